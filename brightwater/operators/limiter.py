"""Sliding-window rate limiting over a stored request log.

Only accepted requests occupy the window, so a decision depends on earlier decisions. Three
observations keep the exact answer distributed:

* Requests of one user in the same millisecond share one decision row, so the log is first counted
  per user and millisecond.
* Time is cut into buckets of one window. If a bucket and the one before it hold at most ``limit``
  requests, everything in the bucket is accepted whatever happened earlier. Such quiet buckets
  are handled by an ordinary window over short slices.
* Only runs of other buckets need the decisions in sequence. A run starts after a quiet bucket,
  whose accepted requests are known, so runs are independent of each other and each is streamed in
  time order with at most ``limit`` entries of state.
* A long run is cut into time slices. All slices first start from an empty window; then every slice
  whose predecessor ends with another window than it started from is run again from that one, until
  none is left. Windows soon meet whatever they started from, unless traffic keeps them apart.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from brightwater.functions import fixed_values as fixed
from brightwater.plans.scratch import written
from brightwater.plans.skew import with_time_slices

_USER = ["project", "user_id"]

# Distinct milliseconds of a busy run that one task streams; longer runs are sliced.
RUN_CELLS = 100_000


class AcceptedWindow:
    """Accepted requests of one user inside the window, oldest first."""

    def __init__(self, limit: int, window_ms: int, entries=()):
        self.limit, self.window_ms = limit, window_ms
        self.entries = deque(entries)
        self.held = sum(count for _, count in self.entries)

    def offer(self, now: int, requests: int, known: bool = False) -> tuple[int, int, int | None]:
        """Offer requests made at ``now``; returns (held before, accepted, oldest held time)."""
        while self.entries and self.entries[0][0] <= now - self.window_ms:
            self.held -= self.entries.popleft()[1]
        before = self.held
        accepted = requests if known else max(0, min(requests, self.limit - before))
        if accepted:
            self.entries.append((now, accepted))
            self.held += accepted
        return before, accepted, self.entries[0][0] if self.entries else None


def requests_in_window(
    requests: DataFrame, window_ms: int = fixed.RATE_WINDOW_MS, slice_ms: int | None = None
) -> DataFrame:
    """Add ``in_window``: the user's requests in the window that ends with each request.

    This counts rejected requests too, so it is an upper bound of what the limiter sees. The
    window runs over time slices that carry the end of the previous slice as context.
    """
    reach = window_ms - 1
    width = max(slice_ms or 60 * window_ms, window_ms)
    sliced = with_time_slices(requests, F.col("ts_ms"), reach, width)
    order = Window.partitionBy(*_USER, "_slot").orderBy("ts_ms").rangeBetween(-reach, 0)
    return (
        sliced.withColumn("in_window", F.count(F.lit(1)).over(order))
        .filter("_own")
        .drop("_slot", "_own")
    )


def _marked_buckets(cells: DataFrame, limit: int) -> DataFrame:
    """One row per user and non-empty bucket: is it busy, in a chain, in which run, before which run.

    A user has at most one row per window length of time here, however many requests that were.
    """
    buckets = cells.groupBy(*_USER, "bucket").agg(F.sum("n").alias("bucket_n"))
    order = Window.partitionBy(*_USER).orderBy("bucket")
    follows = F.coalesce(F.lag("bucket").over(order) == F.col("bucket") - 1, F.lit(False))
    precedes = F.coalesce(F.lead("bucket").over(order) == F.col("bucket") + 1, F.lit(False))
    before = F.when(follows, F.lag("bucket_n").over(order)).otherwise(F.lit(0))
    busy = buckets.withColumn("busy", F.col("bucket_n") + before > limit)
    chained = busy.withColumn(
        "in_chain", F.col("busy") | (follows & F.lag("busy").over(order))
    ).withColumn("_chained", F.sum(F.col("in_chain").cast("int")).over(order))
    runs = chained.withColumn(
        "run", F.when(F.col("in_chain"), F.col("bucket") - F.col("_chained"))
    )
    opens = ~F.col("in_chain") & precedes & F.lead("in_chain").over(order)
    return runs.withColumn("context_of", F.when(opens, F.lead("run").over(order))).select(
        *_USER, "bucket", "busy", "in_chain", "run", "context_of"
    )


_SLICE = [*_USER, "run", "slot"]
_WINDOW = "array<struct<ms: long, accepted: long>>"


def _replayed(cells: DataFrame, limit: int, window_ms: int, decisions: bool) -> DataFrame:
    """Run slices in time order from their ``entry`` windows: their decisions, or their exit windows."""
    columns = ["project", "user_id", "ts_ms", "n", "before", "accepted", "oldest"]
    schema = "project string, user_id string, ts_ms long, n long, before long, accepted long, oldest long"
    exits = f"project string, user_id string, run long, slot long, exit {_WINDOW}"

    def ended(key, window) -> pd.DataFrame:
        held = [{"ms": ms, "accepted": count} for ms, count in window.entries]
        return pd.DataFrame([(*key, held)], columns=[*_SLICE, "exit"])

    def decide(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, window = None, AcceptedWindow(limit, window_ms)
        for batch in batches:
            out = []
            entries = batch.entry if "entry" in batch else [None] * len(batch)
            for project, user, run, slot, now, n, known, entry in zip(
                batch.project, batch.user_id, batch.run, batch.slot, batch.ts_ms, batch.n, batch.known, entries
            ):
                if (project, user, run, slot) != current:
                    if current is not None and not decisions:
                        yield ended(current, window)
                    current = (project, user, run, slot)
                    held = [(e["ms"], e["accepted"]) for e in entry] if entry is not None else ()
                    window = AcceptedWindow(limit, window_ms, held)
                decision = window.offer(int(now), int(n), bool(known))
                if not known:
                    out.append((project, user, now, n, *decision))
            if decisions:
                yield pd.DataFrame(out, columns=columns)
        if current is not None and not decisions:
            yield ended(current, window)

    ordered = cells.repartition(*_SLICE).sortWithinPartitions(*_SLICE, "ts_ms")
    return ordered.mapInPandas(decide, schema if decisions else exits)


def _decide_runs(
    cells: DataFrame, limit: int, window_ms: int, slice_ms: int, run_cells: int
) -> DataFrame:
    """Decisions for cells of busy runs, each run or slice of a long run streamed in time order."""
    long_runs = (
        cells.groupBy(*_USER, "run").agg(F.count(F.lit(1)).alias("size")).filter(F.col("size") > run_cells)
    )
    if long_runs.isEmpty():
        return _replayed(cells.withColumn("slot", F.lit(0).cast("long")), limit, window_ms, True)
    slot = F.when(F.col("size").isNotNull(), F.floor(F.col("ts_ms") / F.lit(slice_ms))).otherwise(F.lit(0))
    cells = cells.join(long_runs, [*_USER, "run"], "left").withColumn("slot", slot.cast("long")).drop("size")
    cells = written(cells, "busy-cells")
    exits = written(_replayed(cells, limit, window_ms, False), "exits")
    entries = exits.select(*_SLICE, F.array().cast(_WINDOW).alias("entry"))
    order = Window.partitionBy(*_USER, "run").orderBy("slot")
    while True:
        # What the slice before ends with is what this one starts from.
        handed = exits.withColumn("given", F.lag("exit").over(order)).select(*_SLICE, "given")
        wanted = entries.join(handed, _SLICE).withColumn(
            "given", F.coalesce("given", F.array().cast(_WINDOW))
        )
        wanted = wanted.withColumn("again", ~F.col("given").eqNullSafe(F.col("entry")))
        step = written(wanted, "entries")
        entries = step.select(*_SLICE, F.col("given").alias("entry"))
        again = step.filter("again").select(*_SLICE, F.col("given").alias("entry"))
        if again.isEmpty():
            return _replayed(cells.join(entries, _SLICE), limit, window_ms, True)
        rerun = _replayed(cells.join(again, _SLICE), limit, window_ms, False)
        exits = written(
            exits.join(again.select(*_SLICE), _SLICE, "left_anti").unionByName(rerun), "exits"
        )


def _decide_quiet(cells: DataFrame, window_ms: int) -> DataFrame:
    """Decisions for cells of quiet buckets: all accepted, only the count before is needed."""
    reach = window_ms - 1
    sliced = with_time_slices(cells, F.col("ts_ms"), reach, 60 * window_ms)
    earlier = Window.partitionBy(*_USER, "_slot").orderBy("ts_ms").rangeBetween(-reach, -1)
    return (
        sliced.withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0)))
        .filter("_own AND NOT in_chain")
        .select(
            *_USER,
            "ts_ms",
            "n",
            "before",
            F.col("n").alias("accepted"),
            F.lit(None).cast("long").alias("oldest"),
        )
    )


def rate_limit_batch(
    requests: DataFrame,
    limit: int = fixed.REQUESTS_PER_WINDOW,
    window_ms: int = fixed.RATE_WINDOW_MS,
    slice_ms: int | None = None,
    run_cells: int = RUN_CELLS,
) -> DataFrame:
    """Add ``allowed``, ``remaining`` and ``reset_in`` (seconds) to each request.

    ``requests`` has id, project, user_id (both strings) and ts_ms. Requests of one user are taken
    in the order of (ts_ms, id). A busy run of more than ``run_cells`` distinct milliseconds is cut into slices
    of ``slice_ms`` (by default 60 windows); the result depends on neither.
    """
    cells = requests.groupBy(
        *_USER, F.floor(F.col("ts_ms") / F.lit(window_ms)).alias("bucket"), "ts_ms"
    ).agg(F.count(F.lit(1)).alias("n"))
    cells = written(cells, "cells")
    marked = cells.join(_marked_buckets(cells, limit), [*_USER, "bucket"])

    run = F.coalesce("run", "context_of")
    chained = marked.filter(run.isNotNull()).select(
        *_USER, run.alias("run"), "ts_ms", "n", (~F.col("in_chain")).alias("known")
    )
    # A cell outside the chains sees only its own bucket and the one before, and both are quiet.
    decisions = _decide_runs(chained, limit, window_ms, max(slice_ms or 60 * window_ms, window_ms), run_cells).unionByName(
        _decide_quiet(marked.filter("NOT busy"), window_ms)
    )

    decided = requests.join(decisions, [*_USER, "ts_ms"])
    # Only requests that share their millisecond need an order; of those, the accepted come first.
    alone = decided.filter("n = 1").withColumn("place", F.lit(1))
    among = Window.partitionBy(*_USER, "ts_ms").orderBy("id")
    shared = decided.filter("n > 1")
    first = (
        shared.select(*_USER, "ts_ms", "id")
        .withColumn("place", F.row_number().over(among))
        .filter(F.col("place") <= limit)
        .select("id", "place")
    )
    placed = alone.unionByName(shared.join(first, "id", "left"))
    allowed = F.coalesce(F.col("place") <= F.col("accepted"), F.lit(False))
    wait = F.ceil((F.col("oldest") + F.lit(window_ms) - F.col("ts_ms")) / F.lit(1000.0))
    full = -(-window_ms // 1000)
    return placed.select(
        *requests.columns,
        allowed.alias("allowed"),
        F.when(allowed, F.lit(limit) - F.col("before") - F.col("place"))
        .otherwise(F.lit(0))
        .cast("long")
        .alias("remaining"),
        F.when(allowed, F.lit(full)).otherwise(wait).cast("long").alias("reset_in"),
    )
