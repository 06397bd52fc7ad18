"""Streaming forms of the operators.

State is kept per key in the state store: a few timestamps or texts, never the history. Within a
micro-batch the rows of a key are put in time order; how many there can be is bounded by the
source's limit per trigger.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from brightwater.functions import fixed_values as fixed
from brightwater.operators.breaker import changes, step
from brightwater.operators.jobs import route_jobs, validate_jobs
from brightwater.operators.limiter import AcceptedWindow
from brightwater.functions.numbers import percent, whole_average
from brightwater.operators.request_log import latency_counts, latency_summary
from brightwater.operators.tables import one_per_key
from brightwater.streaming.runs import batch_writer, keyed_state, run_available, store_checkpoint


def read_queue(spark: SparkSession, path: str, schema, files_per_trigger: int = 1000) -> DataFrame:
    """Stream the files of a folder (or one file) as they appear."""
    return (
        spark.readStream.schema(schema)
        .option("maxFilesPerTrigger", files_per_trigger)
        .parquet(path)
    )


def dequeue(
    queue: DataFrame, path: str, name: str = "dequeue", checkpoint: str | None = None
) -> DataFrame:
    """Take all queued jobs that earlier calls have not taken; all jobs taken so far are returned.

    Within a micro-batch the oldest are written first. Several queues may feed one store under names
    (or checkpoints) of their own.
    """
    place, run = store_checkpoint(path, name, checkpoint)

    def write(batch: DataFrame, number: int) -> None:
        batch_writer(path, run)(batch.sortWithinPartitions("created_at", "job_id"), number)

    run_available(queue, write, place)
    return queue.sparkSession.read.parquet(path)


def _latest(stored: DataFrame, key: str, order: str) -> DataFrame:
    """The newest row per key by its own time; rows of one time are ordered by their content."""
    rest = [c for c in stored.columns if c not in ("run", "batch")]
    newest = F.struct(F.col(order), F.xxhash64(*[F.to_json(F.struct(c)) for c in rest]))
    return one_per_key(stored.select(*rest), [key], lambda row: F.max_by(row, newest))


def compacted(stored: DataFrame, path: str) -> DataFrame:
    """Write a folded store to a new folder, from which later runs can go on, and read it."""
    stored.write.mode("errorifexists").parquet(f"{path}/run=compacted/batch=0")
    return stored.sparkSession.read.parquet(path).drop("run", "batch")


def _in_order(rows: Iterator[pd.DataFrame], *by: str) -> pd.DataFrame:
    return pd.concat(list(rows), ignore_index=True).sort_values(list(by), kind="stable")


class _Limiter(StatefulProcessor):
    def __init__(self, limit: int, window_ms: int):
        self.limit, self.window_ms = limit, window_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        entry = T.StructType(
            [T.StructField("ms", T.LongType()), T.StructField("accepted", T.LongType())]
        )
        self.accepted = handle.getListState("accepted", entry)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        project, user = key
        held = [(e[0], e[1]) for e in self.accepted.get()] if self.accepted.exists() else []
        window = AcceptedWindow(self.limit, self.window_ms, held)
        batch = _in_order(rows, "ts_ms", "id")
        out = [
            (project, user, *_limited(window, row_id, now))
            for row_id, now in zip(batch["id"].tolist(), batch["ts_ms"].tolist())
        ]
        self.accepted.put(list(window.entries))
        yield pd.DataFrame(out, columns=["project", "user_id", *_LIMITED])[_LIMITER_COLUMNS]

    def close(self) -> None:
        pass


#: Decisions of a key are handed on in frames of so many rows.
_FRAME_ROWS = 10_000


class _Slices(StatefulProcessor):
    """Holds rows in time slices until the watermark has passed a slice, then decides it in time order.

    A task sorts one slice of one key at a time, however much of the key a micro-batch brings.
    """

    #: Columns that order rows, the time in milliseconds first, and what else a decision needs.
    columns: tuple[str, ...] = ()
    kinds: tuple[T.DataType, ...] = ()
    #: Columns of the decisions.
    decided: tuple[str, ...] = ()

    def __init__(self, slice_ms: int):
        self.slice_ms = slice_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        row = T.StructType([T.StructField(n, k) for n, k in zip(self.columns, self.kinds)])
        rows = T.StructType([T.StructField("rows", T.ArrayType(row))])
        place = T.StructType([T.StructField(n, T.LongType()) for n in ("slot", "piece")])
        self.waiting = handle.getMapState("waiting", place, rows)
        self.pieces = handle.getValueState("pieces", T.StructType([T.StructField("n", T.LongType())]))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        """Rows are put beside those that wait, as pieces of their slices; there is a timer for the first slice."""
        pieces, first = (self.pieces.get() or (0,))[0], None
        for batch in rows:
            slots: dict[int, list[tuple]] = {}
            for row in zip(*[batch[c].tolist() for c in self.columns]):
                slots.setdefault(row[0] // self.slice_ms, []).append(row)
            for slot, part in slots.items():
                self.waiting.updateValue((slot, pieces), (part,))
                pieces += 1
            first = min([*slots, first] if first is not None else slots)
        self.pieces.update((pieces,))
        self.handle.registerTimer((first + 1) * self.slice_ms)
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = max(timerValues.getCurrentWatermarkInMs(), expiredTimerInfo.getExpiryTimeInMs())
        places = sorted((p[0], p[1]) for p in self.waiting.keys())
        ready = [p for p in places if (p[0] + 1) * self.slice_ms <= passed]
        later = places[len(ready) :]
        state, out = self.resumed(), []
        for _, slice_places in groupby(ready, key=lambda p: p[0]):
            rows = []
            for place in slice_places:
                rows.extend(tuple(r) for r in self.waiting.getValue(place)[0])
                if later:
                    self.waiting.removeKey(place)
            for row in sorted(rows):
                state = self.decide(key, state, row, out)
                if len(out) >= _FRAME_ROWS:
                    yield pd.DataFrame(out, columns=self.decided)
                    out = []
        if out:
            yield pd.DataFrame(out, columns=self.decided)
        if later:
            self.handle.registerTimer((later[0][0] + 1) * self.slice_ms)
        elif ready:
            self.waiting.clear()
            self.pieces.clear()
        self.suspended(state, passed, bool(later))

    def resumed(self):
        """What earlier decisions for the key left."""
        raise NotImplementedError

    def decide(self, key, state, row: tuple, out: list[tuple]):
        """Append what follows from a row and return the state after it."""
        raise NotImplementedError

    def suspended(self, state, now: int, waits: bool) -> None:
        """Store the state; ``waits`` tells whether rows of the key are left."""
        raise NotImplementedError

    def close(self) -> None:
        pass


class _SlicedLimiter(_Slices):
    columns, kinds = ("ts_ms", "id"), (T.LongType(), T.LongType())
    decided = ("id", "project", "user_id", "ts_ms", "allowed", "remaining", "reset_in")

    def __init__(self, limit: int, window_ms: int, slice_ms: int):
        super().__init__(slice_ms)
        self.limit, self.window_ms = limit, window_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        entry = T.StructType([T.StructField("ms", T.LongType()), T.StructField("accepted", T.LongType())])
        self.accepted = handle.getListState("accepted", entry)

    def resumed(self) -> AcceptedWindow:
        held = [(e[0], e[1]) for e in self.accepted.get()] if self.accepted.exists() else []
        return AcceptedWindow(self.limit, self.window_ms, held)

    def decide(self, key, window: AcceptedWindow, row: tuple, out: list[tuple]) -> AcceptedWindow:
        now, row_id = row
        row_id, now, *limited = _limited(window, row_id, now)
        out.append((row_id, *key, now, *limited))
        return window

    def suspended(self, window: AcceptedWindow, now: int, waits: bool) -> None:
        """Forget a user whose window is empty; until then look again when it will be."""
        entries = window.entries
        if waits or entries and entries[-1][0] + self.window_ms > now:
            self.accepted.put(list(entries))
            if not waits:
                self.handle.registerTimer(entries[-1][0] + self.window_ms)
        else:
            self.accepted.clear()


_LIMITED = ["id", "ts_ms", "allowed", "remaining", "reset_in"]
_LIMITER_COLUMNS = ["id", "project", "user_id", "ts_ms", "allowed", "remaining", "reset_in"]


def _limited(window: AcceptedWindow, row_id: int, now: int) -> tuple:
    before, accepted, oldest = window.offer(now, 1)
    if accepted:
        return row_id, now, True, window.limit - before - 1, -(-window.window_ms // 1000)
    return row_id, now, False, 0, -(-(oldest + window.window_ms - now) // 1000)


def _event_timed(df: DataFrame, late: str) -> DataFrame:
    """Rows with their event time under a watermark."""
    return df.withColumn("event_time", F.timestamp_millis("ts_ms")).withWatermark("event_time", late)


def rate_limit_stream(
    requests: DataFrame,
    limit: int = fixed.REQUESTS_PER_WINDOW,
    window_ms: int = fixed.RATE_WINDOW_MS,
    late: str | None = None,
) -> DataFrame:
    """``rate_limit_batch`` on a stream (id, project, user_id, ts_ms), whose id is a long.

    With ``late`` rows may come in any order up to that far behind the newest: they wait in slices of a window
    until the watermark has passed, a user is forgotten when the window is empty, and later rows are
    dropped. Without it rows are decided at once, must arrive in time order across micro-batches (within one
    they are sorted), and users are kept.
    """
    keyed_state(requests.sparkSession)
    timed = late is not None
    source = _event_timed(requests, late) if timed else requests
    return source.groupBy("project", "user_id").transformWithStateInPandas(
        statefulProcessor=_SlicedLimiter(limit, window_ms, window_ms) if timed else _Limiter(limit, window_ms),
        outputStructType=(
            "id long, project string, user_id string, ts_ms long, allowed boolean, "
            "remaining long, reset_in long"
        ),
        outputMode="Append",
        timeMode="EventTime" if timed else "None",
    )


class _Breaker(StatefulProcessor):
    def __init__(self, threshold: int, reset_ms: int, consecutive: bool):
        self.rules = (threshold, reset_ms, consecutive)

    def init(self, handle: StatefulProcessorHandle) -> None:
        fields = [T.StructField(n, T.LongType()) for n in ("failures", "opened")]
        self.current = handle.getValueState("state", T.StructType(fields))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        state = tuple(self.current.get()) if self.current.exists() else (0, -1)
        out = []
        batch = _in_order(rows, "ts_ms", "seq")
        for now, seq, success in zip(
            batch["ts_ms"].tolist(), batch["seq"].tolist(), batch["success"].tolist()
        ):
            after = step(state, now, success, *self.rules)
            out.extend(changes(key[0], now, seq, state, after))
            state = after
        self.current.update(state)
        yield pd.DataFrame(out, columns=["name", "ts_ms", "seq", "before", "after"])

    def close(self) -> None:
        pass


class _SlicedBreaker(_Slices):
    columns, kinds = ("ts_ms", "seq", "success"), (T.LongType(), T.LongType(), T.BooleanType())
    decided = ("name", "ts_ms", "seq", "before", "after")

    def __init__(self, threshold: int, reset_ms: int, consecutive: bool, slice_ms: int):
        super().__init__(slice_ms)
        self.rules = (threshold, reset_ms, consecutive)

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        fields = [T.StructField(n, T.LongType()) for n in ("failures", "opened")]
        self.current = handle.getValueState("state", T.StructType(fields))

    def resumed(self) -> tuple:
        return tuple(self.current.get() or (0, -1))

    def decide(self, key, state: tuple, row: tuple, out: list[tuple]) -> tuple:
        now, seq, success = row
        after = step(state, now, success, *self.rules)
        out.extend(changes(key[0], now, seq, state, after))
        return after

    def suspended(self, state: tuple, now: int, waits: bool) -> None:
        self.current.update(state)


def breaker_stream(
    events: DataFrame,
    threshold: int = fixed.BREAKER_FAILURES,
    reset_ms: int = fixed.BREAKER_RESET_MS,
    consecutive: bool = False,
    late: str | None = None,
) -> DataFrame:
    """``breaker_batch`` on a stream (name, ts_ms, seq, success).

    ``late`` is that of ``rate_limit_stream``: rows wait in slices of ``reset_ms`` until the watermark has
    passed; without it they must arrive in time order across micro-batches.
    """
    keyed_state(events.sparkSession)
    timed = late is not None
    processor = (
        _SlicedBreaker(threshold, reset_ms, consecutive, reset_ms)
        if timed
        else _Breaker(threshold, reset_ms, consecutive)
    )
    return (_event_timed(events, late) if timed else events).groupBy("name").transformWithStateInPandas(
        statefulProcessor=processor,
        outputStructType="name string, ts_ms long, seq long, before string, after string",
        outputMode="Append",
        timeMode="EventTime" if timed else "None",
    )


class _Memory(StatefulProcessor):
    def __init__(self, n: int):
        self.n = n

    def init(self, handle: StatefulProcessorHandle) -> None:
        entry = T.StructType(
            [T.StructField("seq", T.LongType()), T.StructField("text", T.StringType())]
        )
        self.recent = handle.getListState("recent", entry)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        held = [(e[0], e[1]) for e in self.recent.get()] if self.recent.exists() else []
        for batch in rows:
            held.extend(zip(batch["seq"].tolist(), batch["text"].tolist()))
            held = sorted(held)[-self.n :]
        self.recent.put(held)
        yield pd.DataFrame(
            {
                "user_id": [key[0]],
                "role": ["user"],
                "recent_interactions": [[text for _, text in held]],
                "last_seq": [held[-1][0]],
            }
        )

    def close(self) -> None:
        pass


def memory_stream(interactions: DataFrame, n: int = 10) -> DataFrame:
    """The last ``n`` texts of each user that a micro-batch touched, oldest first."""
    keyed_state(interactions.sparkSession)
    return interactions.groupBy("user_id").transformWithStateInPandas(
        statefulProcessor=_Memory(n),
        outputStructType=(
            "user_id string, role string, recent_interactions array<string>, last_seq long"
        ),
        outputMode="Update",
        timeMode="None",
    )


def latest_memory(updates: DataFrame) -> DataFrame:
    """The newest memory row per user of a collected ``memory_stream``."""
    newest = F.max_by(F.struct("role", "recent_interactions"), "last_seq")
    return (
        updates.groupBy("user_id").agg(newest.alias("row")).select("user_id", "row.*")
    )


def request_stats_stream(logs: DataFrame, late: str = "1 hour") -> DataFrame:
    """Priced logs counted per hour, project and distinct latency; ``latest_windows`` reads windows from it.

    State is one row per hour and count. Rows that come later than ``late`` behind the newest are dropped
    if their hour has been closed by then.
    """
    timed = logs.withColumn("created_at", F.col("created_at").cast("timestamp"))
    hour = F.window("created_at", "1 hour").alias("hour")
    counted = latency_counts(timed.withWatermark("created_at", late), hour, "project")
    return counted.withColumn("hour", F.col("hour.start"))


def latest_windows(updates: DataFrame, hours: int = 24) -> DataFrame:
    """The statistics of ``request_stats`` per project and every window of ``hours`` that starts on an hour.

    ``updates`` are the collected rows of ``request_stats_stream``, of which the last per count holds.
    """
    key = ["hour", "project", "latency_ms"]
    final = one_per_key(updates, key, lambda row: F.max_by(row, F.col("batch"))).drop("batch")
    first = F.col("hour") - F.expr(f"INTERVAL {hours - 1} HOURS")
    starts = F.explode(F.sequence(first, F.col("hour"), F.expr("INTERVAL 1 HOUR")))
    return latency_summary(final.withColumn("window_start", starts), "window_start", "project")


#: Size of the quantile sketches of ``request_sketch_stream``; a quantile is off by SKETCH_ERROR of the ranks, rarely more.
SKETCH_K, SKETCH_ERROR = 800, 0.005


def request_sketch_stream(logs: DataFrame, late: str = "1 hour", k: int = SKETCH_K) -> DataFrame:
    """Priced logs summed per hour and project, with a mergeable sketch of the latencies.

    State is one row of bounded size per hour and project, however many different latencies there are;
    ``sketched_windows`` reads windows from it. ``late`` is that of ``request_stats_stream``.
    """
    timed = logs.withColumn("created_at", F.col("created_at").cast("timestamp")).withWatermark("created_at", late)
    hour = F.window("created_at", "1 hour").alias("hour")
    summed = timed.groupBy(hour, "project").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum("latency_ms").alias("latency"),
        F.kll_sketch_agg_bigint(F.col("latency_ms").cast("bigint"), k).alias("sketch"),
        F.sum(F.col("tokens_in") + F.col("tokens_out")).alias("tokens"),
        F.sum(F.col("cost_usd").cast("decimal(10,6)")).alias("cost"),
        F.count_if(F.col("status") == "error").alias("errors"),
    )
    return summed.withColumn("hour", F.col("hour.start"))


def sketched_windows(updates: DataFrame, hours: int = 24) -> DataFrame:
    """The statistics of ``request_stats`` per project and every window of ``hours`` that starts on an hour.

    Everything is exact but ``p95_latency_ms``, which is a latency whose rank is within ``SKETCH_ERROR`` of
    95 percent. ``updates`` are the collected rows of ``request_sketch_stream``, of which the last per hour holds.
    """
    final = one_per_key(updates, ["hour", "project"], lambda row: F.max_by(row, F.col("batch"))).drop("batch")
    first = F.col("hour") - F.expr(f"INTERVAL {hours - 1} HOURS")
    starts = F.explode(F.sequence(first, F.col("hour"), F.expr("INTERVAL 1 HOUR")))
    totals = final.withColumn("window_start", starts).groupBy("window_start", "project").agg(
        F.sum("n").alias("total_requests"),
        F.sum("latency").alias("latency"),
        F.kll_merge_agg_bigint("sketch").alias("sketch"),
        F.sum("tokens").alias("total_tokens"),
        F.sum("cost").alias("cost"),
        F.sum("errors").alias("error_count"),
    )
    return totals.select(
        "window_start",
        "project",
        "total_requests",
        whole_average(F.col("latency"), F.col("total_requests")).alias("avg_latency_ms"),
        F.kll_sketch_get_quantile_bigint("sketch", F.lit(0.95).cast("double")).alias("p95_latency_ms"),
        "total_tokens",
        F.col("cost").cast("double").alias("total_cost_usd"),
        "error_count",
        percent(F.col("error_count"), F.col("total_requests"), 2).alias("error_rate_pct"),
    )


def job_stream(
    jobs: DataFrame,
    today,
    path: str,
    name: str = "job-stream",
    order: str = "created_at",
    checkpoint: str | None = None,
) -> DataFrame:
    """Validate, route and extract queued jobs; one row per job in the store with its status.

    Invalid jobs fail with their validation error. A job that is queued again replaces its row if it is newer
    by ``order``, whichever run or micro-batch brought it; a retried micro-batch rewrites its own folder.
    A later run goes on after the input that was taken under this name (or checkpoint).
    """
    place, run = store_checkpoint(path, name, checkpoint)

    def write(batch: DataFrame, number: int) -> None:
        checked = validate_jobs(batch).withColumnRenamed("error", "invalid")
        routed = route_jobs(checked, today).withColumns(
            {
                "status": F.when(F.col("invalid").isNotNull(), "failed").otherwise(F.col("status")),
                "error": F.coalesce("invalid", "error"),
                **{
                    kind: F.when(F.col("invalid").isNull(), F.col(kind))
                    for kind in ("invoice", "email", "ticket")
                },
            }
        )
        batch_writer(path, run)(routed.drop("invalid", "input_text", "input_json"), number)

    run_available(jobs, write, place)
    return _latest(jobs.sparkSession.read.parquet(path), "job_id", order)


#: Groups of jobs that share their state, as one call for each of many small keys costs more than its rows.
JOB_GROUPS = 256


class _Remembered(StatefulProcessor):
    """The jobs of a group, each with the time from which it is remembered, in slices of that time."""

    def __init__(self, keep_ms: int):
        self.keep_ms = keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        longs = T.ArrayType(T.LongType())
        kept = T.StructType([T.StructField("jobs", longs), T.StructField("since", longs)])
        self.kept = handle.getMapState("kept", T.StructType([T.StructField("slot", T.LongType())]), kept)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        held = {slot[0]: (list(kept[0]), list(kept[1])) for slot, kept in self.kept.iterator()}
        since: dict[int | None, int] = {}
        for jobs, times in held.values():
            for job, ms in zip(jobs, times):
                since[job] = max(ms, since.get(job, ms))
        batch = _in_order(rows, "created_ms")
        new, touched = [], set()
        for job, now in zip(batch["job_id"].tolist(), batch["created_ms"].tolist()):
            job = job if job == job else None
            if job not in since or now - since[job] > self.keep_ms:
                since[job] = now
                new.append((job, now))
                slot = now // self.keep_ms
                touched.add(slot)
                jobs, times = held.setdefault(slot, ([], []))
                jobs.append(job)
                times.append(now)
        for slot in touched:
            self.kept.updateValue((slot,), held[slot])
        if new:
            self.handle.registerTimer((min(touched) + 2) * self.keep_ms)
            yield pd.DataFrame(new, columns=["job_id", "created_ms"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        """Forget the slices of which no job is remembered any more; there is a timer for the first that is left."""
        passed = max(timerValues.getCurrentWatermarkInMs(), expiredTimerInfo.getExpiryTimeInMs())
        slots = [s[0] for s in self.kept.keys()]
        left = [s for s in slots if (s + 2) * self.keep_ms > passed]
        if left:
            for slot in set(slots).difference(left):
                self.kept.removeKey((slot,))
            self.handle.registerTimer((min(left) + 2) * self.keep_ms)
        else:
            self.kept.clear()
        yield from ()

    def close(self) -> None:
        pass


def job_expiry_stream(finished: DataFrame, hours: int = fixed.JOB_RETENTION_HOURS) -> DataFrame:
    """Finished jobs (job_id, created_at), each remembered for ``hours`` of event time.

    A job that shows up again while it is remembered is not emitted again; after that it is new,
    and its state is removed when the watermark passes. Jobs share their state in ``JOB_GROUPS`` groups.
    """
    keyed_state(finished.sparkSession)
    timed = finished.select(
        F.col("job_id").cast("long").alias("job_id"),
        F.col("created_at").cast("timestamp").alias("created_at"),
        F.unix_millis(F.col("created_at").cast("timestamp")).alias("created_ms"),
    ).withWatermark("created_at", f"{hours} hours")
    group = F.when(F.col("job_id").isNotNull(), F.pmod(F.xxhash64("job_id"), F.lit(JOB_GROUPS)))
    return timed.withColumn("job_group", group).groupBy("job_group").transformWithStateInPandas(
        statefulProcessor=_Remembered(hours * 3_600_000),
        outputStructType="job_id long, created_ms long",
        outputMode="Append",
        timeMode="EventTime",
    )


def session_store_stream(
    sessions: DataFrame,
    path: str,
    order: str = "seq",
    name: str = "sessions",
    checkpoint: str | None = None,
) -> DataFrame:
    """Upsert sessions by session_id: the newest row of each, by ``order``.

    Every micro-batch appends its newest row per session; the table is folded when it is read, so
    no batch rewrites the store. Later runs add to it (see ``job_stream``).
    """
    place, run = store_checkpoint(path, name, checkpoint)

    def write(batch: DataFrame, number: int) -> None:
        batch_writer(path, run)(_latest(batch, "session_id", order), number)

    run_available(sessions, write, place)
    return _latest(sessions.sparkSession.read.parquet(path), "session_id", order)
