"""Streams over several micro-batches end with what the batch form gives."""

import time

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from brightwater.entries import guard_jobs, stores_streams
from brightwater.operators import breaker, limiter
from brightwater.operators.tables import last_n_interactions
from brightwater.plans import tables
from brightwater.plans.scratch import scratch_path
from brightwater.streaming import streams
from brightwater.streaming.runs import batch_writer, collected, run_available

FOLDER = "/root/testdata/sf0.001"
PARTS = 4


def in_parts(spark, df, order, name):
    """The rows as a stream of files in time order, one file per micro-batch."""
    path = scratch_path(spark, name)
    rows = df.toPandas().sort_values(order, kind="stable")
    for part in range(PARTS):
        piece = rows.iloc[part * len(rows) // PARTS : (part + 1) * len(rows) // PARTS]
        spark.createDataFrame(piece, df.schema).coalesce(1).write.mode("append").parquet(path)
        time.sleep(0.05)
    return streams.read_queue(spark, path, df.schema, files_per_trigger=1)


def same(left, right):
    assert sorted(map(tuple, left.select(*sorted(left.columns)).collect())) == sorted(
        map(tuple, right.select(*sorted(right.columns)).collect())
    )


def test_limiter_stream(spark):
    requests = guard_jobs.limited_requests(spark, FOLDER).withColumn("user_id", F.col("user_id").substr(1, 1))
    stream = in_parts(spark, requests, ["ts_ms", "id"], "requests")
    got = collected(streams.rate_limit_stream(stream, 3, guard_jobs.DAY_MS), "limited")
    assert got.select("batch").distinct().count() == PARTS
    same(got.drop("batch"), limiter.rate_limit_batch(requests, 3, guard_jobs.DAY_MS))


def test_breaker_stream(spark):
    events = guard_jobs.call_outcomes(spark, FOLDER)
    stream = in_parts(spark, events, ["ts_ms", "seq"], "calls")
    got = collected(streams.breaker_stream(stream, 3, guard_jobs.RESET_MS), "broken")
    same(got.drop("batch"), breaker.breaker_batch(events, 3, guard_jobs.RESET_MS, slice_ms=guard_jobs.DAY_MS))


def out_of_order(spark, df, name, flush, by="ts_ms"):
    """The rows in files that overlap in time, then one far later row that lets the watermark pass all."""
    path = scratch_path(spark, name)
    rows = df.toPandas().sort_values(by).reset_index(drop=True)
    rows = rows.iloc[[i for k in range(PARTS) for i in range(k, len(rows), PARTS)]]
    for part in range(PARTS):
        piece = rows.iloc[part * len(rows) // PARTS : (part + 1) * len(rows) // PARTS]
        spark.createDataFrame(piece, df.schema).coalesce(1).write.mode("append").parquet(path)
        time.sleep(0.05)
    spark.createDataFrame([flush], df.schema).coalesce(1).write.mode("append").parquet(path)
    return streams.read_queue(spark, path, df.schema, files_per_trigger=1)


def test_limiter_stream_out_of_order(spark):
    """Rows in any order within the lateness are decided as in time order."""
    requests = guard_jobs.limited_requests(spark, FOLDER).withColumn("user_id", F.col("user_id").substr(1, 1))
    last = requests.agg(F.max("ts_ms")).first()[0]
    flush = (-1, "flush", "flush", last + 1000 * guard_jobs.DAY_MS)
    wide = requests.select("id", "project", "user_id", "ts_ms")
    stream = out_of_order(spark, wide, "requests-mixed", flush)
    got = collected(streams.rate_limit_stream(stream, 3, guard_jobs.DAY_MS, late="400 days"), "limited-mixed")
    same(got.drop("batch").filter("id >= 0"), limiter.rate_limit_batch(wide, 3, guard_jobs.DAY_MS))


def test_breaker_stream_out_of_order(spark):
    events = guard_jobs.call_outcomes(spark, FOLDER).select("name", "ts_ms", "seq", "success")
    last = events.agg(F.max("ts_ms")).first()[0]
    flush = ("flush", last + 1000 * guard_jobs.DAY_MS, -1, True)
    stream = out_of_order(spark, events, "calls-mixed", flush)
    got = collected(streams.breaker_stream(stream, 3, guard_jobs.RESET_MS, late="400 days"), "broken-mixed")
    want = breaker.breaker_batch(events, 3, guard_jobs.RESET_MS, slice_ms=guard_jobs.DAY_MS)
    same(got.drop("batch").filter("name <> 'flush'"), want)


def test_users_are_forgotten(spark):
    """After the watermark has passed a user's window, the state store holds nothing of the user."""
    path = scratch_path(spark, "requests-few")
    schema = "id long, project string, user_id string, ts_ms long"
    for i, rows in enumerate([[(1, "p", "a", 1000), (2, "p", "a", 1500)], [(3, "p", "b", 90_000)], [(4, "p", "c", 900_000)], [(5, "p", "c", 9_000_000)]]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)
        time.sleep(0.05)
    stream = streams.read_queue(spark, path, spark.createDataFrame([], schema).schema, 1)
    store, checkpoint = scratch_path(spark, "few"), scratch_path(spark, "few-state")
    decided = streams.rate_limit_stream(stream, 1, 2000, late="1 second")
    run_available(decided, batch_writer(store, "run"), checkpoint)
    got = {r.id: (r.allowed, r.reset_in) for r in spark.read.parquet(store).collect()}
    assert got == {1: (True, 2), 2: (False, 2), 3: (True, 2), 4: (True, 2)}
    held = spark.read.format("statestore").option("stateVarName", "accepted").load(checkpoint)
    assert {r.key.user_id for r in held.select("key").collect()} <= {"c"}


def test_memory_stream(spark):
    turns = tables.interactions(spark, FOLDER)
    stream = in_parts(spark, turns, ["seq"], "turns")
    got = streams.latest_memory(collected(streams.memory_stream(stream, 3), "memory", mode="update"))
    same(got, last_n_interactions(turns, 3))


def test_sessions_stream(spark):
    rows = spark.createDataFrame(
        [("a", "one", 1), ("b", "two", 2), ("a", "three", 3), ("b", "four", 4)],
        "session_id string, transcript string, seq long",
    )
    stream = in_parts(spark, rows, ["seq"], "sessions")
    got = streams.session_store_stream(stream, scratch_path(spark, "sessions-out"))
    assert sorted(map(tuple, got.collect())) == [("a", "three", 3), ("b", "four", 4)]


def test_expired_jobs_are_forgotten(spark):
    rows = spark.createDataFrame(
        [(1, "2024-01-01 00:00:00"), (1, "2024-01-01 05:00:00"), (2, "2024-01-04 00:00:00"), (1, "2024-01-09 00:00:00")],
        "job_id long, created_at string",
    ).withColumn("created_at", F.col("created_at").cast("timestamp"))
    stream = in_parts(spark, rows, ["created_at"], "finished")
    got = collected(streams.job_expiry_stream(stream), "expiry")
    assert sorted(r.job_id for r in got.collect()) == [1, 1, 2]


def test_retried_batch_replaces_itself(spark):
    path = scratch_path(spark, "retried")
    write = batch_writer(path, "run")
    write(spark.range(3), 0)
    write(spark.range(3), 0)
    assert spark.read.parquet(path).count() == 3


def queue_of(spark, rows, schema, *name):
    path = scratch_path(spark, "-".join(name or ("queue",)))
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(path)
    return path, lambda: streams.read_queue(spark, path, spark.createDataFrame([], schema).schema, 1)


def test_two_queues_and_the_same_queue_twice(spark):
    schema = "session_id string, transcript string, seq long"
    _, first = queue_of(spark, [("a", "one", 1), ("b", "two", 2)], schema)
    _, second = queue_of(spark, [("a", "late", 0), ("b", "new", 3), ("c", "x", 1)], schema)
    path = scratch_path(spark, "sessions-two")
    streams.session_store_stream(first(), path, name="first")
    want = [("a", "one", 1), ("b", "new", 3), ("c", "x", 1)]
    for _ in range(2):
        got = streams.session_store_stream(second(), path, name="second")
        assert sorted(map(tuple, got.collect())) == want
    again = streams.session_store_stream(first(), path, checkpoint=scratch_path(spark, "own"))
    assert sorted(map(tuple, again.collect())) == want
    assert sorted(map(tuple, streams.compacted(again, scratch_path(spark, "compact")).collect())) == want


def test_jobs_are_taken_once(spark):
    schema = "job_id long, created_at timestamp"
    path, queue = queue_of(spark, [], schema)
    store = scratch_path(spark, "taken-twice")
    for start in (0, 5):
        spark.range(start, start + 5).selectExpr("id job_id", "current_timestamp() created_at").write.mode("append").parquet(path)
        for _ in range(2):
            taken = streams.dequeue(queue(), store)
    assert sorted(r.job_id for r in taken.collect()) == list(range(10))


def test_newest_job_wins_in_any_order(spark):
    schema = "job_id long, pipeline_type string, input_text string, input_json string, created_at long"
    kind = "support_ticket_categorization"
    old, new = (1, "translation", "refund", None, 1), (1, kind, "refund please", None, 2)
    for rows in ([old, new], [new, old]):
        path = scratch_path(spark, "jobs-order")
        for number, row in enumerate(rows):
            _, queue = queue_of(spark, [row], schema)
            done = streams.job_stream(queue(), F.lit("2024-06-30"), path, f"queue-{number}")
        assert [(r.job_id, r.status, r.created_at) for r in done.collect()] == [(1, "completed", 2)]
    _, both = queue_of(spark, [new, old], schema)
    done = streams.job_stream(both(), F.lit("2024-06-30"), scratch_path(spark, "jobs-tie"))
    assert [r.status for r in done.collect()] == ["completed"]


@pytest.mark.parametrize("late, kept", [("1 hour", 2), ("10 days", 3)])
def test_late_rows(spark, late, kept):
    rows = [("2024-01-05 00:10:00",), ("2024-01-05 01:20:00",), ("2024-01-07 00:00:00",), ("2024-01-01 00:00:00",)]
    logs = spark.createDataFrame(rows, "created_at string").select(
        F.lit("p").alias("project"),
        F.lit(5).alias("latency_ms"),
        F.lit(1).alias("tokens_in"),
        F.lit(1).alias("tokens_out"),
        F.lit(0.5).alias("cost_usd"),
        F.lit("success").alias("status"),
        F.col("created_at").cast("timestamp").alias("created_at"),
    )
    path = scratch_path(spark, "late")
    for i in range(4):
        logs.filter(F.col("created_at") == F.lit(rows[i][0]).cast("timestamp")).coalesce(1).write.mode("append").parquet(path)
        time.sleep(0.05)
    stream = streams.read_queue(spark, path, logs.schema, files_per_trigger=1)
    updates = collected(streams.request_stats_stream(stream, late=late), "late-out", mode="update")
    days = streams.latest_windows(updates).filter("hour(window_start) = 0 AND date_format(window_start, 'dd') IN ('01', '05', '07')")
    assert days.count() == kept
    assert {(r.total_requests, r.total_cost_usd, r.error_rate_pct) for r in days.collect()} == {(2, 1.0, 0.0), (1, 0.5, 0.0)}


def test_sketches_keep_their_size_and_error(spark):
    """Many different latencies, in several micro-batches: bounded state, and a percentile near the exact one."""
    path = scratch_path(spark, "logs")
    rows = spark.range(60_000).selectExpr(
        "id", "concat('p', id % 2) project", "cast(pmod(hash(id), 1000003) as int) latency_ms", "1 tokens_in", "2 tokens_out",
        "cast(0.5 as double) cost_usd", "if(id % 10 = 0, 'error', 'success') status",
        "timestamp_millis(1700000000000 + (id % 7200) * 1000) created_at",
    )
    for part in range(3):
        rows.where(f"id % 3 = {part}").coalesce(1).write.mode("append").parquet(path)
        time.sleep(0.05)
    stream = streams.read_queue(spark, path, rows.schema, 1)
    updates = collected(streams.request_sketch_stream(stream, late="1 day"), "sketch", mode="update")
    assert updates.agg(F.max(F.length("sketch"))).first()[0] < 60_000 and updates.select("batch").distinct().count() >= 3
    got = streams.sketched_windows(updates, hours=2).collect()
    hours = rows.selectExpr("*", "explode(sequence(date_trunc('hour', created_at) - interval 1 hour, date_trunc('hour', created_at), interval 1 hour)) w")
    exact = {(r.w, r.project): r for r in hours.groupBy("w", "project").agg(F.sort_array(F.collect_list("latency_ms")).alias("l")).collect()}
    assert len(got) == len(exact) > 4
    for r in got:
        values = np.array(exact[r.window_start, r.project].l)
        below, upto = (values < r.p95_latency_ms).mean(), (values <= r.p95_latency_ms).mean()
        assert below <= 0.95 + streams.SKETCH_ERROR and upto >= 0.95 - streams.SKETCH_ERROR
        assert r.total_requests == len(values) and r.avg_latency_ms == (2 * int(values.sum()) + len(values)) // (2 * len(values))
        assert (r.total_tokens, r.total_cost_usd) == (3 * len(values), 0.5 * len(values))


def below(plan, node):
    """The nodes under every ``node`` of a printed plan."""
    lines = plan.splitlines()
    depths = [len(line) - len(line.lstrip(" :+-")) for line in lines]
    for at, line in enumerate(lines):
        if line.lstrip(" :+-").startswith(node):
            for depth, inner in zip(depths[at + 1 :], lines[at + 1 :]):
                if depth <= depths[at]:
                    break
                yield inner.lstrip(" :+-*()0123456789")


def test_counts_of_windows_are_not_broadcast(spark):
    """The log opened into windows is many times its files: no driver may hold it."""
    plan = stores_streams.request_sketch_stream(spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    assert "Generate explode" in plan
    assert not [node for node in below(plan, "BroadcastExchange") if node.startswith("Generate")]


class Remembering:
    """State of one key in memory, which counts how often it is asked."""

    def __init__(self):
        self.calls, self.stores, self.timers = 0, {}, set()

    def __getattr__(self, name):
        return lambda variable, *_: Held(self, self.stores.setdefault(variable, {}))

    def registerTimer(self, at):
        self.calls += 1
        self.timers.add(at)


class Held:
    def __init__(self, handle, store):
        self.handle, self.store = handle, store

    def __getattr__(self, name):
        self.handle.calls += 1
        return {
            "exists": lambda: bool(self.store), "clear": self.store.clear, "keys": lambda: iter(list(self.store)),
            "get": lambda: self.store.get(None), "put": lambda rows: self.store.update({None: rows}),
            "update": lambda value: self.store.update({None: value}), "getValue": self.store.get,
            "updateValue": lambda at, value: self.store.update({at: value}), "containsKey": self.store.__contains__,
            "removeKey": self.store.pop, "iterator": lambda: iter(list(self.store.items())),
        }[name]


class Times:
    def __init__(self, now):
        self.getCurrentWatermarkInMs = self.getExpiryTimeInMs = lambda: now


def test_waiting_slices_cost_few_calls_and_one_frame(spark):
    """30 slices of a user that pass together: one timer, one frame of decisions, few calls to the state."""
    handle, limiting = Remembering(), streams._SlicedLimiter(1, 100, 100)
    limiting.init(handle)
    rows = pd.DataFrame({"ts_ms": [at * 100 + part for part in (70, 10) for at in range(30)], "id": range(60)})
    for batch in (rows[:45], rows[45:]):
        assert not list(limiting.handleInputRows(("p", "u"), iter([batch]), None))
    assert handle.timers and max(handle.timers) < 3000
    frames, fired = [], 0
    while waiting := [at for at in handle.timers if at <= 3000]:
        handle.timers.remove(min(waiting))
        frames += limiting.handleExpiredTimer(("p", "u"), Times(3000), Times(min(waiting)))
        fired += 1
    got = pd.concat(frames)
    window = limiter.AcceptedWindow(1, 100)
    assert got.allowed.tolist() == [window.offer(ms, 1)[1] == 1 for ms in sorted(rows.ts_ms)]
    assert len(frames) == 1 and fired <= 2 and handle.calls < 150
    assert not handle.stores["waiting"]


def test_remembered_jobs_share_calls(spark):
    """1,000 jobs of a group in one batch cost as many state calls as they have slices, and are forgotten together."""
    handle, remembering = Remembering(), streams._Remembered(100)
    remembering.init(handle)
    rows = pd.DataFrame({"job_id": [*range(1000)] * 3, "created_ms": [*[110] * 1000, *[150] * 1000, *[211] * 1000]})
    got = pd.concat(remembering.handleInputRows((0,), iter([rows]), None))
    assert got.created_ms.value_counts().to_dict() == {110: 1000, 211: 1000} and handle.calls < 10
    more = pd.DataFrame({"job_id": [1, 2, None], "created_ms": [311, 312, 312]})
    got = pd.concat(remembering.handleInputRows((0,), iter([more]), None))
    assert [None if job != job else job for job in got.job_id] == [2, None]
    for at in sorted(handle.timers):
        list(remembering.handleExpiredTimer((0,), Times(at), Times(at)))
    list(remembering.handleExpiredTimer((0,), Times(500), Times(500)))
    assert not handle.stores["kept"]
