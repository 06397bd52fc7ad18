"""Appending writers, one per logged table.

Each returns the path it wrote to. A plain append of columns needs no shuffle; only chunks are
rebalanced into their hash buckets, where adaptive execution splits a bucket that grows too large.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brightwater.operators.guard import input_hash
from brightwater.operators.request_log import request_cost


def write_chunks(chunks: DataFrame, path: str, buckets: int = 64) -> str:
    """Chunk rows, partitioned by a hash bucket of their document."""
    bucket = F.pmod(F.xxhash64("doc_id"), F.lit(buckets)).cast("int")
    bucketed = chunks.withColumn("bucket", bucket).hint("rebalance", F.col("bucket"))
    bucketed.write.mode("append").partitionBy("bucket").parquet(path)
    return path


def request_log_rows(logs: DataFrame) -> DataFrame:
    """Log rows with their cost to 6 decimals and absent token counts as 0."""
    error = F.col("error_msg") if "error_msg" in logs.columns else F.lit(None).cast("string")
    return request_cost(logs).select(
        "id",
        "project",
        "endpoint",
        "user_id",
        "latency_ms",
        F.coalesce("tokens_in", F.lit(0)).alias("tokens_in"),
        F.coalesce("tokens_out", F.lit(0)).alias("tokens_out"),
        F.col("cost_usd").cast("decimal(10,6)").alias("cost_usd"),
        "status",
        error.alias("error_msg"),
        "created_at",
    )


def append_request_log(logs: DataFrame, path: str) -> str:
    request_log_rows(logs).write.mode("append").parquet(path)
    return path


def append_eval_result(results: DataFrame, path: str) -> str:
    """Judge results; groundedness is stored twice, the hallucination confidence not at all."""
    rows = results.withColumn("groundedness_score", F.col("groundedness")).drop(
        "hallucination_confidence"
    )
    rows.write.mode("append").parquet(path)
    return path


def append_security_event(events: DataFrame, path: str) -> str:
    """Event rows; an ``input`` column is replaced by its short hash."""
    if "input" in events.columns:
        events = events.withColumn("input_hash", input_hash(F.col("input"))).drop("input")
    events.write.mode("append").parquet(path)
    return path


def append_agent_run(runs: DataFrame, path: str) -> str:
    """Runs with their steps as an array of structs."""
    runs.write.mode("append").parquet(path)
    return path


def append_record_json(records: DataFrame, path: str, written_at) -> str:
    """Arbitrary records as JSON lines, each with the time of writing."""
    records.withColumn("timestamp", written_at).write.mode("append").json(path)
    return path


def enqueue_jobs(jobs: DataFrame, path: str) -> str:
    """Put jobs into the queue folder that ``dequeue`` streams from."""
    jobs.write.mode("append").parquet(path)
    return path
