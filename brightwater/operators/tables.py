"""Table maintenance: upserts, updates, deletes, expiry and per-key folds.

Every function returns the new state of the table; writing it is left to the caller. Updates are
folded to one row per key with mergeable aggregates before they meet the base table, so the base
is joined once and a key that changes very often costs one row.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def one_per_key(df: DataFrame, keys: Sequence[str], pick) -> DataFrame:
    """One row per key, chosen by an aggregate over the struct of the other columns."""
    rest = [c for c in df.columns if c not in keys]
    return (
        df.groupBy(*keys)
        .agg(pick(F.struct(*rest)).alias("_row"))
        .select(*[F.col(c) if c in keys else F.col("_row")[c].alias(c) for c in df.columns])
    )


def upsert_latest(
    base: DataFrame, updates: DataFrame, keys: Sequence[str], order: str
) -> DataFrame:
    """Insert or replace: each key ends with its newest update, or its base row without one.

    ``order`` is a unique column of ``updates`` that need not be in the table.
    """
    newest = one_per_key(updates, keys, lambda row: F.max_by(row, F.col(order)))
    kept = base.join(newest.select(*keys), list(keys), "left_anti")
    return kept.unionByName(newest.select(*base.columns))


def insert_ignore(
    base: DataFrame, rows: DataFrame, keys: Sequence[str], order: str
) -> DataFrame:
    """Insert rows whose key is new; of several new rows with one key the first is kept."""
    first = one_per_key(rows, keys, lambda row: F.min_by(row, F.col(order)))
    return base.unionByName(
        first.join(base.select(*keys), list(keys), "left_anti").select(*base.columns)
    )


def partial_update(
    base: DataFrame,
    updates: DataFrame,
    keys: Sequence[str],
    columns: Sequence[str],
    order: str,
    touched: str,
) -> DataFrame:
    """Overwrite only the values that an update gives; unknown keys change nothing.

    Per column the newest non-null value wins. ``touched`` becomes the order value of the key's
    newest update.
    """
    folded = updates.groupBy(*keys).agg(
        *[
            F.max_by(c, F.when(F.col(c).isNotNull(), F.col(order))).alias(f"_new_{c}")
            for c in columns
        ],
        F.max(order).alias("_touched"),
    )
    joined = base.join(folded, list(keys), "left")
    changed = {c: F.coalesce(F.col(f"_new_{c}"), F.col(c)) for c in columns}
    changed[touched] = F.coalesce(F.col("_touched"), F.col(touched))
    return joined.withColumns(changed).select(*base.columns)


def delete_by_key(base: DataFrame, keys: DataFrame, on: Sequence[str]) -> DataFrame:
    return base.join(keys.select(*on), list(on), "left_anti")


def job_status_fold(events: DataFrame) -> DataFrame:
    """The current row of each job from its status log, by the highest ``seq``."""
    state = F.max_by(F.struct("status", "result", "error"), "seq")
    return (
        events.groupBy("job_id")
        .agg(state.alias("row"), F.max("seq").alias("seq"))
        .select("job_id", "row.status", "row.result", "row.error", "seq")
    )


def purge_expired_jobs(jobs: DataFrame, as_of: Column, hours: int = 24) -> DataFrame:
    """Drop finished jobs created more than ``hours`` before ``as_of``; keep unfinished ones."""
    expired = F.col("status").isin("completed", "failed") & (
        F.col("created_at") < as_of - F.make_interval(hours=F.lit(hours))
    )
    return jobs.filter(~F.coalesce(expired, F.lit(False)))


def unexpired_memory(entries: DataFrame, as_of: Column) -> DataFrame:
    """Entries without an expiry or with one after ``as_of``."""
    return entries.filter(F.col("expires_at").isNull() | (F.col("expires_at") > as_of))


def label_filter(predictions: DataFrame, label: str) -> DataFrame:
    return predictions.filter(F.col("label") == label)


def pending_fifo(jobs: DataFrame, n: int = 10) -> DataFrame:
    """The ``n`` pending jobs that have waited longest."""
    return jobs.filter("status = 'pending'").orderBy("created_at", "job_id").limit(n)


def last_n_interactions(
    interactions: DataFrame, n: int = 10, memory: DataFrame | None = None
) -> DataFrame:
    """Per user the most recent ``n`` texts, oldest first; role ``user`` unless memory has one.

    The rank filter is applied to each input partition before the shuffle, so a busy user sends
    ``n`` rows per partition.
    """
    newest = Window.partitionBy("user_id").orderBy(F.col("seq").desc())
    kept = interactions.withColumn("_rank", F.row_number().over(newest)).filter(F.col("_rank") <= n)
    ordered = F.array_sort(F.collect_list(F.struct("seq", "text")))
    grouped = kept.groupBy("user_id").agg(
        F.transform(ordered, lambda r: r["text"]).alias("recent_interactions")
    )
    if memory is None:
        return grouped.withColumn("role", F.lit("user"))
    return grouped.join(memory.select("user_id", "role"), "user_id", "left").withColumn(
        "role", F.coalesce("role", F.lit("user"))
    )
