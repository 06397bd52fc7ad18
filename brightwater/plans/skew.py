"""Order-dependent steps that stay split when one key holds most of the rows.

A plain window over a key sorts the whole key in one task. The helpers here cut each key into
slices that follow the order, work inside the slices, and correct the result with per-slice totals,
which are small and pre-aggregated before they are shuffled.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brightwater.plans.scratch import written

BROADCAST_ROWS = 100_000


def fits(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> bool:
    """True if counting shows at most ``max_rows`` rows; reads no more than that."""
    return df.limit(max_rows + 1).count() <= max_rows


def small(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Mark a frame for broadcast only if it ``fits``.

    A larger frame is returned unmarked and is joined by a shuffle, where adaptive execution
    splits hot partitions.
    """
    return F.broadcast(df) if fits(df, max_rows) else df


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Redistribute a freshly read table that has fewer pieces than there are cores.

    Large tables come in many pieces and are left as they are. Only for plain scans: asking a frame
    with joins or groupings for its pieces would run it.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, *keys) if df.rdd.getNumPartitions() < cores else df


def running_sums(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column],
    slices: Sequence[Column],
    sums: dict[str, Column],
) -> DataFrame:
    """Inclusive running totals per key along ``order``, as new columns named by ``sums``.

    ``slices`` must never decrease along ``order``; a slice is the largest unit one task sorts.
    ``order`` must be unique within a key.
    """
    keys = list(keys)
    cut = [f"_slice{i}" for i in range(len(slices))]
    names = list(sums)
    values = [f"_value{i}" for i in range(len(names))]
    sliced = df.withColumns(dict(zip(cut, slices)) | dict(zip(values, sums.values())))

    totals = sliced.groupBy(*keys, *cut).agg(
        *[F.sum(v).alias(f"_total{i}") for i, v in enumerate(values)]
    )
    # Without a key the slices are themselves dealt to ordered parts, whose totals are few.
    parts: list[str] = []
    if not keys:
        count = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        dealt = totals.repartitionByRange(count, *cut).withColumn("_part", F.spark_partition_id())
        totals, parts = written(dealt, "slices"), ["_part"]
    earlier = (
        Window.partitionBy(*keys, *parts).orderBy(*cut).rowsBetween(Window.unboundedPreceding, -1)
    )
    offsets = totals.select(
        *[F.col(c).alias(f"_k{i}") for i, c in enumerate(keys + cut)],
        *[
            F.coalesce(F.sum(f"_total{i}").over(earlier), F.lit(0)).alias(f"_offset{i}")
            for i in range(len(names))
        ],
        *parts,
    )
    if parts:
        before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
        sums_of = totals.groupBy("_part").agg(
            *[F.sum(f"_total{i}").alias(f"_whole{i}") for i in range(len(names))]
        )
        shifts = sums_of.select(
            "_part",
            *[
                F.coalesce(F.sum(f"_whole{i}").over(before), F.lit(0)).alias(f"_shift{i}")
                for i in range(len(names))
            ],
        )
        offsets = offsets.join(shifts, "_part").select(
            *[f"_k{i}" for i in range(len(cut))],
            *[
                (F.col(f"_offset{i}") + F.col(f"_shift{i}")).alias(f"_offset{i}")
                for i in range(len(names))
            ],
        )
    within = Window.partitionBy(*keys, *cut).orderBy(*order).rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    local = sliced.withColumns(
        {f"_local{i}": F.sum(v).over(within) for i, v in enumerate(values)}
    )
    matched = F.lit(True)
    for i, c in enumerate(keys + cut):
        matched = matched & local[c].eqNullSafe(offsets[f"_k{i}"])
    joined = local.join(offsets, matched)
    return joined.select(
        *[local[c] for c in df.columns],
        *[
            (F.col(f"_local{i}") + F.col(f"_offset{i}")).alias(name)
            for i, name in enumerate(names)
        ],
    )


def numbered(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column],
    slices: Sequence[Column],
    name: str,
) -> DataFrame:
    """Row number from 1 per key along ``order``."""
    return running_sums(df, keys, order, slices, {name: F.lit(1).cast("long")})


def with_time_slices(
    df: DataFrame, time_ms: Column, reach_ms: int, slice_ms: int
) -> DataFrame:
    """Copy every row into the time slices whose backward-looking windows can see it.

    Adds ``_slot`` and ``_own``: a row is owned by its own slice and is context in the next one if
    it lies within ``reach_ms`` before that slice. ``slice_ms`` must be at least ``reach_ms``.
    """
    if slice_ms < reach_ms:
        raise ValueError("a slice must be at least as long as the window reaches back")
    own = F.floor(time_ms / F.lit(slice_ms))
    into = time_ms - own * F.lit(slice_ms)
    slots = F.when(into >= slice_ms - reach_ms, F.array(own, own + 1)).otherwise(F.array(own))
    return (
        df.withColumn("_home", own)
        .withColumn("_slot", F.explode(slots))
        .withColumn("_own", F.col("_slot") == F.col("_home"))
        .drop("_home")
    )
