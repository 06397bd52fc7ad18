"""DataFrame helpers shared by the operators of this folder."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from brightwater.plans.scratch import written
from brightwater.plans.session import prepare

#: The internal row key that operators add; callers' columns are never read under this name.
ROW = "__row"
#: Rows in an Arrow batch of texts: long texts make batches large.
BATCH_ROWS = 256

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def registered(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query of this folder and, where SQL can say the same, that SQL."""

    def add(run: Query) -> Query:
        QUERIES[name] = run
        if sql is not None:
            SQL[name] = sql
        return run

    return add


def ready(spark: SparkSession) -> None:
    """Ship the package to the executors and keep Arrow batches of long texts small."""
    prepare(spark)
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key, "10000")) > BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    ready(spark)
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


class Identified:
    """Rows under the unique long key ``ROW``, and how to give results the caller's key back."""

    def __init__(self, rows: DataFrame, key: str, kind, numbered: bool):
        self.rows, self._key, self._kind, self._numbered = rows, key, kind, numbered

    def restore(self, result: DataFrame) -> DataFrame:
        columns = [c for c in result.columns if c != ROW]
        if self._numbered:
            result = result.join(self.rows.select(ROW, "__key"), ROW)
        source = F.col("__key" if self._numbered else ROW)
        return result.select(source.cast(self._kind).alias(self._key), *columns)

    def key_of(self, result: DataFrame, column: str) -> DataFrame:
        """Replace row keys in another column by the caller's keys; null stays null."""
        if not self._numbered:
            return result.withColumn(column, F.col(column).cast(self._kind))
        names = self.rows.select(F.col(ROW).alias("__named"), F.col("__key").alias("__name"))
        joined = result.join(names, F.col(column) == F.col("__named"), "left")
        return joined.withColumn(column, F.col("__name")).drop("__named", "__name")


def identified(df: DataFrame, key: str, **columns: Column) -> Identified:
    """The named columns under a unique long row key that follows the order of ``key``.

    Unique non-null integer keys serve as they are; whether they are unique is counted on that column
    alone. Otherwise every row is a record of its own: rows are numbered along (key, columns) with null
    keys last, and written once, so that the numbers are the same in every later read.
    """
    ready(df.sparkSession)
    kind = df.schema[key].dataType
    named = [value.alias(name) for name, value in columns.items()]
    if kind.simpleString() in ("tinyint", "smallint", "int", "bigint"):
        odd = df.groupBy(F.col(key).alias("k")).count().where("count > 1 or k is null")
        if odd.isEmpty():
            return Identified(df.select(F.col(key).cast("long").alias(ROW), *named), key, kind, False)
    order = [F.col("__key").asc_nulls_last(), *[F.col(c).asc_nulls_last() for c in columns]]
    ordered = (
        df.select(*named, F.col(key).alias("__key"))
        .repartitionByRange(partitions(df.sparkSession), *order)
        .sortWithinPartitions(*order)
        .withColumn(ROW, F.monotonically_increasing_id())
    )
    return Identified(written(ordered.select(ROW, *columns, "__key"), "rows"), key, kind, True)


def whole_groups(
    batches: Iterator[pa.RecordBatch], keys: list[str], least: int = 4096
) -> Iterator[pa.Table]:
    """Cut a stream sorted by ``keys`` into tables that end where a key ends.

    A table has at least ``least`` rows unless it is the last; one key is never split.
    """
    held: list[pa.RecordBatch] = []
    rows, target = 0, least
    for batch in batches:
        held.append(batch)
        rows += batch.num_rows
        if rows < target:
            continue
        table = pa.Table.from_batches(held)
        cut = _last_start(table, keys)
        if cut:
            yield table.slice(0, cut)
            rest = table.slice(cut)
            held, rows, target = rest.to_batches(), rest.num_rows, least
        else:  # one key so far: look again when as many rows more have come
            target = 2 * rows
    if rows:
        yield pa.Table.from_batches(held)


def _last_start(table: pa.Table, keys: list[str]) -> int:
    changed = np.zeros(table.num_rows - 1, dtype=bool) if table.num_rows else np.zeros(0, bool)
    for key in keys:
        values = table[key].to_numpy()
        changed |= values[1:] != values[:-1]
    found = np.flatnonzero(changed)
    return int(found[-1]) + 1 if len(found) else 0


def group_starts(table: pa.Table, keys: list[str]) -> np.ndarray:
    """Where each key begins in a table sorted by ``keys``, and the number of rows."""
    changed = np.ones(table.num_rows, dtype=bool)
    for k, key in enumerate(keys):
        values = table[key].to_numpy()
        differs = values[1:] != values[:-1]
        changed[1:] = differs if k == 0 else changed[1:] | differs
    return np.append(np.flatnonzero(changed), table.num_rows)


def byte_list(column: pa.Array | pa.ChunkedArray) -> list[bytes]:
    """Strings or binaries as bytes; null as empty."""
    import pyarrow.compute as pc

    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    if not pa.types.is_binary(column.type) and not pa.types.is_large_binary(column.type):
        column = column.cast(kind)
    return pc.fill_null(column, b"").to_pylist()
