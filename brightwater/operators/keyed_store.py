"""A table stored by key buckets, of which a change rewrites the touched ones only.

A version says in which folder each bucket's rows are. A change reads the touched buckets, writes their new rows
into a folder of its own, and then the next version, which is complete or not there: readers of the version
before keep their files. One writer at a time; of two that start from the same version the second is refused.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brightwater.operators import tables

BUCKET = "_bucket"


class KeyedStore:
    """One version of a stored table; see ``create_keyed`` and ``open_keyed``."""

    def __init__(
        self, spark: SparkSession, path: str, keys: list[str], buckets: int, version: int, schema: T.StructType, folders: dict[int, str]
    ):
        self.spark, self.path, self.keys, self.buckets, self.version = spark, path, keys, buckets, version
        self.schema, self.folders = schema, folders

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")

    def _rows(self, buckets: Sequence[int]) -> DataFrame:
        """Rows of the given buckets; only their folders are read."""
        places = [f"{self.path}/data/{self.folders[b]}/{BUCKET}={b}" for b in buckets if b in self.folders]
        if not places:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*places)

    @property
    def rows(self) -> DataFrame:
        """The whole table as of this version."""
        return self._rows(sorted(self.folders))

    def get(self, keys: DataFrame) -> DataFrame:
        """The rows of the given keys, from their buckets."""
        wanted = keys.select(*self.keys).distinct()
        touched = self._touched(wanted)
        return self._rows(touched).join(wanted, self.keys, "left_semi")

    def _touched(self, changes: DataFrame) -> list[int]:
        found = changes.select(self._bucket().alias("b")).distinct().collect()  # as many as there are buckets
        return sorted(r.b for r in found)

    def _changed(self, touched: list[int], rows: DataFrame) -> KeyedStore:
        """The next version, whose touched buckets have these rows."""
        version = self.version + 1
        folder = f"{version}-{uuid.uuid4().hex}"  # its own, also if another writer is at the same version
        place = f"{self.path}/data/{folder}"
        dealt = rows.select(*self.schema.names).withColumn(BUCKET, self._bucket()).hint("rebalance", BUCKET)
        dealt.write.mode("errorifexists").partitionBy(BUCKET).parquet(place)
        whole = T.StructType([*self.schema.fields, T.StructField(BUCKET, T.IntegerType())])
        filled = [r[0] for r in self.spark.read.schema(whole).parquet(place).select(BUCKET).distinct().collect()]
        folders = {b: v for b, v in self.folders.items() if b not in set(touched)} | {b: folder for b in filled}
        # -1 stands for no bucket, so that an empty table has a version too
        listed = self.spark.createDataFrame([(-1, folder), *sorted(folders.items())], "bucket int, folder string")
        listed.coalesce(1).write.mode("errorifexists").parquet(f"{self.path}/versions/version={version}")
        return KeyedStore(self.spark, self.path, self.keys, self.buckets, version, self.schema, folders)

    def change(self, changes: DataFrame, apply: Callable[[DataFrame, DataFrame], DataFrame]) -> KeyedStore:
        """The next version: ``apply(rows, changes)`` in place of the rows of all buckets that ``changes`` has keys of.

        ``apply`` must keep every row whose key is not among the changes.
        """
        touched = self._touched(changes)
        return self._changed(touched, apply(self._rows(touched), changes)) if touched else self

    def upsert(self, updates: DataFrame, order: str) -> KeyedStore:
        """Insert or replace by the newest update per key; see ``tables.upsert_latest``."""
        return self.change(updates, lambda rows, new: tables.upsert_latest(rows, new, self.keys, order))

    def insert_new(self, rows: DataFrame, order: str) -> KeyedStore:
        """Insert rows whose key is new; see ``tables.insert_ignore``."""
        return self.change(rows, lambda old, new: tables.insert_ignore(old, new, self.keys, order))

    def update(self, updates: DataFrame, columns: Sequence[str], order: str, touched: str) -> KeyedStore:
        """Overwrite the values that an update gives; see ``tables.partial_update``."""
        return self.change(updates, lambda rows, new: tables.partial_update(rows, new, self.keys, columns, order, touched))

    def delete(self, keys: DataFrame) -> KeyedStore:
        """Drop the rows of the given keys."""
        return self.change(keys, lambda rows, gone: tables.delete_by_key(rows, gone, self.keys))


def create_keyed(rows: DataFrame, path: str, keys: Sequence[str], buckets: int | None = None) -> KeyedStore:
    """A new store of rows that have each key once; keys are not null.

    ``buckets`` defaults to the session's number of shuffle partitions. A bucket is what the smallest change rewrites.
    """
    spark = rows.sparkSession
    count = int(spark.conf.get("spark.sql.shuffle.partitions")) if buckets is None else buckets
    plain = T.StructType([T.StructField(f.name, f.dataType) for f in rows.schema.fields])
    about = spark.createDataFrame([(list(keys), count, plain.json())], "key_columns array<string>, buckets int, layout string")
    about.coalesce(1).write.mode("errorifexists").parquet(f"{path}/about")
    return KeyedStore(spark, path, list(keys), count, 0, plain, {})._changed([], rows)


def open_keyed(spark: SparkSession, path: str, version: int | None = None) -> KeyedStore:
    """The newest version of the store under ``path``, or the one asked for."""
    about = spark.read.parquet(f"{path}/about").first()
    listed = spark.read.schema("bucket int, folder string, version int").option("basePath", f"{path}/versions").parquet(f"{path}/versions")
    if version is None:
        # a version's one file appears when its job is committed
        version = listed.agg(F.max("version")).first()[0] or 0
    folders = {r.bucket: r.folder for r in listed.where((F.col("version") == version) & (F.col("bucket") >= 0)).collect()}
    schema = T.StructType.fromJson(json.loads(about.layout))
    return KeyedStore(spark, path, list(about.key_columns), about.buckets, version, schema, folders)
