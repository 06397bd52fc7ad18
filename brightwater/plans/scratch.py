"""Where intermediate tables and stream checkpoints go.

The cluster names a shared folder in ``spark.checkpoint.dir``. Only a local-mode session without
that setting gets a folder of its own, because there all tasks share one machine.
"""

from __future__ import annotations

import tempfile
import uuid
from urllib.parse import unquote

import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession

_local_roots: dict[str, str] = {}


def scratch_root(spark: SparkSession) -> str:
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    context = spark.sparkContext
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that every executor can reach")
    app = context.applicationId
    if app not in _local_roots:
        _local_roots[app] = tempfile.mkdtemp(prefix="brightwater-")
    return _local_roots[app]


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path under the shared folder, never handed out twice."""
    return f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, *partition_by: str) -> DataFrame:
    """Write a frame once and read it back, so that it is computed once and its lineage ends."""
    path = scratch_path(df.sparkSession, name)
    writer = df.write.mode("errorifexists")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def file_store(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system that a task opens a file of the shared folder with, and the path within it."""
    if uri.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + unquote(uri[5:]).lstrip("/")
    return pafs.FileSystem.from_uri(uri)
