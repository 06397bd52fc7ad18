"""A queue of job segments that several consumers take from, every segment by one of them.

A segment is a folder that becomes visible in ``ready`` by a rename when it is complete. A consumer claims it by
renaming it into a folder of its own; a rename succeeds for one only, on any file system where it is atomic
(HDFS and local ones are, plain object stores are not). Its jobs are written to the consumer's store under the segment's
name, and then it is moved to ``done``. A consumer that was lost finds what it had claimed when it starts
again under its name; writing a segment anew replaces what was written of it.
"""

from __future__ import annotations

import time
import uuid

from pyspark.sql import DataFrame, SparkSession

READY, CLAIMED, DONE = "ready", "claimed", "done"


class _Folders:
    """Folders of the file system that a path belongs to."""

    def __init__(self, spark: SparkSession, path: str):
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(path).getFileSystem(spark._jsc.hadoopConfiguration())

    def names(self, folder: str) -> list[str]:
        place = self._path(folder)
        return sorted(f.getPath().getName() for f in self._fs.listStatus(place)) if self._fs.exists(place) else []

    def moved(self, source: str, target: str) -> bool:
        """Whether this call moved the folder; no if somebody else had moved it before."""
        self._fs.mkdirs(self._path(target).getParent())
        try:
            return self._fs.rename(self._path(source), self._path(target))
        except Exception as failed:
            if "FileNotFoundException" in str(failed):
                return False
            raise


def enqueue_segment(jobs: DataFrame, path: str) -> str:
    """Write jobs as one segment of the queue under ``path``; segments are taken in the order of their writing."""
    spark = jobs.sparkSession
    name = f"{time.time_ns():020d}-{uuid.uuid4().hex[:8]}"
    jobs.write.parquet(f"{path}/writing/{name}")
    _Folders(spark, path).moved(f"{path}/writing/{name}", f"{path}/{READY}/{name}")
    return name


def claim(spark: SparkSession, path: str, consumer: str) -> str | None:
    """The name of the oldest segment that this consumer could claim, or None if there is none.

    Segments that the consumer claimed before and has not finished come first.
    """
    folders = _Folders(spark, path)
    mine = folders.names(f"{path}/{CLAIMED}/{consumer}")
    if mine:
        return mine[0]
    for name in folders.names(f"{path}/{READY}"):
        if folders.moved(f"{path}/{READY}/{name}", f"{path}/{CLAIMED}/{consumer}/{name}"):
            return name
    return None


def finish(spark: SparkSession, path: str, consumer: str, name: str) -> None:
    """Say that a claimed segment's jobs are stored."""
    _Folders(spark, path).moved(f"{path}/{CLAIMED}/{consumer}/{name}", f"{path}/{DONE}/{name}")


def take_segments(spark: SparkSession, path: str, consumer: str, store: str, schema, most: int | None = None) -> list[str]:
    """Claim segments, oldest first, and store their jobs, until none is left or ``most`` are done; their names.

    ``store`` has a folder per segment, of all consumers that share it; ``schema`` is that of the jobs.
    """
    taken: list[str] = []
    while most is None or len(taken) < most:
        name = claim(spark, path, consumer)
        if name is None:
            break
        jobs = spark.read.schema(schema).parquet(f"{path}/{CLAIMED}/{consumer}/{name}")
        jobs.write.mode("overwrite").parquet(f"{store}/segment={name}")
        finish(spark, path, consumer, name)
        taken.append(name)
    return taken
