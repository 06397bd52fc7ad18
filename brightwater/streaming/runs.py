"""Running streams over everything that is available, and their checkpoints."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession

import brightwater
from brightwater.plans.scratch import scratch_path
from brightwater.plans.session import ROCKSDB_STORE


def keyed_state(spark: SparkSession) -> None:
    """Arbitrary keyed state needs the RocksDB store, and processors that travel as code.

    Spark first starts a stateful processor in a helper process on the driver, which does not see
    the files that were added for the executors.
    """
    cloudpickle.register_pickle_by_value(brightwater)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB_STORE)


def run_available(
    stream: DataFrame,
    write_batch: Callable[[DataFrame, int], None],
    checkpoint: str,
    mode: str = "append",
) -> None:
    """Process all available input in micro-batches and wait for the end.

    A batch that is retried after a failure is written again under the same number, so
    ``write_batch`` must overwrite what the number wrote before.
    """
    query = (
        stream.writeStream.outputMode(mode)
        .foreachBatch(write_batch)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()


def batch_writer(path: str, run: str) -> Callable[[DataFrame, int], None]:
    """Writes every micro-batch to a folder of its run and number, replacing an earlier attempt."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/run={run}/batch={number}")

    return write


def store_checkpoint(path: str, name: str, checkpoint: str | None = None) -> tuple[str, str]:
    """Where a stream into a store keeps its progress, and the name of its run in the store.

    Without a checkpoint of the caller it is kept beside the rows, per stream ``name``: a later run under
    that name goes on after the input that was taken. Numbers of batches are unique in a checkpoint, so
    the run is named after it, and no run replaces the rows of another.
    """
    place = checkpoint or f"{path}/_checkpoints/{name}"
    return place, f"{name}-{hashlib.sha256(place.encode()).hexdigest()[:16]}"


def collected(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Run a stream to its end into a table and read it; ``batch`` is the micro-batch number."""
    spark = stream.sparkSession
    path = scratch_path(spark, name)
    checkpoint, run = store_checkpoint(path, name)
    run_available(stream, batch_writer(path, run), checkpoint, mode)
    return spark.read.parquet(path).drop("run")


def collected_in_event_time(
    stream: DataFrame, decide: Callable[[DataFrame], DataFrame], last: DataFrame, name: str
) -> DataFrame:
    """Run an event-time stream to its end, and once more with the row of ``last``, whose time closes all the others.

    A watermark only passes rows when later ones come, so the end of a finished input has to be told. The closing
    row comes by a source of its own after the whole input; what is decided for it is among the results.
    """
    spark = stream.sparkSession
    path, ends = scratch_path(spark, name), scratch_path(spark, f"{name}-end")
    last.limit(0).write.parquet(ends)
    closing = spark.readStream.schema(last.schema).parquet(ends)
    decided = decide(stream.unionByName(closing))
    checkpoint, run = store_checkpoint(path, name)
    run_available(decided, batch_writer(path, run), checkpoint)
    last.write.mode("append").parquet(ends)
    run_available(decided, batch_writer(path, run), checkpoint)
    return spark.read.parquet(path).drop("run", "batch")
