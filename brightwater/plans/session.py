"""Session settings shared by tests, the benchmark and the registered queries."""

from __future__ import annotations

import os
import shutil
import tempfile

from pyspark.sql import SparkSession

ROCKSDB_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

_shipped: set[str] = set()


def local_session(cores: int | str = "*", app: str = "brightwater", **conf: str) -> SparkSession:
    """A session for one machine; a cluster supplies its own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def prepare(spark: SparkSession) -> None:
    """Read and compare timestamps in UTC, and give every executor this package."""
    if spark.conf.get("spark.sql.session.timeZone") != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    app = spark.sparkContext.applicationId
    if app not in _shipped:
        package = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
        archive = shutil.make_archive(
            os.path.join(tempfile.mkdtemp(prefix="brightwater-package-"), "brightwater"),
            "zip",
            root_dir=os.path.dirname(package),
            base_dir=os.path.basename(package),
        )
        spark.sparkContext.addPyFile(archive)
        _shipped.add(app)
