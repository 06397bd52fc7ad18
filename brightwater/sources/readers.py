"""Readers: text documents, the raw churn file, rows by key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from brightwater.functions.text import is_blank

# What the matched service stores of a document.
STORED_CHARS = 10_000

TELCO_SCHEMA = (
    "customerID string, gender string, SeniorCitizen int, Partner string, Dependents string, "
    "tenure int, PhoneService string, MultipleLines string, InternetService string, "
    "OnlineSecurity string, OnlineBackup string, DeviceProtection string, TechSupport string, "
    "StreamingTV string, StreamingMovies string, Contract string, PaperlessBilling string, "
    "PaymentMethod string, MonthlyCharges double, TotalCharges string, Churn string"
)


def _extension(name: Column) -> Column:
    return F.lower(F.element_at(F.split(name, r"\."), -1))


def ingest_documents(raw: DataFrame) -> DataFrame:
    """Check raw documents (name, text, permissions); ``reason`` says why one is rejected."""
    extension = _extension(F.col("name"))
    reason = F.when(
        extension != "txt",
        F.concat(F.lit("Unsupported format: "), extension, F.lit(". Use TXT.")),
    ).when(
        is_blank(F.col("text")),
        F.concat(F.lit('Document "'), F.col("name"), F.lit('" contains no extractable text.')),
    )
    return raw.withColumn("reason", reason)


def document_rows(checked: DataFrame, stored_chars: int | None = STORED_CHARS) -> DataFrame:
    """The stored form of accepted documents: the first ``stored_chars`` characters, or the whole text if None."""
    content = F.col("text") if stored_chars is None else F.substring("text", 1, stored_chars)
    return checked.filter(F.col("reason").isNull()).select(
        F.substring(F.sha2("name", 256), 1, 32).alias("id"),
        "name",
        content.alias("content"),
        "permissions",
    )


def read_text_documents(
    spark: SparkSession, paths: str | Sequence[str], permissions: Sequence[str]
) -> tuple[DataFrame, DataFrame]:
    """Accepted documents (name, text, permissions) and rejected files (name, reason).

    Only text files are read; of other files nothing but the name is.
    """
    listed = [paths] if isinstance(paths, str) else list(paths)
    readers = F.array(*[F.lit(p) for p in permissions])
    texts = (
        spark.read.option("pathGlobFilter", "*.{txt,TXT}")
        .text(listed, wholetext=True)
        .select(F.col("_metadata.file_name").alias("name"), F.col("value").alias("text"))
    )
    checked = ingest_documents(texts.withColumn("permissions", readers))
    others = (
        spark.read.format("binaryFile")
        .load(listed)
        .select(F.col("_metadata.file_name").alias("name"), F.lit(None).cast("string").alias("text"))
        .filter(_extension(F.col("name")) != "txt")
    )
    rejected = checked.select("name", "reason").unionByName(
        ingest_documents(others).select("name", "reason")
    )
    accepted = checked.filter(F.col("reason").isNull()).drop("reason")
    return accepted, rejected.filter(F.col("reason").isNotNull())


def read_telco_csv(spark: SparkSession, path: str) -> DataFrame:
    """The churn file with its fixed schema; TotalCharges stays text because it holds blanks.

    Columns are matched by their order in the file's header.
    """
    return spark.read.csv(
        path, header=True, schema=TELCO_SCHEMA, ignoreLeadingWhiteSpace=False, enforceSchema=False
    )


def read_table_by_key(table: DataFrame, **values) -> DataFrame:
    """Rows whose columns equal the given values; the comparison reaches the file scan."""
    for name, value in values.items():
        table = table.filter(F.col(name) == F.lit(value))
    return table


def read_table_by_keys(table: DataFrame, keys: DataFrame, on: Sequence[str]) -> DataFrame:
    """Rows whose key is in ``keys``."""
    return table.join(keys.select(*on), list(on), "left_semi")
