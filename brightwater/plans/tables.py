"""Readers of the shared test tables and the derived views built on them."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brightwater.plans.session import prepare


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One of the given Parquet tables."""
    prepare(spark)
    return spark.read.parquet(os.path.join(folder, f"{name}.parquet"))


def stream(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One of the given tables as a stream of its files.

    The path is written as a pattern, because a streamed path without one must be a folder.
    """
    schema = table(spark, folder, name).schema
    return (
        spark.readStream.schema(schema)
        .option("maxBytesPerTrigger", str(4 * 1024**3))
        .parquet(os.path.join(folder, f"{name}.parque[t]"))
    )


def request_logs(spark: SparkSession, folder: str, read=table) -> DataFrame:
    k = F.regexp_extract("props", "([0-9]+)", 1).cast("int")
    pick = F.col("event_id") % 4
    return read(spark, folder, "events").select(
        F.col("event_id").alias("id"),
        F.concat(F.lit("svc-"), (F.col("user_id") % 5).cast("string")).alias("project"),
        F.col("event_type").alias("endpoint"),
        F.col("user_id").cast("string").alias("user_id"),
        F.floor(F.col("value") * 100).cast("int").alias("latency_ms"),
        (k * 10).alias("tokens_in"),
        (k * 3).alias("tokens_out"),
        F.when(pick == 0, "llama-3.3-70b-versatile")
        .when(pick == 1, "llama-3.1-8b-instant")
        .when(pick == 2, "mixtral-8x7b-32768")
        .alias("model"),
        F.when(F.col("event_type") == "error", "error").otherwise("success").alias("status"),
        F.col("ts").cast("timestamp").alias("created_at"),
    )


def eval_results(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "source", "n_chars")
    labels = table(spark, folder, "labels")
    return docs.join(labels, "doc_id").select(
        F.col("doc_id").alias("query_id"),
        F.col("source").alias("project"),
        (F.col("quality") * 0.5 + (F.col("doc_id") % 50) / 100.0)
        .cast("double")
        .alias("groundedness"),
        ((F.col("n_chars") % 101) / 100.0).cast("double").alias("answer_relevance"),
        F.when(F.col("doc_id") % 11 != 0, F.col("toxic") == 1).alias("hallucination"),
    )


def telco(spark: SparkSession, folder: str) -> DataFrame:
    orders = table(spark, folder, "orders")
    customers = table(spark, folder, "customer")
    spans = orders.groupBy("o_custkey").agg(
        F.min("o_orderdate").alias("first"), F.max("o_orderdate").alias("last")
    )
    newest = orders.agg(F.max("o_orderdate")).scalar()
    key = F.col("c_custkey")
    offline = F.col("c_nationkey") % 3 == 2

    def days(later, earlier):
        return F.extract(F.lit("DAY"), later - earlier)

    def service(modulus: int, below: int):
        return (
            F.when(offline, "No internet service")
            .when(key % modulus < below, "Yes")
            .otherwise("No")
        )

    def yes(condition):
        return F.when(condition, "Yes").otherwise("No")

    based = customers.join(spans, key == F.col("o_custkey"), "left").select(
        "c_custkey",
        "c_nationkey",
        F.coalesce(
            F.least(F.lit(72), F.floor(days(F.col("last"), F.col("first")) / 30).cast("int")),
            F.lit(0),
        ).alias("tenure"),
        (F.floor(2000 + (F.col("c_acctbal") + 1000) * 0.9) / 100).alias("monthly"),
        F.when(F.col("last").isNull() | (days(newest, F.col("last")) > 365), 1)
        .otherwise(0)
        .alias("churn"),
    )
    return based.select(
        key.alias("customer_id"),
        "tenure",
        F.col("monthly").alias("MonthlyCharges"),
        (F.col("monthly") * F.col("tenure")).alias("TotalCharges"),
        F.when(key % 6 == 0, 1).otherwise(0).alias("SeniorCitizen"),
        yes(key % 2 == 0).alias("Partner"),
        yes(key % 5 == 0).alias("Dependents"),
        F.when(key % 10 == 0, "No").otherwise("Yes").alias("PhoneService"),
        F.when(key % 10 == 0, "No phone service")
        .when(key % 7 < 3, "Yes")
        .otherwise("No")
        .alias("MultipleLines"),
        F.when(F.col("c_nationkey") % 3 == 0, "Fiber optic")
        .when(F.col("c_nationkey") % 3 == 1, "DSL")
        .otherwise("No")
        .alias("InternetService"),
        service(11, 4).alias("OnlineSecurity"),
        service(13, 5).alias("OnlineBackup"),
        service(17, 6).alias("DeviceProtection"),
        service(19, 6).alias("TechSupport"),
        service(23, 9).alias("StreamingTV"),
        service(29, 11).alias("StreamingMovies"),
        F.when(key % 3 == 0, "Month-to-month")
        .when(key % 3 == 1, "One year")
        .otherwise("Two year")
        .alias("Contract"),
        yes(key % 8 < 5).alias("PaperlessBilling"),
        F.when(key % 4 == 0, "Electronic check")
        .when(key % 4 == 1, "Mailed check")
        .when(key % 4 == 2, "Bank transfer (automatic)")
        .otherwise("Credit card (automatic)")
        .alias("PaymentMethod"),
        "churn",
    )


def invoices(spark: SparkSession, folder: str) -> DataFrame:
    orders = table(spark, folder, "orders")
    customers = table(spark, folder, "customer").select("c_custkey", "c_name")
    return orders.join(customers, F.col("c_custkey") == F.col("o_custkey")).select(
        F.col("o_orderkey").alias("job_id"),
        F.concat(
            F.lit("Invoice Vendor: "),
            "c_name",
            F.lit("; Total: $"),
            F.floor("o_totalprice").cast("bigint").cast("string"),
            F.lit("; Date: "),
            F.col("o_orderdate").cast("date").cast("string"),
        ).alias("input_text"),
    )


def prompt_saves(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "part").select(
        F.col("p_brand").alias("project"),
        F.concat(F.lit("size-"), (F.col("p_size") % 5).cast("string")).alias("name"),
        F.col("p_name").alias("content"),
        F.lit("llama-3.3-70b-versatile").alias("model"),
        F.col("p_partkey").alias("seq"),
    )


def interactions(spark: SparkSession, folder: str, read=table) -> DataFrame:
    return (
        read(spark, folder, "conversations")
        .filter("role = 'user'")
        .select(
            F.concat(F.lit("u"), (F.col("conv_id") % 40).cast("string")).alias("user_id"),
            (F.col("conv_id") * 100 + F.col("turn")).alias("seq"),
            "text",
        )
    )


def text_queries(spark: SparkSession, folder: str) -> DataFrame:
    lang = F.col("item_id") % 4
    return table(spark, folder, "benchmark").select(
        F.col("item_id").alias("query_id"),
        "text",
        F.when(lang == 0, "en")
        .when(lang == 1, "de")
        .when(lang == 2, "fr")
        .otherwise("es")
        .alias("user_id"),
    )


def label_queries(spark: SparkSession, folder: str) -> DataFrame:
    """One query vector per label: the mean of the label's vectors, over the whole table."""
    values = table(spark, folder, "embeddings").select(
        "label", F.posexplode("embedding").alias("at", "value")
    )
    means = values.groupBy("label", "at").agg(
        F.round(F.avg(F.col("value").cast("double")), 9).alias("mean")
    )
    ordered = F.array_sort(F.collect_list(F.struct("at", "mean")))
    return means.groupBy(F.col("label").alias("query_id")).agg(
        F.transform(ordered, lambda m: m["mean"]).alias("embedding")
    )


def agent_steps(spark: SparkSession, folder: str) -> DataFrame:
    user = F.col("user_id")
    return table(spark, folder, "events").select(
        F.concat(
            user.cast("string"), F.lit("-"), F.col("ts").cast("date").cast("string")
        ).alias("run_id"),
        F.col("event_id").alias("seq"),
        F.when(F.col("event_type") == "signup", "plan")
        .when(F.col("event_type") == "view", "step_start")
        .when(F.col("event_type") == "click", "step_end")
        .when(F.col("event_type") == "error", "step_error")
        .otherwise("summary")
        .alias("event"),
        F.when(user % 3 == 0, "search")
        .when(user % 3 == 1, "calculator")
        .otherwise("http-api")
        .alias("tool_name"),
        F.col("ts").cast("timestamp").alias("created_at"),
    )


def documents_with_readers(spark: SparkSession, folder: str) -> DataFrame:
    """Documents whose readers are named by their language and their source."""
    return table(spark, folder, "documents").select(
        "doc_id",
        F.concat(F.lit("doc-"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("doc_name"),
        "text",
        F.array("lang", "source").alias("permissions"),
    )
