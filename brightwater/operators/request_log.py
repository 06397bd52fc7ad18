"""Request logs: cost, model choice, window statistics, recent rows, telemetry."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brightwater.functions import fixed_values as fixed
from brightwater.functions.numbers import percent, whole_average


def price_table(spark) -> DataFrame:
    """The price list as a three-row dimension."""
    rows = [(model, paid_in, paid_out) for model, (paid_in, paid_out) in fixed.TOKEN_PRICES.items()]
    return spark.createDataFrame(rows, "model string, price_in double, price_out double")


def price_lookup(logs: DataFrame, prices: DataFrame | None = None) -> DataFrame:
    """Attach ``price_in`` and ``price_out`` to each row; null for an unknown or missing model.

    The built-in price list has three rows and is broadcast; a caller's own list is left to
    adaptive execution.
    """
    if prices is None:
        prices = F.broadcast(price_table(logs.sparkSession))
    return logs.join(prices, "model", "left")


def request_cost(logs: DataFrame, prices: DataFrame | None = None) -> DataFrame:
    """Add ``cost_usd``: token counts times price per million, 0 without a known model."""
    cost = (F.coalesce("tokens_in", F.lit(0)) / F.lit(1e6)) * F.col("price_in") + (
        F.coalesce("tokens_out", F.lit(0)) / F.lit(1e6)
    ) * F.col("price_out")
    return (
        price_lookup(logs, prices)
        .withColumn("cost_usd", F.coalesce(cost, F.lit(0.0)))
        .drop("price_in", "price_out")
    )


def recent_window_filter(
    logs: DataFrame, as_of: Column, hours: int = 24, project: str | None = None
) -> DataFrame:
    """Rows of the last ``hours`` before ``as_of``, optionally of one project."""
    kept = logs.filter(F.col("created_at") > as_of - F.make_interval(hours=F.lit(hours)))
    return kept if project is None else kept.filter(F.col("project") == project)


def latency_counts(logs: DataFrame, *keys) -> DataFrame:
    """Priced logs counted per key and distinct latency: exact, and small where the log is large."""
    return logs.groupBy(*keys, "latency_ms").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(F.col("tokens_in") + F.col("tokens_out")).alias("tokens"),
        F.sum(F.col("cost_usd").cast("decimal(10,6)")).alias("cost"),
        F.count_if(F.col("status") == "error").alias("errors"),
    )


def latency_summary(counted: DataFrame, *keys: str) -> DataFrame:
    """The statistics of ``request_stats`` per key, from ``latency_counts``."""
    totals = counted.groupBy(*keys).agg(
        F.sum("n").alias("total_requests"),
        F.sum(F.col("latency_ms") * F.col("n")).alias("latency"),
        F.percentile("latency_ms", F.lit(0.95), F.col("n")).alias("p95"),
        F.sum("tokens").alias("total_tokens"),
        F.sum("cost").alias("cost"),
        F.sum("errors").alias("error_count"),
    )
    return totals.select(
        *keys,
        "total_requests",
        whole_average(F.col("latency"), F.col("total_requests")).alias("avg_latency_ms"),
        F.rint("p95").cast("bigint").alias("p95_latency_ms"),
        "total_tokens",
        F.col("cost").cast("double").alias("total_cost_usd"),
        "error_count",
        percent(F.col("error_count"), F.col("total_requests"), 2).alias("error_rate_pct"),
    )


def request_stats(
    logs: DataFrame, as_of: Column, hours: int = 24, project: str | None = None
) -> DataFrame:
    """Per project: request count, latency average and 95th percentile, tokens, cost, errors.

    Rows are first counted per project and latency, so a project with most of the rows reaches
    the percentile as one row per distinct millisecond value.
    """
    recent = recent_window_filter(logs, as_of, hours, project)
    return latency_summary(latency_counts(recent, "project"), "project")


def recent_rows(df: DataFrame, n: int, newest: str, key: str) -> DataFrame:
    """The newest ``n`` rows of a table, ties broken by key."""
    return df.orderBy(F.col(newest).desc(), F.col(key).desc()).limit(n)


def select_model(df: DataFrame, complexity: str = "complexity", budget: str = "budget") -> DataFrame:
    """Add ``model`` chosen by task complexity and budget; a missing budget is ``normal``."""
    limited = F.coalesce(F.col(budget), F.lit("normal"))
    return df.withColumn(
        "model",
        F.when((limited == "tight") | (F.col(complexity) == "low"), fixed.MODEL_TIERS["fast"])
        .when(
            (F.col(complexity) == "high") & (limited == "unlimited"),
            fixed.MODEL_TIERS["powerful"],
        )
        .otherwise(fixed.MODEL_TIERS["balanced"]),
    )



def telemetry_project(df: DataFrame, service: str) -> DataFrame:
    """One service's rows as common telemetry records.

    ``chat`` and ``video`` read request logs, ``agents`` agent runs, ``jobs`` jobs
    and ``churn`` predictions. Values a service does not track are constants; ``jobs``
    and ``churn`` add two columns of their own.
    """
    zero = F.lit(0).cast("bigint")

    def column(name: str, kind: str, default: Column) -> Column:
        return F.coalesce(F.col(name).cast(kind), default)

    success = {
        "chat": lambda: F.col("status") == "success",
        "video": lambda: F.col("status") == "success",
        "agents": lambda: F.col("success"),
        "jobs": lambda: F.col("status") == "completed",
        "churn": lambda: F.lit(True),
    }[service]()
    timed = service in ("chat", "video", "agents")
    model = F.lit(fixed.DEFAULT_TELEMETRY_MODEL)
    if service == "agents":
        model = F.coalesce(F.col("model_used"), model)
    elif service == "churn":
        model = F.lit(fixed.CHURN_TELEMETRY_MODEL)
    counted = service == "chat"
    extras = {
        "jobs": [F.col("pipeline_type").alias("pipelineType"), F.col("status")],
        "churn": [F.col("label"), F.col("confidence")],
    }.get(service, [])
    return df.select(
        F.col("job_id" if service == "jobs" else "id").cast("string").alias("queryId"),
        F.col("created_at").alias("timestamp"),
        (column("latency_ms", "bigint", zero) if timed else zero).alias("latencyMs"),
        success.alias("success"),
        model.alias("modelId"),
        (column("tokens_in", "bigint", zero) if counted else zero).alias("tokensIn"),
        (column("tokens_out", "bigint", zero) if counted else zero).alias("tokensOut"),
        (column("cost_usd", "double", F.lit(0.0)) if counted else F.lit(0.0)).alias("costUsd"),
        *extras,
    )


def telemetry_union(sources: dict[str, DataFrame], n: int = 50) -> DataFrame:
    """The newest ``n`` records of every service in one schema."""
    union = None
    for service, df in sources.items():
        key = "job_id" if service == "jobs" else "id"
        part = telemetry_project(recent_rows(df, n, "created_at", key), service).withColumn(
            "service", F.lit(service)
        )
        union = part if union is None else union.unionByName(part, allowMissingColumns=True)
    if union is None:
        raise ValueError("no sources given")
    return union
