"""Queries over request logs."""

from __future__ import annotations

from pyspark.sql import functions as F

from brightwater.entries import entry
from brightwater.entries.views_sql import with_views
from brightwater.operators import request_log as ops
from brightwater.plans import tables

AS_OF = "2024-01-31 00:00:00"
HOURS = 24 * 31

def as_of():
    return F.lit(AS_OF).cast("timestamp")


@entry(
    "request_cost",
    with_views(
        "priced_logs",
        "SELECT id, project, model, tokens_in, tokens_out, round(cost_usd, 9) AS cost_usd FROM priced_logs",
    ),
)
def request_cost(spark, folder):
    return ops.request_cost(tables.request_logs(spark, folder)).select(
        "id", "project", "model", "tokens_in", "tokens_out", F.round("cost_usd", 9).alias("cost_usd")
    )


@entry(
    "price_lookup",
    with_views(
        "priced_logs", "SELECT id, model, price_in, price_out FROM priced_logs"
    ),
)
def price_lookup(spark, folder):
    return ops.price_lookup(tables.request_logs(spark, folder)).select(
        "id", "model", "price_in", "price_out"
    )


@entry(
    "request_stats",
    with_views(
        "priced_logs",
        f"""
SELECT project, count(*) AS total_requests,
 cast((2*sum(latency_ms) + count(*)) // (2*count(*)) AS bigint) AS avg_latency_ms,
 cast(round_even(quantile_cont(latency_ms, 0.95), 0) AS bigint) AS p95_latency_ms,
 cast(sum(tokens_in + tokens_out) AS bigint) AS total_tokens,
 cast(sum(cast(cast(cost_usd AS varchar) AS decimal(10,6))) AS double) AS total_cost_usd,
 cast(count(*) FILTER (WHERE status = 'error') AS bigint) AS error_count,
 cast((20000*count(*) FILTER (WHERE status = 'error') + count(*)) // (2*count(*)) AS bigint) / 100.0 AS error_rate_pct
FROM priced_logs WHERE created_at > timestamp '{AS_OF}' - INTERVAL {HOURS} HOUR GROUP BY project""",
    ),
)
def request_stats(spark, folder):
    priced = ops.request_cost(tables.request_logs(spark, folder))
    return ops.request_stats(priced, as_of(), HOURS)


@entry(
    "recent_window_filter",
    with_views(
        "request_logs",
        f"""SELECT id, project, endpoint, latency_ms FROM request_logs
WHERE created_at > timestamp '{AS_OF}' - INTERVAL 48 HOUR AND project = 'svc-1'""",
    ),
)
def recent_window_filter(spark, folder):
    logs = tables.request_logs(spark, folder)
    return ops.recent_window_filter(logs, as_of(), 48, "svc-1").select(
        "id", "project", "endpoint", "latency_ms"
    )


@entry(
    "recent_rows",
    with_views(
        "request_logs",
        """SELECT id, project, endpoint, epoch_us(created_at)//1000 AS created_ms FROM request_logs
ORDER BY created_at DESC, id DESC LIMIT 20""",
    ),
)
def recent_rows(spark, folder):
    logs = tables.request_logs(spark, folder)
    return ops.recent_rows(logs, 20, "created_at", "id").select(
        "id", "project", "endpoint", F.unix_millis("created_at").alias("created_ms")
    )


@entry(
    "select_model",
    """
SELECT o_orderkey AS task_id, complexity, budget,
 CASE WHEN coalesce(budget,'normal') = 'tight' OR complexity = 'low' THEN 'llama-3.1-8b-instant'
  ELSE 'llama-3.3-70b-versatile' END AS model
FROM (SELECT o_orderkey,
 CASE WHEN o_totalprice < 100000 THEN 'low' WHEN o_totalprice < 300000 THEN 'medium' ELSE 'high' END AS complexity,
 CASE o_orderstatus WHEN 'P' THEN 'tight' WHEN 'F' THEN 'unlimited' END AS budget FROM orders)""",
)
def select_model(spark, folder):
    price = F.col("o_totalprice")
    tasks = tables.table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("task_id"),
        F.when(price < 100000, "low").when(price < 300000, "medium").otherwise("high").alias(
            "complexity"
        ),
        F.when(F.col("o_orderstatus") == "P", "tight")
        .when(F.col("o_orderstatus") == "F", "unlimited")
        .alias("budget"),
    )
    return ops.select_model(tasks)


def service_rows(spark, folder):
    """The five services' own tables, all derived from the given ones."""
    priced = ops.request_cost(tables.request_logs(spark, folder))
    runs = tables.table(spark, folder, "events").select(
        F.col("event_id").alias("id"),
        (F.col("event_type") != "error").alias("success"),
        F.floor("value").cast("int").alias("latency_ms"),
        F.when(F.col("event_type") == "click", "mixtral-8x7b-32768").alias("model_used"),
        F.col("ts").cast("timestamp").alias("created_at"),
    )
    status = F.col("o_orderstatus")
    jobs = tables.table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("job_id"),
        F.lit("invoice_extraction").alias("pipeline_type"),
        F.when(status == "F", "completed").when(status == "P", "pending").otherwise("failed").alias(
            "status"
        ),
        F.col("o_orderdate").cast("timestamp").alias("created_at"),
    )
    predictions = tables.table(spark, folder, "lineitem").select(
        F.concat_ws("-", "l_orderkey", "l_partkey", "l_linenumber").alias("id"),
        F.when(F.col("l_returnflag") == "R", "Churn").otherwise("No Churn").alias("label"),
        F.col("l_discount").alias("confidence"),
        F.col("l_shipdate").cast("timestamp").alias("created_at"),
    )
    return {
        "chat": priced.filter("project = 'svc-0'"),
        "agents": runs,
        "jobs": jobs,
        "churn": predictions,
        "video": priced.filter("project = 'svc-4'"),
    }


_FIELDS = [
    "queryId", "timestamp", "latencyMs", "success", "modelId", "tokensIn", "tokensOut", "costUsd",
    "pipelineType", "status", "label", "confidence", "service",
]


def _printable(df):
    return df.withColumns(
        {"timestamp": F.unix_millis("timestamp"), "costUsd": F.round("costUsd", 9)}
    )


_UNION_SQL = (
    """WITH chat AS (SELECT cast(id AS varchar) AS "queryId", created_at AS t, cast(latency_ms AS bigint) AS "latencyMs", status='success' AS success,
 'llama-3.3-70b-versatile' AS "modelId", cast(tokens_in AS bigint) AS "tokensIn", cast(tokens_out AS bigint) AS "tokensOut", round(cost_usd, 9) AS "costUsd",
 NULL::varchar AS "pipelineType", NULL::varchar AS status, NULL::varchar AS label, NULL::double AS confidence, 'chat' AS service, id AS k FROM priced_logs WHERE project='svc-0'),
agents AS (SELECT cast(event_id AS varchar) AS "queryId", ts AS t, cast(floor(value) AS bigint) AS "latencyMs", event_type <> 'error' AS success,
 CASE WHEN event_type='click' THEN 'mixtral-8x7b-32768' ELSE 'llama-3.3-70b-versatile' END AS "modelId", 0::bigint AS "tokensIn", 0::bigint AS "tokensOut", 0.0::double AS "costUsd",
 NULL::varchar AS "pipelineType", NULL::varchar AS status, NULL::varchar AS label, NULL::double AS confidence, 'agents' AS service, event_id AS k FROM events),
jobs AS (SELECT cast(o_orderkey AS varchar) AS "queryId", o_orderdate AS t, 0::bigint AS "latencyMs", o_orderstatus='F' AS success,
 'llama-3.3-70b-versatile' AS "modelId", 0::bigint AS "tokensIn", 0::bigint AS "tokensOut", 0.0::double AS "costUsd",
 'invoice_extraction' AS "pipelineType", CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'P' THEN 'pending' ELSE 'failed' END AS status, NULL::varchar AS label, NULL::double AS confidence,
 'jobs' AS service, o_orderkey AS k FROM orders),
churn AS (SELECT concat_ws('-', l_orderkey, l_partkey, l_linenumber) AS "queryId", l_shipdate AS t, 0::bigint AS "latencyMs", true AS success,
 'stacked-ensemble-xgb-lgbm-rf' AS "modelId", 0::bigint AS "tokensIn", 0::bigint AS "tokensOut", 0.0::double AS "costUsd",
 NULL::varchar AS "pipelineType", NULL::varchar AS status, CASE WHEN l_returnflag='R' THEN 'Churn' ELSE 'No Churn' END AS label, l_discount AS confidence,
 'churn' AS service, concat_ws('-', l_orderkey, l_partkey, l_linenumber) AS k FROM lineitem),
video AS (SELECT cast(id AS varchar) AS "queryId", created_at AS t, cast(latency_ms AS bigint) AS "latencyMs", status='success' AS success,
 'llama-3.3-70b-versatile' AS "modelId", 0::bigint AS "tokensIn", 0::bigint AS "tokensOut", 0.0::double AS "costUsd",
 NULL::varchar AS "pipelineType", NULL::varchar AS status, NULL::varchar AS label, NULL::double AS confidence, 'video' AS service, id AS k FROM priced_logs WHERE project='svc-4'),
everything AS (SELECT * REPLACE (lpad(cast(k AS varchar), 30, '0') AS k) FROM chat UNION ALL BY NAME SELECT * REPLACE (lpad(cast(k AS varchar), 30, '0') AS k) FROM agents UNION ALL BY NAME SELECT * REPLACE (lpad(cast(k AS varchar), 30, '0') AS k) FROM jobs
 UNION ALL BY NAME SELECT * FROM churn UNION ALL BY NAME SELECT * REPLACE (lpad(cast(k AS varchar), 30, '0') AS k) FROM video)
"""
)
_LIST = ", ".join(f'"{f}"' if f != "timestamp" else 'epoch_us(t)//1000 AS "timestamp"' for f in _FIELDS)


@entry("telemetry_project", with_views("priced_logs", _UNION_SQL + f"SELECT {_LIST} FROM everything"))
def telemetry_project(spark, folder):
    union = None
    for service, df in service_rows(spark, folder).items():
        part = ops.telemetry_project(df, service).withColumn("service", F.lit(service))
        union = part if union is None else union.unionByName(part, allowMissingColumns=True)
    return _printable(union).select(*_FIELDS)


@entry(
    "telemetry_union",
    with_views(
        "priced_logs",
        _UNION_SQL
        + f"""SELECT {_LIST} FROM everything
QUALIFY row_number() OVER (PARTITION BY service ORDER BY t DESC, k DESC) <= 50""",
    ),
)
def telemetry_union(spark, folder):
    return _printable(ops.telemetry_union(service_rows(spark, folder))).select(*_FIELDS)
