"""Readers, writers and streams over the given tables."""

from __future__ import annotations

from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.sql import functions as F

from brightwater.entries import SQL, churn, entry, guard_jobs, ops_tables, retrieval
from brightwater.entries.views_sql import with_views
from brightwater.operators import evaluation
from brightwater.operators.request_log import request_cost
from brightwater.plans import tables
from brightwater.plans.scratch import scratch_path, written
from brightwater.plans.skew import fits
from brightwater.sources import readers, sinks
from brightwater.streaming import claims, streams
from brightwater.streaming.runs import collected, collected_in_event_time


@entry(
    "read_text_documents",
    """WITH raw AS (SELECT concat('doc-', doc_id, CASE lang WHEN 'es' THEN '.docx' ELSE '.TXT' END) AS name, CASE WHEN n_chars % 10 = 0 THEN chr(10) || ' ' ELSE text END AS text, lang FROM documents)
SELECT name, CASE WHEN lang = 'es' THEN 'Unsupported format: docx. Use TXT.' WHEN trim(text, chr(10) || ' ') = '' THEN concat('Document "', name, '" contains no extractable text.') END AS reason,
 CASE WHEN lang <> 'es' AND trim(text, chr(10) || ' ') <> '' THEN substr(text, 1, 10000) END AS content FROM raw""",
)
def read_text_documents(spark, folder):
    raw = tables.table(spark, folder, "documents").select(
        F.concat(
            F.lit("doc-"),
            F.col("doc_id").cast("string"),
            F.when(F.col("lang") == "es", ".docx").otherwise(".TXT"),
        ).alias("name"),
        F.when(F.col("n_chars") % 10 == 0, "\n ").otherwise(F.col("text")).alias("text"),
        F.array("lang", "source").alias("permissions"),
    )
    checked = readers.ingest_documents(raw)
    rejected = checked.filter(F.col("reason").isNotNull()).select("name", "reason")
    accepted = readers.document_rows(checked).select("name", "content")
    return accepted.unionByName(rejected, allowMissingColumns=True)


@entry(
    "read_telco_csv",
    with_views(
        "telco",
        f"""SELECT concat('C-', customer_id) AS "customerID", CASE WHEN customer_id % 2 = 0 THEN 'Female' ELSE 'Male' END AS gender, {churn._quoted(churn._PLAIN_FIELDS)},
 CASE WHEN tenure = 0 THEN ' ' ELSE cast(cast("TotalCharges" AS decimal(18,2)) AS varchar) END AS "TotalCharges", CASE WHEN churn = 1 THEN 'Yes' ELSE ' No' END AS "Churn" FROM telco""",
    ),
)
def read_telco_csv(spark, folder):
    path = scratch_path(spark, "telco")
    order = [c.split()[0] for c in readers.TELCO_SCHEMA.split(", ")]
    churn.raw_records(spark, folder).select(*order).write.csv(
        path, header=True, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False
    )
    return readers.read_telco_csv(spark, path)


@entry(
    "write_chunks",
    with_views("chunks", "SELECT id, doc_id, chunk_index, chunk_text FROM chunks"),
)
def write_chunks(spark, folder):
    path = sinks.write_chunks(retrieval.chunks(spark, folder), scratch_path(spark, "chunks"))
    return spark.read.parquet(path).select("id", "doc_id", "chunk_index", "chunk_text")


@entry(
    "append_request_log",
    with_views(
        "priced_logs",
        """SELECT id, project, endpoint, user_id, latency_ms, tokens_in, tokens_out, cast(cast(cast(cost_usd AS varchar) AS decimal(10,6)) AS double) AS cost_usd, status FROM priced_logs""",
    ),
)
def append_request_log(spark, folder):
    path = sinks.append_request_log(tables.request_logs(spark, folder), scratch_path(spark, "logs"))
    return (
        spark.read.parquet(path)
        .withColumn("cost_usd", F.col("cost_usd").cast("double"))
        .drop("error_msg", "created_at")
    )


@entry(
    "append_eval_result",
    SQL["combine_rag_eval"]
    .replace("AS groundedness,", "AS groundedness, max(score) FILTER (WHERE judge='groundedness') AS groundedness_score,")
    .replace("max(score) FILTER (WHERE judge='hallucination') AS hallucination_confidence, ", ""),
)
def append_eval_result(spark, folder):
    judged = evaluation.parse_judge_output(ops_tables.judge_replies(spark, folder))
    path = sinks.append_eval_result(
        evaluation.combine_rag_eval(judged), scratch_path(spark, "evaluations")
    )
    why = F.col("judge_reasoning")
    return spark.read.parquet(path).select(
        "query_id",
        "groundedness",
        "groundedness_score",
        "answer_relevance",
        "hallucination",
        why["groundedness"].alias("why_grounded"),
        why["answerRelevance"].alias("why_relevant"),
        why["hallucination"].alias("why_hallucination"),
    )


@entry(
    "append_security_event",
    f"""WITH {guard_jobs._GUARDED} SELECT doc_id, 'injection_attempt' AS event_type, substr(sha256(substr(input, 1, 500)), 1, 16) AS input_hash,
 {guard_jobs._INJECTION} AS reason, 'high' AS severity FROM guarded WHERE ({guard_jobs._INJECTION}) IS NOT NULL""",
)
def append_security_event(spark, folder):
    from brightwater.operators.guard import detect_prompt_injection

    unsafe = detect_prompt_injection(guard_jobs.guarded(spark, folder)).filter("NOT safe")
    events = unsafe.select(
        "doc_id",
        F.lit("injection_attempt").alias("event_type"),
        "input",
        "reason",
        F.lit("high").alias("severity"),
    )
    return spark.read.parquet(
        sinks.append_security_event(events, scratch_path(spark, "security"))
    )


def agent_runs(spark, folder):
    """Every order as a run whose steps follow from its status."""
    status = F.col("o_orderstatus")

    def step(event, tool=None, message=None):
        return F.struct(
            F.date_format("o_orderdate", "yyyy-MM-dd").alias("timestamp"),
            F.lit(event).alias("event"),
            (F.lit(tool) if tool is None else tool).cast("string").alias("toolName"),
            F.lit(message).cast("string").alias("message"),
        )

    tool = F.when(F.col("o_totalprice") > 200000, "search").otherwise("calculator")
    planned = F.array(step("plan"), step("step_start", tool))
    return tables.table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("run_id"),
        F.col("o_orderpriority").alias("task"),
        (status == "F").alias("success"),
        F.when(status == "F", F.concat(planned, F.array(step("step_end", tool), step("summary"))))
        .when(status == "P", F.concat(planned, F.array(step("step_error", tool, "timeout"))))
        .otherwise(F.array(step("summary")))
        .alias("steps"),
        F.lit("llama-3.3-70b-versatile").alias("model_used"),
    )


@entry(
    "append_agent_run",
    """SELECT o_orderkey AS run_id, CASE o_orderstatus WHEN 'F' THEN 'success' WHEN 'P' THEN 'tool_failure' ELSE 'planning_failure' END AS outcome,
 CASE o_orderstatus WHEN 'O' THEN 0 ELSE 1 END::bigint AS started, CASE o_orderstatus WHEN 'F' THEN 1 ELSE 0 END::bigint AS finished, CASE o_orderstatus WHEN 'P' THEN 1 ELSE 0 END::bigint AS failed FROM orders""",
)
def append_agent_run(spark, folder):
    from brightwater.operators.agents import agent_run_outcomes, explode_steps

    path = sinks.append_agent_run(agent_runs(spark, folder), scratch_path(spark, "runs"))
    return agent_run_outcomes(explode_steps(spark.read.parquet(path)))


@entry(
    "append_record_json",
    "SELECT conv_id, turn, text AS content, '2024-06-30T00:00:00.000Z' AS \"timestamp\" FROM conversations",
)
def append_record_json(spark, folder):
    records = tables.table(spark, folder, "conversations").select(
        "conv_id", "turn", F.col("text").alias("content")
    )
    path = sinks.append_record_json(
        records, scratch_path(spark, "records"), F.lit("2024-06-30T00:00:00.000Z")
    )
    schema = "conv_id long, turn long, content string, timestamp string"
    return spark.read.schema(schema).json(path)


@entry(
    "enqueue_jobs",
    f"WITH {ops_tables._JOBS_SQL} SELECT job_id, status, epoch_us(created_at)//1000 AS created_ms FROM jobs",
)
def enqueue_jobs(spark, folder):
    """The jobs are queued and taken in two turns."""
    jobs = ops_tables.job_rows(spark, folder)
    queue, store = scratch_path(spark, "queue"), scratch_path(spark, "taken")
    for number in (0, 1):
        sinks.enqueue_jobs(jobs.filter(F.col("job_id") % 2 == number), queue)
        taken = streams.dequeue(streams.read_queue(spark, queue, jobs.schema, 1), store)
    return taken.select("job_id", "status", F.unix_millis("created_at").alias("created_ms"))


@entry("claim_jobs", SQL["enqueue_jobs"])
def claim_jobs(spark, folder):
    """Segments of jobs, taken by two consumers side by side into one store."""
    jobs = ops_tables.job_rows(spark, folder)
    queue, store = scratch_path(spark, "segments"), scratch_path(spark, "claimed")
    for number in range(4):
        claims.enqueue_segment(jobs.filter(F.pmod("job_id", F.lit(4)) == number), queue)

    def consume(name):
        return claims.take_segments(spark, queue, name, store, jobs.schema)

    with ThreadPool(2) as pool:
        pool.map(inheritable_thread_target(spark)(consume), ["first", "second"])
    taken = spark.read.schema(jobs.schema).parquet(store)
    return taken.select("job_id", "status", F.unix_millis("created_at").alias("created_ms"))


@entry(
    "read_table_by_key",
    "SELECT event_id, user_id, event_type, value FROM events WHERE user_id = 42",
)
def read_table_by_key(spark, folder):
    events = tables.table(spark, folder, "events").drop("ts", "props")
    return readers.read_table_by_key(events, user_id=42)


@entry(
    "read_table_by_keys",
    "SELECT doc_id, lang, source, n_chars FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)",
)
def read_table_by_keys(spark, folder):
    docs = tables.table(spark, folder, "documents").drop("text")
    return readers.read_table_by_keys(docs, tables.table(spark, folder, "labels"), ["doc_id"])


# Streams: each must end with what its batch form gives.
#: A row of this name and time, far behind all given ones, closes an event-time stream.
END, END_MS = "end of input", 4_000_000_000_000


@entry("rate_limit_stream", SQL["rate_limit_batch"])
def rate_limit_stream(spark, folder):
    """In event time: the one file of requests is in no order, and users whose window has passed are forgotten."""
    requests = guard_jobs.limited_requests(spark, folder, tables.stream)
    last = spark.createDataFrame([(-1, END, END, END_MS)], requests.schema)
    decided = collected_in_event_time(
        requests, lambda rows: streams.rate_limit_stream(rows, 3, guard_jobs.DAY_MS, late="60 days"), last, "rate-limit"
    )
    return decided.where(F.col("user_id") != END).select("id", "allowed", "remaining", "reset_in")


@entry("rate_limit_stream_ordered", SQL["rate_limit_batch"])
def rate_limit_stream_ordered(spark, folder):
    """Decided at once, for requests that arrive in time order across micro-batches."""
    requests = guard_jobs.limited_requests(spark, folder, tables.stream)
    decided = streams.rate_limit_stream(requests, 3, guard_jobs.DAY_MS)
    return collected(decided, "rate-limit").select("id", "allowed", "remaining", "reset_in")


@entry("breaker_stream", SQL["breaker_batch"])
def breaker_stream(spark, folder):
    """In event time, as ``rate_limit_stream``."""
    events = guard_jobs.call_outcomes(spark, folder, tables.stream)
    last = spark.createDataFrame([(END, END_MS, -1, True)], events.schema)
    changes = collected_in_event_time(
        events, lambda rows: streams.breaker_stream(rows, reset_ms=guard_jobs.RESET_MS, late="60 days"), last, "breaker"
    )
    return changes.where(F.col("name") != END)


@entry("breaker_stream_ordered", SQL["breaker_batch"])
def breaker_stream_ordered(spark, folder):
    """Decided at once, for outcomes that arrive in time order across micro-batches."""
    events = guard_jobs.call_outcomes(spark, folder, tables.stream)
    changes = streams.breaker_stream(events, reset_ms=guard_jobs.RESET_MS)
    return collected(changes, "breaker").drop("batch")


@entry("memory_stream", SQL["last_n_interactions"])
def memory_stream(spark, folder):
    turns = tables.interactions(spark, folder, tables.stream)
    updates = collected(streams.memory_stream(turns), "memory", mode="update")
    return streams.latest_memory(updates).select(
        "user_id",
        "role",
        F.size("recent_interactions").cast("bigint").alias("kept"),
        F.array_join("recent_interactions", " | ").alias("recent"),
    )


_WINDOWS = with_views(
    "priced_logs",
    """WITH slots AS (SELECT *, unnest(generate_series(date_trunc('hour', created_at) - INTERVAL 23 HOUR, date_trunc('hour', created_at), INTERVAL 1 HOUR)) AS window_start FROM priced_logs),
stats AS (SELECT project, window_start, count(*) AS n, 0.95::double * (count(*) - 1) AS place, list_sort(list(latency_ms)) AS l, sum(latency_ms) AS latency, sum(tokens_in + tokens_out) AS tokens,
 sum(cast(cast(cost_usd AS varchar) AS decimal(10,6))) AS cost, count(*) FILTER (WHERE status = 'error') AS errors FROM slots GROUP BY project, window_start)
SELECT project, epoch_us(window_start)//1000 AS window_start_ms, n AS total_requests, cast((2*latency + n) // (2*n) AS bigint) AS avg_latency_ms,
 cast(round_even(CASE WHEN floor(place) = ceil(place) THEN l[cast(place AS bigint) + 1]
  ELSE (ceil(place) - place) * l[cast(floor(place) AS bigint) + 1] + (place - floor(place)) * l[cast(ceil(place) AS bigint) + 1] END, 0) AS bigint) AS p95_latency_ms,
 cast(tokens AS bigint) AS total_tokens, cast(cost AS double) AS total_cost_usd, errors AS error_count, cast((20000*errors + n) // (2*n) AS bigint) / 100.0 AS error_rate_pct FROM stats""",
)


@entry("request_stats_stream", _WINDOWS)
def request_stats_stream(spark, folder):
    # One file holds the whole log in no order; no row of it is late.
    logs = request_cost(tables.request_logs(spark, folder, tables.stream))
    updates = collected(streams.request_stats_stream(logs, late="60 days"), "request-stats", mode="update")
    windows = streams.latest_windows(updates)
    return windows.withColumn("window_start_ms", F.unix_millis("window_start")).drop("window_start")


_P95 = _WINDOWS[_WINDOWS.index(" cast(round_even(") : _WINDOWS.index(" AS p95_latency_ms,")] + " AS p95_latency_ms"


@entry("request_sketch_stream", _WINDOWS.replace(_P95, " true AS near_p95"))
def request_sketch_stream(spark, folder):
    """Windows from sketches of bounded size; whether the percentile is within their stated error of the exact rank."""
    logs = request_cost(tables.request_logs(spark, folder, tables.stream))
    updates = collected(streams.request_sketch_stream(logs, late="60 days"), "request-sketch", mode="update")
    windows = written(streams.sketched_windows(updates), "sketched-windows")
    hour = F.date_trunc("hour", "created_at").alias("hour")
    given = tables.request_logs(spark, folder).groupBy("project", hour, "latency_ms").agg(F.count(F.lit(1)).alias("n"))
    first = F.col("hour") - F.expr("INTERVAL 23 HOURS")
    starts = F.explode(F.sequence(first, F.col("hour"), F.expr("INTERVAL 1 HOUR")))
    counted = given.select("project", "latency_ms", "n", starts.alias("window_start"))
    # The files look small enough to broadcast before they are opened into windows: only the windows may be.
    windows = windows.hint("broadcast" if fits(windows) else "merge")
    ranked = counted.join(windows.select("project", "window_start", "p95_latency_ms"), ["project", "window_start"])
    below, upto = F.col("latency_ms") < F.col("p95_latency_ms"), F.col("latency_ms") <= F.col("p95_latency_ms")
    ranks = ranked.groupBy("project", "window_start").agg(
        F.sum("n").alias("all"), F.sum(F.when(below, F.col("n")).otherwise(0)).alias("below"), F.sum(F.when(upto, F.col("n")).otherwise(0)).alias("upto")
    )
    error = streams.SKETCH_ERROR
    near = (F.col("below") <= (0.95 + error) * F.col("all")) & (F.col("upto") >= (0.95 - error) * F.col("all"))
    told = windows.drop("p95_latency_ms").join(ranks.select("project", "window_start", near.alias("near_p95")), ["project", "window_start"])
    return told.withColumn("window_start_ms", F.unix_millis("window_start")).drop("window_start")


@entry(
    "job_stream",
    f"""WITH {guard_jobs._TEXTS}, sized AS (SELECT jobs.*, t, strlen(cast(CASE WHEN input_text IS NULL THEN json_object('pipeline_type', jobs.pipeline_type) ELSE json_object('pipeline_type', jobs.pipeline_type, 'input_text', input_text) END AS varchar))
 + coalesce(strlen(input_json) + 14, 0) AS bytes FROM jobs JOIN texts ON texts.job_id = jobs.job_id),
checked AS (SELECT *, CASE WHEN pipeline_type IS NULL THEN 'Missing required field: pipeline_type.'
 WHEN pipeline_type = 'translation' THEN 'Invalid pipeline_type "translation". Valid values: invoice_extraction, email_classification, support_ticket_categorization.'
 WHEN input_text IS NULL AND input_json IS NULL THEN 'Provide either input_text or input_json.'
 WHEN bytes > 102400 THEN concat('Input size ', cast(bytes AS varchar), ' bytes exceeds the 100KB limit (102400 bytes).') END AS error FROM sized)
SELECT job_id, CASE WHEN error IS NULL THEN 'completed' ELSE 'failed' END AS status, error,
 CASE WHEN error IS NULL AND pipeline_type = 'email_classification' THEN {guard_jobs._EMAIL.replace('{t}', 't')} END AS email,
 CASE WHEN error IS NULL AND pipeline_type = 'support_ticket_categorization' THEN {guard_jobs._TICKET.replace('{t}', 't')} END AS ticket FROM checked""",
)
def job_stream(spark, folder):
    """The jobs arrive in two queues, one run each, into one store; some of them in both."""
    jobs = guard_jobs.text_jobs(spark, folder, tables.stream).withColumn("queued_at", F.col("job_id"))
    path, turn = scratch_path(spark, "jobs-done"), F.pmod("job_id", F.lit(3))
    for number in (0, 1):
        queue = jobs.filter(turn != number)
        done = streams.job_stream(queue, F.lit("2024-06-30"), path, f"queue-{number}", "queued_at")
    return done.select(
        "job_id",
        "status",
        "error",
        F.col("email.category").alias("email"),
        F.col("ticket.category").alias("ticket"),
    )


@entry(
    "job_expiry_stream",
    """WITH RECURSIVE finished AS (SELECT l_orderkey AS job_id, epoch_ms(cast(l_shipdate AS timestamp)) AS ms FROM lineitem WHERE l_linestatus = 'F'),
kept AS (SELECT job_id, min(ms) AS ms FROM finished GROUP BY job_id
 UNION ALL SELECT k.job_id, (SELECT min(f.ms) FROM finished f WHERE f.job_id = k.job_id AND f.ms - k.ms > 24 * 3600000) AS ms FROM kept k WHERE k.ms IS NOT NULL)
SELECT job_id, ms AS created_ms FROM kept WHERE ms IS NOT NULL""",
)
def job_expiry_stream(spark, folder):
    """Jobs finished more than 24 hours after they were last remembered are given again."""
    finished = (
        tables.stream(spark, folder, "lineitem")
        .filter("l_linestatus = 'F'")
        .select(F.col("l_orderkey").alias("job_id"), F.col("l_shipdate").alias("created_at"))
    )
    return collected(streams.job_expiry_stream(finished), "job-expiry").drop("batch")


@entry(
    "session_store_stream",
    """SELECT session_id, transcript, seq FROM (SELECT conv_id AS session_id, text AS transcript, turn AS seq FROM conversations)
QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY seq DESC) = 1""",
)
def session_store_stream(spark, folder):
    """Odd turns arrive in a first run, even ones in a second."""
    sessions = tables.stream(spark, folder, "conversations").select(
        F.col("conv_id").alias("session_id"), F.col("text").alias("transcript"), F.col("turn").alias("seq")
    )
    path = scratch_path(spark, "sessions")
    for number in (1, 0):
        stored = streams.session_store_stream(
            sessions.filter(F.col("seq") % 2 == number), path, name=f"turns-{number}"
        )
    return stored
