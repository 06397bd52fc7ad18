"""Queries over prompts, evaluations, agent runs and maintained tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from brightwater.entries import SQL, entry
from brightwater.entries.views_sql import with_views
from brightwater.operators import agents, evaluation, keyed_store, prompts
from brightwater.operators import tables as ops
from brightwater.plans import tables
from brightwater.plans.scratch import scratch_path


def versions(spark, folder):
    return prompts.prompt_history(tables.prompt_saves(spark, folder))


@entry(
    "prompt_history",
    with_views(
        "prompt_versions", "SELECT project, name, version, content, model, is_active, seq FROM prompt_versions"
    ),
)
def prompt_history(spark, folder):
    return versions(spark, folder)


@entry(
    "active_prompt",
    with_views(
        "prompt_versions", "SELECT project, name, version, content, model FROM prompt_versions WHERE is_active"
    ),
)
def active_prompt(spark, folder):
    return prompts.active_prompt(versions(spark, folder))


@entry(
    "next_version",
    with_views(
        "prompt_versions",
        """SELECT w.project, w.name, coalesce(max(version), 0) + 1 AS next_version FROM
(SELECT DISTINCT project, name FROM prompt_saves UNION ALL SELECT DISTINCT project, 'new' FROM prompt_saves) w
LEFT JOIN prompt_versions v ON v.project = w.project AND v.name = w.name GROUP BY w.project, w.name""",
    ),
)
def next_version(spark, folder):
    known = tables.prompt_saves(spark, folder).select("project", "name").distinct()
    fresh = known.select("project", F.lit("new").alias("name")).distinct()
    return prompts.next_version(versions(spark, folder), known.union(fresh))


@entry(
    "deactivate_versions",
    with_views(
        "prompt_versions",
        """SELECT project, name, version, is_active AND NOT (project, name) IN
(SELECT (project, name) FROM prompt_saves WHERE content LIKE 'blue%') AS is_active FROM prompt_versions""",
    ),
)
def deactivate_versions(spark, folder):
    saves = tables.prompt_saves(spark, folder)
    return prompts.deactivate_versions(
        versions(spark, folder), saves.filter("content LIKE 'blue%'")
    ).select("project", "name", "version", "is_active")


@entry(
    "eval_summary",
    with_views(
        "eval_results",
        """SELECT project, count(*) AS total_evals,
 cast((2*sum(cast(round(groundedness*1000) AS bigint)) + count(groundedness)) // (2*count(groundedness)) AS bigint) / 1000.0 AS avg_groundedness,
 cast((2*sum(cast(round(answer_relevance*1000) AS bigint)) + count(answer_relevance)) // (2*count(answer_relevance)) AS bigint) / 1000.0 AS avg_answer_relevance,
 cast(count(*) FILTER (WHERE hallucination) AS bigint) AS hallucination_count,
 cast((2000*count(*) FILTER (WHERE hallucination) + count(*)) // (2*count(*)) AS bigint) / 10.0 AS hallucination_rate_pct
FROM eval_results GROUP BY project""",
    ),
)
def eval_summary(spark, folder):
    return evaluation.eval_summary(tables.eval_results(spark, folder))


_REPLIES_SQL = """replies AS (SELECT doc_id AS query_id, judge, CASE
  WHEN n_chars % 7 = 0 THEN 'I cannot judge this.'
  WHEN n_chars % 7 = 1 THEN 'Result: {"score": 0.9, "reasoning": oops}'
  WHEN n_chars % 7 = 2 THEN '{"reasoning": "no score"}'
  WHEN judge = 'hallucination' THEN concat('{"hallucinated": ', CASE WHEN n_chars % 2 = 0 THEN 'true' ELSE 'false' END, ', "confidence": ', cast((n_chars % 13) AS varchar), '.25, "reasoning": "', lang, '"}')
  ELSE concat('Here you go: {"score": 0.', cast((n_chars % 97) AS varchar), ', "reasoning": "', source, '"} Done.') END AS reply
 FROM documents CROSS JOIN (VALUES ('groundedness'), ('relevance'), ('hallucination')) j(judge)),
found AS (SELECT query_id, judge, CASE WHEN regexp_matches(reply, '\\{(?s:.)*\\}') THEN regexp_extract(reply, '(\\{(?s:.)*\\})', 1) ELSE '{}' END AS body FROM replies),
good AS (SELECT query_id, judge, CASE WHEN json_valid(body) THEN body END AS body FROM found),
judged AS (SELECT query_id, judge,
  least(1.0::double, greatest(0.0::double, coalesce(cast(json_extract_string(body, CASE judge WHEN 'hallucination' THEN '$.confidence' ELSE '$.score' END) AS double), 0.5::double))) AS score,
  CASE WHEN judge = 'hallucination' THEN coalesce(json_extract_string(body, '$.hallucinated') = 'true', false) END AS hallucinated,
  CASE WHEN body IS NULL THEN 'Evaluation failed' ELSE coalesce(json_extract_string(body, '$.reasoning'), '') END AS reasoning FROM good)"""


def judge_replies(spark, folder):
    n = F.col("n_chars")
    docs = tables.table(spark, folder, "documents").select("doc_id", "n_chars", "lang", "source")
    judges = F.explode(F.array(*[F.lit(j) for j in evaluation.JUDGES]))
    return docs.withColumn("judge", judges).select(
        F.col("doc_id").alias("query_id"),
        "judge",
        F.when(n % 7 == 0, "I cannot judge this.")
        .when(n % 7 == 1, 'Result: {"score": 0.9, "reasoning": oops}')
        .when(n % 7 == 2, '{"reasoning": "no score"}')
        .when(
            F.col("judge") == "hallucination",
            F.concat(
                F.lit('{"hallucinated": '),
                F.when(n % 2 == 0, "true").otherwise("false"),
                F.lit(', "confidence": '),
                (n % 13).cast("string"),
                F.lit('.25, "reasoning": "'),
                "lang",
                F.lit('"}'),
            ),
        )
        .otherwise(
            F.concat(
                F.lit('Here you go: {"score": 0.'),
                (n % 97).cast("string"),
                F.lit(', "reasoning": "'),
                "source",
                F.lit('"} Done.'),
            )
        )
        .alias("reply"),
    )


@entry(
    "parse_judge_output",
    f"WITH {_REPLIES_SQL} SELECT query_id, judge, score, hallucinated, reasoning FROM judged",
)
def parse_judge_output(spark, folder):
    return evaluation.parse_judge_output(judge_replies(spark, folder)).drop("reply")


@entry(
    "combine_rag_eval",
    f"""WITH {_REPLIES_SQL} SELECT query_id, max(score) FILTER (WHERE judge='groundedness') AS groundedness,
 max(score) FILTER (WHERE judge='relevance') AS answer_relevance, bool_or(hallucinated) FILTER (WHERE judge='hallucination') AS hallucination,
 max(score) FILTER (WHERE judge='hallucination') AS hallucination_confidence, max(reasoning) FILTER (WHERE judge='groundedness') AS why_grounded,
 max(reasoning) FILTER (WHERE judge='relevance') AS why_relevant, max(reasoning) FILTER (WHERE judge='hallucination') AS why_hallucination
FROM judged GROUP BY query_id""",
)
def combine_rag_eval(spark, folder):
    judged = evaluation.parse_judge_output(judge_replies(spark, folder))
    return evaluation.combine_rag_eval(judged).select(
        "query_id",
        "groundedness",
        "answer_relevance",
        "hallucination",
        "hallucination_confidence",
        F.col("judge_reasoning.groundedness").alias("why_grounded"),
        F.col("judge_reasoning.answerRelevance").alias("why_relevant"),
        F.col("judge_reasoning.hallucination").alias("why_hallucination"),
    )


@entry(
    "agent_run_summary",
    with_views(
        "agent_steps",
        """WITH runs AS (SELECT run_id, count(*) FILTER (WHERE event='plan') AS plans, count(*) FILTER (WHERE event='step_start') AS s,
 count(*) FILTER (WHERE event='step_end') AS e, count(*) FILTER (WHERE event='step_error') AS f FROM agent_steps GROUP BY run_id),
o AS (SELECT CASE WHEN plans=0 THEN 'planning_failure' WHEN f>0 THEN 'tool_failure' ELSE 'success' END AS outcome, s, e, f FROM runs)
SELECT outcome, count(*) AS runs, cast(sum(s) AS bigint) AS steps_started, cast(sum(e) AS bigint) AS steps_finished, cast(sum(f) AS bigint) AS steps_failed,
 cast((2000*count(*) + (SELECT count(*) FROM o)) // (2*(SELECT count(*) FROM o)) AS bigint) / 10.0 AS share_pct FROM o GROUP BY outcome""",
    ),
)
def agent_run_summary(spark, folder):
    return agents.agent_run_summary(tables.agent_steps(spark, folder))


@entry(
    "agent_tool_failures",
    with_views(
        "agent_steps",
        "SELECT tool_name, count(*) AS failures FROM agent_steps WHERE event='step_error' GROUP BY tool_name",
    ),
)
def agent_tool_failures(spark, folder):
    return agents.agent_tool_failures(tables.agent_steps(spark, folder))


# Maintained tables: orders are the base; line items of the order bring the updates.
def order_base(spark, folder):
    return tables.table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("job_id"),
        F.col("o_orderstatus").alias("status"),
        F.col("o_orderpriority").alias("note"),
        F.lit(0).cast("bigint").alias("updated_at"),
    )


def order_updates(spark, folder):
    """Returned items change the status; the key range runs past the known orders."""
    return (
        tables.table(spark, folder, "lineitem")
        .filter("l_returnflag = 'R'")
        .select(
            (F.col("l_orderkey") + 100).alias("job_id"),
            F.when(F.col("l_linestatus") == "F", "returned").alias("status"),
            F.when(F.col("l_quantity") > 25, "bulk").alias("note"),
            (
                F.unix_date(F.col("l_shipdate").cast("date")) * F.lit(10**10)
                + F.col("l_partkey") * 10
                + F.col("l_linenumber")
            ).alias("updated_at"),
        )
    )


_BASE_SQL = """base AS (SELECT o_orderkey AS job_id, o_orderstatus AS status, o_orderpriority AS note, 0::bigint AS updated_at FROM orders),
updates AS (SELECT l_orderkey + 100 AS job_id, CASE WHEN l_linestatus='F' THEN 'returned' END AS status, CASE WHEN l_quantity > 25 THEN 'bulk' END AS note,
 date_diff('day', date '1970-01-01', cast(l_shipdate AS date)) * 10000000000 + l_partkey*10 + l_linenumber AS updated_at FROM lineitem WHERE l_returnflag = 'R')"""


@entry(
    "upsert_latest",
    f"""WITH {_BASE_SQL}, newest AS (SELECT job_id, status, note, updated_at FROM updates
 QUALIFY row_number() OVER (PARTITION BY job_id ORDER BY updated_at DESC) = 1)
SELECT * FROM newest UNION ALL SELECT * FROM base WHERE job_id NOT IN (SELECT job_id FROM newest)""",
)
def upsert_latest(spark, folder):
    return ops.upsert_latest(
        order_base(spark, folder), order_updates(spark, folder), ["job_id"], "updated_at"
    )


def stored_orders(spark, folder):
    return keyed_store.create_keyed(order_base(spark, folder), scratch_path(spark, "keyed"), ["job_id"])


@entry("upsert_stored", SQL["upsert_latest"])
def upsert_stored(spark, folder):
    """The updates come in two turns; each rewrites the buckets of its keys."""
    store, updates = stored_orders(spark, folder), order_updates(spark, folder)
    late = F.col("updated_at") > F.lit(updates.agg(F.percentile_approx("updated_at", 0.5)).first()[0])
    store.upsert(updates.where(~late), "updated_at").upsert(updates.where(late), "updated_at")
    return keyed_store.open_keyed(spark, store.path).rows


@entry(
    "insert_ignore",
    f"""WITH {_BASE_SQL}, oldest AS (SELECT job_id, status, note, updated_at FROM updates
 QUALIFY row_number() OVER (PARTITION BY job_id ORDER BY updated_at) = 1)
SELECT * FROM base UNION ALL SELECT * FROM oldest WHERE job_id NOT IN (SELECT job_id FROM base)""",
)
def insert_ignore(spark, folder):
    return ops.insert_ignore(
        order_base(spark, folder), order_updates(spark, folder), ["job_id"], "updated_at"
    )


@entry(
    "partial_update",
    f"""WITH {_BASE_SQL}, folded AS (SELECT job_id, arg_max(status, updated_at) FILTER (WHERE status IS NOT NULL) AS s,
 arg_max(note, updated_at) FILTER (WHERE note IS NOT NULL) AS n, max(updated_at) AS u FROM updates GROUP BY job_id)
SELECT b.job_id, coalesce(s, b.status) AS status, coalesce(n, b.note) AS note, coalesce(u, b.updated_at) AS updated_at
FROM base b LEFT JOIN folded f ON f.job_id = b.job_id""",
)
def partial_update(spark, folder):
    return ops.partial_update(
        order_base(spark, folder),
        order_updates(spark, folder),
        ["job_id"],
        ["status", "note"],
        "updated_at",
        "updated_at",
    )


@entry(
    "delete_by_key",
    f"WITH {_BASE_SQL} SELECT * FROM base WHERE job_id NOT IN (SELECT job_id FROM updates)",
)
def delete_by_key(spark, folder):
    return ops.delete_by_key(
        order_base(spark, folder), order_updates(spark, folder), ["job_id"]
    )


@entry("delete_stored", SQL["delete_by_key"])
def delete_stored(spark, folder):
    store = stored_orders(spark, folder).delete(order_updates(spark, folder))
    return keyed_store.open_keyed(spark, store.path).rows


@entry(
    "job_status_fold",
    """WITH log AS (SELECT l_orderkey AS job_id, l_partkey * 100 + l_linenumber * 10 + 1 AS seq, 'processing' AS status, NULL AS result, NULL AS error FROM lineitem
 UNION ALL SELECT l_orderkey, l_partkey * 100 + l_linenumber * 10 + CASE l_returnflag WHEN 'R' THEN 3 ELSE 2 END, CASE l_returnflag WHEN 'R' THEN 'failed' ELSE 'completed' END,
 CASE l_returnflag WHEN 'R' THEN NULL ELSE concat('part ', cast(l_partkey AS varchar)) END, CASE l_returnflag WHEN 'R' THEN 'returned' END FROM lineitem WHERE l_linestatus='F')
SELECT job_id, status, result, error, cast(seq AS bigint) AS seq FROM (SELECT job_id, max(seq) AS seq, arg_max(struct_pack(s:=status, r:=result, e:=error), seq) AS x FROM log GROUP BY job_id)
 t, LATERAL (SELECT x.s AS status, x.r AS result, x.e AS error)""",
)
def job_status_fold(spark, folder):
    return ops.job_status_fold(status_log(spark, folder)).withColumn(
        "seq", F.col("seq").cast("bigint")
    )


def status_log(spark, folder):
    """A job event log: every line item starts its order's job, finished ones end it."""
    lines = tables.table(spark, folder, "lineitem")
    number = F.col("l_partkey") * 100 + F.col("l_linenumber") * 10
    returned = F.col("l_returnflag") == "R"
    nothing = F.lit(None).cast("string")
    started = lines.select(
        F.col("l_orderkey").alias("job_id"),
        (number + 1).alias("seq"),
        F.lit("processing").alias("status"),
        nothing.alias("result"),
        nothing.alias("error"),
    )
    ended = lines.filter("l_linestatus = 'F'").select(
        F.col("l_orderkey").alias("job_id"),
        (number + F.when(returned, 3).otherwise(2)).alias("seq"),
        F.when(returned, "failed").otherwise("completed").alias("status"),
        F.when(~returned, F.concat(F.lit("part "), F.col("l_partkey").cast("string"))).alias(
            "result"
        ),
        F.when(returned, "returned").alias("error"),
    )
    return started.unionByName(ended)


def job_rows(spark, folder):
    status = F.col("o_orderstatus")
    return tables.table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("job_id"),
        F.when(status == "F", "completed")
        .when(status == "P", "pending")
        .otherwise("failed")
        .alias("status"),
        F.col("o_orderdate").cast("timestamp").alias("created_at"),
    )


_JOBS_SQL = """jobs AS (SELECT o_orderkey AS job_id, CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'P' THEN 'pending' ELSE 'failed' END AS status,
 o_orderdate AS created_at FROM orders)"""


@entry(
    "purge_expired_jobs",
    f"""WITH {_JOBS_SQL} SELECT job_id, status FROM jobs
WHERE NOT (status IN ('completed','failed') AND created_at < timestamp '1997-01-01 00:00:00' - INTERVAL 24 HOUR)""",
)
def purge_expired_jobs(spark, folder):
    as_of = F.lit("1997-01-01 00:00:00").cast("timestamp")
    return ops.purge_expired_jobs(job_rows(spark, folder), as_of).select("job_id", "status")


@entry(
    "pending_fifo",
    f"WITH {_JOBS_SQL} SELECT job_id, status FROM jobs WHERE status='pending' ORDER BY created_at, job_id LIMIT 10",
)
def pending_fifo(spark, folder):
    return ops.pending_fifo(job_rows(spark, folder)).select("job_id", "status")


@entry(
    "unexpired_memory",
    """SELECT concat('mem:', cast(event_id AS varchar)) AS key, props AS value FROM events
WHERE event_type = 'signup' OR ts + INTERVAL 7 DAY > timestamp '2024-01-20 00:00:00'""",
)
def unexpired_memory(spark, folder):
    lasting = F.col("event_type") == "signup"
    entries = tables.table(spark, folder, "events").select(
        F.concat(F.lit("mem:"), F.col("event_id").cast("string")).alias("key"),
        F.col("props").alias("value"),
        F.when(~lasting, F.col("ts").cast("timestamp") + F.expr("INTERVAL 7 DAYS")).alias(
            "expires_at"
        ),
    )
    as_of = F.lit("2024-01-20 00:00:00").cast("timestamp")
    return ops.unexpired_memory(entries, as_of).select("key", "value")


@entry(
    "last_n_interactions",
    with_views(
        "interactions",
        """SELECT user_id, 'user' AS role, count(*) AS kept, array_to_string(list(text ORDER BY seq), ' | ') AS recent FROM
(SELECT * FROM interactions QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY seq DESC) <= 10) GROUP BY user_id""",
    ),
)
def last_n_interactions(spark, folder):
    return ops.last_n_interactions(tables.interactions(spark, folder)).select(
        "user_id",
        "role",
        F.size("recent_interactions").cast("bigint").alias("kept"),
        F.array_join("recent_interactions", " | ").alias("recent"),
    )
