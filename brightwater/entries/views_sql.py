"""The derived views of ``plans/tables.py`` as SQL text."""

from __future__ import annotations

VIEWS = {
    "request_logs": """
SELECT event_id AS id, concat('svc-', cast(user_id % 5 AS varchar)) AS project, event_type AS endpoint,
 cast(user_id AS varchar) AS user_id, cast(floor(value*100) AS int) AS latency_ms,
 cast(regexp_extract(props,'([0-9]+)',1) AS int)*10 AS tokens_in, cast(regexp_extract(props,'([0-9]+)',1) AS int)*3 AS tokens_out,
 CASE event_id % 4 WHEN 0 THEN 'llama-3.3-70b-versatile' WHEN 1 THEN 'llama-3.1-8b-instant' WHEN 2 THEN 'mixtral-8x7b-32768' END AS model,
 CASE WHEN event_type='error' THEN 'error' ELSE 'success' END AS status, ts AS created_at FROM events""",
    "priced_logs": """
SELECT r.*, price_in, price_out, coalesce((tokens_in/1e6)*price_in + (tokens_out/1e6)*price_out, 0.0) AS cost_usd
 FROM request_logs r LEFT JOIN (VALUES ('llama-3.3-70b-versatile', 0.59::double, 0.79::double),
 ('llama-3.1-8b-instant', 0.05::double, 0.08::double), ('mixtral-8x7b-32768', 0.24::double, 0.24::double)) p(m, price_in, price_out)
 ON r.model = p.m""",
    "eval_results": """
SELECT d.doc_id AS query_id, d.source AS project, cast(l.quality*0.5 + (d.doc_id % 50)/100.0 AS double) AS groundedness,
 cast((d.n_chars % 101)/100.0 AS double) AS answer_relevance, CASE WHEN d.doc_id % 11 = 0 THEN NULL ELSE l.toxic=1 END AS hallucination
 FROM documents d JOIN labels l ON d.doc_id=l.doc_id""",
    "telco": """
SELECT c_custkey AS customer_id, tenure, monthly AS "MonthlyCharges", monthly*tenure AS "TotalCharges", CASE WHEN c_custkey % 6 = 0 THEN 1 ELSE 0 END AS "SeniorCitizen",
  CASE WHEN c_custkey % 2 = 0 THEN 'Yes' ELSE 'No' END AS "Partner", CASE WHEN c_custkey % 5 = 0 THEN 'Yes' ELSE 'No' END AS "Dependents",
  CASE WHEN c_custkey % 10 = 0 THEN 'No' ELSE 'Yes' END AS "PhoneService",
  CASE WHEN c_custkey % 10 = 0 THEN 'No phone service' WHEN c_custkey % 7 < 3 THEN 'Yes' ELSE 'No' END AS "MultipleLines",
  CASE c_nationkey % 3 WHEN 0 THEN 'Fiber optic' WHEN 1 THEN 'DSL' ELSE 'No' END AS "InternetService",
  CASE WHEN c_nationkey % 3 = 2 THEN 'No internet service' WHEN c_custkey % 11 < 4 THEN 'Yes' ELSE 'No' END AS "OnlineSecurity",
  CASE WHEN c_nationkey % 3 = 2 THEN 'No internet service' WHEN c_custkey % 13 < 5 THEN 'Yes' ELSE 'No' END AS "OnlineBackup",
  CASE WHEN c_nationkey % 3 = 2 THEN 'No internet service' WHEN c_custkey % 17 < 6 THEN 'Yes' ELSE 'No' END AS "DeviceProtection",
  CASE WHEN c_nationkey % 3 = 2 THEN 'No internet service' WHEN c_custkey % 19 < 6 THEN 'Yes' ELSE 'No' END AS "TechSupport",
  CASE WHEN c_nationkey % 3 = 2 THEN 'No internet service' WHEN c_custkey % 23 < 9 THEN 'Yes' ELSE 'No' END AS "StreamingTV",
  CASE WHEN c_nationkey % 3 = 2 THEN 'No internet service' WHEN c_custkey % 29 < 11 THEN 'Yes' ELSE 'No' END AS "StreamingMovies",
  CASE c_custkey % 3 WHEN 0 THEN 'Month-to-month' WHEN 1 THEN 'One year' ELSE 'Two year' END AS "Contract",
  CASE WHEN c_custkey % 8 < 5 THEN 'Yes' ELSE 'No' END AS "PaperlessBilling",
  CASE c_custkey % 4 WHEN 0 THEN 'Electronic check' WHEN 1 THEN 'Mailed check' WHEN 2 THEN 'Bank transfer (automatic)' ELSE 'Credit card (automatic)' END AS "PaymentMethod",
  churn FROM (SELECT c_custkey, c_nationkey, coalesce(least(72, cast(floor(extract(day from (o.l - o.f))/30) AS int)),0) AS tenure,
   floor(2000 + (c_acctbal+1000)*0.9)/100 AS monthly, CASE WHEN o.l IS NULL OR extract(day from (m.mx - o.l)) > 365 THEN 1 ELSE 0 END AS churn
   FROM customer LEFT JOIN (SELECT o_custkey, min(o_orderdate) f, max(o_orderdate) l FROM orders GROUP BY o_custkey) o ON o_custkey=c_custkey
   CROSS JOIN (SELECT max(o_orderdate) mx FROM orders) m) b""",
    "invoices": """
SELECT o_orderkey AS job_id, concat('Invoice Vendor: ', c_name, '; Total: $', cast(cast(floor(o_totalprice) AS bigint) AS varchar), '; Date: ', cast(cast(o_orderdate AS date) AS varchar)) AS input_text
 FROM orders JOIN customer ON c_custkey=o_custkey""",
    "prompt_saves": """
SELECT p_brand AS project, concat('size-', cast(p_size % 5 AS varchar)) AS name, p_name AS content,
 'llama-3.3-70b-versatile' AS model, p_partkey AS seq FROM part""",
    "prompt_versions": """
SELECT project, name, cast(row_number() OVER w AS bigint) AS version, content, model,
 seq = max(seq) OVER (PARTITION BY project, name) AS is_active, seq FROM prompt_saves WINDOW w AS (PARTITION BY project, name ORDER BY seq)""",
    "interactions": """
SELECT concat('u', cast(conv_id % 40 AS varchar)) AS user_id, conv_id*100+turn AS seq, text FROM conversations WHERE role='user'""",
    "text_queries": """
SELECT item_id AS query_id, text, CASE item_id % 4 WHEN 0 THEN 'en' WHEN 1 THEN 'de' WHEN 2 THEN 'fr' ELSE 'es' END AS user_id FROM benchmark""",
    "label_queries": """
SELECT label AS query_id, list(m ORDER BY i) AS embedding FROM (SELECT label, i, round(avg(v), 9) AS m FROM
 (SELECT label, generate_subscripts(embedding, 1) AS i, cast(unnest(embedding) AS double) AS v FROM embeddings) GROUP BY label, i) GROUP BY label""",
    "agent_steps": """
SELECT concat(cast(user_id AS varchar), '-', cast(cast(ts AS date) AS varchar)) AS run_id, event_id AS seq,
 CASE event_type WHEN 'signup' THEN 'plan' WHEN 'view' THEN 'step_start' WHEN 'click' THEN 'step_end' WHEN 'error' THEN 'step_error' ELSE 'summary' END AS event,
 CASE user_id % 3 WHEN 0 THEN 'search' WHEN 1 THEN 'calculator' ELSE 'http-api' END AS tool_name, ts AS created_at FROM events""",
    "chunks": """
SELECT concat(cast(doc_id AS varchar), '-', cast(i AS varchar)) AS id, doc_id, concat('doc-', cast(doc_id AS varchar), '.txt') AS doc_name,
 cast(i AS int) AS chunk_index, substr(text, i*448+1, 512) AS chunk_text, [lang, source] AS permissions
 FROM (SELECT doc_id, text, lang, source, unnest(range(0, greatest(0, cast(ceil((length(text)-512)/448.0) AS bigint))+1)) AS i FROM documents WHERE length(text) > 0)""",
}

# Views that a view itself reads.
_NEEDS = {
    "priced_logs": ["request_logs"],
    "prompt_versions": ["prompt_saves"],
}


def with_views(names: str, body: str) -> str:
    """The body preceded by the named views as common table expressions."""
    ordered: list[str] = []

    def add(name: str) -> None:
        for needed in _NEEDS.get(name, []):
            add(needed)
        if name not in ordered:
            ordered.append(name)

    for name in names.split():
        add(name)
    ctes = ",\n".join(f"{name} AS ({VIEWS[name].strip()})" for name in ordered)
    body = body.strip()
    if body.upper().startswith("WITH RECURSIVE "):
        return f"WITH RECURSIVE {ctes},\n{body[len('WITH RECURSIVE '):]}"
    if body.upper().startswith("WITH "):
        return f"WITH {ctes},\n{body[len('WITH '):]}"
    return f"WITH {ctes}\n{body}"
