"""Churn queries over all customers."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from brightwater.entries import entry
from brightwater.entries.views_sql import with_views
from brightwater.functions import fixed_values as fixed
from brightwater.operators import churn_features as features
from brightwater.operators import churn_metrics as metrics
from brightwater.operators import churn_scoring as scoring
from brightwater.operators import churn_training as training
from brightwater.plans import tables
from brightwater.plans.scratch import written

KEY = "customer_id"


def records(spark, folder):
    return tables.telco(spark, folder)


def raw_records(spark, folder):
    """The telco table as it looks in a raw file: text totals with blanks, Yes/No labels."""
    return records(spark, folder).select(
        F.concat(F.lit("C-"), F.col(KEY).cast("string")).alias("customerID"),
        F.when(F.col(KEY) % 2 == 0, "Female").otherwise("Male").alias("gender"),
        *[c for c in fixed.CHURN_FIELDS if c != "TotalCharges"],
        F.when(F.col("tenure") == 0, " ")
        .otherwise(F.col("TotalCharges").cast("decimal(18,2)").cast("string"))
        .alias("TotalCharges"),
        F.when(F.col("churn") == 1, "Yes").otherwise(" No").alias("Churn"),
    )


def _quoted(names) -> str:
    return ", ".join(f'"{n}"' for n in names)


_PLAIN_FIELDS = [c for c in fixed.CHURN_FIELDS if c != "TotalCharges"]


@entry(
    "clean_telco",
    with_views(
        "telco",
        f"""SELECT {_quoted(_PLAIN_FIELDS)}, CASE WHEN tenure = 0 THEN "MonthlyCharges" ELSE cast(cast("TotalCharges" AS decimal(18,2)) AS double) END AS "TotalCharges", churn AS "Churn" FROM telco""",
    ),
)
def clean_telco(spark, folder):
    return features.clean_telco(raw_records(spark, folder))


@entry(
    "class_balance",
    with_views(
        "telco",
        """SELECT round(sum(churn) / count(*), 9) AS churn_rate, round((count(*) - sum(churn)) / sum(churn), 9) AS imbalance,
 round(count(*) / (2 * sum(churn)), 9) AS weight_churn, round(count(*) / (2 * (count(*) - sum(churn))), 9) AS weight_stay FROM telco""",
    ),
)
def class_balance(spark, folder):
    balance = features.class_balance(records(spark, folder))
    return balance.select(*[F.round(c, 9).alias(c) for c in balance.columns])


@entry(
    "validate_churn_fields",
    with_views(
        "telco",
        """SELECT customer_id, CASE WHEN len(m) > 0 THEN 'MISSING_FIELDS' END AS error, array_to_string(m, ',') AS missing FROM (SELECT customer_id,
 list_filter([CASE WHEN customer_id % 3 = 0 THEN 'tenure' END, CASE WHEN "InternetService" = 'No' THEN 'OnlineSecurity' END], lambda x: x IS NOT NULL) AS m FROM telco)""",
    ),
)
def validate_churn_fields(spark, folder):
    holes = records(spark, folder).withColumns(
        {
            "tenure": F.when(F.col(KEY) % 3 != 0, F.col("tenure")),
            "OnlineSecurity": F.when(F.col("InternetService") != "No", F.col("OnlineSecurity")),
        }
    )
    checked = features.validate_churn_fields(holes)
    return checked.select(KEY, "error", F.array_join("missing", ",").alias("missing"))


def _feature_sql(scoring_form: bool) -> dict[str, str]:
    """Feature expressions over the telco view, for serving or for training."""
    m, t = '"MonthlyCharges"', '"TotalCharges"'
    total = f"(CASE WHEN {t} = 0 THEN {m} ELSE {t} END)" if scoring_form else t
    risk = "0.0" if scoring_form else "0.5"
    out = {
        "SeniorCitizen": 'cast("SeniorCitizen" AS double)',
        "log_tenure": "ln(1 + tenure)",
        "log_monthly": "0.0::double" if scoring_form else f"ln(1 + {m})",
        "monthly_to_total": f"{m} / ({total} + 1)",
        "charges_per_month": f"{total} / (tenure + 1)",
        "tenure_sq": "pow(tenure / 72.0::double, 2)",
        "value_score": f"1.0 - least(greatest({m} / 118.75, 0.0), 1.0)"
        if scoring_form
        else f"1.0 - {m} / (SELECT max({m}) FROM telco)",
        "loyalty_score": "tenure / 72.0::double",
        "contract_risk": f"""(CASE "Contract" WHEN 'Month-to-month' THEN 1.0 WHEN 'One year' THEN 0.5 WHEN 'Two year' THEN 0.0 ELSE {risk} END)::double""",
        "internet_risk": f"""(CASE "InternetService" WHEN 'Fiber optic' THEN 1.0 WHEN 'DSL' THEN 0.5 WHEN 'No' THEN 0.0 ELSE {risk} END)::double""",
        "payment_risk": """(CASE "PaymentMethod" WHEN 'Electronic check' THEN 1.0 WHEN 'Mailed check' THEN 0.7 ELSE 0.3 END)::double""",
        "is_new": "(tenure <= 3)::int::double",
        "is_loyal": "(tenure >= 48)::int::double",
        "high_charges": f"({m} >= 80)::int::double",
        "no_support": """("TechSupport" = 'No' AND "OnlineSecurity" = 'No')::int::double""",
        "paperless_echeck": """("PaperlessBilling" = 'Yes' AND "PaymentMethod" = 'Electronic check')::int::double""",
    }
    for name, levels in fixed.CHURN_LEVELS.items():
        for level in levels:
            out[f"{name}_{level}"] = f"""("{name}" = '{level}')::int::double"""
    return out


def _features_select(scoring_form: bool) -> str:
    return ", ".join(
        f'round({sql}, 9) AS "{name}"' for name, sql in _feature_sql(scoring_form).items()
    )


def _rounded(df):
    return df.select(
        KEY, *[F.round(F.col(f"`{c}`"), 9).alias(c) for c in df.columns if c != KEY]
    )


@entry(
    "churn_features_train",
    with_views("telco", f"SELECT customer_id, {_features_select(False)} FROM telco"),
)
def churn_features_train(spark, folder):
    return _rounded(features.churn_features_train(records(spark, folder), keep=(KEY,)))


@entry(
    "churn_features_score",
    with_views("telco", f"SELECT customer_id, {_features_select(True)} FROM telco"),
)
def churn_features_score(spark, folder):
    return _rounded(features.churn_features_score(records(spark, folder), keep=(KEY,)))


_SHAP = [
    f"{weight!r}::double * ({_feature_sql(True)[name]} - {mean!r}::double) / {std!r}::double"
    for name, weight, mean, std in zip(
        features.FEATURES, fixed.CHURN_WEIGHTS, fixed.CHURN_MEANS, fixed.CHURN_STDS
    )
]
_SCORED = f"""probable AS (SELECT *, 1.0 / (1.0 + exp(-({fixed.CHURN_INTERCEPT!r}::double + {" + ".join(_SHAP)}))) AS probability FROM telco),
scored AS (SELECT *, CASE WHEN probability >= 0.54 THEN 'Churn' ELSE 'No Churn' END AS label, floor(probability * 10000 + 0.5) / 10000 AS confidence FROM probable)"""


@entry(
    "score_churn",
    with_views("telco", f"WITH {_SCORED} SELECT customer_id, label, confidence FROM scored"),
)
def score_churn(spark, folder):
    return scoring.score_churn(records(spark, folder)).select(KEY, "label", "confidence")


_NAMES = "[" + ", ".join(f"'{n}'" for n in features.FEATURES) + "]"
_EXPLAINED = f"""{_SCORED},
parts AS (SELECT customer_id, unnest([{", ".join(_SHAP)}]) AS shap, unnest({_NAMES}) AS feature, unnest(range(0, {len(_SHAP)})) AS i FROM telco),
strong AS (SELECT customer_id, feature, CASE WHEN shap >= 0 THEN 'positive' ELSE 'negative' END AS impact, floor(abs(shap) * 10000 + 0.5) / 10000 AS magnitude,
 row_number() OVER (PARTITION BY customer_id ORDER BY floor(abs(shap) * 10000 + 0.5) DESC, i) AS place FROM parts WHERE abs(shap) > 1e-4 QUALIFY place <= 3)"""
_TOLD = "array_to_string(list(concat(feature, ' ', impact, ' ', cast(cast(magnitude AS decimal(8,4)) AS varchar)) ORDER BY place), '; ')"


def told(explanation="explanation"):
    return F.array_join(
        F.transform(
            explanation,
            lambda e: F.concat_ws(
                " ", e["feature"], e["impact"], e["magnitude"].cast("decimal(8,4)").cast("string")
            ),
        ),
        "; ",
    )


@entry(
    "explain_churn",
    with_views(
        "telco",
        f"WITH {_EXPLAINED} SELECT customer_id, {_TOLD} AS explanation FROM strong GROUP BY customer_id",
    ),
)
def explain_churn(spark, folder):
    explained = scoring.explain_churn(records(spark, folder))
    return explained.select(KEY, told().alias("explanation"))


@entry(
    "top_contributions",
    """WITH n AS (SELECT row_number() OVER () AS r, * FROM lineitem),
v AS (SELECT r, l_orderkey, l_partkey, l_linenumber, unnest(['quantity', 'price', 'discount', 'tax']) AS feature,
 unnest([l_quantity / 50, l_extendedprice / -100000, l_discount, -l_tax]) AS value, unnest([0, 1, 2, 3]) AS i FROM n),
s AS (SELECT *, floor(abs(value) * 10000 + 0.5) / 10000 AS magnitude, row_number() OVER (PARTITION BY r ORDER BY floor(abs(value) * 10000 + 0.5) DESC, i) AS place FROM v WHERE abs(value) > 1e-4)
SELECT l_orderkey, l_partkey, l_linenumber, array_to_string(list(concat(feature, ' ', CASE WHEN value >= 0 THEN 'positive' ELSE 'negative' END, ' ', cast(cast(magnitude AS decimal(8,4)) AS varchar)) ORDER BY place), '; ') AS top
FROM s WHERE place <= 3 GROUP BY r, l_orderkey, l_partkey, l_linenumber""",
)
def top_contributions(spark, folder):
    parts = {
        "quantity": F.col("l_quantity") / 50,
        "price": F.col("l_extendedprice") / -100000,
        "discount": F.col("l_discount"),
        "tax": -F.col("l_tax"),
    }
    listed = F.array(
        *[F.struct(F.lit(n).alias("feature"), v.alias("value")) for n, v in parts.items()]
    )
    lines = tables.table(spark, folder, "lineitem").withColumn(
        "top", scoring.top_contributions(listed)
    )
    return lines.select("l_orderkey", "l_partkey", "l_linenumber", told("top").alias("top"))


_SURVIVAL_VALUES = ", ".join(
    f"('{c}', '{i}', {m}::double, {a}::double, {b}::double, {n})" for c, i, m, a, b, n in fixed.SURVIVAL_ROWS
)
_LOOKUP = f"""survival(contract, internet, median, p25, p75, n) AS (VALUES {_SURVIVAL_VALUES}),
looked AS (SELECT s.*, coalesce(v.median, 10.0) AS median, coalesce(v.p25, 2.0) AS p25, coalesce(v.p75, 29.0) AS p75 FROM scored s
 LEFT JOIN survival v ON v.contract = s."Contract" AND v.internet = s."InternetService")"""


@entry(
    "survival_lookup",
    with_views("telco", f"WITH {_SCORED}, {_LOOKUP} SELECT customer_id, median, p25, p75 FROM looked"),
)
def survival_lookup(spark, folder):
    return scoring.survival_lookup(records(spark, folder)).select(KEY, "median", "p25", "p75")


@entry(
    "time_to_churn",
    with_views(
        "telco",
        f"""WITH {_SCORED}, {_LOOKUP}, urgent AS (SELECT *, CASE WHEN probability >= 0.7 THEN 0.5 WHEN probability >= 0.5 THEN 0.75 ELSE 1.0 END AS u FROM looked)
SELECT customer_id, cast(floor(greatest(0, median - tenure) * u + 0.5) AS bigint) AS median_months, cast(floor(greatest(0, p25 - tenure) * u + 0.5) AS bigint) AS min_months,
 cast(floor(greatest(0, p75 - tenure) * u + 0.5) AS bigint) AS max_months, CASE WHEN probability >= 0.7 THEN 'high' WHEN probability >= 0.4 THEN 'medium' ELSE 'low' END AS certainty FROM urgent""",
    ),
)
def time_to_churn(spark, folder):
    scored = scoring.score_churn(records(spark, folder))
    return scoring.time_to_churn(scored).select(
        KEY, "median_months", "min_months", "max_months", "certainty"
    )


def _q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


_ADVICE = f"""CASE WHEN label = 'Churn' THEN CASE
 WHEN contains(feature, 'contract_risk') OR contains(feature, 'Contract') THEN CASE WHEN "Contract" = 'Month-to-month' THEN {_q(fixed.ADVICE_CONTRACT)} END
 WHEN contains(feature, 'log_tenure') OR contains(feature, 'loyalty') OR contains(feature, 'is_new') THEN CASE WHEN tenure <= 3 THEN {_q(fixed.ADVICE_NEW)} WHEN tenure <= 12 THEN {_q(fixed.ADVICE_EARLY)} ELSE {_q(fixed.ADVICE_LONG)} END
 WHEN contains(feature, 'monthly') OR contains(feature, 'charges') OR contains(feature, 'value_score') THEN CASE WHEN "MonthlyCharges" >= 80 THEN {_q(fixed.ADVICE_PRICE)} ELSE {_q(fixed.ADVICE_PLAN)} END
 WHEN contains(feature, 'internet_risk') OR contains(feature, 'InternetService') THEN CASE WHEN "InternetService" = 'Fiber optic' THEN {_q(fixed.ADVICE_FIBRE)} END
 WHEN contains(feature, 'payment_risk') OR contains(feature, 'PaymentMethod') OR contains(feature, 'paperless_echeck') THEN {_q(fixed.ADVICE_PAYMENT)}
 WHEN contains(feature, 'no_support') OR contains(feature, 'TechSupport') OR contains(feature, 'OnlineSecurity') THEN {_q(fixed.ADVICE_SUPPORT)} END
ELSE CASE WHEN contains(feature, 'contract_risk') OR contains(feature, 'Contract') THEN CASE WHEN "Contract" = 'Two year' THEN {_q(fixed.KEEP_TWO_YEAR)} WHEN "Contract" = 'One year' THEN {_q(fixed.KEEP_ONE_YEAR)} END
 WHEN contains(feature, 'log_tenure') OR contains(feature, 'loyalty') OR contains(feature, 'is_loyal') THEN CASE WHEN tenure >= 48 THEN {_q(fixed.KEEP_LOYAL)} WHEN tenure >= 12 THEN {_q(fixed.KEEP_ESTABLISHED)} ELSE {_q(fixed.KEEP_NEW)} END
 WHEN contains(feature, 'value_score') OR contains(feature, 'monthly') OR contains(feature, 'charges') THEN {_q(fixed.KEEP_VALUE)} END END"""


@entry(
    "recommend",
    with_views(
        "telco",
        f"""WITH {_EXPLAINED}, advised AS (SELECT s.customer_id, label, place, {_ADVICE} AS advice FROM scored s JOIN strong ON strong.customer_id = s.customer_id)
SELECT customer_id, any_value(label) AS label, coalesce(array_to_string(list(advice ORDER BY place) FILTER (WHERE advice IS NOT NULL), ' '),
 CASE any_value(label) WHEN 'Churn' THEN {_q(fixed.ADVICE_DEFAULT)} ELSE {_q(fixed.KEEP_DEFAULT)} END) AS recommendation FROM advised GROUP BY customer_id""",
    ),
)
def recommend(spark, folder):
    return scoring.predict_churn(records(spark, folder)).select(KEY, "label", "recommendation")


def predictions(spark, folder):
    """A prediction per customer, in the order of the customer ids."""
    return (
        scoring.explain_churn(scoring.score_churn(records(spark, folder)))
        .withColumn("id", F.col(KEY))
        .withColumn("created_at", F.timestamp_seconds(F.col(KEY) + 1_700_000_000))
    )


@entry(
    "label_filter",
    with_views(
        "telco", f"WITH {_SCORED} SELECT customer_id, label, confidence FROM scored WHERE label = 'Churn'"
    ),
)
def label_filter(spark, folder):
    from brightwater.operators.tables import label_filter as keep

    return keep(predictions(spark, folder), "Churn").select(KEY, "label", "confidence")


@entry(
    "prediction_stats",
    with_views(
        "telco",
        f"""WITH {_SCORED} SELECT count(*) AS total, cast((2*sum(cast(round(confidence*10000) AS bigint)) + 10*count(*)) // (20*count(*)) AS bigint) / 1000.0 AS avg_confidence,
 cast(count(*) FILTER (WHERE label = 'Churn') AS bigint) AS churn_count, cast(count(*) FILTER (WHERE label = 'No Churn') AS bigint) AS no_churn_count,
 cast((2000*count(*) FILTER (WHERE label = 'Churn') + count(*)) // (2*count(*)) AS bigint) / 10.0 AS churn_rate_pct FROM scored""",
    ),
)
def prediction_stats(spark, folder):
    return scoring.prediction_stats(predictions(spark, folder))


@entry(
    "label_distribution",
    with_views("telco", f'WITH {_SCORED} SELECT label, count(*) AS "count" FROM scored GROUP BY label'),
)
def label_distribution(spark, folder):
    return scoring.label_distribution(predictions(spark, folder))


@entry(
    "insights",
    with_views(
        "telco",
        f"""WITH {_EXPLAINED}, p AS (SELECT s.customer_id, label, confidence, feature FROM scored s LEFT JOIN strong ON strong.customer_id = s.customer_id AND place = 1),
t AS (SELECT count(*) AS n, sum(cast(round(confidence*10000) AS bigint)) AS u, count(*) FILTER (WHERE label = 'Churn' AND confidence >= 0.75) AS sure FROM p),
l AS (SELECT label, count(*) AS c FROM p GROUP BY label ORDER BY c DESC, min(customer_id) LIMIT 1),
f AS (SELECT feature, count(*) AS c FROM p WHERE feature IS NOT NULL GROUP BY feature ORDER BY c DESC, min(customer_id) LIMIT 1)
SELECT 1 AS position, concat(cast((200*c + n) // (2*n) AS bigint), '% of submitted records were classified as "', label, '" (', c, ' of ', n, ' records).') AS statement FROM l, t
UNION ALL SELECT 2, concat('Average prediction confidence across all records is ', printf('%.1f', cast((2*u + 10*n) // (20*n) AS bigint) / 10.0), '%.') FROM t
UNION ALL SELECT 3, concat('"', feature, '" is the most influential feature in ', cast((200*c + n) // (2*n) AS bigint), '% of predictions.') FROM f, t
UNION ALL SELECT 4, concat(cast((200*sure + n) // (2*n) AS bigint), '% of records show high-confidence churn risk (confidence ≥ 75%).') FROM t WHERE sure > 0""",
    ),
)
def insights(spark, folder):
    return scoring.insights(predictions(spark, folder))


@entry(
    "survival_table",
    with_views(
        "telco",
        """WITH c AS (SELECT * FROM telco WHERE churn = 1), o AS (SELECT quantile_cont(tenure, [0.5, 0.25, 0.75]) AS q, count(*) AS n FROM c),
g AS (SELECT "Contract" AS contract, "InternetService" AS internet, quantile_cont(tenure, [0.5, 0.25, 0.75]) AS q, count(*) AS n FROM c GROUP BY 1, 2),
cells AS (SELECT contract, internet FROM (VALUES ('Month-to-month'), ('One year'), ('Two year')) a(contract), (VALUES ('DSL'), ('Fiber optic'), ('No')) b(internet)),
every AS (SELECT cells.contract, cells.internet, CASE WHEN coalesce(g.n, 0) >= 5 THEN g.q ELSE o.q END AS q, coalesce(g.n, 0) AS n FROM cells LEFT JOIN g ON g.contract = cells.contract AND g.internet = cells.internet, o
 UNION ALL SELECT '_overall', '_overall', q, n FROM o)
SELECT contract, internet, round_even(q[1], 1) AS median, round_even(q[2], 1) AS p25, round_even(q[3], 1) AS p75, n FROM every""",
    ),
)
def survival_table(spark, folder):
    return metrics.survival_table(records(spark, folder).filter("churn = 1"))


def scores(spark, folder):
    """Label and score per customer, with the stable split."""
    scored = scoring.score_churn(records(spark, folder)).select(
        KEY, F.col("churn").alias("y"), F.col("confidence").alias("p")
    )
    return metrics.stratified_split(written(scored, "scores"), KEY, "y")


_SPLIT = f"""{_SCORED}, hashed AS (SELECT customer_id, churn AS y, confidence AS p, row_number() OVER (PARTITION BY churn ORDER BY md5(concat(cast(customer_id AS varchar), ':42')), customer_id) AS r, count(*) OVER (PARTITION BY churn) AS n FROM scored),
sized AS (SELECT *, floor(n * 0.3 + 0.5) AS nt FROM hashed),
split AS (SELECT customer_id, y, p, CASE WHEN r <= nt THEN 'test' ELSE 'train' END AS split, r > nt AND r <= nt + floor((n - nt) * 0.15 + 0.5) AS is_validation FROM sized)"""


@entry(
    "stratified_split",
    with_views("telco", f"WITH {_SPLIT} SELECT customer_id, y, split, is_validation FROM split"),
)
def stratified_split(spark, folder):
    return scores(spark, folder).drop("p")


_METRICS = f"""{_SPLIT}, per AS (SELECT split, p, count(*) FILTER (WHERE y = 1) AS pos, count(*) FILTER (WHERE y = 0) AS neg FROM split GROUP BY split, p),
ranked AS (SELECT *, sum(pos) OVER w AS ctp, sum(neg) OVER w AS cfp FROM per WINDOW w AS (PARTITION BY split ORDER BY p DESC)),
sums AS (SELECT split, sum(pos) AS a, sum(neg) AS b, coalesce(sum(pos) FILTER (WHERE p >= 0.54), 0) AS tp, coalesce(sum(neg) FILTER (WHERE p >= 0.54), 0) AS fp,
 sum(pos * cfp - pos * neg / 2.0) AS above, sum(pos * (ctp / (ctp + cfp))) AS ap, sum(pos * (1 - p) * (1 - p) + neg * p * p) AS err FROM ranked GROUP BY split),
rated AS (SELECT split, (tp + b - fp) / (a + b) AS accuracy, 1 - above / (a * b) AS auc, ap / a AS avg_prec, err / (a + b) AS brier,
 CASE WHEN 2 * tp + fp + a - tp = 0 THEN 0.0 ELSE 2.0 * tp / (2 * tp + fp + a - tp) END AS f1, CASE WHEN tp + fp = 0 THEN 0.0 ELSE tp / (tp + fp) END AS "precision", CASE WHEN a = 0 THEN 0.0 ELSE tp / a END AS recall,
 cast(tp AS bigint) AS tp, cast(fp AS bigint) AS fp, cast(a - tp AS bigint) AS fn, cast(b - fp AS bigint) AS tn FROM sums),
metrics AS (SELECT split, {", ".join(f'floor("{m}" * 10000 + 0.5) / 10000 AS "{m}"' for m in ["accuracy", "auc", "avg_prec", "brier", "f1", "precision", "recall"])}, tp, fp, fn, tn FROM rated)"""


@entry("binary_metrics", with_views("telco", f"WITH {_METRICS} SELECT * FROM metrics"))
def binary_metrics(spark, folder):
    return metrics.binary_metrics(scores(spark, folder), fixed.CHURN_THRESHOLD, split="split")


@entry(
    "overfit_gap",
    with_views(
        "telco",
        f"""WITH {_METRICS}, gaps AS (SELECT round(max(auc) FILTER (WHERE split = 'train') - max(auc) FILTER (WHERE split = 'test'), 4) AS auc_gap,
 round(max(f1) FILTER (WHERE split = 'train') - max(f1) FILTER (WHERE split = 'test'), 4) AS f1_gap FROM metrics)
SELECT auc_gap, f1_gap, auc_gap > 0.05 AS auc_overfit, f1_gap > 0.1 AS f1_overfit FROM gaps""",
    ),
)
def overfit_gap(spark, folder):
    return metrics.overfit_gap(
        metrics.binary_metrics(scores(spark, folder), fixed.CHURN_THRESHOLD, split="split")
    )


@entry(
    "optimise_threshold",
    with_views(
        "telco",
        f"""WITH {_SPLIT}, th AS (SELECT 0.1::double + i * ((0.9::double - 0.1::double) / 160) AS threshold FROM range(0, 161) r(i)),
e AS (SELECT threshold, count(*) FILTER (WHERE p >= threshold AND y = 1) AS tp, count(*) FILTER (WHERE p >= threshold) AS chosen, count(*) FILTER (WHERE y = 1) AS pos FROM th, split WHERE is_validation GROUP BY threshold)
SELECT round(threshold, 6) AS threshold, round(CASE WHEN chosen + pos = 0 THEN 0.0 ELSE 2.0 * tp / (chosen + pos) END, 9) AS f1 FROM e
ORDER BY CASE WHEN chosen + pos = 0 THEN 0.0 ELSE 2.0 * tp / (chosen + pos) END DESC, threshold LIMIT 1""",
    ),
)
def optimise_threshold(spark, folder):
    best = metrics.optimise_threshold(scores(spark, folder).filter("is_validation"))
    return best.select(F.round("threshold", 6).alias("threshold"), F.round("f1", 9).alias("f1"))


_FOLDS = """placed AS (SELECT customer_id, churn, row_number() OVER (ORDER BY tenure, customer_id) - 1 AS position, count(*) OVER () // 7 AS f FROM telco),
folds AS (SELECT customer_id, churn, position, CASE WHEN position // f BETWEEN 2 AND 7 THEN cast(position // f - 1 AS int) END AS test_fold,
 CASE WHEN greatest(position // f, 1) <= 6 THEN cast(greatest(position // f, 1) AS int) END AS train_from FROM placed)"""


@entry(
    "walk_forward_folds",
    with_views(
        "telco", f"WITH {_FOLDS} SELECT customer_id, position, test_fold, train_from FROM folds"
    ),
)
def walk_forward_folds(spark, folder):
    return metrics.walk_forward_folds(records(spark, folder), "tenure", KEY).select(
        KEY, "position", "test_fold", "train_from"
    )


@entry(
    "walk_forward_summary",
    with_views(
        "telco",
        f"""WITH {_SCORED}, {_FOLDS}, per AS (SELECT test_fold, confidence AS p, count(*) FILTER (WHERE s.churn = 1) AS pos, count(*) FILTER (WHERE s.churn = 0) AS neg FROM folds JOIN scored s ON s.customer_id = folds.customer_id WHERE test_fold IS NOT NULL GROUP BY 1, 2),
ranked AS (SELECT *, sum(neg) OVER (PARTITION BY test_fold ORDER BY p DESC) AS cfp FROM per),
aucs AS (SELECT test_fold, coalesce(floor((1 - sum(pos * cfp - pos * neg / 2.0) / nullif(sum(pos) * sum(neg), 0)) * 10000 + 0.5) / 10000, 0.5) AS auc FROM ranked GROUP BY test_fold)
SELECT floor(avg(auc) * 10000 + 0.5) / 10000 AS mean_auc, floor(stddev_pop(auc) * 10000 + 0.5) / 10000 AS std_auc FROM aucs""",
    ),
)
def walk_forward_summary(spark, folder):
    """The served model's AUC on the test rows of every fold."""
    scored = scoring.score_churn(records(spark, folder))
    folds = metrics.walk_forward_folds(scored, "tenure", KEY).filter("test_fold IS NOT NULL")
    per_fold = metrics.binary_metrics(
        folds, fixed.CHURN_THRESHOLD, "churn", "confidence", split="test_fold"
    )
    return metrics.walk_forward_summary(
        per_fold.withColumn("auc", F.coalesce("auc", F.lit(0.5)))
    )


# Training on all customers: models that are fitted side by side.
PARALLEL = 8


def training_rows(spark, folder):
    """The features as a written table, because fitting reads them many times."""
    rows = features.churn_features_train(records(spark, folder), keep=(KEY, "churn"))
    return written(rows, "churn-features")


_NUMERIC_SQL = {
    n: s for n, s in _feature_sql(False).items() if n in fixed.CHURN_NUMERIC
}


@entry(
    "standardize",
    with_views(
        "telco",
        f"""WITH raw AS (SELECT customer_id, {", ".join(f'{s} AS "{n}"' for n, s in _NUMERIC_SQL.items())} FROM telco),
stats AS (SELECT {", ".join(f'avg("{n}") AS "m_{n}", CASE WHEN stddev_pop("{n}") = 0 THEN 1.0 ELSE stddev_pop("{n}") END AS "s_{n}"' for n in _NUMERIC_SQL)} FROM raw)
SELECT customer_id, {", ".join(f'round(("{n}" - "m_{n}") / "s_{n}", 6) AS "{n}"' for n in _NUMERIC_SQL)} FROM raw, stats""",
    ),
)
def standardize(spark, folder):
    numeric = training_rows(spark, folder).select(KEY, *fixed.CHURN_NUMERIC)
    scaled = training.standardize(numeric, features=fixed.CHURN_NUMERIC)
    return scaled.select(KEY, *[F.round(c, 6).alias(c) for c in fixed.CHURN_NUMERIC])


def assembled(spark, folder):
    return training.assemble(
        training.standardize(training_rows(spark, folder)), [KEY], "churn"
    )


def _no_gradient(names) -> str:
    values = ", ".join("('" + n.replace("'", "''") + "')" for n in names)
    return f"SELECT feature, 0.0::double AS gradient FROM (VALUES {values}) f(feature)"


@entry("fit_logreg", _no_gradient(["_intercept", *training.FEATURES]))
def fit_logreg(spark, folder):
    """The slope of the penalized loss at the fitted weights, which is zero where it is smallest."""
    rows = assembled(spark, folder)
    model = training.fit_logreg(rows)
    scored = training.positive_probability(rows, model, "p")
    error = F.col("weight") * (F.col("p") - F.col("label"))
    total = rows.agg(F.sum("weight")).first()[0]
    sums = (
        scored.select(error.alias("error"), F.posexplode(vector_to_array("features")).alias("at", "x"))
        .groupBy("at")
        .agg((F.sum(F.col("error") * F.col("x")) / total).alias("slope"))
    )
    penalty = model.getRegParam()
    weights = [(i, name, float(w) * penalty) for i, (name, w) in enumerate(zip(training.FEATURES, model.coefficients))]
    named = spark.createDataFrame(weights, "at int, feature string, pull double")
    slopes = sums.join(F.broadcast(named), "at").select("feature", (F.col("slope") + F.col("pull")).alias("slope"))
    level = scored.agg((F.sum(error) / total).alias("slope")).select(F.lit("_intercept").alias("feature"), "slope")
    return slopes.unionByName(level).select("feature", F.abs(F.round("slope", 3)).alias("gradient"))


@entry(
    "fit_stack",
    with_views("telco", "SELECT customer_id, cast(churn AS double) AS label, true AS in_range, true AS better FROM telco"),
)
def fit_stack(spark, folder):
    """The whole stack at its own settings: a probability for every customer, and a better AUC than the served model's."""
    rows = assembled(spark, folder)
    scored = written(training.fit_stack(rows, KEY, parallelism=PARALLEL).score(rows).select(KEY, "label", "p"), "stacked")
    auc = metrics.binary_metrics(scored, 0.5, "label", "p").first().auc
    served = scoring.score_churn(records(spark, folder))
    known = metrics.binary_metrics(served, fixed.CHURN_THRESHOLD, "churn", "confidence").first().auc
    return scored.select(
        KEY, "label", F.col("p").between(0, 1).alias("in_range"), F.lit(auc > known).alias("better")
    )


@entry("tune_cv")
def tune_cv(spark, folder):
    from pyspark.ml.classification import RandomForestClassifier

    _, trials = training.tune_cv(
        assembled(spark, folder),
        KEY,
        RandomForestClassifier(seed=training.SEED),
        {"numTrees": [5, 10], "maxDepth": [3, 5], "minInstancesPerNode": [1, 5]},
        trials=4,
        folds=3,
    )
    return trials


# The forest's search space: trees, depth, rows in a leaf, features tried at a split.
FOREST_SPACE = {
    "numTrees": (50, 300), "maxDepth": (5, 20), "minInstancesPerNode": (1, 10), "featureSubsetStrategy": ["sqrt", "log2"],
}
_TRIALS = ", ".join(
    f"({n}, '{training.trial_text(t)}')" for n, t in enumerate(training.drawn_trials(FOREST_SPACE, 30))
)


@entry(
    "tune_forest",
    f"SELECT cast(trial AS int) AS trial, parameters, true AS tested, true AS in_range FROM (VALUES {_TRIALS}) t(trial, parameters)",
)
def tune_forest(spark, folder):
    """All 30 trials of the forest over five folds, losing ones dropped early."""
    from pyspark.ml.classification import RandomForestClassifier

    forest = RandomForestClassifier(seed=training.SEED)
    _, trials = training.halving_search(assembled(spark, folder), KEY, forest, FOREST_SPACE, parallelism=PARALLEL)
    return trials.select(
        "trial", "parameters", F.col("folds").between(1, 5).alias("tested"), F.col("auc").between(0, 1).alias("in_range")
    )


@entry(
    "walk_forward",
    with_views(
        "telco",
        f"""WITH {_FOLDS}, numbers AS (SELECT unnest([1, 2, 3, 4, 5, 6]) AS fold)
SELECT cast(fold AS int) AS fold, count(*) FILTER (WHERE train_from <= fold) AS train_size, count(*) FILTER (WHERE test_fold = fold) AS test_size,
 round(count(*) FILTER (WHERE test_fold = fold AND churn = 1) / count(*) FILTER (WHERE test_fold = fold), 6) AS test_churn_rate, true AS in_range
FROM folds, numbers GROUP BY fold HAVING count(*) FILTER (WHERE test_fold = fold) > 0""",
    ),
)
def walk_forward(spark, folder):
    """Six stacks at their own settings, each trained on the past of its fold: sizes, churn, and an AUC in its range."""
    found = training.walk_forward(training_rows(spark, folder), KEY, "churn", parallelism=PARALLEL)
    return found.select(
        "fold",
        "train_size",
        "test_size",
        F.round("test_churn_rate", 6).alias("test_churn_rate"),
        F.col("auc").between(0, 1).alias("in_range"),
    )


@entry("calibrate_platt", _no_gradient(["_intercept", "p"]))
def calibrate_platt(spark, folder):
    """The slope of the loss on the held-out scores at the fitted curve, which is zero where it is smallest."""
    held_out = scores(spark, folder).filter("is_validation")
    fitted = training.calibrate_platt(held_out, held_out)
    error = F.col("calibrated") - F.col("y")
    slopes = fitted.agg(F.avg(error).alias("level"), F.avg(error * F.col("p")).alias("slope"))
    named = F.explode(
        F.array(
            F.struct(F.lit("_intercept").alias("feature"), F.col("level").alias("g")),
            F.struct(F.lit("p").alias("feature"), F.col("slope").alias("g")),
        )
    )
    return slopes.select(named.alias("r")).select("r.feature", F.abs(F.round("r.g", 3)).alias("gradient"))
