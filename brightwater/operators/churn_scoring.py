"""Scoring churn records: probability, explanation, time to churn, advice, and what was predicted."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brightwater.functions import fixed_values as fixed
from brightwater.functions.numbers import percent, round_up_half
from brightwater.functions.text import let
from brightwater.operators.churn_features import FEATURES, scoring_features
from brightwater.plans.scratch import written
from brightwater.plans.skew import small


_MODEL = {
    name: (weight, mean, std if std > 0 else 1.0)
    for name, weight, mean, std in zip(
        FEATURES, fixed.CHURN_WEIGHTS, fixed.CHURN_MEANS, fixed.CHURN_STDS
    )
}


def _contributions(records: DataFrame, log_monthly_bug: bool) -> list[Column]:
    """Weight times standardized value, per feature in model order."""
    features = scoring_features(records, log_monthly_bug)
    return [
        F.lit(weight) * (features[name] - F.lit(mean)) / F.lit(std)
        for name, (weight, mean, std) in _MODEL.items()
    ]


def _field_score(field: str) -> Column:
    """The summed contribution of a field's one-hot features, looked up by its level."""

    def part(level: str, value: float) -> float:
        weight, mean, std = _MODEL[f"{field}_{level}"]
        return weight * (value - mean) / std

    levels = fixed.CHURN_LEVELS[field]
    absent = sum(part(level, 0.0) for level in levels)
    score = F.lit(absent)
    for level in levels:
        present = absent - part(level, 0.0) + part(level, 1.0)
        score = F.when(F.col(field) == level, F.lit(present)).otherwise(score)
    return score


def churn_probability(records: DataFrame, log_monthly_bug: bool = True) -> Column:
    features = scoring_features(records, log_monthly_bug)
    z = F.lit(fixed.CHURN_INTERCEPT)
    for name in fixed.CHURN_NUMERIC:
        weight, mean, std = _MODEL[name]
        z = z + F.lit(weight) * (features[name] - F.lit(mean)) / F.lit(std)
    for field in fixed.CHURN_LEVELS:
        z = z + _field_score(field)
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-z))


def score_churn(records: DataFrame, log_monthly_bug: bool = True) -> DataFrame:
    """Add ``probability``, ``label`` and ``confidence`` (the probability to 4 decimals)."""
    p = F.col("probability")
    return records.withColumn("probability", churn_probability(records, log_monthly_bug)).withColumns(
        {
            "label": F.when(p >= fixed.CHURN_THRESHOLD, "Churn").otherwise("No Churn"),
            "confidence": round_up_half(p, 4),
        }
    )


def top_contributions(contributions: Column, n: int = 3) -> Column:
    """The ``n`` strongest of an array of (feature, value) as (feature, impact, magnitude).

    Magnitudes are compared after rounding to 4 decimals, equal ones in feature order; values up
    to 0.0001 are left out.
    """
    weighed = F.transform(
        contributions,
        lambda c, i: F.struct(
            (-round_up_half(F.abs(c["value"]), 4)).alias("rank"),
            i.alias("place"),
            c["feature"].alias("feature"),
            c["value"].alias("value"),
        ),
    )
    kept = F.filter(weighed, lambda c: F.abs(c["value"]) > 1e-4)
    return F.transform(
        F.slice(F.array_sort(kept), 1, n),
        lambda c: F.struct(
            c["feature"].alias("feature"),
            F.when(c["value"] >= 0, "positive").otherwise("negative").alias("impact"),
            (-c["rank"]).alias("magnitude"),
        ),
    )


def explain_churn(records: DataFrame, log_monthly_bug: bool = True) -> DataFrame:
    """Add ``explanation``: the three strongest contributions to the score."""
    parts = F.array(
        *[
            F.struct(F.lit(name).alias("feature"), part.alias("value"))
            for name, part in zip(FEATURES, _contributions(records, log_monthly_bug))
        ]
    )
    return records.withColumn("explanation", top_contributions(parts))


def survival_dimension(spark) -> DataFrame:
    return spark.createDataFrame(
        fixed.SURVIVAL_ROWS,
        "contract string, internet string, median double, p25 double, p75 double, n long",
    )


def survival_lookup(records: DataFrame, survival: DataFrame | None = None) -> DataFrame:
    """Add the survival quartiles of the record's contract and internet kind.

    Missing kinds count as Month-to-month and Fiber optic; kinds without a row take the overall row.
    ``survival`` has at most one row per pair of kinds plus the overall row.
    """
    table = survival_dimension(records.sparkSession) if survival is None else survival
    quartiles = ["median", "p25", "p75"]
    overall = (
        table.filter("contract = '_overall'")
        .agg(*[F.first(q).alias(q) for q in quartiles])
        .select(F.struct(*quartiles))
        .scalar()
    )
    cells = table.filter("contract <> '_overall'").select(
        F.col("contract").alias("_contract"),
        F.col("internet").alias("_internet"),
        *[F.col(q).alias(f"_{q}") for q in quartiles],
    )
    contract = F.coalesce("Contract", F.lit("Month-to-month"))
    internet = F.coalesce("InternetService", F.lit("Fiber optic"))
    matched = (contract == F.col("_contract")) & (internet == F.col("_internet"))
    return records.join(small(cells), matched, "left").select(
        *records.columns, *[F.coalesce(f"_{q}", overall[q]).alias(q) for q in quartiles]
    )


def time_to_churn(scored: DataFrame, survival: DataFrame | None = None) -> DataFrame:
    """Add the months left (``median_months``, ``min_months``, ``max_months``) and their certainty.

    A likelier churner is expected sooner. ``scored`` has the record fields and ``probability``.
    """
    p = F.col("probability")
    tenure = F.coalesce(F.col("tenure").try_cast("double"), F.lit(0.0))
    urgency = F.when(p >= 0.7, 0.5).when(p >= 0.5, 0.75).otherwise(1.0)

    def left(quartile: str) -> Column:
        months = F.greatest(F.lit(0.0), F.col(quartile) - tenure) * urgency
        return F.floor(months + 0.5).cast("long")

    looked_up = survival_lookup(scored, survival)
    return looked_up.select(
        *scored.columns,
        left("median").alias("median_months"),
        left("p25").alias("min_months"),
        left("p75").alias("max_months"),
        F.when(p >= 0.7, "high").when(p >= 0.4, "medium").otherwise("low").alias("certainty"),
    )


def _names(feature: Column, *parts: str) -> Column:
    found = F.lit(False)
    for part in parts:
        found = found | F.contains(feature, F.lit(part))
    return found


def _leaving_advice(feature: Column, tenure, monthly, contract, internet) -> Column:
    return (
        F.when(
            _names(feature, "contract_risk", "Contract"),
            F.when(contract == "Month-to-month", fixed.ADVICE_CONTRACT),
        )
        .when(
            _names(feature, "log_tenure", "loyalty", "is_new"),
            F.when(tenure <= 3, fixed.ADVICE_NEW)
            .when(tenure <= 12, fixed.ADVICE_EARLY)
            .otherwise(fixed.ADVICE_LONG),
        )
        .when(
            _names(feature, "monthly", "charges", "value_score"),
            F.when(monthly >= 80, fixed.ADVICE_PRICE).otherwise(fixed.ADVICE_PLAN),
        )
        .when(
            _names(feature, "internet_risk", "InternetService"),
            F.when(internet == "Fiber optic", fixed.ADVICE_FIBRE),
        )
        .when(
            _names(feature, "payment_risk", "PaymentMethod", "paperless_echeck"),
            fixed.ADVICE_PAYMENT,
        )
        .when(_names(feature, "no_support", "TechSupport", "OnlineSecurity"), fixed.ADVICE_SUPPORT)
    )


def _staying_advice(feature: Column, tenure, contract) -> Column:
    return (
        F.when(
            _names(feature, "contract_risk", "Contract"),
            F.when(contract == "Two year", fixed.KEEP_TWO_YEAR).when(
                contract == "One year", fixed.KEEP_ONE_YEAR
            ),
        )
        .when(
            _names(feature, "log_tenure", "loyalty", "is_loyal"),
            F.when(tenure >= 48, fixed.KEEP_LOYAL)
            .when(tenure >= 12, fixed.KEEP_ESTABLISHED)
            .otherwise(fixed.KEEP_NEW),
        )
        .when(_names(feature, "value_score", "monthly", "charges"), fixed.KEEP_VALUE)
    )


def recommend(explained: DataFrame) -> DataFrame:
    """Add ``recommendation``: one advice per explaining feature, for leaving or staying.

    Any label but "Churn" takes the advice for staying.
    """
    tenure = F.coalesce(F.col("tenure").try_cast("double"), F.lit(0.0))
    monthly = F.coalesce(F.col("MonthlyCharges").try_cast("double"), F.lit(0.0))
    contract = F.coalesce("Contract", F.lit(""))
    internet = F.coalesce("InternetService", F.lit(""))
    leaving = F.coalesce(F.col("label") == "Churn", F.lit(False))
    names = F.transform(
        F.slice(F.filter("explanation", lambda e: F.coalesce(e["feature"], F.lit("")) != ""), 1, 3),
        lambda e: e["feature"],
    )
    advice = F.transform(
        names,
        lambda f: F.when(leaving, _leaving_advice(f, tenure, monthly, contract, internet)).otherwise(
            _staying_advice(f, tenure, contract)
        ),
    )
    text = let(
        F.array_join(F.array_compact(advice), " "),
        lambda t: F.when(t != "", t).otherwise(
            F.when(leaving, fixed.ADVICE_DEFAULT).otherwise(fixed.KEEP_DEFAULT)
        ),
    )
    return explained.withColumn("recommendation", text)


def predict_churn(records: DataFrame, log_monthly_bug: bool = True) -> DataFrame:
    """Score, explain and advise in one pass over complete records."""
    return recommend(explain_churn(score_churn(records, log_monthly_bug), log_monthly_bug))


def _is(label: str, strict: bool) -> Column:
    if strict:
        return F.col("label") == label
    return F.lower("label") == label.lower()


def _units(digits: int) -> Column:
    return F.round(F.col("confidence") * 10**digits).cast("long")


def prediction_stats(
    predictions: DataFrame,
    churn: str = "Churn",
    no_churn: str = "No Churn",
    strict: bool = False,
) -> DataFrame:
    """Number of predictions, average confidence to 3 decimals, churn counts and share.

    Labels are compared without regard to case unless ``strict``. Confidences have 4 decimals, so
    their average is taken over exact units.
    """
    rows = F.count(F.lit(1))
    total, counted = F.sum(_units(4)), F.count("confidence")
    average = F.call_function(
        "div", total * 2 + counted * 10, F.nullif(counted * 20, F.lit(0))
    ) / F.lit(1000.0)
    leaving = F.count_if(_is(churn, strict))
    return predictions.agg(
        rows.alias("total"),
        average.alias("avg_confidence"),
        leaving.alias("churn_count"),
        F.count_if(_is(no_churn, strict)).alias("no_churn_count"),
        percent(leaving, rows, 1).alias("churn_rate_pct"),
    )


def label_distribution(predictions: DataFrame) -> DataFrame:
    return predictions.groupBy("label").agg(F.count(F.lit(1)).alias("count"))


def insights(
    predictions: DataFrame, churn: str = "Churn", strict: bool = False, at_least: int = 10
) -> DataFrame:
    """Plain-language statements about stored predictions; none from fewer than ``at_least``.

    The predictions (label, confidence, explanation, created_at) are read once into a small table of
    counts per label and top feature; everything else is computed from that. Of equally frequent
    labels or features the one seen first is named.
    """
    seen = F.unix_micros("created_at")
    per_label = predictions.groupBy(
        "label", F.try_element_at("explanation", F.lit(1))["feature"].alias("feature")
    ).agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(_units(4)).alias("units"),
        F.count("confidence").alias("valid"),
        F.count_if(_is(churn, strict) & (F.col("confidence") >= 0.75)).alias("sure"),
        F.min(seen).alias("first"),
    )
    counts = written(per_label, "insight-counts")

    def most(column: str) -> Column:
        ranked = (
            counts.filter(F.coalesce(F.col(column), F.lit("")) != "")
            .groupBy(column)
            .agg(F.sum("n").alias("n"), F.min("first").alias("first"))
        )
        best = F.max_by(
            F.struct(F.col(column).alias("name"), "n"), F.struct(F.col("n"), -F.col("first"))
        )
        return ranked.agg(best).scalar()

    totals = counts.agg(
        F.sum("n").alias("total"),
        F.sum("units").alias("units"),
        F.sum("valid").alias("valid"),
        F.sum("sure").alias("sure"),
    ).withColumns({"top_label": most("label"), "top_feature": most("feature")})

    def share(part: Column) -> Column:
        return percent(part, F.col("total"), 0).cast("long").cast("string")

    tenths = F.call_function(
        "div", F.col("units") * 2 + F.col("valid") * 10, F.nullif(F.col("valid") * 20, F.lit(0))
    )
    statements = F.array(
        F.concat(
            share(F.col("top_label.n")),
            F.lit('% of submitted records were classified as "'),
            F.col("top_label.name"),
            F.lit('" ('),
            F.col("top_label.n").cast("string"),
            F.lit(" of "),
            F.col("total").cast("string"),
            F.lit(" records)."),
        ),
        F.concat(
            F.lit("Average prediction confidence across all records is "),
            F.format_string("%.1f", tenths / F.lit(10.0)),
            F.lit("%."),
        ),
        F.concat(
            F.lit('"'),
            F.col("top_feature.name"),
            F.lit('" is the most influential feature in '),
            share(F.col("top_feature.n")),
            F.lit("% of predictions."),
        ),
        F.when(
            F.col("sure") > 0,
            F.concat(
                share(F.col("sure")),
                F.lit("% of records show high-confidence churn risk (confidence ≥ 75%)."),
            ),
        ),
    )
    return (
        totals.filter(F.col("total") >= at_least)
        .select(F.posexplode(statements).alias("position", "statement"))
        .filter(F.col("statement").isNotNull())
        .withColumn("position", F.col("position") + 1)
    )
