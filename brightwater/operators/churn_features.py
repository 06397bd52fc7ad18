"""Churn records: checks, cleaning and features for training and for scoring."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brightwater.functions import fixed_values as fixed

ONE_HOT = [f"{name}_{level}" for name, levels in fixed.CHURN_LEVELS.items() for level in levels]
FEATURES = fixed.CHURN_NUMERIC + ONE_HOT


def validate_churn_fields(records: DataFrame) -> DataFrame:
    """Add ``missing`` (names of null or absent required fields) and ``error``, null if complete."""
    names = [
        F.when(F.col(name).isNull(), F.lit(name)) if name in records.columns else F.lit(name)
        for name in fixed.CHURN_FIELDS
    ]
    missing = F.array_compact(F.array(*names))
    return records.withColumn("missing", missing).withColumn(
        "error", F.when(F.size("missing") > 0, "MISSING_FIELDS")
    )


def clean_telco(raw: DataFrame) -> DataFrame:
    """Drop id and gender, read TotalCharges as a number (else MonthlyCharges), Churn as 0 or 1."""
    total = F.coalesce(F.col("TotalCharges").try_cast("double"), F.col("MonthlyCharges"))
    return raw.drop("customerID", "gender").withColumns(
        {
            "TotalCharges": total,
            "Churn": (F.lower(F.trim("Churn")) == "yes").cast("int"),
        }
    )


def class_balance(df: DataFrame, label: str = "churn") -> DataFrame:
    """Churn rate, how many stay per churner, and the balanced class weights."""
    positive, rows = F.sum(label), F.count(F.lit(1))
    return df.agg(
        (positive / rows).alias("churn_rate"),
        ((rows - positive) / F.nullif(positive, F.lit(0))).alias("imbalance"),
        (rows / (F.nullif(positive, F.lit(0)) * 2)).alias("weight_churn"),
        (rows / (F.nullif(rows - positive, F.lit(0)) * 2)).alias("weight_stay"),
    )


def _one_hot(text) -> dict[str, Column]:
    return {
        f"{name}_{level}": F.when(text(name) == level, 1.0).otherwise(0.0)
        for name, levels in fixed.CHURN_LEVELS.items()
        for level in levels
    }


def _flag(condition: Column) -> Column:
    return F.when(condition, 1.0).otherwise(0.0)


def _shared(tenure: Column, monthly: Column, total: Column, text) -> dict[str, Column]:
    """Features that training and scoring compute alike."""
    return {
        "log_tenure": F.log1p(tenure),
        "monthly_to_total": monthly / (total + 1),
        "charges_per_month": total / (tenure + 1),
        "tenure_sq": F.pow(tenure / 72, F.lit(2.0)),
        "loyalty_score": tenure / 72.0,
        "is_new": _flag(tenure <= 3),
        "is_loyal": _flag(tenure >= 48),
        "high_charges": _flag(monthly >= 80),
        "no_support": _flag((text("TechSupport") == "No") & (text("OnlineSecurity") == "No")),
        "paperless_echeck": _flag(
            (text("PaperlessBilling") == "Yes") & (text("PaymentMethod") == "Electronic check")
        ),
        **_one_hot(text),
    }


def _risk(value: Column, levels: dict[str, float], otherwise: float) -> Column:
    risk = F.lit(otherwise)
    for level, score in levels.items():
        risk = F.when(value == level, F.lit(score)).otherwise(risk)
    return risk


RISKS = {
    "contract_risk": "Contract",
    "internet_risk": "InternetService",
    "payment_risk": "PaymentMethod",
}


def churn_features_train(df: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """The training features, plus the ``keep`` columns.

    The price score divides by the highest MonthlyCharges of the data. Unknown levels have risk
    0.5, and missing values become 0.
    """
    tenure, monthly = F.col("tenure").cast("double"), F.col("MonthlyCharges").cast("double")
    total = F.col("TotalCharges").cast("double")
    highest = df.agg(F.max("MonthlyCharges")).scalar()
    features = _shared(tenure, monthly, total, F.col) | {
        "SeniorCitizen": F.col("SeniorCitizen").cast("double"),
        "log_monthly": F.log1p(monthly),
        "value_score": 1.0 - monthly / highest,
        **{
            name: _risk(F.col(column), fixed.TRAINING_RISK[column], fixed.TRAINING_RISK_OTHER)
            for name, column in RISKS.items()
        },
    }
    return df.select(*keep, *[F.coalesce(features[f], F.lit(0.0)).alias(f) for f in FEATURES])


def scoring_features(records: DataFrame, log_monthly_bug: bool = True) -> dict[str, Column]:
    """The serving features as columns over raw records.

    They differ from training: the price score uses a fixed highest charge and is clamped, unknown
    contract and internet levels have risk 0 and unknown payment 0.3, a total of 0 means one month,
    and ``log_monthly`` is never filled in, which ``log_monthly_bug=False`` repairs.
    """

    kinds = dict(records.dtypes)

    def number(name: str) -> Column:
        value = F.col(name)
        if kinds[name] in ("string", "double", "float"):
            value = F.nanvl(value.try_cast("double"), F.lit(0.0))
        return F.coalesce(value.cast("double"), F.lit(0.0))

    def text(name: str) -> Column:
        return F.coalesce(F.col(name).cast("string"), F.lit(""))

    tenure, monthly = number("tenure"), number("MonthlyCharges")
    given = number("TotalCharges")
    total = F.when(given == 0, monthly).otherwise(given)
    share = F.least(F.greatest(monthly / fixed.CHURN_MAX_MONTHLY, F.lit(0.0)), F.lit(1.0))
    return _shared(tenure, monthly, total, text) | {
        "SeniorCitizen": number("SeniorCitizen"),
        "log_monthly": F.lit(0.0) if log_monthly_bug else F.log1p(monthly),
        "value_score": 1.0 - share,
        **{
            name: _risk(text(column), fixed.SERVING_RISK[column], fixed.SERVING_RISK_OTHER[column])
            for name, column in RISKS.items()
        },
    }


def churn_features_score(
    df: DataFrame, keep: tuple[str, ...] = (), log_monthly_bug: bool = True
) -> DataFrame:
    features = scoring_features(df, log_monthly_bug)
    return df.select(*keep, *[features[f].alias(f) for f in FEATURES])
