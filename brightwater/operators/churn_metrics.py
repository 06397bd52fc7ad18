"""Churn model evaluation: metrics, thresholds, splits, folds and the survival table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brightwater.functions import fixed_values as fixed
from brightwater.functions.numbers import round_up_half
from brightwater.plans.scratch import written
from brightwater.plans.skew import numbered, running_sums

# A slice of scores or hashes is the most that one task sorts; there are about a million of them.
SCORE_SLICES = 1 << 20
HASH_DIGITS = 5


def survival_table(churners: DataFrame) -> DataFrame:
    """Quartiles of tenure of the churners per contract and internet kind, plus overall.

    A cell with fewer than 5 churners takes the overall quartiles. Rows are counted per tenure
    month before the quartiles are taken.
    """
    spark = churners.sparkSession
    counts = churners.groupBy(
        F.col("Contract").alias("contract"), F.col("InternetService").alias("internet"), "tenure"
    ).agg(F.count(F.lit(1)).alias("n"))
    points = F.array(F.lit(0.5), F.lit(0.25), F.lit(0.75))
    quartiles = F.percentile("tenure", points, F.col("n"))
    overall = counts.agg(quartiles.alias("q"), F.coalesce(F.sum("n"), F.lit(0)).alias("n"))
    found = counts.groupBy("contract", "internet").agg(quartiles.alias("q"), F.sum("n").alias("n"))
    cells = spark.createDataFrame(
        [
            (contract, internet)
            for contract in fixed.CHURN_LEVELS["Contract"]
            for internet in fixed.CHURN_LEVELS["InternetService"]
        ],
        "contract string, internet string",
    )
    n = F.coalesce("n", F.lit(0))
    rows = cells.join(found, ["contract", "internet"], "left").select(
        "contract",
        "internet",
        F.when(n >= 5, F.col("q")).otherwise(overall.select("q").scalar()).alias("q"),
        n.alias("n"),
    )
    whole = overall.select(
        F.lit("_overall").alias("contract"), F.lit("_overall").alias("internet"), "q", "n"
    )
    return rows.unionByName(whole).select(
        "contract",
        "internet",
        *[F.bround(F.col("q")[i], 1).alias(c) for i, c in enumerate(["median", "p25", "p75"])],
        "n",
    )


def binary_metrics(
    scored: DataFrame, threshold: float, label: str = "y", score: str = "p", split: str | None = None
) -> DataFrame:
    """Metrics per split to 4 decimals: accuracy, AUC, average precision, Brier, F1, precision,
    recall and the confusion counts.

    AUC counts tied scores half; average precision is the step sum over distinct scores. Rows are
    counted per distinct score, and the running counts over scores are taken in slices.
    """
    group = F.col(split) if split else F.lit("all")
    y, p = F.col(label), F.col(score).cast("double")
    per_score = scored.groupBy(group.alias("split"), p.alias("p")).agg(
        F.count_if(y == 1).alias("pos"), F.count_if(y == 0).alias("neg")
    )
    # The running counts read the counts twice; the scored rows are read once.
    per_score = written(per_score, "score-counts")
    above = running_sums(
        per_score,
        ["split"],
        [F.col("p").desc()],
        [F.floor(F.col("p") * -SCORE_SLICES)],
        {"tp": F.col("pos"), "fp": F.col("neg")},
    )
    chosen = F.col("p") >= threshold
    pos, neg = F.col("pos"), F.col("neg")

    def total(value: Column, condition: Column | None = None) -> Column:
        kept = value if condition is None else F.when(condition, value).otherwise(F.lit(0))
        return F.sum(kept)

    sums = above.groupBy("split").agg(
        total(pos).alias("positives"),
        total(neg).alias("negatives"),
        total(pos, chosen).alias("tp"),
        total(neg, chosen).alias("fp"),
        F.sum(pos * F.col("fp") - pos * neg / F.lit(2.0)).alias("_above"),
        F.sum(pos * (F.col("tp") / (F.col("tp") + F.col("fp")))).alias("_precision"),
        F.sum(pos * F.pow(1 - F.col("p"), F.lit(2.0)) + neg * F.pow("p", F.lit(2.0))).alias("_error"),
    )
    positives, negatives = F.col("positives"), F.col("negatives")
    tp, fp = F.col("tp"), F.col("fp")
    fn, tn = positives - tp, negatives - fp

    def ratio(part: Column, whole: Column) -> Column:
        return F.when(whole == 0, F.lit(0.0)).otherwise(part / whole)

    values = {
        "accuracy": (tp + tn) / (positives + negatives),
        "auc": 1 - F.col("_above") / F.nullif(positives * negatives, F.lit(0)),
        "avg_prec": F.col("_precision") / F.nullif(positives, F.lit(0)),
        "brier": F.col("_error") / (positives + negatives),
        "f1": ratio(tp * 2.0, tp * 2 + fp + fn),
        "precision": ratio(tp, tp + fp),
        "recall": ratio(tp, positives),
    }
    return sums.select(
        "split",
        *[round_up_half(v, 4).alias(n) for n, v in values.items()],
        "tp",
        "fp",
        fn.alias("fn"),
        tn.alias("tn"),
    )


def overfit_gap(metrics: DataFrame, train: str = "train", test: str = "test") -> DataFrame:
    """Train minus test AUC and F1, and whether they pass 0.05 and 0.10."""

    def gap(metric: str) -> Column:
        def of(name: str) -> Column:
            return F.max(F.when(F.col("split") == name, F.col(metric)))

        return F.round(of(train) - of(test), 4)

    return metrics.agg(gap("auc").alias("auc_gap"), gap("f1").alias("f1_gap")).withColumns(
        {"auc_overfit": F.col("auc_gap") > 0.05, "f1_overfit": F.col("f1_gap") > 0.10}
    )


def walk_forward_summary(folds: DataFrame) -> DataFrame:
    return folds.agg(
        round_up_half(F.avg("auc"), 4).alias("mean_auc"),
        round_up_half(F.stddev_pop("auc"), 4).alias("std_auc"),
    )


def optimise_threshold(
    scored: DataFrame, label: str = "y", score: str = "p", low=0.1, high=0.9, steps=161
) -> DataFrame:
    """The threshold with the highest F1 of ``steps`` evenly spaced ones; the lowest among equals.

    Scores are counted per interval between thresholds, so one pass serves all thresholds.
    """
    gap = (high - low) / (steps - 1)
    thresholds = F.array(*[F.lit(low + i * gap) for i in range(steps)])
    p = F.col(score).cast("double")
    near = F.least(F.greatest(F.floor((p - low) / gap).cast("int") + 1, F.lit(0)), F.lit(steps))
    # The arithmetic guess is at most one off; comparing with the thresholds settles it.
    passed = (
        F.when((near < steps) & (p >= F.try_element_at(thresholds, near + 1)), near + 1)
        .when((near > 0) & (p < F.try_element_at(thresholds, F.greatest(near, F.lit(1)))), near - 1)
        .otherwise(near)
    )
    counts = (
        scored.groupBy(passed.alias("passed"))
        .agg(F.count_if(F.col(label) == 1).alias("pos"), F.count(F.lit(1)).alias("n"))
    )
    # At most steps + 1 rows from here on, so one task may order them.
    spots = scored.sparkSession.range(1, steps + 1).select(F.col("id").cast("int").alias("passed"))
    reached = Window.orderBy(F.col("passed").desc()).rowsBetween(Window.unboundedPreceding, 0)
    tp = F.coalesce(F.sum("pos").over(reached), F.lit(0))
    chosen = F.coalesce(F.sum("n").over(reached), F.lit(0))
    positives = counts.agg(F.sum("pos")).scalar()
    f1 = F.coalesce(tp * 2.0 / F.nullif(chosen + positives, F.lit(0)), F.lit(0.0))
    return (
        spots.join(F.broadcast(counts), "passed", "left")
        .select(F.element_at(thresholds, F.col("passed")).alias("threshold"), f1.alias("f1"))
        .orderBy(F.col("f1").desc(), "threshold")
        .limit(1)
    )


def stratified_split(
    df: DataFrame,
    key: str,
    label: str,
    test: float = 0.3,
    validation: float = 0.15,
    seed: int = 42,
) -> DataFrame:
    """Add ``split`` (train or test) and ``is_validation``, with equal shares of each label.

    Rows are ordered by a hash of key and seed, so the split never changes. Validation rows are
    part of the training rows, as in the matched service.
    """
    hashed = df.withColumn(
        "_hash", F.md5(F.concat_ws(":", F.col(key).cast("string"), F.lit(str(seed))))
    )
    placed = numbered(
        hashed, [label], [F.col("_hash"), F.col(key)], [F.substring("_hash", 1, HASH_DIGITS)], "_place"
    )
    sizes = df.groupBy(F.col(label).alias("_label")).agg(F.count(F.lit(1)).alias("_n"))
    joined = placed.join(sizes, placed[label].eqNullSafe(sizes["_label"]))
    n_test = F.floor(F.col("_n") * test + 0.5)
    n_validation = F.floor((F.col("_n") - n_test) * validation + 0.5)
    place = F.col("_place")
    return joined.select(
        *df.columns,
        F.when(place <= n_test, "test").otherwise("train").alias("split"),
        ((place > n_test) & (place <= n_test + n_validation)).alias("is_validation"),
    )


def walk_forward_folds(
    df: DataFrame, order: str, key: str, n_folds: int = 6, key_slice: int = 100_000_000
) -> DataFrame:
    """Add ``position`` (from 0 by ``order``, then ``key``), ``test_fold`` and ``train_from``.

    With folds of ``n // (n_folds + 1)`` rows, fold i (from 1) trains on the first i + 1 folds and
    tests on the next; a row trains in every fold from ``train_from`` on. Positions are counted per
    value of ``order`` and range of the integer ``key``, never in one global sort.
    """
    ordered = numbered(
        df,
        [],
        [F.col(order), F.col(key)],
        [F.col(order), F.floor(F.col(key) / key_slice)],
        "_number",
    )
    size = F.call_function("div", df.agg(F.count(F.lit(1))).scalar(), F.lit(n_folds + 1))
    block = F.call_function("div", F.col("position"), F.nullif(size, F.lit(0)))
    test = F.when(block.between(2, n_folds + 1), block - 1)
    train = F.greatest(block, F.lit(1))
    return (
        ordered.withColumn("position", F.col("_number") - 1)
        .drop("_number")
        .withColumns(
            {
                "test_fold": test.cast("int"),
                "train_from": F.when(train <= n_folds, train).cast("int"),
            }
        )
    )
