"""Models trained on the smallest customer table."""

import pytest
from pyspark.ml.classification import LogisticRegression
from pyspark.sql import functions as F

from brightwater.entries import churn
from brightwater.operators import churn_metrics as metrics
from brightwater.operators import churn_training as training

FOLDER = "/root/testdata/sf0.01"
SMALL = training.TreeSettings(trees=3, rounds=1)


@pytest.fixture(scope="module")
def rows(spark):
    return training.assemble(
        training.standardize(churn.training_rows(spark, FOLDER)), ["customer_id"], "churn"
    )


def test_balanced_weights(rows):
    sums = {r.label: r.w for r in rows.groupBy("label").agg(F.sum("weight").alias("w")).collect()}
    assert sums[0.0] == pytest.approx(sums[1.0]) == pytest.approx(rows.count() / 2)


def test_logreg_is_better_than_chance(rows):
    scored = training.positive_probability(rows, training.fit_logreg(rows, C=1.0), "p")
    assert metrics.binary_metrics(scored, 0.5, "label").first().auc > 0.55


def test_stack_scores_every_row(rows):
    scored = training.fit_stack(rows, "customer_id", SMALL, folds=2).score(rows)
    assert scored.count() == rows.count()
    assert scored.filter("p < 0 OR p > 1 OR p IS NULL").isEmpty()


def test_folds_of_a_walk_are_fitted_side_by_side(spark, monkeypatch):
    calls, at_once = [], training.side_by_side

    def seen(spark, run, jobs, parallelism):
        calls.append(len(jobs))
        return at_once(spark, run, jobs, parallelism)

    monkeypatch.setattr(training, "side_by_side", seen)
    features = churn.training_rows(spark, FOLDER)
    got = training.walk_forward(features, "customer_id", "churn", n_folds=3, settings=SMALL, cv=2, parallelism=8).collect()
    assert len(got) > 1 and max(calls) == len(got) * 3 * 3  # folds, models a base, bases
    assert [r.fold for r in got] == list(range(1, len(got) + 1)) and all(0 <= r.auc <= 1 for r in got)
    folds = metrics.walk_forward_folds(features, "log_tenure", "customer_id", 3)
    for r in got:
        assert r.train_size == folds.where(F.col("train_from") <= r.fold).count()
        assert r.test_size == folds.where(F.col("test_fold") == r.fold).count()


def test_search_keeps_places_in_trees_and_the_same_forest(rows, monkeypatch):
    from pyspark.ml.classification import RandomForestClassifier

    space = {"numTrees": (2, 4), "maxDepth": (3, 6)}
    model, table = training.halving_search(rows, "customer_id", RandomForestClassifier(seed=1), space, trials=3, folds=2, parallelism=3)
    assert model.getOrDefault("cacheNodeIds")
    plain = RandomForestClassifier(seed=1, numTrees=model.getNumTrees, maxDepth=model.getMaxDepth())
    found = training.halving_search(rows, "customer_id", plain, {}, trials=1, folds=2)[0]
    assert model.toDebugString.split("\n", 1)[1] == found.toDebugString.split("\n", 1)[1]
    off = plain.copy({plain.cacheNodeIds: False})
    data = training.written(training.stratified_folds(rows, "customer_id", "label", 2).hint("rebalance"), "halving")
    assert off.fit(data).totalNumNodes == model.totalNumNodes


def test_search_returns_all_trials(rows):
    model, trials = training.tune_cv(
        rows, "customer_id", LogisticRegression(maxIter=5), {"regParam": [0.1, 1.0]}, trials=5, folds=2
    )
    assert trials.count() == 2 and model.coefficients.size == 55


def test_halving_drops_losers_early(rows):
    space = {"regParam": (0.001, 10.0), "maxIter": (1, 5), "standardization": [True, False]}
    drawn = training.drawn_trials(space, 9)
    assert drawn == training.drawn_trials(space, 9) and all(0.001 <= t["regParam"] <= 10 for t in drawn)
    model, table = training.halving_search(rows, "customer_id", LogisticRegression(), space, trials=9, folds=5, parallelism=6)
    got = {r.trial: r for r in table.collect()}
    assert {t: r.parameters for t, r in got.items()} == {t: training.trial_text(p) for t, p in enumerate(drawn)}
    assert sorted(r.folds for r in got.values()) == [1] * 6 + [3] * 2 + [5]
    first = training.stratified_folds(rows, "customer_id", "label", 5)
    from pyspark.ml.evaluation import BinaryClassificationEvaluator

    evaluator, aucs = BinaryClassificationEvaluator(), {}
    for t, p in enumerate(drawn):
        fitted = LogisticRegression(**p).fit(first.where("fold <> 0"))
        aucs[t] = evaluator.evaluate(fitted.transform(first.where("fold = 0")))
    for t, r in got.items():
        if r.folds == 1:
            assert r.auc == pytest.approx(aucs[t], abs=1e-6)
    best = next(t for t, r in got.items() if r.folds == 5)
    assert model.getRegParam() == drawn[best]["regParam"]
    assert {t for t, r in got.items() if r.folds > 1} == set(sorted(aucs, key=lambda t: (-aucs[t], t))[:3])


def test_calibration_is_monotone(spark):
    scored = spark.createDataFrame([(i % 2 if i < 5 else 1, i / 10) for i in range(10)], "y int, p double")
    out = [r.calibrated for r in training.calibrate_platt(scored, scored).orderBy("p").collect()]
    assert out == sorted(out)
