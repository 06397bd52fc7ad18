"""Forests and boosted trees grown on bins, against plain Python and Spark ML."""

import numpy as np
import pytest
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F

from brightwater.operators import churn_training as training
from brightwater.operators import trees


def made(spark, rows=600, seed=3):
    """Rows (id, label, features, weight): a value of many, of few, a rare flag, and a label that depends on them."""
    rng = np.random.default_rng(seed)
    many, few, rare = rng.normal(size=rows), rng.integers(0, 4, rows) / 3.0, (rng.random(rows) < 0.01) * 1.0
    label = (many + few + 3 * rare + rng.normal(scale=0.5, size=rows) > 0.6) * 1.0
    data = [(i, float(y), [float(a), float(b), float(c)]) for i, (y, a, b, c) in enumerate(zip(label, many, few, rare))]
    df = spark.createDataFrame(data, "id long, label double, x array<double>").repartition(3)
    df = df.select("id", "label", array_to_vector("x").alias("features"), F.lit(1.0).alias("weight"))
    return training.written(df, "made")


def arrays(df):
    rows = df.orderBy("id").select("label", vector_to_array("features").alias("x")).collect()
    return np.array([r.label for r in rows]), np.array([r.x for r in rows])


def test_thresholds_and_bins_are_those_of_all_rows(spark):
    df = made(spark)
    labels, x = arrays(df)
    cuts = trees.thresholds(df)
    assert len(cuts[0]) == 31 and cuts[1] == pytest.approx([1 / 6, 3 / 6, 5 / 6]) and cuts[2].tolist() == [0.5]
    shares = (x[:, 0][:, None] <= cuts[0]).mean(axis=0)
    assert np.abs(shares - np.arange(1, 32) / 32).max() < 0.01
    blocks = trees.binned(df.withColumn("part", (F.col("id") % 2).cast("int")), cuts, "part").collect()
    got = sorted(
        (b.fold, y, tuple(row))
        for b in blocks
        for y, row in zip(b.labels, np.frombuffer(b.bins, np.uint8).reshape(b.rows, 3).tolist())
    )
    want = [(x[:, [f]] > cuts[f]).sum(axis=1).tolist() for f in range(3)]
    assert got == sorted((i % 2, int(labels[i]), row) for i, row in enumerate(zip(*want)))


def plain_tree(bins, labels, weight, sizes, depth, least):
    """Rows of nodes by the best Gini split of all features, as nested tuples."""
    n, ones = weight.sum(), (weight * labels).sum()
    best = ones**2 / n * (1 + 1e-12), None, None
    for f in range(bins.shape[1]) if depth else []:
        for c in range(sizes[f] - 1):
            left = bins[:, f] <= c
            score = 0
            for side in (left, ~left):
                m, k = weight[side].sum(), (weight * labels)[side].sum()
                score = -np.inf if m < least else score + k**2 / m
            if score > best[0]:
                best = score, f, c
    if best[1] is None:
        return ones / n
    left = bins[:, best[1]] <= best[2]
    sides = [plain_tree(bins[s], labels[s], weight[s], sizes, depth - 1, least) for s in (left, ~left)]
    return (best[1], best[2], *sides)


@pytest.mark.parametrize("pieces", [(1 << 21, 1 << 20), (7, 5)])
def test_a_tree_has_the_best_splits(monkeypatch, pieces):
    monkeypatch.setattr(trees, "PIECE_PLACES", pieces[0])
    monkeypatch.setattr(trees, "PIECE_CELLS", pieces[1])
    rng = np.random.default_rng(5)
    sizes = np.array([32, 4, 2])
    bins = np.stack([rng.integers(0, s, 200) for s in sizes], axis=1).astype(np.uint8)
    labels = (rng.random(200) < 0.2 + bins[:, 1] / 8 + bins[:, 0] / 64).astype(np.uint8)
    weight = rng.poisson(1.0, 200).astype(np.uint8)
    tree = trees._grown_tree(bins, labels, weight, sizes, rng, 4, 3, 3)

    def nested(at=0):
        feature, cut, child, share = (part[at] for part in tree)
        return float(share) if feature < 0 else (feature, cut, nested(child), nested(child + 1))

    def same(a, b):
        if isinstance(a, tuple):
            return a[:2] == b[:2] and same(a[2], b[2]) and same(a[3], b[3])
        return a == pytest.approx(b)

    drawn = weight > 0
    assert same(nested(), plain_tree(bins[drawn], labels[drawn].astype(float), weight[drawn].astype(float), sizes, 4, 3))


def test_large_forests_of_a_search_are_grown_in_tasks(spark, monkeypatch):
    df = made(spark)

    def no_fit(*_):
        raise AssertionError("fitted level by level")

    space = {"numTrees": (20, 40), "maxDepth": (8, 12), "minInstancesPerNode": (1, 4)}
    with monkeypatch.context() as patched:
        patched.setattr(RandomForestClassifier, "_fit", no_fit)
        model, table = training.halving_search(df, "id", RandomForestClassifier(seed=1), space, trials=6, folds=3)
    rows = table.orderBy("trial").collect()
    assert sorted(r.folds for r in rows) == [1] * 4 + [3] * 2
    data = training.stratified_folds(df, "id", "label", 3)
    chosen = training.drawn_trials(space, 6)
    for r in rows[:2]:
        spark_ml = RandomForestClassifier(seed=1, **chosen[r.trial]).fit(data.where("fold <> 0"))
        known = BinaryClassificationEvaluator().evaluate(spark_ml.transform(data.where("fold = 0")))
        assert r.auc == pytest.approx(known, abs=0.04)
    best = max((r for r in rows if r.folds == 3), key=lambda r: r.auc)
    assert model.trees.count() == chosen[best.trial]["numTrees"]
    scored = training.positive_probability(df, model, "p")
    labels, p = zip(*[(r.label, r.p) for r in scored.orderBy("id").select("label", "p").collect()])
    assert trees.auc(np.array(labels), np.array(p)) > best.auc


def test_area_under_the_curve_counts_ties_half():
    rng = np.random.default_rng(0)
    labels, scores = rng.integers(0, 2, 60), rng.integers(0, 8, 60) / 7.0
    pairs = [(a > b) + (a == b) / 2 for a in scores[labels == 1] for b in scores[labels == 0]]
    assert trees.auc(labels, scores) == pytest.approx(np.mean(pairs))
    assert trees.auc(np.ones(3), np.arange(3)) == 0.5


def boosted_by_hand(bins, labels, sizes, rounds, step):
    """Margins of boosted stumps by plain loops."""
    y = 2.0 * labels - 1
    margin = np.zeros(len(y))
    for round_ in range(rounds):
        slope = 4 * y / (1 + np.exp(2 * y * margin)) if round_ else y
        best = None
        for f in range(bins.shape[1]):
            for c in range(sizes[f] - 1):
                left = bins[:, f] <= c
                if left.all() or not left.any():
                    continue
                score = slope[left].sum() ** 2 / left.sum() + slope[~left].sum() ** 2 / (~left).sum()
                if best is None or score > best[0] * (1 + 1e-9):
                    best = score, left
        left = best[1]
        margin += (step if round_ else 1.0) * np.where(left, slope[left].mean(), slope[~left].mean())
    return margin


def test_boosted_trees_of_several_tables_grow_in_step(spark):
    frames = [made(spark, 500, 1), made(spark, 300, 2)]
    folded = [df.withColumn("fold", (F.col("id") % 3).cast("int")) for df in frames]
    cuts = [trees.thresholds(df) for df in folded]
    tables = [(trees.binned(df, c, "fold"), c) for df, c in zip(folded, cuts)]
    models = [trees.Boosting(t, fold, 0.3, 1.0, 1, 1) for t in (0, 1) for fold in (0, None)]
    grown = trees.grow_boosted(spark, tables, models, 5, 1)
    for model, boosted in zip(models, grown):
        labels, x = arrays(frames[model.table])
        bins = np.stack([(x[:, [f]] > c).sum(axis=1) for f, c in enumerate(cuts[model.table])], axis=1)
        ids = np.arange(len(labels))
        kept = np.ones(len(ids), bool) if model.fold is None else ids % 3 != model.fold
        want = boosted_by_hand(bins[kept], labels[kept], [len(c) + 1 for c in cuts[model.table]], 5, 0.3)
        assert boosted.margin(x[kept]) == pytest.approx(want, abs=1e-4)


def test_a_stack_fits_no_model_round_by_round(spark, monkeypatch):
    from pyspark.ml.classification import GBTClassifier

    def no_fit(*_):
        raise AssertionError("fitted level by level")

    df = made(spark)
    settings = training.TreeSettings(trees=20, rounds=21, forest_depth=4)
    known = [m.fit(df).transform(df) for m in training.base_models(settings).values()]
    known = [BinaryClassificationEvaluator().evaluate(s) for s in known]
    for kind in (GBTClassifier, RandomForestClassifier):
        monkeypatch.setattr(kind, "_fit", no_fit)
    stack = training.fit_stack(df, "id", settings, folds=3)
    labels = arrays(df)[0]
    for name, auc in zip(stack.bases, known):
        p = [r.p for r in training.positive_probability(df, stack.bases[name], "p").orderBy("id").collect()]
        assert trees.auc(labels, np.array(p)) == pytest.approx(auc, abs=0.03)
    scored = stack.score(df)
    assert scored.count() == df.count() and scored.filter("p < 0 OR p > 1 OR p IS NULL").isEmpty()
