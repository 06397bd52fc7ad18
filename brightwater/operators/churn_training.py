"""Training churn models with Spark ML."""

from __future__ import annotations

import math
import random
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce
from itertools import takewhile
from multiprocessing.pool import ThreadPool

from pyspark.ml.classification import (
    GBTClassifier,
    LogisticRegression,
    RandomForestClassifier,
)
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.tuning import CrossValidator
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.util import inheritable_thread_target

from brightwater.operators.churn_features import FEATURES
from brightwater.operators import trees
from brightwater.operators.churn_metrics import HASH_DIGITS, binary_metrics, walk_forward_folds
from brightwater.plans.scratch import written
from brightwater.plans.skew import numbered

SEED = 42


def _quoted(name: str) -> Column:
    return F.col(f"`{name}`")


def scaler(
    df: DataFrame, features: Sequence[str] = tuple(FEATURES)
) -> dict[str, tuple[float, float]]:
    """Mean and population deviation of every feature, from one aggregation to one row.

    A deviation of 0 counts as 1.
    """
    row = df.agg(
        *[F.avg(_quoted(f)).alias(f"mean_{i}") for i, f in enumerate(features)],
        *[F.stddev_pop(_quoted(f)).alias(f"std_{i}") for i, f in enumerate(features)],
    ).first()
    return {f: (row[f"mean_{i}"] or 0.0, row[f"std_{i}"] or 1.0) for i, f in enumerate(features)}


def standardize(
    df: DataFrame, fitted_on: DataFrame | None = None, features: Sequence[str] = tuple(FEATURES)
) -> DataFrame:
    """Replace each feature by its z-score, with the statistics of ``fitted_on`` (default: itself)."""
    statistics = scaler(df if fitted_on is None else fitted_on, features)
    return df.withColumns(
        {f: (_quoted(f) - F.lit(mean)) / F.lit(std) for f, (mean, std) in statistics.items()}
    )


def assemble(
    df: DataFrame, keep: Sequence[str], label: str, features: Sequence[str] = tuple(FEATURES)
) -> DataFrame:
    """Columns ``keep``, ``label`` as a double, ``features`` as a vector, balanced ``weight``.

    The result is a written table, because fitting reads it many times.
    """
    y = F.col(label).cast("double")
    rows, positive = df.agg(F.count(F.lit(1)), F.sum(y)).first()
    stay = rows - (positive or 0.0)
    weight = F.when(y == 1, F.lit(rows / (2 * positive) if positive else 1.0)).otherwise(
        F.lit(rows / (2 * stay) if stay else 1.0)
    )
    assembled = df.select(
        *keep,
        y.alias("label"),
        array_to_vector(F.array(*[_quoted(f) for f in features])).alias("features"),
        weight.alias("weight"),
    )
    return written(assembled, "assembled")


def _logistic(n_rows: int, C: float, **columns) -> LogisticRegression:
    # Balanced weights sum to the number of rows.
    return LogisticRegression(
        weightCol="weight",
        elasticNetParam=0.0,
        standardization=False,
        regParam=1.0 / (C * n_rows),
        maxIter=1000,
        **columns,
    )


def fit_logreg(assembled: DataFrame, C: float = 0.0058):
    """L2 logistic regression with balanced classes on standardized features."""
    return _logistic(assembled.count(), C).fit(assembled)


def coefficient_table(spark, model, features: Sequence[str] = tuple(FEATURES)) -> DataFrame:
    """The fitted weights as rows (feature, weight), the intercept among them."""
    rows = [(f, float(w)) for f, w in zip(features, model.coefficients)]
    return spark.createDataFrame(
        [("_intercept", float(model.intercept)), *rows], "feature string, weight double"
    )


def positive_probability(df: DataFrame, model, name: str) -> DataFrame:
    """Add the model's probability of churn and drop what else it adds."""
    scored = model.transform(df).withColumn(name, vector_to_array("probability")[1])
    return scored.select(*df.columns, name)


@dataclass(frozen=True)
class TreeSettings:
    """Sizes of the three base models."""

    trees: int = 100
    rounds: int = 100
    forest_depth: int = 5
    boost_depth: int = 3
    learning_rate: float = 0.1


def base_models(s: TreeSettings) -> dict[str, object]:
    """Two boosted-tree settings and a random forest."""
    return {
        "boost_a": GBTClassifier(
            maxIter=s.rounds, maxDepth=s.boost_depth, stepSize=s.learning_rate, seed=SEED
        ),
        "boost_b": GBTClassifier(
            maxIter=s.rounds,
            maxDepth=s.boost_depth,
            stepSize=s.learning_rate,
            subsamplingRate=0.8,
            seed=SEED + 1,
        ),
        "forest": RandomForestClassifier(
            numTrees=s.trees, maxDepth=s.forest_depth, seed=SEED
        ),
    }


@dataclass(frozen=True)
class Stack:
    """Fitted base models and the logistic model on their probabilities."""

    bases: dict
    meta: object

    def score(self, assembled: DataFrame, name: str = "p") -> DataFrame:
        df = assembled
        for base, model in self.bases.items():
            df = positive_probability(df, model, base)
        df = df.withColumn("stacked", array_to_vector(F.array(*self.bases)))
        kept = df.drop("features").withColumnRenamed("stacked", "features")
        scored = positive_probability(kept, self.meta, name)
        return scored.drop("features", *self.bases)


def side_by_side(spark, run, jobs: Sequence, parallelism: int) -> list:
    """Results of independent Spark jobs, several at a time; whoever is done takes the next."""
    with ThreadPool(max(1, min(parallelism, len(jobs)))) as pool:
        return pool.map(inheritable_thread_target(spark)(run), jobs, chunksize=1)


def _sets_only(estimator, *names: str) -> bool:
    """True if no other parameter was changed from its default."""
    return {p.name for p in estimator._paramMap} <= {"seed", "cacheNodeIds", *names}


def _growing(estimator, fold: int | None) -> trees.Growing | None:
    """A forest as ``trees`` grows it, or None if it has other settings."""
    if not isinstance(estimator, RandomForestClassifier) or not _sets_only(
        estimator, "numTrees", "maxDepth", "minInstancesPerNode", "featureSubsetStrategy"
    ):
        return None
    strategy, depth = estimator.getFeatureSubsetStrategy(), estimator.getMaxDepth()
    if strategy not in trees.STRATEGIES:
        return None
    least = estimator.getMinInstancesPerNode()
    return trees.Growing(fold, estimator.getNumTrees(), depth, least, strategy, estimator.getSeed())


def _boosting(estimator, table: int, fold: int | None) -> trees.Boosting | None:
    """Boosted trees as ``trees`` grows them, or None if they have other settings."""
    if not isinstance(estimator, GBTClassifier) or not _sets_only(
        estimator, "maxIter", "maxDepth", "stepSize", "subsamplingRate", "minInstancesPerNode"
    ):
        return None
    if not 1 <= estimator.getMaxDepth() <= trees.BOOST_LEVELS:
        return None
    least = estimator.getMinInstancesPerNode()
    return trees.Boosting(
        table, fold, estimator.getStepSize(), estimator.getSubsamplingRate(), estimator.getSeed(), least
    )


def _grown(tables: Sequence[DataFrame], bases: dict, jobs: Sequence, parallelism: int) -> dict:
    """The models of those jobs (table, fold left out, base) that ``trees`` can grow together."""
    spark = tables[0].sparkSession

    def cut(table: DataFrame):
        found = trees.thresholds(table)
        return trees.binned(table, found, "fold"), found

    binned = side_by_side(spark, cut, tables, parallelism)
    models: dict = {}
    boosted: dict = {}
    for at, fold, name in jobs:
        if (job := _boosting(bases[name], at, fold)) is not None:
            kind = (bases[name].getMaxIter(), bases[name].getMaxDepth())
            boosted.setdefault(kind, {})[at, fold, name] = job
    for (rounds, depth), group in boosted.items():
        models |= zip(group, trees.grow_boosted(spark, binned, list(group.values()), rounds, depth))
    for at, (blocks, cuts) in enumerate(binned):
        forests = {job: _growing(bases[job[2]], job[1]) for job in jobs if job[0] == at}
        forests = {job: growing for job, growing in forests.items() if growing is not None}
        held = trees.Held(spark, blocks, cuts)
        if forests and held.fits():
            models |= zip(forests, held.forests(list(forests.values())))
    return models


def fit_stack(
    assembled: DataFrame,
    key: str,
    settings: TreeSettings = TreeSettings(),
    folds: int = 5,
    C: float = 0.0058,
    parallelism: int = 4,
) -> Stack:
    """Stacked ensemble: a balanced logistic model on out-of-fold base probabilities."""
    return fit_stacks([assembled], key, settings, folds, C, parallelism)[0]


def fit_stacks(
    frames: Sequence[DataFrame],
    key: str,
    settings: TreeSettings = TreeSettings(),
    folds: int = 5,
    C: float = 0.0058,
    parallelism: int = 4,
) -> list[Stack]:
    """The stack of each frame, the base models of all of them side by side.

    Boosted trees grow in step and forests tree by tree (``trees``); what has other settings is fitted by Spark ML.
    """
    spark = frames[0].sparkSession
    bases = base_models(settings)

    def folded(assembled: DataFrame) -> DataFrame:
        # every round of every model runs a task per file: small data is one file
        fold = F.pmod(F.xxhash64(key), F.lit(folds)).cast("int")
        return written(assembled.withColumn("fold", fold).hint("rebalance"), "stack")

    tables = side_by_side(spark, folded, frames, parallelism)

    # Every base model, without each fold and on all rows.
    parts = [*range(folds), None]
    jobs = [(at, fold, name) for name in bases for at in range(len(tables)) for fold in parts]
    grown = _grown(tables, bases, jobs, parallelism)

    def fit(job: tuple[int, int | None, str]):
        if job in grown:
            return grown[job]
        at, fold, name = job
        data = tables[at]
        return bases[name].fit(data if fold is None else data.filter(F.col("fold") != fold))

    models = dict(zip(jobs, side_by_side(spark, fit, jobs, parallelism)))

    def stack(at: int) -> Stack:
        out_of_fold = None
        for fold in range(folds):
            held = tables[at].filter(F.col("fold") == fold)
            for name in bases:
                held = positive_probability(held, models[at, fold, name], name)
            part = held.select(key, "label", "weight", *bases)
            out_of_fold = part if out_of_fold is None else out_of_fold.unionByName(part)
        stacked = written(
            out_of_fold.withColumn("features", array_to_vector(F.array(*bases))), "out-of-fold"
        )
        return Stack(
            bases={name: models[at, None, name] for name in bases},
            meta=_logistic(stacked.count(), C).fit(stacked),
        )

    return side_by_side(spark, stack, range(len(tables)), parallelism)


def stratified_folds(df: DataFrame, key: str, label: str, folds: int = 5) -> DataFrame:
    """Add ``fold``: rows of each label dealt out evenly in hash order."""
    hashed = df.withColumn("_hash", F.md5(F.concat_ws(":", F.col(key).cast("string"), F.lit("fold"))))
    placed = numbered(
        hashed, [label], [F.col("_hash"), F.col(key)], [F.substring("_hash", 1, HASH_DIGITS)], "_place"
    )
    return placed.withColumn("fold", (F.col("_place") % folds).cast("int")).drop("_hash", "_place")


def tune_cv(
    assembled: DataFrame,
    key: str,
    estimator,
    choices: dict[str, Sequence],
    trials: int = 30,
    folds: int = 5,
    parallelism: int = 4,
    seed: int = SEED,
) -> tuple[object, DataFrame]:
    """Search parameter combinations for the highest cross-validated AUC.

    ``choices`` maps parameter names to values; ``trials`` distinct combinations are drawn.
    Returns the best model, fitted on all rows, and the rows (trial, parameters, auc).
    """
    space = [{}]
    for name, values in choices.items():
        space = [{**chosen, name: value} for chosen in space for value in values]
    drawn = random.Random(seed).sample(space, min(trials, len(space)))
    grid = [{estimator.getParam(n): v for n, v in chosen.items()} for chosen in drawn]
    data = written(stratified_folds(assembled, key, "label", folds), "tune")
    search = CrossValidator(
        estimator=estimator,
        estimatorParamMaps=grid,
        evaluator=BinaryClassificationEvaluator(metricName="areaUnderROC"),
        numFolds=folds,
        foldCol="fold",
        parallelism=parallelism,
        seed=seed,
    ).fit(data)
    rows = [
        (i, ", ".join(f"{n}={v}" for n, v in sorted(chosen.items())), float(auc))
        for i, (chosen, auc) in enumerate(zip(drawn, search.avgMetrics))
    ]
    table = data.sparkSession.createDataFrame(rows, "trial int, parameters string, auc double")
    return search.bestModel, table


def drawn_trials(space: dict[str, object], trials: int, seed: int = SEED) -> list[dict[str, object]]:
    """Parameters of random trials: a list is chosen from, a pair (low, high) is a range of its kind.

    A range of decimals is drawn evenly on a logarithmic scale.
    """
    rng = random.Random(seed)

    def value(kind):
        if isinstance(kind, list):
            return rng.choice(kind)
        low, high = kind
        if isinstance(low, int):
            return rng.randint(low, high)
        return round(low * (high / low) ** rng.random(), 6)

    return [{name: value(space[name]) for name in sorted(space)} for _ in range(trials)]


def trial_text(parameters: dict[str, object]) -> str:
    return ", ".join(f"{name}={value}" for name, value in sorted(parameters.items()))


#: Nodes of a forest's level up to which it is left to Spark ML.
LEVEL_NODES = 4096


def halving_search(
    assembled: DataFrame,
    key: str,
    estimator,
    space: dict[str, object],
    trials: int = 30,
    folds: int = 5,
    keep: int = 3,
    parallelism: int = 4,
    seed: int = SEED,
) -> tuple[object, DataFrame]:
    """Search random trials for the highest cross-validated AUC, dropping the losing ones early.

    All trials are tested on the first fold, the best of every ``keep`` on the next two, the best of ``keep`` of those on
    the following four, and so on until the folds are used up. Fits of a round run side by side, the largest
    forests first, and keep the rows' places in their trees beside the rows. Forests with more than ``LEVEL_NODES`` nodes in
    a level, for which Spark ML passes over the rows many times, are grown tree by tree (``trees``). Returns the winner fitted on all rows, and rows (trial, parameters, folds, auc): the folds a trial was tested on
    and its mean AUC there. Equal trials are ordered by number.
    """
    data = written(stratified_folds(assembled, key, "label", folds).hint("rebalance"), "halving")
    chosen = drawn_trials(space, trials, seed)
    # else all trees grown so far are sent with every level; the models are the same
    placed = {"cacheNodeIds": True} if estimator.hasParam("cacheNodeIds") else {}
    evaluator = BinaryClassificationEvaluator(metricName="areaUnderROC")

    def model(trial: int):
        return estimator.copy({estimator.getParam(n): v for n, v in (chosen[trial] | placed).items()})

    def size(job: tuple[int, int]) -> int:
        return math.prod(chosen[job[0]].get(n, 1) for n in ("numTrees", "maxIter", "maxDepth"))

    def tested(job: tuple[int, int]) -> float:
        trial, fold = job
        fitted = model(trial).fit(data.where(F.col("fold") != fold))
        return evaluator.evaluate(fitted.transform(data.where(F.col("fold") == fold)))

    held = _held_search(data, [model(trial) for trial in range(trials)])

    def all_tested(jobs: list[tuple[int, int]]) -> list[float]:
        if held is None:
            return side_by_side(data.sparkSession, tested, jobs, parallelism)
        return held.aucs([_growing(model(trial), fold) for trial, fold in jobs])

    found: dict[int, list[float]] = {trial: [] for trial in range(trials)}

    def mean(trial: int) -> float:
        return sum(found[trial]) / len(found[trial])

    left, done, width = list(found), 0, 1
    while done < folds:
        jobs = [(trial, fold) for trial in left for fold in range(done, min(done + width, folds))]
        jobs.sort(key=lambda job: (-size(job), job))
        for (trial, _), auc in zip(jobs, all_tested(jobs)):
            found[trial].append(auc)
        done, width = done + width, 2 * width
        left = sorted(left, key=lambda trial: (-mean(trial), trial))[: max(1, -(-len(left) // keep))]
    rows = [(t, trial_text(chosen[t]), len(found[t]), float(mean(t))) for t in range(trials)]
    table = data.sparkSession.createDataFrame(rows, "trial int, parameters string, folds int, auc double")
    if held is None:
        return model(left[0]).fit(data), table
    return held.forests([_growing(model(left[0]), None)])[0], table


def _held_search(data: DataFrame, models: Sequence) -> trees.Held | None:
    """The rows of a search for workers to hold, if its forests are large and the rows fit."""
    forests = [_growing(model, None) for model in models]
    if None in forests:
        return None
    rows = data.count()
    if max(f.trees * min(2**f.depth, rows) for f in forests) <= LEVEL_NODES:
        return None
    cuts = trees.thresholds(data)
    held = trees.Held(data.sparkSession, trees.binned(data, cuts, "fold"), cuts)
    return held if held.fits() else None


def walk_forward(
    features: DataFrame,
    key: str,
    label: str,
    order: str = "log_tenure",
    n_folds: int = 6,
    settings: TreeSettings = TreeSettings(),
    cv: int = 3,
    C: float = 0.1,
    parallelism: int = 4,
) -> DataFrame:
    """Train the stack on the past and test it on the next rows, fold by fold, in ``order``.

    Rows (fold, train_size, test_size, test_churn_rate, auc); a fold with one class has AUC 0.5.
    """
    spark = features.sparkSession
    data = written(walk_forward_folds(features, order, key, n_folds), "walk-forward")
    tested = {r.test_fold for r in data.select("test_fold").distinct().collect()}
    numbers = list(takewhile(tested.__contains__, range(1, n_folds + 1)))
    if not numbers:
        raise ValueError("too few rows for a fold")

    def train(fold: int) -> DataFrame:
        return data.filter(F.col("train_from") <= fold)

    def past(fold: int) -> DataFrame:
        return assemble(standardize(train(fold)), [key], label)

    frames = side_by_side(spark, past, numbers, parallelism)
    stacks = dict(zip(numbers, fit_stacks(frames, key, settings, cv, C, parallelism)))

    def result(fold: int) -> DataFrame:
        test = data.filter(F.col("test_fold") == fold)
        held = assemble(standardize(test, fitted_on=train(fold)), [key], label)
        scored = written(stacks[fold].score(held), "walk-forward-scores")
        metrics = binary_metrics(scored, 0.5, "label", "p")
        sizes = train(fold).agg(F.count(F.lit(1))).scalar()
        counted = F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn")
        return metrics.select(
            F.lit(fold).alias("fold"),
            sizes.alias("train_size"),
            counted.alias("test_size"),
            ((F.col("tp") + F.col("fn")) / counted).alias("test_churn_rate"),
            F.coalesce("auc", F.lit(0.5)).alias("auc"),
        )

    return reduce(DataFrame.unionByName, side_by_side(spark, result, numbers, parallelism))


def calibrate_platt(held_out: DataFrame, scored: DataFrame, label: str = "y", score: str = "p"):
    """Add ``calibrated``: a one-feature logistic model fitted on held-out scores."""

    def as_vector(df: DataFrame) -> DataFrame:
        return df.withColumn("features", array_to_vector(F.array(F.col(score).cast("double"))))

    model = LogisticRegression(labelCol=label).fit(as_vector(held_out))
    return positive_probability(as_vector(scored), model, "calibrated").drop("features")
