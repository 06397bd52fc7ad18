"""Forests and boosted trees for many models at once, on rows whose features are bins of a byte each.

Spark ML grows one model after the other and starts several jobs for each level of its trees. Here the thresholds of a
feature are found once per table, as there at most 32 bins, and a row is one byte per feature from then on.

Boosted trees grow in step: one job sums the residuals of all models for one level of their trees, block of rows by
block, and only the sums meet in the driver. The trees of forests do not depend on each other: a task grows some of
them on all bins, which every worker reads and holds; tables of more than ``HELD_BYTES`` of bins are left to Spark ML.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark import StorageLevel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from brightwater.plans.scratch import file_store, scratch_root, written

#: Bins of a feature, as Spark ML has them.
MAX_BINS = 32
#: Values of a feature by which a task describes its rows; fewer different ones are exact.
SKETCH_VALUES = 1024
#: Rows of a block.
BLOCK_ROWS = 8192
#: Rows of a block whose comparisons with all thresholds are held at once; they stay in the cache.
STEP_ROWS = 512
#: Bytes of bins that a worker holds to grow the trees of forests.
HELD_BYTES = 384 << 20
#: Row places of all features tried, unless more cells are counted, and cells that a forest task has in memory at once.
PIECE_PLACES, PIECE_CELLS = 1 << 17, 1 << 20
#: Trees of a forest grown by one task.
TASK_TREES = 8
#: Rounds of boosting after which the rows' state no longer depends on the rounds before.
CHECKPOINT_ROUNDS = 20
#: Tasks whose sums the driver adds without a step between.
FEW_PIECES = 32
#: Levels of boosted trees grown here; deeper ones are left to Spark ML.
BOOST_LEVELS = 6
#: The least loss of Gini impurity, for what sums differ by.
LEAST_GINI = 1e-12
#: A gain must pass this share of what a node has, because residuals are summed in single precision within a block.
LEAST_GAIN = 1e-6


def _vectors(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False)
    return flat.reshape(len(column), -1)


def _shorter(values: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Values in order and their counts, merged into at most ``SKETCH_VALUES`` steps of about equal counts."""
    values, place = np.unique(values, return_inverse=True)
    counts = np.bincount(place, weights=counts, minlength=len(values))
    if len(values) <= SKETCH_VALUES:
        return values, counts
    total = np.cumsum(counts)
    marks = np.linspace(0, total[-1], SKETCH_VALUES + 1)[1:]
    kept = np.unique(np.minimum(np.searchsorted(total, marks), len(total) - 1))
    return values[kept], np.diff(total[kept], prepend=0.0)


def _thresholds(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Middles between neighbours: between all of few values, else where the counts are cut into ``MAX_BINS`` shares."""
    if len(values) <= MAX_BINS:
        return (values[1:] + values[:-1]) / 2
    total = np.cumsum(counts)
    at = np.searchsorted(total, total[-1] * np.arange(1, MAX_BINS) / MAX_BINS)
    at = np.unique(at[at < len(values) - 1])
    return (values[at] + values[at + 1]) / 2


def thresholds(assembled: DataFrame) -> list[np.ndarray]:
    """Per feature the values that may split it, found from all rows: a row goes left if it is not above."""

    def described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: list = []
        for batch in batches:
            rows = _vectors(batch[0])
            if not len(rows):
                continue
            known = known or [(np.zeros(0), np.zeros(0))] * rows.shape[1]
            for f, (values, counts) in enumerate(known):
                met, n = np.unique(rows[:, f], return_counts=True)
                known[f] = _shorter(np.append(values, met), np.append(counts, n))
        for f, (values, counts) in enumerate(known):
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(values), f, np.int32)), pa.array(values), pa.array(counts)],
                names=["feature", "value", "n"],
            )

    def cut(rows: pd.DataFrame) -> pd.DataFrame:
        found = _thresholds(*_shorter(rows["value"].to_numpy(), rows["n"].to_numpy()))
        return pd.DataFrame({"feature": [rows["feature"].iloc[0]], "cuts": [found]})

    values = assembled.select(vector_to_array("features").alias("x")).mapInArrow(
        described, "feature int, value double, n double"
    )
    cuts = values.groupBy("feature").applyInPandas(cut, "feature int, cuts array<double>").collect()
    return [np.array(r.cuts, dtype=np.float64) for r in sorted(cuts, key=lambda r: r.feature)]


def binned(assembled: DataFrame, cuts: Sequence[np.ndarray], fold: str | None = None) -> DataFrame:
    """A written table of blocks (fold, rows, labels, bins): bytes, ``bins`` with one run of rows after the other.

    A block has rows of one ``fold``.
    """

    def block(fold: int, x: np.ndarray, labels: np.ndarray) -> pa.RecordBatch:
        bins = np.empty(x.shape, dtype=np.uint8)
        for f, c in enumerate(cuts):
            bins[:, f] = np.searchsorted(c, x[:, f])
        columns = [[fold], [len(x)], [labels.astype(np.uint8).tobytes()], [bins.tobytes()]]
        kinds = [pa.int32(), pa.int32(), pa.binary(), pa.binary()]
        return pa.RecordBatch.from_arrays(
            [pa.array(c, k) for c, k in zip(columns, kinds)], names=["fold", "rows", "labels", "bins"]
        )

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        for batch in batches:
            of, labels, x = batch["fold"].to_numpy(), batch["label"].to_numpy(), _vectors(batch["x"])
            for f in np.unique(of).tolist():
                parts = held.setdefault(f, [])
                parts.append((x[of == f], labels[of == f]))
                if sum(len(p[1]) for p in parts) >= BLOCK_ROWS:
                    yield block(f, *(np.concatenate(p) for p in zip(*parts)))
                    held[f] = []
        for f, parts in held.items():
            if parts:
                yield block(f, *(np.concatenate(p) for p in zip(*parts)))

    rows = assembled.select(
        (F.lit(0) if fold is None else F.col(fold)).cast("int").alias("fold"),
        "label",
        vector_to_array("features").alias("x"),
    )
    return written(rows.mapInArrow(cut, "fold int, rows int, labels binary, bins binary"), "bins")


def _probability(df: DataFrame, score) -> DataFrame:
    """Add ``probability`` as Spark ML has it, by a function from rows of features to the share of class 1."""

    @F.pandas_udf("double")
    def churns(features: pd.Series) -> pd.Series:
        return pd.Series(score(np.stack(features.to_numpy())) if len(features) else [], dtype="float64")

    p: Column = churns(vector_to_array("features"))
    return df.withColumn("_p", p).withColumn("probability", array_to_vector(F.array(1 - F.col("_p"), F.col("_p")))).drop("_p")


# Boosted trees


@dataclass(frozen=True)
class BoostedTrees:
    """Trees of full depth, their nodes level by level; without a better cut all rows of a node go left."""

    features: np.ndarray  # of tree and node
    cuts: np.ndarray
    values: np.ndarray  # of tree and leaf
    weights: np.ndarray

    def margin(self, x: np.ndarray) -> np.ndarray:
        columns, every = np.ascontiguousarray(x.T), np.arange(len(x))
        total = np.zeros(len(x))
        for feature, cut, value, weight in zip(self.features, self.cuts, self.values, self.weights):
            node = np.zeros(len(x), dtype=np.int64)
            for _ in range(int(math.log2(len(value)))):
                node = 2 * node + 1 + (columns[feature[node], every] > cut[node])
            total += weight * value[node - (len(value) - 1)]
        return total

    def transform(self, df: DataFrame) -> DataFrame:
        return _probability(df, lambda x: 1 / (1 + np.exp(-2 * self.margin(x))))


@dataclass(frozen=True)
class Boosting:
    """One model of a group: its table, the fold it leaves out, its step, share of rows and seed."""

    table: int
    fold: int | None
    step: float
    share: float
    seed: int
    least: int


#: A cut that no bin is above.
ALL_LEFT = 255


def _went_right(bins: np.ndarray, features: np.ndarray, cuts: np.ndarray, levels: int) -> np.ndarray:
    """Which node of level ``levels`` each row of a block has reached in one tree."""
    node = np.zeros(bins.shape[1], dtype=np.uint8)
    for level in range(levels):
        first, right = 2**level - 1, np.zeros(bins.shape[1], dtype=bool)
        for at in range(2**level):
            above = bins[features[first + at]] > cuts[first + at]
            right |= above if level == 0 else above & (node == at)
        node = 2 * node + right
    return node


def grow_boosted(
    spark: SparkSession,
    tables: Sequence[tuple[DataFrame, Sequence[np.ndarray]]],
    models: Sequence[Boosting],
    rounds: int,
    depth: int,
) -> list[BoostedTrees]:
    """Gradient-boosted trees on the logistic loss as Spark ML defines them, for all models in step.

    ``tables`` are (blocks, thresholds). The first tree is fitted to the labels -1 and 1, later ones to the slope of the
    loss, and split by the largest loss of variance; a leaf has its rows' mean. A job sums the residuals of every
    model's nodes of one level by threshold; the sums of right children follow from those of their parents.
    """
    splits = [
        (
            np.repeat(np.arange(len(cuts)), [len(c) for c in cuts]),
            np.concatenate([np.arange(len(c)) for c in cuts]).astype(np.uint8),
        )
        for _, cuts in tables
    ]
    own = [[m for m, model in enumerate(models) if model.table == t] for t in range(len(tables))]

    def active(table: int, fold: int) -> list[int]:
        return [m for m in own[table] if models[m].fold != fold]

    def opened(table: int):
        def of(at_row):
            row, at = at_row
            bins = np.frombuffer(row.bins, dtype=np.uint8).reshape(row.rows, -1)
            y = np.frombuffer(row.labels, dtype=np.uint8).astype(np.float32) * 2 - 1
            f = np.zeros((len(active(table, row.fold)), row.rows), dtype=np.float32)
            return table, row.fold, at, np.ascontiguousarray(bins.T), y, f

        return of

    def advanced(trees, round_):
        """The state after a round: each model's margin moves by its tree."""
        features, cuts, values = trees

        def move(block):
            table, fold, at, bins, y, margin = block
            margin = margin.copy()
            for i, m in enumerate(active(table, fold)):
                weight = 1.0 if round_ == 0 else models[m].step
                leaf = _went_right(bins, features[m], cuts[m], depth)
                margin[i] += (weight * values[m]).astype(np.float32)[leaf]
            return table, fold, at, bins, y, margin

        return move

    def summed(trees, round_, level):
        """Per table the sums over this task's blocks of (model, left child, residual or rows, threshold or all)."""
        children = 2 ** max(level - 1, 0)

        def run(blocks):
            total = {}
            for table, fold, at, bins, y, margin in blocks:
                mine = active(table, fold)
                if not mine:
                    continue
                columns = np.empty((len(mine), children, 2, len(y)), dtype=np.float32)
                for i, m in enumerate(mine):
                    rows = np.ones(len(y), dtype=np.float32)
                    if models[m].share < 1:
                        rng = np.random.default_rng([models[m].seed, round_, table, at])
                        rows = (rng.random(len(y), dtype=np.float32) < models[m].share).astype(np.float32)
                    residual = y if round_ == 0 else 4 * y / (1 + np.exp(np.minimum(2 * y * margin[i], 80)))
                    residual = residual * rows
                    node = _went_right(bins, trees[0][m], trees[1][m], level) if level else None
                    for child in range(children):
                        here = 1 if node is None else node == 2 * child
                        np.multiply(residual, here, out=columns[i, child, 0])
                        np.multiply(rows, here, out=columns[i, child, 1])
                of, cut = splits[table]
                flat = columns.reshape(-1, len(y))
                sums = np.zeros((len(flat), len(of) + 1), dtype=np.float32)
                below = np.ones((len(of) + 1, min(len(y), STEP_ROWS)), dtype=np.float32)
                for a in range(0, len(y), STEP_ROWS):
                    some = flat[:, a : a + STEP_ROWS]
                    held = below[:, : some.shape[1]]
                    held[:-1] = bins[:, a : a + STEP_ROWS][of] <= cut[:, None]
                    sums += some @ held.T
                if table not in total:
                    total[table] = np.zeros((len(own[table]), children, 2, len(of) + 1))
                places = np.searchsorted(own[table], mine)
                total[table][places] += sums.reshape(len(mine), children, 2, -1)
            yield total

        return run

    def added(a: dict, b: dict) -> dict:
        return {t: a[t] + b[t] if t in a and t in b else a.get(t, b.get(t)) for t in {*a, *b}}

    context, state = spark.sparkContext, None
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(scratch_root(spark))
    for t, (blocks, _) in enumerate(tables):
        part = blocks.rdd.zipWithIndex().map(opened(t)).keyBy(lambda block: block[0] + block[2])
        state = part if state is None else state.union(part)
    pieces = max(1, context.defaultParallelism)
    # block by block, one task as many as another
    state = state.partitionBy(pieces, int).values().persist(StorageLevel.MEMORY_AND_DISK)
    nodes = 2**depth - 1
    grown, last = [], None
    for round_ in range(rounds):
        if grown:
            moved = state.map(advanced(grown[-1], round_ - 1)).persist(StorageLevel.MEMORY_AND_DISK)
            if round_ % CHECKPOINT_ROUNDS == 0:
                moved.checkpoint()
            last, state = state, moved
        features = np.zeros((len(models), nodes), dtype=np.int64)
        cuts = np.full((len(models), nodes), ALL_LEFT, dtype=np.int64)
        full: list = [None] * len(models)
        for level in range(depth):
            sums = state.mapPartitions(summed((features, cuts), round_, level))
            found = sums.treeReduce(added) if pieces > FEW_PIECES else sums.reduce(added)
            if last is not None:
                last.unpersist()
                last = None
            for t, members in enumerate(own):
                for i, m in enumerate(members):
                    left = found[t][i] if t in found else np.zeros((2 ** max(level - 1, 0), 2, len(splits[t][0]) + 1))
                    full[m] = left if not level else np.stack([left, full[m] - left], axis=1).reshape(-1, *left.shape[1:])
                    at = _best_cuts(full[m], models[m].least)
                    first = 2**level - 1
                    for n, best in enumerate(at.tolist()):
                        if best >= 0:
                            features[m, first + n], cuts[m, first + n] = splits[t][0][best], splits[t][1][best]
                    if level == depth - 1:
                        full[m] = _children(full[m], at)
        # a child without rows is never reached by a row
        values = np.array([f[:, 0] / np.maximum(f[:, 1], 1) for f in full])
        grown.append((features, cuts, values))
    state.unpersist()
    return [_boosted(grown, m, tables[model.table][1], model.step) for m, model in enumerate(models)]


def _best_cuts(sums: np.ndarray, least: int) -> np.ndarray:
    """Per node the threshold with the largest loss of variance, or -1."""
    s, n = sums[:, 0, -1:], sums[:, 1, -1:]
    left, rows = sums[:, 0, :-1], sums[:, 1, :-1]
    kept = s * s / np.maximum(n, 1)
    gain = left * left / np.maximum(rows, 1) + (s - left) ** 2 / np.maximum(n - rows, 1) - kept
    gain[(rows < least) | (n - rows < least)] = -np.inf
    if not gain.shape[1]:
        return np.full(len(sums), -1)
    best = gain.argmax(axis=1)
    return np.where(gain[np.arange(len(best)), best] > LEAST_GAIN * kept[:, 0], best, -1)


def _children(sums: np.ndarray, best: np.ndarray) -> np.ndarray:
    """Sums and rows of both children of every node, in order."""
    left = sums[np.arange(len(best)), :, best]  # -1 is the whole node
    return np.stack([left, sums[:, :, -1] - left], axis=1).reshape(-1, 2)


def _boosted(grown: list, m: int, cuts: Sequence[np.ndarray], step: float) -> BoostedTrees:
    features = np.array([g[0][m] for g in grown])
    bins = np.array([g[1][m] for g in grown])
    values = [
        [math.inf if b == ALL_LEFT else cuts[f][b] for f, b in zip(*pair)] for pair in zip(features.tolist(), bins.tolist())
    ]
    weights = np.array([1.0] + [step] * (len(grown) - 1))
    return BoostedTrees(features, np.array(values), np.array([g[2][m] for g in grown]), weights)


# Forests


@dataclass(frozen=True)
class Growing:
    """One forest: the fold it leaves out, and the parameters of Spark ML's forests."""

    fold: int | None
    trees: int
    depth: int
    least: int
    strategy: str
    seed: int

    def tried(self, features: int) -> int:
        """Features tried at a split."""
        shares = {
            "auto": 1.0 if self.trees == 1 else math.sqrt(features) / features,
            "all": 1.0,
            "sqrt": math.sqrt(features) / features,
            "log2": math.log2(features) / features,
            "onethird": 1 / 3,
        }
        return max(1, min(features, math.ceil(round(shares[self.strategy] * features, 9))))


STRATEGIES = ("auto", "all", "sqrt", "log2", "onethird")


def _grown_tree(bins, labels, weight, sizes, rng, depth, tried, least):
    """One tree (feature or -1, last bin of the left child, left child, share of class 1), nodes level by level.

    ``weight`` says how often a row was drawn. Splits have the largest loss of Gini impurity among ``tried`` features
    drawn for each node.
    """
    d = bins.shape[1]
    flat, rows = bins.reshape(-1), np.flatnonzero(weight)
    w, y = weight[rows], labels[rows]
    base, node = rows * d, np.zeros(len(rows), dtype=np.int32)
    counts = np.bincount(y, weights=w, minlength=2).reshape(1, 2)
    parts, first = [], 0
    for level in range(depth + 1):
        k, n = len(counts), counts.sum(axis=1)
        feature, cut, child = np.full(k, -1, np.int16), np.zeros(k, np.uint8), np.zeros(k, np.int32)
        share = counts[:, 1] / np.maximum(n, 1)
        parts.append((feature, cut, child, share))
        open_ = np.flatnonzero((counts.min(axis=1) > 0) & (n >= 2 * least)) if level < depth else np.zeros(0, int)
        if not len(open_):
            break
        place = np.full(k, -1, np.int32)
        place[open_] = np.arange(len(open_))
        kept = place[node] >= 0
        base, w, y, node = base[kept], w[kept], y[kept], place[node[kept]]
        drawn = rng.random((len(open_), d), dtype=np.float32).argpartition(tried - 1, axis=1)[:, :tried]
        won, left = _best_splits(flat, base, w, y, node, drawn, sizes, counts[open_], least)
        split = np.flatnonzero(won[0] >= 0)
        if not len(split):
            break
        feature[open_[split]], cut[open_[split]] = won[0][split], won[1][split]
        first += k
        child[open_[split]] = first + 2 * np.arange(len(split))
        place = np.full(len(open_), -1, np.int32)
        place[split] = np.arange(len(split))
        kept = place[node] >= 0
        base, w, y, node = base[kept], w[kept], y[kept], node[kept]
        node = 2 * place[node] + (flat[base + won[0][node]] > won[1][node])
        parent, left = counts[open_[split]], left[split]
        counts = np.stack([left, parent - left], axis=1).reshape(-1, 2)
    return tuple(np.concatenate(p) for p in zip(*parts))


def _best_splits(flat, base, w, y, node, drawn, sizes, counts, least):
    """Per node its (feature or -1, last left bin), and the classes' counts of the left child."""
    nodes, tried = drawn.shape
    width = sizes[drawn]
    step = max(1, PIECE_CELLS // max(1, int(width.sum(axis=1).max())))
    feature, cut, left = np.full(nodes, -1), np.zeros(nodes, int), np.zeros((nodes, 2))
    for a in range(0, nodes, step):
        z = min(nodes, a + step)
        mine = slice(None) if step >= nodes else np.flatnonzero((node >= a) & (node < z))
        b, weights, label, at = base[mine], w[mine], y[mine], node[mine] - a
        wide = width[a:z].reshape(-1)
        start = np.cumsum(wide) - wide
        cells = int(wide.sum())
        found = np.zeros(2 * cells)
        per_row, starts = drawn[a:z], start.reshape(-1, tried)
        rows = max(1, max(PIECE_PLACES, cells) // tried)
        for lo in range(0, len(b), rows):
            piece = slice(lo, lo + rows)
            here = at[piece]
            place = per_row.take(here, axis=0)
            place += b[piece, None]
            key = starts.take(here, axis=0)
            key += flat.take(place)
            key += key
            key += label[piece, None]
            found += np.bincount(key.ravel(), weights=np.repeat(weights[piece], tried), minlength=2 * cells)
        ones = found[1::2]
        n, ones = (found[::2] + ones).cumsum(), ones.cumsum()
        first = start > 0
        n -= np.repeat(np.where(first, n[start - 1], 0), wide)
        ones -= np.repeat(np.where(first, ones[start - 1], 0), wide)
        per_node = wide.reshape(-1, tried).sum(axis=1)
        all_n, all_ones = counts[a:z].sum(axis=1), counts[a:z, 1]
        rest, rest_ones = np.repeat(all_n, per_node) - n, np.repeat(all_ones, per_node) - ones
        # the loss of Gini impurity but for a constant of the node
        with np.errstate(divide="ignore", invalid="ignore"):
            score = ones * ones / n + rest_ones * rest_ones / rest
        score[(n < least) | (rest < least)] = -np.inf
        firsts = np.cumsum(per_node) - per_node
        best = np.maximum.reduceat(score, firsts)
        own = all_ones * all_ones / all_n
        hit = np.flatnonzero(score == np.repeat(best, per_node))
        owner, where = np.unique(np.searchsorted(firsts, hit, "right") - 1, return_index=True)
        hit = hit[where]  # every node has one, if only a forbidden one
        better = best[owner] > own[owner] * (1 + LEAST_GINI)
        hit, owner = hit[better], owner[better]
        column = np.searchsorted(start, hit, "right") - 1
        feature[a + owner] = drawn[a:z].reshape(-1)[column]
        cut[a + owner] = hit - start[column]
        left[a + owner] = np.stack([n[hit] - ones[hit], ones[hit]], axis=1)
    return (feature, cut), left


def _shares(tree, flat: np.ndarray, base: np.ndarray, above) -> np.ndarray:
    """The share of class 1 in the leaf of each row; ``above`` compares places of a row with a node's cut."""
    feature, _, child, share = tree
    node, going = np.zeros(len(base), dtype=np.int64), np.arange(len(base))
    while len(going):
        here = node[going]
        inner = feature[here] >= 0
        going, here = going[inner], here[inner]
        if len(going):
            node[going] = child[here] + above(flat[base[going] + feature[here]], here)
    return share[node]


def auc(labels: np.ndarray, scores: np.ndarray) -> float:
    """Area under the curve of class 1 among all rows, ties half."""
    values, place = np.unique(np.round(scores, 9), return_inverse=True)
    positive = np.bincount(place, weights=labels, minlength=len(values))
    negative = np.bincount(place, minlength=len(values)) - positive
    pairs = positive.sum() * negative.sum()
    if not pairs:
        return 0.5
    below = np.cumsum(negative) - negative
    return float((positive * (below + negative / 2)).sum() / pairs)


@dataclass(frozen=True)
class Forest:
    """Trees as rows (tree, feature, cut, child, share) of a written table; cuts are bins of ``thresholds``."""

    trees: DataFrame
    thresholds: Sequence[np.ndarray]

    def transform(self, df: DataFrame) -> DataFrame:
        """The mean of the leaves' shares; the trees are held by every task."""
        kinds = [np.int16, np.uint8, np.int32, np.float64]
        rows = self.trees.orderBy("tree").select("feature", "cut", "child", "share").collect()
        held = df.sparkSession.sparkContext.broadcast(
            [tuple(np.frombuffer(v, dtype=k) for v, k in zip(row, kinds)) for row in rows]
        )
        cuts = self.thresholds

        def score(x: np.ndarray) -> np.ndarray:
            bins = np.stack([np.searchsorted(c, x[:, f]) for f, c in enumerate(cuts)], axis=1).astype(np.uint8)
            flat, base = bins.reshape(-1), np.arange(len(bins)) * bins.shape[1]
            total = np.zeros(len(bins))
            for tree in held.value:
                total += _shares(tree, flat, base, lambda values, node: values > tree[1][node])
            return total / len(held.value)

        return _probability(df, score)


#: What this worker holds: the files it was read from, and bins, labels and folds of all their rows.
_read: list = [None, None]


def _all_rows(files: tuple[str, ...], rows: int, features: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bins, labels and folds of all rows of a table of blocks, read once by a worker; it holds one table at a time."""
    if _read[0] != files:
        _read[:] = None, None
        held = np.empty((rows, features), np.uint8), np.empty(rows, np.uint8), np.empty(rows, np.int32)
        at = 0
        for name in files:
            store, path = file_store(name)
            for batch in pq.ParquetFile(store.open_input_file(path)).iter_batches(16):
                for b in batch.to_pylist():
                    z = at + b["rows"]
                    held[0][at:z] = np.frombuffer(b["bins"], np.uint8).reshape(-1, features)
                    held[1][at:z] = np.frombuffer(b["labels"], np.uint8)
                    held[2][at:z] = b["fold"]
                    at = z
        if at != rows:
            raise ValueError(f"{at} rows were read, {rows} written")
        _read[:] = files, held
    return _read[1]


class Held:
    """A table of bins that workers read whole from the shared folder, to grow trees on it."""

    def __init__(self, spark: SparkSession, blocks: DataFrame, cuts: Sequence[np.ndarray]):
        self.spark, self.cuts = spark, cuts
        self.rows = blocks.agg(F.sum("rows")).first()[0] or 0
        self.files = tuple(sorted(blocks.inputFiles()))

    def fits(self) -> bool:
        return self.rows * (len(self.cuts) + 5) <= HELD_BYTES

    def _tasks(self, jobs: Sequence[Growing]):
        tasks = [
            (at, range(a, min(a + TASK_TREES, job.trees)))
            for at, job in enumerate(jobs)
            for a in range(0, job.trees, TASK_TREES)
        ]
        tasks.sort(key=lambda t: -jobs[t[0]].depth * len(t[1]))
        return self.spark.sparkContext.parallelize(tasks, max(1, len(tasks)))

    def _grower(self, jobs: Sequence[Growing]):
        place, sizes = (self.files, self.rows, len(self.cuts)), np.array([len(c) + 1 for c in self.cuts])

        def grow(at: int, number: int):
            job = jobs[at]
            bins, labels, fold = _all_rows(*place)
            rng = np.random.default_rng([job.seed, number])
            # drawn with replacement, as one Poisson number per row
            weight = rng.poisson(1.0, len(labels)).astype(np.uint8) if job.trees > 1 else np.ones(len(labels), np.uint8)
            if job.fold is not None:
                weight[fold == job.fold] = 0
            tried = job.tried(bins.shape[1])
            return _grown_tree(bins, labels, weight, sizes, rng, job.depth, tried, job.least)

        return grow

    def aucs(self, jobs: Sequence[Growing]) -> list[float]:
        """Of each forest the AUC on the fold that it leaves out."""
        place, grow = (self.files, self.rows, len(self.cuts)), self._grower(jobs)

        def left_out(at: int):
            bins, labels, fold = _all_rows(*place)
            return bins, labels, np.flatnonzero(fold == jobs[at].fold)

        def scored(task):
            at, numbers = task
            bins, _, rows = left_out(at)
            flat, base, total = bins.reshape(-1), rows * bins.shape[1], np.zeros(len(rows))
            for number in numbers:
                tree = grow(at, number)
                total += _shares(tree, flat, base, lambda values, node: values > tree[1][node])
            return at, total

        def measured(found):
            at, total = found
            _, labels, rows = left_out(at)
            return at, auc(labels[rows], total / jobs[at].trees)

        parts = max(1, min(len(jobs), self.spark.sparkContext.defaultParallelism))
        found = dict(self._tasks(jobs).map(scored).reduceByKey(np.add, parts).map(measured).collect())
        return [found[at] for at in range(len(jobs))]

    def forests(self, jobs: Sequence[Growing]) -> list[Forest]:
        """The forests, their trees written by the tasks that grow them."""
        grow = self._grower(jobs)

        def rows(task):
            at, numbers = task
            for number in numbers:
                yield (at, number, *[bytearray(part.tobytes()) for part in grow(at, number)])

        schema = "job int, tree int, feature binary, cut binary, child binary, share binary"
        trees = written(self.spark.createDataFrame(self._tasks(jobs).flatMap(rows), schema), "trees")
        return [Forest(trees.filter(F.col("job") == at), self.cuts) for at in range(len(jobs))]
