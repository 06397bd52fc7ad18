"""Nearest neighbours: exact, by inverted lists, and by locality-sensitive hashing.

The queries are a block of bounded size that every task holds as a matrix. A task multiplies each
Arrow batch of stored vectors with it and keeps only its best ``k`` per query, so no pair of query
and vector ever leaves a task unless it is among them, and the stored vectors are not shuffled.
The approximate searches compare a vector only with the queries that probe its list or share one of its
buckets; vectors that no query can meet are dropped by a filter on the stored columns.
More queries than one block holds meet groups of stored vectors of bounded size instead: around pivots, where the
triangle inequality leaves out groups that cannot hold one of a query's best, or else all of them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import Normalizer
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brightwater.functions.vectors import hash_vectors
from brightwater.plans.scratch import written
from brightwater.plans.skew import fits

QUERY_BLOCK = 4096
#: Bytes of the vectors in one group of an exact search for many queries.
GROUP_BYTES = 64 << 20
#: Pivots of such a search, and the vectors that they are learned from.
PIVOTS = 256
PIVOT_ROWS = 20_000
#: Stored rows whose vectors a task holds at once.
COMPARED_ROWS = 2048
# Values that a filter on readers, lists or buckets may name; more are left to the tasks.
FILTER_VALUES = 1000

#: Hash tables, directions joined into a key, and keys probed in a table.
TABLES, BITS, PROBES = 20, 10, 32
#: First bits of a key that decide its folder in stored hash tables.
PART_BITS = 3

# Similarities are rounded before they are ranked, so that ranks do not depend on the order in
# which products are summed; ids decide among equals.
DIGITS = 9

Encoder = Callable[[list], np.ndarray]


def hash_encoder(dims: int = 768) -> Encoder:
    return lambda texts: hash_vectors(texts, dims)


def _unit(matrix: np.ndarray) -> np.ndarray:
    lengths = np.sqrt((matrix * matrix).sum(axis=1, keepdims=True))
    return matrix / np.where(lengths == 0, 1.0, lengths)


def _matrix(column: pa.Array, encode: Encoder | None, dims: int | None = None) -> np.ndarray:
    """Unit vectors, one per row; raises if a vector has another length than ``dims`` or the first."""
    if encode is not None:
        return _unit(np.asarray(encode(column.to_pylist()), dtype=np.float64))
    if len(column) == 0:
        return np.zeros((0, dims or 0))
    lengths = pc.list_value_length(column).to_numpy(zero_copy_only=False)
    wanted = lengths[0] if dims is None else dims
    if not (lengths == wanted).all():
        raise ValueError(f"vectors must have {wanted:.0f} values, found {set(lengths.tolist()) - {wanted}}")
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return _unit(flat.reshape(len(column), -1))


@dataclass
class _Block:
    """A block of queries: ids, unit vectors, and optionally readers, probed lists and buckets."""

    ids: list
    matrix: np.ndarray
    users: list | None = None
    lists: np.ndarray | None = None
    buckets: np.ndarray | None = None
    by_user: dict = field(default_factory=dict)
    by_list: dict = field(default_factory=dict)
    by_bucket: dict = field(default_factory=dict)
    parts: list | None = None

    def __post_init__(self):
        self.by_user = _rows_by(self.users or [])

    def probe(self, lists: np.ndarray, part_shift: int | None = None) -> None:
        """Each query meets the vectors of its lists only; lists may be stored in parts of 2 ** part_shift."""
        self.lists = lists
        self.by_list = _rows_by(lists)
        if part_shift is not None:
            self.parts = sorted({v >> part_shift for v in self.by_list})

    def share(self, buckets: np.ndarray) -> None:
        """Each query meets the vectors that have one of its buckets only."""
        self.buckets = buckets
        self.by_bucket = _rows_by(buckets)


def _rows_by(values) -> dict:
    """Value (or each of several values) to the rows that have it."""
    groups: dict = {}
    for row, value in enumerate(values):
        for v in np.unique(value).tolist() if isinstance(value, np.ndarray) else [value]:
            groups.setdefault(v, []).append(row)
    return {value: np.array(rows) for value, rows in groups.items()}


def _stored_by(column: pa.Array, wanted) -> dict:
    """For each wanted value the rows of a list column that hold it, each row once."""
    values = pa.array(list(wanted), type=column.type.value_type)
    found = pc.index_in(column.flatten(), value_set=values)
    hit = np.asarray(pc.is_valid(found))
    owner = np.asarray(pc.list_parent_indices(column))[hit]
    which = found.drop_null().to_numpy()
    keep = np.ones(len(owner), dtype=bool)
    order = np.lexsort((owner, which))
    owner, which = owner[order], which[order]
    keep[1:] = (owner[1:] != owner[:-1]) | (which[1:] != which[:-1])
    owner, which = owner[keep], which[keep]
    starts = np.flatnonzero(np.append(True, which[1:] != which[:-1])) if len(which) else []
    names = list(wanted)
    return {names[which[a]]: owner[a:b] for a, b in zip(starts, [*starts[1:], len(which)])}


class _Best:
    """The best ``k`` (similarity, id) per query seen so far; with ``repeats`` a row may come several times."""

    def __init__(self, queries: int, k: int, repeats: bool = False):
        self.k, self.repeats = k, repeats
        self.found = [([], []) for _ in range(queries)]
        self.floor = np.full(queries, -np.inf)

    def add(self, query: int, sims: np.ndarray, ids: np.ndarray) -> None:
        keep = np.flatnonzero(sims >= self.floor[query])
        if len(keep) == 0:
            return
        if len(keep) > self.k:
            edge = np.partition(sims[keep], len(keep) - self.k)[len(keep) - self.k]
            keep = keep[sims[keep] >= edge]
        old_sims, old_ids = self.found[query]
        merged = sorted(
            zip([*old_sims, *sims[keep].tolist()], [*old_ids, *ids[keep].tolist()]),
            key=lambda pair: (-pair[0], pair[1]),
        )
        if self.repeats:  # equal neighbours are the same vector, met again
            merged = [m for n, m in enumerate(merged) if not n or m != merged[n - 1]]
        merged = merged[: self.k]
        self.found[query] = ([s for s, _ in merged], [i for _, i in merged])
        if len(merged) == self.k:
            self.floor[query] = merged[-1][0]


def _meetings(batch: pa.RecordBatch, block: _Block) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Which queries (rows of the block) meet which stored vectors (rows of the batch)."""
    every = np.arange(len(block.ids))
    if block.lists is not None:
        stored = _rows_by(batch.column("list").to_pylist())
        met = [(block.by_list[v], rows) for v, rows in stored.items() if v in block.by_list]
    elif block.buckets is not None:
        stored = _stored_by(batch.column("buckets"), block.by_bucket)
        partners: dict = {}
        for bucket, rows in stored.items():
            for query in block.by_bucket[bucket].tolist():
                partners.setdefault(query, []).append(rows)
        met = [(np.array([q]), np.unique(np.concatenate(rows))) for q, rows in partners.items()]
    else:
        met = [(every, np.arange(batch.num_rows))]
    if block.users is None:
        yield from met
        return
    readable = _stored_by(batch.column("permissions"), [u for u in block.by_user if u is not None])
    for queries, rows in met:
        for user, seen in readable.items():
            mine = np.intersect1d(block.by_user[user], queries, assume_unique=True)
            both = seen if len(rows) == batch.num_rows else np.intersect1d(seen, rows, assume_unique=True)
            if len(mine) and len(both):
                yield mine, both


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of the batches, so few at a time that their vectors stay small."""
    for batch in batches:
        for start in range(0, batch.num_rows, COMPARED_ROWS):
            yield batch.slice(start, COMPARED_ROWS)


def _compared(batch: pa.RecordBatch, block: _Block, encode):
    """Ids of the batch, and (queries, rows, similarities) of what meets."""
    ids = np.array(batch.column("id").to_pylist(), dtype=object)
    vectors = _matrix(batch.column("vector"), encode, block.matrix.shape[1] if len(block.ids) else None)
    return ids, (
        (queries, rows, np.round(block.matrix[queries] @ vectors[rows].T, DIGITS))
        for queries, rows in _meetings(batch, block)
    )


def _scan(batches: Iterator[pa.RecordBatch], block: _Block, k: int, encode, repeats: bool) -> _Best:
    best = _Best(len(block.ids), k, repeats)
    for batch in _pieces(batches):
        if not block.ids:
            continue
        ids, compared = _compared(batch, block, encode)
        for queries, rows, sims in compared:
            for at, query in enumerate(queries.tolist()):
                best.add(query, sims[at], ids[rows])
    return best


def _found(
    batches, block: _Block, k: int | None, encode, schema: pa.Schema, repeats: bool = False
) -> Iterator[pa.RecordBatch]:
    """The best rows of a task, or with ``k`` None all of them, batch by batch."""

    def rows(columns) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, schema)], schema=schema)

    if k is not None:
        yield rows(_rows(_scan(batches, block, k, encode, repeats), block))
        return
    for batch in _pieces(batches):
        if not block.ids:
            continue
        ids, compared = _compared(batch, block, encode)
        for queries, stored, sims in compared:
            for at, query in enumerate(queries.tolist()):
                yield rows(([block.ids[query]] * len(stored), ids[stored].tolist(), sims[at].tolist()))


class Wanted:
    """Pairs (query, id) that are sought in a ranking by score, then id; with scores their places in it.

    Scores are whole numbers of 10 ** -DIGITS. What a task has met is counted between the pairs of a query.
    """

    def __init__(self, pairs: list[tuple], scores: list[float] | None = None):
        self.ids = np.empty(len({i for _, i in pairs}), dtype=object)
        self.ids[:] = sorted({i for _, i in pairs})
        place = {i: at for at, i in enumerate(self.ids)}
        self.of: dict = {}
        for at, (query, i) in enumerate(pairs):
            key = place[i] if scores is None else self._keys(np.array(scores[at]), place[i])
            self.of.setdefault(query, []).append((int(key), i))
        for query, found in self.of.items():
            found.sort(key=lambda pair: pair[0])
            self.of[query] = np.array([key for key, _ in found], dtype=np.int64), [i for _, i in found]
        self.met = {query: np.zeros(len(keys) + 1, dtype=np.int64) for query, (keys, _) in self.of.items()}

    def _keys(self, scores: np.ndarray, places) -> np.ndarray:
        return np.rint(scores * 10.0**DIGITS).astype(np.int64) * (len(self.ids) + 1) - places

    def placed(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of each id how many sought ones are before it, and whether it is one itself."""
        at = np.searchsorted(self.ids, ids)
        return at, np.append(self.ids, None)[at] == ids

    def among(self, query, places: np.ndarray, sought: np.ndarray) -> np.ndarray:
        """Which rows are sought for a query."""
        return sought & np.isin(places, self.of[query][0]) if query in self.of else np.zeros(len(places), dtype=bool)

    def count(self, query, scores: np.ndarray, places: np.ndarray, sought: np.ndarray) -> None:
        if query in self.of:  # an id does not count for itself
            at = np.searchsorted(self.of[query][0], self._keys(scores, places + sought), "right")
            self.met[query] += np.bincount(at, minlength=len(self.met[query]))

    def counted(self) -> tuple[list, list, list]:
        """Queries, ids, and how many rows were better."""
        queries, ids, better = [], [], []
        for query, (_, names) in self.of.items():
            queries.extend([query] * len(names))
            ids.extend(names)
            better.extend((self.met[query][::-1].cumsum()[::-1][1:]).tolist())
        return queries, ids, better


def _rows(best: _Best, block: _Block) -> tuple[list, list, list]:
    queries, ids, sims = [], [], []
    for query, (found_sims, found_ids) in enumerate(best.found):
        queries.extend([block.ids[query]] * len(found_ids))
        ids.extend(found_ids)
        sims.extend(found_sims)
    return queries, ids, sims


def _result_type(queries: DataFrame, chunks: DataFrame) -> T.StructType:
    return T.StructType(
        [
            T.StructField("query_id", queries.schema["query_id"].dataType),
            T.StructField("id", chunks.schema["id"].dataType),
            T.StructField("similarity", T.DoubleType()),
        ]
    )


def _arrow_type(result: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(result)


def _block_of(rows: pa.Table | pa.RecordBatch, extra: Callable[[_Block], None] | None) -> _Block:
    names = rows.schema.names

    def combined(name: str) -> pa.Array:
        column = rows.column(name)
        return column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column

    block = _Block(
        ids=combined("query_id").to_pylist(),
        matrix=_matrix(combined("vector"), None),
        users=combined("user_id").to_pylist() if "user_id" in names else None,
    )
    if extra is not None:
        extra(block)
    return block


def _reachable(chunks: DataFrame, block: _Block) -> DataFrame:
    """Stored rows that some query may meet, as a filter that a partitioned table prunes by."""
    if block.users is not None and len(block.by_user) <= FILTER_VALUES:
        users = F.array(*[F.lit(u) for u in block.by_user]).cast("array<string>")
        chunks = chunks.filter(F.arrays_overlap("permissions", users))
    if block.parts is not None and len(block.parts) <= FILTER_VALUES:
        chunks = chunks.filter(F.col("part").isin(block.parts))
    if block.lists is not None and len(block.by_list) <= FILTER_VALUES:
        chunks = chunks.filter(F.col("list").isin(sorted(block.by_list)))
    if block.buckets is not None and len(block.by_bucket) <= FILTER_VALUES:
        buckets = F.array(*[F.lit(b) for b in sorted(block.by_bucket)]).cast("array<bigint>")
        chunks = chunks.filter(F.arrays_overlap("buckets", buckets))
    return chunks


def _search(
    queries: DataFrame,
    chunks: DataFrame,
    k: int | None,
    encode: Encoder | None,
    extra: Callable[[_Block], None] | None = None,
    query_block: int = QUERY_BLOCK,
    repeats: bool = False,
    pivots: bool = False,
) -> DataFrame:
    """Rows (query_id, id, similarity, rank) for frames with columns named as in ``_scan``.

    Rows without a vector are left out. All rows are ranked if ``k`` is None. With ``repeats`` a vector may be
    stored several times and counts once.
    """
    spark = chunks.sparkSession
    result = _result_type(queries, chunks)
    queries, chunks = (df.filter("vector is not null") for df in (queries, chunks))
    first = queries.limit(query_block + 1).toArrow()
    if first.num_rows <= query_block and not (pivots and first.num_rows):
        own = _block_of(first, extra)
        shared = spark.sparkContext.broadcast(own)
        schema = _arrow_type(result)

        def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            yield from _found(batches, shared.value, k, encode, schema, repeats)

        found = _reachable(chunks, own).mapInArrow(search, result)
    elif k is None or extra is not None:
        found = _search_in_groups(queries, _encoded(chunks, encode), k, extra, query_block, result, repeats)
    else:
        dims = len(first["vector"][0])
        found = _search_by_pivots(queries, _encoded(chunks, encode), k, query_block, result, dims)
    if repeats:
        found = found.dropDuplicates(["query_id", "id"])
    order = Window.partitionBy("query_id").orderBy(F.col("similarity").desc(), "id")
    ranked = found.withColumn("rank", F.row_number().over(order))
    return ranked if k is None else ranked.filter(F.col("rank") <= k)


def _encoded(chunks: DataFrame, encode: Encoder | None) -> DataFrame:
    """Texts as vectors, so that they are embedded once however many blocks they meet."""
    if encode is None:
        return chunks
    place = chunks.columns.index("vector")

    def embed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = np.asarray(encode(batch.column(place).to_pylist()), dtype=np.float64)
            column = pa.array(list(vectors), type=pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays(
                [column if i == place else c for i, c in enumerate(batch.columns)], names=batch.schema.names
            )

    fields = [
        T.StructField(f.name, T.ArrayType(T.DoubleType()) if f.name == "vector" else f.dataType)
        for f in chunks.schema.fields
    ]
    return chunks.mapInArrow(embed, T.StructType(fields))


def _search_in_groups(queries, chunks, k, extra, query_block, result, repeats) -> DataFrame:
    """Every block of queries meets every block of vectors in a group of bounded size."""
    query_blocks = -(-queries.count() * 2 // query_block)
    dims = queries.select(F.size("vector").alias("n")).first().n
    vector_blocks = max(1, -(-chunks.count() // _group_rows(dims)))

    def dealt(df: DataFrame, key: str, mine: str, blocks: int, other: str, others: int):
        spots = F.sequence(F.lit(0), F.lit(others - 1))
        return df.withColumn(
            mine, F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int")
        ).withColumn(other, F.explode(spots))

    left = dealt(queries, "query_id", "_q", query_blocks, "_v", vector_blocks)
    right = dealt(chunks, "id", "_v", vector_blocks, "_q", query_blocks)
    schema = _arrow_type(result)

    def meet(some_queries: pa.Table, some_chunks: pa.Table) -> pa.Table:
        if some_queries.num_rows == 0 or some_chunks.num_rows == 0:
            return schema.empty_table()
        batches = some_chunks.combine_chunks().to_batches()
        return pa.Table.from_batches(_found(iter(batches), _block_of(some_queries, extra), k, None, schema, repeats), schema)

    return (
        left.groupBy("_q", "_v").cogroup(right.groupBy("_q", "_v")).applyInArrow(meet, result)
    )


def means(points: np.ndarray, k: int, seed: int, rounds: int = 12) -> np.ndarray:
    """Cluster means of a bounded sample, by Lloyd's rounds from k different starting points; k rows at most."""
    points = np.asarray(points, dtype=np.float64)
    starts = np.unique(points, axis=0)
    if len(starts) <= k:
        return starts
    found = starts[np.random.default_rng(seed).permutation(len(starts))[:k]]
    for _ in range(rounds):
        near = ((found**2).sum(axis=1)[None, :] - 2 * (points @ found.T)).argmin(axis=1)
        counts = np.bincount(near, minlength=k)
        sums = np.zeros_like(found)
        np.add.at(sums, near, points)
        found = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], found)
    return found


def _group_rows(dims: int) -> int:
    return max(64, GROUP_BYTES // (8 * max(dims, 1)))


def _angles(unit: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Angles between unit vectors (or zeros, at a right angle to everything) and pivots; a metric on the sphere."""
    return np.arccos(np.clip(unit @ pivots.T, -1.0, 1.0))


def _pivots_of(chunks: DataFrame, dims: int, groups: int) -> np.ndarray:
    """Unit vectors around which stored vectors lie, learned from at most ``PIVOT_ROWS`` of them."""
    total = chunks.count()
    drawn = F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < int(min(1.0, PIVOT_ROWS / max(total, 1)) * (1 << 30))
    sample = chunks.select("id", "vector").where(drawn).limit(PIVOT_ROWS).toArrow()
    unit = _matrix(sample["vector"].combine_chunks(), None, dims) if sample.num_rows else np.eye(1, dims)
    found = means(unit, min(PIVOTS, max(groups, 16)), 42)
    found = _unit(found)
    return found[np.abs(found).sum(axis=1) > 0] if np.abs(found).sum() else np.eye(1, dims)


def _around(df: DataFrame, pivots: np.ndarray, key: str) -> DataFrame:
    """Add the nearest pivot ``_p`` and the angle to it; zero vectors, at a right angle to all, are with the first."""
    shared = df.sparkSession.sparkContext.broadcast(pivots)
    place = df.columns.index("vector")

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            angles = _angles(_matrix(batch.column(place), None, shared.value.shape[1]), shared.value)
            near = angles.argmin(axis=1)
            more = [pa.array(near, pa.int32()), pa.array(angles[np.arange(len(near)), near])]
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], names=[*batch.schema.names, "_p", "_angle"])

    more = [T.StructField("_p", T.IntegerType()), T.StructField("_angle", T.DoubleType())]
    return written(df.mapInArrow(add, T.StructType([*df.schema.fields, *more])), key)


def _reached(unit: np.ndarray, floor: np.ndarray, pivots: np.ndarray, radius: np.ndarray) -> np.ndarray:
    """Which pivots may have a vector with a similarity of ``floor`` or more, per unit vector.

    By the triangle inequality a vector around a pivot is at least the pivot's angle less its radius away.
    """
    least = np.maximum(_angles(unit, pivots) - radius[None, :], 0.0)
    # a zero vector is no point of the sphere: its similarity is 0 to all
    bound = np.where(np.abs(unit).sum(axis=1, keepdims=True) == 0, 0.0, np.cos(least))
    return (bound + 1e-7 >= floor[:, None]) & (radius >= 0)[None, :]


def _search_by_pivots(queries, chunks, k, query_block, result, dims) -> DataFrame:
    """Exact search for many queries: vectors are grouped around pivots, and a query meets the groups it can need.

    A query first meets the vectors around its own pivot. The k-th best similarity there is a floor; other pivots are
    met only if their nearest possible vector reaches it. Groups hold at most ``query_block`` queries and
    ``GROUP_BYTES`` of vectors on average.
    """
    spark = chunks.sparkSession
    rows = _group_rows(dims)
    stored = written(chunks, "vectors")
    pivots = _pivots_of(stored, dims, -(-stored.count() // rows))
    stored, asked = _around(stored, pivots, "stored"), _around(queries, pivots, "asked")
    # zero vectors have similarity 0 to everything, so their pivot must reach a right angle
    flat = F.when(F.forall("vector", lambda x: x == 0), F.lit(np.pi)).otherwise(F.col("_angle"))
    around = {r["_p"]: r for r in stored.groupBy("_p").agg(F.count(F.lit(1)).alias("n"), F.max(flat).alias("far")).collect()}
    radius = np.array([around[p].far if p in around else -1.0 for p in range(len(pivots))])
    parts = [max(1, -(-around[p].n // rows)) if p in around else 1 for p in range(len(pivots))]
    owned = {r["_p"]: r["count"] for r in asked.groupBy("_p").count().collect()}
    shares = [max(1, -(-owned.get(p, 0) // query_block)) for p in range(len(pivots))]

    def part(key: str, counts: list[int]) -> Column:
        return F.pmod(F.xxhash64(key), F.get(F.array(*map(F.lit, counts)), F.col("_p"))).cast("int")

    asked = asked.withColumn("_share", part("query_id", shares)).withColumn("_own", F.col("_p"))
    stored = stored.withColumn("_part", part("id", parts)).drop("_angle")
    schema = _arrow_type(result)

    def meet(some_queries: pa.Table, some_chunks: pa.Table) -> pa.Table:
        if some_queries.num_rows == 0 or some_chunks.num_rows == 0:
            return schema.empty_table()
        batches = some_chunks.combine_chunks().to_batches()
        return pa.Table.from_batches(_found(iter(batches), _block_of(some_queries, None), k, None, schema), schema)

    def met(some: DataFrame) -> DataFrame:
        """The queries of ``some`` with the vectors around the pivot ``_p`` that each row names."""
        pairs = written(some.select("_p", "_own", "_share").distinct(), "pairs")
        copied = stored.join(F.broadcast(pairs) if fits(pairs) else pairs, "_p")
        spots = F.sequence(F.lit(0), F.get(F.array(*map(F.lit, parts)), F.col("_p")) - 1)
        left = some.withColumn("_part", F.explode(spots))
        on = ["_own", "_share", "_p", "_part"]
        return left.groupBy(*on).cogroup(copied.groupBy(*on)).applyInArrow(meet, result)

    columns = [c for c in asked.columns if c not in ("_p", "_angle")]
    near = written(met(asked.drop("_angle")), "near")
    order = Window.partitionBy("query_id").orderBy(F.col("similarity").desc())
    kth = near.withColumn("nth", F.row_number().over(order)).where(F.col("nth") == k)
    floors = asked.select(*columns).join(kth.select("query_id", F.col("similarity").alias("_floor")), "query_id", "left")
    place, own = floors.columns.index("vector"), floors.columns.index("_own")

    def need(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            unit = _matrix(batch.column(place), None, dims)
            floor = np.array(pc.fill_null(batch.column(batch.num_columns - 1), -2.0), dtype=np.float64)
            wanted = _reached(unit, floor, pivots, radius)
            wanted[np.arange(len(unit)), batch.column(own).to_numpy()] = False
            found = pa.array([np.flatnonzero(w).tolist() for w in wanted], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([*batch.columns, found], names=[*batch.schema.names, "_needed"])

    fields = [*floors.schema.fields, T.StructField("_needed", T.ArrayType(T.IntegerType()))]
    needed = floors.mapInArrow(need, T.StructType(fields)).withColumn("_p", F.explode("_needed"))
    return near.unionByName(met(written(needed.drop("_floor", "_needed"), "needed")))


def _inputs(queries, chunks, vector, access, more=()):
    q = queries.select(
        "query_id",
        F.col("embedding").alias("vector"),
        *(["user_id"] if access else []),
    )
    c = chunks.select(
        "id", F.col(vector).alias("vector"), *(["permissions"] if access else []), *more
    )
    return q, c


def vector_topk(
    queries: DataFrame,
    chunks: DataFrame,
    k: int | None = 5,
    access: bool = False,
    encode: Encoder | None = None,
    query_block: int = QUERY_BLOCK,
    pivots: bool = False,
) -> DataFrame:
    """The ``k`` stored vectors most similar to each query, by cosine; all of them with ``k`` None.

    More than ``query_block`` queries (any number with ``pivots``) meet groups of vectors around pivots, and only
    those that can hold one of their best ``k``.

    ``queries`` has query_id and embedding, ``chunks`` id and embedding. With ``access`` a query's
    user_id must be among the chunk's permissions. With ``encode`` the chunks carry ``chunk_text``
    and are embedded inside the scan instead of before it.
    """
    q, c = _inputs(queries, chunks, "embedding" if encode is None else "chunk_text", access)
    return _search(q, c, k, encode, query_block=query_block, pivots=pivots)


def vector_places(
    queries: DataFrame, chunks: DataFrame, pairs: DataFrame, access: bool = False, encode: Encoder | None = None
) -> DataFrame | None:
    """Rows (query_id, id, rank): the places that the few ``pairs`` (query_id, id) have in ``vector_topk`` with ``k`` None.

    Only the pairs' own similarities leave a task, and how many others are better. None if the queries are more than a block.
    """
    spark, result = chunks.sparkSession, _result_type(queries, chunks)
    q, c = _inputs(queries, chunks, "embedding" if encode is None else "chunk_text", access)
    q, c = (df.filter("vector is not null") for df in (q, c))
    first = q.limit(QUERY_BLOCK + 1).toArrow()
    if first.num_rows > QUERY_BLOCK:
        return None
    own = _block_of(first, None)
    shared, schema = spark.sparkContext.broadcast(own), _arrow_type(result)
    kinds = [f.type for f in schema]

    def met(batches: Iterator[pa.RecordBatch], wanted: Wanted):
        for batch in _pieces(batches):
            if shared.value.ids:
                ids, compared = _compared(batch, shared.value, encode)
                places, sought = wanted.placed(ids)
                for asked, rows, sims in compared:
                    for at, query in enumerate(asked.tolist()):
                        yield shared.value.ids[query], ids, rows, sims[at], places[rows], sought[rows]

    def picked(wanted):
        def pick(batches):
            for query, ids, rows, sims, places, sought in met(batches, wanted.value):
                mine = wanted.value.among(query, places, sought)
                if mine.any():
                    columns = [query] * int(mine.sum()), ids[rows[mine]].tolist(), sims[mine]
                    yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(columns, kinds)], schema=schema)

        return pick

    def counting(wanted):
        def count(batches):
            held = wanted.value
            for found in held.met.values():  # a worker may keep it from another task
                found[:] = 0
            for query, _, _, sims, places, sought in met(batches, held):
                held.count(query, sims, places, sought)
            yield places_batch(held, kinds)

        return count

    return places_of(_reachable(c, own), pairs, picked, counting, result)


def places_batch(wanted: Wanted, kinds: list) -> pa.RecordBatch:
    columns = zip(wanted.counted(), [*kinds[:2], pa.int64()])
    return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in columns], names=["query_id", "id", "better"])


def places_of(rows: DataFrame, pairs: DataFrame, picked, counting, result: T.StructType) -> DataFrame:
    """Ranks of the pairs: their scores from the rows that have their ids, then a count over all rows."""
    spark = rows.sparkSession
    sought = pairs.select("query_id", "id").distinct().collect()
    wanted = spark.sparkContext.broadcast(Wanted([tuple(r) for r in sought]))
    few = rows.join(F.broadcast(pairs.select("id").distinct()), "id", "left_semi").select(*rows.columns)
    found = few.mapInArrow(picked(wanted), result).collect()
    scored = spark.sparkContext.broadcast(Wanted([tuple(r)[:2] for r in found], [r[2] for r in found]))
    schema = T.StructType([*result.fields[:2], T.StructField("better", T.LongType())])
    better = rows.mapInArrow(counting(scored), schema).groupBy("query_id", "id").agg(F.sum("better").alias("better"))
    return better.select("query_id", "id", (F.col("better") + 1).cast("int").alias("rank"))


def _with_unit_features(df: DataFrame) -> DataFrame:
    raw = df.withColumn("_raw", array_to_vector(F.col("embedding").cast("array<double>")))
    return Normalizer(inputCol="_raw", outputCol="_features").transform(raw).drop("_raw")


def inverted_lists(chunks: DataFrame, lists: int = 100, seed: int = 42) -> tuple[DataFrame, np.ndarray]:
    """Assign every vector to the nearest of ``lists`` trained centroids; also return the centroids.

    Vectors are scaled to length one first, as they are when they are compared.
    """
    vectors = _with_unit_features(chunks.filter("embedding is not null"))
    model = KMeans(k=lists, seed=seed, featuresCol="_features", predictionCol="list").fit(vectors)
    centroids = np.array(model.clusterCenters())
    return assign_lists(chunks, centroids), centroids


def _nearest_lists(matrix: np.ndarray, centroids: np.ndarray, n: int) -> np.ndarray:
    """The ``n`` centroids nearest to each unit vector, ties by number."""
    distance = (centroids**2).sum(axis=1)[None, :] - 2 * (matrix @ centroids.T)
    return np.argsort(np.round(distance, DIGITS), axis=1, kind="stable")[:, :n]


def assign_lists(chunks: DataFrame, centroids: np.ndarray) -> DataFrame:
    """Add ``list``, the number of the centroid nearest to the scaled vector; rows without a vector go.

    Stored partitioned by ``list``, a search reads the files of the probed lists only.
    """
    shared = chunks.sparkSession.sparkContext.broadcast(np.asarray(centroids, dtype=np.float64))
    stored = chunks.filter("embedding is not null")
    place = stored.columns.index("embedding")

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = _matrix(batch.column(place), None, shared.value.shape[1])
            near = _nearest_lists(vectors, shared.value, 1)[:, 0] if len(vectors) else []
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(near, pa.int32())], names=[*batch.schema.names, "list"]
            )

    return stored.mapInArrow(assign, T.StructType([*stored.schema.fields, T.StructField("list", T.IntegerType())]))


def ivf_topk(
    queries: DataFrame,
    listed: DataFrame,
    centroids: np.ndarray,
    k: int | None = 5,
    probes: int = 10,
    access: bool = False,
    query_block: int = QUERY_BLOCK,
) -> DataFrame:
    """Approximate neighbours: a query is compared with the vectors of its ``probes`` nearest lists only.

    ``listed`` comes from ``assign_lists`` with the same centroids.
    """
    centroids = np.asarray(centroids, dtype=np.float64)

    def nearest(block: _Block) -> None:
        block.probe(_nearest_lists(block.matrix, centroids, probes))

    q, c = _inputs(queries, listed, "embedding", access, more=["list"])
    return _search(q, c, k, None, nearest, query_block)


def hash_directions(dims: int, tables: int = TABLES, bits: int = BITS, seed: int = 42) -> np.ndarray:
    """Random directions of the hash tables: (tables, bits, dims)."""
    return np.random.default_rng(seed).standard_normal((tables, bits, dims))


def _projections(matrix: np.ndarray, directions: np.ndarray) -> np.ndarray:
    """How far each unit vector lies along every direction: (vectors, tables, bits)."""
    tables, bits, dims = directions.shape
    return np.round(matrix @ directions.reshape(tables * bits, dims).T, DIGITS).reshape(-1, tables, bits)


def _keys(along: np.ndarray) -> np.ndarray:
    """The key of each vector in every table: one bit a direction, and tables do not mix."""
    _, tables, bits = along.shape
    return ((along >= 0) @ (1 << np.arange(bits))) + (np.arange(tables) << bits)


def _probed_keys(along: np.ndarray, probes: int) -> np.ndarray:
    """The keys a query probes: in each table its own and the nearest ones, ``probes`` together.

    A key is as far as the planes that must be crossed to get there, by the sum of squared distances; up to
    two are crossed. Equal distances are taken in the order of the crossed directions, fewer first.
    """
    _, tables, bits = along.shape
    crossed = [(), *((a,) for a in range(bits)), *combinations(range(bits), 2)]
    crosses = np.zeros((len(crossed), bits))
    for row, which in enumerate(crossed):
        crosses[row, list(which)] = 1
    flips = (crosses @ (1 << np.arange(bits))).astype(np.int64)
    far = np.round((along**2) @ crosses.T, DIGITS)
    near = np.argsort(far, axis=2, kind="stable")[:, :, :probes]
    return (_keys(along)[:, :, None] ^ flips[near]).reshape(len(along), -1)


def _with_keys(chunks: DataFrame, directions: np.ndarray, name: str) -> DataFrame:
    shared = chunks.sparkSession.sparkContext.broadcast(np.asarray(directions, dtype=np.float64))
    stored = chunks.filter("embedding is not null")
    place = stored.columns.index("embedding")

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = _matrix(batch.column(place), None, shared.value.shape[2])
            keys = _keys(_projections(vectors, shared.value)) if len(vectors) else []
            found = pa.array(list(keys), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([*batch.columns, found], names=[*batch.schema.names, name])

    field = T.StructField(name, T.ArrayType(T.LongType()))
    return stored.mapInArrow(add, T.StructType([*stored.schema.fields, field]))


def hashed_buckets(chunks: DataFrame, directions: np.ndarray) -> DataFrame:
    """Add ``buckets``, the key of each hash table, to stored vectors; rows without a vector go."""
    return _with_keys(chunks, directions, "buckets")


def write_hash_tables(chunks: DataFrame, directions: np.ndarray, path: str) -> DataFrame:
    """Store every vector once per hash table, under its key ``list``; rows without a vector go.

    Files are partitioned by ``part``, the table and the first bits of the key, and sorted by key: a search for few
    queries reads the parts that its probed keys are in. The copies are the price of not reading the others.
    """
    opened = _with_keys(chunks, directions, "_keys").withColumn("list", F.explode("_keys")).drop("_keys")
    split = opened.withColumn("part", _part(F.col("list"), directions.shape[1]))
    split.repartition("part").sortWithinPartitions("part", "list").write.partitionBy("part").parquet(path)
    return chunks.sparkSession.read.schema(split.schema).parquet(path)


def _part(key: Column, bits: int) -> Column:
    return F.shiftright(key, max(bits - PART_BITS, 0)).cast("int")


def lsh_topk(
    queries: DataFrame,
    chunks: DataFrame,
    k: int | None = 5,
    tables: int = TABLES,
    bits: int = BITS,
    probes: int = PROBES,
    seed: int = 42,
    access: bool = False,
    directions: np.ndarray | None = None,
    query_block: int = QUERY_BLOCK,
) -> DataFrame:
    """Approximate neighbours: vectors with a key that the query probes in some hash table.

    A key joins the sides of ``bits`` random planes; in each of ``tables`` tables a query probes the ``probes`` nearest
    keys. ``directions`` gives the planes, otherwise random ones are drawn. A vector is compared with the
    queries that probe one of its keys and nothing else. Chunks from ``hashed_buckets`` or ``write_hash_tables``
    (with the same directions) are not hashed again; of the latter only the probed parts are read.
    """
    if directions is None:
        sized = queries.filter("embedding is not null").select(F.size("embedding").alias("n")).first()
        directions = hash_directions(sized.n if sized else 1, tables, bits, seed)
    directions = np.asarray(directions, dtype=np.float64)

    def probed(block: _Block) -> np.ndarray:
        if not block.ids:
            return np.zeros((0, 1), dtype=np.int64)
        return _probed_keys(_projections(block.matrix, directions), probes)

    if "list" in chunks.columns:  # copies by key: a vector may be met in several tables
        q, c = _inputs(queries, chunks, "embedding", access, more=["list", "part"])
        shift = max(directions.shape[1] - PART_BITS, 0)
        return _search(q, c, k, None, lambda b: b.probe(probed(b), shift), query_block, True)
    hashed = chunks if "buckets" in chunks.columns else hashed_buckets(chunks, directions)
    q, c = _inputs(queries, hashed, "embedding", access, more=["buckets"])
    return _search(q, c, k, None, lambda b: b.share(probed(b)), query_block)


def lsh_met(queries: DataFrame, chunks: DataFrame, directions: np.ndarray, probes: int = PROBES) -> DataFrame:
    """Rows (query_id, met): how many stored vectors a query is compared with by ``lsh_topk``.

    For measuring a choice of tables: at most ``QUERY_BLOCK`` queries.
    """
    asked = queries.filter("embedding is not null").select("query_id", F.col("embedding").alias("vector"))
    rows = asked.limit(QUERY_BLOCK + 1).toArrow()
    if rows.num_rows > QUERY_BLOCK:
        raise ValueError(f"at most {QUERY_BLOCK} queries")
    directions = np.asarray(directions, dtype=np.float64)

    def probed(block: _Block) -> None:
        if block.ids:
            block.share(_probed_keys(_projections(block.matrix, directions), probes))

    shared = chunks.sparkSession.sparkContext.broadcast(_block_of(rows, probed))
    result = T.StructType([queries.schema["query_id"], T.StructField("n", T.LongType())])
    schema = _arrow_type(result)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = shared.value
        met = np.zeros(len(block.ids), dtype=np.int64)
        for batch in batches:
            for some, stored in _meetings(batch, block) if block.ids and batch.num_rows else []:
                met[some] += len(stored)
        yield pa.RecordBatch.from_arrays([pa.array(block.ids, schema.field(0).type), pa.array(met)], schema=schema)

    hashed = chunks if "buckets" in chunks.columns else hashed_buckets(chunks, directions)
    counted = hashed.select("buckets").mapInArrow(count, result)
    return counted.groupBy("query_id").agg(F.sum("n").alias("met"))
