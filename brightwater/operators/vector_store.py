"""A stored index of vectors: trained inverted lists with short codes, appends, and splits of lists that grew.

Training takes a bounded sample (``TRAIN_ROWS``): centroids of the lists, and for what remains of a vector after its
centroid one codebook for every part of the dimensions (product quantization). Every vector is stored under its list
with its code, ``parts`` bytes, beside the vector itself.

A search compares a query with the codes of its nearest lists, keeps the best few per task, and then compares
the best of all tasks exactly; only lists that some query probes are read, and vectors only by the second step.

Layout: every append or split writes a folder of ``vectors``, partitioned by list. A version lists the folders and
which of their lists count, and holds the model; it is written last, so a reader has one whole version.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brightwater.functions.vectors import cosine_similarity
from brightwater.operators.vector import (
    DIGITS,
    QUERY_BLOCK,
    _arrow_type,
    _Best,
    _matrix,
    _result_type,
    _rows_by,
    _stored_by,
    _with_unit_features,
    means,
)
from brightwater.plans.scratch import written
from brightwater.plans.skew import fits

LISTS = 100
PARTS = 16
CODES = 256
#: Vectors that centroids are learned from, and of these the ones that codebooks are learned from.
TRAIN_ROWS = 100_000
CODE_ROWS = 10_000


@dataclass(frozen=True)
class Model:
    """Centroids by list number (a retired list has a row of NaN) and codebooks (parts, codes, width)."""

    centroids: np.ndarray
    codebooks: np.ndarray

    @property
    def dims(self) -> int:
        return self.centroids.shape[1]

    def nearest(self, unit: np.ndarray, n: int, among: np.ndarray | None = None) -> np.ndarray:
        """The ``n`` lists nearest to each unit vector, ties by number; retired lists are never near."""
        lists = np.flatnonzero(~np.isnan(self.centroids[:, 0])) if among is None else among
        centroids = self.centroids[lists]
        far = np.round((centroids**2).sum(axis=1)[None, :] - 2 * (unit @ centroids.T), DIGITS)
        return lists[np.argsort(far, axis=1, kind="stable")[:, :n]]

    def split(self, vectors: np.ndarray) -> np.ndarray:
        """Vectors cut into the parts of the codebooks, the last one filled up with zeros: (rows, parts, width)."""
        parts, _, width = self.codebooks.shape
        padded = np.zeros((len(vectors), parts * width))
        padded[:, : vectors.shape[1]] = vectors
        return padded.reshape(len(vectors), parts, width)

    def codes(self, rest: np.ndarray) -> np.ndarray:
        """The nearest codeword of every part."""
        out = np.zeros((len(rest), len(self.codebooks)), dtype=np.uint8)
        for part, values in enumerate(self.split(rest).transpose(1, 0, 2)):
            book = self.codebooks[part]
            out[:, part] = ((book**2).sum(axis=1)[None, :] - 2 * (values @ book.T)).argmin(axis=1)
        return out


def _sampled(vectors: DataFrame, rows: int) -> DataFrame:
    """About ``rows`` rows, never more, drawn by a hash of the id."""
    total = vectors.count()
    if total <= rows:
        return vectors
    share = F.pmod(F.xxhash64("id", F.lit(7)), F.lit(1 << 30)) < int((1 << 30) * rows / total)
    return vectors.where(share).limit(rows)


def train(chunks: DataFrame, lists: int = LISTS, parts: int = PARTS, seed: int = 42) -> Model:
    """Learn a model from at most ``TRAIN_ROWS`` of the vectors, scaled to length one.

    There are fewer lists than asked for if the sample has fewer different vectors.
    """
    sample = written(_sampled(chunks.where("embedding is not null").select("id", "embedding"), TRAIN_ROWS), "sample")
    if sample.isEmpty():
        raise ValueError("there is no vector to learn from")
    unit = _with_unit_features(sample)
    fitted = KMeans(k=lists, seed=seed, featuresCol="_features", predictionCol="list").fit(unit)
    centroids = np.array(fitted.clusterCenters())
    few = _sampled(sample, CODE_ROWS).select("embedding").toArrow()["embedding"].combine_chunks()
    vectors = _matrix(few, None, centroids.shape[1])
    width = -(-centroids.shape[1] // parts)
    model = Model(centroids, np.zeros((parts, 1, width)))
    rest = model.split(vectors - centroids[model.nearest(vectors, 1)[:, 0]])
    books = np.zeros((parts, CODES, width))
    for part in range(parts):
        book = means(rest[:, part], CODES, seed + part)
        books[part] = book[np.minimum(np.arange(CODES), len(book) - 1)]
    return Model(centroids, books)


class VectorStore:
    """One version of a stored index; see ``create_store`` and ``open_vectors``."""

    def __init__(self, spark: SparkSession, path: str, version: int, model: Model, folders: dict[int, list[int]]):
        self.spark, self.path, self.version, self.model, self.folders = spark, path, version, model, folders

    @property
    def rows(self) -> DataFrame:
        """All stored columns with ``list`` and ``code``, of the lists that count in this version."""
        found = None
        for folder, lists in sorted(self.folders.items()):
            part = self.spark.read.parquet(f"{self.path}/vectors/{folder}").where(F.col("list").isin(lists))
            found = part if found is None else found.unionByName(part, allowMissingColumns=True)
        if found is None:
            raise ValueError("the store is empty: append vectors first")
        return found

    def _saved(self, model: Model, folders: dict[int, list[int]]) -> VectorStore:
        """Write the next version; readers of this one are not disturbed."""
        version = self.version + 1
        centroids = [("centroid", n, c.tolist()) for n, c in enumerate(model.centroids)]
        width = model.codebooks.shape[2]
        books = [("codebook", p, model.codebooks[p].ravel().tolist()) for p in range(len(model.codebooks))]
        listed = [("folder", n, [float(x) for x in lists]) for n, lists in folders.items()]
        rows = [*centroids, *books, *listed, ("width", width, [])]
        frame = self.spark.createDataFrame(rows, "kind string, number int, numbers array<double>")
        frame.coalesce(1).write.parquet(f"{self.path}/versions/version={version}")
        self.spark.range(1).select(F.lit(version).alias("version")).write.mode("append").parquet(f"{self.path}/finished")
        return VectorStore(self.spark, self.path, version, model, folders)

    def _assigned(self, chunks: DataFrame, model: Model, among: np.ndarray | None) -> DataFrame:
        stored = chunks.where("embedding is not null").drop("list", "code")
        place = stored.columns.index("embedding")
        shared = self.spark.sparkContext.broadcast((model, among))

        def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own, some = shared.value
            for batch in batches:
                if not batch.num_rows:
                    continue
                unit = _matrix(batch.column(place), None, own.dims)
                lists = own.nearest(unit, 1, some)[:, 0]
                codes = own.codes(unit - own.centroids[lists])
                columns = [pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(lists, pa.int32())]
                yield pa.RecordBatch.from_arrays([*batch.columns, *columns], names=[*batch.schema.names, "code", "list"])

        more = [T.StructField("code", T.BinaryType()), T.StructField("list", T.IntegerType())]
        return stored.mapInArrow(assign, T.StructType([*stored.schema.fields, *more]))

    def _written(self, rows: DataFrame) -> tuple[int, list[int]]:
        """Write a new folder; its number and the lists that it has rows of."""
        folder = 1 + max(self.folders, default=-1)
        path = f"{self.path}/vectors/{folder}"
        rows.hint("rebalance", "list").write.mode("overwrite").partitionBy("list").parquet(path)
        found = self.spark.read.schema(rows.schema).parquet(path).select("list").distinct().collect()
        return folder, sorted(r.list for r in found)  # as many as there are lists

    def append(self, chunks: DataFrame) -> VectorStore:
        """The next version, with more rows in the existing lists; rows without a vector are left out.

        ``chunks`` has id, embedding and any other columns; ``list`` and ``code`` are replaced.
        """
        folder, lists = self._written(self._assigned(chunks, self.model, None))
        return self._saved(self.model, {**self.folders, folder: lists} if lists else self.folders)

    def sizes(self) -> dict[int, int]:
        """Rows of every list."""
        return {r.list: r["count"] for r in self.rows.groupBy("list").count().collect()}

    def split(self, most: int, seed: int = 42) -> VectorStore:
        """The next version, with every list of more than ``most`` rows cut into several around new centroids.

        Only the rows of those lists are written again. A list of equal vectors stays as it is.
        """
        model, retired, born = self.model, [], []
        for number, count in sorted(self.sizes().items()):
            if count <= most:
                continue
            own = _sampled(self.rows.where(F.col("list") == number).select("id", "embedding"), CODE_ROWS)
            sample = _matrix(own.toArrow()["embedding"].combine_chunks(), None, model.dims)
            children = means(sample, -(-count // most), seed)
            if len(children) > 1:
                retired.append(number)
                first = len(model.centroids)
                born.append(np.arange(first, first + len(children)))
                model = replace(model, centroids=np.concatenate((model.centroids, children)))
        if not retired:
            return self
        parts = [self._assigned(self.rows.where(F.col("list") == n), model, b) for n, b in zip(retired, born)]
        moved = parts[0]
        for part in parts[1:]:
            moved = moved.unionByName(part)
        folder, lists = self._written(moved)
        centroids = model.centroids.copy()
        centroids[retired] = np.nan
        gone = set(retired)
        kept = {f: [x for x in own if x not in gone] for f, own in self.folders.items()}
        return self._saved(
            replace(model, centroids=centroids), {f: own for f, own in kept.items() if own} | {folder: lists}
        )

    def search(
        self, queries: DataFrame, k: int = 5, probes: int = 10, rerank: int = 10, access: bool = False
    ) -> DataFrame:
        """Rows (query_id, id, similarity, rank): the best ``k`` of the ``probes`` lists nearest to each query.

        Codes choose ``rerank`` * k vectors per query, which are then compared exactly. With ``access`` a query's
        user_id must be among the row's permissions. Queries without a vector have no rows; queries
        are taken in blocks of ``QUERY_BLOCK``, each of which reads its lists once.
        """
        asked = written(queries.where("embedding is not null").select("query_id", "embedding", *(["user_id"] if access else [])), "asked")
        blocks = max(1, -(-asked.count() * 5 // (4 * QUERY_BLOCK))) if not fits(asked, QUERY_BLOCK) else 1
        found = None
        for block in range(blocks):
            mine = asked if blocks == 1 else asked.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == block)
            part = self._candidates(mine, k * rerank, probes, access)
            found = part if found is None else found.unionByName(part)
        best = Window.partitionBy("query_id").orderBy(F.desc("similarity"), "id")
        chosen = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k * rerank)
        chosen = written(chosen.select("query_id", "id", "list"), "candidates")
        stored = self.rows.select("id", "list", F.col("embedding").alias("vector"))
        lists = [r.list for r in chosen.select("list").distinct().collect()]
        near = F.broadcast(chosen) if fits(chosen) else chosen
        exact = (
            stored.where(F.col("list").isin(lists)).join(near, ["list", "id"]).join(asked, "query_id")
            .select("query_id", "id", F.round(cosine_similarity(F.col("embedding"), F.col("vector")), DIGITS).alias("similarity"))
        )
        return exact.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)

    def _candidates(self, asked: DataFrame, most: int, probes: int, access: bool) -> DataFrame:
        """The best ``most`` vectors of every task by their codes, with their lists."""
        table = asked.toArrow()
        unit = _matrix(table["embedding"].combine_chunks(), None, self.model.dims)
        probed = self.model.nearest(unit, probes) if len(unit) else np.zeros((0, 1), dtype=np.int64)
        users = table["user_id"].to_pylist() if access else None
        shared = self.spark.sparkContext.broadcast((self.model, table["query_id"].to_pylist(), unit, probed, users))
        stored = self.rows.select("id", "list", "code", *(["permissions"] if access else []))
        stored = stored.where(F.col("list").isin(np.unique(probed).tolist()))
        result = _result_type(asked, stored)
        result.add(T.StructField("list", T.IntegerType()))
        schema = _arrow_type(result)

        def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            model, names, unit, probed, users = shared.value
            best = _Best(len(names), most)
            by_list, by_user = _rows_by(probed), _rows_by(users or [])
            for batch in batches:
                if not batch.num_rows or not names:
                    continue
                ids = np.empty(batch.num_rows, dtype=object)
                lists = batch.column(1).to_numpy()
                ids[:] = list(zip(batch.column(0).to_pylist(), lists.tolist()))
                codes = np.frombuffer(b"".join(batch.column(2).to_pylist()), dtype=np.uint8)
                codes = codes.reshape(batch.num_rows, -1)
                readable = None
                if users is not None:
                    readable = _stored_by(batch.column(3), [u for u in by_user if u is not None])
                for number in np.unique(lists).tolist():
                    rows = np.flatnonzero(lists == number)
                    for q in by_list.get(number, np.zeros(0, dtype=np.int64)).tolist():
                        mine = rows
                        if readable is not None:
                            mine = np.intersect1d(rows, readable.get(users[q], rows[:0]), assume_unique=True)
                        if len(mine):
                            best.add(q, _by_code(model, unit[q], number, codes[mine]), ids[mine])
            columns: list[list] = [[], [], [], []]
            for q, (sims, found) in enumerate(best.found):
                columns[0] += [names[q]] * len(found)
                columns[1] += [i for i, _ in found]
                columns[2] += sims
                columns[3] += [n for _, n in found]
            arrays = [pa.array(c, type=f.type) for c, f in zip(columns, schema)]
            yield pa.RecordBatch.from_arrays(arrays, schema=schema)

        return stored.mapInArrow(compare, result)


def _by_code(model: Model, query: np.ndarray, number: int, codes: np.ndarray) -> np.ndarray:
    """Similarities of a query and the coded vectors of one list."""
    table = np.einsum("pw,pcw->pc", model.split(query[None, :])[0], model.codebooks)
    return np.round(query @ model.centroids[number] + table[np.arange(codes.shape[1]), codes].sum(axis=1), DIGITS)


def create_store(chunks: DataFrame, path: str, lists: int = LISTS, parts: int = PARTS, seed: int = 42) -> VectorStore:
    """Train on the chunks and store them; see ``train`` and ``VectorStore.append``."""
    model = train(chunks, lists, parts, seed)
    return VectorStore(chunks.sparkSession, path, 0, model, {}).append(chunks)


def open_vectors(spark: SparkSession, path: str) -> VectorStore:
    """The newest finished version of the store under ``path``."""
    version = spark.read.parquet(f"{path}/finished").agg(F.max("version")).first()[0]
    rows = spark.read.parquet(f"{path}/versions/version={version}").collect()
    by = {kind: sorted((r.number, r.numbers) for r in rows if r.kind == kind) for kind in ("centroid", "codebook", "folder", "width")}
    books = np.array([n for _, n in by["codebook"]])
    model = Model(np.array([n for _, n in by["centroid"]]), books.reshape(len(books), -1, by["width"][0][0]))
    return VectorStore(spark, path, version, model, {n: [int(x) for x in lists] for n, lists in by["folder"]})
