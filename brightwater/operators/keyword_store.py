"""A stored inverted index over chunks: built once, appended to, and searched without reading a text.

Chunks are written with their length and a zone, ``zone_rows`` neighbouring chunks. A posting block holds the
occurrences of one term in the chunks of a zone that have the same readers, with the largest term frequency and the
shortest chunk among them, which bound what any of its chunks can score. A task makes the blocks of the chunks it
reads, in runs sorted by bucket, a hash of the term, so that a search skips what lies between the buckets of its terms;
nothing is shuffled. Counts, bounds and readers are columns beside the occurrences, so that a search can read
them alone; document frequencies are sums of them.

A search whose terms occur in many chunks adds up the bounds of each zone, scores the most promising zones, and takes
the k-th best score found there as a threshold. Zones whose bound is below it cannot hold a better chunk
and are left out. Results are those of a full scan.

Layout: ``chunks``, ``blocks`` and ``sizes`` have one folder a segment; ``segments`` lists the finished segments
and is written last, so that a reader never sees half of one.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema, to_arrow_type

from brightwater.functions.text import STOP_WORDS, word_lists
from brightwater.operators import retrieval
from brightwater.operators.vector import DIGITS
from brightwater.plans.scratch import written
from brightwater.plans.skew import BROADCAST_ROWS, fits

ZONE_ROWS = 512
#: Zones of a query that are scored to find its threshold.
SEEDS = 3
#: Sums of bounds and of scores may differ by rounding; a zone this close to the threshold is scored.
SLACK = 1e-6
#: Occurrences that are scored at once, without a threshold: finding one would cost more.
DIRECT = 20_000_000
#: One zone in so many is looked at to see whether bounds leave enough out, and the share of zones they may keep.
LOOKED_AT, WORTH = 64, 0.3

#: Chunks in one sorted run of blocks, and the tokens after which a run ends with the chunk that it is in.
RUN_ROWS, RUN_TOKENS = 32_768, 1_000_000

_SEGMENT_BITS = 48
_BLOCK = (
    "bucket int, term string, zone long, permissions array<string>, n long, max_tf int, min_dl int,"
    " entries array<struct<slot: int, dl: int, tf: int>>"
)
_COLUMNS = {"blocks": f"{_BLOCK}, segment int", "sizes": "user_id string, n_docs long, total long, segment int"}


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Runs of whole chunks, bounded by rows and by tokens, whatever sizes the batches have."""
    held, rows, tokens = [], 0, 0
    for batch in batches:
        many = pc.list_value_length(batch.column("tokens")).fill_null(0).to_numpy().astype(np.int64)
        ends, start = np.cumsum(many), 0
        while start < batch.num_rows:
            before = ends[start - 1] if start else 0
            # the chunk that passes the bound is the run's last
            full = int(np.searchsorted(ends, before + RUN_TOKENS - tokens)) + 1
            stop = min(batch.num_rows, full, start + RUN_ROWS - rows)
            held.append(batch.slice(start, stop - start))
            rows, tokens, start = rows + stop - start, tokens + int(ends[stop - 1] - before), stop
            if rows >= RUN_ROWS or tokens >= RUN_TOKENS:
                yield pa.Table.from_batches(held).combine_chunks()
                held, rows, tokens = [], 0, 0
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _one(table: pa.Table, name: str) -> pa.Array:
    chunks = table[name].chunks
    return chunks[0] if len(chunks) == 1 else pa.concat_arrays(chunks)


def _blocks_of(run: pa.Table, buckets: int) -> pa.RecordBatch | None:
    """The blocks of a run of chunks (zone, slot, permissions, dl, tokens), sorted by bucket and term."""
    tokens, rows = _one(run, "tokens"), run.num_rows
    found = tokens.flatten().dictionary_encode()
    terms = found.dictionary
    if not len(terms):
        return None
    dealt = np.array([zlib.crc32(t) % buckets for t in terms.cast(pa.binary()).to_pylist()], dtype=np.int32)
    ordered = pc.sort_indices(pa.table({"b": dealt, "t": terms}), [("b", "ascending"), ("t", "ascending")]).to_numpy()
    place = np.empty(len(terms), dtype=np.int64)
    place[ordered] = np.arange(len(terms))
    owner = np.repeat(np.arange(rows), np.asarray(pc.list_value_length(tokens)))
    # chunks of one zone with the same readers
    permissions = _one(run, "permissions")
    same = pc.binary_join(permissions, "\x00").dictionary_encode().indices.to_numpy().astype(np.int64)
    zone = _one(run, "zone").to_numpy()
    kinds, group = np.unique(np.stack((zone, same)), axis=1, return_inverse=True)
    group = group.reshape(-1)
    example = np.zeros(kinds.shape[1], dtype=np.int64)
    example[group[::-1]] = np.arange(rows)[::-1]
    key = (place[found.indices.to_numpy()] * len(example) + group[owner]) * rows + owner
    key, tf = np.unique(key, return_counts=True)
    owner, key = key % rows, key // rows
    starts = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    which, term = key[starts] % len(example), ordered[key[starts] // len(example)]
    dl, tf = _one(run, "dl").to_numpy()[owner], tf.astype(np.int32)
    entries = pa.StructArray.from_arrays(
        [pa.array(v, pa.int32()) for v in (_one(run, "slot").to_numpy()[owner], dl, tf)], names=["slot", "dl", "tf"]
    )
    ends = np.append(starts, len(key))
    return pa.RecordBatch.from_arrays(
        [
            pa.array(dealt[term], pa.int32()),
            terms.take(pa.array(term)),
            pa.array(zone[example[which]], pa.int64()),
            permissions.take(pa.array(example[which])),
            pa.array(np.diff(ends), pa.int64()),
            pa.array(np.maximum.reduceat(tf, starts), pa.int32()),
            pa.array(np.minimum.reduceat(dl, starts), pa.int32()),
            pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), entries),
        ],
        names=["bucket", "term", "zone", "permissions", "n", "max_tf", "min_dl", "entries"],
    )


@F.arrow_udf(T.IntegerType())
def _n_tokens(texts: pa.Array) -> pa.Array:
    return word_lists(texts).value_lengths()


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches with the tokens of their texts, which are the last column."""
    for batch in batches:
        columns = [*batch.columns[:-1], word_lists(batch.columns[-1])]
        yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names[:-1], "tokens"])


def _made(buckets: int):
    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for run in _runs(_cut(batches)):
            blocks = _blocks_of(run, buckets)
            for a in range(0, 0 if blocks is None else blocks.num_rows, 1 << 16):
                yield blocks.slice(a, 1 << 16)

    return make


def _scores_of_zone(weights: list, k1: float, b: float, candidates: int | None, result: T.StructType):
    """Scores of the chunks of a zone, from its blocks (zone, term, permissions, entries)."""
    score = retrieval._chunk_scores(weights, [], to_arrow_type(result["query_id"].dataType), k1, b, candidates)
    schema = to_arrow_schema(result)

    def scores(blocks: pa.Table) -> pa.Table:
        entries = _one(blocks, "entries")
        held = entries.flatten()
        block = np.repeat(np.arange(blocks.num_rows), entries.value_lengths().to_numpy())
        slot = held.field("slot").to_numpy()
        order = np.argsort(slot, kind="stable")
        block, slot = block[order], slot[order]
        starts = np.flatnonzero(np.append(True, slot[1:] != slot[:-1]))
        found = pa.StructArray.from_arrays(
            [_one(blocks, "term").take(pa.array(block)), held.field("tf").take(pa.array(order))], names=["term", "tf"]
        )
        chunks = pa.RecordBatch.from_arrays(
            [
                pa.array(slot[starts]),
                _one(blocks, "permissions").take(pa.array(block[starts])),
                held.field("dl").take(pa.array(order[starts])),
                pa.ListArray.from_arrays(pa.array(np.append(starts, len(slot)).astype(np.int32)), found),
            ],
            names=["id", "permissions", "dl", "found"],
        )
        zone = blocks["zone"][0]
        parts = [
            pa.RecordBatch.from_arrays([p[0], pa.repeat(zone, p.num_rows), p[1], p[2]], schema=schema)
            for p in score(iter([chunks]))
        ]
        return pa.Table.from_batches(parts, schema)

    return scores


def _readers() -> Column:
    """Everybody who may read a chunk, and null for all of them together."""
    return F.array_append("permissions", F.lit(None).cast("string"))


def _saturated(tf: Column, dl: Column, k1: float, b: float) -> Column:
    return tf * (k1 + 1) / (tf + k1 * (1 - b + b * (dl / F.col("avg_dl"))))


class KeywordStore:
    """A stored index; see ``write_store`` and ``open_store``."""

    def __init__(self, spark: SparkSession, path: str, buckets: int, zone_rows: int, segments: list[int]):
        self.spark, self.path, self.buckets, self.zone_rows, self.segments = spark, path, buckets, zone_rows, segments

    def _folder(self, name: str, segment: int) -> str:
        return f"{self.path}/{name}/segment={segment}"

    def _read(self, name: str) -> DataFrame:
        if not self.segments:
            raise ValueError("the store is empty: append chunks first")
        folders = [self._folder(name, s) for s in self.segments]
        reader = self.spark.read.option("basePath", f"{self.path}/{name}")
        if name != "chunks":
            reader = reader.schema(self._schema(name))
        return reader.parquet(*folders).drop("segment")

    def _schema(self, name: str) -> T.StructType:
        """Columns of a derived table; an empty segment has no file that would tell."""
        return T.StructType.fromDDL(_COLUMNS[name])

    def _bucket(self, term: Column) -> Column:
        return F.pmod(F.crc32(term.cast("binary")), F.lit(self.buckets)).cast("int").alias("bucket")

    def _of_terms(self, name: str, terms: DataFrame) -> DataFrame:
        """Stored rows of the buckets that the terms are in."""
        found = terms.select(self._bucket(F.col("term"))).distinct().collect()
        return self._read(name).where(F.col("bucket").isin(sorted(r.bucket for r in found)))

    @property
    def chunks(self) -> DataFrame:
        """The stored chunks, with ``dl`` (length in tokens), ``zone`` and ``slot``, their place in it."""
        return self._read("chunks")

    def append(self, chunks: DataFrame) -> KeywordStore:
        """Add chunks as a new segment; the store with it.

        ``chunks`` has id (new and unique), chunk_text, permissions and any other columns, the same in every
        segment. A null text has no tokens; null permissions are nobody's.
        """
        segment = 1 + max(self.segments, default=-1)
        lowered = F.lower("chunk_text")
        base = F.lit(segment << _SEGMENT_BITS).cast("long")
        number = F.monotonically_increasing_id()
        zone = base + F.floor(number / self.zone_rows)
        slot = (number % self.zone_rows).cast("int")
        readers = F.array_sort(F.array_distinct(F.coalesce("permissions", F.array().cast("array<string>"))))
        ready = chunks.withColumns({"permissions": readers, "dl": _n_tokens(lowered), "zone": zone, "slot": slot})
        ready.write.mode("overwrite").option("compression", "zstd").parquet(self._folder("chunks", segment))
        stored = self.spark.read.schema(ready.schema).parquet(self._folder("chunks", segment))

        (
            stored.select("zone", "slot", "permissions", "dl", lowered)
            .mapInArrow(_made(self.buckets), _BLOCK)
            .write.mode("overwrite")
            .option("compression", "zstd")
            .parquet(self._folder("blocks", segment))
        )
        (
            stored.select("dl", F.explode(_readers()).alias("user_id"))
            .groupBy("user_id")
            .agg(F.count(F.lit(1)).alias("n_docs"), F.sum("dl").alias("total"))
            .write.mode("overwrite")
            .parquet(self._folder("sizes", segment))
        )
        done = self.spark.range(1).select(
            F.lit(segment).alias("segment"), F.lit(self.buckets).alias("buckets"), F.lit(self.zone_rows).alias("zone_rows")
        )
        done.write.mode("append").parquet(f"{self.path}/segments")
        return KeywordStore(self.spark, self.path, self.buckets, self.zone_rows, [*self.segments, segment])

    def sizes(self) -> DataFrame:
        """Per reader the chunks and their average length; a null reader stands for all chunks."""
        summed = self._read("sizes").groupBy("user_id").agg(F.sum("n_docs").alias("n_docs"), F.sum("total").alias("total"))
        return summed.select("user_id", "n_docs", (F.col("total") / F.col("n_docs")).alias("avg_dl"))

    def frequencies(self, terms: DataFrame) -> DataFrame:
        """Chunks per reader and term for the given terms; a null reader stands for all chunks."""
        asked = terms.select("term").distinct()
        near = F.broadcast(asked) if fits(asked) else asked
        counted = self._of_terms("blocks", asked).select("term", "permissions", "n").join(near, "term")
        return (
            counted.select("term", "n", F.explode(_readers()).alias("user_id"))
            .groupBy("user_id", "term")
            .agg(F.sum("n").alias("df"))
        )

    def _weights(self, queries: DataFrame, stats: str) -> DataFrame:
        terms = retrieval.query_terms(queries)
        reader = F.col("user_id") if stats == "permitted" else F.lit(None).cast("string")
        terms = terms.withColumn("reader", reader)
        frequencies = self.frequencies(terms).withColumnRenamed("user_id", "of")
        sizes = self.sizes().withColumnRenamed("user_id", "whose")
        n, df = F.col("n_docs"), F.col("df")
        found = (
            terms.join(frequencies.withColumnRenamed("term", "word"), (F.col("term") == F.col("word")) & F.col("reader").eqNullSafe(F.col("of")))
            .join(sizes, F.col("reader").eqNullSafe(F.col("whose")))
            .select(
                "query_id", "user_id", "term", self._bucket(F.col("term")), "avg_dl", "df",
                (F.col("qtf") * F.ln((n - df + 0.5) / (df + 0.5) + 1)).alias("weight"),
            )
        )
        return written(found, "weights")

    def _blocks(
        self, weights: DataFrame, few: bool, columns: list[str], zones: DataFrame | None = None, one_in: int = 1
    ) -> DataFrame:
        """Blocks of the queries' terms.

        ``zones`` (zone, asked) says which queries a zone matters to; by default all. ``one_in`` looks at that part
        of the zones only.
        """
        terms = weights.select("bucket", "term").distinct()
        blocks = self._of_terms("blocks", weights).select("bucket", "term", "zone", "permissions", *columns)
        if one_in > 1:
            blocks = blocks.where(F.pmod(F.xxhash64("zone"), F.lit(one_in)) == 0)
        blocks = blocks.join(F.broadcast(terms) if few else terms, ["bucket", "term"], "left_semi")
        return blocks if zones is None else blocks.join(zones, "zone")

    def _met(
        self, weights: DataFrame, columns: list[str], zones: DataFrame | None = None, one_in: int = 1
    ) -> DataFrame:
        """``_blocks`` beside each query that may read them, zone by zone in one task."""
        few = fits(weights)
        near = F.broadcast(weights) if few else weights
        blocks = self._blocks(weights, few, columns, zones, one_in)
        if few:  # blocks are sent to their zone once, not once for every query
            met = blocks.repartition("zone").join(near, ["bucket", "term"])
        else:
            met = blocks.join(near, ["bucket", "term"]).repartition("zone")
        readable = F.array_contains("permissions", F.col("user_id"))
        if zones is not None:
            readable = readable & F.array_contains("asked", F.col("query_id"))
        return met.where(readable)

    def zone_bounds(
        self, weights: DataFrame, k1: float = retrieval.K1, b: float = retrieval.B, one_in: int = 1
    ) -> DataFrame:
        """Rows (query_id, zone, bound): what a chunk of the zone that the user may read can score at most."""
        most = F.col("weight") * _saturated(F.col("max_tf"), F.col("min_dl"), k1, b)
        return (
            self._met(weights, ["max_tf", "min_dl"], one_in=one_in)
            .groupBy("zone", "query_id", "term")
            .agg(F.max(most).alias("most"))
            .groupBy("zone", "query_id")
            .agg(F.sum("most").alias("bound"))
        )

    def _scored(
        self,
        weights: DataFrame,
        zones: DataFrame | None,
        k1: float,
        b: float,
        needed: DataFrame | None,
        candidates: int | None = None,
    ) -> DataFrame:
        """Scores of the chunks of the given zones, or of all.

        With ``candidates`` those may be left out that are not among so many best of their zone for a query.
        """
        if needed is None and fits(weights):  # the task that has a zone's blocks scores its chunks
            types = [weights.schema["query_id"].dataType, T.LongType(), T.IntegerType(), T.DoubleType()]
            names = ["query_id", "zone", "slot", "score"]
            result = T.StructType([T.StructField(n, t) for n, t in zip(names, types)])
            scores = _scores_of_zone(weights.drop("bucket", "df").collect(), k1, b, candidates, result)
            blocks = self._blocks(weights, True, ["entries"]).drop("bucket")
            if zones is not None:  # a zone's scores for other queries than ask for it are as right, and cheaper than to say who asks
                blocks = blocks.join(zones.select("zone"), "zone", "left_semi")
            found = blocks.groupBy("zone").applyInArrow(scores, result)
            return found.withColumn("score", F.round("score", DIGITS))
        opened = self._met(weights, ["entries"], zones).select(
            "query_id", "zone", "term", "weight", "avg_dl", F.inline("entries")
        )
        score = F.round(F.sum(F.col("weight") * _saturated(F.col("tf"), F.col("dl"), k1, b)), DIGITS)
        # a chunk's occurrences are in one zone, so this needs no further shuffle
        scored = opened.groupBy("zone", "query_id", "slot")
        if needed is None:
            return scored.agg(score.alias("score"))
        have = F.count(F.when(~F.col("term").isin(STOP_WORDS), 1))
        full = scored.agg(score.alias("score"), have.alias("have")).join(needed, "query_id")
        return full.where(F.col("have") == F.col("needed")).select("zone", "query_id", "slot", "score")

    def _named(self, scored: DataFrame, few: bool) -> DataFrame:
        """Scores by the chunks' ids instead of their places."""
        places = self.chunks.select("zone", "slot", "id")
        found = places.join(F.broadcast(scored) if few else scored, ["zone", "slot"])
        return found.select("query_id", "id", "score")

    def _best_named(self, scored: DataFrame, candidates: int) -> DataFrame:
        """The best chunks by score, then id; ids are looked up for those in question, ties included."""
        order = Window.partitionBy("query_id").orderBy(F.desc("score"))
        first = scored.withColumn("place", F.rank().over(order)).where(F.col("place") <= candidates).drop("place")
        found = written(first, "best")
        return retrieval._best(self._named(found, fits(found)), "score", candidates)

    def rank(
        self,
        queries: DataFrame,
        candidates: int | None = 10,
        match_all: bool = False,
        unmatched: bool = False,
        k1: float = retrieval.K1,
        b: float = retrieval.B,
        stats: str = "permitted",
        bounds: bool | None = None,
    ) -> DataFrame:
        """The best ``candidates`` chunks per query by BM25, as ``retrieval.rank_by_keyword`` ranks them.

        ``bounds`` says whether zones below the threshold are left out; the result is the same. By default they are if the
        queries' terms occur more than ``DIRECT`` times and a look at some zones shows that most can be left out.
        ``queries`` has query_id, user_id and text. With ``candidates`` None every chunk that shares a term is returned,
        with ``unmatched`` also the others that the user may read, at score 0; both give a row for every such pair.
        """
        if stats not in ("permitted", "global"):
            raise ValueError("stats is 'permitted' or 'global'")
        if match_all and unmatched:
            raise ValueError("match_all leaves no unmatched chunks")
        weights = self._weights(queries, stats)
        needed = _needed(queries) if match_all else None
        zones = None
        if candidates is not None and not unmatched and bounds is not False:
            if bounds or self._worth(weights, candidates, k1, b, needed):
                zones = self._promising(weights, candidates, k1, b, needed)
        scored = self._scored(weights, zones, k1, b, needed, None if unmatched else candidates)
        if candidates is not None and not unmatched:
            return self._best_named(scored, candidates)
        scored = self._named(scored, False)
        if unmatched:
            askers = queries.select("query_id", "user_id")
            few = F.broadcast(askers) if fits(askers) else askers
            readable = retrieval.permission_filter(self.chunks.select("id", "permissions"), askers)
            scored = (
                readable.join(few, "user_id").select("query_id", "id")
                .join(scored, ["query_id", "id"], "left").fillna(0.0, ["score"])
            )
        return retrieval._best(scored, "score", candidates)

    def _worth(self, weights, candidates, k1, b, needed) -> bool:
        """Whether finding a threshold costs less than it saves; the threshold of a few zones is lower, so rather not."""
        if (weights.agg(F.sum("df")).first()[0] or 0) <= DIRECT:
            return False
        some = written(self.zone_bounds(weights, k1, b, LOOKED_AT), "looked-at")
        kept = self._above(some, weights, candidates, k1, b, needed).count()
        return kept <= WORTH * some.count()

    def _above(self, zones, weights, candidates, k1, b, needed) -> DataFrame:
        """The zones whose bound reaches the k-th best score of the most promising ones."""
        order = Window.partitionBy("query_id").orderBy(F.desc("bound"), "zone")
        seeds = zones.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= SEEDS)
        best = Window.partitionBy("query_id").orderBy(F.desc("score"))
        scored = self._scored(weights, _by_zone(seeds), k1, b, needed, candidates).withColumn("nth", F.row_number().over(best))
        floor = scored.where(F.col("nth") == candidates).select("query_id", F.col("score").alias("floor"))
        near = F.broadcast(floor) if fits(weights) else floor
        kept = zones.join(near, "query_id", "left").where(
            F.col("floor").isNull() | (F.col("bound") + SLACK >= F.col("floor"))
        )
        return kept.drop("floor")

    def _promising(self, weights, candidates, k1, b, needed) -> DataFrame:
        """Zones that may hold one of the best chunks, with the queries that they matter to."""
        zones = written(self.zone_bounds(weights, k1, b), "zones")
        return written(_by_zone(self._above(zones, weights, candidates, k1, b, needed)), "promising")

    def hybrid(
        self, queries: DataFrame, top_k: int = 5, candidates: int | None = None, match_all: bool = False, dims: int = 768,
        embed_fn=None,
    ) -> DataFrame:
        """``retrieval.hybrid_retrieve`` from the store: both arms and the texts come from stored columns.

        Chunks stored with ``embedding`` are not embedded again.
        """
        n = 2 * top_k if candidates is None else candidates
        lists = [
            retrieval.rank_by_similarity(queries, self.chunks, n, dims, embed_fn),
            self.rank(queries, n, match_all),
        ]
        found = retrieval.rrf_topk(lists, top_k).select("query_id", "id", "rank", "rrf_score")
        few = fits(queries, BROADCAST_ROWS // top_k)
        return retrieval.rehydrate_chunks(found, self.chunks.select("id", "doc_name", "chunk_text"), few)


def _by_zone(zones: DataFrame) -> DataFrame:
    return zones.groupBy("zone").agg(F.collect_set("query_id").alias("asked"))


def _needed(queries: DataFrame) -> DataFrame:
    """How many different terms that are no stop words a chunk must have."""
    terms = retrieval.query_terms(queries).where(~F.col("term").isin(STOP_WORDS))
    return terms.groupBy("query_id").agg(F.count(F.lit(1)).alias("needed"))


def write_store(chunks: DataFrame, path: str, buckets: int | None = None, zone_rows: int = ZONE_ROWS) -> KeywordStore:
    """A new store of the chunks under ``path``; see ``KeywordStore.append`` for their columns.

    ``buckets`` defaults to the session's number of shuffle partitions; a large corpus wants as many as a bucket's
    blocks are to be read at once.
    """
    spark = chunks.sparkSession
    count = int(spark.conf.get("spark.sql.shuffle.partitions")) if buckets is None else buckets
    return KeywordStore(spark, path, count, zone_rows, []).append(chunks)


def open_store(spark: SparkSession, path: str) -> KeywordStore:
    """The store under ``path`` with its finished segments."""
    kind = T.StructType([T.StructField(n, T.IntegerType()) for n in ("segment", "buckets", "zone_rows")])
    rows = spark.read.schema(kind).parquet(f"{path}/segments").distinct().collect()
    return KeywordStore(spark, path, rows[0].buckets, rows[0].zone_rows, sorted(r.segment for r in rows))
