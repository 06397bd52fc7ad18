"""Jaccard self-join of texts on word shingles, by MinHash banding with exact verification.

1. Every text becomes a set of word shingles. Texts with equal sets form a class, whose smallest row
   represents it; only representatives go on.
2. Band and row counts are chosen for the wanted recall at the threshold. Representatives meet by
   band hash. Inside a bucket, pairs whose set sizes or signatures rule out the threshold (at the same
   recall) are left; what remains is kept as a spanning forest, not as pairs.
3. Connected candidates are verified on their full shingle sets, each text being sent once per block of
   its group. A block gives the number of links per representative and a spanning forest of the links.

Large buckets and groups are compared in bounded blocks (every two blocks meet in one task), so no
task holds a whole group and pairs are never rows of a plan.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brightwater.llm.components import components
from brightwater.llm.frames import (
    ROW,
    byte_list,
    group_starts,
    identified,
    registered,
    table,
    whole_groups,
)
from brightwater.llm.hashing import constants, mix, text_shingles
from brightwater.plans.scratch import written

WORDS = 5
THRESHOLD = 0.8
RECALL = 0.9999
#: Signatures have at most this many hashes.
MAX_HASHES = 100
#: Representatives of one bucket, or of one candidate group, that a block holds.
BUCKET_BLOCK = 512
GROUP_BLOCK = 256


def banding(threshold: float, recall: float, max_hashes: int = MAX_HASHES) -> tuple[int, int, int]:
    """(bands, rows, agreeing): the most selective choice whose misses stay within 1 - recall.

    Half of the allowed misses goes to the bands, half to ``agreeing``, the least number of equal
    hashes of a pair that is worth verifying.
    """
    miss = (1 - recall) / 2
    best = None
    for rows in range(1, 17):
        bands = max(1, math.ceil(math.log(miss) / math.log1p(-(threshold**rows)))) if threshold < 1 else 1
        if bands * rows <= max_hashes:
            best = bands, rows
    if best is None:
        raise ValueError("no banding reaches this recall within max_hashes")
    hashes = best[0] * best[1]
    below, agreeing = 0.0, 0
    while agreeing < hashes:
        below += math.comb(hashes, agreeing) * threshold**agreeing * (1 - threshold) ** (hashes - agreeing)
        if below > miss:
            break
        agreeing += 1
    return best[0], best[1], agreeing


def signature(shingles: np.ndarray, hashes: int) -> np.ndarray:
    """MinHash values (32 bits each) of a non-empty set of shingle hashes."""
    factors, shifts = constants(hashes, 5) | np.uint64(1), constants(hashes, 6)
    least = np.full(hashes, np.iinfo(np.uint64).max, dtype=np.uint64)
    for a in range(0, len(shingles), 256):
        np.minimum(least, ((shingles[a : a + 256, None] ^ shifts) * factors).min(axis=0), out=least)
    return (least >> np.uint64(32)).astype(np.uint32)


def _sketches(n: int, hashes: int):
    def run(batches):
        with np.errstate(over="ignore"):
            for batch in batches:
                count = batch.num_rows
                sizes = np.zeros(count, np.int64)
                keys = np.zeros((2, count), np.uint64)
                signatures: list[bytes | None] = [None] * count
                for row, found in text_shingles(batch.column(1), n):
                    if len(found):
                        sizes[row] = len(found)
                        keys[0, row] = found.sum(dtype=np.uint64)
                        keys[1, row] = mix(found ^ np.uint64(0x5DEECE66D)).sum(dtype=np.uint64)
                        signatures[row] = signature(found, hashes).tobytes()
                yield pa.record_batch(
                    {
                        ROW: batch.column(0),
                        "n": pa.array(sizes),
                        "k1": pa.array(keys[0].view(np.int64)),
                        "k2": pa.array(keys[1].view(np.int64)),
                        "signature": pa.array(signatures, pa.binary()),
                    }
                )

    return run


def _matrix(column, hashes: int) -> np.ndarray:
    return np.frombuffer(b"".join(byte_list(column)), dtype=np.uint32).reshape(-1, hashes)


def _band_keys(bands: int, rows: int):
    def run(batches):
        with np.errstate(over="ignore"):
            for batch in batches:
                if not batch.num_rows:
                    continue
                parts = _matrix(batch.column(1), bands * rows).reshape(-1, bands, rows).astype(np.uint64)
                keys = np.broadcast_to(constants(bands, 9), parts.shape[:2]).copy()
                for k in range(rows):
                    keys = mix(keys ^ parts[:, :, k])
                yield pa.record_batch(
                    {
                        "key": pa.array(keys.view(np.int64).ravel()),
                        "rep": pa.array(np.repeat(batch.column(0).to_numpy(), bands)),
                    }
                )

    return run


def _forest(adjacent: np.ndarray) -> list[tuple[int, int]]:
    """(smallest index of the component, index) for every linked index of a boolean matrix."""
    count = len(adjacent)
    todo = adjacent.any(axis=1)
    out = []
    for root in range(count):
        if not todo[root]:
            continue
        seen = np.zeros(count, dtype=bool)
        seen[root] = True
        edge = seen
        while edge.any():
            edge = adjacent[edge].any(axis=0) & ~seen
            seen |= edge
        todo &= ~seen
        out += [(root, k) for k in np.flatnonzero(seen).tolist() if k != root]
    return out


def _size_ratio(sizes: np.ndarray, threshold: float) -> np.ndarray:
    small, large = np.minimum.outer(sizes, sizes), np.maximum.outer(sizes, sizes)
    return small >= threshold * large - 1e-9


def _candidates(hashes: int, agreeing: int, threshold: float):
    """Spanning forests of the pairs in each block pair of a bucket that may reach the threshold."""

    def work(found: pa.Table):
        starts = group_starts(found, ["key", "x", "y"])
        reps, sizes = found["rep"].to_numpy(), found["n"].to_numpy()
        signatures = _matrix(found["signature"].combine_chunks(), hashes)
        counts = np.diff(starts)
        two = starts[:-1][counts == 2]
        fits = (signatures[two] == signatures[two + 1]).sum(axis=1) >= agreeing
        fits &= np.minimum(sizes[two], sizes[two + 1]) >= threshold * np.maximum(sizes[two], sizes[two + 1]) - 1e-9
        left, right = [reps[two[fits]]], [reps[two[fits] + 1]]
        for g in np.flatnonzero(counts > 2).tolist():
            a, b = starts[g], starts[g + 1]
            own = signatures[a:b]
            equal = np.zeros((b - a, b - a), dtype=np.uint8 if hashes < 256 else np.int32)
            for k in range(hashes):
                equal += own[:, k, None] == own[None, :, k]
            linked = (equal >= agreeing) & _size_ratio(sizes[a:b], threshold)
            np.fill_diagonal(linked, False)
            pairs = np.array(_forest(linked), dtype=np.int64).reshape(-1, 2)
            left.append(reps[a:b][pairs[:, 0]])
            right.append(reps[a:b][pairs[:, 1]])
        left, right = np.concatenate(left), np.concatenate(right)
        return pa.record_batch({"a": pa.array(np.minimum(left, right)), "b": pa.array(np.maximum(left, right))})

    def run(batches):
        for found in whole_groups(batches, ["key", "x", "y"]):
            yield work(found)

    return run


def _packed(batches):
    packer = zstandard.ZstdCompressor(level=3, write_content_size=True)
    for batch in batches:
        texts = [packer.compress(t) for t in byte_list(batch.column(1))]
        yield pa.record_batch({"rep": batch.column(0), "packed": pa.array(texts, pa.binary())})


def shared_counts(sets: list[np.ndarray], slice_bits: int = 1 << 16) -> np.ndarray:
    """Sizes of all intersections of the given sorted sets, by bit vectors over shared elements."""
    count = len(sets)
    owner = np.repeat(np.arange(count), [len(s) for s in sets])
    values, place, seen = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    number = np.cumsum(seen > 1) - 1
    shared = seen[place] > 1
    owner, place = owner[shared], number[place[shared]]
    total = np.zeros((count, count), dtype=np.int32)
    width = int(number[-1]) + 1 if len(number) else 0
    for a in range(0, width, slice_bits):
        here = (place >= a) & (place < a + slice_bits)
        span = min(slice_bits, width - a)
        bits = np.zeros((count, -(-span // 64) * 64), dtype=bool)
        bits[owner[here], place[here] - a] = True
        words = np.packbits(bits, axis=1).view(np.uint64)
        for k in range(count):
            total[k, k:] += np.bitwise_count(words[k] & words[k:]).sum(axis=1, dtype=np.int32)
    return total + np.triu(total, 1).T


def _verified(n: int, threshold: float):
    """Links inside each block pair: per representative their number, and a spanning forest."""

    def work(found: pa.Table):
        unpack = zstandard.ZstdDecompressor()
        texts = pa.array([unpack.decompress(p) for p in byte_list(found["packed"].combine_chunks())], pa.binary())
        sets = [s for _, s in text_shingles(texts.cast(pa.string()), n)]
        starts = group_starts(found, ["root", "x", "y"])
        reps, copies = found["rep"].to_numpy(), found["copies"].to_numpy()
        block, x, y = found["block"].to_numpy(), found["x"].to_numpy(), found["y"].to_numpy()
        out_a, out_b, out_links, out_sets = [], [], [], []
        for a, b in zip(starts[:-1].tolist(), starts[1:].tolist()):
            own = sets[a:b]
            sizes = np.array([len(s) for s in own])
            if b - a == 2:
                both = len(np.intersect1d(own[0], own[1], assume_unique=True))
                shared = np.array([[sizes[0], both], [both, sizes[1]]])
            else:
                shared = shared_counts(own)
            union = np.add.outer(sizes, sizes) - shared
            linked = shared / np.maximum(union, 1) >= threshold
            np.fill_diagonal(linked, False)
            if x[a] != y[a]:  # pairs of one block are counted where the block meets itself
                linked &= block[a:b, None] != block[None, a:b]
            degree = linked.sum(axis=1)
            some = np.flatnonzero(degree)
            out_a += reps[a:b][some].tolist()
            out_b += [None] * len(some)
            out_links += (linked[some] @ copies[a:b]).tolist()
            out_sets += degree[some].tolist()
            for p, q in _forest(linked):
                out_a.append(int(reps[a + p]))
                out_b.append(int(reps[a + q]))
                out_links.append(None)
                out_sets.append(None)
        return pa.record_batch(
            {
                "a": pa.array(out_a, pa.int64()),
                "b": pa.array(out_b, pa.int64()),
                "links": pa.array(out_links, pa.int64()),
                "sets": pa.array(out_sets, pa.int64()),
            }
        )

    def run(batches):
        with np.errstate(over="ignore"):
            for found in whole_groups(batches, ["root", "x", "y"], least=64):
                yield work(found)

    return run


def _block_pairs(df: DataFrame, member: str, count: str, most: int, *columns: str) -> DataFrame:
    """Deal members of a group to blocks of about ``most`` and copy each to all pairs of its block."""
    blocks = F.ceil(F.col(count) / F.lit(most)).cast("int")
    dealt = df.withColumn("blocks", blocks).withColumn(
        "block", F.pmod(F.xxhash64(member), F.col("blocks")).cast("int")
    )
    met = dealt.withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)")))
    return met.select(
        *columns, "block", F.least("block", "other").alias("x"), F.greatest("block", "other").alias("y")
    )


def similar_texts(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    words: int = WORDS,
    threshold: float = THRESHOLD,
    recall: float = RECALL,
    max_hashes: int = MAX_HASHES,
    bucket_block: int = BUCKET_BLOCK,
    group_block: int = GROUP_BLOCK,
) -> DataFrame:
    """Texts linked by a Jaccard similarity of their word shingles of at least ``threshold``.

    One row per text: (key, class_id, set_id, n_links, n_linked_sets, n_shingles). ``set_id`` is the
    smallest key with the same shingle set, ``class_id`` the smallest key of the connected component of
    links, ``n_links`` counts the other texts linked to this one (copies included), ``n_linked_sets`` the
    different sets among them. Words are runs of letters, digits, marks and underscores, lower-cased (hashing.word_hashes);
    a text of fewer than ``words`` words has one shingle. Links are verified exactly; a pair at the
    threshold is found with probability ``recall`` at least, closer pairs with more.

    Null and empty texts, and texts without words, are linked to nothing. Rows with a null or repeated
    key are texts of their own, ordered with null keys last (their ids are then those keys). Other
    columns are not read; an empty table gives an empty result.
    """
    source = identified(docs, key, text=F.col(text))
    bands, rows, agreeing = banding(threshold, recall, max_hashes)
    hashes = bands * rows
    sketches = written(
        source.rows.select(ROW, "text").mapInArrow(
            _sketches(words, hashes), f"{ROW} long, n long, k1 long, k2 long, signature binary"
        ),
        "sketches",
    )
    firsts = written(
        sketches.where("n > 0").groupBy("k1", "k2").agg(F.min(ROW).alias("rep"), F.count("*").alias("copies")),
        "classes",
    )
    reps = written(
        sketches.select(F.col(ROW).alias("rep"), "n", "signature").join(firsts.select("rep", "copies"), "rep"),
        "representatives",
    )
    banded = reps.select("rep", "signature").mapInArrow(_band_keys(bands, rows), "key long, rep long")
    buckets = written(banded.groupBy("key").agg(F.count("*").alias("size")).where("size > 1"), "buckets")
    met = _block_pairs(banded.join(buckets, "key"), "rep", "size", bucket_block, "key", "rep")
    likely = (
        met.join(reps.select("rep", "n", "signature"), "rep")
        .repartition("key", "x", "y")
        .sortWithinPartitions("key", "x", "y")
        .select("key", "x", "y", "rep", "n", "signature")
        .mapInArrow(_candidates(hashes, agreeing, threshold), "a long, b long")
    )
    groups = components(likely)
    sizes = groups.groupBy("root").agg(F.count("*").alias("size"))
    members = written(
        groups.join(sizes, "root").select(F.col("node").alias("rep"), "root", "size").join(
            firsts.select("rep", "copies"), "rep"
        ),
        "members",
    )
    packed = source.rows.select(ROW, "text").mapInArrow(_packed, "rep long, packed binary")
    links = written(
        _block_pairs(members.join(packed, "rep"), "rep", "size", group_block, "root", "rep", "copies", "packed")
        .repartition("root", "x", "y")
        .sortWithinPartitions("root", "x", "y")
        .select("root", "x", "y", "block", "rep", "copies", "packed")
        .mapInArrow(_verified(words, threshold), "a long, b long, links long, sets long"),
        "links",
    )
    classes = components(links.where("b is not null")).select(F.col("node").alias("rep"), "root")
    counts = (
        links.where("b is null")
        .groupBy(F.col("a").alias("rep"))
        .agg(F.sum("links").alias("links"), F.sum("sets").alias("sets"))
    )
    known = written(firsts.join(classes, "rep", "left").join(counts, "rep", "left"), "linked")
    has = F.col("n") > 0
    result = (
        sketches.select(ROW, "n", F.when(has, F.col("k1")).alias("k1"), F.when(has, F.col("k2")).alias("k2"))
        .join(known, ["k1", "k2"], "left")
        .select(
            ROW,
            F.coalesce("root", "rep", ROW).alias("class_id"),
            F.coalesce("rep", ROW).alias("set_id"),
            (F.coalesce("links", F.lit(0)) + F.coalesce(F.col("copies") - 1, F.lit(0))).alias("n_links"),
            F.coalesce("sets", F.lit(0)).cast("long").alias("n_linked_sets"),
            F.col("n").alias("n_shingles"),
        )
    )
    named = source.key_of(source.key_of(result, "class_id"), "set_id")
    return source.restore(named)


@registered("op7_ngram_jaccard_join")
def ngram_jaccard_join(spark, folder):
    """Every document with its class of near duplicates and its number of links."""
    return similar_texts(table(spark, folder, "documents"))
