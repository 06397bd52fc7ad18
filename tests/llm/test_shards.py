"""Sharding: the law, groups, slots, and the placement itself."""

import zlib

import numpy as np
from pyspark.sql import functions as F

from brightwater.llm.shards import place, shard, vector_bin_packing

FOLDER = "/root/testdata/sf0.01"


def slots_are_gapless(rows):
    by_shard = {}
    for r in rows:
        by_shard.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(v) == list(range(len(v))) for v in by_shard.values())


def test_query(spark):
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    rows = vector_bin_packing(spark, FOLDER).collect()
    assert len(rows) == len(docs) and {r.doc_id for r in rows} == set(docs)
    sizes, where = np.zeros(40), {}
    for r in rows:
        data = docs[r.doc_id].encode()
        assert (r["size"], r.text_crc32, r.law, r.grown_shard) == (len(data) + 16, zlib.crc32(data), "bytes", None)
        assert r.tokens == len(docs[r.doc_id].split())
        sizes[r.shard] += r["size"]
        where.setdefault(docs[r.doc_id], set()).add(r.shard)
    slots_are_gapless(rows)
    whole = {t for t in where if sum(len(x.encode()) + 16 for x in docs.values() if x == t) <= sizes.mean()}
    assert all(len(where[t]) == 1 for t in whole) and len(whole) >= len(where) - 5
    assert sizes.max() <= 1.04 * sizes.mean() and sizes.min() >= 0.96 * sizes.mean()


def test_large_groups_are_dealt(spark):
    docs = spark.range(6000).select(
        F.col("id").alias("doc_id"),
        F.when(F.col("id") % 3 == 0, F.lit("the same text " * 9)).otherwise(F.concat(F.lit("t"), F.col("id"))).alias("text"),
    )
    rows = shard(docs, 7).collect()
    slots_are_gapless(rows)
    sizes = np.bincount([r.shard for r in rows], weights=[r["size"] for r in rows], minlength=7)
    assert sizes.max() <= 1.05 * sizes.mean()


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, "a b"), (3, "a b"), (None, "a  b "), (4, "x" * 5000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("size", F.lit("s"))
    got = shard(docs, 3).collect()
    assert sorted((r.doc_id or -1, r["size"], r.tokens) for r in got) == [
        (-1, 21, 2), (1, 16, 0), (2, 16, 0), (3, 19, 2), (3, 19, 2), (4, 5016, 1)
    ]
    where = {r.doc_id: r.shard for r in got}
    assert where[1] == where[2]
    slots_are_gapless(got)
    assert shard(docs.limit(0), 3).collect() == []


def test_place_balances_all_dimensions():
    pick = np.random.default_rng(1)
    items = np.stack([pick.integers(1, 100, 3000), pick.integers(1, 50, 3000), np.ones(3000)], axis=1).astype(float)
    found = place(items, 10)
    for k in range(3):
        load = np.bincount(found, weights=items[:, k], minlength=10)
        assert load.max() < 1.03 * load.mean()
    assert len(place(np.zeros((0, 3)), 4)) == 0
