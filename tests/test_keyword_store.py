"""The stored inverted index: equal to a scan of the texts, also with bounds, segments and odd rows."""

import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from brightwater.operators import keyword_store, retrieval
from brightwater.plans.scratch import scratch_path

WORDS = [f"t{i}" for i in range(40)]


def corpus(spark, seed=3, n=260):
    random.seed(seed)
    rows = []
    for k in range(n):
        topic = (k // 20) % 7
        words = [random.choice(WORDS[topic * 5 : topic * 5 + 8]) for _ in range(random.randint(0, 40))]
        text = None if k % 41 == 0 else " ".join(words) + random.choice(["", "  ", "\n", " The of"])
        readers = random.choice([["a"], ["a", "b"], ["b", "a", "b"], [], None, ["c"]])
        rows.append((f"c{k:03d}", text, readers, f"doc{k}", 1, 2))
    columns = "id string, chunk_text string, permissions array<string>, doc_name string, bucket int, part int"
    return spark.createDataFrame(rows, columns).repartition(3)


def questions(spark):
    random.seed(8)
    rows = [(i, random.choice("abz"), " ".join(random.choice(WORDS + ["the", "unknown"]) for _ in range(random.randint(1, 5)))) for i in range(25)]
    rows += [(90, "a", ""), (91, None, "t1 t2"), (92, "a", "the of"), (93, "b", "t1 T1 t1")]
    return spark.createDataFrame(rows, "query_id int, user_id string, text string")


def told(df):
    return sorted((r.query_id, r["rank"], r.id, round(r.score, 6)) for r in df.collect())


@pytest.fixture(scope="module")
def store(spark):
    chunks = corpus(spark)
    made = keyword_store.write_store(chunks.where("id < 'c150'"), scratch_path(spark, "store"), buckets=3, zone_rows=8)
    made.append(chunks.where("id >= 'c150'").select("part", "doc_name", "id", "permissions", "chunk_text", "bucket"))
    return keyword_store.open_store(spark, made.path)


@pytest.mark.parametrize("options", [{}, {"match_all": True}, {"unmatched": True}, {"stats": "global"}, {"candidates": 2}, {"candidates": None}])
def test_equals_scan(spark, store, options):
    q = questions(spark)
    chunks = corpus(spark).withColumn("permissions", F.coalesce("permissions", F.array().cast("array<string>")))
    chunks = chunks.fillna({"chunk_text": ""})
    want = told(retrieval.rank_by_keyword(q, chunks, **options))
    assert len(want) > 20
    for bounds in (True, None):
        assert told(store.rank(q, bounds=bounds, **options)) == want


def test_counts(spark, store):
    q, chunks = questions(spark), corpus(spark).where("permissions is not null and chunk_text is not null")
    terms = retrieval.query_terms(q)
    got = store.frequencies(terms)
    want = retrieval.doc_freq(chunks, q)
    mine = got.join(terms.select("user_id", "term").distinct(), ["user_id", "term"])
    assert sorted(map(tuple, mine.select("user_id", "term", "df").collect())) == sorted(map(tuple, want.collect()))
    every = {r.user_id: r.n_docs for r in store.sizes().collect()}
    assert every[None] == corpus(spark).count() and every["c"] == corpus(spark).where("array_contains(permissions, 'c')").count()


def test_bounds_leave_zones_out(spark, monkeypatch):
    """A rare term leads to few zones, although the other term is everywhere."""
    rows = [(f"c{k:04d}", "common " * 9 + (f"rare{k % 500} " * 3 if k % 8 == 0 else "other"), ["a"], "d") for k in range(4000)]
    chunks = spark.createDataFrame(rows, "id string, chunk_text string, permissions array<string>, doc_name string")
    made = keyword_store.write_store(chunks, scratch_path(spark, "store"), buckets=4, zone_rows=16)
    q = spark.createDataFrame([(1, "a", "common rare8"), (2, "a", "rare16")], "query_id int, user_id string, text string")
    weights = made._weights(q, "permitted")
    every = made.zone_bounds(weights).groupBy("query_id").count().collect()
    kept = made._promising(weights, 3, 1.5, 0.75, None).select(F.explode("asked").alias("q")).groupBy("q").count().collect()
    assert dict(every)[1] >= 240 and dict(kept)[1] <= 12
    assert not made._worth(weights, 1, 1.5, 0.75, None)  # the terms are too few for a look
    monkeypatch.setattr(keyword_store, "DIRECT", 10)
    monkeypatch.setattr(keyword_store, "LOOKED_AT", 2)
    assert made._worth(weights, 1, 1.5, 0.75, None)
    assert told(made.rank(q, 1)) == told(made.rank(q, 1, bounds=False))
    assert told(made.rank(q, 3, bounds=True)) == told(retrieval.rank_by_keyword(q, chunks, 3))


def test_searches_read_no_text(spark, store):
    q = questions(spark)
    weights = store._weights(q, "permitted")
    for found in (store._scored(weights, None, 1.5, 0.75, None), store.zone_bounds(weights), store.rank(q)):
        plan = found._jdf.queryExecution().toString().split("Physical Plan")[1]
        assert "chunk_text" not in plan and plan.count("Scan") >= 1
    scored = store._scored(weights, None, 1.5, 0.75, None)._jdf.queryExecution().toString()
    assert "In(bucket" in scored  # row groups of other buckets are skipped


def test_zones_are_scored_and_cut_in_their_task(spark, store, monkeypatch):
    weights = store._weights(questions(spark), "permitted")
    told = lambda df: {(r.query_id, r.zone, r.slot): round(r.score, 8) for r in df.collect()}
    few, cut = (store._scored(weights, None, 1.5, 0.75, None, n) for n in (None, 2))
    assert "FlatMapGroupsInArrow" in few._jdf.queryExecution().toString()
    zones = store.zone_bounds(weights).groupBy("zone").agg(F.collect_set("query_id").alias("asked"))
    asked = store._scored(weights, zones, 1.5, 0.75, None)
    entries = [line for line in asked._jdf.queryExecution().optimizedPlan().toString().split("\n") if "FlatMapGroups" in line]
    assert entries and "asked" not in entries[0]  # blocks do not carry the queries that ask for their zone
    assert told(asked) == told(few)
    few, cut = told(few), told(cut)
    monkeypatch.setattr(keyword_store, "fits", lambda *a, **k: False)
    assert few == told(store._scored(weights, None, 1.5, 0.75, None)) and few
    best = lambda rows, q: sorted((s for k, s in rows.items() if k[0] == q), reverse=True)[:2]
    assert all(best(cut, q) == best(few, q) for q in {k[0] for k in few}) and cut.items() < few.items()


def test_hybrid(spark, store):
    q = questions(spark).where("user_id is not null and query_id < 90")
    chunks = corpus(spark).where("permissions is not null and chunk_text is not null")
    whole = keyword_store.write_store(chunks, scratch_path(spark, "store"), buckets=2)
    key = lambda r: (r.query_id, r["rank"], r.id, round(r.rrf_score, 9), r.doc_name, r.chunk_text)
    want = sorted(map(key, retrieval.hybrid_retrieve(q, chunks, 4).collect()))
    assert sorted(map(key, whole.hybrid(q, 4).collect())) == want and want


def test_segments(spark):
    chunks = corpus(spark, n=30)
    path = scratch_path(spark, "store")
    made = keyword_store.write_store(chunks, path, buckets=2)
    half = made._folder("chunks", 1)
    chunks.write.parquet(half)  # a segment that was never finished
    assert keyword_store.open_store(spark, path).chunks.count() == 30
    assert keyword_store.open_store(spark, path).append(chunks.limit(0)).chunks.count() == 30
    empty = keyword_store.write_store(chunks.limit(0), scratch_path(spark, "store"))
    assert empty.rank(questions(spark)).collect() == [] and empty.chunks.count() == 0


def test_runs_are_bounded_by_tokens(monkeypatch):
    monkeypatch.setattr(keyword_store, "RUN_ROWS", 60)
    monkeypatch.setattr(keyword_store, "RUN_TOKENS", 1000)

    def batches():
        for rows in (5, 0, 700, 300, 1):
            tokens = pa.array([["a"] * (n % 40) for n in range(rows)], pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([pa.array(range(rows), pa.int64()), tokens], names=["slot", "tokens"])

    runs = list(keyword_store._runs(batches()))
    assert [v for run in runs for v in run["slot"].to_pylist()] == [*range(5), *range(700), *range(300), 0]
    assert max(run.num_rows for run in runs) <= 60
    assert max(sum(map(len, run["tokens"].to_pylist())) for run in runs) < 1000 + 40
