"""Distributed forms against plain loops on random and skewed data."""

import random
import time
from collections import deque

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from brightwater.functions import chunking
from brightwater.functions.text import word_lists, words
from brightwater.operators import breaker, limiter, retrieval, vector
from brightwater.operators.chunks import chunk_documents
from brightwater.operators.churn_metrics import binary_metrics, optimise_threshold, walk_forward_folds
from brightwater.plans.scratch import scratch_path
from brightwater.plans.skew import numbered


def limited(requests, limit, window):
    held, out = {}, {}
    for row_id, project, user, now in sorted(requests, key=lambda r: (r[3], r[0])):
        queue = held.setdefault((project, user), deque())
        while queue and queue[0] <= now - window:
            queue.popleft()
        if len(queue) < limit:
            out[row_id] = (True, limit - len(queue) - 1, -(-window // 1000))
            queue.append(now)
        else:
            out[row_id] = (False, 0, -(-(queue[0] + window - now) // 1000))
    return out


def request_rows(seed, span):
    """One user holds most rows, some of them in the same millisecond."""
    rng = random.Random(seed)
    rows = []
    for i in range(1500):
        user = "hot" if rng.random() < 0.7 else f"u{rng.randrange(20)}"
        rows.append((i, "p", user, rng.randrange(span) // rng.choice([1, 50, 1000])))
    return rows


@pytest.mark.parametrize("seed, span, limit, window", [(1, 400_000, 5, 3000), (2, 60_000, 3, 7000), (3, 5_000_000, 2, 60_000)])
def test_limiter(spark, seed, span, limit, window):
    rows = request_rows(seed, span)
    df = spark.createDataFrame(rows, "id long, project string, user_id string, ts_ms long")
    got = {
        r.id: (r.allowed, r.remaining, r.reset_in)
        for r in limiter.rate_limit_batch(df, limit, window).collect()
    }
    assert got == limited(rows, limit, window)


def test_requests_in_window(spark):
    rows = request_rows(4, 500_000)
    df = spark.createDataFrame(rows, "id long, project string, user_id string, ts_ms long")
    got = {r.id: r.in_window for r in limiter.requests_in_window(df, 5000, 5000).collect()}
    for row_id, _, user, now in rows:
        assert got[row_id] == sum(1 for r in rows if r[2] == user and now - 5000 < r[3] <= now)


@pytest.mark.parametrize("seed, consecutive", [(1, False), (2, True), (3, False)])
def test_breaker(spark, seed, consecutive):
    rng = random.Random(seed)
    rows = [
        ("hot" if rng.random() < 0.8 else "cold", rng.randrange(100_000), i, rng.random() < 0.55)
        for i in range(2000)
    ]
    df = spark.createDataFrame(rows, "name string, ts_ms long, seq long, success boolean")
    got = breaker.breaker_batch(df, 5, 900, consecutive, slice_ms=2500).collect()
    want, states = [], {}
    for name, now, seq, success in sorted(rows, key=lambda r: (r[1], r[2])):
        before = states.get(name, (0, -1))
        states[name] = breaker.step(before, now, success, 5, 900, consecutive)
        want.extend(breaker.changes(name, now, seq, before, states[name]))
    assert sorted(map(tuple, got)) == sorted(want)
    assert len(want) > 20


def test_breaker_opens_at_five_and_ignores_calls_while_open():
    state, seen = (0, -1), []
    for now in range(6):
        after = breaker.step(state, now, False, 5, 30_000)
        seen.extend(breaker.changes("c", now, now, state, after))
        state = after
    assert seen == [("c", 4, 4, "closed", "open")]
    assert breaker.step(state, 20_000, True, 5, 30_000) == state
    assert breaker.step(state, 40_000, True, 5, 30_000) == (0, -1)


def test_numbering_a_hot_key(spark):
    rows = [("a" if i % 4 else "b", i * 7919 % 10_007) for i in range(3000)]
    df = spark.createDataFrame(rows, "k string, v long")
    got = numbered(df, ["k"], [F.col("v")], [F.floor(F.col("v") / 100)], "n").collect()
    for key in "ab":
        ordered = sorted(v for k, v in rows if k == key)
        assert {(r.v, r.n) for r in got if r.k == key} == {(v, i + 1) for i, v in enumerate(ordered)}


def nearest(queries, stored, k, near=lambda q, i: True):
    out = set()
    for q, (vector_q, user) in queries.items():
        found = []
        for i, (v, readers) in stored.items():
            if user in readers and near(q, i):
                cosine = np.dot(vector_q, v) / (np.linalg.norm(vector_q) * np.linalg.norm(v))
                found.append((-round(float(cosine), 9), i))
        out |= {(q, i, rank + 1) for rank, (_, i) in enumerate(sorted(found)[:k])}
    return out


@pytest.fixture(scope="module")
def vectors():
    rng = np.random.default_rng(7)
    centers = rng.normal(size=(6, 8))
    stored = {}
    for i in range(600):
        # A third of the stored vectors are copies of one.
        v = centers[0] if i % 3 == 0 else centers[i % 6] + rng.normal(scale=0.3, size=8)
        stored[f"c{i:03d}"] = (v, ["u", "w"] if i % 2 else ["w"])
    queries = {
        q: (centers[q % 6] + rng.normal(scale=0.1, size=8), "u" if q % 2 else "w") for q in range(24)
    }
    return queries, stored


@pytest.mark.parametrize("slice_ms", [1000, 4000])
def test_limiter_slices_of_one_busy_user(spark, slice_ms):
    """Long runs cut into slices, with traffic that keeps windows apart and traffic that lets them meet."""
    pick = random.Random(7)
    rows, now = [], 0
    for i in range(3000):
        now += pick.choice([0, 20, 40, 130] if (i // 500) % 2 else [250])
        rows.append((i, "p", pick.choice(["a", "a", "a", "b"]), now))
    frame = spark.createDataFrame(rows, "id long, project string, user_id string, ts_ms long").repartition(3)
    got = limiter.rate_limit_batch(frame, 4, 1000, slice_ms, run_cells=10)
    assert {r.id: (r.allowed, r.remaining, r.reset_in) for r in got.collect()} == limited(rows, 4, 1000)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "slot" in plan


def frames(spark, vectors):
    queries, stored = vectors
    q = spark.createDataFrame(
        [(i, v.tolist(), u) for i, (v, u) in queries.items()],
        "query_id int, embedding array<double>, user_id string",
    )
    c = spark.createDataFrame(
        [(i, v.tolist(), p) for i, (v, p) in stored.items()],
        "id string, embedding array<double>, permissions array<string>",
    )
    return q, c.repartition(5)


@pytest.mark.parametrize("block", [100, 5])
def test_vector_search(spark, vectors, block):
    """Few queries in one block, and more queries than a block holds."""
    q, c = frames(spark, vectors)
    found = vector.vector_topk(q, c, 7, access=True, query_block=block)
    got = {(r.query_id, r.id, r["rank"]) for r in found.collect()}
    assert got == nearest(*vectors, 7)


def test_approximate_search(spark, vectors):
    q, c = frames(spark, vectors)
    want = nearest(*vectors, 5)
    listed, centroids = vector.inverted_lists(c, lists=12)
    for found, least in [
        (vector.ivf_topk(q, listed, centroids, 5, probes=12, access=True), 1.0),
        (vector.ivf_topk(q, listed, centroids, 5, probes=3, access=True), 0.8),
        (vector.lsh_topk(q, c, 5, access=True), 0.9),
        (vector.ivf_topk(q, listed, centroids, 5, probes=3, access=True, query_block=5), 0.8),
        (vector.lsh_topk(q, c, 5, access=True, query_block=5), 0.9),
    ]:
        got = {(r.query_id, r.id, r["rank"]) for r in found.collect()}
        assert len({g[:2] for g in got} & {w[:2] for w in want}) >= least * len(want)


def test_lists_prune_and_full_probes_are_exact(spark, vectors):
    q, c = frames(spark, vectors)
    listed, centroids = vector.inverted_lists(c, lists=12)
    path = scratch_path(spark, "listed")
    listed.write.partitionBy("list").parquet(path)
    stored = spark.read.parquet(path)
    few = vector.ivf_topk(q.limit(1), stored, centroids, 5, probes=2)
    plan = few._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [list#" in plan and " IN (" in plan.split("PartitionFilters")[1][:60]
    exact = vector.vector_topk(q, c, 5)
    every = vector.ivf_topk(q, stored, centroids, 5, probes=12)
    assert sorted(map(tuple, every.collect())) == sorted(map(tuple, exact.collect()))


def test_probed_keys(vectors):
    """Nearest keys first, by brute force over all keys at most two planes away."""
    queries, _ = vectors
    matrix = np.array([v / np.linalg.norm(v) for v, _ in queries.values()])
    planes = vector.hash_directions(matrix.shape[1], tables=3, bits=6)
    along = vector._projections(matrix, planes)
    got = vector._probed_keys(along, 10).reshape(len(matrix), 3, 10)
    for i in range(len(matrix)):
        for t in range(3):
            own = sum(1 << j for j in range(6) if along[i, t, j] >= 0)
            ways = []
            for key in range(64):
                crossed = [j for j in range(6) if (key ^ own) >> j & 1]
                if len(crossed) <= 2:
                    ways.append((round(sum(along[i, t, j] ** 2 for j in crossed), 9), len(crossed), crossed, key))
            assert got[i, t].tolist() == [key + (t << 6) for *_, key in sorted(ways)[:10]]


def test_stored_hash_tables(spark, vectors):
    """Tables stored by key give what the scan gives; one query reads some of their parts."""
    q, c = frames(spark, vectors)
    dims = len(next(iter(vectors[0].values()))[0])
    planes = vector.hash_directions(dims, tables=6, bits=6)
    stored = vector.write_hash_tables(c, planes, scratch_path(spark, "tables"))
    assert stored.count() == 6 * c.count()
    for block in (100, 5):
        scan = vector.lsh_topk(q, c, 5, probes=4, directions=planes, access=True, query_block=block)
        found = vector.lsh_topk(q, stored, 5, probes=4, directions=planes, access=True, query_block=block)
        assert sorted(map(tuple, found.collect())) == sorted(map(tuple, scan.collect()))
    few = vector.lsh_topk(q.limit(1), stored, 5, probes=2, directions=planes)
    plan = few._jdf.queryExecution().executedPlan().toString()
    named = plan.split("PartitionFilters: [part#")[1].split("(")[1].split(")")[0]
    assert len(named.split(",")) < 6 * 8
    met = {r.query_id: r.met for r in vector.lsh_met(q, c, planes, 4).collect()}
    every = vector.lsh_topk(q, c, None, probes=4, directions=planes).groupBy("query_id").count().collect()
    assert met == {r.query_id: r["count"] for r in every}


def test_many_queries(spark):
    """More queries than a block holds: equal to one block, and few of the groups are met."""
    random_ = np.random.default_rng(3)
    centres = random_.standard_normal((12, 8)) * 4
    def cloud(n, seed):
        random_ = np.random.default_rng(seed)
        return [(centres[i % 12] + 0.3 * random_.standard_normal(8)).tolist() for i in range(n)]
    rows = [(f"v{i}", v, ["a"] if i % 2 else ["a", "b"]) for i, v in enumerate(cloud(900, 1))]
    rows += [("zero", [0.0] * 8, ["a"]), ("none", None, ["a"]), ("twin1", rows[0][1], ["b"]), ("twin2", rows[0][1], ["b"])]
    c = spark.createDataFrame(rows, "id string, embedding array<double>, permissions array<string>").repartition(4)
    asked = [(i, v, "ab"[i % 2]) for i, v in enumerate(cloud(10_000, 2))]
    asked += [(20_000, [0.0] * 8, "a"), (20_001, [-x for x in rows[5][1]], "b"), (20_002, None, "a")]
    q = spark.createDataFrame(asked, "query_id int, embedding array<double>, user_id string").repartition(4)
    few = q.where("query_id % 40 = 0 or query_id >= 20000")
    for access in (False, True):
        want = sorted(map(tuple, vector.vector_topk(few, c, 5, access=access).collect()))
        got = vector.vector_topk(q, c, 5, access=access, query_block=1000)
        assert sorted(map(tuple, got.join(few.select("query_id"), "query_id").select("query_id", "id", "similarity", "rank").collect())) == want
    pivots = vector._unit(centres)
    unit = vector._unit(np.array(cloud(600, 4)))
    angles = vector._angles(unit, pivots)
    radius = np.array([angles[angles.argmin(axis=1) == p, p].max() for p in range(12)])
    assert vector._reached(unit, np.full(600, 0.98), pivots, radius).sum() <= 3 * 600
    assert vector._reached(unit, np.full(600, -2.0), pivots, radius).all()


@pytest.mark.parametrize("dims", [2, 5])
def test_pivot_bounds_lose_nothing(dims):
    """No vector around a pivot that is not reached has the similarity."""
    random_ = np.random.default_rng(dims)
    stored, asked = vector._unit(random_.standard_normal((400, dims))), vector._unit(random_.standard_normal((60, dims)))
    pivots = vector._unit(vector.means(stored, 9, 1))
    angles = vector._angles(stored, pivots)
    home = angles.argmin(axis=1)
    radius = np.array([angles[home == p, p].max() if (home == p).any() else -1 for p in range(len(pivots))])
    similar = asked @ stored.T
    floor = np.sort(similar, axis=1)[:, -5]
    reached = vector._reached(asked, floor, pivots, radius)
    assert not (similar >= floor[:, None])[~reached[:, home]].any() and not reached.all()


def test_null_and_ragged_vectors(spark):
    q = spark.createDataFrame([(1, [1.0, 0.0])], "query_id int, embedding array<double>")
    c = spark.createDataFrame([("a", [1.0, 1.0]), ("b", None), ("c", [0.0, 2.0])], "id string, embedding array<double>")
    assert [r.id for r in vector.vector_topk(q, c, 5).orderBy("rank").collect()] == ["a", "c"]
    bad = c.union(spark.createDataFrame([("d", [1.0])], c.schema))
    with pytest.raises(Exception, match="vectors must have 2"):
        vector.vector_topk(q, bad, 5).collect()


def test_all_candidates(spark, vectors):
    q, c = frames(spark, vectors)
    every = vector.vector_topk(q, c, None, access=True)
    queries, stored = vectors
    assert every.count() == sum(u in p for _, u in queries.values() for _, p in stored.values())
    assert every.filter("rank <= 5").count() == vector.vector_topk(q, c, 5, access=True).count()


def letters(texts):
    """A custom encoder: letter counts."""
    return np.array([[(t or "").count(x) for x in "abc"] for t in texts], dtype=float)


def test_custom_encoder(spark):
    chunks = spark.createDataFrame(
        [(i, "n", t, ["u"]) for i, t in enumerate(["aaa", "abab", "ccc", "bbb a"])],
        "id int, doc_name string, chunk_text string, permissions array<string>",
    )
    queries = spark.createDataFrame([(1, "aab", "u")], "query_id int, text string, user_id string")
    ranked = retrieval.rank_by_similarity(queries, chunks, 4, embed_fn=letters).orderBy("rank").collect()
    assert [r.id for r in ranked] == [1, 0, 3, 2]
    assert retrieval.hybrid_retrieve(queries, chunks, 2, embed_fn=letters).count() == 2
    asked = spark.createDataFrame([(1, 7, "ccc")], "query_id int, doc_id int, question string")
    text = spark.createDataFrame([(7, "aaa bbb ccc abc")], "doc_id int, text string")
    found = retrieval.top_chunks_in_doc(asked, text, 1, n_words=1, embed_fn=letters).collect()
    assert [r.chunk_text for r in found] == ["ccc"]


def sentence_chunks(text, size, overlap):
    import re

    sentences = re.findall(r"[^.!?]+[.!?]+", text) or [text]
    chunks, current = [], ""
    for sentence in sentences:
        if len(current) + len(sentence) <= size:
            current += sentence
        else:
            if current:
                chunks.append(current.strip())
            current = sentence
    if current:
        chunks.append(current.strip())
    for i in range(1, len(chunks)):
        if overlap:
            chunks[i] = chunks[i - 1][-overlap:] + " " + chunks[i]
    return [c for c in chunks if c]


def test_chunkers_on_random_texts(spark):
    rng = random.Random(5)
    texts = [
        "".join(rng.choice("ab c.!?\n é") for _ in range(rng.randrange(1, 400))) for _ in range(200)
    ]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    cut = df.select(
        "doc_id",
        chunking.chunk_sentence(F.col("text"), 40, 7).alias("sentence"),
        chunking.chunk_fixed(F.col("text"), 40, 7).alias("fixed"),
        chunking.chunk_paragraph(F.col("text"), 40, 7).alias("paragraph"),
        chunking.chunk_words(F.col("text"), 6).alias("words"),
    ).collect()
    for row in cut:
        text = texts[row.doc_id]
        assert row.sentence == sentence_chunks(text, 40, 7)
        assert all(c in text and len(c) <= 40 for c in row.fixed)
        assert row.fixed[0] + "".join(c[7:] for c in row.fixed[1:]) == text
        assert " ".join(row.words) == " ".join(text.split())
        # Size, the uncounted blank line, and the overlap with its blank.
        assert all(len(c) <= 40 + 2 + 7 + 1 for c in row.paragraph)
    ids = chunk_documents(df, "fixed", size=40, overlap=7).select("id")
    assert ids.count() == ids.distinct().count() == sum(len(r.fixed) for r in cut)


def test_metrics_against_pairs(spark):
    rng = random.Random(9)
    rows = [(int(rng.random() < 0.4), round(rng.random(), 2)) for _ in range(400)]
    df = spark.createDataFrame(rows, "y int, p double")
    got = binary_metrics(df, 0.5).first()
    pos, neg = [p for y, p in rows if y], [p for y, p in rows if not y]
    auc = sum((a > b) + (a == b) / 2 for a in pos for b in neg) / (len(pos) * len(neg))
    assert got.auc == pytest.approx(auc, abs=1e-4)
    assert got.brier == pytest.approx(sum((y - p) ** 2 for y, p in rows) / len(rows), abs=1e-4)
    assert (got.tp, got.fp) == (sum(p >= 0.5 for p in pos), sum(p >= 0.5 for p in neg))

    best = max(
        ((lambda t: (2 * sum(p >= t for p in pos) / (sum(p >= t for _, p in rows) + len(pos)), -t))(0.1 + i * ((0.9 - 0.1) / 160)))
        for i in range(161)
    )
    chosen = optimise_threshold(df).first()
    assert (chosen.f1, chosen.threshold) == (pytest.approx(best[0]), pytest.approx(-best[1]))


def test_folds(spark):
    df = spark.range(703).select("id", (F.col("id") * 31 % 73).alias("tenure"))
    rows = walk_forward_folds(df, "tenure", "id", key_slice=100).collect()
    assert sorted(r.position for r in rows) == list(range(703))
    size = 703 // 7
    for fold in range(1, 7):
        train = {r.position for r in rows if r.train_from is not None and r.train_from <= fold}
        test = {r.position for r in rows if r.test_fold == fold}
        assert train == set(range((fold + 1) * size))
        assert test == set(range((fold + 1) * size, min((fold + 2) * size, 703)))


def test_substring_frequencies_look_up_parts_of_words(spark):
    """No text is compared with every term; few and many terms give what plain containment gives."""
    texts = ["The cat sat", "concat CATS  dog", "", None, "doé éclair cat-like", "dogma"]
    readers = [["a"], ["a", "b", "a"], ["b"], ["a"], ["b", None], None]
    rows = [(str(i), t, p) for i, (t, p) in enumerate(zip(texts, readers))]
    chunks = spark.createDataFrame(rows, "id string, chunk_text string, permissions array<string>")
    asked = [(1, "a", "cat s dog"), (2, "b", " É cat do "), (3, "c", "cat")]
    queries = spark.createDataFrame(asked, "query_id long, user_id string, text string")
    want = {}
    for _, user, text in asked:
        for term in set(" ".join(text.lower().split(" ")).split(" ")):
            n = sum(user in (p or []) and t is not None and term in t.lower() for _, t, p in rows)
            if n:
                want[user, term] = n
    for bounded in (None, True, False):
        found = retrieval.doc_freq(chunks, queries, "substring", bounded)
        assert {(r.user_id, r.term): r.df for r in found.collect()} == want
        assert "contains(" not in found._jdf.queryExecution().optimizedPlan().toString().lower()


def test_chunks_are_scored_where_they_are_read(spark):
    """No shuffle holds a row per chunk and query or per occurrence, and the pruned ranks are those of all scores."""
    rng = random.Random(3)
    words = [f"w{i}" for i in range(12)]
    rows = [(str(i), " ".join(rng.choices(words, k=rng.randint(0, 9))), rng.sample(["a", "b", "c"], 2)) for i in range(400)]
    chunks = spark.createDataFrame(rows, "id string, chunk_text string, permissions array<string>").repartition(3)
    asked = [(q, "abd"[q % 3], " ".join(rng.choices(words, k=4))) for q in range(9)]
    queries = spark.createDataFrame(asked, "query_id long, user_id string, text string")
    index = retrieval.keyword_index(chunks, queries)
    scored = retrieval.bm25_score(queries, chunks, index=index)
    assert "Exchange" not in scored._jdf.queryExecution().executedPlan().toString()
    made = retrieval.postings(chunks, retrieval.query_terms(queries))._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" not in made
    every = {}
    for r in scored.collect():
        every.setdefault(r.query_id, []).append((-r.score, r.id))
    best = retrieval.rank_by_keyword(queries, chunks, 5, index=index).collect()
    want = {(q, at + 1, id, -s) for q, found in every.items() for at, (s, id) in enumerate(sorted(found)[:5])}
    assert {(r.query_id, r.rank, r.id, r.score) for r in best} == want and len(want) == 30


def test_many_terms_are_scored_as_few(spark, monkeypatch):
    """Terms too many to hold are joined instead, with the same scores."""
    rows = [(str(i), text, ["a", "b"][: 1 + i % 2]) for i, text in enumerate(["x y", "y y z", "z", "x x x", "q"] * 3)]
    chunks = spark.createDataFrame(rows, "id string, chunk_text string, permissions array<string>")
    queries = spark.createDataFrame([(1, "a", "x y"), (2, "b", "z y y")], "query_id long, user_id string, text string")

    def scores():
        found = [retrieval.bm25_score(queries, chunks, unmatched=every) for every in (False, True)]
        return [set(map(tuple, df.select("query_id", "id", "score").collect())) for df in found]

    few = scores()
    monkeypatch.setattr(retrieval, "fits", lambda *_: False)
    assert scores() == few and few[0] < few[1]


def test_unmatched_chunks_come_with_the_scores(spark):
    """Ranking every readable chunk shuffles its pairs once, for the ranks."""
    rows = [(str(i), text, ["a", "b"][: 1 + i % 2]) for i, text in enumerate(["x y", "y y z", "z", "", "q"] * 3)]
    chunks = spark.createDataFrame(rows, "id string, chunk_text string, permissions array<string>")
    queries = spark.createDataFrame([(1, "a", "x y"), (2, "b", "z"), (3, "a", "")], "query_id long, user_id string, text string")
    ranked = retrieval.rank_by_keyword(queries, chunks, None, unmatched=True)
    plan = ranked._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.count("Exchange") == 1
    matched = {(r.query_id, r.id): r.score for r in retrieval.bm25_score(queries, chunks).collect()}
    want = {(q, id, matched.get((q, id), 0.0)) for q, user, _ in queries.collect() for id, _, p in rows if user in p}
    assert {(r.query_id, r.id, r.score) for r in ranked.collect()} == want


def test_dense_and_sparse_sums_agree(spark, monkeypatch):
    texts = [" ".join(f"w{(n * k) % 23}" for k in range(1, n % 12)) for n in range(300)]
    rows = [(str(n), None if n % 50 == 7 else [f"u{n % 3}", f"u{n % 2}"], t) for n, t in enumerate(texts)]
    parts = spark.createDataFrame(rows, "id string, permissions array<string>, chunk_text string")
    asked = [(n, f"u{n % 3}", f"w{n} w{n + 1} w1 w1 zz") for n in range(20)]
    queries = spark.createDataFrame(asked, "query_id int, user_id string, text string")
    index = retrieval.keyword_index(parts, queries)
    for pairs in (50, retrieval.SCORED_PAIRS):
        for unmatched in (False, True):
            found = []
            for dense in (0, 10**9):
                monkeypatch.setattr(retrieval, "DENSE", dense)
                monkeypatch.setattr(retrieval, "SCORED_PAIRS", pairs)
                scored = retrieval.bm25_score(queries, parts, index=index, unmatched=unmatched).collect()
                found.append(sorted(map(tuple, scored)))
            assert found[0] == found[1] and len(found[0]) == len({f[:2] for f in found[0]}) > 0
    counts = {(r.user_id, r.term): r.df for r in retrieval.doc_freq(parts, queries, index=index).collect()}
    users = {u: {t for q, v, text in asked if v == u for t in text.split()} for _, u, _ in asked}
    wanted = {}
    for _, readers, text in rows:
        for u in set(readers or []):
            for term in set(text.split()) & users.get(u, set()):
                wanted[u, term] = wanted.get((u, term), 0) + 1
    assert counts == wanted


def test_vectors_are_compared_in_pieces(spark, monkeypatch):
    seen, encode = [], vector.hash_encoder(16)
    batch = pa.RecordBatch.from_arrays([pa.array([str(n) for n in range(50)])] * 2, names=["id", "vector"])
    block = vector._Block(ids=[1, 2], matrix=encode(["17", "40"]))
    monkeypatch.setattr(vector, "COMPARED_ROWS", 7)
    best = vector._scan([batch], block, 1, lambda texts: seen.append(len(texts)) or encode(texts), False)
    assert max(seen) == 7 and sum(seen) == 50
    assert [ids for _, ids in best.found] == [["17"], ["40"]]


def test_whole_numbers_point_like_the_embedding(spark):
    from brightwater.functions.vectors import cosine_similarity, hash_embed, hash_sums

    df = spark.createDataFrame([("some text \U0001F600",), ("x" * 900,), ("",), (None,)], "text string")
    rows = df.select(
        F.size(hash_sums(F.col("text"), 64)).alias("n"), hash_sums(F.col("text"), 64).alias("whole"), hash_embed(F.col("text"), 64).alias("unit"), "text"
    ).withColumn("cos", cosine_similarity(F.col("whole"), F.col("unit"))).collect()
    assert all(r.n == 64 for r in rows)
    assert [round(r.cos, 12) for r in rows] == [1.0, 1.0, 0.0, 0.0]
    assert sum(rows[1].whole) == 900 * ord("x")


def test_fixed_chunks_of_a_long_text_cost_one_pass(spark):
    text = "".join(random.Random(4).choices("ab é\n😀", k=200)) * 20_000
    started = time.monotonic()
    rows = spark.createDataFrame([(text,)], "t string").select(F.explode(chunking.chunk_fixed(F.col("t")))).collect()
    assert time.monotonic() - started < 30
    starts = range(0, len(text) - 64, 448)
    assert [r[0] for r in rows] == [text[at : at + 512] for at in starts]
    short = spark.createDataFrame([(w,) for w in ("", "a", "é\n😀b", "abcdefg")], "t string")
    for size, overlap in ((1, 0), (3, 2), (4, 1), (5, 0)):
        for r in short.select("t", chunking.chunk_fixed(F.col("t"), size, overlap).alias("c")).collect():
            last = max(0, -(-(len(r.t) - size) // (size - overlap)))
            assert r.c == [r.t[i * (size - overlap) :][:size] for i in range(last + 1) if r.t]


def test_words_are_cut_in_the_task_as_by_the_column(spark):
    rng = random.Random(5)
    parts = [*" \t\n\x0b\x85\x1c", *map(chr, [0xA0, 0xC2, 0x1680, 0x2003, 0x200B, 0x2014, 0x202F, 0x3000, 0xFEFF]), "a", "é", "😀"]
    texts = [None, "", " ", *("".join(rng.choices(parts, k=rng.randrange(12))) for _ in range(3000))]
    rows = spark.createDataFrame(list(enumerate(texts)), "n int, t string").coalesce(1)
    want = [r.w or [] for r in rows.select(words(F.col("t")).alias("w")).collect()]
    assert word_lists(pa.array(texts)).to_pylist() == want
    assert word_lists(pa.array(texts).slice(7, 500)).to_pylist() == want[7:507]
    assert word_lists(pa.array([], pa.string())).to_pylist() == []
    chunks = rows.select(F.col("n").alias("id"), F.array(F.lit("u")).alias("permissions"), F.col("t").alias("chunk_text"))
    found = retrieval.postings(chunks, spark.createDataFrame([("é",), ("a",)], "term string"))
    assert "split(" not in found._jdf.queryExecution().optimizedPlan().toString()
    got = {r.id: (r.dl, {f.term: f.tf for f in r.found}) for r in found.collect()}
    assert got == {
        at: (None if texts[at] is None else len(ws), {w: ws.count(w) for w in ("é", "a") if w in ws})
        for at, ws in enumerate([r.w or [] for r in rows.select(words(F.lower("t")).alias("w")).collect()])
    }
