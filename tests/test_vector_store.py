"""Stored vectors: training, codes, appends, splits, versions, pruning and odd rows."""

import numpy as np
import pytest

from brightwater.operators import vector, vector_store
from brightwater.plans.scratch import scratch_path

DIMS = 12


def points(seed, n, groups=6):
    random = np.random.default_rng(seed)
    centres = random.standard_normal((groups, DIMS))
    return [(centres[i % groups] + 0.4 * random.standard_normal(DIMS)).tolist() for i in range(n)]


def chunks(spark, vectors, first=0):
    rows = [(f"v{first + i:04d}", v, ["a"] if i % 3 else ["a", "b"], i, 7) for i, v in enumerate(vectors)]
    return spark.createDataFrame(rows, "id string, embedding array<double>, permissions array<string>, version int, code int").repartition(3)


def questions(spark):
    rows = [(i, v, "a" if i % 2 else "b") for i, v in enumerate(points(9, 15))]
    rows.append((99, None, "a"))
    return spark.createDataFrame(rows, "query_id int, embedding array<double>, user_id string")


def told(df):
    return sorted((r.query_id, r["rank"], r.id, round(r.similarity, 8)) for r in df.collect())


@pytest.fixture(scope="module")
def stored(spark):
    return vector_store.create_store(chunks(spark, points(1, 300)), scratch_path(spark, "v"), lists=8, parts=5)


def test_means():
    random = np.random.default_rng(2)
    cloud = np.concatenate([random.standard_normal((50, 3)) * 0.01 + c for c in ([0, 0, 9], [5, 0, 0], [0, 7, 0])])
    found = vector.means(cloud, 6, 1)
    near = np.sqrt(((cloud[:, None] - found[None]) ** 2).sum(axis=2)).min(axis=1)
    assert len(found) == 6 and near.max() < 8 and np.median(near) < 0.1
    assert vector.means(np.ones((5, 2)), 3, 1).tolist() == [[1, 1]]


def test_codes_keep_the_order_nearly(stored):
    unit = np.array(points(1, 300))
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    model = stored.model
    lists = model.nearest(unit, 1)[:, 0]
    codes = model.codes(unit - model.centroids[lists])
    for number in np.unique(lists):
        mine = np.flatnonzero(lists == number)
        guess = vector_store._by_code(model, unit[0], number, codes[mine])
        assert np.abs(guess - unit[mine] @ unit[0]).mean() < 0.03


def test_full_search_is_exact(spark, stored):
    q = questions(spark)
    for access in (False, True):
        want = told(vector.vector_topk(q, chunks(spark, points(1, 300)), 7, access=access))
        assert told(stored.search(q, 7, probes=8, rerank=50, access=access)) == want
    few = told(stored.search(q, 7, probes=3, rerank=4))
    exact = {w[::2] for w in told(vector.vector_topk(q, chunks(spark, points(1, 300)), 7))}
    assert len({f[::2] for f in few} & exact) >= 0.9 * len(exact)


def test_append_and_split(spark, stored):
    more = points(4, 200) + [points(5, 1)[0]] * 90
    before = sorted(r.id for r in stored.rows.select("id").collect())
    grown = stored.append(chunks(spark, more, first=1000))
    assert sorted(r.id for r in stored.rows.select("id").collect()) == before  # readers of the old version
    opened = vector_store.open_vectors(spark, stored.path)
    assert (opened.version, opened.folders) == (grown.version, grown.folders)
    assert np.array_equal(opened.model.codebooks, grown.model.codebooks)
    every = chunks(spark, points(1, 300)).union(chunks(spark, more, first=1000))
    names = sorted(r.id for r in every.select("id").collect())
    split = opened.split(60)
    assert sorted(r.id for r in split.rows.select("id").collect()) == names
    assert max(opened.sizes().values()) > max(split.sizes().values())
    untouched = {n for n, size in opened.sizes().items() if size <= 60}
    assert untouched <= set(split.sizes()) and len(split.model.centroids) > 8
    assert sorted(split.folders[0]) == sorted(set(opened.folders[0]) & untouched)
    again = vector_store.open_vectors(spark, stored.path)
    q = questions(spark)
    want = told(vector.vector_topk(q, every, 7))
    assert told(again.search(q, 7, probes=100, rerank=100)) == want
    equal = again.split(40).split(40).split(40)  # equal vectors cannot be told apart
    assert max(equal.sizes().values()) >= 90 and sorted(r.id for r in equal.rows.select("id").collect()) == names


def test_only_probed_lists_are_read(spark, stored):
    found = stored._candidates(questions(spark).where("query_id = 3").select("query_id", "embedding"), 5, 2, False)
    plan = found._jdf.queryExecution().executedPlan().toString()
    scan = plan[plan.index("FileScan") :]
    assert "list#" in scan.split("PartitionFilters")[1][:200] and "embedding" not in scan.split("ReadSchema")[1]
    named = scan.split(" IN (")[-1].split(")")[0]
    assert len(named.split(",")) == 2


def test_odd_rows(spark):
    rows = [("a", [1.0, 0.0], None), ("a", [1.0, 0.0], ["x"]), ("z", [0.0, 0.0], ["x"]), ("n", None, ["x"]), (None, [0.5, 0.5], ["x"])]
    some = spark.createDataFrame(rows, "id string, embedding array<double>, permissions array<string>")
    store = vector_store.create_store(some, scratch_path(spark, "v"), lists=2, parts=3)
    assert store.rows.count() == 4
    q = spark.createDataFrame([(1, [1.0, 0.1], "x")], "query_id int, embedding array<double>, user_id string")
    ranked = [(r.id, round(r.similarity, 3)) for r in store.search(q, 2, probes=9, access=True).orderBy("rank").collect()]
    assert ranked[0] == ("a", 0.995)
    assert store.search(q.limit(0)).collect() == []
    assert store.append(some.limit(0)).rows.count() == 4
    with pytest.raises(ValueError):
        vector_store.create_store(some.where("embedding is null"), scratch_path(spark, "v"))
