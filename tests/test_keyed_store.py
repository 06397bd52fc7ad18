"""A table in key buckets: changes rewrite the touched ones, versions stay whole."""

import random

import pytest
from pyspark.sql import functions as F

from brightwater.operators import keyed_store, tables
from brightwater.plans.scratch import scratch_path

COLUMNS = "k long, name string, status string, at long"


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def some(spark, keys, at):
    return spark.createDataFrame([(k, f"n{k}", random.choice(["a", None]), at + i) for i, k in enumerate(keys)], COLUMNS)


@pytest.fixture
def store(spark):
    random.seed(1)
    return keyed_store.create_keyed(some(spark, range(400), 0), scratch_path(spark, "keyed"), ["k"], buckets=20)


def test_changes_equal_the_table_functions(spark, store):
    base = store.rows.cache()
    random.seed(2)
    updates = some(spark, [random.randrange(450) for _ in range(60)], 1000)
    assert rows_of(store.upsert(updates, "at").rows) == rows_of(tables.upsert_latest(base, updates, ["k"], "at"))
    keyed = keyed_store.create_keyed(base, scratch_path(spark, "keyed"), ["k"], buckets=7)
    changed = keyed.update(updates, ["name", "status"], "at", "at")
    assert rows_of(changed.rows) == rows_of(tables.partial_update(base, updates, ["k"], ["name", "status"], "at", "at"))
    more = changed.insert_new(updates, "at")
    assert rows_of(more.rows) == rows_of(tables.insert_ignore(changed.rows, updates, ["k"], "at"))
    fewer = more.delete(updates)
    assert rows_of(fewer.rows) == rows_of(tables.delete_by_key(more.rows, updates, ["k"]))
    assert rows_of(keyed_store.open_keyed(spark, keyed.path).rows) == rows_of(fewer.rows)


def test_only_touched_buckets_are_written(spark, store):
    before = rows_of(store.rows)
    few = some(spark, [3, 4, 3, 900], 1000)
    changed = store.upsert(few, "at")
    touched = set(store._touched(few))
    assert len(touched) <= 3
    assert {b for b, v in changed.folders.items() if v not in store.folders.values()} == touched
    assert all(changed.folders[b] == store.folders[b] for b in store.folders if b not in touched)
    own = next(v for b, v in changed.folders.items() if b in touched)
    written = spark.read.parquet(f"{store.path}/data/{own}").count()
    assert written < 100
    assert rows_of(store.rows) == before  # a reader of the old version
    assert rows_of(keyed_store.open_keyed(spark, store.path, 1).rows) == before
    assert rows_of(changed.get(few.select("k"))) == rows_of(changed.rows.where("k in (3, 4, 900)"))


def test_two_writers_and_unfinished_versions(spark, store):
    first = store.upsert(some(spark, [1], 1000), "at")
    with pytest.raises(Exception, match="PATH_ALREADY_EXISTS|already exists"):
        store.upsert(some(spark, [2], 1000), "at")
    some(spark, [5], 1).withColumn("_bucket", F.lit(1)).write.partitionBy("_bucket").parquet(f"{store.path}/data/2-lost")
    opened = keyed_store.open_keyed(spark, store.path)
    assert opened.version == first.version and rows_of(opened.rows) == rows_of(first.rows)


def test_empty(spark, store):
    none = some(spark, [], 0)
    assert store.upsert(none, "at") is store
    gone = store.delete(store.rows)
    assert gone.rows.count() == 0 and keyed_store.open_keyed(spark, store.path).rows.count() == 0
    assert keyed_store.open_keyed(spark, store.path).upsert(some(spark, [7], 5), "at").rows.count() == 1
    empty = keyed_store.create_keyed(none, scratch_path(spark, "keyed"), ["k"], buckets=3)
    assert empty.rows.count() == 0 and empty.insert_new(some(spark, [1, 1], 1), "at").rows.count() == 1
