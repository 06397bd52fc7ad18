"""Containment search against brute force and the query's SQL."""

import random

import pytest
from pyspark.sql import functions as F

from brightwater.llm.contamination import CONTAINED_SQL, benchmark_decontamination, contained_items
from tests.compare import compare, connect
from tests.llm.test_similar import word_sets

FOLDER = "/root/testdata/sf0.001"


def brute(docs, items, threshold=0.8):
    texts, asked = word_sets([t for _, t in docs]), word_sets([t for _, t in items])
    return sorted(
        (d, i, len(s), len(s & t))
        for (d, _), t in zip(docs, texts)
        for (i, _), s in zip(items, asked)
        if s and len(s & t) >= threshold * len(s) - 1e-9
    )


def rows(df):
    return sorted((r.doc_id, r.item_id, r.n_item_shingles, r.n_shared) for r in df.collect())


def test_query_agrees_with_sql(spark):
    assert compare(benchmark_decontamination(spark, FOLDER), connect(FOLDER), CONTAINED_SQL) == ""


@pytest.mark.parametrize("block_chars", [10**6, 700])
def test_equals_brute_force(spark, block_chars):
    pick = random.Random(8)
    words = ["".join(pick.choices("abcdefg", k=3)) for _ in range(300)]
    items = [(i, " ".join(pick.choices(words, k=pick.randint(1, 60)))) for i in range(40)]
    docs = []
    for d in range(80):
        body = pick.choices(words, k=pick.randint(0, 300))
        for _ in range(pick.randint(0, 3)):
            own = pick.choice(items)[1].split()
            for _ in range(pick.randint(0, 3)):
                own[pick.randrange(len(own))] = "zz"
            body[len(body) // 2 : len(body) // 2] = own
        docs.append((d, " ".join(body).capitalize() + "."))
    docs += [(100 + i, t) for i, t in items[:10]]
    got = contained_items(
        spark.createDataFrame(docs, "doc_id long, text string"),
        spark.createDataFrame(items, "item_id long, text string"),
        block_chars=block_chars,
    )
    want = brute(docs, items)
    assert len(want) > 30 and rows(got) == want


def test_odd_rows(spark):
    text = " ".join(f"w{i}" for i in range(12))
    docs = [(1, None), (2, ""), (3, text), (3, text), (None, "x " + text), (4, "two words")]
    items = [(7, text), (7, text), (8, None), (9, ""), (None, "Two words")]
    got = contained_items(
        spark.createDataFrame(docs, "doc_id long, text string").withColumn("item", F.lit(0)),
        spark.createDataFrame(items, "item_id long, text string").withColumn("doc_id", F.lit(0)),
    )
    found = sorted(((r.doc_id, r.item_id) for r in got.collect()), key=repr)
    assert found == sorted([(3, 7)] * 4 + [(None, 7)] * 2 + [(4, None)], key=repr)


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b c d e f")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "a b c d e f")], "item_id long, text string")
    assert contained_items(docs, items.limit(0)).collect() == []
    assert contained_items(docs.limit(0), items).collect() == []
    assert len(contained_items(docs, items).collect()) == 1


def test_marks_beyond_ascii_separate_words(spark):
    words = [f"w{i}" for i in range(20)]
    quoted = [f"\u201c{w}\u201d" if i in (4, 11) else w for i, w in enumerate(words)]
    docs = [(1, "so " + " ".join(quoted)), (2, "\u00a0".join(words)), (3, "\u3001".join(words) + "\u3002"), (4, "\u2014".join(words))]
    got = contained_items(
        spark.createDataFrame(docs, "doc_id long, text string"),
        spark.createDataFrame([(5, " ".join(words))], "item_id long, text string"),
    )
    assert sorted((r.doc_id, r.n_shared) for r in got.collect()) == [(k, 16) for k in (1, 2, 3, 4)]


def test_sql_splits_words_alike(tmp_path, spark):
    import pyarrow as pa
    import pyarrow.parquet as pq

    text = "w1 w2 \u201cw3\u201d w4\u2014w5 caf\u00e9 cafe\u0301 \u6f22\u5b57\u3002w6 \u0663 w_7"
    plain = "w1 w2 w3 w4 w5 caf\u00e9 cafe\u0301 \u6f22\u5b57 w6 \u0663 w_7"
    for name, key, rows in (("documents", "doc_id", [text, plain, "x " + plain]), ("benchmark", "item_id", [plain, text])):
        pq.write_table(pa.table({key: list(range(len(rows))), "text": rows}), tmp_path / f"{name}.parquet")
    import duckdb

    con = duckdb.connect()
    for name in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet'")
    found = benchmark_decontamination(spark, str(tmp_path))
    assert compare(found, con, CONTAINED_SQL) == "" and found.count() == 6
