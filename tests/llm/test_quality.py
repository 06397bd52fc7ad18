"""Quality statistics against brute force, the binomial test against exact fractions, and the guarantee."""

import math
import random
import re
from collections import Counter
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from brightwater.llm import quality
from brightwater.llm.quality import binomial_tail, judge, quality_rules, thresholds

FOLDER = "/root/testdata/sf0.001"


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    covered = set()
    for i in range(len(words) - 2):
        if windows[tuple(words[i : i + 3])] > 1:
            covered |= {i, i + 1, i + 2}
    seen, again = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            again += line in seen
            seen.add(line)
    n = len(words)
    failed = n < 50 or 100 * len(covered) > 50 * n
    return n, sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), again, len(covered), failed


def numbers(r):
    return r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed


def test_query_equals_brute_force(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    rows = quality_rules(spark, FOLDER).collect()
    assert len(rows) == len(docs)
    for r in rows:
        assert numbers(r) == brute(docs[r.doc_id]), r.doc_id
        assert not (r.kept and r.base_failed)


def test_odd_texts(spark):
    texts = [
        None, "", " \n\t ", "a", "a b", "a b c a b c", "x " * 400, "a\n\na\n a\na \na", "é ü x y\x0bz\x0cq\r\n" * 3,
        "### $$ <b>|", "a b c d a b c e b c d", "\U0001f600 \U0001f600 \U0001f600 \U0001f600", "w" * 100_000,
    ]
    docs = spark.createDataFrame([(i, t, "en", 0) for i, t in enumerate(texts)], "doc_id long, text string, lang string, n_words int")
    labels = spark.createDataFrame([(1, 1), (1, 0), (None, 1), (99, 1)], "doc_id long, quality int")
    rows = judge(docs.union(docs.limit(1)), labels).collect()
    assert len(rows) == len(texts) + 1
    for r in rows:
        assert numbers(r) == brute(texts[r.doc_id]), texts[r.doc_id]
    assert judge(docs.limit(0), labels).collect() == []
    nulls = docs.select(F.lit(None).cast("long").alias("doc_id"), "text", F.lit(None).cast("string").alias("lang"))
    assert judge(nulls, labels.limit(0)).count() == len(texts)


@pytest.mark.parametrize("p", [0.01, 0.0125, 0.2])
def test_binomial_tail_is_exact(spark, p):
    cases = [(k, n) for n in (1, 2, 7, 50, 400, 3000) for k in (0, 1, 2, 5, 20) if k <= n]
    got = spark.createDataFrame(cases, "k long, n long").select("k", "n", binomial_tail(F.col("k"), F.col("n"), p).alias("t"))
    q = Fraction(p)
    for k, n, tail in got.collect():
        want = 1.0 if k >= n * p else float(sum(math.comb(n, i) * q**i * (1 - q) ** (n - i) for i in range(k + 1)))
        assert tail == pytest.approx(want, rel=1e-8)


def test_selected_cutoffs_keep_the_guarantee(spark):
    """Good documents have few symbols, bad ones many: bad ones go, good ones stay."""
    pick = random.Random(3)
    rows, labels = [], []
    for i in range(9000):
        good = i % 3 > 0
        mark = pick.choices(["", "#"], weights=[99, 1])[0] if good else pick.choice(["##", "$$$", "||"])
        words = [f"w{pick.randrange(10**6)}{mark if pick.random() < 0.3 else ''}" for _ in range(60)]
        rows.append((i, " ".join(words), "en" if i % 7 else "xx"))
        labels.append((i, int(good)))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4)
    marks = spark.createDataFrame(labels, "doc_id long, quality int").repartition(4)
    found = {r.doc_id: r for r in judge(docs, marks).collect()}
    lost = sum(not found[i].kept for i, good in labels if good)
    caught = sum(not found[i].kept for i, good in labels if not good)
    assert lost <= quality.LIMIT * 6000 and caught >= 0.95 * 3000
    # a few labels prove nothing
    few = judge(docs, marks.where("doc_id < 60"))
    assert few.where("not kept").count() == 0


def test_some_hundred_labels_prove_cutoffs(spark):
    """Four strata with 300 good labels each: too few for a test per statistic, enough for one of all together."""
    pick = random.Random(5)
    rows, labels = [], []
    for i in range(1600):
        good = i % 4 > 0
        words = [f"w{pick.randrange(10**6)}{'' if good else '$$'}" for _ in range(60)]
        rows.append((i, " ".join(words), "abcd"[i // 4 % 4]))
        labels.append((i, int(good)))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4)
    found = {r.doc_id: r for r in judge(docs, spark.createDataFrame(labels, "doc_id long, quality int")).collect()}
    assert not any(found[i].kept for i, good in labels if not good)
    for stratum in "abcd":
        lost = sum(not found[i].kept for i, good in labels if good and rows[i][2] == stratum)
        assert lost <= quality.LIMIT * 300


def test_no_labels_no_cutoffs(spark):
    empty = spark.createDataFrame(
        [], "stratum string, fold int, n_words long, n_symbols long, n_repeat_words long, n_dup_lines long, __n_lines long, __n_marks long"
    )
    assert thresholds(empty).collect() == []


def test_main_path_is_native(spark):
    plan = quality_rules(spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
