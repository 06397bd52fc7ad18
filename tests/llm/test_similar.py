"""The similarity join against brute force over all pairs."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from brightwater.llm.components import components
from brightwater.llm.hashing import text_shingles
from brightwater.llm.similar import banding, ngram_jaccard_join, shared_counts, similar_texts

FOLDER = "/root/testdata/sf0.001"


def word_sets(texts, n=5):
    import regex as re

    out = []
    for t in texts:
        words = re.findall(r"[\p{L}\p{N}\p{M}_]+", (t or "").lower())
        out.append({tuple(words[k : k + n]) for k in range(len(words) - n + 1)} or ({tuple(words)} if words else set()))
    return out


def brute(rows, threshold=0.8):
    """(key, text) rows in order to key -> (class, links); classes by index order."""
    sets = word_sets([t for _, t in rows])
    links = [set() for _ in rows]
    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b]:
                both = len(sets[a] & sets[b])
                if both / (len(sets[a]) + len(sets[b]) - both) >= threshold:
                    links[a].add(b)
                    links[b].add(a)
    root = list(range(len(rows)))
    changed = True
    while changed:
        changed = False
        for a in range(len(rows)):
            for b in links[a]:
                if root[b] < root[a]:
                    root[a], changed = root[b], True
    return {k: (rows[root[i]][0], len(links[i])) for i, (k, _) in enumerate(rows)}


def near_copies(seed, groups=12, size=12):
    pick = random.Random(seed)
    words = ["".join(pick.choices("abcdefgé", k=pick.randint(2, 7))) for _ in range(4000)]
    texts = []
    for g in range(groups):
        base = pick.choices(words, k=pick.randint(3, 160))
        for _ in range(size):
            own = list(base)
            for _ in range(pick.choice([0, 0, 1, 1, 2, 3, 5])):
                own[pick.randrange(len(own))] = pick.choice(words)
            texts.append(" ".join(own))
    pick.shuffle(texts)
    return [(i * 3, t) for i, t in enumerate(texts)]


def result(df):
    return {r.doc_id: (r.class_id, r.n_links) for r in df.collect()}


def test_query_equals_brute_force(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    rows = sorted((r.doc_id, r.text) for r in docs.select("doc_id", "text").collect())
    assert result(ngram_jaccard_join(spark, FOLDER)) == brute(rows)


@pytest.mark.parametrize("blocks", [(512, 256), (3, 2)])
def test_equals_brute_force_in_any_blocks(spark, blocks):
    rows = near_copies(5)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = similar_texts(docs, bucket_block=blocks[0], group_block=blocks[1])
    assert result(got) == brute(rows)


def test_odd_rows(spark):
    text = " ".join(f"w{i}" for i in range(30))
    rows = [(1, None), (2, ""), (3, "... !!"), (4, text), (4, text), (None, text), (5, "only three words"),
            (6, "Only, three words!"), (7, text + " more")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("rep", F.lit("x"))
    got = sorted(((r.doc_id, r.class_id, r.n_links) for r in similar_texts(docs).collect()), key=repr)
    want = [(1, 1, 0), (2, 2, 0), (3, 3, 0), (4, 4, 3), (4, 4, 3), (None, 4, 3), (5, 5, 1), (6, 5, 1), (7, 4, 3)]
    assert got == sorted(want, key=repr)


def test_empty_table(spark):
    assert similar_texts(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_banding_reaches_recall():
    bands, rows, agreeing = banding(0.8, 0.9999)
    assert 1 - (1 - 0.8**rows) ** bands >= 0.99995
    assert bands * rows <= 100 and 0 < agreeing < bands * rows


def test_shared_counts():
    pick = np.random.default_rng(3)
    sets = [np.unique(pick.integers(0, 300, size=pick.integers(0, 90)).astype(np.uint64)) for _ in range(40)]
    got = shared_counts(sets, slice_bits=64)
    for a in range(40):
        for b in range(40):
            assert a == b or got[a, b] == len(np.intersect1d(sets[a], sets[b]))


def test_shingles_are_those_of_the_words():
    texts = ["A b-c d e F g", "a B c, d e f G", "x y", "", None, "né Né né né né né né"]
    found = [set(s.tolist()) for _, s in text_shingles(pa.array(texts), 5)]
    assert found[0] == found[1] and len(found[0]) == 3
    assert len(found[2]) == 1 and not found[3] and not found[4] and len(found[5]) == 1


def test_components(spark):
    edges = [(i, i + 1) for i in range(10, 40)] + [(100, 7), (7, 3), (50, 51), (51, 50), (60, 60)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 10 for i in range(10, 41)}, 3: 3, 7: 3, 100: 3, 50: 50, 51: 50, 60: 60}


MARKS = ["{}", "\u201c{}\u201d", "{}\u2014", "{}\u00a0", "\u00ab{}\u00bb", "{}\u2026", "{}\u3002"]


def test_marks_beyond_ascii_separate_words(spark):
    """Typographic quotes, dashes, no-break spaces and CJK punctuation are no letters."""
    words = [f"w{i}" for i in range(40)] + ["caf\u00e9", "cafe\u0301", "\u6f22\u5b57", "\u0663"]
    rows = [(k, " ".join(mark.format(w) if i % 3 == 0 else w for i, w in enumerate(words))) for k, mark in enumerate(MARKS)]
    rows.append((99, "".join(f"{w}\u00a0" for w in words)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = similar_texts(docs).collect()
    assert {(r.class_id, r.n_links) for r in found} == {(0, len(rows) - 1)}
    assert brute(rows) == {r.doc_id: (r.class_id, r.n_links) for r in found}
