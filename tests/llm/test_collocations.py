"""Collocations: against a plain count of all phrases, spread beginnings, and odd rows."""

import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa

from brightwater.llm.collocations import (
    _depths,
    _hot_beginnings,
    _longest_windows,
    _Windows,
    _without_rare_endings,
    collocations,
    phrase_counts,
)

UPPER = {c: c + 32 for c in range(65, 91)}


def plain(rows, least, longest=5, top=2000):
    """Counts and collocations by counting every phrase; rows are (group, text)."""
    counts, sizes = Counter(), Counter()
    for group, text in rows:
        group = "und" if group is None else group
        for piece in re.split(r"[.,;:!?\n-\r]", (text or "").translate(UPPER)):
            words = re.findall(r"[^ \t]+", piece)
            sizes[group] += len(words)
            for k in range(1, longest + 1):
                counts.update((group, *words[i : i + k]) for i in range(len(words) - k + 1))
    counts = Counter({p: f for p, f in counts.items() if f >= least})
    longer = {}
    for p, f in counts.items():
        for k in range(2, len(p) - 1):
            for i in range(1, len(p) - k + 1):
                inner = (p[0], *p[i : i + k])
                longer[inner] = max(longer.get(inner, 0), f)
    found = {}
    for p, a in counts.items():
        if len(p) < 3 or 100 * longer.get(p, 0) >= 100 * a:
            continue
        cuts = []
        for k in range(1, len(p) - 1):
            left, right = counts[p[: k + 1]], counts[(p[0], *p[k + 1 :])]
            cuts.append((1000 * a * sizes[p[0]] // (left * right), k, left, right))
        score, _, left, right = min(cuts)
        found.setdefault(p[0], []).append((-score, -a, " ".join(p[1:]).encode(), left, right))
    told = []
    for group, best in found.items():
        for rank, (score, a, phrase, left, right) in enumerate(sorted(best)[:top], start=1):
            told.append((group, rank, phrase.decode(), -a, left, right, sizes[group], -score))
    return counts, sizes, sorted(told)


def texts_of(seed, n):
    random.seed(seed)
    common = ["new", "york", "city", "the", "a", "Straße", "été", "of"]
    rare = [f"w{i}" for i in range(60)]
    marks = [". ", ", ", "\n", " ", " ", " ", "  ", "\t", " ", ";"]
    rows = []
    for k in range(n):
        words = []
        while len(words) < random.randint(0, 60):
            words += random.choice([["New", "York", "City"], ["the", random.choice(rare)], [random.choice(common)], [random.choice(rare)]])
        text = "".join(w + random.choice(marks) for w in words)
        rows.append((random.choice(["en", "de", None, "und"]), None if k % 37 == 0 else text))
    return rows


def test_small_tables(spark):
    for seed, n, least, parts in ((1, 400, 5, 1), (2, 900, 12, 13), (3, 60, 1, 3)):
        rows = texts_of(seed, n)
        docs = spark.createDataFrame(rows, "lang string, text string").repartition(parts)
        counts, sizes, told = plain(rows, least)
        got = phrase_counts(docs, least=least).collect()
        assert {(r.name, *r.words): r.f for r in got if r.words} == counts
        assert {r.name: r.f for r in got if not r.words} == {g: n for g, n in sizes.items() if n}
        assert sorted(tuple(r) for r in collocations(docs, least=least).collect()) == told and told
        few = plain(rows, least, top=3)[2]
        assert sorted(tuple(r) for r in collocations(docs, least=least, top=3).collect()) == few


def test_hot_beginnings(spark):
    """One word pair before a third of all words: its windows are spread, and nothing changes."""
    random.seed(9)
    rows = [("en", " ".join(f"hot pair v{random.randrange(40)} v{random.randrange(40)}" for _ in range(50))) for _ in range(200)]
    docs = spark.createDataFrame(rows, "lang string, text string").repartition(9)
    hot = _hot_beginnings(docs.selectExpr("lang as name", "text"), 5)
    assert ("en", "hot") in hot and ("en", "hot", "pair") in hot
    block = _Windows(pa.array(["en"] * 200), pa.array([t for _, t in rows]), 5)
    depth = _depths(block, [("en", "hot"), ("en", "hot", "pair"), ("de", "v1")], 5)
    words = np.array(["", *[w.decode() for w in block.words.to_pylist()]])
    first, second = words[block.columns[0]], words[block.columns[1]]
    assert set(depth[(first == "hot") & (second == "pair")]) == {3} and set(depth[first != "hot"]) == {1}
    assert sorted(tuple(r) for r in collocations(docs, least=30).collect()) == plain(rows, 30)[2]


def test_buckets_keep_what_they_do_not_know():
    """Counts summed over many blocks and buckets are the plain ones, whatever is spread."""
    rows = [(g or "und", t or "") for g, t in texts_of(4, 300)]
    counts, sizes, _ = plain(rows, 4)
    for hot in ([], [("en", "new"), ("en", "new", "york"), ("en", "new", "york", "city"), ("de", "the"), ("xx", "a")]):
        deal, merge = _longest_windows(5, 7, hot), _without_rare_endings(5, 4)
        batches = [
            pa.record_batch({"name": [g for g, _ in rows[a : a + 40]], "text": [t for _, t in rows[a : a + 40]]})
            for a in range(0, 300, 40)
        ]
        entries = [e for b in batches for e in pa.Table.from_batches(deal(iter([b]))).to_pylist()]
        entries.sort(key=lambda e: e["bucket"])
        got = Counter()
        for out in merge(iter([pa.RecordBatch.from_pylist(entries)])):
            for row in out.to_pylist():
                words = [row[f"w{k}"] for k in range(1, 6) if row[f"w{k}"]]
                for k in range(len(words) + 1):
                    got[(row["name"], *words[:k])] += row["n"]
        assert {p: f for p, f in got.items() if len(p) > 1 and f >= 4} == counts
        assert {p[0]: f for p, f in got.items() if len(p) == 1} == {g: n for g, n in sizes.items() if n}


def test_odd_rows(spark):
    rows = [(None, None, "x", 1), ("en", "", "x", 1), (None, "a b a b", "x", 1), (None, "A B. a b", "x", 2)] * 30
    rows += [("en", "word " * 50_000, "x", 1), (None, "...,,,  \n", "x", 1)]
    docs = spark.createDataFrame(rows, "lang string, text string, name string, w1 int")
    want = plain([r[:2] for r in rows], 100)[2]
    assert sorted(tuple(r) for r in collocations(docs).collect()) == want and want
    assert collocations(docs.limit(0)).collect() == []
    assert collocations(docs.where("text is null")).collect() == []
    whole = plain([(None, r[1]) for r in rows], 100)[2]
    assert sorted(tuple(r) for r in collocations(docs, group=None).collect()) == whole


def test_ties_and_wide_products(spark):
    """Equal scores go by count, then phrase; products beyond 64 bits stay exact."""
    rows = [("x", f"{w}1 {w}2") for w in ("b", "a", "é", "z") for _ in range(120)] + [("x", "f f f f")] * 20_000
    docs = spark.createDataFrame(rows, "lang string, text string")
    assert sorted(tuple(r) for r in collocations(docs).collect()) == plain(rows, 100)[2]
    exact = spark.sql(
        "select (cast(a as decimal(19,0)) * cast(n as decimal(19,0)) * 1000)"
        " div (cast(l as decimal(19,0)) * cast(l as decimal(19,0))) as s"
        " from values (5000000000000L, 900000000000000L, 3000000000L) as t(a, n, l)"
    ).first().s
    assert exact == 1000 * 5_000_000_000_000 * 900_000_000_000_000 // 3_000_000_000**2
