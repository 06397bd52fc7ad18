"""Periodic runs: against all periods tried one by one, odd rows, and the query's digests."""

import hashlib
import random
import re
import zlib

import numpy as np

from brightwater.llm.periodic import Places, periodic_run_detection, periodic_runs, word_runs

FOLDER = "/root/testdata/sf0.001"


def tried(words, min_words=6, min_exponent=4):
    """Maximal runs by trying every period; only those that no smaller period explains."""
    found, n = set(), len(words)
    for q in range(1, n // min_exponent + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            size = j - i + q
            smaller = any(words[i : i + size - d] == words[i + d : i + size] for d in range(1, q))
            if size >= max(min_words, min_exponent * q) and not smaller:
                found.add((i, size, q))
            i = j
    return sorted(found, key=lambda r: (r[0], r[2]))


def collapsed(words, runs):
    gone = {i for start, size, q in runs for i in range(start + q, start + size)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def test_random_sequences():
    random.seed(5)
    for _ in range(3000):
        words = [random.randint(0, random.choice([1, 2, 3])) for _ in range(random.randint(0, 30))]
        if len(words) > 3 and random.random() < 0.7:
            a, p = random.randrange(len(words)), random.randint(1, 6)
            size = len(words) + random.randint(0, 20)
            p = min(p, len(words) - a)
            words = words[:a] + [words[a + (i - a) % p] for i in range(a, size)]
            words += [random.randint(0, 3) for _ in range(random.randint(0, 6))]
        for least, times in ((6, 4), (2, 2), (4, 3)):
            got = word_runs(np.array(words, dtype=np.int64), least, times)
            assert [tuple(r) for r in got.tolist()] == tried(words, least, times), (words, least, times)


def test_ordered_set():
    random.seed(2)
    order = random.sample(range(5000), 3000)
    held, known = Places(order[0]), [order[0]]
    for x in order[1:]:
        before = max((y for y in known if y < x), default=None)
        after = min((y for y in known if y > x), default=None)
        assert held.add(x) == (before, after)
        known.append(x)
    assert list(held) == sorted(known) and held.size == len(known) and len(held.blocks) > 4


def test_very_long_texts():
    for n, p in ((120_000, 1), (120_000, 7), (120_000, 30_000)):
        assert word_runs(np.arange(n) % p, 6, 4).tolist() == [[0, n, p]]


def test_odd_rows(spark):
    texts = [None, "", " \t\n", "a a a a a", "a a a a a a", "x y x y x y x y z", "é é " * 7, "a " * 30_000 + "b"]
    rows = [(None if k % 3 == 0 else 7, t, "old", "older") for k, t in enumerate(texts * 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, runs string, __row string")
    got = periodic_runs(docs).collect()
    assert len(got) == len(rows)
    want = []
    for key, text, *_ in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        runs = tried(words) if len(words) < 100 else [(0, 30_000, 1)]
        want.append((key, len(words), runs, collapsed(words, runs)))
    told = [(r.doc_id, r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in got]
    assert sorted(told, key=repr) == sorted(want, key=repr)
    assert periodic_runs(docs.limit(0)).collect() == []


def test_query(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").collect()
    got = {r.doc_id: r for r in periodic_run_detection(spark, FOLDER).collect()}
    assert set(got) == {r.doc_id for r in docs}
    looped = 0
    for doc in docs:
        words = re.findall(r"[^\x20\x09-\x0D]+", doc.text or "")
        h, n = zlib.crc32(str(doc.doc_id).encode()), len(words)
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
            looped += 1
        runs = tried(words)
        best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=(None,) * 3)
        told = "".join(f"{s},{size},{q}\n" for s, size, q in runs)
        r = got[doc.doc_id]
        assert (r.n_runs, r.start, r.length, r.period) == (len(runs), *best)
        assert r.exponent_milli == (1000 * best[1] // best[2] if runs else None)
        assert r.runs_sha256 == hashlib.sha256(told.encode()).hexdigest()
        assert r.collapsed_sha256 == hashlib.sha256(collapsed(words, runs).encode()).hexdigest()
    assert looped > 5
