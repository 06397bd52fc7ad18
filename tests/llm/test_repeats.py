"""Repeat removal against brute force over all strings of the given length."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from brightwater.llm import repeats
from brightwater.llm.repeats import remove_repeats, suffix_array_dedup

FOLDER = "/root/testdata/sf0.001"


def brute(rows, length):
    """rows: (doc_id, bytes) in corpus order."""
    seen, out = set(), {}
    for k, data in rows:
        gone = bytearray(len(data))
        for s in range(len(data) - length + 1):
            piece = data[s : s + length]
            if piece in seen:
                gone[s : s + length] = b"\1" * length
            seen.add(piece)
        kept = bytes(b for b, g in zip(data, gone) if not g)
        runs = sum(1 for i, g in enumerate(gone) if g and not (i and gone[i - 1]))
        out[k] = (len(data), sum(gone), runs, hashlib.sha256(kept).hexdigest())
    return out


def digests(df):
    rows = df.select(
        "doc_id", "n_bytes", (F.col("n_bytes") - F.length("kept")).alias("r"), F.size("spans").alias("s"),
        F.sha2("kept", 256).alias("h"),
    ).collect()
    return [(r.doc_id, tuple(r)[1:]) for r in rows]


def test_query_equals_brute_force(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    rows = sorted((r.doc_id, (r.text or "").encode()) for r in docs.select("doc_id", "text").collect())
    got = {r.doc_id: tuple(r)[1:] for r in suffix_array_dedup(spark, FOLDER).collect()}
    assert got == brute(rows, repeats.LENGTH)


def _corpus(seed):
    """Texts with shared passages, edits, periodic runs, repeated bytes and copies."""
    pick = random.Random(seed)
    words = ["".join(pick.choices("abcdeé", k=pick.randint(1, 6))) for _ in range(300)]
    passage = [" ".join(pick.choices(words, k=40)) for _ in range(4)]
    texts = []
    for _ in range(60):
        parts = [" ".join(pick.choices(words, k=pick.randint(0, 60))) for _ in range(3)]
        parts.insert(1, pick.choice(passage)[pick.randint(0, 9) :])
        if pick.random() < 0.3:
            parts.append("ab c" * pick.randint(1, 120))
        if pick.random() < 0.2:
            parts.append("x" * pick.randint(50, 400))
        text = " ".join(parts)
        texts.append(text)
        if pick.random() < 0.3:
            at = pick.randrange(len(text))
            texts.append(text[:at] + pick.choice("zq") + text[at + 1 :])
        if pick.random() < 0.2:
            texts.append(text)
    return texts


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_equals_brute_force_on_repetitive_texts(spark, seed):
    texts = _corpus(seed)
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = dict(digests(remove_repeats(docs)))
    assert got == brute([(i, t.encode()) for i, t in enumerate(texts)], repeats.LENGTH)


def test_spread_triggers_and_salted_groups(spark):
    """The paths for hot triggers give the same result as the plain ones."""
    line = "This sentence stands in nearly every text of the corpus, and what surrounds it differs."
    assert repeats.LENGTH > len(line)
    texts = [f"{i * 7919} {line} {i * 104729}" + t for i, t in enumerate(_corpus(4))]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    want = brute([(i, t.encode()) for i, t in enumerate(texts)], repeats.LENGTH)
    assert dict(digests(remove_repeats(docs, spread=1, group=2))) == want
    assert dict(digests(remove_repeats(docs, group=1))) == want


def test_odd_rows(spark):
    """Null and empty texts, repeated and null keys, clashing columns, short texts."""
    long = "".join(chr(97 + (i * i * 7 + i // 3) % 26) for i in range(400))
    rows = [(1, None, 0), (2, "", 0), (3, "short", 0), (4, long, 0), (4, long, 0), (None, long + "!", 0), (5, "é" * 90, 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, code int").withColumn("__row", F.lit(1))
    got = sorted(digests(remove_repeats(docs)), key=repr)
    data = long.encode()
    order = [(1, b""), (2, b""), (3, b"short"), (4, data), (4.5, data), (5, ("é" * 90).encode()), (9, data + b"!")]
    want = brute(order, repeats.LENGTH)
    names = {4.5: 4, 9: None}
    assert got == sorted(((names.get(k, k), v) for k, v in want.items()), key=repr)


def test_whole_characters(spark):
    shared = "é" * 70
    docs = spark.createDataFrame([(1, "a" + shared), (2, "ab" + shared)], "doc_id long, text string")
    kept = {r.doc_id: bytes(r.kept) for r in remove_repeats(docs, whole_characters=True).collect()}
    for data in kept.values():
        data.decode()


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert remove_repeats(docs).collect() == []
