"""Packing: an exact round trip of ids, full sequences, and the curve."""

import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from brightwater.llm.packing import LENGTH, WordIds, hilbert, hilbert_packing, pack

FOLDER = "/root/testdata/sf0.001"
PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(PATH)


def check(pieces, want, length):
    """pieces: (doc, start, length, doc_tokens, sequence, offset, crc or ids)."""
    by_doc, by_sequence = {}, {}
    for p in pieces:
        by_doc.setdefault(p[0], []).append(p)
        by_sequence.setdefault(p[4], []).append(p)
    assert set(by_doc) == {k for k, ids in want.items() if len(ids)}
    for k, own in by_doc.items():
        ids, at = np.array(want[k], dtype="<u4"), 0
        for _, start, size, total, _, _, crc in sorted(own, key=lambda p: p[1]):
            assert start == at and size > 0 and total == len(ids)
            assert crc == zlib.crc32(ids[start : start + size].tobytes())
            at += size
        assert at == len(ids)
    for s, own in by_sequence.items():
        at = 0
        for p in sorted(own, key=lambda p: p[5]):
            assert p[5] == at
            at += p[2]
        assert at == length or s == max(by_sequence)
    assert sorted(by_sequence) == list(range(len(by_sequence)))


def test_query_is_a_round_trip(spark, tokenizer):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").collect()
    want = {r.doc_id: [*tokenizer.encode(r.text or "", add_special_tokens=False).ids, 1] for r in docs}
    rows = hilbert_packing(spark, FOLDER).select(
        "doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids_crc32"
    )
    check([tuple(r) for r in rows.collect()], want, LENGTH)


def test_odd_rows(spark, tokenizer):
    rows = [(1, None), (2, ""), (3, "a b c " * 50), (3, "a b c " * 50), (None, "x"), (4, " \n\t Né é  <|endoftext|> 1's")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n", F.lit("n"))
    got = pack(docs, PATH, length=16).withColumn("crc", F.crc32("ids")).collect()
    total = sum(len(tokenizer.encode(t or "", add_special_tokens=False).ids) + 1 for _, t in rows)
    assert sum(r.length for r in got) == total
    assert max(r.sequence_id for r in got) == (total - 1) // 16
    assert pack(docs.limit(0), PATH).collect() == []
    assert {r.doc_id for r in pack(docs, PATH, end_id=None).collect()} == {3, 4, None}


def test_word_ids_are_the_tokenizers(tokenizer):
    texts = ["Hello  World\n\nit's ÉTÉ 123 ##$$ a\tb c", "", None, "é éx ΑΣ ΣΑΣ. İ", "日本語 テキスト", "don't we'll  "]
    ids, ends = WordIds(PATH).texts(pa.array(texts))
    for k, text in enumerate(texts):
        assert ids[ends[k] : ends[k + 1]].tolist() == tokenizer.encode(text or "", add_special_tokens=False).ids


@pytest.mark.parametrize("remembered", [None, 50])
def test_random_words_are_encoded_like_whole_texts(tokenizer, remembered):
    pick = random.Random(4)
    signs = "aAzZéÉßÀŒœŠİΣσςıſªº²¼½«»¿…—'’`!#$%&*+-./:;<=>?@[]^_|~0123456789\u0301\u00ad\u00a0\t日本😀"
    coder = WordIds(PATH, remembered=remembered)
    texts = ["".join(pick.choices(signs + " " * 12 + "\n'st", k=pick.randint(0, 80))) for _ in range(3000)]
    texts += ["I'll DON'T it's WE'RE x's'", "<|startoftext|>a <|x b|> A<|endoftext|>B"]
    for a in range(0, len(texts), 700):
        block = texts[a : a + 700]
        ids, ends = coder.texts(pa.array(block))
        for k, text in enumerate(block):
            assert ids[ends[k] : ends[k + 1]].tolist() == tokenizer.encode(text, add_special_tokens=False).ids, text


@pytest.mark.parametrize("dimensions,bits", [(2, 4), (3, 3)])
def test_hilbert_steps_to_neighbours(dimensions, bits):
    side = 2**bits
    cells = np.stack(np.meshgrid(*[np.arange(side)] * dimensions, indexing="ij"), -1).reshape(-1, dimensions)
    place = hilbert(cells, bits)
    order = np.argsort(place)
    assert np.array_equal(np.sort(place), np.arange(side**dimensions))
    assert (np.abs(np.diff(cells[order].astype(int), axis=0)).sum(axis=1) == 1).all()


def test_neighbours_on_the_curve_are_alike(spark):
    """Two vocabularies end up in different sequences."""
    left, right = "red green blue yellow", "seven eight nine ten"
    docs = spark.createDataFrame([(i, (left if i % 2 else right) + " ") for i in range(200)], "doc_id long, text string")
    rows = pack(docs, PATH, length=50).collect()
    mixed = {}
    for r in rows:
        mixed.setdefault(r.sequence_id, set()).add(r.doc_id % 2)
    assert sum(len(v) > 1 for v in mixed.values()) <= 1
