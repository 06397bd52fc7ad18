"""Byte pairs: against the vocabulary's own library, scanning against the heap, and odd rows."""

import hashlib
import random
from array import array

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from brightwater.llm.bytepairs import SHORT, BytePairs, byte_pair_encoding, decode, encode

PATH = public_tokenizers.path("byte_bpe_50k.json")
FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def pairs():
    return BytePairs(PATH, public_tokenizers.PATTERN)


@pytest.fixture(scope="module")
def library():
    found = Tokenizer.from_file(PATH)
    found.no_truncation()
    found.no_padding()
    return found


def ids_of(pairs, texts):
    ids, ends = pairs.encode(pa.array(texts, pa.string()))
    return [ids[a:b].tolist() for a, b in zip(ends[:-1], ends[1:])]


def test_against_library(pairs, library):
    random.seed(4)
    parts = ["a", "the", " ", "  ", "\n", "\t", "'s", "'ll", "<|endoftext|>", "<|end", "12", "é", "ß", "中文", " "]
    parts += [" ", "!", "...", "\x1c", "\x85", "🎉", "x" * 40, "ab" * 90, " ", "　", "é", "İ"]
    texts = ["".join(random.choice(parts) for _ in range(random.randint(0, 20))) for _ in range(4000)]
    texts += [f"a{chr(c)}b {chr(c)} {chr(c)}{chr(c)}1" for c in range(1, 0x3100) if not 0xD800 <= c < 0xE000]
    want = [x.ids for x in library.encode_batch(texts, add_special_tokens=False)]
    assert ids_of(pairs, texts) == want
    for ids in want:
        assert pairs.decode(np.array(ids, dtype=np.uint32)) == library.decode(ids, skip_special_tokens=False)


def test_scan_and_heap_merge_alike(pairs):
    random.seed(6)
    for _ in range(400):
        word = "".join(random.choice("aabnerstié") for _ in range(random.randint(1, 200))).encode()
        assert pairs._scanned(word) == pairs._queued(word)


def test_any_ids_decode(pairs, library):
    random.seed(8)
    for _ in range(500):
        ids = [random.randint(0, 50_400) for _ in range(10)]
        assert pairs.decode(np.array(ids, dtype=np.uint32)) == library.decode(ids, skip_special_tokens=False)


def test_odd_rows(spark, library):
    texts = [None, "", " ", "two words", "two words", "n" * (40 * SHORT), "word " * 60_000, "<|endoftext|> <|endoftext|>"]
    rows = [(None if k % 3 == 0 else 1, t, b"x", 5) for k, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id int, text string, ids binary, n_tokens int")
    got = sorted((r.doc_id is None, r.n_tokens, bytes(r.ids), r.decoded) for r in decode(encode(docs, PATH), PATH).collect())
    want = []
    for key, text, *_ in rows:
        ids = library.encode(text or "", add_special_tokens=False).ids
        want.append((key is None, len(ids), array("I", ids).tobytes(), text or ""))
    assert got == sorted(want)
    assert decode(encode(docs.limit(0), PATH), PATH).collect() == []
    none = spark.createDataFrame([(None,), (b"",), (array("I", [60_000]).tobytes(),)], "ids binary")
    assert sorted(repr(r.decoded) for r in decode(none, PATH).collect()) == ["''", "''", "None"]
    with pytest.raises(ValueError):
        encode(docs, PATH, key="n_tokens")


def test_query(spark, library):
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    rows = byte_pair_encoding(spark, FOLDER).collect()
    assert len(rows) == len(docs)
    for r in rows:
        ids = library.encode(docs[r.doc_id], add_special_tokens=False).ids
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(array("I", ids).tobytes()).hexdigest()
        text = library.decode(ids, skip_special_tokens=False)
        assert r.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()
