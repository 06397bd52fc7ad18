"""Byte-pair encoding of whole texts, and decoding, with the vocabulary of a byte-level tokenizer file.

A text is cut before every space that surely begins a token, so that equal chunks are encoded once and remembered.
A chunk is split by the vocabulary's pattern into words. A word is encoded on a contiguous rank array: the list
of its part boundaries and the ranks of adjacent parts. The least rank (the first of equal ones) is found
by scanning, its boundary is deleted, and the ranks beside it are looked up again. Words longer than
``SHORT`` bytes take the same merges in the same order from a heap, because scanning them is quadratic.
"""

from __future__ import annotations

import heapq
import json
from array import array

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brightwater.llm.frames import byte_list, ready, registered, table
from brightwater.llm.hashing import text_blocks
from brightwater.llm.words import byte_set, column, gathered, plain_strings, stretches

#: Words up to so many bytes are merged by scanning.
SHORT = 128
#: Different chunks whose ids a worker remembers.
REMEMBERED = 400_000
#: Texts are encoded in blocks of this many bytes, or one longer text.
BLOCK = 4 << 20

_NONE = 1 << 60
#: First bytes of characters that are no white space, so that a space before one begins a token.
_SOLID = byte_set(bytes([*range(0x21, 0x7F), *range(0xC3, 0xE1), *range(0xE4, 0xEF), *range(0xF0, 0xF5)]))


def _byte_names() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable ones for themselves,
    the others, in order, for the characters from 256 on."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(256 + k): b for k, b in enumerate(others)}


class BytePairs:
    """Encoder and decoder of one tokenizer file of the byte-level kind."""

    def __init__(self, path: str, pattern: str):
        with open(path, encoding="utf-8") as file:
            told = json.load(file)
        model, cut = told["model"], told.get("pre_tokenizer") or {}
        known = cut.get("type") == "ByteLevel" and cut.get("use_regex", True) and not cut.get("add_prefix_space")
        odd = [model.get(x) for x in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges")]
        added = told.get("added_tokens", [])
        odd += [t.get(x) for t in added for x in ("single_word", "lstrip", "rstrip", "normalized")]
        if model.get("type") != "BPE" or not known or told.get("normalizer") or any(odd):
            raise ValueError("not a plain byte-level vocabulary")
        names = _byte_names()

        def raw(token: str) -> bytes:
            return bytes(names[c] for c in token)

        self._ids = {raw(token): i for token, i in model["vocab"].items()}
        self._ranks = {}
        for rank, pair in enumerate(model["merges"]):
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            self._ranks[raw(left), raw(right)] = rank
        self._special = {t["content"].encode(): t["id"] for t in added}
        self._pattern = regex.compile(pattern)
        self._known: dict[bytes, bytes] = {}
        tokens = {i: token for token, i in self._ids.items()} | {i: t for t, i in self._special.items()}
        self._tokens = [tokens.get(i, b"") for i in range(max(tokens) + 1)]

    def word(self, word: bytes) -> list[int]:
        """The ids of one word."""
        parts = self._scanned(word) if len(word) <= SHORT else self._queued(word)
        return [self._ids[word[a:b]] for a, b in zip(parts, parts[1:])]

    def _scanned(self, word: bytes) -> list[int]:
        """Part boundaries after all merges, by scanning the ranks of adjacent parts."""
        rank_of = self._ranks.get
        edge = list(range(len(word) + 1))
        rank = [rank_of((word[i : i + 1], word[i + 1 : i + 2]), _NONE) for i in range(len(word) - 1)]
        while rank:
            least = min(rank)
            if least == _NONE:
                break
            i = rank.index(least)
            del edge[i + 1], rank[i]
            a, b = edge[i], edge[i + 1]
            if i:
                rank[i - 1] = rank_of((word[edge[i - 1] : a], word[a:b]), _NONE)
            if i < len(rank):
                rank[i] = rank_of((word[a:b], word[b : edge[i + 2]]), _NONE)
        return edge

    def _queued(self, word: bytes) -> list[int]:
        """The same boundaries, with the ranks in a heap and outdated entries left in it."""
        rank_of = self._ranks.get
        n = len(word)
        after, before = list(range(1, n + 2)), list(range(-1, n))
        heap = []

        def offer(a: int) -> None:
            b = after[a]
            if b < n:
                rank = rank_of((word[a:b], word[b : after[b]]))
                if rank is not None:
                    heapq.heappush(heap, (rank, a, b, after[b]))

        for a in range(n):
            offer(a)
        while heap:
            _, a, b, c = heapq.heappop(heap)
            if after[a] != b or after[b] != c:
                continue
            after[a], after[b] = c, 0
            if c < n:
                before[c] = a
            offer(a)
            if a:
                offer(before[a])
        edge = [0]
        while edge[-1] < n:
            edge.append(after[edge[-1]])
        return edge

    def _chunk(self, chunk: bytes) -> bytes:
        """The ids of a chunk as bytes."""
        if chunk in self._special:
            return array("I", [self._special[chunk]]).tobytes()
        known, out = self._known, []
        for piece in self._pattern.findall(chunk.decode()):
            raw = piece.encode()
            if raw != chunk and raw in known:
                out.append(known[raw])
                continue
            ids = array("I", self.word(raw)).tobytes()
            known[raw] = ids
            out.append(ids)
        return out[0] if len(out) == 1 else b"".join(out)

    def _cuts(self, data: np.ndarray, begins: np.ndarray) -> np.ndarray:
        """Where chunks begin: at texts, around special tokens, and before spaces that begin a token."""
        borders = [begins]
        flat = data.tobytes()
        for special in self._special:
            at = flat.find(special)
            while at >= 0:
                text = int(np.searchsorted(begins, at, side="right")) - 1
                if at + len(special) <= begins[text + 1]:
                    borders.append(np.array([at, at + len(special)]))
                    at = flat.find(special, at + len(special))
                else:
                    at = flat.find(special, at + 1)
        border = np.unique(np.concatenate(borders))
        spaced = np.zeros(len(data) + 1, dtype=bool)
        spaced[: max(len(data) - 1, 0)] = (data[:-1] == 0x20) & _SOLID[data[1:]]
        spaced[border[border > 0] - 1] = False
        spaced[border] = True
        return np.flatnonzero(spaced)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts in order, and where each text begins (one more entry for the end)."""
        raw = byte_list(plain_strings(texts))
        data = np.frombuffer(b"".join(raw), dtype=np.uint8)
        begins = np.concatenate(([0], np.cumsum([len(x) for x in raw], dtype=np.int64)))
        if not len(data):
            return np.zeros(0, dtype=np.uint32), np.zeros(len(begins), dtype=np.int64)
        cuts = self._cuts(data, begins)
        offsets = pa.py_buffer(cuts.astype(np.int32))
        chunks = pa.Array.from_buffers(pa.binary(), len(cuts) - 1, [None, offsets, pa.py_buffer(data)])
        coded = chunks.dictionary_encode()
        if len(self._known) > REMEMBERED:
            self._known = {}
        ids_of = []
        for chunk in coded.dictionary.to_pylist():
            ids = self._known.get(chunk)
            if ids is None:
                ids = self._chunk(chunk)
                self._known[chunk] = ids
            ids_of.append(ids)
        flat = np.frombuffer(b"".join(ids_of), dtype=np.uint32)
        sizes = np.fromiter((len(x) // 4 for x in ids_of), np.int64, len(ids_of))
        rows = coded.indices.to_numpy()
        firsts = np.cumsum(sizes) - sizes
        done = np.concatenate(([0], np.cumsum(sizes[rows])))
        return flat[stretches(firsts[rows], sizes[rows])], done[np.searchsorted(cuts, begins)]

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids; unknown ids are left out, bytes that are no UTF-8 become U+FFFD."""
        ids = ids[ids < len(self._tokens)]
        return b"".join(map(self._tokens.__getitem__, ids.tolist())).decode("utf-8", "replace")


_held: dict[tuple[str, str], BytePairs] = {}


def _vocabulary(path: str, pattern: str) -> BytePairs:
    if (path, pattern) not in _held:
        _held[path, pattern] = BytePairs(path, pattern)
    return _held[path, pattern]


def _encoded(path: str, pattern: str, key: str):
    def run(batches):
        coder = _vocabulary(path, pattern)
        for found in gathered(batches, BLOCK, 1):
            keys, texts = column(found, 0), plain_strings(column(found, 1))
            for a, b in text_blocks(texts, BLOCK):
                ids, ends = coder.encode(texts.slice(a, b - a))
                flat, at = ids.astype("<u4").tobytes(), (ends * 4).tolist()
                own = [flat[p:q] for p, q in zip(at, at[1:])]
                columns = [keys.slice(a, b - a), pa.array(np.diff(ends), pa.int64()), pa.array(own, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=[key, "n_tokens", "ids"])

    return run


def encode(
    docs: DataFrame,
    path: str,
    pattern: str = public_tokenizers.PATTERN,
    key: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """Token ids of every whole text by the byte-level vocabulary file at ``path``.

    Returns (key, n_tokens, ids); ``ids`` holds little-endian unsigned 32-bit integers. ``pattern`` splits texts into
    words. Strings of the file's special tokens become their ids, as in the file's own library.
    Null and empty texts have no ids. Every row is encoded by itself: null or repeated keys and equal texts give a
    row each, an empty table none; merges of equal rank are taken from the left. Other columns are not read.
    ``path`` must be readable by every executor.
    """
    if key in ("n_tokens", "ids"):
        raise ValueError(f"the key must not be named {key}")
    ready(docs.sparkSession)
    kind = docs.schema[key].dataType.simpleString()
    return docs.select(F.col(f"`{key}`"), F.col(f"`{text}`")).mapInArrow(
        _encoded(path, pattern, key), f"`{key}` {kind}, n_tokens long, ids binary"
    )


def _decoded(path: str, pattern: str, place: int, into: str):
    def run(batches):
        coder = _vocabulary(path, pattern)
        for batch in batches:
            for a, b in text_blocks(batch.column(place), BLOCK):
                part = batch.slice(a, b - a)
                texts = [
                    None if x is None else coder.decode(np.frombuffer(x, dtype="<u4"))
                    for x in part.column(place).to_pylist()
                ]
                names = [*batch.schema.names, into]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.string())], names=names)

    return run


def decode(
    tokens: DataFrame,
    path: str,
    pattern: str = public_tokenizers.PATTERN,
    ids: str = "ids",
    into: str = "decoded",
) -> DataFrame:
    """All columns of ``tokens`` and the text of its ids, special tokens included.

    ``ids`` holds little-endian unsigned 32-bit integers; null stays null, none give an empty text. Ids that
    the vocabulary does not have are left out; bytes that are no UTF-8 become U+FFFD. ``into`` must be a new name.
    """
    if into in tokens.columns:
        raise ValueError(f"there is a column {into} already")
    ready(tokens.sparkSession)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in tokens.schema.fields)
    return tokens.mapInArrow(_decoded(path, pattern, tokens.columns.index(ids), into), f"{schema}, `{into}` string")


@registered("op11_byte_pair_encoding")
def byte_pair_encoding(spark, folder):
    """Ids of every document and the text they decode to, as digests."""
    path = public_tokenizers.path("byte_bpe_50k.json")
    back = decode(encode(table(spark, folder, "documents"), path), path)
    return back.select(
        "doc_id",
        "n_tokens",
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )
