"""Packing of documents into token sequences along a space-filling curve.

1. Texts become token ids. Their hashed token vectors are projected to a few dimensions.
2. The projections are placed on a Hilbert curve over the corpus's bounding box; documents are
   range-sorted by curve position (ties by key, so that copies can be split over tasks).
3. Running token counts along the curve give every document its place in one long line of tokens,
   which is cut every ``length`` ids. A document that crosses a cut continues in the next sequence, so only
   the very last sequence can need padding.

Only positions are sorted; ids move once, to meet the places of their document.
"""

from __future__ import annotations

import json
import os
from array import array

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brightwater.llm.frames import ROW, identified, partitions, registered, table
from brightwater.llm.hashing import constants, text_blocks
from brightwater.plans.scratch import written

LENGTH = 2048
END_ID = 1
DIMENSIONS = 3
#: Bits of the grid per dimension; the curve position has DIMENSIONS times as many.
BITS = 16
#: Distinct words, and as many pieces of words, whose ids a worker remembers.
REMEMBERED = 500_000
#: Texts are tokenized in blocks of this many bytes, or one longer text.
TOKEN_BLOCK = 4 << 20
#: Ids of a piece that are copied at once into a result batch.
BATCH_IDS = 1 << 20


class WordIds:
    """Token ids of whole texts, encoding each distinct piece of a word once.

    White space never becomes part of a token of the vocabularies this is used with, so a text's ids are
    those of its space- and newline-separated words in order. If the tokenizer lower-cases and splits by a
    pattern, plain words (Latin letters, digits, signs) are cut into the pieces that it encodes by themselves.
    Words and pieces seen lately are remembered.
    """

    def __init__(self, path: str, remembered: int | None = None):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(path)
        self._split = _piece_pattern(path)
        self._most = REMEMBERED if remembered is None else remembered
        self._pieces: dict[str, bytes] = {}
        self._words = pa.array([], pa.string())
        self._sizes, self._flat = np.zeros(0, np.int64), np.zeros(0, np.uint32)

    def _coded(self, texts: list[str]) -> list[bytes]:
        out = []
        for a in range(0, len(texts), 4096):
            found = self._tokenizer.encode_batch_fast(texts[a : a + 4096], add_special_tokens=False)
            out += [array("I", f.ids).tobytes() for f in found]
        return out

    def _encoded(self, words: list[str]) -> list[bytes]:
        plain, split = _PLAIN.fullmatch, self._split
        parts = [
            split.findall(w.lower()) if split is not None and plain(w) and "<|" not in w else [w] for w in words
        ]
        if len(self._pieces) > self._most:
            self._pieces = {}
        known = self._pieces
        new = list({piece for found in parts for piece in found if piece not in known})
        known.update(zip(new, self._coded(new)))
        return [known[found[0]] if len(found) == 1 else b"".join([known[x] for x in found]) for found in parts]

    def _rows_of(self, words: pa.Array) -> np.ndarray:
        """Where the given distinct words stand among the remembered ones, which they join."""
        rows = pc.index_in(words, value_set=self._words)
        missing = pc.is_null(rows)
        new = words.filter(missing)
        if not len(new):
            return rows.to_numpy()
        coded = self._encoded(new.to_pylist())
        sizes = np.fromiter((len(c) // 4 for c in coded), np.int64, len(coded))
        if len(self._words) + len(new) > self._most:  # keep what these words need
            old = rows.drop_null().to_numpy()
            self._flat = self._flat[_ranges((np.cumsum(self._sizes) - self._sizes)[old], self._sizes[old])]
            self._words, self._sizes = self._words.take(pa.array(old)), self._sizes[old]
            rows = pc.index_in(words, value_set=self._words)
        place = np.array(pc.fill_null(rows, -1).to_numpy(zero_copy_only=False))
        place[np.asarray(missing)] = np.arange(len(new)) + len(self._words)
        self._words = pa.concat_arrays([self._words, new])
        self._sizes = np.concatenate((self._sizes, sizes))
        self._flat = np.concatenate((self._flat, np.frombuffer(b"".join(coded), dtype=np.uint32)))
        return place

    def texts(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts in order, and where each text begins (one more entry for the end)."""
        spaced = pc.replace_substring(pc.fill_null(texts, ""), "\n", " ")
        words = pc.split_pattern(spaced, " ")
        ends = np.asarray(words.offsets) - words.offsets[0].as_py()
        coded = words.flatten().dictionary_encode()
        rows = self._rows_of(coded.dictionary)[coded.indices.to_numpy()]
        sizes = self._sizes[rows]
        begins = (np.cumsum(self._sizes) - self._sizes)[rows]
        done = np.concatenate(([0], np.cumsum(sizes)))
        return self._flat[_ranges(begins, sizes)], done[ends]


def _ranges(begins: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers begins[i], begins[i] + 1, ... (sizes[i] of them), for one i after the other."""
    done = np.cumsum(sizes) - sizes
    return np.repeat(begins - done, sizes) + np.arange(sizes.sum())


#: Words of which lower-casing and the split pattern are the same here and in the tokenizer.
_PLAIN = regex.compile("[\x21-\x7e\u00a1-\u012f\u0131-\u017f]*")


def _piece_pattern(path: str):
    """The split pattern of a tokenizer that lower-cases and splits by one removed pattern; else None."""
    with open(path, encoding="utf-8") as file:
        told = json.load(file)
    steps = (told.get("normalizer") or {}).get("normalizers", [])
    cut = ((told.get("pre_tokenizer") or {}).get("pretokenizers") or [{}])[0]
    spaces = {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}
    if steps != [{"type": "NFC"}, spaces, {"type": "Lowercase"}] or (
        cut.get("type"), cut.get("behavior"), cut.get("invert")
    ) != ("Split", "Removed", True):
        return None
    return regex.compile(cut["pattern"]["Regex"])


_held: dict[str, WordIds] = {}


def _word_ids(path: str) -> WordIds:
    if path not in _held:
        _held[path] = WordIds(path)
    return _held[path]


def _vectors(ids: np.ndarray, ends: np.ndarray) -> list[np.ndarray]:
    """The mean of the projected hashed vectors of each text's tokens, dimension by dimension in [-1, 1]."""
    counts = np.maximum(np.diff(ends), 1)
    with np.errstate(over="ignore"):
        spots = (ids * np.uint32(2654435761)) >> np.uint32(16)
        out = []
        for k in range(DIMENSIONS):
            direction = constants(1 << 16, 101 + k).view(np.int64) / float(1 << 63)
            sums = np.zeros(len(ids) + 1)
            np.cumsum(direction[spots], out=sums[1:])
            out.append((sums[ends[1:]] - sums[ends[:-1]]) / counts)
    return out


def _gathered(batches):
    """Rows and texts of as many batches as make up a block."""
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.column(1).nbytes
        if size >= TOKEN_BLOCK:
            yield tuple(pa.concat_arrays([b.column(k) for b in held]) for k in (0, 1))
            held, size = [], 0
    if held:
        yield tuple(pa.concat_arrays([b.column(k) for b in held]) for k in (0, 1))


def _tokens(path: str, end_id: int | None):
    def run(batches):
        coder = _word_ids(path)
        for rows, texts in _gathered(batches):
            for a, b in text_blocks(texts, TOKEN_BLOCK):
                ids, ends = coder.texts(texts.slice(a, b - a))
                counts = np.diff(ends)
                vectors = _vectors(ids, ends)
                tail = [] if end_id is None else [end_id]
                own = [
                    np.append(ids[p:q], tail).astype("<u4") for p, q in zip(ends[:-1].tolist(), ends[1:].tolist())
                ]
                small = [x.astype("<u2") if not len(x) or x.max() < 1 << 16 else x for x in own]
                yield pa.record_batch(
                    {
                        ROW: rows.slice(a, b - a),
                        "n": pa.array(counts + len(tail), pa.int64()),
                        **{f"x{k}": pa.array(vectors[k]) for k in range(DIMENSIONS)},
                        "ids": pa.array([x.tobytes() for x in small], pa.binary()),
                    }
                )

    return run


def hilbert(cells: np.ndarray, bits: int) -> np.ndarray:
    """Positions along the Hilbert curve of grid cells (one row of coordinates each)."""
    x = cells.astype(np.uint64).copy()
    n = x.shape[1]
    one = np.uint64(1)
    for level in range(bits - 1, 0, -1):  # undo the rotations, highest bit first
        q = one << np.uint64(level)
        p = q - one
        for i in range(n):
            high = (x[:, i] & q) > 0
            swap = np.where(high, np.uint64(0), (x[:, 0] ^ x[:, i]) & p)
            x[:, 0] ^= np.where(high, p, swap)
            x[:, i] ^= swap
    for i in range(1, n):
        x[:, i] ^= x[:, i - 1]
    flip = np.zeros(len(x), dtype=np.uint64)
    for level in range(bits - 1, 0, -1):
        q = one << np.uint64(level)
        flip ^= np.where((x[:, n - 1] & q) > 0, q - one, np.uint64(0))
    x ^= flip[:, None]
    place = np.zeros(len(x), dtype=np.uint64)
    for level in range(bits - 1, -1, -1):
        for i in range(n):
            place = (place << one) | ((x[:, i] >> np.uint64(level)) & one)
    return place


def _positions(low: list[float], high: list[float], bits: int):
    def run(batches):
        least, span = np.array(low), np.maximum(np.array(high) - np.array(low), 1e-300)
        for batch in batches:
            points = np.stack([batch.column(2 + k).to_numpy() for k in range(DIMENSIONS)], axis=1)
            cells = np.clip((points - least) / span * (2**bits - 1), 0, 2**bits - 1).astype(np.uint64)
            place = hilbert(cells, bits).astype(np.int64)
            yield pa.record_batch({ROW: batch.column(0), "n": batch.column(1), "place": pa.array(place)})

    return run


def _running(batches):
    """Ids before each document within its task, and the task's number along the curve."""
    part, before = TaskContext.get().partitionId(), 0
    for batch in batches:
        counts = batch.column(1).to_numpy()
        ends = before + np.cumsum(counts)
        yield pa.record_batch(
            {
                ROW: batch.column(0),
                "part": pa.array(np.full(len(counts), part), pa.int32()),
                "before": pa.array(ends - counts, pa.int64()),
                "n": batch.column(1),
            }
        )
        before = int(ends[-1]) if len(ends) else before


def _pieces(length: int):
    def run(batches):
        names = ("start", "length", "doc_tokens", "sequence_id", "offset")
        for batch in batches:
            rows: list[int] = []
            out: dict[str, list[int]] = {name: [] for name in names}
            cut: list[bytes] = []
            held = 0
            for row, place, count, data in zip(*(c.to_pylist() for c in batch.columns)):
                ids = np.frombuffer(data, dtype="<u2" if len(data) == 2 * count else "<u4").astype("<u4")
                at = 0
                while at < count:
                    offset = (place + at) % length
                    size = min(length - offset, count - at)
                    rows.append(row)
                    for name, value in zip(names, (at, size, count, (place + at) // length, offset)):
                        out[name].append(value)
                    cut.append(ids[at : at + size].tobytes())
                    at += size
                    held += size
                    if held >= BATCH_IDS:
                        yield _piece_batch(rows, out, cut)
                        rows, out, cut, held = [], {name: [] for name in names}, [], 0
            yield _piece_batch(rows, out, cut)

    return run


def _piece_batch(rows, out, cut) -> pa.RecordBatch:
    columns = {name: pa.array(values, pa.int64()) for name, values in out.items()}
    return pa.record_batch({ROW: pa.array(rows, pa.int64()), **columns, "ids": pa.array(cut, pa.binary())})


def pack(
    docs: DataFrame,
    tokenizer: str,
    key: str = "doc_id",
    text: str = "text",
    length: int = LENGTH,
    end_id: int | None = END_ID,
) -> DataFrame:
    """Pieces of documents in sequences of ``length`` tokens, similar documents in the same ones.

    One row per piece: (key, start, length, doc_tokens, sequence_id, offset, ids): the piece holds
    ``length`` ids (little-endian unsigned 32-bit, as bytes) of its document from ``start`` on and stands at ``offset``
    in its sequence. Every document is its text's ids by ``tokenizer`` (a tokenizer file) followed by
    ``end_id``; every id lies in exactly one piece. All sequences but the last are full.

    A null text is empty and so is one piece, of ``end_id`` (none if that is None). Rows with null or
    repeated keys are documents of their own. Other columns are not read; an empty table gives no pieces.
    """
    spark = docs.sparkSession
    source = identified(docs, key, text=F.col(text))
    names = [f"x{k}" for k in range(DIMENSIONS)]
    tokens = written(
        source.rows.select(ROW, "text").mapInArrow(
            _tokens(tokenizer, end_id), f"{ROW} long, n long, {', '.join(f'{x} double' for x in names)}, ids binary"
        ),
        "tokens",
    )
    box = tokens.agg(*[f(x) for f in (F.min, F.max) for x in names]).first()
    low, high = ([v or 0.0 for v in part] for part in (box[:DIMENSIONS], box[DIMENSIONS:]))
    curve = written(
        tokens.select(ROW, "n", *names)
        .mapInArrow(_positions(low, high, BITS), f"{ROW} long, n long, place long")
        .repartitionByRange(partitions(spark), "place", ROW)
        .sortWithinPartitions("place", ROW)
        .select(ROW, "n")
        .mapInArrow(_running, f"{ROW} long, part int, before long, n long"),
        "curve",
    )
    # one row per task of the sort
    totals = sorted((r.part, r.total) for r in curve.groupBy("part").agg(F.sum("n").alias("total")).collect())
    ends = np.cumsum([0] + [total for _, total in totals])
    shifts = spark.createDataFrame(
        [(part, int(before)) for (part, _), before in zip(totals, ends)], "part int, shift long"
    )
    places = curve.join(F.broadcast(shifts), "part").select(ROW, (F.col("before") + F.col("shift")).alias("place"), "n")
    pieces = (
        tokens.select(ROW, "ids")
        .join(places, ROW)
        .select(ROW, "place", "n", "ids")
        .mapInArrow(
            _pieces(length),
            f"{ROW} long, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary",
        )
    )
    return source.restore(pieces)


def digest(pieces: DataFrame) -> DataFrame:
    """The pieces with a checksum in place of their ids."""
    return pieces.select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"
    )


@registered("op10_hilbert_packing")
def hilbert_packing(spark, folder):
    """All documents in sequences of 2048 tokens."""
    return digest(pack(table(spark, folder, "documents"), public_tokenizers.path("word_bpe_49k.json")))
