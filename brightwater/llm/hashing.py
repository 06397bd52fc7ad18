"""Vectorised hashing of bytes, words and word shingles inside a task.

All functions work on one bounded block of concatenated texts. A substring hash is the difference of
two prefix sums of a polynomial modulo 2^64, moved back to position 0 and mixed, so that every hash of
a block costs a few array operations and no Python loop runs per word.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
#: Blocks of texts are processed up to this many bytes at a time; a longer text is a block of its own.
BLOCK_BYTES = 512 << 10

#: Characters beyond ASCII that separate words, like the ASCII ones that are no word bytes.
_OTHER = r"[^\x00-\x7F\p{L}\p{N}\p{M}]+"

_tables: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every input bit."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def constants(n: int, seed: int) -> np.ndarray:
    """n fixed 64-bit numbers."""
    return mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(_BASE) + np.uint64(seed))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if "up" not in _tables or len(_tables["up"]) < n:
        size = max(n, 1 << 16)
        for name, base in (("up", _BASE), ("down", _INVERSE)):
            steps = np.full(size, base, dtype=np.uint64)
            steps[0] = 1
            _tables[name] = np.cumprod(steps, dtype=np.uint64)
    return _tables["up"], _tables["down"]


def prefix_sums(data: np.ndarray) -> np.ndarray:
    """Prefix sums from which range_hash reads the hash of any substring of data."""
    if "bytes" not in _tables:
        _tables["bytes"] = constants(256, 17)
    up, _ = _powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(_tables["bytes"][data] * up[: len(data)], out=sums[1:])
    return sums


def range_hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of data[start:end]; equal substrings have equal hashes wherever they stand."""
    _, down = _powers(len(sums))
    return mix((sums[end] - sums[start]) * down[start])


def text_blocks(texts: pa.Array, block_bytes: int = BLOCK_BYTES):
    """Yield (first row, last row + 1) of blocks of at most block_bytes, or of one longer text."""
    lengths = np.asarray(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False))
    first, size = 0, 0
    for row, length in enumerate(lengths.tolist()):
        if row > first and size + length > block_bytes:
            yield first, row
            first, size = row, 0
        size += length + 1
    if len(lengths) > first:
        yield first, len(lengths)


def joined(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The texts with one newline after each, and where each begins (one more entry for the end)."""
    data = np.frombuffer(b"\n".join(texts) + b"\n", dtype=np.uint8)
    sizes = np.fromiter((len(t) + 1 for t in texts), dtype=np.int64, count=len(texts))
    return data, np.concatenate(([0], np.cumsum(sizes)))


def _word_bytes() -> np.ndarray:
    if "word" not in _tables:
        table = np.zeros(256, dtype=bool)
        table[128:] = True
        for byte in b"0123456789_abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ":
            table[byte] = True
        _tables["word"] = table
    return _tables["word"]


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts in order, and the row of each.

    Words are runs of letters, digits, marks (Unicode L, N and M) and underscores, after lower-casing. A null
    text has none.
    """
    lowered = pc.utf8_lower(pc.fill_null(texts, ""))
    lowered = pc.replace_substring_regex(lowered, pattern=_OTHER, replacement=" ").cast(pa.binary()).to_pylist()
    data, begins = joined(lowered)
    inside = _word_bytes()[data]
    edges = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    if inside[0]:
        edges = np.concatenate(([0], edges))
    start, end = edges[0::2], edges[1::2]
    rows = np.searchsorted(begins, start, side="right") - 1
    return range_hash(prefix_sums(data), start, end), rows


def shingle_hashes(words: np.ndarray, rows: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all n-word shingles in order, and the row of each.

    A text of fewer words (but at least one) has one shingle of all of them.
    """
    weights = constants(n, 23)
    if len(words) >= n:
        total = words[: len(words) - n + 1] * weights[0]
        for k in range(1, n):
            total = total + words[k : len(words) - n + 1 + k] * weights[k]
        inside = rows[: len(total)] == rows[n - 1 :]
        total, owner = mix(total[inside]), rows[: len(inside)][inside]
    else:
        total, owner = np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=rows.dtype)
    named, first, counts = np.unique(rows, return_index=True, return_counts=True)
    few = counts < n
    if few.any():
        extra = [
            (words[a : a + c] * weights[:c]).sum(dtype=np.uint64)
            for a, c in zip(first[few].tolist(), counts[few].tolist())
        ]
        total = np.concatenate((total, mix(np.array(extra, dtype=np.uint64))))
        owner = np.concatenate((owner, named[few]))
        order = np.argsort(owner, kind="stable")
        total, owner = total[order], owner[order]
    return total, owner


def distinct(found: np.ndarray) -> np.ndarray:
    """The sorted distinct values."""
    found = np.sort(found)
    keep = np.ones(len(found), dtype=bool)
    np.not_equal(found[1:], found[:-1], out=keep[1:])
    return found[keep]


def text_shingles(texts: pa.Array, n: int = 5):
    """Yield (row, sorted distinct shingle hashes) for every text of an Arrow array."""
    for first, last in text_blocks(texts):
        total, owner = shingle_hashes(*word_hashes(texts.slice(first, last - first)), n)
        ends = np.searchsorted(owner, np.arange(last - first + 1), side="left").tolist()
        for k in range(last - first):
            yield first + k, distinct(total[ends[k] : ends[k + 1]])
