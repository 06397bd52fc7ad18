"""Words of a block of texts as arrays: where they stand and which of them are equal."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def byte_set(members: bytes) -> np.ndarray:
    """A table of 256 flags, true for the given bytes."""
    table = np.zeros(256, dtype=bool)
    table[np.frombuffer(members, dtype=np.uint8)] = True
    return table


def spans(data: np.ndarray, breaks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the runs of bytes outside ``breaks`` start and end; data ends with a break."""
    inside = ~breaks[data]
    edges = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    if len(inside) and inside[0]:
        edges = np.concatenate(([0], edges))
    return edges[0::2], edges[1::2]


def coded(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    """A number for every word data[start:end], equal for equal words, and the bytes it stands for.

    Words are in order and do not overlap. The numbers index the returned array.
    """
    if not len(start):
        return np.zeros(0, dtype=np.int64), pa.array([], pa.binary())
    edges = np.empty(2 * len(start), dtype=np.int32)
    edges[0::2], edges[1::2] = start, end
    every = pa.Array.from_buffers(
        pa.binary(), len(edges) - 1, [None, pa.py_buffer(edges), pa.py_buffer(np.ascontiguousarray(data))]
    )
    words = every.take(pa.array(np.arange(0, len(edges) - 1, 2)))
    found = words.dictionary_encode()
    return found.indices.to_numpy().astype(np.int64), found.dictionary


def stretches(begins: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers begins[i], begins[i] + 1, ... (sizes[i] of them), for one i after the other."""
    done = np.cumsum(sizes) - sizes
    return np.repeat(begins - done, sizes) + np.arange(int(sizes.sum()))


def gathered(batches, size: int, texts: int):
    """Record batches joined until column ``texts`` has ``size`` bytes, as tables."""
    held, have = [], 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        have += batch.column(texts).nbytes
        if have >= size:
            yield pa.Table.from_batches(held).combine_chunks()
            held, have = [], 0
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def column(table: pa.Table, k: int) -> pa.Array:
    """Column k of a table as one array."""
    chunks = table.column(k).chunks
    return chunks[0] if len(chunks) == 1 else pa.concat_arrays(chunks)


def plain_strings(values: pa.Array) -> pa.Array:
    """Strings without nulls (null is empty) and with 32-bit offsets."""
    return pc.fill_null(values, "").cast(pa.string())
