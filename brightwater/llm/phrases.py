"""Prefix-free parsing of byte strings into overlapping phrases cut at rolling-hash triggers.

A trigger is a position whose gram hash is the first minimum of some window of LENGTH bytes, so it
depends on the bytes of that window alone. The phrase of a trigger spans all windows it governs.
Consecutive phrases overlap by LENGTH - 1 bytes: every string of LENGTH bytes lies in exactly one
phrase, at the same distance from the trigger wherever it occurs.
"""

from __future__ import annotations

import numpy as np

from brightwater.llm.hashing import prefix_sums, range_hash

#: Bytes hashed at a trigger.
GRAM = 24


def _window_minima(values: np.ndarray, width: int) -> np.ndarray:
    """The minimum of every run of width values."""
    have, low = 1, values
    while have * 2 <= width:
        low = np.minimum(low[:-have], low[have:])
        have *= 2
    rest = width - have
    return np.minimum(low[: len(low) - rest], low[rest:]) if rest else low


def parse(data: np.ndarray, begins: np.ndarray, length: int, gram: int = GRAM) -> dict:
    """Phrases of the texts in data (see hashing.joined; begins counts one separator byte per text).

    Returns arrays, one entry per phrase in corpus order: row, low and high (first and last window
    start, relative to the text), trigger (gram hash), phrase (hash of its bytes); and the prefix sums.
    """
    sums = prefix_sums(data)
    n = len(data)
    empty = np.zeros(0, dtype=np.int64)
    none = {"row": empty, "place": empty, "low": empty, "high": empty, "trigger": empty.astype(np.uint64)}
    none |= {"phrase": none["trigger"], "sums": sums}
    if n < length:
        return none
    at = np.arange(n - gram + 1)
    grams = range_hash(sums, at, at + gram)
    width = length - gram + 1
    minima = _window_minima(grams, width)
    sizes = np.diff(begins) - 1
    starts = np.zeros(len(minima) + 1, dtype=np.int32)
    has = np.flatnonzero(sizes >= length)
    np.add.at(starts, begins[has], 1)
    np.add.at(starts, begins[has] + sizes[has] - length + 1, -1)
    inside = np.cumsum(starts[:-1]) > 0
    edge = np.ones(len(minima), dtype=bool)
    np.not_equal(minima[1:], minima[:-1], out=edge[1:])
    edge[begins[has]] = True
    edge[1:] |= inside[1:] != inside[:-1]
    first = np.flatnonzero(edge)
    last = np.concatenate((first[1:], [len(minima)])) - 1
    keep = inside[first]
    low, limit = first[keep], last[keep]
    lows, highs, places = [], [], []
    steps = np.arange(width)
    while len(low):
        place = np.empty(len(low), dtype=np.int64)
        for a in range(0, len(low), 4096):
            block = low[a : a + 4096]
            place[a : a + 4096] = block + np.argmin(grams[block[:, None] + steps], axis=1)
        high = np.minimum(limit, place)
        lows.append(low)
        highs.append(high)
        places.append(place)
        more = high < limit
        low, limit = high[more] + 1, limit[more]
    if not lows:
        return none
    low, high, place = map(np.concatenate, (lows, highs, places))
    if len(lows) > 1:
        order = np.argsort(low, kind="stable")
        low, high, place = low[order], high[order], place[order]
    row = np.searchsorted(begins, low, side="right") - 1
    phrase = range_hash(sums, low, high + length) ^ (place - low).astype(np.uint64)
    return {
        "row": row,
        "place": place,
        "low": low - begins[row],
        "high": high - begins[row],
        "trigger": grams[place],
        "phrase": phrase,
        "sums": sums,
    }
