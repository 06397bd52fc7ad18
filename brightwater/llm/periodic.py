"""Periodic runs of words inside texts, by uniting suffix classes along descending common prefixes.

1. Words are numbered, texts of a block at once; the numbers of different texts never meet. Prefix doubling
   sorts the suffixes that share enough words with another one of their text, and gives the longest common
   prefixes (LCP) of neighbours.
2. Kruskal. Neighbours are united by decreasing LCP with union-find; every class keeps its positions in order.
   A position that joins a class meets its neighbours there. Two of them at a distance p of at most the LCP
   start a repetition of period p that ends LCP words after the second one. No smaller period fits: its
   positions would lie in between and would have been united before.
3. A repetition that the word before would continue is part of a longer one and is left to that.

Rows are independent: nothing is shuffled, and a text is never split.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brightwater.llm.frames import byte_list, ready, registered, table
from brightwater.llm.hashing import joined, text_blocks
from brightwater.llm.words import byte_set, coded, spans

#: Bytes that separate words.
SPACES = b" \t\n\v\f\r"
MIN_WORDS = 6
MIN_EXPONENT = 4
#: Positions in one block of an ordered set.
PLACES = 512

_RUNS = "array<struct<start: long, length: long, period: long>>"


class Places:
    """An ordered set of positions, in blocks of bounded length."""

    __slots__ = ("blocks", "firsts", "size")

    def __init__(self, place: int):
        self.blocks, self.firsts, self.size = [[place]], [place], 1

    def add(self, place: int) -> tuple[int | None, int | None]:
        """Insert a position that is not in the set; the members before and after it."""
        k = max(bisect_right(self.firsts, place) - 1, 0)
        block = self.blocks[k]
        i = bisect_left(block, place)
        before = block[i - 1] if i else None
        if i < len(block):
            after = block[i]
        else:
            after = self.firsts[k + 1] if k + 1 < len(self.firsts) else None
        insort(block, place)
        self.firsts[k] = block[0]
        self.size += 1
        if len(block) > PLACES:
            half = len(block) // 2
            self.blocks[k : k + 1] = [block[:half], block[half:]]
            self.firsts.insert(k + 1, block[half])
        return before, after

    def __iter__(self):
        for block in self.blocks:
            yield from block


def shared_suffixes(codes: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions that share words with another one, in suffix order, and the LCP of each with the one before.

    Every position whose LCP with a neighbour is ``least`` or more is there; the first LCP is 0.
    """
    n = len(codes)
    none = np.zeros(0, dtype=np.int64)
    if n < 2:
        return none, none
    active = np.argsort(codes, kind="stable")
    ordered = codes[active]
    new = np.append(True, ordered[1:] != ordered[:-1])
    at = np.arange(n)
    rank = np.empty(n, dtype=np.int64)
    rank[active] = np.maximum.accumulate(np.where(new, at, 0))
    active = active[~(new & np.append(new[1:], True))]
    levels, width, shared = [rank.astype(np.int32 if n < 1 << 31 else np.int64)], 1, active
    while len(active):
        follows = active + width
        later = np.where(follows < n, rank[np.minimum(follows, n - 1)] + 1, 0)
        key = rank[active] * (n + 1) + later
        order = np.argsort(key, kind="stable")
        active, key = active[order], key[order]
        head = rank[active]
        new = np.append(True, key[1:] != key[:-1])
        fresh = np.append(True, head[1:] != head[:-1])
        at = np.arange(len(active))
        inside = np.maximum.accumulate(np.where(new, at, 0)) - np.maximum.accumulate(np.where(fresh, at, 0))
        rank[active] = head + inside
        levels.append(rank.astype(levels[0].dtype))
        width *= 2
        active = active[~(new & np.append(new[1:], True))]
        if width <= least:
            shared = active
    if not len(shared):
        return none, none
    shared = shared[np.argsort(rank[shared], kind="stable")]
    a, b = shared[:-1].copy(), shared[1:].copy()
    for k in reversed(range(len(levels))):
        inside = np.maximum(a, b) < n
        same = inside & (levels[k][np.minimum(a, n - 1)] == levels[k][np.minimum(b, n - 1)])
        step = same.astype(np.int64) << k
        a += step
        b += step
    return shared, np.append(0, a - shared[:-1])


def _seeds(place: list[int], order: list[int], lcp: list[int], times: int) -> list[tuple[int, int, int]]:
    """(first position, distance, LCP) of positions that become neighbours within the LCP over ``times``."""
    root = list(range(len(place)))
    members: list[Places | None] = [None] * len(place)
    found = []

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for j in order:
        one, two = find(j - 1), find(j)
        large = members[one] or Places(place[one])
        small = members[two] or Places(place[two])
        if large.size < small.size:
            one, two, large, small = two, one, small, large
        reach = lcp[j] // times
        joining = list(small)
        for k, x in enumerate(joining):
            before, after = large.add(x)
            # two that join together were neighbours already, or the later one lies in between
            if before is not None and x - before <= reach and not (k and joining[k - 1] == before):
                found.append((before, x - before, lcp[j]))
            if after is not None and after - x <= reach and not (k + 1 < len(joining) and joining[k + 1] < after):
                found.append((x, after - x, lcp[j]))
        root[two] = one
        members[one], members[two] = large, None
    return found


def word_runs(codes: np.ndarray, min_words: int, min_exponent: int) -> np.ndarray:
    """Maximal runs (start, length, period) of a sequence of numbers, by start, then period."""
    least = min(max(min_words - p, (min_exponent - 1) * p) for p in range(1, min_words + 1))
    place, lcp = shared_suffixes(codes, least)
    picked = np.flatnonzero(lcp >= least)
    empty = np.zeros((0, 3), dtype=np.int64)
    if not len(picked):
        return empty
    order = picked[np.argsort(-lcp[picked], kind="stable")]
    found = _seeds(place.tolist(), order.tolist(), lcp.tolist(), min_exponent - 1)
    if not found:
        return empty
    start, period, shared = np.array(found, dtype=np.int64).T
    first = start == 0
    whole = first | (codes[np.maximum(start - 1, 0)] != codes[np.maximum(start - 1, 0) + period])
    whole &= shared + period >= min_words
    runs = np.unique(np.stack((start, period, shared + period), axis=1)[whole], axis=0)
    return runs[:, [0, 2, 1]]


def _found(min_words: int, min_exponent: int):
    breaks = byte_set(SPACES)

    def block(texts: pa.Array):
        data, begins = joined(byte_list(texts))
        rows = len(texts)
        start, end = spans(data, breaks)
        codes, words = coded(data, start, end)
        row = np.searchsorted(begins, start, side="right") - 1
        first = np.searchsorted(row, np.arange(rows + 1))
        runs = word_runs(row * max(len(words), 1) + codes, min_words, min_exponent)
        owner = row[runs[:, 0]] if len(runs) else np.zeros(0, dtype=np.int64)
        depth = np.zeros(len(codes) + 1, dtype=np.int64)
        np.add.at(depth, runs[:, 0] + runs[:, 2], 1)
        np.add.at(depth, runs[:, 0] + runs[:, 1], -1)
        stays = np.cumsum(depth[:-1]) == 0
        # kept words with the byte after each, which becomes a space
        marks = np.zeros(len(data) + 1, dtype=np.int8)
        marks[start[stays]] += 1
        marks[end[stays] + 1] -= 1
        mask = np.cumsum(marks[:-1], dtype=np.int8) > 0
        spaced = data.copy()
        spaced[end] = 32
        kept = spaced[mask]
        edges = np.concatenate(([0], np.cumsum(mask)))[begins]
        flat = kept.tobytes()
        texts = [flat[a : max(a, b - 1)] for a, b in zip(edges[:-1].tolist(), edges[1:].tolist())]
        offsets = np.searchsorted(owner, np.arange(rows + 1)).astype(np.int32)
        values = [runs[:, 0] - first[owner], runs[:, 1], runs[:, 2]]
        listed = pa.StructArray.from_arrays(
            [pa.array(v, pa.int64()) for v in values], names=["start", "length", "period"]
        )
        return (
            pa.array(np.diff(first), pa.int64()),
            pa.ListArray.from_arrays(pa.array(offsets), listed),
            pa.array(texts, pa.binary()).cast(pa.string()),
        )

    def run(batches):
        for batch in batches:
            for a, b in text_blocks(batch.column(1)):
                n, runs, kept = block(batch.column(1).slice(a, b - a))
                names = [*batch.schema.names[:1], "n_words", "runs", "collapsed"]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), n, runs, kept], names=names)

    return run


def periodic_runs(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    min_words: int = MIN_WORDS,
    min_exponent: int = MIN_EXPONENT,
) -> DataFrame:
    """The periodic runs of words of every text, and the text with each run cut to its first period.

    Words are separated by ASCII white space and compared by their bytes. A run is a stretch of words with
    smallest period q, at least ``min_words`` and ``min_exponent`` * q words long, that neither neighbouring word
    continues. Returns (key, n_words, runs, collapsed): ``runs`` are (start, length, period) by start, then
    period; a word is left out of ``collapsed`` if a run contains it after that run's first q words, the others
    are joined by one space.

    Null and empty texts have no words, no runs and an empty ``collapsed``. Rows are independent: null or
    repeated keys and equal texts give a row each; an empty table gives none. Runs that overlap are all
    reported. Other columns are not read. A text is held by one task, with some 100 bytes a word.
    """
    if min_exponent < 2 or min_words < 2:
        raise ValueError("a run repeats at least once")
    if key in ("n_words", "runs", "collapsed"):
        raise ValueError(f"the key must not be named {key}")
    ready(docs.sparkSession)
    kind = docs.schema[key].dataType.simpleString()
    return docs.select(F.col(f"`{key}`"), F.col(f"`{text}`")).mapInArrow(
        _found(min_words, min_exponent), f"`{key}` {kind}, n_words long, runs {_RUNS}, collapsed string"
    )


@registered("op13_periodic_runs")
def periodic_run_detection(spark, folder):
    """Runs of every document; of those whose hashed id ends in 0, a tail is repeated first.

    The tail of such a document becomes a repetition of its first p words, as the contract says. A null
    id has no hash and changes nothing.
    """
    docs = table(spark, folder, "documents")
    words = docs.select(
        "doc_id",
        "text",
        F.crc32(F.col("doc_id").cast("string").cast("binary")).alias("h"),
        F.regexp_extract_all("text", F.lit("[^\\x20\\x09-\\x0D]+"), F.lit(0)).alias("words"),
    )
    sized = words.withColumn("n", F.size("words").cast("long")).withColumn("g", F.floor(F.col("h") / 10))
    cut = sized.withColumn("a", F.col("g") % F.greatest("n", F.lit(1)))
    cut = cut.withColumn("p", 1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8)))
    unit = F.expr("slice(words, int(a) + 1, int(p))")
    times = F.ceil((F.col("n") - F.col("a")) / F.col("p")).cast("int")
    tail = F.slice(F.flatten(F.array_repeat(unit, times)), F.lit(1), (F.col("n") - F.col("a")).cast("int"))
    looped = F.array_join(F.concat(F.expr("slice(words, 1, int(a))"), tail), " ")
    changed = cut.select("doc_id", F.when((F.col("h") % 10 == 0) & (F.col("n") > 0), looped).otherwise(F.col("text")).alias("text"))
    found = periodic_runs(changed)
    best = F.array_max(F.transform("runs", lambda r: F.struct(r.length.alias("l"), (-r.start).alias("s"), (-r.period).alias("q"))))
    lines = F.transform("runs", lambda r: F.concat_ws(",", r.start, r.length, r.period))
    told = F.concat(F.array_join(lines, "\n"), F.when(F.size("runs") > 0, "\n").otherwise(""))
    return found.withColumn("best", best).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        (-F.col("best.s")).alias("start"),
        F.col("best.l").alias("length"),
        (-F.col("best.q")).alias("period"),
        F.expr("(1000 * best.l) div (-best.q)").alias("exponent_milli"),
        F.sha2(told, 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
