"""Removal of byte strings that repeat anywhere in a corpus, by prefix-free parsing.

1. Parse. Rolling-hash triggers cut every text into phrases that overlap by ``length - 1`` bytes
   (phrases.parse). A string of ``length`` bytes lies in one phrase, at a place its bytes determine.
2. Dictionary. Phrases meet by trigger. Every occurrence of a phrase but its first in corpus order is
   removed without looking at its bytes again, which settles nearly all of a repetitive corpus. Two
   different phrases can share a string of ``length`` bytes only if they also share the bytes left or
   right of the trigger up to half of it; only those phrases go on.
3. Suffix array. The suffixes of such dictionary phrases are sorted by their first ``length`` bytes and,
   if equal, by corpus order, which is what the parse contributes. A suffix equal to its predecessor
   repeats an earlier string.

Equal trigger bytes can stand in any share of all texts. Phrases are therefore deduplicated in the map
task before they are shuffled, triggers with many contexts are spread over all partitions, and large
groups of suffixes are sorted in salted parts whose survivors meet in a second step.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from brightwater.llm.frames import (
    ROW,
    byte_list,
    identified,
    partitions,
    registered,
    table,
    whole_groups,
)
from brightwater.llm.hashing import joined, mix, prefix_sums, range_hash, text_blocks
from brightwater.llm.phrases import GRAM, parse
from brightwater.plans.scratch import written

LENGTH = 100
#: Text whose phrases are combined before they leave a map task.
COMBINE_BYTES = 8 << 20
#: A trigger with more different phrases than this in one combined block is spread.
SPREAD_PHRASES = 64
#: Phrases in one unsalted group of suffixes.
GROUP_PHRASES = 2048

_FIELDS = (
    ("trigger", "u8"), ("phrase", "u8"), ("left", "u4"), ("right", "u4"),
    ("row", "i8"), ("low", "i4"), ("span", "u1"), ("off", "u1"), ("flag", "u1"),
)
_ENTRY = sum(int(kind[1]) for _, kind in _FIELDS)
_KNOWN, _HOT = 1, 2


def _blob(columns: dict[str, np.ndarray], pick: slice) -> bytes:
    return b"".join(columns[name][pick].astype(f"<{kind}").tobytes() for name, kind in _FIELDS)


def _unblob(blobs: list[bytes]) -> dict[str, np.ndarray]:
    parts: dict[str, list[np.ndarray]] = {name: [] for name, _ in _FIELDS}
    for blob in blobs:
        count, at = len(blob) // _ENTRY, 0
        for name, kind in _FIELDS:
            parts[name].append(np.frombuffer(blob, dtype=f"<{kind}", count=count, offset=at))
            at += count * int(kind[1])
    return {name: np.concatenate(part) for name, part in parts.items()}


def _phrases(rows: np.ndarray, texts: list[bytes], length: int) -> dict[str, np.ndarray]:
    half = (length - GRAM) // 2
    data, begins = joined(texts)
    found = parse(data, begins, length)
    sums, row, place = found["sums"], found["row"], found["place"]
    low, high = found["low"] + begins[row], found["high"] + begins[row]
    left = np.where(
        place - low >= half, range_hash(sums, np.maximum(place - half, 0), place + GRAM) | np.uint64(1), np.uint64(0)
    )
    right = np.where(
        place - high < half,
        range_hash(sums, place, np.minimum(place + length - half, len(data))) | np.uint64(1),
        np.uint64(0),
    )
    return {
        "trigger": found["trigger"],
        "phrase": found["phrase"],
        "left": (left & np.uint64(0xFFFFFFFF)).astype(np.uint32),
        "right": (right & np.uint64(0xFFFFFFFF)).astype(np.uint32),
        "row": rows[row],
        "low": found["low"].astype(np.int32),
        "span": (high - low).astype(np.uint8),
        "off": (place - low).astype(np.uint8),
    }


def _combined(parts: list[dict[str, np.ndarray]], buckets: int, spread: int) -> pa.RecordBatch:
    """Phrases of one block, deduplicated and dealt to the buckets of their triggers."""
    x = {name: np.concatenate([p[name] for p in parts]) for name in parts[0]}
    if np.any(x["row"][1:] < x["row"][:-1]):
        order = np.lexsort((x["low"], x["row"]))
        x = {name: values[order] for name, values in x.items()}
    n = len(x["row"])
    x["flag"] = np.zeros(n, dtype=np.uint8)
    order = np.argsort(x["phrase"], kind="stable")
    trigger, phrase = x["trigger"][order], x["phrase"][order]
    again = np.zeros(n, dtype=bool)
    again[1:] = (phrase[1:] == phrase[:-1]) & (trigger[1:] == trigger[:-1])
    x["flag"][order[again]] = _KNOWN

    bucket = mix(x["trigger"])
    first = np.flatnonzero(x["flag"] == 0)
    first = first[np.argsort(x["trigger"][first], kind="stable")]
    trigger = x["trigger"][first]
    starts = np.flatnonzero(np.append(True, trigger[1:] != trigger[:-1])) if len(first) else first
    sizes = np.diff(np.append(starts, len(first)))
    rank = np.arange(len(first)) - np.repeat(starts, sizes)
    hot = np.repeat(sizes > spread, sizes)
    x["flag"][first[hot]] |= _HOT
    away = first[hot & (rank >= spread)]
    bucket[away] = mix(x["trigger"][away] ^ x["phrase"][away])
    known = x["flag"] == _KNOWN
    bucket[known] = mix(x["row"][known].astype(np.uint64))

    number = (bucket % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(number, kind="stable")
    x = {name: values[order] for name, values in x.items()}
    used, at = np.unique(number[order], return_index=True)
    ends = np.append(at[1:], n)
    blobs = [_blob(x, slice(a, b)) for a, b in zip(at.tolist(), ends.tolist())]
    return pa.record_batch({"bucket": pa.array(used, pa.int64()), "blob": pa.array(blobs, pa.binary())})


def _parse_texts(length: int, buckets: int, spread: int):
    def run(batches):
        held, size = [], 0
        with np.errstate(over="ignore"):
            for batch in batches:
                rows = batch.column(0).to_numpy()
                texts = batch.column(1)
                for a, b in text_blocks(texts):
                    block = byte_list(texts.slice(a, b - a))
                    found = _phrases(rows[a:b], block, length)
                    if len(found["row"]):
                        held.append(found)
                        size += sum(map(len, block))
                    if size >= COMBINE_BYTES:
                        yield _combined(held, buckets, spread)
                        held, size = [], 0
            if held:
                yield _combined(held, buckets, spread)

    return run


def _salt_bits(count: np.ndarray, group: int) -> np.ndarray:
    return np.ceil(np.log2(np.maximum(count / group, 1))).astype(np.int64)


def _sharing(trigger: np.ndarray, side: np.ndarray, hot: np.ndarray, hot_bits: int, most: int):
    """Which phrases share a side with another one, and how many salt bits their group needs."""
    bits = np.full(len(side), -1, dtype=np.int64)
    valid = np.flatnonzero(side)
    order = valid[np.lexsort((side[valid], trigger[valid]))]
    if len(order):
        new = np.ones(len(order), dtype=bool)
        new[1:] = (side[order][1:] != side[order][:-1]) | (trigger[order][1:] != trigger[order][:-1])
        starts = np.flatnonzero(new)
        sizes = np.diff(np.append(starts, len(order)))
        count = np.repeat(sizes, sizes)
        bits[order] = np.where(count > 1, _salt_bits(count, most), -1)
    bits[hot & (side != 0)] = hot_bits
    return bits


def _dictionary(blobs: list[bytes], hot_bits: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and code of repeated phrases (kind 0) and of phrases whose suffixes must be compared.

    Code: low << 32 | span << 25 | off << 18 | left bits + 1 << 9 | right bits + 1 << 1 | compare.
    """
    x = _unblob(blobs)
    plain = (x["low"].astype(np.int64) << 32) | (x["span"].astype(np.int64) << 25) | (x["off"].astype(np.int64) << 18)
    known = (x["flag"] & _KNOWN) > 0
    rows, codes = [x["row"][known]], [plain[known]]
    pick = np.flatnonzero(~known)
    if len(pick):
        order = pick[np.lexsort((x["low"][pick], x["row"][pick], x["phrase"][pick], x["trigger"][pick]))]
        trigger, phrase = x["trigger"][order], x["phrase"][order]
        new_trigger = np.append(True, trigger[1:] != trigger[:-1])
        first = new_trigger | np.append(True, phrase[1:] != phrase[:-1])
        again = order[~first]
        rows.append(x["row"][again])
        codes.append(plain[again])
        group = np.cumsum(new_trigger) - 1
        marked = np.zeros(group[-1] + 1, dtype=bool)
        marked[group[(x["flag"][order] & _HOT) > 0]] = True
        kept, hot = order[first], marked[group[first]]
        left = _sharing(x["trigger"][kept], x["left"][kept], hot, hot_bits, most)
        right = _sharing(x["trigger"][kept], x["right"][kept], hot, hot_bits, most)
        go = (left >= 0) | (right >= 0)
        rows.append(x["row"][kept[go]])
        codes.append(plain[kept[go]] | ((left[go] + 1) << 9) | ((right[go] + 1) << 1) | 1)
    return np.concatenate(rows), np.concatenate(codes)


def _compare_phrases(hot_bits: int, most: int):
    def run(batches):
        bucket, held = None, []
        with np.errstate(over="ignore"):
            for batch in batches:
                for number, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    if number != bucket and held:
                        yield from _code_batches(held, hot_bits, most)
                        held = []
                    bucket = number
                    held.append(blob)
            if held:
                yield from _code_batches(held, hot_bits, most)

    return run


def _code_batches(blobs, hot_bits, most):
    rows, codes = _dictionary(blobs, hot_bits, most)
    for a in range(0, len(rows), 1 << 16):
        yield pa.record_batch({ROW: pa.array(rows[a : a + (1 << 16)]), "code": pa.array(codes[a : a + (1 << 16)])})


def _packed_texts(batches):
    """Texts travel through the shuffles compressed."""
    packer = zstandard.ZstdCompressor(level=3, write_content_size=True)
    for batch in batches:
        packed = [packer.compress(t) for t in byte_list(batch.column(1))]
        yield pa.record_batch({ROW: batch.column(0), "packed": pa.array(packed, pa.binary())})


def _merged(low: np.ndarray, high: np.ndarray, reach: int) -> tuple[np.ndarray, np.ndarray]:
    """Windows starting in [low, high] as maximal runs: runs whose bytes touch become one."""
    order = np.argsort(low, kind="stable")
    low, high = low[order], np.maximum.accumulate(high[order])
    new = np.append(True, low[1:] > high[:-1] + reach)
    starts = np.flatnonzero(new)
    return low[starts], high[np.append(starts[1:], len(low)) - 1]


_SUFFIX_SCHEMA = f"{ROW} long, code long, key long, salt int, bits int, start int, payload binary"


def _cut_phrases(length: int):
    """Repeated spans of each text, and the phrases whose suffixes must be compared, by shared side."""
    half = (length - GRAM) // 2

    def sides(row, data, codes):
        for code in codes[(codes & 1) > 0].tolist():
            low, span, off = code >> 32, code >> 25 & 127, code >> 18 & 127
            place, high = low + off, low + span
            if bits := code >> 9 & 511:
                last = min(high, place - half)
                key = xxhash.xxh3_64_intdigest(data[place - half : place + GRAM], 1)
                yield row, key, bits - 1, low, data[low : last + length]
            if bits := code >> 1 & 255:
                start = max(low, place - half + 1)
                key = xxhash.xxh3_64_intdigest(data[place : place + length - half], 2)
                yield row, key, bits - 1, start, data[start : high + length]

    def run(batches):
        unpack = zstandard.ZstdDecompressor()
        for batch in batches:
            out: dict[str, list] = {name: [] for name in (ROW, "code", "key", "salt", "bits", "start", "payload")}

            def add(*values):
                for held, value in zip(out.values(), values):
                    held.append(value)

            codes_of = batch.column(2)
            for k, (row, packed) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())):
                codes = codes_of[k].values.to_numpy()
                known = codes[(codes & 1) == 0]
                if len(known):
                    low = known >> 32
                    low, high = _merged(low, low + (known >> 25 & 127), 1)
                    for a, b in zip(low.tolist(), high.tolist()):
                        add(row, a << 32 | b, None, None, None, None, None)
                if len(known) < len(codes):
                    data = unpack.decompress(packed) if packed else b""
                    for r, key, bits, start, payload in sides(row, data, codes):
                        salt = (r * 0x9E3779B1 >> 7) & ((1 << bits) - 1)
                        add(r, None, key - (1 << 63), salt, bits, start, payload)
            yield pa.record_batch(
                {
                    ROW: pa.array(out[ROW], pa.int64()),
                    "code": pa.array(out["code"], pa.int64()),
                    "key": pa.array(out["key"], pa.int64()),
                    "salt": pa.array(out["salt"], pa.int32()),
                    "bits": pa.array(out["bits"], pa.int32()),
                    "start": pa.array(out["start"], pa.int32()),
                    "payload": pa.array(out["payload"], pa.binary()),
                }
            )

    return run


def _sorted_suffixes(length: int):
    """Sort the suffixes of complete groups of phrases; equal neighbours repeat an earlier string.

    Gives runs of repeated suffixes (code) and, of salted groups, the first suffix of each kind.
    """
    windows = np.lib.stride_tricks.sliding_window_view

    def work(found: pa.Table):
        payload = byte_list(found["payload"].combine_chunks())
        sizes = np.fromiter((len(p) for p in payload), np.int64, len(payload))
        begins = np.concatenate(([0], np.cumsum(sizes)))[:-1]
        data = np.frombuffer(b"".join(payload), dtype=np.uint8)
        counts = sizes - length + 1
        phrase = np.repeat(np.arange(len(payload)), counts)
        inner = np.arange(len(phrase)) - np.repeat(np.cumsum(counts) - counts, counts)
        at = begins[phrase] + inner
        row = found[ROW].to_numpy()[phrase]
        start = found["start"].to_numpy()[phrase].astype(np.int64) + inner
        salt = found["salt"].to_numpy()[phrase]
        key = found["key"].to_numpy()[phrase]
        corpus = np.lexsort((start, row, salt, key))
        suffix = windows(data, length)[at[corpus]].view(f"S{length}").ravel()
        number = _suffix_order(suffix, key[corpus], salt[corpus])
        order = corpus[number]
        same = np.zeros(len(order), dtype=bool)
        ranked = suffix[number]
        same[1:] = (
            (ranked[1:] == ranked[:-1])
            & (salt[order][1:] == salt[order][:-1])
            & (key[order][1:] == key[order][:-1])
        )
        repeated = np.zeros(len(order), dtype=bool)
        repeated[order[same]] = True
        first = np.zeros(len(order), dtype=bool)
        first[order[~same]] = True
        # windows of one phrase are neighbours: runs of repeated ones become one row
        pick = np.flatnonzero(repeated)
        if len(pick):
            edge = np.append(True, (pick[1:] != pick[:-1] + 1) | (phrase[pick][1:] != phrase[pick][:-1]))
            a = pick[edge]
            b = pick[np.append(np.flatnonzero(edge)[1:], len(pick)) - 1]
            yield _resolved(row[a], (start[a] << 32) | start[b])
        salted = np.flatnonzero(first & (found["bits"].to_numpy()[phrase] > 0))
        if len(salted):
            sums = prefix_sums(data)
            hashes = range_hash(sums, at[salted], at[salted] + length)
            yield _resolved(row[salted], start[salted], key[salted], hashes.view(np.int64))

    def run(batches):
        with np.errstate(over="ignore"):
            for found in whole_groups(batches, ["key", "salt"]):
                yield from work(found)

    return run


def _suffix_order(suffix: np.ndarray, key: np.ndarray, salt: np.ndarray) -> np.ndarray:
    """Order by group, then suffix bytes; stable, so equal suffixes stay in corpus order."""
    new = np.append(True, (key[1:] != key[:-1]) | (salt[1:] != salt[:-1]))
    group = (np.cumsum(new) - 1).astype(">u4")
    width = suffix.dtype.itemsize
    keyed = np.empty((len(suffix), width + 4), dtype=np.uint8)
    keyed[:, :4] = group.view(np.uint8).reshape(-1, 4)
    keyed[:, 4:] = suffix.view(np.uint8).reshape(-1, width)
    return np.argsort(keyed.view(f"S{width + 4}").ravel(), kind="stable")


def _resolved(row, code, key=None, suffix=None) -> pa.RecordBatch:
    none = pa.nulls(len(row), pa.int64())
    return pa.record_batch(
        {
            ROW: pa.array(row, pa.int64()),
            "code": pa.array(code, pa.int64()),
            "key": none if key is None else pa.array(key, pa.int64()),
            "suffix": none if suffix is None else pa.array(suffix, pa.int64()),
        }
    )


def _kept_texts(length: int, whole_characters: bool):
    """Cut the repeated spans out of each text."""

    def run(batches):
        unpack = zstandard.ZstdDecompressor()
        for batch in batches:
            sizes, kept, starts, stops, counts = [], [], [], [], []
            codes_of = batch.column(2)
            for k, packed in enumerate(batch.column(1).to_pylist()):
                data = unpack.decompress(packed) if packed else b""
                sizes.append(len(data))
                codes = codes_of[k]
                if not codes.is_valid:
                    kept.append(data)
                    counts.append(0)
                    continue
                values = codes.values.to_numpy()
                low, high = _merged(values >> 32, values & 0xFFFFFFFF, length)
                spans = list(zip(low.tolist(), (high + length).tolist()))
                if whole_characters:
                    spans = [s for s in (_inner_characters(data, *s) for s in spans) if s[0] < s[1]]
                pieces, at = [], 0
                for a, b in spans:
                    pieces.append(data[at:a])
                    at = b
                kept.append(b"".join([*pieces, data[at:]]))
                counts.append(len(spans))
                starts += [a for a, _ in spans]
                stops += [b for _, b in spans]
            offsets = pa.array(np.concatenate(([0], np.cumsum(counts))).astype(np.int32))
            spans = pa.StructArray.from_arrays(
                [pa.array(starts, pa.int64()), pa.array(stops, pa.int64())], names=["start", "stop"]
            )
            yield pa.record_batch(
                {
                    ROW: batch.column(0),
                    "n_bytes": pa.array(sizes, pa.int64()),
                    "kept": pa.array(kept, pa.binary()),
                    "spans": pa.ListArray.from_arrays(offsets, spans),
                }
            )

    return run


def _inner_characters(data: bytes, a: int, b: int) -> tuple[int, int]:
    """The span without the bytes of characters that it only touches."""
    while a < b and data[a] & 0xC0 == 0x80:
        a += 1
    while b > a and b < len(data) and data[b] & 0xC0 == 0x80:
        b -= 1
    return a, b


def remove_repeats(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    length: int = LENGTH,
    whole_characters: bool = False,
    spread: int = SPREAD_PHRASES,
    group: int = GROUP_PHRASES,
) -> DataFrame:
    """Cut from every text each byte covered by a ``length``-byte string that also starts earlier.

    Earlier is a smaller key or, in the same text, an earlier byte. Strings never cross texts and are
    judged on the input. Returns (key, n_bytes, kept, spans): UTF-8 bytes before, the bytes left, and
    the removed runs as byte offsets [start, stop). ``whole_characters`` leaves a character in place
    if a run covers only some of its bytes, so that what is left is UTF-8. ``spread`` and ``group`` say
    from which size triggers are spread and groups of suffixes salted; the result does not depend on them.

    Null texts are empty. Rows with a null or repeated key are texts of their own, ordered by (key,
    text) with null keys last. Texts shorter than ``length`` are returned whole; an empty table gives an
    empty result. Other columns are not read.
    """
    if not GRAM + 8 <= length <= GRAM + 127:
        raise ValueError(f"length must lie between {GRAM + 8} and {GRAM + 127}")
    spark = docs.sparkSession
    source = identified(docs, key, text=F.col(text))
    texts = source.rows
    buckets = max(16, partitions(spark))
    hot_bits = max(1, math.ceil(math.log2(buckets)))
    codes = (
        texts.select(ROW, "text")
        .mapInArrow(_parse_texts(length, buckets, spread), "bucket long, blob binary")
        .repartition(buckets, "bucket")
        .sortWithinPartitions("bucket")
        .mapInArrow(_compare_phrases(hot_bits, group), f"{ROW} long, code long")
    )
    packed = texts.select(ROW, "text").mapInArrow(_packed_texts, f"{ROW} long, packed binary")
    listed = codes.groupBy(ROW).agg(F.collect_list("code").alias("codes"))
    cut = written(
        packed.join(listed, ROW).select(ROW, "packed", "codes").mapInArrow(_cut_phrases(length), _SUFFIX_SCHEMA),
        "phrases",
    )
    suffixes = written(
        cut.where("code is null")
        .repartition("key", "salt")
        .sortWithinPartitions("key", "salt")
        .select(ROW, "key", "salt", "bits", "start", "payload")
        .mapInArrow(_sorted_suffixes(length), f"{ROW} long, code long, key long, suffix long"),
        "suffixes",
    )
    earlier = Window.partitionBy("key", "suffix").orderBy(ROW, "code")
    second = (
        suffixes.where("key is not null")
        .withColumn("nth", F.row_number().over(earlier))
        .where("nth > 1")
        .select(ROW, (F.shiftleft("code", 32).bitwiseOR(F.col("code"))).alias("code"))
    )
    spans = (
        cut.where("code is not null")
        .select(ROW, "code")
        .unionByName(suffixes.where("key is null").select(ROW, "code"))
        .unionByName(second)
        .groupBy(ROW)
        .agg(F.collect_list("code").alias("codes"))
    )
    kept = (
        packed.join(spans, ROW, "left")
        .select(ROW, "packed", "codes")
        .mapInArrow(
            _kept_texts(length, whole_characters),
            f"{ROW} long, n_bytes long, kept binary, spans array<struct<start: long, stop: long>>",
        )
    )
    return source.restore(kept)


@registered("op1_suffix_array_dedup")
def suffix_array_dedup(spark, folder):
    """Every document with the number of bytes and runs removed and the digest of what is left."""
    kept = remove_repeats(table(spark, folder, "documents"))
    return kept.select(
        "doc_id",
        "n_bytes",
        (F.col("n_bytes") - F.length("kept")).cast("long").alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )
