"""Collocations: phrases that occur more often than their parts suggest, per group of texts.

1. Only the longest windows are counted. A window is a word and the next ones of its piece as lead columns,
   padded at the piece's end. Equal windows of a block are counted in the map task; tasks send them, packed,
   to buckets of their first words.
2. A bucket holds all windows that begin alike, so it knows which beginnings are rare. Rare endings are
   padded too, and windows that became equal are added up. This loses no frequent phrase.
3. Spark's ROLLUP over the lead columns sums these windows to the counts of all shorter prefixes: words,
   phrases of every length, and, without any word, the words of the group.
4. Frequent phrases meet the counts of their parts, and the phrases inside them, by joins on the phrase.

Very common beginnings would fill one bucket. Those with a two-thousandth of all windows or more, a list of
bounded length, are spread by the next word; what a bucket then does not know, it leaves to the ROLLUP.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brightwater.llm.frames import byte_list, partitions, ready, registered, table
from brightwater.llm.hashing import joined, mix, prefix_sums, range_hash, text_blocks
from brightwater.llm.words import byte_set, coded, column, gathered, plain_strings, spans
from brightwater.plans.scratch import written

LEAST = 100
LONGEST = 5
TOP = 2000
#: A beginning with more than 1 / HOT of all windows is spread.
HOT = 2000
#: Texts whose windows are counted together before they leave a map task.
BLOCK = 8 << 20
#: Parts of a bucket, which a task takes one after the other.
SPLITS = 8
#: Stands for no group.
UNKNOWN = "und"

_BREAKS = b".,;:!?\n\v\f\r"
_SPACES = b" \t"


class _Windows:
    """The padded windows of one block: group and word numbers, one column per lead; 0 is the padding."""

    def __init__(self, groups: pa.Array, texts: pa.Array, longest: int):
        data, begins = joined(byte_list(texts))
        lower = np.arange(256, dtype=np.uint8)
        lower[65:91] += 32
        data = lower[data]
        ends = byte_set(_BREAKS)
        start, end = spans(data, ends | byte_set(_SPACES))
        codes, self.words = coded(data, start, end)
        piece = np.cumsum(ends[data], dtype=np.int64)[start] if len(data) else start
        row = np.searchsorted(begins, start, side="right") - 1
        named = groups.dictionary_encode()
        self.groups = named.dictionary
        self.group = named.indices.to_numpy().astype(np.int64)[row]
        m = len(codes)
        self.columns = [codes + 1]
        for k in range(1, longest):
            lead = np.zeros(m, dtype=np.int64)
            if m > k:
                lead[:-k] = np.where(piece[k:] == piece[:-k], codes[k:] + 1, 0)
            self.columns.append(lead)
        self.size = len(self.words) + 1


def _sorted_groups(columns: list[np.ndarray], sizes: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """An order of the rows of columns that puts equal ones together, and where each kind starts."""
    packed: list[np.ndarray] = []
    room = 1
    for values, size in zip(columns, sizes):
        if packed and room * size < 1 << 62:
            packed[-1] = packed[-1].astype(np.int64) * size + values
            room *= size
        else:
            packed.append(values)
            room = size
    order = np.argsort(packed[0], kind="stable") if len(packed) == 1 else np.lexsort(packed[::-1])
    new = np.zeros(len(order), dtype=bool)
    if len(order):
        new[0] = True
        for values in packed:
            ranked = values[order]
            new[1:] |= ranked[1:] != ranked[:-1]
    return order, np.flatnonzero(new)


def _counts(starts: np.ndarray, total: int) -> np.ndarray:
    return np.diff(np.append(starts, total))


def _blocks(batches, longest: int):
    for found in gathered(batches, BLOCK, 1):
        groups, texts = plain_strings(column(found, 0)), plain_strings(column(found, 1))
        for a, b in text_blocks(texts, BLOCK):
            yield _Windows(groups.slice(a, b - a), texts.slice(a, b - a), longest)


def _common_beginnings(longest: int):
    """Beginnings of all lengths below ``longest`` with more than 1 / HOT of a block, and the block's size."""

    def run(batches):
        for block in _blocks(batches, longest):
            rows = len(block.group)
            if not rows:
                continue
            words = block.words.cast(pa.string()).to_pylist()
            names = block.groups.to_pylist()
            told = [("", [], rows)]
            keep = np.arange(rows)
            for k in range(1, longest):
                keep = keep[block.columns[k - 1][keep] > 0]
                columns = [block.group[keep], *[c[keep] for c in block.columns[:k]]]
                order, starts = _sorted_groups(columns, [len(names), *[block.size] * k])
                counts = _counts(starts, len(order))
                common = counts * HOT > rows
                for at, count in zip(starts[common].tolist(), counts[common].tolist()):
                    i = keep[order[at]]
                    prefix = [words[block.columns[j][i] - 1] for j in range(k)]
                    told.append((names[block.group[i]], prefix, count))
                keep = keep[np.sort(order[np.repeat(common, counts)])]
            yield pa.record_batch(
                {
                    "name": pa.array([t[0] for t in told]),
                    "prefix": pa.array([t[1] for t in told], pa.list_(pa.string())),
                    "n": pa.array([t[2] for t in told], pa.int64()),
                }
            )

    return run


def _hot_beginnings(source: DataFrame, longest: int) -> list[tuple]:
    """Beginnings to spread, as (group, word, ...): fewer than HOT of each length.

    They only decide which task counts what; the counts do not depend on them.
    """
    found = source.mapInArrow(_common_beginnings(longest), "name string, prefix array<string>, n long")
    found = written(found.groupBy("name", "prefix").agg(F.sum("n").alias("n")), "beginnings")
    total = found.where(F.size("prefix") == 0).agg(F.sum("n")).first()[0] or 0
    hot = found.where((F.size("prefix") > 0) & (F.col("n") * HOT > F.lit(total)))
    return [(r["name"], *r["prefix"]) for r in hot.select("name", "prefix").collect()]


def _numbers(values: list, wanted: list) -> dict:
    wanted = set(wanted)
    return {value: i for i, value in enumerate(values) if value in wanted}


def _depths(block: _Windows, hot: list[tuple], longest: int) -> np.ndarray:
    """How many words decide the bucket of each window: the first beginning that is not hot."""
    depth = np.ones(len(block.group), dtype=np.int64)
    names = _numbers(block.groups.to_pylist(), [h[0] for h in hot])
    wanted = sorted({w for h in hot for w in h[1:]})
    numbers = _numbers(block.words.cast(pa.string()).to_pylist(), wanted)
    # nodes of the tree of hot beginnings: node 0 .. are the groups, children by (node, word)
    node = block.group.copy()
    places = {(name,): i for name, i in names.items()}
    following = len(block.groups)
    rows = np.arange(len(node))
    for k in range(1, longest):
        keys, nodes = [], []
        for h in hot:
            if len(h) == k + 1 and h[:-1] in places and h[-1] in numbers:
                keys.append(places[h[:-1]] * block.size + numbers[h[-1]] + 1)
                nodes.append(following)
                places[h] = following
                following += 1
        if not keys:
            break
        order = np.argsort(np.array(keys, dtype=np.int64))
        known, target = np.array(keys, dtype=np.int64)[order], np.array(nodes, dtype=np.int64)[order]
        key = node[rows] * block.size + block.columns[k - 1][rows]
        found = np.minimum(np.searchsorted(known, key), len(known) - 1)
        hit = known[found] == key
        rows = rows[hit]
        node[rows] = target[found[hit]]
        depth[rows] = k + 1
    return depth


def _ipc(batch: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    options = pa.ipc.IpcWriteOptions(compression="zstd")
    with pa.ipc.new_stream(sink, batch.schema, options=options) as writer:
        writer.write_batch(batch)
    return sink.getvalue().to_pybytes()


def _from_ipc(blob: bytes) -> pa.Table:
    return pa.ipc.open_stream(blob).read_all()


def _longest_windows(longest: int, buckets: int, hot: list[tuple]):
    """Counted windows of each block, packed and dealt to the buckets of their beginnings."""

    def dealt(block: _Windows):
        order, starts = _sorted_groups([block.group, *block.columns], [len(block.groups), *[block.size] * longest])
        counts = _counts(starts, len(order))
        first = order[starts]
        block.group = block.group[first]
        block.columns = [c[first] for c in block.columns]
        depth = _depths(block, hot, longest)
        hashes = np.zeros(block.size, dtype=np.uint64)
        if block.size > 1:
            offsets = np.frombuffer(block.words.buffers()[1], dtype=np.int32)
            offsets = offsets[block.words.offset : block.words.offset + block.size].astype(np.int64)
            sums = prefix_sums(np.frombuffer(block.words.buffers()[2], dtype=np.uint8))
            hashes[1:] = range_hash(sums, offsets[:-1], offsets[1:])
        named, begins = joined(byte_list(block.groups))
        mixed = range_hash(prefix_sums(named), begins[:-1], begins[1:] - 1)[block.group]
        for k, lead in enumerate(block.columns):
            mixed = np.where(depth > k, mix(mixed ^ hashes[lead]), mixed)
        part = (mixed % np.uint64(buckets * SPLITS)).astype(np.int64)
        order = np.argsort(part, kind="stable")
        cuts = np.searchsorted(part[order], np.arange(buckets * SPLITS + 1)).reshape(-1)
        for number in range(buckets):
            split = cuts[number * SPLITS : (number + 1) * SPLITS + 1] - cuts[number * SPLITS]
            pick = order[cuts[number * SPLITS] : cuts[(number + 1) * SPLITS]]
            if not len(pick):
                continue
            leads = np.stack([c[pick] for c in block.columns])
            words, small = np.unique(leads, return_inverse=True)
            small = small.reshape(leads.shape)
            if words[0]:  # 0 stays the padding
                small += 1
            else:
                words = words[1:]
            columns = {f"w{k + 1}": pa.array(small[k], pa.int32()) for k in range(longest)}
            columns["g"] = pa.array(block.group[pick], pa.int32())
            columns["depth"] = pa.array(depth[pick], pa.int8())
            columns["n"] = pa.array(counts[pick], pa.int32())
            windows = pa.record_batch(columns)
            yield (
                number,
                _ipc(pa.record_batch({"word": block.words.take(pa.array(words - 1))})),
                _ipc(pa.record_batch({"name": block.groups})),
                [_ipc(windows.slice(a, b - a)) for a, b in zip(split.tolist(), split[1:].tolist())],
            )

    def run(batches):
        names = ["bucket", "words", "names", "windows"]
        with np.errstate(over="ignore"):
            for block in _blocks(batches, longest):
                if not len(block.group):
                    continue
                held, size = [], 0
                for entry in dealt(block):
                    held.append(entry)
                    size += len(entry[1]) + len(entry[2]) + sum(map(len, entry[3]))
                    if size > 4 << 20:
                        yield _entries(held, names)
                        held, size = [], 0
                if held:
                    yield _entries(held, names)

    return run


def _entries(held: list[tuple], names: list[str]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.binary(), pa.binary(), pa.list_(pa.binary())]
    columns = [pa.array(list(values), kind) for values, kind in zip(zip(*held), kinds)]
    return pa.RecordBatch.from_arrays(columns, names=names)


def _merged_numbers(arrays: list[pa.Array]) -> tuple[list[np.ndarray], pa.Array]:
    """Common numbers for the values of several arrays, and the values in that order."""
    every = pa.concat_arrays(arrays).dictionary_encode()
    numbers = every.indices.to_numpy().astype(np.int64)
    cuts = np.cumsum([len(a) for a in arrays])[:-1]
    return np.split(numbers, cuts), every.dictionary


def _without_rare_endings(longest: int, least: int):
    """Windows of a bucket, cut behind their longest beginning that is frequent or not known here."""

    def bucket(blobs: list[tuple]):
        words, word_names = _merged_numbers([_from_ipc(b[0])["word"].combine_chunks() for b in blobs])
        names, group_names = _merged_numbers([_from_ipc(b[1])["name"].combine_chunks() for b in blobs])
        words = [np.append(0, w + 1).astype(np.int32) for w in words]
        word_names = pa.concat_arrays([pa.array([b""], pa.binary()), word_names]).cast(pa.string())
        for split in range(SPLITS):
            windows = [_from_ipc(b[2][split]) for b in blobs]
            if any(w.num_rows for w in windows):
                yield part(words, word_names, names, group_names, windows)

    def part(of_words, word_names, names, group_names, windows) -> pa.RecordBatch:
        group = np.concatenate([n[w["g"].to_numpy()] for n, w in zip(names, windows)])
        columns = [
            np.concatenate([of[w[f"w{k + 1}"].to_numpy()] for of, w in zip(of_words, windows)])
            for k in range(longest)
        ]
        depth = np.concatenate([w["depth"].to_numpy() for w in windows])
        n = np.concatenate([w["n"].to_numpy() for w in windows]).astype(np.int64)
        size = len(word_names)
        order, starts = _sorted_groups([group, *columns], [len(group_names), *[size] * longest])
        n = np.add.reduceat(n[order], starts)
        first = order[starts]
        group, depth, columns = group[first], depth[first], [c[first] for c in columns]
        # rows are sorted, so every beginning is a range of rows
        rows = len(n)
        at = np.arange(rows)
        new = np.append(True, group[1:] != group[:-1])
        length, head = np.zeros(rows, dtype=np.int64), np.maximum.accumulate(np.where(new, at, 0))
        for k, lead in enumerate(columns, start=1):
            new[1:] |= lead[1:] != lead[:-1]
            begins = np.flatnonzero(new)
            spread = _counts(begins, rows)
            frequent = np.repeat(np.add.reduceat(n, begins) >= least, spread)
            stays = (lead > 0) & (frequent | (depth > k))
            length = np.where(stays, k, length)
            head = np.where(stays, np.repeat(begins, spread), head)
        order, starts = _sorted_groups([length, head], [longest + 1, rows + 1])
        total = np.add.reduceat(n[order], starts)
        first = order[starts]
        out = [group_names.take(pa.array(group[first]))]
        for k, lead in enumerate(columns):
            out.append(word_names.take(pa.array(np.where(length[first] > k, lead[first], 0))))
        out.append(pa.array(total, pa.int64()))
        return pa.RecordBatch.from_arrays(out, names=["name", *[f"w{k + 1}" for k in range(longest)], "n"])

    def run(batches):
        number, held = None, []
        for batch in batches:
            for row in range(batch.num_rows):
                entry = [c[row].as_py() for c in batch.columns]
                if entry[0] != number and held:
                    yield from bucket(held)
                    held = []
                number = entry[0]
                held.append(entry[1:])
        if held:
            yield from bucket(held)

    return run


def phrase_counts(
    docs: DataFrame, text: str = "text", group: str | None = "lang", least: int = LEAST, longest: int = LONGEST
) -> DataFrame:
    """Counts of all frequent phrases of 1 to ``longest`` words per group, and of all words of a group.

    Returns (name, words, f): ``words`` is the phrase as an array, f its occurrences, ``least`` or more; the row
    with no words counts all words of the group. Written once. See collocations for how texts are read.
    """
    spark = docs.sparkSession
    ready(spark)
    name: Column = F.lit(UNKNOWN) if group is None else F.coalesce(F.col(f"`{group}`").cast("string"), F.lit(UNKNOWN))
    source = docs.select(name.alias("name"), F.col(f"`{text}`").alias("text"))
    buckets = max(16, partitions(spark))
    hot = _hot_beginnings(source, longest)
    leads = [f"w{k + 1}" for k in range(longest)]
    typed = ", ".join(f"{w} string" for w in leads)
    windows = (
        source.mapInArrow(
            _longest_windows(longest, buckets, hot), "bucket long, words binary, names binary, windows array<binary>"
        )
        .repartition(buckets, "bucket")
        .sortWithinPartitions("bucket")
        .mapInArrow(_without_rare_endings(longest, least), f"name string, {typed}, n long")
    )
    summed = windows.rollup("name", *leads).agg(F.sum("n").alias("f"), F.grouping_id().alias("summed"))
    # a sum over the last k leads has k low bits set; one whose last word is padding repeats a shorter sum
    words = F.array_compact(F.array(*leads))
    whole = summed.where(f"summed < {(1 << (longest + 1)) - 1}").select("name", words.alias("words"), "f")
    kept = whole.where((F.size("words") == 0) | ((F.element_at("words", -1) != "") & (F.col("f") >= least)))
    return written(kept, "phrase-counts")


def collocations(
    docs: DataFrame,
    text: str = "text",
    group: str | None = "lang",
    least: int = LEAST,
    longest: int = LONGEST,
    top: int | None = TOP,
    share: int = 100,
) -> DataFrame:
    """The best collocations of every group of texts.

    Texts are lower-cased (A-Z), split into pieces at line ends and ``.,;:!?``, and pieces into words at spaces and
    tabs. Candidates are phrases of 2 to ``longest`` words inside pieces that occur ``least`` times or more
    (a), overlaps included. A cut leaves a first part (l occurrences) and a rest (r); with n words in the
    group its score is floor(1000 * a * n / (l * r)), and the lowest of the cuts counts, the first of equal
    ones. A candidate goes if a longer one contains it and has ``share`` percent of its occurrences or more.
    Returns per group the first ``top`` (None: all) by score and a, both falling, then phrase in byte order:
    (name, rank, phrase, a, l, r, n, score).

    Null texts are empty; a null group is ``und``, as is every text if ``group`` is None. Every row is a
    text of its own, also repeated ones. A table without texts gives no rows. Other columns are not read.
    """
    counts = phrase_counts(docs, text, group, least, longest)
    phrase = F.array_join("words", " ")
    sizes = counts.where(F.size("words") == 0).select("name", F.col("f").alias("n"))
    parts = counts.where(F.size("words") > 0).select("name", phrase.alias("part"), F.col("f").alias("f"))
    found = counts.where(F.size("words") > 1).select("name", "words", F.size("words").alias("size"), F.col("f").alias("a"))
    inner = (
        found.where("size > 2")
        .withColumn("from", F.explode(F.expr("sequence(1, size - 1)")))
        .withColumn("take", F.explode(F.expr("sequence(2, least(size - 1, size - from + 1))")))
        .groupBy("name", F.expr("array_join(slice(words, from, take), ' ')").alias("phrase"))
        .agg(F.max("a").alias("longer"))
    )
    own = found.withColumn("phrase", phrase).join(inner, ["name", "phrase"], "left")
    alone = own.where(F.col("longer").isNull() | (100 * F.col("longer") < share * F.col("a")))
    cuts = alone.withColumn("cut", F.explode(F.expr("sequence(1, size - 1)"))).select(
        "name", "phrase", "a", "cut",
        F.expr("array_join(slice(words, 1, cut), ' ')").alias("first"),
        F.expr("array_join(slice(words, cut + 1, size), ' ')").alias("rest"),
    )
    left = parts.select("name", F.col("part").alias("first"), F.col("f").alias("l"))
    right = parts.select("name", F.col("part").alias("rest"), F.col("f").alias("r"))
    wide = "cast({} as decimal(19, 0))".format
    score = F.expr(f"({wide('a')} * {wide('n')} * 1000) div ({wide('l')} * {wide('r')})")
    scored = cuts.join(left, ["name", "first"]).join(right, ["name", "rest"]).join(sizes, "name")
    best = scored.groupBy("name", "phrase", "a", "n").agg(
        F.min(F.struct(score.alias("score"), "cut", "l", "r")).alias("best")
    )
    told = best.select("name", "phrase", "a", "best.l", "best.r", "n", "best.score")
    order = Window.partitionBy("name").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = told.withColumn("rank", F.row_number().over(order).cast("long"))
    if top is not None:
        ranked = ranked.where(F.col("rank") <= top)
    return ranked.select("name", "rank", "phrase", "a", "l", "r", "n", "score")


COLLOCATIONS_SQL = """
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, doc_id, unnest(regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[.,;:!?\\x0A-\\x0D]')) AS piece
  FROM documents),
listed AS (
  SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS words FROM pieces),
sizes AS (SELECT lang, CAST(sum(len(words)) AS HUGEINT) AS n FROM listed GROUP BY lang),
starts AS (
  SELECT lang, words, unnest(range(1, len(words) + 1)) AS i FROM listed WHERE len(words) > 0),
phrases AS (
  SELECT lang, k, list_slice(words, i, i + k - 1) AS words
  FROM starts, (SELECT unnest([1, 2, 3, 4, 5]) AS k) AS lengths
  WHERE i + k - 1 <= len(words)),
counts AS (
  SELECT lang, k, words, count(*) AS f FROM phrases GROUP BY lang, k, words HAVING count(*) >= 100),
inner_phrases AS (
  SELECT c.lang, list_slice(c.words, b.i, b.i + s.k - 1) AS words, max(c.f) AS longer
  FROM counts AS c, (SELECT unnest([1, 2, 3, 4]) AS i) AS b, (SELECT unnest([2, 3, 4]) AS k) AS s
  WHERE s.k < c.k AND b.i + s.k - 1 <= c.k
  GROUP BY ALL),
candidates AS (
  SELECT c.lang, c.k, c.words, c.f AS a
  FROM counts AS c LEFT JOIN inner_phrases AS p ON c.lang = p.lang AND c.words = p.words
  WHERE c.k > 1 AND (p.longer IS NULL OR 100 * p.longer < 100 * c.f)),
cuts AS (
  SELECT c.lang, c.words, c.a, x.cut, l.f AS l, r.f AS r, s.n,
    (CAST(1000 AS HUGEINT) * c.a * s.n) // (CAST(l.f AS HUGEINT) * r.f) AS score
  FROM candidates AS c, (SELECT unnest([1, 2, 3, 4]) AS cut) AS x, counts AS l, counts AS r, sizes AS s
  WHERE x.cut < c.k AND s.lang = c.lang
    AND l.lang = c.lang AND l.words = list_slice(c.words, 1, x.cut)
    AND r.lang = c.lang AND r.words = list_slice(c.words, x.cut + 1, c.k)),
lowest AS (
  SELECT *, row_number() OVER (PARTITION BY lang, words ORDER BY score, cut) AS place FROM cuts),
ranked AS (
  SELECT lang, row_number() OVER (PARTITION BY lang
      ORDER BY score DESC, a DESC, array_to_string(words, ' ')) AS rank,
    array_to_string(words, ' ') AS phrase, a, l, r, n, score
  FROM lowest WHERE place = 1)
SELECT lang, CAST(rank AS BIGINT) AS rank, phrase, CAST(a AS BIGINT) AS a, CAST(l AS BIGINT) AS l,
  CAST(r AS BIGINT) AS r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score
FROM ranked WHERE rank <= 2000
"""


@registered("op12_phrase_collocations", COLLOCATIONS_SQL)
def phrase_collocations(spark, folder):
    """The first 2000 collocations of each language."""
    return collocations(table(spark, folder, "documents")).withColumnRenamed("name", "lang")
