"""Search for benchmark items inside documents by size-partitioned MinHash containment.

An item is contained in a document if the document has at least ``threshold`` of the item's word
shingles, however long the document is. Items are partitioned by the size of their shingle sets. In each
partition an item is represented by its smallest shingle hashes: as many as a document must hit at
least once if it contains the item (of n shingles it may miss n - ceil(threshold * n), so one more
than that cannot all be missing). A document too short for every item of a partition skips it. Items
that are hit are verified on their full shingle sets.

The documents are scanned where they are and never shuffled. Items are held by every task in blocks of a
bounded number of words; more items than one block are searched block by block, all documents each.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brightwater.llm.frames import ROW, identified, registered, table
from brightwater.llm.hashing import distinct, shingle_hashes, text_blocks, text_shingles, word_hashes

WORDS = 5
THRESHOLD = 0.8
#: Characters of item texts that a block may hold. A single longer item is a block of its own.
BLOCK_CHARS = 8_000_000


class Index:
    """The shingle sets of some items and, by size partition, their smallest hashes."""

    def __init__(self, items: list[tuple[int, np.ndarray]], threshold: float):
        self.items = [(k, s) for k, s in items if len(s)]
        self.threshold = threshold
        self.parts = []
        by_size: dict[int, list[int]] = {}
        for number, (_, found) in enumerate(self.items):
            by_size.setdefault(len(found).bit_length(), []).append(number)
        for numbers in by_size.values():
            sizes = [len(self.items[i][1]) for i in numbers]
            hashes, owners = [], []
            for i in numbers:
                found = self.items[i][1]
                sketch = found[: len(found) - self.needed(len(found)) + 1]
                hashes.append(sketch)
                owners.append(np.full(len(sketch), i))
            hashes, owners = np.concatenate(hashes), np.concatenate(owners)
            order = np.argsort(hashes, kind="stable")
            self.parts.append((self.needed(min(sizes)), hashes[order], owners[order]))
        every = np.concatenate([p[1] for p in self.parts]) if self.parts else np.zeros(0, np.uint64)
        self.seen = np.zeros(1 << 20, dtype=bool)
        self.seen[(every >> np.uint64(44)).astype(np.int64)] = True

    def needed(self, size: int) -> int:
        return max(1, math.ceil(self.threshold * size - 1e-9))

    def candidates(self, total: np.ndarray, owner: np.ndarray) -> np.ndarray:
        """(text, item) pairs with at least one hash of the item's sketch in the text."""
        lengths = np.bincount(owner) if len(owner) else np.zeros(0, dtype=np.int64)
        maybe = self.seen[(total >> np.uint64(44)).astype(np.int64)]
        total, owner = total[maybe], owner[maybe]
        found = []
        for least, hashes, items in self.parts:
            fits = lengths[owner] >= least
            values, texts = total[fits], owner[fits]
            a = np.searchsorted(hashes, values, side="left")
            b = np.searchsorted(hashes, values, side="right")
            hit = np.flatnonzero(b > a)
            counts = b[hit] - a[hit]
            inner = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
            found.append(np.stack((np.repeat(texts[hit], counts), items[np.repeat(a[hit], counts) + inner])))
        pairs = np.concatenate(found, axis=1) if found else np.zeros((2, 0), dtype=np.int64)
        return np.unique(pairs.T, axis=0)


def _search(shared, n: int):
    def run(batches):
        index: Index = shared.value
        with np.errstate(over="ignore"):
            for batch in batches:
                rows, texts = batch.column(0).to_numpy(), batch.column(1)
                out: list[list] = [[], [], [], []]
                for first, last in text_blocks(texts):
                    total, owner = shingle_hashes(*word_hashes(texts.slice(first, last - first)), n)
                    pairs = index.candidates(total, owner)
                    text, own = -1, total
                    for k, item in pairs.tolist():
                        if k != text:
                            a, b = np.searchsorted(owner, [k, k + 1])
                            text, own = k, distinct(total[a:b])
                        key, found = index.items[item]
                        both = len(np.intersect1d(own, found, assume_unique=True))
                        if both >= index.needed(len(found)):
                            for held, value in zip(out, (int(rows[first + k]), key, len(found), both)):
                                held.append(value)
                yield pa.record_batch(
                    [pa.array(v, pa.int64()) for v in out], names=[ROW, "item", "n_item_shingles", "n_shared"]
                )

    return run


def contained_items(
    docs: DataFrame,
    items: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    item_key: str = "item_id",
    item_text: str = "text",
    words: int = WORDS,
    threshold: float = THRESHOLD,
    block_chars: int = BLOCK_CHARS,
) -> DataFrame:
    """(key, item_key, n_item_shingles, n_shared, containment) for every item contained in a document.

    Words are runs of letters, digits, marks and underscores, lower-cased (hashing.word_hashes). Containment is the share of
    the item's distinct shingles that the document has. An item of fewer than ``words`` words is one
    shingle of all of them and is found in documents of just these words, not inside longer ones.

    Null and empty texts and items without words match nothing. Rows with null or repeated keys are
    records of their own and are reported under those keys. Other columns are not read. An empty table on
    either side gives an empty result.
    """
    spark = docs.sparkSession
    found = identified(docs, key, text=F.col(text))
    asked = identified(items, item_key, text=F.col(item_text))
    chars = asked.rows.select(F.sum(F.length("text"))).first()[0] or 0
    blocks = max(1, math.ceil(chars / block_chars))
    result = None
    for block in range(blocks):
        own = asked.rows.where(F.pmod(F.xxhash64(ROW), F.lit(blocks)) == block).select(ROW, "text").toArrow()
        with np.errstate(over="ignore"):
            column = own["text"].combine_chunks() if own.num_rows else pa.array([], pa.string())
            sets = [(int(own[ROW][k].as_py()), s) for k, s in text_shingles(column, words)]
        shared = spark.sparkContext.broadcast(Index(sets, threshold))
        pairs = found.rows.select(ROW, "text").mapInArrow(
            _search(shared, words), f"{ROW} long, item long, n_item_shingles long, n_shared long"
        )
        result = pairs if result is None else result.unionByName(pairs)
    named = asked.key_of(result, "item").withColumnRenamed("item", item_key)
    return found.restore(named).withColumn("containment", F.col("n_shared") / F.col("n_item_shingles"))


CONTAINED_SQL = r"""
WITH d AS (
    SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '(?:[0-9a-z_]|[^\x00-\x7F\P{L}]|[^\x00-\x7F\P{N}]|[^\x00-\x7F\P{M}])+') AS w FROM documents
), i AS (
    SELECT item_id, regexp_extract_all(lower(coalesce(text, '')), '(?:[0-9a-z_]|[^\x00-\x7F\P{L}]|[^\x00-\x7F\P{N}]|[^\x00-\x7F\P{M}])+') AS w FROM benchmark
), ds AS (
    SELECT DISTINCT doc_id, unnest(list_transform(range(1, greatest(len(w) - 3, 2)), lambda k: array_to_string(w[k:k+4], ' '))) AS s
    FROM d WHERE len(w) > 0
), s AS (
    SELECT DISTINCT item_id, unnest(list_transform(range(1, greatest(len(w) - 3, 2)), lambda k: array_to_string(w[k:k+4], ' '))) AS s
    FROM i WHERE len(w) > 0
), n AS (SELECT item_id, count(*) AS n FROM s GROUP BY item_id)
SELECT doc_id, item_id, n AS n_item_shingles, count(*) AS n_shared, count(*) / n AS containment
FROM ds JOIN s USING (s) JOIN n USING (item_id)
GROUP BY doc_id, item_id, n HAVING count(*) >= ceil(0.8 * n - 1e-9)
"""


@registered("op3_benchmark_decontamination", CONTAINED_SQL)
def benchmark_decontamination(spark, folder):
    """Every (document, benchmark item) with the item contained in the document."""
    return contained_items(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
