"""Sharding by vector bin packing: bytes, tokens and rows are balanced together.

Equal texts form a group and stay in one shard. Large groups are items of their own; the many small
ones are hashed into a fixed number of cells, so the number of items depends on the number of shards
alone. Items are placed largest first, each in the shard where the dot product of its (bytes, tokens, rows)
with the shard's residual capacity is highest. Rows then look up their item's shard.

The law that holds is `bytes`: shards have nearly equal sizes. A group too large for that (more than
a whole shard) is dealt in parts by a hash of the row.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brightwater.llm.frames import ROW, identified, registered, table
from brightwater.plans.scratch import written
from brightwater.plans.skew import numbered

#: Cells of small groups per shard; a group larger than 1 / CELLS of a shard is an item of its own.
CELLS = 256
#: What a row costs besides its text.
ROW_BYTES = 16
#: Weights of bytes, tokens and rows in the dot product: bytes are the law.
WEIGHTS = (16.0, 1.0, 1.0)
#: Slices in which the rows of a shard are numbered.
SLOT_SLICES = 1024


def place(items: np.ndarray, shards: int) -> np.ndarray:
    """The shard of each item (rows of bytes, tokens, rows), by the largest dot product with what is left.

    A shard that has used up its tokens or rows has none left of them; used-up bytes count against it.
    """
    if not len(items):
        return np.zeros(0, dtype=np.int64)
    share = items / np.maximum(items.sum(axis=0), 1) * shards
    weights = np.array(WEIGHTS)
    left = np.ones((shards, items.shape[1]))
    out = np.empty(len(items), dtype=np.int64)
    for i in np.lexsort((np.arange(len(items)), -items[:, 0])).tolist():
        rest = np.maximum(left, 0)
        rest[:, 0] = left[:, 0]
        best = int(np.argmax(rest @ (share[i] * weights)))
        out[i] = best
        left[best] -= share[i]
    return out


def shard(docs: DataFrame, shards: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Put every row in a shard: (key, size, tokens, text_crc32, law, shard, slot, grown_shard).

    ``size`` is the UTF-8 length of the text plus ROW_BYTES, ``tokens`` its number of words between
    white space, ``slot`` a gapless number from 0 in the shard along a hash of the key. ``grown_shard`` belongs
    to another law and is null.

    A null text counts as an empty one, and both are in one group. Rows with null or repeated keys are
    rows of their own. Other columns are not read; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    source = identified(docs, key, text=F.coalesce(F.col(text), F.lit("")))
    words = F.size(F.split(F.trim(F.regexp_replace("text", r"\s+", " ")), " "))
    rows = written(
        source.rows.select(
            ROW,
            (F.octet_length("text") + ROW_BYTES).cast("long").alias("size"),
            F.when(F.trim("text") == "", 0).otherwise(words).cast("long").alias("tokens"),
            F.crc32(F.col("text").cast("binary")).alias("text_crc32"),
            F.xxhash64("text").alias("k1"),
            F.xxhash64(F.lit(1), "text").alias("k2"),
        ),
        "sizes",
    )
    sums = [F.sum(c).alias(c) for c in ("size", "tokens")] + [F.count("*").alias("rows")]
    capacity = (rows.agg(F.sum("size")).first()[0] or 0) / shards
    groups = written(rows.groupBy("k1", "k2").agg(*sums), "groups")
    large = groups.where(F.col("size") > capacity / CELLS)
    # a group of more than a shard is dealt in parts of about a quarter
    dealt_in = F.when(F.col("size") > capacity, F.ceil(F.col("size") * 4 / max(capacity, 1.0))).otherwise(1)
    cells = CELLS * shards
    small = groups.where(F.col("size") <= capacity / CELLS).groupBy(F.pmod("k1", F.lit(cells)).alias("cell"))
    # at most CELLS groups and CELLS cells per shard, and four parts per shard
    parts = spark.createDataFrame(
        large.select("k1", "k2", dealt_in.cast("int").alias("parts")).collect(), "k1 long, k2 long, parts int"
    )
    in_parts = rows.join(F.broadcast(parts), ["k1", "k2"], "left").withColumn(
        "part", F.pmod(F.xxhash64(ROW), F.col("parts")).cast("int")
    )
    big = in_parts.where("part is not null").groupBy("k1", "k2", "part").agg(*sums).orderBy("k1", "k2", "part").collect()
    little = small.agg(*[F.sum(c).alias(c) for c in ("size", "tokens", "rows")]).orderBy("cell").collect()
    names = [(r.k1, r.k2, r.part, None) for r in big] + [(None, None, None, r.cell) for r in little]
    loads = [(r["size"], r.tokens, r["rows"]) for r in [*big, *little]]
    found = place(np.array(loads, dtype=float).reshape(-1, 3), shards)
    placed = [(*name, int(s)) for name, s in zip(names, found)]
    own = spark.createDataFrame(
        [(k1, k2, part, s) for k1, k2, part, cell, s in placed if cell is None],
        "k1 long, k2 long, part int, own_shard int",
    )
    cell_shards = spark.createDataFrame(
        [(cell, s) for *_, cell, s in placed if cell is not None], "cell long, cell_shard int"
    )
    dealt = (
        in_parts.withColumn("cell", F.when(F.col("parts").isNull(), F.pmod("k1", F.lit(cells))))
        .join(F.broadcast(own), ["k1", "k2", "part"], "left")
        .join(F.broadcast(cell_shards), "cell", "left")
        .select(ROW, "size", "tokens", "text_crc32", F.coalesce("own_shard", "cell_shard").alias("shard"))
    )
    piece = F.pmod(F.xxhash64(F.lit(7), ROW), F.lit(SLOT_SLICES))
    slotted = numbered(written(dealt, "dealt"), ["shard"], [F.col(ROW)], [piece], "slot")
    return source.restore(
        slotted.select(
            ROW,
            "size",
            "tokens",
            "text_crc32",
            F.lit("bytes").alias("law"),
            "shard",
            (F.col("slot") - 1).cast("long").alias("slot"),
            F.lit(None).cast("int").alias("grown_shard"),
        )
    )


@registered("op8_vector_bin_packing")
def vector_bin_packing(spark, folder):
    """All documents in 40 shards of nearly equal bytes."""
    return shard(table(spark, folder, "documents"), 40)
