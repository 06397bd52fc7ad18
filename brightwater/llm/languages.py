"""Language identification by compression.

Every language is a raw-content zstandard dictionary cut from labelled texts. A text is compressed
against each dictionary, piece by piece so that a long text cannot become its own dictionary, and
belongs to the language that makes it smallest. Sizes are whole bytes, which says little about short texts;
those are also compressed against several small dictionaries per language, and the sizes add up. The
margin between the two smallest sums says how safe the choice is; a narrow one rejects the text.
"""

from __future__ import annotations

import re

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brightwater.llm.frames import ready, registered, table
from brightwater.plans.scratch import written
from brightwater.plans.skew import small

#: Bounds of the fitting sample: texts per language, and characters taken from the middle of each.
SAMPLE_TEXTS = 400
SAMPLE_CHARS = 700
#: Parts of a language whose first draws are found side by side; one task then sees at most DRAW_PARTS * SAMPLE_TEXTS.
DRAW_PARTS = 64
#: Bytes of the dictionary for all texts, and the number and bytes of those for short texts.
DICTIONARY_BYTES = 80_000
SMALL_DICTIONARIES = 8
SMALL_BYTES = 8_000
#: Texts below this size count as short.
SHORT_BYTES = 600
#: Texts are compressed in pieces of this many bytes.
PIECE_BYTES = 4096
LEVEL = 6
#: Texts whose score lies below this are rejected.
MIN_SCORE = 0.005
UNDECIDED = "und"

_LETTER = re.compile(r"[^\W\d_]")
_OTHER = re.compile(r"[\W\d_]+")


def plain(text: str) -> str:
    """Lower-case letters, with one space for anything between them."""
    return _OTHER.sub(" ", text.lower()).strip()


def train(
    docs: DataFrame,
    text: str = "text",
    label: str = "lang",
    key: str = "doc_id",
    texts: int = SAMPLE_TEXTS,
    chars: int = SAMPLE_CHARS,
) -> dict[str, list[bytes]]:
    """Dictionaries per language, the large one first, from a bounded sample of the labelled texts.

    The sample is the ``texts`` texts per language with the smallest hashes of key and text, and of each at most
    ``chars`` characters around its middle. Rows equal in both count once. Rows without a label or without text are
    left out; no rows give no languages. The sample is the only thing that reaches the driver.
    """
    rows = docs.select(F.col(label).alias("lang"), F.col(text).alias("text"), F.col(key).cast("string").alias("key"))
    rows = rows.where("lang is not null and text is not null and trim(text) <> ''")
    rows = rows.withColumn("draw", F.xxhash64("key", "text"))
    # the last draw of each language is found on hashes alone: first in every part of a language, then among those
    dealt = rows.select("lang", "draw").distinct().withColumn("part", F.pmod(F.shiftright("draw", 8), F.lit(DRAW_PARTS)))
    first = dealt
    for group in (["lang", "part"], ["lang"]):
        place = F.row_number().over(Window.partitionBy(*group).orderBy("draw"))
        first = first.withColumn("place", place).where(F.col("place") <= texts).drop("place")
    last = written(first.groupBy("lang").agg(F.max("draw").alias("last")), "draws")
    middle = F.greatest(F.lit(1), F.floor((F.length("text") - chars) / 2) + 1).cast("int")
    picked = (
        rows.join(small(last), "lang")
        .where("draw <= last")
        .select("lang", "draw", F.substring(F.col("text"), middle, F.lit(chars)).alias("text"))
        .groupBy("lang", "draw")
        .agg(F.min("text").alias("text"))
    )
    held: dict[str, list[tuple[int, str]]] = {}
    for row in picked.toLocalIterator():
        held.setdefault(row.lang, []).append((row.draw, row.text))
    out = {}
    for lang in sorted(held):
        sample = " ".join(plain(t) for _, t in sorted(held[lang])).encode()
        large = sample[:DICTIONARY_BYTES]
        # the small ones hold other text where the sample is large enough
        rest = sample[DICTIONARY_BYTES:]
        rest = rest if len(rest) >= SMALL_BYTES * SMALL_DICTIONARIES else sample
        size = min(SMALL_BYTES, len(rest) // SMALL_DICTIONARIES)
        shorter = [rest[a * size : (a + 1) * size] for a in range(SMALL_DICTIONARIES)]
        if len(large) >= 8:
            out[lang] = [large, *(x for x in shorter if len(x) >= 8)]
    return out


class Classifier:
    """Compressors over the learned dictionaries, built once per task."""

    def __init__(self, dictionaries: dict[str, list[bytes]], level: int = LEVEL, piece: int = PIECE_BYTES):
        self.piece = piece
        self.packers = []
        for lang, contents in sorted(dictionaries.items()):
            own = []
            for data in contents:
                learned = zstandard.ZstdCompressionDict(data, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
                learned.precompute_compress(level=level)
                own.append(
                    zstandard.ZstdCompressor(
                        dict_data=learned,
                        level=level,
                        write_checksum=False,
                        write_content_size=False,
                        write_dict_id=False,
                    )
                )
            self.packers.append((lang, own))

    def sizes(self, text: str) -> list[tuple[int, str]]:
        data = plain(text).encode("utf-8", "replace")
        if len(data) < SHORT_BYTES:
            return sorted((sum(len(p.compress(data)) for p in own), lang) for lang, own in self.packers)
        pieces = [data[a : a + self.piece] for a in range(0, len(data), self.piece)]
        return sorted((sum(len(own[0].compress(x)) for x in pieces), lang) for lang, own in self.packers)

    def predict(self, text: str | None) -> tuple[str, float]:
        """(language, score): the score is the saving over the second language, from 0 to 1."""
        if not text or not self.packers or not _LETTER.search(text):
            return UNDECIDED, 0.0
        ranked = self.sizes(text)
        if len(ranked) == 1:
            return ranked[0][1], 1.0
        (best, lang), (second, _) = ranked[:2]
        return lang, (second - best) / second


def _predicted(shared, min_score: float):
    def run(batches):
        model = Classifier(shared.value)
        for batch in batches:
            found = [model.predict(t) for t in batch.column(batch.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    *batch.columns[:-1],
                    pa.array([lang for lang, _ in found], pa.string()),
                    pa.array([score for _, score in found], pa.float64()),
                    pa.array([lang == UNDECIDED or score < min_score for lang, score in found], pa.bool_()),
                ],
                names=[*batch.schema.names[:-1], "lang_pred", "score", "rejected"],
            )

    return run


def identify(
    docs: DataFrame, dictionaries: dict[str, list[bytes]], text: str = "text", *keep: str, min_score: float = MIN_SCORE
) -> DataFrame:
    """The ``keep`` columns with lang_pred, score and rejected for every row, in one scan.

    Whole texts are compressed. ``lang_pred`` is a learned language, or `und` with score 0 if the text is
    null or has no letter, or if no language was learned. ``rejected`` holds for `und` and for scores
    below ``min_score``. Ties go to the language first in the alphabet. Repeated rows get equal
    results; an empty table gives an empty one.
    """
    ready(docs.sparkSession)
    kept = docs.select(*keep, F.col(text).alias("__text"))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields[:-1])
    return kept.mapInArrow(
        _predicted(docs.sparkSession.sparkContext.broadcast(dictionaries), min_score),
        (fields + ", " if fields else "") + "lang_pred string, score double, rejected boolean",
    )


def accepted(
    docs: DataFrame, dictionaries: dict[str, list[bytes]], text: str = "text", min_score: float = MIN_SCORE
) -> DataFrame:
    """The rows, with all their columns, whose language is not rejected."""
    ready(docs.sparkSession)
    place = docs.columns.index(text)
    shared = docs.sparkSession.sparkContext.broadcast(dictionaries)

    def run(batches):
        model = Classifier(shared.value)
        for batch in batches:
            found = [model.predict(t) for t in batch.column(place).to_pylist()]
            yield batch.filter(pa.array([p != UNDECIDED and s >= min_score for p, s in found], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def held_out(key: Column) -> Column:
    """The quarter of the keys that is never learned from."""
    return F.coalesce(F.crc32(key.cast("string")) % 4 == 2, F.lit(False))


@registered("op5_language_id")
def language_id(spark, folder):
    """The language of every document, learned from the documents that are not held out."""
    docs = table(spark, folder, "documents")
    model = train(docs.where(~held_out(F.col("doc_id"))))
    marked = docs.withColumn("held_out", held_out(F.col("doc_id")))
    return identify(marked, model, "text", "doc_id", "held_out")
