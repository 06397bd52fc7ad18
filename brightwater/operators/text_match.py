"""Keyword match by lexemes: every word of a question, by its stem, somewhere in a chunk, ranked by nearness.

Only the words that a corpus has are stemmed, once each, and only those with a questioned stem are kept. A chunk's
tokens are looked up in that small table with their positions; chunks that have all lexemes are ranked.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brightwater.functions.stemming import stem
from brightwater.functions.text import STOP_WORDS, let
from brightwater.operators import retrieval
from brightwater.operators.vector import DIGITS
from brightwater.plans.scratch import written
from brightwater.plans.skew import fits

#: Weight of a word in a text without weighted parts, words that are too far apart, and what their nearness is then.
WEIGHT = 0.1
FAR, FAR_NEARNESS = 100, 1e-30
#: The sum of 1 / n**2 over all n, by which a single word's rank is scaled.
ALL_SQUARES = 1.64493406685


def tokens(text: Column) -> Column:
    """Lower-case runs of letters and digits; a null text has none."""
    found = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[\\p{L}\\p{N}]+"), F.lit(0))
    return found


def stems(words: DataFrame) -> DataFrame:
    """Add ``lexeme``, the stem of ``word``."""
    place = words.columns.index("word")

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = pa.array([None if w is None else stem(w) for w in batch.column(place).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns, found], names=[*batch.schema.names, "lexeme"])

    return words.mapInArrow(add, ", ".join(f"`{n}` {k}" for n, k in words.dtypes) + ", lexeme string")


def lexemes(df: DataFrame, stemmed: bool = True) -> DataFrame:
    """``df`` with ``lexeme`` beside each ``word``; words that are not stemmed are their own lexemes."""
    return stems(df) if stemmed else df.withColumn("lexeme", F.col("word"))


def question_lexemes(queries: DataFrame, stemmed: bool = True) -> DataFrame:
    """Distinct rows (query_id, user_id, lexeme, needed) of the questions' words that are no stop words."""
    words = queries.select("query_id", "user_id", F.explode(F.array_distinct(tokens(F.col("text")))).alias("word"))
    asked = lexemes(words.where(~F.col("word").isin(STOP_WORDS)), stemmed).select("query_id", "user_id", "lexeme").distinct()
    sizes = asked.groupBy("query_id", "user_id").agg(F.count(F.lit(1)).alias("needed"))
    return asked.join(sizes, ["query_id", "user_id"])


def match_lexemes(queries: DataFrame, chunks: DataFrame, stemmed: bool = True) -> DataFrame:
    """Rows (query_id, id, found): permitted chunks that have every lexeme of the question, and where.

    ``found`` is an array of (lexeme, positions), positions from 1 by token. A question of stop words only matches
    nothing. Null texts have no words, null permissions no readers.
    """
    asked = written(question_lexemes(queries, stemmed), "lexemes")
    few = fits(asked)
    wanted = asked.select("lexeme").distinct()
    # the corpus's words, each once, of which those with a wanted lexeme stay
    spelled = chunks.select(F.explode(F.array_distinct(tokens(F.col("chunk_text")))).alias("word")).distinct()
    known = lexemes(spelled, stemmed).join(F.broadcast(wanted) if few else wanted, "lexeme", "left_semi")
    known = written(known.select("word", "lexeme"), "words")
    opened = chunks.select("id", "permissions", F.posexplode(tokens(F.col("chunk_text"))).alias("at", "word"))
    places = (
        opened.join(F.broadcast(known) if fits(known) else known, "word")
        .groupBy("id", "permissions", "lexeme")
        .agg(F.array_sort(F.collect_list(F.col("at") + 1)).alias("positions"))
    )
    return (
        places.join(F.broadcast(asked) if few else asked, "lexeme")
        .where(F.array_contains("permissions", F.col("user_id")))
        .groupBy("query_id", "id", "needed")
        .agg(F.collect_list(F.struct("lexeme", "positions")).alias("found"))
        .where(F.size("found") == F.col("needed"))
        .select("query_id", "id", F.array_sort("found").alias("found"))
    )


def _nearness(apart: Column) -> Column:
    """How much of the full weight two words keep that are so many words apart."""
    near = 1 / (1.005 + 0.05 * F.exp(apart / 1.5 - 2))
    return F.sqrt(WEIGHT * WEIGHT * F.when(apart > FAR, F.lit(FAR_NEARNESS)).otherwise(near))


def text_rank(found: Column) -> Column:
    """The rank of a text by the places of the lexemes in it (an array of (lexeme, positions)).

    Every pair of places of two different lexemes counts by its nearness, as independent chances; a single
    lexeme counts by the number of its places.
    """

    def pairs(x: Column, y: Column) -> Column:
        def one(p: Column) -> Column:
            others = F.filter(y["positions"], lambda q: q != p)
            return F.transform(others, lambda q: _nearness(F.abs(p - q).cast("double")))

        return F.flatten(F.transform(x["positions"], one))

    def earlier(x: Column, i: Column) -> Column:
        return F.flatten(F.transform(F.slice(found, F.lit(1), i), lambda y: pairs(x, y)))

    every = F.flatten(F.transform(found, earlier))
    none_of = F.aggregate(every, F.lit(0.0), lambda total, w: total + F.log1p(-w))
    spots = let(F.size(F.get(found, F.lit(0))["positions"]), lambda n: F.transform(F.sequence(F.lit(1), n), lambda j: 1 / (j * j)))
    single = WEIGHT * F.aggregate(spots, F.lit(0.0), lambda total, w: total + w) / ALL_SQUARES
    return F.when(F.size(found) == 1, single).otherwise(-F.expm1(none_of))


def rank_by_lexemes(queries: DataFrame, chunks: DataFrame, candidates: int | None = 10, stemmed: bool = True) -> DataFrame:
    """Rows (query_id, id, score, rank): matching chunks by ``text_rank``, ties by id; all if ``candidates`` is None."""
    scored = match_lexemes(queries, chunks, stemmed).select(
        "query_id", "id", F.round(text_rank(F.col("found")), DIGITS).alias("score")
    )
    return retrieval._best(scored, "score", candidates)
