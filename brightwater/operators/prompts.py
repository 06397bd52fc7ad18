"""Prompt versions, prompt assembly and context cutting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brightwater.functions.text import words
from brightwater.plans.skew import numbered

_KEY = ["project", "name"]


def prompt_history(saves: DataFrame, seq: str = "seq", slice_width: int = 1_000_000) -> DataFrame:
    """Number the saves of each prompt 1, 2, 3 ... and mark only the newest as active.

    ``seq`` is a unique integer in save order; a task numbers at most ``slice_width`` of them.
    """
    versions = numbered(
        saves, _KEY, [F.col(seq)], [F.floor(F.col(seq) / slice_width)], "version"
    )
    newest = saves.groupBy(*_KEY).agg(F.max(seq).alias("_newest"))
    return (
        versions.join(newest, _KEY)
        .withColumn("is_active", F.col(seq) == F.col("_newest"))
        .drop("_newest")
    )


def active_prompt(versions: DataFrame) -> DataFrame:
    """The newest active row per prompt."""
    newest = F.max_by(F.struct("content", "model"), "version")
    return (
        versions.filter("is_active")
        .groupBy(*_KEY)
        .agg(F.max("version").alias("version"), newest.alias("row"))
        .select(*_KEY, "version", "row.content", "row.model")
    )


def next_version(versions: DataFrame, wanted: DataFrame) -> DataFrame:
    """For each wanted (project, name) the version its next save gets, 1 for a new prompt."""
    highest = versions.groupBy(*_KEY).agg(F.max("version").alias("highest"))
    return wanted.join(highest, _KEY, "left").select(
        *_KEY, (F.coalesce("highest", F.lit(0)) + 1).alias("next_version")
    )


def deactivate_versions(versions: DataFrame, keys: DataFrame) -> DataFrame:
    """Switch off every version of the given prompts, leave the others as they are."""
    named = keys.select(*_KEY).distinct().withColumn("_named", F.lit(True))
    return (
        versions.join(named, _KEY, "left")
        .withColumn("is_active", F.col("is_active") & F.col("_named").isNull())
        .drop("_named")
    )


def last_of(items: Column, n: int) -> Column:
    """The last ``n`` elements, all of them if there are fewer."""
    kept = F.least(F.lit(n), F.size(items))
    return F.slice(items, F.greatest(F.size(items) - kept, F.lit(0)) + 1, kept)


def build_prompt(
    questions: DataFrame, retrieved: DataFrame, memory: DataFrame | None = None
) -> DataFrame:
    """One prompt and its citations per question that retrieved something.

    ``retrieved`` holds the few ranked chunks per question. The parts are the user's role and
    last five interactions, the chunks in rank order, and the question; a missing part is left out.
    """
    ranked = F.array_sort(F.collect_list(F.struct("rank", "doc_name", "id", "chunk_text")))
    context = retrieved.groupBy("query_id").agg(ranked.alias("found"))
    df = questions.join(context, "query_id")
    if memory is None:
        about = F.lit(None).cast("string")
    else:
        df = df.join(memory.select("user_id", "role", "recent_interactions"), "user_id", "left")
        about = F.concat(
            F.lit("Context about user:\nUser role: "),
            "role",
            F.lit("\nRecent interactions: "),
            F.array_join(last_of(F.col("recent_interactions"), 5), "; "),
        )
    chunks = F.array_join(F.transform("found", lambda c: c["chunk_text"]), "\n\n")
    return df.select(
        "query_id",
        "user_id",
        F.concat_ws(
            "\n\n",
            about,
            F.concat(F.lit("Relevant documents:\n"), chunks),
            F.concat(F.lit("User question: "), "text"),
        ).alias("prompt"),
        F.transform(
            "found",
            lambda c: F.struct(c["doc_name"].alias("documentName"), c["id"].alias("chunkId")),
        ).alias("citations"),
    )


def evaluation_context(retrieved: DataFrame, chunks: int = 3, chars: int = 2000) -> DataFrame:
    """Per question the best chunks joined by blank lines and cut to ``chars`` characters."""
    ranked = F.array_sort(F.collect_list(F.struct("rank", "chunk_text")))
    joined = F.array_join(F.transform(ranked, lambda c: c["chunk_text"]), "\n\n")
    return (
        retrieved.filter(F.col("rank") <= chunks)
        .groupBy("query_id")
        .agg(F.substring(joined, 1, chars).alias("context"))
    )


def transcript_context(df: DataFrame, text: str = "text", n_words: int = 4000) -> DataFrame:
    """Add ``context``: the first ``n_words`` words of a transcript."""
    return df.withColumn(
        "context", F.array_join(F.slice(words(F.col(text)), 1, n_words), " ")
    )
