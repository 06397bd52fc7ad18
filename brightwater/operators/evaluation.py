"""Evaluation: judge replies, summaries and retrieval quality."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brightwater.functions.numbers import percent, whole_average

JUDGES = ["groundedness", "relevance", "hallucination"]


def _average_of_thousandths(name: str) -> Column:
    units = F.round(F.col(name) * 1000).cast("bigint")
    return whole_average(F.sum(units), F.count(units)) / 1000.0


def eval_summary(evals: DataFrame) -> DataFrame:
    """Per project: evaluations, average scores to 3 decimals, hallucinations and their share.

    Scores are stored with three decimals, so the averages are taken over exact thousandths.
    """
    flagged = F.count_if(F.col("hallucination"))
    return evals.groupBy("project").agg(
        F.count(F.lit(1)).alias("total_evals"),
        _average_of_thousandths("groundedness").alias("avg_groundedness"),
        _average_of_thousandths("answer_relevance").alias("avg_answer_relevance"),
        flagged.alias("hallucination_count"),
        percent(flagged, F.count(F.lit(1)), 1).alias("hallucination_rate_pct"),
    )


def parse_judge_output(replies: DataFrame) -> DataFrame:
    """Read the JSON object in each stored judge reply (columns ``judge`` and ``reply``).

    Adds ``score`` in [0, 1] (a hallucination judge's confidence), ``hallucinated`` and
    ``reasoning``. Without an object the defaults apply; an unreadable object scores 0.5 with the
    reasoning "Evaluation failed".
    """
    found = F.regexp_extract("reply", r"(\{[\s\S]*\})", 1)
    parsed = F.try_parse_json(F.when(found == "", "{}").otherwise(found))
    df = replies.withColumn("_parsed", parsed)

    def value(path: str, kind: str) -> Column:
        return F.try_variant_get("_parsed", path, kind)

    detector = F.col("judge") == "hallucination"
    number = F.when(detector, value("$.confidence", "double")).otherwise(value("$.score", "double"))
    half = F.lit(0.5)
    return df.withColumns(
        {
            "score": F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce(number, half))),
            "hallucinated": F.when(
                detector, F.coalesce(value("$.hallucinated", "boolean"), F.lit(False))
            ),
            "reasoning": F.when(F.col("_parsed").isNull(), "Evaluation failed").otherwise(
                F.coalesce(value("$.reasoning", "string"), F.lit(""))
            ),
        }
    ).drop("_parsed")


def combine_rag_eval(judged: DataFrame) -> DataFrame:
    """One row per query from its three judge rows."""
    wide = (
        judged.groupBy("query_id")
        .pivot("judge", JUDGES)
        .agg(F.first(F.struct("score", "hallucinated", "reasoning"), ignorenulls=True))
    )
    return wide.select(
        "query_id",
        F.col("groundedness.score").alias("groundedness"),
        F.col("relevance.score").alias("answer_relevance"),
        F.col("hallucination.hallucinated").alias("hallucination"),
        F.col("hallucination.score").alias("hallucination_confidence"),
        F.struct(
            F.col("groundedness.reasoning").alias("groundedness"),
            F.col("relevance.reasoning").alias("answerRelevance"),
            F.col("hallucination.reasoning").alias("hallucination"),
        ).alias("judge_reasoning"),
    )


def relevance_semi_join(retrieved: DataFrame, relevant: DataFrame) -> DataFrame:
    """Retrieved rows whose id is relevant to their query; repeated ids stay repeated."""
    return retrieved.join(relevant.select("query_id", "id"), ["query_id", "id"], "left_semi")


def _hits(queries: DataFrame, retrieved: DataFrame, relevant: DataFrame, k: int) -> DataFrame:
    hits = (
        relevance_semi_join(retrieved.filter(F.col("rank") <= k), relevant)
        .groupBy("query_id")
        .agg(F.count(F.lit(1)).alias("hits"))
    )
    return (
        queries.select("query_id")
        .join(hits, "query_id", "left")
        .withColumn("hits", F.coalesce("hits", F.lit(0)))
    )


def precision_at_k(
    queries: DataFrame, retrieved: DataFrame, relevant: DataFrame, k: int
) -> DataFrame:
    """Per query the relevant ids among the first ``k``, divided by ``k`` even if fewer came back."""
    return _hits(queries, retrieved, relevant, k).select(
        "query_id", (F.col("hits") / F.lit(float(k))).alias("precision")
    )


def recall_at_k(
    queries: DataFrame, retrieved: DataFrame, relevant: DataFrame, k: int
) -> DataFrame:
    """Per query the relevant ids among the first ``k``, divided by all relevant; 0 without any."""
    wanted = relevant.groupBy("query_id").agg(F.count(F.lit(1)).alias("wanted"))
    return (
        _hits(queries, retrieved, relevant, k)
        .join(wanted, "query_id", "left")
        .select("query_id", F.coalesce(F.col("hits") / F.col("wanted"), F.lit(0.0)).alias("recall"))
    )


def evaluate_retrieval(
    queries: DataFrame, retrieved: DataFrame, relevant: DataFrame, k: int
) -> DataFrame:
    """Number of queries, average precision at ``k`` and average recall at ``k``."""
    both = precision_at_k(queries, retrieved, relevant, k).join(
        recall_at_k(queries, retrieved, relevant, k), "query_id"
    )
    return both.agg(
        F.count(F.lit(1)).alias("queries"),
        F.avg("precision").alias("precision"),
        F.avg("recall").alias("recall"),
    )
