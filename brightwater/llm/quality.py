"""Quality rules with risk-controlled thresholds.

A document is measured by a few text statistics. For each stratum (language) one cutoff per statistic is
selected on labelled documents. One part of them proposes sets of cutoffs, from lenient to strict; the held-out rest
tests them in this order: the exact binomial test must reject "at least the allowed share of good documents
lies above any cutoff of the set". The first failure ends the sequence, and the last set before it is selected. The
level is divided by the number of sequences (Bonferroni over strata; a fixed sequence needs no further
correction), so with the wanted confidence no stratum loses more good documents than allowed. A document is
kept if no selected cutoff rejects it.

All of it is DataFrame expressions: texts are measured in one scan inside the JVM, thresholds come from
counts per stratum.
"""

from __future__ import annotations

import functools
import operator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brightwater.llm.frames import registered, table
from brightwater.plans.scratch import written

#: Most good documents that all rules together may reject, and the error probability of that claim.
LIMIT = 0.05
ERROR = 0.05
#: Cutoffs tried per statistic, lenient first: shares of the proposing good documents above them.
TAILS = (0.0, 0.0005, 0.001, 0.002)
#: Still more lenient cutoffs, tried before those: multiples of the largest value of the proposing good documents, because
#: the largest of a few is often exceeded.
STRETCHES = (2.0, 1.5, 1.25, 1.1)
#: One in so many labelled documents proposes cutoffs, the others test them.
FOLDS = 4
LEAST_WORDS = 50
SYMBOLS = "#*$%&|<>"

_SPACE = r"[\x20\x09-\x0D]+"


def let(value: Column, use) -> Column:
    """``use(value)`` with the value computed once per row."""
    return F.element_at(F.transform(F.array(value), use), 1)


def words_of(text: Column) -> Column:
    """Runs of anything but ASCII white space; none for null."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), _SPACE), lambda w: w != "")


def repeated_words(words: Column, window: int = 3) -> Column:
    """How many words lie in ``window``-word windows found twice or more in the array.

    Windows are hashed to 64 bits and sorted with their places; equal neighbours mark repeated places,
    whose windows are added up as a union of intervals.
    """
    places = F.sequence(F.lit(0), F.size(words) - window)
    hashed = lambda i: F.xxhash64(*[words[i + k] for k in range(window)])
    pairs = F.sort_array(F.transform(places, lambda i: F.struct(hashed(i).alias("h"), i.alias("i"))))

    def marked(sorted_pairs: Column) -> Column:
        n = F.size(sorted_pairs)
        same = lambda x, k: F.coalesce(F.get(sorted_pairs, k)["h"] == x["h"], F.lit(False))
        kept = F.filter(sorted_pairs, lambda x, k: same(x, k - 1) | same(x, k + 1))
        return F.sort_array(F.transform(kept, lambda x: x["i"]))

    def covered(at: Column) -> Column:
        gains = F.transform(at, lambda x, k: F.when(k == 0, window).otherwise(F.least(F.lit(window), x - F.get(at, k - 1))))
        return F.aggregate(gains, F.lit(0), lambda total, x: total + x)

    counted = let(pairs, lambda p: let(marked(p), covered))
    return F.when(F.size(words) >= window, counted).otherwise(0).cast("long")


def measured(docs: DataFrame, text: str, *keep: Column) -> DataFrame:
    """The ``keep`` columns and the text statistics of every row."""
    whole = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(whole, "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    cut = docs.select(*keep, whole.alias("__text"), words_of(F.col(text)).alias("__words"), lines.alias("__lines"))
    kinds = [c for c in cut.columns if c not in ("__text", "__words", "__lines")]
    return cut.select(
        *kinds,
        F.size("__words").cast("long").alias("n_words"),
        F.length(F.array_join("__words", "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace("__text", f"[^{SYMBOLS}]+", "")).cast("long").alias("n_symbols"),
        (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long").alias("n_dup_lines"),
        repeated_words(F.col("__words")).alias("n_repeat_words"),
        F.size("__lines").cast("long").alias("__n_lines"),
        F.length(F.regexp_replace("__text", r"[\p{L}\p{N}\s]+", "")).cast("long").alias("__n_marks"),
    )


def base_failed() -> Column:
    return (F.col("n_words") < LEAST_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 50)


#: Statistics that a rule may cut: large values are bad.
def statistics() -> dict[str, Column]:
    words = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    return {
        "symbols": F.col("n_symbols") / words,
        "repeats": F.col("n_repeat_words") / words,
        "lines": F.col("n_dup_lines") / F.greatest(F.col("__n_lines"), F.lit(1)),
        "marks": F.col("__n_marks") / words,
    }


def log_gamma(x: Column) -> Column:
    """Logarithm of the gamma function for x >= 1, by its asymptotic series from 8 upwards."""
    shifted = x + 8
    product = F.lit(0.0)
    for k in range(8):
        product = product + F.log(x + k)
    series = (
        (shifted - 0.5) * F.log(shifted) - shifted + 0.9189385332046727
        + 1 / (12 * shifted) - 1 / (360 * F.pow(shifted, 3)) + 1 / (1260 * F.pow(shifted, 5))
    )
    return series - product


def binomial_tail(k: Column, n: Column, p: float) -> Column:
    """P(X <= k) for X binomial(n, p), where k lies below n * p; larger k give 1.

    The largest term is exp of its logarithm; the terms below it follow by their ratios, which shrink.
    """
    k, n = k.cast("double"), n.cast("double")
    largest = (
        log_gamma(n + 1) - log_gamma(k + 1) - log_gamma(n - k + 1) + k * F.log(F.lit(p)) + (n - k) * F.log1p(F.lit(-p))
    )
    ratio = (1 - p) / p
    terms = F.aggregate(
        F.sequence(F.lit(0), F.greatest(k.cast("int") - 1, F.lit(0))),
        F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("total")),
        lambda held, i: F.struct(
            (held["term"] * (k - i) / (n - k + i + 1) * ratio).alias("term"),
            (held["total"] + held["term"] * (k - i) / (n - k + i + 1) * ratio).alias("total"),
        ),
    )["total"]
    return F.when(k >= n * p, 1.0).otherwise(F.least(F.lit(1.0), F.exp(largest) * F.when(k > 0, terms).otherwise(1.0)))


def thresholds(
    good: DataFrame, limit: float = LIMIT, error: float = ERROR, tails: tuple[float, ...] = TAILS
) -> DataFrame:
    """(stratum, rule, cutoff) proven on ``good``: measured good documents with a stratum and a fold.

    Fold 0 proposes, the others test. The cutoffs of a stratum are tested together against the whole limit, as a
    document may be rejected by any of them. A stratum without proven cutoffs has no row.
    """
    rules = list(statistics())
    values = written(
        good.select("stratum", "fold", *[value.alias(name) for name, value in statistics().items()]), "statistics"
    )
    shares = F.array(*[F.lit(1 - t) for t in tails])
    lenient = lambda name: F.array(*[F.max(name) * s for s in STRETCHES])
    lists = [F.concat(lenient(name), F.percentile(name, shares)).alias(name) for name in rules]
    proposed = values.where("fold = 0").groupBy("stratum").agg(*lists).withColumn("sets", F.arrays_zip(*rules))
    proposed = written(proposed.select("stratum", F.posexplode("sets").alias("step", "cutoffs")), "proposed")
    sequences = max(proposed.where("step = 0").count(), 1)
    rejected = functools.reduce(operator.or_, [F.col(name) > F.col("cutoffs")[name] for name in rules])
    tested = (
        values.where("fold > 0")
        .join(proposed, "stratum")
        .groupBy("stratum", "step", "cutoffs")
        .agg(F.count("*").alias("n"), F.count_if(rejected).alias("k"))
        .withColumn("p_value", binomial_tail(F.col("k"), F.col("n"), limit))
    )
    lenient_first = Window.partitionBy("stratum").orderBy("step")
    passes = (F.col("p_value") <= error / sequences).cast("int")
    stepped = tested.withColumn("passed", F.min(passes).over(lenient_first))
    chosen = stepped.where("passed = 1").groupBy("stratum").agg(F.max_by("cutoffs", "step").alias("cutoffs"))
    pairs = F.array(*[F.struct(F.lit(name).alias("rule"), F.col("cutoffs")[name].alias("cutoff")) for name in rules])
    return chosen.select("stratum", F.explode(pairs).alias("c")).select("stratum", "c.rule", "c.cutoff")


def judge(
    docs: DataFrame,
    labels: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    stratum: str = "lang",
    label: str = "quality",
    limit: float = LIMIT,
    error: float = ERROR,
) -> DataFrame:
    """The statistics of every row, whether a base rule fails, and whether the document is kept.

    Gives (key, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept,
    rejected_by). Base rules reject short and repetitive texts; the selected cutoffs of the row's stratum
    reject the rest. They are learned from the rows of ``labels`` with label 1 whose document passes the
    base rules; a stratum without enough of them has no cutoffs and rejects nothing more.

    A null text has no words. Null strata form one of their own. Every row is judged by itself: repeated rows give
    repeated results and rows with null keys are kept in the result, but learn from no label; a document labelled more
    than once is good if all its labels are 1. Clashing columns are not read; an empty table on either side is allowed.
    """
    level = F.coalesce(F.col(stratum).cast("string"), F.lit(""))
    rows = written(measured(docs, text, F.col(key).alias("__key"), level.alias("stratum")), "measured")
    good = (
        labels.select(F.col(key).alias("__key"), F.col(label).alias("label"))
        .dropna()
        .groupBy("__key")
        .agg(F.min("label").alias("label"))
        .where("label = 1")
        .select("__key")
    )
    fold = F.pmod(F.xxhash64("__key"), F.lit(FOLDS))
    known = rows.where(~base_failed()).join(good, "__key").withColumn("fold", fold)
    cutoffs = thresholds(known, limit, error).groupBy("stratum").agg(
        F.map_from_entries(F.collect_list(F.struct("rule", "cutoff"))).alias("cutoffs")
    )
    above = F.array_compact(
        F.array(
            *[
                F.when(value > F.coalesce(F.col("cutoffs")[name], F.lit(float("inf"))), F.lit(name))
                for name, value in statistics().items()
            ]
        )
    )
    judged = rows.join(written(cutoffs, "cutoffs"), "stratum", "left")
    return judged.select(
        F.col("__key").alias(key),
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        base_failed().alias("base_failed"),
        (~base_failed() & (F.size(above) == 0)).alias("kept"),
        F.when(~base_failed(), above).alias("rejected_by"),
    )


@registered("op4_quality_rules")
def quality_rules(spark, folder):
    """Every document with its statistics and the verdict of the rules."""
    found = judge(table(spark, folder, "documents"), table(spark, folder, "labels"))
    return found.drop("rejected_by")
