"""A training-corpus pipeline over documents.

Stages run in order; each works on all rows that the one before kept, is written as Parquet and read again. All but
the last return the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from brightwater.llm.contamination import contained_items
from brightwater.llm.frames import ROW, identified, ready, table
from brightwater.llm.languages import accepted, train
from brightwater.llm.packing import digest, pack
from brightwater.llm.repeats import remove_repeats
from brightwater.llm.similar import similar_texts
from brightwater.plans.scratch import written


#: Bytes of an Arrow batch between Spark and a Python worker.
BATCH_BYTES = "8m"


def language_identification(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is clear; those without letters or with a narrow margin go.

    Languages are learned from the labelled texts of the stage's own input. Null texts go.
    """
    _prepared(spark)
    return accepted(docs, train(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, the one with the smallest doc_id.

    Documents without words are in no group and stay. Of rows that repeat a doc_id, the first by text stays if
    they are near duplicates of each other; rows with a null doc_id come last.
    """
    whole = _Whole(docs)
    found = similar_texts(whole.rows, key=ROW, text=whole.name["text"])
    return whole.without(found.where(F.col("class_id") != F.col(ROW)).select(ROW), "copies")


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages of 100 bytes and more that an earlier document or place has.

    Characters are cut whole. Texts change and n_chars with them; no document goes, and null texts stay null.
    """
    whole = _Whole(docs)
    kept = remove_repeats(whole.rows, key=ROW, text=whole.name["text"], whole_characters=True)
    changed = kept.where("size(spans) > 0").select(ROW, F.col("kept").cast("string").alias("kept"))
    joined = whole.rows.join(written(changed, "changed"), ROW, "left")
    values = {"text": F.coalesce("kept", whole.name["text"])}
    if "n_chars" in docs.columns:
        count = F.when(F.col("kept").isNotNull(), F.length("kept")).otherwise(F.col(whole.name["n_chars"]))
        values["n_chars"] = count.cast(docs.schema["n_chars"].dataType)
    return whole.named(joined, values)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no benchmark item."""
    whole = _Whole(docs)
    found = contained_items(whole.rows, table(spark, sf_dir, "benchmark"), key=ROW, text=whole.name["text"])
    return whole.without(found.select(ROW).distinct(), "contaminated")


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents in sequences of 2048 tokens, piece by piece."""
    _prepared(spark)
    return digest(pack(docs, public_tokenizers.path("word_bpe_49k.json")))


def _prepared(spark: SparkSession) -> None:
    """Python workers stay from stage to stage: small Arrow batches keep what they hold small."""
    ready(spark)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


class _Whole:
    """Whole rows under a unique key along doc_id (frames.identified), their columns under numbered names.

    Whatever the columns are called, they cannot clash with those that a stage adds.
    """

    def __init__(self, docs: DataFrame):
        _prepared(docs.sparkSession)
        self.columns = docs.columns
        self.name = {column: f"c{n}" for n, column in enumerate(docs.columns)}
        renamed = docs.toDF(*self.name.values())
        kept = {name: F.col(name) for name in renamed.columns}
        self.rows = identified(renamed, self.name["doc_id"], **kept).rows.select(ROW, *kept)

    def named(self, rows: DataFrame, values: dict[str, Column] | None = None) -> DataFrame:
        """The columns under their own names, some with new values."""
        return rows.select(*[(values or {}).get(c, F.col(self.name[c])).alias(c) for c in self.columns])

    def without(self, gone: DataFrame, name: str) -> DataFrame:
        """The rows whose keys are not in ``gone``, which is written first."""
        return self.named(self.rows.join(written(gone, name), ROW, "left_anti"))


STAGES = [
    ("language identification", language_identification),
    ("near duplicates", near_duplicates),
    ("repeated passages", repeated_passages),
    ("benchmark decontamination", decontamination),
    ("packing", packing),
]

#: No SQL can state compression sizes or tokenization; tests/llm/test_pipeline.py has a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over documents."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
