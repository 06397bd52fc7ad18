"""Held-out accuracy and edge cases of language identification."""

import zlib

import pytest
from pyspark.sql import functions as F

from brightwater.llm.frames import table
from brightwater.llm.languages import Classifier, accepted, identify, language_id, train

FOLDER = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    true = {r.doc_id: r for r in table(spark, FOLDER, "documents").collect()}
    rows = language_id(spark, FOLDER).collect()
    assert len(rows) == len(true)
    held = [r for r in rows if r.held_out]
    assert {r.doc_id for r in held} == {k for k in true if zlib.crc32(str(k).encode()) % 4 == 2}
    right = sum(r.lang_pred == true[r.doc_id].lang for r in held)
    assert right >= 0.97 * len(held)
    assert all(0 <= r.score <= 1 for r in rows)
    labelled = {r.lang for r in true.values()}
    assert {r.lang_pred for r in rows} <= labelled | {"und"}


@pytest.fixture(scope="module")
def model():
    english = " ".join(f"the {w} of this house and that {w}" for w in "tree river garden street window".split()) * 20
    german = " ".join(f"der {w} des hauses und die {w}" for w in "baum fluss garten strasse fenster".split()) * 20
    return {"en": [english.encode()], "de": [german.encode()]}


def test_predictions(model):
    known = Classifier(model)
    assert known.predict("the river of this house and that garden")[0] == "en"
    assert known.predict("DER FLUSS des hauses !! und die strasse")[0] == "de"
    for text in (None, "", "  ", "123 ... !!", "_"):
        assert known.predict(text) == ("und", 0.0)
    assert known.predict("the river " * 20_000)[0] == "en"
    assert known.predict("qqq xxx")[0] in ("en", "de")
    assert Classifier({"en": model["en"]}).predict("abc") == ("en", 1.0)
    assert Classifier({}).predict("abc") == ("und", 0.0)


def test_rows_keep_their_columns(spark, model):
    rows = [(1, "the garden of this house", "x"), (1, "the garden of this house", "x"), (None, None, "y"), (2, "12", "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string")
    found = identify(docs.withColumnRenamed("score", "rank"), model, "text", "doc_id", "rank").collect()
    assert sorted(((r.doc_id, r.rank, r.lang_pred) for r in found), key=repr) == sorted(
        [(1, "x", "en"), (1, "x", "en"), (None, "y", "und"), (2, "z", "und")], key=repr
    )
    kept = accepted(docs, model)
    assert kept.columns == docs.columns and kept.count() == 2
    assert accepted(docs.limit(0), model).count() == 0


def test_training_rows(spark):
    docs = spark.createDataFrame([(1, None, "en"), (2, "x", None), (3, " ", "en")], "doc_id long, text string, lang string")
    assert train(docs) == {}
    assert train(docs.limit(0)) == {}
    many = spark.range(3000).select(
        F.col("id").alias("doc_id"), F.lit("wort und satz " * 200).alias("text"), F.lit("de").alias("lang")
    )
    assert sum(map(len, train(many)["de"])) < 200_000


def test_null_and_repeated_keys_are_drawn_by_row(spark):
    """A third of the rows under no key, and a third under one key, neither fill the sample nor escape its bound."""
    key = F.when(F.col("id") % 3 == 0, F.lit(None)).when(F.col("id") % 3 == 1, F.lit(-1)).otherwise(F.col("id"))
    mark = F.element_at(F.array(F.lit("null"), F.lit("same"), F.lit("own")), (F.col("id") % 3 + 1).cast("int"))
    letters = F.translate(F.col("id").cast("string"), "0123456789", "abcdefghij")
    docs = spark.range(6000).select(key.alias("doc_id"), F.concat_ws(" ", mark, letters).alias("text"), F.lit("en").alias("lang"))
    words = train(docs, texts=300)["en"][0].decode().split()
    assert len(words) == 600
    assert all(50 <= words.count(kind) <= 150 for kind in ("null", "same", "own"))
    copies = docs.select("doc_id", F.lit("one text").alias("text"), "lang").where("doc_id is null")
    assert train(copies.union(docs.limit(0)), texts=300)["en"][0] == b"one text"


def test_every_language_is_learned(spark):
    letters = F.translate(F.col("id").cast("string"), "0123456789", "abcdefghij")
    docs = spark.range(1100).select(F.col("id").alias("doc_id"), F.concat(F.lit("words of "), letters).alias("text"), letters.alias("lang"))
    assert len(train(docs)) == 1100
