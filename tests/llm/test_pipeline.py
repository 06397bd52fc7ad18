"""Every stage of the pipeline against brute force on its own input, and the whole run."""

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline as pipeline
from brightwater.llm.languages import Classifier, MIN_SCORE, train
from tests.llm.test_contamination import brute as contained
from tests.llm.test_packing import LENGTH, check
from tests.llm.test_similar import brute as classes

FOLDER = "/root/testdata/sf0.001"


def cut(rows, length=100):
    """(key, text) in order to key -> text without repeated strings; characters whole."""
    seen, out = set(), {}
    for key, text in rows:
        data = text.encode()
        gone = [False] * len(data)
        for s in range(len(data) - length + 1):
            piece = data[s : s + length]
            if piece in seen:
                gone[s : s + length] = [True] * length
            seen.add(piece)
        kept, at = [], 0
        for char in text:
            size = len(char.encode())
            if not all(gone[at : at + size]):
                kept.append(char)
            at += size
        out[key] = "".join(kept)
    return out


@pytest.fixture(scope="module")
def stages(spark):
    """The input of every stage and its result, as one run has them."""
    docs, out = spark.read.parquet(f"{FOLDER}/documents.parquet"), []
    for name, stage in pipeline.STAGES:
        result = stage(spark, docs, FOLDER).cache()
        out.append((docs, result))
        docs = result
    return out


def texts(df):
    return sorted((r.doc_id, r.text) for r in df.collect())


def test_columns(stages):
    for docs, result in stages[:-1]:
        assert result.columns == docs.columns and result.dtypes == docs.dtypes


def test_languages(spark, stages):
    docs, result = stages[0]
    model = Classifier(train(docs))
    want = [(k, t) for k, t in texts(docs) if (p := model.predict(t))[0] != "und" and p[1] >= MIN_SCORE]
    assert texts(result) == want and 0.95 * docs.count() <= len(want)


def test_near_duplicates(stages):
    docs, result = stages[1]
    rows = texts(docs)
    found = classes(rows)
    assert texts(result) == [(k, t) for k, t in rows if found[k][0] == k]
    assert len(texts(result)) < len(rows)


def test_repeated_passages(stages):
    docs, result = stages[2]
    rows = texts(docs)
    want = cut(rows)
    assert dict(texts(result)) == want and want != dict(rows)
    assert all(r.n_chars == len(r.text) for r in result.collect() if r.text != dict(rows)[r.doc_id])


def test_decontamination(spark, stages):
    docs, result = stages[3]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    bad = {k for k, *_ in contained(texts(docs), items)}
    assert texts(result) == [(k, t) for k, t in texts(docs) if k not in bad]


def test_packing(stages):
    docs, result = stages[4]
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = {k: [*tokenizer.encode(t, add_special_tokens=False).ids, 1] for k, t in texts(docs)}
    rows = result.select("doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids_crc32")
    check([tuple(r) for r in rows.collect()], want, LENGTH)


def test_run_is_the_stages_in_order(spark, stages):
    assert sorted(map(tuple, pipeline.run(spark, FOLDER).collect())) == sorted(map(tuple, stages[-1][1].collect()))


def test_odd_rows(spark):
    """Null and repeated keys, null and empty texts, extra columns: no stage fails or loses columns."""
    body = " ".join(f"word{'abcdefgh'[i % 8]} tree" for i in range(60))
    rows = [(1, None, "en", "s", 0), (2, "", "en", "s", 0), (3, body, "en", "s", 5), (3, body, "en", "s", 5), (None, body + " more", None, None, None),
            (4, "12 34", "en", "s", 2), (5, "baum und haus " * 30, "de", "s", 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs = docs.withColumn("class_id", F.lit("x")).withColumn("packed", F.lit(1))
    for data in (docs, docs.limit(0)):
        for name, stage in pipeline.STAGES[1:4]:
            result = stage(spark, data, FOLDER)
            assert result.columns == docs.columns
            result.collect()
        assert pipeline.language_identification(spark, data, FOLDER).columns == docs.columns
        pipeline.packing(spark, data, FOLDER).collect()
    left = pipeline.near_duplicates(spark, docs, FOLDER).collect()
    assert sorted(str(r.doc_id) for r in left) == ["1", "2", "3", "4", "5"]
    assert pipeline.repeated_passages(spark, docs, FOLDER).where("text is null").count() == 1
    assert sorted(r.doc_id for r in pipeline.language_identification(spark, docs, FOLDER).where("doc_id is not null").collect()) == [3, 3, 5]


CLASHES = ["key", "df", "__row", "__key", "kept", "c0", "c1", "rows", "columns", "row", "span", "code", "class_id"]


@pytest.mark.parametrize("repeat", [False, True])
def test_clashing_columns(spark, repeat):
    """Every stage keeps columns that are called like its own, also where rows must be numbered."""
    own = spark.read.parquet(f"{FOLDER}/documents.parquet").limit(60)
    docs = own.union(own.limit(5).withColumn("doc_id", F.lit(None).cast("long"))) if repeat else own
    wide = docs.select(*docs.columns, *[F.concat(F.lit(f"{c}-"), F.col("doc_id").cast("string")).alias(c) for c in CLASHES])
    for _, stage in pipeline.STAGES[:-1]:
        result, plain = stage(spark, wide, FOLDER), stage(spark, docs, FOLDER)
        assert result.columns == wide.columns and result.dtypes == wide.dtypes
        rows = result.collect()
        assert sorted((repr(r.doc_id), r.text, r.n_chars) for r in rows) == sorted(
            (repr(r.doc_id), r.text, r.n_chars) for r in plain.collect()
        )
        assert all(r[c] == (None if r.doc_id is None else f"{c}-{r.doc_id}") for r in rows for c in CLASHES)
    assert len(pipeline.packing(spark, wide, FOLDER).collect()) >= docs.count()
