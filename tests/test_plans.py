"""Plans that must hold at any size."""

import pytest

import __spark_entry__ as driver
from brightwater.entries import retrieval as searches
from brightwater.operators import retrieval, vector
from brightwater.operators.churn_scoring import score_churn
from brightwater.plans import tables

FOLDER = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_flagship(spark):
    text = plan(driver.entry(spark))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text
    assert "BatchEvalPython" not in text
    assert "WindowGroupLimit" in text


def test_only_needed_columns_are_read(spark):
    logs = driver.queries()["request_stats"](spark, FOLDER)
    assert "ReadSchema: struct<event_id:bigint,ts:timestamp_ntz,user_id:bigint,event_type:string,value:double,props:string>" in plan(logs)
    by_key = driver.queries()["read_table_by_key"](spark, FOLDER)
    assert "EqualTo(user_id,42)" in plan(by_key)


@pytest.mark.parametrize("name", ["last_n_interactions", "rank_by_keyword", "rrf_topk", "vector_topk"])
def test_top_rows_are_cut_before_the_shuffle(spark, name):
    assert "WindowGroupLimit" in plan(driver.queries()[name](spark, FOLDER))


def test_scoring_stays_in_the_jvm(spark):
    text = plan(score_churn(tables.telco(spark, FOLDER)))
    assert "Python" not in text and "Window" not in text


def test_large_query_sets_are_not_broadcast(spark, monkeypatch):
    monkeypatch.setattr(retrieval, "fits", lambda *a, **k: False)
    queries, chunks = tables.text_queries(spark, FOLDER), searches.chunks(spark, FOLDER)
    conf = "spark.sql.autoBroadcastJoinThreshold"
    old = spark.conf.get(conf)
    spark.conf.set(conf, "-1")
    try:
        scored = retrieval.bm25_score(queries, chunks)
        assert "Broadcast" not in plan(scored)
        big = {(r.query_id, r.id, r.score) for r in scored.collect()}
    finally:
        spark.conf.set(conf, old)
    monkeypatch.undo()
    assert big == {(r.query_id, r.id, r.score) for r in retrieval.bm25_score(queries, chunks).collect()}


def test_rows_of_many_queries_equal_those_of_few(spark):
    queries, stored = tables.label_queries(spark, FOLDER), searches.stored_vectors(spark, FOLDER)
    few = vector.vector_topk(queries, stored, 5)
    many = vector.vector_topk(queries, stored, 5, query_block=3)
    assert sorted(map(tuple, few.collect())) == sorted(map(tuple, many.collect()))


def test_metrics_read_the_scores_once(spark):
    text = driver.queries()["binary_metrics"](spark, FOLDER)._jdf.queryExecution().optimizedPlan().toString()
    assert text.count("Relation [") <= 4


def test_positions_without_a_key_have_no_single_window(spark):
    found = driver.queries()["walk_forward_folds"](spark, FOLDER)
    windows = [line for line in plan(found).split("\n") if " Window [" in line]
    assert any("_part" in line for line in windows)
