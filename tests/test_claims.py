"""Several consumers of one queue take every job once, oldest segment first, also after a loss."""

from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target

from brightwater.plans.scratch import scratch_path
from brightwater.streaming import claims

SCHEMA = "job_id long, text string"


def queue_of(spark, segments):
    path = scratch_path(spark, "queue")
    names = [claims.enqueue_segment(spark.createDataFrame([(j, f"t{j}") for j in jobs], SCHEMA), path) for jobs in segments]
    return path, names


def test_two_consumers(spark):
    segments = [[10 * s + j for j in range(5)] for s in range(8)]
    path, names = queue_of(spark, segments)
    store = scratch_path(spark, "store")

    def consume(name):
        return claims.take_segments(spark, path, name, store, SCHEMA)

    with ThreadPool(3) as pool:
        taken = pool.map(inheritable_thread_target(spark)(consume), ["a", "b", "c"])
    assert sorted(sum(taken, [])) == names and all(own == sorted(own) for own in taken)
    assert sorted(r.job_id for r in spark.read.parquet(store).collect()) == sorted(sum(segments, []))
    assert claims.claim(spark, path, "a") is None


def test_oldest_first_and_new_segments(spark):
    path, names = queue_of(spark, [[1], [2], [3]])
    store = scratch_path(spark, "store")
    assert claims.take_segments(spark, path, "a", store, SCHEMA, most=2) == names[:2]
    later = claims.enqueue_segment(spark.createDataFrame([(4, None)], SCHEMA), path)
    assert claims.take_segments(spark, path, "b", store, SCHEMA) == [names[2], later]


def test_a_lost_consumer_goes_on(spark):
    path, names = queue_of(spark, [[1, 2], [3]])
    store = scratch_path(spark, "store")
    assert claims.claim(spark, path, "a") == names[0]  # and is lost before anything is stored
    assert claims.take_segments(spark, path, "b", store, SCHEMA) == [names[1]]
    assert claims.claim(spark, path, "a") == names[0]
    half = spark.createDataFrame([(1, "half")], SCHEMA)
    half.write.parquet(f"{store}/segment={names[0]}")  # lost again while it was writing
    assert claims.take_segments(spark, path, "a", store, SCHEMA) == [names[0]]
    assert sorted(map(tuple, spark.read.schema(SCHEMA).parquet(store).select("job_id", "text").collect())) == [(1, "t1"), (2, "t2"), (3, "t3")]


def test_empty_queue_and_empty_segment(spark):
    path, store = scratch_path(spark, "queue"), scratch_path(spark, "store")
    assert claims.take_segments(spark, path, "a", store, SCHEMA) == []
    claims.enqueue_segment(spark.createDataFrame([], SCHEMA), path)
    assert len(claims.take_segments(spark, path, "a", store, SCHEMA)) == 1
    assert spark.read.schema(SCHEMA).parquet(store).count() == 0
