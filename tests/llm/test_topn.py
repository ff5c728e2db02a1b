import random

from pyspark.sql import functions as F

from cinelode.llm import topn
from cinelode.llm.queries import oracle_sql, queries
from helpers import duck, duck_rows, rows


def ranked(df, n, parts):
    ranking = [F.col("score").desc(), F.col("second").desc_nulls_last(), F.col("id").asc()]
    return sorted(tuple(r) for r in topn.top_n(df, "g", ranking, n, ["id"], partitions=parts).collect())


def test_a_hot_group_over_many_partitions(spark):
    rng = random.Random(2)
    rows_ = [(i, rng.choice(["hot"] * 6 + list("abcdef")), float(rng.randrange(5)), rng.choice([None, 1.0, 2.0])) for i in range(3000)]
    df = spark.createDataFrame(rows_, "id bigint, g string, score double, second double").repartition(7)
    want = []
    for g in {r[1] for r in rows_}:
        own = sorted((r for r in rows_ if r[1] == g), key=lambda r: (-r[2], r[3] is None, -(r[3] or 0), r[0]))
        want += [(g, k, r[0]) for k, r in enumerate(own[:5], 1)]
    for parts in (1, 3, 16):
        assert ranked(df, 5, parts) == sorted(want)


def test_small_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        df = spark.createDataFrame([(i, "ab"[i % 2], float(i), None) for i in range(40)], "id bigint, g string, score double, second double")
        assert ranked(df, 3, 2) == [("a", 1, 38), ("a", 2, 36), ("a", 3, 34), ("b", 1, 39), ("b", 2, 37), ("b", 3, 35)]
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_null_groups_empty_and_latest(spark):
    df = spark.createDataFrame([(1, None, 1.0, None)], "id bigint, g string, score double, second double")
    assert ranked(df, 5, 4) == [] and ranked(df.limit(0), 5, 4) == []
    t = spark.createDataFrame([(1, 5, "a"), (1, 7, None), (1, 7, None), (2, None, "b")], "id int, at int, v string")
    assert sorted(map(tuple, topn.latest(t, "id", "at", ["v"]).collect())) == [(1, None), (2, "b")]


def test_query(spark, data):
    assert rows(queries()["p3_found"](spark, data)) == duck_rows(duck(data), oracle_sql()["p3_found"])
