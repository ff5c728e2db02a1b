import random

from pyspark.sql import functions as F

from cinelode.operators import intervals as I


def brute(spans):
    out, reach = [], None
    for s, e in sorted(x for x in spans if x[1] > x[0]):
        if reach is not None and s > reach:
            out.append((reach, s))
        reach = e if reach is None else max(reach, e)
    return out


def frame(spark, rows):
    return spark.createDataFrame(rows, "k bigint, s_ms bigint, e_ms bigint")


def test_random_spans_against_brute_force(spark):
    rng = random.Random(5)
    rows = [(k, s, s + rng.choice([0, 1, 50, 900, 5000])) for k in range(6) for s in [rng.randrange(0, 40_000) for _ in range(60)]]
    got = sorted(map(tuple, I.gaps(frame(spark, rows), "k", bucket_ms=3000).collect()))
    want = sorted((k, a, b) for k in range(6) for a, b in brute([(s, e) for kk, s, e in rows if kk == k]))
    assert got == want


def test_touching_nested_zero_length_and_repeats(spark):
    rows = [(1, 0, 10), (1, 10, 20), (1, 5, 8), (1, 30, 30), (1, 40, 50), (1, 40, 50), (None, 0, 5), (None, 9, 12)]
    assert sorted(map(tuple, I.gaps(frame(spark, rows), "k").collect()), key=str) == [(1, 20, 40), (None, 5, 9)]
    assert sorted(map(tuple, I.periods(frame(spark, rows), "k").collect()), key=str) == [(1, 0, 20), (1, 40, 50), (None, 0, 5), (None, 9, 12)]


def test_a_long_line_reaches_over_later_buckets(spark):
    rows = [(1, 0, 100_000), (1, 5_000, 6_000), (1, 50_000, 51_000), (1, 100_500, 101_000)]
    assert list(map(tuple, I.gaps(frame(spark, rows), "k", bucket_ms=1000).collect())) == [(1, 100_000, 100_500)]


def test_usable_time(spark):
    nan = float("nan")
    rows = [(1, 1.0, 2.0, None), (2, None, 2.0, 0.5), (3, 1.0, nan, 0.25), (4, 3.0, 1.0, None), (5, nan, None, 1.0), (6, None, 2.0, None), (7, 1.0, float("inf"), 1.0)]
    df = spark.createDataFrame(rows, "id int, start double, end double, window double").withColumn("s_msx", F.lit("extra"))
    got = {r.id: (r.s_ms, r.e_ms) for r in I.usable_time(df).collect()}
    assert got == {1: (1000, 2000), 2: (1500, 2000), 3: (1000, 1250), 4: (1000, 3000), 7: (1000, 2000)}


def test_empty(spark):
    assert I.gaps(frame(spark, []), "k").count() == 0
    assert I.periods(frame(spark, []), "k").count() == 0
