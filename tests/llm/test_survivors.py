from datetime import datetime

from pyspark.sql import functions as F

from cinelode.llm import survivors

FILES = "id bigint, item_id bigint, name string, short_name string, size bigint, listed_at timestamp, first_id string"
DAY = datetime(2024, 1, 1)
LATER = datetime(2024, 2, 1)


def found(spark, rows):
    df = spark.createDataFrame([(*r, "clash") for r in rows], FILES)
    return sorted((r.first_id, r.keep_id) for r in survivors.same_files(df).collect())


def test_groups(spark):
    rows = [
        (1, 1, "Show S01E02.mkv", "n/a", 5, DAY),
        (2, 1, "Other spelling/Shw - S01E02 - x [720p].mp4", "ok", 5, DAY),
        (3, 1, "Show.S01E02.ass", "ok", 5, DAY),  # another class
        (4, 1, "Show - 02 [1080p].mkv", "ok", 5, LATER),  # the one regular season
        (5, 1, "Show OVA 02.mkv", "ok", 5, DAY),  # special
        (6, 1, "Sample/Show.S01E02.sample.mkv", "ok", 5, DAY),
        (7, 1, None, "ok", 5, DAY),
        (4, 1, "Show - 02 [1080p].mkv", "ok", 5, LATER),  # exact repeat
        (8, 2, "Show S01E02.mkv", "ok", 5, DAY),  # another download
    ]
    assert found(spark, rows) == [(1, 4)]


def test_two_seasons_leave_bare_numbers_alone(spark):
    rows = [(1, 1, "A S01E02.mkv", "a", 1, DAY), (2, 1, "A S02E02.mkv", "a", 1, DAY), (3, 1, "A - 02.mkv", "a", 1, DAY), (4, 1, "B - 02 [720p].mkv", "a", 1, DAY)]
    assert found(spark, rows) == [(3, 3)]


def test_tracks_films_extras(spark):
    rows = [
        (1, 1, "B - A (2001)/Disc 1/02 - x.flac", "-", 0, None),
        (2, 1, "B - A (2001)/cd1/2_y.mp3", None, 7, None),
        (3, 1, "B - A (2001)/cd2/02 y.mp3", None, 7, None),
        (4, 2, "F (2001).mkv", "a", 1, None),
        (5, 2, "[G] F Movie.avi", "a", 1, None),
        (6, 2, "F (2001)/extras/Making.Of.mkv", "a", 1, None),
        (7, 2, "Q/Bonus/making_of [720p].mp4", "a", 1, DAY),
        (8, 2, "F (2001)/extras/Trailer.mkv", "a", 1, None),
    ]
    assert found(spark, rows) == [(1, 2), (4, 4), (6, 7)]


def test_field_by_field(spark):
    rows = [(1, 1, "A S01E01.mkv", "unknown", 9, LATER), (2, 1, "A S01E01 x.mkv", "good", -1, DAY), (3, 1, "A S01E01 y.mkv", " ", None, None)]
    df = spark.createDataFrame([(*r, "") for r in rows], FILES)
    r = survivors.same_files(df).first()
    assert (r.first_id, r.keep_id, r.best_name, r.best_short_name, r.best_size) == (1, 1, "A S01E01.mkv", "good", 9)


def test_values_of_trusted_containers_go_first(spark):
    rows = [(1, 1, "A S01E01.avi", "late", 9, LATER), (2, 1, "A S01E01.MKV", "mine", None, DAY), (3, 1, "A - 01.mp4", None, 7, None), (3, 1, "A - 01.mp4", None, 7, None)]
    df = spark.createDataFrame([(*r, "") for r in rows], FILES)
    r = survivors.same_files(df, by_source=True).first()
    assert (r.first_id, r.keep_id, r.best_name, r.best_short_name, r.best_size) == (1, 1, "A S01E01.MKV", "mine", 7)
    # Most usable values still decide on the record; among equal ones the source does.
    assert survivors.same_files(df.filter("id > 1"), by_source=True).first().keep_id == 2


def test_a_group_without_season_is_merged_from_its_maxima(spark):
    """A name that has the season comes only once the others are aggregated, and wins or loses as if it had been there."""
    for late, keep in ((DAY, 5), (LATER, 1)):
        rows = [(5, 1, "A - 02.mkv", "x", 1, datetime(2024, 1, 15)), (6, 1, "A Episode 2.mkv", "x", 1, DAY), (1, 1, "A S03E02.mkv", "x", 1, late), (9, 1, "A S00E02.mkv", "x", 1, LATER)]
        assert found(spark, rows) == [(1, keep)]


def test_one_parse(spark):
    """Names are read in one place of the plan, before the groups are written."""
    df = spark.createDataFrame([(1, 1, "A S01E01.mkv", "a", 1, DAY, "")], FILES)
    assert survivors.same_files(df)._jdf.queryExecution().executedPlan().toString().count("MapInPandas") == 0


def test_ties_priority_and_empty(spark):
    df = spark.createDataFrame([(1, "k", "a", 1), (2, "k", "b", 1), (3, None, "c", 2), (4, None, None, 2)], "id bigint, g string, v string, at int")
    rule = {"v": survivors.usable_text(F.col("v"))}
    assert {(r.g, r.first_id, r.keep_id) for r in survivors.survivors(df, ["g"], "id", rule, "at").collect()} == {("k", 1, 1), (None, 3, 3)}
    assert {(r.g, r.keep_id, r.best_v) for r in survivors.survivors(df, ["g"], "id", rule, "at", priority=F.col("id")).collect()} == {("k", 2, "b"), (None, 3, "c")}
    assert survivors.survivors(df.limit(0), ["g"], "id", rule, "at").count() == 0
