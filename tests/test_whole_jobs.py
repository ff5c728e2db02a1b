"""Queries that must take in every row."""

import duckdb
import pytest

from cinelode.operators import rank, render
from cinelode.plans import registry, search
from helpers import duck_rows, rows

QUERIES, SQL = registry.queries(), registry.oracle_sql()


def tables(tmp_path, **made):
    """A folder with the given tables (SQL each) and a connection that sees them."""
    c = duckdb.connect()
    for name, sql in made.items():
        c.sql(f"copy ({sql}) to '{tmp_path}/{name}.parquet'")
        c.sql(f"create view {name} as select * from '{tmp_path}/{name}.parquet'")
    return str(tmp_path), c


@pytest.fixture
def albums(tmp_path):
    """Files with odd and even ids named as albums: of two artists, of none, and one that is not plausible."""
    names = ["Ann Lee - 1999 - Garden of Stone", "Ann Lee - 2001 - The Garden of Stone", "Bo Ray - 1999 - Garden of Stone", "Garden of Stone 1999", "Quiet Garden of Stone 2003", "Ann Lee - Tin..."]
    ids = [3, 4, 55, 8, 107, 9]
    files = " union all ".join(f"select {i}::bigint as id, '{n}.flac' as name, {10_000_000 + i}::bigint as size" for i, n in zip(ids, names, strict=True))
    return tables(tmp_path, files=files)


def test_plausible_albums_of_odd_ids(spark, albums):
    d, c = albums
    got = rows(QUERIES["p12_plausible_albums"](spark, d))
    assert got == duck_rows(c, SQL["p12_plausible_albums"])
    assert {r[1] for r in got[1]} == {3, 4, 55, 8, 107}


def kept_albums(found):
    """By pairs: the ids kept of (artist, key, seeders, id), best first within an artist."""
    kept = []
    for artist, key, _, ident in sorted(found, key=lambda r: (-r[2], r[3])):
        same = [k for a, k, _ in kept if a == artist]
        if key and not any(k == key or min(len(k), len(key)) >= 8 and (k.endswith(key) or key.endswith(k)) for k in same):
            kept.append((artist, key, ident))
    return [(ident, artist) for artist, _, ident in kept]


def test_greedy_albums_by_artist(spark, albums):
    got = QUERIES["w16_greedy_albums"](spark, albums[0]).collect()
    assert sorted((r.id, r.grp) for r in got) == [(4, "annlee"), (55, "boray"), (107, None)]


def test_greedy_albums_against_pairs(spark, data):
    found = [(r.grp, r.key, r.seeders, r.id) for r in search._plausible(spark, data).selectExpr("lower(regexp_replace(artist, r'[^\\p{L}\\p{N}_]+', '')) grp", "key", "seeders", "id").collect()]
    got = sorted(((r.id, r.grp) for r in QUERIES["w16_greedy_albums"](spark, data).collect()), key=repr)
    assert len({grp for grp, *_ in found}) > 1 and got == sorted(kept_albums(found), key=repr)


def test_fold_keeps_no_rows_and_groups_nulls(spark):
    """A group of many batches, its key NULL, is one group with one state."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        df = spark.range(100).selectExpr("cast(null as bigint) g", "id", "concat('sameoldalbum', id % 3) key").unionByName(spark.createDataFrame([(1, 500, "sameoldalbum0")], "g bigint, id bigint, key string"))
        got = {(r.g, r.id) for r in search.greedy_suffixes(df, "g", "key", ["id"]).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert {i for _, i in got} == {0, 1, 2, 500}


def test_pending_and_new_hold_every_release(spark, tmp_path):
    d, c = tables(tmp_path, files="select i::bigint as id, case when i in (5, 7) then 'same.mkv' else 'release ' || i || '.mkv' end as name, 1::bigint as size from range(1, 21) t(i)")
    got = rows(QUERIES["r05_pending_and_new"](spark, d))
    assert got == duck_rows(c, SQL["r05_pending_and_new"])
    assert {r[0] for r in got[1]} == set(range(1, 21)) - {7}


def test_covers_of_all_files(spark, tmp_path):
    """Items whose ids of files don't divide by 5 have covers too, and a better one among them wins."""
    d, c = tables(tmp_path, files="select i::bigint as id, (i % 4)::bigint as item_id, 'x.mkv' as name, (1000000 + 1000 * i)::bigint as size from range(1, 30) t(i) where i % 5 > 0 or i % 4 = 0")
    got = rows(QUERIES["t05_p26_covers"](spark, d))
    assert got == duck_rows(c, SQL["t05_p26_covers"])
    assert {r[1] for r in got[1]} == {0, 1, 2, 3}


def test_every_result_has_a_place(spark, tmp_path):
    d, c = tables(tmp_path, files="select i::bigint as id, 'Show ' || i || case i % 3 when 0 then ' 1080p.mkv' else ' 720p.mkv' end as name, 300000000::bigint as size from range(1, 251) t(i)")
    got = rows(QUERIES["t03_ranked_results"](spark, d))
    assert got == duck_rows(c, SQL["t03_ranked_results"])
    assert sorted(r[got[0].index("place")] for r in got[1]) == list(range(1, 251))


def test_pick(spark):
    ranked = rank.placed(spark.createDataFrame([(i, s) for i, s in enumerate([5, None, 9, 5, 9])], "id long, score long"), "score", "id")
    assert [(r.place, r.id) for r in ranked.orderBy("place").collect()] == [(1, 2), (2, 4), (3, 0), (4, 3), (5, 1)]
    picked = lambda df, n: [(r.id, r.error) for r in rank.pick(df, n).collect()]
    assert picked(ranked, 3) == [(0, None)]
    assert picked(ranked, 0) == picked(ranked, 6) == [(None, "pick 1-5")]
    assert picked(ranked.filter("false"), 1) == [(None, "no results")]
    many = rank.placed(spark.range(30).selectExpr("id", "-id score"), "score", "id")
    assert picked(many, 12) == [(11, None)] and picked(many, 31) == [(None, "pick 1-10")]


def test_ninety_cleanest(spark):
    clips = spark.range(200).selectExpr("cast(id % 7 as int) show_id", "concat('s', id) speaker", "if(id = 3, null, cast(id div 2 as double)) ratio")
    got = [(r.ratio, r.show_id, r.speaker) for r in render.cleanest(clips).collect()]
    want = sorted(((i // 2 * 1.0, i % 7, f"s{i}") for i in range(200) if i != 3), key=lambda r: (-r[0], r[1], r[2]))[:90]
    assert got == want


def test_more_queries_than_memory_holds(spark):
    k = spark.createDataFrame([(1, "xxhollowship"), (2, "hollow"), (3, ""), (4, "ship")], "id bigint, key string")
    q = spark.createDataFrame([(7, "hollow"), (8, "ship"), (9, "hollowships"), (7, "")], "show_id int, q string")
    want = {(1, 7), (1, 8), (2, 7), (4, 8)}
    for most in (2, 100):
        assert {tuple(r) for r in search._contained(k, q, most).collect()} == want
