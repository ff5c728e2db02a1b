import pytest
from pyspark.sql import functions as F

from cinelode.functions import text as T
from cinelode.operators import casting as C
from cinelode.operators import library as L
from cinelode.sources import readers as R
from cinelode.sources import writers as W


def test_members(spark):
    bank = spark.createDataFrame([(1, "POLAR BEAR"), (1, "PENGUIN"), (1, "PANDA"), (1, "PANDA MOTHER")], "show_id int, speaker string")
    labels = spark.createDataFrame([(1, "BEAR / PENG"), (1, "PANDA & BEAR"), (1, "GHOST/BEAR"), (2, "A/B"), (1, "ALONE")], "show_id int, label string")
    got = {(r.show_id, r.label): r.voices for r in C.member_voices(labels, bank).collect()}
    assert got == {(1, "BEAR / PENG"): ["POLAR BEAR", "PENGUIN"], (1, "PANDA & BEAR"): [], (1, "GHOST/BEAR"): [], (2, "A/B"): []}


def test_sheets(spark):
    a = spark.createDataFrame([(1, 10, "x/disc.flac"), (2, 20, "One.flac"), (2, 21, "two.flac"), (2, 22, "three.flac")], "item_id int, id int, name string")
    s = spark.createDataFrame([(1, 1, "any.cue", "other.wav"), (2, 2, "one.cue", "nothing.wav"), (2, 3, "z.cue", "TWO.wav"), (2, 4, "two.cue", None)], "item_id int, sheet int, sheet_name string, named string")
    assert sorted(map(tuple, C.sheets_of_audio(a, s).collect())) == [(10, 1), (20, 2), (21, 3)]


def test_speakable_takes_trim_unison(spark):
    t = spark.createDataFrame([("Ｔhe Tsukkomi, tsukkomi!",), (None,)], "text string")
    assert [r[0] for r in C.speakable(t, "text", {"tsukkomi": "tsoo-koh-mee"}).collect()] == ["The Tsoo-koh-mee, tsoo-koh-mee!", None]
    k = spark.createDataFrame([("red door", 2, "red"), ("red door", 1, "red door"), ("red door", 3, None)], "phrase string, take int, heard string")
    assert [(x.take, x.missed) for x in C.takes(k).first().takes] == [(1, []), (2, ["door"]), (3, ["red", "door"])]
    c = spark.createDataFrame([([0.0, 0.0, 1.0, 1.0, 0.0],), ([0.0, 0.0],)], "v array<double>")
    assert [r.v for r in C.trimmed(c, "v", 50).collect()] == [[1.0, 1.0], [0.0, 0.0]]
    v = spark.createDataFrame([(1, 0, [1.0, 1.0]), (1, 1, [1.0, 1.0])], "line int, voice int, samples array<double>")
    assert [round(r["sample"], 4) for r in C.unison(v, "line", 1).orderBy("i").collect()] == [0.7071, 1.4142, 0.7071]


def test_writers(spark, tmp_path):
    q = spark.createDataFrame([("a\tb", None, 3)], "album string, year string, size int")
    W.write_tsv(q, ["album", "year", "size"], str(tmp_path / "q"))
    assert [r.value for r in spark.read.text(str(tmp_path / "q")).collect()] == ["a b\t\t3"]
    m = spark.createDataFrame([("OTTER", 1.5, 3), ("BEAR", None, 1)], "speaker string, pitch double, clips int")
    W.write_map(m, "speaker", ["pitch", "clips"], str(tmp_path / "m"))
    assert sorted(map(tuple, W.read_map(spark, str(tmp_path / "m"), "pitch:double,clips:int", "speaker").collect())) == [("BEAR", None, 1), ("OTTER", 1.5, 3)]
    assert W.worksheet_lines(m, "speaker", ["clips"]).collect()[0].value == '{"speaker":"OTTER","clips":3}'
    W.commit_report(m, q, str(tmp_path / "r"))
    assert W.committed(spark, str(tmp_path / "r"))[0].count() == 2
    assert {r.name for r in W.listing(spark, str(tmp_path / "r"), "_SUCCESS").collect()} <= {"_SUCCESS"}


def test_subtitles_there_and_back(spark):
    lines = spark.createDataFrame([("f", 1000, 2500, "Hello"), ("f", 500, 900, "First"), ("f", 0, 100, "Gone"), ("g", 3_600_000, 3_601_000, None)], "file string, st bigint, en bigint, text string")
    srt = W.subtitle_text(lines, "file", -400)
    back = R.srt_events(srt, "file", "text").orderBy("file", "st").collect()
    assert [(r.file, r.st, r.en, r.text) for r in back] == [("f", 100, 500, "First"), ("f", 600, 2100, "Hello"), ("g", 3_599_600, 3_600_600, "")]
    ass = W.subtitle_text(lines, "file", 0, "ass")
    again = R.ass_events(R.lines_of(ass, "file", "text"), "file").filter("file = 'f'").orderBy("st").collect()
    assert [(r.st, r.en, r.text) for r in again] == [(0, 100, "Gone"), (500, 900, "First"), (1000, 2500, "Hello")]


def test_cache_and_names(spark):
    rows = spark.range(5).withColumnRenamed("id", "k")
    cache = spark.createDataFrame([(1, "old"), (9, "other")], "k bigint, v string")
    whole, new = W.through_cache(rows, cache, "k", lambda d: d.withColumn("v", F.lit("new")))
    assert sorted(map(tuple, whole.collect())) == [(0, "new"), (1, "old"), (2, "new"), (3, "new"), (4, "new")] and new.count() == 4
    n = spark.createDataFrame([("012-otter-some-words-t3.wav",), ("junk",)], "n string").select(W.clip_name(F.col("n")).alias("c"))
    assert [tuple(r.c) for r in n.collect()] == [(12, "otter", "some-words", 3), (None, None, None, None)]
    s = spark.createDataFrame([("OTTER:: Hi there",), ("plain",)], "l string").select(W.spoken_line(F.col("l")).alias("s"))
    assert [tuple(r.s) for r in s.collect()] == [("OTTER", "Hi there"), (None, "plain")]


def test_small_lookups(spark):
    from cinelode.operators import frames, render

    r = spark.createDataFrame([("a", "", "u"), ("b", "m", None), ("c", None, "")], "title string, magnetUrl string, downloadUrl string")
    assert sorted((x.title, x.link) for x in R.with_link(r).collect()) == [("a", "u"), ("b", "m")]
    f = spark.createDataFrame([(1, 0, 2.0), (1, 1, 9.0), (1, 2, 4.0), (2, 0, 1.0)], "k int, frame int, ratio double")
    assert sorted((x.k, x.frame) for x in frames.passable(f, "k").collect()) == [(1, 1), (1, 2), (2, 0)]
    lines = spark.createDataFrame([(1, 1, 0, "A"), (2, 1, 0, "B"), (3, 1, None, "A")], "id int, episode_id int, overdub int, speaker string")
    pans = spark.createDataFrame([(1, 0, "A", -0.6)], "episode_id int, overdub int, speaker string, pan double")
    assert sorted((x.id, x.pan) for x in render.placed(lines, pans).collect()) == [(1, -0.6), (2, None), (3, None)]


def test_a_report_stands_only_once_its_manifest_does(spark, tmp_path, monkeypatch):
    folder = str(tmp_path / "r")
    one = spark.createDataFrame([(1, "a")], "id int, v string")
    first = W.commit_report(one, one, folder)
    broken = one.withColumn("v", F.raise_error(F.lit("no")).cast("string"))
    with pytest.raises(Exception):
        W.commit_report(one.withColumn("id", F.lit(2)), broken, folder)
    report, artefact = W.committed(spark, folder)
    assert report.first().id == 1 == artefact.first().id
    second = W.commit_report(one.withColumn("id", F.lit(3)), one, folder)
    assert first != second and W.committed(spark, folder)[0].first().id == 3


def test_checkpoints_are_released(spark):
    from cinelode import session

    session.release(spark)
    df = session.cut(spark.range(5))
    assert df.count() == 5 and session.release(spark) == 1 and session.release(spark) == 0


def test_a_failed_listing_is_no_empty_one(spark):
    schema = "success boolean, detail string, data array<struct<id:bigint>>"
    fine = spark.createDataFrame([(True, None, [(1,), (2,)])], schema)
    assert R.successful(fine).count() == 2
    with pytest.raises(Exception, match="rate limit"):
        R.successful(spark.createDataFrame([(False, "rate limit", [])], schema)).collect()


def test_sample_formats(spark):
    import struct

    def wav(kind, bits, data, rate=8000):
        fmt = struct.pack("<HHIIHH", kind, 1, rate, rate * bits // 8, bits // 8, bits)
        body = b"WAVE" + b"fmt " + struct.pack("<I", 16) + fmt + b"data" + struct.pack("<I", len(data)) + data
        return b"RIFF" + struct.pack("<I", len(body)) + body

    files = [("u8", wav(1, 8, bytes([128, 192, 64]))), ("i16", wav(1, 16, struct.pack("<3h", 0, 16384, -16384))), ("i24", wav(1, 24, b"\0\0\0\0\0\x40\0\0\xc0")), ("i32", wav(1, 32, struct.pack("<3i", 0, 2**30, -(2**30)))), ("f32", wav(3, 32, struct.pack("<3f", 0, 0.5, -0.5), 16000)), ("odd", wav(2, 4, b"x"))]
    df = R.wav_chunks(spark.createDataFrame(files, "path string, content binary"))
    got = {r.path: [round(x, 6) for x in r.samples] for r in df.collect()}
    assert got == dict.fromkeys(("u8", "i16", "i24", "i32", "f32"), [0.0, 0.5, -0.5])
    assert R.disagreeing(df.withColumn("k", F.lit(1)), "k").first().rates == [8000, 16000] and R.disagreeing(df, "path").count() == 0


def test_absolute_numbers_between_dots(spark):
    names = ["Show.Name.53.v2.1080p.WEB.mkv", "Show.Name.53.mkv", "Show.Name.7.1080p.mkv", "Show.Name.S02.101.720p.mkv"]
    df = spark.createDataFrame([(n,) for n in names], "n string").select(T.episode_of(F.col("n"), F.lit(""), F.lit("Item")).alias("e"))
    assert [(r.e.show, r.e.season, r.e.episode) for r in df.collect()] == [("Show Name", 1, 53), (None, None, None), (None, None, None), ("Show Name", 2, 101)]


def test_folders_of_one_title(spark):
    rows = [("tv", "rick and morty", 3), ("tv", "Rick and Morty", 2), ("tv", "Fallout", 9), ("tv", "Fallout (2024)", 1), ("tv", "STAR ANDOR", 1), ("tv", "ANDOR", 5), ("tv", "Andor", 1), ("music", "a/x", 1), ("music", "A/x", 1)]
    files = [(d, f, f"r{i}", f"{f}/r{i}") for d, f, n in rows for i in range(n)]
    df = spark.createDataFrame(files, "dest string, folder string, rest string, path string")
    aliases = spark.createDataFrame([("star andor", "andor")], "variant string, title string")
    got = {r.folder: r.canon for r in L.canonical_folders(df, aliases).collect()}
    assert got == {"rick and morty": "rick and morty", "Rick and Morty": "rick and morty", "Fallout": "Fallout (2024)", "Fallout (2024)": "Fallout (2024)", "STAR ANDOR": "Andor", "ANDOR": "Andor", "Andor": "Andor"}
    merged = L.merged_folders(df, aliases)
    assert merged.count() == len(files) and {r.folder for r in merged.filter("dest = 'tv'").select("folder").distinct().collect()} == {"rick and morty", "Fallout (2024)", "Andor"}
