import io
import struct
import wave

from pyspark.sql import functions as F

from cinelode.sources import readers as R


def lines(spark, text):
    return R.lines_of(spark.createDataFrame([("f", text)], "file string, text string"), "file", "text")


def test_line_formats(spark):
    env = R.env_pairs(lines(spark, "# c\n\nA = 1=2\nnope\nB="))
    assert [(r.key, r.value) for r in env.orderBy("n").collect()] == [("A", "1=2"), ("B", "")]
    watch = R.watchlist(lines(spark, "# x\nShow | q S{season:02d}E{ep:02d} | y\nBare"))
    assert [(r.folder, r.template) for r in watch.orderBy("n").collect()] == [("Show", "q S{season:02d}E{ep:02d} | y"), ("Bare", "")]
    assert [r.album for r in R.queue_rows(lines(spark, "a\t1\t2\tt\tu\nbroken\tx")).collect()] == ["a"]
    ans = R.answers(lines(spark, "17 OZU\n23 - skip # none\n\n17 MARA sign"))
    assert {(r.id, r.role, r.kind) for r in ans.collect()} == {("17", "MARA", "sign"), ("23", "", "skip")}


def test_read_lines_from_files(spark, tmp_path):
    (tmp_path / "a.txt").write_text("one\r\ntwo\n")
    got = R.read_lines(spark, str(tmp_path)).orderBy("n").collect()
    assert [r.line for r in got] == ["one", "two", ""]


def test_ass_and_srt(spark):
    ass = "Format: x\nDialogue: 0,0:00:01.50,0:00:02.00,Default,bear,0,0,0,,Hi, you\nDialogue: broken"
    got = R.ass_events(lines(spark, ass), "file").collect()
    assert [(r.st, r.en, r.actor, r.text) for r in got] == [(1500, 2000, "BEAR", "Hi, you")]
    srt = "1\r\n00:00:01,000 --> 00:00:02,500\r\nHello\r\nthere\r\n\r\n2\r\n00:00:03,000 --> 00:00:04,000\r\n"
    df = spark.createDataFrame([("f", srt), ("g", None), ("h", "")], "file string, text string")
    assert [(r.st, r.en, r.text) for r in R.srt_events(df, "file", "text").orderBy("n").collect()] == [(1000, 2500, "Hello there"), (3000, 4000, "")]


def test_cue(spark):
    sheet = 'REM DATE 1999\nPERFORMER "P"\nTITLE "Album"\nFILE "a b.wav" WAVE\n TRACK 01 AUDIO\n  TITLE "One"\n  INDEX 00 00:00:00\n  INDEX 01 00:02:00\n TRACK 02 AUDIO\n  TITLE "Two"\n  PERFORMER "Q"\n  INDEX 01 01:00:15\n TRACK 03 AUDIO\n  TITLE "No start"'
    got = R.track_spans(R.cue_tracks(lines(spark, sheet), "file"), "file").orderBy("num").collect()
    assert [(r.num, r.title, r.performer, round(r.start, 3)) for r in got] == [(1, "One", None, 2.0), (2, "Two", "Q", 60.2)]
    assert (got[0].album_title, got[0].album_performer, got[0].date, got[0].file_name) == ("Album", "P", 1999, "a b.wav")
    assert round(got[0].duration, 3) == 58.2 and got[1].duration is None


def test_charsets_and_forms(spark):
    rows = [("é".encode(),), ("﻿a".encode(),), ("Ёж".encode("cp1251"),), (None,)]
    got = [r[0] for r in spark.createDataFrame(rows, "b binary").select(R.any_charset("b")).collect()]
    assert got == ["é", "a", "Ёж", None]
    assert spark.createDataFrame([("ＡＢ①",)], "s string").select(R.compatible("s")).first()[0] == "AB1"


def test_wav(spark):
    b = io.BytesIO()
    w = wave.open(b, "wb")
    w.setnchannels(2)
    w.setsampwidth(2)
    w.setframerate(8000)
    w.writeframes(struct.pack("<8h", 0, 16384, 16384, 16384, -16384, 0, 0, 0))
    w.close()
    df = spark.createDataFrame([("x", b.getvalue()), ("y", b"junk"), ("z", None)], "path string, content binary")
    got = R.wav_chunks(df, 3).orderBy("chunk").collect()
    assert [(r.rate, r.channels, r.samples) for r in got] == [(8000, 2, [0.25, 0.5, -0.25]), (8000, 2, [0.0])]


def test_links_and_images(spark):
    df = spark.createDataFrame([("https://h/p?a=1&apikey=k&b=2",), ("magnet:?x",), (None,)], "u string")
    assert [r[0] for r in df.select(R.packed_url(F.col("u"))).collect()] == ["/p?a=1&b=2", "magnet:?x", ""]
    img = spark.createDataFrame([(b"\xff\xd8\xff\xe0",), (b"\x89PNG",), (b"text",)], "c binary")
    assert [r[0] for r in img.select(R.image_kind(F.col("c"))).collect()] == ["jpeg", "png", None]


def test_json_listing(spark, tmp_path):
    (tmp_path / "i.json").write_text('[{"kind":"torrents","id":1,"name":"A","files":[{"id":5,"name":"a/b.mkv","size":7}]},{"id":2}]')
    from cinelode.operators.library import unnested

    got = unnested(R.json_table(spark, str(tmp_path / "i.json"), R.ITEMS)).select("id", "file_ord", "file.name").orderBy("id").collect()
    assert [tuple(r) for r in got] == [(1, 0, "a/b.mkv"), (2, None, None)]
