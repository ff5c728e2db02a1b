import pytest
from pyspark.sql import functions as F

from cinelode.functions import score as S
from cinelode.functions import text as T


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(f(F.col("x")).alias("y")).first()["y"]


@pytest.mark.parametrize(
    "name, title",
    [
        ("[Group] My.Show.S01E02.1080p.WEB-DL", "My Show"),
        ("www.site.org - Some.Film.2019.1080p.BluRay", "Some Film (2019)"),
        ("Show Name (2020-2023) Season 1", "Show Name (2020)"),
        ("A%20B.720p", "A B"),
        ("100% Pure.720p", "100% Pure"),
        ("1080p", None),
        ("", None),
        (None, None),
        ("ムシリコ ラホ 1080p", "ムシリコ ラホ"),
    ],
)
def test_clean_show(spark, name, title):
    assert one(spark, name, T.clean_show) == title


@pytest.mark.parametrize(
    "name, want",
    [
        ("My.Show.S02E07.mkv", ("My Show", 2, 7, True, False)),
        ("My Show 3x08 Late.mkv", ("My Show", 3, 8, True, False)),
        ("01.02 - Late.mkv", ("Item", 1, 2, False, False)),
        ("[G] Show - 03 [1080p].mkv", ("Show", 2, 3, False, True)),
        ("Show OVA - 02.mkv", ("Show", 0, 2, False, False)),
        ("Some Film.mkv", (None, None, None, False, False)),
    ],
)
def test_episode(spark, name, want):
    assert tuple(one(spark, name, lambda c: T.episode_of(c, F.lit("Season 2"), F.lit("Item")))) == want


@pytest.mark.parametrize(
    "name, want",
    [
        ("Artist Name - Album Title (1999) [FLAC]", ("Artist Name", "Album Title", 1999)),
        ("1996-Godspelized", (None, "Godspelized", 1996)),
        ("A B, C D, E F - Go See (2002) FLAC (tracks + cue)", ("A B", "Go See", 2002)),
        ("Band - 2001 - Thing - Part Two (2005)", ("Band", "Thing - Part Two", 2001)),
        ("", (None, None, None)),
    ],
)
def test_artist_album(spark, name, want):
    assert tuple(one(spark, name, T.artist_album)) == want


def test_small_ones(spark):
    assert one(spark, ' a<b>:"c"? . ', T.sanitize) == "abc "
    assert one(spark, "...", T.sanitize) == "untitled"
    assert one(spark, "01.02 - x", T.friendly_name) == "S01E02 - x"
    assert one(spark, "ムシ a_B!", T.word_key) == "ムシa_b"
    assert one(spark, r"{\i1}Daily\Nspecial (higawari).{\i0}", T.clean_speech) == "Daily special."
    assert one(spark, "BEAR / Cat and dog", T.group_members) == ["BEAR", "Cat", "dog"]
    assert one(spark, "everyone ", T.is_group) is True
    assert one(spark, None, T.is_group) is False
    assert one(spark, "01:02:15", T.cue_seconds) == pytest.approx(62.2)
    assert one(spark, "1:02:03,5", T.clock_ms) == 3_723_500
    assert one(spark, "x", T.clock_ms) is None
    assert one(spark, 3_723_456, lambda c: T.clock(c, ","), "bigint") == "01:02:03,456"
    assert one(spark, "??>>~~", T.url_safe_base64) == "Pz8-Pn5-"


def test_scores(spark):
    assert one(spark, "Show.1080p.BluRay.HDR.mkv", S.quality) == 315
    assert one(spark, "Show.2160p.REMUX.mkv", S.quality) == -1000
    assert one(spark, "Show.ITA.720p.mkv", S.quality) == 170
    assert one(spark, 1.0427, S.rate_name, "double") == "25/23.976"
    assert one(spark, 1.2, S.rate_name, "double") is None
