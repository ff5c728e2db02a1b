import random

import pytest

from cinelode.llm import canonical, medianames


def osa(a, b):
    d = [[i + j if not i * j else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i][j] = min(d[i - 1][j] + 1, d[i][j - 1] + 1, d[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i][j] = min(d[i][j], d[i - 2][j - 2] + 1)
    return d[-1][-1]


def test_the_automaton_finds_all_and_only_entries_within_distance():
    rng = random.Random(4)
    names = list({"".join(rng.choices("abc", k=rng.randrange(3, 9))) for _ in range(300)})
    r = canonical.Reference([(n, i) for i, n in enumerate(names)])
    joined = ["".join(w) for w, _ in r.entries]
    for _ in range(150):
        typed = "".join(rng.choices("abcd", k=rng.randrange(1, 10)))
        for k in (0, 1, 2, 3):
            want = {i: osa(typed, e) for i, e in enumerate(joined) if osa(typed, e) <= k}
            assert r.search(typed, k) == want


def test_distance_and_spread():
    rng = random.Random(6)
    for _ in range(500):
        a, b = ("".join(rng.choices("abc", k=rng.randrange(0, 8))) for _ in range(2))
        assert canonical.distance(a, b, 9) == osa(a, b)
        assert min(canonical.distance(a, b, 2), 3) == min(osa(a, b), 3)
        if b:
            assert sum(canonical.spread(a, (b,))) == osa(a, b)


SHOWS = [("Hollow Cartographer", 1), ("Hollow Cartographer After School", 2), ("The Secret Orchard", 3), ("Mata Zuwa", 3), ("ムシリコ・ラホ", 4), ("Restless Blizzard & Daughter", 5), ("Painted Telescope", 6), ("Salted Shipyard", 7)]


@pytest.mark.parametrize(
    "typed, show",
    [
        ("Hollow.Cartographer", 1),
        ("Hllow Cartographer", 1),
        ("Hollow Cartographer - After School", 2),
        ("hollowcartographerafterschool", 2),
        ("Hollow Cartographer Before Noon", 0),
        ("Secret Orchard, The", 3),
        ("Th3 S3cret Orch4rd", 3),
        ("Zuwa, Mata", 3),
        ("Sеcrеt Orchаrd", 3),
        ("Sécret Örchard", 3),
        ("ムシリコ ラホ", 4),
        ("Restless_Blizzard_and_Daughter", 5),
        ("RestlessBlizzard&Daughter", 5),
        ("Salted Telescope", 0),
        ("Secret Telescope", 0),
        ("Something Else", 0),
    ],
)
def test_titles(typed, show):
    assert canonical.Reference(SHOWS).nearest(typed)[0] == show


@pytest.mark.parametrize(
    "path, want",
    [
        ("[Kumo] Show Name - 03v2 [1080p].mkv", ("episode", "video", None, 3)),
        ("Season 02/E12 Late.srt", ("episode", "subtitle", 2, 12)),
        ("S1/Show, Episode Nine.avi", ("episode", "video", 1, 9)),
        ("Show 2nd Season - 02 - x.mkv", ("episode", "video", 2, 2)),
        ("Show 第12話.mp4", ("episode", "video", None, 12)),
        ("Show.OVA.01.1080p.avi", ("episode", "video", 0, 1)),
        ("Show [720p]/02.05 - Late (1).mkv", ("episode", "video", 2, 5)),
        ("X_s001e004_The_Late copy.mkv", ("episode", "video", 1, 4)),
        ("Sample/Show.S01E01.sample.mkv", ("sample", "video", None, None)),
        ("Band - Album (2001)/CD2/03. x.flac", ("track", "audio", 2, 3)),
        ("Film (2001)/Extras/Making_Of.mkv", ("extra", "video", None, None)),
        ("Film The Movie 2001 [720p].mkv", ("film", "video", None, None)),
        ("", ("", "", None, None)),
        (None, ("", "", None, None)),
    ],
)
def test_paths(path, want):
    assert medianames.parse(path)[:4] == want


def test_table(spark):
    files = spark.createDataFrame([(1, "The Secret Orchard OST/01 x.flac", "e"), (1, "The Secret Orchard OST/01 x.flac", "e"), (2, None, ""), (3, "Nobody S01E01.mkv", ""), (4, "x" * 50_000, "")], "id bigint, name string, show_id string")
    seasons = spark.createDataFrame([(3, "The Secret Orchard", ["Zuwa Mata"]), (4, None, None), (None, "Ghost", [])], "show_id int, show string, aliases array<string>")
    assert {(r.id, r.show_id) for r in canonical.match(files, seasons).collect()} == {(1, 3), (2, 0), (3, 0), (4, 0)}
    assert canonical.match(files.limit(0), seasons).count() == 0
    assert {r.show_id for r in canonical.match(files, seasons.limit(0)).collect()} == {0}


def test_folders_are_asked_where_the_own_title_is_out_of_reach(spark):
    rows = [(1, "The Secret Orchard/Scrt Orkhrdxq S01E02.mkv"), (2, "The Secret Orchard/Season 1/Qqqqq Wwwww S01E03.mkv"), (3, "The Secret Orchard/Walker Tales B S01E01.mkv"), (4, "Nothing Listed/Qqqqq Wwwww S01E03.mkv")]
    seasons = spark.createDataFrame([(3, "The Secret Orchard", None), (4, "Walker Tales A", None), (5, "Walker Tales C", None)], "show_id int, show string, aliases array<string>")
    got = {r.id: r.show_id for r in canonical.match(spark.createDataFrame(rows, "id bigint, name string"), seasons).collect()}
    assert got == {1: 3, 2: 3, 3: 0, 4: 0}  # 3 is as near to one show as to another: not asked further


def test_another_word_that_is_not_on_the_list():
    assert canonical.Reference([s for s in SHOWS if s[1] != 7]).nearest("Salted Telescope")[0] == 0
    assert canonical.Reference(SHOWS).nearest("Paaindte Telescope")[0] == 6


def test_the_count_filter_loses_no_entry():
    rng = random.Random(9)
    names = list({"".join(rng.choices("abcd", k=rng.randrange(4, 26))) for _ in range(400)})
    r = canonical.Reference([(n, i) for i, n in enumerate(names)])
    joined = ["".join(w) for w, _ in r.entries]
    for _ in range(150):
        typed = list(rng.choice(joined))
        for _ in range(rng.randrange(0, 5)):
            i = rng.randrange(len(typed))
            typed[i : i + 2] = rng.choice([typed[i : i + 2][::-1], ["a", *typed[i : i + 2]], typed[i + 1 : i + 2], ["b", *typed[i + 1 : i + 2]]])
        typed = "".join(typed) or "a"
        k = canonical.allowed(len(typed))
        assert r.search(typed, k) == {i: e for i, x in enumerate(joined) if (e := osa(typed, x)) <= k}


def test_all_entries_within_reach_and_the_unmatched(spark):
    rows = [(1, "Walker Tales B S01E01.mkv"), (2, "Walker Tales B S01E02.mkv"), (2, "Walker Tales B S01E02.mkv"), (3, "Quite Other S01E02.mkv"), (4, None), (5, "Salted Telescope S01E01.mkv")]
    seasons = spark.createDataFrame([(4, "Walker Tales A", None), (5, "Walker Tales C", None), (6, "Painted Telescope", ["Telescope"])], "show_id int, show string, aliases array<string>")
    got = {(r.title, r.files, r.show_id, r.errors, r.plausible) for r in canonical.within_reach(spark.createDataFrame(rows, "id bigint, name string"), seasons).collect()}
    assert got == {("Walker Tales B", 2, 4, 1, True), ("Walker Tales B", 2, 5, 1, True), ("Quite Other", 1, None, None, None), ("Salted Telescope", 1, 6, 3, False)}
    assert canonical.within_reach(spark.createDataFrame(rows, "id bigint, name string").limit(0), seasons).count() == 0
