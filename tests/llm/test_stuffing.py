import pytest

from cinelode.llm import stuffing as S

PROSE = "After six tries, her understudy questioned the regional room tone in one evening. It rained in Ninagawa Bay, so his agent praised the dialogue list instead. "
CASES = [
    "best download / cheap mirror / Show best download / best download / cheap mirror / BEST DOWNLOAD / cheap mirror / Show Cheap Mirror / best download",
    "Our best download is the only best download you need. Try best download or best download, the real best download. No best download? Then get best download from our best download page.",
    "\n".join(f"Show ep{i} - https://www.link{i}.example.com/d/{i}abc" for i in range(8)),
    "\n".join(f"Show ep{i}\nhxxp://link{i} dot example/ep{i}" for i in range(8)),
    " ".join(f'<a href="https://x{i}.example/ep{i}">Show {i}</a>' for i in range(8)),
    "[Show 1](http://a.example/1)\n[Show 2](http://b.example/2)\n[Show 3](c.example/3)",
    "#hoodie #mug #bestdownload #hoodie #poster #mug #hoodie #bestdownload #mug #artbook",
    "\n".join(f"mug black {i}.99" for i in range(10)),
    "SKU-90971 figure stand SKU-30388 XLR cable SKU-76100 box set SKU-84637 XLR cable SKU-83359 boom arm",
    "\n".join(f"Show episode {i} watch online free" for i in range(1, 9)),
    PROSE + "\n" + "mug (best deals)\nhoodie (best deals)\nmug (free online)\nhoodie (free online)\n" * 8,
    "смотреть онлайн, все серии, смотреть онлайн, все серии, Show все серии, смотреть онлайн, все серии, смотреть онлайн",
]
HONEST = [
    PROSE * 3,
    PROSE * 3 + "\nSources: https://a.example/1 https://b.example/2\n#dub #booth",
    "Band - Album (1999)\nRipped from the disc, log checked.\n" + "\n".join(f"{i:02d}. Cinder Halcyon  {i}:4{i}" for i in range(1, 9)),
    "Cast of Some Show\n" + "\n".join(f"{a} - {b}" for a, b in zip("Otter Heron Pirate Captain Walrus Lynx Magpie".split(), "Nerys Ilvo Maret Celio Pimka Thandri Yevka".split(), strict=True)),
    "\n\n".join(f"{i}\n00:00:0{i},000 --> 00:00:0{i},900\nMind the step." for i in range(1, 9)),
    "\n".join(f"Dialogue: 0,0:00:0{i}.00,0:00:0{i}.90,Default,Otter,0,0,0,,Wait. Wait!" for i in range(1, 9)),
    "\n".join(f"1{i}:12 WARN booth gain -{i}.9 dB, the pauses skipped" for i in range(8)),
    "\n".join(f"- https://link{i}.example/d/{i}: {PROSE}" for i in range(4)),
    "Otter: Go! Go! Go!\nWalrus: Wait. Wait!\nHeron: Row, row, and row.\nPirate: No, no, no.\nLynx: Mind the step, please.",
    "lol https://a.example/1",
    "合唱と合唱を比べると、少し小さいほうを選びます。雨の中、市場の音が録り直されました。長い沈黙だけ昨日音が違います。",
    "Glossary\nretake: recording a line again because the first one was late.\nlip flap: the moment in which a mouth moves without sound.\nwalla: the murmur of a crowd that says nothing.",
]


TOPS = ("com", "example")


def share(text):
    """By the first look."""
    j = S.judged(text, TOPS)
    return sum(c for k, _, c in j if k in S.BAD) / max(sum(c for *_, c in j), 1)


@pytest.mark.parametrize("text", CASES)
def test_cases(text):
    assert share(text) >= S.SHARE


@pytest.mark.parametrize("text", HONEST[:9] + HONEST[10:])
def test_honest(text):
    assert share(text) < S.SHARE


def test_table(spark):
    texts = [*CASES, *HONEST, None, "", "  \n ", "x" * 200_000, "Wait here. " * 20_000]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id bigint, text string, shapes string")
    assert sorted(r.doc_id for r in S.flagged(df).collect()) == list(range(len(CASES)))
    assert S.shapes(df).count() == len(texts)
    assert S.flagged(df.limit(0)).count() == 0


def test_shapes_are_coarse():
    a, b = (S.judged(x, TOPS)[0] for x in ("Show ep3 - a.example/3", "Other ep9 - b.example/7"))
    assert a[:2] == b[:2]
    assert S.judged("x" * 9, TOPS)[0][1] != S.judged("X" * 9, TOPS)[0][1]


def test_one_repeated_word_is_no_keyword_page():
    assert share("a. " * 20_000) < S.SHARE


def test_top_names_come_from_the_corpus(spark):
    """A bare host is a link if its last label is known from full addresses, whatever country it is of."""
    pages = [f"See https://site{i}.de/page{i} and www.x{i}.de for more of it, please." for i in range(5)]
    bare = "\n".join(f"site{i}.de/list/{i}" for i in range(9))
    df = spark.createDataFrame(list(enumerate([*pages, bare])), "doc_id bigint, text string")
    assert S.top_names(df) == ("de",)
    assert [r.doc_id for r in S.flagged(df).collect()] == [5]
    assert S.judged("site1.de/list/1", ("de",))[0][0] == "link" != S.judged("site1.qq/list/1", ("de",))[0][0]
    assert S.top_names(df.limit(0)) == ()


def test_what_a_shape_stands_for_is_learnt(spark):
    """The same bare lines are non-sentences where the corpus has them on pages of links, and honest where it has them among sentences."""
    titles = "\n".join(f"Quiet Harbor {i}a" for i in range(12))
    links = "\n".join(f"https://x{i}.example/{i}" for i in range(14))
    odd = [(100, titles + "\n" + "\n".join(f"https://y{i}.example/{i}" for i in range(4)))]
    among_links = [(i, titles + "\n\n" + links) for i in range(30)]
    among_words = [(i, titles + "\n\n" + PROSE * 4) for i in range(30)]
    flagged = lambda rows: {r.doc_id for r in S.flagged(spark.createDataFrame(rows + odd, "doc_id bigint, text string")).collect()}
    assert 100 in flagged(among_links) and 100 not in flagged(among_words)


def test_few_shapes(spark, monkeypatch):
    df = spark.createDataFrame([(1, CASES[3])], "doc_id bigint, text string")
    assert S.scored(df).first().main_shapes <= 2 and S.flagged(df).count() == 1
    monkeypatch.setattr(S, "FEW", 0)
    assert S.flagged(df).count() == 0


def test_no_length_is_cut_off():
    long = "x" * 3000
    assert [p.kind for p in S.pieces(f"[{long}](https://a.example/{long})", TOPS)] == ["link"]
    assert [p.text for p in S.pieces(f'<div class="{long}">We left.</div>', TOPS)] == ["We left."]
    assert len(S.judged("[" * 50_000 + "<a href=x>" * 5_000, TOPS)) > 0
