import numpy as np
import pandas as pd

from cinelode.llm import bpe, mixing

DOCS = "doc_id bigint, source string, text string, shard string"


def tables(spark, n=60):
    rows = [(i, ["big", "big", "big", "small"][i % 4], "word " * (5 + i % 7), "x") for i in range(n)]
    rows += [(900, "unlisted", "word " * 50, "x"), (901, "big", None, "x"), (902, "big", "", "x"), (903, None, "word", "x")]
    targets = [("big", 0.5, 1), ("small", 0.4, 3), ("absent", 0.1, 2)]
    return spark.createDataFrame(rows, DOCS), spark.createDataFrame(targets, "source string, target_share double, max_repeats int"), rows


def test_blocks_and_caps(spark):
    docs, targets, rows = tables(spark)
    m = mixing.mix(docs, targets, block=16).toPandas()
    size = {r[0]: len(bpe.encode_strings([r[2]])[0]) for r in rows}
    assert not m.duplicated(["shard", "slot"]).any() and not m.duplicated(["source", "block", "repeat"]).any()
    used = {}
    for _, r in m.iterrows():
        assert r["n_tokens"] == sum(x["to_token"] - x["from_token"] for x in r["docs"]) <= 16
        for x in r["docs"]:
            for t in range(x["from_token"], x["to_token"]):
                used[x["doc_id"], t] = used.get((x["doc_id"], t), 0) + 1
    caps = {"big": 1, "small": 3}
    of = {r[0]: r[1] for r in rows}
    assert all(n <= caps[of[d]] and t < size[d] for (d, t), n in used.items())
    # The source that repeats most is used evenly: each token as often as another, but for one.
    n = [v for (d, _), v in used.items() if of[d] == "small"]
    assert max(n) - min(n) <= 1


def test_report(spark):
    docs, targets, _ = tables(spark)
    r = {x.source: x for x in mixing.report(docs, targets, block=16).collect()}
    m = mixing.mix(docs, targets, block=16).toPandas()
    assert r["absent"].mixed_tokens == 0 and not r["absent"].met and abs(sum(x.actual_share for x in r.values()) - 1) < 1e-9
    for s, g in m.groupby("source"):
        assert r[s].mixed_tokens == g["n_tokens"].sum() and r[s].given == len(g) and r[s].most_repeats == g["repeat"].max() <= r[s].max_repeats


def test_empty(spark):
    docs, targets, _ = tables(spark)
    assert mixing.mix(docs.limit(0), targets).count() == 0 and mixing.mix(docs, targets.limit(0)).count() == 0
    assert mixing.report(docs.limit(0), targets).agg({"mixed_tokens": "sum"}).first()[0] == 0


def test_permutations():
    for n in (1, 2, 3, 17, 64, 1000):
        j = np.arange(n)
        a, b = (mixing.permuted(j, np.full(n, n), np.full(n, k)) for k in (1, 2))
        assert sorted(a) == sorted(b) == list(range(n))
        assert n < 10 or (a != b).any()


def test_draws_meet_the_totals():
    given = [100, 0, 37]
    rows = list(mixing.drawn(given, 16, 0, 99))
    assert [r[0] for r in rows] == list(range(9)) and [sum(c) for _, c, _ in rows] == [16] * 8 + [9]
    assert np.sum([c for _, c, _ in rows], axis=0).tolist() == given
    before = np.zeros(3, int)
    for _, c, b in rows:
        assert b == before.tolist()
        before += c
    # A task that draws only its own shards gets the same ones.
    assert [r for x in range(0, 9, 2) for r in mixing.drawn(given, 16, x, min(x + 2, 9))] == rows


def test_draws_of_totals_beyond_any_sampler():
    """A trillion blocks: any shard is reached in a few steps, sums are exact, shares are those of the totals."""
    given = [10**12, 3 * 10**11, 7, 0]
    n = mixing.shards_of(given, 1024)
    for low in (0, n // 3, n - 3):
        rows = list(mixing.drawn(given, 1024, low, low + 3))
        assert [r[0] for r in rows] == [low, low + 1, low + 2] and all(sum(c) == 1024 for _, c, _ in rows[:2])
        for (_, c, b), (_, _, after) in zip(rows, rows[1:], strict=False):
            assert [x + y for x, y in zip(b, c, strict=True)] == after
    last = rows[-1]
    assert [x + y for x, y in zip(last[1], last[2], strict=True)] == given
    counts = np.sum([c for _, c, _ in mixing.drawn(given, 1024, 10**6, 10**6 + 200)], axis=0)
    assert abs(counts[0] / counts.sum() - 10 / 13) < 0.01


def test_both_samplers_have_the_same_law(monkeypatch):
    draw = lambda: [mixing.hypergeometric(np.random.default_rng([1, i]), 6000, 4000, 2000) for i in range(4000)]
    exact = draw()
    monkeypatch.setattr(mixing, "EXACT_DRAW", 100)
    limit = draw()
    assert abs(np.mean(exact) - np.mean(limit)) < 2 and abs(np.std(exact) / np.std(limit) - 1) < 0.05
    assert all(mixing.hypergeometric(np.random.default_rng(i), 3, 200, 202) in (2, 3) for i in range(20))


def test_the_longest_mix_meets_all_that_can_be(spark):
    docs, targets, _ = tables(spark)
    r = {x.source: x for x in mixing.report(docs, targets, block=16).collect()}
    assert r["big"].met and r["small"].met and not r["absent"].met
    assert abs(r["big"].actual_share - 0.5 / 0.9) < 0.05 and abs(r["small"].actual_share - 0.4 / 0.9) < 0.05
    assert any(x.blocks * x.max_repeats - x.given <= 1 for x in r.values() if x.given), "none could be longer"
    long = {x.source: x for x in mixing.report(docs, targets, block=16, total_blocks=1000).collect()}
    assert not any(x.met for x in long.values()) and long["small"].given == 3 * long["small"].blocks


def test_plan():
    t = pd.DataFrame({"source": ["a", "b", "c", None], "target_share": [0.5, 0.3, 0.2, 0.1], "max_repeats": [1, 2, None, 1]})
    p = mixing.planned(t, {"a": 1000, "b": 100}, 10, 110).set_index("source")
    assert p.loc["a", "given"] == 55 and p.loc["b", "given"] == 20 and p.loc["c", "given"] == 0 and p["wanted"].sum() == 110
