"""Properties and brute force of the ordered operators."""

import random

import numpy as np
from pyspark.sql import functions as F

from cinelode.operators import align, frames, ordered, rank, reconcile, render, script
from cinelode.plans.search import greedy_suffixes

LINE = "id bigint, episode_id bigint, st bigint, en bigint, speaker string, text string, style string, is_group boolean"


def lines(spark, n=120, seed=3):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        s = rng.randrange(0, 60_000)
        rows.append((i, i % 3, s, s + rng.choice([0, 200, 900, 4000]), rng.choice(["A", "B", "C", None]), rng.choice(["Hello there", "and so on.", "Go!", "x"]), "Default", rng.random() < 0.1))
    return spark.createDataFrame(rows, LINE), rows


def test_collisions(spark):
    df, rows = lines(spark)
    got = {r.id for r in script.colliding(df, bin_ms=700).collect()}
    want = {a[0] for a in rows for b in rows if a[1] == b[1] and a[2] < b[3] and b[2] < a[3] and a[4] and b[4] and a[4] != b[4]}
    assert got == want


def test_room(spark):
    df, rows = lines(spark, 60)
    got = {r.id: r.slack_ms for r in script.with_room(df).collect()}
    for i, e, s, t, *_ in rows:
        later = [b[2] for b in rows if b[1] == e and (b[2], b[0]) > (s, i) and b[2] >= t]
        assert got[i] == (min(later) - t if later else 5000)


def test_every_case_member_overlaps_another(spark):
    df, rows = lines(spark)
    by = {r[0]: r for r in rows}
    cases = {}
    for r in script.overlap_cases(df).collect():
        cases.setdefault((r.episode_id, r.overdub), []).append(by[r.id])
    assert cases
    for g in cases.values():
        for a in g:
            # The earlier one (by start, id) still sounds when the later one begins; a line of no length may lie within another.
            pairs = [sorted([a, b], key=lambda r: (r[2], r[0])) for b in g if a is not b and a[4] != b[4]]
            assert any(x[3] > y[2] for x, y in pairs)


def test_merge_keeps_all_words(spark):
    df, _ = lines(spark)
    a = script.attributed(df)
    m = script.merged(a)
    count = lambda d, c: d.select(F.sum(F.size(F.split(c, " ")))).first()[0]
    assert count(a, "text") == count(m, "text")
    assert m.agg(F.sum("events")).first()[0] == a.count()


def test_empty_tables(spark):
    none = spark.createDataFrame([], LINE)
    for f in (script.attributed, script.with_room, script.scene_table, script.overlap_cases, script.colliding):
        assert f(none).count() == 0
    assert script.merged(script.attributed(none)).count() == 0


def test_first_wins_is_idempotent(spark):
    df = spark.createDataFrame([("a", 2, 1), ("a", 1, 5), ("a", 1, 3), ("b", None, 9), (None, 1, 1)], "k string, o int, id int")
    once = rank.extreme(df, ["k"], [("o", False), ("id", False)], ["o", "id"])
    assert sorted(map(tuple, once.collect()), key=str) == [("a", 1, 3), ("b", None, 9), (None, 1, 1)]
    assert sorted(map(tuple, rank.extreme(once, ["k"], [("o", False), ("id", False)], ["o", "id"]).collect()), key=str) == sorted(map(tuple, once.collect()), key=str)


def test_reconcile_of_equal_sets_changes_nothing(spark):
    w = spark.createDataFrame([("a", 1), ("b", None), (None, 3)], "p string, v int")
    assert {(r.p, r.action) for r in reconcile.actions(w, w, "p", "v").collect()} == {("a", "unchanged"), ("b", "unchanged")}


def test_prune_gate(spark):
    plan = spark.createDataFrame([(str(i), "stale" if i < 10 else "unchanged") for i in range(30)], "p string, action string")
    assert reconcile.prune_gate(plan).first()["block"] == "would delete 10/30 files"
    assert reconcile.prune_gate(plan.filter("action <> 'stale'")).first()["block"] is None
    assert reconcile.prune_gate(plan, F.lit("usenet failed to list")).first()["block"] == "usenet failed to list"


def test_correlation_recovers_a_shift():
    rng = np.random.default_rng(0)
    a = np.repeat(rng.random(400) < 0.4, 5).astype(float)
    b = np.r_[np.zeros(74), a][: len(a)]
    shift, peak, margin = align.correlate(a, b, 200)
    assert shift == 74 and peak > 0.99 and margin > 0.05
    # Brute force over all shifts.
    best = max(range(-200, 201), key=lambda s: np.corrcoef(a[max(0, -s) : len(a) - max(0, s)], b[max(0, s) : len(b) - max(0, -s)])[0, 1])
    assert best == shift


def test_anchor_offset_recovers_a_shift(spark):
    rows = [(1, i * 3000, f"this is spoken line number {i} of the script") for i in range(12)]
    a = spark.createDataFrame(rows, "episode_id bigint, st bigint, text string")
    f = align.fits(align.anchors(a, a.withColumn("st", F.col("st") - 3720))).first()
    assert (f["middle"], f["scatter"], round(f["slope"], 9)) == (-3.72, 0.0, 0.0)


def test_greedy_suffixes(spark):
    rows = [(1, 1, 11, "theatregaronne"), (1, 2, 12, "newquartettheatregaronne"), (1, 3, 13, "other"), (1, 4, 14, "another"), (1, 5, 15, "other"), (1, 6, 16, None)]
    df = spark.createDataFrame(rows, "g int, rank int, id bigint, key string")
    assert {r.id for r in greedy_suffixes(df, "g", "key", ["rank"]).collect()} == {11, 13, 14}


def test_queue_and_duck(spark):
    rows = [(1, 0, 1, 1000, 0, 3000), (1, 1200, 2, 1000, 400, 900), (1, 90_000, 3, 1000, 0, 500)]
    df = spark.createDataFrame(rows, "episode_id bigint, st bigint, id bigint, window_ms bigint, slack_ms bigint, generated_ms bigint")
    got = {r.id: (r.head_ms, r.late_ms) for r in render.queued(df).collect()}
    assert got == {1: (0, 0), 2: (2342, 1142), 3: (90_000, 0)}


def test_frames(spark):
    c = spark.createDataFrame([(1, [0.0, 0.0, 3.0, 4.0, 1.0]), (2, [])], "k bigint, v array<float>")
    got = [(r.k, r.frame, round(r.rms, 4)) for r in frames.rms_frames(c, "k", "v", 2).orderBy("frame").collect()]
    assert got == [(1, 0, 0.0), (1, 1, 3.5355)]
    t = spark.createDataFrame([(1, i, x) for i, x in enumerate([True, False, False, True, False, True, True])], "k int, frame int, on boolean")
    b = frames.bridged(t, "k", "on", 1)
    assert [r.bridged for r in b.orderBy("frame").collect()] == [True, False, False, True, True, True, True]
    assert [tuple(r) for r in frames.runs(b, "k", "bridged", 2).collect()] == [(1, 3, 6)]


def test_running_values_over_buckets(spark):
    df, rows = lines(spark, 200)
    got = ordered.running(df, ["episode_id"], True, 5_000, who=("last", F.col("speaker")), top=("max", F.col("en")), n=("sum", F.lit(1)))
    before = ordered.running(df, ["episode_id"], False, 5_000, top=("max", F.col("en")), n=("sum", F.lit(1)))
    got, before = ({r.id: r for r in x.collect()} for x in (got, before))
    for e in range(3):
        who, top, n = None, None, 0
        for r in sorted((r for r in rows if r[1] == e), key=lambda r: (r[2], r[0])):
            assert (before[r[0]].top, before[r[0]].n) == (top, n)
            who, top, n = r[4] or who, max(r[3], top or 0), n + 1
            assert (got[r[0]].who, got[r[0]].top, got[r[0]].n) == (who, top, n)


def test_neighbours_over_blocks(spark):
    df, rows = lines(spark, 200)
    got = {r.id: (r.before, r.after) for r in ordered.neighbours(df, ["episode_id"], F.col("id"), 2, 2, block=7).collect()}
    for e in range(3):
        ids = [r[0] for r in sorted((r for r in rows if r[1] == e), key=lambda r: (r[2], r[0]))]
        for k, i in enumerate(ids):
            assert got[i] == (ids[max(k - 2, 0) : k], ids[k + 1 : k + 3])
    assert len(got) == 200


def test_components_against_brute_force():
    rng = np.random.default_rng(4)
    for _ in range(200):
        n = int(rng.integers(2, 30))
        st = np.sort(rng.integers(0, 60, n))
        en, who = st + rng.integers(0, 12, n), rng.integers(0, 3, n)
        want = list(range(n))
        for _ in range(n):
            for i in range(n):
                for j in range(i + 1, n):
                    if en[i] > st[j] and who[i] != who[j]:
                        want[i] = want[j] = min(want[i], want[j])
        assert script.together(st, en, who).tolist() == want


def test_merge_against_a_plain_fold(spark):
    df, _ = lines(spark, 300, seed=9)
    a = script.attributed(df)
    rows = sorted(a.collect(), key=lambda r: (r.episode_id, r.st, r.id))
    done = {}
    for r in rows:
        past = done.setdefault(r.episode_id, [])
        near = [u for u in past[-3:] if u["who"] == r.who][-1:]
        open_ = near and r.st - near[0]["en"] <= 600 and (r.continuation or near[0]["text"][-1:] not in ".!" and r.text[:1].islower())
        if open_:
            near[0].update(text=near[0]["text"] + " " + r.text, en=max(near[0]["en"], r.en), events=near[0]["events"] + 1)
        else:
            past.append({"id": r.id, "who": r.who, "text": r.text, "en": r.en, "events": 1})
    want = {(u["id"], u["text"], u["en"], u["events"]) for x in done.values() for u in x}
    assert {(r.first_id, r.text, r.en, r.events) for r in script.merged(a).collect()} == want and any(u[3] > 2 for u in want)


def test_pans_keep_conflicts_apart(spark):
    rows = [(1, 1, 0, 100, "A"), (2, 1, 50, 150, "B"), (3, 1, 120, 200, "C"), (4, 1, 140, 160, "A"), (5, 1, 300, 400, "D"), (6, 1, 0, 500, "E")]
    df = spark.createDataFrame([(*r, 0) for r in rows], "id bigint, episode_id bigint, st bigint, en bigint, speaker string, overdub int")
    got = {r.speaker: r.pan for r in script.conflict_pans(df).collect()}
    # E overlaps all four; A, B and C overlap each other; D only E.
    assert got == {"E": -0.6, "A": 0.6, "B": -0.35, "C": 0.35, "D": 0.6}
    assert script.conflict_pans(df.limit(0)).count() == 0


def test_an_episode_of_many_lines_is_spread(spark):
    """One episode holds all lines: no task of the merge, the queue or the repeats holds more than a part of them."""
    n = 60_000
    df = spark.range(n).selectExpr("id", "7L episode_id", "id * 4000 st", "id * 4000 + 2500 en", "concat('S', id % 3) speaker", "if(id % 2 = 0, 'and', 'So.') text", "'Default' style", "false is_group", "2500L window_ms", "1000L slack_ms", "2600L generated_ms")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        cut = ordered.islands(df, ["episode_id"], F.col("st") > F.col("reach") + 600)
        sizes = [r["n"] for r in cut.repartition("episode_id", "island").groupBy(F.spark_partition_id()).agg(F.count(F.lit(1)).alias("n")).collect()]
        assert max(sizes) < 0.6 * n
        assert script.merged(script.attributed(df)).count() == n and render.queued(df).count() == n and script.kept_apart(df, ["episode_id", "text"], 15_000).count() < n
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_medians(spark):
    rng = random.Random(2)
    rows = [(rng.choice(["hot", "hot", "hot", "b", None]), rng.choice([None, float("nan"), 1.0, 1.0, rng.random(), rng.gauss(0, 9)])) for _ in range(5000)] + [("one", 4.0), ("none", None)]
    df = spark.createDataFrame(rows, "k string, v double")
    want = {}
    for k in {r[0] for r in rows}:
        v = [x for g, x in rows if g == k and x is not None and x == x]
        if v:
            want[k] = (float(np.median(v)), len(v))
    got = {r.k: (r["median"], r.n) for r in rank.medians(df, ["k"], "v").collect()}
    assert got.keys() == want.keys() and all(abs(got[k][0] - want[k][0]) < 1e-12 and got[k][1] == want[k][1] for k in want)
    every = [x for _, x in rows if x is not None and x == x]
    assert rank.medians(df, [], "v").first()["median"] == float(np.median(every))
    assert rank.medians(df.limit(0), ["k"], "v").count() == 0 == rank.medians(df.limit(0), [], "v").count()


def test_correlated_and_decided(spark):
    rng = random.Random(1)
    rows, at = [], 0
    for i in range(80):
        at += rng.randrange(700, 6000)
        rows.append((1, i, at, at + rng.randrange(300, 2500), f"words {i}"))
    a = spark.createDataFrame(rows, "episode_id bigint, id bigint, st bigint, en bigint, text string")
    b = a.withColumns({"st": F.col("st") + 5000, "en": F.col("en") + 5000})
    c = align.correlated(a, b).first()
    assert abs(c.shift_ms - 5000) <= 50 and c.peak > 0.9 and c.margin > 0.05
    fit = "episode_id bigint, n bigint, middle double, slope double, cross double, span double, scatter double, residual double"
    fits = spark.createDataFrame([(1, 9, 2.0, 0.0, 2.0, 100.0, 0.1, 0.1), (2, 9, 30.0, 0.0427, 0.0, 1300.0, 9.0, 0.1), (3, 3, 9.0, 0.0, 9.0, 10.0, 0.0, 0.0), (4, 9, 1.0, 0.0, 1.0, 10.0, 5.0, 5.0)], fit)
    shifts = spark.createDataFrame([(1, 0, 0.1, 0.0), (3, -4750, 0.5, 0.2), (4, 100, 0.2, 0.2), (5, 200, 0.3, 0.06)], "episode_id bigint, shift_ms bigint, peak double, margin double")
    got = {r.episode_id: (r.how, r.offset, r.rate) for r in align.decided(fits, shifts).collect()}
    assert got[1] == ("text", 2.0, None) and got[2][:2] == ("rate", 30.0) and got[2][2] is not None
    assert got[3] == ("activity", -4.75, None) and got[4] == ("none", None, None) and got[5] == ("activity", 0.2, None)


def test_clean_frames_bands_and_curves(spark):
    f = spark.createDataFrame([(0.006, 0.0), (0.004, 0.0), (0.1, 0.02), (0.1, 0.009)], "v double, b double")
    assert [r[0] for r in f.select(frames.clean(F.col("v"), F.col("b"))).collect()] == [True, False, False, True]
    h = spark.createDataFrame([(0.0,), (119.9,), (120.0,), (999.0,), (1000.0,), (3400.0,), (8000.0,), (-1.0,)], "h double")
    assert [r[0] for r in h.select(frames.band(F.col("h"))).collect()] == ["sub", "sub", "low", "voice", "upper voice", "presence", "air", None]
    g = spark.createDataFrame([(1, 0, 0.2), (1, 1, 0.6), (1, 2, 0.4)], "k int, frame int, gain double")
    got = [r.gain for r in frames.interpolated(g, "k", 4).orderBy("sample").collect()]
    want = np.interp(np.arange(12), np.arange(3) * 4 + 2.0, [0.2, 0.6, 0.4], left=1.0, right=1.0)
    assert np.allclose(got, want)


def test_nudges(spark):
    cols = "kind string, role string, lift double, tuning_pitch double, tuning_pace double, tuning_gain double, shade_pitch double, shade_pace double, shade_gain double"
    rows = [("sign", "BEAR", None, 1.0, 1.1, 1.0, 5.0, 5.0, 5.0), ("speech", "Narrator", None, 1.0, 1.1, None, 5.0, 5.0, 5.0), ("speech", "BEAR", 0.5, 1.0, None, None, -0.5, 0.9, 1.2), ("speech", None, 0.5, None, None, None, 9.0, 9.0, 9.0)]
    got = [(round(r.pitch, 6), round(r.pace, 6), round(r.gain, 6)) for r in render.nudged(spark.createDataFrame(rows, cols)).collect()]
    assert got == [(0.7, 1.155, 0.9), (1.0, 1.1, 1.0), (1.5, 0.9, 1.2), (0.5, 1.0, 1.0)]


def test_auto_resolve_by_case(spark):
    cases = spark.createDataFrame([(1, 0, "A"), (1, 0, "B"), (1, 1, "A"), (1, 1, "C"), (1, 2, "D")], "episode_id bigint, overdub int, speaker string")
    pans = spark.createDataFrame([("A", 0.1), ("B", -0.15), ("C", 0.1), ("C", -0.2), ("D", None)], "speaker string, pan double")
    assert {(r.overdub, r.eligible) for r in render.auto_resolved(cases, pans).collect()} == {(0, True), (1, False), (2, True)}
