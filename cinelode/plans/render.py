"""Flow C, second half: room, budgets, shades, gains and the reports of a render."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cinelode.functions import patterns as P
from cinelode.functions import score as S
from cinelode.functions import text as T
from cinelode.operators import rank
from cinelode.operators import reconcile as R
from cinelode.operators import render as O
from cinelode.operators import script as C
from cinelode.plans import views as V
from cinelode.plans.base import query
from cinelode.plans.script import SPEECH, speech
from cinelode.plans.views import real, trimmed
from cinelode.sources.tables import table

REP = f"WITH {V.REPORTS}"
#: Reports carry no episode; 340 lines in a row stand for one, as that is an episode's usual size.
LINES_PER_EPISODE = 340
WORDS = f"CASE WHEN {trimmed('coalesce(text, ' + chr(39) * 2 + ')')} = '' THEN 0 ELSE len(regexp_split_to_array({trimmed('text')}, '\\s+')) END"


@query(f"{REP}, q AS (SELECT id // {LINES_PER_EPISODE} AS episode, count(*) AS n_lines, count(*) FILTER (WHERE compression > {P.SQUEEZED}) AS squeezed, count(*) FILTER (WHERE overflow > {P.OVERRUN} AND available > 0) AS overruns, coalesce(max(overflow) FILTER (WHERE overflow > {P.OVERRUN} AND available > 0), 0.0) AS worst FROM reports GROUP BY 1) SELECT *, round(squeezed / n_lines, 6) AS squeezed_share, round(overruns / n_lines, 6) AS overrun_rate FROM q")
def a06_quality(spark: SparkSession, d: str) -> DataFrame:
    r = V.reports(spark, d).withColumn("episode", F.expr(f"id div {LINES_PER_EPISODE}"))
    return O.quality(r, "episode")


@query(f"{REP}, k AS (SELECT 'worst' AS kind, id, overflow AS measure FROM reports WHERE overflow > {P.OVERRUN} AND available > 0 UNION ALL SELECT 'tightest', id, compression FROM reports WHERE compression > {P.SQUEEZED} UNION ALL SELECT 'clean', id, held FROM reports WHERE compression <= {P.SQUEEZED} AND overflow <= 0.05 AND available > 1.5 AND held > 1.5) SELECT kind, CAST(place AS INTEGER) AS place, id, measure FROM (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY measure DESC, id) AS place FROM k) WHERE place <= 5")
def p17_t07_t09_top_lines(spark: SparkSession, d: str) -> DataFrame:
    """Worst, tightest and cleanest lines."""
    return O.top_lines(V.reports(spark, d))


@query(f"{REP} SELECT count(*) AS placed, count(*) FILTER (WHERE compression > {P.SQUEEZED}) AS compressed, count(*) FILTER (WHERE overflow > {P.OVERRUN}) AS overrunning, count(*) FILTER (WHERE late > 0.25) AS waited, round(max(late), 6) AS latest, round(20 * log10(max(gain) / min(gain)), 6) AS spread_db FROM reports WHERE gain > 0")
def a25_summary(spark: SparkSession, d: str) -> DataFrame:
    return V.reports(spark, d).filter("gain > 0").agg(
        F.count(F.lit(1)).alias("placed"), F.count_if(F.col("compression") > P.SQUEEZED).alias("compressed"), F.count_if(F.col("overflow") > P.OVERRUN).alias("overrunning"), F.count_if(F.col("late") > 0.25).alias("waited"), F.round(F.max("late"), 6).alias("latest"), F.round(20 * F.log10(F.max("gain") / F.min("gain")), 6).alias("spread_db")
    )


# The two tables are of different episodes; ids that both have stand for lines of one here.
RATE = f"{SPEECH}, {V.REPORTS}, w AS (SELECT s.id, {WORDS} AS n_words, r.generated FROM speech s JOIN reports r ON r.id = s.id), rate AS (SELECT coalesce(median(n_words / generated), 2.3) AS rate, count(*) AS sampled FROM w WHERE n_words >= 3 AND generated > 0.5)"


def _rate(spark: SparkSession, d: str) -> DataFrame:
    s = speech(spark, d).select("id", T.word_count(F.col("text")).alias("n_words"))
    w = s.join(V.reports(spark, d).select("id", "generated"), "id").filter("n_words >= 3 and generated > 0.5")
    mid = rank.medians(w.withColumn("rate", F.col("n_words") / F.col("generated")), [], "rate")
    # No line at all leaves no row, and the usual rate.
    return mid.agg(F.coalesce(F.max("median"), F.lit(2.3)).alias("rate"), F.coalesce(F.max("n"), F.lit(0)).alias("sampled"))


@query(f"{RATE} SELECT round(rate, 6) AS rate, sampled FROM rate")
def a07_j01_speaking_rate(spark: SparkSession, d: str) -> DataFrame:
    """Median words a second over the lines that a report has."""
    return _rate(spark, d).withColumn("rate", F.round("rate", 6))


ROOM = f"{SPEECH}, room AS (SELECT *, window_ms / 1000.0 + greatest(0.0, slack_ms / 1000.0 - {P.BREATH}) AS room FROM (SELECT a.*, a.en - a.st AS window_ms, coalesce((SELECT min(b.st) FROM speech b WHERE b.episode_id = a.episode_id AND b.st >= a.en AND (b.st, b.id) > (a.st, a.id)) - a.en, {P.LAST_SLACK_MS}) AS slack_ms FROM speech a))"


@query(f"{ROOM}, w AS (SELECT *, {WORDS} AS n_words FROM room) SELECT id, CAST(n_words AS INTEGER) AS n_words, round(room, 6) AS room, CAST(greatest(2, trunc(round(room * 2.3 * 1.15, 9))) AS INTEGER) AS budget FROM w WHERE NOT is_group AND room > 0.2 AND n_words / room > 2.3 * 1.35")
def p16_m12_w14_undeliverable(spark: SparkSession, d: str) -> DataFrame:
    """Lines that can't be said in their room, with the words they may have."""
    w = C.with_room(speech(spark, d)).withColumns({"n_words": T.word_count(F.col("text")), "room": S.room(F.col("window_ms") / 1000, F.col("slack_ms") / 1000)})
    late = w.filter(~F.col("is_group") & (F.col("room") > 0.2)).filter(F.try_divide("n_words", "room") > 2.3 * P.MAX_FACTOR)
    return late.select("id", "n_words", F.round("room", 6).alias("room"), F.greatest(F.lit(2), F.round(F.col("room") * 2.3 * 1.15, 9).cast("int")).alias("budget"))


W11 = f"""{ROOM.replace('WITH ', 'WITH RECURSIVE ', 1)}, o AS (SELECT episode_id, row_number() OVER (PARTITION BY episode_id ORDER BY st, id) AS n, id, st, window_ms, slack_ms, window_ms * 11 // 10 AS made FROM room),
q AS (
  SELECT episode_id, CAST(0 AS BIGINT) AS n, CAST(-1 AS BIGINT) AS cur, CAST(NULL AS BIGINT) AS id, CAST(0 AS BIGINT) AS late_ms, CAST(0 AS BIGINT) AS available_ms, CAST(1 AS DOUBLE) AS factor FROM o WHERE n = 1
  UNION ALL
  SELECT episode_id, n, CAST(st + late + floor(made / factor + 0.5) + 120 AS BIGINT), id, late, avail, factor FROM (
    SELECT *, CASE WHEN avail > 200 AND made > avail THEN least(made / avail, 1.35) ELSE 1.0 END AS factor FROM (
      SELECT *, greatest(0, window_ms - late + greatest(0, slack_ms - 150)) AS avail FROM (
        SELECT o.*, CASE WHEN o.st < q.cur AND q.cur - o.st <= 2500 THEN q.cur - o.st ELSE 0 END AS late FROM q JOIN o ON o.episode_id = q.episode_id AND o.n = q.n + 1))))
SELECT id, late_ms, available_ms, round(factor, 6) AS factor FROM q WHERE n > 0"""


@query(W11)
def w11_m11_queue(spark: SparkSession, d: str) -> DataFrame:
    """Lines read one after the other; what a voice makes of a line is taken as 1.1 times its window."""
    w = C.with_room(speech(spark, d)).withColumn("generated_ms", F.expr("window_ms * 11 div 10"))
    return O.queued(w).select("id", "late_ms", "available_ms", F.round("factor", 6).alias("factor"))


@query(f"{REP}, m AS (SELECT median(gain) AS mid FROM reports) SELECT id, round(CASE WHEN generated > 0 AND mid > 0 AND gain > 0 THEN least(greatest(gain, 0.4 * mid), 2.6 * mid) / generated ELSE 1.0 END, 6) AS raw_gain, round(least(greatest(gain, mid / 2.5), mid * 2.5), 6) AS held_gain, round(cos((least(greatest(pan, -1.0), 1.0) + 1) * pi() / 4), 6) AS left_gain, round(sin((least(greatest(pan, -1.0), 1.0) + 1) * pi() / 4), 6) AS right_gain FROM reports, m WHERE gain IS NOT NULL AND pan IS NOT NULL")
def m09_m10_a24_gains(spark: SparkSession, d: str) -> DataFrame:
    """Gains held around the scene's median, and equal-power pan; levels are read from gain and generated."""
    r = V.reports(spark, d).filter("gain is not null and pan is not null")
    mid = rank.medians(V.reports(spark, d), [], "gain").agg(F.max("median").alias("mid"))  # one row
    r = r.join(F.broadcast(mid))
    pan = S.pan_gains(F.col("pan"))
    raw = S.wanted_level(F.col("gain"), F.col("generated"), F.col("mid"))
    return r.select("id", F.round(F.coalesce(raw, F.lit(1.0)), 6).alias("raw_gain"), F.round(S.gain_spread(F.col("gain"), F.col("mid")), 6).alias("held_gain"), F.round(pan["left"], 6).alias("left_gain"), F.round(pan["right"], 6).alias("right_gain"))


@query(f"{REP} SELECT speaker, count(*) AS n_lines, round(median(gain), 6) AS habit, round(median(compression), 6) AS factor FROM reports WHERE speaker IS NOT NULL GROUP BY 1")
def a24_habits(spark: SparkSession, d: str) -> DataFrame:
    """Median gain and factor of each speaker."""
    r = V.reports(spark, d).filter("speaker is not null").select("speaker", "gain", "compression")
    n = r.groupBy("speaker").agg(F.count(F.lit(1)).alias("n_lines"))
    habit, factor = (rank.medians(r, ["speaker"], c).select("speaker", F.round("median", 6).alias(to)) for c, to in (("gain", "habit"), ("compression", "factor")))
    return n.join(habit, "speaker", "left").join(factor, "speaker", "left").select("speaker", "n_lines", "habit", "factor")


BANK = "bank0 AS (SELECT show_id, speaker, seconds, clips, CASE WHEN isnan(ratio) THEN NULL ELSE ratio END AS ratio, CASE WHEN isnan(pitch) THEN NULL ELSE pitch END AS pitch FROM bank)"


def bank(spark: SparkSession, d: str) -> DataFrame:
    b = table(spark, d, "bank", "show_id", "speaker", "seconds", "clips", "ratio", "pitch")
    return b.withColumns({"ratio": real(F.col("ratio")), "pitch": real(F.col("pitch"))})


@query(f"WITH {BANK} SELECT DISTINCT show_id, speaker, ratio FROM bank0 WHERE ratio IS NOT NULL ORDER BY ratio DESC, show_id, speaker LIMIT 90")
def t09_cleanest_clips(spark: SparkSession, d: str) -> DataFrame:
    """The 90 cleanest clips of the bank by ratio."""
    return O.cleanest(bank(spark, d).select("show_id", "speaker", "ratio").distinct())


DENSE = "v AS (SELECT show_id, CAST(round(12 * log2(pitch) * 1000000) AS BIGINT) AS tone, seconds FROM bank0 WHERE pitch > 0), h AS (SELECT a.show_id, a.tone, round(sum(b.seconds), 6) AS held, count(*) AS n_members FROM (SELECT DISTINCT show_id, tone FROM v) a JOIN v b ON a.show_id = b.show_id AND b.tone BETWEEN a.tone - 2000000 AND a.tone + 2000000 GROUP BY 1, 2), t AS (SELECT show_id, round(sum(seconds), 6) AS total FROM v GROUP BY 1)"


@query(f"WITH {BANK}, {DENSE} SELECT show_id, tone / 1000000 AS middle, held, round(held / total, 6) AS share, n_members FROM (SELECT *, row_number() OVER (PARTITION BY show_id ORDER BY held DESC, tone) AS r FROM h JOIN t USING (show_id)) WHERE r = 1")
def a11_a12_densest_pitch(spark: SparkSession, d: str) -> DataFrame:
    """The pitch band of each show that holds most seconds."""
    return O.densest_band(bank(spark, d), "show_id", "pitch", "seconds")


@query(f"WITH {BANK} SELECT a.show_id, a.speaker, arg_min(b.speaker, {{'d': abs(a.pitch - b.pitch), 's': b.speaker}}) AS voice FROM bank0 a JOIN bank0 b ON a.show_id = b.show_id AND a.speaker <> b.speaker AND a.pitch IS NOT NULL AND b.pitch IS NOT NULL AND a.clips < 12 AND b.clips >= 12 GROUP BY 1, 2")
def j11_understudies(spark: SparkSession, d: str) -> DataFrame:
    """Nearest banked voice by pitch for each speaker with few clips, within the show."""
    b = bank(spark, d).filter("pitch is not null")
    voices = b.filter("clips >= 12").select(F.col("show_id").alias("__show"), F.col("speaker").alias("voice"), F.col("pitch").alias("__pitch"))
    pairs = b.filter("clips < 12").join(voices, (F.col("show_id") == F.col("__show")) & (F.col("speaker") != F.col("voice")))
    best = F.min(F.struct(F.abs(F.col("pitch") - F.col("__pitch")).alias("d"), F.col("voice").alias("s")))
    return pairs.groupBy("show_id", "speaker").agg(best["s"].alias("voice"))


@query(f"WITH {BANK}, n AS (SELECT show_id, median(pitch) AS neutral FROM bank0 WHERE pitch > 0 GROUP BY 1 HAVING count(*) >= 2) SELECT show_id, speaker, round(greatest(least(round_even(1.6 * ((exp(2 * s) - 1) / (exp(2 * s) + 1)) / 0.25, 0) * 0.25, 1.6), -1.6), 2) AS shade FROM (SELECT b.show_id, b.speaker, 12 * log2(coalesce(b.pitch, n.neutral) / n.neutral) / 8 AS s FROM bank0 b JOIN n USING (show_id))")
def m06_m08_a13_shades(spark: SparkSession, d: str) -> DataFrame:
    """Shade of each voice from the show's median pitch; an unmeasured one borrows the median."""
    b = bank(spark, d)
    neutral = b.filter("pitch > 0").groupBy("show_id").agg(F.median("pitch").alias("neutral"), F.count(F.lit(1)).alias("n")).filter("n >= 2").drop("n")
    return b.join(neutral, "show_id").select("show_id", "speaker", S.pitch_shade(F.coalesce("pitch", "neutral"), F.col("neutral")).alias("shade"))


BYTE = "(instr('0123456789abcdef', substr(h, {i}, 1)) - 1) * 16 + instr('0123456789abcdef', substr(h, {j}, 1)) - 1"


@query(f"SELECT speaker, round(({BYTE.format(i=1, j=2)}) / 127.5 - 1.0, 6) AS lean, round(1 + (({BYTE.format(i=3, j=4)}) / 127.5 - 1.0) * 0.06, 3) AS pace FROM (SELECT DISTINCT speaker, sha1(speaker) AS h FROM bank)")
def m05_hash_shades(spark: SparkSession, d: str) -> DataFrame:
    """Repeatable shade of a role from its name."""
    s = table(spark, d, "bank", "speaker").distinct()
    lean = F.conv(F.substring(F.sha1(F.col("speaker").cast("binary")), 1, 2), 16, 10).cast("double") / 127.5 - 1.0
    return s.select("speaker", F.round(lean, 6).alias("lean"), S.hash_shade(F.col("speaker"))["pace"].alias("pace"))


@query(f"{SPEECH} SELECT id, CASE WHEN kind = 'sign' THEN 'sign' WHEN role IS NOT NULL AND role <> '' AND upper(role) NOT IN ('NARRATION', 'NARRATOR') THEN 'role' ELSE 'plain' END AS shade, CAST(CASE WHEN kind = 'sign' THEN 1.05 ELSE 1.0 END AS DOUBLE) AS pace FROM lines WHERE kind IN ('speech', 'sign')")
def m07_nudges(spark: SparkSession, d: str) -> DataFrame:
    """Which shade a line takes: a sign's, its role's, or none for narration."""
    a = V.lines(spark, d).filter("kind in ('speech', 'sign')")
    role = F.coalesce((F.col("role") != "") & ~F.upper("role").isin(*P.PLAIN_ROLES), F.lit(False))
    return a.select("id", F.when(F.col("kind") == "sign", "sign").when(role, "role").otherwise("plain").alias("shade"), F.when(F.col("kind") == "sign", 1.05).otherwise(1.0).alias("pace"))


OLD = "old AS (SELECT id, generated, compression, CASE WHEN id % 7 = 0 THEN gain + 0.01 ELSE gain END AS gain, overflow FROM reports WHERE id % 10 <> 3)"


@query(f"{REP}, {OLD}, m AS (SELECT a.id, greatest(abs(a.generated - o.generated), abs(a.compression - o.compression), abs(a.gain - o.gain), abs(a.overflow - o.overflow)) AS apart FROM reports a JOIN old o USING (id)) SELECT id, round(apart, 6) AS apart FROM m WHERE apart > 0.005")
def j19_moved(spark: SparkSession, d: str) -> DataFrame:
    """Lines that moved between two reports; the older one is made of the newer by changing every seventh gain."""
    r = V.reports(spark, d)
    old = r.filter("id % 10 <> 3").withColumn("gain", F.when(F.col("id") % 7 == 0, F.col("gain") + 0.01).otherwise(F.col("gain")))
    return O.moved(old, r).select("id", F.round("apart", 6).alias("apart"))


@query(f"{SPEECH}, e AS (SELECT id, CASE WHEN id % 3 = 0 THEN text || '!' ELSE text END AS text, 'new ' || id AS fresh FROM speech WHERE id % 2 = 0) SELECT s.id, CASE WHEN e.id IS NULL THEN 'none' WHEN e.text IS NOT DISTINCT FROM s.text THEN 'applied' ELSE 'stale' END AS state, CASE WHEN e.id IS NOT NULL AND e.text IS NOT DISTINCT FROM s.text THEN e.fresh END AS fresh FROM speech s LEFT JOIN e ON e.id = s.id")
def j03_guarded_edits(spark: SparkSession, d: str) -> DataFrame:
    """Edits laid over lines only where the text is still the one they were made for."""
    s = speech(spark, d).select("id", "text")
    edits = s.filter("id % 2 = 0").select("id", F.when(F.col("id") % 3 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text")).alias("text"), F.concat(F.lit("new "), F.col("id").cast("string")).alias("fresh"))
    return R.guarded_merge(s, edits, "id", "text", "fresh").select("id", "state", "fresh")


@query(f"{SPEECH}, e AS (SELECT speaker, text, arg_max(id, id) AS adapted FROM speech WHERE speaker IS NOT NULL AND text IS NOT NULL GROUP BY 1, 2) SELECT s.id, e.adapted FROM speech s LEFT JOIN e ON e.speaker = s.speaker AND e.text = s.text")
def j04_carried(spark: SparkSession, d: str) -> DataFrame:
    """Edits carried over by (speaker, text), the last one winning."""
    s = speech(spark, d)
    named = s.filter("speaker is not null and text is not null").withColumn("adapted", F.col("id"))
    return s.join(R.carried_over(named, ["speaker", "text"], "id", "adapted"), ["speaker", "text"], "left").select("id", "adapted")


@query(f"{SPEECH} SELECT id FROM speech WHERE st >= 60000 AND en <= 600000")
def p19_render_range(spark: SparkSession, d: str) -> DataFrame:
    return speech(spark, d).filter("st >= 60000 and en <= 600000").select("id")


@query(f"{SPEECH}, w(id) AS (SELECT unnest([1, 2, 3, 5, 8, 13, 21, 999999999])) SELECT w.id, CASE WHEN s.id IS NULL THEN 'missing' ELSE 'found' END AS state FROM (SELECT CAST(id AS BIGINT) AS id FROM w) w LEFT JOIN speech s ON s.id = w.id UNION ALL SELECT id, 'window' FROM speech WHERE st - 2500 <= 120000 AND 120000 <= en + 2500")
def p18_repair_lines(spark: SparkSession, d: str) -> DataFrame:
    """Lines of an id list, missing ones named, and lines around a moment."""
    s = speech(spark, d)
    ids = spark.createDataFrame([(i,) for i in (1, 2, 3, 5, 8, 13, 21, 999_999_999)], "id bigint")
    listed = F.broadcast(ids).join(s.select(F.col("id").alias("k")), F.col("id") == F.col("k"), "left").select("id", F.when(F.col("k").isNull(), "missing").otherwise("found").alias("state"))
    return listed.unionAll(s.filter("st - 2500 <= 120000 and 120000 <= en + 2500").select("id", F.lit("window")))


@query(f"{REP} SELECT id, greatest(0, least(CAST(round(start_seconds * 1000) AS BIGINT), CAST(round((start_seconds - coalesce(late, 0)) * 1000) AS BIGINT)) - 200) AS replace_head, greatest(CAST(round((start_seconds + held) * 1000) AS BIGINT), CAST(round((start_seconds - coalesce(late, 0) + available) * 1000) AS BIGINT)) + 200 AS replace_tail FROM reports WHERE start_seconds IS NOT NULL AND held IS NOT NULL AND available IS NOT NULL")
def g05_replace_spans(spark: SparkSession, d: str) -> DataFrame:
    """Span of the original that a line takes over, with pads."""
    r = V.reports(spark, d).filter("start_seconds is not null and held is not null and available is not null")
    ms = lambda c: F.round(c * 1000).cast("long")
    own = F.col("start_seconds") - F.coalesce("late", F.lit(0.0))
    return r.select("id", F.greatest(F.lit(0), F.least(ms(F.col("start_seconds")), ms(own)) - 200).alias("replace_head"), (F.greatest(ms(F.col("start_seconds") + F.col("held")), ms(own + F.col("available"))) + 200).alias("replace_tail"))


@query(f"{REP} SELECT speaker, bool_and(abs(pan) <= 0.15) AS centred FROM reports WHERE speaker IS NOT NULL AND pan IS NOT NULL GROUP BY 1")
def g03_auto_resolve(spark: SparkSession, d: str) -> DataFrame:
    """Whether every measured pan of a speaker is near the centre."""
    return V.reports(spark, d).filter("speaker is not null and pan is not null").groupBy("speaker").agg(F.every(F.abs("pan") <= 0.15).alias("centred"))


@query(f"WITH {BANK}, c AS (SELECT show_id, speaker, ratio, seconds / greatest(clips, 1) AS piece FROM bank0 WHERE ratio IS NOT NULL AND seconds / greatest(clips, 1) >= 0.4), a AS (SELECT *, coalesce(sum(piece) OVER (PARTITION BY show_id ORDER BY ratio DESC, speaker ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM c) SELECT show_id, speaker, round(before, 6) AS before FROM a WHERE before < 10")
def w15_greedy_clips(spark: SparkSession, d: str) -> DataFrame:
    """Cleanest pieces first until ten seconds are reached; pieces under 0.4 s are passed over."""
    c = bank(spark, d).withColumn("piece", F.col("seconds") / F.greatest("clips", F.lit(1))).filter("ratio is not null and piece >= 0.4")
    before = F.sum("piece").over(W.partitionBy("show_id").orderBy(F.desc("ratio"), "speaker").rowsBetween(W.unboundedPreceding, -1))
    return c.withColumn("before", F.coalesce(before, F.lit(0.0))).filter("before < 10").select("show_id", "speaker", F.round("before", 6).alias("before"))


@query(f"{REP}, {BANK}, p AS (SELECT speaker, median(pitch) AS reference FROM bank0 WHERE pitch > 0 GROUP BY 1), h AS (SELECT speaker, median(gain) * 180 AS heard, count(*) AS n_lines FROM reports WHERE speaker IS NOT NULL AND gain IS NOT NULL GROUP BY 1) SELECT h.speaker, h.n_lines, round((heard - reference) / reference * 100, 4) AS drift, abs((heard - reference) / reference * 100) > 20 AS drifted FROM h JOIN p USING (speaker)")
def a17_drift(spark: SparkSession, d: str) -> DataFrame:
    """Median heard against the reference pitch; what a line sounded at is read off its gain here, as the tables hold no pitch."""
    p = bank(spark, d).filter("pitch > 0").groupBy("speaker").agg(F.median("pitch").alias("reference"))
    h = rank.medians(V.reports(spark, d).filter("speaker is not null and gain is not null"), ["speaker"], "gain").select("speaker", (F.col("median") * 180).alias("heard"), F.col("n").alias("n_lines"))
    off = (F.col("heard") - F.col("reference")) / F.col("reference") * 100
    return h.join(p, "speaker").select("speaker", "n_lines", F.round(off, 4).alias("drift"), (F.abs(off) > 20).alias("drifted"))


STAMP = "sha256(concat_ws('|', coalesce(text, ''), coalesce(speaker, ''), CAST(en - st AS VARCHAR)))"


@query(f"{SPEECH}, n AS (SELECT id, {STAMP} AS stamp FROM speech), c AS (SELECT {STAMP} AS stamp FROM speech WHERE id % 4 <> 1) SELECT id FROM n WHERE stamp NOT IN (SELECT stamp FROM c)")
def st4_stamp_cache(spark: SparkSession, d: str) -> DataFrame:
    """Lines whose stamp is in no cache; the cache here holds three lines of four."""
    stamp = F.sha2(F.concat_ws("|", F.coalesce("text", F.lit("")), F.coalesce("speaker", F.lit("")), (F.col("en") - F.col("st")).cast("string")), 256)
    n = speech(spark, d).withColumn("stamp", stamp)
    return n.join(n.filter("id % 4 <> 1").select("stamp").distinct(), "stamp", "left_anti").select("id")
