"""Planning and judging rendered lines."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cinelode.functions import patterns as P
from cinelode.operators import ordered
from cinelode.operators.fold import stream_fold

# Pause between two lines read by one person, and how late one may start (ms).
SOLO_GAP_MS, MAX_LAG_MS = 120, 2500


def queued(lines: DataFrame) -> DataFrame:
    """Lines of an episode read one after the other: episode_id, id, head_ms, late_ms, available_ms, factor.

    ``lines``: episode_id, st, id, window_ms, slack_ms, generated_ms. A line waits for the one before if that makes it no more than
    MAX_LAG_MS late; what the queue eats comes off its room. The state is the moment at which the reader is free. It lies no later than the longest
    lag, the made length and the pause behind any earlier line, so where that has passed the queue begins anew and episodes are spread.
    """
    rows = lines.select("episode_id", "st", "id", "window_ms", "slack_ms", "generated_ms")
    free = rows.withColumn("__free", F.col("st") + MAX_LAG_MS + F.greatest("generated_ms", F.lit(0)) + SOLO_GAP_MS + 1)
    cut = ordered.islands(free, ["episode_id"], F.col("st") > F.col("reach"), end="__free").drop("__free")

    def step(cursor: list[int], row: tuple) -> tuple:
        e, st, i, window, slack, made, _ = row
        wait = cursor[0] - st if cursor else 0
        late = wait if 0 < wait <= MAX_LAG_MS else 0
        room = max(0, window - late + max(0, slack - 150))
        factor = min(made / room, P.MAX_FACTOR) if room > 200 and made > room else 1.0
        cursor[:] = [st + late + math.floor(made / factor + 0.5) + SOLO_GAP_MS]
        return e, i, st + late, late, room, factor

    return stream_fold(cut, ["episode_id", "island"], ["st", "id"], list, step, "episode_id bigint, id bigint, head_ms bigint, late_ms bigint, available_ms bigint, factor double")


def ducked(frames: DataFrame, floor: float, falling: float, rising: float) -> DataFrame:
    """One-pole gain per frame: quick down, slow up. ``frames``: episode_id, frame, speaking (boolean). Adds gain. Only the gain itself is held."""

    def step(gain: list[float], row: tuple) -> tuple:
        e, f, on = row
        want = floor if on else 1.0
        gain[0] = want + (gain[0] - want) * (falling if want < gain[0] else rising)
        return e, f, gain[0]

    return stream_fold(frames.select("episode_id", "frame", "speaking"), ["episode_id"], ["frame"], lambda: [1.0], step, "episode_id bigint, frame bigint, gain double")


def densest_band(df: DataFrame, key: str, pitch: str, weight: str, band: float = 2.0) -> DataFrame:
    """For each ``key`` the pitch whose band (+- ``band`` semitones) holds most weight; first by pitch on ties.

    Result: key, middle, held, share, n_members. Sums are rounded to 6 places before they are compared.
    """
    fine = 1_000_000  # semitones in whole millionths, as range frames want
    v = df.filter((F.col(pitch) > 0) & ~F.isnan(pitch)).withColumn("semi", F.round(12 * F.log2(F.col(pitch)) * fine).cast("long"))
    near = W.partitionBy(key).orderBy("semi").rangeBetween(-int(band * fine), int(band * fine))
    whole = W.partitionBy(key)
    v = v.select(key, "semi", F.round(F.sum(weight).over(near), 6).alias("held"), F.count(F.lit(1)).over(near).alias("n_members"), F.round(F.sum(weight).over(whole), 6).alias("total"))
    best = v.groupBy(key).agg(F.min(F.struct((-F.col("held")).alias("lost"), "semi", "n_members", "total")).alias("m"))
    return best.select(key, (F.col("m.semi") / fine).alias("middle"), (-F.col("m.lost")).alias("held"), F.round(-F.col("m.lost") / F.col("m.total"), 6).alias("share"), F.col("m.n_members").alias("n_members"))


def top_lines(reports: DataFrame, n: int = 5) -> DataFrame:
    """The ``n`` worst, tightest and cleanest lines (kind, place, id); each branch is a top-k, ties by id."""
    worst = reports.filter((F.col("overflow") > P.OVERRUN) & (F.col("available") > 0)).select(F.lit("worst").alias("kind"), "id", F.col("overflow").alias("measure"))
    tight = reports.filter(F.col("compression") > P.SQUEEZED).select(F.lit("tightest").alias("kind"), "id", F.col("compression").alias("measure"))
    clean = reports.filter((F.col("compression") <= P.SQUEEZED) & (F.col("overflow") <= 0.05) & (F.col("available") > 1.5) & (F.col("held") > 1.5)).select(F.lit("clean").alias("kind"), "id", F.col("held").alias("measure"))
    tops = [b.orderBy(F.desc("measure"), "id").limit(n) for b in (worst, tight, clean)]
    union = tops[0].unionByName(tops[1]).unionByName(tops[2])
    return union.withColumn("place", F.row_number().over(W.partitionBy("kind").orderBy(F.desc("measure"), "id"))).select("kind", "place", "id", "measure")


def cleanest(clips: DataFrame, n: int = 90) -> DataFrame:
    """The ``n`` clips of the highest ratio; clips without one are left out, ties by show and speaker. A top-k."""
    return clips.filter("ratio is not null").orderBy(F.desc("ratio"), "show_id", "speaker").limit(n)


def quality(reports: DataFrame, key: str | Column) -> DataFrame:
    """Lines, share squeezed, overruns, worst overrun and their rate, by ``key``."""
    over = (F.col("overflow") > P.OVERRUN) & (F.col("available") > 0)
    q = reports.groupBy(key).agg(
        F.count(F.lit(1)).alias("n_lines"), F.count_if(F.col("compression") > P.SQUEEZED).alias("squeezed"), F.count_if(over).alias("overruns"), F.coalesce(F.max(F.when(over, F.col("overflow"))), F.lit(0.0)).alias("worst")
    )
    return q.withColumns({"squeezed_share": F.round(F.col("squeezed") / F.col("n_lines"), 6), "overrun_rate": F.round(F.col("overruns") / F.col("n_lines"), 6)})


def moved(before: DataFrame, after: DataFrame, fields: tuple[str, ...] = ("generated", "compression", "gain", "overflow"), tolerance: float = 0.005) -> DataFrame:
    """Lines of two reports that differ in a field by more than ``tolerance``; lines in one only are left out."""
    old = before.select(F.col("id").alias("__id"), *[F.col(f).alias(f"__{f}") for f in fields])
    apart = F.greatest(*[F.abs(F.col(f) - F.col(f"__{f}")) for f in fields])
    return after.join(old, F.col("id") == F.col("__id")).withColumn("apart", apart).filter(F.col("apart") > tolerance).select("id", "apart")


def placed(lines: DataFrame, pans: DataFrame) -> DataFrame:
    """Lines with the ``pan`` resolved for their case and speaker; NULL (the centre) where none is. pans: episode_id, overdub, speaker, pan."""
    p = pans.select(F.col("episode_id").alias("__e"), F.col("overdub").alias("__o"), F.col("speaker").alias("__s"), "pan")
    return lines.join(p, (F.col("episode_id") == F.col("__e")) & (F.col("overdub") == F.col("__o")) & (F.col("speaker") == F.col("__s")), "left").drop("__e", "__o", "__s")


# The shade of a sign that is read out.
SIGN_SHADE = {"pitch": -0.3, "pace": 1.05, "gain": 0.9}


def nudged(lines: DataFrame) -> DataFrame:
    """Lines with ``pitch``, ``pace`` and ``gain``: what the actor's tuning and the line's shade make together.

    ``lines``: kind, role, lift, and tuning_ and shade_ columns of pitch, pace and gain (NULL: none). Pitch adds, pace and gain multiply. A sign has its own
    shade, a role that is no narration its role's, a measured line none; ``lift`` goes before a shade's pitch. A line with none of these keeps the tuning.
    """
    role = F.coalesce((F.col("role") != "") & ~F.upper("role").isin(*P.PLAIN_ROLES), F.lit(False))
    sign, measured = F.coalesce(F.col("kind") == "sign", F.lit(False)), F.col("lift").isNotNull()
    plain = {"pitch": 0.0, "pace": 1.0, "gain": 1.0}
    shade = {c: F.when(sign, SIGN_SHADE[c]).when(role, F.coalesce(f"shade_{c}", F.lit(n))).otherwise(n) for c, n in plain.items()}
    base = {c: F.coalesce(f"tuning_{c}", F.lit(n)) for c, n in plain.items()}
    none = ~sign & ~role & ~measured
    return lines.withColumns({
        "pitch": base["pitch"] + F.when(none, 0.0).otherwise(F.coalesce("lift", shade["pitch"])),
        "pace": base["pace"] * F.when(none, 1.0).otherwise(shade["pace"]),
        "gain": base["gain"] * F.when(none, 1.0).otherwise(shade["gain"]),
    })


#: A measured pan no farther from the centre has nothing to match.
CENTRED = 0.15


def auto_resolved(cases: DataFrame, pans: DataFrame) -> DataFrame:
    """(episode_id, overdub, eligible): whether every measured pan of a case's speakers is near the centre; unmeasured speakers don't count against it.

    cases: episode_id, overdub, speaker. pans: speaker, pan (NULL: not measured).
    """
    worst = pans.groupBy(F.col("speaker").alias("__s")).agg(F.max(F.abs("pan")).alias("__far"))
    who = cases.select("episode_id", "overdub", "speaker").distinct().join(worst, F.col("speaker") == F.col("__s"), "left")
    return who.groupBy("episode_id", "overdub").agg(F.every(F.coalesce(F.col("__far") <= CENTRED, F.lit(True))).alias("eligible"))
