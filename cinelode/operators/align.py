"""Time alignment of two scripts: anchors, fits, correlation and the decision."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cinelode.functions import score as S
from cinelode.functions import text as T
from cinelode.operators import intervals

# Shortest anchor, frames and reach in seconds, and what makes an offset sure.
MIN_ANCHOR, FRAME, REACH, GUARD = 14, 0.05, 180.0, 2.0
MAX_SCATTER, MAX_DRIFT, MIN_PEAK, MIN_MARGIN, ENOUGH = 0.5, 0.6, 0.25, 0.05, 8


def anchors(moving: DataFrame, fixed: DataFrame, pair: str = "episode_id") -> DataFrame:
    """(pair, at, offset): lines whose cleaned text occurs exactly once on either side. Inputs: pair, st, text (ms)."""

    def once(df: DataFrame, name: str) -> DataFrame:
        k = df.select(pair, T.clean_anchor(F.col("text")).alias("key"), "st").filter(F.length("key") >= MIN_ANCHOR)
        return k.groupBy(pair, "key").agg(F.count(F.lit(1)).alias("n"), F.min("st").alias(name)).filter("n = 1").drop("n")

    both = once(moving, "a").join(once(fixed, "b"), [pair, "key"])
    return both.select(pair, (F.col("a") / 1000).alias("at"), ((F.col("b") - F.col("a")) / 1000).alias("offset"))


def fits(pairs: DataFrame, pair: str = "episode_id") -> DataFrame:
    """Median offset, scatter (MAD), slope, intercept, residual (MAD about the line) and span of each pair.

    A line is fitted from 6 anchors on. Medians need two passes over the anchors, joined on the pair.
    """
    six = F.count(F.lit(1)) >= 6
    first = pairs.groupBy(pair).agg(
        F.count(F.lit(1)).alias("n"), F.median("offset").alias("middle"), F.when(six, F.coalesce(F.regr_slope("offset", "at"), F.lit(0.0))).otherwise(0.0).alias("slope"), F.when(six, F.regr_intercept("offset", "at")).alias("cross"), (F.max("at") - F.min("at")).alias("span")
    ).withColumn("cross", F.coalesce("cross", "middle"))
    second = pairs.join(first.withColumnRenamed(pair, "__p"), F.col(pair) == F.col("__p")).groupBy(pair).agg(F.median(F.abs(F.col("offset") - F.col("middle"))).alias("scatter"), F.median(F.abs(F.col("offset") - (F.col("slope") * F.col("at") + F.col("cross")))).alias("residual"))
    return first.join(second, pair)


def covered(lines: DataFrame, key: str = "episode_id", width_ms: int = 50) -> DataFrame:
    """(key, frames): how many frames of ``width_ms`` the key's lines cover, each once; from merged periods, so no line is taken apart into frames."""
    spans = lines.select(key, F.floor(F.col("st") / width_ms).alias("s_ms"), F.floor(F.col("en") / width_ms).alias("e_ms"))
    p = intervals.periods(spans, key, intervals.BUCKET_MS // width_ms)
    return p.groupBy(key).agg(F.sum(F.col("period_end_ms") - F.col("period_start_ms")).alias("frames"))


def correlate(moving: np.ndarray, fixed: np.ndarray, reach: int) -> tuple[int, float, float]:
    """(shift, peak, margin) of two timelines of 0 and 1: the normalised correlation over the overlap, for all shifts at once.

    Sums over every overlap come from cumulative sums and one FFT product, so a pair costs n log n.
    """
    n, m = len(moving), len(fixed)
    size = 1 << int(np.ceil(np.log2(n + m)))
    cross = np.fft.irfft(np.fft.rfft(fixed, size) * np.conj(np.fft.rfft(moving, size)), size)
    a, b = np.r_[0, np.cumsum(moving)], np.r_[0, np.cumsum(fixed)]
    shifts = np.arange(-reach, reach + 1)
    lo, hi = np.maximum(0, -shifts), np.minimum(n, m - shifts)
    span = hi - lo
    fine = span >= max(1, min(reach, min(n, m) // 2))
    lo, hi, span = np.where(fine, lo, 0), np.where(fine, hi, 1), np.where(fine, span, 1)
    sa, sb = a[hi] - a[lo], b[np.clip(hi + shifts, 0, m)] - b[np.clip(lo + shifts, 0, m)]
    top = cross[shifts % size] - sa * sb / span
    under = np.sqrt(np.maximum(sa - sa**2 / span, 0) * np.maximum(sb - sb**2 / span, 0))
    scores = np.where(fine & (under > 1e-9), top / np.where(under > 1e-9, under, 1), 0.0)
    best = int(np.argmax(np.round(scores, 9)))
    guard = int(GUARD / FRAME)
    field = np.r_[scores[: max(0, best - guard)], scores[best + guard :]]
    return best - reach, float(scores[best]), float(scores[best] - field.max()) if len(field) else float(scores[best])


def correlated(moving: DataFrame, fixed: DataFrame, pair: str = "episode_id", reach_s: float = REACH) -> DataFrame:
    """(pair, shift_ms, peak, margin) of each pair of timelines: lists of spans meet per pair, not frames."""
    spans = lambda df, name: df.groupBy(pair).agg(F.collect_list(F.struct("st", "en")).alias(name))
    both = spans(moving, "a").join(spans(fixed, "b"), pair)
    reach, width = int(reach_s / FRAME), int(FRAME * 1000)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for p, a, b in zip(pdf[pair], pdf["a"], pdf["b"], strict=True):
                n = int(max(x["en"] for x in [*a, *b])) // width + 1
                lines = []
                for spans_ in (a, b):
                    t = np.zeros(n)
                    for x in spans_:
                        t[x["st"] // width : max(x["en"] // width, x["st"] // width)] = 1
                    lines.append(t)
                shift, peak, margin = correlate(lines[0], lines[1], reach)
                rows.append((p, shift * width, peak, margin))
            yield pd.DataFrame(rows, columns=[pair, "shift_ms", "peak", "margin"])

    return both.mapInPandas(run, f"{pair} bigint, shift_ms bigint, peak double, margin double")


def decided(fit: DataFrame, by_shift: DataFrame, pair: str = "episode_id") -> DataFrame:
    """(pair, how, offset, rate): text if the anchors agree, rate if they lie on a line, else activity if its peak stands out, else none."""
    both = fit.join(by_shift, pair, "full_outer")
    drift = F.col("slope") * F.col("span")
    enough = F.coalesce(F.col("n") >= ENOUGH, F.lit(False))
    how = (
        F.when(enough & (F.col("scatter") <= MAX_SCATTER) & (F.abs(drift) <= MAX_DRIFT), "text")
        .when(enough & (F.col("residual") <= MAX_SCATTER) & (F.abs(drift) > MAX_DRIFT), "rate")
        .when((F.col("peak") >= MIN_PEAK) & (F.col("margin") >= MIN_MARGIN), "activity")
        .otherwise("none")
    )
    both = both.withColumn("how", how)
    offset = F.when(F.col("how").isin("text", "rate"), F.col("middle")).when(F.col("how") == "activity", F.col("shift_ms") / 1000)
    return both.select(pair, "how", offset.alias("offset"), F.when(F.col("how") == "rate", S.rate_name(1 / (1 + F.col("slope")))).alias("rate"))
