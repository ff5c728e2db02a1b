"""Frame-wise features of sample chunks: levels, smoothing, runs, pan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def rms_frames(chunks: DataFrame, key: str, samples: str, width: int) -> DataFrame:
    """(key, frame, rms) of arrays of samples; a trailing partial frame is dropped. One row a chunk in, one a frame out."""
    n = F.floor(F.size(samples) / width).cast("int")
    part = lambda f: F.slice(samples, f * width + 1, width)
    level = lambda f: F.sqrt(F.aggregate(part(f), F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")) / width)
    frames = F.transform(F.sequence(F.lit(0), n - 1), lambda f: F.struct(f.alias("frame"), level(f).alias("rms")))
    return chunks.filter(F.size(samples) >= width).select(key, F.inline(frames))


def active(frames: DataFrame, key: str, share: float = 0.25) -> DataFrame:
    """Frames with ``on``: the level is above ``share`` of the key's 90th percentile (linear interpolation)."""
    loud = frames.groupBy(F.col(key).alias("__k")).agg(F.percentile("rms", F.lit(0.9)).alias("p90"))
    return frames.join(loud, F.col(key) == F.col("__k")).drop("__k").withColumn("on", F.col("rms") > share * F.col("p90"))


def smoothed(frames: DataFrame, key: str, width: int = 5) -> DataFrame:
    """``smooth``: centred mean with zeros beyond the ends (always divided by ``width``)."""
    half = width // 2
    w = W.partitionBy(key).orderBy("frame").rowsBetween(-half, half)
    return frames.withColumn("smooth", F.sum("rms").over(w) / width)


def bridged(frames: DataFrame, key: str, on: str, gap: int = 4) -> DataFrame:
    """``bridged``: gaps of up to ``gap`` frames between true ones are filled."""
    w = W.partitionBy(key).orderBy("frame")
    here = F.when(F.col(on), F.col("frame"))
    before = F.last(here, ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, 0))
    # The next true frame, as the last one seen going backwards (a running frame, not a rescan of what follows).
    after = F.last(here, ignorenulls=True).over(W.partitionBy(key).orderBy(F.desc("frame")).rowsBetween(W.unboundedPreceding, 0))
    return frames.withColumn("bridged", F.col(on) | F.coalesce(after - before <= gap + 1, F.lit(False)))


def runs(frames: DataFrame, key: str, on: str, least: int) -> DataFrame:
    """(key, first, last) of runs of true frames of at least ``least`` frames: gaps and islands."""
    w = W.partitionBy(key).orderBy("frame")
    t = frames.filter(on).withColumn("__g", F.col("frame") - F.row_number().over(w))
    return t.groupBy(key, "__g").agg(F.min("frame").alias("first"), F.max("frame").alias("last")).filter(F.col("last") - F.col("first") + 1 >= least).drop("__g")


def pan_and_level(left: Column, right: Column) -> Column:
    """Struct pan (-1 .. 1, by power) and loudness in dB of two arrays of samples."""
    power = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")) / F.size(a)
    total = power(left) + power(right)
    return F.struct(F.coalesce((power(right) - power(left)) / F.nullif(total, F.lit(0.0)), F.lit(0.0)).alias("pan"), (10 * F.log10(total / 2 + 1e-12)).alias("loudness"))


def mask(spans: DataFrame, key: str, head: str, tail: str, ramp: int) -> DataFrame:
    """(key, frame, weight): strongest claim of overlapping spans [head, tail), with linear ramps at both edges."""
    f = spans.filter(F.col(tail) - F.col(head) >= 2).select(key, head, tail, F.explode(F.sequence(F.col(head), F.col(tail) - 1)).alias("frame"))
    edge = F.least(F.lit(ramp), F.floor((F.col(tail) - F.col(head)) / 2))
    step = F.when(edge > 1, 1 / (F.greatest(F.lit(ramp), F.lit(2)) - 1)).otherwise(1.0)
    near = F.least(F.col("frame") - F.col(head), F.col(tail) - 1 - F.col("frame"))
    weight = F.when(near < edge, near * step).otherwise(1.0)
    return f.groupBy(key, "frame").agg(F.max(weight).alias("weight"))


def passable(frames: DataFrame, key: str, ratio: str = "ratio", least: float = 3.0) -> DataFrame:
    """Frames whose ratio reaches the larger of ``least`` and the key's median; all frames of a key where none does."""
    mid = frames.groupBy(F.col(key).alias("__k")).agg(F.greatest(F.lit(least), F.median(ratio)).alias("__m"), F.max(ratio).alias("__top"))
    return frames.join(mid, F.col(key) == F.col("__k")).filter((F.col(ratio) >= F.col("__m")) | (F.col("__top") < F.col("__m"))).drop("__k", "__m", "__top")


def clean(voice: Column, behind: Column, floor: float = 0.005, ratio: float = 10.0) -> Column:
    """Whether a frame is a clean clip's: the voice is above ``floor`` and at least ``ratio`` times what is behind it."""
    return (voice > floor) & (voice / (behind + 1e-6) >= ratio)


# Frequency groups with their lowest edge in Hz, and the difference in dB that is large.
BANDS = (("sub", 0), ("low", 120), ("voice", 400), ("upper voice", 1000), ("presence", 3400), ("air", 8000))
LARGE_DB = 3.0


def band(hertz: Column) -> Column:
    """Name of the group that a frequency lies in; NULL below 0."""
    out = F.when(hertz >= BANDS[-1][1], BANDS[-1][0])
    for name, low in reversed(BANDS[:-1]):
        out = out.when(hertz >= low, name)
    return out


def band_report(levels: DataFrame) -> DataFrame:
    """(band, frames, delta, large) of levels (hertz, before, after in dB): the mean difference of each group, and whether it exceeds LARGE_DB."""
    m = levels.withColumn("band", band(F.col("hertz"))).filter("band is not null and before is not null and after is not null")
    m = m.groupBy("band").agg(F.count(F.lit(1)).alias("frames"), F.avg(F.col("after") - F.col("before")).alias("delta"))
    return m.withColumn("large", F.abs("delta") > LARGE_DB)


def stability(levels: DataFrame, key: str, speaking: str) -> DataFrame:
    """(key, during, between): mean difference of levels (before, after in dB) while a line plays and while none does; keys without one of both are left out."""
    delta = F.col("after") - F.col("before")
    m = levels.groupBy(key).agg(F.avg(F.when(F.col(speaking), delta)).alias("during"), F.avg(F.when(~F.col(speaking), delta)).alias("between"))
    return m.filter("during is not null and between is not null")


def interpolated(gains: DataFrame, key: str, width: int) -> DataFrame:
    """(key, sample, gain): gains of frames (key, frame, gain) as a curve over samples, straight between the frames' middles and 1 beyond the first and last.

    Each frame makes the samples up to the next middle; nothing but the next frame's gain is looked up.
    """
    half = width / 2.0
    nxt = gains.select(F.col(key).alias("__k"), (F.col("frame") - 1).alias("__f"), F.col("gain").alias("__to"))
    g = gains.join(nxt, F.col(key).eqNullSafe(F.col("__k")) & (F.col("frame") == F.col("__f")), "left").drop("__k", "__f")
    middle = F.col("frame") * width + half
    # Samples from this middle to the one before the next; the first frame also makes those before it, the last those behind it.
    low = F.when(F.col("frame") == 0, 0).otherwise(F.ceil(middle)).cast("long")
    high = F.when(F.col("__to").isNull(), (F.col("frame") + 1) * width - 1).otherwise(F.ceil(middle + width) - 1).cast("long")
    s = g.withColumn("sample", F.explode(F.sequence(low, high)))
    share = (F.col("sample") - middle) / width
    inside = F.when(share < 0, 1.0).when(share == 0, F.col("gain")).when(F.col("__to").isNull(), 1.0).otherwise(F.col("gain") + share * (F.col("__to") - F.col("gain")))
    return s.select(key, "sample", inside.alias("gain"))


def crossfaded(original: Column, replaced: Column, weight: Column) -> Column:
    """A sample between two versions: ``weight`` 0 is the original, 1 the replacement."""
    return original * (1 - weight) + replaced * weight


def normalised(samples: DataFrame, value: str, ceiling: float = 0.99) -> DataFrame:
    """Samples scaled down so that the loudest stays under ``ceiling``; quieter ones stay as they are. One global maximum of one row."""
    peak = samples.agg(F.max(F.abs(value)).alias("__peak"))
    return samples.join(F.broadcast(peak)).withColumn(value, F.col(value) * F.when(F.col("__peak") > ceiling, ceiling / F.col("__peak")).otherwise(1.0)).drop("__peak")
