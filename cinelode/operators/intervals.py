"""Interval algebra per entity: covered periods, gaps, overlaps, scenes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Width of a time bucket for the first merge, in milliseconds.
BUCKET_MS = 600_000


def _number(c: Column) -> Column:
    return F.when(F.isnan(c) | F.isnull(c) | (F.abs(c) == F.lit(float("inf"))), None).otherwise(c)


def usable_time(df: DataFrame, start: str = "start", end: str = "end", window: str = "window") -> DataFrame:
    """Add ``s_ms`` and ``e_ms`` (bigint) and drop rows without usable time.

    A missing end (NULL, NaN, infinite) is start + window, a missing start is end - window; if
    either still can't be had the row is left out; reversed ends are exchanged.
    """
    s, e, w = (_number(F.col(c).cast("double")) for c in (start, end, window))
    s2, e2 = F.coalesce(s, e - w), F.coalesce(e, s + w)
    ms = lambda c: F.round(c * 1000).cast("long")
    return (
        df.withColumns({"__s": ms(s2), "__e": ms(e2)})
        .filter(F.col("__s").isNotNull() & F.col("__e").isNotNull())
        .withColumns({"s_ms": F.least("__s", "__e"), "e_ms": F.greatest("__s", "__e")})
        .drop("__s", "__e")
    )


def _merged(df: DataFrame, key: str) -> DataFrame:
    """One merge: sessions with a duration of their own row, by (key, bucket)."""
    stamp = F.timestamp_millis(F.col("s_ms"))
    gap = F.concat((F.col("e_ms") - F.col("s_ms")).cast("string"), F.lit(" milliseconds"))
    return (
        df.groupBy(key, "bucket", F.session_window(stamp, gap).alias("w"))
        .agg(F.count(F.lit(1)).alias("n"))
        .select(key, "bucket", F.unix_millis("w.start").alias("s_ms"), F.unix_millis("w.end").alias("e_ms"), "n")
    )


def _stitched(df: DataFrame, key: str, bucket_ms: int) -> DataFrame:
    """Merged periods by bucket with ``reach`` (latest end so far) and ``nxt`` (next start).

    A period may run over later buckets, so each bucket gets the latest end of all
    earlier ones; that needs one row for each bucket, not the lines.
    """
    lines = (
        df.select(key, "s_ms", "e_ms")
        .filter(F.col("e_ms") > F.col("s_ms"))
        .withColumn("bucket", F.floor(F.col("s_ms") / bucket_ms))
    )
    parts = _merged(lines, key)
    order = W.partitionBy(key).orderBy("bucket")
    buckets = parts.groupBy(key, "bucket").agg(F.max("e_ms").alias("last"), F.min("s_ms").alias("first"))
    buckets = buckets.select(
        F.col(key).alias("__k"),
        F.col("bucket").alias("__b"),
        F.max("last").over(order.rowsBetween(W.unboundedPreceding, -1)).alias("carried"),
        F.lead("first").over(order).alias("follows"),
    )
    inside = W.partitionBy(key, "bucket").orderBy("s_ms", "e_ms")
    return (
        parts.join(buckets, (F.col(key).eqNullSafe(F.col("__k"))) & (F.col("bucket") == F.col("__b")))
        .withColumns(
            {
                "before": F.greatest("carried", F.max("e_ms").over(inside.rowsBetween(W.unboundedPreceding, -1))),
                "reach": F.greatest("carried", F.max("e_ms").over(inside.rowsBetween(W.unboundedPreceding, 0))),
                "nxt": F.coalesce(F.lead("s_ms").over(inside), "follows"),
            }
        )
        .select(key, "bucket", "s_ms", "e_ms", "before", "reach", "nxt", "n")
    )


def gaps(df: DataFrame, key: str, bucket_ms: int = BUCKET_MS) -> DataFrame:
    """Uncovered stretches between the first and last covered moment of each entity.

    ``df`` has ``key``, ``s_ms``, ``e_ms``. Rows of zero length cover nothing; NULL keys
    form an entity of their own; an entity without covered time has no row. Repeats
    change nothing, and other columns are ignored.
    """
    return (
        _stitched(df, key, bucket_ms)
        .filter(F.col("nxt") > F.col("reach"))
        .select(key, F.col("reach").alias("gap_start_ms"), F.col("nxt").alias("gap_end_ms"))
    )


def periods(df: DataFrame, key: str, bucket_ms: int = BUCKET_MS) -> DataFrame:
    """Continuous covered periods of each entity; touching periods are one.

    Starts are the merged parts that nothing earlier reaches, ends the last reach
    before the next start; both are derived from the same rows as :func:`gaps`.
    """
    parts = _stitched(df, key, bucket_ms)
    edge = parts.filter(F.col("before").isNull() | (F.col("s_ms") > F.col("before"))).select(key, F.col("s_ms").alias("at"), F.lit(0).alias("side"))
    stop = parts.filter(F.col("nxt").isNull() | (F.col("nxt") > F.col("reach"))).select(key, F.col("reach").alias("at"), F.lit(1).alias("side"))
    both = edge.unionAll(stop)
    order = W.partitionBy(key).orderBy("at", F.col("side").desc())
    return (
        both.withColumn("period_end_ms", F.lead("at").over(order))
        .filter("side = 0")
        .select(key, F.col("at").alias("period_start_ms"), "period_end_ms")
    )
