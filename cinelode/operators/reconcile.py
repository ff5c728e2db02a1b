"""Wanted against existing: actions, guards and set differences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# When a prune is refused.
PRUNE_SHARE, PRUNE_FLOOR = 0.25, 20


def actions(wanted: DataFrame, existing: DataFrame, key: str, value: str) -> DataFrame:
    """(key, action): created, updated, unchanged or stale. Keys are unique on both sides; NULL keys are left out."""
    w = wanted.select(key, F.col(value).alias("__w"), F.lit(True).alias("__in_w"))
    e = existing.select(key, F.col(value).alias("__e"), F.lit(True).alias("__in_e"))
    action = F.when(F.col("__in_w").isNull(), "stale").when(F.col("__in_e").isNull(), "created").when(F.col("__w").eqNullSafe(F.col("__e")), "unchanged").otherwise("updated")
    return w.filter(F.col(key).isNotNull()).join(e.filter(F.col(key).isNotNull()), key, "full_outer").select(key, action.alias("action"))


def prune_gate(planned: DataFrame, failed: Column | None = None) -> DataFrame:
    """One row: stale, existing and ``block`` (reason or NULL) of a plan of :func:`actions`."""
    n = planned.agg(F.count_if(F.col("action") == "stale").alias("stale"), F.count_if(F.col("action") != "created").alias("existing"))
    source = F.lit(None).cast("string") if failed is None else failed
    mass = (F.col("stale") > F.col("existing") * PRUNE_SHARE) & (F.col("existing") >= PRUNE_FLOOR)
    return n.withColumn("block", F.coalesce(source, F.when(mass, F.concat_ws(" ", F.lit("would delete"), F.concat_ws("/", F.col("stale").cast("string"), F.col("existing").cast("string")), F.lit("files")))))


def guarded_merge(rows: DataFrame, edits: DataFrame, key: str, text: str, new: str) -> DataFrame:
    """Edits laid over rows only where the text they were made for is still the same.

    Result: rows with ``new`` and ``state``: applied, stale or none. Edits are unique by key.
    """
    e = edits.select(F.col(key).alias("__k"), F.col(text).alias("__t"), F.col(new).alias("__n"))
    same = F.col("__t").eqNullSafe(F.col(text))
    return (
        rows.join(e, F.col(key) == F.col("__k"), "left")
        .withColumns({"state": F.when(F.col("__k").isNull(), "none").when(same, "applied").otherwise("stale"), new: F.when(F.col("__k").isNotNull() & same, F.col("__n"))})
        .drop("__k", "__t", "__n")
    )


def carried_over(edits: DataFrame, natural: list[str], order: str, value: str) -> DataFrame:
    """The last edit of each natural key, so that edits survive new ids."""
    return edits.groupBy(*natural).agg(F.max_by(value, order).alias(value))
