"""Best representative of each group of duplicate records.

One aggregation keeps, for each attribute, the maximum of a composite struct
(usable, source priority, time, -id, value), so the best value of every field and the
best whole record come from the same pass, with partial aggregation before the shuffle (by
sorting, as structs with strings are no fixed-width buffers). Maxima of maxima are maxima, so
groups that turn out to be one are merged from their few rows, not from the records.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cinelode.llm import medianames
from cinelode.session import cut

# Texts that stand for a missing value.
STAND_INS = ("", "-", "--", "n/a", "na", "none", "null", "nil", "nan", "unknown", "?", "tbd", "missing", "undefined")

PARTS = "kind string, media string, season int, number int, label string"


def usable_text(c: Column) -> Column:
    """Present, not blank and no stand-in."""
    t = F.lower(F.regexp_replace(c, r"^[\s 　]+|[\s 　]+$", ""))
    return F.coalesce(~t.isin(*STAND_INS), F.lit(False))


def partial(df: DataFrame, group: list[str], key: str, attributes: dict[str, Column], at: str, priority: Column | None = None, uncounted: tuple[str, ...] = ()) -> DataFrame:
    """Groups with what :func:`merged` needs: first, last, record and a struct for each attribute; rows with a NULL key are left out.

    Attributes in ``uncounted`` survive like others, but make no record more complete.
    """
    order = priority if priority is not None else F.lit(0)
    usable = {c: F.coalesce(cond, F.lit(False)).cast("int") for c, cond in attributes.items()}
    filled = sum((u for c, u in usable.items() if c not in uncounted), F.lit(0))
    record = F.max(F.struct(filled.alias("n"), order.alias("p"), F.col(at).alias("t"), (-F.col(key)).alias("k"))).alias("__record")
    fields = [F.max(F.struct(u.alias("u"), order.alias("p"), F.col(at).alias("t"), (-F.col(key)).alias("k"), F.col(c).alias("v"))).alias(f"__{c}") for c, u in usable.items()]
    return df.filter(F.col(key).isNotNull()).groupBy(*group).agg(F.min(key).alias("__first"), F.max(key).alias("__last"), record, *fields)


def merged(parts: DataFrame, group: list[str], key: str, attributes: list[str], again: bool = True) -> DataFrame:
    """Result rows from partial groups; ``again`` if several of them may be one group."""
    if again:
        parts = parts.groupBy(*group).agg(F.min("__first").alias("__first"), F.max("__last").alias("__last"), F.max("__record").alias("__record"), *[F.max(f"__{c}").alias(f"__{c}") for c in attributes])
    best = [F.when(F.col(f"__{c}.u") == 1, F.col(f"__{c}.v")).alias(f"best_{c}") for c in attributes]
    return parts.filter(F.col("__last") > F.col("__first")).select(*group, F.col("__first").alias(f"first_{key}"), (-F.col("__record.k")).alias(f"keep_{key}"), *best)


def survivors(df: DataFrame, group: list[str], key: str, attributes: dict[str, Column], at: str, priority: Column | None = None) -> DataFrame:
    """One row for each group of two or more keys.

    ``attributes`` maps a column to the condition under which its value is usable. Result: the
    group columns, ``first_<key>`` (smallest), ``keep_<key>`` (most usable values, then source priority, then latest
    ``at`` with NULL earliest, then smallest key) and, for each attribute, the
    surviving value ``best_<column>``: usable first, then priority, latest, smallest key; NULL if
    no record has a usable one. Repeated rows change nothing. NULL keys are left out; NULL group values are values.
    """
    return merged(partial(df, group, key, attributes, at, priority), group, key, list(attributes), again=False)


def named_parts(files: DataFrame) -> DataFrame:
    """Rows with what their name says: kind, media, season, number, label."""
    columns = ["id", "item_id", "name", "short_name", "size", "listed_at"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            parts = [medianames.parse(x)[:5] for x in pdf["name"]]
            yield pd.concat([pdf.reset_index(drop=True), pd.DataFrame(parts, columns=["kind", "media", "season", "number", "label"]).astype({"season": "Int32", "number": "Int32"})], axis=1)

    one = files.select(*columns)
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in one.schema)
    return one.mapInPandas(run, f"{kinds}, {PARTS}")


# How a container is trusted as the source of a record's values, best first; others come last.
TRUSTED = ("mkv", "flac", "ass", "mp4", "m4v", "srt", "m4a", "avi", "mp3")


def trust(name: Column) -> Column:
    """Source priority of a file by its container."""
    ext = F.lower(F.regexp_extract(name, r"\.([^./\\]+)\s*$", 1))
    out = F.lit(0)
    for i, x in enumerate(TRUSTED):
        out = F.when(ext == x, len(TRUSTED) - i).otherwise(out)
    return F.coalesce(out, F.lit(0))


GROUP = ["item_id", "media", "kind", "season", "number", "label"]


def same_files(files: DataFrame, fields: bool = True, by_source: bool = False) -> DataFrame:
    """Groups of files of one download that are the same file, with their survivors.

    Same season and episode, same film, same extra or same disc and track, in the same
    class. A name without a season takes the one regular season of its download; if that has
    several, or none, such names agree only with each other. Samples and nameless
    rows are in no group; rows without a class (another extension) are one class.

    The surviving record has most usable values among short_name and size, then (``by_source``) the most trusted container,
    then the latest time, then the smallest id. ``fields`` adds best_name, best_short_name and best_size.

    Names are read once: groups by what the name itself says are aggregated and written, the season that a download
    has follows from these few rows, and groups without a season are merged into it from their maxima.
    """
    parts = named_parts(files).filter(~F.col("kind").isin("sample", "") & F.col("item_id").isNotNull())
    rules = {"short_name": usable_text(F.col("short_name")), "size": F.col("size") > 0}
    # Without ``fields`` the two conditions only count for the record.
    if fields:
        rules["name"] = F.lit(True)
    rows = cut(partial(parts, GROUP, "id", rules, "listed_at", trust(F.col("name")) if by_source else None, uncounted=("name",)))
    regular = F.when((F.col("kind") == "episode") & (F.col("season") > 0), F.col("season"))
    seasons = (
        rows.groupBy("item_id")
        .agg(F.min(regular).alias("low"), F.max(regular).alias("high"))
        .filter(F.col("low") == F.col("high"))
        .select(F.col("item_id").alias("__item"), F.col("low").alias("only"))
    )
    bare = rows.filter("kind = 'episode' and season is null").join(seasons, F.col("item_id") == F.col("__item"), "left").withColumn("season", F.col("only"))
    whole = rows.filter("kind <> 'episode' or season is not null").unionByName(bare.select(*rows.columns))
    return merged(whole, GROUP, "id", list(rules) if fields else [])
