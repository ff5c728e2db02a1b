"""First-wins, best-of and queue operators with a stated order on ties."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def latest_by(df: DataFrame, key: list[str], at: str, columns: list[str]) -> DataFrame:
    """One row for each key, that with the latest ``at`` (NULL earliest), ties by the largest ``columns``.

    One aggregation with partial maxima (by sorting, as the structs hold strings); repeats collapse, NULL keys are one group.
    """
    m = df.groupBy(*key).agg(F.max(F.struct(at, *columns)).alias("__m"))
    return m.select(*key, *[F.col(f"__m.{c}").alias(c) for c in (at, *columns)])


#: Sketch accuracy of the bracket around a median: it holds about four in so many of a key's values.
BRACKET = 10_000


def medians(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys, median, n): the exact median of each key's values (the mean of the middle two), NULLs and NaNs left out.

    A mergeable sketch brackets the middle, with its rank error on both sides. Values below the bracket are only counted; those within it
    are counted by value before the shuffle and ranked. So neither a hot key nor one over all rows is sorted in one task. No ``keys`` give one row.
    """
    keys_ = keys or ["__all"]
    v = (df if keys else df.withColumn("__all", F.lit(0))).select(*keys_, F.col(value).cast("double").alias("__x")).filter(F.col("__x").isNotNull() & ~F.isnan("__x"))
    edge = 2.0 / BRACKET
    low_high = F.percentile_approx("__x", [0.5 - edge, 0.5 + edge], BRACKET)
    around = v.groupBy(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys_)]).agg(F.count(F.lit(1)).alias("n"), low_high.alias("__b"))
    same = F.lit(True)
    for i, k in enumerate(keys_):
        same = same & F.col(k).eqNullSafe(F.col(f"__k{i}"))
    near = v.join(around if keys else F.broadcast(around), same).filter(F.col("__x") <= F.get("__b", 1))
    below = F.col("__x") < F.get("__b", 0)
    counted = near.groupBy(*keys_, "n", F.when(~below, F.col("__x")).alias("__x")).agg(F.count(F.lit(1)).alias("__c"))
    upto = W.partitionBy(*keys_).orderBy(F.asc_nulls_first("__x")).rowsBetween(W.unboundedPreceding, 0)
    placed_ = counted.withColumn("__to", F.sum("__c").over(upto))
    holds = lambda at: (F.col("__to") > at) & (F.col("__to") - F.col("__c") <= at)
    left, right = F.expr("(n - 1) div 2"), F.expr("n div 2")
    middle = (F.max(F.when(holds(left), F.col("__x"))) + F.max(F.when(holds(right), F.col("__x")))) / 2
    return placed_.groupBy(*keys_, "n").agg(middle.alias("median")).select(*keys, "median", "n")


def extreme(df: DataFrame, key: list[str], order: list[tuple[str, bool]], keep: list[str], **more: Column) -> DataFrame:
    """The first row of each key in a numeric order, as one aggregation: (column, descending) pairs of numbers.

    Numbers are turned so that the smallest struct wins, with NULL last; pre-aggregated before the shuffle,
    so a hot key costs no more than any other. ``more`` are further aggregates.
    """
    turned = []
    for i, (c, down) in enumerate(order):
        turned += [F.col(c).isNull().alias(f"n{i}"), (-F.col(c) if down else F.col(c)).alias(f"v{i}")]
    m = df.groupBy(*key).agg(F.min(F.struct(*turned, F.struct(*keep).alias("keep"))).alias("__m"), *[a.alias(n) for n, a in more.items()])
    return m.select(*key, *[F.col(f"__m.keep.{c}").alias(c) for c in keep], *more)


def queue_take(queue: DataFrame, held: DataFrame, key: str, order: str, slots: int) -> DataFrame:
    """Rows of a queue that aren't held yet, in order, with ``sent``: whether they fit the free slots."""
    waiting = queue.join(held.select(key).distinct(), key, "left_anti")
    top = waiting.orderBy(order).limit(max(slots, 0)).select(F.col(order).alias("__o"))
    return waiting.join(F.broadcast(top), F.col(order) == F.col("__o"), "left").withColumn("sent", F.col("__o").isNotNull()).drop("__o")


def placed(df: DataFrame, score: str, unique: str) -> DataFrame:
    """All rows with ``place``: 1 is the highest ``score``, ties by ``unique``; a NULL score comes last.

    Made for scores of few values: rows above are summed over one row for each value, and only the rows of one value are sorted together.
    """
    n = df.groupBy(F.col(score).alias("__s")).agg(F.count(F.lit(1)).alias("__n"))
    above = W.orderBy(F.desc_nulls_last("__s")).rowsBetween(W.unboundedPreceding, -1)
    n = n.select("__s", F.coalesce(F.sum("__n").over(above), F.lit(0)).alias("__above"))
    own = F.row_number().over(W.partitionBy(score).orderBy(unique))
    return df.join(n, F.col(score).eqNullSafe(F.col("__s"))).withColumn("place", F.col("__above") + own).drop("__s", "__above")


def pick(ranked: DataFrame, n: int, listed: int = 10) -> DataFrame:
    """The row at place ``n`` with ``error`` NULL; if there is none, one row that holds only an error, naming the places that a list shows."""
    there = ranked.agg(F.count(F.lit(1)).alias("__n"))  # one row
    hit = there.join(ranked.filter(F.col("place") == n), F.lit(True), "left")
    error = F.when(F.col("__n") == 0, "no results").when(F.col("place").isNull(), F.concat(F.lit("pick 1-"), F.least("__n", F.lit(listed)).cast("string")))
    return hit.withColumn("error", error).drop("__n")
