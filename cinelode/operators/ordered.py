"""Running values over the lines of an episode without one task for an episode.

Lines are windowed within time buckets, and what earlier buckets leave behind is carried in from one row
for each bucket. So an episode that holds a third of all lines is spread over its buckets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Width of a time bucket in milliseconds.
BUCKET_MS = 300_000


def running(df: DataFrame, keys: list[str], inclusive: bool, bucket_ms: int = BUCKET_MS, **wanted: tuple[str, Column]) -> DataFrame:
    """``df`` with a running value for each of ``wanted``: ("last" | "max" | "sum", expression), in the order (st, id) within ``keys``.

    ``last`` is the latest value that isn't NULL. Not ``inclusive`` means that a row doesn't count itself; then the first row has NULL (a sum 0).
    NULL keys are keys; rows that tie in (st, id) are in any order.
    """
    names = [f"__v{i}" for i in range(len(wanted))]
    rows = df.withColumns({"__bucket": F.floor(F.col("st") / bucket_ms)} | {v: e for v, (_, e) in zip(names, wanted.values(), strict=True)})
    inside = W.partitionBy(*keys, "__bucket").orderBy("st", "id").rowsBetween(W.unboundedPreceding, 0 if inclusive else -1)

    def of(kind: str, c: Column) -> Column:
        return F.max(c) if kind == "max" else F.sum(c) if kind == "sum" else F.last(c, ignorenulls=True)

    def of_bucket(kind: str, v: str) -> Column:
        return F.max(F.when(F.col(v).isNotNull(), F.struct("st", "id", v)))[v] if kind == "last" else of(kind, F.col(v))

    kinds = [k for k, _ in wanted.values()]
    sums = rows.groupBy(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)], F.col("__bucket").alias("__b")).agg(*[of_bucket(k, v).alias(f"{v}b") for k, v in zip(kinds, names, strict=True)])
    moved = W.partitionBy(*[f"__k{i}" for i in range(len(keys))]).orderBy("__b").rowsBetween(W.unboundedPreceding, -1)
    carried = sums.select(*[f"__k{i}" for i in range(len(keys))], "__b", *[of(k, F.col(f"{v}b")).over(moved).alias(f"{v}c") for k, v in zip(kinds, names, strict=True)])
    same = F.col("__bucket") == F.col("__b")
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"__k{i}"))
    both = rows.join(carried, same)
    out = {}
    for name, kind, v in zip(wanted, kinds, names, strict=True):
        own, before = of(kind, F.col(v)).over(inside), F.col(f"{v}c")
        out[name] = F.coalesce(own, before) if kind == "last" else F.greatest(own, before) if kind == "max" else F.coalesce(own, F.lit(0)) + F.coalesce(before, F.lit(0))
    return both.withColumns(out).select(*df.columns, *wanted)


def islands(df: DataFrame, keys: list[str], apart: Column, end: str = "en", bucket_ms: int = 60_000) -> DataFrame:
    """``df`` with ``island``: the number of the stretch that a line lies in, from 0 within ``keys``.

    A new stretch begins with a time bucket whose first start is ``apart`` (an expression of ``st`` and ``reach``, the latest end of all earlier
    buckets, that holds for every later start too). Stretches are independent for every operator that looks no farther back than that allows. Only one
    row of each bucket is put in order.
    """
    rows = df.withColumn("__bucket", F.floor(F.col("st") / bucket_ms))
    names = [f"__k{i}" for i in range(len(keys))]
    one = rows.groupBy(*[F.col(k).alias(n) for k, n in zip(keys, names, strict=True)], F.col("__bucket").alias("__b")).agg(F.min("st").alias("st"), F.max(end).alias("__end"))
    order = W.partitionBy(*names).orderBy("__b")
    begins = F.coalesce(apart, F.lit(False)).cast("int")
    one = one.withColumn("reach", F.max("__end").over(order.rowsBetween(W.unboundedPreceding, -1)))
    one = one.withColumn("island", F.sum(begins).over(order.rowsBetween(W.unboundedPreceding, 0))).select(*names, "__b", "island")
    same = F.col("__bucket") == F.col("__b")
    for k, n in zip(keys, names, strict=True):
        same = same & F.col(k).eqNullSafe(F.col(n))
    return rows.join(one, same).select(*df.columns, "island")


def following(points: DataFrame, key: str, starts: DataFrame, bucket_ms: int = BUCKET_MS) -> DataFrame:
    """(key, id, nxt): the first start at or after each point, NULL if none follows. points: key, id, at; starts: key, at.

    Points and starts are laid on one axis and read backwards within buckets; a bucket whose starts are used up takes the first of a later one.
    """
    axis = starts.select(key, "at", F.lit(None).cast("long").alias("id"), F.lit(1).alias("is_start")).unionByName(points.select(key, "at", "id", F.lit(0).alias("is_start")))
    axis = axis.withColumn("__bucket", F.floor(F.col("at") / bucket_ms))
    first = axis.groupBy(F.col(key).alias("__k"), F.col("__bucket").alias("__b")).agg(F.min(F.when(F.col("is_start") == 1, F.col("at"))).alias("first"))
    later = W.partitionBy("__k").orderBy(F.desc("__b")).rowsBetween(W.unboundedPreceding, -1)
    first = first.withColumn("__later", F.min("first").over(later)).drop("first")
    # A start at the point's own moment follows it.
    ahead = W.partitionBy(key, "__bucket").orderBy(F.desc("at"), F.desc("is_start")).rowsBetween(W.unboundedPreceding, -1)
    joined = axis.join(first, F.col(key).eqNullSafe(F.col("__k")) & (F.col("__bucket") == F.col("__b")))
    return joined.withColumn("nxt", F.coalesce(F.last(F.when(F.col("is_start") == 1, F.col("at")), ignorenulls=True).over(ahead), "__later")).filter("is_start = 0").select(key, "id", "nxt")


def neighbours(df: DataFrame, keys: list[str], value: Column, before: int, after: int, block: int = 1000) -> DataFrame:
    """``df`` with ``before`` and ``after``: arrays of ``value`` of so many rows before and after each, in the order (st, id).

    Rows are numbered, cut into blocks of their numbers, and each block borrows the rows beside it.
    """
    numbered = running(df.withColumn("__value", value), keys, True, __n=("sum", F.lit(1)))
    own = F.floor((F.col("__n") - 1) / block)
    at = F.col("__n") - 1 - own * block
    blocks = F.array_compact(F.array(own, F.when(at < after, own - 1), F.when(at >= block - before, own + 1)))
    spread = numbered.withColumn("__own", own).withColumn("__block", F.explode(blocks))
    order = W.partitionBy(*keys, "__block").orderBy("__n")
    look = lambda a, b: F.collect_list("__value").over(order.rowsBetween(a, b))
    return spread.withColumns({"before": look(-before, -1), "after": look(1, after)}).filter(F.col("__own") == F.col("__block")).select(*df.columns, "before", "after")
