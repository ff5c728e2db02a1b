"""First N rows of every group by a global range-partitioned sort.

The rows are range-partitioned and sorted on (group, ranking), so a group of any size is
spread over as many partitions as it needs. Each partition counts its groups and
keeps at most N rows of each; the counts of earlier partitions, prefix-summed by group,
turn the places within a partition into exact places, and those up to N stay.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from cinelode.session import parallelism


def latest(df: DataFrame, key: str, at: str, columns: list[str]) -> DataFrame:
    """One row for each ``key``: that with the latest ``at`` (NULL is earliest).

    Rows that also tie in ``at`` are decided by the largest values of ``columns`` in that
    order, so the result does not depend on row order. It is a hash aggregation with
    partial aggregation; NULL keys are one group.
    """
    packed = F.max(F.struct(F.col(at), *[F.col(c) for c in columns])).alias("__m")
    return df.groupBy(key).agg(packed).select(key, *[F.col(f"__m.{c}").alias(c) for c in columns])


def number(c: str) -> Column:
    """A double with NaN as NULL and one zero."""
    x = F.col(c).cast("double")
    return F.when(F.isnan(x), None).otherwise(x + F.lit(0.0))


def top_n(df: DataFrame, group: str, ranking: list[Column], n: int, keep: list[str], partitions: int | None = None) -> DataFrame:
    """The up to ``n`` first rows of each group with ``place`` from 1.

    ``ranking`` must end in a column that is unique within a group, else equal rows
    are placed in any order. Rows without a group are dropped. Result: group, place, keep.
    """
    spark = df.sparkSession
    parts = partitions or parallelism(spark)
    keep = [c for c in keep if c != group]
    by = [F.col(group).asc(), *ranking]
    ranked = df.filter(F.col(group).isNotNull()).repartitionByRange(parts, *by).sortWithinPartitions(*by)
    ranked = ranked.select(F.spark_partition_id().alias("__part"), group, *keep)
    out = T.StructType([*ranked.schema.fields, T.StructField("__local", T.LongType()), T.StructField("__count", T.LongType())])
    arrow = to_arrow_schema(out)

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # The batches of a partition come in its order. Of a group, rows up to place n
        # go out at once; its full count follows on a row of its own with no place.
        current, seen, part = None, 0, None
        empty = lambda name: pa.nulls(1, arrow.field(name).type)

        def total() -> pa.RecordBatch:
            one = {"__part": pa.array([part], arrow.field("__part").type), group: pa.array([current], arrow.field(group).type), "__count": pa.array([seen], pa.int64())}
            return pa.RecordBatch.from_arrays([one.get(f.name, empty(f.name)) for f in arrow], schema=arrow)

        for b in batches:
            if not b.num_rows:
                continue
            part = b.column("__part")[0].as_py()
            g = b.column(group)
            codes = g.dictionary_encode().indices.to_numpy(zero_copy_only=False)
            new = np.flatnonzero(np.r_[True, codes[1:] != codes[:-1]])
            size = np.diff(np.r_[new, b.num_rows])
            first = g[0].as_py()
            if current is not None and first != current:
                yield total()
                seen = 0
            carried = seen if first == current else 0
            local = np.arange(b.num_rows) - np.repeat(new, size) + 1
            local[: size[0]] += carried
            counts = size.copy()
            counts[0] += carried
            # Groups that end within this batch are counted on their last row.
            ends = new + size - 1
            count = np.full(b.num_rows, -1, dtype=np.int64)
            count[ends[:-1]] = counts[:-1]
            stay = (local <= n) | (count >= 0)
            place = pa.array(local, pa.int64(), mask=local > n)
            rows = pa.RecordBatch.from_arrays([*b.columns, place, pa.array(count, pa.int64(), mask=count < 0)], schema=arrow)
            yield rows.filter(pa.array(stay))
            current, seen = g[b.num_rows - 1].as_py(), int(counts[-1])
        if current is not None:
            yield total()

    local = ranked.mapInArrow(places, out)
    # At most n + 1 rows of a group and partition are left here.
    earlier = W.partitionBy(group).orderBy("__part").rangeBetween(W.unboundedPreceding, -1)
    return (
        local.withColumn("__before", F.coalesce(F.sum("__count").over(earlier), F.lit(0)))
        .withColumn("place", (F.col("__before") + F.col("__local")).cast("int"))
        .filter(F.col("__local").isNotNull() & (F.col("place") <= n))
        .select(group, "place", *keep)
    )
