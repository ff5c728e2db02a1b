"""Session defaults and the shared checkpoint folder."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Rows of text cost more to work on than their bytes suggest: small inputs keep several tasks.
    "spark.sql.adaptive.coalescePartitions.minPartitionSize": "64k",
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    "spark.ui.enabled": "false",
}


def build(master: str = "local[*]", **conf: str) -> SparkSession:
    """A session for tests and local runs; clusters bring their own."""
    builder = SparkSession.builder.master(master)
    for k, v in (DEFAULTS | conf).items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the folder that the cluster names in ``spark.checkpoint.dir``.

    Only where neither that setting nor a folder on the context exists (local
    tests) a folder of this machine is taken, and only for a local master.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is not None:
        return
    named = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        sc.setCheckpointDir(named)
    elif sc.master.startswith("local[") or sc.master == "local":
        sc.setCheckpointDir(os.path.join(tempfile.gettempdir(), "cinelode-checkpoints"))
    else:
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")


_written: list[tuple[str, str]] = []


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the shared folder and go on from there. :func:`release` deletes what was written."""
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    out = df.checkpoint(eager=True)
    file = out._jdf.queryExecution().logical().rdd().getCheckpointFile()
    if file.isDefined():
        _written.append((spark.sparkContext.applicationId, file.get()))
    return out


def release(spark: SparkSession) -> int:
    """Delete the checkpoints of this session's results, which must all have been used; gives their number.

    Results are lazy, so only their user knows when that is. Clusters may instead set
    ``spark.cleaner.referenceTracking.cleanCheckpoints``, as sessions of :func:`build` do.
    """
    app = spark.sparkContext.applicationId
    mine = [f for a, f in _written if a == app]
    for f in mine:
        path = spark._jvm.org.apache.hadoop.fs.Path(f)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    _written[:] = [(a, f) for a, f in _written if a != app]
    return len(mine)


def parallelism(spark: SparkSession) -> int:
    """Partitions that an explicit range partitioning should use."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
