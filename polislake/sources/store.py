"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MOST_TASKS = 100_000
#: Rows that are broadcast.
FEW = 100_000


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where none is named, a folder of our own in local mode, an error on a cluster."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    context = spark.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        if context.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir names no folder that all executors share")
        context.setCheckpointDir(f"file://{tempfile.mkdtemp(prefix='polislake-')}")
    return context._jsc.sc().getCheckpointDir().get().rstrip("/")


def written(df: DataFrame, tag: str) -> tuple[DataFrame, str]:
    """`df` as a table of the shared folder, and where it is: its lineage ends there, and a lost executor costs no more than a read."""
    path = f"{shared_dir(df.sparkSession)}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def few(df: DataFrame, tag: str) -> DataFrame:
    """`df` as a table of the shared folder, to be broadcast if it has no more than FEW rows: its few keys would else deal a large table to as few tasks."""
    table, _ = written(df, tag)
    return F.broadcast(table) if table.count() <= FEW else table


def dealt(df: DataFrame, *keys: str, size: str = "1", each: int = 100_000) -> DataFrame:
    """`df` dealt out by `keys` to so many tasks that one has about `each` of `size` (an expression, summed over the rows). For rows that get many more or longer in the next step: splits of files
    and shuffles are as large as what is read, not as what is made of it."""
    total = df.agg(F.sum(F.expr(size)).cast("double")).first()[0] or 0
    return df.repartition(int(min(MOST_TASKS, max(df.sparkSession.sparkContext.defaultParallelism, total // each + 1))), *keys)


def drop(spark: SparkSession, *paths: str) -> None:
    for path in paths:
        target = spark._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def measured_joins(spark: SparkSession) -> None:
    """Joins of the session broadcast a side by its size once it is there. A scan's estimate is of its compressed files and a few of their columns, and tells nothing of the texts made of them:
    by it, a driver would gather tables that grow."""
    static, adaptive = "spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"
    if spark.conf.get("spark.sql.adaptive.enabled") == "true" and spark.conf.get(static) != "-1":
        if spark.conf.get(adaptive, None) is None:
            spark.conf.set(adaptive, spark.conf.get(static))
        spark.conf.set(static, "-1")
