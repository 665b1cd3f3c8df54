"""Shared storage for intermediate tables: the folder named in spark.checkpoint.dir."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor sees. Where the session names none, a folder of our own in local mode (tests), an error on a cluster."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    own = spark.sparkContext._jsc.sc().getCheckpointDir()
    if own.isDefined():
        return own.get().rstrip("/")
    if spark.sparkContext.master.split("[")[0] != "local":
        raise ValueError("spark.checkpoint.dir names no folder that all executors share")
    spark.sparkContext.setCheckpointDir(f"file://{tempfile.mkdtemp(prefix='polislake-')}")
    return spark.sparkContext._jsc.sc().getCheckpointDir().get().rstrip("/")


def new_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, tag: str, **options: str) -> DataFrame:
    """Writes `df` once to the shared folder and reads it back: cuts lineage and survives a lost executor. options: of the Parquet writer."""
    path = new_path(df.sparkSession, tag)
    df.write.options(**options).parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def release(*tables: DataFrame) -> None:
    """Deletes what materialize() or bucketed() wrote for these tables; they must not be read again."""
    for df in tables:
        path = getattr(df, "_stored_at", None)
        if path:
            remove(df.sparkSession, path)
        name = getattr(df, "_stored_as", None)
        if name:
            df.sparkSession.sql(f"DROP TABLE IF EXISTS {name}")


def remove(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def free_shuffles(spark: SparkSession) -> None:
    """Lets the context cleaner drop the shuffle files of finished plans, which else stay on the executors' disks until the driver collects its garbage."""
    spark._jvm.System.gc()


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def fresh(columns: list[str], name: str) -> str:
    """`name`, or a longer name that no column has (Spark's names ignore case)."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def modest_batches(spark: SparkSession, rows: int = 2000) -> None:
    """Arrow batches of at most `rows` rows: workers that keep tables of their own have less room for long texts."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(name)) > rows:
        spark.conf.set(name, str(rows))


def bucketed(df: DataFrame, tag: str, key: str, buckets: int) -> DataFrame:
    """Writes `df` to the shared warehouse in buckets of `key`, so that grouping by it moves no rows of this table."""
    name = f"polislake_{tag}_{uuid.uuid4().hex}"
    df.write.bucketBy(buckets, key).format("parquet").saveAsTable(name)
    out = df.sparkSession.table(name)
    out._stored_as = name
    return out
