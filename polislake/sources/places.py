"""The place of rows in their files, whatever splits they are read in."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .store import written

#: Splits whose counts are broadcast.
MANY_SPLITS = 100_000


def with_places(scan: DataFrame, name: str = "place") -> DataFrame:
    """A plain scan of files with the number of each row in its file (0, 1, ...).

    A split is read in order, by one task: a row's number in it is its running number less the split's least. The rows of the splits before it in the file, summed by where they begin, are
    added to that. So numbers have no gaps and do not depend on the size of splits."""
    taken = set(scan.columns)
    file, block, run = (next(c for c in (f"{name}_{x}" + "_" * i for i in range(99)) if c not in taken) for x in ("file", "block", "run"))
    rows = scan.select("*", F.col("_metadata.file_path").alias(file), F.col("_metadata.file_block_start").alias(block), F.monotonically_increasing_id().alias(run))
    splits = rows.groupBy(F.col(file).alias("f"), F.col(block).alias("b")).agg(F.count(F.lit(1)).alias("n"), F.min(run).alias("first"))
    before = Window.partitionBy("f").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    base = splits.select("f", "b", (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("first")).alias("base"))
    base, _ = written(base, "splits")
    base = F.broadcast(base) if base.count() <= MANY_SPLITS else base
    return rows.join(base, (F.col(file) == F.col("f")) & (F.col(block) == F.col("b"))).select(*scan.columns, (F.col("base") + F.col(run)).alias(name))
