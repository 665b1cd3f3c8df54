"""Connected components of an edge table, in DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._store import free_shuffles, materialize, release


def components(edges: DataFrame) -> DataFrame:
    """node, root (the least node of its component) of each node in `edges` (a, b bigint).

    FastSV: hook roots and nodes to the least grandparent among neighbours, then jump pointers, until nothing changes. Joins read
    written tables on both sides, so that Spark can split a hot root; minima are aggregated before their shuffle."""
    both = materialize(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    parents = materialize(both.select(F.col("a").alias("node")).distinct().select("node", F.col("node").alias("up"), F.col("node").alias("upper")), "parents")
    while True:
        seen = both.join(parents.select(F.col("node").alias("b"), "upper"), "b").groupBy(F.col("a").alias("node")).agg(F.min("upper").alias("near"))
        step = parents.join(seen, "node")
        offers = F.inline(F.array(
            F.struct(F.col("node").alias("at"), F.least("up", "upper", "near").alias("to")), F.struct(F.col("up").alias("at"), F.col("near").alias("to"))
        ))
        hooked = materialize(step.select(offers).groupBy(F.col("at").alias("node")).agg(F.min("to").alias("up")), "hooked")
        jumped = hooked.join(hooked.select(F.col("node").alias("up"), F.col("up").alias("upper")), "up").select("node", "up", "upper")
        after = materialize(jumped, "parents")
        before = parents.select("node", F.col("up").alias("old_up"), F.col("upper").alias("old_upper"))
        moved = after.join(before, "node").where("up <> old_up OR upper <> old_upper").limit(1).count()
        release(hooked, parents)
        free_shuffles(edges.sparkSession)
        parents = after
        if not moved:
            release(both)
            return parents.select("node", F.col("up").alias("root"))
