"""Character grams as keys of substring joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def grams(text: Column, k: int) -> Column:
    """The distinct runs of k characters of a text; none if it is shorter."""
    starts = F.when(F.length(text) >= k, F.sequence(F.lit(1), F.length(text) - (k - 1))).otherwise(F.array().cast("array<int>"))
    return F.array_distinct(F.transform(starts, lambda i: F.substring(text, i, F.lit(k))))


def contained_between(inner: DataFrame, outer: DataFrame, k: int = 3) -> DataFrame:
    """(x, y): x of `inner` is contained in y of `outer`. Both have one column n, distinct and not null.

    A y that contains x has each gram of x, so also the one that the fewest of `outer` have: that one is the key. Texts shorter than a gram are keys themselves. The empty text
    is in all; that is one row at most, and its pairs are part of the result."""
    y = outer.select(F.col("n").alias("y"))
    keyed = y.select("y", F.explode(grams(F.col("y"), k)).alias("g"))
    held = keyed.groupBy("g").agg(F.count(F.lit(1)).alias("df"))
    own = inner.where(F.length("n") >= k).select(F.col("n").alias("x"), F.explode(grams(F.col("n"), k)).alias("g"))
    rarest = own.join(held, "g", "left").groupBy("x").agg(F.min_by("g", F.struct(F.coalesce("df", F.lit(0)), "g")).alias("g"))
    found = rarest.join(keyed, "g").where(F.col("y").contains(F.col("x"))).select("x", "y")
    for short in range(1, k):
        x = inner.where(F.length("n") == short).select(F.col("n").alias("x"))
        found = found.unionByName(x.join(y.select("y", F.explode(grams(F.col("y"), short)).alias("x")), "x").select("x", "y"))
    empty = inner.where(F.col("n") == "").select(F.col("n").alias("x"))
    return found.unionByName(y.join(F.broadcast(empty), F.col("y").startswith(F.col("x"))).select("x", "y"))
