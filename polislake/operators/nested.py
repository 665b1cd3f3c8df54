"""Nested JSON documents of any size: a row of the result is a piece of text, and the pieces in order are the document.

Rows are dealt to ranges by all levels and the order inside them, so a level of any size spreads over tasks. A row opens what it is the first of and closes what it is the last of; it knows
that from its neighbours, and at the ends of a range from the first and last rows of the ranges beside it (a row a range). No list is ever held."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.store import drop, written
from .analytics import contributions


def _json(name: str, value: Column) -> Column:
    """`"name":value` of an object."""
    text = F.to_json(F.struct(value.alias(name)), {"ignoreNullFields": "false"})
    return F.substring(text, F.lit(2), F.length(text) - 2)


def nested_text(rows: DataFrame, levels: list[tuple[str, str]], order: list[str], item: Column) -> tuple[DataFrame, str]:
    """range, place and text of the document's pieces, in order over the tasks, and the folder to drop after use. levels: (column, name of the list below it), outermost first; order: columns that sort the innermost lists."""
    keys = [c for c, _ in levels]
    flat = rows.select(*[F.col(c).alias(f"k{i}") for i, c in enumerate(keys)], *[F.col(c).alias(f"o{i}") for i, c in enumerate(order)], F.to_json(item, {"ignoreNullFields": "false"}).alias("item"))
    by = [f"k{i}" for i in range(len(keys))] + [f"o{i}" for i in range(len(order))] + ["item"]
    # Dealing out by ranges reads its rows twice: they are made once before.
    flat, made = written(flat, "rows")
    dealt, at = written(flat.repartitionByRange(*by).withColumn("range", F.spark_partition_id()), "ranges")
    drop(rows.sparkSession, made)
    inside = Window.partitionBy("range").orderBy(*by)
    me = F.struct(*[f"k{i}" for i in range(len(keys))])
    ends = dealt.groupBy("range").agg(F.min(F.struct(*by)).alias("first"), F.max(F.struct(*by)).alias("last"))  # a row a range
    across = Window.orderBy("range")
    of = lambda end: F.struct(*[F.col(f"{end}.k{i}") for i in range(len(keys))])
    ends = ends.select("range", F.lag(of("last")).over(across).alias("range_before"), F.lead(of("first")).over(across).alias("range_after"))
    beside = dealt.repartitionByRange("range").join(F.broadcast(ends), "range").withColumns({"place": F.row_number().over(inside), "before": F.coalesce(F.lag(me).over(inside), "range_before"), "after": F.coalesce(F.lead(me).over(inside), "range_after")})
    # The first level at which a row differs from a neighbour; len(keys): none.
    differs = lambda other: reduce(lambda rest, i: F.when(F.col(other).isNull() | ~F.col(f"{other}.k{i}").eqNullSafe(F.col(f"k{i}")), F.lit(i)).otherwise(rest), reversed(range(len(keys))), F.lit(len(keys)))
    beside = beside.withColumns({"opens": differs("before"), "closes": differs("after")})
    opening = [F.when(F.col("opens") <= i, F.concat(F.lit("{"), _json(c, F.col(f"k{i}")), F.lit(f',"{below}":['))).otherwise("") for i, (c, below) in enumerate(levels)]
    closing = F.repeat(F.lit("]}"), F.lit(len(keys)) - F.col("closes"))
    start = F.when(F.col("before").isNull(), "[").otherwise(",")
    text = F.concat(start, *opening, F.col("item"), closing, F.when(F.col("after").isNull(), "]").otherwise(""))
    return beside.select("range", "place", text.alias("text")).sortWithinPartitions("range", "place"), at


def write_nested(rows: DataFrame, path: str, levels: list[tuple[str, str]], order: list[str], item: Column) -> None:
    """The document as text files, to be read in the order of their names."""
    pieces, at = nested_text(rows, levels, order, item)
    if rows.sparkSession.read.schema("range int").parquet(at).isEmpty():
        pieces = rows.sparkSession.createDataFrame([(0, 0, "[]")], "range int, place int, text string")
    pieces.select("text").write.mode("overwrite").text(path)
    drop(rows.sparkSession, at)


CONTRIBUTION = ("timestamp", "contribution", "text", "participant")


def write_contributions(triples: DataFrame, path: str) -> None:
    """Platforms, their processes and their contributions in time order, all of them."""
    write_nested(contributions(triples, None, ordered=False), path, [("platform", "processes"), ("process", "contributions")], ["timestamp", "contribution"], F.struct(*CONTRIBUTION))


def write_fallacy_report(contribution: DataFrame, fallacies: DataFrame, path: str) -> None:
    """Processes, their contributions with fallacies and what was found in each. contribution: id, process, participant, text; fallacies: contribution, type, segment, confidence."""
    found = fallacies.select(F.col("contribution").alias("id"), "type", "segment", "confidence").join(contribution.select("id", "process", "participant", "text"), "id")
    write_nested(found, path, [("process", "contributions"), ("id", "fallacies")], ["type", "segment", "confidence"], F.struct("type", "segment", "confidence", "participant", "text"))
