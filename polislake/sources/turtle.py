"""Turtle files of any size, read in splits.

Lines are read where their splits are. A line that ends with a full stop outside a long string ends a statement; whether it is outside is the parity of the long-string marks before it: counted in
each split, summed over the splits before it in the file (a row a split). Statements are numbered the same way, gathered from their lines and parsed on their own, after the prefixes of
their file, which a pass over the lines collects. Statements that end unseen are parsed together with the next, so an end too few does no harm; a file of which a statement cannot be parsed, that binds a prefix
twice or has a base, is read as a whole.

Blank nodes belong to their file; those without a label are named by their statement."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.terms import TRIPLE_COLUMNS, TRIPLE_SCHEMA
from .rdf import parse_turtle, read_whole
from .store import written

#: Rows of files or splits that are broadcast.
SMALL = 100_000
PREFIX = r"(?i)^\s*@?prefix\s+([\w.-]*:)\s*(<[^>]*>)"
REMARK = r"""\s#[^"'<>]*$"""
BASE = r"(?i)^\s*@?base\s+<"


def _sized(df: DataFrame, tag: str) -> DataFrame:
    out, _ = written(df, tag)
    return F.broadcast(out) if out.count() <= SMALL else out


def _before(lines: DataFrame, count: Column, name: str) -> DataFrame:
    """lines with `name`: the sum of `count` over the lines before in the file, by two levels."""
    inside = Window.partitionBy("path", "block").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    own = lines.withColumn("own", F.coalesce(F.sum(count).over(inside), F.lit(0)))
    splits = lines.groupBy("path", "block").agg(F.sum(count).alias("n"))
    ahead = Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    base = _sized(splits.select("path", "block", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("base")), "splits")
    return own.join(base, ["path", "block"]).withColumn(name, F.col("base") + F.col("own")).drop("base", "own")


def statements(spark: SparkSession, path: str) -> DataFrame:
    """path, file, statement, text (of one or more whole statements)."""
    scan = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_name").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("run"))
    lines, _ = written(scan, "lines")  # numbered once
    comment = F.ltrim("value").startswith("#")
    marks = F.when(comment, 0).otherwise((F.length("value") - F.length(F.replace("value", F.lit('"""')))) / 3).cast("long")
    lines = _before(lines, marks, "marks")
    said = F.rtrim(F.regexp_replace("value", REMARK, ""))
    ends = (~comment & ((F.col("marks") + marks) % 2 == 0) & said.endswith(".")).cast("long")
    numbered = _before(written(lines.withColumn("ends", ends), "lines")[0], F.col("ends"), "statement")
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", "run", "value"))), lambda x: x["value"]), "\n")
    return numbered.groupBy("path", "file", "statement").agg(whole.alias("text"))


def _parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    names = [c.split()[0] for c in TRIPLE_SCHEMA.split(", ")]
    for b in batches:
        out = []
        for where, file, n, text, head in zip(b["path"], b["file"], b["statement"], b["text"], b["head"], strict=True):
            tell = lambda v, k, file=file, n=n: v if k != "bnode" else f"{file}_{f's{n}_' if v.startswith('genid') else ''}{v}"
            try:
                rows = list(parse_turtle(f"{head or ''}\n{text}"))
            except Exception:  # noqa: BLE001  the file is read as a whole, which tells what is wrong with it
                out.append([None] * len(names) + [where])
                continue
            out += [[tell(r[0], r[1]), r[1], r[2], tell(r[3], r[4]), *r[4:7], file, None] for r in rows]
        yield pd.DataFrame(out, columns=[*names, "problem"])


def read_turtle(spark: SparkSession, path: str) -> DataFrame:
    """The triples of Turtle files, as a set."""
    found, _ = written(statements(spark, path), "statements")
    lines = found.select("path", F.explode(F.split("text", "\n")).alias("line"))
    bound = lines.where(F.col("line").rlike(PREFIX)).select("path", F.regexp_extract("line", PREFIX, 1).alias("name"), F.regexp_extract("line", PREFIX, 2).alias("to")).distinct()
    twice = bound.groupBy("path", "name").count().where("count > 1").select("path").unionByName(lines.where(F.col("line").rlike(BASE)).select("path")).distinct()
    heads = bound.groupBy("path").agg(F.array_join(F.array_sort(F.collect_list(F.concat(F.lit("@prefix "), "name", F.lit(" "), "to", F.lit(" .")))), "\n").alias("head"))
    plain = found.join(_sized(twice, "whole"), "path", "left_anti").join(_sized(heads, "heads"), "path", "left")
    parsed, _ = written(plain.select("path", "file", "statement", "text", "head").mapInPandas(_parse, f"{TRIPLE_SCHEMA}, problem string"), "parsed")
    bad = [r["path"] for r in twice.unionByName(parsed.where("problem IS NOT NULL").select(F.col("problem").alias("path"))).distinct().collect()]  # names of files
    fine = parsed.where("problem IS NULL").drop("problem")
    good = fine if not bad else fine.join(F.broadcast(spark.createDataFrame([(x,) for x in bad], "problem string").join(found.select("path", "file").distinct(), F.col("problem") == F.col("path")).select(F.col("file").alias("src"))), "src", "left_anti")
    out = good.select([c.split()[0] for c in TRIPLE_SCHEMA.split(", ")])
    for x in bad:
        out = out.unionByName(read_whole(spark, x, "turtle"))
    return out.dropDuplicates(list(TRIPLE_COLUMNS))
