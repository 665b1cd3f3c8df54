"""Search for a part of a word by an index: for each run of GRAM characters, the texts that have it.

index/postings: g, id, field by bucket of g; index/texts: id, field, type, text. A search reads the buckets of its own grams, keeps the texts that have all of them and looks into those
only. A term shorter than a gram is looked for in all texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.grams import grams
from ..functions.terms import TYPE
from .model import instances, values

GRAM = 3


def searched(triples: DataFrame) -> DataFrame:
    """id, field, type, v: what a search looks into: names of typed things, texts of contributions."""
    types = triples.where(F.col("p") == TYPE).select(F.col("s").alias("id"), X.local_name(F.col("o")).alias("type"))
    names = values(triples, "name").select("id", F.col("name").alias("v")).join(types, "id").select("id", F.lit("name").alias("field"), "type", "v")
    texts = values(triples, "text").select("id", F.col("text").alias("v")).join(instances(triples, "contribution"), "id").select("id", F.lit("text").alias("field"), F.lit("Contribution").alias("type"), "v")
    return names.unionByName(texts).distinct()


def write_index(triples: DataFrame, path: str, buckets: int = 64) -> None:
    """Buckets are a number that fits the vocabulary: all texts of a gram are in one."""
    rows = searched(triples).withColumn("own", F.pmod(F.xxhash64("id"), F.lit(buckets)).cast("int"))
    rows.repartition("own").write.mode("overwrite").partitionBy("own").parquet(f"{path}/texts")
    held = triples.sparkSession.read.parquet(f"{path}/texts")
    keyed = held.select("id", "own", F.explode(grams(F.lower("v"), GRAM)).alias("g")).distinct().withColumn("bucket", F.pmod(F.xxhash64("g"), F.lit(buckets)).cast("int"))
    # A frequent gram goes to several tasks, by its texts.
    keyed.repartition("bucket", F.pmod(F.xxhash64("id"), F.lit(8))).sortWithinPartitions("g").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/postings")
    triples.sparkSession.createDataFrame([(buckets,)], "buckets int").coalesce(1).write.mode("overwrite").json(f"{path}/about")


def candidates(spark: SparkSession, path: str, words: str) -> DataFrame | None:
    """id, own of the texts that have every gram of a term; null for a term without grams."""
    wanted = sorted({words[i : i + GRAM] for i in range(len(words) - GRAM + 1)})
    if not wanted:
        return None
    buckets = spark.read.json(f"{path}/about").first()["buckets"]
    terms = spark.createDataFrame([(w,) for w in wanted], "g string").select(F.pmod(F.xxhash64("g"), F.lit(buckets)).cast("int").alias("b"))
    near = sorted({r["b"] for r in terms.collect()})
    postings = spark.read.parquet(f"{path}/postings").where(F.col("bucket").isin(near) & F.col("g").isin(wanted))
    return postings.groupBy("id", "own").agg(F.count_distinct("g").alias("n")).where(F.col("n") == len(wanted)).select("id", "own")


def search(spark: SparkSession, path: str, words: str, limit: int | None = 50) -> DataFrame:
    """id, type, text (200 characters and ... if longer) of what holds `words`, as analytics.search finds it in the graph."""
    if not words.strip():
        raise ValueError("the search term is empty")
    low = words.lower()
    texts, near = spark.read.parquet(f"{path}/texts"), candidates(spark, path, low)
    if near is not None:
        texts = texts.join(near, ["own", "id"], "left_semi")
    found = texts.where(F.lower("v").contains(low)).select("id", "type", X.shorten(F.col("v"), 200).alias("text")).distinct().orderBy("id", "type", "text")
    return found.limit(limit) if limit is not None else found
