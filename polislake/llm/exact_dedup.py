"""Exact dedup: rows are grouped by a 128-bit hash of their text, texts of one hash are told apart by their bytes, one id of each text stays. DataFrame functions only.

Texts move once, to meet those of their hash: tasks merge their own copies before that, so a text that a third of all rows share is a row a task. Everything after that moves
ids and hashes. Texts that at least one row in HOT_SHARE has are at most HOT_SHARE in number, whatever the input: they are broadcast, and their rows meet no other rows of their text.

Null text counts as empty; empty texts are copies of each other. Long texts are hashed and compared whole. Of equal texts the row with the largest (or smallest) id stays; a null id only
if there is no other. Rows that repeat both an id and a text are copies too: exactly one of them stays. An empty table gives an empty result. Only the columns named are read; others
may have any name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._store import materialize, release

HOT_SHARE = 1000


def content_hash(text: Column) -> Column:
    """128 bits."""
    return F.unhex(F.md5(text.cast("binary")))


def unchanged(text: Column) -> Column:
    return text


def _judged(documents: DataFrame, text: str, key: str, keep: str, normal: Callable[[Column], Column], digest: Callable[[Column], Column], whole: bool) -> tuple[DataFrame, DataFrame]:
    """Each row with id, h (hash), keep_id, group_size and sha of its text (and `row`, all its columns, if whole); and a table to release."""
    best = {"largest": F.max, "smallest": F.min}[keep]
    body = normal(F.coalesce(F.col(text), F.lit("")))
    rows = documents.select(*([F.struct("*").alias("row")] if whole else []), F.col(key).alias("id"), body.alias("text")).withColumn("h", digest(F.col("text")))
    carried = [*(["row"] if whole else []), "id", "h"]
    of_text = [F.count(F.lit(1)).alias("group_size"), best("id").alias("keep_id")]
    texts = rows.groupBy("h", "text").agg(*of_text).select("h", "group_size", "keep_id", F.unhex(F.sha2(F.col("text").cast("binary"), 256)).alias("sha"))
    # One row a hash. Where it has one text, hash and text are the same thing.
    hashes = texts.groupBy("h").agg(F.count(F.lit(1)).alias("texts"), F.sum("group_size").alias("group_size"), F.first("keep_id").alias("keep_id"), F.first("sha").alias("sha"))
    hashes = materialize(hashes, "hashes")
    total, most = hashes.agg(F.sum("group_size"), F.max("texts")).first()
    sure = hashes.where("texts = 1").drop("texts")
    hot = F.col("group_size") * HOT_SHARE >= F.lit(total or 0)
    known = sure.where(hot).select("h", *[F.col(c).alias(f"hot_{c}") for c in ("group_size", "keep_id", "sha")])
    near = rows.select(*carried).join(F.broadcast(known), "h", "left")
    # Rows of hot texts are finished and go on spread by their ids; they meet nothing here.
    near = near.withColumn("spread", F.when(F.col("hot_sha").isNull(), F.lit(0)).otherwise(F.xxhash64("id")))
    met = near.join(sure.where(~hot).withColumn("spread", F.lit(0).cast("long")), ["h", "spread"], "left")
    out = met.select(*carried, *[F.coalesce(f"hot_{c}", c).alias(c) for c in ("group_size", "keep_id", "sha")]).where("sha IS NOT NULL")
    if (most or 0) > 1:  # different texts of one hash: their rows find their texts by the bytes
        apart = rows.join(hashes.where("texts > 1").select("h"), "h", "left_semi")
        own = apart.groupBy("h", "text").agg(*of_text).withColumn("sha", F.unhex(F.sha2(F.col("text").cast("binary"), 256)))
        out = out.unionByName(apart.join(own, ["h", "text"]).select(out.columns))
    return out, hashes


def exact_copies(
    documents: DataFrame, text: str = "text", key: str = "doc_id", keep: str = "largest", normal: Callable[[Column], Column] = unchanged, digest: Callable[[Column], Column] = content_hash
) -> DataFrame:
    """One row a row: `key`, keep_id (of the row of that text that stays), group_size, kept, text_sha256. normal: what is done to texts before they are compared."""
    out, hashes = _judged(documents, text, key, keep, normal, digest, whole=False)
    judged = materialize(out, "judged")
    release(hashes)
    end = ["id", "keep_id", "group_size", "kept", "sha"]
    several = F.expr("group_size > 1 AND id <=> keep_id")
    plain = judged.where(~several).withColumn("kept", F.col("group_size") == 1).select(end)
    # Rows with the id that stays: one as a rule; of rows that repeat it, the first counts as kept.
    chosen = judged.where(several).groupBy("h", "id", "keep_id", "group_size", "sha").agg(F.count(F.lit(1)).alias("times"))
    chosen = chosen.withColumn("time", F.explode(F.expr("sequence(1L, times)"))).withColumn("kept", F.col("time") == 1).select(end)
    return plain.unionByName(chosen).select(F.col("id").alias(key), "keep_id", "group_size", "kept", F.lower(F.hex("sha")).alias("text_sha256"))


def drop_exact_copies(
    documents: DataFrame, text: str = "text", key: str = "doc_id", keep: str = "largest", normal: Callable[[Column], Column] = unchanged, digest: Callable[[Column], Column] = content_hash
) -> DataFrame:
    """The rows of `documents` that stay, with all their columns."""
    out, _ = _judged(documents, text, key, keep, normal, digest, whole=True)
    stay = materialize(out.where("id <=> keep_id"), "stay")
    several = stay.where("group_size > 1").dropDuplicates(["h", "sha"])
    return stay.where("group_size = 1").unionByName(several).select("row.*")


ORACLE_SQL = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, row_number() OVER (PARTITION BY coalesce(text, '') ORDER BY doc_id DESC NULLS LAST) = 1 AS kept,
  sha256(coalesce(text, '')) AS text_sha256 FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
"""
