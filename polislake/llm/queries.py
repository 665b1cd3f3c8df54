"""The queries opN_<name> and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ball_kmeans, bm25_search, divergence, exact_dedup, jaccard_join, mixing, quality_rules, substring_dedup, warc


#: A deployment takes its own from where it keeps its secrets.
PSEUDONYM_KEY = "polislake test key"


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality_rules(_documents(spark, sf_dir))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .language_id import identify

    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))  # a null id is not held out
    return identify(_documents(spark, sf_dir), ~held_out).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op3_archive_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .warc import archive_pages, read_warc

    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return read_warc(spark, archive_pages(pages), with_payload=False).drop("payload")


def op4_lattice_likelihood(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .lattice_lm import score_texts

    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 10 == 0, F.lit(False))
    scored = score_texts(_documents(spark, sf_dir), ~held_out)
    return scored.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score", "lattice_score")


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .substring_dedup import remove_repeats

    return remove_repeats(_documents(spark, sf_dir), with_text=False).drop("kept_text")


def op6_bm25_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .bm25_search import search

    return search(_documents(spark, sf_dir), F.col("doc_id") % 100 == 0)


def op7_sample_segmentations(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sampling import sample_segmentations

    return sample_segmentations(_documents(spark, sf_dir))


def op8_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import mix_plan

    plan = mix_plan(_documents(spark, sf_dir))
    digest = plan.select(
        "doc_id", "size", "source_size", "target", "taken", F.size("copies").alias("n_copies"), F.when(F.size("copies") > 0, F.col("copies")[0]["position"]).alias("first_position")
    )
    return digest.orderBy(F.col("first_position").asc_nulls_last(), "doc_id")


def op9_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pii import pseudonymize

    return pseudonymize(_documents(spark, sf_dir).select("doc_id", "text"), key=PSEUDONYM_KEY, count="n_pseudonyms")


def op10_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .jaccard_join import jaccard_components

    return jaccard_components(_documents(spark, sf_dir)).select("doc_id", "n_shingles", "component_id")


def op11_ball_kmeans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ball_kmeans.ball_kmeans(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.source_divergence(_documents(spark, sf_dir))


def op13_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_copies(_documents(spark, sf_dir))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, f in globals().items() if k.startswith("op") and k[2].isdigit()}


def oracle_sql() -> dict[str, str]:
    return {
        "op1_quality_rules": quality_rules.ORACLE_SQL,
        "op3_archive_pages": warc.ORACLE_SQL,
        "op5_substring_dedup": substring_dedup.ORACLE_SQL,
        "op6_bm25_search": bm25_search.ORACLE_SQL,
        "op8_mix_sources": mixing.ORACLE_SQL,
        "op10_ngram_jaccard_join": jaccard_join.ORACLE_SQL,
        "op11_ball_kmeans": ball_kmeans.ORACLE_SQL,
        "op12_source_divergence": divergence.ORACLE_SQL,
        "op13_exact_dedup": exact_dedup.ORACLE_SQL,
    }
