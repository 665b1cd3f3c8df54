"""From raw documents to sampled subword segmentations: language, near-duplicates, personal data, mixture, SentencePiece.

Each stage reads what its predecessor wrote. All but the last return the columns of documents. Every stage takes nulls in any column, whole texts of any length (memory grows with
the longest), empty tables (an empty result) and extra columns of any name, which all but the last pass on."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from polislake.llm._store import materialize
from polislake.llm.jaccard_join import keep_one
from polislake.llm.language_id import keep_identified
from polislake.llm.mixing import mixed, read_positions
from polislake.llm.pii import pseudonymize
from polislake.llm.queries import PSEUDONYM_KEY
from polislake.llm.sampling import sample_segmentations

#: Segmentations a document of the mix gets.
SAMPLES = 2
#: Bytes of text whose lattices a worker of the last stage holds: little, as executors have grown in the stages before.
TOGETHER = 3 << 17


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the network tells with a score of at least 0.5; null texts and texts without a letter go.
    Repeated rows get equal decisions, and a score of exactly 0.5 stays. A null doc_id trains and is judged like any other."""
    return keep_identified(docs, F.crc32(F.col("doc_id").cast("string")) % 3 != 1)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of five-word shingle sets linked at a Jaccard similarity of 0.8: that with the smallest doc_id (a null one last; of
    rows that tie in id by a hash of the row, of rows equal in id and text any one). Null, empty and blank texts stay: they are like nothing, not even each other."""
    return keep_one(docs, shingle=5, percent=80)


def replace_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with pseudonyms for personal data; n_chars follows the text. Null text stays null; rows are judged one by one, so repeated rows
    stay equal and there are no ties."""
    out = pseudonymize(docs, PSEUDONYM_KEY)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, a row a copy, in training order (ties by doc_id). Texts without words are not taken; a null source is a source;
    repeated rows are copies that the mix counts one by one."""
    return mixed(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """SAMPLES distinct segmentations of each row, sampled without replacement; fewer where a row has fewer, none for a null text. `position` is the row's place in training order, told from the
    files that the mix was written to: ordering by it gives the mix. Copies of a document have places, and so samples, of their own. Rows of a table that was not read from files have no
    place (null); there rows that repeat a doc_id and a text repeat their samples."""
    placed = read_positions(docs)
    place = placed.columns[-1]
    key = F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (place, "doc_id")])
    out = sample_segmentations(placed.select(key.alias("doc_id"), "text"), k=SAMPLES, together=TOGETHER)
    told = lambda value, kind: F.nullif(value, F.lit("")).cast(kind)
    own = told(F.expr("substring(doc_id, locate('|', doc_id) + 1)"), docs.schema["doc_id"].dataType)
    return out.select(own.alias("doc_id"), told(F.substring_index("doc_id", "|", 1), "long").alias("position"), *[c for c in out.columns if c != "doc_id"])


STAGES = [
    ("language ID", identify_language),
    ("n-gram Jaccard join", drop_near_duplicates),
    ("PII", replace_personal_data),
    ("mixing sources to target weights", mix),
    ("SentencePiece encoding and decoding", encode),
]

#: A trained network and sampled segmentations have no SQL; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), "stage")
    return STAGES[-1][1](spark, docs, sf_dir)
