"""Rows that grow in the next step are dealt to tasks by what they become."""

from pyspark.sql import functions as F

from polislake.operators import link as L
from polislake.operators.versions import Versions
from polislake.sources.store import dealt
from polislake.streaming import ingest as I


def test_tasks_grow_with_the_rows_and_their_size(spark):
    rows = spark.range(1000).coalesce(1)
    cores = spark.sparkContext.defaultParallelism
    assert dealt(rows, "id").rdd.getNumPartitions() == cores
    assert dealt(rows, "id", each=10).rdd.getNumPartitions() == 101
    assert dealt(rows, "id", size="id", each=1000).rdd.getNumPartitions() == 500
    assert dealt(rows.limit(0), "id").count() == 0
    assert sorted(r["id"] for r in dealt(rows, "id", each=10).collect()) == list(range(1000))


def test_keywords_of_few_texts_are_counted_by_more_tasks(spark, monkeypatch):
    monkeypatch.setattr(L, "TEXT_BYTES", 200)
    texts = spark.createDataFrame([(i % 40, f"water water river{'abcd'[i % 4]} river{'abcd'[i % 4]}") for i in range(60)] + [(None, "lake lake"), (None, None)], "id int, text string").coalesce(1)
    found = L.frequent_keywords(texts)
    assert found.rdd.getNumPartitions() > spark.sparkContext.defaultParallelism
    got = {(r["id"], r["rank"]): (r["keyword"], r["n"]) for r in found.collect()}
    assert len({k[0] for k in got}) == 41 and got[0, 1] == ("water", 4) and got[39, 1] == ("water", 2) and got[None, 1] == ("lake", 2)


def test_cells_of_a_large_change_get_more_files(spark, tmp_path, monkeypatch):
    from polislake.operators import versions

    monkeypatch.setattr(versions, "FILE_ROWS", 100)
    events = spark.range(200).select(F.col("id").cast("string").alias("contribution_id"), F.lit("t").alias("text"), F.lit(None).cast("string").alias("timestamp"), (F.col("id") % 3).alias("user_id"), *[F.lit(None).cast(t).alias(n) for n, t in (("user_name", "string"), ("post_id", "bigint"), ("post_name", "string"), ("group_id", "bigint"), ("group_name", "string"), ("value", "int"), ("parent_point_id", "bigint"), ("fallacies", "array<struct<type:string,score:double,rationale:string>>"))])
    for batch, most in enumerate((100, 200, 150)):
        I.ingest_batch(events.where(F.col("contribution_id").cast("int") < most), str(tmp_path), "e", batch, buckets=2)
    graph = Versions(spark, f"{tmp_path}/graph")
    rows, want = graph.read().select("s", "p", "o").collect(), I.ingest(events).select("s", "p", "o").distinct().collect()
    assert len(rows) == len(want) and set(rows) == set(want)
    assert graph.manifest()["rows"] == len(want)
