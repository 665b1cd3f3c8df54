"""Cases of the third review: each failed, or grew faster than its input, before."""

import random

from pyspark.sql import functions as F

from polislake.operators import link as L
from polislake.sources.adapters import madrid, read_json
from polislake.sources.store import measured_joins


def test_contained_names_match_brute_force(spark):
    draw = random.Random(3)
    texts = {"".join(draw.choice("ab ") for _ in range(draw.randint(1, 30))) for _ in range(250)}
    texts |= {t[i : i + k] for t in list(texts)[:60] for i, k in ((0, 3), (1, 7), (2, 13), (1, 25)) if t[i : i + k]}
    for gram in (2, 3):
        got = [tuple(r) for r in L.contained_names(spark.createDataFrame([(t,) for t in sorted(texts)], "n string"), gram).collect()]
        assert len(got) == len(set(got)) and set(got) == {(x, y) for x in texts for y in texts if x != y and x in y}


def test_alike_names_of_one_length_have_no_runs_to_compare(spark):
    """Numbers in names: three digits are in thousands of them, so candidates grew with the square."""
    names = spark.range(3000).select(F.concat(F.lit("member "), F.lpad(F.col("id").cast("string"), 9, "0")).alias("n"))
    plan = L.contained_names(names)
    assert plan.count() == 0
    candidates = spark.range(3000).select(F.format_string("m%05d", "id").alias("n")).unionByName(spark.createDataFrame([("m0001",)], "n string"))
    assert {r["y"] for r in L.contained_names(candidates).collect()} == {f"m0001{i}" for i in range(10)}


def test_joins_do_not_trust_estimates_of_files(spark, tmp_path):
    """A scan of few compressed bytes that becomes long texts is not gathered by the driver; a side that is small is still broadcast when it is there."""
    spark.range(20000).select("id", F.lit("x").alias("pad")).write.parquet(f"{tmp_path}/t")
    before = {k: spark.conf.get(k, None) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold")}
    measured_joins(spark)
    try:
        t = spark.read.parquet(f"{tmp_path}/t")
        long = t.select("id", F.repeat(F.concat("pad", F.col("id").cast("string")), 200).alias("text"))
        plan = lambda df: (df.write.format("noop").mode("overwrite").save(), df.collect(), df._jdf.queryExecution().executedPlan().toString())[-1]
        assert "BroadcastHashJoin" not in plan(long.join(long.withColumnRenamed("text", "other"), "id").groupBy().agg(F.sum(F.length("text")), F.max("other")))
        assert "BroadcastHashJoin" in plan(t.join(t.where("id < 5"), "id"))
    finally:
        for k, v in before.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)


def test_names_are_cleaned_once(spark, monkeypatch):
    """The cleaned names are a table: what follows scans no participants."""
    people = spark.createDataFrame([("1", "Ann Lee", "a"), ("2", "Dr. ann lee", "b")], "id string, name string, platform string").cache()
    found = L.resolve_participants(people)
    assert "InMemory" not in found._jdf.queryExecution().analyzed().toString() and len(found.inputFiles()) > 0
    assert [(r["a"], r["b"], r["relation"]) for r in found.collect()] == [("1", "2", "sameAs")]


def test_documents_are_parsed_from_memory_and_keep_their_numbers(spark, tmp_path):
    (tmp_path / "a.json").write_text('[\n{"a": 1.50, "b": 12345678901234567890123,\n "c": 1e3, "e": {"z": [1.0, 2]}, "g": "é\\nx"},\n{"a": true}]\n')
    (tmp_path / "b.json").write_text('\ufeff{"a": "y",\n"b": null}')
    got = sorted(read_json(spark, str(tmp_path)).collect(), key=lambda r: r["a"])
    assert [r["a"] for r in got] == ["1.50", "true", "y"] and (got[0]["b"], got[0]["c"], got[0]["e"]["z"], got[0]["g"]) == ("12345678901234567890123", "1e3", ["1.0", "2"], "é\nx")
    assert "multiLine" not in read_json(spark, str(tmp_path))._jdf.queryExecution().analyzed().toString()


def test_links_read_tables_not_documents(spark, tmp_path):
    (tmp_path / "p.json").write_text('{"proposals": [{"id": 1, "title": "t", "text": "x", "author": {"id": 7}, "comments": [{"id": 2, "body": "y", "author": {"id": 8}}]}]}')
    e = madrid(spark, str(tmp_path))
    assert not any(f.endswith(".json") for link in ("has_contribution", "response_to", "made_by") for f in e.links[link].inputFiles())
    assert sorted(r["target"][-6:] for r in e.links["has_contribution"].collect()) == ["ment_2", "text_1"]
