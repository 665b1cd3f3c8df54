"""Links of proposals and spaces are made from few short columns, each row once."""

import glob
import json
import re
from collections import Counter

from pyspark.sql import functions as F

from polislake.functions import text as X
from polislake.operators import nested
from polislake.operators.model import RES
from polislake.sources.adapters import decidim_spaces, madrid_csv


def test_links_of_repeated_comments_hold_no_row_twice(spark, tmp_path):
    (tmp_path / "d.csv").write_text("id;title;description;author_name;created_at\n1;t;x;Ann Lee;02/03/2020 04\n2;u;<b> </b>;Bo;never\n3;v;y;;\n")
    (tmp_path / "c.csv").write_text("id;debate_id;body;author_name;created_at\n7;1;hi;Bo;03/03/2020 05\n7;1;hi again;Bo;\n7;2;hi;Bo;\n7;2;hi;Cy;\n8;9;lost;Bo;\n9;3;;Bo;\n")
    e = madrid_csv(spark, f"{tmp_path}/d.csv", f"{tmp_path}/c.csv")
    at = lambda df: Counter((r[0].removeprefix(RES + "madrid_"), r[1].removeprefix(RES + "madrid_")) for r in df.select("source", "target").collect())
    assert at(e.links["has_contribution"]) == Counter([("proposal_1", "text_1"), ("proposal_3", "text_3"), ("proposal_1", "comment_7"), ("proposal_2", "comment_7")])
    assert at(e.links["response_to"]) == Counter([("comment_7", "text_1"), ("comment_7", "text_2")])
    assert at(e.links["made_by"]) == Counter([("text_1", "participant_ann_lee"), ("comment_7", "participant_bo"), ("comment_7", "participant_cy")])
    assert at(e.links["has_participant"]) == Counter([("proposal_1", "participant_ann_lee"), ("proposal_1", "participant_bo"), ("proposal_2", "participant_bo"), ("proposal_2", "participant_cy")])
    assert Counter(r["timestamp"] for r in e.tables["contribution"].collect()) == Counter({"2020-03-02T04:00:00": 1, "2020-03-03T05:00:00": 1, None: 4})
    assert {r["identifier"]: r["start_date"] for r in e.tables["process"].collect()} == {"1": "2020-03-02T04:00:00", "2": None, "3": None}


def test_slugs(spark):
    names = ["Dr. Ann-Lee  O'Neil", " a\tb\x0bc ", "Éva_1 日本 x", "", "#", "Supplier12", " a b", None]
    rows = spark.createDataFrame([(n,) for n in names], "n string")
    want = [n if n is None else re.sub(r"[ \t\n\x0b\f\r]+", "_", re.sub(r"[^a-zA-Z0-9 \t\n\x0b\f\r]", "", n).strip(" ")).lower() for n in names]
    assert [r[0] for r in rows.select(X.slug(rows["n"])).collect()] == want


def test_links_of_spaces_read_one_table_of_rows(spark, tmp_path):
    """Comments were joined to their parents anew for each link, and few spaces dealt all rows to as few tasks."""
    made = lambda rows, names, at: (spark.createDataFrame(rows, ", ".join(f"`{n}` string" for n in names)).write.parquet(f"{tmp_path}/{at}"), spark.read.parquet(f"{tmp_path}/{at}"))[1]
    space = "participatory_space/id"
    p = made([("1", "s", "k", "K", "a", "Ann", "x"), ("1", "t", "k", "K", "a", "Ann", "x"), ("2", "s", "q", None, "b", None, "y"), ("3", "s", None, None, None, None, "z")], ["id", space, "category/id", "category/name/es", "author/id", "author/name", "title/ca"], "source_p")
    c = made([("7", "1", "hi", "b", None), ("7", "1", "hi", "b", None), ("7", "2", "yo", "a", "Ann"), ("8", "2", "oh", "c", None), ("9", "5", "lost", "a", "Ann"), ("6", "3", "", "c", "Cy")], ["id", "commentable_id", "body", "author/id", "author/name"], "source_c")
    e = decidim_spaces(p, None, c)
    assert not any("/source_" in f for df in e.links.values() for f in df.inputFiles())
    got = {k: Counter((r[0].removeprefix(RES + "decidim_"), r[1].removeprefix(RES + "decidim_")) for r in df.select("source", "target").collect()) for k, df in e.links.items()}
    assert got["has_contribution"] == Counter([("process_s", "proposal_1"), ("process_t", "proposal_1"), ("process_s", "proposal_2"), ("process_s", "proposal_3"), ("process_s", "comment_7"), ("process_t", "comment_7"), ("process_s", "comment_8")])
    assert got["has_participant"] == Counter([("process_s", "participant_a"), ("process_t", "participant_a"), ("process_s", "participant_c")])
    assert got["made_by"] == Counter([("proposal_1", "participant_a"), ("comment_7", "participant_a"), ("comment_8", "participant_c")])
    assert got["response_to"] == Counter([("comment_7", "proposal_1"), ("comment_7", "proposal_2"), ("comment_8", "proposal_2")])
    assert got["has_topic"] == Counter([("process_s", "topic_k"), ("process_t", "topic_k"), ("proposal_1", "topic_k")])
    assert {r["id"].removeprefix(RES + "decidim_"): r["text"] for r in e.tables["contribution"].collect()} == {"proposal_1": "x", "proposal_2": "y", "proposal_3": "z", "comment_7": "hi", "comment_8": "oh"}
    assert "BroadcastHashJoin" in e.links["has_topic"]._jdf.queryExecution().sparkPlan().toString()


def test_nested_documents_come_in_order_without_a_sort_of_all(spark, tmp_path):
    """Rows were dealt out by ranges three times, and what was before that made anew each time."""
    rows = spark.range(3000).select((F.col("id") % 3).cast("string").alias("platform"), (F.col("id") % 7).cast("string").alias("process"), F.hash("id").alias("timestamp"), F.col("id").alias("contribution"))
    levels = [("platform", "processes"), ("process", "contributions")]
    pieces, _ = nested.nested_text(rows, levels, ["timestamp"], F.struct("contribution"))
    plan = pieces._jdf.queryExecution().optimizedPlan().toString()
    assert "], true" not in plan and plan.count("RepartitionByExpression") == 1
    nested.write_nested(rows, f"{tmp_path}/out", levels, ["timestamp"], F.struct("contribution"))
    text = "".join(open(f).read() for f in sorted(glob.glob(f"{tmp_path}/out/part-*")))
    got = [(p["platform"], q["process"], c["contribution"]) for p in json.loads(text) for q in p["processes"] for c in q["contributions"]]
    assert got == [(r[0], r[1], r[3]) for r in sorted(map(tuple, rows.collect()))]


def test_all_contributions_need_no_order(spark, sf):
    from polislake.operators.analytics import contributions
    from polislake.sources.tables import table_graph

    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    assert "Sort [" not in plan(contributions(table_graph(spark, sf), None, ordered=False)) and "Sort [" in plan(contributions(table_graph(spark, sf), None))
