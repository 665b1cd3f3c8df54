"""Queries against SQL over whole tables, where the SQL in the catalogue covers less."""

import random

import duckdb
import pytest

from polislake import queries as Q
from polislake.functions.terms import TRIPLE_SCHEMA
from polislake.operators import link as L
from polislake.plans.results import sparql, values

WHOLE = {
    "similar_topics": """
WITH t AS (SELECT CAST(min(p_partkey) AS VARCHAR) AS id, p_brand AS process, lower(p_name) AS n FROM part WHERE p_name IS NOT NULL GROUP BY 2, 3)
SELECT a.id AS a, b.id AS b, a.process AS process_a, b.process AS process_b FROM t a JOIN t b ON a.process <> b.process AND (contains(a.n, b.n) OR contains(b.n, a.n)) WHERE a.n <> '' AND b.n <> ''
""",
    "thread_structure": f"""
WITH RECURSIVE s AS (SELECT DISTINCT conv_id, turn FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL),
r AS (SELECT a.conv_id, a.turn AS later, b.turn AS first FROM s a JOIN s b ON a.conv_id = b.conv_id AND b.turn = a.turn - 1
  UNION SELECT r.conv_id, r.later, s.turn FROM r JOIN s ON s.conv_id = r.conv_id AND s.turn = r.first - 1)
SELECT '{Q.RES}conversation_' || conv_id || '_' || later AS later, '{Q.RES}conversation_' || conv_id || '_' || first AS first FROM r
""",
}


def same(spark, sf, tmp_path, name, tables):
    Q.queries()[name](spark, sf).write.parquet(f"{tmp_path}/out")
    duck = duckdb.connect()
    for t in tables:
        duck.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    names = sorted(r[0] for r in duck.sql(f"DESCRIBE {WHOLE[name]}").fetchall())
    pick = ", ".join(names)
    got, want = f"SELECT {pick} FROM '{tmp_path}/out/*.parquet'", f"SELECT {pick} FROM ({WHOLE[name]})"
    assert duck.sql(f"SELECT count(*) FROM ({want})").fetchall()[0][0] > 0
    assert duck.sql(f"({got}) EXCEPT ALL ({want})").fetchall() == []
    assert duck.sql(f"({want}) EXCEPT ALL ({got})").fetchall() == []


def test_similar_topics_whole_names(spark, sf, tmp_path):
    same(spark, sf, tmp_path, "similar_topics", ["part"])


def test_similar_topics_past_nine_characters(spark, tmp_path):
    rows = [(1, "cold plate", "p"), (2, "old plate", "q"), (3, "environment law", "p"), (4, "environment tax", "q")]
    spark.createDataFrame(rows, "p_partkey bigint, p_name string, p_brand string").write.parquet(f"{tmp_path}/part.parquet")
    assert {(r["a"], r["b"]) for r in Q.queries()["similar_topics"](spark, str(tmp_path)).collect()} == {("1", "2"), ("2", "1")}


def test_thread_structure_all_conversations(spark, sf, tmp_path):
    same(spark, sf, tmp_path, "thread_structure", ["conversations"])


def test_thread_structure_gap_and_depth(spark, tmp_path):
    rows = [(1, 0), (1, 1), (2, 0), (2, 1), (2, 2), (2, 3), (3, 5), (3, 6), (3, 8), (3, 6), (None, 0)]
    spark.createDataFrame(rows, "conv_id bigint, turn int").write.parquet(f"{tmp_path}/conversations.parquet")
    got = sorted((r["later"].removeprefix(Q.RES), r["first"].removeprefix(Q.RES)) for r in Q.queries()["thread_structure"](spark, str(tmp_path)).collect())
    assert got == [("conversation_1_1", "conversation_1_0"), *[(f"conversation_2_{a}", f"conversation_2_{b}") for a in range(4) for b in range(a)], ("conversation_3_6", "conversation_3_5")]


def test_closure_of_long_chains_and_cycles(spark):
    none = None
    edges = [(f"c{i}", f"c{i + 1}") for i in range(40)] + [("x", "y"), ("y", "z"), ("z", "x"), ("z", "w"), ("w", "c38"), ("l", "l"), ("x", "y")]
    g = spark.createDataFrame([(a, "uri", "p:e", b, "uri", none, none, "t") for a, b in edges], TRIPLE_SCHEMA)
    got = [(r["a"], r["b"]) for r in values(sparql(g, "SELECT ?a ?b WHERE { ?a <p:e>+ ?b }")).collect()]
    want = set(edges)
    while len(more := want | {(a, d) for a, b in want for c, d in edges if b == c}) > len(want):
        want = more
    assert sorted(got) == sorted(want)


@pytest.mark.parametrize("name", ["participant_resolution", "cross_platform_links"])
def test_names_keep_their_words(spark, sf, monkeypatch, name):
    seen, resolve = [], L.resolve_participants
    monkeypatch.setattr(L, "resolve_participants", lambda p: seen.append(p) or resolve(p))
    assert Q.queries()[name](spark, sf).count() > 0
    assert seen[0].where("name NOT LIKE '%Member %'").count() == 0


def test_a_common_word_makes_no_pairs(spark):
    names = spark.createDataFrame([(f"member {i:06d}",) for i in range(500)] + [("member ann lee",), ("member ann fox lee",)], "n string")
    assert [tuple(r) for r in L.similar_words(names).collect()] == [("member ann fox lee", "member ann lee")]


def test_similar_words_loses_no_pair(spark):
    draw = random.Random(7)
    names = sorted({" ".join(draw.choices("abcdefghij", weights=[20, 10, 5, 3, 2, 1, 1, 1, 1, 1], k=draw.randint(1, 7))) for _ in range(200)})
    want = set()
    for x in names:
        for y in names:
            a, b = set(x.split()), set(y.split())
            if x < y and " " in x and " " in y and len(a & b) / len(a | b) > 0.5:
                want.add((x, y))
    got = [tuple(r) for r in L.similar_words(spark.createDataFrame([(n,) for n in names], "n string")).collect()]
    assert want and want <= set(got) and len(got) == len(set(got))


@pytest.mark.parametrize("related", [0.4, 0.2, 0.75])
def test_relate_topics_loses_no_pair(spark, related):
    draw = random.Random(11)
    words = ["apple", "bread", "cider", "dates", "elder", "figs", "grape", "honey", "ivory", "jelly"]
    names = [(f"t{i:03d}", " ".join(draw.choices(words, weights=[30, 20, 10, 5, 4, 3, 2, 1, 1, 1], k=draw.randint(1, 7)))) for i in range(120)]
    want = set()
    for i, x in names:
        for j, y in names:
            a, b = set(x.split()), set(y.split())
            if i < j and len(x) > 5 and len(y) > 5 and (s := len(a & b) / len(a | b)) >= related:
                want |= {(i, j, s >= 0.7), (j, i, s >= 0.7)}
    got = [(r["a"], r["b"], r["relation"] != "related") for r in L.relate_topics(spark.createDataFrame(names, "id string, name string"), related=related).collect()]
    assert want and sorted(got) == sorted(want)
