import json

import pytest
from pyspark.sql import functions as F

from polislake.functions import text as X
from polislake.functions.terms import DEL, TRIPLE_COLUMNS, TRIPLE_SCHEMA, TYPE
from polislake.operators import analytics as A
from polislake.operators import detect as D
from polislake.operators import link as L
from polislake.streaming import ingest as I


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values))
    return row.select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(("f", "value", "want"), [
    (X.clean_html, "<p>a</p>  <b>b</b>\n", "a b"), (X.local_name, "http://x/y#z", "z"), (X.local_name, "http://x/y", "y"), (X.normalize_name, "Dr. José  O'Neil, Sir", "josé oneil"), (X.normalize_name, "Desiree", "desiree"),
    (lambda c: X.normalize_name(c, True), "Desire", "dee"), (X.slug, "Ann-Marie  Lee!", "annmarie_lee"), (X.organization_id, "A/B C", "org_A_B_C"), (X.video_time, "x?playerStartTime=20250310-17:00:05&b", "2025-03-10T17:00:05"),
    (X.day_hour, "01/02/2020 10", "2020-02-01T10:00:00"), (X.day_hour, "nope", None), (X.case_number, "No. 12-345, x", "12-345"), (X.court_role, "Justice Kagan", "Justice"), (X.url_tail, "http://a/b/c?x=1", "c"),
    (X.title_case, "def/ROLE_NAME", "Role Name"), (X.platform_by_name, "Debate in the Parliament", "European Parliament"), (X.platform_by_address, "http://x/us_supreme_1", "scotus"), (lambda c: X.platform_by_address(c, True), "http://x/us_supreme_1", "ep_debate"),
    (X.topic_tags, "The AI and climate of housing health", ["climate", "health", "technology"]), (X.platform_id, "Your Priorities", "yourpriorities"), (X.whole_number, "12", 12), (X.whole_number, "x", None), (lambda c: X.shorten(c, 3), "abcd", "abc..."),
])
def test_text(spark, f, value, want):
    assert one(spark, f(F.col("v")), v=value) == want


def test_model_answer(spark):
    got = one(spark, X.model_items(F.col("v")), v='Sure:\n```json\n[{"type": "ad hominem", "segment": "s", "confidence": "0.9"}, {"segment": "none"}, {"type": "x", "confidence": "high"}]\n```')
    assert [(r["type"], r["confidence"]) for r in got] == [("ad hominem", 0.9), ("x", 0.5)]
    assert one(spark, X.model_items(F.col("v")), v="no list") == []


def test_resolution(spark):
    rows = [("1", "Dr. Ann Lee", "a"), ("2", "ann lee", "b"), ("3", "Ann Lee Smith", "b"), ("4", "Bob Ray Lee Fox", "a"), ("5", "Bob Ray Lee Cox", "c"), ("6", "Zoe", "a"), ("7", "Ann Lee", "a"), ("8", "", "b"), ("9", None, "c"), ("10", "xZoey", "b"), ("11", "Al", "a"), ("12", "Alan", "b")]
    df = spark.createDataFrame(rows, "id string, name string, platform string")
    got = {(r["a"], r["b"]): (round(r["similarity"], 2), r["relation"]) for r in L.resolve_participants(df).collect()}

    def brute():
        def norm(x):
            return x.lower().replace("dr. ", "")

        out = {}
        for i, n, p in rows:
            for j, m, q in rows:
                if n and m and p < q:
                    a, b = norm(n), norm(m)
                    wa, wb = set(a.split()), set(b.split())
                    jac = len(wa & wb) / len(wa | wb)
                    s = 1.0 if a == b else 0.8 if a in b or b in a else jac if len(a.split()) > 1 and len(b.split()) > 1 and jac > 0.5 else 0
                    if s >= 0.6:
                        out[i, j] = (round(s, 2), "sameAs" if s >= 0.8 else "related")
        return out

    assert got == brute()
    assert L.resolve_participants(df, cap=1).count() <= len(got)
    assert any("8" in (r["a"], r["b"]) for r in L.resolve_participants(df, compat=True).collect())


def test_topic_relations(spark):
    df = spark.createDataFrame([("1", "climate change policy europe"), ("2", "climate change policy"), ("3", "climate change energy"), ("4", "tax"), ("5", "the climate of change policy europe now")], "id string, name string")
    got = {(r["a"], r["b"], r["relation"]) for r in L.relate_topics(df).collect()}
    assert ("1", "2", "broader") in got and ("2", "1", "narrower") in got and ("2", "3", "related") in got and ("3", "2", "related") in got
    assert not any("4" in x for x in got)


def test_temporal(spark):
    df = spark.createDataFrame([("p", "a", 1), ("p", "b", 2), ("p", "c", 3), ("q", "d", 1), ("q", "e", None)], "process string, contribution string, timestamp int")
    assert {(r["source"], r["target"]) for r in L.temporal_chain(df).collect()} == {("b", "a"), ("c", "b")}
    assert {(r["source"], r["target"]) for r in L.temporal_chain(df, compat=True).collect()} == {("b", "a"), ("a", "a")}
    assert L.temporal_pairs(df).count() == 3


def test_arguments_keywords_links(spark):
    df = spark.createDataFrame([("1", "We agree Because it works"), ("2", "thus it is"), ("3", "plain"), ("4", None)], "id string, text string")
    got = {r["id"]: (r["premise"], r["conclusion"]) for r in L.mine_arguments(df).collect()}
    assert got == {"1": (" it works", "we agree "), "2": (None, None)}
    words = spark.createDataFrame([("1", "Zebra apple zebra apple mango mango mango this this")], "id string, text string")
    assert [r["keyword"] for r in L.frequent_keywords(words).orderBy("rank").collect()] == ["mango", "zebra", "apple"]
    a = spark.createDataFrame([("1", "Climate law"), ("2", "Citizen voice")], "id string, name string")
    b = spark.createDataFrame([("3", "Environment"), ("4", "citizen panels")], "id string, name string")
    assert {(r["a"], r["b"]) for r in L.keyword_topic_links(a, b).collect()} == {("1", "3"), ("2", "4")}
    assert {(r["a"], r["b"]) for r in L.first_counterpart(a, b).collect()} == {("2", "3")}
    t = spark.createDataFrame([("1", "tax", "p"), ("2", "Tax law", "q"), ("3", "a", "q"), ("4", "law", "q")], "id string, name string, process string")
    assert {(r["a"], r["b"]) for r in L.similar_topics(t).collect()} == {("1", "2"), ("2", "1"), ("1", "3"), ("3", "1")}


def test_fallacies(spark):
    c = spark.createDataFrame([("c1", "p", "Ann", "Everyone knows, you idiot"), ("c2", "p", "Bob", ""), ("c3", "p", "Bob", "Fine")], "id string, process string, participant string, text string")
    f = D.detect(c)
    assert {(r["contribution"], r["type"]) for r in f.collect()} == {("c1", "ad hominem"), ("c1", "hasty generalization")}
    assert D.detect(c, lambda t: 1 / 0).count() == 0
    s = A.fallacy_stats(c, f).first()
    assert (s["total"], s["with_fallacies"], round(s["percentage"], 1)) == (3, 1, 33.3)
    assert A.fallacy_stats(c.limit(0), f).first()["percentage"] == 0.0
    r = A.fallacy_report(c, f).first()
    assert len(r["fallacies_by_contribution"]) == 1 and len(r["fallacies_by_contribution"][0]["fallacies"]) == 2
    assert A.most_fallacious(c, f).first()["participant"] == "Ann"


def test_platforms_and_validation(spark):
    rows = [(f"http://x/madrid_{i}", "uri", TYPE, DEL + "Contribution", "uri", None, None, "x") for i in range(3)] + [("http://x/madrid_0", "uri", DEL + "platform", "Your Priorities", "literal", None, None, "x")]
    g = spark.createDataFrame(rows, TRIPLE_SCHEMA)
    got = {r["id"]: (r["name"], r["count"]) for r in A.platforms(g).collect()}
    assert got == {"decidemadrid": ("Decide Madrid", 3), "yourpriorities": ("Your Fallacious Priorities", 1)}
    v = {r["check"]: r["passed"] for r in A.validate(g).collect()}
    assert not v["processes"] and v["topic_relations"] and len(v) == 7
    with pytest.raises(ValueError):
        A.search(g, " ")


EVENTS = [
    {"contribution_id": "point-1", "text": "Bello", "timestamp": "2024-01-01T00:00:00", "user_id": 1, "user_name": "Ann", "post_id": 2, "post_name": "Post", "group_id": 3, "group_name": "Group", "value": 1, "parent_point_id": 9, "fallacies": [{"type": "ad hominem", "score": 0.5, "rationale": "perché"}]},
    {"contribution_id": "point-2", "text": "Only"},
]


def test_ingest_batch_and_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text("\n".join(map(json.dumps, [*EVENTS, EVENTS[0]])) + "\nnot json\n")
    events = I.parse_events(spark.read.text(f"{tmp_path}/in")).where("contribution_id IS NOT NULL")
    batch = {tuple(r[c] for c in TRIPLE_COLUMNS) for r in I.ingest(events).collect()}
    mine = {(r[2], r[3]) for r in batch if r[0].endswith("point-1")}
    assert (DEL + "supports", I.BASE + "post-2") in mine and (DEL + "supports", I.BASE + "point-9") in mine and (DEL + "respondsTo", I.BASE + "point-9") in mine
    assert len([r for r in batch if r[2] == TYPE and r[3] == DEL + "FallacyType"]) == 1
    assert len([r for r in batch if r[0].endswith("point-2")]) == 4
    stream = I.parse_events(spark.readStream.text(f"{tmp_path}/in")).where("contribution_id IS NOT NULL")
    I.start(stream, f"{tmp_path}/out", f"{tmp_path}/cp", available_now=True).awaitTermination()
    again = {tuple(r[c] for c in TRIPLE_COLUMNS) for r in I.read_set(spark, f"{tmp_path}/out").collect()}
    assert again == batch
    c = {r["contribution_id"]: r["fallacies_added"] for r in I.counters(events).collect()}
    assert c["point-1"] == 1


def test_stream_keeps_every_event(spark, tmp_path):
    files = [
        [EVENTS[0], {"text": "no id, no time"}, {"contribution_id": "now", "text": "no time"}], [{"text": "another without an id"}, {"contribution_id": "old", "text": "long ago", "timestamp": "1999-05-05T00:00:00"}],
        [EVENTS[0], {"contribution_id": "point-1", "text": "Bello, changed", "timestamp": "2024-01-01T00:00:00"}, {"text": "no id, no time"}],
    ]
    (tmp_path / "in").mkdir()
    for i, events in enumerate(files):
        (tmp_path / "in" / f"{i}.json").write_text("\n".join(map(json.dumps, events)))
    batch = {tuple(r[c] for c in TRIPLE_COLUMNS) for r in I.ingest(I.parse_events(spark.read.text(f"{tmp_path}/in"))).collect()}
    stream = I.parse_events(spark.readStream.option("maxFilesPerTrigger", 1).text(f"{tmp_path}/in"))
    I.start(stream, f"{tmp_path}/out", f"{tmp_path}/cp", available_now=True).awaitTermination()
    stored = [tuple(r[c] for c in TRIPLE_COLUMNS) for r in spark.read.parquet(f"{tmp_path}/out").collect()]
    assert {tuple(r[c] for c in TRIPLE_COLUMNS) for r in I.read_set(spark, f"{tmp_path}/out").collect()} == batch
    texts = [o for _, _, p, o, *_ in stored if p == DEL + "text"]
    assert sorted(texts) == ["Bello", "Bello, changed", "another without an id", "long ago", "no id, no time", "no time"]


def test_product_counts(spark):
    l = spark.createDataFrame([("g", "x"), ("g", "x"), ("g", "y")], "g string, b string")
    r = spark.createDataFrame([("g", "x"), ("g", "x"), ("g", "x")], "g string, b string")
    row = A.product_counts(l, r, "g", "b").first()
    assert (row["left_count"], row["right_count"]) == (2 * 3 + 1, 6)
