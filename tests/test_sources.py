"""RDF files in four formats, and each adapter on a small file of its shape."""

import json
import sqlite3

import pytest
from pyspark.sql import functions as F

from polislake.functions.terms import DEL, OWL, TRIPLE_COLUMNS, TRIPLE_SCHEMA, TYPE, XSD
from polislake.operators import analytics as A
from polislake.operators import model as M
from polislake.sources import adapters as S
from polislake.sources import rdf as R

ROWS = [
    ("http://x/a", "uri", TYPE, DEL + "Participant", "uri", None, None, "t"), ("http://x/a", "uri", DEL + "name", 'Ann "é" \\ line\nnext\t<&>', "literal", None, None, "t"),
    ("http://x/a", "uri", DEL + "text", "ciao", "literal", None, "it", "t"), ("http://x/a", "uri", DEL + "startDate", "2024-01-01T00:00:00", "literal", XSD + "dateTime", None, "t"),
    ("http://x/b", "uri", OWL + "sameAs", "http://x/a", "uri", None, None, "t"), ("n1", "bnode", DEL + "knows", "n2", "bnode", None, None, "t"),
]


def as_set(df):
    return {tuple(r[c] for c in TRIPLE_COLUMNS) for r in df.collect()}


@pytest.mark.parametrize(("fmt", "ending"), [("nt", "nt"), ("ttl", "ttl"), ("rdf", "rdf"), ("jsonld", "jsonld")])
def test_round_trip(spark, tmp_path, fmt, ending):
    g = spark.createDataFrame(ROWS, TRIPLE_SCHEMA)
    (tmp_path / f"g.{ending}").write_text(R.document(g, fmt))
    got = as_set(R.read_rdf(spark, f"{tmp_path}/g.{ending}"))
    plain = lambda rows: {r for r in rows if "bnode" not in (r[1], r[4])}
    assert plain(got) == plain({r[:7] for r in ROWS})
    assert len(got) == len(ROWS)


def test_turtle_syntax(spark, tmp_path):
    (tmp_path / "g.ttl").write_text('@prefix d: <http://d/> .\n@base <http://b/> .\n# note\nd:a a d:C ; d:p "x"@en, """long "q" text""" , 5, 2.5, true ; d:q [ d:r <rel> ] .\n d:l d:list ( 1 2 ) .')
    got = as_set(R.read_rdf(spark, f"{tmp_path}/g.ttl"))
    objects = {(r[3], r[5], r[6]) for r in got if r[2] == "http://d/p"}
    assert objects == {("x", None, "en"), ('long "q" text', None, None), ("5", XSD + "integer", None), ("2.5", XSD + "decimal", None), ("true", XSD + "boolean", None)}
    assert ("http://b/rel", "uri") in {(r[3], r[4]) for r in got}
    assert len(got) == 6 + 2 + 1 + 4


def test_wrong_extension_and_folder(spark, tmp_path):
    g = spark.createDataFrame(ROWS[:3], TRIPLE_SCHEMA)
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "a.ttl").write_text(R.document(g, "xml"))
    (tmp_path / "b.jsonld").write_text(R.document(g, "jsonld"))
    (tmp_path / "notes.md").write_text("not rdf")
    assert as_set(R.read_rdf(spark, str(tmp_path))) == {r[:7] for r in ROWS[:3]}
    with pytest.raises(ValueError):
        R.export(g, "csv")


def put(tmp_path, name, x):
    p = tmp_path / name
    p.write_text(x if isinstance(x, str) else json.dumps(x))
    return str(p)


def counts(spark, e):
    r = A.graph_stats(M.to_triples(e, "t")).first()
    return r["processes"], r["participants"], r["contributions"], r["topics"], r["organizations"]


DEBATE = {
    "@type": "del:DeliberationProcess", "del:identifier": "d1", "del:name": "Debate", "del:startDate": "2025-03-10T00:00:00Z", "del:hasTopic": [{"@type": "del:Topic", "del:identifier": "topic_1", "del:name": "Climate"}],
    "del:hasParticipant": [{"del:identifier": "participant_1", "del:name": "Ann", "del:hasRole": {"del:name": "MEP"}, "del:isAffiliatedWith": {"del:name": "A/B group"}}, {"del:identifier": "participant_2", "del:name": "Bob"}],
    "del:hasContribution": [{"del:identifier": "c1", "del:text": "because x", "del:madeBy": {"@id": "participant_1"}}, {"del:identifier": "c2", "del:text": "", "del:madeBy": {"@id": "participant_2"}, "del:responseTo": {"@id": "c1"}}],
}


def test_debates(spark, tmp_path):
    e = S.debates(spark, put(tmp_path, "d.json", DEBATE))
    assert counts(spark, e) == (1, 2, 2, 1, 1)
    t = M.to_triples(e, "t")
    assert M.links(t, "response_to").count() == 1 and M.links(t, "made_by").count() == 2 and M.links(t, "has_role").count() == 1
    two = [DEBATE, DEBATE | {"del:identifier": "d2"}]
    assert counts(spark, S.debates(spark, put(tmp_path, "two.json", {"@graph": two}))) == (2, 4, 4, 2, 1)
    assert counts(spark, S.debates(spark, put(tmp_path, "two.json", {"@graph": two}), compat=True))[:3] == (2, 2, 2)
    other = json.loads(json.dumps(DEBATE).replace("del:", "dkg:"))
    assert counts(spark, S.debates(spark, put(tmp_path, "k.json", other))) == (1, 2, 2, 1, 1)


def test_parliament(spark, tmp_path):
    s = {"debate_date": "2024-07-17", "speeches": [{"id": f"s/{i}", "activity_label": {"en": "Topic A" if i < 2 else "Topic B"}, "activity_start_date": "2024-07-17T10:00:00", "had_participation": {"had_participant_person": [f"person/{i % 2}"], "participation_role": "def/ep-roles/CHAIR_PERSON"}} for i in range(3)]}
    assert counts(spark, S.parliament_api(spark, put(tmp_path, "p.json", s))) == (1, 2, 3, 2, 0)


def test_html(spark, tmp_path):
    generic = "<html><head><title>Debate</title></head><body><div class='date'>2025-03-10</div><h2 class='title'>Topic</h2><div class='speech'><span class='speaker'>Ann</span><span class='role'>Chair</span><span class='affiliation'>G</span><span class='time'>10:00:00</span><div class='text'>Hello <b>all</b></div></div><div class='speech'><span class='speaker'>Bob</span><div class='text'>Yes</div></div></body></html>"
    assert counts(spark, S.debate_html(spark, put(tmp_path, "g.html", generic))) == (1, 2, 2, 1, 1)
    verbatim = (
        "<html><head><title>Verbatim report - Monday, 10 March 2025</title></head><body><table class='list_summary'><tr><td><a href='#t1'>1. Opening</a></td></tr></table>"
        "<table class='doc_box_header'><tr><td class='doc_title'>1. Opening</td></tr></table><table><tr><td><span class='doc_subtitle_level1_bis'><span class='bold'>President</span></span></td></tr>"
        "<tr><td><a title='Video of the speeches' href='x?playerStartTime=20250310-17:00:05'>v</a><p class='contents'>Welcome</p></td></tr></table>"
        "<table><tr><td><span class='doc_subtitle_level1_bis'><span class='bold'>Ann Lee (S&amp;D)</span></span><p class='contents'>Thanks</p></td></tr></table></body></html>"
    )
    e = S.debate_html(spark, put(tmp_path, "v.html", verbatim))
    assert counts(spark, e) == (1, 2, 2, 1, 1)
    assert {r["timestamp"] for r in e.tables["contribution"].collect()} == {"2025-03-10T17:00:05", None}
    assert e.tables["process"].first()["start_date"] == "2025-03-10"


def test_times_of_sources(spark, tmp_path):
    undated = {"speeches": [{"id": f"SPEECH-9-2024-07-17-{i}", "activity_label": {"en": "A"}} for i in range(2)]}
    p = S.parliament_api(spark, put(tmp_path, "u.json", undated)).tables["process"].first()
    assert p["id"].endswith("debate_2024-07-17") and p["start_date"] == "2024-07-17"
    zoned = DEBATE | {"del:startDate": "2024-07-17T10:00:00Z", "del:endDate": "2024-07-17T14:30:00+02:00"}
    for zone in ("UTC", "America/New_York"):
        before = spark.conf.get("spark.sql.session.timeZone")
        spark.conf.set("spark.sql.session.timeZone", zone)
        try:
            d = S.debates(spark, put(tmp_path, "z.json", zoned)).tables["process"].first()
        finally:
            spark.conf.set("spark.sql.session.timeZone", before)
        assert (d["start_date"], d["end_date"]) == ("2024-07-17T10:00:00", "2024-07-17T12:30:00")
    assert S.debates(spark, put(tmp_path, "n.json", DEBATE | {"del:startDate": "2024-07-17", "del:endDate": "soon"})).tables["process"].select("start_date", "end_date").first() == ("2024-07-17", "soon")


def test_proposals(spark, tmp_path):
    flat = {"proposals": [{"id": 1, "title": "Bikes", "text": "<p>More  bikes</p>", "userId": 7, "date": "2020-01-01"}], "comments": [{"id": 5, "proposalId": 1, "userId": 8, "text": "Yes", "date": "2020-01-02"}, {"id": 6, "proposalId": 99, "userId": 8, "text": "Orphan"}]}
    assert counts(spark, S.madrid(spark, put(tmp_path, "m.json", flat))) == (1, 2, 2, 1, 0)
    nested = {"proposals": [{"id": 1, "title": "Bikes", "description": "x", "author": {"id": 7, "username": "ann"}, "comments": [{"id": 5, "body": "Yes", "author": {"id": 8, "username": "bob"}}]}]}
    assert counts(spark, S.madrid(spark, put(tmp_path, "n.json", nested))) == (1, 2, 2, 1, 0)
    d = put(tmp_path, "d.csv", 'id;title;description;created_at;cached_votes_total;author_name\n1;Bikes;"a; b";01/02/2020 10;3;Ann\n')
    c = put(tmp_path, "c.csv", "id;debate_id;body;created_at;author_name\n9;1;Yes;02/02/2020 11;Bob\n")
    e = S.madrid_csv(spark, d, c)
    assert counts(spark, e) == (1, 2, 2, 1, 0)
    assert "2020-02-01T10:00:00" in {r["timestamp"] for r in e.tables["contribution"].collect()}
    dec = {"proposals": [{"id": "p1", "title": {"en": "T", "ca": "", "es": "E"}, "body": {"en": "B"}, "author": {"id": "u1", "name": "Ann"}, "created_at": "2021-01-01"}], "comments": [{"id": "c1", "proposal_id": "p1", "author": {"id": "u2", "name": "Bob"}, "body": {"ca": "Si"}}]}
    e = S.decidim(spark, put(tmp_path, "dec.json", dec))
    assert counts(spark, e) == (1, 2, 2, 1, 0) and e.tables["process"].first()["name"] == "E"
    p = put(tmp_path, "dp.csv", "id;participatory_space/id;author/id;author/name;title/ca;title/es;body/ca;published_at\n1;3;7;Ann;Bicis;;Mes;2020-01-01\n1;4;7;Ann;Bicis;;Mes;2020-01-01\n")
    c = put(tmp_path, "dc.csv", "id;commentable_id;body;created_at;author/id;author/name\n9;1;Si;2020-01-02;8;Bob\n")
    assert counts(spark, S.decidim_csv(spark, p, c)) == (1, 2, 2, 1, 0)


def test_decidim_spaces(spark, tmp_path):
    folder = tmp_path / "open"
    folder.mkdir()
    head = "id;participatory_space/id;participatory_space/url;category/id;category/name/ca;category/name/es;author/id;author/name;title/ca;title/es;body/ca;published_at\n"
    rows = ["1;3;https://x.y/processes/plan?locale=ca;5;;Calles;7;Ann;Bicis;;Mes;2020-01-01", "1;4;https://x.y/processes/other;5;Carrers;;7;Ann;Bicis;;Mes;2020-01-01", "1;3;https://x.y/processes/plan;5;;Calles;7;Ann;Bicis;;Mes;2020-01-01"]
    rows += ["2;3;;;;;8;;;;;", "3;;;;;;7;Ann;No space;;;", "4;3;;6;;;9;;;Solo;;"]
    put(folder, "www-proposals.csv", head + "\n".join(rows) + "\n")
    put(folder, "www-meetings.csv", "id;participatory_space/id;category/id;title/ca;description/es;start_time\n1;3;5;Trobada;Charla;2020-02-02\n2;99;5;Unknown;;\n3;4;;;;\n")
    put(folder, "www-proposal_comments.csv", "id;commentable_id;body;created_at;author/id;author/name\n9;1;Si;2020-01-02;8;Bob\n10;77;Orphan;;8;Bob\n11;1;;;12;Silent\n")
    put(folder, "www-meeting_comments.csv", "id;commentable_id;body;author/id;author/name\n20;1;Fine;8;Bob\n21;2;Lost;8;Bob\n")
    put(folder, "www-results.csv", "id;participatory_space/id;title/ca\n1;3;Done\n2;99;Elsewhere\n")
    put(folder, "readme.txt", "proposals")
    e = S.decidim_folder(spark, str(folder))
    short = lambda x: x.rsplit("/", 1)[-1].rsplit("#", 1)[-1].removeprefix("decidim_")
    got = {k: sorted((short(r["source"]), short(r["target"])) for r in v.collect()) for k, v in e.links.items()}
    assert got["has_contribution"] == sorted([("process_3", x) for x in ("proposal_1", "proposal_4", "meeting_1", "comment_9", "comment_20")] + [("process_4", "proposal_1"), ("process_4", "comment_9")])
    assert got["response_to"] == [("comment_20", "meeting_1"), ("comment_9", "proposal_1")]
    assert got["made_by"] == [("comment_20", "participant_8"), ("comment_9", "participant_8"), ("proposal_1", "participant_7")]
    assert got["has_participant"] == [(f"process_{s}", f"participant_{p}") for s in (3, 4) for p in (12, 7, 8)]
    assert got["has_topic"] == sorted([("process_3", "topic_5"), ("process_4", "topic_5"), ("proposal_1", "topic_5"), ("meeting_1", "topic_5"), ("process_3", "result_topic_1"), ("barcelona_process", "result_topic_2")])
    assert {short(r["id"]): r["text"] for r in e.tables["contribution"].collect()} == {"proposal_1": "Bicis\n\nMes", "proposal_4": "Solo", "meeting_1": "Trobada\n\nCharla", "comment_9": "Si", "comment_20": "Fine"}
    assert {r["name"] for r in e.tables["process"].collect()} == {"Decidim Barcelona: plan", "Decidim Barcelona: other", S.DECIDIM_PLATFORM}
    assert counts(spark, e) == (3, 3, 5, 3, 0)
    assert set(S.discover(spark, str(tmp_path))) == set()
    folder.rename(tmp_path / "decidim_folder")
    assert S.discover(spark, str(tmp_path)) == {"decidim_folder": [f"{tmp_path}/decidim_folder"]}
    with pytest.raises(FileNotFoundError):
        S.decidim_folder(spark, f"{tmp_path}/none")


def test_samples_by_group(spark):
    rows = spark.createDataFrame([(g, i, f"t{i}") for g in ("a", None) for i in (4, 2, 3, 1)] + [("b", 1, None)], "g string, i int, t string")
    got = {r["g"]: (r["n"], r["samples"]) for r in A.group_samples(rows, "g", ["i"], F.col("t")).collect()}
    assert got == {"a": (4, ["t1", "t2", "t3"]), None: (4, ["t1", "t2", "t3"]), "b": (1, [None])}


def test_delidata(spark, tmp_path):
    doc = {"conversations": [{"group_id": "g1", "messages": [{"message_id": 1, "origin": "Ann", "original_text": "Hi  all", "annotation_type": "Probing"}, {"message_id": 2, "origin": "system", "original_text": "joined"}, {"message_id": 3, "origin": "Bob", "original_text": "", "annotation_type": "0"}]}]}
    e = S.delidata(spark, put(tmp_path, "x.json", doc))
    assert counts(spark, e) == (1, 1, 1, 0, 0) and e.tables["argument"].count() == 1
    t = put(tmp_path, "g7.tsv", "message_id\torigin\toriginal_text\tannotation_type\n1\tAnn\tHello\t0\n2\tSYSTEM\tx\t0\n")
    assert counts(spark, S.delidata_tsv(spark, t)) == (1, 1, 1, 0, 0)


def test_consultations(spark, tmp_path):
    a = put(tmp_path, "a.csv", 'id,publication_id,language,country,organization,surname,first_name,feedback,date_feedback,publication,user_type\n1,9,en,FRA,Org One,,,"Good, but late",2021-01-01,Plan,x\n2,9,en,DEU,,Lee,Ann,Fine,2021-01-02,Plan,x\n3,9,en,DEU,,,,Anon,2021-01-02,Plan,x\n')
    e = S.consultations(spark, a)
    assert counts(spark, e) == (1, 3, 3, 0, 1)
    assert {r["participant_type"] for r in e.tables["participant"].collect()} == {"organization", "person", "anonymous"}
    b = put(tmp_path, "b.csv", "Initiative ID,Initiative Title,Contributor ID,Contributor Name,Organization,Feedback ID,Feedback Text,Submission Date\n1,T,5,Ann,Org,7,Text,2020-01-01\n")
    assert counts(spark, S.consultations(spark, b)) == (1, 1, 1, 0, 1)
    d = put(tmp_path, "i.json", {"initiative_id": "1", "title": "T", "policy_areas": ["Climate action", "Energy"], "feedback": [{"id": "7", "text": "x", "country": "ITA", "organization": "", "date": "2020-01-01"}]})
    assert counts(spark, S.consultation_documents(spark, d)) == (1, 1, 1, 2, 0)
    db = sqlite3.connect(f"{tmp_path}/f.db")
    db.execute("CREATE TABLE feedback (id TEXT, publication_id TEXT, initiative_id TEXT, data TEXT, timestamp TEXT)")
    db.execute("INSERT INTO feedback VALUES ('1', '2', NULL, ?, 'x')", (json.dumps({"firstName": "Ann", "surname": "Lee", "country": "ITA", "feedback": "hi"}),))
    db.commit()
    assert counts(spark, S.consultation_sqlite(spark, f"{tmp_path}/f.db")) == (1, 1, 1, 0, 0)


def test_habermas(spark, tmp_path):
    doc = {
        "candidate_comparisons": [{"session_id": "s1", "participant_id": "p1", "round": 1, "comparison_id": "k1", "candidate_a": "A", "candidate_b": "B", "preference": "A", "reasoning": "clear"}],
        "final_preference_rankings": [{"session_id": "s1", "participant_id": "p2", "round": 1, "rankings": [{"candidate": "B", "rank": 2}, {"candidate": "A", "rank": 1}]}],
        "position_statement_ratings": [{"session_id": "s1", "participant_id": "p1", "statement_id": "x1", "topic": "Tax", "statement": "Raise it", "agreement_rating": 4}],
        "round_survey_responses": [{"session_id": "s2", "participant_id": "p3", "survey_id": "v1", "questions": [{"question_id": "q", "question_text": "Why?", "response": 3, "response_text": "So"}]}],
    }
    e = S.habermas_json(spark, put(tmp_path, "h.json", doc))
    assert counts(spark, e) == (2, 3, 4, 1, 0)
    assert "Ranking: A, B" in {r["text"] for r in e.tables["contribution"].collect()}
    for name, rows in doc.items():
        rows = [{k: json.dumps(v) if isinstance(v, list) else v for k, v in r.items()} for r in rows]
        spark.createDataFrame(rows).write.parquet(f"{tmp_path}/h/{name}.parquet")
    assert counts(spark, S.habermas_files(spark, f"{tmp_path}/h")) == (2, 3, 4, 1, 0)
    bad = spark.createDataFrame([("s", "p", 1, "not json")], "session_id string, participant_id string, round int, rankings string")
    assert S.habermas({"final_preference_rankings": bad}).tables["contribution"].count() == 1


def test_court(spark, tmp_path):
    doc = {"case_metadata": {"docket_number": "12-345", "case_name": "A v. B", "argument_date": "2013-01-01"}, "transcript": [{"speaker": "CHIEF JUSTICE ROBERTS", "text": "We begin"}, {"speaker": "MR. SMITH", "text": " "}, {"speaker": "MR. SMITH", "text": "May it please"}]}
    e = S.court(spark, put(tmp_path, "c.json", doc))
    assert counts(spark, e) == (1, 2, 2, 1, 0)
    assert {r["id"][-1] for r in e.tables["contribution"].collect()} == {"1", "3"}
    assert {r["name"] for r in e.tables["role"].collect()} == {"Chief Justice", "Attorney"}
    cases = {"cases": [{"id": "7", "name": "C v. D", "transcript": [{"id": "1", "text": "Hi", "speaker_id": "j1"}]}]}
    assert counts(spark, S.court(spark, put(tmp_path, "cs.json", cases))) == (1, 1, 1, 1, 0)
    t = put(tmp_path, "t.csv", "case,speaker,text\n1,MS. LEE,Yes\n1,JUSTICE KAGAN,No\n2,MS. LEE,Again\n")
    assert counts(spark, S.court_csv(spark, t)) == (2, 2, 3, 2, 0)


def test_page_parts_and_paging(spark):
    html = '<html><nav>menu</nav><p>Main   text</p><a href="/have-your-say/initiatives/123-plan">x</a><a href="f/doc.PDF">d</a> F123456 <script>var</script></html>'
    r = S.page_parts(spark.createDataFrame([("u", html)], "url string, html string")).first()
    assert r["links"] == ["123-plan"] and r["ref"] == "F123456" and r["attachments"] == ["f/doc.PDF"] and "menu" not in r["main_text"] and "Main text" in r["main_text"]
    pages = iter([(200, list(range(3)), {}), (429, [], {}), (200, [3], {})])
    assert list(S.paginate(lambda p: next(pages), {}, size=3)) == [0, 1, 2, 3]
    pages = iter([(200, [1], {"last": False}), (200, [2], {"last": True})])
    assert list(S.paginate(lambda p: next(pages), {}, size=3)) == [1, 2]
    waits, pages = [], iter([(429, [], {"Retry-After": "7"}), (429, [], {"Retry-After": "soon"}), (200, [1], {})])
    assert list(S.paginate(lambda p: next(pages), {}, size=3, pause=4, wait=waits.append)) == [1] and waits == [7, 4]
    with pytest.raises(TimeoutError):
        list(S.paginate(lambda p: (429, [], {}), {}, tries=3, wait=waits.append))
    assert len(waits) == 4
    html = "<dl><dt>Topic</dt> <dd><b>Climate</b>  action</dd><dt class='x'>Topic</dt><dd></dd></dl><dt>Alone</dt>"
    r = S.page_parts(spark.createDataFrame([("u", html), ("v", None)], "url string, html string")).collect()
    assert [[tuple(m) for m in x["metadata"]] for x in r] == [[("Topic", "Climate action"), ("Topic", "")], []]


def test_entities_round_trip(spark, tmp_path):
    t = M.to_triples(S.debates(spark, put(tmp_path, "d.json", DEBATE)), "t")
    again = M.to_triples(M.entities(t), "t")
    assert as_set(again) == as_set(t)
    M.write_graph(t, f"{tmp_path}/g")
    assert as_set(M.read_graph(spark, f"{tmp_path}/g")) == as_set(t)
