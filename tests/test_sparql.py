import json

import pytest

from polislake.functions.terms import DEL, RDF, TRIPLE_SCHEMA, TYPE, XSD, canonical, iri
from polislake.plans.parser import SyntaxProblem, parse
from polislake.plans.results import sparql, sparql_json, values


@pytest.fixture(scope="module")
def g(spark):
    rows = []

    def t(s, p, o, kind="literal", dt=None, lang=None):
        rows.append((s, "uri", p if ":" in p else DEL + p, o, kind, dt, lang, "x"))

    for i in (1, 2, 3):
        t(f"p{i}", TYPE, DEL + "Participant", "uri")
        t(f"p{i}", "name", f"Name {i}")
    t("p1", "isAffiliatedWith", "o1", "uri")
    t("o1", "name", "Org")
    t("c1", TYPE, DEL + "Contribution", "uri")
    t("c1", "madeBy", "p1", "uri")
    t("c1", "text", "Héllo climate", lang="it")
    t("c1", "timestamp", "2024-01-01T00:00:00", dt=XSD + "dateTime")
    t("c1", "score", "5", dt=XSD + "integer")
    t("c2", TYPE, DEL + "Contribution", "uri")
    t("c2", "madeBy", "p2", "uri")
    t("c2", "text", "other")
    t("c2", "score", "7.5", dt=XSD + "decimal")
    t("c2", "responseTo", "c1", "uri")
    t("c3", "responseTo", "c2", "uri")
    t("c1", "responseTo", "c3", "uri")
    t("d1", TYPE, DEL + "DeliberationProcess", "uri")
    t("d1", "name", "Proc")
    t("d1", "hasContribution", "c1", "uri")
    return spark.createDataFrame(rows, TRIPLE_SCHEMA).persist()


CASES = [
    ("SELECT ?n WHERE { ?p a del:Participant ; del:name ?n } ORDER BY ?n", [("Name 1",), ("Name 2",), ("Name 3",)]),
    ("SELECT ?p ?on WHERE { ?p a del:Participant OPTIONAL { ?p del:isAffiliatedWith ?o . ?o del:name ?on } } ORDER BY ?p", [("p1", "Org"), ("p2", None), ("p3", None)]),
    ("SELECT ?p ?n WHERE { ?p a del:Participant OPTIONAL { ?p del:name ?n FILTER(?n = 'Name 2') } } ORDER BY ?p", [("p1", None), ("p2", "Name 2"), ("p3", None)]),
    ("SELECT (COUNT(DISTINCT ?a) AS ?x) (COUNT(DISTINCT ?b) AS ?y) WHERE { OPTIONAL { ?a a del:Participant } OPTIONAL { ?b a del:Contribution } }", [("3", "2")]),
    ("SELECT (COUNT(DISTINCT ?a) AS ?x) WHERE { OPTIONAL { ?a a del:Nothing } OPTIONAL { ?b a del:Contribution } }", [("0",)]),
    ('SELECT ?c WHERE { ?c del:text ?t FILTER(REGEX(?t, "HÉLLO", "i")) }', [("c1",)]),
    ('SELECT ?c WHERE { ?c del:text "other" }', [("c2",)]),
    ('SELECT ?c WHERE { ?c del:text "Héllo climate" }', []),
    ('SELECT ?c WHERE { ?c del:text "Héllo climate"@it }', [("c1",)]),
    ("SELECT ?p (COUNT(?c) AS ?n) WHERE { ?p a del:Participant OPTIONAL { ?c del:madeBy ?p } } GROUP BY ?p HAVING (?n < 1)", [("p3", "0")]),
    ("SELECT ?p WHERE { ?p a del:Participant MINUS { ?c del:madeBy ?p } }", [("p3",)]),
    ("SELECT ?p WHERE { ?p a del:Participant FILTER EXISTS { ?c del:madeBy ?p . ?c del:responseTo ?z } } ORDER BY ?p", [("p1",), ("p2",)]),
    ("SELECT ?x WHERE { ?x del:responseTo+ <c1> } ORDER BY ?x", [("c1",), ("c2",), ("c3",)]),
    ("SELECT ?n WHERE { <c1> del:madeBy/del:name ?n }", [("Name 1",)]),
    ("SELECT ?n WHERE { <p1> ^del:madeBy ?n }", [("c1",)]),
    ("SELECT ?n WHERE { <c1> (del:madeBy|del:responseTo) ?n } ORDER BY ?n", [("c3",), ("p1",)]),
    ("SELECT DISTINCT ?k ?v WHERE { { ?k del:name ?v } UNION { ?k del:text ?v } } ORDER BY DESC(?v) LIMIT 2", [("c2", "other"), ("d1", "Proc")]),
    ("SELECT * WHERE { VALUES ?p { <p1> <p9> } ?p del:name ?n }", [("p1", "Name 1")]),
    ("SELECT ?p ?x WHERE { VALUES (?p ?x) { (<p1> UNDEF) (UNDEF 2) } ?p a del:Participant } ORDER BY ?p", [("p1", None), ("p1", "2"), ("p2", "2"), ("p3", "2")]),
    ("SELECT (SUM(?s) AS ?a) (MIN(?s) AS ?b) (AVG(?s) AS ?d) WHERE { ?c del:score ?s }", [("12.5", "5", "6.25")]),
    ('SELECT (GROUP_CONCAT(?n; SEPARATOR="|") AS ?s) WHERE { ?p a del:Participant ; del:name ?n }', [("Name 1|Name 2|Name 3",)]),
    ("SELECT ?c WHERE { ?c del:score ?s FILTER(?s >= 5 && ?s < 6) }", [("c1",)]),
    ('SELECT ?c WHERE { ?c del:score ?s FILTER(?s = 5.0) }', [("c1",)]),
    ("SELECT ?c WHERE { ?c del:text ?t FILTER(?t > 3 || BOUND(?t)) } ORDER BY ?c", [("c1",), ("c2",)]),
    ("SELECT ?c WHERE { ?c del:text ?t FILTER(!(?t > 3)) }", []),
    ('SELECT ?c (YEAR(?t) + 1 AS ?y) WHERE { ?c del:timestamp ?t FILTER(?t < "2025-01-01T00:00:00Z"^^xsd:dateTime) }', [("c1", "2025")]),
    ('SELECT (STRAFTER(STR(?t), "#") AS ?x) WHERE { <d1> a ?t }', [("DeliberationProcess",)]),
    ('SELECT (IF(?s > 6, "high", "low") AS ?x) (COALESCE(?none, "d") AS ?y) WHERE { ?c del:score ?s } ORDER BY ?x', [("high", "d"), ("low", "d")]),
    ('SELECT (CONCAT(UCASE("a"), LCASE("B"), STR(STRLEN("xyz"))) AS ?x) (LANG(?t) AS ?l) WHERE { <c1> del:text ?t }', [("Ab3", "it")]),
    ("SELECT ?s WHERE { { SELECT ?s WHERE { ?s a del:Participant } ORDER BY DESC(?s) LIMIT 1 } }", [("p3",)]),
    ("SELECT ?n WHERE { ?p a del:Participant ; del:name ?n } ORDER BY ?n OFFSET 1 LIMIT 1", [("Name 2",)]),
    ("SELECT ?p ?o WHERE { <o1> ?p ?o }", [(DEL + "name", "Org")]),
    ("SELECT ?x WHERE { ?x del:madeBy [ del:name 'Name 2' ] }", [("c2",)]),
    ("SELECT (COUNT(*) AS ?n) WHERE { ?s ?p ?o }", [("23",)]),
]


@pytest.mark.parametrize(("text", "want"), CASES)
def test_select(g, text, want):
    got = [tuple(r) for r in values(sparql(g, text)).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    if "ORDER BY" in text and "{ SELECT" not in text:
        assert got == want


def test_compatibility_join(g):
    text = "SELECT ?p ?o ?n WHERE { { ?p a del:Participant OPTIONAL { ?p del:isAffiliatedWith ?o } } { ?o del:name ?n FILTER(?n = 'Org') } } ORDER BY ?p"
    assert [tuple(r) for r in values(sparql(g, text)).collect()] == [("p1", "o1", "Org"), ("p2", "o1", "Org"), ("p3", "o1", "Org")]


def test_other_forms(g):
    assert sparql(g, "ASK { ?x del:name 'Org' }") is True
    assert sparql(g, "ASK { ?x del:name 'No' }") is False
    made = sparql(g, "CONSTRUCT { ?p del:knows ?c } WHERE { ?c del:madeBy ?p OPTIONAL { ?c del:none ?z } }")
    assert sorted((r["s"], r["o"]) for r in made.collect()) == [("p1", "c1"), ("p2", "c2")]
    assert sparql(g, "DESCRIBE <o1>").count() == 1
    assert sparql(g, "DESCRIBE ?x WHERE { ?x a del:DeliberationProcess }").count() == 3


def test_results_document(g):
    doc = json.loads(sparql_json(sparql(g, "SELECT ?t ?n ?z WHERE { <c1> del:text ?t ; del:score ?n }")))
    assert doc["head"]["vars"] == ["t", "n", "z"]
    assert doc["results"]["bindings"] == [{"t": {"type": "literal", "value": "Héllo climate", "xml:lang": "it"}, "n": {"type": "literal", "value": "5", "datatype": XSD + "integer"}}]
    assert json.loads(sparql_json(sparql(g, "SELECT ?a WHERE { ?a a <nothing:x> }"))) == {"head": {"vars": ["a"]}, "results": {"bindings": []}}


def test_bound_parameters(g):
    got = values(sparql(g, "SELECT ?n WHERE { ?p del:name ?n }", {"p": iri("p2")})).collect()
    assert [r["n"] for r in got] == ["Name 2"]


@pytest.mark.parametrize("text", ["", "SELECT", "SELECT ?x { ?x", "SELECT ?x WHERE { ?x no:p ?y }", "SELECT ?x WHERE { ?x a ?y } LIMIT 5 more"])
def test_syntax(text):
    with pytest.raises(SyntaxProblem):
        parse(text)


def test_canonical(spark):
    rows = [("c", "uri", DEL + "respondsTo", "b", "uri", None, None, "x"), ("c", "uri", DEL + "partOf", "p", "uri", None, None, "x")]
    got = sorted((r["s"], r["p"], r["o"]) for r in canonical(spark.createDataFrame(rows, TRIPLE_SCHEMA)).collect())
    assert got == [("c", DEL + "responseTo", "b"), ("p", DEL + "hasContribution", "c")]
    assert RDF
