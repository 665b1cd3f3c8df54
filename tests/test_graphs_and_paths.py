"""Named graphs, paths from a bound end and joins by containment, against small graphs worked out by hand or by brute force."""

import random

import pytest
from pyspark.sql import functions as F

from polislake.functions import terms as T
from polislake.functions.grams import contained_between, grams
from polislake.functions.terms import DEL, GRAPHS, TRIPLE_SCHEMA, iri
from polislake.plans import compile as C
from polislake.plans import paths as P
from polislake.plans.parser import SyntaxProblem, parse
from polislake.plans.results import sparql, values

A, B = "http://example.org/a", "b"


@pytest.fixture(scope="module")
def q(spark):
    rows = []

    def t(src, s, p, o, kind="uri"):
        rows.append((s, "uri", DEL + p, o, kind, None, None, src))

    for src in (A, B):  # in both graphs
        t(src, "x", "name", "X", "literal")
    t(A, "x", "knows", "y")
    t(A, "y", "name", "Y", "literal")
    t(B, "y", "knows", "z")
    t(B, "z", "name", "Z", "literal")
    t(B, A, "name", "the graph a", "literal")
    t("c", "y", "name", "Why", "literal")
    return spark.createDataFrame(rows, TRIPLE_SCHEMA).persist()


G = {"a": A, "b": GRAPHS + "b", "c": GRAPHS + "c"}
GRAPH_CASES = [
    ("SELECT ?s ?n WHERE { ?s del:name ?n }", [("x", "X"), ("y", "Y"), ("z", "Z"), (A, "the graph a"), ("y", "Why")]),
    ("SELECT ?s ?n WHERE { GRAPH <%(a)s> { ?s del:name ?n } }", [("x", "X"), ("y", "Y")]),
    ("SELECT ?s ?n WHERE { GRAPH <%(b)s> { ?s del:name ?n } }", [("x", "X"), ("z", "Z"), (A, "the graph a")]),
    ("SELECT ?s WHERE { GRAPH <http://no/such> { ?s del:name ?n } }", []),
    ("SELECT ?s WHERE { GRAPH <b> { ?s del:name ?n } }", []),
    ("SELECT ?g ?s WHERE { GRAPH ?g { ?s del:name 'X' } }", [("%(a)s", "x"), ("%(b)s", "x")]),
    ("SELECT ?g ?n WHERE { GRAPH ?g { ?s del:knows ?o . ?s del:name ?n } }", [("%(a)s", "X")]),
    ("SELECT ?n ?m WHERE { GRAPH <%(a)s> { ?s del:knows ?o ; del:name ?n } GRAPH <%(c)s> { ?o del:name ?m } }", [("X", "Why")]),
    ("SELECT ?g ?n ?o WHERE { GRAPH ?g { ?s del:name ?n OPTIONAL { ?s del:knows ?o } } } ", [("%(a)s", "X", "y"), ("%(a)s", "Y", None), ("%(b)s", "X", None), ("%(b)s", "Z", None), ("%(b)s", "the graph a", None), ("%(c)s", "Why", None)]),
    ("SELECT ?g ?n WHERE { GRAPH ?g { ?g del:name ?n } }", []),
    ("SELECT ?g ?n WHERE { ?g del:name ?n GRAPH ?g { ?s del:knows ?o } }", [("%(a)s", "the graph a")]),
    ("SELECT ?g WHERE { GRAPH ?g { } }", [("%(a)s",), ("%(b)s",), ("%(c)s",)]),
    ("SELECT ?g ?s WHERE { GRAPH ?g { VALUES ?s { <x> <z> } ?s del:name ?n MINUS { ?s del:knows ?o } } }", [("%(b)s", "x"), ("%(b)s", "z")]),
    ("SELECT ?g ?s WHERE { GRAPH ?g { ?s del:name ?n MINUS { ?t del:knows ?o } } }", [("%(a)s", "x"), ("%(a)s", "y"), ("%(b)s", "x"), ("%(b)s", "z"), ("%(b)s", A), ("%(c)s", "y")]),
    ("SELECT ?g ?s WHERE { GRAPH ?g { ?s del:name ?n FILTER NOT EXISTS { ?s del:knows ?o } } }", [("%(a)s", "y"), ("%(b)s", "x"), ("%(b)s", "z"), ("%(b)s", A), ("%(c)s", "y")]),
    ("SELECT ?g ?k WHERE { GRAPH ?g { { SELECT ?p (COUNT(?s) AS ?k) WHERE { ?s ?p ?n } GROUP BY ?p } FILTER(?k > 1) } }", [("%(a)s", "2"), ("%(b)s", "3")]),
    ("SELECT ?g ?o WHERE { GRAPH ?g { <x> del:knows+ ?o } }", [("%(a)s", "y")]),
    ("SELECT ?g ?s ?o WHERE { GRAPH ?g { ?s del:knows* ?o FILTER(?s != ?o) } }", [("%(a)s", "x", "y"), ("%(b)s", "y", "z")]),
    ("SELECT ?g ?o WHERE { GRAPH ?g { ?s del:name 'X' . ?s del:knows* ?o } }", [("%(a)s", "x"), ("%(a)s", "y"), ("%(b)s", "x")]),
    ("SELECT ?o WHERE { <x> del:knows+ ?o }", [("y",), ("z",)]),
    ("SELECT ?o FROM <%(a)s> WHERE { <x> del:knows+ ?o }", [("y",)]),
    ("SELECT ?s ?n FROM <%(a)s> FROM <%(b)s> WHERE { ?s del:name ?n }", [("x", "X"), ("y", "Y"), ("z", "Z"), (A, "the graph a")]),
    ("SELECT ?s FROM NAMED <%(a)s> WHERE { ?s del:name ?n }", []),
    ("SELECT ?s FROM <%(c)s> FROM NAMED <%(a)s> WHERE { ?s del:name ?n GRAPH ?g { ?s del:name ?m } }", [("y",)]),
    ("SELECT ?s FROM NAMED <%(a)s> WHERE { GRAPH <%(b)s> { ?s del:name ?n } }", []),
]


@pytest.mark.parametrize(("text", "want"), GRAPH_CASES)
def test_graphs(q, text, want):
    got = values(sparql(q, text % G, quads=True)).collect()
    assert sorted(map(tuple, got), key=str) == sorted((tuple(x % G if isinstance(x, str) and "%(" in x else x for x in row) for row in want), key=str)


def test_graphs_of_other_forms(spark, q):
    assert sparql(q, "ASK FROM <%(c)s> WHERE { <x> del:name ?n }" % G) is False
    assert sparql(q, "DESCRIBE <y> FROM <%(a)s> FROM <%(c)s>" % G).count() == 2
    made = sparql(q, "CONSTRUCT { ?g del:has ?s } FROM NAMED <%(b)s> WHERE { GRAPH ?g { ?s del:knows ?o } }" % G)
    assert [(r["s"], r["o"]) for r in made.collect()] == [(G["b"], "y")]
    assert [r["s"] for r in values(sparql(q, "SELECT ?s WHERE { GRAPH ?g { ?s del:knows ?o } }", {"g": iri(G["b"])}, quads=True)).collect()] == ["y"]
    assert T.quads(q, q).count() == q.count()
    with pytest.raises(ValueError, match="no column src"):
        sparql(q.drop("src"), "SELECT ?s WHERE { GRAPH ?g { ?s ?p ?o } }")
    for text in ("SELECT ?s WHERE { GRAPH 'a' { ?s ?p ?o } }", "SELECT ?s FROM ?g WHERE { ?s ?p ?o }", "SELECT ?s WHERE { { SELECT ?s FROM <a:b> WHERE { ?s ?p ?o } } }", "SELECT ?s WHERE { SERVICE <a:b> { ?s ?p ?o } }"):
        with pytest.raises(SyntaxProblem):
            parse(text)
    for text in ("SELECT ?s WHERE { GRAPH ?g { SELECT ?s WHERE { ?s ?p ?o } LIMIT 1 } }", "SELECT ?n WHERE { GRAPH ?g { SELECT (COUNT(?s) AS ?n) WHERE { ?s ?p ?o } } }"):
        with pytest.raises(NotImplementedError):
            sparql(q, text)


# Paths
def net(spark, seed, n=12, m=14, chain=10):
    rng = random.Random(seed)
    edges = {(f"n{rng.randrange(n)}", rng.choice("pq"), f"n{rng.randrange(n)}") for _ in range(m)} | {(f"k{i}", "p", f"k{i + 1}") for i in range(chain)}
    return edges, spark.createDataFrame([(s, "uri", DEL + p, o, "uri", None, None, "t") for s, p, o in sorted(edges)], TRIPLE_SCHEMA).persist()


def walk(edges, steps, start, least):
    """What a walk by `steps` (label, forward) reaches from a node, by at least so many steps (0 or 1)."""
    nxt = lambda x: {o for s, p, o in edges for lab, fw in steps if p == lab and fw and s == x} | {s for s, p, o in edges for lab, fw in steps if p == lab and not fw and o == x}
    seen, todo = set(), {start}
    while todo:
        todo = set().union(*map(nxt, todo)) - seen
        seen |= todo
    return seen | ({start} if least == 0 else set())


PATHS = [("del:p+", [("p", 1)], 1), ("del:p*", [("p", 1)], 0), ("(del:p|del:q)+", [("p", 1), ("q", 1)], 1), ("(del:p|^del:q)*", [("p", 1), ("q", 0)], 0), ("(^del:p)+", [("p", 0)], 1)]


@pytest.mark.parametrize(("path", "steps", "least"), PATHS)
def test_bound_ends(spark, path, steps, least):
    edges, g = net(spark, 7)
    nodes = {x for s, _, o in edges for x in (s, o)}
    for start in ("k0", "n3") if least else ("n3", "nowhere"):
        ahead = sorted(r["y"] for r in values(sparql(g, f"SELECT ?y WHERE {{ <{start}> {path} ?y }}")).collect())
        assert ahead == sorted(walk(edges, steps, start, least))
        back = sorted(r["y"] for r in values(sparql(g, f"SELECT ?y WHERE {{ ?y {path} <{start}> }}")).collect())
        assert back == sorted(walk(edges, [(p, not f) for p, f in steps], start, least))
    both = sparql(g, f"ASK {{ <k0> {path} <k6> }}")
    assert both is ("k6" in walk(edges, steps, "k0", least))
    free = {tuple(r) for r in values(sparql(g, f"SELECT ?x ?y WHERE {{ ?x {path} ?y }}")).collect()}
    assert free == {(x, y) for x in nodes for y in walk(edges, steps, x, least)}


def test_nested_paths(spark):
    edges, g = net(spark, 11)
    step = lambda xs, p: {o for s, lab, o in edges for x in xs if lab == p and s == x}
    twice = lambda x: step(step({x}, "p"), "q")
    for start in ("n1", "n5"):
        seen, todo = set(), {start}
        while todo:
            todo = set().union(*map(twice, todo)) - seen
            seen |= todo
        assert {r["y"] for r in values(sparql(g, f"SELECT ?y WHERE {{ <{start}> (del:p/del:q)+ ?y }}")).collect()} == seen
        assert {r["y"] for r in values(sparql(g, f"SELECT ?y WHERE {{ <{start}> del:p?/del:q* ?y }}")).collect()} == {y for x in step({start}, "p") | {start} for y in walk(edges, [("q", 1)], x, 0)}


def test_closure_from_bound_variables(spark, monkeypatch):
    """The values that other patterns leave are where a closure starts: only pairs that they reach are ever written."""
    edges, g = net(spark, 3, n=200, m=300, chain=40)
    made = []
    real = P.written

    def watch(df, tag):
        out, path = real(df, tag)
        made.append((tag, out.count()))
        return out, path

    monkeypatch.setattr(P, "written", watch)
    text = "SELECT ?x ?y WHERE { ?x del:p <k36> . ?x del:p+ ?y }"
    got = {tuple(r) for r in values(sparql(g, text)).collect()}
    assert got == {("k35", y) for y in walk(edges, [("p", 1)], "k35", 1)}
    assert sum(n for tag, n in made if tag == "reached") == len(got) and not any(tag in ("path", "power") for tag, _ in made)
    made.clear()
    monkeypatch.setattr(C, "MANY", 10**6)  # a good part of all nodes: as a whole
    assert {tuple(r) for r in values(sparql(g, text)).collect()} == got
    assert any(tag == "power" for tag, _ in made)


# Containment
def test_contained_between(spark):
    rng = random.Random(5)
    words = ["", "a", "ab", "éa", "😀b", "abc", "bca"] + ["".join(rng.choice("abé") for _ in range(rng.randrange(1, 9))) for _ in range(120)]
    inner, outer = sorted(set(words[:90])), sorted(set(words[40:]) | {"", "abc"})
    frame = lambda xs: spark.createDataFrame([(x,) for x in xs], "n string")
    got = [tuple(r) for r in contained_between(frame(inner), frame(outer)).collect()]
    assert sorted(got) == sorted((x, y) for x in inner for y in outer if x in y)
    assert contained_between(frame(inner).limit(0), frame(outer)).count() == 0 and contained_between(frame(inner), frame(outer).limit(0)).count() == 0
    assert spark.range(1).select(grams(F.lit("abab"), 2).alias("g"), grams(F.lit("a"), 2).alias("h")).first().asDict() == {"g": ["ab", "ba"], "h": []}


def topics(spark):
    names = ["Climate", "climate action", "Action", "", "mate", "Tax", "tax", "Taxes"]
    rows = []
    for i, n in enumerate(names):
        d = f"d{i % 3}"
        rows += [(d, "uri", DEL + "hasTopic", f"t{i}", "uri", None, None, "x"), (f"t{i}", "uri", DEL + "name", n, "literal", None, None, "x")]
    return names, spark.createDataFrame(rows, TRIPLE_SCHEMA).persist()


@pytest.mark.parametrize("both", [True, False])
def test_containment_joins_by_grams(spark, both):
    names, g = topics(spark)
    test = "CONTAINS(LCASE(?m), LCASE(?n))" + (" || CONTAINS(LCASE(?n), LCASE(?m))" if both else "")
    text = f"SELECT ?a ?n ?b ?m WHERE {{ ?a del:hasTopic ?x . ?x del:name ?n . ?b del:hasTopic ?y . ?y del:name ?m FILTER(?a != ?b) FILTER(STRLEN(?n) > 0) FILTER({test}) }}"
    df = sparql(g, text)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and plan.count("BroadcastNestedLoopJoin") <= 2  # the empty name alone, one row at most, each way
    inside = lambda x, y: x.lower() in y.lower()
    want = [(f"d{i % 3}", n, f"d{j % 3}", m) for i, n in enumerate(names) for j, m in enumerate(names) if i % 3 != j % 3 and n and (inside(n, m) or both and inside(m, n))]
    assert sorted(tuple(r) for r in values(df).collect()) == sorted(want)


def test_other_containments_stay_filters(spark):
    _, g = topics(spark)
    text = "SELECT ?n ?m WHERE { ?x del:name ?n . ?y del:name ?m FILTER(CONTAINS(?n, ?m) || STRLEN(?n) > 6) }"
    names = topics(spark)[0]
    assert sorted(tuple(r) for r in values(sparql(g, text)).collect()) == sorted((n, m) for n in names for m in names if m in n or len(n) > 6)


def test_patterns_that_a_union_connects(spark):
    rows = [(f"p{i}", "uri", DEL + "name", f"N{i}", "literal", None, None, "x") for i in range(6)] + [("p0", "uri", T.OWL + "sameAs", "p1", "uri", None, None, "x"), ("p2", "uri", T.SKOS + "related", "p3", "uri", None, None, "x")]
    g = spark.createDataFrame(rows, TRIPLE_SCHEMA).persist()
    df = sparql(g, "SELECT ?n ?m ?r WHERE { ?p del:name ?n . ?q del:name ?m { ?p owl:sameAs ?q BIND('same' AS ?r) } UNION { ?p skos:related ?q BIND('near' AS ?r) } }")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan
    assert sorted(map(tuple, values(df).collect())) == [("N0", "N1", "same"), ("N2", "N3", "near")]
    apart = sparql(g, "SELECT ?n ?m WHERE { { ?p del:name ?n . ?q del:name ?m } { ?p owl:sameAs ?x } }")
    assert len({r["m"] for r in apart.collect()}) == 6 and apart.count() == 6
