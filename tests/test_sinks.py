import json

from polislake.__main__ import main
from polislake.functions.terms import TRIPLE_COLUMNS
from polislake.operators import model as M
from polislake.operators import sinks as K
from polislake.plans.parser import parse
from polislake.sources import adapters as S

DEBATE = {
    "@type": "del:DeliberationProcess", "del:identifier": "d1", "del:name": "Debate", "del:hasTopic": [{"del:identifier": "t1", "del:name": "Climate change policy"}, {"del:identifier": "t2", "del:name": "Climate change energy"}],
    "del:hasParticipant": [{"del:identifier": "p1", "del:name": "Ann"}], "del:hasContribution": [{"del:identifier": "c1", "del:text": "Everyone knows " + "x" * 600, "del:madeBy": {"@id": "p1"}}],
}
OWL = """<rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#" xmlns:rdfs="http://www.w3.org/2000/01/rdf-schema#" xmlns:owl="http://www.w3.org/2002/07/owl#">
<owl:Class rdf:about="http://o/A"><rdfs:subClassOf rdf:resource="http://o/B"/></owl:Class><owl:Class rdf:about="http://o/B"><rdfs:subClassOf rdf:resource="http://o/C"/></owl:Class>
<owl:ObjectProperty rdf:about="http://o/p"><rdfs:domain><owl:Class><owl:unionOf rdf:parseType="Collection"><rdf:Description rdf:about="http://o/A"/><rdf:Description rdf:about="http://o/B"/></owl:unionOf></owl:Class></rdfs:domain></owl:ObjectProperty></rdf:RDF>"""


def test_versions_documents_and_files(spark, tmp_path):
    (tmp_path / "d.json").write_text(json.dumps(DEBATE))
    e = S.debates(spark, f"{tmp_path}/d.json")
    t = M.to_triples(e, "x")
    rows = lambda df: {tuple(r[c] for c in TRIPLE_COLUMNS) for r in df.collect()}
    assert [K.save_version(t, f"{tmp_path}/g") for _ in range(3)] == [1, 2, 3]
    assert K.versions(spark, f"{tmp_path}/g") == [2, 3]
    assert rows(K.load_version(spark, f"{tmp_path}/g")) == rows(t)
    doc = K.process_documents(e).first()
    assert len(doc["topics"]) == 2 and len(doc["contributions"]) == 1
    K.write_documents(e, f"{tmp_path}/docs")
    assert spark.read.json(f"{tmp_path}/docs").first()["process"] == "d1"
    K.write_csv(e.tables["contribution"].select("id", "text"), f"{tmp_path}/csv", "text")
    assert len(spark.read.option("header", "true").csv(f"{tmp_path}/csv").first()["text"]) == 500
    K.write_statistics(t, f"{tmp_path}/stats")
    assert spark.read.json(f"{tmp_path}/stats").first()["topics"] == 2
    assert set(K.save_formats(t, f"{tmp_path}/formats").values()) == {"written"}
    assert K.save_formats(t, f"{tmp_path}/formats", ("nothing", "ntriples"))["ntriples"] == "written"
    for q in K.EXAMPLES.values():
        parse(q)
    assert "PREFIX del:" in K.example_text()


def test_ontology(spark, tmp_path):
    (tmp_path / "o").mkdir()
    (tmp_path / "o" / "ontology.owl").write_text(OWL)
    o = K.read_ontology(spark, f"{tmp_path}/o")
    assert {(r["class"], r["super"]) for r in K.superclasses(o).collect()} == {("http://o/A", "http://o/B"), ("http://o/A", "http://o/C"), ("http://o/B", "http://o/C")}


def test_command_line(spark, tmp_path, capsys):
    (tmp_path / "d.json").write_text(json.dumps(DEBATE))
    g = f"{tmp_path}/g"
    main(["integrate", g, f"debates={tmp_path}/d.json"])
    main(["query", g, "SELECT ?a ?b WHERE { ?a skos:related ?b }"])
    main(["stats", g])
    main(["report", g])
    main(["export", g, f"{tmp_path}/ttl"])
    main(["unify", f"{tmp_path}/u", f"{tmp_path}/ttl/*.txt"])
    assert K.load_version(spark, f"{tmp_path}/u").count() == K.load_version(spark, g).count()
    out = capsys.readouterr().out
    assert '"contributions":1' in out and "hasty generalization" in out and out.count('"type": "uri"') == 4
