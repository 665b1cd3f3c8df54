"""Turtle read in splits against the same text parsed as a whole."""

import re
from collections import Counter

import pytest

from polislake.functions.terms import TRIPLE_COLUMNS
from polislake.sources import rdf, turtle
from polislake.sources.rdf import parse_turtle, read_rdf
from polislake.sources.turtle import read_turtle

HEAD = '@prefix ex: <http://ex/> .\nPREFIX del: <http://del/>\n# a comment with """ and a stop.\n'
BODY = "".join(
    f'''ex:s{i} a ex:Thing ;
    ex:name "name {i}. " , "it's {i}"@en ;  # stop.
    ex:long """first
line {i}.
# no comment.
last "quoted" {i}.""" ;
    ex:n {i}.5 , {i} .
_:b{i % 3} ex:of ex:s{i} . ex:t{i} ex:x true .
ex:u{i} ex:address [ ex:city "c{i}" ; ex:zip "{i}" ] ;
  ex:list ( 1 "two" ex:three ) .

'''
    for i in range(12)
)


def shape(rows):
    """Triples with blank nodes told by what they are, not by their names."""
    labelled = lambda v: m[0] if (m := re.search(r"b\d$", v)) else "blank"
    tell = lambda v, k: labelled(v) if k == "bnode" else v
    return Counter((tell(r[0], r[1]), r[1], r[2], tell(r[3], r[4]), *r[4:7]) for r in rows)


def read(spark, path, split):
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    before = {k: spark.conf.get(k) for k in names}
    try:
        spark.conf.set(names[0], str(split))
        spark.conf.set(names[1], "1")
        return read_turtle(spark, path).collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


@pytest.mark.parametrize("split", [700, 10**8])
def test_splits(spark, tmp_path, split, monkeypatch):
    monkeypatch.setattr(turtle, "read_whole", None)  # no file needs it
    (tmp_path / "a.ttl").write_text(HEAD + BODY)
    got = [tuple(r[c] for c in TRIPLE_COLUMNS) for r in read(spark, f"{tmp_path}/a.ttl", split)]
    assert shape(got) == shape(set(parse_turtle(HEAD + BODY)))
    blanks = {r[0] for r in got if r[1] == "bnode"}
    assert len(blanks) == 3 + 12 + 36  # three labels, an address and three list cells each
    cities = {r[0]: r[3] for r in got if r[2] == "http://ex/city"}
    assert all(cities[r[0]] == f"c{r[3]}" for r in got if r[2] == "http://ex/zip")


def test_files_that_are_read_as_a_whole(spark, tmp_path):
    (tmp_path / "a.ttl").write_text(HEAD + BODY)
    (tmp_path / "b.ttl").write_text('@prefix ex: <http://one/> .\nex:a ex:b "x" .\n@prefix ex: <http://two/> .\nex:a ex:b "y" .\n')
    (tmp_path / "c.ttl").write_text("@base <http://base/> .\n<a> <b> <c> .\n")
    (tmp_path / "d.ttl").write_text("@prefix ex: <http://ex/> .\nex:a ex:b '''one.\ntwo.''' .\nex:c ex:d ex:e .\n")  # long strings of the other kind
    (tmp_path / "e.ttl").write_text("")
    got = read(spark, f"{tmp_path}/*.ttl", 500)
    by_file = {f: [tuple(r[c] for c in TRIPLE_COLUMNS) for r in got if r["src"] == f"{f}.ttl"] for f in "abcde"}
    assert sorted(r[0] + r[3] for r in by_file["b"]) == ["http://one/ax", "http://two/ay"] and [r[:3] for r in by_file["c"]] == [("http://base/a", "uri", "http://base/b")]
    assert sorted(r[3] for r in by_file["d"]) == ["http://ex/e", "one.\ntwo."] and not by_file["e"]
    assert shape(by_file["a"]) == shape(set(parse_turtle(HEAD + BODY)))
    (tmp_path / "f.ttl").write_text("ex:a ex:b .\n")
    with pytest.raises(Exception, match="cannot be read"):
        read(spark, f"{tmp_path}/f.ttl", 500)


def test_large_files_go_through_splits(spark, tmp_path, monkeypatch):
    (tmp_path / "a.ttl").write_text(HEAD + BODY)
    whole = shape(tuple(r[c] for c in TRIPLE_COLUMNS) for r in read_rdf(spark, f"{tmp_path}/a.ttl").collect())
    monkeypatch.setattr(rdf, "LARGE", 100)
    assert shape(tuple(r[c] for c in TRIPLE_COLUMNS) for r in read_rdf(spark, f"{tmp_path}/a.ttl").collect()) == whole
