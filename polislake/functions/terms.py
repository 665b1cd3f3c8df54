"""RDF terms in Spark columns.

A triple row is s, s_kind, p, o, o_kind, o_dt, o_lang, src; its identity is all but src. In query plans a term is one string, so that
term equality is string equality: `<` and an IRI, `_` and a blank node's name, or `"`, a tag (nothing, `@` and a language, `^` and a datatype),
`|` and the lexical form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Vocabulary addresses that the data uses.
DEL = "https://w3id.org/deliberation/ontology#"
RES = "https://w3id.org/deliberation/resource/"
RDF = "http://www.w3.org/1999/02/22-rdf-syntax-ns#"
RDFS = "http://www.w3.org/2000/01/rdf-schema#"
OWL = "http://www.w3.org/2002/07/owl#"
SKOS = "http://www.w3.org/2004/02/skos/core#"
XSD = "http://www.w3.org/2001/XMLSchema#"
FOAF = "http://xmlns.com/foaf/0.1/"
DCT = "http://purl.org/dc/terms/"
PREFIXES = {"del": DEL, "rdf": RDF, "rdfs": RDFS, "owl": OWL, "skos": SKOS, "xsd": XSD, "foaf": FOAF, "dct": DCT}
TYPE = RDF + "type"
#: A graph is named by its source: by the source itself if that is an address, else below this one.
GRAPHS = RES + "graph/"

TRIPLE_COLUMNS = ("s", "s_kind", "p", "o", "o_kind", "o_dt", "o_lang")
TRIPLE_SCHEMA = "s string, s_kind string, p string, o string, o_kind string, o_dt string, o_lang string, src string"

#: Predicates that sources use for the canonical ones.
SYNONYMS = {
    DEL + "respondsTo": DEL + "responseTo",
    DEL + "hasTimestamp": DEL + "timestamp",
    DCT + "created": DEL + "timestamp",
    DEL + "isAbout": DEL + "hasTopic",
    DEL + "containsArgument": DEL + "hasArgument",
    DEL + "hasFallacy": DEL + "containsFallacy",
    DEL + "hasFallacies": DEL + "containsFallacy",
}
NUMERIC = tuple(XSD + x for x in ("integer", "decimal", "double", "float", "int", "long", "short", "byte", "nonNegativeInteger", "positiveInteger"))


def literal_tag(dt: Column, lang: Column) -> Column:
    plain = dt.isNull() | (dt == XSD + "string")
    return F.when(lang.isNotNull(), F.concat(F.lit("@"), F.lower(lang))).when(plain, F.lit("")).otherwise(F.concat(F.lit("^"), dt))


def encode(value: Column, kind: Column, dt: Column | None = None, lang: Column | None = None) -> Column:
    none = F.lit(None).cast("string")
    tag = literal_tag(dt if dt is not None else none, lang if lang is not None else none)
    return F.when(kind == "uri", F.concat(F.lit("<"), value)).when(kind == "bnode", F.concat(F.lit("_"), value)).otherwise(F.concat(F.lit('"'), tag, F.lit("|"), value))


def iri(x: str) -> str:
    return "<" + x


def literal(x: str, dt: str | None = None, lang: str | None = None) -> str:
    tag = f"@{lang.lower()}" if lang else "" if dt in (None, XSD + "string") else "^" + dt
    return f'"{tag}|{x}'


def is_literal(t: Column) -> Column:
    return t.startswith('"')


def lexical(t: Column) -> Column:
    """STR(): the lexical form or the IRI."""
    return F.when(is_literal(t), F.substring(t, F.locate("|", t) + 1, F.length(t))).otherwise(F.substring(t, F.lit(2), F.length(t)))


def tag(t: Column) -> Column:
    return F.when(is_literal(t), F.substring(t, F.lit(2), F.locate("|", t) - 2))


def datatype(t: Column) -> Column:
    g = tag(t)
    return F.when(g == "", F.lit(XSD + "string")).when(g.startswith("@"), F.lit(RDF + "langString")).when(g.startswith("^"), F.substring(g, F.lit(2), F.length(g)))


def language(t: Column) -> Column:
    g = tag(t)
    return F.when(g.startswith("@"), F.substring(g, F.lit(2), F.length(g))).when(g.isNotNull(), F.lit(""))


def _typed(t: Column, names: tuple[str, ...]) -> Column:
    return t.rlike(r'^"\^' + XSD.replace(".", r"\.") + "(" + "|".join(n.removeprefix(XSD) for n in names) + r")\|")


def number(t: Column) -> Column:
    """The value of a numeric literal, else null."""
    return F.when(_typed(t, NUMERIC), F.substring_index(t, "|", -1).try_cast("double"))


def moment(t: Column) -> Column:
    """The value of a date or dateTime literal (no zone: UTC), else null."""
    return F.when(_typed(t, ("dateTime", "date")), F.try_to_timestamp(F.substring_index(t, "|", -1)))


def make_literal(value: Column, dt: str | None = None) -> Column:
    return F.concat(F.lit(f'"{"^" + dt if dt else ""}|'), value.cast("string"))


def graph_name(src: Column) -> Column:
    """The encoded name of the graph of a source."""
    return F.concat(F.lit("<"), F.when(src.contains(":"), src).otherwise(F.concat(F.lit(GRAPHS), src)))


def in_graphs(names: list[str]) -> Column:
    """Triples of the graphs with these (encoded) names, as a filter that scans take."""
    found = set()
    for name in (n[1:] for n in names):
        below = name.removeprefix(GRAPHS)
        found |= {name} if ":" in name else set()
        found |= {below} if below != name and ":" not in below else set()
    return F.col("src").isin(sorted(found)) if found else F.lit(False)


def canonical(triples: DataFrame) -> DataFrame:
    """Synonymous predicates under their canonical names; partOf is turned into hasContribution."""
    named = F.create_map(*[F.lit(x) for pair in SYNONYMS.items() for x in pair])
    part_of = F.col("p") == DEL + "partOf"
    none = F.lit(None).cast("string")
    return triples.select(
        F.when(part_of, F.col("o")).otherwise(F.col("s")).alias("s"), F.when(part_of, F.col("o_kind")).otherwise(F.col("s_kind")).alias("s_kind"),
        F.when(part_of, F.lit(DEL + "hasContribution")).otherwise(F.coalesce(named[F.col("p")], F.col("p"))).alias("p"),
        F.when(part_of, F.col("s")).otherwise(F.col("o")).alias("o"), F.when(part_of, F.col("s_kind")).otherwise(F.col("o_kind")).alias("o_kind"),
        F.when(part_of, none).otherwise(F.col("o_dt")).alias("o_dt"), F.when(part_of, none).otherwise(F.col("o_lang")).alias("o_lang"), "src",
    )


def graph(*parts: DataFrame) -> DataFrame:
    """The union of triple tables, as a set."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.dropDuplicates(list(TRIPLE_COLUMNS))


def quads(*parts: DataFrame) -> DataFrame:
    """The union of triple tables, as a set of triples in each source: named graphs stay whole."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.dropDuplicates([*TRIPLE_COLUMNS, "src"])


def added(before: DataFrame, after: DataFrame) -> DataFrame:
    """The triples of `after` that `before` lacks."""
    on = None
    b = before.select(*[F.col(c).alias(f"b_{c}") for c in TRIPLE_COLUMNS])
    for c in TRIPLE_COLUMNS:
        same = F.col(c).eqNullSafe(F.col(f"b_{c}"))
        on = same if on is None else on & same
    return after.join(b, on, "left_anti")
