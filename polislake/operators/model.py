"""Entities and the triples that stand for them.

An adapter returns Entities: named tables of ids, attributes and links. `to_triples` is the one mapper from entities to triples; `views` derives entity
and link tables from any triple table."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.terms import DCT, DEL, OWL, RES, RDFS, SKOS, TRIPLE_COLUMNS, TRIPLE_SCHEMA, TYPE, XSD

# Class and property names by table and column.
CLASSES = {
    "process": "DeliberationProcess", "participant": "Participant", "contribution": "Contribution", "topic": "Topic", "organization": "Organization", "role": "Role",
    "argument": "Argument", "premise": "Premise", "conclusion": "Conclusion", "fallacy": "FallacyType",
}
#: Attribute columns: predicate and datatype.
ATTRIBUTES = {
    "identifier": (DEL + "identifier", None), "name": (DEL + "name", None), "text": (DEL + "text", None), "timestamp": (DEL + "timestamp", XSD + "dateTime"), "start_date": (DEL + "startDate", XSD + "dateTime"),
    "end_date": (DEL + "endDate", XSD + "dateTime"), "platform": (DEL + "platform", None), "description": (DEL + "description", None), "country": (DEL + "country", None), "participant_type": (DEL + "participantType", None),
    "url": (DEL + "url", XSD + "anyURI"), "confidence": (DEL + "hasConfidence", XSD + "float"), "segment": (DEL + "segment", None), "language": (DCT + "language", None), "source": (DCT + "source", None), "label": (RDFS + "label", None),
}
LINKS = {
    "has_participant": DEL + "hasParticipant", "has_contribution": DEL + "hasContribution", "has_topic": DEL + "hasTopic", "made_by": DEL + "madeBy", "affiliated": DEL + "isAffiliatedWith", "has_role": DEL + "hasRole",
    "response_to": DEL + "responseTo", "has_argument": DEL + "hasArgument", "has_premise": DEL + "hasPremise", "has_conclusion": DEL + "hasConclusion", "contains_fallacy": DEL + "containsFallacy",
    "supports": DEL + "supports", "attacks": DEL + "attacks", "same_as": OWL + "sameAs", "related": SKOS + "related", "broader": SKOS + "broader", "narrower": SKOS + "narrower", "follows": DEL + "follows",
}


@dataclass
class Entities:
    """tables: class name -> (id, attributes...); links: link name -> (source, target). Ids are full addresses."""

    tables: dict[str, DataFrame] = field(default_factory=dict)
    links: dict[str, DataFrame] = field(default_factory=dict)

    def __add__(self, other: Entities) -> Entities:
        out = Entities(dict(self.tables), dict(self.links))
        for mine, theirs in ((out.tables, other.tables), (out.links, other.links)):
            for k, df in theirs.items():
                mine[k] = mine[k].unionByName(df, allowMissingColumns=True) if k in mine else df
        return out


def address(*parts) -> F.Column:
    """A resource address from columns and texts."""
    return F.concat(F.lit(RES), *[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def to_triples(e: Entities, src: str) -> DataFrame:
    """All triples of the entities, as a set. Null and empty attributes give none."""
    none = F.lit(None).cast("string")

    def rows(df: DataFrame, items: list) -> DataFrame:
        cells = [F.struct(s.alias("s"), F.lit("uri").alias("s_kind"), F.lit(p).alias("p"), o.cast("string").alias("o"), F.lit(kind).alias("o_kind"), F.lit(dt).cast("string").alias("o_dt"), none.alias("o_lang"), F.lit(src).alias("src")) for s, p, o, kind, dt in items]
        return df.select(F.inline(F.array(*cells))).where("s IS NOT NULL AND o IS NOT NULL AND o <> ''")

    parts = []
    for name, df in e.tables.items():
        items = [(F.col("id"), TYPE, F.lit(DEL + CLASSES[name]), "uri", None)]
        items += [(F.col("id"), *(ATTRIBUTES[c][0], F.col(c), "literal", ATTRIBUTES[c][1])) for c in df.columns if c in ATTRIBUTES]
        parts.append(rows(df, items))
    for name, df in e.links.items():
        parts.append(rows(df, [(F.col("source"), LINKS[name], F.col("target"), "uri", None)]))
    return reduce(lambda a, b: a.unionByName(b), parts).dropDuplicates(list(TRIPLE_COLUMNS))


def instances(triples: DataFrame, name: str) -> DataFrame:
    """id of each instance of a class."""
    return triples.where((F.col("p") == TYPE) & (F.col("o") == DEL + CLASSES[name])).select(F.col("s").alias("id")).distinct()


def links(triples: DataFrame, name: str) -> DataFrame:
    return triples.where((F.col("p") == LINKS[name]) & (F.col("o_kind") != "literal")).select(F.col("s").alias("source"), F.col("o").alias("target"))


def values(triples: DataFrame, column: str) -> DataFrame:
    """id and value of an attribute, a row a value."""
    return triples.where((F.col("p") == ATTRIBUTES[column][0]) & (F.col("o_kind") == "literal")).select(F.col("s").alias("id"), F.col("o").alias(column))


def entities(triples: DataFrame) -> Entities:
    """The entity and link tables of a graph; attributes are the least value where there are several."""
    attributes = triples.where((F.col("o_kind") == "literal") & F.col("p").isin([p for p, _ in ATTRIBUTES.values()]))
    by_id = attributes.groupBy(F.col("s").alias("id")).agg(*[F.min(F.when(F.col("p") == p, F.col("o"))).alias(c) for c, (p, _) in ATTRIBUTES.items()])
    return Entities({c: instances(triples, c).join(by_id, "id", "left") for c in CLASSES}, {k: links(triples, k) for k in LINKS})


def write_graph(triples: DataFrame, path: str, parts: int = 32) -> None:
    """Partitioned by predicate, so that a pattern with a constant predicate reads its own files only. A predicate's triples are dealt to up to
    `parts` tasks by their subject: most triples have one of a few predicates."""
    triples.repartition("p", F.pmod(F.xxhash64("s"), F.lit(parts))).write.mode("overwrite").partitionBy("p").parquet(path)


def read_graph(spark, path: str) -> DataFrame:
    return spark.read.parquet(path).select(*[c.split()[0] for c in TRIPLE_SCHEMA.split(", ")])
