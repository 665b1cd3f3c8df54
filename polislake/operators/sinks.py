"""What leaves the engine: versioned graphs, nested documents, CSV, statistics, example queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.terms import PREFIXES
from ..sources.rdf import read_rdf, write_rdf
from .analytics import graph_stats
from .model import Entities, read_graph, write_graph


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def versions(spark: SparkSession, path: str) -> list[int]:
    """Complete versions below `path`, oldest first."""
    p, fs = _fs(spark, path)
    if not fs.exists(p):
        return []
    found = [s.getPath() for s in fs.listStatus(p)]
    return sorted(int(x.getName()[1:]) for x in found if x.getName()[:1] == "v" and x.getName()[1:].isdigit() and fs.exists(_fs(spark, f"{x}/_SUCCESS")[0]))


def save_version(triples: DataFrame, path: str, keep: int = 2) -> int:
    """Writes the graph as a new version; readers see it once it is complete. The last `keep` versions stay (the backup)."""
    spark = triples.sparkSession
    old = versions(spark, path)
    n = (old[-1] if old else 0) + 1
    write_graph(triples, f"{path}/v{n}")
    for v in old[: max(0, len(old) + 1 - keep)]:
        p, fs = _fs(spark, f"{path}/v{v}")
        fs.delete(p, True)
    return n


def load_version(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    found = versions(spark, path)
    if not found:
        raise ValueError(f"{path} holds no complete version")
    return read_graph(spark, f"{path}/v{version or found[-1]}")


def save_formats(triples: DataFrame, path: str, formats: tuple[str, ...] = ("turtle", "xml", "json-ld", "ntriples")) -> dict[str, str]:
    """The graph in several formats; a problem with one is reported and does not stop the others."""
    out = {}
    for f in formats:
        try:
            write_rdf(triples, f"{path}/{f}", f)
            out[f] = "written"
        except Exception as e:  # noqa: BLE001  the caller sees each format's outcome
            out[f] = f"failed: {e}"
    return out


def process_documents(e: Entities) -> DataFrame:
    """process_id, name, topics[], participants[], contributions[]: a nested document a process."""
    none = F.lit(None).cast("string")
    col = lambda df, c: F.col(c) if c in df.columns else none.alias(c)

    def side(link: str, table: str, columns: tuple[str, ...]) -> DataFrame:
        rows = e.links[link].join(e.tables[table].select(F.col("id").alias("target"), *[col(e.tables[table], c) for c in columns]), "target")
        return rows.groupBy(F.col("source").alias("id")).agg(F.sort_array(F.collect_list(F.struct("target", *columns))).alias(f"{table}s"))

    out = e.tables["process"].select("id", *[col(e.tables["process"], c) for c in ("name", "start_date", "platform")])
    for link, table, columns in (("has_topic", "topic", ("name",)), ("has_participant", "participant", ("name",)), ("has_contribution", "contribution", ("timestamp", "text"))):
        if link in e.links and table in e.tables:
            out = out.join(side(link, table, columns), "id", "left")
    return out.withColumnRenamed("id", "process_id")


def write_documents(e: Entities, path: str) -> None:
    """One folder a process; documents are JSON lines."""
    docs = process_documents(e)
    docs.withColumn("process", F.regexp_extract("process_id", r"([^/#]*)$", 1)).write.mode("overwrite").partitionBy("process").json(path)


def write_csv(rows: DataFrame, path: str, text: str | None = None, width: int = 500) -> None:
    """CSV with a header; the column `text` is cut at `width` characters. White space at the ends of values stays."""
    out = rows.withColumn(text, F.substring(F.col(text), 1, width)) if text else rows
    out.write.mode("overwrite").option("header", "true").option("quote", '"').option("escape", '"').option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)


def write_statistics(triples: DataFrame, path: str) -> None:
    graph_stats(triples).coalesce(1).write.mode("overwrite").json(path)


def write_summary(documents: DataFrame, path: str) -> None:
    """Conversion summary a process: counts of the nested arrays."""
    names = [c for c in ("topics", "participants", "contributions") if c in documents.columns]
    documents.select("process_id", "name", *[F.coalesce(F.size(c), F.lit(0)).alias(c) for c in names]).write.mode("overwrite").json(path)


#: Example queries by name.
EXAMPLES = {
    "processes": "SELECT ?process ?name ?start WHERE { ?process a del:DeliberationProcess ; del:name ?name OPTIONAL { ?process del:startDate ?start } } ORDER BY ?start",
    "contributions": "SELECT ?name ?text ?at WHERE { ?c a del:Contribution ; del:madeBy ?p ; del:text ?text . ?p del:name ?name OPTIONAL { ?c del:timestamp ?at } }",
    "topics": "SELECT ?process ?topic WHERE { ?x del:name ?process ; del:hasTopic ?t . ?t del:name ?topic } ORDER BY ?process ?topic",
    "organizations": "SELECT ?organization ?name WHERE { ?p a del:Participant ; del:name ?name ; del:isAffiliatedWith ?o . ?o del:name ?organization } ORDER BY ?organization ?name",
    "arguments": "SELECT ?c ?argument ?premise ?conclusion WHERE { ?c del:hasArgument ?argument OPTIONAL { ?argument del:hasPremise ?a . ?a del:text ?premise } OPTIONAL { ?argument del:hasConclusion ?b . ?b del:text ?conclusion } }",
    "linked participants": "SELECT ?a ?b WHERE { ?a owl:sameAs ?b ; del:platform ?x . ?b del:platform ?y FILTER(?x != ?y) }",
    "several processes": "SELECT ?name (COUNT(DISTINCT ?d) AS ?n) WHERE { ?d del:hasParticipant ?p . ?p del:name ?name } GROUP BY ?name HAVING (?n > 1) ORDER BY DESC(?n)",
}


def example_text() -> str:
    """A file of example queries, with the prefixes they use."""
    head = "\n".join(f"PREFIX {p}: <{a}>" for p, a in PREFIXES.items())
    return head + "\n\n" + "\n\n".join(f"# {name}\n{q}" for name, q in EXAMPLES.items()) + "\n"


def read_ontology(spark: SparkSession, path: str) -> DataFrame:
    """An ontology file, or that of a folder: documentation/ontology.owl, else ontology.owl."""
    p, fs = _fs(spark, path)
    if fs.exists(p) and fs.getFileStatus(p).isDirectory():
        for name in ("documentation/ontology.owl", "ontology.owl"):
            if fs.exists(_fs(spark, f"{path}/{name}")[0]):
                return read_rdf(spark, f"{path}/{name}")
        raise ValueError(f"{path} holds no ontology.owl")
    return read_rdf(spark, path)


def superclasses(ontology: DataFrame) -> DataFrame:
    """(class, super): the closure of rdfs:subClassOf; no query uses it unless asked."""
    from ..plans.results import sparql, values

    return values(sparql(ontology, "SELECT ?class ?super WHERE { ?class rdfs:subClassOf+ ?super }")).where(F.col("super").startswith("http"))


