"""python -m polislake integrate|unify|query|export|stats|report ...: thin wrappers over the library."""

from __future__ import annotations

import argparse
from functools import reduce


def main(args: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="polislake")
    sub = p.add_subparsers(dest="command", required=True)
    a = sub.add_parser("integrate", help="read files with adapters and write a graph with its links")
    a.add_argument("output")
    a.add_argument("inputs", nargs="+", help="adapter=path")
    a.add_argument("--no-links", action="store_true")
    a = sub.add_parser("unify", help="unite RDF files into a graph")
    a.add_argument("output")
    a.add_argument("inputs", nargs="+")
    a = sub.add_parser("query", help="answer a SPARQL query")
    a.add_argument("graph")
    a.add_argument("query")
    a = sub.add_parser("export", help="write a graph in a format")
    a.add_argument("graph")
    a.add_argument("output")
    a.add_argument("--format", default="turtle")
    a = sub.add_parser("stats")
    a.add_argument("graph")
    a = sub.add_parser("report", help="fallacies of the contributions of a graph, by the offline rules")
    a.add_argument("graph")
    o = p.parse_args(args)

    from pyspark.sql import SparkSession
    from pyspark.sql import functions as F

    from .functions.terms import graph
    from .operators import analytics, detect, link, model, sinks
    from .plans.results import sparql, sparql_json
    from .sources.adapters import REGISTRY
    from .sources.rdf import read_rdf, write_rdf

    spark = SparkSession.builder.appName("polislake").getOrCreate()
    if o.command == "integrate":
        entities = reduce(lambda x, y: x + y, [REGISTRY[name](spark, path) for name, path in (i.split("=", 1) for i in o.inputs)])
        parts = [model.to_triples(entities, "integrate")]
        if not o.no_links and "participant" in entities.tables and "platform" in entities.tables["participant"].columns:
            pairs = link.resolve_participants(entities.tables["participant"])
            ends = pairs.select(F.col("a").alias("source"), F.col("b").alias("target"), "relation")
            parts.append(model.to_triples(model.Entities({}, {k: ends.where(F.col("relation") == r).drop("relation") for k, r in (("same_as", "sameAs"), ("related", "related"))}), "links"))
        if not o.no_links and "topic" in entities.tables:
            pairs = link.relate_topics(entities.tables["topic"]).select(F.col("a").alias("source"), F.col("b").alias("target"), "relation")
            parts.append(model.to_triples(model.Entities({}, {r: pairs.where(F.col("relation") == r).drop("relation") for r in ("broader", "narrower", "related")}), "links"))
        print("version", sinks.save_version(graph(*parts), o.output))
    elif o.command == "unify":
        print("version", sinks.save_version(graph(*[read_rdf(spark, i) for i in o.inputs]), o.output))
    else:
        g = sinks.load_version(spark, o.graph)
        if o.command == "query":
            out = sparql(g, o.query)
            print(out if isinstance(out, bool) else sparql_json(out))
        elif o.command == "export":
            write_rdf(g, o.output, o.format)
        elif o.command == "stats":
            print(analytics.graph_stats(g).toJSON().first())
        else:
            c = model.instances(g, "contribution").join(model.values(g, "text"), "id")
            home = model.links(g, "has_contribution").select(F.col("target").alias("id"), F.col("source").alias("process"))
            by = model.links(g, "made_by").select(F.col("source").alias("id"), F.col("target").alias("participant"))
            rows = c.join(home, "id", "left").join(by, "id", "left")
            for line in analytics.fallacy_report(rows, detect.detect(rows)).toJSON().toLocalIterator():
                print(line)


if __name__ == "__main__":
    main()
