"""RDF files: N-Triples, Turtle (and N3), RDF/XML and JSON-LD, read and written.

N-Triples is read by lines, so its files split; so does Turtle where a file has more than LARGE bytes (sources.turtle). The others are whole documents: a file is a row of a binary read and is parsed
where it was read."""

from __future__ import annotations

import json
import re
import xml.etree.ElementTree as ET
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.terms import DEL, PREFIXES, RDF, TRIPLE_COLUMNS, TRIPLE_SCHEMA, XSD
from ..plans.parser import TOKEN, unescape

FORMATS = {
    "ttl": "turtle", "turtle": "turtle", "n3": "turtle", "rdf": "xml", "xml": "xml", "owl": "xml", "json": "json-ld", "jsonld": "json-ld", "json-ld": "json-ld", "nt": "ntriples", "ntriples": "ntriples",
}
#: A Turtle file of more bytes is read in splits.
LARGE = 32 << 20
Row = tuple[str, str, str, str, str, str | None, str | None]


def format_of(path: str) -> str:
    """By extension; Turtle if it tells nothing."""
    return FORMATS.get(path.rsplit(".", 1)[-1].lower(), "turtle")


def _object(value: str, dt: str | None = None, lang: str | None = None) -> tuple[str, str, str | None, str | None]:
    return value, "literal", dt, lang


# Turtle
def parse_turtle(text: str, base: str = "") -> Iterator[Row]:
    tokens: list[tuple[str, str]] = []
    at = 0
    pattern = re.compile(r"@(?:prefix|base)\b")
    while at < len(text):
        if m := pattern.match(text, at):
            tokens.append(("word", m.group()))
        elif not (m := TOKEN.match(text, at)):
            raise ValueError(f"unexpected text at {at}: {text[at : at + 30]!r}")
        elif m.lastgroup != "space":
            tokens.append((m.lastgroup, m.group()))
        at = m.end()
    prefixes: dict[str, str] = {}
    out: list[Row] = []
    i, blanks = 0, 0

    def resolve(x: str) -> str:
        return x if re.match(r"[A-Za-z][\w+.-]*:", x) else base + x

    def blank() -> tuple[str, str]:
        nonlocal blanks
        blanks += 1
        return f"genid{blanks}", "bnode"

    def node() -> tuple:
        nonlocal i
        kind, t = tokens[i]
        i += 1
        if kind == "iri":
            return resolve(t[1:-1]), "uri", None, None
        if kind == "pname":
            p, _, local = t.partition(":")
            return prefixes[p] + local, "uri", None, None
        if kind == "bnode":
            return t[2:], "bnode", None, None
        if t == "a":
            return RDF + "type", "uri", None, None
        if t == "[":
            me = blank()
            if tokens[i][1] != "]":
                properties(me)
            i += 1
            return (*me, None, None)
        if t == "(":
            items = []
            while tokens[i][1] != ")":
                items.append(node())
            i += 1
            head = (RDF + "nil", "uri", None, None)
            for x in reversed(items):
                me = blank()
                out.append((*me, RDF + "first", *x))
                out.append((*me, RDF + "rest", *head))
                head = (*me, None, None)
            return head
        if kind == "string":
            n = 3 if t[:3] in ('"""', "'''") else 1
            body = unescape(t[n:-n])
            if i < len(tokens) and tokens[i][0] == "lang":
                i += 1
                return _object(body, None, tokens[i - 1][1][1:])
            if i < len(tokens) and tokens[i][1] == "^^":
                i += 1
                return _object(body, node()[0])
            return _object(body)
        if t in ("true", "false"):
            return _object(t, XSD + "boolean")
        sign = ""
        if t in "+-" and tokens[i][0] == "number":
            sign, (kind, t) = t, tokens[i]
            i += 1
        if kind == "number":
            return _object(sign + t, XSD + ("double" if "e" in t.lower() else "decimal" if "." in t else "integer"))
        raise ValueError(f"unexpected {t!r}")

    def properties(subject: tuple[str, str]) -> None:
        nonlocal i
        while True:
            p = node()[0]
            while True:
                out.append((*subject, p, *node()))
                if tokens[i][1] != ",":
                    break
                i += 1
            while tokens[i][1] == ";":
                i += 1
            if tokens[i][1] in (".", "]"):
                return

    while i < len(tokens):
        word = tokens[i][1]
        if word.lower() in ("@prefix", "prefix"):
            prefixes[tokens[i + 1][1][:-1]] = resolve(tokens[i + 2][1][1:-1])
            i += 3 + (word[0] == "@")
        elif word.lower() in ("@base", "base"):
            base = tokens[i + 1][1][1:-1]
            i += 2 + (word[0] == "@")
        else:
            subject = node()
            if tokens[i][1] != ".":
                properties(subject[:2])
            i += 1
        yield from out
        out.clear()


# RDF/XML
def parse_xml(text: str | bytes) -> Iterator[Row]:
    root = ET.fromstring(text)
    count = 0
    lang_key = "{http://www.w3.org/XML/1998/namespace}lang"
    plain = lambda tag: tag[1:].replace("}", "")
    rdf = lambda name: f"{{{RDF}}}{name}"
    base = root.get("{http://www.w3.org/XML/1998/namespace}base", "")

    def address(x: str) -> str:
        return x if re.match(r"[A-Za-z][\w+.-]*:", x) else base + x

    def subject(e: ET.Element) -> tuple[str, str]:
        nonlocal count
        if e.get(rdf("about")) is not None:
            return address(e.get(rdf("about"))), "uri"
        if e.get(rdf("ID")) is not None:
            return address("#" + e.get(rdf("ID"))), "uri"
        if e.get(rdf("nodeID")) is not None:
            return e.get(rdf("nodeID")), "bnode"
        count += 1
        return f"genid{count}", "bnode"

    def describe(e: ET.Element) -> Iterator[Row]:
        nonlocal count
        me = subject(e)
        if plain(e.tag) != RDF + "Description":
            yield (*me, RDF + "type", plain(e.tag), "uri", None, None)
        for k, v in e.attrib.items():
            if k.startswith("{") and not plain(k).startswith(RDF) and k != lang_key and not k.startswith("{http://www.w3.org/XML"):
                yield (*me, plain(k), *_object(v))
        for p in e:
            name = plain(p.tag)
            if p.get(rdf("resource")) is not None:
                yield (*me, name, address(p.get(rdf("resource"))), "uri", None, None)
            elif p.get(rdf("nodeID")) is not None:
                yield (*me, name, p.get(rdf("nodeID")), "bnode", None, None)
            elif p.get(rdf("parseType")) == "Resource":
                count += 1
                inner = (f"genid{count}", "bnode")
                yield (*me, name, *inner, None, None)
                for q in p:
                    yield (*inner, plain(q.tag), *_object(q.text or "", q.get(rdf("datatype")), q.get(lang_key)))
            elif p.get(rdf("parseType")) == "Collection":
                head = (RDF + "nil", "uri")
                rows = []
                for x in reversed(list(p)):
                    item = list(describe(x))
                    who = subject(x) if x.get(rdf("about")) is not None else item[0][:2]
                    count += 1
                    cell = (f"genid{count}", "bnode")
                    rows += [*item, (*cell, RDF + "first", *who, None, None), (*cell, RDF + "rest", *head, None, None)]
                    head = cell
                yield (*me, name, *head, None, None)
                yield from rows
            elif len(p):
                inner_rows = [list(describe(x)) for x in p]
                for x, rows in zip(p, inner_rows, strict=True):
                    who = subject(x) if x.get(rdf("about")) is not None else rows[0][:2] if rows else subject(x)
                    yield (*me, name, *who, None, None)
                    yield from rows
            else:
                yield (*me, name, *_object(p.text or "", p.get(rdf("datatype")), p.get(lang_key) or e.get(lang_key) or root.get(lang_key)))

    for e in root if plain(root.tag) == RDF + "RDF" else [root]:
        yield from describe(e)


# JSON-LD
def parse_jsonld(text: str) -> Iterator[Row]:
    """Expanded and prefixed documents, with @graph, @context prefixes and term definitions, nested nodes, @value, @list-free arrays."""
    doc = json.loads(text)
    count = 0

    def terms(context) -> dict[str, str]:
        out: dict[str, str] = {}
        for c in context if isinstance(context, list) else [context]:
            if isinstance(c, dict):
                for k, v in c.items():
                    out[k] = v if isinstance(v, str) else v.get("@id", "") if isinstance(v, dict) else ""
        return out

    def expand(x: str, context: dict[str, str]) -> str:
        if x in context and x[0] != "@":
            return expand(context[x], {k: v for k, v in context.items() if k != x})
        p, mark, local = x.partition(":")
        if mark and not local.startswith("//") and (p in context or p in PREFIXES):
            return context.get(p, PREFIXES.get(p, "")) + local
        if mark or x.startswith("_:"):
            return x
        return context.get("@vocab", "") + x

    def node(d: dict, context: dict[str, str]) -> Iterator[Row]:
        nonlocal count
        context = context | terms(d.get("@context", {}))
        if "@graph" in d:
            for x in d["@graph"] if isinstance(d["@graph"], list) else [d["@graph"]]:
                yield from node(x, context)
            if set(d) <= {"@graph", "@context", "@id"}:
                return
        if "@id" not in d:
            count += 1
            d = {"@id": f"_:genid{count}"} | d
        who = expand(d["@id"], context)
        me = (who[2:], "bnode") if who.startswith("_:") else (who, "uri")
        kinds = d.get("@type", [])
        for t in kinds if isinstance(kinds, list) else [kinds]:
            yield (*me, RDF + "type", expand(t, context), "uri", None, None)
        for k, values in d.items():
            if k[0] == "@":
                continue
            p = expand(k, context)
            for v in values if isinstance(values, list) else [values]:
                if v is None:
                    continue
                if isinstance(v, dict) and "@value" in v:
                    x = v["@value"]
                    yield (*me, p, *_object(str(x).lower() if isinstance(x, bool) else str(x), expand(v["@type"], context) if "@type" in v else None, v.get("@language")))
                elif isinstance(v, dict):
                    if "@id" not in v:
                        count += 1
                        v = {"@id": f"_:genid{count}"} | v
                    other = expand(v["@id"], context)
                    yield (*me, p, *((other[2:], "bnode") if other.startswith("_:") else (other, "uri")), None, None)
                    if set(v) - {"@id"}:
                        yield from node(v, context)
                elif isinstance(v, bool):
                    yield (*me, p, *_object(str(v).lower(), XSD + "boolean"))
                elif isinstance(v, (int, float)):
                    yield (*me, p, *_object(str(v), XSD + ("integer" if isinstance(v, int) else "double")))
                else:
                    yield (*me, p, *_object(v))

    for d in doc if isinstance(doc, list) else [doc]:
        yield from node(d, {})


PARSERS = {"turtle": parse_turtle, "xml": parse_xml, "json-ld": parse_jsonld}
NT_LINE = r'^\s*(<[^>]*>|_:\S+)\s+<([^>]*)>\s+(<[^>]*>|_:\S+|"(?:[^"\\]|\\.)*"(?:@[\w-]+|\^\^<[^>]*>)?)\s*\.\s*$'


def read_ntriples(spark: SparkSession, path: str) -> DataFrame:
    line = spark.read.text(path).where(F.col("value").rlike(NT_LINE))
    s, p, o = (F.regexp_extract("value", NT_LINE, i) for i in (1, 2, 3))
    rows = line.select(s.alias("s0"), p.alias("p"), o.alias("o0"), F.col("_metadata.file_name").alias("src"))
    body = F.regexp_extract("o0", r'^"((?:[^"\\]|\\.)*)"', 1)
    for mark, value in (("\\\\", "\u0001"), ('\\"', '"'), ("\\n", "\n"), ("\\r", "\r"), ("\\t", "\t"), ("\u0001", "\\")):
        body = F.replace(body, F.lit(mark), F.lit(value))
    kind = lambda c: F.when(F.col(c).startswith("<"), "uri").when(F.col(c).startswith("_:"), "bnode").otherwise("literal")
    plain = lambda c: F.when(F.col(c).startswith("<"), F.regexp_replace(c, "^<|>$", "")).otherwise(F.substring(F.col(c), F.lit(3), F.length(c)))
    empty = lambda x: F.nullif(x, F.lit(""))
    lit = F.col("o0").startswith('"')
    return rows.select(
        plain("s0").alias("s"), kind("s0").alias("s_kind"), "p", F.when(lit, body).otherwise(plain("o0")).alias("o"), kind("o0").alias("o_kind"),
        F.when(lit, empty(F.regexp_extract("o0", r"\^\^<([^>]*)>$", 1))).alias("o_dt"), F.when(lit, empty(F.regexp_extract("o0", r'"@([\w-]+)$', 1))).alias("o_lang"), "src",
    )


def read_rdf(spark: SparkSession, path: str, fmt: str | None = None) -> DataFrame:
    """The triples of a file, of several (a glob) or of a folder's *.ttl, *.n3, *.rdf, *.xml, *.owl, *.jsonld and *.nt, as a set. The format follows each file's
    extension unless given; one that cannot be parsed in it is tried in the others."""
    if (fmt or format_of(path)) == "ntriples" and not path.endswith("/"):
        return read_ntriples(spark, path).dropDuplicates(list(TRIPLE_COLUMNS))
    if (fmt or FORMATS.get(path.rsplit(".", 1)[-1].lower())) == "turtle":
        sizes = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).agg(F.max("length")).first()
        if (sizes[0] or 0) > LARGE:
            from .turtle import read_turtle

            return read_turtle(spark, path)
    return read_whole(spark, path, fmt)


def read_whole(spark: SparkSession, path: str, fmt: str | None = None) -> DataFrame:
    """read_rdf of files that a task parses each."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content")
    names = [c.split()[0] for c in TRIPLE_SCHEMA.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for where, content in zip(b["path"], b["content"], strict=True):
                ending = where.rsplit("/", 1)[-1].rpartition(".")[2]
                if ending.lower() not in FORMATS and not fmt and not path.endswith(f".{ending}"):
                    continue  # other files of a folder
                text, first = bytes(content).decode("utf-8"), fmt or format_of(where)
                rows, problem = None, None
                for f in [first, *[x for x in PARSERS if x != first]]:
                    try:
                        rows = list((PARSERS[f] if f in PARSERS else parse_turtle)(text))
                        break
                    except Exception as e:  # noqa: BLE001  the next format is tried
                        problem = problem or e
                if rows is None:
                    raise ValueError(f"{where} cannot be read: {problem}")
                # Blank nodes belong to their file.
                mine = where.rsplit("/", 1)[-1]
                tell = lambda v, k, mine=mine: f"{mine}_{v}" if k == "bnode" else v
                yield pd.DataFrame([(tell(r[0], r[1]), r[1], r[2], tell(r[3], r[4]), r[4], r[5], r[6], mine) for r in rows], columns=names)

    return files.mapInPandas(run, TRIPLE_SCHEMA).dropDuplicates(list(TRIPLE_COLUMNS))


# Writers
def _escaped(c: Column) -> Column:
    for mark, value in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        c = F.replace(c, F.lit(mark), F.lit(value))
    return c


def _node(v: str, k: str) -> Column:
    return F.when(F.col(k) == "bnode", F.concat(F.lit("_:"), F.col(v))).otherwise(F.concat(F.lit("<"), F.col(v), F.lit(">")))


def _object_text() -> Column:
    tail = F.when(F.col("o_lang").isNotNull(), F.concat(F.lit("@"), F.col("o_lang"))).when(F.col("o_dt").isNotNull() & (F.col("o_dt") != XSD + "string"), F.concat(F.lit("^^<"), F.col("o_dt"), F.lit(">"))).otherwise("")
    return F.when(F.col("o_kind") == "literal", F.concat(F.lit('"'), _escaped(F.col("o")), F.lit('"'), tail)).otherwise(_node("o", "o_kind"))


def ntriples(triples: DataFrame) -> DataFrame:
    return triples.select(F.concat(_node("s", "s_kind"), F.lit(" <"), F.col("p"), F.lit("> "), _object_text(), F.lit(" .")).alias("value"))


def turtle(triples: DataFrame) -> DataFrame:
    """A block a subject (full addresses, so blocks need no shared prefixes and files can be split)."""
    rows = triples.select(_node("s", "s_kind").alias("subject"), F.concat(F.lit("<"), F.col("p"), F.lit("> "), _object_text()).alias("part"))
    block = rows.groupBy("subject").agg(F.array_join(F.array_sort(F.collect_list("part")), " ;\n    ").alias("parts"))
    return block.select(F.concat("subject", F.lit(" "), "parts", F.lit(" .")).alias("value"))


def jsonld(triples: DataFrame) -> DataFrame:
    """A JSON object a subject, in expanded form, on a line."""
    quote = lambda c: F.concat(F.lit('"'), _escaped(c), F.lit('"'))
    name = lambda v, k: F.when(F.col(k) == "bnode", F.concat(F.lit("_:"), F.col(v))).otherwise(F.col(v))
    more = F.when(F.col("o_lang").isNotNull(), F.concat(F.lit(', "@language": '), quote(F.col("o_lang")))).when(F.col("o_dt").isNotNull(), F.concat(F.lit(', "@type": '), quote(F.col("o_dt")))).otherwise("")
    cell = F.when(F.col("o_kind") == "literal", F.concat(F.lit('{"@value": '), quote(F.col("o")), more, F.lit("}"))).otherwise(F.concat(F.lit('{"@id": '), quote(name("o", "o_kind")), F.lit("}")))
    typed = F.col("p") == RDF + "type"
    rows = triples.select(name("s", "s_kind").alias("id"), F.when(typed, "@type").otherwise(F.col("p")).alias("p"), F.when(typed, quote(F.col("o"))).otherwise(cell).alias("cell"))
    lists = rows.groupBy("id", "p").agg(F.array_join(F.array_sort(F.collect_list("cell")), ", ").alias("cells"))
    pairs = lists.groupBy("id").agg(F.array_join(F.array_sort(F.collect_list(F.concat(quote(F.col("p")), F.lit(": ["), "cells", F.lit("]")))), ", ").alias("pairs"))
    return pairs.select(F.concat(F.lit('{"@id": '), quote(F.col("id")), F.lit(", "), "pairs", F.lit("}")).alias("value"))


def rdfxml(triples: DataFrame) -> DataFrame:
    """An rdf:Description a subject, with the namespaces it uses on its property elements."""
    esc = lambda c: F.replace(F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;")), F.lit('"'), F.lit("&quot;"))
    local = F.regexp_extract("p", r"([A-Za-z_][\w.-]*)$", 1)
    space = F.substring(F.col("p"), F.lit(1), F.length("p") - F.length(local))
    who = F.when(F.col("s_kind") == "bnode", F.concat(F.lit('rdf:nodeID="'), F.col("s"), F.lit('"'))).otherwise(F.concat(F.lit('rdf:about="'), esc(F.col("s")), F.lit('"')))
    head = F.concat(F.lit("<p:"), local, F.lit(' xmlns:p="'), esc(space), F.lit('"'))
    link = F.when(F.col("o_kind") == "bnode", F.concat(F.lit(' rdf:nodeID="'), F.col("o"), F.lit('"/>'))).otherwise(F.concat(F.lit(' rdf:resource="'), esc(F.col("o")), F.lit('"/>')))
    tag = F.when(F.col("o_lang").isNotNull(), F.concat(F.lit(' xml:lang="'), F.col("o_lang"), F.lit('"'))).when(F.col("o_dt").isNotNull(), F.concat(F.lit(' rdf:datatype="'), esc(F.col("o_dt")), F.lit('"'))).otherwise("")
    part = F.concat(head, F.when(F.col("o_kind") == "literal", F.concat(tag, F.lit(">"), esc(F.col("o")), F.lit("</p:"), local, F.lit(">"))).otherwise(link))
    rows = triples.select(who.alias("who"), part.alias("part"))
    block = rows.groupBy("who").agg(F.array_join(F.array_sort(F.collect_list("part")), "\n  ").alias("parts"))
    return block.select(F.concat(F.lit("<rdf:Description "), "who", F.lit(">\n  "), "parts", F.lit("\n</rdf:Description>")).alias("value"))


WRITERS = {"ntriples": ntriples, "turtle": turtle, "json-ld": jsonld, "xml": rdfxml}
ENDS = {"ntriples": ("", ""), "turtle": ("", ""), "json-ld": ("[", "]"), "xml": (f'<?xml version="1.0" encoding="UTF-8"?>\n<rdf:RDF xmlns:rdf="{RDF}" xmlns:del="{DEL}">', "</rdf:RDF>")}


def export(triples: DataFrame, fmt: str) -> DataFrame:
    """Rows of text in a format, by any of its names."""
    if fmt.lower() not in FORMATS:
        raise ValueError(f"unknown format {fmt!r}")
    return WRITERS[FORMATS[fmt.lower()]](triples)


def document(triples: DataFrame, fmt: str) -> str:
    """A whole document; for graphs that fit the driver."""
    name = FORMATS[fmt.lower()]
    lines = [r["value"] for r in export(triples, fmt).collect()]
    head, tail = ENDS[name]
    return "\n".join(x for x in (head, (",\n" if name == "json-ld" else "\n").join(sorted(lines)), tail) if x) + "\n"


def write_rdf(triples: DataFrame, path: str, fmt: str = "ntriples") -> None:
    """A folder of text files, written by the executors; RDF/XML and JSON-LD files are fragments without their ends."""
    export(triples, fmt).write.mode("overwrite").text(path)
