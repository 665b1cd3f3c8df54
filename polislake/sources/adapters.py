"""Adapters from source files to Entities. Each takes a session and a path and gives tables of resource addresses and attributes.

Ids that are local to a file are prefixed by their process, unless compat asks for one global numbering."""

from __future__ import annotations

import sqlite3
import time
from collections.abc import Callable, Iterator
from functools import reduce
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators.model import Entities, address
from .places import with_places
from .store import few, written


def _has(df: DataFrame, *path: str) -> bool:
    schema = df.schema
    for p in path:
        schema = getattr(schema, "elementType", schema)
        if not hasattr(schema, "fieldNames") or p not in schema.fieldNames():
            return False
        schema = schema[p].dataType
    return True


def field(df: DataFrame, *names: str, kind: str = "string") -> Column:
    """The first of these fields that is not null, of those that exist."""
    found = []
    for n in names:
        if _has(df, *n.split("/")):
            c = F.col(".".join(f"`{p}`" for p in n.split("/")))
            if df.select(c).schema[0].dataType.typeName() != "struct":
                found.append(c.cast(kind))
    return F.coalesce(*found) if found else F.lit(None).cast(kind)


def explode(df: DataFrame, name: str, *keep: Column) -> DataFrame | None:
    """Rows of a nested array (or a single struct) as columns, with `keep`; null if the field does not exist."""
    for n in (f"del:{name}", f"dkg:{name}", name):
        if _has(df, n):
            c = F.col(f"`{n}`")
            kind = df.schema[n].dataType
            c = c if kind.typeName() == "array" else F.array(c)
            inner = df.select(*keep, F.posexplode(c).alias("pos", "x"))
            return inner.select(*[k for k in inner.columns if k != "x"], "x.*") if hasattr(inner.schema["x"].dataType, "fieldNames") else inner
    return None


def _d(df: DataFrame, name: str) -> Column:
    """A field with one of the two prefixes or none."""
    return field(df, f"del:{name}", f"dkg:{name}", name)


NO_JSON = "\u0001\u001e\u0002\u001e"


def read_json(spark: SparkSession, path: str) -> DataFrame:
    """Documents of files, numbers as they are written. A file is a record up to a separator that JSON text cannot hold: read as multi-line documents, each number to be kept as text is a read of the file of its own."""
    return spark.read.option("lineSep", NO_JSON).option("primitivesAsString", "true").json(path)


def documents_of(docs: DataFrame) -> DataFrame:
    """The nodes of @graph where there is one, else the documents themselves; processes only."""
    if "@graph" in docs.columns:
        docs = docs.select(F.explode("@graph").alias("x")).select("x.*")
    return docs.where(F.col("`@type`").rlike("(^|[:/#])DeliberationProcess$")) if "@type" in docs.columns else docs


def debates(spark: SparkSession, path: str, compat: bool = False, platform: str | None = None) -> Entities:
    """Process documents (debates and what other converters write in their shape): topics, participants with roles and organisations, contributions, arguments."""
    return process_documents(documents_of(read_json(spark, path)), compat, platform)


def process_documents(docs: DataFrame, compat: bool = False, platform: str | None = None) -> Entities:
    key = F.coalesce(_d(docs, "identifier"), X.stable_id(F.to_json(F.struct(*docs.columns))))
    docs = docs.withColumn("pkey", key)
    pid = address(F.col("pkey"))
    local = (lambda c: address(c)) if compat else (lambda c: address(F.col("pkey"), "_", c))
    none = F.lit(None).cast("string")
    e = Entities()
    e.tables["process"] = docs.select(
        pid.alias("id"), F.col("pkey").alias("identifier"), _d(docs, "name").alias("name"), X.without_zone(_d(docs, "startDate")).alias("start_date"), X.without_zone(_d(docs, "endDate")).alias("end_date"), (F.lit(platform) if platform else _d(docs, "platform")).alias("platform"), _d(docs, "description").alias("description")
    )
    t = explode(docs, "hasTopic", F.col("pkey"))
    if t is not None:
        tid = F.coalesce(local(_d(t, "identifier")), field(t, "@id"), local(X.slug(_d(t, "name"))))
        e.tables["topic"] = t.select(tid.alias("id"), _d(t, "identifier").alias("identifier"), _d(t, "name").alias("name"))
        e.links["has_topic"] = t.select(pid.alias("source"), tid.alias("target"))
    p = explode(docs, "hasParticipant", F.col("pkey"))
    if p is not None:
        who = F.coalesce(local(_d(p, "identifier")), field(p, "@id"), local(X.slug(_d(p, "name"))))
        org = field(p, "del:isAffiliatedWith/del:name", "dkg:isAffiliatedWith/dkg:name", "isAffiliatedWith/name")
        role = field(p, "del:hasRole/del:name", "dkg:hasRole/dkg:name", "hasRole/name")
        base = p.select(who.alias("id"), _d(p, "identifier").alias("identifier"), _d(p, "name").alias("name"), (F.lit(platform) if platform else none).alias("platform"), org.alias("org"), role.alias("role"), "pkey")
        e.tables["participant"] = base.select("id", "identifier", "name", "platform")
        e.tables["organization"] = base.where("org IS NOT NULL").select(address(X.organization_id(F.col("org"))).alias("id"), F.col("org").alias("name")).distinct()
        e.tables["role"] = base.where("role IS NOT NULL").select(F.concat(F.col("id"), F.lit("_role")).alias("id"), F.col("role").alias("name"))
        e.links["has_participant"] = base.select(pid.alias("source"), F.col("id").alias("target"))
        e.links["affiliated"] = base.where("org IS NOT NULL").select(F.col("id").alias("source"), address(X.organization_id(F.col("org"))).alias("target"))
        e.links["has_role"] = base.where("role IS NOT NULL").select(F.col("id").alias("source"), F.concat(F.col("id"), F.lit("_role")).alias("target"))
    c = explode(docs, "hasContribution", F.col("pkey"))
    if c is not None:
        cid = F.coalesce(local(_d(c, "identifier")), field(c, "@id"), local(F.concat(F.lit("contribution_"), F.col("pos") + 1)))
        ref = lambda n: local(F.regexp_replace(field(c, f"del:{n}/@id", f"dkg:{n}/@id", f"{n}/@id"), "^.*[#/]", ""))
        rows = c.select(cid.alias("id"), _d(c, "identifier").alias("identifier"), _d(c, "text").alias("text"), _d(c, "timestamp").alias("timestamp"), ref("madeBy").alias("by"), ref("responseTo").alias("to"), ref("hasTopic").alias("topic"), ref("hasArgument").alias("argument"), "pkey")
        e.tables["contribution"] = rows.select("id", "identifier", "text", "timestamp")
        e.links["has_contribution"] = rows.select(pid.alias("source"), F.col("id").alias("target"))
        link = lambda col: rows.where(F.col(col).isNotNull()).select(F.col("id").alias("source"), F.col(col).alias("target"))
        e.links |= {"made_by": link("by"), "response_to": link("to"), "has_argument": link("argument")}
        e = e + Entities({}, {"has_topic": link("topic")})
    a = explode(docs, "hasArgument", F.col("pkey"))
    if a is not None:
        aid = local(_d(a, "identifier"))
        e = e + Entities({"argument": a.select(aid.alias("id"), _d(a, "identifier").alias("identifier"), _d(a, "text").alias("text"))}, {"has_argument": a.select(pid.alias("source"), aid.alias("target"))})
    return e


def parliament_api(spark: SparkSession, path: str) -> Entities:
    """speeches[] of the parliament's interface: topics are the distinct activity labels, numbered by first appearance."""
    docs = read_json(spark, path)
    # Without a date the sitting is told by the id of a speech, such as SPEECH-9-2024-07-17.
    sitting = F.nullif(X.sitting_date(F.array_min(F.col("speeches.id").cast("array<string>"))), F.lit("")) if _has(docs, "speeches", "id") else F.lit(None).cast("string")
    docs = docs.withColumn("day", F.coalesce(field(docs, "debate_date"), field(docs, "date"), sitting))
    docs = docs.withColumn("pkey", F.coalesce(field(docs, "debate_id"), F.col("day")))
    s = explode(docs, "speeches", F.col("pkey"), F.col("day"))
    pid = address("debate_", F.col("pkey"))
    label = field(s, "activity_label/en", "activity_label/fr", "activity_label/mul", "activity_label")
    person = field(s, "had_participation/had_participant_person", "had_participation/had_participant_person/0")
    rows = s.select(
        "pkey", "day", "pos", F.coalesce(field(s, "id"), field(s, "activity_id")).alias("sid"), label.alias("label"), F.coalesce(field(s, "activity_start_date"), field(s, "activity_date")).alias("at"),
        F.regexp_replace(person, r'^\["?|"?\]$', "").alias("person"), field(s, "had_participation/participation_role").alias("role"), field(s, "had_participation/participation_in_name_of").alias("org"),
    )
    first = rows.where("label IS NOT NULL").groupBy("pkey", "label").agg(F.min("pos").alias("first"))
    topics = first.withColumn("n", F.row_number().over(Window.partitionBy("pkey").orderBy("first")))
    cid = address("speech_", F.regexp_replace("sid", "[/ ]", "_"))
    who = address("person_", X.local_name(F.col("person")))
    e = Entities()
    e.tables["process"] = docs.select(pid.alias("id"), F.col("pkey").alias("identifier"), F.concat(F.lit("Debate "), F.col("pkey")).alias("name"), F.col("day").alias("start_date"))
    e.tables["topic"] = topics.select(F.concat(pid, F.lit("_topic_"), F.col("n")).alias("id"), F.col("label").alias("name"))
    e.tables["contribution"] = rows.select(cid.alias("id"), F.col("sid").alias("identifier"), F.col("label").alias("text"), F.col("at").alias("timestamp"))
    e.tables["participant"] = rows.where("person IS NOT NULL").select(who.alias("id"), F.col("person").alias("identifier"), X.local_name(F.col("person")).alias("name")).distinct()
    e.tables["role"] = rows.where("role IS NOT NULL").select(address("role_", X.slug(X.title_case(F.col("role")))).alias("id"), X.title_case(F.col("role")).alias("name")).distinct()
    e.tables["organization"] = rows.where("org IS NOT NULL").select(address(X.organization_id(X.local_name(F.col("org")))).alias("id"), X.local_name(F.col("org")).alias("name")).distinct()
    e.links["has_topic"] = topics.select(pid.alias("source"), F.concat(pid, F.lit("_topic_"), F.col("n")).alias("target"))
    e.links["has_contribution"] = rows.select(pid.alias("source"), cid.alias("target"))
    spoken = rows.where("person IS NOT NULL")
    e.links["made_by"] = spoken.select(cid.alias("source"), who.alias("target"))
    e.links["has_participant"] = spoken.select(pid.alias("source"), who.alias("target")).distinct()
    e.links["has_role"] = spoken.where("role IS NOT NULL").select(who.alias("source"), address("role_", X.slug(X.title_case(F.col("role")))).alias("target")).distinct()
    e.links["affiliated"] = spoken.where("org IS NOT NULL").select(who.alias("source"), address(X.organization_id(X.local_name(F.col("org")))).alias("target")).distinct()
    return e


class _Speeches(HTMLParser):
    """Text by class from a debate page of either dialect."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.title, self.topics, self.speeches, self.stack, self.day = "", [], [], [], ""

    def handle_starttag(self, tag, attrs):
        a = dict(attrs)
        kinds = set((a.get("class") or "").split())
        if tag == "a":
            href = a.get("href") or ""
            if "playerStartTime=" in href and self.speeches:
                self.speeches[-1]["video"] = href
            if href.startswith("#") and any("list_summary" in k for _, k in self.stack):
                kinds.add("toc")
        if "doc_subtitle_level1_bis" in kinds or "speech" in kinds:
            self.speeches.append({"speaker": "", "text": "", "role": "", "affiliation": "", "time": "", "video": "", "topic": self.topics[-1] if self.topics and "doc_subtitle_level1_bis" in kinds else ""})
        if tag not in ("br", "img", "meta", "link", "input", "hr"):
            self.stack.append((tag, kinds))

    def handle_endtag(self, tag):
        while self.stack:
            if self.stack.pop()[0] == tag:
                break

    def handle_data(self, data):
        tags = [t for t, _ in self.stack]
        kinds = set().union(*[k for _, k in self.stack]) if self.stack else set()
        put = lambda name: self.speeches[-1].__setitem__(name, (self.speeches[-1][name] + " " + data.strip()).strip())
        if tags[-1:] == ["title"]:
            self.title += data
        elif "date" in kinds:
            self.day += data.strip()
        elif "toc" in kinds or "doc_title" in kinds or (tags[-1:] == ["h2"] and "title" in kinds):
            if data.strip() and data.strip() not in self.topics:
                self.topics.append(data.strip())
        elif self.speeches and data.strip():
            for kind, name in (("speaker", "speaker"), ("role", "role"), ("affiliation", "affiliation"), ("time", "time"), ("text", "text"), ("contents", "text")):
                if kind in kinds:
                    put(name)
                    return
            if "doc_subtitle_level1_bis" in kinds:
                put("speaker")


def parse_debate_html(html: str) -> dict:
    p = _Speeches()
    p.feed(html)
    return {"title": p.title.strip(), "day": p.day, "topics": p.topics, "speeches": p.speeches}


def debate_html(spark: SparkSession, path: str) -> Entities:
    """Verbatim pages and generic debate pages: a page is parsed where it is read, in batches."""
    schema = "file string, title string, day string, topics array<string>, speeches array<struct<speaker:string,text:string,role:string,affiliation:string,time:string,video:string,topic:string>>"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame([{"file": f} | parse_debate_html(h) for f, h in zip(b["file"], b["value"], strict=True)], columns=["file", "title", "day", "topics", "speeches"])

    pages = spark.read.option("wholetext", "true").text(path).select(F.col("_metadata.file_name").alias("file"), "value").mapInPandas(run, schema)
    day = F.coalesce(F.date_format(X.title_date(F.col("title")), "yyyy-MM-dd"), F.nullif(F.col("day"), F.lit("")))
    pages = pages.withColumn("pkey", F.concat(F.lit("debate_"), F.coalesce(day, F.regexp_replace("file", r"\.[^.]*$", "")))).withColumn("start", day)
    s = pages.select("pkey", "start", F.posexplode("speeches").alias("pos", "x")).select("pkey", "start", "pos", "x.*")
    name, role, group = X.speaker_parts(F.col("speaker"))
    some = lambda c: F.nullif(F.trim(F.col(c)), F.lit(""))
    s = s.select("*", F.regexp_replace(name, r"[\s.–—-]+$", "").alias("who"), F.coalesce(some("role"), role).alias("as"), F.coalesce(some("affiliation"), group).alias("org")).where("who <> ''")
    at = F.coalesce(X.video_time(F.col("video")), F.when(some("time").isNotNull() & F.col("start").isNotNull(), F.concat("start", F.lit("T"), some("time"))))
    numbered = s.join(s.groupBy("pkey", "who").agg(F.min("pos").alias("first")).withColumn("n", F.row_number().over(Window.partitionBy("pkey").orderBy("first"))).drop("first"), ["pkey", "who"])
    pid, person = address(F.col("pkey")), address(F.col("pkey"), "_participant_", F.col("n"))
    cid = address(F.col("pkey"), "_contribution_", F.col("pos") + 1)
    # Attributes come from a person's first speech.
    one = numbered.withColumn("place", F.row_number().over(Window.partitionBy("pkey", "n").orderBy("pos"))).where("place = 1")
    t = pages.select("pkey", F.posexplode("topics").alias("k", "topic"))
    tid = address(F.col("pkey"), "_topic_", F.col("k") + 1)
    e = Entities()
    e.tables["process"] = pages.select(pid.alias("id"), F.col("pkey").alias("identifier"), F.col("title").alias("name"), F.col("start").alias("start_date"))
    e.tables["topic"] = t.select(tid.alias("id"), F.col("topic").alias("name"))
    e.tables["participant"] = one.select(person.alias("id"), F.col("who").alias("name"))
    e.tables["role"] = one.where(F.col("as").isNotNull()).select(F.concat(person, F.lit("_role")).alias("id"), F.col("as").alias("name"))
    e.tables["organization"] = one.where("org IS NOT NULL").select(address(X.organization_id(F.col("org"))).alias("id"), F.col("org").alias("name")).distinct()
    e.tables["contribution"] = numbered.select(cid.alias("id"), X.collapse(F.col("text")).alias("text"), at.alias("timestamp"))
    e.links["has_topic"] = t.select(pid.alias("source"), tid.alias("target"))
    e.links["has_participant"] = one.select(pid.alias("source"), person.alias("target"))
    e.links["has_role"] = one.where(F.col("as").isNotNull()).select(person.alias("source"), F.concat(person, F.lit("_role")).alias("target"))
    e.links["affiliated"] = one.where("org IS NOT NULL").select(person.alias("source"), address(X.organization_id(F.col("org"))).alias("target"))
    e.links["has_contribution"] = numbered.select(pid.alias("source"), cid.alias("target"))
    e.links["made_by"] = numbered.select(cid.alias("source"), person.alias("target"))
    return e


def _proposals(p: DataFrame, c: DataFrame | None, prefix: str, platform: str, time: Callable[[Column], Column] = lambda at: at) -> Entities:
    """p: id, title, text, author, author_name, at; c: id, parent, text, author, author_name, at, each an answer to its proposal's text; time: what makes a time of `at`. One process a proposal. Links of contributions hold no row twice.

    Files are parsed into a table once, not once a link. The tables hold ids as the files have them: addresses and times are made where they are asked for."""
    p, _ = written(p, "proposals")
    pid, person = address(f"{prefix}_proposal_", F.col("id")), address(f"{prefix}_participant_", F.col("author"))
    e = Entities()
    e.tables["process"] = p.select(pid.alias("id"), F.col("id").alias("identifier"), F.col("title").alias("name"), F.lit(platform).alias("platform"), time(F.col("at")).alias("start_date"))
    e.tables["topic"] = p.select(address(f"{prefix}_topic_", F.col("id")).alias("id"), F.col("title").alias("name"))
    e.links["has_topic"] = p.select(pid.alias("source"), address(f"{prefix}_topic_", F.col("id")).alias("target"))
    columns = [X.clean_html(F.col("text")).alias("text"), "author", "author_name", "at"]
    body = p.select(F.lit("text").alias("kind"), "id", F.col("id").alias("parent"), *columns)
    if c is not None:
        body = body.unionByName(c.join(p.select(F.col("id").alias("parent")), "parent", "left_semi").select(F.lit("comment").alias("kind"), "id", "parent", *columns))
    body, _ = written(body.where("text <> ''"), "contributions")
    placed, _ = written(body.select("kind", "parent", "id").distinct(), "placed")  # for two links
    cid, of = address(f"{prefix}_", F.col("kind"), "_", F.col("id")), address(f"{prefix}_proposal_", F.col("parent"))
    e.tables["contribution"] = body.select(cid.alias("id"), "text", time(F.col("at")).alias("timestamp"))
    e.links["has_contribution"] = placed.select(of.alias("source"), cid.alias("target"))
    e.links["response_to"] = placed.where("kind = 'comment'").select(cid.alias("source"), address(f"{prefix}_text_", F.col("parent")).alias("target"))
    made = body.where("author IS NOT NULL")
    e.links["made_by"] = made.select("kind", "id", "author").distinct().select(cid.alias("source"), person.alias("target"))
    e.tables["participant"] = made.groupBy("author").agg(F.min("author_name").alias("name")).select(person.alias("id"), F.col("author").alias("identifier"), F.coalesce("name", F.concat(F.lit("Citizen "), F.col("author"))).alias("name"), F.lit(platform).alias("platform"))
    e.links["has_participant"] = made.select("parent", "author").distinct().select(of.alias("source"), person.alias("target"))
    return e


def madrid(spark: SparkSession, path: str) -> Entities:
    """proposals[] and comments[] (at the top or below their proposal), authors as ids or as structs."""
    docs = read_json(spark, path)
    raw = explode(docs, "proposals")
    p = raw.select(field(raw, "id").alias("id"), field(raw, "title").alias("title"), F.coalesce(field(raw, "text"), field(raw, "summary"), field(raw, "description")).alias("text"), F.coalesce(field(raw, "userId"), field(raw, "author/id")).alias("author"), field(raw, "author/username").alias("author_name"), F.coalesce(field(raw, "date"), field(raw, "created_at")).alias("at"))
    c = explode(docs, "comments") if _has(docs, "comments") else explode(raw.withColumnRenamed("id", "pid"), "comments", F.col("pid")) if _has(raw, "comments") else None
    if c is not None:
        c = c.select(field(c, "id").alias("id"), F.coalesce(field(c, "proposalId"), field(c, "proposal_id"), field(c, "pid")).alias("parent"), F.coalesce(field(c, "text"), field(c, "body")).alias("text"), F.coalesce(field(c, "userId"), field(c, "author/id")).alias("author"), field(c, "author/username").alias("author_name"), F.coalesce(field(c, "date"), field(c, "created_at")).alias("at"))
    return _proposals(p, c, "madrid", "Decide Madrid")


def read_csv(spark: SparkSession, path: str, sep: str = ",") -> DataFrame:
    return spark.read.option("sep", sep).option("header", "true").option("multiLine", "true").option("quote", '"').option("escape", '"').csv(path)


def madrid_csv(spark: SparkSession, debates_path: str, comments_path: str | None = None) -> Entities:
    d = read_csv(spark, debates_path, ";")
    p = d.select(field(d, "id").alias("id"), field(d, "title").alias("title"), field(d, "description").alias("text"), X.slug(field(d, "author_name")).alias("author"), field(d, "author_name").alias("author_name"), field(d, "created_at").alias("at"))
    c = None
    if comments_path:
        c = read_csv(spark, comments_path, ";")
        c = c.select(field(c, "id").alias("id"), field(c, "debate_id").alias("parent"), field(c, "body").alias("text"), X.slug(field(c, "author_name")).alias("author"), field(c, "author_name").alias("author_name"), field(c, "created_at").alias("at"))
    return _proposals(p, c, "madrid", "Decide Madrid", X.day_hour)


def _many(df: DataFrame, name: str) -> Column:
    """A text in several languages: Catalan, Spanish, English (structs or a column a language)."""
    return X.first_language(*[field(df, f"{name}/{lang}") if _has(df, name, lang) else (F.col(f"`{name}/{lang}`") if f"{name}/{lang}" in df.columns else F.lit(None).cast("string")) for lang in ("ca", "es", "en")], F.col(f"`{name}`").cast("string") if name in df.columns and not _has(df, name, "ca") else F.lit(None).cast("string"))


def decidim(spark: SparkSession, path: str) -> Entities:
    docs = read_json(spark, path)
    raw = explode(docs, "proposals")
    p = raw.select(field(raw, "id").alias("id"), _many(raw, "title").alias("title"), _many(raw, "body").alias("text"), field(raw, "author/id").alias("author"), field(raw, "author/name").alias("author_name"), field(raw, "created_at").alias("at"))
    c = explode(docs, "comments")
    if c is not None:
        c = c.select(field(c, "id").alias("id"), field(c, "proposal_id").alias("parent"), _many(c, "body").alias("text"), field(c, "author/id").alias("author"), field(c, "author/name").alias("author_name"), field(c, "created_at").alias("at"))
    return _proposals(p, c, "decidim", "Decidim Barcelona")


def decidim_csv(spark: SparkSession, proposals_path: str, comments_path: str | None = None) -> Entities:
    d = read_csv(spark, proposals_path, ";")
    col = lambda df, n: F.col(f"`{n}`") if n in df.columns else F.lit(None).cast("string")
    p = d.select(col(d, "id").alias("id"), _many(d, "title").alias("title"), F.coalesce(_many(d, "body"), _many(d, "description")).alias("text"), col(d, "author/id").alias("author"), col(d, "author/name").alias("author_name"), F.coalesce(col(d, "published_at"), col(d, "start_time")).alias("at"))
    p = p.dropDuplicates(["id"])
    c = None
    if comments_path:
        c = read_csv(spark, comments_path, ";")
        c = c.select(col(c, "id").alias("id"), col(c, "commentable_id").alias("parent"), col(c, "body").alias("text"), col(c, "author/id").alias("author"), col(c, "author/name").alias("author_name"), col(c, "created_at").alias("at"))
    return _proposals(p, c, "decidim", "Decidim Barcelona")


#: What a Decidim export file holds, by what its name contains; the first that fits counts.
DECIDIM_FILES = (("meeting_comments", "meeting_comments"), ("comments", "proposal_comments"), ("proposals", "proposals"), ("meetings", "meetings"), ("results", "results"))
DECIDIM_PLATFORM = "Decidim Barcelona Participatory Democracy Platform"


def _cells(df: DataFrame | None, *names: str) -> list[Column]:
    """Columns by name (with slashes); null where there is none, or for an empty text."""
    return [F.nullif(F.col(f"`{n}`").cast("string"), F.lit("")).alias(n) if df is not None and n in df.columns else F.lit(None).cast("string").alias(n) for n in names]


def decidim_spaces(proposals: DataFrame, meetings: DataFrame | None = None, proposal_comments: DataFrame | None = None, meeting_comments: DataFrame | None = None, results: DataFrame | None = None) -> Entities:
    """One process a participatory space that has proposals. Columns are those of the open data files; one that is missing counts as null.

    Meetings join spaces that exist; a comment belongs to every space its parent is in, and answers it. A category is a topic of the spaces whose
    proposals have it, and of their contributions. Results are topics, of their space or, without a known one, of the platform. Rows without an id or
    text give no contribution, authors without a name no participant; repeated rows give one; of several names of an id the least is taken."""
    space, category = "participatory_space/id", "category/id"
    text = lambda df, body: F.btrim(F.concat_ws("\n\n", _many(df, "title"), _many(df, body)), F.lit(" \t\n\r"))
    who = ("author/id", "author/name")
    p = proposals.select(*_cells(proposals, "id", space, "participatory_space/url", category, *who, "published_at"), _many(proposals, "category/name").alias("category_name"), text(proposals, "body").alias("text")).where(F.col(space).isNotNull())
    p, _ = written(p, "proposals")
    pid = address("decidim_process_", F.col(space))
    spaces = few(p.groupBy(space).agg(F.min(X.url_tail(F.col("participatory_space/url"))).alias("name")), "spaces")
    e = Entities()
    e.tables["process"] = spaces.select(pid.alias("id"), F.concat(F.lit("decidim_process_"), F.col(space)).alias("identifier"), F.concat(F.lit("Decidim Barcelona: "), F.coalesce("name", F.lit(""))).alias("name"), F.lit("Decidim Barcelona").alias("platform"))

    topics = few(p.where(F.col(category).isNotNull()).groupBy(space, category).agg(F.min("category_name").alias("name")).where("name IS NOT NULL"), "topics")
    tid = address("decidim_topic_", F.col(category))
    e.tables["topic"] = topics.groupBy(category).agg(F.min("name").alias("name")).select(tid.alias("id"), "name")

    # All rows as a table, parsed and joined once, not once a link; ids as the files have them.
    none = F.lit(None).cast("string")
    columns = ["id", space, "text", F.col("author/id").alias("author"), F.col("author/name").alias("author_name"), "timestamp", category, "to_kind", "to"]
    of_kind = lambda df, kind, **more: df.withColumns({"to_kind": none, "to": none} | more).select(F.lit(kind).alias("kind"), *columns)
    body = [of_kind(p, "proposal", timestamp=F.col("published_at"))]
    parents = [(proposal_comments, p, "proposal")]
    if meetings is not None:
        m = meetings.select(*_cells(meetings, "id", space, category, "start_time"), text(meetings, "description").alias("text")).join(spaces.select(space), space, "left_semi")
        body.append(of_kind(m, "meeting", **{"timestamp": F.col("start_time"), "author/id": none, "author/name": none}))
        parents.append((meeting_comments, m, "meeting"))
    for c, of, kind in parents:
        if c is not None:
            c = c.select(*_cells(c, "id", "commentable_id", "body", *who, "created_at"))
            c = c.join(of.select(F.col("id").alias("commentable_id"), space).distinct(), "commentable_id")
            body.append(of_kind(c, "comment", **{"text": F.col("body"), "timestamp": F.col("created_at"), category: none, "to_kind": F.lit(kind), "to": F.col("commentable_id")}))
    rows, _ = written(reduce(DataFrame.unionByName, body), "contributions")

    person, cid = address("decidim_participant_", F.col("author")), address("decidim_", F.col("kind"), "_", F.col("id"))
    # Whoever wrote a row of a space takes part in it, also where the row gives no contribution.
    named, _ = written(rows.where("author IS NOT NULL AND author_name IS NOT NULL").groupBy(space, "author").agg(F.min("author_name").alias("name")), "named")
    e.tables["participant"] = named.groupBy("author").agg(F.min("name").alias("name")).select(person.alias("id"), F.col("author").alias("identifier"), "name", F.lit("Decidim Barcelona").alias("platform"))
    e.links["has_participant"] = named.select(pid.alias("source"), person.alias("target"))

    said = rows.where("id IS NOT NULL AND text <> ''")
    e.tables["contribution"] = said.groupBy("kind", "id").agg(F.min("text").alias("text"), F.min("timestamp").alias("timestamp")).select(cid.alias("id"), "text", "timestamp")
    e.links["has_contribution"] = said.select(space, "kind", "id").distinct().select(pid.alias("source"), cid.alias("target"))
    made = said.where("author IS NOT NULL")  # a row with a name is among those that name its author
    made = made.where("author_name IS NOT NULL").select("kind", "id", "author").unionByName(made.where("author_name IS NULL").join(named.select(space, "author"), [space, "author"], "left_semi").select("kind", "id", "author"))
    e.links["made_by"] = made.distinct().select(cid.alias("source"), person.alias("target"))
    about = said.where(F.col(category).isNotNull()).join(topics.select(space, category), [space, category], "left_semi").select("kind", "id", category).distinct()
    e.links["has_topic"] = topics.select(pid.alias("source"), tid.alias("target")).unionByName(about.select(cid.alias("source"), tid.alias("target")))
    e.links["response_to"] = said.where("to IS NOT NULL").select("kind", "id", "to_kind", "to").distinct().select(cid.alias("source"), address("decidim_", F.col("to_kind"), "_", F.col("to")).alias("target"))

    if results is not None:
        r = results.select(*_cells(results, "id", space), _many(results, "title").alias("name")).where("id IS NOT NULL")
        r = r.join(spaces.select(space, F.lit(True).alias("known")), space, "left")
        rid, home = address("decidim_result_topic_", F.col("id")), F.when(F.col("known"), pid).otherwise(address("decidim_barcelona_process"))
        e.tables["topic"] = e.tables["topic"].unionByName(r.groupBy("id").agg(F.min("name").alias("name")).select(rid.alias("id"), "name"))
        e.links["has_topic"] = e.links["has_topic"].unionByName(r.select(home.alias("source"), rid.alias("target")).distinct())
        platform = r.where("known IS NULL").agg(F.count(F.lit(1)).alias("n")).where("n > 0")
        e.tables["process"] = e.tables["process"].unionByName(platform.select(address("decidim_barcelona_process").alias("id"), F.lit("decidim_barcelona_process").alias("identifier"), F.lit(DECIDIM_PLATFORM).alias("name"), F.lit("Decidim Barcelona").alias("platform")))
    return e


def decidim_folder(spark: SparkSession, folder: str, sep: str = ";") -> Entities:
    """Spaces from a folder of open data files, each told by its name. Files of one kind need not have the same columns; others are left alone."""
    kinds: dict[str, list[DataFrame]] = {}
    for path in files(spark, folder):
        name = path.rsplit("/", 1)[-1]
        kind = next((k for part, k in DECIDIM_FILES if part in name), None)
        if name.endswith(".csv") and kind:
            kinds.setdefault(kind, []).append(read_csv(spark, path, sep))
    if "proposals" not in kinds:
        raise FileNotFoundError(f"no file of proposals in {folder}")
    return decidim_spaces(**{k: reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), v) for k, v in kinds.items()})


def _conversations(rows: DataFrame) -> Entities:
    """rows: grp, mid, origin, text, kind, parent (annotation target)."""
    rows = rows.where(F.coalesce(F.upper("origin") != "SYSTEM", F.lit(True)) & (F.coalesce("text", F.lit("")) != "") & F.col("mid").isNotNull())
    pid, cid = address("delidata_process_", F.col("grp")), address("delidata_message_", F.col("grp"), "_", F.col("mid"))
    who = address("delidata_participant_", F.col("grp"), "_", X.slug(F.col("origin")))
    e = Entities()
    groups = rows.select("grp").distinct()
    e.tables["process"] = groups.select(pid.alias("id"), F.col("grp").alias("identifier"), F.concat(F.lit("DeliData "), F.col("grp")).alias("name"), F.lit("DeliData").alias("platform"))
    e.tables["contribution"] = rows.select(cid.alias("id"), F.col("mid").alias("identifier"), X.collapse(F.col("text")).alias("text"))
    made = rows.where("origin IS NOT NULL")
    e.tables["participant"] = made.select(who.alias("id"), F.col("origin").alias("name"), F.lit("DeliData").alias("platform")).distinct()
    e.links["has_contribution"] = rows.select(pid.alias("source"), cid.alias("target"))
    e.links["made_by"] = made.select(cid.alias("source"), who.alias("target"))
    e.links["has_participant"] = made.select(pid.alias("source"), who.alias("target")).distinct()
    argued = rows.where("kind IS NOT NULL AND kind NOT IN ('', '0')")
    arg = F.concat(cid, F.lit("_argument"))
    e.tables["argument"] = argued.select(arg.alias("id"), X.collapse(F.col("text")).alias("text"))
    e.links["has_argument"] = argued.select(cid.alias("source"), arg.alias("target"))
    return e


def delidata(spark: SparkSession, path: str) -> Entities:
    docs = read_json(spark, path)
    c = docs.select(F.explode("conversations").alias("x")).select("x.*") if "conversations" in docs.columns else docs
    m = explode(c, "messages", field(c, "group_id").alias("grp"))
    return _conversations(m.select("grp", F.coalesce(field(m, "message_id"), field(m, "id")).alias("mid"), field(m, "origin", "author").alias("origin"), F.coalesce(field(m, "clean_text"), field(m, "original_text"), field(m, "text")).alias("text"), field(m, "annotation_type").alias("kind")))


def delidata_tsv(spark: SparkSession, path: str) -> Entities:
    m = spark.read.option("sep", "\t").option("header", "true").csv(path).withColumn("file", F.regexp_replace(F.col("_metadata.file_name"), r"\.[^.]*$", ""))
    return _conversations(m.select(F.coalesce(field(m, "group_id"), F.col("file")).alias("grp"), field(m, "message_id").alias("mid"), field(m, "origin").alias("origin"), F.coalesce(field(m, "clean_text"), field(m, "original_text")).alias("text"), field(m, "annotation_type").alias("kind")))


def _feedback(rows: DataFrame) -> Entities:
    """rows: initiative, title, fid, text, org, name, country, at, language. A person is an organisation, else named with the feedback's id, else anonymous by country."""
    rows, _ = written(rows.where("initiative IS NOT NULL AND fid IS NOT NULL"), "feedback")  # parsed once, not once a link
    some = lambda c: F.nullif(F.trim(F.col(c)), F.lit(""))
    key = F.when(some("org").isNotNull(), F.concat(F.lit("org_"), X.slug(F.col("org")))).when(some("name").isNotNull(), F.concat(F.lit("person_"), X.slug(F.col("name")), F.lit("_"), F.col("fid"))).otherwise(F.concat(F.lit("anonymous_"), F.coalesce(some("country"), F.lit("unknown"))))
    shown = F.coalesce(some("name"), some("org"), F.concat(F.lit("Anonymous, "), F.coalesce(some("country"), F.lit("unknown"))))
    kind = F.when(some("org").isNotNull(), "organization").when(some("name").isNotNull(), "person").otherwise("anonymous")
    pid, cid, who = address("euhys_process_", F.col("initiative")), address("euhys_feedback_", F.col("fid")), address("euhys_participant_", key)
    platform = "EU Have Your Say"
    e = Entities()
    e.tables["process"] = rows.groupBy("initiative").agg(F.min("title").alias("name")).select(pid.alias("id"), F.col("initiative").alias("identifier"), F.coalesce("name", F.concat(F.lit("Initiative "), F.col("initiative"))).alias("name"), F.lit(platform).alias("platform"))
    e.tables["contribution"] = rows.select(cid.alias("id"), F.col("fid").alias("identifier"), X.clean_html(F.col("text")).alias("text"), F.col("at").alias("timestamp"), "language")
    e.tables["participant"] = rows.select(who.alias("id"), shown.alias("name"), F.col("country"), kind.alias("participant_type"), F.lit(platform).alias("platform")).dropDuplicates(["id"])
    e.tables["organization"] = rows.where(some("org").isNotNull()).select(address("euhys_org_", X.slug(F.col("org"))).alias("id"), F.col("org").alias("name")).distinct()
    e.links["affiliated"] = rows.where(some("org").isNotNull()).select(who.alias("source"), address("euhys_org_", X.slug(F.col("org"))).alias("target")).distinct()
    e.links["has_contribution"] = rows.select(pid.alias("source"), cid.alias("target"))
    e.links["made_by"] = rows.select(cid.alias("source"), who.alias("target"))
    e.links["has_participant"] = rows.select(pid.alias("source"), who.alias("target")).distinct()
    return e


def consultations(spark: SparkSession, path: str) -> Entities:
    """CSV with either header set."""
    d = read_csv(spark, path)
    full = F.trim(F.concat_ws(" ", field(d, "first_name"), field(d, "surname")))
    return _feedback(d.select(
        field(d, "publication_id", "Initiative ID").alias("initiative"), field(d, "publication", "Initiative Title").alias("title"), field(d, "id", "Feedback ID").alias("fid"), field(d, "feedback", "Feedback Text").alias("text"),
        field(d, "organization", "Organization").alias("org"), F.coalesce(F.nullif(full, F.lit("")), field(d, "Contributor Name")).alias("name"), field(d, "country").alias("country"), field(d, "date_feedback", "Submission Date", "timestamp").alias("at"), field(d, "language").alias("language"),
    ))


def consultation_documents(spark: SparkSession, path: str) -> Entities:
    """Initiative documents with feedback[] and policy_areas[]."""
    d = read_json(spark, path)
    d = d.withColumn("iid", field(d, "initiative_id", "id"))
    f = explode(d, "feedback", F.col("iid"), field(d, "title").alias("t"))
    rows = f.select(
        F.col("iid").alias("initiative"), F.col("t").alias("title"), field(f, "id").alias("fid"), field(f, "text", "feedback").alias("text"), field(f, "organization").alias("org"), F.nullif(F.trim(F.concat_ws(" ", field(f, "firstName"), field(f, "surname"))), F.lit("")).alias("name"),
        field(f, "country").alias("country"), field(f, "date", "dateFeedback").alias("at"), field(f, "language").alias("language"),
    )
    e = _feedback(rows)
    if _has(d, "policy_areas"):
        t = d.select("iid", F.explode("policy_areas").alias("area"))
        tid = address("euhys_topic_", X.slug(F.col("area")))
        e = e + Entities({"topic": t.select(tid.alias("id"), F.col("area").alias("name")).distinct()}, {"has_topic": t.select(address("euhys_process_", F.col("iid")).alias("source"), tid.alias("target"))})
    return e


def sqlite_table(spark: SparkSession, path: str, query: str) -> DataFrame:
    """The rows of a small SQLite query, as text; large tables are exported first."""
    with sqlite3.connect(path) as db:
        rows = db.execute(query)
        names = [d[0] for d in rows.description]
        return spark.createDataFrame([tuple(None if v is None else str(v) for v in r) for r in rows], ", ".join(f"`{n}` string" for n in names))


def consultation_sqlite(spark: SparkSession, path: str) -> Entities:
    raw = sqlite_table(spark, path, "SELECT CAST(id AS TEXT) AS id, CAST(publication_id AS TEXT) AS publication_id, CAST(initiative_id AS TEXT) AS initiative_id, data FROM feedback")
    x = raw.withColumn("j", F.from_json("data", "firstName string, surname string, organization string, country string, feedback string, dateFeedback string, language string"))
    return _feedback(x.select(F.coalesce("initiative_id", "publication_id").alias("initiative"), F.lit(None).cast("string").alias("title"), F.col("id").alias("fid"), F.col("j.feedback").alias("text"), F.col("j.organization").alias("org"), F.nullif(F.trim(F.concat_ws(" ", "j.firstName", "j.surname")), F.lit("")).alias("name"), F.col("j.country").alias("country"), F.col("j.dateFeedback").alias("at"), F.col("j.language").alias("language")))


def habermas(tables: dict[str, DataFrame]) -> Entities:
    """candidate_comparisons, final_preference_rankings, position_statement_ratings, round_survey_responses: one process a session."""
    platform = "Habermas Machine"
    pid, who = address("habermas_process_", F.col("session_id")), address("habermas_participant_", F.col("participant_id"))
    parts = []
    get = lambda name: tables.get(name)
    one = lambda df, kind, key, text: df.select(F.col("session_id").cast("string"), F.col("participant_id").cast("string"), address(f"habermas_{kind}_", key).alias("id"), text.alias("text"), field(df, "timestamp").alias("timestamp"))
    if (c := get("candidate_comparisons")) is not None:
        parts.append(one(c, "comparison", F.col("comparison_id"), F.concat(F.lit("Prefers "), field(c, "preference"), F.lit(" between "), field(c, "candidate_a"), F.lit(" and "), field(c, "candidate_b"), F.coalesce(F.concat(F.lit(": "), field(c, "reasoning")), F.lit("")))))
    if (c := get("position_statement_ratings")) is not None:
        parts.append(one(c, "statement", F.col("statement_id"), F.concat(field(c, "statement"), F.lit(" (agreement "), field(c, "agreement_rating"), F.lit(")"), F.coalesce(F.concat(F.lit(": "), field(c, "comment")), F.lit("")))))
    if (c := get("final_preference_rankings")) is not None:
        r = c if c.schema["rankings"].dataType.typeName() == "array" else c.withColumn("rankings", X.json_items(F.col("rankings"), "array<struct<candidate:string,rank:int,score:double>>"))
        parts.append(one(r, "ranking", F.concat_ws("_", "session_id", "participant_id", "round"), F.concat(F.lit("Ranking: "), F.array_join(F.transform(F.array_sort(F.transform("rankings", lambda x: F.struct(x["rank"].alias("rank"), x["candidate"].alias("candidate")))), lambda x: x["candidate"]), ", "))))
    if (c := get("round_survey_responses")) is not None:
        q = c if c.schema["questions"].dataType.typeName() == "array" else c.withColumn("questions", X.json_items(F.col("questions"), "array<struct<question_id:string,question_text:string,response:int,response_text:string>>"))
        parts.append(one(q, "survey", F.col("survey_id"), F.array_join(F.transform("questions", lambda x: F.concat(F.coalesce(x["question_text"], F.lit("")), F.lit(" "), F.coalesce(x["response_text"].cast("string"), x["response"].cast("string"), F.lit("")))), "; ")))
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    e = Entities()
    e.tables["process"] = rows.select("session_id").distinct().select(pid.alias("id"), F.col("session_id").alias("identifier"), F.concat(F.lit("Habermas session "), F.col("session_id")).alias("name"), F.lit(platform).alias("platform"))
    e.tables["participant"] = rows.select("participant_id").distinct().select(who.alias("id"), F.concat(F.lit("Participant "), F.col("participant_id")).alias("name"), F.lit(platform).alias("platform"))
    e.tables["contribution"] = rows.select("id", "text", "timestamp")
    e.links["has_contribution"] = rows.select(pid.alias("source"), F.col("id").alias("target"))
    e.links["made_by"] = rows.select(F.col("id").alias("source"), who.alias("target"))
    e.links["has_participant"] = rows.select(pid.alias("source"), who.alias("target")).distinct()
    if (c := get("position_statement_ratings")) is not None and "topic" in c.columns:
        tid = address("habermas_topic_", X.slug(F.col("topic")))
        t = c.where("topic IS NOT NULL").select("session_id", "topic").distinct()
        e = e + Entities({"topic": t.select(tid.alias("id"), F.col("topic").alias("name")).distinct()}, {"has_topic": t.select(pid.alias("source"), tid.alias("target"))})
    return e


def habermas_files(spark: SparkSession, folder: str) -> Entities:
    names = ("candidate_comparisons", "final_preference_rankings", "position_statement_ratings", "round_survey_responses")
    return habermas({n: spark.read.parquet(f"{folder}/{n}.parquet") for n in names})


def habermas_json(spark: SparkSession, path: str) -> Entities:
    docs = read_json(spark, path)
    names = ("candidate_comparisons", "final_preference_rankings", "position_statement_ratings", "round_survey_responses")
    return habermas({n: docs.select(F.explode(n).alias("x")).select("x.*") for n in names if n in docs.columns})


def _court(rows: DataFrame, cases: DataFrame) -> Entities:
    """rows: case, pos, speaker, role, text, at; cases: case, name, start. The counter of contributions counts rows without text too."""
    pid = address("scotus_case_", X.slug(F.col("case")))
    n = F.row_number().over(Window.partitionBy("case").orderBy("pos"))
    rows = rows.withColumn("n", n).where("speaker IS NOT NULL AND trim(coalesce(text, '')) <> ''")
    who, cid = address("scotus_participant_", X.slug(F.col("speaker"))), F.concat(pid, F.lit("_contribution_"), F.col("n"))
    role = F.coalesce("role", X.court_role(F.col("speaker")))
    rid = address("role_us_supreme_", X.slug(role))
    platform = "US Supreme Court"
    e = Entities()
    e.tables["process"] = cases.select(pid.alias("id"), F.col("case").alias("identifier"), F.coalesce("name", "case").alias("name"), F.col("start").alias("start_date"), F.lit(platform).alias("platform")).dropDuplicates(["id"])
    e.tables["topic"] = cases.select(F.concat(pid, F.lit("_topic")).alias("id"), F.coalesce("name", "case").alias("name")).dropDuplicates(["id"])
    e.tables["participant"] = rows.select(who.alias("id"), F.initcap("speaker").alias("name"), F.lit(platform).alias("platform")).dropDuplicates(["id"])
    e.tables["role"] = rows.select(rid.alias("id"), role.alias("name")).distinct()
    e.tables["contribution"] = rows.select(cid.alias("id"), X.collapse(F.col("text")).alias("text"), F.col("at").alias("timestamp"))
    e.links["has_topic"] = cases.select(pid.alias("source"), F.concat(pid, F.lit("_topic")).alias("target")).distinct()
    e.links["has_role"] = rows.select(who.alias("source"), rid.alias("target")).distinct()
    e.links["has_participant"] = rows.select(pid.alias("source"), who.alias("target")).distinct()
    e.links["has_contribution"] = rows.select(pid.alias("source"), cid.alias("target"))
    e.links["made_by"] = rows.select(cid.alias("source"), who.alias("target"))
    return e


def court(spark: SparkSession, path: str) -> Entities:
    """case_metadata and transcript[] documents, or cases[] with transcript[]."""
    docs = read_json(spark, path)
    if "cases" in docs.columns:
        docs = docs.select(F.explode("cases").alias("x")).select("x.*")
    case = F.coalesce(field(docs, "case_metadata/docket_number"), field(docs, "docket_number"), field(docs, "id"))
    cases = docs.select("*", case.alias("case"))
    t = explode(cases, "transcript", F.col("case"))
    rows = t.select("case", "pos", field(t, "speaker", "speaker_id").alias("speaker"), field(t, "speaker_role").alias("role"), field(t, "text").alias("text"), field(t, "timestamp").alias("at"))
    return _court(rows, cases.select("case", F.coalesce(field(docs, "case_metadata/case_name"), field(docs, "case_name"), field(docs, "name")).alias("name"), F.coalesce(field(docs, "case_metadata/argument_date"), field(docs, "date")).alias("start")))


def court_csv(spark: SparkSession, path: str) -> Entities:
    """case, speaker, text; or id, text, speaker, speaker_role with the file as the case. Rows keep their file order."""
    d = with_places(read_csv(spark, path).select("*", F.regexp_replace(F.col("_metadata.file_name"), r"\.[^.]*$", "").alias("file"), "_metadata"), "pos")
    rows = d.select(F.coalesce(field(d, "case"), F.col("file")).alias("case"), "pos", field(d, "speaker").alias("speaker"), field(d, "speaker_role").alias("role"), field(d, "text").alias("text"), F.lit(None).cast("string").alias("at"))
    name = F.max(X.case_name(F.col("text")))
    return _court(rows, rows.groupBy("case").agg(name.alias("name")).withColumn("start", F.lit(None).cast("string")))


def sampled_text(df: DataFrame, rows: int | None = None, width: int = 100, least: int = 10) -> DataFrame:
    """id and text of any table: its string columns longer than `least`, `width` characters of each, of the first `rows` rows if asked."""
    names = [c for c, t in df.dtypes if t == "string"]
    cells = [F.when(F.length(F.col(f"`{c}`")) > least, F.substring(F.col(f"`{c}`"), 1, width)) for c in names]
    out = df.limit(rows) if rows is not None else df
    return out.select(X.stable_id(*[F.col(f"`{c}`") for c in df.columns]).alias("id"), F.concat_ws(" ", *cells).alias("text")).where("text <> ''")


#: Fixed values of page extraction: link and reference patterns.
INITIATIVE_LINK = r"/have-your-say/initiatives/(\d+[^\"'#? ]*)"
FEEDBACK_REF = r"(F\d{5,})"
METADATA = r"(?is)<dt\b[^>]*>(.*?)</dt>\s*<dd\b[^>]*>(.*?)</dd>"


def page_parts(pages: DataFrame) -> DataFrame:
    """url, links, ref, main_text, attachments, metadata, sha256 of raw pages (url, html), all as expressions. metadata: the terms of definition
    lists and what stands beside them, in page order, repeated terms kept."""
    html = F.coalesce("html", F.lit(""))
    body = F.regexp_replace(html, r"(?is)<(script|style|nav|header|footer|aside)\b.*?</\1>", " ")
    hrefs = F.regexp_extract_all(html, F.lit(r'href="([^"]*)"'))
    term, value = [F.regexp_extract_all(html, F.lit(METADATA), F.lit(i)) for i in (1, 2)]
    metadata = F.transform(F.arrays_zip(term.alias("term"), value.alias("value")), lambda x: F.struct(X.clean_html(x["term"]).alias("term"), X.clean_html(x["value"]).alias("value")))
    return pages.select(
        "url", F.array_distinct(F.regexp_extract_all(html, F.lit(INITIATIVE_LINK))).alias("links"), F.nullif(F.regexp_extract(html, FEEDBACK_REF, 1), F.lit("")).alias("ref"),
        X.clean_html(body).alias("main_text"), F.filter(hrefs, lambda h: F.lower(h).rlike(r"\.(pdf|docx?|odt|rtf|txt)($|\?)") | F.lower(h).contains("attachment")).alias("attachments"),
        metadata.alias("metadata"), F.sha2(html, 256).alias("sha256"),
    )


def paginate(fetch: Callable[[dict], tuple[int, list, dict]], params: dict, size: int = 50, most: int | None = None, pause: float = 10, tries: int = 20, wait: Callable[[float], None] = time.sleep) -> Iterator[dict]:
    """Items of a paged interface: by offset until a short page or status 204, or until `last`. fetch gives status, items, about.

    Status 429 is asked again after the seconds in about's Retry-After (`pause` without a number there); `tries` times in a row are an error."""
    offset, page, refused = 0, 0, 0
    while most is None or page < most:
        status, items, about = fetch(params | {"offset": offset, "page": page, "limit": size})
        if status == 429:
            refused += 1
            if refused == tries:
                raise TimeoutError(f"refused {tries} times in a row at offset {offset}")
            after = str(about.get("Retry-After", ""))
            wait(float(after) if after.isdecimal() else pause)
            continue
        if status == 204:
            return
        refused = 0
        yield from items
        if about.get("last", len(items) < size):
            return
        offset, page = offset + size, page + 1


#: Adapters by name: (kind of path, function).
REGISTRY: dict[str, Callable[[SparkSession, str], Entities]] = {
    "debates": debates, "parliament_api": parliament_api, "debate_html": debate_html, "madrid": madrid, "madrid_csv": madrid_csv,
    "decidim": decidim, "decidim_csv": decidim_csv, "decidim_folder": decidim_folder, "delidata": delidata, "delidata_tsv": delidata_tsv,
    "consultations": consultations, "consultation_documents": consultation_documents, "consultation_sqlite": consultation_sqlite, "habermas": habermas_files, "habermas_json": habermas_json, "court": court, "court_csv": court_csv,
}


def files(spark: SparkSession, folder: str) -> list[str]:
    """What is in a folder, by name, through Spark's file systems; nothing where there is none."""
    at = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    return sorted(str(s.getPath().toString()) for s in fs.listStatus(at)) if fs.exists(at) else []


def discover(spark: SparkSession, folder: str) -> dict[str, list[str]]:
    """Files below `folder`/<adapter> for each registered adapter; adapters that read a folder get the folder."""
    out = {}
    for name in REGISTRY:
        found = files(spark, f"{folder}/{name}")
        if found:
            out[name] = [f"{folder}/{name}"] if REGISTRY[name] in (decidim_folder, habermas_files) else found
    return out
