"""Point-wise ingest of events: one expression for batch and stream, and windows over event time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.terms import DEL, RDFS, TRIPLE_COLUMNS, TYPE, XSD
from ..functions.text import stable_id
from ..operators.versions import IDS, Versions
from ..sources.store import dealt, drop, written

BASE = "https://example.org/ingest/"
EVENT = (
    "contribution_id string, text string, timestamp string, user_id bigint, user_name string, post_id bigint, post_name string, group_id bigint, group_name string, community_id bigint, "
    "community_name string, value int, parent_point_id bigint, fallacies array<struct<type:string,score:double,rationale:string>>"
)


def event_triples(base: str = BASE, language: str = "it", platform: str = "Your Priorities") -> Column:
    """array<triple> of an event's columns. Fallacy ids derive from the event, so a replay adds nothing."""
    return F.filter(_possible_triples(base, language, platform), lambda x: x.isNotNull())


def _possible_triples(base: str = BASE, language: str = "it", platform: str = "Your Priorities") -> Column:
    """event_triples() with nulls for the triples that an event does not have. A filter of the array would have Spark interpret all that makes it."""
    c = lambda n: F.col(n).cast("string")
    me = F.concat(F.lit(base), F.coalesce(c("contribution_id"), F.concat(F.lit("point-"), stable_id(F.col("text"), F.col("timestamp"), F.col("user_id")))))
    node = lambda tag, n: F.concat(F.lit(f"{base}{tag}-"), c(n))
    user, topic, process, parent = node("user", "user_id"), node("post", "post_id"), node("group", "group_id"), node("point", "parent_point_id")
    none = F.lit(None).cast("string")

    def t(s: Column, p: str, o: Column, kind: str = "uri", dt: str | None = None, lang: str | None = None, when: Column | None = None) -> Column:
        row = F.struct(s.alias("s"), F.lit("uri").alias("s_kind"), F.lit(p).alias("p"), o.alias("o"), F.lit(kind).alias("o_kind"), (F.lit(dt) if dt else none).alias("o_dt"), (F.lit(lang) if lang else none).alias("o_lang"), F.lit("ingest").alias("src"))
        ok = s.isNotNull() & o.isNotNull() & (o != "")
        return F.when(ok if when is None else ok & when, row)

    cls = lambda n: F.lit(DEL + n)
    stance = {"supports": F.col("value") == 1, "attacks": F.col("value") == -1}
    rows = [t(me, TYPE, cls("Contribution")), t(me, TYPE, cls("Argument")), t(me, DEL + "platform", F.lit(platform), "literal"), t(me, DEL + "text", c("text"), "literal", lang=language), t(me, DEL + "hasTimestamp", c("timestamp"), "literal", XSD + "dateTime")]
    for who, kind, name in ((user, "Participant", "user_name"), (topic, "Topic", "post_name"), (process, "DeliberationProcess", "group_name")):
        rows += [t(who, TYPE, F.when(who.isNotNull(), cls(kind))), t(who, RDFS + "label", c(name), "literal"), t(who, DEL + "name", c(name), "literal")]
    rows += [t(me, DEL + "madeBy", user), t(me, DEL + "isAbout", topic), t(me, DEL + "respondsTo", parent)]
    rows += [t(me, DEL + k, o, when=w) for k, w in stance.items() for o in (topic, parent)]
    rows += [t(me, DEL + "partOf", process), t(process, DEL + "hasTopic", topic), t(process, DEL + "hasParticipant", user)]

    def fallacy(x: Column, i: Column) -> Column:
        who = F.concat(F.lit(f"{base}fallacy-"), stable_id(me, x["type"], i))
        return F.array(
            t(who, TYPE, cls("FallacyType")), t(who, RDFS + "label", x["type"], "literal"), t(who, DEL + "hasConfidence", x["score"].cast("string"), "literal", XSD + "float"),
            t(who, RDFS + "comment", x["rationale"], "literal", lang=language), t(me, DEL + "containsFallacy", who),
        )

    extra = F.flatten(F.transform(F.coalesce("fallacies", F.from_json(F.lit("[]"), "array<struct<type:string,score:double,rationale:string>>")), fallacy))
    return F.concat(F.array(*rows), extra)


def parse_events(lines: DataFrame, column: str = "value") -> DataFrame:
    return lines.select(F.from_json(F.col(column).cast("string"), EVENT).alias("e")).where("e IS NOT NULL").select("e.*")


def ingest(events: DataFrame, **options) -> DataFrame:
    """Triples of events, for a batch or a stream alike (a batch is made a set by the caller's graph)."""
    return events.select(F.inline(_possible_triples(**options))).where("p IS NOT NULL")


def counters(events: DataFrame) -> DataFrame:
    """contribution_id, fallacies_added, participant_linked, topic_linked, process_created: what a point-wise call would answer."""
    return events.select(
        "contribution_id", F.coalesce(F.size("fallacies"), F.lit(0)).alias("fallacies_added"), F.col("user_id").isNotNull().alias("participant_linked"), F.col("post_id").isNotNull().alias("topic_linked"), F.col("group_id").isNotNull().alias("process_created")
    )


def start(events: DataFrame, path: str, checkpoint: str, every: str = "5 minutes", available_now: bool = False, delay: str = "1 hour"):
    """A query that appends the triples of a stream of events to `path`.

    An event that repeats another in all its fields is dropped if it comes within the delay, later ones by the set on reading. The watermark is on the time of arrival alone,
    so an event without an id or a time, or with an old time, is stored like any other."""
    once = events.withColumn("arrived", F.current_timestamp()).withColumn("same", F.sha2(F.to_json(F.struct(*events.columns)), 256))
    once = once.withWatermark("arrived", delay).dropDuplicatesWithinWatermark(["same"])
    out = ingest(once.drop("arrived", "same")).writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")
    return (out.trigger(availableNow=True) if available_now else out.trigger(processingTime=every)).start()


def read_set(spark, path: str) -> DataFrame:
    return spark.read.parquet(path).dropDuplicates(list(TRIPLE_COLUMNS))


# Windows over event time; `ts` may be a timestamp without zone, which watermarks do not take.
def timed(events: DataFrame, column: str = "ts", delay: str | None = None) -> DataFrame:
    out = events.withColumn(column, F.col(column).cast("timestamp"))
    return out.withWatermark(column, delay) if delay else out


def windowed(events: DataFrame, keys: list[str], size: str, slide: str | None = None, column: str = "ts", delay: str | None = None) -> DataFrame:
    """Counts and sums a window (tumbling, or sliding by `slide`)."""
    w = F.window(column, size, slide) if slide else F.window(column, size)
    return timed(events, column, delay).groupBy(w.alias("w"), *keys).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *keys, "n", "total")


def sessions(events: DataFrame, keys: list[str], gap: str, column: str = "ts", delay: str | None = None) -> DataFrame:
    out = timed(events, column, delay).groupBy(F.session_window(column, gap).alias("w"), *keys).agg(F.count(F.lit(1)).alias("n"))
    return out.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *keys, "n")


# Ingest into versions
COUNTERS = "events bigint, new bigint, repeated bigint, fallacies_added bigint, participants_linked bigint, topics_linked bigint, processes_created bigint, triples_added bigint, total_triples bigint"


def ingest_batch(events: DataFrame, root: str, name: str, batch: int, buckets: int = 32, **options) -> None:
    """A batch of events into the graph of `root` (operators.versions): root/graph, root/events (hashes of the events that are in) and root/counters.

    An event that is in already, however long ago, adds nothing and counts as repeated. The graph, the counters and the events are committed in this order, each once a batch: a batch
    that was ended within it and is run again ends as if it had run once."""
    spark = events.sparkSession
    seen, graph = Versions(spark, f"{root}/events", IDS, buckets), Versions(spark, f"{root}/graph", buckets=buckets)
    known = seen.manifest()
    if known["applied"].get(name, [-1])[0] >= batch:
        return
    held, at = written(dealt(events, "contribution_id").withColumn("id", F.sha2(F.to_json(F.struct(*events.columns)), 256)), "batch")
    ids = seen._placed(held.select("id").distinct(), known["buckets"])
    new, new_at = written(seen.missing(ids, known).select("id"), "new")
    fresh = held.dropDuplicates(["id"]).join(new, "id", "left_semi")
    made = graph.add(ingest(dealt(fresh, "id").drop("id"), **options), (name, batch))
    told = counters(fresh).agg(
        F.count(F.lit(1)).alias("new"), F.coalesce(F.sum("fallacies_added"), F.lit(0)).alias("fallacies_added"), F.count_if("participant_linked").alias("participants_linked"),
        F.count_if("topic_linked").alias("topics_linked"), F.count_if("process_created").alias("processes_created"),
    )
    told = told.withColumns({"events": F.lit(held.count()), "triples_added": F.lit(made["applied"][name][1]), "total_triples": F.lit(made["rows"])}).withColumn("repeated", F.col("events") - F.col("new"))
    told.select(*[F.col(c.split()[0]).cast("long") for c in COUNTERS.split(", ")]).coalesce(1).write.mode("overwrite").parquet(f"{root}/counters/stream={name}/batch={batch}")
    seen.add(new, (name, batch))
    drop(spark, at, new_at)


def start_versions(events: DataFrame, root: str, checkpoint: str, name: str = "ingest", every: str = "5 minutes", available_now: bool = False, **options):
    """A query that saves a stream of events as versions of the graph: a version a batch, at most one each `every`, none while nothing comes."""
    out = events.writeStream.foreachBatch(lambda df, batch: ingest_batch(df, root, name, batch, **options)).option("checkpointLocation", checkpoint)
    return (out.trigger(availableNow=True) if available_now else out.trigger(processingTime=every)).start()
