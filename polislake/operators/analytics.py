"""Statistics, listings, search, platforms, network, fallacies and validation of a graph."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.terms import DEL, OWL, SKOS, TYPE
from .model import CLASSES, instances, links, values


def graph_stats(triples: DataFrame) -> DataFrame:
    """One row: triples, and distinct instances of the five main classes and links across platforms, in one scan."""
    of = lambda c: F.count_distinct(F.when((F.col("p") == TYPE) & (F.col("o") == DEL + CLASSES[c]), F.col("s")))
    names = {"processes": "process", "participants": "participant", "contributions": "contribution", "topics": "topic", "organizations": "organization"}
    return triples.agg(
        F.count(F.lit(1)).alias("triples"), *[of(c).alias(n) for n, c in names.items()], F.count_if(F.col("p") == OWL + "sameAs").alias("cross_platform_links")
    )


def processes(triples: DataFrame) -> DataFrame:
    """id, name, start_date, end_date by start date (unknown first)."""
    out = instances(triples, "process").join(values(triples, "name"), "id")
    return out.join(values(triples, "start_date"), "id", "left").join(values(triples, "end_date"), "id", "left").orderBy(F.col("start_date").asc_nulls_first(), "id")


def participants(triples: DataFrame) -> DataFrame:
    """id, name, organization, role by name; a row for each combination of several."""
    named = lambda link, out: links(triples, link).join(values(triples, "name"), F.col("target") == F.col("id")).select(F.col("source").alias("id"), F.col("name").alias(out))
    base = instances(triples, "participant").join(values(triples, "name"), "id")
    return base.join(named("affiliated", "organization"), "id", "left").join(named("has_role", "role"), "id", "left").orderBy("name", "id")


def search(triples: DataFrame, words: str, limit: int | None = 50) -> DataFrame:
    """Named entities and contributions whose name or text holds `words`: id, type, text (200 characters and ... if longer). The term is a bound value."""
    if not words.strip():
        raise ValueError("the search term is empty")
    hit = F.lower("v").contains(words.lower())
    types = triples.where(F.col("p") == TYPE).select(F.col("s").alias("id"), X.local_name(F.col("o")).alias("type"))
    names = values(triples, "name").select("id", F.col("name").alias("v")).where(hit).join(types, "id")
    texts = values(triples, "text").select("id", F.col("text").alias("v")).where(hit).join(instances(triples, "contribution"), "id").select("id", "v", F.lit("Contribution").alias("type"))
    found = names.unionByName(texts).distinct().select("id", "type", X.shorten(F.col("v"), 200).alias("text")).orderBy("id", "type", "text")
    return found.limit(limit) if limit is not None else found


def contributions(triples: DataFrame, limit: int | None = 1000, ordered: bool = True) -> DataFrame:
    """contribution, text, timestamp, participant, process, platform (declared, else told by the process's name), the first `limit` by process and time. ordered: False leaves the order of all open."""
    made = links(triples, "made_by").join(values(triples, "name"), F.col("target") == F.col("id")).select(F.col("source").alias("id"), F.col("name").alias("participant"))
    of = links(triples, "has_contribution").join(values(triples, "name"), F.col("source") == F.col("id")).select(F.col("source").alias("pid"), F.col("target").alias("id"), F.col("name").alias("process"))
    of = of.join(values(triples, "platform").withColumnRenamed("id", "pid"), "pid", "left").drop("pid")
    rows = instances(triples, "contribution").join(values(triples, "text"), "id", "left").join(values(triples, "timestamp"), "id", "left").join(made, "id", "left").join(of, "id", "left").distinct()
    if ordered or limit is not None:
        rows = rows.orderBy(F.col("process").asc_nulls_first(), F.col("timestamp").asc_nulls_first(), "id")
    rows = rows.limit(limit) if limit is not None else rows
    process = F.coalesce("process", F.lit("Unknown Process"))
    return rows.select(
        F.col("id").alias("contribution"), F.coalesce("text", F.lit("")).alias("text"), "timestamp", F.coalesce("participant", F.lit("Unknown")).alias("participant"),
        process.alias("process"), F.coalesce("platform", X.platform_by_name(process)).alias("platform"),
    )


def nested_contributions(rows: DataFrame) -> DataFrame:
    """platform, processes[{process, contributions[]}] of contributions()."""
    one = F.struct("timestamp", "contribution", "text", "participant")
    inner = rows.groupBy("platform", "process").agg(F.sort_array(F.collect_list(one)).alias("contributions"))
    return inner.groupBy("platform").agg(F.sort_array(F.collect_list(F.struct("process", "contributions"))).alias("processes"))


def detail(triples: DataFrame, resource: str, compat: bool = False) -> DataFrame:
    """property (local name), values of one resource; compat keeps one value, the greatest."""
    rows = triples.where(F.col("s") == resource).select(X.local_name(F.col("p")).alias("property"), "o")
    return rows.groupBy("property").agg(F.max("o").alias("value") if compat else F.sort_array(F.collect_list("o")).alias("values"))


def platforms(triples: DataFrame, compat: bool = False) -> DataFrame:
    """id, name, count by falling count: declared platforms of contributions (also through their process, unless compat) and platforms told by
    address; the greater count where both know one."""
    c = instances(triples, "contribution")
    named = values(triples, "platform")
    told = c.join(named, "id")
    if not compat:
        via = links(triples, "has_contribution").join(named.withColumnRenamed("id", "source"), "source").select(F.col("target").alias("id"), "platform")
        told = told.unionByName(c.join(via, "id")).distinct()
    declared = told.groupBy("platform").agg(F.count_distinct("id").alias("n")).groupBy(X.platform_id(F.col("platform")).alias("id")).agg(F.max("platform").alias("platform"), F.max("n").alias("n"))
    by_address = c.groupBy(X.platform_by_address(F.col("id"), compat).alias("id")).agg(F.count(F.lit(1)).alias("m"))
    both = declared.join(by_address, "id", "full")
    label = F.when(F.col("m").isNotNull(), X.platform_label(F.col("id"))).otherwise(F.coalesce(F.create_map(*[F.lit(x) for p in X.PLATFORM_LABELS.items() for x in p])[F.col("id")], F.col("platform")))
    return both.select("id", label.alias("name"), F.greatest(F.coalesce("n", F.lit(0)), F.coalesce("m", F.lit(0))).alias("count")).orderBy(F.desc("count"), "id")


def platform_comparison(member: dict[str, DataFrame], platform: str = "platform") -> DataFrame:
    """A row a platform with the distinct count of each table (platform, id): each is counted on its own, so no product of them arises."""
    counts = [df.groupBy(platform).agg(F.count_distinct("id").alias(name)) for name, df in member.items()]
    out = reduce(lambda a, b: a.join(b, platform, "full"), counts)
    return out.select(platform, *[F.coalesce(n, F.lit(0)).alias(n) for n in member])


def product_counts(left: DataFrame, right: DataFrame, group: str, by: str) -> DataFrame:
    """What non-distinct counts over the product of two optional link tables give, a row a `group`: sum over `by` of left x right, without the product."""
    l = left.groupBy(group, by).agg(F.count(F.lit(1)).alias("l"))
    r = right.groupBy(group, by).agg(F.count(F.lit(1)).alias("r"))
    both = l.join(r, [group, by], "full").select(group, F.coalesce("l", F.lit(0)).alias("l"), F.coalesce("r", F.lit(0)).alias("r"))
    one = F.greatest("l", F.lit(1)) * F.greatest("r", F.lit(1))
    return both.groupBy(group).agg(F.sum(F.when(F.col("l") > 0, one).otherwise(0)).alias("left_count"), F.sum(F.when(F.col("r") > 0, one).otherwise(0)).alias("right_count"))


def network(triples: DataFrame, limit: int | None = 200) -> DataFrame:
    """Edges source, target, source_label, target_label, relation, source_type, target_type: links between named things, their types, and things alone."""
    named = values(triples, "name")
    typed = triples.where((F.col("p") == TYPE) & F.col("o").isin([DEL + c for c in CLASSES.values()])).select(F.col("s").alias("id"), X.local_name(F.col("o")).alias("type"))
    node = named.join(typed, "id").groupBy("id").agg(F.min("name").alias("label"), F.min("type").alias("type"))
    relations = (DEL + "hasParticipant", DEL + "hasTopic", DEL + "hasContribution", DEL + "madeBy", DEL + "isAffiliatedWith", OWL + "sameAs", SKOS + "related")
    edge = triples.where(F.col("p").isin(*relations) & (F.col("o_kind") == "uri")).select(F.col("s").alias("source"), F.col("o").alias("target"), X.local_name(F.col("p")).alias("relation")).distinct()
    end = lambda side: node.select(F.col("id").alias(side), F.col("label").alias(f"{side}_label"), F.col("type").alias(f"{side}_type"))
    linked = edge.join(end("source"), "source").join(end("target"), "target")
    touched = linked.select(F.col("source").alias("id")).unionByName(linked.select(F.col("target").alias("id"))).distinct()
    alone = node.join(touched, "id", "left_anti").select(
        F.col("id").alias("source"), F.col("id").alias("target"), F.col("label").alias("source_label"), F.col("label").alias("target_label"), F.lit("standalone").alias("relation"), F.col("type").alias("source_type"), F.col("type").alias("target_type")
    )
    out = linked.select(*alone.columns).unionByName(alone).orderBy("source", "target", "relation")
    return out.limit(limit) if limit is not None else out


def network_nodes(edges: DataFrame) -> DataFrame:
    """id, label, type, a row a node."""
    ends = edges.select(F.inline(F.array(*[F.struct(F.col(s).alias("id"), F.col(f"{s}_label").alias("label"), F.col(f"{s}_type").alias("type")) for s in ("source", "target")])))
    return ends.groupBy("id").agg(F.min(F.struct("label", "type")).alias("x")).select("id", "x.label", "x.type")


def network_edges(edges: DataFrame) -> DataFrame:
    return edges.where("relation <> 'standalone' AND source <> target").select("source", "target", "relation")


# Fallacies: contributions (id, process, participant, text), fallacies (contribution, type, segment, confidence).
def fallacy_stats(contribution: DataFrame, fallacies: DataFrame) -> DataFrame:
    """One row: total, with_fallacies, percentage. Whether a contribution has fallacies follows from the fallacies alone."""
    marked = contribution.join(fallacies.select(F.col("contribution").alias("id")).distinct().withColumn("hit", F.lit(1)), "id", "left")
    return share(marked.agg(F.count(F.lit(1)).alias("total"), F.count("hit").alias("with_fallacies")))


def share(counts: DataFrame) -> DataFrame:
    return counts.withColumn("percentage", F.when(F.col("total") > 0, F.col("with_fallacies") / F.col("total") * 100).otherwise(0.0))


def fallacies_by_type(fallacies: DataFrame) -> DataFrame:
    return fallacies.groupBy("type").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "type")


def most_fallacious(contribution: DataFrame, fallacies: DataFrame, most: int = 10) -> DataFrame:
    rows = fallacies.join(contribution.select(F.col("id").alias("contribution"), "participant"), "contribution")
    return rows.groupBy("participant").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "participant").limit(most)


def fallacy_report(contribution: DataFrame, fallacies: DataFrame) -> DataFrame:
    """process, statistics and fallacies_by_contribution, nested."""
    one = fallacies.groupBy(F.col("contribution").alias("id")).agg(F.sort_array(F.collect_list(F.struct("type", "segment", "confidence"))).alias("fallacies"))
    listed = contribution.join(one, "id").groupBy("process").agg(F.sort_array(F.collect_list(F.struct("id", "participant", "text", "fallacies"))).alias("fallacies_by_contribution"))
    counts = share(contribution.join(one.select("id", F.lit(1).alias("hit")), "id", "left").groupBy("process").agg(F.count(F.lit(1)).alias("total"), F.count("hit").alias("with_fallacies")))
    kinds = fallacies.join(contribution.select(F.col("id").alias("contribution"), "process"), "contribution").groupBy("process", "type").agg(F.count(F.lit(1)).alias("count"))
    kinds = kinds.groupBy("process").agg(F.sort_array(F.collect_list(F.struct(F.col("count"), F.col("type"))), asc=False).alias("fallacy_types"))
    return counts.join(kinds, "process", "left").join(listed, "process", "left")


#: What a usable graph has at least.
EXPECTED = {"processes": 1, "participants": 10, "contributions": 10, "cross_platform_links": 1, "topic_relations": 0, "cross_platform_participants": 0, "linked_contributions": 0}


def validate(triples: DataFrame, expected: dict[str, int] = EXPECTED) -> DataFrame:
    """check, found, expected_min, passed."""
    same, made = links(triples, "same_as"), links(triples, "made_by")
    topic = instances(triples, "topic")
    relations = triples.where(F.col("p").isin(SKOS + "related", SKOS + "broader", SKOS + "narrower")).select(F.col("s").alias("a"), F.col("o").alias("b"))
    both = relations.join(topic.withColumnRenamed("id", "a"), "a").join(topic.withColumnRenamed("id", "b"), "b")
    platform = values(triples, "platform")
    across = same.join(platform.select(F.col("id").alias("source"), F.col("platform").alias("x")), "source").join(platform.select(F.col("id").alias("target"), F.col("platform").alias("y")), "target").where("x <> y")
    linked = made.join(same.select(F.col("source").alias("target")).unionByName(same.select("target")).distinct(), "target", "left_semi")
    counted = {
        "processes": instances(triples, "process"), "participants": instances(triples, "participant"), "contributions": instances(triples, "contribution"), "cross_platform_links": same,
        "topic_relations": both, "cross_platform_participants": across, "linked_contributions": linked,
    }
    rows = [df.agg(F.count(F.lit(1)).alias("found")).select(F.lit(k).alias("check"), "found", F.lit(expected[k]).alias("expected_min")) for k, df in counted.items()]
    return reduce(lambda a, b: a.unionByName(b), rows).withColumn("passed", F.col("found") >= F.col("expected_min"))


def most_answered(replies: DataFrame) -> DataFrame:
    """contribution, n of (source, target) replies, by falling n."""
    return replies.groupBy(F.col("target").alias("contribution")).agg(F.count_distinct("source").alias("n")).orderBy(F.desc("n"), "contribution")


def first_wins(rows: DataFrame, keys: list[str], order: list[Column | str]) -> DataFrame:
    """The first row of each key."""
    name = "__place"
    return rows.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col(name) == 1).drop(name)


def group_samples(rows: DataFrame, group: str, order: list[str], sample: Column, most: int = 3) -> DataFrame:
    """group, n, samples: how many rows a group has and `sample` of its first `most` (by `order`, ties by the sample), each of at most that many rows
    a task: both halves are cut down before they are shuffled."""
    counts = rows.groupBy(group).agg(F.count(F.lit(1)).alias("n"))
    first = Window.partitionBy(group).orderBy(*order, "__sample")
    top = rows.select(group, *order, sample.alias("__sample")).withColumn("__place", F.row_number().over(first)).where(F.col("__place") <= most)
    kept = top.groupBy(F.col(group).alias("__group")).agg(F.sort_array(F.collect_list(F.struct("__place", "__sample"))).alias("__kept"))
    return counts.join(kept, F.col(group).eqNullSafe(F.col("__group"))).select(group, "n", F.col("__kept.__sample").alias("samples"))


def surrogate_ids(rows: DataFrame, group: str, key: str, position: str) -> DataFrame:
    """group, key, n: keys of a group numbered by first appearance."""
    first = rows.groupBy(group, key).agg(F.min(position).alias("first"))
    return first.select(group, key, F.row_number().over(Window.partitionBy(group).orderBy("first", key)).alias("n"))


def upsert(table: DataFrame, changes: DataFrame, keys: list[str]) -> DataFrame:
    """table with the rows of `changes` in place of those with the same keys."""
    return table.join(changes.select(*keys), keys, "left_anti").unionByName(changes)
