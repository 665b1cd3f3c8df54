"""Links between entities: resolution across platforms, topic relations, temporal chains, arguments, tags."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..sources.store import dealt, measured_joins, written

#: Bytes of text whose words a task counts.
TEXT_BYTES = 8 << 20

SAME, RELATED = 0.8, 0.6


def name_similarity(a: Column, b: Column) -> Column:
    """1 for equal normalised names, 0.8 where one contains the other, else the words' Jaccard index if it is over 0.5 and both have two words."""
    wa, wb = F.array_distinct(F.split(a, " ")), F.array_distinct(F.split(b, " "))
    j = X.jaccard(wa, wb)
    several = (F.size(F.split(a, " ")) > 1) & (F.size(F.split(b, " ")) > 1)
    return F.when(a == b, 1.0).when(a.contains(b) | b.contains(a), 0.8).when(several & (j > 0.5), j).otherwise(0.0)


def contained_names(names: DataFrame, gram: int = 3) -> DataFrame:
    """(x, y), x contained in y and another name: y has the rarest of x's character runs of one length, at least half of x's own up to eight grams; x itself where it is shorter than a gram. names: n, distinct.

    Runs of a length are taken only of names longer than the shortest that is looked up by them: names of one length, however many and however alike, have none to compare."""
    sizes = [*range(1, gram), *(gram << k for k in range(4))]  # of runs
    size = reduce(lambda rest, k: F.when(F.length("n") >= k, F.lit(k)).otherwise(rest), sizes, F.lit(0))
    of = lambda k: F.array_distinct(F.transform(F.sequence(F.lit(1), F.length("n") - k + 1), lambda i: F.substring(F.col("n"), i, k)))
    sized = names.where("n <> ''").withColumn("k", size)
    least = sized.groupBy("k").agg(F.min(F.length("n")).alias("least"))  # a row a length of runs
    keyed = sized.select("n").join(F.broadcast(least), F.length("n") > F.col("least")).select("n", F.explode(of(F.col("k"))).alias("g"))
    common = keyed.groupBy("g").agg(F.count(F.lit(1)).alias("df"))
    own = sized.select("n", F.explode(of(F.col("k"))).alias("g"))
    rarest = own.join(common, "g", "left").groupBy("n").agg(F.min_by("g", F.struct(F.coalesce("df", F.lit(0)), "g")).alias("g"))
    return rarest.select(F.col("n").alias("x"), "g").join(keyed.select(F.col("n").alias("y"), "g"), "g").where("length(y) > length(x) AND contains(y, x)").select("x", "y")


def similar_words(names: DataFrame) -> DataFrame:
    """(x, y), x < y, of names of several words: all pairs whose words' Jaccard index is over 0.5, and few others. names: n, distinct.

    Of k words such a pair shares over k / 2, so one of the rarest k - k div 2 of each name, in one order of all words; a word that most names have is not looked up."""
    words = names.where(F.col("n").contains(" ")).select("n", F.explode(F.array_distinct(F.split("n", " "))).alias("w"))
    common = words.groupBy("w").agg(F.count(F.lit(1)).alias("df"))
    ranked = words.join(common, "w").groupBy("n").agg(F.array_sort(F.collect_list(F.struct("df", "w"))).alias("r"))
    rare = ranked.select("n", F.explode(F.expr("slice(r, 1, size(r) - size(r) div 2)")).alias("r")).select("n", F.col("r.w").alias("w"))
    return rare.select(F.col("n").alias("x"), "w").join(rare.select(F.col("n").alias("y"), "w"), "w").where("x < y").select("x", "y").distinct()


def resolve_participants(participants: DataFrame, cap: int | None = None, compat: bool = False, gram: int = 3) -> DataFrame:
    """Pairs (a, b, platform_a, platform_b, similarity, relation) of participants of different platforms.

    participants: id, name, platform. Candidates share one of the rarest words (see similar_words), or, so that containment inside a word is found too, the
    rarest of the character `gram`s of the shorter name. cap keeps so many a platform, by id."""
    measured_joins(participants.sparkSession)
    p = participants.select("id", "platform", X.normalize_name(F.col("name"), compat).alias("n")).where("id IS NOT NULL AND platform IS NOT NULL AND n IS NOT NULL")
    if not compat:
        p = p.where("n <> ''")
    p = p.dropDuplicates(["id", "platform", "n"])
    if cap is not None:
        p = p.withColumn("k", F.row_number().over(Window.partitionBy("platform").orderBy("id"))).where(F.col("k") <= cap).drop("k")
    # Names are cleaned once, and compared once, whoever bears them.
    p, _ = written(p, "people")
    distinct, _ = written(p.select("n").distinct(), "names")
    inside = contained_names(distinct.where("n <> ''"), gram)
    if compat:  # an empty name is contained in every name
        inside = inside.unionByName(distinct.where("n = ''").select(F.col("n").alias("x")).crossJoin(distinct.where("n <> ''").select(F.col("n").alias("y"))))
    shared = similar_words(distinct)
    pairs = inside.unionByName(shared).select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).unionByName(distinct.select(F.col("n").alias("x"), F.col("n").alias("y"))).distinct()
    scored = pairs.withColumn("similarity", name_similarity(F.col("x"), F.col("y"))).where(F.col("similarity") >= RELATED)
    both = scored.unionByName(scored.where("x <> y").select(F.col("y").alias("x"), F.col("x").alias("y"), "similarity"))
    left = p.select(F.col("id").alias("a"), F.col("platform").alias("platform_a"), F.col("n").alias("x"))
    right = p.select(F.col("id").alias("b"), F.col("platform").alias("platform_b"), F.col("n").alias("y"))
    found = left.join(both, "x").join(right, "y").where("platform_a < platform_b")
    return found.select("a", "b", "platform_a", "platform_b", "similarity", F.when(F.col("similarity") >= SAME, "sameAs").otherwise("related").alias("relation"))


def relate_topics(topics: DataFrame, broader: float = 0.7, related: float = 0.4) -> DataFrame:
    """(a, b, jaccard, relation): `broader` from the longer name to the shorter and `narrower` back, or `related` both ways.

    topics: id, name. Only names longer than five characters. Names that must share two tokens or more are joined on the first two they share, in one order of all
    tokens by frequency: of n tokens, both are among the rarest n - max(related * n, 2) + 2. A frequent pair of tokens is a key of few names, so candidates stay near the
    result. Names so short that one shared token is enough are joined on it. Exact for thresholds over 0. Equal lengths: the second (by id) is the one with the longer name."""
    t = topics.select("id", "name", X.topic_tokens(F.col("name")).alias("tokens")).where((F.length("name") > 5) & (F.size("tokens") > 0)).dropDuplicates(["id", "name"])
    words = t.select("id", "name", F.explode("tokens").alias("w"))
    common = words.groupBy("w").agg(F.count(F.lit(1)).alias("df"))
    ranked = words.join(common, "w").groupBy("id", "name").agg(F.array_sort(F.collect_list(F.struct("df", "w"))).alias("r"))
    sets = ranked.select("id", F.length("name").alias("len"), F.size("r").alias("n"), F.transform("r", lambda x: x["w"]).alias("tokens"))
    least = F.ceil((F.col("n") + F.col("n2")) * related / (1 + related) - 1e-9)  # tokens that a pair of these sizes shares at least

    def pairs(index: DataFrame, k: int) -> DataFrame:
        other = index.select("key", *[F.col(c).alias(f"{c}2") for c in ("id", "len", "n", "tokens")])
        near = (F.col("id") < F.col("id2")) & ((least > 1) if k == 2 else (least <= 1))
        met = index.join(other, "key").where(near).withColumn("both", F.array_intersect("tokens", "tokens2"))
        return met.where(F.slice("both", 1, k) == F.col("key")).withColumn("c", F.size("both"))

    prefix = F.expr(f"slice(tokens, 1, n - CAST(greatest(ceil(n * {related} - 1e-9), 2) AS INT) + 2)")
    twos = F.expr("flatten(transform(prefix, (x, i) -> transform(slice(prefix, i + 2, size(prefix)), y -> array(x, y))))")
    hits = pairs(sets.where("n > 1").withColumn("prefix", prefix).withColumn("key", F.explode(twos)).drop("prefix"), 2)
    if 2 * related <= 1 + related:  # two names of one token each need one
        short = sets.where(F.col("n") + 1 <= (1 + related) / related + 1e-9)
        hits = hits.unionByName(pairs(short.withColumn("key", F.explode(F.transform("tokens", lambda x: F.array(x)))), 1))
    scored = hits.withColumn("jaccard", F.col("c") / (F.col("n") + F.col("n2") - F.col("c"))).where(F.col("jaccard") >= related)
    first_longer = F.col("len") > F.col("len2")
    up = F.struct(F.when(first_longer, F.col("id")).otherwise(F.col("id2")).alias("a"), F.when(first_longer, F.col("id2")).otherwise(F.col("id")).alias("b"))
    row = lambda a, b, r: F.struct(a.alias("a"), b.alias("b"), F.lit(r).alias("relation"))
    strong = F.array(row(up["a"], up["b"], "broader"), row(up["b"], up["a"], "narrower"))
    weak = F.array(row(F.col("id"), F.col("id2"), "related"), row(F.col("id2"), F.col("id"), "related"))
    return scored.select("jaccard", F.inline(F.when(F.col("jaccard") >= broader, strong).otherwise(weak))).select("a", "b", "jaccard", "relation")


def temporal_chain(contributions: DataFrame, compat: bool = False) -> DataFrame:
    """(process, source, target): each contribution follows the one before it in its process.

    contributions: process, contribution, timestamp. compat gives what a list with a row for each later contribution gives: self-loops, and nothing for the last."""
    order = Window.partitionBy("process").orderBy("timestamp", "contribution")
    c = contributions.where("timestamp IS NOT NULL")
    if compat:
        by = Window.partitionBy("process").orderBy("timestamp")
        later = F.count(F.lit(1)).over(Window.partitionBy("process").orderBy(F.desc("timestamp")).rangeBetween(Window.unboundedPreceding, -1))
        c = c.withColumn("later", later).where("later > 0")
        chain = c.withColumn("before", F.lag("contribution").over(order))
        loops = chain.where("later > 1").select("process", F.col("contribution").alias("source"), F.col("contribution").alias("target"))
        return chain.where("before IS NOT NULL").select("process", F.col("contribution").alias("source"), F.col("before").alias("target")).unionByName(loops)
    return c.withColumn("target", F.lag("contribution").over(order)).where("target IS NOT NULL").select("process", F.col("contribution").alias("source"), "target")


def temporal_pairs(contributions: DataFrame) -> DataFrame:
    """All ordered pairs of a process in time order (grows with the square of a process; temporal_chain is the linear form)."""
    a = contributions.select("process", F.col("contribution").alias("first"), F.col("timestamp").alias("t1"))
    b = contributions.select("process", F.col("contribution").alias("second"), F.col("timestamp").alias("t2"))
    return a.join(b, "process").where("t1 < t2").select("process", "first", "second")


def mine_arguments(contributions: DataFrame, markers: tuple[str, ...] = X.ARGUMENT_MARKERS, split: str = "because", width: int = 100) -> DataFrame:
    """(id, argument, premise, conclusion) of contributions (id, text) that hold a marker; the premise follows `split`, the conclusion comes before it."""
    low = F.lower("text")
    hit = F.lit(False)
    for m in markers:
        hit = hit | low.contains(m)
    has = low.contains(split)
    premise = F.substring(X.str_after(low, split), 1, width)
    conclusion = F.substring(X.str_before(low, split), 1, width)
    return contributions.where(hit).select("id", F.concat(F.lit("argument_"), X.stable_id(F.col("id"), low)).alias("argument"), F.when(has, premise).alias("premise"), F.when(has, conclusion).alias("conclusion"))


def frequent_keywords(texts: DataFrame, most: int = 5, text: Column | None = None) -> DataFrame:
    """(id, keyword, n, rank): words of four letters or more that occur twice, the most frequent first, ties by first appearance. Texts are dealt out by id once, about TEXT_BYTES
    a task; their words are counted and ranked where they are. text: what is made of a text first, there."""
    words = dealt(texts, "id", size="octet_length(text)", each=TEXT_BYTES).select("id", F.posexplode(X.keywords(F.col("text") if text is None else text)).alias("pos", "keyword")).groupBy("id", "keyword").agg(F.count(F.lit(1)).alias("n"), F.min("pos").alias("first"))
    rank = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("n"), "first"))
    return words.where("n > 1").select("id", "keyword", "n", rank.alias("rank")).where(F.col("rank") <= most)


def tag_topics(texts: DataFrame, most: int = 3, topics: dict = X.TOPIC_KEYWORDS) -> DataFrame:
    low = texts.select("id", F.lower("text").alias("low"))  # once, for all keywords
    return low.select("id", F.explode(X.lowered_tags(F.col("low"), most, topics)).alias("topic"))


def keyword_topic_links(left: DataFrame, right: DataFrame, rules=(("climate", "environment"), ("democracy", "participation"), ("citizen", "citizen")), most: int = 3) -> DataFrame:
    """(a, b) of topics (id, name) whose names hold the two words of a rule; at most `most`, by id."""
    rule = lambda df, i, c: df.select(F.col("id").alias(c), F.explode(F.filter(F.array(*[F.when(F.lower("name").contains(r[i]), F.lit(k)) for k, r in enumerate(rules)]), lambda x: x.isNotNull())).alias("rule"))
    return rule(left, 0, "a").join(rule(right, 1, "b"), "rule").select("a", "b").distinct().orderBy("a", "b").limit(most)


def first_counterpart(people: DataFrame, others: DataFrame, marks: tuple[str, ...] = ("Citizen", "MEP")) -> DataFrame:
    """(a, b): each person (id, name) with a mark in the name, related to the first other by id."""
    hit = F.lit(False)
    for m in marks:
        hit = hit | F.col("name").contains(m)
    first = others.agg(F.min("id").alias("b")).where("b IS NOT NULL")
    return people.where(hit).select(F.col("id").alias("a")).join(F.broadcast(first), F.lit(True))


def similar_topics(topics: DataFrame) -> DataFrame:
    """(a, b, process_a, process_b) of topics (id, name, process) of different processes whose names contain one another; by the rarest characters of the shorter name."""
    t = topics.select("id", "process", F.lower("name").alias("n")).where("n <> ''")
    names = t.select("n").distinct()
    pairs = contained_names(names).unionByName(names.select(F.col("n").alias("x"), F.col("n").alias("y")))
    pairs = pairs.unionByName(pairs.select(F.col("y").alias("x"), F.col("x").alias("y"))).distinct()
    a = t.select(F.col("id").alias("a"), F.col("process").alias("process_a"), F.col("n").alias("x"))
    b = t.select(F.col("id").alias("b"), F.col("process").alias("process_b"), F.col("n").alias("y"))
    return a.join(pairs, "x").join(b, "y").where("process_a <> process_b").select("a", "b", "process_a", "process_b")
