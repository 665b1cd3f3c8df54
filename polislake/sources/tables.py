"""The deliberation graph as a view of relational tables: platform = region, process = nation, participant = customer, organisation = market segment,
contribution = order, topic = brand. Each predicate is a branch of its own with a constant p, so a pattern with a constant predicate reads its branch only."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.terms import DEL, RES, TYPE, XSD
from .store import measured_joins

STAMP = "yyyy-MM-dd'T'HH:mm:ss"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    measured_joins(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def res(tag: str, key: Column | str) -> Column:
    return F.concat(F.lit(f"{RES}{tag}_"), (F.col(key) if isinstance(key, str) else key).cast("string"))


def branch(df: DataFrame, s: Column, p: str, o: Column, kind: str = "literal", dt: str | None = None) -> DataFrame:
    none = F.lit(None).cast("string")
    return df.select(
        s.alias("s"), F.lit("uri").alias("s_kind"), F.lit(p).alias("p"), o.cast("string").alias("o"), F.lit(kind).alias("o_kind"), (F.lit(dt) if dt else none).alias("o_dt"), none.alias("o_lang"), F.lit("tables").alias("src")
    )


def table_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = lambda n: table(spark, sf_dir, n)
    nation = t("nation").join(F.broadcast(t("region")), F.col("n_regionkey") == F.col("r_regionkey"))  # 25 and 5 rows by definition
    customer, orders = t("customer"), t("orders")
    cls = lambda n: F.lit(DEL + n)
    process, person, order = res("process", "n_nationkey"), res("participant", "c_custkey"), res("contribution", "o_orderkey")
    placed = orders.select("o_orderkey", "o_custkey").join(customer.select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
    brand = t("part").select("p_partkey", "p_brand")
    brands = brand.select("p_brand").distinct()
    topic = res("topic", F.replace("p_brand", F.lit("#"), F.lit("-")))
    discussed = (
        t("lineitem").select("l_orderkey", "l_partkey").join(brand, F.col("l_partkey") == F.col("p_partkey")).join(placed.select("o_orderkey", "c_nationkey"), F.col("l_orderkey") == F.col("o_orderkey"))
        .select("c_nationkey", "p_brand").distinct()
    )
    segments = customer.select("c_mktsegment").distinct()
    parts = [
        branch(nation, process, TYPE, cls("DeliberationProcess"), "uri"), branch(nation, process, DEL + "name", F.col("n_name")), branch(nation, process, DEL + "platform", F.col("r_name")),
        branch(customer, person, TYPE, cls("Participant"), "uri"), branch(customer, person, DEL + "name", F.col("c_name")),
        branch(customer, person, DEL + "isAffiliatedWith", res("org", "c_mktsegment"), "uri"), branch(customer, res("process", "c_nationkey"), DEL + "hasParticipant", person, "uri"),
        branch(segments, res("org", "c_mktsegment"), TYPE, cls("Organization"), "uri"), branch(segments, res("org", "c_mktsegment"), DEL + "name", F.col("c_mktsegment")),
        branch(orders, order, TYPE, cls("Contribution"), "uri"), branch(orders, order, DEL + "timestamp", F.date_format("o_orderdate", STAMP), dt=XSD + "dateTime"), branch(orders, order, DEL + "text", F.col("o_orderpriority")),
        branch(orders, order, DEL + "madeBy", res("participant", "o_custkey"), "uri"), branch(placed, res("process", "c_nationkey"), DEL + "hasContribution", order, "uri"),
        branch(brands, topic, TYPE, cls("Topic"), "uri"), branch(brands, topic, DEL + "name", F.col("p_brand")), branch(discussed, res("process", "c_nationkey"), DEL + "hasTopic", topic, "uri"),
    ]
    return reduce(lambda a, b: a.unionByName(b), parts)


def conversation_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations: a turn answers the one before it."""
    c = table(spark, sf_dir, "conversations").where("conv_id IS NOT NULL AND turn IS NOT NULL").dropDuplicates(["conv_id", "turn"])
    me = F.concat(res("conversation", "conv_id"), F.lit("_"), F.col("turn"))
    before = c.select("conv_id", (F.col("turn") + 1).alias("turn"))
    answers = c.join(before, ["conv_id", "turn"])
    return branch(c, me, TYPE, F.lit(DEL + "Contribution"), "uri").unionByName(branch(answers, me, DEL + "responseTo", F.concat(res("conversation", "conv_id"), F.lit("_"), F.col("turn") - 1), "uri"))
