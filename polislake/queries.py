"""Queries of the driver tables and their SQL. SPARQL ones are given as text and run through the parser and the compiler."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import terms as T
from .functions import text as X
from .operators import analytics as A
from .operators import link as L
from .operators import model as M
from .operators import nested, search_index
from .operators.sinks import load_version, save_version, write_csv, write_documents, write_summary
from .operators.versions import Versions
from .plans.results import bindings, sparql, values
from .sources.adapters import consultation_documents, consultations, court_csv, debates, decidim_spaces, delidata, delidata_tsv, madrid, madrid_csv
from .sources.places import with_places
from .sources.rdf import read_rdf, write_rdf
from .sources.store import dealt, shared_dir
from .sources.tables import STAMP, branch, conversation_graph, res, table, table_graph
from .sources.turtle import read_turtle
from .streaming import ingest as I

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}
RES = T.RES


def query(sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql.replace("{R}", RES).replace("{D}", T.DEL)
        return f

    return add


def sparql_query(name: str, text: str, sql: str, graph=table_graph, bound: dict[str, str] | None = None) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return values(sparql(graph(spark, sf_dir), text, bound))

    run.__name__ = name
    query(sql)(run)


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return table(spark, sf_dir, name)


def _members(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """Participants, contributions and topics by platform."""
    place = _t(spark, sf_dir, "nation").join(F.broadcast(_t(spark, sf_dir, "region")), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", F.col("r_name").alias("platform"))
    people = _t(spark, sf_dir, "customer").select("c_custkey", "c_nationkey").join(F.broadcast(place), F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "platform", "c_nationkey")
    orders = _t(spark, sf_dir, "orders").select("o_orderkey", "o_custkey").join(people, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "platform", "c_nationkey")
    # Part keys by platform first: fewer rows than lineitems reach the brands.
    items = _t(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey").join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select("platform", "l_partkey").distinct()
    topics = items.join(_t(spark, sf_dir, "part").select("p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey")).select("platform", F.col("p_brand").alias("id"))
    return {"participants": people.select("platform", F.col("c_custkey").alias("id")), "contributions": orders.select("platform", F.col("o_orderkey").alias("id")), "topics": topics}


@query("""
SELECT r_name AS platform, count(DISTINCT c_custkey) AS participants, count(DISTINCT o_orderkey) AS contributions, count(DISTINCT p_brand) AS topics
FROM region JOIN nation ON n_regionkey = r_regionkey JOIN customer ON c_nationkey = n_nationkey LEFT JOIN orders ON o_custkey = c_custkey
LEFT JOIN lineitem ON l_orderkey = o_orderkey LEFT JOIN part ON p_partkey = l_partkey GROUP BY r_name
""")
def platform_comparison(spark, sf_dir):
    return A.platform_comparison(_members(spark, sf_dir))


@query("""
WITH m AS (SELECT c_nationkey, count(*) AS l FROM customer GROUP BY 1), c AS (SELECT c_nationkey, count(*) AS r FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1)
SELECT r_name AS platform, CAST(sum(coalesce(l, 0) * greatest(coalesce(r, 0), 1)) AS BIGINT) AS left_count, CAST(sum(coalesce(r, 0) * greatest(coalesce(l, 0), 1)) AS BIGINT) AS right_count
FROM (SELECT * FROM m FULL JOIN c USING (c_nationkey)) JOIN nation ON n_nationkey = c_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY r_name
""")
def platform_comparison_product(spark, sf_dir):
    place = _t(spark, sf_dir, "nation").join(F.broadcast(_t(spark, sf_dir, "region")), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_nationkey").alias("process"), F.col("r_name").alias("platform"))
    c = _t(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").alias("process"))
    people = c.join(F.broadcast(place), "process").select("platform", "process")
    orders = _t(spark, sf_dir, "orders").join(c, F.col("o_custkey") == F.col("c_custkey")).join(F.broadcast(place), "process").select("platform", "process")
    return A.product_counts(people, orders, "platform", "process")


STATS = "(SELECT count(DISTINCT {k}) FROM {t})"
sparql_query(
    "graph_stats",
    """SELECT (COUNT(DISTINCT ?a) AS ?processes) (COUNT(DISTINCT ?b) AS ?participants) (COUNT(DISTINCT ?c) AS ?contributions) (COUNT(DISTINCT ?d) AS ?topics) (COUNT(DISTINCT ?e) AS ?organizations)
    WHERE { OPTIONAL { ?a a del:DeliberationProcess } OPTIONAL { ?b a del:Participant } OPTIONAL { ?c a del:Contribution } OPTIONAL { ?d a del:Topic } OPTIONAL { ?e a del:Organization } }""",
    """SELECT CAST((SELECT count(DISTINCT n_nationkey) FROM nation) AS VARCHAR) AS processes, CAST((SELECT count(DISTINCT c_custkey) FROM customer) AS VARCHAR) AS participants,
    CAST((SELECT count(DISTINCT o_orderkey) FROM orders) AS VARCHAR) AS contributions, CAST((SELECT count(DISTINCT p_brand) FROM part) AS VARCHAR) AS topics, CAST((SELECT count(DISTINCT c_mktsegment) FROM customer) AS VARCHAR) AS organizations""",
)
sparql_query(
    "list_processes",
    "SELECT ?process ?name ?start WHERE { ?process a del:DeliberationProcess ; del:name ?name . OPTIONAL { ?process del:startDate ?start } } ORDER BY ?start ?name",
    "SELECT '{R}process_' || n_nationkey AS process, n_name AS name, CAST(NULL AS VARCHAR) AS start FROM nation",
)
sparql_query(
    "participants_with_organizations",
    "SELECT ?name ?org ?role WHERE { ?p a del:Participant ; del:name ?name . OPTIONAL { ?p del:isAffiliatedWith ?o . ?o del:name ?org } OPTIONAL { ?p del:hasRole ?r . ?r del:name ?role } } ORDER BY ?name",
    "SELECT c_name AS name, c_mktsegment AS org, CAST(NULL AS VARCHAR) AS role FROM customer",
)
sparql_query(
    "contributions_of_participant",
    """SELECT ?c ?at WHERE { ?p a del:Participant ; del:name "Customer#000000007" . ?c del:madeBy ?p . OPTIONAL { ?c del:timestamp ?at } } ORDER BY ?at""",
    "SELECT '{R}contribution_' || o_orderkey AS c, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') AS at FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_name = 'Customer#000000007'",
)
sparql_query(
    "contributions_by_regex",
    """SELECT ?name ?c WHERE { ?p ^del:madeBy ?c ; del:name ?name . FILTER(REGEX(?name, "customer#0+1[0-9]$", "i")) } ORDER BY ?name ?c""",
    "SELECT c_name AS name, '{R}contribution_' || o_orderkey AS c FROM orders JOIN customer ON o_custkey = c_custkey WHERE regexp_matches(c_name, 'customer#0+1[0-9]$', 'i')",
)
sparql_query(
    "topics_by_process",
    "SELECT ?process ?topic WHERE { ?p a del:DeliberationProcess ; del:name ?process ; del:hasTopic ?t . ?t del:name ?topic } ORDER BY ?process ?topic",
    "SELECT DISTINCT n_name AS process, p_brand AS topic FROM nation JOIN customer ON c_nationkey = n_nationkey JOIN orders ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey",
)
sparql_query(
    "topic_keyword_contributions",
    """SELECT DISTINCT ?c ?text WHERE { ?p del:hasContribution ?c ; del:name ?n . ?c del:text ?text FILTER(CONTAINS(LCASE(?text), "urgent") || (REGEX(?n, "^can", "i") && CONTAINS(?text, "LOW"))) }""",
    "SELECT DISTINCT '{R}contribution_' || o_orderkey AS c, o_orderpriority AS text FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON n_nationkey = c_nationkey WHERE contains(lower(o_orderpriority), 'urgent') OR (regexp_matches(n_name, '^can', 'i') AND contains(o_orderpriority, 'LOW'))",
)
sparql_query(
    "processes_by_participants",
    "SELECT ?name (COUNT(DISTINCT ?p) AS ?n) WHERE { ?d a del:DeliberationProcess ; del:name ?name ; del:hasParticipant ?p } GROUP BY ?name HAVING (?n > 1) ORDER BY DESC(?n) ?name",
    "SELECT n_name AS name, CAST(count(DISTINCT c_custkey) AS VARCHAR) AS n FROM nation JOIN customer ON c_nationkey = n_nationkey GROUP BY 1 HAVING count(DISTINCT c_custkey) > 1",
)
sparql_query(
    "silent_participants",
    "SELECT ?name WHERE { ?p a del:Participant ; del:name ?name FILTER NOT EXISTS { ?c del:madeBy ?p } }",
    "SELECT c_name AS name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)",
)
sparql_query(
    "minus_urgent",
    """SELECT ?c WHERE { ?c a del:Contribution MINUS { ?c del:text ?t FILTER(CONTAINS(?t, "URGENT")) } }""",
    "SELECT '{R}contribution_' || o_orderkey AS c FROM orders WHERE NOT contains(coalesce(o_orderpriority, ''), 'URGENT')",
)
sparql_query(
    "values_and_union",
    """SELECT ?kind ?name WHERE { VALUES ?kind { "process" "org" } { ?x a del:DeliberationProcess ; del:name ?name BIND("process" AS ?kind) } UNION { ?x a del:Organization ; del:name ?name BIND("org" AS ?kind) } } ORDER BY ?kind ?name""",
    "SELECT 'process' AS kind, n_name AS name FROM nation UNION ALL SELECT DISTINCT 'org', c_mktsegment FROM customer",
)
sparql_query(
    "top_participants",
    "SELECT ?name ?n WHERE { { SELECT ?p (COUNT(?c) AS ?n) WHERE { ?c del:madeBy ?p } GROUP BY ?p } ?p del:name ?name } ORDER BY DESC(?n) ?name LIMIT 20",
    "SELECT c_name AS name, CAST(count(*) AS VARCHAR) AS n FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY c_custkey, c_name ORDER BY count(*) DESC, c_name LIMIT 20",
)
sparql_query(
    "contributions_before",
    """SELECT ?c ?year WHERE { ?c del:timestamp ?t FILTER(?t < "1995-03-01T00:00:00"^^xsd:dateTime) BIND(YEAR(?t) AS ?year) }""",
    "SELECT '{R}contribution_' || o_orderkey AS c, CAST(year(o_orderdate) AS VARCHAR) AS year FROM orders WHERE o_orderdate < TIMESTAMP '1995-03-01 00:00:00'",
)
sparql_query(
    "names_longer_than_six",
    "SELECT ?name (STRLEN(?name) AS ?n) (UCASE(SUBSTR(?name, 1, 3)) AS ?head) WHERE { ?p a del:DeliberationProcess ; del:name ?name FILTER(STRLEN(?name) > 6) }",
    "SELECT n_name AS name, CAST(length(n_name) AS VARCHAR) AS n, upper(substr(n_name, 1, 3)) AS head FROM nation WHERE length(n_name) > 6",
)
sparql_query(
    "process_of_participant_path",
    """SELECT ?process (COUNT(?c) AS ?n) WHERE { ?process del:hasContribution/del:madeBy/del:isAffiliatedWith ?o . ?o del:name "BUILDING" . BIND(1 AS ?c) } GROUP BY ?process""",
    "SELECT '{R}process_' || c_nationkey AS process, CAST(count(*) AS VARCHAR) AS n FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_mktsegment = 'BUILDING' GROUP BY c_nationkey",
)
sparql_query(
    "thread_structure",
    "SELECT ?later ?first WHERE { ?later del:responseTo+ ?first }",
    """WITH RECURSIVE s AS (SELECT DISTINCT conv_id, turn FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL),
    r AS (SELECT a.conv_id, a.turn AS later, b.turn AS first FROM s a JOIN s b ON a.conv_id = b.conv_id AND b.turn = a.turn - 1
      UNION SELECT r.conv_id, r.later, s.turn FROM r JOIN s ON s.conv_id = r.conv_id AND s.turn = r.first - 1)
    SELECT '{R}conversation_' || conv_id || '_' || later AS later, '{R}conversation_' || conv_id || '_' || first AS first FROM r""",
    conversation_graph,
)
sparql_query(
    "class_counts",
    "SELECT ?class (COUNT(?x) AS ?n) WHERE { ?x a ?class } GROUP BY ?class ORDER BY ?class",
    "SELECT '{D}DeliberationProcess' AS class, CAST(count(*) AS VARCHAR) AS n FROM nation UNION ALL SELECT '{D}Participant', CAST(count(*) AS VARCHAR) FROM customer UNION ALL SELECT '{D}Contribution', CAST(count(*) AS VARCHAR) FROM orders UNION ALL SELECT '{D}Organization', CAST(count(DISTINCT c_mktsegment) AS VARCHAR) FROM customer UNION ALL SELECT '{D}Topic', CAST(count(DISTINCT p_brand) AS VARCHAR) FROM part",
)
sparql_query(
    "topics_of_named_processes",
    """SELECT ?process ?topic WHERE { ?p a del:DeliberationProcess ; del:name ?process ; del:hasTopic ?t . ?t del:name ?topic FILTER(CONTAINS(LCASE(?process), "united")) }""",
    "SELECT DISTINCT n_name AS process, p_brand AS topic FROM nation JOIN customer ON c_nationkey = n_nationkey JOIN orders ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey WHERE contains(lower(n_name), 'united')",
)
sparql_query(
    "responses",
    "SELECT ?answer ?to ?text WHERE { ?answer del:responseTo ?to . OPTIONAL { ?answer del:text ?text } }",
    "SELECT '{R}conversation_' || a.conv_id || '_' || a.turn AS answer, '{R}conversation_' || b.conv_id || '_' || b.turn AS to, CAST(NULL AS VARCHAR) AS text FROM (SELECT DISTINCT conv_id, turn FROM conversations) a JOIN (SELECT DISTINCT conv_id, turn FROM conversations) b ON a.conv_id = b.conv_id AND b.turn = a.turn - 1",
    conversation_graph,
)
sparql_query(
    "topics_with_ids",
    "SELECT ?t ?name WHERE { ?t a del:Topic ; del:name ?name } ORDER BY ?name",
    "SELECT DISTINCT '{R}topic_' || replace(p_brand, '#', '-') AS t, p_brand AS name FROM part",
)
sparql_query(
    "participants_by_organization",
    "SELECT ?org ?name WHERE { ?p del:isAffiliatedWith ?o ; del:name ?name . ?o del:name ?org } ORDER BY ?org ?name",
    "SELECT c_mktsegment AS org, c_name AS name FROM customer",
)
sparql_query(
    "participants_of_a_platform",
    """SELECT ?name ?org WHERE { ?d a del:DeliberationProcess ; del:name "FRANCE" ; del:hasParticipant ?p . ?p del:name ?name . OPTIONAL { ?p del:isAffiliatedWith ?o . ?o del:name ?org } }""",
    "SELECT c_name AS name, c_mktsegment AS org FROM customer JOIN nation ON n_nationkey = c_nationkey WHERE n_name = 'FRANCE'",
)
sparql_query(
    "contributions_with_author",
    "SELECT ?c ?text ?author WHERE { ?c a del:Contribution ; del:text ?text . OPTIONAL { ?c del:madeBy ?p . ?p del:name ?author } }",
    "SELECT '{R}contribution_' || o_orderkey AS c, o_orderpriority AS text, c_name AS author FROM orders LEFT JOIN customer ON o_custkey = c_custkey",
)
sparql_query(
    "related_topics_of_processes",
    """SELECT DISTINCT ?a ?b WHERE { ?x del:hasTopic ?t ; del:name ?a . ?y del:hasTopic ?t ; del:name ?b . ?t del:name "Brand#13" FILTER(?a != ?b) }""",
    """WITH t AS (SELECT DISTINCT n_name FROM nation JOIN customer ON c_nationkey = n_nationkey JOIN orders ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey WHERE p_brand = 'Brand#13')
    SELECT x.n_name AS a, y.n_name AS b FROM t x JOIN t y ON x.n_name <> y.n_name""",
)


MEMBERS, PLACED = "https://example.org/members", "placed"


def _sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two sources of one graph: customers with their names and organisations, and orders with the names of those who placed them."""
    customer, orders = _t(spark, sf_dir, "customer"), _t(spark, sf_dir, "orders")
    who, by = res("participant", "c_custkey"), res("participant", "o_custkey")
    named = customer.join(orders.select("o_custkey").distinct(), F.col("c_custkey") == F.col("o_custkey"), "left_semi")
    members = [branch(customer, who, T.DEL + "name", F.col("c_name")), branch(customer, who, T.DEL + "isAffiliatedWith", res("org", "c_mktsegment"), "uri")]
    placed = [branch(named, who, T.DEL + "name", F.col("c_name")), branch(orders, res("contribution", "o_orderkey"), T.DEL + "madeBy", by, "uri")]
    return T.quads(*[df.withColumn("src", F.lit(src)) for src, parts in ((MEMBERS, members), (PLACED, placed)) for df in parts])


def quad_query(name: str, text: str, sql: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return values(sparql(_sources(spark, sf_dir), text, quads=True))

    run.__name__ = name
    query(sql)(run)


quad_query(
    "names_by_graph",
    "SELECT ?g (COUNT(?p) AS ?n) WHERE { GRAPH ?g { ?p del:name ?name } } GROUP BY ?g",
    f"SELECT '{MEMBERS}' AS g, CAST(count(*) AS VARCHAR) AS n FROM customer UNION ALL SELECT '{T.GRAPHS}{PLACED}', CAST(count(DISTINCT c_custkey) AS VARCHAR) FROM customer JOIN orders ON o_custkey = c_custkey",
)
quad_query(
    "contributions_across_graphs",
    f"SELECT ?c ?org WHERE {{ GRAPH <{T.GRAPHS}{PLACED}> {{ ?c del:madeBy ?p }} GRAPH <{MEMBERS}> {{ ?p del:isAffiliatedWith ?org }} }}",
    "SELECT '{R}contribution_' || o_orderkey AS c, '{R}org_' || c_mktsegment AS org FROM orders JOIN customer ON o_custkey = c_custkey",
)
quad_query(
    "names_in_a_merge_of_graphs",
    f"SELECT ?p ?name FROM <{T.GRAPHS}{PLACED}> FROM <{MEMBERS}> WHERE {{ ?p del:name ?name }}",
    "SELECT '{R}participant_' || c_custkey AS p, c_name AS name FROM customer",
)
quad_query(
    "members_named_in_one_graph",
    f"SELECT ?p FROM <{MEMBERS}> FROM NAMED <{T.GRAPHS}{PLACED}> WHERE {{ ?p del:isAffiliatedWith ?o FILTER EXISTS {{ GRAPH ?g {{ ?p del:name ?n }} }} }}",
    "SELECT '{R}participant_' || c_custkey AS p FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)",
)

LONGEST = "SELECT conv_id, max(turn) AS most FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL GROUP BY conv_id ORDER BY most DESC, conv_id LIMIT 1"
RUN = f"""WITH RECURSIVE one AS ({LONGEST}), s AS (SELECT DISTINCT c.conv_id, turn, most FROM conversations c JOIN one USING (conv_id)),
r AS (SELECT conv_id, {{start}} AS turn FROM one UNION SELECT s.conv_id, s.turn FROM r JOIN s ON s.conv_id = r.conv_id AND s.turn = r.turn {{step}})
SELECT '{{R}}conversation_' || r.conv_id || '_' || r.turn AS turn FROM r JOIN one USING (conv_id) WHERE r.turn <> {{start}}"""


def _longest(spark: SparkSession, sf_dir: str) -> tuple[str, int, int]:
    """The conversation with the highest turn, that turn, and its least one."""
    c = _t(spark, sf_dir, "conversations").where("conv_id IS NOT NULL AND turn IS NOT NULL").groupBy("conv_id").agg(F.max("turn").alias("most"), F.min("turn").alias("least"))
    return c.orderBy(F.desc("most"), "conv_id").first()


@query(RUN.replace("{start}", "most").replace("{step}", "- 1"))
def turns_before(spark, sf_dir):
    """A path from a bound subject."""
    conv, most, _ = _longest(spark, sf_dir)
    return values(sparql(conversation_graph(spark, sf_dir), f"SELECT ?turn WHERE {{ <{RES}conversation_{conv}_{most}> del:responseTo+ ?turn }}"))


@query(RUN.replace("{start}", "(SELECT min(turn) FROM conversations JOIN one USING (conv_id))").replace("{step}", "+ 1"))
def turns_after(spark, sf_dir):
    """A path to a bound object."""
    conv, _, least = _longest(spark, sf_dir)
    return values(sparql(conversation_graph(spark, sf_dir), f"SELECT ?turn WHERE {{ ?turn del:responseTo+ <{RES}conversation_{conv}_{least}> }}"))


def part_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Brands as processes whose topics are the names of their parts."""
    p = _t(spark, sf_dir, "part").where("p_name IS NOT NULL AND p_brand IS NOT NULL").groupBy("p_brand", "p_name").agg(F.min("p_partkey").alias("p_partkey"))
    brand, topic = res("process", F.replace("p_brand", F.lit("#"), F.lit("-"))), res("topic", "p_partkey")
    brands = p.select("p_brand").distinct()
    parts = [
        branch(brands, brand, T.TYPE, F.lit(T.DEL + "DeliberationProcess"), "uri"), branch(brands, brand, T.DEL + "name", F.col("p_brand")),
        branch(p, brand, T.DEL + "hasTopic", topic, "uri"), branch(p, topic, T.DEL + "name", F.col("p_name")),
    ]
    return reduce(DataFrame.unionByName, parts)


sparql_query(
    "similar_topic_names",
    """SELECT ?name1 ?topic1 ?name2 ?topic2 WHERE { ?process1 a del:DeliberationProcess ; del:name ?name1 ; del:hasTopic ?t1 . ?t1 del:name ?topic1 .
    ?process2 a del:DeliberationProcess ; del:name ?name2 ; del:hasTopic ?t2 . ?t2 del:name ?topic2 .
    FILTER(?process1 != ?process2) FILTER(CONTAINS(LCASE(?topic1), LCASE(?topic2)) || CONTAINS(LCASE(?topic2), LCASE(?topic1))) }""",
    """WITH t AS (SELECT p_brand, p_name FROM part WHERE p_name IS NOT NULL AND p_brand IS NOT NULL GROUP BY ALL)
    SELECT a.p_brand AS name1, a.p_name AS topic1, b.p_brand AS name2, b.p_name AS topic2 FROM t a JOIN t b ON a.p_brand <> b.p_brand AND (contains(lower(a.p_name), lower(b.p_name)) OR contains(lower(b.p_name), lower(a.p_name)))""",
    part_graph,
)


def _linked(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    """A query over the people of two platforms, the links between them and what customers contribute."""
    people = _people(spark, sf_dir)
    pairs = L.resolve_participants(people).where("relation = 'sameAs'").select(F.col("a").alias("source"), F.col("b").alias("target"))
    if spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        pairs = pairs.checkpoint()  # the graph scans the pairs once a pattern
    made = _t(spark, sf_dir, "orders").select(res("contribution", "o_orderkey").alias("id"), F.col("o_orderpriority").alias("text"), F.lit(None).cast("string").alias("timestamp"), res("c", "o_custkey").alias("author"))
    triples = M.to_triples(M.Entities({"participant": people}, {"same_as": pairs}), "people")
    more = made.select(F.inline(F.array(*[F.struct(F.col("id").alias("s"), F.lit("uri").alias("s_kind"), F.lit(T.DEL + p).alias("p"), F.col(c).alias("o"), F.lit(k).alias("o_kind"), F.lit(None).cast("string").alias("o_dt"), F.lit(None).cast("string").alias("o_lang"), F.lit("orders").alias("src")) for p, c, k in (("madeBy", "author", "uri"), ("text", "text", "literal"))])))
    return values(sparql(triples.select(*T.TRIPLE_COLUMNS, "src").unionByName(more), text))


def _linked_people(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tables' graph, whose customers are of platform a, with the suppliers of platform b and the links between the two."""
    people = _people(spark, sf_dir)
    pairs = L.resolve_participants(people).where("relation = 'sameAs'")
    if spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        pairs = pairs.checkpoint()  # three checks read them
    own = lambda c: F.when(F.col(c).startswith(RES + "c_"), F.concat(F.lit(RES + "participant_"), F.substring_index(c, "_", -1))).otherwise(F.col(c))
    e = M.Entities({"participant": people.select(own("id").alias("id"), "name", "platform")}, {"same_as": pairs.select(own("a").alias("source"), own("b").alias("target"))})
    return T.graph(table_graph(spark, sf_dir), M.to_triples(e, "people"))


def opinion_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as contributions, labels as what was found in them, and the arguments in their texts."""
    docs = _t(spark, sf_dir, "documents").where("doc_id IS NOT NULL AND text IS NOT NULL").select(F.col("doc_id").alias("id"), "text")
    bad = _t(spark, sf_dir, "labels").where("toxic = 1").select("doc_id", F.when(F.col("quality") == 1, "toxic").otherwise("toxic junk").alias("type"), F.when(F.col("quality") == 1, "1.0").otherwise("0.5").alias("sure")).distinct()
    found = L.mine_arguments(docs, ("that ", "with "), "that ").select("id", "premise", "conclusion")
    c, f, a = res("contribution", "id"), res("fallacy", "doc_id"), res("argument", "id")
    parts = [
        branch(docs, c, T.TYPE, F.lit(T.DEL + "Contribution"), "uri"), branch(docs, c, T.DEL + "text", F.col("text")), branch(bad, res("contribution", "doc_id"), T.DEL + "containsFallacy", f, "uri"),
        branch(bad, res("argument", "doc_id"), T.DEL + "containsFallacy", f, "uri"), branch(bad, f, T.TYPE, F.lit(T.DEL + "FallacyType"), "uri"), branch(bad, f, T.DEL + "name", F.col("type")),
        branch(bad, f, T.DEL + "confidence", F.col("sure"), dt=T.XSD + "decimal"), branch(found, a, T.TYPE, F.lit(T.DEL + "Argument"), "uri"), branch(found, c, T.DEL + "containsArgument", a, "uri"),
    ]
    for side in ("premise", "conclusion"):
        some = found.where(F.col(side).isNotNull())
        parts += [branch(some, a, T.DEL + f"has{side.title()}", res(side, "id"), "uri"), branch(some, res(side, "id"), T.DEL + "text", F.col(side))]
    return reduce(DataFrame.unionByName, parts)


BAD_SQL = "(SELECT DISTINCT doc_id, CASE WHEN quality = 1 THEN 'toxic' ELSE 'toxic junk' END AS type, CASE WHEN quality = 1 THEN '1.0' ELSE '0.5' END AS sure FROM labels WHERE toxic = 1)"
ARGUMENT_SQL = """(SELECT doc_id, text, CASE WHEN contains(lower(text), 'that ') THEN substr(substr(lower(text), instr(lower(text), 'that ') + 5), 1, 100) END AS premise,
CASE WHEN contains(lower(text), 'that ') THEN substr(substr(lower(text), 1, instr(lower(text), 'that ') - 1), 1, 100) END AS conclusion FROM documents WHERE contains(lower(text), 'that ') OR contains(lower(text), 'with '))"""
sparql_query(
    "fallacies_by_confidence",
    "SELECT ?text ?type ?confidence WHERE { ?c a del:Contribution ; del:text ?text ; del:containsFallacy ?f . ?f a del:FallacyType ; del:name ?type ; del:confidence ?confidence } ORDER BY DESC(?confidence)",
    f"SELECT text, type, sure AS confidence FROM documents JOIN {BAD_SQL} USING (doc_id) WHERE text IS NOT NULL",
    opinion_graph,
)
sparql_query(
    "argument_analysis",
    "SELECT ?argument ?premise ?conclusion ?fallacy WHERE { ?argument a del:Argument . OPTIONAL { ?argument del:hasPremise ?premise } OPTIONAL { ?argument del:hasConclusion ?conclusion } OPTIONAL { ?argument del:containsFallacy ?fallacy } }",
    f"""SELECT '{{R}}argument_' || a.doc_id AS argument, CASE WHEN premise IS NOT NULL THEN '{{R}}premise_' || a.doc_id END AS premise, CASE WHEN conclusion IS NOT NULL THEN '{{R}}conclusion_' || a.doc_id END AS conclusion,
    CASE WHEN b.doc_id IS NOT NULL THEN '{{R}}fallacy_' || a.doc_id END AS fallacy FROM {ARGUMENT_SQL} a LEFT JOIN {BAD_SQL} b ON a.doc_id = b.doc_id""",
    opinion_graph,
)
sparql_query(
    "argument_texts",
    "SELECT ?text ?argument ?premise ?conclusion WHERE { ?c del:text ?text ; del:containsArgument ?argument . ?argument del:hasPremise ?a ; del:hasConclusion ?b . ?a del:text ?premise . ?b del:text ?conclusion }",
    f"SELECT text, '{{R}}argument_' || doc_id AS argument, premise, conclusion FROM {ARGUMENT_SQL} WHERE premise IS NOT NULL AND conclusion IS NOT NULL",
    opinion_graph,
)


def _brands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Brands as topics, related where parts of both come in one size and type."""
    p = _t(spark, sf_dir, "part").select("p_brand", "p_size", "p_type").distinct()
    topic = lambda c: res("topic", F.replace(c, F.lit("#"), F.lit("-")))
    both = p.join(p.withColumnRenamed("p_brand", "other"), ["p_size", "p_type"]).where("p_brand <> other").select("p_brand", "other").distinct()
    brands = p.select("p_brand").distinct()
    return reduce(DataFrame.unionByName, [branch(brands, topic("p_brand"), T.TYPE, F.lit(T.DEL + "Topic"), "uri"), branch(both, topic("p_brand"), T.SKOS + "related", topic("other"), "uri")])


sparql_query(
    "count_of_related_topics",
    "SELECT (COUNT(?link) AS ?count) WHERE { ?t1 a del:Topic . ?t2 a del:Topic . ?t1 skos:related ?t2 . BIND(?t1 AS ?link) }",
    """SELECT CAST(count(*) AS VARCHAR) AS count FROM (SELECT DISTINCT a.p_brand, b.p_brand FROM part a JOIN part b ON a.p_size = b.p_size AND a.p_type = b.p_type AND a.p_brand <> b.p_brand)""",
    _brands,
)
sparql_query(
    "count_of_triples",
    "SELECT (COUNT(*) AS ?n) WHERE { ?s ?p ?o }",
    """WITH t AS (SELECT DISTINCT c_nationkey, p_brand FROM customer JOIN orders ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey)
    SELECT CAST(3 * (SELECT count(*) FROM nation) + 4 * (SELECT count(*) FROM customer) + 2 * (SELECT count(DISTINCT c_mktsegment) FROM customer) + 4 * (SELECT count(*) FROM orders)
    + (SELECT count(*) FROM orders JOIN customer ON o_custkey = c_custkey) + 2 * (SELECT count(DISTINCT p_brand) FROM part) + (SELECT count(*) FROM t) AS VARCHAR) AS n""",
)


def _with_suppliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    people = _t(spark, sf_dir, "supplier").select(res("s", "s_suppkey").alias("id"), F.col("s_name").alias("name"), F.lit("b").alias("platform"))
    return table_graph(spark, sf_dir).unionByName(M.to_triples(M.Entities({"participant": people}), "people").select(*T.TRIPLE_COLUMNS, "src"))


sparql_query(
    "participants_with_platform",
    "SELECT ?participant ?name ?platform WHERE { ?participant a del:Participant ; del:name ?name . OPTIONAL { ?participant del:platform ?platform } }",
    "SELECT '{R}participant_' || c_custkey AS participant, c_name AS name, NULL AS platform FROM customer UNION ALL SELECT '{R}s_' || s_suppkey, s_name, 'b' FROM supplier",
    _with_suppliers,
)

LINKS_SQL = "customer JOIN supplier ON regexp_replace(c_name, '[^0-9]', '', 'g') = regexp_replace(s_name, '[^0-9]', '', 'g')"


@query(f"SELECT CAST(count(*) AS VARCHAR) AS n FROM {LINKS_SQL}")
def same_as_count(spark, sf_dir):
    return _linked(spark, sf_dir, "SELECT (COUNT(?a) AS ?n) WHERE { ?a owl:sameAs ?b }")


@query(f"SELECT '{{R}}s_' || s_suppkey AS person, '{{R}}contribution_' || o_orderkey AS c, o_orderpriority AS text FROM {LINKS_SQL} JOIN orders ON o_custkey = c_custkey")
def contributions_of_linked_participants(spark, sf_dir):
    return _linked(spark, sf_dir, 'SELECT ?person ?c ?text WHERE { ?a owl:sameAs ?person . ?person del:platform "b" . ?c del:madeBy ?a ; del:text ?text }')


@query(f"SELECT 'Member ' || regexp_replace(c_name, '[^0-9]', '', 'g') AS name1, 'a' AS platform1, 'Dr. Member ' || regexp_replace(s_name, '[^0-9]', '', 'g') AS name2, 'b' AS platform2, 'sameAs' AS relation FROM {LINKS_SQL}")
def connections(spark, sf_dir):
    """Links of both kinds with their names: patterns that only the UNION connects."""
    return _linked(
        spark, sf_dir,
        """SELECT ?name1 ?platform1 ?name2 ?platform2 ?relation WHERE { ?p1 del:name ?name1 ; del:platform ?platform1 . ?p2 del:name ?name2 ; del:platform ?platform2 .
        { ?p1 owl:sameAs ?p2 . BIND("sameAs" AS ?relation) } UNION { ?p1 skos:related ?p2 . BIND("related" AS ?relation) } FILTER(?platform1 != ?platform2) }""",
    )


@query(f"""SELECT 'Member ' || regexp_replace(c_name, '[^0-9]', '', 'g') AS name, o_orderpriority AS text1, event_type AS text2 FROM {LINKS_SQL} JOIN orders ON o_custkey = c_custkey JOIN events ON user_id = s_suppkey""")
def texts_of_linked_people(spark, sf_dir):
    """What the same person wrote on two platforms: customers' orders and suppliers' events."""
    people = _people(spark, sf_dir).withColumn("name", F.regexp_replace("name", "^Dr. ", ""))
    pairs = L.resolve_participants(people).where("relation = 'sameAs'").select(F.col("a").alias("source"), F.col("b").alias("target"))
    if spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        pairs = pairs.checkpoint()
    g = M.to_triples(M.Entities({"participant": people}, {"same_as": pairs}), "people").select(*T.TRIPLE_COLUMNS, "src")
    for df, key, who, by, text in ((_t(spark, sf_dir, "orders"), "o_orderkey", "c", "o_custkey", "o_orderpriority"), (_t(spark, sf_dir, "events"), "event_id", "s", "user_id", "event_type")):
        me = res(f"{who}_contribution", key)
        g = g.unionByName(branch(df, me, T.DEL + "madeBy", res(who, by), "uri")).unionByName(branch(df, me, T.DEL + "text", F.col(text)))
    text = """SELECT ?name ?text1 ?text2 WHERE { ?p1 del:name ?name ; del:platform ?x . ?p2 del:name ?name ; del:platform ?y . ?p1 owl:sameAs ?p2 .
    ?c1 del:madeBy ?p1 ; del:text ?text1 . ?c2 del:madeBy ?p2 ; del:text ?text2 FILTER(?x != ?y) }"""
    return values(sparql(g, text))


@query(f"""SELECT CAST(0 AS VARCHAR) AS processes, CAST((SELECT count(*) FROM customer) + (SELECT count(*) FROM supplier) AS VARCHAR) AS participants, CAST(0 AS VARCHAR) AS topics, CAST(count(DISTINCT c_custkey) AS VARCHAR) AS cross_links FROM {LINKS_SQL}""")
def quick_stats(spark, sf_dir):
    return _linked(
        spark, sf_dir,
        """SELECT (COUNT(DISTINCT ?process) AS ?processes) (COUNT(DISTINCT ?participant) AS ?participants) (COUNT(DISTINCT ?topic) AS ?topics) (COUNT(DISTINCT ?link) AS ?cross_links) WHERE {
        OPTIONAL { ?process a del:DeliberationProcess } OPTIONAL { ?participant a del:Participant } OPTIONAL { ?topic a del:Topic } OPTIONAL { ?p1 owl:sameAs ?p2 . BIND(?p1 AS ?link) } }""",
    )


sparql_query("initial_bindings", "SELECT ?p ?name WHERE { ?p del:name ?name }", "SELECT c_name AS name, CAST(NULL AS VARCHAR) AS p FROM customer WHERE c_custkey = 3", bound={"p": T.iri(RES + "participant_3")})
ORACLE["initial_bindings"] = f"SELECT '{RES}participant_3' AS p, c_name AS name FROM customer WHERE c_custkey = 3"


@query("""SELECT '{"process":{"type":"uri","value":"{R}process_' || n_nationkey || '"},"name":{"type":"literal","value":"' || n_name || '"}}' AS json FROM nation""")
def sparql_json_rows(spark, sf_dir):
    return bindings(sparql(table_graph(spark, sf_dir), "SELECT ?process ?name ?end WHERE { ?process a del:DeliberationProcess ; del:name ?name OPTIONAL { ?process del:endDate ?end } }"))


@query("""
SELECT '{R}contribution_' || o_orderkey AS contribution, o_orderpriority AS text, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') AS timestamp, c_name AS participant, n_name AS process, r_name AS platform
FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey
ORDER BY process, timestamp, contribution LIMIT 1000
""")
def contributions_api(spark, sf_dir):
    return A.contributions(table_graph(spark, sf_dir))


@query("""
WITH d AS (SELECT lower(replace(replace(r_name, ' ', '_'), '.', '_')) AS id, max(r_name) AS name, count(DISTINCT o_orderkey) AS n FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey GROUP BY 1),
u AS (SELECT 'ep_debate' AS id, count(*) AS m FROM orders HAVING count(*) > 0)
SELECT coalesce(d.id, u.id) AS id, CASE WHEN u.id IS NOT NULL THEN 'European Parliament Debates' ELSE name END AS name, greatest(coalesce(n, 0), coalesce(m, 0)) AS count FROM d FULL JOIN u ON d.id = u.id
""")
def platform_inventory(spark, sf_dir):
    return A.platforms(table_graph(spark, sf_dir))


@query("""
SELECT * FROM (
SELECT '{R}process_' || n_nationkey AS id, 'DeliberationProcess' AS type, n_name AS text FROM nation WHERE contains(lower(n_name), 'an')
UNION SELECT '{R}org_' || c_mktsegment, 'Organization', c_mktsegment FROM customer WHERE contains(lower(c_mktsegment), 'an')
UNION SELECT '{R}participant_' || c_custkey, 'Participant', c_name FROM customer WHERE contains(lower(c_name), 'an')
UNION SELECT '{R}topic_' || replace(p_brand, '#', '-'), 'Topic', p_brand FROM part WHERE contains(lower(p_brand), 'an')
UNION SELECT '{R}contribution_' || o_orderkey, 'Contribution', o_orderpriority FROM orders WHERE contains(lower(o_orderpriority), 'an')) ORDER BY id, type, text LIMIT 50
""")
def keyword_search(spark, sf_dir):
    return A.search(table_graph(spark, sf_dir), "An")


def _folder(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"


@query("""
SELECT '{R}process_' || n_nationkey AS id, 'DeliberationProcess' AS type, n_name AS text FROM nation WHERE contains(lower(n_name), 'ran')
UNION SELECT '{R}participant_' || c_custkey, 'Participant', c_name FROM customer WHERE contains(lower(c_name), 'ran')
UNION SELECT '{R}org_' || c_mktsegment, 'Organization', c_mktsegment FROM customer WHERE contains(lower(c_mktsegment), 'ran')
UNION SELECT '{R}topic_' || replace(p_brand, '#', '-'), 'Topic', p_brand FROM part WHERE contains(lower(p_brand), 'ran')
UNION SELECT '{R}contribution_' || o_orderkey, 'Contribution', o_orderpriority FROM orders WHERE contains(lower(o_orderpriority), 'ran')
""")
def indexed_search(spark, sf_dir):
    path = _folder(spark, "index")
    search_index.write_index(table_graph(spark, sf_dir), path)
    return search_index.search(spark, path, "Ran", None)


@query("""
WITH c AS (SELECT '{R}contribution_' || o_orderkey AS contribution, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') AS timestamp, n_name AS process, r_name AS platform
FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey),
n AS (SELECT *, row_number() OVER (ORDER BY platform, process, timestamp, contribution) AS k FROM c)
SELECT CAST(k AS BIGINT) AS k, contribution, CASE WHEN lag(platform) OVER (ORDER BY k) IS DISTINCT FROM platform THEN platform END AS opens_platform,
CASE WHEN lag(process) OVER (ORDER BY k) IS DISTINCT FROM process THEN process END AS opens_process,
CASE WHEN lead(platform) OVER (ORDER BY k) IS DISTINCT FROM platform THEN 2 WHEN lead(process) OVER (ORDER BY k) IS DISTINCT FROM process THEN 1 ELSE 0 END AS closes FROM n
""")
def nested_contributions(spark, sf_dir):
    """Each piece of the nested document: its place, its contribution, what it opens, how many lists it closes."""
    path = _folder(spark, "nested")
    nested.write_contributions(table_graph(spark, sf_dir), path)
    # The number of a line in its file, and of its file: those of one document.
    lines = with_places(spark.read.text(path).select("value", "_metadata"), "line").withColumn("file", F.col("_metadata.file_name"))
    files = spark.read.text(path).groupBy(F.col("_metadata.file_name").alias("file")).agg(F.count(F.lit(1)).alias("lines"))
    before = files.alias("a").join(files.alias("b"), F.col("b.file") < F.col("a.file"), "left").groupBy(F.col("a.file").alias("file")).agg(F.coalesce(F.sum("b.lines"), F.lit(0)).alias("before"))  # a row a file
    found = lambda pattern: F.nullif(F.regexp_extract("value", pattern, 1), F.lit(""))
    return lines.join(F.broadcast(before), "file").select(
        (F.col("before") + F.col("line") + 1).alias("k"), found('"contribution":"([^"]*)"').alias("contribution"), found('[{]"platform":"([^"]*)","processes"').alias("opens_platform"),
        found('[{]"process":"([^"]*)","contributions"').alias("opens_process"), F.length(F.regexp_replace(F.regexp_extract("value", r"}((?:\]})*)\]?$", 1), "]", "")).alias("closes"),
    )


def _links(e: M.Entities, *names: str, sets: bool = False) -> DataFrame:
    """Links as a set; sets: they hold no row twice as they are."""
    each = [e.links[k].select(F.lit(k).alias("link"), "source", "target") for k in names]
    return reduce(DataFrame.unionByName, each if sets else [df.distinct() for df in each])


def _said(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of conversations with their place, role and text on one line."""
    c = _t(spark, sf_dir, "conversations").where("conv_id IS NOT NULL AND turn IS NOT NULL AND role IS NOT NULL")
    return c.select("conv_id", "turn", "role", F.coalesce(X.collapse(F.translate("text", '"\\\\', "''")), F.lit("")).alias("text"))


def _json_files(docs: DataFrame, file: Column, name: str, path: str) -> None:
    """A JSON document a `file` (some hundred documents each), which holds its documents as the list `name`."""
    whole = docs.groupBy(file.alias("file")).agg(F.to_json(F.struct(F.collect_list(F.struct(*[F.col(f"`{c}`") for c in docs.columns])).alias(name))).alias("value"))
    whole.write.partitionBy("file").text(path)


SAID_SQL = "WITH s AS (SELECT conv_id, turn, role FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL AND role IS NOT NULL)"


@query(SAID_SQL + """
SELECT 'has_participant' AS link, '{R}' || conv_id AS source, '{R}' || conv_id || '_' || role AS target FROM s UNION SELECT 'has_contribution', '{R}' || conv_id, '{R}' || conv_id || '_t' || turn FROM s
UNION SELECT 'made_by', '{R}' || conv_id || '_t' || turn, '{R}' || conv_id || '_' || role FROM s UNION SELECT 'response_to', '{R}' || conv_id || '_t' || turn, '{R}' || conv_id || '_t' || (turn - 1) FROM s WHERE turn > 0""")
def debate_links(spark, sf_dir):
    """Conversations as debate documents, a hundred to a file, and back."""
    path, rows = _folder(spark, "debates"), _said(spark, sf_dir)
    at = lambda c: F.struct(F.concat(F.lit(RES), c).alias("@id"))
    turn = F.concat(F.lit("t"), F.col("turn"))
    before = F.when(F.col("turn") > 0, at(F.concat(F.lit("t"), F.col("turn") - 1)))
    said = F.struct(turn.alias("del:identifier"), F.col("text").alias("del:text"), at(F.col("role")).alias("del:madeBy"), before.alias("del:responseTo"))
    docs = rows.groupBy("conv_id").agg(F.collect_list(said).alias("del:hasContribution"), F.collect_set(F.struct(F.col("role").alias("del:identifier"), F.col("role").alias("del:name"))).alias("del:hasParticipant"))
    docs = docs.select(F.lit("del:DeliberationProcess").alias("@type"), F.col("conv_id").cast("string").alias("del:identifier"), "del:hasContribution", "del:hasParticipant")
    _json_files(docs, F.floor(F.col("`del:identifier`").cast("long") / 100), "@graph", path)
    return _links(debates(spark, path), "has_participant", "has_contribution", "made_by", "response_to")


@query(r"""
WITH s AS (SELECT conv_id, turn, role FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL AND role IS NOT NULL AND upper(role) <> 'SYSTEM' AND trim(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g')) <> ''),
n AS (SELECT '{R}delidata_' AS d)
SELECT 'has_contribution' AS link, d || 'process_' || conv_id AS source, d || 'message_' || conv_id || '_' || turn AS target FROM s, n UNION SELECT 'made_by', d || 'message_' || conv_id || '_' || turn, d || 'participant_' || conv_id || '_' || lower(role) FROM s, n
UNION SELECT 'has_participant', d || 'process_' || conv_id, d || 'participant_' || conv_id || '_' || lower(role) FROM s, n
UNION SELECT 'has_argument', d || 'message_' || conv_id || '_' || turn, d || 'message_' || conv_id || '_' || turn || '_argument' FROM s, n WHERE turn % 3 > 0""")
def delidata_links(spark, sf_dir):
    """Conversations as annotated chat logs, and back."""
    path = _folder(spark, "delidata")
    kind = F.when(F.col("turn") % 3 == 0, "0").otherwise("Probing")
    rows = _said(spark, sf_dir).select(F.col("conv_id").alias("group_id"), F.col("turn").alias("message_id"), F.col("role").alias("origin"), F.col("text").alias("original_text"), kind.alias("annotation_type"))
    rows.write.option("sep", "\t").option("header", True).csv(path)
    return _links(delidata_tsv(spark, path), "has_contribution", "made_by", "has_participant", "has_argument")


@query(r"""
WITH s AS (SELECT conv_id, turn, role FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL AND role IS NOT NULL AND upper(role) <> 'SYSTEM' AND trim(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g')) <> ''),
n AS (SELECT '{R}delidata_' AS d)
SELECT 'has_contribution' AS link, d || 'process_' || conv_id AS source, d || 'message_' || conv_id || '_' || turn AS target FROM s, n UNION SELECT 'made_by', d || 'message_' || conv_id || '_' || turn, d || 'participant_' || conv_id || '_' || lower(role) FROM s, n
UNION SELECT 'has_argument', d || 'message_' || conv_id || '_' || turn, d || 'message_' || conv_id || '_' || turn || '_argument' FROM s, n WHERE turn % 3 > 0""")
def chat_documents(spark, sf_dir):
    """Conversations as documents of annotated chats, and back."""
    path = _folder(spark, "chats")
    kind = F.when(F.col("turn") % 3 == 0, "0").otherwise("Probing")
    one = F.struct(F.col("turn").alias("message_id"), F.col("role").alias("origin"), F.col("text").alias("original_text"), kind.alias("annotation_type"))
    docs = _said(spark, sf_dir).groupBy(F.col("conv_id").alias("group_id")).agg(F.collect_list(one).alias("messages"))
    _json_files(docs, F.floor(F.col("group_id") / 100), "conversations", path)
    return _links(delidata(spark, path), "has_contribution", "made_by", "has_argument")


@query("""
WITH p AS (SELECT o_orderkey AS id, o_custkey AS who FROM orders), c AS (SELECT l_orderkey AS parent, l_orderkey || '_' || l_linenumber AS id, l_suppkey AS who FROM lineitem JOIN orders ON o_orderkey = l_orderkey), m AS (SELECT '{R}madrid_' AS m)
SELECT 'has_contribution' AS link, m || 'proposal_' || id AS source, m || 'text_' || id AS target FROM p, m UNION SELECT 'has_contribution', m || 'proposal_' || parent, m || 'comment_' || c.id FROM c, m
UNION SELECT 'response_to', m || 'comment_' || c.id, m || 'text_' || parent FROM c, m UNION SELECT 'made_by', m || 'text_' || id, m || 'participant_' || who FROM p, m UNION SELECT 'made_by', m || 'comment_' || c.id, m || 'participant_' || c.who FROM c, m""")
def proposal_documents(spark, sf_dir):
    """Orders as proposals with line items as the comments below them, as documents, and back."""
    path = _folder(spark, "proposals")
    l = _t(spark, sf_dir, "lineitem")
    said = l.groupBy("l_orderkey").agg(F.collect_list(F.struct(F.concat_ws("_", "l_orderkey", "l_linenumber").alias("id"), F.col("l_returnflag").alias("body"), F.struct(F.col("l_suppkey").alias("id")).alias("author"))).alias("comments"))
    o = _t(spark, sf_dir, "orders").join(said, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    docs = o.select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("title"), F.col("o_orderpriority").alias("summary"), F.struct(F.col("o_custkey").alias("id")).alias("author"), F.date_format("o_orderdate", STAMP).alias("created_at"), "comments")
    _json_files(docs, F.floor(F.col("id") / 4000), "proposals", path)
    return _links(madrid(spark, path), "has_contribution", "response_to", "made_by")


@query("""
SELECT 'has_contribution' AS link, '{R}euhys_process_' || c_custkey AS source, '{R}euhys_feedback_' || o_orderkey AS target FROM orders JOIN customer ON o_custkey = c_custkey
UNION SELECT 'made_by', '{R}euhys_feedback_' || o_orderkey, '{R}euhys_participant_person_' || lower(o_orderstatus) || '_' || o_orderkey FROM orders JOIN customer ON o_custkey = c_custkey
UNION SELECT 'has_topic', '{R}euhys_process_' || c_custkey, '{R}euhys_topic_' || lower(c_mktsegment) FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders)""")
def initiative_documents(spark, sf_dir):
    """Customers as initiatives with their orders as feedback, a document each, and back."""
    path = _folder(spark, "initiatives")
    said = _t(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.collect_list(F.struct(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("text"), F.col("o_orderstatus").alias("surname"), F.lit("X").alias("country"))).alias("feedback"))
    c = _t(spark, sf_dir, "customer").join(said, F.col("c_custkey") == F.col("o_custkey"))
    docs = c.select(F.col("c_custkey").alias("initiative_id"), F.col("c_name").alias("title"), F.array("c_mktsegment").alias("policy_areas"), "feedback")
    files = docs.groupBy(F.floor(F.col("initiative_id") / 500).alias("file")).agg(F.to_json(F.collect_list(F.struct(*docs.columns))).alias("value"))
    files.write.partitionBy("file").text(path)
    return _links(consultation_documents(spark, path), "has_contribution", "made_by", "has_topic")


@query("""
SELECT n_nationkey AS process, n_name AS name, (SELECT count(*) FROM customer WHERE c_nationkey = n_nationkey) AS participants,
(SELECT count(*) FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_nationkey = n_nationkey) AS contributions FROM nation""")
def process_summaries(spark, sf_dir):
    """A nested document a process, written and read back, and what its summary counts."""
    path = _folder(spark, "documents")
    nation, customer, orders = (_t(spark, sf_dir, n) for n in ("nation", "customer", "orders"))
    placed = orders.join(customer, F.col("o_custkey") == F.col("c_custkey"))
    e = M.Entities(
        {
            "process": nation.select(res("process", "n_nationkey").alias("id"), F.col("n_name").alias("name")), "participant": customer.select(res("participant", "c_custkey").alias("id"), F.col("c_name").alias("name")),
            "contribution": orders.select(res("contribution", "o_orderkey").alias("id"), F.col("o_orderpriority").alias("text")),
        },
        {
            "has_participant": customer.select(res("process", "c_nationkey").alias("source"), res("participant", "c_custkey").alias("target")),
            "has_contribution": placed.select(res("process", "c_nationkey").alias("source"), res("contribution", "o_orderkey").alias("target")),
        },
    )
    write_documents(e, f"{path}/documents")
    write_summary(spark.read.json(f"{path}/documents"), f"{path}/summary")
    back = spark.read.json(f"{path}/summary")
    return back.select(F.substring_index("process_id", "_", -1).cast("long").alias("process"), "name", "participants", "contributions")


@query(r"""
WITH s AS (SELECT conv_id, turn, role, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role) AS n, trim(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g')) AS text FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL AND role IS NOT NULL)
SELECT '{R}scotus_case_' || conv_id || '_contribution_' || n AS source, '{R}scotus_participant_' || lower(role) AS target FROM s WHERE text <> ''""")
def court_speakers(spark, sf_dir):
    """Conversations as transcripts whose contributions are numbered by their place in the file."""
    path = _folder(spark, "court")
    rows = _said(spark, sf_dir).select(F.col("conv_id").alias("case"), F.col("role").alias("speaker"), "text", "turn")
    rows.repartition("case").sortWithinPartitions("case", "turn", "speaker").select("case", "speaker", "text").write.option("header", True).option("quote", '"').option("escape", '"').csv(path)
    return court_csv(spark, path).links["made_by"]


@query("""
WITH f AS (SELECT o_orderkey AS fid, c_nationkey AS iid, CASE WHEN o_orderpriority LIKE '1%' THEN c_mktsegment END AS org, c_name AS name FROM orders JOIN customer ON o_custkey = c_custkey),
w AS (SELECT *, CASE WHEN org IS NOT NULL THEN 'org_' || lower(org) ELSE 'person_' || lower(regexp_replace(name, '[^A-Za-z0-9_]', '', 'g')) || '_' || fid END AS k FROM f)
SELECT 'has_contribution' AS link, '{R}euhys_process_' || iid AS source, '{R}euhys_feedback_' || fid AS target FROM w UNION SELECT 'made_by', '{R}euhys_feedback_' || fid, '{R}euhys_participant_' || k FROM w
UNION SELECT 'has_participant', '{R}euhys_process_' || iid, '{R}euhys_participant_' || k FROM w UNION SELECT 'affiliated', '{R}euhys_participant_' || k, '{R}euhys_org_' || lower(org) FROM w WHERE org IS NOT NULL""")
def consultation_links(spark, sf_dir):
    """Orders as feedback to the initiatives of nations, in the files of consultations."""
    path = _folder(spark, "consultations")
    o = _t(spark, sf_dir, "orders").join(_t(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    org = F.when(F.col("o_orderpriority").startswith("1"), F.col("c_mktsegment"))
    o.select(
        F.col("o_orderkey").alias("id"), F.col("c_nationkey").alias("publication_id"), F.lit("en").alias("language"), F.lit("X").alias("country"), org.alias("organization"), F.col("c_name").alias("surname"), F.lit(None).cast("string").alias("first_name"),
        F.col("o_orderpriority").alias("feedback"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("date_feedback"), F.lit("Plan").alias("publication"),
    ).write.option("header", True).option("quote", '"').option("escape", '"').csv(path)
    return _links(consultations(spark, path), "has_contribution", "made_by", "has_participant", "affiliated")


@query("""
WITH p AS (SELECT o_orderkey AS id, 'customer' || o_custkey AS who FROM orders), c AS (SELECT l_orderkey AS parent, l_orderkey || '_' || l_linenumber AS id, 'supplier' || l_suppkey AS who FROM lineitem), m AS (SELECT '{R}madrid_' AS m)
SELECT 'has_contribution' AS link, m || 'proposal_' || id AS source, m || 'text_' || id AS target FROM p, m UNION SELECT 'has_contribution', m || 'proposal_' || parent, m || 'comment_' || c.id FROM c JOIN p ON p.id = parent, m
UNION SELECT 'response_to', m || 'comment_' || c.id, m || 'text_' || parent FROM c JOIN p ON p.id = parent, m UNION SELECT 'made_by', m || 'text_' || id, m || 'participant_' || who FROM p, m
UNION SELECT 'made_by', m || 'comment_' || c.id, m || 'participant_' || c.who FROM c JOIN p ON p.id = parent, m""")
def debate_comments(spark, sf_dir):
    """Orders as debates and line items as comments to them, in the files of a city's portal."""
    path = _folder(spark, "madrid")
    csv = lambda df, at: df.write.option("sep", ";").option("header", True).option("quote", '"').option("escape", '"').csv(f"{path}/{at}")
    when = lambda c: F.date_format(c, "dd/MM/yyyy HH").alias("created_at")
    o, l = _t(spark, sf_dir, "orders"), _t(spark, sf_dir, "lineitem")
    csv(o.select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("title"), F.col("o_orderpriority").alias("description"), F.concat(F.lit("Customer"), "o_custkey").alias("author_name"), when("o_orderdate")), "debates")
    csv(l.select(F.concat_ws("_", "l_orderkey", "l_linenumber").alias("id"), F.col("l_orderkey").alias("debate_id"), F.col("l_returnflag").alias("body"), F.concat(F.lit("Supplier"), "l_suppkey").alias("author_name"), when("l_shipdate")), "comments")
    return _links(madrid_csv(spark, f"{path}/debates", f"{path}/comments"), "has_contribution", "response_to", "made_by", sets=True)


def _member_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers and nations with names, and texts of documents that need escaping."""
    customer, nation, docs = _t(spark, sf_dir, "customer"), _t(spark, sf_dir, "nation"), _t(spark, sf_dir, "documents").where("doc_id IS NOT NULL AND text <> ''")
    who = res("participant", "c_custkey")
    return T.graph(
        branch(customer, who, T.TYPE, F.lit(T.DEL + "Participant"), "uri"), branch(customer, who, T.DEL + "name", F.col("c_name")), branch(customer, res("process", "c_nationkey"), T.DEL + "hasParticipant", who, "uri"),
        branch(nation, res("process", "n_nationkey"), T.DEL + "name", F.col("n_name")), branch(docs, res("contribution", "doc_id"), T.DEL + "text", F.substring("text", 1, 300)),
        branch(docs, res("contribution", "doc_id"), T.DEL + "length", F.length("text"), dt=T.XSD + "integer"),
    )


MEMBER_SQL = """SELECT '{R}participant_' || c_custkey AS s, 'http://www.w3.org/1999/02/22-rdf-syntax-ns#type' AS p, '{D}Participant' AS o, CAST(NULL AS VARCHAR) AS dt FROM customer
UNION SELECT '{R}participant_' || c_custkey, '{D}name', c_name, NULL FROM customer UNION SELECT '{R}process_' || c_nationkey, '{D}hasParticipant', '{R}participant_' || c_custkey, NULL FROM customer
UNION SELECT '{R}process_' || n_nationkey, '{D}name', n_name, NULL FROM nation UNION SELECT '{R}contribution_' || doc_id, '{D}text', substr(text, 1, 300), NULL FROM documents WHERE doc_id IS NOT NULL AND text <> ''
UNION SELECT '{R}contribution_' || doc_id, '{D}length', CAST(length(text) AS VARCHAR), 'http://www.w3.org/2001/XMLSchema#integer' FROM documents WHERE doc_id IS NOT NULL AND text <> ''"""


def _read_back(df: DataFrame) -> DataFrame:
    return df.select("s", "p", "o", F.col("o_dt").alias("dt"))


@query(MEMBER_SQL)
def ntriples_round_trip(spark, sf_dir):
    path = _folder(spark, "nt")
    write_rdf(_member_graph(spark, sf_dir), path, "ntriples")
    return _read_back(read_rdf(spark, path, "ntriples"))


@query(MEMBER_SQL)
def turtle_round_trip(spark, sf_dir):
    """Written as Turtle, read back in splits."""
    path = _folder(spark, "ttl")
    write_rdf(_member_graph(spark, sf_dir), path, "turtle")
    return _read_back(read_turtle(spark, path))


@query(MEMBER_SQL)
def saved_version(spark, sf_dir):
    """A graph saved twice: the backup stays, the last version is read."""
    path, graph = _folder(spark, "saved"), _member_graph(spark, sf_dir)
    save_version(graph.where(F.col("p") == T.TYPE), path)
    save_version(graph, path)
    return _read_back(load_version(spark, path))


@query(r"SELECT doc_id, substr(replace(text, chr(13), ''), 1, 500) AS text FROM documents WHERE text IS NOT NULL AND text <> ''")
def csv_export(spark, sf_dir):
    """Texts cut at 500 characters, as CSV and back."""
    path = _folder(spark, "csv")
    docs = _t(spark, sf_dir, "documents").where("text IS NOT NULL AND text <> ''").select("doc_id", F.translate("text", "\r", "").alias("text"))
    write_csv(docs, path, "text")
    back = spark.read.option("header", True).option("multiLine", True).option("quote", '"').option("escape", '"').option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)
    return back.select(F.col("doc_id").cast("long").alias("doc_id"), "text")


@query("SELECT o_orderkey, CAST(row_number() OVER (PARTITION BY o_custkey % 16 ORDER BY o_orderkey) - 1 AS BIGINT) AS place FROM orders")
def places_in_files(spark, sf_dir):
    """The place of rows in CSV files that are read in splits."""
    path = _folder(spark, "orders")
    rows = _t(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority", (F.col("o_custkey") % 16).alias("part"))
    rows.repartition("part").sortWithinPartitions("part", "o_orderkey").write.partitionBy("part").option("header", True).csv(path)
    return with_places(spark.read.option("header", True).csv(path)).select(F.col("o_orderkey").cast("long").alias("o_orderkey"), "place")


@query("""
WITH o AS (SELECT DISTINCT c_mktsegment FROM customer), topics AS (SELECT DISTINCT p_brand FROM part),
t AS (SELECT DISTINCT c_nationkey, p_brand FROM customer JOIN orders ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey)
SELECT * FROM (
SELECT '{R}process_' || n_nationkey AS source, '{R}participant_' || c_custkey AS target, 'hasParticipant' AS relation FROM customer JOIN nation ON n_nationkey = c_nationkey
UNION ALL SELECT '{R}participant_' || c_custkey, '{R}org_' || c_mktsegment, 'isAffiliatedWith' FROM customer
UNION ALL SELECT '{R}process_' || c_nationkey, '{R}topic_' || replace(p_brand, '#', '-'), 'hasTopic' FROM t)
""")
def network_edges(spark, sf_dir):
    return A.network_edges(A.network(table_graph(spark, sf_dir), limit=None))


@query("""
SELECT '{R}process_' || n_nationkey AS id, n_name AS label, 'DeliberationProcess' AS type FROM nation
UNION ALL SELECT '{R}participant_' || c_custkey, c_name, 'Participant' FROM customer
UNION ALL SELECT DISTINCT '{R}org_' || c_mktsegment, c_mktsegment, 'Organization' FROM customer
UNION ALL SELECT DISTINCT '{R}topic_' || replace(p_brand, '#', '-'), p_brand, 'Topic' FROM part
""")
def network_nodes(spark, sf_dir):
    return A.network_nodes(A.network(table_graph(spark, sf_dir), limit=None))


@query("""
SELECT property, value FROM (SELECT o_orderkey, 'type' AS property, '{D}Contribution' AS value FROM orders UNION ALL SELECT o_orderkey, 'timestamp', strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') FROM orders
UNION ALL SELECT o_orderkey, 'text', o_orderpriority FROM orders UNION ALL SELECT o_orderkey, 'madeBy', '{R}participant_' || o_custkey FROM orders) WHERE o_orderkey = (SELECT min(o_orderkey) FROM orders)
""")
def contribution_detail(spark, sf_dir):
    first = _t(spark, sf_dir, "orders").agg(F.min("o_orderkey")).first()[0]
    return A.detail(table_graph(spark, sf_dir), f"{RES}contribution_{first}", compat=True)


def _people(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers and suppliers as the participants of two platforms, by the number in their names."""
    c = _t(spark, sf_dir, "customer").select(res("c", "c_custkey").alias("id"), F.concat(F.lit("Member "), F.regexp_replace("c_name", "[^0-9]", "")).alias("name"), F.lit("a").alias("platform"))
    s = _t(spark, sf_dir, "supplier").select(res("s", "s_suppkey").alias("id"), F.concat(F.lit("Dr. Member "), F.regexp_replace("s_name", "[^0-9]", "")).alias("name"), F.lit("b").alias("platform"))
    return c.unionByName(s)


@query("""
SELECT '{R}c_' || c_custkey AS a, '{R}s_' || s_suppkey AS b, 'a' AS platform_a, 'b' AS platform_b, CAST(1.0 AS DOUBLE) AS similarity, 'sameAs' AS relation
FROM customer JOIN supplier ON regexp_replace(c_name, '[^0-9]', '', 'g') = regexp_replace(s_name, '[^0-9]', '', 'g')
""")
def participant_resolution(spark, sf_dir):
    return L.resolve_participants(_people(spark, sf_dir))


@query("""
SELECT n_name AS process, '{R}c_' || c_custkey AS a, '{R}s_' || s_suppkey AS b FROM customer JOIN supplier ON regexp_replace(c_name, '[^0-9]', '', 'g') = regexp_replace(s_name, '[^0-9]', '', 'g') JOIN nation ON n_nationkey = c_nationkey
""")
def cross_platform_links(spark, sf_dir):
    people = _people(spark, sf_dir)
    pairs = L.resolve_participants(people).where("relation = 'sameAs'").select(F.col("a").alias("source"), F.col("b").alias("target"))
    if spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        pairs = pairs.checkpoint()  # the graph scans the pairs once a pattern
    e = M.Entities({"participant": people}, {"same_as": pairs})
    linked = sparql(M.to_triples(e, "people"), "SELECT ?a ?b WHERE { ?a owl:sameAs ?b ; del:platform ?x . ?b del:platform ?y FILTER(?x != ?y) }")
    home = _t(spark, sf_dir, "customer").select(res("c", "c_custkey").alias("a"), "c_nationkey").join(F.broadcast(_t(spark, sf_dir, "nation")), F.col("c_nationkey") == F.col("n_nationkey"))
    return values(linked).join(home, "a").select(F.col("n_name").alias("process"), "a", "b")


def _topic_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "part").groupBy(F.concat_ws(" ", "p_name", F.lower("p_type"), F.concat(F.lit("size"), F.col("p_size").cast("string"))).alias("name")).agg(F.min("p_partkey").cast("string").alias("id"))


TOPIC_SQL = """
WITH d AS (SELECT CAST(min(p_partkey) AS VARCHAR) AS id, p_name || ' ' || lower(p_type) || ' size' || p_size AS name FROM part GROUP BY 2),
t AS (SELECT id, name, list_distinct(list_filter(regexp_split_to_array(regexp_replace(lower(name), '[^a-z0-9_ ]', '', 'g'), ' +'),
  lambda w: len(w) > 2 AND NOT list_contains([STOPS], w))) AS w FROM d WHERE length(name) > 5),
u AS (SELECT id, name, len(w) AS n, unnest(w) AS k FROM t),
h AS (SELECT a.id AS i, b.id AS j, length(a.name) AS li, length(b.name) AS lj, a.n AS na, b.n AS nb, count(*) AS c FROM u a JOIN u b ON a.k = b.k AND a.id < b.id GROUP BY ALL),
s AS (SELECT *, CAST(c AS DOUBLE) / (na + nb - c) AS jaccard FROM h WHERE CAST(c AS DOUBLE) / (na + nb - c) >= 0.4)
SELECT CASE WHEN li > lj THEN i ELSE j END AS a, CASE WHEN li > lj THEN j ELSE i END AS b, jaccard, 'broader' AS relation FROM s WHERE jaccard >= 0.7
UNION ALL SELECT CASE WHEN li > lj THEN j ELSE i END, CASE WHEN li > lj THEN i ELSE j END, jaccard, 'narrower' FROM s WHERE jaccard >= 0.7
UNION ALL SELECT i, j, jaccard, 'related' FROM s WHERE jaccard < 0.7 UNION ALL SELECT j, i, jaccard, 'related' FROM s WHERE jaccard < 0.7
""".replace("STOPS", ", ".join(f"'{w}'" for w in X.TOPIC_STOP_WORDS))


@query(TOPIC_SQL)
def topic_relations(spark, sf_dir):
    return L.relate_topics(_topic_names(spark, sf_dir))


@query(f"SELECT relation, count(*) AS n FROM ({TOPIC_SQL}) GROUP BY relation")
def topic_relation_counts(spark, sf_dir):
    return L.relate_topics(_topic_names(spark, sf_dir)).groupBy("relation").agg(F.count(F.lit(1)).alias("n"))


@query("""
WITH t AS (SELECT CAST(min(p_partkey) AS VARCHAR) AS id, p_brand AS process, lower(p_name) AS n FROM part WHERE p_name IS NOT NULL GROUP BY 2, 3)
SELECT a.id AS a, b.id AS b, a.process AS process_a, b.process AS process_b FROM t a JOIN t b ON a.process <> b.process AND (contains(a.n, b.n) OR contains(b.n, a.n)) WHERE a.n <> '' AND b.n <> ''
""")
def similar_topics(spark, sf_dir):
    names = _t(spark, sf_dir, "part").groupBy(F.lower("p_name").alias("name"), F.col("p_brand").alias("process")).agg(F.min("p_partkey").cast("string").alias("id"))
    return L.similar_topics(names)


@query("SELECT s_name AS name, count(DISTINCT c_nationkey) AS n FROM supplier JOIN lineitem ON l_suppkey = s_suppkey JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey GROUP BY s_suppkey, s_name HAVING count(DISTINCT c_nationkey) > 1")
def multi_process_participants(spark, sf_dir):
    home = _t(spark, sf_dir, "orders").select("o_orderkey", "o_custkey").join(_t(spark, sf_dir, "customer").select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "c_nationkey")
    seen = _t(spark, sf_dir, "lineitem").select("l_suppkey", "l_orderkey").join(home, F.col("l_orderkey") == F.col("o_orderkey")).groupBy("l_suppkey").agg(F.count_distinct("c_nationkey").alias("n")).where("n > 1")
    return seen.join(_t(spark, sf_dir, "supplier"), F.col("l_suppkey") == F.col("s_suppkey")).select(F.col("s_name").alias("name"), "n")


@query(f"""
WITH f AS (SELECT 'processes' AS "check", 1 AS least, (SELECT count(DISTINCT n_nationkey) FROM nation) AS n UNION ALL SELECT 'participants', 10, (SELECT count(*) FROM customer) + (SELECT count(*) FROM supplier)
UNION ALL SELECT 'contributions', 10, (SELECT count(DISTINCT o_orderkey) FROM orders) UNION ALL SELECT 'cross_platform_links', 1, (SELECT count(*) FROM {LINKS_SQL}) UNION ALL SELECT 'topic_relations', 0, 0
UNION ALL SELECT 'cross_platform_participants', 0, (SELECT count(*) FROM {LINKS_SQL}) UNION ALL SELECT 'linked_contributions', 0, (SELECT count(*) FROM {LINKS_SQL} JOIN orders ON o_custkey = c_custkey))
SELECT "check", CAST(n AS BIGINT) AS found, least AS expected_min, n >= least AS passed FROM f""")
def graph_validation(spark, sf_dir):
    return A.validate(_linked_people(spark, sf_dir))


SPACES_SQL = """
WITH p AS (SELECT o_orderkey AS id, o_orderpriority AS sp, nullif(o_orderstatus, 'O') AS cat, 'c' || o_custkey AS a, 'C' || o_custkey AS who FROM orders),
m AS (SELECT s_suppkey AS id, sp FROM supplier JOIN (SELECT DISTINCT sp FROM p) ON sp = CASE WHEN s_nationkey % 2 = 0 THEN '5-LOW' ELSE 'elsewhere' END),
b AS (SELECT 'proposal_' || id AS id, sp, a, who, cat, CAST(NULL AS VARCHAR) AS parent FROM p
UNION ALL SELECT 'meeting_' || id, sp, NULL, NULL, 'P', NULL FROM m
UNION ALL SELECT 'comment_' || l_orderkey || '_' || l_linenumber, sp, 's' || l_suppkey, CASE WHEN l_linestatus = 'F' THEN 'S' || l_suppkey END, NULL, 'proposal_' || l_orderkey FROM lineitem JOIN p ON id = l_orderkey
UNION ALL SELECT 'comment_e' || event_id, sp, 'u' || user_id, 'U' || user_id, NULL, 'meeting_' || id FROM events JOIN m ON id = user_id),
n AS (SELECT DISTINCT sp, a FROM b WHERE who IS NOT NULL), t AS (SELECT DISTINCT sp, cat FROM p WHERE cat IS NOT NULL), d AS (SELECT '{R}decidim_' AS d)
SELECT 'has_contribution' AS link, d || 'process_' || sp AS source, d || id AS target FROM b, d
UNION SELECT 'has_participant', d || 'process_' || sp, d || 'participant_' || a FROM n, d
UNION SELECT 'made_by', d || id, d || 'participant_' || a FROM b JOIN n USING (sp, a), d
UNION SELECT 'response_to', d || id, d || parent FROM b, d WHERE parent IS NOT NULL
UNION SELECT 'has_topic', d || 'process_' || sp, d || 'topic_' || cat FROM t, d
UNION SELECT 'has_topic', d || id, d || 'topic_' || cat FROM b JOIN t USING (sp, cat), d"""


@query(SPACES_SQL)
def space_links(spark, sf_dir):
    """Orders as proposals, suppliers as meetings, line items and events as comments to them."""
    t = lambda name, **cols: _t(spark, sf_dir, name).selectExpr(*[f"{c} AS `{n}`" for n, c in cols.items()])
    space = "participatory_space/id"
    proposals = t("orders", id="o_orderkey", **{space: "o_orderpriority", "category/id": "nullif(o_orderstatus, 'O')", "category/name/es": "'Status ' || o_orderstatus", "author/id": "'c' || o_custkey", "author/name": "'C' || o_custkey", "title/ca": "'Order ' || o_orderkey"})
    meetings = t("supplier", id="s_suppkey", **{space: "if(s_nationkey % 2 = 0, '5-LOW', 'elsewhere')", "category/id": "'P'", "title/en": "s_name"})
    answers = t("lineitem", id="l_orderkey || '_' || l_linenumber", commentable_id="l_orderkey", body="l_returnflag", **{"author/id": "'s' || l_suppkey", "author/name": "if(l_linestatus = 'F', 'S' || l_suppkey, null)"})
    remarks = t("events", id="'e' || event_id", commentable_id="user_id", body="event_type", **{"author/id": "'u' || user_id", "author/name": "'U' || user_id"})
    e = decidim_spaces(proposals, meetings, answers, remarks)
    return reduce(DataFrame.unionByName, [df.select(F.lit(k).alias("link"), "source", "target") for k, df in e.links.items()])


def _turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "conversations").select(F.col("conv_id").alias("process"), F.concat_ws("_", "conv_id", "turn").alias("contribution"), F.col("turn").alias("timestamp"), "role", "text")


@query("WITH w AS (SELECT conv_id, turn, lag(turn) OVER (PARTITION BY conv_id ORDER BY turn) AS b FROM conversations) SELECT conv_id AS process, conv_id || '_' || turn AS source, conv_id || '_' || b AS target FROM w WHERE b IS NOT NULL")
def temporal_chain(spark, sf_dir):
    return L.temporal_chain(_turns(spark, sf_dir))


@query("SELECT a.conv_id AS process, a.conv_id || '_' || a.turn AS first, b.conv_id || '_' || b.turn AS second FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND a.turn < b.turn")
def temporal_pairs(spark, sf_dir):
    return L.temporal_pairs(_turns(spark, sf_dir))


@query("SELECT conv_id || '_' || (turn - 1) AS contribution, count(*) AS n FROM (SELECT DISTINCT conv_id, turn FROM conversations) c WHERE EXISTS (SELECT 1 FROM conversations b WHERE b.conv_id = c.conv_id AND b.turn = c.turn - 1) GROUP BY ALL")
def most_answered(spark, sf_dir):
    t = _turns(spark, sf_dir)
    return A.most_answered(L.temporal_chain(t).select("source", "target"))


@query("""WITH w AS (SELECT conv_id, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn, text NULLS FIRST) AS k FROM conversations)
SELECT conv_id AS process, count(*) AS n, coalesce(string_agg(text, ' | ' ORDER BY k) FILTER (WHERE k <= 3), '') AS samples FROM w GROUP BY conv_id""")
def conversation_samples(spark, sf_dir):
    return A.group_samples(_turns(spark, sf_dir), "process", ["timestamp"], F.col("text")).withColumn("samples", F.array_join("samples", " | "))


@query("SELECT conv_id AS process, role AS participant, row_number() OVER (PARTITION BY conv_id ORDER BY min(turn), role) AS n FROM conversations GROUP BY conv_id, role")
def surrogate_ids(spark, sf_dir):
    return A.surrogate_ids(_turns(spark, sf_dir).withColumnRenamed("role", "participant"), "process", "participant", "timestamp").select("process", "participant", F.col("n").cast("bigint"))


@query("SELECT conv_id AS process, role, text FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id, role ORDER BY turn) = 1")
def first_wins(spark, sf_dir):
    return A.first_wins(_turns(spark, sf_dir), ["process", "role"], ["timestamp"]).select("process", "role", "text")


@query(r"SELECT doc_id, trim(regexp_replace(text, '[ \t\n\x0B\f\r]+', ' ', 'g')) AS text FROM documents")
def text_clean(spark, sf_dir):
    return _t(spark, sf_dir, "documents").select("doc_id", X.collapse(F.col("text")).alias("text"))


@query(r"SELECT page_id, trim(regexp_replace(regexp_replace(html, '<[^>]+>', ' ', 'g'), '[ \t\n\x0B\f\r]+', ' ', 'g')) AS text FROM pages")
def html_strip(spark, sf_dir):
    return _t(spark, sf_dir, "pages").select("page_id", X.clean_html(F.col("html")).alias("text"))


KEYWORD_SQL = r"""
WITH k AS (SELECT doc_id, list_filter(regexp_extract_all(lower(regexp_replace(text, '[^A-Za-z ]', ' ', 'g')), '\b([a-z]{4,})\b', 1), lambda w: NOT list_contains([STOPS], w)) AS w FROM documents),
u AS (SELECT doc_id, unnest(w) AS keyword, generate_subscripts(w, 1) AS pos FROM k), g AS (SELECT doc_id, keyword, count(*) AS n, min(pos) AS f FROM u GROUP BY ALL)
SELECT doc_id AS id, keyword, n, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, f) AS INT) AS rank FROM g WHERE n > 1 QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, f) <= 5
""".replace("STOPS", ", ".join(f"'{w}'" for w in X.KEYWORD_STOP_WORDS))


@query(KEYWORD_SQL)
def keyword_frequency(spark, sf_dir):
    plain = F.regexp_replace("text", "[^A-Za-z ]", " ")  # the common subset of the regular expression dialects
    return L.frequent_keywords(_t(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text"), text=plain)


TAG_SQL = "WITH t AS (SELECT doc_id AS id, list_filter([" + ", ".join(f"CASE WHEN {' OR '.join(f"contains(lower(text), '{k}')" for k in v)} THEN '{n}' END" for n, v in X.TOPIC_KEYWORDS.items()) + "], lambda x: x IS NOT NULL)[1:3] AS l FROM documents) SELECT id, unnest(l) AS topic FROM t"


@query(TAG_SQL)
def topic_tags(spark, sf_dir):
    return L.tag_topics(_t(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text"))


@query("""
WITH c AS (SELECT doc_id AS id, lower(text) AS t FROM documents WHERE contains(lower(text), 'that ') OR contains(lower(text), 'with '))
SELECT id, CASE WHEN contains(t, 'that ') THEN substr(substr(t, instr(t, 'that ') + 5), 1, 100) END AS premise, CASE WHEN contains(t, 'that ') THEN substr(substr(t, 1, instr(t, 'that ') - 1), 1, 100) END AS conclusion FROM c
""")
def argument_mining(spark, sf_dir):
    return L.mine_arguments(_t(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text"), ("that ", "with "), "that ").select("id", "premise", "conclusion")


def _flagged(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    docs = _t(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("lang").alias("process"), F.col("source").alias("participant"), "text")
    bad = _t(spark, sf_dir, "labels").where("toxic = 1").select(F.col("doc_id").alias("contribution"), F.when(F.col("quality") == 1, "toxic").otherwise("toxic junk").alias("type"), F.lit("").alias("segment"), F.lit(1.0).alias("confidence"))
    return docs, bad


@query("""
WITH f AS (SELECT DISTINCT doc_id FROM labels WHERE toxic = 1)
SELECT count(*) AS total, count(f.doc_id) AS with_fallacies, CASE WHEN count(*) > 0 THEN CAST(count(f.doc_id) AS DOUBLE) / count(*) * 100 ELSE 0.0 END AS percentage FROM documents d LEFT JOIN f ON f.doc_id = d.doc_id
""")
def fallacy_stats(spark, sf_dir):
    return A.fallacy_stats(*_flagged(spark, sf_dir))


@query("SELECT CASE WHEN quality = 1 THEN 'toxic' ELSE 'toxic junk' END AS type, count(*) AS n FROM labels WHERE toxic = 1 GROUP BY 1")
def fallacies_by_type(spark, sf_dir):
    return A.fallacies_by_type(_flagged(spark, sf_dir)[1])


@query("SELECT source AS participant, count(*) AS n FROM labels JOIN documents USING (doc_id) WHERE toxic = 1 GROUP BY 1 ORDER BY n DESC, participant LIMIT 10")
def most_fallacious(spark, sf_dir):
    return A.most_fallacious(*_flagged(spark, sf_dir))


@query("""
WITH f AS (SELECT DISTINCT doc_id FROM labels WHERE toxic = 1)
SELECT lang AS process, count(*) AS total, count(f.doc_id) AS with_fallacies, count(*) FILTER (f.doc_id IS NOT NULL) AS listed FROM documents d LEFT JOIN f ON f.doc_id = d.doc_id GROUP BY 1
""")
def fallacy_report(spark, sf_dir):
    r = A.fallacy_report(*_flagged(spark, sf_dir))
    return r.select("process", "total", "with_fallacies", F.coalesce(F.size("fallacies_by_contribution"), F.lit(0)).cast("bigint").alias("listed"))


@query("SELECT event_id, user_id, event_type, value FROM (SELECT * FROM events WHERE event_type <> 'click' UNION ALL SELECT event_id, ts, user_id, 'press' AS event_type, value, props FROM events WHERE event_type = 'click')")
def upsert_latest(spark, sf_dir):
    e = _t(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value")
    return A.upsert(e, e.where("event_type = 'click'").withColumn("event_type", F.lit("press")), ["event_id"])


def _event_graph(events: DataFrame) -> DataFrame:
    return branch(events, res("user", "user_id"), T.DEL + "did", F.col("event_type"))


@query("SELECT DISTINCT '{R}user_' || user_id AS s, '{D}did' AS p, event_type AS o FROM events")
def graph_union(spark, sf_dir):
    e = _t(spark, sf_dir, "events")
    return T.graph(_event_graph(e.where("event_type <> 'view'")), _event_graph(e)).select("s", "p", "o")


@query("SELECT DISTINCT '{R}user_' || user_id AS s, event_type AS o FROM events WHERE event_type = 'purchase'")
def added_triples(spark, sf_dir):
    e = _t(spark, sf_dir, "events")
    return T.added(T.graph(_event_graph(e.where("event_type <> 'purchase'"))), T.graph(_event_graph(e))).select("s", "o")


INGEST_SQL = """
WITH e AS (SELECT 'https://example.org/ingest/' AS b, 'https://example.org/ingest/point-' || event_id AS me, 'https://example.org/ingest/user-' || user_id AS u, event_type AS x, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS t, CASE WHEN value > 50 THEN 1 ELSE -1 END AS v FROM events)
SELECT me AS s, 'http://www.w3.org/1999/02/22-rdf-syntax-ns#type' AS p, '{D}Contribution' AS o FROM e UNION SELECT me, 'http://www.w3.org/1999/02/22-rdf-syntax-ns#type', '{D}Argument' FROM e
UNION SELECT me, '{D}platform', 'Your Priorities' FROM e UNION SELECT me, '{D}text', x FROM e UNION SELECT me, '{D}hasTimestamp', t FROM e
UNION SELECT u, 'http://www.w3.org/1999/02/22-rdf-syntax-ns#type', '{D}Participant' FROM e UNION SELECT me, '{D}madeBy', u FROM e
UNION SELECT b || 'post-1', 'http://www.w3.org/1999/02/22-rdf-syntax-ns#type', '{D}Topic' FROM e UNION SELECT me, '{D}isAbout', b || 'post-1' FROM e UNION SELECT me, CASE WHEN v = 1 THEN '{D}supports' ELSE '{D}attacks' END, b || 'post-1' FROM e
"""


def _ingest_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _t(spark, sf_dir, "events")
    c = lambda x, t: F.lit(x).cast(t)
    return e.select(
        F.concat(F.lit("point-"), "event_id").alias("contribution_id"), F.col("event_type").alias("text"), F.date_format("ts", STAMP).alias("timestamp"), "user_id", c(None, "string").alias("user_name"), c(1, "bigint").alias("post_id"),
        c(None, "string").alias("post_name"), c(None, "bigint").alias("group_id"), c(None, "string").alias("group_name"), F.when(F.col("value") > 50, 1).otherwise(-1).alias("value"), c(None, "bigint").alias("parent_point_id"),
        c(None, "array<struct<type:string,score:double,rationale:string>>").alias("fallacies"),
    )


@query(INGEST_SQL)
def ingest_triples(spark, sf_dir):
    return T.graph(I.ingest(dealt(_ingest_events(spark, sf_dir), "contribution_id"))).select("s", "p", "o")


@query(INGEST_SQL)
def versioned_ingest(spark, sf_dir):
    """Two batches of events and a replay of the first, as versions of a graph."""
    root = _folder(spark, "versions")
    events = _ingest_events(spark, sf_dir)
    part = F.pmod(F.xxhash64("contribution_id"), F.lit(2))
    for batch, which in enumerate((0, 1, 0)):
        I.ingest_batch(events.where(part == which), root, "events", batch, buckets=4)
    return Versions(spark, f"{root}/graph").read().select("s", "p", "o")


@query("SELECT time_bucket(INTERVAL '1 day', ts) AS start, event_type, count(*) AS n FROM events GROUP BY ALL")
def events_tumbling(spark, sf_dir):
    return I.windowed(_t(spark, sf_dir, "events"), ["event_type"], "1 day").select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n")


@query("WITH w AS (SELECT unnest([time_bucket(INTERVAL '1 day', ts), time_bucket(INTERVAL '1 day', ts) - INTERVAL '1 day']) AS start, event_type FROM events) SELECT start, event_type, count(*) AS n FROM w GROUP BY ALL")
def events_sliding(spark, sf_dir):
    return I.windowed(_t(spark, sf_dir, "events"), ["event_type"], "2 days", "1 day").select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n")


@query("""
WITH o AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) <= INTERVAL '6 hours' THEN 0 ELSE 1 END AS new FROM events),
s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM o)
SELECT min(ts) AS start, user_id, count(*) AS n FROM s GROUP BY user_id, k
""")
def events_session(spark, sf_dir):
    return I.sessions(_t(spark, sf_dir, "events"), ["user_id"], "6 hours").select(F.col("start").cast("timestamp_ntz").alias("start"), "user_id", "n")


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE)
