"""Operator 8, mixing sources to target weights along a time-varying curriculum.

Sources in code point order (null last) weigh 5, 2, 1, repeating, and share BUDGET times all words. A source's target
stops at MAX_EPOCHS times its size; the excess goes to the others by weight. With the sources sorted by cap / weight that
fixed point is a single level: those before the first source whose share fits are capped, the rest get weight x level.

A source runs through its documents in a keyed order (MD5 of the id), again and again until its target is reached; the document
at the boundary is taken in part (or, with split_boundary=False, as a whole if at least half of it fits). The word offset of a
copy in this run, over the target, is the share y of the source's demand that comes before it. The weight of a source over training time t in [0, 1] is
1 + g * (2t - 1), g by weight class; its integral (1 - g) t + g t**2 is inverted in closed form to give the copy's position.

Running sums are two-level: buckets of the keyed order are summed first, so a hot source is spread over many tasks, and the
window runs inside a bucket only. The source table has a row a source.

Null text is size 0. A document of size 0 is never taken. Repeated rows are separate copies of a document. Ties in the keyed order (a repeated or null doc_id) are
broken by id, size and a hash of the row; rows that are equal in all of them are interchangeable. A very long text is one document of its size, read once. An empty table gives an empty
result. `mix_plan` and `training_order` leave other columns out; `mixed` keeps them, whatever their names.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._store import free_shuffles, fresh, materialize, release

WEIGHTS = (5, 2, 1)
SLOPES = (-0.5, 0.0, 0.5)
BUDGET = 1.5
MAX_EPOCHS = 2
#: Documents of the largest source that one bucket holds on average.
BUCKET_ROWS = 1_000


def words_in(text: str) -> Column:
    return F.size(F.filter(F.split(F.coalesce(F.col(text), F.lit("")), "[ \\t\\n\\x0B\\f\\r]+"), lambda w: w != "")).cast("long")


def source_targets(sized: DataFrame) -> DataFrame:
    """A row a source: sid (rank), source, source_size, rows, slope, target."""
    per = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("rows"))
    # Windows without a partition: the table has one row a source.
    order = Window.orderBy(F.col("source").asc_nulls_last())
    pick = lambda values: F.element_at(F.array(*map(F.lit, values)), (F.col("sid") - 1) % len(values) + 1)
    ranked = per.withColumn("sid", F.row_number().over(order)).withColumns({"weight": pick(WEIGHTS), "slope": pick(SLOPES), "cap": F.col("source_size") * MAX_EPOCHS})
    by_fill = Window.orderBy(F.col("cap") / F.col("weight"), "sid")
    before = by_fill.rowsBetween(Window.unboundedPreceding, -1)
    after = by_fill.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    every = Window.partitionBy()
    level = (F.sum("source_size").over(every) * BUDGET - F.coalesce(F.sum("cap").over(before), F.lit(0))) / F.sum("weight").over(after)
    filled = ranked.withColumn("fill", F.row_number().over(by_fill)).withColumn("level", level)
    fits = F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.struct("fill", "level"))
    first = filled.withColumn("first", F.min(fits).over(every))
    target = F.when(F.col("first").isNull() | (F.col("fill") < F.col("first.fill")), F.col("cap").cast("double")).otherwise(F.col("first.level") * F.col("weight"))
    return first.select("sid", "source", "source_size", "rows", "slope", target.alias("target"))


def identity(documents: DataFrame) -> Column:
    """128 bits of all columns (maps excepted, which have no hash): rows that differ in any of them are told apart."""
    columns = [f"`{c}`" for c, kind in documents.dtypes if "map<" not in kind]
    return F.struct(F.xxhash64(*columns).alias("a"), F.xxhash64(F.lit(1), *columns).alias("b"))


def mix_plan(documents: DataFrame, split_boundary: bool = True) -> DataFrame:
    """A row a document row: doc_id, row (a hash of all columns), size, source_size, target, taken, copies array<struct<position, words>>."""
    sized = materialize(documents.select("doc_id", "source", identity(documents).alias("row"), words_in("text").alias("size")), "sizes")
    targets = materialize(source_targets(sized), "targets")
    most = targets.agg(F.max("rows")).first()[0] or 0
    digits = 0
    while 16**digits * BUCKET_ROWS < most and digits < 8:
        digits += 1
    key = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    named = targets.withColumnRenamed("source", "target_source")
    rows = sized.join(named, F.col("source").eqNullSafe(F.col("target_source"))).select(
        "doc_id", "row", "size", "sid", "source_size", "target", "slope", key.alias("key"), F.substring(key, 1, digits).alias("bucket")
    )
    inside = Window.partitionBy("sid", "bucket").orderBy("key", "doc_id", "size", "row").rowsBetween(Window.unboundedPreceding, -1)
    sums = rows.groupBy("sid", "bucket").agg(F.sum("size").alias("bucket_size"))
    ahead = Window.partitionBy("sid").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select("sid", "bucket", F.coalesce(F.sum("bucket_size").over(ahead), F.lit(0)).alias("ahead"))
    placed = rows.join(offsets, ["sid", "bucket"]).withColumn("start", F.col("ahead") + F.coalesce(F.sum("size").over(inside), F.lit(0)))
    whole = F.floor("target").cast("long")
    full = F.when(F.col("source_size") > 0, F.expr("CAST(floor(target) AS BIGINT) DIV source_size")).otherwise(0)
    placed = placed.withColumns({"whole": whole, "full": full}).withColumn("rest", F.col("whole") - F.col("full") * F.col("source_size"))
    part = F.greatest(F.least(F.col("rest") - F.col("start"), F.col("size")), F.lit(0))
    if not split_boundary:
        part = F.when(part * 2 >= F.col("size"), F.col("size")).otherwise(F.lit(0).cast("long"))
    placed = placed.withColumn("part", part)
    g = F.col("slope")

    def position(copy: Column) -> Column:
        y = F.least((copy * F.col("source_size") + F.col("start")) / F.col("whole"), F.lit(1.0))
        return 2 * y / ((1 - g) + F.sqrt((1 - g) * (1 - g) + 4 * g * y))

    everyone = F.transform(
        F.sequence(F.lit(0).cast("long"), F.col("full")),
        lambda c: F.struct(position(c).alias("position"), F.when(c < F.col("full"), F.col("size")).otherwise(F.col("part")).alias("words")),
    )
    copies = F.when(F.col("whole") > 0, F.filter(everyone, lambda x: x["words"] > 0)).otherwise(F.filter(everyone, lambda x: F.lit(False)))
    return placed.select("doc_id", "row", "size", "source_size", "target", (F.col("full") * F.col("size") + F.col("part")).alias("taken"), copies.alias("copies"))


def training_order(plan: DataFrame) -> DataFrame:
    """The mix itself: a row a copy, range-sorted by training position."""
    return plan.select("doc_id", F.inline("copies")).orderBy("position", "doc_id")


def mixed(documents: DataFrame) -> DataFrame:
    """The documents of the mix, a row a copy, range-sorted by training position; whole documents only. Columns as in `documents`."""
    plan = stored = materialize(mix_plan(documents, split_boundary=False).where(F.size("copies") > 0).select("row", F.col("copies.position").alias("positions")), "plan")
    row, positions, position = (fresh(documents.columns, x) for x in ("mixed_row", "mixed_positions", "mixed_position"))
    texts = documents.withColumn(row, identity(documents))
    if plan.groupBy("row").count().where("count > 1").limit(1).count():  # equal rows: any of them stands for all, with all their copies
        plan = plan.select("row", F.explode("positions").alias("position")).groupBy("row").agg(F.sort_array(F.collect_list("position")).alias("positions"))
        texts = texts.dropDuplicates([row])
    plan = plan.select(F.col("row").alias(row), F.col("positions").alias(positions))
    joined = materialize(texts.join(plan, row).select(*documents.columns, positions), "mixed")
    release(stored)
    free_shuffles(documents.sparkSession)
    copies = joined.select(*documents.columns, F.explode(positions).alias(position))
    return copies.orderBy(position, "doc_id").select(*documents.columns)


#: Files whose row counts are broadcast when places are told from them.
MANY_FILES = 100_000


def read_positions(stored: DataFrame, name: str = "position") -> DataFrame:
    """Rows of a mix that was written and read back, with their place in training order (0, 1, ...) as `name`.

    A range-sorted table is written a file a range, numbered in order, and a scan takes files in any order: the place is the rows in files before, and the row's number in its own. A table that was
    not read from files, or is no plain scan of them, has lost its order: null places."""
    name = fresh(stored.columns, name)
    try:
        placed = stored.select("*", F.col("_metadata.file_name").alias(f"{name}_file"), F.col("_metadata.row_index").alias(f"{name}_row"))
    except AnalysisException:
        return stored.withColumn(name, F.lit(None).cast("long"))
    number = lambda pattern: F.regexp_extract(f"{name}_file", pattern, 1).try_cast("long")
    files = placed.groupBy(f"{name}_file").agg(F.count(F.lit(1)).alias(f"{name}_rows"))
    before = Window.orderBy(number(r"part-(\d+)"), number(r"-c(\d+)"), f"{name}_file").rowsBetween(Window.unboundedPreceding, -1)
    ahead = files.select(f"{name}_file", F.coalesce(F.sum(f"{name}_rows").over(before), F.lit(0)).alias(f"{name}_ahead"))  # a row a file
    if len(stored.inputFiles()) <= MANY_FILES:
        ahead = F.broadcast(ahead)
    return placed.join(ahead, f"{name}_file").select(*stored.columns, (F.col(f"{name}_ahead") + F.col(f"{name}_row")).alias(name))


ORACLE_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size, md5(CAST(doc_id AS VARCHAR)) AS key FROM documents
), per AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS sid FROM sized GROUP BY source
), ranked AS (
  SELECT *, [5, 2, 1][CAST((sid - 1) % 3 + 1 AS INT)] AS weight, [-0.5::DOUBLE, 0.0::DOUBLE, 0.5::DOUBLE][CAST((sid - 1) % 3 + 1 AS INT)] AS slope, 2 * source_size AS cap FROM per
), filled AS (
  SELECT *, row_number() OVER (ORDER BY cap::DOUBLE / weight, sid) AS fill,
    (CAST(sum(source_size) OVER () AS DOUBLE) * 1.5::DOUBLE - CAST(coalesce(sum(cap) OVER (ORDER BY cap::DOUBLE / weight, sid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE))
      / CAST(sum(weight) OVER (ORDER BY cap::DOUBLE / weight, sid ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS DOUBLE) AS level
  FROM ranked
), cut AS (SELECT min(fill) AS k FROM filled WHERE level * weight <= cap),
targets AS (
  SELECT f.source, f.source_size, f.slope, CASE WHEN c.k IS NULL OR f.fill < c.k THEN CAST(f.cap AS DOUBLE) ELSE (SELECT level FROM filled, cut WHERE fill = k) * f.weight END AS target
  FROM filled f, cut c
), placed AS (
  SELECT s.doc_id, s.size, t.source_size, t.target, t.slope, CAST(floor(t.target) AS BIGINT) AS whole,
    CASE WHEN t.source_size > 0 THEN CAST(floor(t.target) AS BIGINT) // t.source_size ELSE 0 END AS full_runs,
    CAST(coalesce(sum(s.size) OVER (PARTITION BY s.source ORDER BY key, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source
), taken AS (
  SELECT *, greatest(least(whole - full_runs * source_size - start, size), 0) AS part FROM placed
), shares AS (
  SELECT *, full_runs * size + part AS taken, least(CAST(start AS DOUBLE) / whole, 1.0::DOUBLE) AS y FROM taken
)
SELECT doc_id, size, source_size, target, taken,
  CAST(CASE WHEN size > 0 THEN full_runs + CASE WHEN part > 0 THEN 1 ELSE 0 END ELSE 0 END AS INT) AS n_copies,
  CASE WHEN taken > 0 THEN 2 * y / ((1 - slope) + sqrt((1 - slope) * (1 - slope) + 4 * slope * y)) END AS first_position
FROM shares
"""
