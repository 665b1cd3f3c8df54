"""Operator 1, quality rules with adaptive thresholds. DataFrame functions only.

The sketch of a metric in a (lang, source) group is a log-linear histogram: a non-negative integer value falls
into the bucket (bit length, next SUB_BITS bits), so a bucket is at most 2**-SUB_BITS wide relative to its value.
Sketches merge by adding counts, which is what Spark's partial aggregation does, and the result is the same
in every run and for every split of the input. A quantile is the lower end of the bucket that holds its rank.

A document is kept if no metric lies outside its group's fence q75 + FENCE * max(q75 - q25, slack) (or the
same below q25 for two-sided metrics). The slack of each metric keeps a group of very even documents from losing
its ordinary members. A group of fewer than MIN_GROUP documents takes the fence of its language, and one of a
small language that of all documents.

Null text counts as empty; an empty text fails the base rules. Null lang or source is a group of its own. Repeated rows
are judged row by row. There are no ties: a value on a fence is inside. A very long text is measured whole. An empty table gives an empty result. Extra columns are ignored; names are read only
from `doc_id`, `text`, `lang` and `source`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._store import materialize

SPACE = "[ \\t\\n\\x0B\\f\\r]"
SUB_BITS = 5
FENCE = 3.0
MIN_GROUP = 50
#: Integer metrics: per mille, or hundredths of a character for word length; the slack in the same unit; two-sided or upper only.
METRICS = {
    "mean_word": (150, True),
    "symbols": (20, False),
    "dup_lines": (120, False),
    "repeats": (100, False),
}


def bind(value: Column, use) -> Column:
    """use(value), where value is computed once although `use` names it often, even inside lambdas."""
    return F.element_at(F.transform(F.array(value), use), 1)


def text_measures(df: DataFrame) -> DataFrame:
    """doc_id, lang, source and the counts n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of each row's whole text.

    Each count comes from a narrow projection; the word array is built once a row and no row leaves its task."""
    text = F.coalesce(F.col("text"), F.lit(""))
    words = F.filter(F.split(text, f"{SPACE}+"), lambda w: w != "")
    lines = F.filter(F.split(text, "\n"), lambda x: F.regexp_replace(x, SPACE, "") != "")

    def covered(w: Column) -> Column:
        """Words in a window of three that occurs twice or more: equal windows are neighbours after sorting."""
        n = F.size(w)
        grams = F.arrays_zip(
            F.transform(
                F.sequence(F.lit(1), n - 2),
                lambda i: F.concat_ws(" ", F.get(w, i - 1), F.get(w, i), F.get(w, i + 1)),
            ).alias("g"),
            F.sequence(F.lit(1), n - 2).alias("p"),
        )

        def starts(s: Column) -> Column:
            m = F.size(s)
            same = lambda a, b: F.get(s, a)["g"] == F.get(s, b)["g"]
            hit = F.filter(
                F.sequence(F.lit(0), m - 1),
                lambda i: F.coalesce(F.when(i > 0, same(i, i - 1)), F.lit(False)) | F.coalesce(F.when(i < m - 1, same(i, i + 1)), F.lit(False)),
            )
            return F.transform(hit, lambda i: F.get(s, i)["p"])

        def cover(p: Column) -> Column:
            return F.size(F.array_distinct(F.flatten(F.transform(p, lambda x: F.array(x, x + 1, x + 2)))))

        def count(g: Column) -> Column:
            return F.when(F.size(F.array_distinct(F.transform(g, lambda x: x["g"]))) == F.size(g), F.lit(0)).otherwise(cover(bind(F.sort_array(g), starts)))

        return F.when(n < 3, F.lit(0)).otherwise(bind(grams, count))

    measures = F.struct(
        bind(words, lambda w: F.struct(F.size(w).cast("long").alias("n_words"), covered(w).cast("long").alias("n_repeat_words"))).alias("w"),
        F.length(F.translate(text, " \t\n\x0b\x0c\r", "")).cast("long").alias("word_chars"),
        (F.length(text) - F.length(F.translate(text, "#*$%&|<>", ""))).cast("long").alias("n_symbols"),
        bind(lines, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long")).alias("n_dup_lines"),
        bind(lines, lambda x: F.size(x).cast("long")).alias("n_lines"),
    )
    flat = df.select("doc_id", "lang", "source", measures.alias("m"))
    return flat.select(
        "doc_id", "lang", "source", F.col("m.w.n_words").alias("n_words"), F.col("m.word_chars").alias("word_chars"), F.col("m.n_symbols").alias("n_symbols"),
        F.col("m.n_dup_lines").alias("n_dup_lines"), F.col("m.w.n_repeat_words").alias("n_repeat_words"), F.col("m.n_lines").alias("n_lines"),
    )


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def metric_values() -> dict[str, Column]:
    n, lines = F.greatest(F.col("n_words"), F.lit(1)), F.greatest(F.col("n_lines"), F.lit(1))
    return {
        "mean_word": F.expr("CAST(100 * word_chars AS BIGINT) DIV greatest(n_words, 1)"),
        "symbols": F.expr("1000 * n_symbols DIV greatest(word_chars, 1)"),
        "dup_lines": F.expr("1000 * n_dup_lines DIV greatest(n_lines, 1)"),
        "repeats": F.expr("1000 * n_repeat_words DIV greatest(n_words, 1)"),
    }


def bucket_of(value: Column) -> Column:
    """Order-preserving bucket of a non-negative integer: exact below 2**(SUB_BITS+1), then SUB_BITS bits after the leading one."""
    e = F.length(F.bin(value)) - 1
    shift = F.greatest(e - SUB_BITS, F.lit(0))
    return F.when(value < (1 << (SUB_BITS + 1)), value).otherwise(
        (shift.cast("long") + 1) * (1 << SUB_BITS) + F.call_function("shiftright", value, shift) - (1 << SUB_BITS)
    )


def bucket_floor(bucket: Column) -> Column:
    """The least value of a bucket."""
    shift = F.greatest(F.floor(bucket / (1 << SUB_BITS)) - 1, F.lit(0)).cast("int")
    return F.when(bucket < (1 << (SUB_BITS + 1)), bucket).otherwise(
        F.call_function("shiftleft", (bucket % (1 << SUB_BITS)) + (1 << SUB_BITS), shift)
    )


def sketches(measured: DataFrame, keys: list[str]) -> DataFrame:
    """Mergeable sketches: keys, metric, bucket, n. Rows: at most groups x metrics x buckets (under 2,000 each)."""
    pairs = F.array(*[F.struct(F.lit(k).alias("metric"), bucket_of(v).alias("bucket")) for k, v in metric_values().items()])
    return measured.select(*keys, F.inline(pairs)).groupBy(*keys, "metric", "bucket").agg(F.count(F.lit(1)).alias("n"))


def merge(sketch: DataFrame, keys: list[str]) -> DataFrame:
    return sketch.groupBy(*keys, "metric", "bucket").agg(F.sum("n").alias("n"))


def fences(sketch: DataFrame, keys: list[str]) -> DataFrame:
    """keys, members and one struct of bounds a metric. A group's sketch is one bounded array, so no window is needed."""
    whole = sketch.groupBy(*keys, "metric").agg(F.sort_array(F.collect_list(F.struct("bucket", "n"))).alias("h"), F.sum("n").alias("members"))

    def quantile(q: float) -> Column:
        rank = F.ceil(F.col("members") * q)
        walk = F.aggregate(
            "h", F.struct(F.lit(0).cast("long").alias("seen"), F.lit(None).cast("long").alias("at")),
            lambda a, x: F.struct((a["seen"] + x["n"]).alias("seen"), F.coalesce(a["at"], F.when(a["seen"] + x["n"] >= rank, x["bucket"])).alias("at")),
        )
        return bucket_floor(walk["at"])

    slack = F.create_map(*[F.lit(x) for k, (s, _) in METRICS.items() for x in (k, s)])[F.col("metric")]
    cut = whole.select(*keys, "metric", "members", quantile(0.25).alias("q25"), quantile(0.75).alias("q75"))
    reach = FENCE * F.greatest(F.col("q75") - F.col("q25"), slack)
    bounds = cut.select(*keys, "metric", "members", (F.col("q25") - reach).alias("low"), (F.col("q75") + reach).alias("high"))
    parts = [F.max(F.when(F.col("metric") == k, F.struct("low", "high"))).alias(k) for k in METRICS]
    return bounds.groupBy(*keys).agg(F.max("members").alias("members"), *parts)


def quality_rules(documents: DataFrame, min_group: int = MIN_GROUP) -> DataFrame:
    """doc_id, counts, base_failed, kept and the name of the first failed metric (null if none).

    The counts are computed once and written as a narrow table; the sketches and the joined filter read that table.
    The fences are a row a group; Spark broadcasts them if their measured size allows it and otherwise joins by key,
    splitting hot keys."""
    measured = materialize(text_measures(documents), "measures")
    fine = materialize(sketches(measured, ["lang", "source"]), "sketches")
    by_lang = merge(fine, ["lang"])
    groups, langs = fences(fine, ["lang", "source"]), fences(by_lang, ["lang"])
    total = fences(merge(by_lang, []), [])
    rename = lambda df, tag: df.select(*[F.col(c).alias(f"{tag}_{c}") for c in df.columns])
    # One row a group, then one row for all: scalars reach the small table of groups only.
    g, lang, every = rename(groups, "g"), rename(langs, "l"), rename(total, "t")
    table = g.join(lang, F.col("g_lang").eqNullSafe(F.col("l_lang")), "left").join(F.broadcast(every), F.lit(True), "left")
    chosen = [
        F.when(F.col("g_members") >= min_group, F.col(f"g_{k}")).when(F.col("l_members") >= min_group, F.col(f"l_{k}")).otherwise(F.col(f"t_{k}")).alias(f"fence_{k}")
        for k in METRICS
    ]
    table = table.select("g_lang", "g_source", *chosen)
    joined = measured.join(table, F.col("lang").eqNullSafe(F.col("g_lang")) & F.col("source").eqNullSafe(F.col("g_source")), "left")
    values = metric_values()
    failed = F.lit(None).cast("string")
    for k, (_, both) in reversed(METRICS.items()):
        out = values[k] > F.col(f"fence_{k}.high")
        failed = F.when((out | (values[k] < F.col(f"fence_{k}.low"))) if both else out, F.lit(k)).otherwise(failed)
    bad = base_failed()
    return joined.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", bad.alias("base_failed"),
        (~bad & failed.isNull()).alias("kept"), F.when(bad, "base").otherwise(failed).alias("failed_rule"),
    )


ORACLE_SQL = r"""
WITH b AS (
  SELECT doc_id, lang, source, coalesce(text, '') AS t, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM documents
), g AS (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 1, 1))) AS p FROM b),
k AS (SELECT doc_id, p, count(*) OVER (PARTITION BY doc_id, array_to_string(w[p:p + 2], ' ')) AS c FROM g),
r AS (SELECT doc_id, len(list_distinct(flatten(list([p, p + 1, p + 2])))) AS n FROM k WHERE c > 1 GROUP BY doc_id),
m AS (
  SELECT b.doc_id, lang, source, CAST(len(w) AS BIGINT) AS n_words, CAST(length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars, CAST(length(t) - length(translate(t, '#*$%&|<>', '')) AS BIGINT) AS n_symbols,
    CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, CAST(coalesce(r.n, 0) AS BIGINT) AS n_repeat_words, CAST(len(lines) AS BIGINT) AS n_lines
  FROM b LEFT JOIN r USING (doc_id)
), v AS (
  SELECT *, 100 * word_chars // greatest(n_words, 1) AS mean_word, 1000 * n_symbols // greatest(word_chars, 1) AS symbols, 1000 * n_dup_lines // greatest(n_lines, 1) AS dup_lines, 1000 * n_repeat_words // greatest(n_words, 1) AS repeats FROM m
), u AS (
  SELECT lang, source, x.metric AS metric, x.v AS v FROM (SELECT lang, source, unnest([{'metric': 'mean_word', 'v': mean_word}, {'metric': 'symbols', 'v': symbols}, {'metric': 'dup_lines', 'v': dup_lines}, {'metric': 'repeats', 'v': repeats}]) AS x FROM v)
), k2 AS (SELECT lang, source, metric, v, greatest(length(bin(v)) - 1 - 5, 0) AS sh FROM u),
s AS (SELECT lang, source, metric, CASE WHEN v < 64 THEN v ELSE (sh + 1) * 32 + (v >> sh) - 32 END AS bucket, count(*) AS n FROM k2 GROUP BY ALL),
levels AS (
  SELECT 'g' AS level, lang, source, metric, bucket, sum(n) AS n FROM s GROUP BY ALL UNION ALL SELECT 'l', lang, NULL, metric, bucket, sum(n) FROM s GROUP BY ALL UNION ALL SELECT 't', NULL, NULL, metric, bucket, sum(n) FROM s GROUP BY ALL
), c AS (SELECT *, sum(n) OVER (PARTITION BY level, lang, source, metric ORDER BY bucket) AS seen, sum(n) OVER (PARTITION BY level, lang, source, metric) AS members FROM levels),
q AS (SELECT level, lang, source, metric, max(members) AS members, min(bucket) FILTER (seen >= ceil(members * 0.25)) AS b25, min(bucket) FILTER (seen >= ceil(members * 0.75)) AS b75 FROM c GROUP BY ALL),
f AS (
  SELECT *, CASE WHEN b25 < 64 THEN b25 ELSE CAST(b25 % 32 + 32 AS BIGINT) << CAST(b25 // 32 - 1 AS INT) END AS q25, CASE WHEN b75 < 64 THEN b75 ELSE CAST(b75 % 32 + 32 AS BIGINT) << CAST(b75 // 32 - 1 AS INT) END AS q75,
    CASE metric WHEN 'mean_word' THEN SLACK_MEAN WHEN 'symbols' THEN SLACK_SYMBOLS WHEN 'dup_lines' THEN SLACK_LINES ELSE SLACK_REPEATS END AS slack FROM q
), h AS (SELECT level, lang, source, members, metric, q25 - FENCE * greatest(q75 - q25, slack) AS low, q75 + FENCE * greatest(q75 - q25, slack) AS high FROM f),
o AS (
  SELECT level, lang, source, max(members) AS members, max(low) FILTER (metric = 'mean_word') AS low, max(high) FILTER (metric = 'mean_word') AS mean_word, max(high) FILTER (metric = 'symbols') AS symbols,
    max(high) FILTER (metric = 'dup_lines') AS dup_lines, max(high) FILTER (metric = 'repeats') AS repeats FROM h GROUP BY ALL
), j AS (
  SELECT v.*, CASE WHEN g.members >= 50 THEN g ELSE CASE WHEN l.members >= 50 THEN l ELSE t END END AS x
  FROM v JOIN o g ON g.level = 'g' AND g.lang IS NOT DISTINCT FROM v.lang AND g.source IS NOT DISTINCT FROM v.source JOIN o l ON l.level = 'l' AND l.lang IS NOT DISTINCT FROM v.lang JOIN o t ON t.level = 't'
), z AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
    CASE WHEN mean_word > x.mean_word OR mean_word < x.low THEN 'mean_word' WHEN symbols > x.symbols THEN 'symbols' WHEN dup_lines > x.dup_lines THEN 'dup_lines' WHEN repeats > x.repeats THEN 'repeats' END AS failed FROM j
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND failed IS NULL AS kept, CASE WHEN base_failed THEN 'base' ELSE failed END AS failed_rule FROM z
""".replace("FENCE", str(FENCE)).replace("SLACK_MEAN", str(METRICS["mean_word"][0])).replace("SLACK_SYMBOLS", str(METRICS["symbols"][0])).replace("SLACK_LINES", str(METRICS["dup_lines"][0])).replace("SLACK_REPEATS", str(METRICS["repeats"][0]))
