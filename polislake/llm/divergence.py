"""Source divergence audit: how far the word use of each source is from that of the other sources of its language, and by which terms.

A byte-level tokenizer: a lookup table over the concatenated UTF-8 buffers tells term bytes (ASCII letters and all bytes of other characters) from the rest, so boundaries are two
comparisons of whole buffers. Slices are grouped by their XXH64, and every slice is compared with the first of its group, byte by byte; slices that differ are grouped apart. Tasks count
(term, group) cells over what they read before they ship them, packed, to the buckets of their terms. A bucket sums them, keeps the terms that enough documents of
a language have, and writes a CSR matrix a language: a row a term, a column a source. With the totals of all buckets known, a second pass reads the matrices, and each bucket adds its
terms to the divergences of all pairs of sources of the language (reduceat over the cells of each source) and offers its largest terms.

All arithmetic is on whole numbers. Memory: a task holds FLUSH cells, or one bucket, or one matrix and a number a source of its language. The totals of the sources are broadcast where they
are below BROADCAST bytes, and beyond joined by language and bucket.

Null text, lang and source are empty strings. Long texts are read whole; rows that repeat are documents each; ties of values go by the bytes of the item. Groups without terms have pairs too. An
empty table gives an empty result. Only text, lang and source are read; other columns may have any name."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._exchange import SHIPPED, batch, bucket_count, exchange
from ._store import materialize, release
from ._tokens import FIRST, by_eights, gather, give_back, lower_az, pack, portions, same_spans, split_by, unpack

TERM = np.zeros(256, bool)
TERM[65:91] = TERM[97:123] = TERM[128:] = True
LEAST_DOCUMENTS, MOST_TERMS, UNIT = 3, 200, 10**9
FLUSH = 1 << 20
BROADCAST = 8 << 20
U = np.uint64
# The primes of XXH64.
P1, P2, P3, P4, P5 = (U(x) for x in (11400714785074694791, 14029467366897019727, 1609587929392839161, 9650029242287828579, 2870177450012600261))


def _rotate(x: np.ndarray, n: int) -> np.ndarray:
    return (x << U(n)) | (x >> U(64 - n))


def xxh64(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """XXH64 (seed 0) of each slice; those of 32 bytes or more by the library."""
    eight, size = by_eights(data), (end - start).astype(np.int64)
    h = P5 + size.astype(U)
    for lane in range(3):
        on = np.flatnonzero(size >= 8 * lane + 8)
        if len(on):
            h[on] = _rotate(h[on] ^ (_rotate(eight[start[on] + 8 * lane] * P2, 31) * P1), 27) * P1 + P4
    at, left = start + (size & ~7), size & 7
    on = np.flatnonzero(left >= 4)
    h[on] = _rotate(h[on] ^ ((eight[at[on]] & FIRST[4]) * P1), 23) * P2 + P3
    at, left = at + (left & 4), left & 3
    for i in range(3):
        on = np.flatnonzero(left > i)
        if len(on):
            h[on] = _rotate(h[on] ^ ((eight[at[on] + i] & FIRST[1]) * P5), 11) * P1
    h = (h ^ (h >> U(33))) * P2
    h = (h ^ (h >> U(29))) * P3
    h ^= h >> U(32)
    for i in np.flatnonzero(size >= 32):
        h[i] = xxhash.xxh64_intdigest(data[start[i] : end[i]].tobytes())
    return h


def distinct_slices(data: np.ndarray, start: np.ndarray, end: np.ndarray, hashes: Callable = xxh64) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A number for each slice, equal for equal bytes; the first slice of each number; the hash of each number."""
    h = hashes(data, start, end)
    number, firsts, total = np.zeros(len(h), np.int64), [np.zeros(0, np.int64)], 0
    left = np.arange(len(h))
    while len(left):
        _, first, group = np.unique(h[left], return_index=True, return_inverse=True)
        lead = left[first]
        same = same_spans(data, start[left], end[left], data, start[lead[group]], end[lead[group]])
        number[left[same]] = total + group[same]
        firsts.append(lead)
        total += len(lead)
        left = left[~same]  # other bytes under a hash that is taken
    first = np.concatenate(firsts)
    return number, first, h[first]


def term_slices(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where terms begin and end in texts side by side."""
    inside = np.zeros(len(data) + 2, bool)
    inside[1:-1] = TERM[data]
    cut = np.zeros(len(data) + 1, bool)
    cut[offsets] = True
    now, before = inside[1:], inside[:-1]
    return np.flatnonzero(now & (~before | cut)), np.flatnonzero(before & (~now | cut))


class _Cells:
    """Counted cells of a task: terms by their bytes, groups by number."""

    def __init__(self, buckets: int, hashes: Callable) -> None:
        self.buckets, self.hashes = buckets, hashes
        self.groups: dict[tuple[str, str], int] = {}
        self.clear()

    def clear(self) -> None:
        self.parts: list[tuple] = []
        self.n = 0

    def group(self, lang: str, source: str) -> int:
        return self.groups.setdefault((lang, source), len(self.groups))

    def add(self, data: np.ndarray, offsets: np.ndarray, group: np.ndarray) -> None:
        low = lower_az(data)
        start, end = term_slices(low, offsets)
        if not len(start):
            return
        term, first, _ = distinct_slices(low, start, end, self.hashes)
        # Documents in the order of their groups: equal (term, group) are neighbours once (term, document) is sorted.
        order = np.argsort(group, kind="stable")
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        doc = place[np.searchsorted(offsets, start, side="right") - 1]
        pair, times = np.unique(term * len(order) + doc, return_counts=True)
        term, owner = pair // len(order), group[order][pair % len(order)]
        head = np.flatnonzero(np.concatenate([[True], (term[1:] != term[:-1]) | (owner[1:] != owner[:-1])]))
        body, at = gather(low, start[first], end[first])
        self.parts.append((body, np.diff(at), term[head], owner[head], np.add.reduceat(times, head), np.diff(np.append(head, len(pair)))))
        self.n += len(head)

    def merged(self) -> tuple[np.ndarray, ...]:
        """Terms (bytes, offsets, hashes) and cells (term, group, count, documents), cells in the order of term and group."""
        return merge(self.parts, len(self.groups), self.hashes)

    def ship(self) -> list[tuple[int, bytes]]:
        if not self.n:
            return []
        body, at, h, term, owner, count, docs = self.merged()
        names = list(self.groups)
        bucket = (h >> U(20)) % U(self.buckets)
        order, bounds = split_by(bucket.astype(np.int64), self.buckets)
        first = np.searchsorted(term, np.arange(len(h) + 1))
        out = []
        for b in np.flatnonzero(np.diff(bounds)):
            mine = order[bounds[b] : bounds[b + 1]]
            cells, where = gather(np.arange(len(term)), first[mine], first[mine + 1])
            text, ends = gather(body, at[mine], at[mine + 1])
            used, local = np.unique(owner[cells], return_inverse=True)
            told = np.frombuffer(json.dumps([names[i] for i in used]).encode(), np.uint8)
            out.append((int(b), pack(told, text, np.diff(ends), np.diff(where), local, count[cells], docs[cells])))
        self.clear()
        return out


def merge(parts: list[tuple], groups: int, hashes: Callable) -> tuple[np.ndarray, ...]:
    body = np.concatenate([p[0] for p in parts])
    size = np.concatenate([p[1] for p in parts])
    base = np.cumsum([0] + [len(p[1]) for p in parts])
    at = np.concatenate([[0], np.cumsum(size)])
    number, first, h = distinct_slices(body, at[:-1], at[1:], hashes)
    key = number[np.concatenate([p[2] + b for p, b in zip(parts, base[:-1], strict=True)])] * groups + np.concatenate([p[3] for p in parts])
    order = np.argsort(key, kind="stable")
    key = key[order]
    head = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    total = lambda i: np.add.reduceat(np.concatenate([p[i] for p in parts]).astype(np.int64)[order], head)
    text, offsets = gather(body, at[first], at[first + 1])
    return text, offsets, h, key[head] // groups, key[head] % groups, total(4), total(5)


def _count(buckets: int, hashes: Callable) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = _Cells(buckets, hashes)
        for b in batches:
            langs, sources = b.column(1).to_pylist(), b.column(2).to_pylist()
            group = np.array([held.group(x, y) for x, y in zip(langs, sources, strict=True)], np.int64)
            for part, data, offsets in portions(b.column(0)):
                held.add(data, offsets, group[part])
                if held.n >= FLUSH:
                    yield batch(held.ship())
        if out := held.ship():
            yield batch(out)
        give_back()

    return run


MATRIX = "lang string, bucket int, sources array<string>, totals array<bigint>, terms bigint, cells binary"


def _matrices(hashes: Callable) -> Callable:
    """A bucket's cells summed: a CSR matrix of kept terms a language."""

    def run(bucket: int, blobs: list) -> Iterator[pa.RecordBatch]:
        groups: dict[tuple[str, str], int] = {}
        parts = []
        for blob in blobs:
            names, text, size, width, owner, count, docs = unpack(blob)
            mine = np.array([groups.setdefault(tuple(g), len(groups)) for g in json.loads(names.tobytes())], np.int64)
            parts.append((text, size.astype(np.int64), np.repeat(np.arange(len(size)), width), mine[owner], count, docs))
        body, at, _, term, owner, count, docs = merge(parts, len(groups), hashes)
        langs = sorted({x for x, _ in groups})
        lang_of = np.array([langs.index(x) for x, _ in groups], np.int64)
        for k, lang in enumerate(langs):
            on = lang_of[owner] == k
            t, g, n = term[on], owner[on], count[on]
            enough = np.bincount(t, docs[on], len(at) - 1) >= LEAST_DOCUMENTS
            t, g, n = t[enough[t]], g[enough[t]], n[enough[t]]
            rows = np.unique(t)
            if not len(rows):
                continue
            words = sorted((body[at[r] : at[r + 1]].tobytes(), r) for r in rows)
            place = np.zeros(len(at), np.int64)
            place[[r for _, r in words]] = np.arange(len(words))
            name = {i: y for (_, y), i in groups.items()}
            used = sorted(np.unique(g).tolist(), key=name.get)
            to = np.zeros(len(groups), np.int64)
            to[used] = np.arange(len(used))
            t, g = place[t], to[g]
            order = np.lexsort((g, t))
            t, g, n = t[order], g[order], n[order]
            packed = pack(np.frombuffer(b"".join(w for w, _ in words), np.uint8), np.array([len(w) for w, _ in words]), np.searchsorted(t, np.arange(len(words) + 1)), g, n)
            totals = np.bincount(g, n, len(used)).astype(np.int64)
            row = [lang], [bucket], [[name[i] for i in used]], [totals.tolist()], [len(words)], [packed]
            kinds = pa.string(), pa.int32(), pa.list_(pa.string()), pa.list_(pa.int64()), pa.int64(), pa.binary()
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(row, kinds, strict=True)], [c.split()[0] for c in MATRIX.split(", ")])

    return run


def share(count: np.ndarray, total: np.ndarray) -> np.ndarray:
    """1 + floor(UNIT * (count + 1) / total), by long division: no product leaves 64 bits while totals are below 9 * 10^15."""
    count, total = np.broadcast_arrays(np.asarray(count, np.int64) + 1, np.asarray(total, np.int64))
    out, rest = count // total, count % total
    for _ in range(3):
        rest = rest * 1000
        out, rest = out * 1000 + rest // total, rest % total
    return out + 1


def departure(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // q


def divergences(terms: int, t: np.ndarray, s: np.ndarray, p: np.ndarray, none: np.ndarray) -> np.ndarray:
    """[a, b]: the departures of source a from source b, summed over all `terms`. Cells (t, s, p) are those that are not empty; none: p of an empty cell of each source."""
    k = len(none)
    order = np.argsort(s, kind="stable")
    t, s, p = t[order], s[order], p[order]
    bounds = np.searchsorted(s, np.arange(k + 1))
    some = np.flatnonzero(np.diff(bounds))
    out = np.zeros((k, k), np.int64)
    for b in range(k):
        mine = slice(bounds[b], bounds[b + 1])
        q = np.full(terms, none[b])
        q[t[mine]] = p[mine]
        # Terms that a does not have: all terms as if it had none, without those that it has.
        values, times = np.unique(q, return_counts=True)
        out[:, b] = (departure(none[:, None], values[None, :]) * times).sum(1)
        if len(some):
            met = q[t]
            out[some, b] += np.add.reduceat(departure(p, met) - departure(none[s], met), bounds[:-1][some])
    return out


FOUND = "lang string, source string, part string, item string, value bigint"


def _found(lang: str, source: list[str], part: str, item: list[str], value: np.ndarray) -> pa.RecordBatch:
    n = len(source)
    return pa.RecordBatch.from_arrays([pa.array([lang] * n, pa.string()), pa.array(source, pa.string()), pa.array([part] * n, pa.string()), pa.array(item, pa.string()), pa.array(value, pa.int64())], [c.split()[0] for c in FOUND.split(", ")])


def _audit(most: int) -> Callable:
    """Rows (lang, sources, cells, every, size, kept): the part of a bucket's terms in each pair of sources, and its largest terms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                lang, v = row["lang"], row["kept"]
                names = [x["source"] for x in row["every"]]
                size = np.array([x["size"] for x in row["every"]], np.int64) + v
                at = {x: i for i, x in enumerate(names)}
                body, width, first, s, n = unpack(row["cells"])
                s, n = np.array([at[x] for x in row["sources"]], np.int64)[s], n.astype(np.int64)
                first = first.astype(np.int64)
                t = np.repeat(np.arange(len(width)), np.diff(first))
                p = share(n, size[s])
                sums = divergences(len(width), t, s, p, share(np.zeros(len(size)), size))
                for i, name in enumerate(names):
                    others = [j for j in range(len(names)) if j != i]
                    if others:
                        yield _found(lang, [name] * len(others), "pair", [names[j] for j in others], sums[i, others])
                q = share(np.add.reduceat(n, first[:-1]), np.full(len(width), row["size"] + v))[t]
                over = np.flatnonzero(p > q)
                f = departure(p[over], q[over])
                order = np.lexsort((t[over], -f, s[over]))  # terms are in the order of their bytes
                over, f = over[order], f[order]
                rank = np.arange(len(over)) - np.searchsorted(s[over], s[over])
                over, f = over[rank < most], f[rank < most]
                ends = np.concatenate([[0], np.cumsum(width.astype(np.int64))])
                text = body.tobytes()
                yield _found(lang, [names[i] for i in s[over]], "term", [text[ends[i] : ends[i + 1]].decode() for i in t[over]], f)

    return run


def source_divergence(documents: DataFrame, most: int = MOST_TERMS, hashes: Callable = xxh64) -> DataFrame:
    """lang, source, part (`pair` or `term`), item, value, rank."""
    spark = documents.sparkSession
    empty = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    rows = documents.select(empty("text"), empty("lang"), empty("source"))
    buckets = bucket_count(rows)
    matrices = materialize(exchange(rows.mapInArrow(_count(buckets, hashes), SHIPPED), buckets, _matrices(hashes), MATRIX), "matrices")
    # A row a source: what the kept terms count there.
    counted = matrices.select("lang", F.inline(F.arrays_zip(F.col("sources").alias("source"), F.col("totals").alias("n")))).groupBy("lang", "source").agg(F.sum("n").alias("n"))
    every = rows.select("lang", "source").distinct().join(counted, ["lang", "source"], "left").select("lang", "source", F.coalesce("n", F.lit(0)).cast("long").alias("size"))
    kept = matrices.groupBy("lang").agg(F.sum("terms").alias("kept"))
    groups = materialize(every.join(kept, "lang", "left"), "groups")
    whole = groups.where("kept IS NOT NULL").groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("source", "size"))).alias("every"), F.sum("size").alias("size"), F.first("kept").alias("kept"))
    bytes_ = groups.agg(F.sum(F.octet_length("source") + 24)).first()[0] or 0
    if bytes_ <= BROADCAST:
        met = matrices.join(F.broadcast(whole), "lang")
    else:
        at = matrices.select("lang", "bucket").distinct()
        met = matrices.join(at.join(whole, "lang"), ["lang", "bucket"])
    found = materialize(met.select("lang", "sources", "cells", "every", "size", "kept").mapInArrow(_audit(most), FOUND), "found")
    release(matrices)
    # Languages that keep no term: every pair is 0.
    bare = groups.where("kept IS NULL").select("lang", "source")
    zero = bare.join(bare.select("lang", F.col("source").alias("item")), "lang").where("source <> item").select("lang", "source", F.lit("pair").alias("part"), "item", F.lit(0).cast("long").alias("value"))
    pairs = found.where("part = 'pair'").groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value")).unionByName(zero)
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    ranked = lambda df: df.select("lang", "source", "part", "item", "value", rank.alias("rank"))
    return ranked(pairs).unionByName(ranked(found.where("part = 'term'")).where(F.col("rank") <= most))


ORACLE_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS d, coalesce(text, '') AS text, coalesce(lang, '') AS lang, coalesce(source, '') AS source FROM documents),
w AS (SELECT d, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
k AS (SELECT lang, term, count(*) AS n FROM w GROUP BY lang, term HAVING count(DISTINCT d) >= 3),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT w.lang, w.source, w.term, count(*) AS n FROM w JOIN k ON k.lang = w.lang AND k.term = w.term GROUP BY ALL),
v AS (SELECT lang, count(*) AS v, sum(n) AS n FROM k GROUP BY lang),
s AS (SELECT g.lang, g.source, coalesce(sum(n), 0) AS n FROM g LEFT JOIN c ON c.lang = g.lang AND c.source = g.source GROUP BY ALL),
p AS (SELECT k.lang, s.source, k.term, coalesce(c.n, 0) AS c, 1 + (CAST(1000000000 AS HUGEINT) * (coalesce(c.n, 0) + 1)) // (CAST(s.n AS HUGEINT) + v.v) AS p,
  1 + (CAST(1000000000 AS HUGEINT) * (k.n + 1)) // (CAST(v.n AS HUGEINT) + v.v) AS q
  FROM k JOIN v ON v.lang = k.lang JOIN s ON s.lang = k.lang LEFT JOIN c ON c.lang = k.lang AND c.source = s.source AND c.term = k.term),
x AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
y AS (SELECT a.lang, a.source, b.source AS item, coalesce(x.value, 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN x ON x.lang = a.lang AND x.source = a.source AND x.item = b.source),
z AS (SELECT lang, source, 'pair' AS part, item, value FROM y UNION ALL SELECT lang, source, 'term', term, (p - q) * (p - q) // q FROM p WHERE c > 0 AND p > q),
r AS (SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INT) AS rank FROM z)
SELECT * FROM r WHERE part = 'pair' OR rank <= 200
"""
