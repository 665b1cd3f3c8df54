"""Operator 5, removal of repeated passages with difference-cover anchors.

COVER is a difference cover modulo PERIOD: for any two positions some shift below PERIOD brings both to positions whose
residues are in COVER. So two equal windows of WINDOW words share an equal anchor of WINDOW - PERIOD + 1 words that both documents
hash, though only positions of these residues are hashed.

1. Anchors shared by two documents or more are found in an exchange by hash.
2. Each hit extends to the windows around its anchor; only those windows are hashed in full (two 64-bit hashes, 96 bits of which and
   the bucket are compared) and meet in a second exchange, which marks a window whose smallest document is another, smaller one.
3. Marks go back to the documents, and each word that a marked window covers is removed.

A mapper ships one document a hash (the smallest), so a passage of a third of all documents costs a row a mapper. No pairs are made.

Null and empty text give no words. Documents shorter than a window are left whole. A null doc_id counts as the smallest. Rows that repeat a doc_id do
not remove each other's words, and each row is judged by its own text. There are no ties: equal ids do not order each other. A very long text is read whole; memory grows with the longest. An empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._exchange import SHIPPED, batch, bucket_count, exchange
from ._store import free_shuffles, materialize, release
from ._tokens import Words, gather, gram_starts, grams, pack, portions, split_by, unpack

WINDOW = 13
PERIOD = 7
COVER = (0, 1, 3)
#: Rows a mapper holds before it combines and ships them.
FLUSH = 1_500_000


def is_difference_cover(cover: tuple[int, ...], period: int) -> bool:
    return {(a - b) % period for a in cover for b in cover} == set(range(period))


class _Held:
    """Rows (key, [key2], doc, rid, pos) of a mapper until they are combined and shipped."""

    def __init__(self, buckets: int, windows: bool) -> None:
        self.buckets, self.windows, self.parts, self.n, self.turn = buckets, windows, [], 0, 0

    def add(self, *arrays: np.ndarray) -> None:
        self.parts.append(arrays)
        self.n += len(arrays[0])

    def ship(self) -> list[tuple[int, bytes]]:
        if not self.n:
            return []
        key, key2, doc, rid, pos = (np.concatenate(x) for x in zip(*self.parts, strict=True))
        self.parts, self.n = [], 0
        order = np.argsort(key, kind="stable")
        k, d = key[order], doc[order]
        head = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
        size = np.diff(np.append(head, len(k)))
        least, most = np.minimum.reduceat(d, head), np.maximum.reduceat(d, head)
        low = np.repeat(least, size)
        if self.windows:  # a window that a smaller document of this mapper has is removed; the others go on
            known, go = order[d > low], order[d == low]
        else:  # an anchor that two documents of this mapper share is a hit; its smallest document goes on
            shared = np.repeat(least != most, size)
            known = order[shared]
            first = np.zeros(len(k), bool)
            at = np.flatnonzero(shared & (d == low))
            first[at[np.concatenate([[True], k[at][1:] != k[at][:-1]])] if len(at) else at] = True
            go = order[~shared | first]
        go.sort()
        known.sort()
        out = []
        places, bounds = split_by((key[go] % np.uint64(self.buckets)).astype(np.int64), self.buckets)
        go = go[places]
        for b in range(self.buckets):
            if bounds[b] < bounds[b + 1]:
                i = go[bounds[b] : bounds[b + 1]]
                out.append((b, _rows_blob(0, key[i] // np.uint64(self.buckets), key2[i], doc[i], rid[i], pos[i])))
        if len(known):
            self.turn += 1
            out.append((int(key[known[0]] % np.uint64(self.buckets)), _rows_blob(1, None, None, doc[known], rid[known], pos[known])))
        return out


def _rows_blob(kind: int, key, key2, doc, rid, pos) -> bytes:
    new = np.concatenate([[True], rid[1:] != rid[:-1]])
    at = np.flatnonzero(new)
    runs = np.diff(np.append(at, len(rid)))
    none = np.zeros(0, np.uint8)
    if key is None:
        low, high, second = none, none, none
    elif key2[0] == 0 and not key2.any():  # 40 bits of an anchor's hash: an anchor only filters
        low, high, second = (key & np.uint64(0xFFFFFFFF)).astype(np.uint32), ((key >> np.uint64(32)) & np.uint64(0xFF)).astype(np.uint8), none
    else:
        low, high, second = (key & np.uint64(0xFFFFFFFF)).astype(np.uint32), (key >> np.uint64(32)).astype(np.uint32), key2.astype(np.uint32)
    return pack(np.array([kind], np.uint8), low, high, second, doc[at], rid[at], runs, pos)


def _rows(blob) -> tuple:
    kind, low, high, second, doc, rid, runs, pos = unpack(blob)
    key = (high.astype(np.uint64) << np.uint64(32)) | low.astype(np.uint64)
    return int(kind[0]), key, second, np.repeat(doc.astype(np.int64), runs), np.repeat(rid.astype(np.int64), runs), pos.astype(np.int64)


def _positions_batch(buckets: int, rid: np.ndarray, pos: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Marks (rid, pos) as blobs for the exchange by document."""
    if not len(rid):
        return
    order = np.lexsort((pos, rid))
    rid, pos = rid[order], pos[order]
    places, bounds = split_by(rid % buckets, buckets)
    out = []
    for b in range(buckets):
        if bounds[b] < bounds[b + 1]:
            i = places[bounds[b] : bounds[b + 1]]
            at = np.flatnonzero(np.concatenate([[True], rid[i][1:] != rid[i][:-1]]))
            out.append((b, pack(rid[i][at], np.diff(np.append(at, len(i))), pos[i])))
    yield batch(out)


def _meet(buckets: int, windows: bool) -> Callable:
    def reduce(_: int, blobs: list) -> Iterator[pa.RecordBatch]:
        rows = [_rows(x) for x in blobs]
        for kind, _, _, _, rid, pos in rows:
            if kind == 1:
                yield from _positions_batch(buckets, rid, pos)
        rows = [r for r in rows if r[0] == 0]
        if not rows:
            return
        key, doc, rid, pos = (np.concatenate([r[i] for r in rows]) for i in (1, 3, 4, 5))
        if windows:
            key2 = np.concatenate([r[2] if len(r[2]) else np.zeros(len(r[1]), np.uint32) for r in rows])
            order = np.lexsort((key2, key))
            key2 = key2[order]
        else:
            order = np.argsort(key, kind="stable")
        key, doc, rid, pos = key[order], doc[order], rid[order], pos[order]
        new = key[1:] != key[:-1]
        if windows:
            new |= key2[1:] != key2[:-1]
        head = np.flatnonzero(np.concatenate([[True], new]))
        size = np.diff(np.append(head, len(key)))
        least = np.minimum.reduceat(doc, head)
        hit = doc > np.repeat(least, size) if windows else np.repeat(least != np.maximum.reduceat(doc, head), size)
        yield from _positions_batch(buckets, rid[hit], pos[hit])

    return reduce


def _by_document(_: int, blobs: list) -> Iterator[pa.RecordBatch]:
    rows = [unpack(x) for x in blobs]
    rid = np.concatenate([np.repeat(r[0].astype(np.int64), r[1]) for r in rows])
    pos = np.concatenate([r[2].astype(np.int64) for r in rows])
    order = np.lexsort((pos, rid))
    rid, pos = rid[order], pos[order]
    at = np.flatnonzero(np.concatenate([[True], rid[1:] != rid[:-1]]))
    ends = np.append(at[1:], len(rid))
    for a in range(0, len(at), 4096):
        part = range(a, min(a + 4096, len(at)))
        yield pa.RecordBatch.from_arrays([pa.array(rid[at[part]]), pa.array([np.unique(pos[at[i] : ends[i]]).astype(np.uint32).tobytes() for i in part], pa.binary())], ["row", "marks"])


def _anchors(buckets: int) -> Callable:
    length = WINDOW - PERIOD + 1
    chosen = np.zeros(PERIOD, bool)
    chosen[list(COVER)] = True

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = _Held(buckets, windows=False)
        for b in batches:
            ids, rows = b.column(0).to_numpy(), b.column(1).to_numpy()
            for part, data, offsets in portions(b.column(2)):
                w = Words(data, offsets)
                at, doc = gram_starts(w.first, length)
                pos = at - w.first[:-1][doc]
                keep = chosen[pos % PERIOD] & (np.diff(w.first)[doc] >= WINDOW)
                at, doc, pos = at[keep], doc[keep], pos[keep]
                if len(at):
                    h = grams(w.hashes(), length)[at]
                    held.add(h, np.zeros(len(h), np.uint32), ids[part][doc], rows[part][doc], pos)
                if held.n >= FLUSH:
                    yield batch(held.ship())
        if out := held.ship():
            yield batch(out)

    return run


def _windows(buckets: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = _Held(buckets, windows=True)
        for b in batches:
            b = b.filter(b.column(3).is_valid())
            ids, rows, marks = b.column(0).to_numpy(), b.column(1).to_numpy(), b.column(3)
            for part, data, offsets in portions(b.column(2)):
                w = Words(data, offsets)
                total = len(w.start)
                if total < WINDOW:
                    continue
                hit = np.zeros(total + 1, np.int64)  # difference array over window starts
                for i in range(part.start, part.stop):
                    a, e = w.first[i - part.start], w.first[i - part.start + 1]
                    p = np.frombuffer(marks[i].as_py(), np.uint32).astype(np.int64)
                    p = p[p < e - a]
                    np.add.at(hit, np.maximum(a + p - PERIOD + 1, a), 1)
                    np.add.at(hit, np.minimum(a + p + 1, e), -1)
                near = np.cumsum(hit[:-1]) > 0
                at, doc = gram_starts(w.first, WINDOW)
                keep = near[at]
                at, doc = at[keep], doc[keep]
                if len(at):
                    key, key2 = grams(w.hashes(), WINDOW)[at], grams(w.hashes(seed=1), WINDOW, seed=1)[at]
                    held.add(key, (key2 >> np.uint64(33)).astype(np.uint32) + np.uint32(1), ids[part][doc], rows[part][doc], at - w.first[:-1][doc])
                if held.n >= FLUSH:
                    yield batch(held.ship())
        if out := held.ship():
            yield batch(out)

    return run


def _stripped(texts: pa.Array, marks: pa.Array, with_text: bool) -> list[pa.Array]:
    """n_words, n_removed, kept_sha256 and kept_text of texts whose marked windows go."""
    n, gone, digest, kept_text = [], [], [], []
    for text, mark in zip(texts.cast(pa.large_binary()), marks, strict=True):
        words = (text.as_py() or b"").split()
        size = len(words)
        if mark.is_valid:
            cover = np.zeros(size + WINDOW + 1, np.int64)
            p = np.frombuffer(mark.as_py(), np.uint32).astype(np.int64)
            p = p[p <= size - WINDOW]
            np.add.at(cover, p, 1)
            np.add.at(cover, p + WINDOW, -1)
            words = [words[i] for i in np.flatnonzero(np.cumsum(cover)[:size] == 0)]
        n.append(size)
        gone.append(size - len(words))
        kept = b" ".join(words)
        digest.append(hashlib.sha256(kept).hexdigest())
        kept_text.append(kept if with_text else None)
    return [pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(digest, pa.string()), pa.array(kept_text, pa.binary()).cast(pa.string())]


END = ("n_words", "n_removed", "kept_sha256", "kept_text")
RESULT = "n_words bigint, n_removed bigint, kept_sha256 string, kept_text string"


def _settle(with_text: bool) -> Callable:
    """Rows (doc_id, row, text, hits): those without hits are finished, the others keep their text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            open_ = b.column(3).is_valid()
            for part, done in ((b.filter(open_), False), (b.filter(pc.invert(open_)), True)):
                if part.num_rows:
                    none = pa.nulls(part.num_rows)
                    end = _stripped(part.column(2), part.column(3), with_text) if done else [none.cast(t) for t in (pa.int64(), pa.int64(), pa.string(), pa.string())]
                    text = none.cast(pa.string()) if done else part.column(2)
                    yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), text, part.column(3), *end], ["doc_id", "row", "text", "hits", *END])

    return run


def _strip(with_text: bool) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), *_stripped(b.column(1), b.column(2), with_text)], ["doc_id", *END])

    return run


def remove_repeats(documents: DataFrame, with_text: bool = True) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256, kept_text (null unless with_text)."""
    text = F.coalesce("text", F.lit(""))
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("doc_id", text).alias("row"), text.alias("text"))
    buckets = bucket_count(rows)
    ordered = rows.select(F.coalesce("doc_id", F.lit(-(1 << 63))).alias("doc_id"), "row", "text")
    hits = exchange(ordered.mapInArrow(_anchors(buckets), SHIPPED), buckets, _meet(buckets, windows=False), SHIPPED)
    hits = materialize(exchange(hits, buckets, _by_document, "row bigint, marks binary"), "hits")
    free_shuffles(documents.sparkSession)
    # Documents without a hit are finished in this pass; only the texts of the others are kept and move again.
    joined = rows.join(hits, "row", "left").select("doc_id", "row", "text", F.col("marks").alias("hits"))
    settled = materialize(joined.mapInArrow(_settle(with_text), f"doc_id bigint, row bigint, text string, hits binary, {RESULT}"), "settled")
    release(hits)
    free_shuffles(documents.sparkSession)
    near = settled.where(F.col("hits").isNotNull())
    windows = near.select(F.coalesce("doc_id", F.lit(-(1 << 63))).alias("doc_id"), "row", "text", "hits").mapInArrow(_windows(buckets), SHIPPED)
    marks = exchange(windows, buckets, _meet(buckets, windows=True), SHIPPED)
    marks = materialize(exchange(marks, buckets, _by_document, "row bigint, marks binary"), "marks")
    free_shuffles(documents.sparkSession)
    stripped = near.join(marks, "row", "left").select("doc_id", "text", "marks").mapInArrow(_strip(with_text), f"doc_id bigint, {RESULT}")
    return settled.where(F.col("hits").isNull()).select("doc_id", *END).unionByName(stripped)


ORACLE_SQL = r"""
WITH w AS (SELECT doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS words FROM documents),
g AS (SELECT doc_id, words, unnest(range(1, greatest(len(words) - 11, 1))) AS p FROM w),
k AS (SELECT doc_id, p, array_to_string(words[p:p + 12], ' ') AS s FROM g),
m AS (SELECT doc_id, p, min(doc_id) OVER (PARTITION BY s) AS first_doc FROM k),
r AS (SELECT doc_id, list_distinct(flatten(list(range(p, p + 13)))) AS gone FROM m WHERE first_doc < doc_id GROUP BY doc_id),
j AS (SELECT w.doc_id, words, coalesce(gone, []) AS gone FROM w LEFT JOIN r USING (doc_id))
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(len(gone) AS BIGINT) AS n_removed,
  sha256(array_to_string(CASE WHEN len(gone) = 0 THEN words ELSE list_where(words, list_transform(range(1, len(words) + 1), lambda i: NOT list_contains(gone, i))) END, ' ')) AS kept_sha256
FROM j
"""
