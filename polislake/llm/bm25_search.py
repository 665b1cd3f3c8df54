"""Operator 6, exact top-k search by BM25 with block-max WAND over inverted index shards.

Words are lower-cased (A-Z), as 64-bit hashes. A query is the set of its distinct words. BM25 with K1 and B, idf ln(1 + (N - df + 0.5) / (df + 0.5)), where N, the mean
length and df are global: document frequencies are counted over all documents and come back to the queries by an exchange.

The pruning is by block-max bounds, taken for all blocks of a shard at once in vectorised passes, not by a cursor that moves from pivot to pivot.

Each mapper writes its documents as index shards of about SHARD_BYTES of text: postings by term, documents ordered within the shard so that like ones are
neighbours (by their most frequent word and length), in blocks of BLOCK documents with each term's largest weight in each block. Queries go through a shard some at a time:
the sums of block maxima, which bound the scores of a block, leave the blocks that can reach a query's threshold (the K-th best score so far in the task, or among the shards
that are searched first). Their documents are scored to float32, frequent terms (a column of weights each) by one matrix product for all these queries, the others by their postings. Documents
that reach the threshold with all that such a sum can be off by are scored again in full. No document that could enter the result is skipped, so merging the tasks' results is exact.

Queries are processed in blocks of at most BLOCK_TERMS terms, one broadcast of bounded size a block. Scores are rounded to 6 decimals, ties go to the smaller
doc_id. Null, empty and blank texts match nothing and, as queries, return nothing. Rows that repeat a doc_id are documents of their own; as queries they are
one, of all their words. A null doc_id is found, as null, but is no query. A very long text is a document and a query like any other; memory grows with the longest. An empty table
gives an empty result. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._exchange import SHIPPED, batch, bucket_count, exchange
from ._store import free_shuffles, materialize, release
from ._tokens import Words, pack, portions, split_by, unpack

K = 10
K1, B = 1.2, 0.75
SHARD_BYTES = 8 << 20
BLOCK = 128
BLOCK_TERMS = 800_000
#: From so many shards on, about one of TURNS is searched first, for what the K-th best document of a query scores at least.
MANY_SHARDS = 32
TURNS = 16
#: A term that one of so many documents of a shard has gets a column of weights, as long as all columns together have at most MOST_CELLS numbers.
SPARSE = 24
MOST_CELLS = 6 << 20
#: Queries, and their scores, that are taken at a time.
MOST_TOGETHER = 64
SCORES = 1 << 18
U = np.uint64
RESULT = "query_id bigint, doc_id bigint, score double"


def _terms(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct terms of each text: text, term, frequency; and the texts' lengths in words."""
    w = Words(data, offsets)
    h, doc = w.hashes(lower=True), w.doc_of()
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    head = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])])) if len(h) else np.zeros(0, np.int64)
    return doc[head], h[head], np.diff(np.append(head, len(h))), np.diff(w.first)


def _shard(ids: np.ndarray, doc: np.ndarray, term: np.ndarray, tf: np.ndarray, length: np.ndarray) -> bytes:
    most = np.lexsort((term, -tf, doc))
    first = most[np.concatenate([[True], doc[most][1:] != doc[most][:-1]])[: len(most)]]
    top = np.zeros(len(ids), U)
    top[doc[first]] = term[first]
    order = np.lexsort((length, top))
    rank = np.empty(len(ids), np.int64)
    rank[order] = np.arange(len(ids))
    by = np.lexsort((rank[doc], term))
    term = term[by]
    head = np.flatnonzero(np.concatenate([[True], term[1:] != term[:-1]])) if len(term) else np.zeros(0, np.int64)
    return pack(ids[order], length[order], term[head], np.diff(np.append(head, len(term))), rank[doc[by]], tf[by])


def _index_mapper(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (doc_id, text) to shards: blob, docs, words, turn (0 for about one of TURNS)."""
    held: list[tuple] = []
    size = 0

    def close() -> pa.RecordBatch:
        nonlocal held, size
        base = np.cumsum([0] + [len(h[0]) for h in held[:-1]])
        ids, term, tf, length = (np.concatenate([h[i] for h in held]) for i in (0, 2, 3, 4))
        doc = np.concatenate([h[1] + b for h, b in zip(held, base, strict=True)])
        held, size = [], 0
        blob = _shard(ids, doc, term, tf, length)
        row = [pa.array([blob], pa.binary()), pa.array([len(ids)], pa.int64()), pa.array([int(length.sum())], pa.int64()), pa.array([crc32(blob) % TURNS], pa.int32())]
        return pa.RecordBatch.from_arrays(row, ["blob", "docs", "words", "turn"])

    for b in batches:
        ids = b.column(0).to_numpy()
        for part, data, offsets in portions(b.column(1)):
            held.append((ids[part], *_terms(data, offsets)))
            size += len(data)
            if size >= SHARD_BYTES:
                yield close()
    if held:
        yield close()


def _frequency_mapper(buckets: int) -> Callable:
    """Shards to (term, document frequency) blobs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for blob in b.column(0):
                _, _, term, df, _, _ = unpack(blob.as_py())
                term = term.astype(U)
                places, bounds = split_by((term % U(buckets)).astype(np.int64), buckets)
                yield batch([(k, b"D" + pack(term[i], df[i])) for k in range(buckets) if len(i := places[bounds[k] : bounds[k + 1]])])

    return run


def _query_mapper(buckets: int) -> Callable:
    """Rows (doc_id, text) to (term, query) blobs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column(0).to_numpy()
            for part, data, offsets in portions(b.column(1)):
                doc, term, _, _ = _terms(data, offsets)
                query = ids[part][doc]
                places, bounds = split_by((term % U(buckets)).astype(np.int64), buckets)
                out = [(k, b"Q" + pack(term[i], query[i])) for k in range(buckets) if len(i := places[bounds[k] : bounds[k + 1]])]
                if out:
                    yield batch(out)

    return run


def _frequency_reducer(_: int, blobs: list) -> Iterator[pa.RecordBatch]:
    """(query_id, term, df) for the terms of queries."""
    asked = [unpack(x[1:]) for x in blobs if x[:1] == b"Q"]
    if not asked:
        return
    term, query = np.concatenate([a[0].astype(U) for a in asked]), np.concatenate([a[1].astype(np.int64) for a in asked])
    own = np.unique(term)
    total = np.zeros(len(own), np.int64)
    for x in blobs:
        if x[:1] == b"D":
            t, df = unpack(x[1:])
            i = np.minimum(np.searchsorted(own, t.astype(U)), len(own) - 1)
            hit = own[i] == t.astype(U)
            total[i[hit]] += df[hit]
    order = np.argsort(query, kind="stable")
    yield pa.RecordBatch.from_arrays([pa.array(query[order]), pa.array(term[order].view(np.int64)), pa.array(total[np.searchsorted(own, term[order])])], ["query_id", "term", "df"])


class Queries:
    """Queries in flat arrays: distinct terms of all queries, and for each query places in them and idf weights."""

    def __init__(self, query: np.ndarray, term: np.ndarray, df: np.ndarray, docs: int) -> None:
        order = np.lexsort((term, query))
        query, term, df = query[order], term[order].view(U), df[order]
        self.ids, first = np.unique(query, return_index=True)
        self.first = np.append(first, len(query))
        self.terms, self.at = np.unique(term, return_inverse=True)
        self.at = self.at.astype(np.int32)
        self.idf = np.log(1 + (docs - df + 0.5) / (df + 0.5))


class Shard:
    def __init__(self, blob: bytes, mean_length: float) -> None:
        self.ids, length, self.terms, size, self.doc, tf = unpack(blob)
        self.ids, self.terms, size, self.doc = self.ids.astype(np.int64), self.terms.astype(U), size.astype(np.int64), self.doc.astype(np.int32)
        self.bounds = np.concatenate([[0], np.cumsum(size)]).astype(np.int32)
        scale = K1 * (1 - B + B * length.astype(float) / max(mean_length, 1e-9))
        tf = tf.astype(float)
        self.weight = tf * (K1 + 1) / (tf + scale[self.doc])
        block = self.doc // BLOCK
        term_of = np.repeat(np.arange(len(size), dtype=np.int32), size)
        head = np.flatnonzero(np.concatenate([[True], (block[1:] != block[:-1]) | (term_of[1:] != term_of[:-1])])) if len(block) else np.zeros(0, np.int64)
        # Runs: the postings of one term in one block.
        self.run_block, self.run_start = block[head], head
        self.run_length = np.diff(np.append(head, len(block)))
        self.run_max = np.maximum.reduceat(self.weight, head) if len(head) else np.zeros(0)
        self.term_runs = np.searchsorted(head, self.bounds).astype(np.int32)
        self.rough, self.rough_max = self.weight.astype(np.float32), self.run_max.astype(np.float32)
        self.term_max = np.maximum.reduceat(self.run_max, self.term_runs[:-1]) if len(size) else np.zeros(0)
        self.blocks = -(-len(self.ids) // BLOCK)
        # Frequent terms have a column each: the weights by document, and the largest of each block.
        often = np.flatnonzero(size * SPARSE >= len(self.ids))
        often = often[np.argsort(-size[often], kind="stable")[: MOST_CELLS // max(len(self.ids), 1)]]
        self.column = np.full(len(size), -1)
        self.column[often] = np.arange(len(often))
        postings = _ranges(self.bounds[often], self.bounds[often + 1])
        self.common = np.zeros((len(self.ids), len(often)), np.float32)
        self.common[self.doc[postings], np.repeat(np.arange(len(often)), size[often])] = self.weight[postings]
        self.common_max = np.maximum.reduceat(self.common, np.arange(0, len(self.ids), BLOCK), axis=0)
        # A sum of n numbers that are not negative is off by less than n / 2^24 of itself in float32, in any order; this is twice that, with room for the rounding of its terms.
        self.slack = 1 + (len(often) + 16) * 2.0**-23
        # The postings by document, and a place for the weights of one query's terms.
        self.term_of = term_of
        self.by_doc = np.argsort(self.doc.astype(np.uint16) if len(self.ids) <= 1 << 16 else self.doc, kind="stable").astype(np.int32)
        self.doc_bounds = np.concatenate([[0], np.cumsum(np.bincount(self.doc, minlength=len(self.ids)))]).astype(np.int32)
        self.idf = np.zeros(len(size))

    def search(self, queries: Queries, place: np.ndarray, some: slice, k: int, best: list[tuple[np.ndarray, np.ndarray]], least: np.ndarray) -> None:
        """Puts the k best (scores, ids) among best[i] and this shard's documents into best[i], for some of the queries. place: of the queries' terms in self.terms, -1 where it has none. least: a score
        that the k best of each query are known to have."""
        asked = range(len(queries.ids))[some]
        own = slice(queries.first[asked.start], queries.first[asked.stop])
        term = place[queries.at[own]]
        here = np.flatnonzero(term >= 0)
        ends = np.searchsorted(here, queries.first[asked.start : asked.stop + 1] - own.start)
        term, idf, query = term[here], queries.idf[own][here], np.repeat(np.arange(len(asked)), np.diff(ends))
        rough = idf.astype(np.float32)
        threshold = np.array([max(least[i], best[i][0][-1] if len(best[i][0]) == k else -np.inf) - 1e-6 for i in asked])
        column = self.column[term]
        dense, rare = column >= 0, np.flatnonzero(column < 0)
        common = np.zeros((len(asked), self.common.shape[1]), np.float32)
        common[query[dense], column[dense]] = rough[dense]
        # The bounds of blocks.
        first, size = self.term_runs[term[rare]], self.term_runs[term[rare] + 1] - self.term_runs[term[rare]]
        runs = _ranges(first, first + size)
        bound = np.bincount(np.repeat(query[rare] * self.blocks, size) + self.run_block[runs], weights=self.rough_max[runs] * np.repeat(rough[rare], size), minlength=len(asked) * self.blocks).astype(float, copy=False).reshape(len(asked), -1)
        bound += common @ self.common_max.T
        left = (bound * self.slack >= threshold[:, None]) & (bound > 0)
        if not left.any():
            return
        # Scores of the blocks that are left to a query at least, to float32.
        docs = np.flatnonzero(np.repeat(left.any(axis=0), BLOCK)[: len(self.ids)])
        whole = len(docs) == len(self.ids)
        first, size = self.bounds[term[rare]], self.bounds[term[rare] + 1] - self.bounds[term[rare]]
        postings = _ranges(first, first + size)
        score = np.bincount(np.repeat(query[rare] * len(self.ids), size) + self.doc[postings], weights=self.rough[postings] * np.repeat(rough[rare], size), minlength=len(asked) * len(self.ids)).astype(float, copy=False).reshape(len(asked), -1)
        score = score if whole else score[:, docs]
        score += common @ (self.common if whole else self.common[docs]).T
        hits = score >= (np.maximum(threshold, 1e-12) / self.slack)[:, None]
        hits[~left.any(axis=1)] = False
        for i in np.flatnonzero(hits.any(axis=1)):
            found = np.flatnonzero(hits[i])
            if len(found) > 4 * k:
                own = score[i, found]
                found = found[own >= np.partition(own, len(found) - k)[len(found) - k] / self.slack**2 - 1e-6]
            mine = slice(ends[i], ends[i + 1])
            best[asked[i]] = self._exact(docs[found], term[mine], idf[mine], k, best[asked[i]], threshold[i])

    def _exact(self, docs: np.ndarray, term: np.ndarray, idf: np.ndarray, k: int, best: tuple[np.ndarray, np.ndarray], threshold: float) -> tuple[np.ndarray, np.ndarray]:
        """`best` with these documents, scored in full."""
        self.idf[term] = idf
        start, end = self.doc_bounds[docs], self.doc_bounds[docs + 1]
        postings = self.by_doc[_ranges(start, end)]
        scores = np.bincount(np.repeat(np.arange(len(docs)), end - start), weights=self.weight[postings] * self.idf[self.term_of[postings]], minlength=len(docs))
        self.idf[term] = 0
        more = np.flatnonzero(scores >= max(threshold, 1e-12))
        docs, scores = docs[more], np.round(scores[more], 6)
        if len(docs) > k:
            least = np.partition(scores, len(scores) - k)[len(scores) - k]
            docs, scores = docs[scores >= least], scores[scores >= least]
        return _best(np.concatenate([best[0], scores]), np.concatenate([best[1], self.ids[docs]]), k)


def _ranges(start: np.ndarray, end: np.ndarray) -> np.ndarray:
    size = end - start
    at = (np.cumsum(size) - size).astype(start.dtype)
    return np.repeat(start - at, size) + np.arange(int(size.sum()), dtype=start.dtype)


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((ids, -scores))[:k]
    return scores[order], ids[order]


def _search_mapper(queries: Queries, mean_length: float, k: int, least: np.ndarray) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = [(np.zeros(0), np.zeros(0, np.int64))] * len(queries.ids)
        for b in batches:
            for blob in b.column(0):
                shard = Shard(blob.as_py(), mean_length)
                if not len(shard.terms):
                    continue
                place = np.minimum(np.searchsorted(shard.terms, queries.terms), len(shard.terms) - 1)
                place = np.where(shard.terms[place] == queries.terms, place, -1)
                together = max(1, min(MOST_TOGETHER, SCORES // len(shard.ids)))
                for i in range(0, len(queries.ids), together):
                    shard.search(queries, place, slice(i, i + together), k, best, least)
        sizes = [len(x[0]) for x in best]
        if sum(sizes):
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.repeat(queries.ids, sizes)), pa.array(np.concatenate([x[1] for x in best])), pa.array(np.concatenate([x[0] for x in best]))], ["query_id", "doc_id", "score"]
            )

    return run


def _ranked(found: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def search(documents: DataFrame, is_query: Column, k: int = K, block_terms: int = BLOCK_TERMS) -> DataFrame:
    """query_id, rank, doc_id, score: the k best documents of each row where is_query holds."""
    spark = documents.sparkSession
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    asked = documents.where(is_query & F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    buckets = bucket_count(rows)
    none = F.lit(-(1 << 63))
    index = materialize(rows.select(F.coalesce("doc_id", none).alias("doc_id"), "text").mapInArrow(_index_mapper, "blob binary, docs bigint, words bigint, turn int"), "index")
    docs, words, shards = (x or 0 for x in index.agg(F.sum("docs"), F.sum("words"), F.count(F.lit(1))).first())
    turns = [F.lit(True)] if shards < MANY_SHARDS else [F.col("turn") == 0, F.col("turn") != 0]
    shipped = index.select("blob").mapInArrow(_frequency_mapper(buckets), SHIPPED).unionByName(asked.mapInArrow(_query_mapper(buckets), SHIPPED))
    terms = exchange(shipped, buckets, _frequency_reducer, "query_id bigint, term bigint, df bigint").distinct()
    terms = materialize(terms, "query-terms")
    free_shuffles(spark)
    # Blocks of queries by hash: their number grows with the queries, their size does not.
    total = terms.count()
    blocks = max(1, -(-total // block_terms))
    found = None
    for block in range(blocks):
        mine = terms.where(F.pmod(F.xxhash64("query_id", F.lit(9)), F.lit(blocks)) == block).toArrow()
        queries = Queries(*(mine.column(c).to_numpy() for c in ("query_id", "term", "df")), docs)
        least = np.full(len(queries.ids), -np.inf)
        for shards in turns:
            part = materialize(index.where(shards).select("blob").mapInArrow(_search_mapper(queries, words / max(docs, 1), k, least), RESULT), "found")
            found = part if found is None else found.unionByName(part)
            if len(turns) > 1 and shards is turns[0]:
                kth = _ranked(part, k).where(F.col("rank") == k).select("query_id", "score").toArrow()
                least[np.searchsorted(queries.ids, kth.column(0).to_numpy())] = kth.column(1).to_numpy()
    release(index, terms)
    return _ranked(found, k).select("query_id", "rank", F.when(F.col("doc_id") == none, None).otherwise(F.col("doc_id")).alias("doc_id"), "score")


ORACLE_SQL = r"""
WITH w AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+')) AS term FROM documents),
tf AS (SELECT doc_id, term, count(*) AS tf FROM w GROUP BY ALL),
dl AS (SELECT doc_id, sum(tf) AS dl FROM tf GROUP BY doc_id),
n AS (SELECT (SELECT count(*) FROM documents) AS n, (SELECT sum(dl) FROM dl) / (SELECT count(*) FROM documents) AS mean),
idf AS (SELECT term, ln(1 + ((SELECT n FROM n) - count(*) + 0.5::DOUBLE) / (count(*) + 0.5::DOUBLE)) AS idf FROM tf GROUP BY term),
s AS (
  SELECT q.doc_id AS query_id, d.doc_id, round(sum(idf * d.tf * 2.2::DOUBLE / (d.tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl.dl / (SELECT mean FROM n)))), 6) AS score
  FROM tf q JOIN tf d USING (term) JOIN idf USING (term) JOIN dl ON dl.doc_id = d.doc_id WHERE q.doc_id % 100 = 0 GROUP BY ALL
)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS INT) AS rank, doc_id, score FROM s
QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) <= 10
"""
