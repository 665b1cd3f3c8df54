"""Operator 4, language model scores: the likelihood of a text over all its segmentations into subword pieces.

The text is its words, lower-cased (A-Z), each with U+2581 before it, and one end. The pieces are those of an existing vocabulary file.
A word's probability is the sum over all segmentations into pieces (and single bytes, so every text has one) of the product of the piece
probabilities: a forward recursion in log space over the word's lattice, many words at a time. A text's log probability is
the sum over its words plus the end's: words are cut at white space, so its lattice is a chain of theirs.

The piece probabilities start from the vocabulary's own scores and are then fitted to the distinct words of all training documents by expectation
maximisation over the same lattices. The vocabulary itself is not changed. A word seen in training has one more arc, from its start to
its end: with count c, N training words and V distinct ones its probability is (c + V * L) / (N + V), L the sum over its segmentations
(Witten-Bell smoothing, so what is gathered grows with the corpus). whole_words=False leaves these arcs out. The
probabilities are fitted for CLASSES latent kinds of text, which the words' own training languages (the most frequent values of
`class_column`, others together) start, and a text's probability is the mixture over the kinds: its own words alone decide how much each counts.

Nothing that grows with the corpus is broadcast: mappers ship their distinct words to buckets, reducers add counts up and write the word
table, which stays in buckets; a second pass asks those buckets for the counts and probabilities of the words of each group of texts.
Only vectors as long as the vocabulary reach the driver.

Null and empty texts have one token, the end. A null doc_id is passed on. Repeated rows count as often as they occur, and get equal scores; there are no ties. A very long text is scored
whole, in a group of its own. Without training text the vocabulary's own
scores apply. An empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ._exchange import SHIPPED, batch, by_key, exchange
from ._store import bucketed, free_shuffles, materialize, modest_batches, release, shuffle_partitions
from ._tokens import Words, gather, lower_az, mix, pack, portions, split_by, unpack
from .pieces import MARK, default_vocabulary, vocabulary

ROUNDS = 3
CLASSES = 4
ADD = 0.1
#: Bytes of text in a group whose words are looked up together.
GROUP_BYTES = 6 << 20
U = np.uint64
LN10 = float(np.log(10))
MARK_BYTE = 0xFF


class Lattices:
    """Arcs of many words at once. Positions are bytes; a piece's bytes are looked up by a rolling hash.

    data, offsets: the words' bytes, without the mark. Position 0 of a word is its mark (3 bytes, one step)."""

    SEED = 0x1B873593

    def __init__(self, names: list[str], ids: np.ndarray, byte_ids: np.ndarray, bytes_everywhere: bool = True) -> None:
        self.byte_ids = byte_ids.copy()
        self.byte_ids[MARK_BYTE] = byte_ids[32]
        self.bytes_everywhere = bytes_everywhere
        raw = [names[i].encode().replace(MARK.encode(), bytes([MARK_BYTE])) for i in ids]
        # Pieces of words, or of marks before one: none has a mark after another character.
        keep = [i for i, r in enumerate(raw) if 0 < len(r) and MARK_BYTE not in r.lstrip(bytes([MARK_BYTE]))]
        raw, self.ids = [raw[i] for i in keep], ids[keep]
        self.longest = max(map(len, raw))
        at = np.concatenate([[0], np.cumsum([len(r) for r in raw])])
        flat = np.frombuffer(b"".join(raw), np.uint8)
        self.table = mix(np.arange(256, dtype=U) + U(self.SEED))
        h = np.zeros(len(raw), U)
        for k in range(self.longest):
            live = np.flatnonzero(np.diff(at) > k)
            h[live] = self.step(h[live], flat[at[live] + k])
        # Filters of all prefixes and all pieces by 24 bits of the hash, so that dead ends stop early.
        order = np.argsort(h)
        self.sorted, self.by = h[order], self.ids[order]
        slot = (self.sorted >> U(44)).astype(np.int64)
        self.slots = np.zeros(1 << 20, np.int32)  # the first piece of a slot; those after it are searched for
        self.slots[slot[::-1]] = np.arange(len(slot), dtype=np.int32)[::-1]
        self.alive = np.zeros(1 << 24, bool)
        self.whole = np.zeros(1 << 24, bool)
        self.whole[(h >> U(40)).astype(np.int64)] = True
        p = np.zeros(len(raw), U)
        for k in range(self.longest):
            live = np.flatnonzero(np.diff(at) > k)
            p[live] = self.step(p[live], flat[at[live] + k])
            self.alive[(p[live] >> U(40)).astype(np.int64)] = True

    def step(self, h: np.ndarray, byte: np.ndarray) -> np.ndarray:
        h = (h ^ self.table[byte]) * U(0x9E3779B97F4A7C15)
        return h ^ (h >> U(29))

    def arcs(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """start, end (in bytes of marked words, see mark()) and piece of every arc."""
        return tuple(np.concatenate(x) for x in zip(*self.arc_lists(data, offsets), strict=True))

    def arc_lists(self, data: np.ndarray, offsets: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """The arcs that are bytes, and those of pieces by rising length. No two arcs of a list begin at one place."""
        n = len(data)
        ends = np.repeat(offsets[1:], np.diff(offsets))
        start, h = np.arange(n), np.zeros(n, U)
        out = [(start, start + 1, self.byte_ids[data])]
        for k in range(self.longest):
            live = start + k < ends[start]
            start, h = start[live], h[live]
            if not len(start):
                break
            h = self.step(h, data[start + k])
            slot = (h >> U(40)).astype(np.int64)
            live = self.alive[slot]
            start, h, slot = start[live], h[live], slot[live]
            maybe = np.flatnonzero(self.whole[slot])
            want = h[maybe]
            i = self.slots[(want >> U(44)).astype(np.int64)].astype(np.int64)
            hit = self.sorted[i] == want
            if not hit.all():
                other = np.flatnonzero(~hit)
                j = np.minimum(np.searchsorted(self.sorted, want[other]), len(self.sorted) - 1)
                i[other], hit[other] = j, self.sorted[j] == want[other]
            found = maybe[hit]
            out.append((start[found], start[found] + k + 1, self.by[i[hit]]))
        if not self.bytes_everywhere:  # bytes only for characters that are no piece
            head = (data & 0xC0) != 0x80
            head[offsets[:-1]] = True
            at, size = np.flatnonzero(head), np.diff(np.append(np.flatnonzero(head), n))
            char = np.cumsum(head) - 1
            known = np.zeros(len(at), bool)
            for a, e, _ in out[1:5]:  # a character has four bytes at most
                one = head[a] & (e - a == size[char[a]])
                known[char[a[one]]] = True
            spelled = ~known[char]
            out[0] = tuple(x[spelled] for x in out[0])
        return out


def mark(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A byte that UTF-8 does not use before each word, for its mark."""
    to = offsets + np.arange(len(offsets))
    out = np.full(len(data) + len(offsets) - 1, MARK_BYTE, np.uint8)
    out[np.arange(len(data)) + np.repeat(np.arange(1, len(offsets)), np.diff(offsets))] = data
    return out, to


class Chart:
    """Forward and backward sums over the arcs of many words, from position to position in step with the words' lengths."""

    def __init__(self, lattices: Lattices, data: np.ndarray, offsets: np.ndarray, marked: bool = False) -> None:
        if not marked:
            data, offsets = mark(data, offsets)
        self.n = len(offsets) - 1
        start, end, piece = lattices.arcs(data, offsets)
        word = np.repeat(np.arange(self.n), np.diff(offsets))
        # Node ids: one more a word than bytes. Depth is the byte within the word.
        self.word = word[start]
        self.start, self.end, self.piece = start + self.word, end + self.word, piece
        self.first, self.last = offsets[:-1] + np.arange(self.n), offsets[1:] + np.arange(self.n)
        self.nodes = len(data) + self.n
        self.sorted = False

    def _by_end(self) -> None:
        """Arcs in the order of their ends' places in the words."""
        depth = self.end - self.first[self.word]
        order = np.argsort(depth * np.int64(self.nodes + 1) + self.end)
        self.word, self.start, self.end, self.piece, depth = (x[order] for x in (self.word, self.start, self.end, self.piece, depth))
        self.levels = np.searchsorted(depth, np.arange(1, (int(depth.max()) if len(depth) else 0) + 2))
        self.sorted = True

    def forward(self, logp: np.ndarray) -> np.ndarray:
        if not self.sorted:
            self._by_end()
        alpha = np.full(self.nodes, -np.inf)
        alpha[self.first] = 0
        w = logp[self.piece]
        for a, b in zip(self.levels[:-1], self.levels[1:], strict=True):
            if a == b:
                continue
            v, to = alpha[self.start[a:b]] + w[a:b], self.end[a:b]
            head = np.flatnonzero(np.concatenate([[True], to[1:] != to[:-1]]))
            top = np.maximum.reduceat(v, head)
            safe = np.where(np.isfinite(top), top, 0)
            size = np.diff(np.append(head, b - a))
            with np.errstate(divide="ignore"):
                alpha[to[head]] = safe + np.log(np.add.reduceat(np.exp(v - np.repeat(safe, size)), head))
        return alpha

    def backward(self, logp: np.ndarray) -> np.ndarray:
        w = logp[self.piece]
        beta = np.full(self.nodes, -np.inf)
        beta[self.last] = 0
        by = np.argsort((self.start - self.first[self.word]) * np.int64(self.nodes + 1) + self.start)
        start, end, v = self.start[by], self.end[by], w[by]
        depth = (self.start - self.first[self.word])[by]
        cuts = np.searchsorted(depth, np.arange((int(depth.max()) if len(depth) else 0) + 2))
        for a, b in zip(cuts[-2::-1], cuts[:0:-1], strict=True):
            if a == b:
                continue
            x, to = beta[end[a:b]] + v[a:b], start[a:b]
            head = np.flatnonzero(np.concatenate([[True], to[1:] != to[:-1]]))
            top = np.maximum.reduceat(x, head)
            safe = np.where(np.isfinite(top), top, 0)
            with np.errstate(divide="ignore"):
                beta[to[head]] = safe + np.log(np.add.reduceat(np.exp(x - np.repeat(safe, np.diff(np.append(head, b - a)))), head))
        return beta

    def expected(self, logp: np.ndarray, weight: np.ndarray, size: int) -> np.ndarray:
        """Expected number of uses of each piece, where each word counts `weight` times."""
        alpha, beta = self.forward(logp), self.backward(logp)
        z = alpha[self.last]
        share = np.exp(np.minimum(alpha[self.start] + logp[self.piece] + beta[self.end] - z[self.word], 0)) * weight[self.word]
        return np.bincount(self.piece, weights=share, minlength=size)


_CACHE: dict[str, Lattices] = {}


def lattices_of(path: str) -> Lattices:
    if path not in _CACHE:
        v = vocabulary(path)
        _CACHE[path] = Lattices(v.names, np.flatnonzero(v.normal), v.byte_ids)
    return _CACHE[path]


def word_slices(offsets: np.ndarray, most: int = 1 << 18) -> Iterator[slice]:
    """Words in runs of about `most` bytes, so that a chart stays small."""
    a = 0
    while a < len(offsets) - 1:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + most, "right")) - 1)
        yield slice(a, b)
        a = b


def _distinct(h: np.ndarray, *sums: np.ndarray) -> tuple:
    """Distinct hashes in order, an index of each, and sums of columns over it."""
    order = np.argsort(h)
    s = h[order]
    head = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]])) if len(s) else np.zeros(0, np.int64)
    return s[head], order[head], [np.add.reduceat(x[order], head, axis=0) if len(s) else x for x in sums]


class _Group:
    """Distinct lower-cased words of a group of texts, with their training counts by class."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, kind: np.ndarray | None, classes: int) -> None:
        self.data = lower_az(data)
        start, end, hashes, sizes = [], [], [], []
        for part in word_slices(offsets, 1 << 20):  # hashing takes many bytes a byte of text
            base = offsets[part.start]
            w = Words(self.data[base : offsets[part.stop]], offsets[part.start : part.stop + 1] - base)
            start.append(w.start + base)
            end.append(w.end + base)
            hashes.append(w.hashes())
            sizes.append(np.diff(w.first))
        none = np.zeros(0, np.int64)
        self.start, self.end, self.hash, self.size = (np.concatenate([none.astype(t), *x]) for x, t in ((start, np.int64), (end, np.int64), (hashes, U), (sizes, np.int64)))
        order = np.argsort(self.hash)
        s = self.hash[order]
        new = np.ones(len(s), bool)
        new[1:] = s[1:] != s[:-1]
        self.distinct, self.at = s[new], order[new]
        #: For each word its place in `distinct`.
        self.word = np.empty(len(s), np.int32)
        self.word[order] = np.cumsum(new) - 1
        self.doc = np.repeat(np.arange(len(self.size), dtype=np.int32), self.size)
        if kind is not None:  # kind -1: not for training
            k = kind[self.doc]
            used = k >= 0
            self.counts = np.bincount(self.word[used] * np.int64(classes) + k[used], minlength=len(self.distinct) * classes).reshape(-1, classes)

    def spelled(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        i = self.at[which]
        return gather(self.data, self.start[i], self.end[i])


def _word_mapper(buckets: int, classes: int) -> Callable:
    """Rows (text, kind): ships (hash, spelling, counts by class) of the distinct training words of each group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            kinds = b.column(1).to_numpy()
            for part, data, offsets in portions(b.column(0), GROUP_BYTES):
                g = _Group(data, offsets, kinds[part], classes)
                used = np.flatnonzero(g.counts.sum(axis=1) > 0)
                places, bounds = split_by((g.distinct[used] % U(buckets)).astype(np.int64), buckets)
                out = []
                for k in range(buckets):
                    if bounds[k] < bounds[k + 1]:
                        i = used[places[bounds[k] : bounds[k + 1]]]
                        flat, at = g.spelled(i)
                        out.append((k, pack(flat, np.diff(at), *g.counts[i].T)))
                if out:
                    yield batch(out)

    return run


def _spelling_hash(flat: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The hash that Words gives these words."""
    spaced, to = np.full(len(flat) + len(at) - 1, 32, np.uint8), at + np.arange(len(at))
    spaced[np.arange(len(flat)) + np.repeat(np.arange(len(at) - 1), np.diff(at))] = flat
    return Words(spaced, np.array([0, len(spaced)])).hashes()


def _word_reducer(classes: int) -> Callable:
    def reduce(bucket: int, blobs: list) -> Iterator[pa.RecordBatch]:
        rows = [unpack(x) for x in blobs]
        flat = np.concatenate([r[0] for r in rows])
        size = np.concatenate([r[1].astype(np.int64) for r in rows])
        at = np.concatenate([[0], np.cumsum(size)])
        counts = np.stack([np.concatenate([r[2 + k].astype(np.int64) for r in rows]) for k in range(classes)], axis=1)
        h = _spelling_hash(flat, at)
        h, i, (total,) = _distinct(h, counts)
        words, ends = gather(flat, at[i], at[i + 1])
        yield pa.RecordBatch.from_arrays(
            [pa.array([bucket], pa.int32()), pa.array([pack(words, np.diff(ends), *total.T)], pa.binary()), pa.array([len(h)], pa.int64()), pa.array([(total > 0).sum(axis=0).tolist()], pa.list_(pa.int64())), pa.array([total.sum(axis=0).tolist()], pa.list_(pa.int64()))],
            ["bucket", "blob", "v", "kinds", "uses"],
        )

    return reduce


def _expectations(path: str, logp: np.ndarray) -> Callable:
    """Rows (blob): expected piece counts by class of the distinct words of each blob."""
    classes, size = logp.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, seen = np.zeros((classes, size)), False
        for b in batches:
            for blob in b.column(0):
                flat, length, *counts = unpack(blob.as_py())
                at = np.concatenate([[0], np.cumsum(length.astype(np.int64))])
                counts = np.stack([np.minimum(c, 1).astype(float) for c in counts])
                if classes == 1:
                    counts = counts.max(axis=0, keepdims=True)
                for s in word_slices(at):
                    chart = Chart(lattices_of(path), flat[at[s.start] : at[s.stop]], at[s.start : s.stop + 1] - at[s.start])
                    for k in range(classes):
                        if counts[k, s].any():
                            total[k] += chart.expected(logp[k], counts[k, s], size)
                seen = True
        if seen:
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["sums"])

    return run


def _add_up(parts: DataFrame) -> np.ndarray | None:
    """The sum of packed float vectors, in a tree of bounded fan-in."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for b in batches:
            for x in b.column(0):
                v = np.frombuffer(x.as_py(), float)
                total = v.copy() if total is None else total + v
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["sums"])

    rows = parts.repartition(16).mapInArrow(run, "sums binary").collect()
    return sum(np.frombuffer(r[0], float) for r in rows) if rows else None


def fit(words: DataFrame, path: str, classes: int, rounds: int = ROUNDS) -> np.ndarray:
    """Piece log probabilities by class."""
    v = vocabulary(path)
    normal = v.normal | v.is_byte
    base = np.where(normal, np.exp(v.logp), 0)
    logp = np.tile(v.logp, (1, 1))
    for n in range(rounds):
        # The classes part in the last round; those before fit what they share.
        apart = classes if n == rounds - 1 else 1
        got = _add_up(words.select("blob").mapInArrow(_expectations(path, np.repeat(logp, apart, axis=0)), "sums binary"))
        if got is None:
            break
        got = got.reshape(apart, -1)
        # A prior of a thousand uses, shared by the vocabulary's own probabilities and all classes' uses, keeps unseen pieces possible.
        pooled = (got.sum(axis=0) + 1000 * base) / (got.sum() + 1000)
        every = got + 1000 * pooled
        with np.errstate(divide="ignore"):
            logp = np.where(normal, np.log(every / every.sum(axis=1)[:, None]), -np.inf)
    logp = logp if len(logp) == classes else np.repeat(logp, classes, axis=0)
    return logp


def _ask_mapper(buckets: int) -> Callable:
    """Rows (chunk, text) in runs of one chunk: ships the distinct words of each chunk to their buckets."""

    def run(chunk: int, data: np.ndarray, offsets: np.ndarray, partial: bool) -> list[tuple[int, bytes]]:
        g = _Group(data, offsets, None, 0)
        places, bounds = split_by((g.distinct % U(buckets)).astype(np.int64), buckets)
        out = []
        for k in range(buckets):
            if bounds[k] < bounds[k + 1]:
                i = places[bounds[k] : bounds[k + 1]]
                flat, at = g.spelled(i)
                # A chunk that the reader may have cut names its words in the answer; a whole one has them in order.
                out.append((k, pack(np.array([chunk]), flat, np.diff(at), g.distinct[i] if partial else np.zeros(0, U))))
        return out

    return run


def score_texts(
    documents: DataFrame, train: F.Column, path: str | None = None, class_column: str | None = "lang", classes: int = CLASSES, rounds: int = ROUNDS, whole_words: bool = True
) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score (word unigram), score (this model), lattice_score (the vocabulary's own scores alone: the sum over
    the words of the log of the sum over their segmentations, without the end), all log10.

    train: a condition on the rows to learn from."""
    spark = documents.sparkSession
    modest_batches(spark)
    path = path or default_vocabulary()
    text = F.coalesce("text", F.lit(""))
    kind = F.lit(0)
    if class_column:
        top = documents.where(train).groupBy(class_column).count().where(F.col(class_column).isNotNull()).orderBy(F.desc("count"), class_column).limit(classes - 1).collect()
        for i, r in enumerate(top):
            kind = F.when(F.col(class_column) == r[0], i + 1).otherwise(kind)
    rows = documents.select(F.col("doc_id"), text.alias("text"), F.when(train, kind).otherwise(F.lit(-1)).cast("int").alias("kind"))
    stats = rows.agg(F.sum(F.octet_length("text")), *[F.sum((F.col("kind") == k).cast("long")) for k in range(classes)]).first()
    size, texts_by_class = stats[0] or 0, [x or 0 for x in stats[1:]]
    buckets = max(2 * shuffle_partitions(spark), -(-size // (16 << 20)))
    words = exchange(rows.select("text", "kind").mapInArrow(_word_mapper(buckets, classes), SHIPPED), buckets, _word_reducer(classes), "bucket int, blob binary, v bigint, kinds array<bigint>, uses array<bigint>")
    words = materialize(words, "words")
    free_shuffles(spark)
    told = words.agg(F.sum("v"), *[F.sum(F.col(c)[k]) for c in ("kinds", "uses") for k in range(classes)]).first()
    v, *by_class = (x or 0 for x in told)
    kinds, uses = np.array(by_class[:classes], float), np.array(by_class[classes:], float)
    texts = np.array(texts_by_class, float)
    trained = int(texts.sum())
    # The end is a token of each training text.
    v, n = v + (trained > 0), int(uses.sum()) + trained
    logp = fit(words, path, classes, rounds if trained else 0)
    end = (texts + 1) / (uses + texts + 1000)
    model = {
        "logp": logp, "end": np.log(end), "weight": np.log((texts + 1) / (texts + 1).sum()),
        "own": vocabulary(path).logp, "kinds": kinds if whole_words else np.zeros(classes), "uses": uses if whole_words else np.zeros(classes), "go_on": np.log1p(-end), "whole": whole_words,
    }
    parts = max(shuffle_partitions(spark), -(-size // GROUP_BYTES) // 4)
    numbered = rows.select("doc_id", "text").mapInArrow(_chunks, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, text string, chunk bigint")
    held = bucketed(numbered, "chunks", "chunk", parts)
    out = materialize(_answer(held, words, buckets, path, model, v, n, trained), "scores")
    release(held, words)
    return out


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Numbers runs of about GROUP_BYTES of text; the written table fixes the numbers."""
    from pyspark import TaskContext

    chunk, size = TaskContext.get().partitionId() << 32, 0
    for b in batches:
        for part, data, _ in portions(b.column(1), 1 << 20):
            if size >= GROUP_BYTES:
                chunk, size = chunk + 1, 0
            size += len(data)
            yield pa.RecordBatch.from_arrays([b.column(0)[part], b.column(1)[part], pa.array(np.full(part.stop - part.start, chunk))], ["doc_id", "text", "chunk"])


def _answer(held: DataFrame, words: DataFrame, buckets: int, path: str, model: dict, v: int, n: int, trained: int) -> DataFrame:
    logp = model["logp"]
    classes = len(logp)
    ask = _ask_mapper(buckets)
    floor = np.log10(n + ADD * (v + 1)) if n + v else 0.0

    def asks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before, first = None, True
        for group in by_key(batches, 1):
            if before is not None:
                if out := ask(before[0], *_texts(before[1].column(0)), first):
                    yield batch(out)
                first = False
            before = group
        if before is not None and (out := ask(before[0], *_texts(before[1].column(0)), True)):
            yield batch(out)

    def reply(bucket: int, blobs: list) -> Iterator[pa.RecordBatch]:
        known = [x for x in blobs if x[:1] == b"W"]
        asked = [unpack(x[1:]) for x in blobs if x[:1] == b"A"]
        if not asked:
            return
        spelled, sizes = [], []
        for _, flat, length, _ in asked:
            spelled.append(flat)
            sizes.append(length.astype(np.int64))
        flat = np.concatenate(spelled)
        at = np.concatenate([[0], np.cumsum(np.concatenate(sizes))])
        h = _spelling_hash(flat, at)
        distinct, i, _ = _distinct(h)
        counts = np.zeros((classes, len(distinct)), np.int64)
        for x in known:
            words_flat, length, *c = unpack(x[1:])
            kh = _spelling_hash(words_flat, np.concatenate([[0], np.cumsum(length.astype(np.int64))]))
            where = np.minimum(np.searchsorted(distinct, kh), len(distinct) - 1)
            ok = distinct[where] == kh
            for k in range(classes):
                counts[k, where[ok]] += c[k].astype(np.int64)[ok]
        own, ends = gather(flat, at[i], at[i + 1])
        logs = np.zeros((classes + 1, len(distinct)))
        for s in word_slices(ends):
            chart = Chart(lattices_of(path), own[ends[s.start] : ends[s.stop]], ends[s.start : s.stop + 1] - ends[s.start])
            for k, weights in enumerate((*logp, model["own"])):
                logs[k, s] = chart.forward(weights)[chart.last]
        for k in range(classes):
            if model["whole"] and model["kinds"][k]:
                logs[k] = np.log(counts[k] + model["kinds"][k] * np.exp(logs[k])) - np.log(model["uses"][k] + model["kinds"][k])
            logs[k] += model["go_on"][k]
        a, out = 0, []
        for chunk, _, length, names in asked:
            w = np.searchsorted(distinct, h[a : a + len(length)])
            a += len(length)
            # The largest float32 error of a word's log probability is a millionth.
            out.append((int(chunk[0]), pack(np.array([bucket]), names.astype(U), counts.sum(axis=0)[w], *logs[:, w].astype(np.float32))))
        yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out]), pa.array([x[1] for x in out], pa.binary())], ["chunk", "blob"])

    kind = to_arrow_type(held.schema["doc_id"].dataType)
    empty = pa.table({"doc_id": pa.array([], kind)} | {c: pa.array([], pa.int64()) for c in ("n_tokens", "n_known", "train_tokens")} | {c: pa.array([], pa.float64()) for c in ("base_score", "score", "lattice_score")})

    def score(docs: pa.Table, answers: pa.Table) -> pa.Table:
        if not docs.num_rows:
            return empty
        data, offsets = _texts(docs.column(1))
        g = _Group(data, offsets, None, 0)
        counts, logs = np.zeros(len(g.distinct), np.int64), np.zeros((classes + 1, len(g.distinct)))
        places, bounds = split_by((g.distinct % U(buckets)).astype(np.int64), buckets)
        for x in (a.as_py() for a in answers.column(1)):
            told, names, c, *parts_logs = unpack(x)
            k = int(told[0])  # packed in as few bytes as it fits: k + 1 must not wrap
            i = np.searchsorted(g.distinct, names.astype(U)) if len(names) else places[bounds[k] : bounds[k + 1]]
            counts[i] = c
            logs[:, i] = parts_logs
        word, doc, size = g.word, g.doc, len(offsets) - 1
        total = lambda x: np.bincount(doc, weights=x, minlength=size)
        tokens = g.size + 1
        known = total((counts[word] > 0).astype(float)).astype(np.int64) + (1 if trained else 0)
        base = total(np.log10(counts[word] + ADD)) + np.log10(trained + ADD) - tokens * floor
        each = np.stack([total(logs[k][word]) + model["end"][k] + model["weight"][k] for k in range(classes)])
        top = each.max(axis=0)
        likely = (top + np.log(np.exp(each - top).sum(axis=0))) / LN10
        return pa.Table.from_arrays(
            [docs.column(0), pa.array(tokens.astype(np.int64)), pa.array(known), pa.array(np.full(size, n, np.int64)), pa.array(base), pa.array(likely), pa.array(total(logs[classes][word]) / LN10)],
            ["doc_id", "n_tokens", "n_known", "train_tokens", "base_score", "score", "lattice_score"],
        )

    tag = lambda df, letter: df.select("bucket", F.concat(F.lit(letter).cast("binary"), F.col("blob")).alias("blob"))
    asked = tag(held.select("text", "chunk").mapInArrow(asks, SHIPPED), "A")
    answers = exchange(asked.unionByName(tag(words.select("bucket", "blob"), "W")), buckets, reply, "chunk bigint, blob binary")
    doc_type = held.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {doc_type}, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double, lattice_score double"
    return held.select("doc_id", "text", "chunk").groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(score, schema)


def _texts(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    from ._tokens import strings

    return strings(column.cast(pa.large_string()))
