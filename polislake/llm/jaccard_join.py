"""Operator 10, exact n-gram Jaccard join by T-occurrence search.

A document's set is its distinct SHINGLE-word shingles of lower-cased (A-Z) words, as 64-bit hashes; a text of fewer words is one
shingle. Documents with equal sets are one node. Two nodes link when 100 * intersection >= PERCENT * union.

1. Linked sets of size n share one of the first n - ceil(PERCENT * n / 100) + 1 shingles of each in any common order. The order is by hash,
   with frequent shingles last (a first pass counts them), so that common lines and passages seldom bring documents together.
2. Documents of like size (classes a factor PERCENT apart, each with its neighbour) that share such a shingle are members of the group of the least
   of them; a mapper ships the least of its own only.
3. In a group, signatures (how many elements lie in each of about n / 2 equal ranges of the hash) bound the difference of two sets from
   below; documents that this bound lets link are chained. Components of the chains are blocks. A pair that links is in one block, and
   documents that share a shingle by chance are not. Large groups are cut into slices whose pairs are tasks.
4. A block is cut into slices of SLICE set elements; each pair of slices is a task of bounded size, so a block of any size is searched exactly.
5. In a task each document, against an inverted index, looks for partners that reach its required overlap T: DivideSkip sets its longest lists
   aside, merges the short ones in list order, keeps what occurs often enough there, and probes the long lists by binary search.
   Documents already known to be in one component are not compared again, so a group of copies costs its size and not its square.
   A task returns the links of a spanning forest.

No pairs of a group are ever made as rows. Both sides of a comparison are counted on whole sets.

Null, empty and blank texts have an empty set and link with nothing, not even each other. Rows that repeat a doc_id are documents of
their own with one id. A null doc_id is a document whose component_id is the least non-null id of its component, if any.
Ties: the least doc_id names a component, and rows that share it are all members. A very long text is a set like any other; memory grows with the longest.
An empty table gives an empty result. Other columns are not read.

The links returned are those of a spanning forest: all that components need, not the number of links of each document.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._exchange import SHIPPED, batch, bucket_count, by_key, exchange
from ._graph import components
from ._store import free_shuffles, fresh, materialize, release
from ._tokens import Words, constants, gram_starts, grams, mix, pack, portions, split_by, unpack

SHINGLE = 4
PERCENT = 85
#: Set elements in a slice of a block.
SLICE = 400_000
#: A shingle is frequent if more than this many of all documents' prefixes hold it, or one in COMMON_SHARE of all documents.
COMMON, COMMON_SHARE = 200, 10_000
FLUSH = 1_000_000
#: Documents in a slice of a group.
GROUP_SLICE = 1_000
#: Most bytes of the filter that keeps documents without candidates from being moved.
BLOOM_BYTES = 16 << 20
#: A list longer than this is merged with others by sorting rather than by a heap; the same merge, fewer Python steps.
HEAP_POSTINGS = 24
U = np.uint64


class Sets:
    """The shingle sets of some texts: `values` by text (each sorted), `first` offsets, `size`."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, n: int, seed: int, check: bool = False) -> None:
        """check: also hashes the shingles anew, from their words on, for check_key()."""
        w = Words(data, offsets)
        count = np.diff(w.first)
        at, doc = gram_starts(w.first, n)
        short = np.flatnonzero((count > 0) & (count < n))
        values = self._shingles(w, n, seed, at, short, count)
        if len(short):
            doc = np.concatenate([doc, short])
        order = np.lexsort((values, doc))
        values, doc = values[order], doc[order]
        new = np.ones(len(values), bool)
        new[1:] = (values[1:] != values[:-1]) | (doc[1:] != doc[:-1])
        self.values, self.doc = values[new], doc[new]
        self.first = np.searchsorted(self.doc, np.arange(len(offsets)))
        self.size = np.diff(self.first)
        if check:
            self.others = self._shingles(w, n, seed + 0x10001, at, short, count)[order[new]]

    @staticmethod
    def _shingles(w: Words, n: int, seed: int, at: np.ndarray, short: np.ndarray, count: np.ndarray) -> np.ndarray:
        """Hashes of the shingles that begin at `at`, then of the whole sequences of `short`."""
        h = w.hashes(seed, lower=True)
        values = grams(h, n, seed)[at] if len(at) else np.zeros(0, U)
        if not len(short):
            return values
        c = constants(seed + 303, n)
        own = [mix(np.array([(h[w.first[i] : w.first[i + 1]] * c[: count[i]]).sum() + U(int(count[i]))], U))[0] for i in short]
        return np.concatenate([values, np.array(own, U)])

    def key(self) -> np.ndarray:
        """A 64-bit hash of each set."""
        return self._sum_of(self.values, 0x51ED270B)

    def check_key(self) -> np.ndarray:
        """A second hash of each set, from the second hashes of its shingles."""
        return self._sum_of(self.others, 0x2545F491)

    def _sum_of(self, values: np.ndarray, salt: int) -> np.ndarray:
        sums = np.concatenate([[U(0)], np.cumsum(mix(values ^ U(salt)))])
        return mix(sums[self.first[1:]] - sums[self.first[:-1]] + self.size.astype(U)).view(np.int64)

    def signatures(self) -> list[bytes]:
        """Elements in each of a power of two of equal hash ranges, at most 255 each."""
        out = []
        for a, b in zip(self.first[:-1], self.first[1:], strict=True):
            k = max(int(b - a) // 2, 1).bit_length() - 1
            ranges = (self.values[a:b] >> U(63 - k) >> U(1)).astype(np.int64)
            out.append(np.minimum(np.bincount(ranges, minlength=1 << k), 255).astype(np.uint8).tobytes())
        return out


def size_class(n: np.ndarray, percent: int) -> np.ndarray:
    """Sizes of which the smaller is at least `percent` of the larger are in one class or in neighbours."""
    bounds, x = [1], 1
    while x <= int(n.max(initial=1)):
        x = max(x + 1, -(-x * 100 // percent))
        bounds.append(x)
    return np.searchsorted(np.array(bounds), n, "right")


def least_overlap(n, percent: int):
    return (percent * n + 99) // 100


def short_name(values: np.ndarray, buckets: int) -> np.ndarray:
    """What is left of a shingle's hash once it is shipped: its bucket and 40 bits. Enough to bring candidates together."""
    b = U(buckets)
    return ((values // b) & U(0xFFFFFFFFFF)) * b + values % b


def _prefix(sets: Sets, percent: int, buckets: int, common: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Places in `values` of the prefix shingles, and their texts."""
    names = short_name(sets.values, buckets)
    rank = np.zeros(len(names), np.int64)
    if len(common[0]):
        i = np.minimum(np.searchsorted(common[0], names), len(common[0]) - 1)
        rank = np.where(common[0][i] == names, common[1][i], 0)
    order = np.lexsort((sets.values, rank, sets.doc)) if rank.any() else np.arange(len(names))
    doc = sets.doc[order]
    place = np.arange(len(names)) - sets.first[:-1][doc]
    keep = place < (sets.size - least_overlap(sets.size, percent) + 1)[doc]
    return order[keep], doc[keep]


def _ship(buckets: int, name: np.ndarray, node: np.ndarray, counts_only: bool) -> list[tuple[int, bytes]]:
    order = np.lexsort((node, name))
    name, node = name[order], node[order]
    new = np.ones(len(name), bool)
    new[1:] = (name[1:] != name[:-1]) | (node[1:] != node[:-1])
    name, node = name[new], node[new]
    head = np.flatnonzero(np.concatenate([[True], name[1:] != name[:-1]]))
    size = np.diff(np.append(head, len(name)))
    out = []
    ship_name, ship_node = name[head], node[head]
    places, bounds = split_by((ship_name % U(buckets)).astype(np.int64), buckets)
    for b in range(buckets):
        if bounds[b] < bounds[b + 1]:
            i = places[bounds[b] : bounds[b + 1]]
            rest = ship_name[i] // U(buckets)
            body = size[i] if counts_only else ship_node[i]
            out.append((b, pack(np.zeros(1, np.uint8), (rest & U(0xFFFFFFFF)).astype(np.uint32), (rest >> U(32)).astype(np.uint8), body)))
    if not counts_only and len(name) > len(head):
        other = np.ones(len(name), bool)
        other[head] = False
        pairs = np.unique(np.stack([node[other], np.repeat(node[head], size)[other]]), axis=1)
        out.append((int(name[0] % U(buckets)), pack(np.ones(1, np.uint8), pairs[0], pairs[1])))
    return out


def _prefix_mapper(n: int, percent: int, seed: int, buckets: int, common: tuple[np.ndarray, np.ndarray], counts_only: bool) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, nodes, held = [], [], 0
        for b in batches:
            for _, data, offsets in portions(b.column(0)):
                sets = Sets(data, offsets, n, seed)
                at, doc = _prefix(sets, percent, buckets, common)
                value, node = sets.values[at], sets.key()[doc]
                if not counts_only:  # one name a size class and its neighbour
                    c = size_class(sets.size, percent)[doc].astype(U)
                    value = np.concatenate([mix(value + (c + U(k)) * U(0xD6E8FEB86659FD93)) for k in (0, 1)])
                    node = np.concatenate([node, node])
                names.append(short_name(value, buckets))
                nodes.append(node)
                held += len(node)
                if held >= FLUSH:
                    yield batch(_ship(buckets, np.concatenate(names), np.concatenate(nodes), counts_only))
                    names, nodes, held = [], [], 0
        if held:
            yield batch(_ship(buckets, np.concatenate(names), np.concatenate(nodes), counts_only))

    return run


def _joined_names(bucket: int, buckets: int, rows: list) -> np.ndarray:
    return ((np.concatenate([r[2] for r in rows]).astype(U) << U(32)) | np.concatenate([r[1] for r in rows]).astype(U)) * U(buckets) + U(bucket)


def _count_reducer(buckets: int, over: int) -> Callable:
    def reduce(bucket: int, blobs: list) -> Iterator[pa.RecordBatch]:
        rows = [unpack(x) for x in blobs]
        name, n = _joined_names(bucket, buckets, rows), np.concatenate([r[3] for r in rows]).astype(np.int64)
        order = np.argsort(name, kind="stable")
        name, n = name[order], n[order]
        head = np.flatnonzero(np.concatenate([[True], name[1:] != name[:-1]]))
        total = np.add.reduceat(n, head)
        keep = total > over
        yield pa.RecordBatch.from_arrays([pa.array(name[head][keep].view(np.int64)), pa.array(total[keep])], ["name", "n"])

    return reduce


def _group_reducer(buckets: int) -> Callable:
    """a: a node, b: the least node of a group of its mapper (local) or of all mappers."""

    def reduce(bucket: int, blobs: list) -> Iterator[pa.RecordBatch]:
        rows = [unpack(x) for x in blobs]
        local = [np.stack([r[1].astype(np.int64), r[2].astype(np.int64)]) for r in rows if r[0][0] == 1]
        if local:
            yield _edges(np.unique(np.concatenate(local, axis=1), axis=1), True)
        rows = [r for r in rows if r[0][0] == 0]
        if rows:
            name, node = _joined_names(bucket, buckets, rows), np.concatenate([r[3].astype(np.int64) for r in rows])
            order = np.lexsort((node, name))
            name, node = name[order], node[order]
            head = np.flatnonzero(np.concatenate([[True], name[1:] != name[:-1]]))
            least = np.repeat(node[head], np.diff(np.append(head, len(name))))
            other = node != least
            if other.any():
                yield _edges(np.unique(np.stack([node, least])[:, other], axis=1), False)

    return reduce


def _edges(pairs: np.ndarray, local: bool) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(pairs[0]), pa.array(pairs[1]), pa.array(np.full(len(pairs[0]), local))], ["a", "b", "local"])


def possible_links(nodes: np.ndarray, size: np.ndarray, signatures: list[bytes], percent: int) -> Iterator[tuple[int, int]]:
    """Star edges of the components of `nodes` under "the signatures allow a link"."""
    sig = [np.frombuffer(x, np.uint8).astype(np.int32) for x in signatures]
    fold = lambda v: v.reshape(-1, 2).sum(axis=1)
    width = np.array([len(v) for v in sig])
    levels: dict[int, tuple[np.ndarray, np.ndarray]] = {}  # at a width: signatures of that width, and of twice that width folded
    for w in np.unique(width):
        own = np.flatnonzero(width == w)
        for level, rows in ((w, [sig[i] for i in own]), (w // 2, [fold(sig[i]) for i in own] if w > 1 else [])):
            if rows:
                held = levels.get(level)
                rows = np.stack(rows)
                levels[level] = (own, rows) if held is None else (np.concatenate([held[0], own]), np.concatenate([held[1], rows]))
    left = np.ones(len(nodes), bool)
    for root in np.argsort(nodes, kind="stable"):
        if not left[root]:
            continue
        left[root] = False
        todo, found = [root], [root]
        while todo:
            x = todo.pop()
            for level, mine in ((width[x], sig[x]), (width[x] // 2, fold(sig[x]) if width[x] > 1 else None)):
                if mine is None or level not in levels:
                    continue
                who, rows = levels[level]
                near = left[who] & (100 * np.minimum(size[who], size[x]) >= percent * np.maximum(size[who], size[x]))
                if not near.any():
                    continue
                who, rows = who[near], rows[near]
                apart = np.abs(rows - mine).sum(axis=1)
                # intersection <= (|x| + |y| - difference) / 2, and a link needs percent * (|x| + |y|) / (100 + percent).
                fit = who[(100 + percent) * (size[who] + size[x] - apart) >= 2 * percent * (size[who] + size[x])]
                left[fit] = False
                todo.extend(fit.tolist())
                found.extend(fit.tolist())
            if not left.any():
                todo.clear()
        for y in found[1:]:
            yield int(nodes[y]), int(nodes[root])


def _chain_mapper(percent: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = [], []
        for _, t in by_key(batches, 0):
            if t.num_rows > 1:
                for x, y in possible_links(t.column(1).to_numpy(), t.column(2).to_numpy(), t.column(3).to_pylist(), percent):
                    a.append(x)
                    b.append(y)
            if len(a) > 50_000:
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])
                a, b = [], []
        if a:
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return run


def chains_of(groups: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """Chains (a, b) among the members of each group that their signatures allow to link."""
    local = groups.where("local").select("a", "b")
    wide = groups.where("NOT local").select(F.col("a").alias("b"), F.col("b").alias("c"))
    through = local.join(wide, "b").select("a", F.col("c").alias("b"))
    leaders = groups.select(F.col("b").alias("a"), "b")
    members = materialize(groups.select("a", "b").unionByName(through).unionByName(leaders).distinct(), "group-members")
    counts = materialize(members.groupBy("b").agg(F.ceil(F.count(F.lit(1)) / GROUP_SLICE).cast("int").alias("slices")).where("slices > 1").withColumnRenamed("b", "large"), "large-groups")
    m, s = F.coalesce("slices", F.lit(1)), F.pmod(F.xxhash64("a", F.lit(2)), F.coalesce("slices", F.lit(1)).cast("long"))
    others = F.filter(F.sequence(F.lit(0).cast("long"), m - F.lit(1).cast("long")), lambda j: (m == 1) | (j != s))
    tasks = F.transform(others, lambda j: F.xxhash64("b", F.least(s, j), F.greatest(s, j)))
    placed = members.join(counts, F.col("b") == F.col("large"), "left").select(F.col("a").alias("node"), F.explode(tasks).alias("task"))
    told = placed.join(nodes.select("node", "n", "signature"), "node").select("task", "node", "n", "signature")
    return told.repartition("task").sortWithinPartitions("task").mapInArrow(_chain_mapper(percent), "a bigint, b bigint")


def bloom_filter(keys: DataFrame, count: int) -> np.ndarray:
    """A Bloom filter of a bigint column: 16 bits a key, at most BLOOM_BYTES; a fuller one only lets more rows through."""
    size = 1 << min(BLOOM_BYTES.bit_length() - 1, max(10, (2 * count).bit_length()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(size, np.uint8)
        for b in batches:
            for at in _probes(b.column(0).to_numpy(), size):
                np.bitwise_or.at(bits, at >> 3, (1 << (at & 7)).astype(np.uint8))
        yield pa.RecordBatch.from_arrays([pa.array([bits.tobytes()], pa.binary())], ["bits"])

    out = np.zeros(size, np.uint8)
    for r in keys.repartition(8).mapInArrow(run, "bits binary").collect():
        out |= np.frombuffer(r[0], np.uint8)
    return out


def _probes(keys: np.ndarray, size: int) -> Iterator[np.ndarray]:
    h = mix(keys.astype(np.int64).view(U))
    for i in range(3):
        yield ((h >> U(20 * i)) * U(0x9E3779B97F4A7C15) >> U(64 - size.bit_length() - 2)).astype(np.int64)


def _maybe_in(bits: np.ndarray) -> Callable:
    """Passes on the rows (row, text) whose row may be in the filter."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ok = np.ones(b.num_rows, bool)
            for at in _probes(b.column(0).to_numpy(), len(bits)):
                ok &= (bits[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)
            yield b.filter(pa.array(ok))

    return run


class _Forest:
    def __init__(self, n: int) -> None:
        self.up = np.arange(n)

    def find(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return int(i)

    def roots(self) -> np.ndarray:
        while True:
            up = self.up[self.up]
            if (up == self.up).all():
                return up
            self.up = up


def merge_counts(lists: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Members of sorted lists and how many lists hold each: a heap for few postings, a sort of the same sequence for many."""
    total = sum(map(len, lists))
    if total == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    if total > HEAP_POSTINGS:
        return np.unique(np.concatenate(lists), return_counts=True)
    heap = [(int(x[0]), i, 0) for i, x in enumerate(lists) if len(x)]
    heapq.heapify(heap)
    members, counts = [], []
    while heap:
        value, i, at = heap[0]
        if members and members[-1] == value:
            counts[-1] += 1
        else:
            members.append(value)
            counts.append(1)
        if at + 1 < len(lists[i]):
            heapq.heapreplace(heap, (int(lists[i][at + 1]), i, at + 1))
        else:
            heapq.heappop(heap)
    return np.array(members, np.int64), np.array(counts, np.int64)


def spanning_links(sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Index pairs of a spanning forest of the links among these sets (each sorted and without repeats)."""
    n = len(sets)
    size = np.array([len(s) for s in sets], np.int64)
    forest, links = _Forest(n), []

    def join(a: int, b: int) -> None:
        x, y = forest.find(a), forest.find(b)
        if x != y:
            forest.up[max(x, y)] = min(x, y)
            links.append((a, b))

    order = np.argsort(size, kind="stable")
    flat = np.concatenate([sets[i] for i in order])
    owner = np.repeat(np.arange(n), size[order])  # by rank in size order, so lists run from small to large sets
    ranked = size[order]
    by = np.lexsort((owner, flat))
    flat, owner = flat[by], owner[by]
    head = np.flatnonzero(np.concatenate([[True], flat[1:] != flat[:-1]]))
    tokens, bounds = flat[head], np.append(head, len(flat))
    lengths = np.diff(bounds)
    # A set in the middle of a group of copies links most of it at once.
    at = np.searchsorted(tokens, sets[order[n // 2]])
    shared = np.bincount(np.concatenate([owner[bounds[i] : bounds[i + 1]] for i in at]), minlength=n)
    pivot = n // 2
    for y in np.flatnonzero((100 + percent) * shared >= percent * (ranked + ranked[pivot])):
        join(int(order[pivot]), int(order[y]))
    rank_of_root = lambda: forest.roots()[order]
    roots = rank_of_root()
    for x in range(n):
        s = sets[order[x]]
        t = int(least_overlap(len(s), percent))
        i = np.searchsorted(tokens, s)
        low = np.searchsorted(ranked, t)  # a partner of x that is not larger has at least t elements
        of = lengths[i]
        # DivideSkip: the longest lists are set aside, as many as the overlap can do without.
        apart = min(t - 1, int(t / (0.3 * np.log2(max(int(of.max()), 2)) + 1)), len(s))
        by_length = np.argsort(of, kind="stable")
        merged, probed = by_length[: len(s) - apart], by_length[len(s) - apart :]
        own = roots[x]
        parts = []
        for j in merged:
            k = i[j]
            if of[j] == 1:
                continue
            p = owner[bounds[k] : bounds[k + 1]]
            p = p[(p >= low) & (p < x)]
            if len(p):
                p = p[roots[p] != own]
                if len(p):
                    parts.append(p)
        if not parts:
            continue
        members, counts = merge_counts(parts)
        need = -(-percent * (len(s) + ranked[members]) // (100 + percent))
        ok = counts + apart >= need
        members, counts, need = members[ok], counts[ok].copy(), need[ok]
        if not len(members):
            continue
        for j in probed:
            k = i[j]
            p = owner[bounds[k] : bounds[k + 1]]
            where = np.minimum(np.searchsorted(p, members), len(p) - 1)
            counts += p[where] == members
        for y in members[counts >= need]:
            join(int(order[x]), int(order[y]))
        if (counts >= need).any():
            roots = rank_of_root()
    return links


def _slice_mapper(n: int, seed: int, buckets: int) -> Callable:
    """Ships the set of each row (text, node, block, slices, slice) to every task its slice takes part in."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        size = 0

        def ship() -> pa.RecordBatch:
            nonlocal held, size
            rows = [(b, pack(np.array([x[0] for x in v], U), np.array([x[1] for x in v]), np.array([len(x[2]) for x in v]), np.concatenate([x[2] for x in v]))) for b, v in held.items()]
            held, size = {}, 0
            return batch(rows)

        for b in batches:
            nodes, blocks, slices, own = (b.column(i).to_numpy() for i in (1, 2, 3, 4))
            for part, data, offsets in portions(b.column(0)):
                sets = Sets(data, offsets, n, seed)
                for i in range(part.start, part.stop):
                    values = sets.values[sets.first[i - part.start] : sets.first[i - part.start + 1]]
                    m, s = int(slices[i]), int(own[i])
                    pairs = [(0, 0)] if m == 1 else [(min(s, j), max(s, j)) for j in range(m) if j != s]
                    for p in pairs:
                        key = mix(np.array([int(blocks[i]) % (1 << 64), p[0] * 2654435761 + p[1] + 1], U))
                        task = int(mix(key[:1] + key[1:])[0])
                        held.setdefault(task % buckets, []).append((task, int(nodes[i]), values))
                        size += len(values) + 8
                    if size >= FLUSH:
                        yield ship()
        if held:
            yield ship()

    return run


def _link_reducer(percent: int) -> Callable:
    def reduce(_: int, blobs: list) -> Iterator[pa.RecordBatch]:
        groups: dict[int, list] = {}
        for x in blobs:
            task, node, size, values = unpack(x)
            for t, v, s in zip(task.tolist(), node.astype(np.int64).tolist(), np.split(values.astype(U), np.cumsum(size.astype(np.int64))[:-1]), strict=True):
                groups.setdefault(t, []).append((v, s))
        a, b = [], []
        for members in groups.values():
            if len(members) > 1:
                members.sort(key=lambda m: m[0])
                for i, j in spanning_links([m[1] for m in members], percent):
                    a.append(members[i][0])
                    b.append(members[j][0])
        if a:
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return reduce


def _node_mapper(n: int, seed: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part, data, offsets in portions(b.column(2)):
                sets = Sets(data, offsets, n, seed, check=True)
                k = slice(part.start, part.stop)
                yield pa.RecordBatch.from_arrays(
                    [b.column(0)[k], b.column(1)[k], pa.array(sets.size.astype(np.int64)), pa.array(sets.key()), pa.array(sets.check_key()), pa.array(sets.signatures(), pa.binary())], ["doc_id", "row", "n_shingles", "node", "check", "signature"]
                )

    return run


def jaccard_components(documents: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT, slice_elements: int = SLICE) -> DataFrame:
    """doc_id, row (a hash of the row), n_shingles, component_id, class (a name of the component, null for an empty set)."""
    spark = documents.sparkSession
    text = F.coalesce("text", F.lit(""))
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("doc_id", text).alias("row"), text.alias("text"))
    seed = 0
    while True:  # 64-bit names of sets are checked against a second hash; a clash takes another seed
        named = materialize(rows.mapInArrow(_node_mapper(shingle, seed), "doc_id bigint, row bigint, n_shingles bigint, node bigint, check bigint, signature binary"), "nodes")
        nodes = named.where("n_shingles > 0").groupBy("node").agg(
            F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row")).alias("least"), F.max("n_shingles").alias("n"), F.min("check").alias("c1"), F.max("check").alias("c2"), F.first("signature").alias("signature")
        )
        nodes = materialize(nodes.select("node", F.col("least.doc_id").alias("least_doc"), F.col("least.row").alias("row"), "n", "signature", (F.col("c1") != F.col("c2")).alias("clash")), "sets")
        if not nodes.where("clash").limit(1).count():
            break
        seed += 1
    buckets = bucket_count(rows)
    texts = rows.select("text")
    total = named.count()
    none = (np.zeros(0, U), np.zeros(0, np.int64))
    counted = texts.mapInArrow(_prefix_mapper(shingle, percent, seed, buckets, none, True), SHIPPED)
    # At most (prefix shingles / limit) rows, under a million whatever the input's size.
    frequent = exchange(counted, buckets, _count_reducer(buckets, max(COMMON, total // COMMON_SHARE)), "name bigint, n bigint").toArrow()
    names, n = frequent.column("name").to_numpy().astype(np.int64).view(U), frequent.column("n").to_numpy()
    ranks = np.empty(len(names), np.int64)
    ranks[np.lexsort((names, n))] = np.arange(1, len(names) + 1)
    by_name = np.argsort(names)
    common = (names[by_name], ranks[by_name])
    free_shuffles(spark)
    shipped = texts.mapInArrow(_prefix_mapper(shingle, percent, seed, buckets, common, False), SHIPPED)
    groups = materialize(exchange(shipped, buckets, _group_reducer(buckets), "a bigint, b bigint, local boolean").distinct(), "groups")
    free_shuffles(spark)
    chains = materialize(chains_of(groups, nodes, percent), "chains")
    blocks = components(chains).select("node", F.col("root").alias("block"))
    weighed = materialize(blocks.join(nodes.select("node", "row", "n"), "node"), "blocks")
    sizes = materialize(weighed.groupBy("block").agg(F.ceil(F.sum("n") / slice_elements).cast("int").alias("slices")), "block-sizes")
    large = sizes.where("slices > 1").withColumnRenamed("block", "large_block")
    member = weighed.join(large, F.col("block") == F.col("large_block"), "left").select(
        "row", "node", "block", F.coalesce("slices", F.lit(1)).alias("slices")
    ).withColumn("slice", F.pmod(F.xxhash64("node", F.lit(1)), F.col("slices")).cast("int"))
    member = materialize(member, "members")
    # Only documents of blocks are moved (and a few more).
    bits = bloom_filter(member.select("row"), member.count())
    texts_of = rows.select("row", "text").mapInArrow(_maybe_in(bits), "row bigint, text string")
    held = texts_of.join(member, "row").select("text", "node", "block", "slices", "slice")
    sliced = held.mapInArrow(_slice_mapper(shingle, seed, buckets), SHIPPED)
    links = materialize(exchange(sliced, buckets, _link_reducer(percent), "a bigint, b bigint"), "links")
    free_shuffles(spark)
    linked = components(links)
    least = linked.join(nodes.select("node", "least_doc"), "node").groupBy("root").agg(F.min("least_doc").alias("component_id"))
    least = materialize(least, "components")
    to_component = materialize(linked.join(least, "root").select("node", "component_id", F.col("root").alias("class")), "node-components")
    both = nodes.select("node", "least_doc").join(to_component, "node", "left")
    own = materialize(both.select("node", F.coalesce("component_id", "least_doc").alias("component_id"), F.coalesce("class", "node").alias("class")), "classes")
    release(nodes, groups, chains, weighed, sizes, member, links, least, to_component)
    out = named.join(own, "node", "left")
    return out.select(
        "doc_id", "row", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"), F.when(F.col("n_shingles") > 0, F.col("class")).alias("class")
    )


def keep_one(documents: DataFrame, **options) -> DataFrame:
    """The rows of `documents`, one of each component: that with the least doc_id, and of rows that repeat it any one."""
    classes = materialize(jaccard_components(documents, **options), "classes")
    order = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row")
    chosen = classes.where("n_shingles > 0").groupBy("class").agg(F.min(order).alias("least")).select("least.row")
    name = fresh(documents.columns, "kept_row")
    first = materialize(chosen.unionByName(classes.where("n_shingles = 0").select("row")).distinct().withColumnRenamed("row", name), "first")
    row = F.xxhash64(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")))
    kept = documents.join(first, row == F.col(name), "left_semi")
    if classes.where("n_shingles > 0").groupBy("row").count().where("count > 1").limit(1).count():
        whole = kept.where(F.size(F.split(F.coalesce("text", F.lit("")), "[^ \\t\\n\\x0B\\f\\r]", 2)) > 1)
        blank = kept.where(F.size(F.split(F.coalesce("text", F.lit("")), "[^ \\t\\n\\x0B\\f\\r]", 2)) <= 1)
        return whole.dropDuplicates(["doc_id", "text"]).unionByName(blank)
    return kept


ORACLE_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), []) AS words FROM documents
), s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(words) >= 4 THEN list_transform(range(1, len(words) - 2), lambda i: array_to_string(words[i:i + 3], ' ')) WHEN len(words) > 0 THEN [array_to_string(words, ' ')] ELSE [] END) AS g FROM w
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * c >= 85 * (na.n + nb.n - c)),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, least(w.doc_id, (SELECT min(b) FROM r WHERE r.a = w.doc_id)) AS component_id FROM w LEFT JOIN n USING (doc_id)
"""
