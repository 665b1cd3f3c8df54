"""Operator 7, SentencePiece encoding and decoding: distinct sampled segmentations by Gumbel top-k.

A text, with a space before it, is a chain of units: a run of spaces (written U+2581) with the characters after it up to the next space, tab or line feed,
such characters alone, or a single tab or line feed. No piece goes beyond a unit (a vocabulary file with one that does is refused), so the segmentations
of a text are all combinations of its units'. The pieces and their log probabilities are those of an existing vocabulary file; characters that are
no piece fall back to bytes. Over the lattice of a text's units the K segmentations with the largest Gumbel-perturbed log probabilities are a sample of K
without replacement.

They are found by a best-first (A*) search over sets of segmentations: a set is a prefix of chosen arcs, the node after it with some of its arcs excluded,
and everything after that free. The perturbed value of a set's best member is known in advance without error (a Gumbel at the log of the
set's probability, cut at the value of the set it came from), so the top of the queue is the next sample. Its arc at the node is drawn among the others and its free
units by backward sums, arc by arc; what remains of the set is split at each arc of the new path. The searches of many texts advance
in step: each round draws the next sample of each text in vectorised passes over all of them, walks of equal units side by side. Of a queue only as many
sets stay as samples are left to draw, and one for kappa. Distinct units are solved once and kept for later runs, within a bound;
units are told apart by their bytes.

Results: rank, ids, log_prob (of the segmentation, among all segmentations of the text), perturbed, and inclusion, the probability that the
segmentation is among the sample given the (K + 1)-th perturbed value: 1 - exp(-exp(log_prob - kappa)); 1 where the text has K segmentations or fewer.
log_likelihood is the log of the sum over all segmentations. The random numbers depend on the seed, the row's key and the place in the text alone.

Null text gives no samples; an empty text one, with no pieces. decode() gives back the text of any of them. Rows that repeat a key and a text repeat
their samples, and a null key is a key like any other. Equal perturbed values (which take equal 53-bit random numbers) are ranked in the order of the search. A text of any length
is sampled whole, in a run of its own if it is long: memory grows with the longest text. An empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import StringType, StructField, StructType

from ._store import modest_batches
from ._tokens import constants, gather, give_back, mix, portions, same_spans, span_hashes
from .lattice_lm import MARK_BYTE, Lattices
from .pieces import MARK, default_vocabulary, vocabulary

K = 4
#: Bytes of text whose searches advance in step.
TOGETHER = 5 << 18
#: Arcs of units that a worker keeps for the next run of texts (some 30 bytes each).
KEPT = 3 << 20
U = np.uint64
SALT = constants(0x5EED, 4)
ONE = 1 << 53
#: No standard Gumbel of 53 bits is above this.
MOST_GUMBEL = 37.5
#: Sets whose log probability is this far below their path's are looked at only where nearer ones do not settle the offers.
REACH = 45.0


def uniform(*parts: np.ndarray) -> np.ndarray:
    """Numbers in (0, 1) from integers: the same integers, the same number."""
    return unit_interval(sum((np.asarray(x).astype(U) * SALT[i % 4] for i, x in enumerate(parts)), np.zeros(1, U)))


def unit_interval(x: np.ndarray) -> np.ndarray:
    h = mix(x)
    h >>= U(11)
    u = h.astype(float)
    u += 0.5
    u *= 2.0**-53
    return u


def log1mexp(x: np.ndarray) -> np.ndarray:
    """log(1 - exp(x)) for x <= 0."""
    out, near = np.empty(len(x)), x > -0.6931
    with np.errstate(divide="ignore"):
        out[near] = np.log(-np.expm1(x[near]))
        near = ~near
        out[near] = np.log1p(-np.exp(x[near]))
    return out


def cut_gumbel(location: np.ndarray, bound: np.ndarray, u: np.ndarray) -> np.ndarray:
    """Gumbel values at `location` conditioned to lie below `bound`."""
    with np.errstate(over="ignore", divide="ignore", invalid="ignore"):
        g = location - np.log(-np.log(u))
        return np.where(np.isneginf(location), -np.inf, -np.logaddexp(-bound, -g))


def split_units(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Texts with a space before each non-empty one: bytes with marks for spaces, unit starts, unit ends, offsets of the texts in the units."""
    size = np.diff(offsets)
    lead = (size > 0).astype(np.int64)
    to = np.concatenate([[0], np.cumsum(size + lead)])
    out = np.full(int(to[-1]), 32, np.uint8)
    out[np.arange(len(data)) + np.repeat(to[:-1] + lead - offsets[:-1], size)] = data
    space, alone = out == 32, (out == 9) | (out == 10)
    begins = space | alone
    begins[1:] &= ~space[:-1] | alone[1:]
    begins[1:] |= alone[:-1]
    begins[to[:-1][size > 0]] = True
    start = np.flatnonzero(begins)
    out[space] = MARK_BYTE
    return out, start, np.append(start[1:], len(out)), np.searchsorted(start, to)


class Grown:
    """An array that grows at its end."""

    def __init__(self, dtype: type) -> None:
        self.room, self.size = np.empty(1 << 16, dtype), 0

    def put(self, values: np.ndarray, anew: bool) -> np.ndarray:
        """The array with `values` after, or instead of, what it holds."""
        n, size = len(values), 0 if anew else self.size
        if size + n > len(self.room):
            old, self.room = self.room, np.empty((size + n) * 3 // 2, self.room.dtype)
            self.room[:size] = old[:size]
        self.room[size : size + n] = values
        self.size = size + n
        return self.room[: self.size]


class Lattice:
    """Arcs of distinct units with conditional probabilities by start node, kept from run to run.

    The nodes of the units that come in together are numbered by place in the unit, then by unit (long units first), so that the arcs of a place are
    side by side. Once there are more than `most` arcs, units that were met only once go before the next run."""

    def __init__(self, lattices: Lattices, logp: np.ndarray, most: int = KEPT) -> None:
        self.lattices, self.logp, self.most = lattices, logp, most
        # By unit: a hash, uses, first arc, log of the sum over its segmentations, end of its bytes; and the bytes.
        self._of_units = {"hash": Grown(U), "uses": Grown(np.int64), "first": Grown(np.int32), "log_z": Grown(float), "until": Grown(np.int64)}
        self._bytes = {"data": Grown(np.uint8)}
        # By node: its unit, its first arc and their number (0 at the end of a unit).
        self._of_nodes = {"unit": Grown(np.int32), "arcs_from": Grown(np.int32), "arcs": Grown(np.int32)}
        # By arc: its node, the first arc of the node at its end (-1 at the end of a unit), log probability among the node's arcs, sum of the probabilities up to it in parts of ONE.
        self._of_arcs = {"start": Grown(np.int32), "next": Grown(np.int32), "piece": Grown(np.int32), "log_p": Grown(float), "cum": Grown(U)}
        self._set({})
        self._by_hash, self._hashes = np.zeros(0, np.int64), np.zeros(0, U)  # the units in the order of their hashes, and these

    def _set(self, more: dict[str, np.ndarray], anew: bool = False) -> None:
        for group in (self._of_units, self._bytes, self._of_nodes, self._of_arcs):
            for name, grown in group.items():
                if name in more or not more:
                    setattr(self, name, grown.put(more.get(name, ()), anew))

    def admit(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The unit of each span, and the spans in an order that has those of a unit side by side. Spans share a unit if their bytes are equal, not their hashes alone."""
        if len(self.start) > self.most:
            self._forget()
        hashes = span_hashes(data, start, end)
        order = np.argsort(hashes)
        own = hashes[order]
        heads = np.append(True, own[1:] != own[:-1])
        head = np.flatnonzero(heads)
        count = np.diff(head, append=len(own))
        first, kind = order[head], np.cumsum(heads) - 1
        of = np.empty(len(order), np.int64)
        of[order] = kind
        own, groups = own[head], (head, head + count)
        again, like = order[~heads], first[kind[~heads]]
        other = again[~same_spans(data, start[again], end[again], data, start[like], end[like])]
        if len(other):  # spans that share a hash with others get a unit each
            of[other] = len(first) + np.arange(len(other))
            first, count, own = np.append(first, other), np.append(count, np.ones(len(other), np.int64)), np.append(own, hashes[other])
        unit = np.full(len(first), -1)
        if len(self.hash):
            i = self._by_hash[np.minimum(np.searchsorted(self._hashes, own), len(self._hashes) - 1)]
            held = np.flatnonzero(self.hash[i] == own)
            held = held[same_spans(data, start[first[held]], end[first[held]], self.data, np.append(0, self.until)[i[held]], self.until[i[held]])]
            unit[held] = i[held]
            self.uses[i[held]] += 1
        new = np.flatnonzero(unit < 0)
        new = new[np.argsort(start[first[new]] - end[first[new]], kind="stable")]
        unit[new] = len(self.hash) + np.arange(len(new))
        if len(new):
            self._add(own[new], np.minimum(count[new], 2), *gather(data, start[first[new]], end[first[new]]))
            self._index(len(self.hash) - len(new))
        by = np.argsort(unit[: len(head)])
        return unit[of], gather(order, groups[0][by], groups[1][by])[0]

    def _index(self, known: int) -> None:
        """Puts the units from `known` on in the order of hashes."""
        new = known + np.argsort(self.hash[known:])
        to = np.searchsorted(self._hashes[:known], self.hash[new])
        self._by_hash, self._hashes = np.insert(self._by_hash[:known], to, new), np.insert(self._hashes[:known], to, self.hash[new])

    def _add(self, hashes: np.ndarray, uses: np.ndarray, data: np.ndarray, at: np.ndarray) -> None:
        """New units, the longest first."""
        size = np.diff(at)
        longest = int(size[0])
        width = np.searchsorted(-size, -np.arange(longest + 1), "right")  # units that have a node at each place
        base = np.concatenate([[0], np.cumsum(width)])
        nodes = int(base[-1])
        unit = np.repeat(np.arange(len(size), dtype=np.int32), size)
        place = np.arange(len(data), dtype=np.int32) - np.repeat(at[:-1].astype(np.int32), size)
        parts = self.lattices.arc_lists(data, at)
        by_place = base.astype(np.int32)
        node = by_place[place] + unit
        arcs, froms = np.zeros(nodes, np.int32), []
        for a, _, _ in parts:
            froms.append(node[a])
            arcs[froms[-1]] += 1
        arcs_from = (np.cumsum(arcs) - arcs).astype(np.int32)
        start, end, piece = (np.empty(int(arcs.sum()), np.int32) for _ in range(3))
        fill = arcs_from.copy()
        while parts:  # long pieces first: they are likely
            (a, e, p), to = parts.pop(), froms.pop()
            i = fill[to]
            fill[to] = i + 1
            start[i], piece[i] = to, p
            end[i] = by_place[place[a] + (e - a)] + unit[a]
        beta = np.full(nodes, -np.inf)
        beta[by_place[size] + np.arange(len(size))] = 0
        log_p, cum = self.logp[piece], np.empty(len(piece), U)
        cuts = np.append(arcs_from, len(piece))[base]
        for k in range(longest - 1, -1, -1):
            a, b = int(cuts[k]), int(cuts[k + 1])
            if a == b:
                continue
            v = log_p[a:b]
            v += beta[end[a:b]]
            n = arcs[base[k] : base[k + 1]]
            live = np.flatnonzero(n)
            n = n[live]
            head = arcs_from[base[k] : base[k + 1]][live] - a
            top = np.maximum.reduceat(v, head)
            top[~np.isfinite(top)] = 0
            p = np.exp(v - np.repeat(top, n))
            total = np.add.reduceat(p, head)
            with np.errstate(divide="ignore", invalid="ignore"):
                sums = top + np.log(total)
                beta[base[k] + live] = sums
                v -= np.repeat(sums, n)
                p *= np.repeat(ONE / total, n)
            p = p.astype(U)
            run = np.cumsum(p)  # whole numbers: a node's sums do not depend on the units that came in with it
            run -= np.repeat(run[head] - p[head], n)
            run[head + n - 1] = ONE
            cum[a:b] = run
        np.minimum(log_p, 0, out=log_p)
        log_p[np.isnan(log_p)] = -np.inf  # arcs between nodes that no segmentation visits
        log_p[arcs[start] == 1] = 0
        n, k, units = len(self.unit), len(self.start), len(self.hash)
        start += n
        arcs_from += k
        follow = np.where(arcs > 0, arcs_from, -1)[end]
        self._set({
            "hash": hashes, "uses": uses, "first": arcs_from[: len(size)], "log_z": beta[: len(size)], "until": at[1:] + len(self.data), "data": data,
            "unit": units + np.arange(nodes) - np.repeat(base[:-1], width), "arcs_from": arcs_from, "arcs": arcs,
            "start": start, "next": follow, "piece": piece, "log_p": log_p, "cum": cum,
        })

    def _forget(self) -> None:
        """Keeps the units met twice or more, if they take at most half of the room."""
        stay = self.uses > 1
        here = stay[self.unit]
        arc = here[self.start]
        if 2 * int(arc.sum()) > self.most:
            stay[:], here[:], arc[:] = False, False, False
        units, nodes, arcs = ((np.cumsum(x) - 1).astype(np.int32) for x in (stay, here, arc))
        data, at = gather(self.data, np.append(0, self.until)[:-1][stay], self.until[stay])
        ends, follow = self.arcs[here] == 0, self.next[arc]
        self._set({
            "hash": self.hash[stay], "uses": np.ones(int(stay.sum()), np.int64), "first": arcs[self.first[stay]], "log_z": self.log_z[stay], "until": at[1:], "data": data,
            "unit": units[self.unit[here]], "arcs": self.arcs[here], "arcs_from": np.where(ends, 0, np.append(arcs, 0)[np.where(ends, 0, self.arcs_from[here])]),
            "start": nodes[self.start[arc]], "next": np.where(follow < 0, -1, np.append(arcs, 0)[follow]), "piece": self.piece[arc], "log_p": self.log_p[arc], "cum": self.cum[arc],
        }, anew=True)
        self._index(0)

    def walk(self, arc: np.ndarray, seed: np.ndarray, place: np.ndarray, turn: int, order: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Arcs drawn from each node to its unit's end, one walk after the other, their log probabilities (both with a 0 after the last), and the length of each walk.

        arc: the first arc of each walk's node, -1 for none. order: the walks in an order that has those of a unit side by side."""
        length = np.zeros(len(arc), np.int64)
        base = seed * SALT[0] + (place * 8 + turn).astype(U) * SALT[1]  # the sum that uniform(seed, place, step) begins with
        arc = arc[order]
        live = np.flatnonzero(arc >= 0)
        arc, live = arc[live].astype(np.intp), order[live]
        base, steps, k = base[live], [], 0
        while len(live):
            u = mix(base + np.full(1, k + 1, U) * SALT[2]) >> U(11)
            over = np.flatnonzero(u >= self.cum[arc])
            u, other = u[over], arc[over]
            while len(over):  # likely arcs come first, so few look further
                other += 1
                arc[over] = other
                more = np.flatnonzero(u >= self.cum[other])
                over, u, other = over[more], u[more], other[more]
            steps.append((live, arc))
            k += 1
            then = self.next[arc]
            on = then >= 0
            length[live[~on]] = k
            live, arc, base = live[on], then[on].astype(np.intp), base[on]
        at = np.cumsum(length) - length
        out, logs = np.zeros(int(length.sum()) + 1, np.int32), np.zeros(int(length.sum()) + 1)
        for k, (who, arc) in enumerate(steps):
            to = at[who]
            to += k
            out[to], logs[to] = arc, self.log_p[arc]
        return out, logs, length

    def choose(self, arc: np.ndarray, excluded: np.ndarray, u: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """An arc drawn at each arc's node among those that are not excluded (-1: none), and the log of the sum of the probabilities of those that are left after it."""
        node = self.start[arc]
        a, n = self.arcs_from[node], self.arcs[node]
        cell, row = np.arange(int(n.max())), np.arange(len(arc))
        p = np.exp(self.log_p[np.minimum(a[:, None] + cell, len(self.log_p) - 1)])
        p[cell >= n[:, None]] = 0
        for e in excluded.T:
            gone = np.flatnonzero(e >= 0)
            p[gone, e[gone] - a[gone]] = 0
        run = np.cumsum(p, axis=1)
        last = len(cell) - 1 - np.argmax(p[:, ::-1] > 0, axis=1)
        chosen = np.minimum(np.count_nonzero(run <= (u * run[:, -1])[:, None], axis=1), last)
        left = run[:, -1] - p[row, chosen]
        some = (np.count_nonzero(excluded >= 0, axis=1) + 1 < n) & (left > 0)
        return a + chosen, np.where(some, np.log(np.where(some, left, 1.0)), -np.inf)


def largest(v: np.ndarray, counts: np.ndarray, want: int) -> tuple[np.ndarray, np.ndarray]:
    """The `want` largest of each run of values, falling, and their places; -inf and 0 where a run has fewer. Overwrites v; values that are not finite do not count."""
    values, at = np.full((len(counts), want), -np.inf), np.zeros((len(counts), want), np.int64)
    v[~np.isfinite(v)] = -np.inf
    some = np.flatnonzero(counts)
    counts = counts[some]
    start = np.cumsum(counts) - counts
    for i in range(want if len(some) else 0):
        top = np.maximum.reduceat(v, start)
        hit = np.flatnonzero(v == np.repeat(top, counts))
        hit = hit[np.searchsorted(hit, start)]
        values[some, i], at[some, i] = top, hit
        v[hit] = -np.inf
    return values, at


class Drawn(NamedTuple):
    """Samples of some texts, text after text and in falling order of perturbed. By sample: its text, rank from 0, log_prob, perturbed, its arcs' bounds in `arcs`; by text: kappa (the next value, or -inf), log_likelihood.

    A sample's arcs are two spans of `arcs`: up to the head that it was drawn from, and after it."""

    of: np.ndarray
    rank: np.ndarray
    log_prob: np.ndarray
    perturbed: np.ndarray
    spans: np.ndarray
    arcs: np.ndarray
    kappa: np.ndarray
    log_z: np.ndarray

    def path(self, some: slice) -> np.ndarray:
        """The arcs of some samples, one after the other."""
        return np.concatenate([self.arcs[a:b] for spans in self.spans[:, some].T.tolist() for a, b in (spans[:2], spans[2:])])


def draw_texts(lattice: Lattice, data: np.ndarray, offsets: np.ndarray, keys: list[bytes], k: int) -> Drawn:
    """k samples of each text, fewer where it has fewer segmentations. `arcs` are the lattice's until its next texts."""
    marked, start, end, first = split_units(data, offsets)
    n = len(keys)
    kappa, log_z = np.full(n, -np.inf), np.zeros(n)
    # By turn and text: a path's log probability, perturbed value and its two spans of `arcs`. The path of a text without units is empty.
    found, spans, arcs = np.zeros((2, k, n)), np.zeros((4, k, n), np.int64), np.zeros(0, np.int32)
    drawn_at = np.zeros((k, n), bool)
    who = np.flatnonzero(np.diff(first))
    drawn_at[0] = True
    if len(who):
        of, order = lattice.admit(marked, start, end)
        firsts = lattice.first[of]
        log_z[who] = np.add.reduceat(np.append(lattice.log_z[of], 0.0), np.minimum(first[:-1], len(start)))[who]
    seeds = np.array([int.from_bytes(hashlib.blake2b(x, digest_size=8).digest(), "little") for x in keys], U)
    # Of each text the sets to look at, by falling value: the path they leave, the place in it, the arcs excluded there, the log probability of what comes before it, its unit.
    kind = np.dtype([("value", float), ("before", float), ("place", np.int64), ("unit", np.int64), ("path", np.int32), ("excluded", np.int32, (k,))])
    queue = np.zeros((len(who), 1), kind)
    queue["value"][:, 0] = -np.log(-np.log(uniform(seeds[who], np.full(len(who), 3))))
    queue["unit"][:, 0] = first[who]
    for turn in range(k):
        live = queue["value"][:, 0] > -np.inf
        who, queue = who[live], queue[live]
        if not len(who):
            break
        head, queue, want = queue[:, 0], queue[:, 1:], k - turn
        seed, value, begin, excluded = seeds[who], head["value"], head["unit"], head["excluded"].copy()
        base, again = np.zeros(len(who)), np.full(len(who), -np.inf)
        if turn:  # the texts of the first turn begin at their start
            path, place = spans[:, head["path"], who], head["place"]
            skip = path[1] - path[0]
            chosen, rest = lattice.choose(arcs[np.where(place < skip, path[0] + place, path[2] + place - skip)], excluded, uniform(seed, np.full(1, turn * 8 + 5), head["place"]))
            excluded[np.arange(len(who)), np.count_nonzero(excluded >= 0, axis=1)] = chosen
            base = head["before"] + lattice.log_p[chosen]
            again = cut_gumbel(head["before"] + rest, value, uniform(seed, np.full(1, turn * 8 + 7), head["place"]))
        # A walk for each unit from a head's on; the first goes on behind the head.
        counts = first[who + 1] - begin
        at = np.cumsum(counts) - counts
        everyone = np.arange(int(counts.sum())) + np.repeat(begin - at, counts)
        nodes = firsts[everyone]
        walks = order
        if turn:
            nodes[at] = lattice.next[chosen]
            walks = np.full(len(of), -1)
            walks[everyone] = np.arange(len(everyone))
            walks = walks[order]
            walks = walks[walks >= 0]
        drawn, logs, length = lattice.walk(nodes, np.repeat(seed, counts), everyone - np.repeat(first[who], counts), turn, walks)
        walker_at = np.concatenate([[0], np.cumsum(counts)])
        walked = np.cumsum(length)
        ends = np.concatenate([[0], walked])[walker_at]
        size = np.diff(ends)
        total = np.cumsum(logs)
        run = total - logs
        shift = run[ends[:-1]] - base  # run less this: what comes before an arc in its path
        seed_at = seed * SALT[0] + np.full(1, turn * 8 + 6, U) * SALT[1] - ends[:-1].astype(U) * SALT[2]

        def offers(
            texts: np.ndarray, counts: np.ndarray, want: int = want, run: np.ndarray = run, logs: np.ndarray = logs, shift: np.ndarray = shift, ends: np.ndarray = ends, seed_at: np.ndarray = seed_at
        ) -> tuple[np.ndarray, np.ndarray]:
            """Gumbels at the log probabilities of the sets left at the first places of the draw, the largest: uniform(seed, turn * 8 + 6, place in the path's draw). A node with one arc leaves nothing."""
            places = np.arange(int(counts.sum())) + np.repeat(ends[texts] - (np.cumsum(counts) - counts), counts)
            v = run[places] - np.repeat(shift[texts], counts) + log1mexp(logs[places])
            with np.errstate(divide="ignore", invalid="ignore"):
                v -= np.log(-np.log(unit_interval(np.repeat(seed_at[texts], counts) + places.astype(U) * SALT[2])))
            values, at = largest(v, counts, want)
            return values, places[at] if len(places) else at

        # What comes before a set bounds its probability, and only the largest values of a path are offered: sets far down a long path need no value.
        # Below a bound Gumbels keep their order, so only the largest are cut.
        near = np.clip(np.searchsorted(-total[:-1], REACH - shift - base) + 1 - ends[:-1], 0, size)
        v, at = offers(np.arange(len(who)), near)
        far = np.flatnonzero((near < size) & ~(v[:, -1] > base - REACH + MOST_GUMBEL))
        if len(far):
            v[far], at[far] = offers(far, size[far])
        drawn_at[turn, who], spans[2, turn, who], spans[3, turn, who] = True, len(arcs) + ends[:-1], len(arcs) + ends[1:]
        skip = np.zeros(len(who), np.int64)
        if turn:  # the path of the set up to the head, and the head
            heads = len(arcs) + np.arange(len(who))
            skip = path[1] - path[0]
            pieces = (path[0], path[0] + np.minimum(place, skip)), (path[2], path[2] + np.maximum(place - skip, 0)), (heads, heads + 1)
            before, at_head = gather(np.append(arcs, chosen.astype(np.int32)), *(np.stack(x, axis=1).ravel() for x in zip(*pieces, strict=True)))
            at_head = len(arcs) + len(drawn) + at_head[::3]
            spans[0, turn, who], spans[1, turn, who], skip = at_head[:-1], at_head[1:], place + 1
            arcs = np.concatenate([arcs, drawn, before])
        else:
            arcs = drawn
        last = np.maximum(ends[1:] - 1, 0)
        found[0, turn, who] = np.where(size > 0, run[last] - shift + logs[last], base)
        found[1, turn, who] = value
        fresh = np.zeros((len(who), want + 1), kind)
        fresh["path"], fresh["excluded"] = turn, -1
        one, back = fresh[:, :want], fresh[:, want]
        one["value"] = -np.logaddexp(-value[:, None], -v)
        one["before"] = run[at] - shift[:, None]
        one["place"] = skip[:, None] + at - ends[:-1, None]
        one["unit"] = np.searchsorted(walked, at, "right") + (begin - walker_at[:-1])[:, None]
        one["excluded"][:, :, 0] = drawn[at]
        back["value"], back["before"], back["place"], back["unit"], back["excluded"] = again, head["before"], head["place"], begin, excluded
        queue = np.concatenate([queue, fresh], axis=1)
        queue = np.take_along_axis(queue, np.argsort(-queue["value"], axis=1, kind="stable")[:, :want], axis=1)
    else:
        kappa[who] = queue["value"][:, 0]
    of, rank = np.nonzero(drawn_at.T)
    return Drawn(of, rank, *found[:, rank, of], spans[:, rank, of], arcs, kappa, log_z)


Sample = tuple[np.ndarray, float, float]


def sample_texts(lattice: Lattice, data: np.ndarray, offsets: np.ndarray, keys: list[bytes], k: int) -> list[tuple[list[Sample], float, float]]:
    """For each text: [(ids, log_prob, perturbed)] in falling order of perturbed, kappa, log_likelihood."""
    d = draw_texts(lattice, data, offsets, keys, k)
    out = [([], kappa, z) for kappa, z in zip(d.kappa.tolist(), d.log_z.tolist(), strict=True)]
    for j, (i, p, v) in enumerate(zip(d.of.tolist(), d.log_prob.tolist(), d.perturbed.tolist(), strict=True)):
        out[i][0].append((lattice.piece[d.path(slice(j, j + 1))], p, v))
    return out


@lru_cache(maxsize=2)
def lattices_for(path: str) -> Lattices:
    v = vocabulary(path)
    for i in np.flatnonzero(v.normal):
        if MARK in v.names[i].lstrip(MARK) or "\n" in v.names[i] or "\t" in v.names[i]:
            raise ValueError(f"piece {i} of {path} goes beyond a unit")
    return Lattices(v.names, np.flatnonzero(v.normal), v.byte_ids, bytes_everywhere=False)


SAMPLE = "sample_rank int, n_pieces int, ids array<int>, log_prob double, perturbed double, inclusion double, log_likelihood double"


def _sampler(path: str, k: int, seed: int, together: int = TOGETHER) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = Lattice(lattices_for(path), vocabulary(path).logp, KEPT * together // TOGETHER)
        for b in batches:
            b = b.filter(b.column(1).is_valid())
            for part, data, offsets in portions(b.column(1), together):
                keys = b.column(0)[part]
                d = draw_texts(lattice, data, offsets, [f"{seed}|{x}".encode() for x in keys.to_pylist()], k)
                kappa = d.kappa[d.of]
                with np.errstate(invalid="ignore", over="ignore"):
                    inclusion = np.where(np.isneginf(kappa), 1.0, -np.expm1(-np.exp(np.minimum(d.log_prob - kappa, 700.0))))
                for at in range(0, len(d.of), 2000):
                    some = slice(at, at + 2000)
                    sizes = np.diff(d.spans[:, some], axis=0)[::2].sum(axis=0).astype(np.int32)
                    ids = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), pa.array(lattice.piece[d.path(some)]))
                    yield pa.RecordBatch.from_arrays(
                        [
                            keys.take(pa.array(d.of[some])), pa.array((d.rank[some] + 1).astype(np.int32)), pa.array(sizes), ids,
                            *(pa.array(x[some]) for x in (d.log_prob, d.perturbed, inclusion, d.log_z[d.of])),
                        ],
                        ["doc_id", "sample_rank", "n_pieces", "ids", "log_prob", "perturbed", "inclusion", "log_likelihood"],
                    )
                del d

    return run


def sample_segmentations(documents: DataFrame, path: str | None = None, k: int = K, seed: int = 1, together: int = TOGETHER) -> DataFrame:
    """doc_id and SAMPLE: k rows a text, fewer where it has fewer segmentations. together: bytes of text a worker holds lattices for; more is faster, and takes
    about 200 times as much memory."""
    modest_batches(documents.sparkSession)
    kind = documents.schema["doc_id"].dataType.simpleString()
    return documents.select("doc_id", "text").mapInArrow(_sampler(path or default_vocabulary(), k, seed, together), f"doc_id {kind}, {SAMPLE}")


def decode(ids: list[int], path: str | None = None) -> str:
    """The text of a segmentation."""
    v = vocabulary(path or default_vocabulary())
    out = bytearray()
    for i in ids:
        out += bytes([int(v.names[i][1:-1], 16)]) if v.is_byte[i] else v.names[i].replace(MARK, " ").encode()
    return out.decode().removeprefix(" ")


def decode_column(segmentations: DataFrame, path: str | None = None) -> DataFrame:
    """Adds `decoded` to rows with `ids`."""
    path = path or default_vocabulary()
    schema = StructType([*segmentations.schema.fields, StructField("decoded", StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = b.schema.get_field_index("ids")
            texts = [decode(x.values.to_pylist() if x.is_valid else [], path) for x in b.column(at)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(texts, pa.string())], [*b.schema.names, "decoded"])

    return segmentations.mapInArrow(run, schema)
