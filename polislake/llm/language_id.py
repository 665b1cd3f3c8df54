"""Operator 2, language identification with a bidirectional gated recurrent network over bytes.

The network reads the UTF-8 bytes of a text in windows of WINDOW bytes (all of them, to the last byte of the longest text), in both directions.
Each position gets a distribution over the languages from both states, and a document's is the mean over its positions. It
is trained here by backpropagation through time, in numpy, on snippets of at most PER_LANGUAGE (documented bound) labelled documents a language,
drawn by a hash of the id; rows whose `train` condition does not hold are never seen. Labels and ids are not inputs.

Null text and text without a letter are `und` with score 0, as is every text if no language was learned. Equal probabilities go to
the first language by name. A null doc_id is passed on; whether such a row trains is for the `train` condition to say. Repeated rows get equal results. An empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._store import fresh
from ._tokens import portions

PER_LANGUAGE = 600
SNIPPET = 192
WINDOW = 96
HIDDEN = 10
STEPS = 260
BATCH = 192
UNKNOWN = "und"
PAD = 256


class Network:
    """Weights by name; the input is one-hot, so its matrices are looked up by byte (row 256: padding)."""

    def __init__(self, labels: list[str], hidden: int = HIDDEN, seed: int = 7) -> None:
        rng = np.random.default_rng(seed)
        self.labels, self.hidden = labels, hidden
        normal = lambda *shape, scale: (rng.standard_normal(shape) * scale).astype(np.float32)
        self.w = {}
        for d in "fb":
            self.w[f"in_{d}"] = normal(257, 3 * hidden, scale=0.3)
            self.w[f"rec_{d}"] = normal(hidden, 3 * hidden, scale=hidden**-0.5)
            self.w[f"out_{d}"] = normal(hidden, len(labels), scale=hidden**-0.5)
        self.w["bias"] = np.zeros(len(labels), np.float32)

    def states(self, x: np.ndarray, d: str, keep: list | None = None) -> Iterator[tuple[int, np.ndarray]]:
        """Hidden states of direction d over x (positions, rows). keep: gets what backpropagation needs."""
        k, w_in, w_rec = self.hidden, self.w[f"in_{d}"], self.w[f"rec_{d}"]
        h = np.zeros((x.shape[1], k), np.float32)
        for t in range(len(x)) if d == "f" else range(len(x) - 1, -1, -1):
            a, g = w_in[x[t]], h @ w_rec
            gates = a[:, : 2 * k] + g[:, : 2 * k]
            gates *= 0.5
            np.tanh(gates, out=gates)
            gates *= 0.5
            gates += 0.5
            z, r = gates[:, :k], gates[:, k:]
            n = np.tanh(a[:, 2 * k :] + r * g[:, 2 * k :])
            new = n + z * (h - n)
            real = (x[t] != PAD)[:, None]
            if not real.all():
                new *= real
            if keep is not None:
                keep.append((t, h, z, r, n, g[:, 2 * k :], real))
            h = new
            yield t, h

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        """(positions, rows, labels): the label distribution of every position."""
        logits = np.empty((*x.shape, len(self.labels)), np.float32)
        for t, h in self._plain_states(x, "f"):
            np.matmul(h, self.w["out_f"], out=logits[t])
        for t, h in self._plain_states(x, "b"):
            logits[t] += h @ self.w["out_b"]
        logits += self.w["bias"]
        # Label by label: the last axis is too short for a reduction of its own.
        top = logits[:, :, 0].copy()
        for i in range(1, len(self.labels)):
            np.maximum(top, logits[:, :, i], out=top)
        logits -= top[:, :, None]
        np.exp(logits, out=logits)
        total = logits[:, :, 0].copy()
        for i in range(1, len(self.labels)):
            total += logits[:, :, i]
        logits /= total[:, :, None]
        return logits

    def _plain_states(self, x: np.ndarray, d: str) -> Iterator[tuple[int, np.ndarray]]:
        """states() without what backpropagation needs: a table and a product for each gate, so that all passes go over whole arrays."""
        k = self.hidden
        tables = [np.ascontiguousarray(self.w[f"in_{d}"][:, i * k : (i + 1) * k]) for i in range(3)]
        steps = [np.ascontiguousarray(self.w[f"rec_{d}"][:, i * k : (i + 1) * k]) for i in range(3)]
        for m in (*tables[:2], *steps[:2]):
            m *= 0.5
        h = np.zeros((x.shape[1], k), np.float32)
        whole = (x != PAD).all(axis=1)
        for t in range(len(x)) if d == "f" else range(len(x) - 1, -1, -1):
            at = x[t]
            z, r, n = (table.take(at, axis=0) for table in tables)
            for gate, step in zip((z, r), steps[:2], strict=True):
                gate += h @ step
                np.tanh(gate, out=gate)
                gate *= 0.5
                gate += 0.5
            r *= h @ steps[2]
            n += r
            np.tanh(n, out=n)
            h = h - n
            h *= z
            h += n
            if not whole[t]:
                h *= (at != PAD)[:, None]
            yield t, h

    def gradients(self, x: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean cross-entropy over positions, and its gradient by backpropagation through time."""
        k = self.hidden
        kept, hidden = {}, {}
        for d in "fb":
            kept[d] = []
            hidden[d] = dict(self.states(x, d, kept[d]))
        logits = np.stack([hidden["f"][t] @ self.w["out_f"] + hidden["b"][t] @ self.w["out_b"] for t in range(len(x))]) + self.w["bias"]
        logits -= logits.max(axis=2, keepdims=True)
        p = np.exp(logits)
        p /= p.sum(axis=2, keepdims=True)
        real = x != PAD
        rows = np.arange(x.shape[1])
        loss = float(-np.log(p[:, rows, y] + 1e-9)[real].mean())
        p[:, rows, y] -= 1
        p *= (real / max(real.sum(), 1))[:, :, None].astype(np.float32)
        g = {n: np.zeros_like(v) for n, v in self.w.items()}
        g["bias"] = p.sum(axis=(0, 1))
        for d in "fb":
            w_rec, w_out = self.w[f"rec_{d}"], self.w[f"out_{d}"]
            later = np.zeros((x.shape[1], k), np.float32)
            for t, before, z, r, n, gn, real_t in reversed(kept[d]):
                g[f"out_{d}"] += hidden[d][t].T @ p[t]
                dh = (p[t] @ w_out.T + later) * real_t
                dz = dh * (before - n) * z * (1 - z)
                dn = dh * (1 - z) * (1 - n * n)
                dr = dn * gn * r * (1 - r)
                da = np.concatenate([dz, dr, dn], axis=1)
                dg = np.concatenate([dz, dr, dn * r], axis=1)
                np.add.at(g[f"in_{d}"], x[t], da)
                g[f"rec_{d}"] += before.T @ dg
                later = dg @ w_rec.T + dh * z
        return loss, g

    def train(self, snippets: list[bytes], targets: np.ndarray, steps: int = STEPS, batch: int = BATCH, seed: int = 11) -> list[float]:
        """Adam on random windows of the snippets, languages in even shares."""
        rng = np.random.default_rng(seed)
        first = {n: np.zeros_like(v) for n, v in self.w.items()}
        second = {n: np.zeros_like(v) for n, v in self.w.items()}
        by = [np.flatnonzero(targets == c) for c in range(len(self.labels))]
        losses = []
        for step in range(1, steps + 1):
            chosen = np.array([rng.choice(by[i % len(by)]) for i in range(batch)])
            x = np.full((WINDOW // 2, batch), PAD, np.int64)
            for j, i in enumerate(chosen):
                s = snippets[i]
                a = rng.integers(0, max(len(s) - WINDOW // 2, 0) + 1)
                part = np.frombuffer(s[a : a + WINDOW // 2], np.uint8)
                x[: len(part), j] = part
            loss, g = self.gradients(x, targets[chosen])
            losses.append(loss)
            norm = np.sqrt(sum(float((v * v).sum()) for v in g.values()))
            rate = 0.03 * (1 - 0.9 * step / steps)
            for n, v in g.items():
                v *= min(1.0, 1.0 / (norm + 1e-9))
                first[n] += 0.1 * (v - first[n])
                second[n] += 0.01 * (v * v - second[n])
                self.w[n] -= (rate * (first[n] / (1 - 0.9**step)) / (np.sqrt(second[n] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
        return losses

    def label_texts(self, data: np.ndarray, offsets: np.ndarray, rows: int = 2048) -> np.ndarray:
        """Mean label distribution over all bytes of each text (zeros for an empty text)."""
        size = np.diff(offsets)
        windows = -(-size // WINDOW)
        doc = np.repeat(np.arange(len(size)), windows)
        nth = np.arange(len(doc)) - np.repeat(np.cumsum(windows) - windows, windows)
        start = offsets[:-1][doc] + nth * WINDOW
        length = np.minimum(offsets[1:][doc] - start, WINDOW)
        total = np.zeros((len(size), len(self.labels)))
        order = np.argsort(length, kind="stable")  # short windows together: a batch is as long as its longest
        for a in range(0, len(order), rows):
            i = order[a : a + rows]
            longest = int(length[i].max())
            step = np.arange(longest)[:, None]
            inside = step < length[i]
            x = np.where(inside, data[np.minimum(start[i] + step, len(data) - 1)].astype(np.int64), PAD)  # PAD is no byte
            p = (self.probabilities(x) * inside[:, :, None]).sum(axis=0)
            np.add.at(total, doc[i], p)
        return total / np.maximum(size, 1)[:, None]


def has_letter(text: str) -> Column:
    return F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False))


def learn(documents: DataFrame, train: Column, per_language: int = PER_LANGUAGE) -> Network:
    """A network for all languages of the training rows."""
    known = documents.where(train & F.col("lang").isNotNull() & has_letter("text")).select("doc_id", "lang", "text")
    counts = {r["lang"]: r["count"] for r in documents.where(train & F.col("lang").isNotNull()).groupBy("lang").count().collect()}
    labels = sorted(counts)
    if not labels:
        return Network([])
    # One and a half times the bound by expectation, then the bound itself by rank of the hash: at most that many rows a language reach the driver.
    share = F.lit(0.0)
    for name, n in counts.items():
        share = F.when(F.col("lang") == name, min(1.0, 1.5 * per_language / n)).otherwise(share)
    draw = F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(1 << 30))
    start = F.pmod(F.xxhash64("doc_id", F.lit(6)), F.greatest(F.length("text") - SNIPPET, F.lit(0)) + 1).cast("int") + 1
    rows = known.where(draw < share * float(1 << 30)).select("lang", draw.alias("draw"), F.substring(F.col("text"), start, F.lit(SNIPPET)).alias("snippet"))
    rows = rows.orderBy("draw", "lang", "snippet").limit(2 * per_language * len(labels)).collect()
    seen: dict[str, list[bytes]] = {name: [] for name in labels}
    for r in rows:
        if len(seen[r["lang"]]) < per_language and r["snippet"]:
            seen[r["lang"]].append(r["snippet"].encode())
    labels = [name for name in labels if seen[name]]
    if not labels:
        return Network([])
    net = Network(labels)
    net.train([s for name in labels for s in seen[name]], np.repeat(np.arange(len(labels)), [len(seen[name]) for name in labels]))
    return net


def _predictor(net: Network) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part, data, offsets in portions(b.column(1)):
                p = net.label_texts(data, offsets)
                best = p.argmax(axis=1)
                ok = b.column(2)[part].to_numpy(zero_copy_only=False).astype(bool)
                names = [net.labels[i] if yes else UNKNOWN for i, yes in zip(best, ok, strict=True)]
                score = np.where(ok, np.clip(p[np.arange(len(best)), best], 0, 1), 0.0)
                yield pa.RecordBatch.from_arrays([b.column(0)[part], pa.array(names, pa.string()), pa.array(score)], ["doc_id", "lang_pred", "score"])

    return run


def identify(documents: DataFrame, train: Column, net: Network | None = None) -> DataFrame:
    """doc_id, lang_pred, score of every row, by a network learned from the rows where `train` holds (or the one given)."""
    net = net or learn(documents, train)
    rows = documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), has_letter("text").alias("letters"))
    kind = documents.schema["doc_id"].dataType.simpleString()
    if not net.labels:
        return rows.select("doc_id", F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"))
    return rows.mapInArrow(_predictor(net), f"doc_id {kind}, lang_pred string, score double")


def keep_identified(documents: DataFrame, train: Column, least: float = 0.5) -> DataFrame:
    """The rows whose language is told with a score of at least `least`; all columns stay."""
    net = learn(documents, train)
    if not net.labels:
        return documents.where(F.lit(False))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            text, letters = b.column(b.schema.get_field_index("text")), b.column(b.num_columns - 1)
            best = np.concatenate([np.zeros(0), *(net.label_texts(data, offsets).max(axis=1) for _, data, offsets in portions(text))])
            yield b.filter(pa.array((best >= least) & letters.to_numpy(zero_copy_only=False).astype(bool))).select(range(b.num_columns - 1))

    mark = fresh(documents.columns, "has_letters")
    return documents.withColumn(mark, has_letter("text")).mapInArrow(run, documents.schema)
