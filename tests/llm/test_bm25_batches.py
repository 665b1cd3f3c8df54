"""Queries of op6 go through a shard together; some shards are searched first."""

import numpy as np
import pyarrow as pa
import pytest

from polislake.llm import bm25_search as S


def _texts(n: int, seed: int = 3) -> list[str]:
    rng = np.random.default_rng(seed)
    words = np.minimum(rng.zipf(1.3, (n, 30)), 400)
    texts = [" ".join(f"w{w}" for w in row[: 1 + i % 30]) for i, row in enumerate(words.tolist())]
    return [*texts[:-9], *texts[:4], "", " \t", *texts[:3]]


def _plain(ids: list[int], texts: list[str], asked: list[int], k: int) -> dict:
    held = [t.split() for t in texts]
    n, mean = len(held), sum(map(len, held)) / len(held)
    df = {}
    for t in held:
        for w in set(t):
            df[w] = df.get(w, 0) + 1
    out = {}
    for q in asked:
        score = lambda d: sum(np.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5)) * d.count(w) * 2.2 / (d.count(w) + 1.2 * (0.25 + 0.75 * len(d) / mean)) for w in set(held[q]) if w in d)
        found = sorted((-round(s, 6), i) for i, s in zip(ids, map(score, held), strict=True) if s > 0)
        out[ids[q]] = found[:k]
    return out


@pytest.mark.parametrize("sparse", [1, 24, 1 << 20])
def test_rows_of_the_search_do_not_depend_on_columns_or_turns(spark, monkeypatch, sparse):
    texts = _texts(600)
    ids = list(range(len(texts)))
    df = spark.createDataFrame(list(zip(ids, texts, strict=True)), "doc_id long, text string").repartition(3)
    want = _plain(ids, texts, [i for i in ids if i % 50 == 0], 10)
    monkeypatch.setattr(S, "MANY_SHARDS", 1)
    monkeypatch.setattr(S, "TURNS", 2)
    monkeypatch.setattr(S, "SPARSE", sparse)
    got = {}
    for r in S.search(df, df.doc_id % 50 == 0, block_terms=200).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((-r["score"], r["doc_id"]))
    assert got.keys() == {q for q, f in want.items() if f}
    for q, found in got.items():
        np.testing.assert_allclose([f[0] for f in found], [f[0] for f in want[q]], atol=2e-6)
        assert [f[1] for f in found] == [f[1] for f in want[q]]


def test_known_scores_keep_documents_out():
    texts = _texts(400)
    rows = pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array(texts)], ["doc_id", "text"])
    (index,) = S._index_mapper(iter([rows]))
    shard = S.Shard(index.column(0)[0].as_py(), 15.0)
    terms = np.repeat(shard.terms, np.diff(shard.bounds))
    asked = shard.ids[shard.doc]
    queries = S.Queries(asked, terms.view(np.int64), np.repeat(np.diff(shard.bounds), np.diff(shard.bounds)).astype(np.int64), len(texts))
    place = np.searchsorted(shard.terms, queries.terms)
    n = len(queries.ids)
    none = (np.zeros(0), np.zeros(0, np.int64))
    free, bound = [none] * n, [none] * n
    shard.search(queries, place, slice(0, n), 5, free, np.full(n, -np.inf))
    least = np.array([f[0][2] if len(f[0]) > 2 else np.inf for f in free])
    shard.search(queries, place, slice(0, n), 5, bound, least)
    for f, b, low in zip(free, bound, least, strict=True):
        keep = f[0] >= low - 1e-6
        assert b[0].tolist() == f[0][keep].tolist() and b[1].tolist() == f[1][keep].tolist()


def test_a_shard_without_words():
    rows = pa.RecordBatch.from_arrays([pa.array([1, 2], pa.int64()), pa.array(["", " "])], ["doc_id", "text"])
    (index,) = S._index_mapper(iter([rows]))
    assert not len(S.Shard(index.column(0)[0].as_py(), 0.0).terms)
