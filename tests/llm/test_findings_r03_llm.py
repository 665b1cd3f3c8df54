"""Cases of the third review."""

import random

import numpy as np
import pytest

from polislake.llm import lattice_lm
from polislake.llm.pieces import default_vocabulary, vocabulary


@pytest.mark.parametrize("buckets", [256, 300])
def test_answers_of_more_than_255_buckets(spark, buckets):
    """The number of a bucket comes packed in a byte where it fits; 255 and one more must not be 0. Only chunks that a reader cannot have cut are told apart by it."""
    draw, path = random.Random(4), default_vocabulary()
    logp = vocabulary(path).logp
    word = lambda: "".join(draw.choice("abcdefgh") for _ in range(6))
    rows = [(i, " ".join(word() for _ in range(3000)), i) for i in range(4)]
    held = spark.createDataFrame(rows, "doc_id long, text string, chunk long").coalesce(1).sortWithinPartitions("chunk")
    words = spark.createDataFrame([], "bucket int, blob binary")
    none = np.zeros(1)
    model = {"logp": logp[None, :], "end": none, "weight": none, "own": logp, "kinds": none, "uses": none, "go_on": none, "whole": False}
    score = lambda n: sorted((r["doc_id"], r["n_tokens"], round(r["score"], 6)) for r in lattice_lm._answer(held, words, n, path, model, 0, 0, 0).collect())
    got = score(buckets)
    assert got == score(3) and [r[1] for r in got] == [3001] * 4


def test_far_sets_change_no_sample(monkeypatch):
    """Values for all sets of a path, or for the near ones and the rest only where those leave an offer open: the same samples."""
    import numpy as np

    from polislake.llm import sampling as S
    from polislake.llm.pieces import default_vocabulary, vocabulary

    texts = [b"the council will vote on water " * 60, b"a", b"", b"zq " * 300, "é日本 x\ty\n".encode() * 40]
    data, offsets = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)])
    found = []
    for reach in (45.0, 1e9, 37.5):
        monkeypatch.setattr(S, "REACH", reach)
        lattice = S.Lattice(S.lattices_for(default_vocabulary()), vocabulary(default_vocabulary()).logp)
        found.append([([(x.tolist(), p, v) for x, p, v in samples], kappa, z) for samples, kappa, z in S.sample_texts(lattice, data, offsets, [str(i).encode() for i in range(len(texts))], 4)])
    assert found[0] == found[1] == found[2]
