"""op7: the searches of many texts advance in passes over all of them."""

import sys
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from polislake.llm import sampling as S
from polislake.llm.pieces import default_vocabulary


def rows(texts):
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts, pa.string())], ["doc_id", "text"])
    return [r for b in S._sampler(default_vocabulary(), 4, 1)(iter([batch])) for r in b.to_pylist()]


def calls(texts):
    n = Counter()
    sys.setprofile(lambda frame, event, arg: n.update([event]))
    try:
        rows(texts)
    finally:
        sys.setprofile(None)
    return n["call"] + n["c_call"]


def test_steps_do_not_grow_with_the_texts():
    """More texts are wider passes, not more of them: before, a text took some 200 calls of its own."""
    texts = [f"the council will vote on water {i % 7} and the motion of the members" for i in range(500)]
    rows(texts[:1])
    assert calls(texts) - calls(texts[:100]) < 40 * 400


def test_passes_over_many_texts_give_each_its_own_samples():
    """Texts of one, two and many segmentations, empty ones and nulls together give what each gives alone."""
    texts = ["a", "", None, "zq", "\n", "the council will vote on water " * 9, "日本 é", " ", "a b", "the"]
    together = rows(texts)
    for i, t in enumerate(texts):
        alone = rows([None] * i + [t])
        mine = [r for r in together if r["doc_id"] == i]
        assert [(r["sample_rank"], r["ids"], r["n_pieces"]) for r in alone] == [(r["sample_rank"], r["ids"], r["n_pieces"]) for r in mine]
        for name in ("log_prob", "perturbed", "inclusion", "log_likelihood"):
            assert [r[name] for r in alone] == pytest.approx([r[name] for r in mine], abs=1e-9)
        assert bool(mine) == (t is not None)


@pytest.mark.parametrize("want", [1, 3])
def test_largest_of_each_run(want):
    v = np.array([3.0, -np.inf, 5.0, 4.0, np.nan, 7.0, 1.0, -np.inf])
    values, at = S.largest(v.copy(), np.array([0, 4, 3, 0, 1]), want)
    assert [[(x, int(i)) for x, i in zip(*r) if x > -np.inf] for r in zip(values, at)] == [[], [(5.0, 2), (4.0, 3), (3.0, 0)][:want], [(7.0, 5), (1.0, 6)][:want], [], []]
