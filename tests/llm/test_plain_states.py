"""op2's forward pass without what training keeps."""

import numpy as np

from polislake.llm.language_id import PAD, Network


def test_plain_states_are_the_states():
    net = Network(["a", "b", "c"])
    x = np.random.default_rng(5).integers(0, 256, (40, 30))
    x[25:, ::3] = PAD  # short windows beside long ones
    x[:, 4] = PAD
    for d in "fb":
        want, got = dict((t, h.copy()) for t, h in net.states(x, d)), dict((t, h.copy()) for t, h in net._plain_states(x, d))
        assert list(got) == list(want)
        for t in want:
            np.testing.assert_allclose(got[t], want[t], atol=2e-6)
    p = net.probabilities(x)
    assert np.allclose(p.sum(axis=2), 1, atol=1e-5)
    logits = np.zeros((40, 30, 3), np.float32)
    for d in "fb":
        for t, h in net.states(x, d):
            logits[t] += h @ net.w[f"out_{d}"]
    e = np.exp(logits + net.w["bias"])
    np.testing.assert_allclose(p, e / e.sum(axis=2, keepdims=True), atol=2e-6)
