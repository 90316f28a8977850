"""The learner's step: sums by input, the gradient made in place, and Adam over weights that lie in one piece."""

import numpy as np
import pytest

from weftgraph.llm import lm


@pytest.mark.parametrize("kinds", [1, 3, 40, 2000])
def test_rows_are_summed_by_input(kinds):
    rng = np.random.default_rng(kinds)
    of = rng.integers(0, kinds, 1500).astype(np.int32)
    x = rng.normal(size=(1500, 7))
    whole = np.zeros((kinds, 7))
    np.add.at(whole, of, x)
    found, sums = lm._summed_rows(x, of)
    assert found.tolist() == sorted(set(of.tolist()))
    np.testing.assert_allclose(sums, whole[found], atol=1e-9)


def test_step_moves_all_weights_as_adam_does(monkeypatch):
    monkeypatch.setattr(lm, "BLOCK", 50)
    monkeypatch.setattr(lm, "IN_ROWS", 3)
    words = {f"w{i}".encode(): 40 - i for i in range(12)}
    codes = lm.Codes(words, 5, [(w[-2:], c, 0, 1) for w, c in words.items()])
    rng = np.random.default_rng(3)
    p = lm.initial(codes) | {"wc": rng.normal(0, 0.3, (lm.HIDDEN, codes.n_classes)).astype(np.float32)}
    taught = lm.Learner(p, codes)
    docs = [np.array([1, 2, 3, 1, 5, 1], np.int16), np.array([4, 7], np.int16)]
    before = {k: v.copy() for k, v in taught.p.items()}
    assert taught.learn(docs, 0.01) > 0
    for k in taught.dense:  # of one step, each weight's change follows from its moments; weights without a gradient stay
        m, v = taught.m[k], taught.v[k]
        np.testing.assert_allclose(before[k] - taught.p[k], 0.01 * np.sqrt(0.001) / 0.1 * m / (np.sqrt(v) + 1e-6), atol=1e-6)
        assert np.shares_memory(taught.p[k], taught.flat_p) and taught.p[k].shape == p[k].shape
    read = np.flatnonzero(np.abs(taught.p["x"] - before["x"]).sum(axis=1))
    assert set(read) == {0, 2, 3, 4, 5, 6, 8} and all((p[k] == before[k]).all() for k in p)
