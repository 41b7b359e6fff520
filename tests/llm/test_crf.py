"""The skip-chain field against enumeration."""

from itertools import product

import numpy as np
import pytest

from rulesieve.llm.crf import EDGE, SkipChain


@pytest.fixture(scope="module")
def field():
    words = ["a", "b", "c", "d"]
    rng = np.random.default_rng(0)
    seqs = [[words[i] for i in rng.integers(0, 4, rng.integers(1, 7))] for _ in range(120)]
    golds = [[int(w in "ab") if k == 0 or s[k - 1] != "c" else 2 for k, w in enumerate(s)] for s in seqs]
    return SkipChain(["x", "y", "z"], lambda t: [t], size=64).fit(seqs, golds, rounds=6, skips=lambda s: [(i, j) for i in range(len(s)) for j in range(i + 2, len(s)) if s[i] == s[j]])


def scores(f, seq):
    flat, start, size = f._layout([seq])
    return f._emissions(flat)[start[0] - EDGE : start[0] - EDGE + size[0]]


def enumerated(f, seq, edges, may=None):
    """(marginals, log of the total weight) over all labellings that ``may`` allows."""
    emit = scores(f, seq)
    total, z = np.zeros(emit.shape), 0.0
    for y in product(range(3), repeat=len(seq)):
        if may and any(m is not None and v not in m for v, m in zip(y, may, strict=True)):
            continue
        score = f.begin[y[0]] + sum(emit[k, v] for k, v in enumerate(y)) + sum(f.moves[a, b] for a, b in zip(y, y[1:], strict=False)) + sum(f.skip[y[i], y[j]] for i, j in edges)
        z += np.exp(score)
        for k, v in enumerate(y):
            total[k, v] += np.exp(score)
    return total / total.sum(1, keepdims=True), np.log(z)


@pytest.mark.parametrize("seq", [["a"], ["a", "c", "b"], ["d", "d", "c", "a", "b", "c"]])
def test_chain_marginals_are_exact(field, seq):
    assert np.allclose(field.marginals([seq], [[]])[0], enumerated(field, seq, [])[0], atol=1e-4)


def test_loopy_marginals_come_near(field):
    seq, edges = ["a", "c", "b", "d", "a"], [(0, 4)]
    alone, tied, exact = field.marginals([seq], [[]])[0], field.marginals([seq], [edges])[0], enumerated(field, seq, edges)[0]
    assert np.abs(tied - exact).max() < 0.05 and np.abs(tied - exact).max() <= np.abs(alone - exact).max() + 1e-3


def test_an_edge_pulls_labels_together(field):
    field.skip, kept = np.eye(3, dtype=np.float32) * 4, field.skip
    try:
        seq = ["a", "d", "d", "q"]
        alone, tied = field.marginals([seq, seq], [[], [(0, 3)]])
    finally:
        field.skip = kept
    first = alone[0].argmax()
    assert tied[3][first] > alone[3][first]


def test_learns_and_batches_alike(field):
    seqs = [["c", "a"], ["a"], ["b", "c", "d", "a"]]
    whole = field.marginals(seqs, [[], [], []])
    for s, m in zip(seqs, whole, strict=True):
        assert np.allclose(m, field.marginals([s], [[]])[0], atol=1e-5)
    assert whole[0].argmax(1).tolist() == [0, 2]


def test_skip_potential_climbs_the_likelihood():
    """The gradient of the skip potential is that of the log-likelihood, open places summed out."""
    rng = np.random.default_rng(1)
    f = SkipChain(["x", "y", "z"], lambda t: [t], size=32)
    f.weights = rng.normal(0, 0.5, f.weights.shape).astype(np.float32)
    f.skip = rng.normal(0, 0.3, (3, 3)).astype(np.float32)
    f.skip = (f.skip + f.skip.T) / 2
    seq, known, edges = ["a", "b", "a"], [1, None, (0, 1)], [(0, 2)]
    may = [(1,), None, (0, 1)]
    grad = f._gradients(f._prepare([seq], [known], [edges]), 3)[-1]
    for a, b in ((0, 0), (0, 1), (1, 2)):
        said = []
        for step in (1e-2, -1e-2):
            kept = f.skip.copy()
            f.skip[a, b] += step / 2
            f.skip[b, a] += step / 2
            said.append(enumerated(f, seq, edges, may)[1] - enumerated(f, seq, edges)[1])
            f.skip = kept
        assert (said[0] - said[1]) / 2e-2 == pytest.approx(grad[a, b], abs=0.03)


def test_open_places_take_what_the_rest_says():
    seqs, known = [["m", "a"], ["m", "b"], ["n", "a"], ["n", "b"]] * 20, [[0, 1], [0, None], [0, 2], [0, None]] * 20
    f = SkipChain(["o", "y", "z"], lambda t: [t], size=64).fit(seqs, known, rounds=20)
    got = f.marginals([["m", "q"], ["n", "q"]])
    assert got[0][1].argmax() == 1 and got[1][1].argmax() == 2


def test_quiet_sequences_are_proved(field):
    rng = np.random.default_rng(5)
    seqs = [["abcd"[i] for i in rng.integers(0, 4, rng.integers(1, 9))] for _ in range(200)]
    for rest in range(3):
        whole = field.marginals(seqs)
        for m, q in zip(whole, field.marginals(seqs, rest=rest), strict=True):
            assert q is not None or (m.argmax(1) == rest).all()
