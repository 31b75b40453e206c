"""Viterbi and forward-backward against all label sequences, and cut into parts against whole chains."""

import itertools
import random
import time

import numpy as np
import pytest

from ampline.llm import chains


def bounds(rng, n, most):
    return np.cumsum([0, *(rng.randint(0, most) for _ in range(n))])


@pytest.mark.parametrize("part", [1, 2, 3, 2048])
def test_viterbi_finds_the_best_of_all_sequences(monkeypatch, part):
    monkeypatch.setattr(chains, "PART", part)
    rng = random.Random(part)
    for _ in range(20):
        offsets, penalty = bounds(rng, 6, 6), rng.choice([0.5, 2.0])
        scores = np.array([[rng.uniform(-3, 0) for _ in range(3)] for _ in range(offsets[-1])], np.float32).reshape(-1, 3)
        got = chains.viterbi(scores, offsets, penalty)
        for a, b in itertools.pairwise(offsets.tolist()):
            worth = lambda x, a=a, b=b: scores[np.arange(a, b), list(x)].sum(dtype=float) - penalty * sum(p != q for p, q in itertools.pairwise(x))
            assert worth(got[a:b].tolist()) == pytest.approx(max(map(worth, itertools.product(range(3), repeat=b - a))), abs=1e-6)


@pytest.mark.parametrize("part", [1, 2, 3, 2048])
def test_marginals_are_those_of_all_sequences(monkeypatch, part):
    monkeypatch.setattr(chains, "PART", part)
    rng = random.Random(part)
    for _ in range(20):
        offsets, start = bounds(rng, 6, 6), rng.uniform(-2, 2)
        lead, change = np.array([rng.uniform(-4, 4) for _ in range(offsets[-1])]), np.array([[rng.uniform(-2, 2) for _ in range(2)] for _ in range(2)])
        ahead, back = chains.chain_odds(lead, offsets, start, change)
        p = ahead * back / (1 + ahead * back)
        for a, b in itertools.pairwise(offsets.tolist()):
            total, on = 0.0, np.zeros(b - a)
            for x in itertools.product((0, 1), repeat=b - a):
                w = np.exp(lead[a:b] @ np.array(x) + (start * x[0] if x else 0) + sum(change[p_, q] for p_, q in itertools.pairwise(x)))
                total += w
                on += w * np.array(x)
            assert p[a:b] == pytest.approx(on / total, abs=1e-9)


def test_a_long_chain_in_parts_is_the_whole_chain(monkeypatch):
    rng = np.random.default_rng(1)
    offsets = np.array([0, 3, 200_003, 200_004, 200_004])
    scores, lead = rng.uniform(-6, 0, (offsets[-1], 4)).astype(np.float32), rng.uniform(-4, 2, offsets[-1])
    change = np.array([[0.0, -1.0], [-0.5, 1.0]])
    start = time.perf_counter()
    labels, odds = chains.viterbi(scores, offsets, 8.0), chains.chain_odds(lead, offsets, -1.0, change)
    assert time.perf_counter() - start < 5
    monkeypatch.setattr(chains, "PART", 1 << 40)
    whole, odds_whole = chains.viterbi(scores, offsets, 8.0), chains.chain_odds(lead, offsets, -1.0, change)
    assert (labels == whole).all()
    for a, b in zip(odds, odds_whole, strict=True):
        assert np.allclose(a, b, rtol=1e-6)
