"""A block of sets joins what comparing all its pairs joins."""

import random
import time

import numpy as np
import pytest

from ampline.llm import jaccard_join
from ampline.llm.jaccard_join import Cluster, JaccardConfig, Matrix, _block_edges

CONFIG = JaccardConfig()


def families(rng, n, size=60):
    """Sets that drift in small steps, that share a part just short of linking, that repeat, and that have nothing in common."""
    out, base = [], rng.sample(range(10**9), size)
    common = rng.sample(range(10**9), size)
    while len(out) < n:
        kind = rng.random()
        if kind < 0.5:
            base = [x if rng.random() > 0.04 else rng.randrange(10**9) for x in base]
            out.append(base)
        elif kind < 0.8:
            out.append(common[: rng.randint(size - 8, size)] + rng.sample(range(10**9), rng.randint(1, 7)))
        elif kind < 0.9 and out:
            out.append(rng.choice(out))
        else:
            out.append(rng.sample(range(10**9), rng.randint(1, size)))
    rng.shuffle(out)
    return [np.unique(np.array(x, np.uint64)) for x in out]


def groups(n, edges):
    label = list(range(n))
    for a, b in edges:
        label = [label[a] if x == label[b] else x for x in label]
    return label


def parts(n, edges):
    label = groups(n, edges)
    return {frozenset(k for k in range(n) if label[k] == x) for x in label}


def linked(a, b):
    common = len(np.intersect1d(a, b))
    return CONFIG.links(common, len(a), len(b))


@pytest.mark.parametrize("loose, entries", [(0, 50), (1, 10**6), (3, 200), (16, 2_000_000)])
@pytest.mark.parametrize("seed", range(4))
def test_members_and_queries_of_a_block(monkeypatch, loose, entries, seed):
    monkeypatch.setattr(jaccard_join, "LOOSE", loose)
    monkeypatch.setattr(jaccard_join, "ENTRIES", entries)
    rng = random.Random(seed)
    sets = families(rng, 130)
    n, held = len(sets), 90
    edges = list(_block_edges(list(range(n)), sets, [k >= held for k in range(n)], CONFIG))
    assert all(linked(sets[a], sets[b]) for a, b in edges)
    # queries aren't held against each other
    pairs = [(a, b) for a in range(n) for b in range(a) if b < held and linked(sets[a], sets[b])]
    assert parts(n, edges) == parts(n, pairs)
    assert len(pairs) > len(edges) > 20


def test_the_matrix_counts_what_each_union_holds():
    rng = random.Random(5)
    sets = families(rng, 40)
    clusters = [Cluster(k, s) for k, s in enumerate(sets)]
    clusters[0].join(clusters.pop())
    matrix = Matrix(clusters)
    for s in [*sets, *families(rng, 5), np.array([2**64 - 1], np.uint64)]:
        assert matrix.overlaps(s).tolist() == [len(np.intersect1d(s, x.union)) for x in clusters]


def test_texts_of_one_template_are_not_compared_one_by_one(monkeypatch):
    """256 members and 1,024 queries that share 200 of 230 shingles, and link with nothing."""
    rng = np.random.default_rng(1)
    common = rng.integers(0, 2**63, 200, np.uint64)
    sets = [np.unique(np.concatenate((common, rng.integers(0, 2**63, 30, np.uint64)))) for _ in range(1_280)]
    compared = []
    monkeypatch.setattr(jaccard_join, "_common", lambda a, b, f=jaccard_join._common: compared.append(1) or f(a, b))
    start = time.perf_counter()
    assert list(_block_edges(list(range(1_280)), sets, [k >= 256 for k in range(1_280)], CONFIG)) == []
    took = time.perf_counter() - start
    print(f"{took:.3f} s, {took / (256 * 1_024 + 256 * 255 / 2) * 1e6:.2f} microseconds a pair, {len(compared)} comparisons")
    assert len(compared) <= 256 * jaccard_join.LOOSE
