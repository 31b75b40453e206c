"""Clusters against Lloyd's rounds written out with Python integers."""

import hashlib
import math
import random
from dataclasses import replace

import numpy as np
import pytest

from ampline.llm.dual_tree import LloydConfig, Tree, cluster, described, nearest

C = LloydConfig(components=3, k=4, rounds=6, block=40, leaf=3)


def brute(rows, c):
    kept = [(i, [math.floor(c.scale * x) for x in v]) for i, v in rows if v is not None and len(v) == c.components and all(x is not None and math.isfinite(x) for x in v)]
    named = [(hashlib.sha256(f"{c.seed}{i}".encode()).hexdigest(), x) for i, x in kept if i is not None]
    centres = [x for _, x in sorted(named)[: c.k]]

    def near(x):
        return min((sum((a - b) ** 2 for a, b in zip(x, y, strict=True)), k) for k, y in enumerate(centres))

    for _ in range(c.rounds):
        mine = [near(x)[1] for _, x in kept]
        for k in range(len(centres)):
            held = [x for (_, x), m in zip(kept, mine, strict=True) if m == k]
            if held:
                centres[k] = [sum(col) // len(held) for col in zip(*held, strict=True)]
    return [(i, near(x)[1], near(x)[0]) for i, x in kept], centres


def vectors(rng, n):
    out = []
    for i in range(n):
        out.append((i, [rng.choice([0.0, 0.5, 1.0, -2.0]) + rng.choice([0, 0, rng.random() / 9]) for _ in range(3)]))
    out += [(n, None), (n + 1, [1.0, 2.0]), (n + 2, [1.0, None, 2.0]), (n + 3, [1.0, math.nan, 2.0]), (n + 4, [math.inf, 0.0, 0.0]), (None, [0.1, 0.2, 0.3])]
    out += [(7, [0.25, 0.25, 0.25])] * 60 + [(8, [-0.1, 0.0, 9.0])]  # a vector that repeats, ids that do
    return out


@pytest.mark.parametrize("seed", range(3))
def test_clusters_are_those_of_plain_rounds(spark, seed):
    rows = vectors(random.Random(seed), 150)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumnRenamed("vec_id", "vec_id").selectExpr("*", "1 as cluster", "2 as x").repartition(3)
    rows = [(r.vec_id, r.embedding) for r in df.collect()]
    want, centres = brute(rows, C)
    got, found = cluster(df, C)
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, want))
    assert found.tolist() == centres
    told = described(df, C).collect()
    assert len(told) == len(want)
    assert {r.inertia for r in told} == {sum(x[2] for x in want)}
    assert all(r.cluster_inertia == sum(x[2] for x in want if x[1] == r.cluster) for r in told)
    assert all(r.centroid_sha256 == hashlib.sha256(",".join(map(str, centres[r.cluster])).encode()).hexdigest() for r in told)


def test_trees_prune_nothing_that_counts():
    rng = np.random.default_rng(5)
    for n, k, spread in ((1, 1, 0), (300, 7, 3), (300, 20, 1000), (500, 33, 1 << 24), (64, 64, 2)):
        x, y = (rng.integers(-spread - 1, spread + 1, (m, 5)).astype(np.int64) for m in (n, k))
        tree, order = Tree.over(x, 4)
        label, distance = nearest(tree, y)
        apart = ((x[order][:, None, :] - y[None, :, :]) ** 2).sum(2)
        assert (label == apart.argmin(1)).all()
        assert (distance == apart.min(1)).all()


def test_the_tree_covers_and_separates():
    x = np.random.default_rng(6).integers(-500, 500, (400, 4)).astype(np.int64)
    tree, _ = Tree.over(x, 1)
    for j in range(len(tree.centre)):
        apart = np.sqrt(((tree.x[tree.begin[j] : tree.end[j]] - tree.x[tree.centre[j]]) ** 2).sum(1))
        assert np.isclose(apart.max(), tree.radius[j])
        if tree.children[j]:
            down = tree.centre[tree.first[j] : tree.first[j] + tree.children[j]]
            assert tree.centre[j] in down
            half = 2.0 ** (np.ceil(np.log2(tree.radius[j])) - 1)
            between = np.sqrt(((tree.x[down][:, None] - tree.x[down][None]) ** 2).sum(2))
            assert (between[~np.eye(len(down), dtype=bool)] > half).all()


def test_few_none_and_huge(spark):
    schema = "vec_id long, embedding array<float>"
    assert cluster(spark.createDataFrame([], schema), C)[0].collect() == []
    assert described(spark.createDataFrame([(1, None)], schema), C).collect() == []
    two = described(spark.createDataFrame([(1, [0.0, 0.0, 0.0]), (2, [1.0, 0.0, 0.0])], schema), C).collect()
    assert sorted((r.vec_id, r.distance) for r in two) == [(1, 0), (2, 0)]
    assert len({r.cluster for r in two}) == 2
    huge = cluster(spark.createDataFrame([(1, [1e30, 0.0, 0.0]), (2, [-1e30, 0.0, 0.0])], schema), replace(C, k=1))[0].collect()
    assert sum(r.distance for r in huge) in (2 * (1 << 26) ** 2, (1 << 27) ** 2)
