"""Clusters and neighbours by the grid against those of whole windows."""

import math
import random
from dataclasses import replace

import pytest

from ampline.config import FIXTURE
from ampline.operators import clustering, grid

SCHEMA = "stream_id long, window_id long, seq long, ln_p double, ln_q double, label string"


def points(rng, n, streams=2):
    rows = []
    for s in range(streams):
        for k in range(n):
            kind = rng.random()
            if kind < 0.4:  # a dense spot, in which a cell holds many
                p, q = rng.gauss(0, 0.02), rng.gauss(1, 0.02)
            elif kind < 0.7:  # a long band
                p, q = rng.uniform(-2, 2), rng.choice([0.0, 0.05])
            elif kind < 0.75:
                p, q = rng.choice([(None, 1.0), (1.0, math.nan), (math.inf, 0.0), (0.25, 0.25)])
            else:
                p, q = rng.uniform(-3, 3), rng.uniform(-3, 3)
            rows.append((s, 7, k * 3 + s, p, q, "x"))
    return rows


@pytest.mark.parametrize(("min_pts", "eps", "seed"), [(2, 0.1, 1), (4, 0.15, 2), (7, 0.25, 3), (1, 0.1, 4)])
def test_clusters_are_those_of_whole_windows(spark, min_pts, eps, seed):
    config = replace(FIXTURE, eps=eps, min_pts=min_pts)
    df = spark.createDataFrame(points(random.Random(seed), 150), SCHEMA).repartition(4)
    want = sorted(map(tuple, clustering.dbscan(df, config).collect()))
    got = grid.numbered(grid.dbscan_grid(df, config, "stream_id", "window_id"), "stream_id", "window_id")
    mine = sorted(map(tuple, got.collect()))
    finite = {(r.stream_id, r.seq) for r in df.collect() if r.ln_p is not None and r.ln_q is not None and math.isfinite(r.ln_p) and math.isfinite(r.ln_q)}
    if min_pts == 1:  # what can't have neighbours is noise here, and a cluster of one point there
        assert [x[:3] for x in mine] == [x[:3] for x in want]
        names = {}
        assert all(names.setdefault((a[0], a[3]), b[3]) == b[3] for a, b in zip(mine, want, strict=True) if (a[0], a[2]) in finite)
    else:
        assert mine == want
    assert len({x[3] for x in want}) > 3


def test_pairs_are_those_of_whole_windows(spark):
    df = spark.createDataFrame(points(random.Random(5), 120), SCHEMA)
    want = clustering.neighbour_pairs(df, FIXTURE).drop("window_id")
    got = grid.grid_pairs(df, FIXTURE)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan
    assert "Cartesian" not in plan


def test_a_cell_that_holds_most_points_makes_no_pairs(spark):
    """Sixty thousand points in one cell: pairs of them would be 1.8 billion."""
    dense = spark.range(60_000).selectExpr("0L stream_id", "id seq", "1.001 + id * 1e-8 ln_p", "1.001D ln_q")
    other = spark.createDataFrame([(0, 100_000, 1.08, 1.0), (0, 100_001, 5.0, 5.0), (0, 100_002, 1.17, 1.0)], "stream_id long, seq long, ln_p double, ln_q double")
    got = grid.dbscan_grid(dense.unionByName(other), FIXTURE)
    assert {(r.first_core, r["count"]) for r in got.groupBy("first_core").count().collect()} == {(0, 60_002), (None, 1)}


def test_no_features(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert grid.dbscan_grid(none, FIXTURE).collect() == []
    assert grid.grid_pairs(none, FIXTURE).collect() == []
    alone = spark.createDataFrame([(0, 0, 5, None, 1.0, "x"), (0, 0, 6, 1.0, 1.0, "x")], SCHEMA)
    assert sorted(map(tuple, grid.dbscan_grid(alone, FIXTURE).collect())) == [(0, 5, None), (0, 6, None)]
