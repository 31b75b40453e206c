"""The event model over windows whose rows come in any order."""

import random

import duckdb
import pytest

from ampline.operators.model import backward_suffixes
from ampline.plans.oracles import ORACLES
from ampline.plans.queries import QUERIES
from tests.conftest import rows
from tests.test_kernel import C, fitting, stream


def tightened(seqs, points):
    """How many of the oldest points can go one by one while the rest fits, and the interval of the last rest; every rest clustered anew."""
    found = [fitting(seqs[i:], points[i:]) for i in range(len(seqs))]
    n = next((i for i, x in enumerate(found) if x is None), len(found))
    return (n - 1, *found[n - 1]) if n else None


@pytest.mark.parametrize("order", ["shuffled", "newest first"])
def test_suffixes_dont_depend_on_the_order_of_rows(spark, order):
    rng = random.Random(3)
    features, want = [], []
    for window in range(12):
        seqs = sorted(rng.sample(range(100 * window, 100 * window + 100), rng.choice([60, 100])))
        points = stream(rng, len(seqs))
        features += [(0, window, s, *x) for s, x in zip(seqs, points, strict=True)]
        found = tightened(seqs, points)
        want += [(0, window, *found)] if found else []
    assert any(dropped for _, _, dropped, *_ in want) and len(want) < 12
    rng.shuffle(features) if order == "shuffled" else features.reverse()
    df = spark.createDataFrame(features, "stream_id long, window_id long, seq long, ln_p double, ln_q double").coalesce(1)
    assert sorted(map(tuple, backward_suffixes(df, C).collect())) == want


def test_features_without_a_position_are_in_no_window(spark):
    window = [(0, 0, s, 0.0, 0.0) for s in range(5)] + [(0, 0, 5, 9.0, 9.0), (0, 0, 6, 5.0, 0.0), (0, 0, 7, 5.0, 0.0)]
    lost = [(None, None, None, 1.0, 1.0), (0, None, None, 1.0, 1.0), (0, 0, None, 30.0, 1.0)]
    df = spark.createDataFrame(window + lost, "stream_id long, window_id long, seq long, ln_p double, ln_q double")
    assert [tuple(r) for r in backward_suffixes(df, C).collect()] == [(0, 0, 3, 5, 5)]


def test_suffixes_of_many_windows_are_those_of_the_sql(spark):
    """Of sf0.01, as no window of sf0.001 has an event."""
    name, sf = "backward_suffix_check", "/root/testdata/sf0.01"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM read_parquet('{sf}/events.parquet')")
    got, want = QUERIES[name](spark, sf), con.execute(ORACLES[name])
    found = rows(got.columns, got.collect())
    assert found == rows([d[0] for d in want.description], want.fetchall())
    assert found[1]
