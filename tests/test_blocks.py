"""One stream in blocks gives the answers of the sequential detector."""

import random
from dataclasses import replace

import numpy as np
import pytest

from ampline.config import DetectorConfig
from ampline.streaming.batch import detect_features
from ampline.streaming.blocks import BlockRuns, detect_in_blocks, in_blocks
from ampline.streaming.kernel import Clean
from tests.test_kernel import C, answers, stream

SETTINGS = [C, replace(C, trim="backward", point_shift=0), replace(C, trim="v1", point_shift=0)]
FEATURES = "stream_id long, seq long, ln_p double, ln_q double"


def steady(rng, n):
    """Long levels with lone spikes, and now and then another level."""
    out, level = [], 1.0
    while len(out) < n:
        out += [(level, 1.0)] * rng.randint(50, 300)
        out += [(90.0 + rng.random() * 9, 50.0)] * rng.randint(0, 1)
        level += rng.random() < 0.3
    return out[:n]


def arrays(points):
    return (np.array([np.nan if x[k] is None else x[k] for x in points]) for k in (0, 1))


@pytest.mark.parametrize("make", [stream, steady])
@pytest.mark.parametrize("config", SETTINGS)
def test_runs_of_a_block_from_each_state(make, config):
    """From what a stream's first part leaves, the second gives the answers and the state that it gives in one piece."""
    rng = random.Random(7)
    for _ in range(25):
        n = rng.randint(210, 420)
        points = make(rng, n)
        whole = Clean(config)
        told = [x for s, x in enumerate(points) for x in whole.feed(s, *x)]
        past = rng.randint(105, n - 1)
        first = Clean(config)
        for s in range(past):
            first.feed(s, *points[s])
        from_ = past - config.max_window
        runs = BlockRuns(list(range(from_, n)), *arrays(points[from_:]), config.max_window, config)
        size, drift = len(first.inner.window.points), first.inner.drift
        assert [(past + k, 1, e) for k, e in runs.events(size, drift)] == [x for x in told[past:] if x[1]]
        end = runs.exits()[size]
        assert end.size == len(whole.inner.window.points)
        assert end.drift + (0 if end.fixed else drift) == whole.inner.drift


def test_tables_do_not_depend_on_the_order_of_sizes():
    points = stream(random.Random(3), 400)
    make = lambda: BlockRuns(list(range(400)), *arrays(points), 100, C)
    shared, want = make(), [make().exit(size) for size in range(101)]
    assert [shared.exit(size) for size in reversed(range(101))] == want[::-1]
    assert make().exits() == want


def test_a_level_without_lone_features_is_skipped():
    """All sizes, over 50,000 features, without one distance."""
    n = 50_000
    runs = BlockRuns(list(range(n)), np.ones(n), np.ones(n), 100, C)
    assert runs.lone == []
    assert [x.size for x in runs.exits()] == [(n - 100 + size) % 101 for size in range(101)]
    assert list(runs.events(50, 0)) == []


def plain(df):
    return sorted(map(tuple, df.select("stream_id", "emit_ord", "s", "d", "event_s").collect()))


@pytest.mark.parametrize("config", SETTINGS)
def test_streams_in_blocks_answer_as_the_batch(spark, config):
    rng = random.Random(11)
    rows = []
    for name, n in ((5, 2_500), (6, 260), (7, 1), (8, 101)):
        # positions have holes, and a stream may begin anywhere
        seqs = sorted(rng.sample(range(10_000_000 * name, 10_000_000 * name + 2 * n), n))
        rows += [(name, s, *x) for s, x in zip(seqs, stream(rng, n), strict=True)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, FEATURES)
    got = plain(detect_in_blocks(df, config, block=210))
    assert got == plain(detect_features(df, config))
    assert sum(x[3] for x in got) > 20


def test_blocks_hold_every_feature_once_and_a_window_before_them(spark):
    df = spark.createDataFrame([(1, s if s < 500 else s + 10**9, 1.0, 1.0) for s in range(1_500)], FEATURES)
    rows = in_blocks(df, C, block=300)
    own = rows.where("not past")
    assert own.count() == own.select("seq").distinct().count() == 1_500
    sizes = own.groupBy("block").count().collect()
    assert len(sizes) == 5 and max(x["count"] for x in sizes) < 450 and min(x["count"] for x in sizes) > 150
    assert {x["count"] for x in rows.where("past").groupBy("block").count().collect()} == {100}


def test_no_features_and_small_blocks(spark):
    none = spark.createDataFrame([], FEATURES)
    assert detect_in_blocks(none, C).collect() == []
    with pytest.raises(ValueError, match="two windows"):
        detect_in_blocks(none, DetectorConfig(), block=200)


def test_null_powers_are_noise(spark):
    points = [(1.0, 1.0)] * 5 + [(None, None)] + [(2.0, 1.0)] * 5
    df = spark.createDataFrame([(1, s, *x) for s, x in enumerate(points)], FEATURES)
    assert [x[2:] for x in plain(detect_in_blocks(df, C))] == answers(points, C)
