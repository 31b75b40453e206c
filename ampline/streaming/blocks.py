"""One long stream over many tasks: blocks of features in order, whatever the window may hold when a block begins.

A window is the newest features of its stream, so between two features the detector's state is the window's size, of which
there are ``max_window + 1``, and a drift. That makes a block a table from the size at its begin to the size at its end:

1. Each block, with the ``max_window`` features before it, gives its table. Runs that start from different sizes become one
   with the first event that they share, and what follows is run once.
2. The tables of a stream are read in order, which gives the state at each block's begin: a few hundred numbers a block.
3. Each block gives its answers from that state.

A run goes from one event or reset to the next. An event needs a noise feature between two clusters, and that has a
neighbour neither in the feature before it nor in the one after; a window without such a feature is skipped unread. Only
a stream of lone spikes without any event costs ``max_window`` runs of a block in the first step.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ampline.config import DetectorConfig
from ampline.operators.stored import stored
from ampline.streaming.batch import RESULT
from ampline.streaming.kernel import InOrder, clean_point

#: Features of a block, about: between half and one and a half times as many, but for a stream's last block, which may have fewer.
BLOCK = 20_000


@dataclass(frozen=True)
class Exit:
    """The window's size at a block's end, and the drift: ``drift`` more than at its begin, or, if ``fixed``, just that."""

    size: int
    fixed: bool
    drift: int

    def before(self, drift: int, reset: bool) -> Exit:
        """The same, of a run that first changes its drift by ``drift`` or empties its window."""
        return self if self.fixed else Exit(self.size, True, self.drift) if reset else Exit(self.size, False, self.drift + drift)


class BlockRuns:
    """Runs of the detector over a block: features in order, of which the first ``past`` are those before the block."""

    def __init__(self, seqs: list[int], p: np.ndarray, q: np.ndarray, past: int, config: DetectorConfig):
        self.config, self.seqs, self.past = config, seqs, past
        self.points = [clean_point(*x) for x in zip(p.tolist(), q.tolist(), strict=True)]
        p, q = (np.array([np.nan if x[k] is None else x[k] for x in self.points]) for k in (0, 1))
        dp, dq = np.diff(p), np.diff(q)
        near = np.concatenate(([False], np.sqrt(dp * dp + dq * dq) <= config.eps, [False]))
        self.lone = np.flatnonzero(~near[1:] & ~near[:-1]).tolist()
        self._exits: dict[tuple[int, int], Exit] = {}

    def jump(self, first: int, done: int, drift: int = 0) -> tuple[int, int, int, int | None, bool] | None:
        """(first, done, drift, event_s, reset) after the next event or reset of a window that begins at ``first``; ``done`` is the last feature it has seen. None: the block ends."""
        full, n = first + self.config.max_window, len(self.seqs)
        k = bisect_right(self.lone, first)
        test = max(done + 1, self.lone[k] + 1) if k < len(self.lone) else n
        if test <= min(full, n - 1):
            run = InOrder(self.config)
            run.drift = drift
            for x in range(first, test):
                run.window.add(self.seqs[x], self.points[x])
            for x in range(test, min(full, n - 1) + 1):
                if event := run.add(self.seqs[x], self.points[x]):
                    return x + 1 - len(run.window.points), x, run.drift, event.event_s, False
        return (full + 1, full, 0, None, True) if full < n else None

    def exit(self, size: int) -> Exit:
        """What the block makes of a window of ``size``. What other sizes came to is known and not run again."""
        at, path = (self.past - size, self.past - 1), []
        while at not in self._exits and (to := self.jump(*at)) is not None:
            path.append((at, to[2], to[4]))
            at = to[:2]
        found = self._exits.setdefault(at, Exit(len(self.seqs) - at[0], False, 0))
        for node, drift, reset in reversed(path):
            found = self._exits[node] = found.before(drift, reset)
        return found

    def exits(self) -> list[Exit]:
        """Of each size that the window may have when the block begins."""
        return [self.exit(size) for size in range(min(self.past, self.config.max_window) + 1)]

    def events(self, size: int, drift: int) -> Iterator[tuple[int, int]]:
        """(place in the block, event_s) of each event, from a window of ``size`` and a drift."""
        at = (self.past - size, self.past - 1, drift)
        while (to := self.jump(*at)) is not None:
            if to[3] is not None:
                yield to[1] - self.past, to[3]
            at = to[:3]


def _blocks(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The rows of one block after another; they come sorted, and a block may go on in the next frame."""
    held: list[pd.DataFrame] = []
    for frame in frames:
        cuts = np.flatnonzero(np.diff(frame["stream_id"]) | np.diff(frame["block"])) + 1
        for part in (frame.iloc[a:b] for a, b in zip([0, *cuts], [*cuts, len(frame)], strict=True) if a < b):
            if held and any(held[0][c].iloc[0] != part[c].iloc[0] for c in ("stream_id", "block")):
                yield pd.concat(held, ignore_index=True)
                held = []
            held.append(part)
    if held:
        yield pd.concat(held, ignore_index=True)


def _runs(rows: pd.DataFrame, config: DetectorConfig) -> BlockRuns:
    return BlockRuns(rows["seq"].tolist(), rows["ln_p"].to_numpy(float), rows["ln_q"].to_numpy(float), int(rows["past"].sum()), config)


_TABLE = "stream_id long, block long, size array<int>, fixed array<boolean>, drift array<long>"
_START = "stream_id long, block long, size int, drift long"


def _tables(config: DetectorConfig):
    def run(frames):
        for rows in _blocks(frames):
            exits = _runs(rows, config).exits()
            yield pd.DataFrame({"stream_id": rows["stream_id"][:1], "block": rows["block"][:1], "size": [[x.size for x in exits]], "fixed": [[x.fixed for x in exits]], "drift": [[x.drift for x in exits]]})

    return run


def _starts(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The state at each block's begin; a stream begins with an empty window."""
    stream, size, drift = None, 0, 0
    for frame in frames:
        out = []
        for row in frame.itertuples(index=False):
            if row.stream_id != stream:
                stream, size, drift = row.stream_id, 0, 0
            out.append((stream, row.block, size, drift))
            size, drift = int(row.size[size]), int(row.drift[size]) + (0 if row.fixed[size] else drift)
        yield pd.DataFrame(out, columns=["stream_id", "block", "size", "drift"])


def _answers(config: DetectorConfig):
    def run(frames):
        for rows in _blocks(frames):
            runs = _runs(rows, config)
            out = rows.loc[runs.past :, ["stream_id", "seq", "before"]].reset_index(drop=True)
            d, event_s = np.zeros(len(out), np.int32), np.full(len(out), -1, np.int64)
            for k, s in runs.events(int(rows["size"].iloc[0]), int(rows["drift"].iloc[0])):
                d[k], event_s[k] = 1, s
            yield pd.DataFrame({"stream_id": out["stream_id"], "emit_ord": out["before"] + np.arange(len(out)), "s": out["seq"], "d": d, "event_s": event_s})

    return run


def in_blocks(features: DataFrame, config: DetectorConfig, block: int = BLOCK) -> DataFrame:
    """stream_id, block, before (features before the block), past, seq, ln_p, ln_q: each block with the last features of the one before it."""
    half = block // 2
    rows = features.select("stream_id", "seq", "ln_p", "ln_q", F.floor(F.col("seq") / half).alias("part"))
    counts = rows.groupBy("stream_id", "part").count()
    order = Window.partitionBy("stream_id").orderBy("part")
    # parts of at most half a block of features make blocks of half a block or more
    dealt = counts.withColumn("before", F.sum("count").over(order) - F.col("count")).withColumn("block", F.floor(F.col("before") / block))
    dealt = dealt.withColumns({"before": F.min("before").over(Window.partitionBy("stream_id", "block")), "final": F.max("block").over(Window.partitionBy("stream_id"))}).drop("count")
    own = rows.join(dealt, ["stream_id", "part"]).select("stream_id", "block", "final", "before", F.lit(False).alias("past"), "seq", "ln_p", "ln_q")
    newest = Window.partitionBy("stream_id", "block").orderBy(F.desc("seq"))
    last = own.withColumn("k", F.row_number().over(newest)).where(F.col("k") <= config.max_window).drop("k")
    past = last.where(F.col("block") < F.col("final")).withColumns({"block": F.col("block") + 1, "past": F.lit(True), "before": F.lit(0).cast("long")})
    return own.drop("final").unionByName(past.drop("final"))


def detect_in_blocks(features: DataFrame, config: DetectorConfig, block: int = BLOCK) -> DataFrame:
    """As ``detect_features``, of streams so long that one stream must be dealt out.

    Features have a position (``seq``) that doesn't repeat within a stream; positions may be missing. Null powers are
    noise. No features give no answers. ``block`` is the size of a block in features: more than twice ``max_window``.
    """
    if block < 2 * (config.max_window + 1):
        raise ValueError("a block must hold more than two windows")
    spark = features.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = stored(in_blocks(features, config, block), "blocks")

    def dealt(df: DataFrame) -> DataFrame:
        return df.repartition(n, "stream_id", "block").sortWithinPartitions("stream_id", "block", "seq")

    tables = dealt(rows).mapInPandas(_tables(config), _TABLE)
    starts = stored(tables.repartition(n, "stream_id").sortWithinPartitions("stream_id", "block").mapInPandas(_starts, _START), "starts")
    return dealt(rows.join(starts, ["stream_id", "block"])).mapInPandas(_answers(config), RESULT)
