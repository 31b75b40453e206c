"""Detection over tables of features: a task runs the kernel down its streams, row by row, in constant memory.

Features are a thousandth of the samples. Streams are dealt out over tasks and sorted; a stream's order is sequential by
nature, as what a window holds depends on the events before.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import replace

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ampline.config import DetectorConfig
from ampline.operators.features import clean_features, flushed_slots, last_write_features
from ampline.streaming.kernel import KERNELS, InOrder, clean_point

RESULT = "stream_id long, emit_ord long, s long, d int, event_s long"


def _runner(kind: str, config: DetectorConfig, finish: bool):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        stream, kernel, emitted = None, None, 0
        for frame in frames:
            out = []
            clock = frame["clock"] if "clock" in frame else frame["seq"]
            for row in zip(frame["stream_id"], frame["seq"], frame["ln_p"], frame["ln_q"], frame["is_bad"], clock, strict=True):
                if kernel is None or row[0] != stream:
                    if kernel is not None and finish:
                        out += [(stream, emitted + k, *x) for k, x in enumerate(kernel.finish())]
                    stream, kernel, emitted = row[0], KERNELS[kind](config), 0
                for answer in kernel.feed(int(row[1]), row[2], row[3], bool(row[4]), int(row[5])):
                    out.append((stream, emitted, *answer))
                    emitted += 1
            yield pd.DataFrame(out, columns=["stream_id", "emit_ord", "s", "d", "event_s"])
        if kernel is not None and finish:
            yield pd.DataFrame([(stream, emitted + k, *x) for k, x in enumerate(kernel.finish())], columns=["stream_id", "emit_ord", "s", "d", "event_s"])

    return run


def _detect(features: DataFrame, kind: str, config: DetectorConfig, order: list, finish: bool = False) -> DataFrame:
    n = int(features.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return features.repartition(n, "stream_id").sortWithinPartitions("stream_id", *order).mapInPandas(_runner(kind, config, finish), RESULT)


def _in_order(features: DataFrame) -> DataFrame:
    return features.select("stream_id", "seq", "ln_p", "ln_q", F.lit(False).alias("is_bad"))


def detect_features(features: DataFrame, config: DetectorConfig) -> DataFrame:
    """Answers for features in order (stream_id, seq, ln_p, ln_q)."""
    return _detect(_in_order(features), "clean", config, ["seq"])


def clean_batches(samples: DataFrame, config: DetectorConfig, whole_only: bool = False) -> DataFrame:
    """Features of clean samples; with ``whole_only`` batches that aren't complete yet are left out, as a stream leaves them open."""
    features = clean_features(samples, config)
    return features.where(F.col("n_samples") >= config.samples_per_feature) if whole_only else features


def detect_clean(samples: DataFrame, config: DetectorConfig, whole_only: bool = False) -> DataFrame:
    """stream_id, emit_ord, s, d, event_s of clean samples. With ``whole_only`` the answers are those of ``detect_stream``."""
    return detect_features(clean_batches(samples, config, whole_only), config)


def fill_config(config: DetectorConfig) -> DetectorConfig:
    """The settings of a detector that answers a dirty stream response by response."""
    return replace(config, trim="backward", point_shift=0)


def detect_dirty_fill(samples: DataFrame, config: DetectorConfig) -> DataFrame:
    """As detect_clean of a dirty stream that is answered response by response: late samples are lost, gaps filled."""
    return detect_features(last_write_features(samples, config), fill_config(config))


def detect_dirty_reordered(samples: DataFrame, config: DetectorConfig, finish: bool = False) -> DataFrame:
    """As detect_clean of a dirty stream whose batches wait for their samples and are put in order; first answers are early."""
    slots = flushed_slots(samples, config, at_end=finish)
    rows = slots.select("stream_id", "seq", "ln_p", "ln_q", "is_bad", F.col("flush_at").alias("clock"), F.pmod("seq", F.lit(config.ring_slots)).alias("slot"))
    return _detect(rows, "reordered", config, ["clock", "slot", "seq"], finish)


COUNTERS = "stream_id long, arrivals long, window_total long, events long, resets long"


def detect_counters(samples: DataFrame, config: DetectorConfig) -> DataFrame:
    """Of each clean stream: features, the sum of the window's lengths as they arrive, events, and resets of a full window."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kernels: dict[int, InOrder] = {}
        stream = None
        for frame in frames:
            done = []
            for row in zip(frame["stream_id"], frame["seq"], frame["ln_p"], frame["ln_q"], strict=True):
                if row[0] != stream:
                    done += [(k, *vars(x.counters).values()) for k, x in kernels.items()]
                    stream, kernels = row[0], {row[0]: InOrder(config)}
                if kernels[stream].add(int(row[1]), clean_point(row[2], row[3])) is None:
                    kernels[stream].reset_if_full()
            yield pd.DataFrame(done, columns=names)
        yield pd.DataFrame([(k, *vars(x.counters).values()) for k, x in kernels.items()], columns=names)

    names = [x.split()[0] for x in COUNTERS.split(", ")]
    rows = clean_features(samples, config).select("stream_id", "seq", "ln_p", "ln_q")
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(n, "stream_id").sortWithinPartitions("stream_id", "seq").mapInPandas(run, COUNTERS)
