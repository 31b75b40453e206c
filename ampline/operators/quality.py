"""Quality of a dirty stream: counters and lateness, by one pass of conditional aggregates.

Lateness is a small number of batches, so order statistics come from its histogram instead of a collected list.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ampline.config import DetectorConfig
from ampline.functions.scalar import batch_id, offset_in_batch


def late_samples(samples: DataFrame, config: DetectorConfig) -> DataFrame:
    """Samples of an earlier batch than the response that brings them, with their lag in batches."""
    size = config.samples_per_feature
    late = samples.where(offset_in_batch("i", "arrival", size) < 0)
    return late.withColumn("lag", F.col("arrival") - batch_id("i", size))


def quality_counters(samples: DataFrame, config: DetectorConfig) -> DataFrame:
    """stream_id, total, normal, duplicates, delayed, missing.

    A sample is a duplicate if its place holds a voltage other than the filler already; missing is what all responses
    could hold less the others.
    """
    size = config.samples_per_feature
    off = offset_in_batch("i", "arrival", size)
    kind = F.when(off < 0, "late").when(off >= size, "early").otherwise("placed")
    kinds = samples.select("stream_id", "arrival", "pos", "voltage", kind.alias("kind"), F.when(off.between(0, size - 1), F.col("i")).alias("place"))
    # each sample of a place but the last is what another one meets there
    known = lambda v: F.coalesce(v != config.filler, F.lit(False)).cast("long")
    places = kinds.groupBy("stream_id", "arrival", "kind", "place").agg(F.count("*").alias("n"), (F.sum(known(F.col("voltage"))) - known(F.max_by("voltage", "pos"))).alias("again"))
    n = lambda kind: F.sum(F.when(F.col("kind") == kind, F.col("n")).otherwise(0))
    again = F.sum(F.when(F.col("kind") == "placed", F.col("again")).otherwise(0))
    by_response = places.groupBy("stream_id", "arrival").agg(F.sum("n").alias("total"), (n("placed") - again).alias("normal"), again.alias("duplicates"), n("late").alias("delayed"))
    counted = by_response.groupBy("stream_id").agg(*[F.sum(c).alias(c) for c in ("total", "normal", "duplicates", "delayed")], F.count("*").alias("responses"))
    missing = F.col("responses") * size - F.col("duplicates") - F.col("delayed") - F.col("normal")
    return counted.withColumn("missing", missing).drop("responses")


def lateness_histogram(samples: DataFrame, config: DetectorConfig) -> DataFrame:
    return late_samples(samples, config).groupBy("stream_id", "lag").agg(F.count("*").alias("n"))


def lateness_mean(samples: DataFrame, config: DetectorConfig) -> DataFrame:
    return late_samples(samples, config).groupBy("stream_id").agg(F.expr("sum(lag) div count(*)").alias("mean_lag"))


def lateness_quartiles(samples: DataFrame, config: DetectorConfig) -> DataFrame:
    """The elements at 0, n/4, n/2, 3n/4 and n - 1 of the sorted lags."""
    bins = lateness_histogram(samples, config)
    up = Window.partitionBy("stream_id").orderBy("lag").rowsBetween(Window.unboundedPreceding, 0)
    cumulated = bins.withColumn("through", F.sum("n").over(up)).withColumn("total", F.sum("n").over(Window.partitionBy("stream_id")))
    places = {"q0": "0", "q1": "total div 4", "q2": "total div 2", "q3": "3 * total div 4", "q4": "total - 1"}
    return cumulated.groupBy("stream_id").agg(*[F.min(F.when(F.col("through") > F.expr(at), F.col("lag"))).alias(name) for name, at in places.items()])
