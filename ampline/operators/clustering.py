"""Density clustering of windows of features.

Neighbours come from an equi-join on the window with a box test before the distance. A window is bounded, so its
clusters are found by a grouped function; all windows run side by side. With min_pts 2 clusters are the connected
components of the neighbour graph and noise is what has no neighbour.
"""

from __future__ import annotations

from collections import deque

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ampline.config import DetectorConfig
from ampline.functions.scalar import distance, is_local, locality


def windowed(features: DataFrame, size: int = 100) -> DataFrame:
    """Features with a tumbling window of ``size`` batches."""
    return features.withColumn("window_id", F.expr(f"seq div {size}"))


def neighbour_pairs(features: DataFrame, config: DetectorConfig) -> DataFrame:
    """stream_id, window_id, a < b and their distance, within eps (inclusive)."""
    key = ["stream_id", "window_id"]
    left = features.select(*key, F.col("seq").alias("a"), F.col("ln_p").alias("p1"), F.col("ln_q").alias("q1"))
    right = features.select(*key, F.col("seq").alias("b"), F.col("ln_p").alias("p2"), F.col("ln_q").alias("q2"))
    box = (F.abs(F.col("p1") - F.col("p2")) <= config.eps) & (F.abs(F.col("q1") - F.col("q2")) <= config.eps)
    apart = distance(F.col("p1"), F.col("q1"), F.col("p2"), F.col("q2"))
    return left.join(right, key).where((F.col("a") < F.col("b")) & box & (apart <= config.eps)).select(*key, "a", "b", apart.alias("distance"))


def _touched(features: DataFrame, config: DetectorConfig) -> DataFrame:
    """A row for each end of each pair."""
    return neighbour_pairs(features, config).select("stream_id", "window_id", F.explode(F.array("a", "b")).alias("seq"))


def core_points(features: DataFrame, config: DetectorConfig) -> DataFrame:
    """Features with at least min_pts neighbours, itself included."""
    counted = _touched(features, config).groupBy("stream_id", "window_id", "seq").agg((F.count("*") + 1).alias("neighbours"))
    if config.min_pts > 1:
        return counted.where(F.col("neighbours") >= config.min_pts)
    every = features.select("stream_id", "window_id", "seq").join(counted, ["stream_id", "window_id", "seq"], "left")
    return every.withColumn("neighbours", F.coalesce("neighbours", F.lit(1)))


def noise_points(features: DataFrame, config: DetectorConfig) -> DataFrame:
    """Features without a neighbour (min_pts 2)."""
    return features.select("stream_id", "window_id", "seq").join(_touched(features, config), ["stream_id", "window_id", "seq"], "left_anti")


def dbscan_labels(p: np.ndarray, q: np.ndarray, eps: float, min_pts: int) -> np.ndarray:
    """Cluster of each point, from 1 in the order of their first core points; 0 is noise. A border point goes to the first cluster that reaches it."""
    dp, dq = p[:, None] - p[None, :], q[:, None] - q[None, :]
    near = np.sqrt(dp * dp + dq * dq) <= eps  # not for NaN
    np.fill_diagonal(near, True)
    core = near.sum(1) >= min_pts
    label, n = np.zeros(len(p), np.int64), 0
    for seed in np.flatnonzero(core):
        if label[seed]:
            continue
        n += 1
        label[seed] = n
        todo = deque([seed])
        while todo:
            at = todo.popleft()
            fresh = np.flatnonzero(near[at] & (label == 0))
            label[fresh] = n
            todo.extend(fresh[core[fresh]])
    return label


def dbscan(features: DataFrame, config: DetectorConfig, *keys: str) -> DataFrame:
    """keys, seq, cluster_id (0: noise) of each window; a window is what shares the keys."""
    keys = keys or ("stream_id", "window_id")

    def cluster(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("seq")
        label = dbscan_labels(rows["ln_p"].to_numpy(float), rows["ln_q"].to_numpy(float), config.eps, config.min_pts)
        return rows[[*keys, "seq"]].assign(cluster_id=label)

    schema = ", ".join(f"{k} long" for k in (*keys, "seq", "cluster_id"))
    return features.select(*keys, "seq", "ln_p", "ln_q").groupBy(*keys).applyInPandas(cluster, schema)


def cluster_stats(clusters: DataFrame, *keys: str) -> DataFrame:
    """keys, cluster_id, u (first), v (last), cnt, loc (share of the span that belongs to it)."""
    keys = keys or ("stream_id", "window_id")
    stats = clusters.where("cluster_id > 0").groupBy(*keys, "cluster_id").agg(F.min("seq").alias("u"), F.max("seq").alias("v"), F.count("*").alias("cnt"))
    return stats.withColumn("loc", locality(F.col("cnt"), F.col("u"), F.col("v")))


def local_clusters(stats: DataFrame, config: DetectorConfig) -> DataFrame:
    return stats.where(is_local(F.col("cnt"), F.col("u"), F.col("v"), config.min_locality))


def cluster_size_histogram(clusters: DataFrame) -> DataFrame:
    """How often a cluster of this number has this size, over windows."""
    sizes = clusters.groupBy("stream_id", "window_id", "cluster_id").agg(F.count("*").alias("size"))
    return sizes.groupBy("cluster_id", "size").agg(F.count("*").alias("n"))


def cluster_kind_counters(clusters: DataFrame) -> DataFrame:
    """Points that are noise, of the first cluster, and of others, per window."""
    one = lambda x: F.count_if(x)
    c = F.col("cluster_id")
    return clusters.groupBy("stream_id", "window_id").agg(one(c == 0).alias("noise"), one(c == 1).alias("first"), one(c > 1).alias("others"))


def gap_count(features: DataFrame, config: DetectorConfig) -> DataFrame:
    """Steps between consecutive features of a window that are longer than eps."""
    order = Window.partitionBy("stream_id", "window_id").orderBy("seq")
    step = distance(F.col("ln_p"), F.col("ln_q"), F.lag("ln_p").over(order), F.lag("ln_q").over(order))
    return features.withColumn("step", step).groupBy("stream_id", "window_id").agg(F.count_if(F.col("step") > config.eps).alias("gaps"))
