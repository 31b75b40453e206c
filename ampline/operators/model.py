"""The event model over clustered windows: steady state, noise, another steady state.

A window is bounded, so its clustered points are brought together once as an array; pairs of clusters that don't overlap,
the noise between them, the loss of each pair and the pair of least loss are then expressions over that array.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ampline.config import DetectorConfig
from ampline.functions.scalar import is_local
from ampline.streaming.kernel import Window, clean_point

WINDOW = ("stream_id", "window_id")
PAIR = ("c1", "u1", "v1", "c2", "u2", "v2")


def _paired(clusters: DataFrame, config: DetectorConfig, keys: list[str]) -> DataFrame:
    """keys, the pair's columns, and ``points``: the window's (seq, cluster_id) by seq."""
    gathered = clusters.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("seq", "cluster_id"))).alias("points"))
    found = F.array_distinct(F.expr("transform(filter(points, x -> x.cluster_id > 0), x -> x.cluster_id)"))
    ids = gathered.withColumn("members", F.transform(found, lambda c: F.struct(c.alias("c"), F.transform(F.filter("points", lambda x: x["cluster_id"] == c), lambda x: x["seq"]).alias("at"))))
    spans = ids.withColumn("spans", F.expr("array_sort(transform(members, m -> named_struct('u', array_min(m.at), 'v', array_max(m.at), 'c', m.c, 'cnt', size(m.at))))"))
    good = spans.withColumn("good", F.filter("spans", lambda x: is_local(x["cnt"], x["u"], x["v"], config.min_locality)))
    pairs = F.flatten(F.transform("good", lambda a: F.transform(F.filter("good", lambda b: a["v"] < b["u"]), lambda b: F.struct(a.alias("a"), b.alias("b")))))
    rows = good.withColumn("pair", F.explode(pairs))
    return rows.select(*keys, *[F.col(f"pair.{side}.{name}").cast("long").alias(f"{name}{k}") for k, side in ((1, "a"), (2, "b")) for name in ("c", "u", "v")], "points")


def _with_noise(clusters: DataFrame, config: DetectorConfig, keys: list[str]) -> DataFrame:
    rows = _paired(clusters, config, keys).withColumn("noise", F.expr("transform(filter(points, x -> x.cluster_id = 0 and x.seq > v1 and x.seq < u2), x -> x.seq)"))
    return rows.where(F.size("noise") > 0).withColumns({"first_noise": F.array_min("noise"), "last_noise": F.array_max("noise"), "n_noise": F.size("noise").cast("long")}).drop("noise")


def cluster_pairs(clusters: DataFrame, config: DetectorConfig, *keys: str) -> DataFrame:
    """Pairs of local clusters of which the first ends before the second starts."""
    return _paired(clusters, config, list(keys or WINDOW)).drop("points")


def event_intervals(clusters: DataFrame, config: DetectorConfig, *keys: str) -> DataFrame:
    """Pairs with noise between them: its first and last position, and how much."""
    return _with_noise(clusters, config, list(keys or WINDOW)).drop("points")


def pair_loss(clusters: DataFrame, config: DetectorConfig, *keys: str) -> DataFrame:
    """As event_intervals, with the members of the first cluster after the event's start less one, and of the second before its end less one."""
    lost = F.expr("filter(points, x -> (x.cluster_id = c1 and x.seq > first_noise - 1) or (x.cluster_id = c2 and x.seq < last_noise - 1))")
    return _with_noise(clusters, config, list(keys or WINDOW)).withColumn("loss", F.size(lost).cast("long")).drop("points")


def best_pair(losses: DataFrame, config: DetectorConfig, *keys: str) -> DataFrame:
    """Of each window the pair of least loss, the first of equals, if the loss is within the threshold."""
    keys = list(keys or WINDOW)
    rest = [c for c in losses.columns if c not in keys]
    top = losses.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct("loss", "u1", "u2")).alias("top"))
    return top.select(*keys, "top.*").where(F.col("loss") <= config.loss_thresh)


def backward_suffixes(features: DataFrame, config: DetectorConfig) -> DataFrame:
    """The tightened interval of each window with an event.

    dropped is the number of oldest features that can go one by one while the rest still fits the model; start and
    end are the noise interval of the last that does. One grouped pass, a window at a time, each sorted by position;
    features without a position are in no window.
    """

    def tighten(rows: pd.DataFrame) -> pd.DataFrame:
        rows, window = rows.sort_values("seq"), Window(config)  # a group's rows come in any order
        for seq, p, q in zip(rows["seq"], rows["ln_p"], rows["ln_q"], strict=True):
            window.add(int(seq), clean_point(p, q))
        found = window.interval()
        out = []
        if found:
            dropped, (start, end) = window.suffixes(found)
            out.append((*(int(rows[k].iloc[0]) for k in WINDOW), dropped, start, end))
        return pd.DataFrame(out, columns=[*WINDOW, "dropped", "start", "end"])

    placed = features.select(*WINDOW, "seq", "ln_p", "ln_q").dropna(subset=[*WINDOW, "seq"])
    return placed.groupBy(*WINDOW).applyInPandas(tighten, "stream_id long, window_id long, dropped long, start long, end long")
