"""Connected components of an edge table by min-label propagation with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ampline.llm.common import Kept, Stored


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, label) for each node of ``edges`` (a, b: long); label is the least node of its component.

    Each round takes the least label among neighbours and then that label's own label, so the number of rounds
    grows with the logarithm of the longest path. Every round is a stored table: lost executors cost no more than one round.
    """
    kept = Kept(edges.select("a", "b").union(edges.select("b", "a")).where("a <> b").distinct())
    both = kept.df
    labels = Stored(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("a")).alias("label")), "labels")
    while True:
        near = both.join(labels.df.select(F.col("node").alias("b"), "label"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("seen"))
        lower = labels.df.join(near, "node").select("node", F.least("label", "seen").alias("label"), F.col("label").alias("old"))
        step = Kept(lower)
        above = step.df.select(F.col("node").alias("label"), F.col("label").alias("top"))
        moved = Stored(step.df.join(above, "label").select("node", F.col("top").alias("label"), (F.col("top") < F.col("old")).alias("changed")), "labels")
        labels.drop()
        step.drop()
        labels = moved
        if moved.df.where("changed").isEmpty():
            kept.drop()
            return moved.df.select("node", "label")
