"""Neighbours and density clusters of windows of any size, by a grid.

Cells are so small (0.7 eps) that all points of one are neighbours, and neighbours are at most two cells apart. So neighbours
meet by an equi-join on cells, and a cell of min_pts points or more holds core points only, without a distance. Clusters are
components of the graph of cells with core points: two cells are linked if the boxes around their core points tell so, or
else if a point of each is near the other. Components come from rounds of least labels with pointer jumping, each round a
stored table. A dense cell is one node however many points it holds, and no window passes through one task.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ampline.config import DetectorConfig
from ampline.functions.scalar import distance
from ampline.operators.stored import stored

SIDE, REACH = 0.7, 2
STEPS = range(-REACH, REACH + 1)
AROUND = [(x, y) for x in STEPS for y in STEPS]
#: One of each two opposite steps, so that every two cells meet once.
HALF = [s for s in AROUND if s > (0, 0)]


def celled(features: DataFrame, config: DetectorConfig, *keys: str) -> DataFrame:
    """keys, seq, p, q and the cell (cx, cy) of features that can have neighbours; those with a null or infinite part are left out."""
    p, q = F.col("ln_p"), F.col("ln_q")
    finite = (F.abs(p) < float("inf")) & (F.abs(q) < float("inf"))
    at = lambda x: F.floor(x / F.lit(SIDE * config.eps))
    return features.where(finite).select(*keys, "seq", p.alias("p"), q.alias("q"), at(p).alias("cx"), at(q).alias("cy"))


def _spread(points: DataFrame, steps: list[tuple[int, int]]) -> DataFrame:
    """A row for each cell at ``steps`` from a row's own."""
    each = F.explode(F.array(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in steps]))
    moved = points.withColumn("step", each)
    return moved.withColumns({"cx": F.col("cx") + F.col("step.x"), "cy": F.col("cy") + F.col("step.y"), "home": (F.col("step.x") == 0) & (F.col("step.y") == 0)}).drop("step")


def grid_pairs(features: DataFrame, config: DetectorConfig, *keys: str) -> DataFrame:
    """keys, a < b and their distance, within eps (inclusive): as neighbour_pairs, for windows of any size (what shares the keys)."""
    keys = list(keys or ("stream_id",))
    points = celled(features, config, *keys)
    left = _spread(points, [(0, 0), *HALF]).withColumnsRenamed({"seq": "s1", "p": "p1", "q": "q1"})
    right = points.withColumnsRenamed({"seq": "s2", "p": "p2", "q": "q2"})
    apart = distance(F.col("p1"), F.col("q1"), F.col("p2"), F.col("q2"))
    met = left.join(right, [*keys, "cx", "cy"]).where((apart <= config.eps) & (~F.col("home") | (F.col("s1") < F.col("s2"))))
    return met.select(*keys, F.least("s1", "s2").alias("a"), F.greatest("s1", "s2").alias("b"), apart.alias("distance"))


def _core(points: DataFrame, config: DetectorConfig, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """(core points, the others): a point of a cell with fewer than min_pts has its neighbours counted."""
    cell = [*keys, "cx", "cy"]
    counted = stored(points.join(points.groupBy(*cell).agg(F.count("*").alias("held")), cell), "celled")
    sparse = counted.where(F.col("held") < config.min_pts).drop("held")
    other = points.select(*cell, F.col("p").alias("p2"), F.col("q").alias("q2"))
    near = _spread(sparse, AROUND).join(other, cell).where(distance(F.col("p"), F.col("q"), F.col("p2"), F.col("q2")) <= config.eps)
    enough = near.groupBy(*keys, "seq").agg(F.count("*").alias("n")).where(F.col("n") >= config.min_pts).select(*keys, "seq")
    core = counted.where(F.col("held") >= config.min_pts).drop("held").unionByName(sparse.join(enough, [*keys, "seq"], "left_semi"))
    return stored(core, "core"), sparse.join(enough, [*keys, "seq"], "left_anti")


BOX = ("p_low", "p_high", "q_low", "q_high")


def _within(low1: Column, high1: Column, low2: Column, high2: Column) -> tuple[Column, Column]:
    """(least, greatest) difference of a value of one range and one of the other."""
    return F.greatest(low2 - high1, low1 - high2, F.lit(0.0)), F.greatest(high2 - low1, high1 - low2)


def _apart(one: list[Column], other: list[Column]) -> tuple[Column, Column]:
    """(least, greatest) distance of points in two boxes, no further off than the distances themselves are rounded."""
    (p_least, p_most), (q_least, q_most) = _within(*one[:2], *other[:2]), _within(*one[2:], *other[2:])
    zero = F.lit(0.0)
    return distance(p_least, q_least, zero, zero), distance(p_most, q_most, zero, zero)


def _linked(core: DataFrame, cells: DataFrame, config: DetectorConfig, keys: list[str]) -> DataFrame:
    """keys, a, b: cells (by node) of which some core points are neighbours."""
    cell, eps, pair = [*keys, "cx", "cy"], config.eps, [*keys, "a", "b"]
    one = _spread(cells.withColumn("x1", F.col("cx")).withColumn("y1", F.col("cy")), HALF).drop("home").withColumnsRenamed({"node": "a", **{x: f"{x}1" for x in BOX}})
    two = cells.withColumnsRenamed({"node": "b", **{x: f"{x}2" for x in BOX}})
    boxes = {k: [F.col(f"{x}{k}") for x in BOX] for k in (1, 2)}
    least, most = _apart(boxes[1], boxes[2])
    met = stored(one.join(two, cell).withColumn("most", most).where(least <= eps), "cell-pairs")
    sure, open_ = met.where(F.col("most") <= eps).select(*pair), met.where(F.col("most") > eps)
    point = [F.col("p"), F.col("p"), F.col("q"), F.col("q")]
    near, far = _apart(point, boxes[2])
    mine = open_.select(*pair, F.col("x1").alias("cx"), F.col("y1").alias("cy"), *boxes[2])
    left = stored(core.join(mine, cell).withColumn("far", far).where(near <= eps).select(*pair, F.col("p").alias("p1"), F.col("q").alias("q1"), "far"), "border-points")
    whole = left.where(F.col("far") <= eps).select(*pair).distinct()
    rest = left.join(whole, pair, "left_anti")
    near, _ = _apart(point, boxes[1])
    right = core.join(open_.select(*pair, "cx", "cy", *boxes[1]), cell).where(near <= eps).select(*pair, F.col("p").alias("p2"), F.col("q").alias("q2"))
    tried = rest.join(right, pair).where(distance(F.col("p1"), F.col("q1"), F.col("p2"), F.col("q2")) <= eps).select(*pair).distinct()
    return reduce(DataFrame.unionByName, [sure, whole, tried])


def components(edges: DataFrame, keys: list[str]) -> DataFrame:
    """keys, node, label: of each node of ``edges`` (keys, a, b) the least node of its component."""
    both = stored(edges.unionByName(edges.select(*keys, F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = stored(both.groupBy(*keys, F.col("a").alias("node")).agg(F.least(F.min("b"), F.min("a")).alias("label")), "labels")
    while True:
        seen = both.join(labels.withColumnRenamed("node", "b"), [*keys, "b"]).groupBy(*keys, F.col("a").alias("node")).agg(F.min("label").alias("seen"))
        lower = stored(labels.join(seen, [*keys, "node"]).select(*keys, "node", F.least("label", "seen").alias("label"), F.col("label").alias("old")), "lower")
        top = lower.select(*keys, F.col("node").alias("label"), F.col("label").alias("top"))
        moved = stored(lower.join(top, [*keys, "label"]).select(*keys, "node", F.col("top").alias("label"), (F.col("top") < F.col("old")).alias("changed")), "labels")
        labels = moved.drop("changed")
        if moved.where("changed").isEmpty():
            return labels


def dbscan_grid(features: DataFrame, config: DetectorConfig, *keys: str) -> DataFrame:
    """keys, seq, first_core of each feature: the first core point of its cluster, null for noise.

    A window is what shares the keys (the stream, if none are given) and may have any size. Clusters are those of
    ``dbscan``, which numbers them by first_core: a border point goes to the cluster that comes first. Features with a
    null part are noise; positions must differ within a window.
    """
    keys = list(keys or ("stream_id",))
    cell = [*keys, "cx", "cy"]
    core, others = _core(celled(features, config, *keys), config, keys)
    box = [F.min("p").alias("p_low"), F.max("p").alias("p_high"), F.min("q").alias("q_low"), F.max("q").alias("q_high")]
    cells = stored(core.groupBy(*cell).agg(F.min("seq").alias("node"), *box), "core-cells")
    labels = components(_linked(core, cells, config, keys), keys)
    # a cell without links is a cluster of its own
    named = stored(cells.select(*cell, "node").join(labels, [*keys, "node"], "left").select(*cell, F.coalesce("label", "node").alias("first_core")), "named-cells")
    inner = core.join(named, cell).select(*keys, "seq", "first_core")
    reach = core.join(named, cell).select(*cell, F.col("p").alias("p2"), F.col("q").alias("q2"), "first_core")
    border = _spread(others, AROUND).join(reach, cell).where(distance(F.col("p"), F.col("q"), F.col("p2"), F.col("q2")) <= config.eps)
    told = inner.unionByName(border.groupBy(*keys, "seq").agg(F.min("first_core").alias("first_core")))
    return features.select(*keys, "seq").join(told, [*keys, "seq"], "left")


def numbered(clusters: DataFrame, *keys: str) -> DataFrame:
    """keys, seq, cluster_id as of ``dbscan``: clusters numbered from 1 by their first core point, 0 for noise."""
    from pyspark.sql import Window

    keys = list(keys or ("stream_id",))
    names = clusters.where("first_core is not null").select(*keys, "first_core").distinct()
    ranked = names.withColumn("cluster_id", F.row_number().over(Window.partitionBy(*keys).orderBy("first_core")).cast("long"))
    return clusters.join(ranked, [*keys, "first_core"], "left").select(*keys, "seq", F.coalesce("cluster_id", F.lit(0).cast("long")).alias("cluster_id"))
