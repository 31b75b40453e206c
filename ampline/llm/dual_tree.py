"""Centroid clustering: Lloyd's rounds by two trees.

Vectors are scaled to integers and gathered into blocks of bounded size as they are read, without a shuffle; each block
gets a cover tree once and is stored with it. In a node of level i of a cover tree all is within 2**i of the node's
vector, its children's vectors are further apart than half of that, and the node's vector is one of them. Every round
builds a tree over the centroids in the same way, and a task descends both trees together, level by level: a pair of
nodes is dropped when its least distance exceeds the largest that the vectors can have to some other centroid. A node with one
centroid left is assigned as a whole; in leaves the centroids that are left are compared exactly. Bounds are floating-point
with slack, comparisons and sums are integers, so pruning never changes a result.

Tasks send the sums of their vectors by cluster and component; the driver holds the centroids alone.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ampline.llm.common import Stored, ragged, stored_alone, table

#: Scaled components are clipped to this, so that a squared distance of 64 of them fits a long.
LARGEST = 1 << 26
#: A bound is slackened by this share, and by this much, so that rounding never prunes a tie.
SHARE, SLACK = 1e-9, 1e-6
BLOCK = "vec_id array<long>, x array<int>, centre array<int>, radius array<double>, begin array<int>, end array<int>, first array<int>, children array<int>"


@dataclass(frozen=True)
class LloydConfig:
    components: int = 64
    scale: int = 1024
    k: int = 8
    rounds: int = 10
    #: Prefix of what is hashed to choose the first centroids.
    seed: str = "3:"
    #: Vectors of a block, and of a leaf.
    block: int = 4096
    leaf: int = 16


def _squares(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Exact squared distances of every row of x to every row of y."""
    most = max(int(np.abs(x).max(initial=0)), int(np.abs(y).max(initial=0)))
    if 4 * most * most * x.shape[1] < 1 << 53:  # then a float holds every sum on the way
        a, b = x.astype(np.float64), y.astype(np.float64)
        return ((a * a).sum(1)[:, None] - 2 * (a @ b.T) + (b * b).sum(1)[None, :]).astype(np.int64)
    a, b = x.astype(np.int64), y.astype(np.int64)
    return np.stack([((a - c) ** 2).sum(1) for c in b], axis=1) if len(b) else np.zeros((len(a), 0), np.int64)


def _paired(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Exact squared distances of row i of x to row i of y."""
    return ((x.astype(np.int64) - y.astype(np.int64)) ** 2).sum(1)


class CoverTree:
    """Nodes by level; node j holds the vectors order[begin[j]:end[j]], ``centre`` is a vector's place in x."""

    def __init__(self, x: np.ndarray, leaf: int):
        self.order = np.arange(len(x))
        self.centre, self.radius, self.begin, self.end, self.first, self.children = [], [], [], [], [], []
        if not len(x):
            return
        self._node(0, _squares(x, x[:1])[:, 0], 0, len(x))
        at = 0
        while at < len(self.centre):
            if self.end[at] - self.begin[at] > leaf and self.radius[at] > 0:
                self._split(x, at)
            at += 1

    def _node(self, centre: int, squares: np.ndarray, begin: int, end: int) -> None:
        for to, value in ((self.centre, centre), (self.radius, float(np.sqrt(squares.max()))), (self.begin, begin), (self.end, end), (self.first, 0), (self.children, 0)):
            to.append(value)

    def _split(self, x: np.ndarray, at: int) -> None:
        """Children within half of the level's reach: the node's own vector first, then the first vector that none of them covers, two at least."""
        begin, end = self.begin[at], self.end[at]
        rest, parts = self.order[begin:end], []
        reach = 2.0 ** (np.ceil(np.log2(self.radius[at])) - 1)
        self.first[at], centre = len(self.centre), self.centre[at]
        while len(rest):
            squares = _squares(x[rest], x[centre : centre + 1])[:, 0]
            near = squares <= reach * reach
            parts.append((centre, rest[near], squares[near]))
            rest = rest[~near]
            centre = int(rest[0]) if len(rest) else -1
        self.children[at] = len(parts)
        for centre, members, squares in parts:
            self.order[begin : begin + len(members)] = members
            self._node(centre, squares, begin, begin + len(members))
            begin += len(members)

    def arrays(self) -> list[np.ndarray]:
        return [np.array(v, np.float64 if k == 1 else np.int32) for k, v in enumerate((self.centre, self.radius, self.begin, self.end, self.first, self.children))]


@dataclass
class Tree:
    """A cover tree whose vectors stand in its own order."""

    x: np.ndarray
    centre: np.ndarray
    radius: np.ndarray
    begin: np.ndarray
    end: np.ndarray
    first: np.ndarray
    children: np.ndarray

    @classmethod
    def over(cls, x: np.ndarray, leaf: int) -> tuple[Tree, np.ndarray]:
        """The tree, and where each of its vectors stands in x."""
        made = CoverTree(x, leaf)
        place = np.empty(len(x), np.int32)
        place[made.order] = np.arange(len(x))
        centre, *rest = made.arrays()
        return cls(x[made.order], place[centre], *rest), made.order


def nearest(tree: Tree, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(the nearest centroid of each of the tree's vectors, the smallest number of equals; its squared distance), by both trees."""
    n = len(tree.x)
    label, distance = np.zeros(n, np.int64), np.zeros(n, np.int64)
    if not n:
        return label, distance
    of, number = Tree.over(centroids, 1)
    node, other = np.zeros(1, np.int64), np.zeros(1, np.int64)
    while len(node):
        # rows are pairs (node of vectors, node of centroids), sorted by the first
        apart = np.sqrt(_paired(tree.x[tree.centre[node]], of.x[of.centre[other]]).astype(np.float64))
        near = np.maximum(apart - tree.radius[node] - of.radius[other], 0)
        far = apart + tree.radius[node]  # no vector of the node is further from the centroid in the pair's centre
        starts = np.flatnonzero(np.diff(node, prepend=-1))
        least = np.repeat(np.minimum.reduceat(far, starts), np.diff(np.append(starts, len(node))))
        good = near <= least * (1 + SHARE) + SLACK
        node, other = node[good], other[good]
        starts = np.flatnonzero(np.diff(node, prepend=-1))
        many = np.diff(np.append(starts, len(node)))
        many = np.repeat(many, many)
        leaf, single = tree.children[node] == 0, of.children[other] == 0
        # one centroid left: all of the node is its
        whole = (many == 1) & single & (of.end[other] - of.begin[other] == 1)
        for a, c in zip(node[whole].tolist(), other[whole].tolist(), strict=True):
            label[tree.begin[a] : tree.end[a]] = number[of.begin[c]]
        # leaves with all centroid nodes open: exactly
        settled = np.repeat(np.logical_and.reduceat(leaf & single, starts), np.diff(np.append(starts, len(node)))) if len(starts) else whole
        _compare(tree, of, number, centroids, node[settled & ~whole], other[settled & ~whole], label)
        rest = ~(whole | settled)
        node, other = _descended(tree, of, node[rest], other[rest])
    distance = _paired(tree.x, centroids[label])
    return label, distance


def _descended(tree: Tree, of: Tree, node: np.ndarray, other: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The pairs one level down in both trees, sorted; what is a leaf stays."""
    for a, at in ((of, 1), (tree, 0)):
        mine = other if at else node
        n = np.maximum(a.children[mine], 1).astype(np.int64)
        down = ragged(np.where(a.children[mine] > 0, a.first[mine], mine).astype(np.int64), n)
        node, other = (np.repeat(node, n), down) if at else (down, np.repeat(other, n))
    order = np.lexsort((other, node))
    return node[order], other[order]


def _compare(tree: Tree, of: Tree, number: np.ndarray, centroids: np.ndarray, node: np.ndarray, other: np.ndarray, label: np.ndarray) -> None:
    """Exact comparison of leaves; leaves with the same centroids left are compared together."""
    if not len(node):
        return
    leaves, at = np.unique(node, return_inverse=True)
    open_ = np.zeros((len(leaves), len(centroids)), bool)
    held = (of.end[other] - of.begin[other]).astype(np.int64)
    open_[np.repeat(at, held), number[ragged(of.begin[other].astype(np.int64), held)]] = True
    kinds, kind = np.unique(open_, axis=0, return_inverse=True)
    for k, which in enumerate(kinds):
        mine = leaves[kind.ravel() == k]
        rows = ragged(tree.begin[mine].astype(np.int64), (tree.end[mine] - tree.begin[mine]).astype(np.int64))
        candidates = np.flatnonzero(which)  # ascending, so the first of equals has the smallest number
        label[rows] = candidates[_squares(tree.x[rows], centroids[candidates]).argmin(1)]


def _blocks(config: LloydConfig) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, config.block):
                part = batch.slice(start, config.block)
                x = part.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, config.components)
                made = CoverTree(x, config.leaf)
                place = np.empty(len(x), np.int32)
                place[made.order] = np.arange(len(x))
                centre, *nodes = made.arrays()
                columns = [part.column("vec_id").take(pa.array(made.order)), x[made.order].ravel(), place[centre], *nodes]
                lists = [pa.array([c.to_pylist() if isinstance(c, pa.Array) else c], pa.list_(t)) for c, t in zip(columns, _TYPES, strict=True)]
                yield pa.record_batch(lists, names=_NAMES)

    return run


_NAMES = [x.split()[0] for x in BLOCK.split(", ")]
_TYPES = [{"long": pa.int64(), "int": pa.int32(), "double": pa.float64()}[x.split("<")[1][:-1]] for x in BLOCK.split(", ")]


def _read(batches: Iterator[pa.RecordBatch], config: LloydConfig) -> Iterator[tuple[pa.Array, Tree]]:
    for batch in batches:
        for r in range(batch.num_rows):
            columns = {c: batch.column(c)[r].values for c in _NAMES}
            arrays = [columns[c].to_numpy(zero_copy_only=False) for c in _NAMES[1:]]
            yield columns["vec_id"], Tree(arrays[0].reshape(-1, config.components), *arrays[1:])


def _sums(centroids: np.ndarray, config: LloydConfig) -> Callable:
    """cluster, at, total: sums of a task's vectors by component; at -1 is their number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(centroids), config.components + 1), np.int64)
        for _, tree in _read(batches, config):
            label, _ = nearest(tree, centroids)
            order = np.argsort(label, kind="stable")
            some, first = np.unique(label[order], return_index=True)
            total[some, 1:] += np.add.reduceat(tree.x[order].astype(np.int64), first, axis=0)
            total[some, 0] += np.bincount(label, minlength=len(centroids))[some]
        cluster, at = np.nonzero(total)
        yield pa.record_batch([pa.array(cluster.astype(np.int32)), pa.array(at.astype(np.int32) - 1), pa.array(total[cluster, at])], names=["cluster", "at", "total"])

    return run


def _labels(centroids: np.ndarray, config: LloydConfig) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, tree in _read(batches, config):
            label, distance = nearest(tree, centroids)
            yield pa.record_batch([ids, pa.array(label.astype(np.int32)), pa.array(distance)], names=["vec_id", "cluster", "distance"])

    return run


def scaled(vectors: DataFrame, config: LloydConfig = LloydConfig()) -> DataFrame:
    """vec_id and x, integers, of the vectors that have the right number of components, none null, infinite or not a number."""
    e = F.col("embedding")
    fine = (F.size(e) == config.components) & F.forall(e, lambda v: F.coalesce(F.abs(v) < float("inf"), F.lit(False)) & ~F.isnan(v))
    most = F.lit(float(LARGEST))
    x = F.transform(e, lambda v: F.greatest(F.least(F.floor(F.greatest(F.least(v.cast("double") * config.scale, most), -most)), F.lit(LARGEST)), F.lit(-LARGEST)).cast("int"))
    return vectors.where(fine).select(F.col("vec_id").cast("long").alias("vec_id"), x.alias("x"))


def first_centroids(kept: DataFrame, config: LloydConfig) -> np.ndarray:
    """The vectors whose ids have the smallest hashes; of rows of one id those with the smallest components."""
    key = F.sha2(F.concat(F.lit(config.seed), F.col("vec_id").cast("string")), 256)
    rows = kept.where("vec_id is not null").select(key.alias("key"), "x").orderBy("key", "x").limit(config.k).collect()
    return np.array([r.x for r in rows], np.int64).reshape(-1, config.components)


def moved(blocks: DataFrame, centroids: np.ndarray, config: LloydConfig) -> np.ndarray:
    """The centroids after one round."""
    parts = blocks.mapInArrow(_sums(centroids, config), "cluster int, at int, total long").groupBy("cluster", "at").agg(F.sum("total").alias("total"))
    total = np.zeros((len(centroids), config.components + 1), np.int64)
    for r in parts.collect():  # a number for each cluster and component
        total[r.cluster, r.at + 1] = r.total
    n = total[:, :1]
    return np.where(n > 0, total[:, 1:] // np.maximum(n, 1), centroids)


def cluster(vectors: DataFrame, config: LloydConfig = LloydConfig()) -> tuple[DataFrame, np.ndarray]:
    """(vec_id, cluster and squared distance of each vector kept, a row each; the centroids).

    Left out are null vectors and those with another number of components or with one that is null, infinite or not a
    number. Scaled components are clipped to 2**26. Rows that repeat an id or a vector are vectors each; a null id is
    no first centroid. With fewer vectors than k there are as many clusters; without any, no rows. Further columns are
    ignored.
    """
    kept = scaled(vectors, config)
    centroids = first_centroids(kept, config)
    if not len(centroids):
        return vectors.sparkSession.createDataFrame([], "vec_id long, cluster int, distance long"), centroids
    blocks = Stored(kept.mapInArrow(_blocks(config), BLOCK), "vector-blocks").df
    for _ in range(config.rounds):
        after = moved(blocks, centroids, config)
        if (after == centroids).all():
            break  # all later rounds are the same
        centroids = after
    return blocks.mapInArrow(_labels(centroids, config), "vec_id long, cluster int, distance long"), centroids


def described(vectors: DataFrame, config: LloydConfig = LloydConfig()) -> DataFrame:
    """As ``cluster``, with the sum of distances of each cluster and of all, and the digest of each cluster's centroid."""
    labels, centroids = cluster(vectors, config)
    labels = Stored(labels, "vector-labels").df
    spark = vectors.sparkSession
    sums = {r.cluster: r.total for r in labels.groupBy("cluster").agg(F.sum("distance").alias("total")).collect()}
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    facts = [(k, sums.get(k, 0), sum(sums.values()), digest) for k, digest in enumerate(digests)]
    told = spark.createDataFrame(facts, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return labels.join(F.broadcast(told), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")  # k rows


def op11_centroid_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stored_alone(lambda: described(table(spark, sf_dir, "embeddings")), "clusters").df


def _oracle(config: LloydConfig = LloydConfig()) -> str:
    """Every round written out: distances by exact sums, and the floor of the mean."""
    near = "SELECT vec_id, nth, x, arg_min(struct_pack(cluster := c, distance := d, y := y), (d, c)) AS best FROM (SELECT v.vec_id, v.nth, v.x, k.c, k.y, list_sum(list_transform(list_zip(v.x, k.y), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT AS d FROM v, {k} k) GROUP BY ALL"
    parts = [
        f"""WITH v AS MATERIALIZED (
  SELECT vec_id, row_number() OVER () AS nth, list_transform(embedding, lambda e: floor({config.scale} * e::DOUBLE)::BIGINT) AS x
  FROM embeddings WHERE len(embedding) = {config.components} AND len(list_filter(embedding, lambda e: e IS NOT NULL AND isfinite(e))) = {config.components}),
k0 AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY sha256('{config.seed}' || vec_id)) - 1 AS c, x AS y FROM v
  QUALIFY row_number() OVER (ORDER BY sha256('{config.seed}' || vec_id)) <= {config.k})"""
    ]
    for i in range(config.rounds):
        parts.append(
            f"""n{i} AS MATERIALIZED ({near.format(k=f"k{i}")}),
k{i + 1} AS MATERIALIZED (
  SELECT k.c, coalesce(m.y, k.y) AS y FROM k{i} k LEFT JOIN (
    SELECT c, list(y ORDER BY i) AS y FROM (
      SELECT best.cluster AS c, i, ((sum(x[i]) - ((sum(x[i]) % count(*)) + count(*)) % count(*)) // count(*))::BIGINT AS y
      FROM n{i}, (SELECT unnest(range(1, {config.components + 1})) AS i) GROUP BY 1, 2) GROUP BY c) m ON m.c = k.c)"""
        )
    last = f"k{config.rounds}"
    return ",\n".join(parts) + (
        f""",
z AS MATERIALIZED (SELECT vec_id, best.cluster AS cluster, best.distance AS distance, best.y AS y FROM ({near.format(k=last)}))
SELECT vec_id, cluster::INT AS cluster, distance, (sum(distance) OVER (PARTITION BY cluster))::BIGINT AS cluster_inertia,
  (sum(distance) OVER ())::BIGINT AS inertia, sha256(array_to_string(y, ',')) AS centroid_sha256
FROM z"""
    )


ORACLE = _oracle()
