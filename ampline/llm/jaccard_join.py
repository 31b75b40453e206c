"""N-gram Jaccard join with a token-group matrix; exact.

Documents with the same shingle set form a class, and only classes are joined.

1. One pass over the texts gives each row's set size and class, and a count sketch of shingles. The sketch is of fixed
   size and only sets the order of shingles (rare first); any order gives right results.
2. A set of n may miss ``d = n - ceil(t * n)`` shingles of one that it links with. So two sets that link share at
   least ``s`` of the first ``d + s`` shingles of each; s is the half of d, and one. These prefixes are the rows
   (shingle, class) of the matrix. Shingles of one class alone fall away.
3. Similar classes are partitioned into groups: each class goes to the leader that it shares most prefix shingles with.
   A group (in blocks of bounded size) keeps the union of its members' shingles. A class opens a cluster of the
   group only if the union holds enough of its shingles to reach the threshold with any member, and is then compared
   with members until one links. A matrix of shingles by clusters bounds the overlaps with many clusters at once.
4. What links so far is labelled with its component. In the second round the matrix says which classes share enough
   prefix shingles with a group other than their own; these queries are held against the group's union, and qualifying
   groups are opened. A class with the label of a group's leader needn't ask that group if the group's leader and its
   own have one label: what links them is known, and the group's members with other labels ask in turn. Members of a
   group of several blocks that aren't linked with its leader ask their own group. So each pair that can link is
   met, or is in one component already, and a hot shingle meets groups, not pairs of classes.

Work and rows follow the number of classes and groups, not of pairs: copies are one class, and a large family of near
copies is one group whose members stop at their first link. A group of any size is dealt out in blocks.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ampline.llm.common import Kept, Stored, n_shuffle, ragged, release, slices, stored_alone, table, words_of
from ampline.llm.components import connected_components

#: The sketch: 2 ** SKETCH_BITS counters, merged in slabs of SLAB.
SKETCH_BITS, SLAB = 20, 1 << 16
#: The binary logarithm of the classes of a shingle beyond which its rows are dealt out in parts of about as many.
HOT = 12
#: Members of a group, and queries to it, that one task holds at once.
BLOCK, ASKS = 256, 1024
#: Clusters of a block that are held against a set one by one, and entries of a matrix that serves for the others.
LOOSE, ENTRIES = 16, 2_000_000
#: Ids up to which the list of rows to fetch is broadcast; a longer list is joined by shuffle.
BROADCAST_IDS = 1_000_000

_P = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9))


@dataclass(frozen=True)
class JaccardConfig:
    words: int = 3
    #: Sets link when den * intersection >= num * union.
    num: int = 90
    den: int = 100

    def least(self, n: np.ndarray | int):
        """The least overlap with which a set of n can link."""
        return -(-n * self.num // self.den)

    def links(self, common: int, a: int, b: int) -> bool:
        return self.den * common >= self.num * (a + b - common)

    def shared(self, n: int) -> int:
        """Shingles that the prefixes of two sets that link share at least, if neither set has fewer than n shingles."""
        return 1 + (n - self.least(n)) // 2

    def prefix(self, n: int) -> int:
        """Length of the prefix of a set of n; 0 if it can't link with a different set."""
        return n - self.least(n) + self.shared(n) if self.links(n, n, n + 1) or self.least(n) < n else 0

    def needed(self, n: str) -> F.Column:
        """The column of shared(least(n)): what the prefix of a set of n shares with that of any set that links with it."""
        least = lambda x: f"(({x}) * {self.num} + {self.den - 1}) div {self.den}"
        return F.expr(f"1 + ({least(n)} - {least(least(n))}) div 2")


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * _P[1]
    h = (h ^ (h >> np.uint64(29))) * _P[2]
    return h ^ (h >> np.uint64(32))


def shingle_sets(text: pa.Array, k: int, seed: int) -> Iterator[np.ndarray]:
    """The sorted distinct 64-bit shingles of each text; words are lower-cased in A-Z."""
    offsets, codes, vocab = words_of(pc.ascii_lower(text))
    word = np.fromiter((xxhash.xxh64_intdigest(w, seed) for w in vocab), np.uint64, len(vocab))[codes] if vocab else np.zeros(0, np.uint64)
    rolled = np.full(max(0, len(word) - k + 1), k, np.uint64)
    for i in range(k):
        rolled = _mixed(rolled * _P[0] + word[i : i + len(rolled)])
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
        if b - a >= k:
            yield np.unique(rolled[a : b - k + 1])
        elif b > a:
            whole = np.full(1, b - a, np.uint64)
            for i in range(a, b):
                whole = _mixed(whole * _P[0] + word[i])
            yield whole
        else:
            yield np.zeros(0, np.uint64)


def _class_of(shingles: np.ndarray, seed: int) -> tuple[int, int]:
    """Two independent 64-bit names of a set."""
    h = xxhash.xxh3_128_intdigest(shingles.tobytes(), seed)
    return (h >> 64) - (1 << 63), (h & (2**64 - 1)) - (1 << 63)


_PROFILE = "doc_id long, n long, c long, check long, slab long, counts binary"


def _profile(config: JaccardConfig, seed: int) -> Callable:
    schema = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("c", pa.int64()), ("check", pa.int64()), ("slab", pa.int64()), ("counts", pa.binary())])

    def run(batches):
        sketch, seen = np.zeros(1 << SKETCH_BITS, np.uint32), set()
        for batch in slices(batches, "text"):
            n, c, check, new = [], [], [], []
            for s in shingle_sets(batch.column("text"), config.words, seed):
                names = _class_of(s, seed) if len(s) else (None, None)
                n.append(len(s))
                c.append(names[0])
                check.append(names[1])
                if config.prefix(len(s)) and names[0] not in seen:
                    seen.add(names[0])
                    new.append(s)
            if new:
                sketch += np.bincount((np.concatenate(new) >> np.uint64(64 - SKETCH_BITS)).astype(np.int64), minlength=len(sketch)).astype(np.uint32)
            nulls = [None] * len(n)
            yield pa.record_batch([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(c, pa.int64()), pa.array(check, pa.int64()), pa.array(nulls, pa.int64()), pa.array(nulls, pa.binary())], schema=schema)
        for k in range(0, len(sketch), SLAB):
            if sketch[k : k + SLAB].any():
                yield pa.record_batch([*([pa.nulls(1, pa.int64())] * 4), pa.array([k // SLAB], pa.int64()), pa.array([zlib.compress(sketch[k : k + SLAB].astype("<u8").tobytes(), 1)], pa.binary())], schema=schema)

    return run


def _added(part: pd.DataFrame) -> pd.DataFrame:
    total = np.zeros(SLAB, "<u8")
    for x in part["counts"]:
        total += np.frombuffer(zlib.decompress(x), "<u8")
    return pd.DataFrame({"slab": part["slab"].iloc[:1], "counts": [zlib.compress(total.tobytes(), 1)]})


def _levels(profiles: DataFrame) -> np.ndarray:
    """The binary logarithm of each counter, 0 for a count of one: 2 ** SKETCH_BITS bytes, summed over all tasks in two levels."""
    slabs = profiles.where("slab is not null").select("slab", "counts")
    few = slabs.groupBy("slab", F.pmod(F.xxhash64("counts"), F.lit(64)).alias("part")).applyInPandas(_added, "slab long, counts binary")
    out = np.zeros(1 << SKETCH_BITS, np.uint64)
    for x in few.groupBy("slab").applyInPandas(_added, "slab long, counts binary").collect():
        out[x.slab * SLAB : (x.slab + 1) * SLAB] = np.frombuffer(zlib.decompress(x.counts), "<u8")
    return np.log2(np.maximum(out, 1).astype(float)).astype(np.uint8)


def _prefixes(config: JaccardConfig, seed: int, levels, hot: int) -> Callable:
    schema = pa.schema([("token", pa.int64()), ("parts", pa.int64()), ("c", pa.int64()), ("n", pa.int64())])

    def run(batches):
        seen: set[int] = set()
        for batch in slices(batches, "text"):
            tokens, parts, c, n = [], [], [], []
            for s in shingle_sets(batch.column("text"), config.words, seed):
                p = config.prefix(len(s))
                if not p or (name := _class_of(s, seed)[0]) in seen:
                    continue
                seen.add(name)
                level = levels.value[(s >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)]
                # in the order of (level, shingle); those of level 0 may be in no other set
                first = np.argsort(level, kind="stable")[:p]
                first = first[level[first] > 0] if not level.all() else first
                tokens.append(s[first])
                parts.append(np.int64(1) << np.maximum(level[first].astype(np.int64) - hot, 0))
                c.append(name)
                n.append(len(s))
            if tokens:
                each = list(map(len, tokens))
                yield pa.record_batch([pa.array(np.concatenate(tokens).view(np.int64)), pa.array(np.concatenate(parts)), pa.array(np.repeat(np.array(c, np.int64), each)), pa.array(np.repeat(np.array(n, np.int64), each))], schema=schema)

    return run


def _fetch(config: JaccardConfig, seed: int) -> Callable:
    schema = pa.schema([("c", pa.int64()), ("shingles", pa.binary())])

    def run(batches):
        for batch in slices(batches, "text"):
            sets = list(shingle_sets(batch.column("text"), config.words, seed))
            yield pa.record_batch([pa.array([_class_of(s, seed)[0] for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())], schema=schema)

    return run


class Cluster:
    """A group of similar sets, and the union of their shingles."""

    def __init__(self, name: int, shingles: np.ndarray):
        self.names, self.sets, self.union, self.least = [name], [shingles], shingles, len(shingles)

    def first_link(self, shingles: np.ndarray, config: JaccardConfig) -> int | None:
        for name, other in zip(self.names, self.sets, strict=True):
            small, large = sorted((len(shingles), len(other)))
            if config.den * small >= config.num * large and config.links(_common(shingles, other), small, large):
                return name
        return None

    def add(self, name: int, shingles: np.ndarray) -> None:
        self._take([name], [shingles], shingles)

    def join(self, other: Cluster) -> None:
        self._take(other.names, other.sets, other.union)

    def _take(self, names: list[int], sets: list[np.ndarray], union: np.ndarray) -> None:
        self.names += names
        self.sets += sets
        self.union, self.least = np.union1d(self.union, union), min(self.least, *map(len, sets))


class Matrix:
    """Shingles by clusters: how many shingles of a set each cluster's union holds, of all clusters at once.

    A shingle that most clusters hold has the list of those that don't, so what a family of texts has in common costs
    nothing for each of its clusters.
    """

    def __init__(self, clusters: list[Cluster]):
        self.clusters = clusters
        self.least = np.array([x.least for x in clusters])
        tokens = np.concatenate([x.union for x in clusters])
        owner = np.repeat(np.arange(len(clusters), dtype=np.int32), [len(x.union) for x in clusters])
        order = np.argsort(tokens, kind="stable")
        tokens, owner = tokens[order], owner[order]
        del order
        first = np.flatnonzero(np.concatenate(([True], tokens[1:] != tokens[:-1])))
        self.tokens, count = tokens[first], np.diff(first, append=len(tokens))
        self.most = 2 * count > len(clusters)
        lacks = np.ones((int(self.most.sum()), len(clusters)), bool)  # no more than twice the entries
        row = np.repeat(np.cumsum(self.most) - 1, count)
        of_most = np.repeat(self.most, count)
        lacks[row[of_most], owner[of_most]] = False
        self.count = np.where(self.most, len(clusters) - count, count)
        self.start = np.cumsum(self.count) - self.count
        self.listed = np.empty(int(self.count.sum()), np.int32)
        self.listed[ragged(self.start[self.most], self.count[self.most])] = np.nonzero(lacks)[1]
        self.listed[ragged(self.start[~self.most], self.count[~self.most])] = owner[~of_most]

    def overlaps(self, shingles: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.tokens, shingles)
        at[at == len(self.tokens)] = 0
        at = at[self.tokens[at] == shingles]
        most = self.most[at]
        here, gone = (np.bincount(self.listed[ragged(self.start[x], self.count[x])], minlength=len(self.clusters)) for x in (at[~most], at[most]))
        return int(most.sum()) + here - gone


class Clusters:
    """The clusters of a block. Those that are new or have grown stay out of the matrix until there are LOOSE of them."""

    def __init__(self, config: JaccardConfig):
        self.config, self.all, self.loose, self.matrices = config, {}, {}, []

    def changed(self, cluster: Cluster) -> None:
        self.all[id(cluster)] = self.loose[id(cluster)] = cluster
        if len(self.loose) > LOOSE:
            self.gather()

    def joined(self, cluster: Cluster, other: Cluster) -> None:
        del self.all[id(other)]
        self.loose.pop(id(other), None)
        cluster.join(other)

    def gather(self) -> None:
        """All clusters in matrices of about ENTRIES entries."""
        self.matrices, self.loose, part, size = [], {}, [], 0
        for x in self.all.values():
            if part and size + len(x.union) > ENTRIES:
                self.matrices.append(Matrix(part))
                part, size = [], 0
            part.append(x)
            size += len(x.union)
        if part:
            self.matrices.append(Matrix(part))

    def _may_link(self, common, n: int, least):
        """Whether a set of n may link with a set of at least ``least`` that holds at most ``common`` of it; for one set, whether it does."""
        return self.config.den * common >= self.config.num * (n + least - common)

    def qualifying(self, shingles: np.ndarray) -> list[Cluster]:
        """Clusters whose union holds enough of the set for a link with any member."""
        n, out = len(shingles), [x for x in self.loose.values() if self._may_link(_common(shingles, x.union), len(shingles), x.least)]
        for m in self.matrices:
            at = np.flatnonzero(self._may_link(m.overlaps(shingles), n, m.least)).tolist()
            # what has changed since, or is part of another cluster, is not asked here
            out += [x for x in (m.clusters[k] for k in at) if id(x) in self.all and id(x) not in self.loose]
        return out


def _common(a: np.ndarray, b: np.ndarray) -> int:
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    return int((b[at] == a).sum()) if len(b) else 0


def _block_edges(names: list[int], sets: list[np.ndarray], asks: list[bool], config: JaccardConfig) -> Iterator[tuple[int, int]]:
    """Links that join what links in this block: among members, and of each query to each cluster of members."""
    clusters = Clusters(config)
    for asked in (False, True):
        if asked and len(clusters.all) > LOOSE:
            clusters.gather()
        for name, s, ask in zip(names, sets, asks, strict=True):
            if ask != asked:
                continue
            home = None
            for cluster in clusters.qualifying(s):
                if (other := cluster.first_link(s, config)) is None:
                    continue
                yield name, other
                if asked:
                    continue
                if home is None:
                    home = cluster
                    home.add(name, s)
                else:  # the set joins two clusters
                    clusters.joined(home, cluster)
            if not asked:
                clusters.changed(home or Cluster(name, s))


def _edges(config: JaccardConfig) -> Callable:
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def of(rows: pa.Table) -> pa.RecordBatch:
        found = list(_block_edges(rows["c"].to_pylist(), [np.frombuffer(x, np.uint64) for x in rows["shingles"].to_pylist()], rows["asks"].to_pylist(), config))
        return pa.record_batch([pa.array([x[0] for x in found], pa.int64()), pa.array([x[1] for x in found], pa.int64())], schema=schema)

    def run(batches):
        held: list[pa.RecordBatch] = []  # the block that may go on in the next batch
        key = None
        for batch in batches:
            at = np.stack([batch.column("g").to_numpy(), batch.column("block").to_numpy()])
            cuts = [0, *(np.flatnonzero((at[:, 1:] != at[:, :-1]).any(0)) + 1).tolist(), batch.num_rows]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if a == b:
                    continue
                if held and key != tuple(at[:, a]):
                    yield of(pa.Table.from_batches(held))
                    held = []
                key = tuple(at[:, a])
                held.append(batch.slice(a, b - a))
        if held:
            yield of(pa.Table.from_batches(held))
        held = []
        release()

    return run


def _verified(members: DataFrame, queries: DataFrame, shingles: DataFrame, config: JaccardConfig) -> DataFrame:
    """Links within groups. members: (g, c), each a set of the group; queries: (g, c), sets held against group g.

    A group is dealt out in blocks of about BLOCK members, and its queries go to each of its blocks, about ASKS at once.
    """
    spark = shingles.sparkSession
    blocks = members.groupBy("g").agg(F.expr(f"(count(*) + {BLOCK} - 1) div {BLOCK}").alias("blocks"))
    parts = queries.groupBy("g").agg(F.expr(f"(count(*) + {ASKS} - 1) div {ASKS}").alias("parts"))
    sized = blocks.join(parts, "g", "left").select("g", "blocks", F.coalesce("parts", F.lit(1)).alias("parts"))
    # the key of a task's work: a block of members and a part of the queries
    each = lambda x: F.explode(F.expr(f"sequence(0L, {x} - 1)"))
    placed = members.join(sized, "g").withColumn("part", each("parts")).select("g", F.expr("pmod(xxhash64(c), blocks) * parts + part").alias("block"), "c", F.lit(False).alias("asks"))
    sent = queries.join(sized, "g").withColumn("at", each("blocks")).select("g", F.expr("at * parts + pmod(xxhash64(c), parts)").alias("block"), "c", F.lit(True).alias("asks"))
    rows = placed.unionByName(sent).join(shingles, "c").select("g", "block", "c", "asks", "shingles")
    dealt = rows.repartition(n_shuffle(spark), "g", "block").sortWithinPartitions("g", "block", "asks", "c")
    return dealt.mapInArrow(_edges(config), "a long, b long")


def _shingles_of(wanted: DataFrame, classes: DataFrame, texts: DataFrame, config: JaccardConfig, seed: int) -> Stored:
    """The sets of the classes ``wanted`` (c), from one text of each."""
    kept = Kept(wanted.join(classes, "c").select(F.col("first_id").alias("id")))
    ids, few = kept.df, kept.df.count() <= BROADCAST_IDS
    rows = texts.join(F.broadcast(ids) if few else ids, F.col("doc_id") == F.col("id"), "left_semi")
    sets = rows.select("text").mapInArrow(_fetch(config, seed), "c long, shingles binary")
    # a repeated doc_id may bring another text along
    out = Stored(sets.join(wanted, "c", "left_semi").dropDuplicates(["c"]), "shingles")
    kept.drop()
    return out


def _profiles(texts: DataFrame, config: JaccardConfig) -> tuple[DataFrame, DataFrame, int]:
    """(profiles of all rows and of the sketch, classes, the seed)"""
    for seed in range(64):
        rows = Stored(texts.mapInArrow(_profile(config, seed), _PROFILE), "profiles")
        named = rows.df.where("c is not null and doc_id is not null")
        classes = Stored(named.groupBy("c").agg(F.min("doc_id").alias("first_id"), (F.min("check") != F.max("check")).alias("mixed")), "classes")
        if classes.df.where("mixed").isEmpty():
            return rows.df, classes.df.select("c", "first_id"), seed
        rows.drop()
        classes.drop()
    raise RuntimeError("no seed keeps the names of different sets apart")


def _hot(rows: DataFrame, low: str, high: str, where: str) -> DataFrame:
    """The rows that are dealt out in parts, with low and high of all parts of their shingle; there are few such shingles."""
    hot = rows.where("part is not null")
    ends = hot.groupBy("token").agg(F.min(low).alias(low), F.max(high).alias(high)).where(where)
    return hot.drop(low, high).join(ends, "token")


def _links(texts: DataFrame, classes: DataFrame, levels, config: JaccardConfig, seed: int) -> DataFrame:
    """(a, b): links of classes, enough of them to join what all links join."""
    spark = texts.sparkSession
    rare = texts.where("doc_id is not null").select("text").mapInArrow(_prefixes(config, seed, levels, HOT), "token long, parts long, c long, n long")
    # the sketch counts no shingle too low, so a part holds few rows; its ends are joined to the shingle's
    dealt = rare.select("token", "c", "n", F.when(F.col("parts") > 1, F.expr("pmod(xxhash64(c), parts)")).alias("part"))
    whole = Window.partitionBy("token", "part")
    # a class comes once from each task at most, so one shuffle serves both the distinct rows and the leaders
    distinct = dealt.repartition(n_shuffle(spark), "token", "part").dropDuplicates(["token", "part", "c", "n"])
    led = distinct.withColumn("leader", F.min(F.struct("c", "n")).over(whole)).withColumn("last", F.max("c").over(whole))
    store = Stored(led.where("part is not null or leader.c <> last"), "matrix")
    columns = ["token", "part", "c", "n", F.col("leader.c").alias("leader"), F.col("leader.n").alias("leader_n")]
    matrix = store.df.where("part is null").select(columns).union(_hot(store.df, "leader", "last", "leader.c <> last").select(columns))

    fits = f"c <> leader and {config.den} * least(n, leader_n) >= {config.num} * greatest(n, leader_n)"
    # a leader that shares far fewer of its shingles than a link takes is left to the second round
    shared = matrix.where(fits).groupBy("c", "n", "leader").count().where(F.col("count") * 4 >= config.needed("n"))
    homes = Kept(shared.groupBy("c").agg(F.max_by("leader", F.struct("count", "leader")).alias("g")))
    home = homes.df
    members = home.select("c").union(home.select("g"))
    sets = _shingles_of(members.distinct(), classes, texts, config, seed)
    leaders = home.selectExpr("g", "g as c").distinct()
    first = Stored(_verified(home.select("g", "c"), leaders, sets.df, config), "links").df
    label = connected_components(first)
    sets.drop()

    # the second round
    labels = label.select(F.col("node").alias("c"), "label")
    mains = label.select(F.col("node").alias("g"), F.col("label").alias("main"))
    grouped = home.select("c", "g").union(leaders.join(home, "c", "left_anti").select("c", "g"))
    sizes = grouped.groupBy("g").agg(F.count("*").alias("size"))
    places = Stored(grouped.join(sizes, "g").join(mains, "g", "left").join(labels, "c", "left").select("c", "g", "size", F.coalesce("label", "c").alias("label"), F.coalesce("main", "g").alias("main")), "places")
    place = places.df
    or_c = [F.coalesce(x, "c").alias(x) for x in ("g", "label", "main")]
    placed = matrix.join(place, "c", "left").select("token", "part", "c", "n", *or_c, F.coalesce("size", F.lit(1)).alias("size"))
    ends = placed.withColumn("low", F.min("label").over(whole)).withColumn("high", F.max("label").over(whole)).where("part is not null or low <> high")
    marked = Stored(ends.select("token", "part", "c", "n", "g", "label", "main", "size", "low", "high"), "cells").df
    columns = ["token", "c", "n", "g", "label", "main", "size"]
    cells = marked.where("part is null").select(columns).union(_hot(marked, "low", "high", "low <> high").select(columns))
    store.drop()
    groups = cells.groupBy("token", "g", "size", "main").agg(F.min("n").alias("least_n"), F.max("n").alias("most_n"))
    asked = groups.select("token", F.col("g").alias("to"), F.col("size").alias("to_size"), F.col("main").alias("to_main"), "least_n", "most_n")
    asks_it = "g <> to and if(main = to_main, label <> to_main, size < to_size or (size = to_size and g < to))"
    in_reach = f"{config.den} * n >= {config.num} * least_n and {config.num} * n <= {config.den} * most_n"
    met = cells.join(asked, "token").where(f"{asks_it} and {in_reach}").groupBy(F.col("to").alias("g"), "c", "n").count().where(F.col("count") >= config.needed("n"))
    own = place.where(f"size > {BLOCK} and label <> main")
    asks = Stored(met.select("g", "c").union(own.select("g", "c")), "asks")
    queries = asks.df
    asked_groups = queries.select("g").distinct()
    inside = place.select("g", "c").join(asked_groups, "g", "left_semi")
    alone = asked_groups.join(place, "g", "left_anti").selectExpr("g", "g as c")
    held = inside.unionByName(alone)
    sets = _shingles_of(held.select("c").union(queries.select("c")).distinct(), classes, texts, config, seed)
    second = _verified(held, queries, sets.df, config)
    return label.select(F.col("node").alias("a"), F.col("label").alias("b")).union(second)


def similar_components(docs: DataFrame, config: JaccardConfig = JaccardConfig()) -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id (the least doc_id that links lead to, itself included).

    Null and empty texts, and texts of white space, have no shingles and link with nothing. A row without doc_id
    links with nothing and has a null component_id. Rows that repeat a doc_id are rows of their own, each with the
    component of its text. An empty table gives no rows; further columns are ignored.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"))
    profiles, classes, seed = _profiles(texts, config)
    levels = docs.sparkSession.sparkContext.broadcast(_levels(profiles))
    links = stored_alone(lambda: _links(texts, classes, levels, config, seed), "links").df

    final = connected_components(links).withColumnRenamed("node", "c")
    known = classes.join(final, "c", "left").select("c", "first_id", F.coalesce("label", "c").alias("label"))
    least = known.groupBy("label").agg(F.min("first_id").alias("component_id"))
    component = known.join(least, "label").select("c", "component_id")
    rows = profiles.where("slab is null")
    linked = rows.where("c is not null and doc_id is not null").join(component, "c").select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    return linked.unionByName(rows.where("c is null or doc_id is null").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id")))


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_components(table(spark, sf_dir, "documents"))
