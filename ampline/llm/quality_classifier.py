"""Quality by random indexing and a two-layer network.

Tokens are runs of letters and digits, and runs of other signs. Each hashes to one of a fixed number of buckets with a random
index vector of a few signs; a bucket's word vector is the sum of the index vectors of what stands within ``reach`` of it, over
all texts of the corpus. Tasks add up what they read and send sums by segment of buckets, so the vectors take the same memory
whatever the corpus holds. A document is pooled from the vectors of its tokens: mean, spread, mean product of neighbours, and
how many tokens it has and how many of them differ. A network with one hidden layer learns the labels from pooled documents;
its log-odds are divided by a temperature that is fitted on labelled rows which the network hasn't seen.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ampline.llm.common import ByteRuns, fold, longer_runs, n_shuffle, slices, table

#: Letters, digits and bytes beyond ASCII are of one kind, other signs of another.
KINDS = np.full(256, 2, np.uint8)
KINDS[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = 1
KINDS[[0x20, *range(0x09, 0x0E)]] = 0
#: Tokens whose vectors are held at once, and buckets of a segment, as a power of two.
CHUNK, SEGMENT = 1 << 12, 12


@dataclass(frozen=True)
class QualityConfig:
    #: Labelled rows that the network is fitted on (expected number, at most).
    sample_rows: int = 20_000
    #: Buckets of tokens, as a power of two; components of a vector, and of these the nonzero ones of an index vector.
    bits: int = 15
    size: int = 48
    nonzero: int = 6
    #: Tokens on each side that are a token's context.
    reach: int = 2
    hidden: int = 32
    epochs: int = 60
    batch: int = 128
    rate: float = 3e-3
    decay: float = 1e-4
    #: Share of the fitted rows that the temperature is fitted on.
    calibration: float = 0.2
    seed: int = 11


def index_vectors(config: QualityConfig) -> tuple[np.ndarray, np.ndarray]:
    """(components, signs) of each bucket's index vector, a row a bucket; the same everywhere."""
    rng = np.random.default_rng(config.seed)
    shape = (1 << config.bits, config.nonzero)
    return rng.integers(0, config.size, shape), rng.choice([-1.0, 1.0], shape)


def _buckets(runs: ByteRuns, config: QualityConfig) -> np.ndarray:
    return (runs.hashes() >> np.uint64(64 - config.bits)).astype(np.int64)


def _contexts(config: QualityConfig) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (at, sign), size = index_vectors(config), (1 << config.bits) * config.size
        total = np.zeros(size)
        for batch in slices(batches, "text"):
            runs = ByteRuns(batch.column("text"), KINDS)
            bucket = _buckets(runs, config)
            for k in range(1, config.reach + 1):
                same = runs.text[k:] == runs.text[:-k]
                left, right = bucket[:-k][same], bucket[k:][same]
                for word, other in ((left, right), (right, left)):
                    for j in range(config.nonzero):
                        total += np.bincount(word * config.size + at[other, j], weights=sign[other, j], minlength=size)
        total = total.astype(np.int64).reshape(-1, config.size)
        pack = zstandard.ZstdCompressor(level=1).compress
        width = 1 << min(SEGMENT, config.bits)
        for k in range(len(total) // width):
            part = total[k * width : (k + 1) * width]
            if part.any():
                yield pa.record_batch([pa.array([k], pa.int32()), pa.array([pack(part.tobytes())], pa.binary())], names=["segment", "sums"])

    return run


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The sum of each segment's rows, one segment at a time."""
    unpack = zstandard.ZstdDecompressor().decompress
    at, total = None, np.zeros(0, np.int64)
    for batch in batches:
        for segment, sums in zip(batch.column("segment").to_pylist(), batch.column("sums"), strict=True):
            part = np.frombuffer(unpack(sums.as_py()), np.int64)
            if segment != at and at is not None:
                yield pa.record_batch([pa.array([at], pa.int32()), pa.array([total.tobytes()], pa.binary())], names=["segment", "sums"])
            at, total = segment, total + part if segment == at else part
    if at is not None:
        yield pa.record_batch([pa.array([at], pa.int32()), pa.array([total.tobytes()], pa.binary())], names=["segment", "sums"])


def word_vectors(docs: DataFrame, config: QualityConfig = QualityConfig()) -> np.ndarray:
    """A unit vector for each bucket, from all texts; zero for a bucket without context."""
    schema = "segment int, sums binary"
    parts = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(_contexts(config), schema)
    merged = parts.repartition(n_shuffle(docs.sparkSession), "segment").sortWithinPartitions("segment").mapInArrow(_added, schema)
    total = np.zeros((1 << config.bits, config.size))
    width = 1 << min(SEGMENT, config.bits)
    for r in merged.toLocalIterator():  # as many rows as the buckets have segments
        total[r.segment * width : (r.segment + 1) * width] = np.frombuffer(r.sums, np.int64).reshape(width, config.size)
    length = np.sqrt((total**2).sum(1, keepdims=True))
    return (total / np.maximum(length, 1e-12)).astype(np.float32)


def pooled(text: pa.Array, vectors: np.ndarray, config: QualityConfig) -> np.ndarray:
    """A row for each text: mean of its tokens' vectors, their spread, mean product of neighbours, log of tokens, share of different ones."""
    runs = ByteRuns(text, KINDS)
    bucket, of, d = _buckets(runs, config), runs.text, config.size
    sums = np.zeros((len(text), 3 * d))
    for s in range(0, len(bucket), CHUNK):
        v, t = vectors[bucket[s : s + CHUNK + 1]].astype(np.float64), of[s : s + CHUNK + 1]
        product = v[:-1] * v[1:] * (t[1:] == t[:-1])[:, None]
        v, t = v[:CHUNK], t[:CHUNK]
        if len(product) < len(v):  # the last token has none after it
            product = np.concatenate([product, np.zeros((1, d))])
        first = np.flatnonzero(np.diff(t, prepend=-1))
        for k, x in enumerate((v, v * v, product)):
            sums[t[first], k * d : (k + 1) * d] += np.add.reduceat(x, first, axis=0)
    n = np.bincount(of, minlength=len(text)).astype(float)
    each = np.maximum(n, 1)[:, None]
    mean = sums[:, :d] / each
    spread = np.sqrt(np.maximum(sums[:, d : 2 * d] / each - mean**2, 0))
    key, one = np.unique(longer_runs(of.astype(np.uint64), runs.hashes()), return_index=True)
    differ = np.bincount(of[one], minlength=len(text)) / np.maximum(n, 1)
    return np.concatenate([mean, spread, sums[:, 2 * d :] / each, np.log1p(n)[:, None], differ[:, None]], axis=1)


@dataclass(frozen=True)
class Network:
    """Two layers over standardised features, and the temperature of its log-odds."""

    centre: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float = 1.0

    def odds(self, x: np.ndarray) -> np.ndarray:
        """Log-odds before the temperature."""
        return np.tanh((x - self.centre) / self.scale @ self.w1 + self.b1) @ self.w2 + self.b2

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.odds(x) / self.temperature, -30, 30)))


def fit_network(x: np.ndarray, y: np.ndarray, config: QualityConfig) -> Network:
    """Minimises the log loss by Adam, over shuffled batches; same rows in the same order give the same network."""
    rng = np.random.default_rng(config.seed)
    centre, scale = x.mean(0), np.maximum(x.std(0), 1e-6)
    z = (x - centre) / scale
    p = [rng.normal(0, 1 / np.sqrt(x.shape[1]), (x.shape[1], config.hidden)), np.zeros(config.hidden), rng.normal(0, 1 / np.sqrt(config.hidden), config.hidden), np.zeros(1)]
    m, v = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p]
    step = 0
    for _ in range(config.epochs):
        order = rng.permutation(len(z))
        for s in range(0, len(z), config.batch):
            rows = order[s : s + config.batch]
            hidden = np.tanh(z[rows] @ p[0] + p[1])
            miss = (1 / (1 + np.exp(-np.clip(hidden @ p[2] + p[3], -30, 30))) - y[rows]) / len(rows)
            back = miss[:, None] * p[2] * (1 - hidden**2)
            slopes = [z[rows].T @ back + config.decay * p[0], back.sum(0), hidden.T @ miss + config.decay * p[2], miss.sum(keepdims=True)]
            step += 1
            for k, g in enumerate(slopes):
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.999 * v[k] + 0.001 * g**2
                p[k] = p[k] - config.rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
    return Network(centre, scale, p[0], p[1], p[2], float(p[3][0]))


def fitted_temperature(odds: np.ndarray, y: np.ndarray) -> float:
    """The temperature between 1/20 and 20 of least log loss, by golden sections of its logarithm (the loss has one minimum).

    Labels are drawn in as if one more row of each class had been seen with the other label, so that rows without an
    error don't make the network certain.
    """
    n1, n0 = y.sum(), len(y) - y.sum()
    target = np.where(y == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))

    def loss(t: float) -> float:
        z = odds / np.exp(t)
        return float(np.mean(np.logaddexp(0, z) - target * z))

    low, high, g = -np.log(20), np.log(20), (np.sqrt(5) - 1) / 2
    for _ in range(60):
        a, b = high - g * (high - low), low + g * (high - low)
        low, high = (low, b) if loss(a) <= loss(b) else (a, high)
    return float(np.exp((low + high) / 2))


def fit_rows(x: np.ndarray, y: np.ndarray, config: QualityConfig = QualityConfig()) -> Network | None:
    """The network, fitted on most rows, with a temperature fitted on the rest; None without rows of both classes among the former."""
    y = np.asarray(y, float)
    aside = np.random.default_rng(config.seed + 1).random(len(y)) < config.calibration
    if len(np.unique(y[~aside])) < 2:
        return None
    net = fit_network(x[~aside], y[~aside], config)
    temperature = fitted_temperature(net.odds(x[aside]), y[aside]) if len(np.unique(y[aside])) == 2 else 1.0
    return Network(net.centre, net.scale, net.w1, net.b1, net.w2, net.b2, temperature)


def _features(vectors, config: QualityConfig) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            x = pooled(batch.column("text"), vectors.value, config)
            lists = pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), x.shape[1]).cast(pa.list_(pa.float64()))
            yield pa.record_batch([batch.column("label_id"), batch.column("quality"), lists], names=["label_id", "quality", "x"])

    return run


def fit(docs: DataFrame, labels: DataFrame, vectors, config: QualityConfig = QualityConfig()) -> Network | None:
    """Learns from labelled documents (labels: doc_id, quality 0/1; of repeated labels the largest holds, of repeated ids the least text).

    ``vectors`` are the broadcast word vectors. Labels are drawn by a hash of the id when there are more than sample_rows.
    """
    known = labels.where("doc_id is not null and quality in (0, 1)").select(F.col("doc_id").cast("long").alias("label_id"), F.col("quality").cast("int").alias("quality"))
    known = known.groupBy("label_id").agg(F.max("quality").alias("quality"))
    share = min(1.0, config.sample_rows / max(1, known.count()))
    drawn = known.where(F.pmod(F.xxhash64("label_id"), F.lit(2**30)) < int(share * 2**30))
    # at most a few ten thousand ids, by the sample's bound
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(drawn), F.col("doc_id") == F.col("label_id"))
    single = texts.groupBy("label_id").agg(F.min("text").alias("text"), F.max("quality").alias("quality"))
    rows = single.mapInArrow(_features(vectors, config), "label_id long, quality int, x array<double>").toArrow().sort_by("label_id")
    if not rows.num_rows:
        return None
    return fit_rows(np.stack(rows["x"].combine_chunks().to_numpy(zero_copy_only=False)), rows["quality"].to_numpy(), config)


def _score(vectors, net, config: QualityConfig) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            score = np.full(batch.num_rows, 0.5) if net.value is None else net.value.score(pooled(batch.column("text"), vectors.value, config))
            yield pa.record_batch([batch.column("doc_id"), pa.array(score)], names=["doc_id", "score"])

    return run


def score_quality(docs: DataFrame, labels: DataFrame, config: QualityConfig = QualityConfig()) -> DataFrame:
    """doc_id and score (0 to 1, calibrated) of each row of ``docs``, learned from ``labels`` and the texts of ``docs``.

    Word vectors come from all texts, labels only from ``labels``. Null and empty texts get the score of a text without
    tokens. Without labels of both classes every score is 0.5. Null ids and repeated rows have a row each; an empty table
    gives none; further columns are ignored.
    """
    sc = docs.sparkSession.sparkContext
    vectors = sc.broadcast(word_vectors(docs, config))
    net = sc.broadcast(fit(docs, labels, vectors, config))
    return docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text").mapInArrow(_score(vectors, net, config), "doc_id long, score double")


def op12_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    scored = score_quality(docs, labels.where(fold("doc_id", 4) != 2))
    return scored.select("doc_id", (fold("doc_id", 4) == 2).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))
