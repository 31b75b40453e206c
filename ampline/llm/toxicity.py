"""Toxicity by a linear-chain conditional random field over words.

Labels are given for documents, so the words to learn from are labelled first: a word of a toxic document is toxic if
it, or a prefix of it, occurs in toxic learning documents and hardly in others. The field's emission weights (word,
prefixes, suffix; hashed) and its transitions are then fitted to these labels by gradient ascent. Forward-backward gives
each word's marginal; a document's score is a logistic function of the sum and the maximum of its words'
marginals, fitted on the same rows. The model has a fixed size and is broadcast; every document is scored whole.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ampline.llm.chains import chain_odds
from ampline.llm.common import fold, slices, sums_between, table, words_of

_EDGE = re.compile(r"^[\W_]+|[\W_]+$")
PREFIXES, SUFFIX = (3, 4, 5, 6), 3
FEATURES = 2 + len(PREFIXES)


@dataclass(frozen=True)
class ToxicityConfig:
    #: Labelled rows of each class that the model is fitted on, at most (expected number), and their longest text.
    sample_rows: int = 2_000
    sample_chars: int = 30_000
    bits: int = 18
    #: For a word to count as toxic: the share of toxic ones among the documents that hold it (in rates), and how
    #: unlikely, in nats, a share as high as that may be by chance.
    precision: float = 0.95
    surprise: float = 10.0
    rounds: int = 20
    rate: float = 1.0
    decay: float = 1e-3
    slice_bytes: int = 12 << 20


def features(words: list[str], bits: int) -> np.ndarray:
    """Hashed features of each word, FEATURES a row; the last slot (``1 << bits``) stands for none."""
    none, out = 1 << bits, np.full((len(words), FEATURES), 1 << bits, np.int64)
    shift, digest = 64 - bits, xxhash.xxh64_intdigest
    for row, raw in zip(out, words, strict=True):
        w = _EDGE.sub("", raw.lower())
        if not w:
            continue
        n = len(w)
        row[:] = [digest(w, 1) >> shift, digest(w[-SUFFIX:], 2) >> shift if n > SUFFIX else none, *(digest(w[:k], 10 + k) >> shift if n > k else none for k in PREFIXES)]
    return out


@dataclass(frozen=True)
class ToxicityModel:
    weights: np.ndarray
    bias: float
    start: float
    change: np.ndarray
    #: intercept, weight of log1p(sum of marginals over one half), weight of the largest marginal
    document: np.ndarray
    config: ToxicityConfig

    def words(self, text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(word offsets, P(toxic) of each word)"""
        offsets, codes, vocab = words_of(text)
        lead = self.weights[features(vocab, self.config.bits)].sum(1) + self.bias if vocab else np.zeros(0)
        ahead, back = chain_odds(lead[codes], offsets, self.start, self.change)
        joint = ahead * back
        return offsets, joint / (1 + joint)

    def score(self, offsets: np.ndarray, p: np.ndarray) -> np.ndarray:
        x = _summary(offsets, p) @ self.document
        return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _summary(offsets: np.ndarray, p: np.ndarray) -> np.ndarray:
    total = sums_between(np.where(p >= 0.5, p, 0.0), offsets)
    most = np.zeros(len(offsets) - 1)
    some = np.flatnonzero(np.diff(offsets))
    if len(some):
        most[some] = np.maximum.reduceat(p, offsets[:-1][some])
    return np.stack([np.ones(len(most)), np.log1p(total), most], axis=1)


def _word_labels(feats: np.ndarray, offsets: np.ndarray, codes: np.ndarray, toxic: np.ndarray, config: ToxicityConfig) -> np.ndarray:
    """Whether each distinct word counts as toxic where it stands in a toxic document."""
    row = np.repeat(np.arange(len(toxic)), np.diff(offsets))
    pair = np.unique(row * (codes.max(initial=0) + 1) + codes)
    doc, word = pair // (codes.max(initial=0) + 1), pair % (codes.max(initial=0) + 1)
    size, bad = (1 << config.bits) + 1, np.zeros(len(feats), bool)
    n = np.array([(toxic == c).sum() for c in (0, 1)], float)
    prior = n[1] / n.sum()
    for k in (0, *range(3, FEATURES)):  # the word, and prefixes of four characters and more
        seen = np.unique(doc * size + feats[word, k])
        held = [np.bincount((seen % size)[toxic[seen // size] == c], minlength=size) for c in (0, 1)]
        both = np.maximum(held[0] + held[1], 1)
        share = held[1] / both
        bits = share * np.log(np.maximum(share, 1e-12) / prior) + (1 - share) * np.log(np.maximum(1 - share, 1e-12) / (1 - prior))
        good = (share > prior) & (both * bits >= config.surprise) & (held[1] / n[1] >= config.precision * (held[0] / n[0] + held[1] / n[1]))
        good[-1] = False
        bad |= good[feats[:, k]]
    return bad


def fit_rows(texts: list[str], toxic: np.ndarray, shares: tuple[float, float], config: ToxicityConfig = ToxicityConfig()) -> ToxicityModel | None:
    """Fits on texts and their labels; shares: how many documents each text of class 0 and 1 stands for."""
    toxic = np.asarray(toxic, np.int64)
    if not (toxic == 1).any() or not (toxic == 0).any():
        return None
    offsets, codes, vocab = words_of(pa.array(texts, pa.string()))
    feats = features(vocab, config.bits)
    bad = _word_labels(feats, offsets, codes, toxic, config)
    y = (bad[codes] & (np.repeat(toxic, np.diff(offsets)) == 1)).astype(float)
    first = np.zeros(len(codes), bool)
    first[offsets[:-1][np.diff(offsets) > 0]] = True
    later = np.flatnonzero(~first)

    size = (1 << config.bits) + 1
    weights, squares = np.zeros(size), np.full(size, 1e-6)
    small = np.array([-2.0, -2.0, 0.0, -1.0, 0.0, 0.0])  # bias, start, transitions 00 01 10 11
    small_squares = np.full(6, 1e-6)
    n = max(1.0, y.sum())
    for _ in range(config.rounds):
        change = small[2:].reshape(2, 2)
        lead = (weights[feats].sum(1) + small[0])[codes]
        ahead, back = chain_odds(lead, offsets, small[1], change)
        joint = ahead * back
        p = joint / (1 + joint)
        miss = y - p
        by_word = np.bincount(codes, weights=miss, minlength=len(vocab))
        slope = np.bincount(feats.ravel(), weights=np.repeat(by_word, FEATURES), minlength=size) / n - config.decay * weights
        squares += slope**2
        weights += config.rate * slope / np.sqrt(squares)
        weights[-1] = 0
        a, b = np.stack([np.ones(len(later)), ahead[later - 1]]), np.stack([np.ones(len(later)), np.exp(np.clip(lead[later], -30, 30)) * back[later]])
        pairs = np.exp(change)[:, :, None] * a[:, None, :] * b[None, :, :]
        pairs /= pairs.sum((0, 1))
        seen = np.bincount((2 * y[later - 1] + y[later]).astype(np.int64), minlength=4)
        slope = np.concatenate(([miss.sum(), miss[first].sum()], seen - pairs.sum(2).ravel())) / n - config.decay * small
        small_squares += slope**2
        small += config.rate * slope / np.sqrt(small_squares)
    model = ToxicityModel(weights, small[0], small[1], small[2:].reshape(2, 2), np.zeros(3), config)
    ahead, back = chain_odds((weights[feats].sum(1) + small[0])[codes], offsets, small[1], model.change)
    x = _summary(offsets, ahead * back / (1 + ahead * back))
    each = np.where(toxic == 1, shares[1], shares[0])
    beta = np.zeros(3)
    for _ in range(50):  # Newton's method, with a slight pull to zero
        q = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        h = (x * (each * q * (1 - q))[:, None]).T @ x + 0.1 * np.eye(3)
        beta += np.linalg.solve(h, x.T @ (each * (toxic - q)) - 0.1 * beta)
    return ToxicityModel(weights.astype(np.float32), small[0], small[1], model.change, beta, config)


def fit(docs: DataFrame, labels: DataFrame, config: ToxicityConfig = ToxicityConfig()) -> ToxicityModel | None:
    """Learns from the labelled documents (labels: doc_id, toxic 0/1; of repeated labels the largest holds, of repeated ids the least text)."""
    known = labels.where("doc_id is not null and toxic in (0, 1)").select(F.col("doc_id").cast("long").alias("label_id"), "toxic").groupBy("label_id").agg(F.max("toxic").alias("toxic"))
    n = {r.toxic: r["count"] for r in known.groupBy("toxic").count().collect()}
    share = {c: min(1.0, config.sample_rows / max(1, n.get(c, 0))) for c in (0, 1)}
    place = F.pmod(F.xxhash64("label_id"), F.lit(2**30))
    drawn = known.where(place < F.when(F.col("toxic") == 1, int(share[1] * 2**30)).otherwise(int(share[0] * 2**30)))
    # at most a few thousand ids, by the sample's bound
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(drawn), F.col("doc_id") == F.col("label_id"))
    # one text for each id, however often it is repeated
    rows = texts.where(F.length("text") <= config.sample_chars).groupBy("label_id").agg(F.min("text").alias("text"), F.max("toxic").alias("toxic")).toPandas().sort_values("label_id")
    return fit_rows(rows["text"].tolist(), rows["toxic"].to_numpy(), (1 / share[0], 1 / share[1]), config)


def _runs(text: str, hit: np.ndarray, p: np.ndarray) -> list[list]:
    """[first and end character offset, largest marginal] of each run of toxic words of a text."""
    out: list[list] = []
    span: list | None = None
    for word, bad, q in zip(re.finditer(r"[^\x20\x09-\x0D]+", text), hit.tolist(), p.tolist(), strict=False):
        if bad and span:
            span[1], span[2] = word.end(), max(span[2], q)
        elif bad:
            out.append(span := [word.start(), word.end(), q])
        else:
            span = None
    return out


_OFFSETS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def _score(model) -> Callable:
    def run(batches):
        m: ToxicityModel | None = model.value
        for batch in slices(batches, "text", m.config.slice_bytes if m else 1 << 22):
            spans: list[list] = [[] for _ in range(batch.num_rows)]
            if m is None:
                score, many = np.zeros(batch.num_rows), np.zeros(batch.num_rows, np.int64)
            else:
                offsets, p = m.words(batch.column("text"))
                hit = p >= 0.5
                score, many = m.score(offsets, p), sums_between(hit.astype(np.int64), offsets)
                for r in np.flatnonzero(many).tolist():
                    mine = slice(offsets[r], offsets[r + 1])
                    spans[r] = [{"start": a, "end": b} for a, b, _ in _runs(batch.column("text")[r].as_py(), hit[mine], p[mine])]
            yield pa.record_batch([batch.column("doc_id"), pa.array(score), pa.array(many), pa.array(spans, _OFFSETS)], names=["doc_id", "score", "n_toxic_words", "toxic_spans"])

    return run


def score_toxicity(docs: DataFrame, model: ToxicityModel | None) -> DataFrame:
    """One row per input row: doc_id, score (0 to 1), n_toxic_words, toxic_spans (first and end character offset of each run of toxic words).

    Null and empty texts get the score of a text without toxic words, and no span; all scores are 0 and without spans where
    nothing could be learned. An empty table gives no rows; null ids and repeated rows give a row each; further columns are
    ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = "doc_id long, score double, n_toxic_words long, toxic_spans array<struct<start: long, end: long>>"
    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(_score(shared), schema)


def _find(model) -> Callable:
    def run(batches):
        m: ToxicityModel = model.value
        for batch in slices(batches, "text", m.config.slice_bytes):
            offsets, p = m.words(batch.column("text"))
            hit = p >= 0.5
            rows = []
            for r in np.flatnonzero(sums_between(hit.astype(np.int64), offsets)).tolist():
                mine, doc_id = slice(offsets[r], offsets[r + 1]), batch.column("doc_id")[r].as_py()
                rows += [(doc_id, *span) for span in _runs(batch.column("text")[r].as_py(), hit[mine], p[mine])]
            columns = zip(*rows, strict=True) if rows else [[]] * 4
            yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.float64()), strict=True)], names=["doc_id", "start", "end", "marginal"])

    return run


def toxic_spans(docs: DataFrame, model: ToxicityModel | None) -> DataFrame:
    """A row per run of toxic words: doc_id, first and end character offset, the largest marginal in it.

    Null and empty texts have no row, and no text has one if nothing could be learned. Null ids and repeated rows have
    their rows each; an empty table gives none; further columns are ignored.
    """
    schema = "doc_id long, start long, end long, marginal double"
    if model is None:
        return docs.sparkSession.createDataFrame([], schema)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(_find(shared), schema)


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = fit(docs, labels.where(fold("doc_id", 5) != 0))
    scored = score_toxicity(docs, model)
    return scored.select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "n_toxic_words", "toxic_spans")
