"""Word vectors against plain sums, gradients against differences, and held-out accuracy."""

import random
import re
from dataclasses import replace

import numpy as np
import pyarrow as pa

from ampline.llm.common import ByteRuns, table
from ampline.llm.quality_classifier import KINDS, Network, QualityConfig, _buckets, fit_network, fit_rows, fitted_temperature, index_vectors, op12_quality, pooled, score_quality, word_vectors

C = QualityConfig(bits=9, size=8, nonzero=3, epochs=30)
TEXTS = ["The the, a&&& b", "", None, "x", "the a the a the a | | |", "café 42 \U0001f600!? the", "a\n\nb\tc"]
TOKEN = re.compile(r"[0-9a-z\u0080-\U0010ffff]+|[^0-9a-z\u0080-\U0010ffff\x20\x09-\x0D]+")


def tokens(text):
    return TOKEN.findall((text or "").lower())


def test_tokens():
    runs = ByteRuns(pa.array(TEXTS, pa.string()).fill_null(""), KINDS)
    assert runs.encoded().to_pylist() == [w for t in TEXTS for w in tokens(t)]
    assert np.bincount(runs.text, minlength=len(TEXTS)).tolist() == [len(tokens(t)) for t in TEXTS]


def test_vectors_are_sums_over_contexts(spark):
    df = spark.createDataFrame([(t, 1) for t in TEXTS * 3], "text string, segment int").repartition(4)
    got, (places, signs) = word_vectors(df, C), index_vectors(C)
    index = np.zeros((1 << C.bits, C.size))
    np.add.at(index, (np.arange(len(index))[:, None], places), signs)
    want = np.zeros((1 << C.bits, C.size))
    for t in TEXTS * 3:
        at = _buckets(ByteRuns(pa.array([t or ""]), KINDS), C)
        for i in range(len(at)):
            for j in range(max(0, i - C.reach), min(len(at), i + C.reach + 1)):
                if i != j:
                    want[at[i]] += index[at[j]]
    length = np.linalg.norm(want, axis=1, keepdims=True)
    assert np.allclose(got, want / np.maximum(length, 1e-12), atol=1e-6)
    assert length.any()


def test_pooling_is_the_plain_one(monkeypatch):
    from ampline.llm import quality_classifier

    vectors = np.random.default_rng(1).normal(size=(1 << C.bits, C.size)).astype(np.float32)
    text = pa.array(TEXTS, pa.string()).fill_null("")
    whole = pooled(text, vectors, C)
    for k, t in enumerate(text.to_pylist()):
        v = vectors[_buckets(ByteRuns(pa.array([t]), KINDS), C)].astype(float)
        n, words = len(v), tokens(t)
        assert n == len(words)
        mean, spread = (v.mean(0), v.std(0)) if n else (np.zeros(C.size), np.zeros(C.size))
        pairs = (v[:-1] * v[1:]).sum(0) / max(n, 1)
        assert np.allclose(whole[k], [*mean, *spread, *pairs, np.log1p(n), len(set(words)) / max(n, 1)], atol=1e-4)
    monkeypatch.setattr(quality_classifier, "CHUNK", 3)  # texts that are cut give the same
    assert np.allclose(pooled(text, vectors, C), whole)


def test_the_network_learns_what_no_line_tells():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(3000, 4))
    y = (x[:, 0] * x[:, 1] > 0).astype(float)
    net = fit_network(x[:2000], y[:2000], replace(C, epochs=60))
    assert ((net.odds(x[2000:]) > 0) == y[2000:]).mean() > 0.93
    again = fit_network(x[:2000], y[:2000], replace(C, epochs=60))
    assert (net.odds(x) == again.odds(x)).all()


def test_temperature_mends_certainty():
    rng = np.random.default_rng(3)
    z = rng.normal(size=20_000) * 2
    y = (rng.random(20_000) < 1 / (1 + np.exp(-z))).astype(float)
    assert abs(fitted_temperature(5 * z, y) - 5) < 0.3
    assert fitted_temperature(np.array([9.0, -9.0]), np.array([1.0, 0.0])) > 5  # two rows don't make sure
    one = Network(np.zeros(1), np.ones(1), np.zeros((1, 2)), np.zeros(2), np.zeros(2), 3.0, 5.0)
    assert np.isclose(one.score(np.zeros((1, 1)))[0], 1 / (1 + np.exp(-0.6)))


def test_odd_rows_and_nothing_to_learn(spark):
    docs = spark.createDataFrame([(k, t, 0.1) for k, t in enumerate(TEXTS)] + [(None, "x", 0.2), (3, "x", 0.3), (3, "x", 0.3)], "doc_id long, text string, score double")
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert [r.score for r in score_quality(docs, none, C).collect()] == [0.5] * 10
    assert score_quality(docs.limit(0), none, C).collect() == []
    one = spark.createDataFrame([(0, 1), (0, 0), (4, 1), (None, 0), (5, None), (6, 7)], "doc_id long, quality int")
    assert {r.score for r in score_quality(docs, one, C).collect()} == {0.5}  # of a label that repeats the largest holds
    assert fit_rows(np.zeros((4, 2)), np.zeros(4)) is None
    rng = random.Random(4)
    many = [(k, " ".join(rng.choice(["good", "fine", "well"]) if k % 2 else "bad&&& junk###" for _ in range(9)), 0.0) for k in range(200)]
    df = spark.createDataFrame([*many, (900, None, 0.0), (901, "", 0.0), (902, "good " * 50_000, 0.0)], docs.schema)
    got = {r.doc_id: r.score for r in score_quality(df, spark.createDataFrame([(k, k % 2) for k in range(150)], one.schema), C).collect()}
    assert got[900] == got[901]
    assert all((got[k] > 0.7) == (k % 2 == 1) for k in range(200))


def test_held_out_rows(spark):
    scored = op12_quality(spark, "/root/testdata/sf0.01")
    assert scored.count() == 1000
    rows = scored.where("held_out").join(table(spark, "/root/testdata/sf0.01", "labels"), "doc_id").collect()
    for label in (0, 1):
        mine = [r.predicted == label for r in rows if r.quality == label]
        assert sum(mine) / len(mine) > 0.9
