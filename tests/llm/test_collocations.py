"""Phrases against plain counting in Python, and against SQL."""

import random
import re
from collections import Counter
from dataclasses import replace

import numpy as np
import pyarrow as pa
import pytest

from ampline.llm.collocations import PhraseConfig, Words, collocations, phrase_counts, sketch

C = PhraseConfig(least=3, top=40, least_bits=10, packed_runs=500)
UPPER = {c: c + 32 for c in range(65, 91)}


def counted(rows, most):
    n, f = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(UPPER)):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for size in range(1, most + 1):
                for k in range(len(words) - size + 1):
                    f[lang, tuple(words[k : k + size])] += 1
    return n, f


def brute(rows, c):
    n, f = counted(rows, c.most_words)
    f = {k: v for k, v in f.items() if v >= c.least}
    found = {}
    for (lang, p), a in f.items():
        if len(p) < 2:
            continue
        cuts = [(1_000_000 * a * a // (f[lang, p[:k]] * f[lang, p[k:]]), k) for k in range(1, len(p))]
        score, k = min(cuts)
        if any(g == lang and len(q) > len(p) and 100 * b >= c.covered * a and any(q[i : i + len(p)] == p for i in range(len(q))) for (g, q), b in f.items()):
            continue
        found.setdefault(lang, []).append((-score, -a, " ".join(p).encode(), f[lang, p[:k]], f[lang, p[k:]]))
    return sorted((lang, i + 1, p.decode(), -a, left, right, n[lang], -score) for lang, some in found.items() for i, (score, a, p, left, right) in enumerate(sorted(some)[: c.top]))


def corpus(rng, n):
    words = ["ab", "b", "Cc", "dé", "e", "\U0001f600", "", "ab|", "b b", "x\x01y"]
    rows = []
    for _ in range(n):
        text = "".join(rng.choice(words) + rng.choice([" ", " ", " ", "\t", "  ", ". ", ",", "\n", "\x0b", ";x "]) for _ in range(rng.randint(0, 25)))
        rows.append((rng.choice(["en", "en", "de", None, "und", ""]), text))
    return [*rows, ("en", None), ("en", ""), ("fr", "..."), ("fr", "one two"), *[("de", "hot pair here")] * 50]


@pytest.mark.parametrize("seed", range(3))
def test_phrases_are_those_of_plain_counting(spark, seed):
    rows = corpus(random.Random(seed), 150)
    df = spark.createDataFrame(rows, "lang string, text string").selectExpr("*", "1 as rank", "'x' as phrase", "2 as f").repartition(3)
    assert sorted(map(tuple, collocations(df, C).collect())) == brute(rows, C)
    small = replace(C, top=3)
    assert sorted(map(tuple, collocations(df, small).collect())) == brute(rows, small)


def test_longer_phrases_and_none(spark):
    four = replace(C, most_words=4, least=2)
    rows = corpus(random.Random(9), 60)
    df = spark.createDataFrame(rows, "lang string, text string")
    assert sorted(map(tuple, collocations(df, four).collect())) == brute(rows, four)
    assert collocations(df.limit(0), C).collect() == []
    assert collocations(spark.createDataFrame([("en", "a b a b")], df.schema), C).collect() == []


def test_a_full_sketch_loses_nothing(spark):
    """With cells far too few everything passes, and the exact count decides."""
    rows = [("en", " ".join(f"w{k}" for k in range(j, j + 40))) for j in range(300)]
    df = spark.createDataFrame(rows, "lang string, text string")
    tight = replace(C, least_bits=3, most_bits=3)
    got = {(r.lang, r.phrase): r.f for r in phrase_counts(df, tight).collect() if r.words}
    want = {(g, " ".join(p)): v for (g, p), v in counted(rows, 3)[1].items() if v >= 3}
    assert got == want


def test_the_sketch_drops_what_is_rare(spark):
    rows = [("en", f"a{k} b{k} c{k}") for k in range(2000)] + [("en", "often said")] * 3
    known = sketch(spark.createDataFrame(rows, "lang string, text string"), replace(C, least_bits=16))
    assert sum(int(np.unpackbits(x).sum()) for x in known.rows) < 2 * 2**16 / 300


def test_words_and_pieces():
    words = Words(pa.array(["", "A b.C\td", "x", None, " ,"], pa.string()).fill_null(""))
    assert words.encoded().to_pylist() == ["a", "b", "c", "d", "x"]
    assert words.piece[0] == words.piece[1]
    assert len(set(words.piece.tolist())) == 3
    assert words.text.tolist() == [1, 1, 1, 1, 2]
    assert len(set(words.hashes().tolist())) == 5
    assert len(Words(pa.array([], pa.string()))) == 0
