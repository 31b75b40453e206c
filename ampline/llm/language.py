"""Language identification of words, spans and documents.

A word's script narrows the languages that it may be in to those that use this script in the learning rows. Within
them the word is scored by smoothed log probabilities of its character 1- to 3-grams; Viterbi with a penalty for each
switch then labels the words, so that mixed texts come out as spans. The document's language is the one of most words.

The model is fitted on a bounded sample of labelled rows and is itself bounded: ``2 ** bits`` counts a language.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ampline.llm.chains import hashed_grams, viterbi
from ampline.llm.common import fold, slices, sums_between, table, words_of

#: First and last code point of Unicode blocks of a script's letters.
SCRIPTS = {
    "latin": [(0x41, 0x5A), (0x61, 0x7A), (0xAA, 0xAA), (0xBA, 0xBA), (0xC0, 0xD6), (0xD8, 0xF6), (0xF8, 0x24F), (0x1E00, 0x1EFF)],
    "greek": [(0x370, 0x3FF), (0x1F00, 0x1FFF)],
    "cyrillic": [(0x400, 0x52F), (0x1C80, 0x1C8F), (0x2DE0, 0x2DFF), (0xA640, 0xA69F)],
    "armenian": [(0x530, 0x58F)],
    "hebrew": [(0x590, 0x5FF)],
    "arabic": [(0x600, 0x6FF), (0x750, 0x77F), (0x8A0, 0x8FF), (0xFB50, 0xFDFF), (0xFE70, 0xFEFF)],
    "devanagari": [(0x900, 0x97F)],
    "bengali": [(0x980, 0x9FF)],
    "tamil": [(0xB80, 0xBFF)],
    "telugu": [(0xC00, 0xC7F)],
    "thai": [(0xE00, 0xE7F)],
    "georgian": [(0x10A0, 0x10FF), (0x2D00, 0x2D2F)],
    "hangul": [(0x1100, 0x11FF), (0x3130, 0x318F), (0xAC00, 0xD7AF)],
    "kana": [(0x3040, 0x30FF), (0x31F0, 0x31FF)],
    "han": [(0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0x20000, 0x323AF)],
}
OTHER = len(SCRIPTS)
_RANGES = sorted((a, b, k) for k, ranges in enumerate(SCRIPTS.values()) for a, b in ranges)
_FROM, _TO, _SCRIPT = (np.array(x) for x in zip(*_RANGES, strict=True))

#: A letter is what Unicode puts into category L; numbers such as fractions and Roman numerals are none.
_LETTER = regex.compile(r"\p{L}")
ORDERS = (1, 2, 3)
#: Words whose character n-grams are held at once, and bytes of text that are learned from at once.
SCORED_WORDS, LEARNED_BYTES = 1 << 14, 1 << 20


@dataclass(frozen=True)
class LanguageConfig:
    #: Expected number of labelled rows that the model is fitted on, at most.
    sample_rows: int = 20_000
    bits: int = 15
    #: What a change of language costs, in nats, and the most that a single word may say for one language over another.
    switch_penalty: float = 8.0
    word_limit: float = 6.0
    smoothing: float = 0.1
    #: Bytes of text that are labelled in step.
    slice_bytes: int = 6 << 20


def scripts_of(words: list[str]) -> np.ndarray:
    """The script of each word's first letter; OTHER for letters outside the table, -1 for words without letters."""
    first = np.array([ord(m[0]) if (m := _LETTER.search(w)) else -1 for w in words], np.int64)
    at = np.maximum(np.searchsorted(_FROM, first, side="right") - 1, 0)
    return np.where(first < 0, -1, np.where((first >= _FROM[at]) & (first <= _TO[at]), _SCRIPT[at], OTHER))


def _learn(bits: int) -> Callable:
    def run(batches):
        totals: dict[str, np.ndarray] = {}
        for batch in slices(batches, "text", LEARNED_BYTES):
            langs = np.array(batch.column("lang").to_pylist(), object)
            offsets, codes, vocab = words_of(batch.column("text"))
            script = scripts_of(vocab)
            owner, gram = hashed_grams(vocab, ORDERS, bits)
            for lang in set(langs):
                rows = np.flatnonzero(langs == lang)
                seen = np.zeros(len(vocab))
                for r in rows:
                    np.add.at(seen, codes[offsets[r] : offsets[r + 1]], 1)
                seen[script < 0] = 0
                got = totals.setdefault(lang, np.zeros((1 << bits) + OTHER + 2))
                got[: 1 << bits] += np.bincount(gram, weights=seen[owner], minlength=1 << bits)
                got[1 << bits : -1] += np.bincount(script[script >= 0], weights=seen[script >= 0], minlength=OTHER + 1)
                got[-1] += len(rows)
        for lang, got in totals.items():
            at = np.flatnonzero(got)
            yield pa.record_batch([pa.array([lang] * len(at)), pa.array(at), pa.array(got[at])], names=["lang", "at", "n"])

    return run


@dataclass(frozen=True)
class LanguageModel:
    langs: list[str]
    #: grams[hash, language]: log probability; may[script, language]: the language uses the script.
    grams: np.ndarray
    may: np.ndarray
    #: The language of most learning rows.
    usual: int
    config: LanguageConfig

    def word_scores(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(score of each word in each language, whether it has a letter); words that say nothing score 0 in all."""
        limit = self.config.word_limit
        script = scripts_of(words)
        out = np.zeros((len(words), len(self.langs)), np.float32)
        for k in range(0, len(words), SCORED_WORDS):  # a word has a few tens of grams
            part = words[k : k + SCORED_WORDS]
            owner, gram = hashed_grams(part, ORDERS, self.config.bits)
            order = np.argsort(owner, kind="stable")
            starts = np.searchsorted(owner[order], np.arange(len(part)))
            out[k : k + len(part)] = np.add.reduceat(self.grams[gram[order]], starts, axis=0)
        may = self.may[script]
        out[~may] = -np.inf
        out -= np.maximum(out.max(1, keepdims=True), -1e30)
        np.maximum(out, -limit, out=out)
        out[~may] = -2 * limit
        out[(script < 0) | ~may.any(1)] = 0
        return out, script >= 0

    def label(self, batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(word offsets, language of each word, whether it has a letter)"""
        offsets, codes, vocab = words_of(batch.column("text"))
        scores, letters = self.word_scores(vocab)
        return offsets, viterbi(scores[codes], offsets, self.config.switch_penalty), letters[codes]


def fit(labelled: DataFrame, config: LanguageConfig = LanguageConfig()) -> LanguageModel | None:
    """Learns from (doc_id, text, lang); rows without lang are left out. None if there is nothing to learn from."""
    rows = labelled.where("lang is not null").selectExpr("doc_id", "text", "cast(lang as string) lang")
    n = rows.count()
    if n > config.sample_rows:
        share = int(config.sample_rows / n * 2**30)
        rows = rows.where(F.pmod(F.xxhash64("doc_id"), F.lit(2**30)) < share)
    counts = rows.select("text", "lang").mapInArrow(_learn(config.bits), "lang string, at long, n double")
    found: pd.DataFrame = counts.groupBy("lang", "at").agg(F.sum("n").alias("n")).toPandas()
    if found.empty:
        return None
    langs, size = sorted(found.lang.unique()), 1 << config.bits
    all_counts = np.zeros((len(langs), size + OTHER + 2))
    all_counts[found.lang.map({x: i for i, x in enumerate(langs)}).to_numpy(), found["at"].to_numpy()] = found["n"].to_numpy()
    grams, scripts = all_counts[:, :size], all_counts[:, size:-1]
    smooth = grams + config.smoothing
    logs = np.log(smooth / smooth.sum(1, keepdims=True)).T.astype(np.float32)
    may = (scripts > 0.01 * np.maximum(scripts.sum(1, keepdims=True), 1)).T
    return LanguageModel(langs, logs, may, int(all_counts[:, -1].argmax()), config)


def _spans(model) -> Callable:
    def run(batches):
        m: LanguageModel = model.value
        for batch in slices(batches, "text", m.config.slice_bytes):
            offsets, label, _ = m.label(batch)
            edge = np.zeros(len(label) + 1, bool)
            edge[offsets] = True
            edge[1:-1] |= label[1:] != label[:-1]
            starts = np.flatnonzero(edge[:-1]) if len(label) else np.zeros(0, np.int64)
            ends = np.append(starts[1:], len(label))[: len(starts)]
            row = np.searchsorted(offsets, starts, side="right") - 1
            yield pa.record_batch(
                [batch.column("doc_id").take(pa.array(row)), pa.array(starts - offsets[row]), pa.array(ends - offsets[row]), pa.array([m.langs[k] for k in label[starts]], pa.string())],
                names=["doc_id", "first_word", "end_word", "lang"],
            )

    return run


def language_spans(docs: DataFrame, model: LanguageModel | None) -> DataFrame:
    """A row per run of words in one language: doc_id, first_word, end_word (exclusive), lang.

    Words are what ASCII white space parts; those without a letter go with their neighbours. Null and empty texts have
    no row, and no text has one if there is no model. Null ids and repeated rows have their rows each; an empty table gives
    none; further columns are ignored.
    """
    texts, schema = docs.selectExpr("cast(doc_id as long) doc_id", "text"), "doc_id long, first_word long, end_word long, lang string"
    if model is None:
        return docs.sparkSession.createDataFrame([], schema)
    return texts.mapInArrow(_spans(docs.sparkSession.sparkContext.broadcast(model)), schema)


def _predict(model, names: tuple[str, str]) -> Callable:
    def run(batches):
        m: LanguageModel | None = model.value
        for batch in slices(batches, "text", m.config.slice_bytes if m else 1 << 22):
            if m is None:
                pred, score = ["und"] * batch.num_rows, np.zeros(batch.num_rows)
            else:
                offsets, label, letters = m.label(batch)
                votes = np.stack([sums_between(((label == k) & letters).astype(np.int64), offsets) for k in range(len(m.langs))], axis=1)
                total = votes.sum(1)
                known = total > 0
                top = votes.argmax(1)
                score = np.where(known, votes.max(1) / np.maximum(total, 1), 0.0)
                pred = [m.langs[k] if ok else "und" for k, ok in zip(top.tolist(), known.tolist(), strict=True)]
            made = dict(zip(names, (pa.array(pred, pa.string()), pa.array(score)), strict=True))
            yield pa.record_batch([*batch.columns, *made.values()], names=[*batch.schema.names, *made])

    return run


def with_language(docs: DataFrame, model: LanguageModel | None, names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """``docs`` with lang_pred and score (or ``names``): the language, and the share of the words with letters that are in it.

    ``und`` with score 0 where text is null or has no letter, or no row could be learned from. Ties go to the language
    first in order. An empty table gives no rows; null ids and repeated rows stay as they are; columns of docs that are
    called as the new ones are replaced.
    """
    rows = docs.drop(*names)
    given = rows.withColumn("text", F.col("text").cast("string")).withColumn("ampline_text_is_null", F.col("text").isNull())
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = StructType(list(given.schema.fields)).add(names[0], "string").add(names[1], "double")
    out = given.mapInArrow(_predict(shared, names), schema)
    return out.withColumn("text", F.when(~F.col("ampline_text_is_null"), F.col("text"))).select(*rows.columns, *names)


def _lettered(batches):
    for batch in slices(batches, "text"):
        yield batch.filter(pa.array([_LETTER.search(x) is not None for x in batch.column("text").to_pylist()], pa.bool_()))


def with_letters(docs: DataFrame) -> DataFrame:
    """The rows whose text has a letter: those that with_language gives a language when there is a model."""
    return docs.withColumn("text", F.col("text").cast("string")).mapInArrow(_lettered, docs.schema)


def identify(docs: DataFrame, model: LanguageModel | None) -> DataFrame:
    """One row per input row: doc_id, lang_pred, score, as by with_language."""
    return with_language(docs.selectExpr("cast(doc_id as long) doc_id", "text"), model).select("doc_id", "lang_pred", "score")


def learn_rows(docs: DataFrame) -> DataFrame:
    return docs.where(fold("doc_id", 3) != 1)


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return identify(docs, fit(learn_rows(docs))).select("doc_id", (fold("doc_id", 3) == 1).alias("held_out"), "lang_pred", "score")
