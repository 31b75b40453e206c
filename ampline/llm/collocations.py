"""Phrase collocations by merged count-min sketches and an exact second pass.

Texts are lower-cased (A-Z), cut into pieces at punctuation and line ends, and pieces into words. A first pass hashes
every run of 1 to ``most_words`` words of a piece, language by language, into a count-min sketch: ``depth`` rows of cells
whose counts can only be too high. Tasks sketch what they read and send it as sorted, packed cells, by segment of a row;
segments are merged in parallel, in constant memory. What is left of the merged sketch is one bit a cell, whether it
reached the least count. A second pass counts exactly, but only what all its cells and all its parts let through; the few
that collisions let through are then below the least count and go. So the sketch's size costs time, never a phrase.

The sketch grows with the text up to ``most_bits``, which bounds what is broadcast (2 * 2**29 bits are 128 MB). Beyond
that more phrases pass to the exact count, with the same result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ampline.llm.common import ByteRuns, Stored, longer_runs, mixed, n_shuffle, slices, stored_alone, table

#: Cells of a segment of a row, as a power of two; a place in it takes three bytes.
SEGMENT = 20
#: Groups in which the best of a language are found before the groups are put together, so that no task has all.
GROUPS, FEWER = 256, 16
#: What a byte is: part of a word (0), between words (1) or between pieces (2).
KINDS = np.zeros(256, np.uint8)
KINDS[[0x20, 0x09]] = 1
KINDS[[*b".,;:!?", *range(0x0A, 0x0E)]] = 2
#: Odd multiplier that tells the rows' cells apart.
SECOND = np.uint64(0xC2B2AE3D27D4EB4F)


@dataclass(frozen=True)
class PhraseConfig:
    most_words: int = 3
    #: Least occurrences of a phrase.
    least: int = 10
    #: A phrase goes if a longer one that holds it occurs at least this many times in a hundred of its own.
    covered: int = 50
    #: Phrases returned of each language.
    top: int = 2000
    #: Rows of the sketch, and bounds of the cells of each, as powers of two; in between it is one for each 16 bytes of text.
    depth: int = 2
    least_bits: int = 20
    most_bits: int = 29
    #: Runs of words that a task gathers before it packs them.
    packed_runs: int = 4 << 20
    #: Bytes of text that a task of the second pass counts, where there is more than two tasks for each core: what is
    #: frequent is frequent in most tasks, so fewer tasks send fewer counts.
    task_bytes: int = 256 << 20


class Words(ByteRuns):
    """The words of a slice of texts, and the piece of each."""

    def __init__(self, text: pa.Array):
        super().__init__(text, KINDS == 0)
        self.piece = np.cumsum(KINDS[self.whole] == 2)[self.start] + self.text if len(self) else np.zeros(0, np.int64)

    def goes_on(self, at: np.ndarray, n: int) -> np.ndarray:
        """Whether the runs of n words from ``at`` on can be one word longer within their piece."""
        go = at + n < len(self)
        go[go] = self.piece[at[go]] == self.piece[at[go] + n]
        return go


def _languages(lang: pa.Array) -> tuple[np.ndarray, list[str], np.ndarray]:
    """(code of each row's language, languages, hash of each)"""
    coded = pc.fill_null(lang.cast(pa.string()), "und").dictionary_encode()
    names = coded.dictionary.to_pylist()
    seeds = np.array([xxhash.xxh64_intdigest(x) for x in names], np.uint64)
    return coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), names, seeds


def cells_of(keys: np.ndarray, row: int, bits: int) -> np.ndarray:
    return (keys if row == 0 else keys * (SECOND + np.uint64(2 * row))) >> np.uint64(64 - bits)


def _packed(keys: np.ndarray, bits: int, config: PhraseConfig) -> Iterator[tuple[int, int, bytes]]:
    """(row, segment, cells): of each cell the distance to the one before, and how often it occurs (up to the least count)."""
    pack = zstandard.ZstdCompressor(level=1).compress
    keys, times = np.unique(keys, return_counts=True)
    times = np.minimum(times, config.least).astype(np.uint8)
    for row in range(config.depth):
        cell = cells_of(keys, row, bits)
        order = np.argsort(cell, kind="stable") if row else slice(None)
        cell, n = cell[order].astype(np.int64), times[order]
        segment = cell >> SEGMENT
        edges = np.flatnonzero(np.diff(segment, prepend=-1, append=-1))
        for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            step = np.diff(cell[a:b], prepend=segment[a] << SEGMENT)
            yield row, int(segment[a]), pack(b"".join([*((step >> s & 255).astype(np.uint8).tobytes() for s in (0, 8, 16)), n[a:b].tobytes()]))


def _sketch(bits: int, config: PhraseConfig) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        for batch in slices(batches, "text"):
            words = Words(batch.column("text"))
            codes, _, seeds = _languages(batch.column("lang"))
            each, at = words.hashes(), np.arange(len(words))
            runs = each + seeds[codes][words.text]
            for n in range(1, config.most_words + 1):
                held.append(mixed(runs))
                go = words.goes_on(at, n)
                at, runs = at[go], longer_runs(runs[go], each[at[go] + n])
            if sum(map(len, held)) >= config.packed_runs:
                yield _batch(_packed(np.concatenate(held), bits, config))
                held = []
        if sum(map(len, held)):
            yield _batch(_packed(np.concatenate(held), bits, config))

    return run


def _batch(rows: Iterator[tuple[int, int, bytes]]) -> pa.RecordBatch:
    row, segment, cells = zip(*rows, strict=True)
    return pa.record_batch([pa.array(row, pa.int32()), pa.array(segment, pa.int32()), pa.array(cells, pa.binary())], names=["row", "segment", "cells"])


def _merge(config: PhraseConfig, size: int) -> Callable:
    """Sorted cells of segments to one bit a cell: whether it reached the least count. Holds one segment at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress
        at, count = None, np.zeros(0, np.int32)

        def done() -> pa.RecordBatch:
            bits = np.packbits(count >= config.least).tobytes()
            return pa.record_batch([pa.array([at[0]], pa.int32()), pa.array([at[1]], pa.int32()), pa.array([bits], pa.binary())], names=["row", "segment", "cells"])

        for batch in batches:
            for key, cells in zip(zip(batch.column("row").to_pylist(), batch.column("segment").to_pylist(), strict=True), batch.column("cells"), strict=True):
                if key != at:
                    if at is not None:
                        yield done()
                    at, count = key, np.zeros(size, np.int32)
                low, mid, high, n = np.frombuffer(unpack(cells.as_py()), np.uint8).reshape(4, -1).astype(np.int32)
                np.add.at(count, np.cumsum(low | mid << 8 | high << 16), n)
                np.minimum(count, config.least, out=count)
        if at is not None:
            yield done()

    return run


class Sketch:
    """One bit a cell; ``may`` never says no to a run of words that occurs often enough."""

    def __init__(self, bits: int, rows: list[np.ndarray], text_bytes: int):
        self.bits, self.rows, self.text_bytes = bits, rows, text_bytes

    def may(self, keys: np.ndarray) -> np.ndarray:
        found = np.ones(len(keys), bool)
        for row, bitmap in enumerate(self.rows):
            todo = np.flatnonzero(found)
            cell = cells_of(keys[todo], row, self.bits)
            found[todo] = (bitmap[(cell >> np.uint64(3)).astype(np.int64)] >> (np.uint64(7) - (cell & np.uint64(7))).astype(np.uint8)) & 1 == 1
        return found


def sketch(texts: DataFrame, config: PhraseConfig = PhraseConfig()) -> Sketch:
    """The merged sketch of texts (lang, text)."""
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = min(config.most_bits, max(config.least_bits, int(size // 16).bit_length()))
    packed = texts.mapInArrow(_sketch(bits, config), "row int, segment int, cells binary")
    dealt = packed.repartition(n_shuffle(texts.sparkSession), "row", "segment").sortWithinPartitions("row", "segment")
    merged = dealt.mapInArrow(_merge(config, 1 << min(SEGMENT, bits)), "row int, segment int, cells binary")
    rows = [np.zeros((1 << bits) // 8, np.uint8) for _ in range(config.depth)]
    width = (1 << min(SEGMENT, bits)) // 8
    for part in merged.toLocalIterator():  # bounded by most_bits
        rows[part.row][part.segment * width : (part.segment + 1) * width] = np.frombuffer(part.cells, np.uint8)
    return Sketch(bits, rows, size)


def _tallied(keys: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(a position of each distinct tuple of keys, how often it occurs); exact, however many distinct keys there are."""
    code = keys[0]
    for more in keys[1:]:
        _, code = np.unique(code, return_inverse=True)
        code = code * (int(more.max(initial=0)) + 1) + more
    _, first, n = np.unique(code, return_index=True, return_counts=True)
    return first, n


def _exact(shared, config: PhraseConfig) -> Callable:
    schema = pa.schema([("lang", pa.string()), ("words", pa.int32()), ("phrase", pa.string()), ("f", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: Sketch = shared.value
        for batch in slices(batches, "text"):
            words = Words(batch.column("text"))
            if not len(words):
                continue
            lang, names, seeds = _languages(batch.column("lang"))
            coded, each = words.encoded(), words.hashes()
            code, lang = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), lang[words.text]
            held = np.bincount(lang, minlength=len(names))
            some = np.flatnonzero(held)
            yield pa.record_batch([pa.array([names[x] for x in some]), pa.array(np.zeros(len(some), np.int32)), pa.array([""] * len(some)), pa.array(held[some])], schema=schema)
            at, runs = np.arange(len(words)), each + seeds[lang]
            for n in range(1, config.most_words + 1):
                good = known.may(mixed(runs))
                at, runs = at[good], runs[good]
                if len(at):
                    first, times = _tallied([lang[at], *(code[at + k] for k in range(n))])
                    parts = [coded.dictionary.take(pa.array(code[at[first] + k])) for k in range(n)]
                    phrase = pc.binary_join_element_wise(*parts, " ") if n > 1 else parts[0]
                    yield pa.record_batch([pa.array(names).take(pa.array(lang[at[first]])), pa.array(np.full(len(first), n, np.int32)), phrase, pa.array(times)], schema=schema)
                # a longer run's last part, which starts one word later, must have passed as well
                passed = np.zeros(len(words) + 1, bool)
                passed[at] = True
                go = words.goes_on(at, n) & passed[at + 1]
                at, runs = at[go], longer_runs(runs[go], each[at[go] + n])

    return run


def phrase_counts(docs: DataFrame, config: PhraseConfig = PhraseConfig()) -> DataFrame:
    """lang, words, phrase, f: how often each phrase of up to ``most_words`` words occurs, those of ``least`` times and more.

    A row with words 0 and an empty phrase tells how many words a language has. A null text is empty, a null lang ``und``.
    """
    texts = docs.select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    sc, known = docs.sparkSession.sparkContext, sketch(texts, config)
    shared = sc.broadcast(known)
    tasks = max(2 * sc.defaultParallelism, -(-known.text_bytes // config.task_bytes))
    rows = texts.coalesce(tasks).mapInArrow(_exact(shared, config), "lang string, words int, phrase string, f long")
    return rows.groupBy("lang", "words", "phrase").agg(F.sum("f").alias("f")).where((F.col("words") == 0) | (F.col("f") >= config.least))


def _scored(counts: DataFrame, config: PhraseConfig) -> DataFrame:
    """lang, phrase, a, l, r, score of the phrases of two words and more that no longer one covers."""
    phrases = counts.where("words >= 2").withColumnRenamed("f", "a")
    cut = phrases.withColumn("k", F.explode(F.expr("sequence(1, words - 1)")))
    cut = cut.withColumns({"left": F.expr("substring_index(phrase, ' ', k)"), "right": F.expr("substring_index(phrase, ' ', k - words)")})
    part = counts.where("words >= 1")
    lefts, rights = (part.select("lang", F.col("phrase").alias(side), F.col("f").alias(f)) for side, f in (("left", "l"), ("right", "r")))
    both = cut.join(lefts, ["lang", "left"]).join(rights, ["lang", "right"])
    a, l, r = (F.col(x).cast("decimal(16,0)") for x in "alr")  # noqa: E741
    score = both.withColumns({"over": F.lit(1_000_000).cast("decimal(7,0)") * (a * a), "under": l * r}).withColumn("score", F.expr("over div under"))
    best = score.groupBy("lang", "phrase", "words", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("x"))
    inner = F.expr("flatten(transform(sequence(2, words - 1), m -> transform(sequence(1, words - m + 1), i -> array_join(slice(split(phrase, ' '), i, m), ' '))))")
    longer = phrases.where("words > 2").withColumn("phrase", F.explode(inner)).groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    left = best.join(longer, ["lang", "phrase"], "left").where(F.coalesce(F.col("longer") * 100 < F.col("a") * config.covered, F.lit(True)))
    return left.select("lang", "phrase", "a", "x.l", "x.r", "x.score")


def collocations(docs: DataFrame, config: PhraseConfig = PhraseConfig()) -> DataFrame:
    """Each language's first phrases by score: lang, rank (from 1), phrase, a, l, r, n, score.

    A language is the value of ``lang``, ``und`` where it is null. Null and empty texts have no words; repeated rows
    count each; ids and further columns are not looked at. Ties are told apart by a, then by the phrase's bytes. An empty
    table, or one in which no phrase is frequent, gives no rows.
    """
    counts = Stored(phrase_counts(docs, config), "phrase-counts").df
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    rows = _scored(counts, config).withColumn("group", F.pmod(F.xxhash64("phrase"), F.lit(GROUPS)))
    for keys in (["lang", "group"], ["lang", F.col("group") % FEWER], ["lang"]):  # each step keeps ``top`` of a group
        rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= config.top)
    n = counts.where("words = 0").select("lang", F.col("f").alias("n"))
    return rows.join(n, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stored_alone(lambda: collocations(table(spark, sf_dir, "documents")), "phrases").df


ORACLE = r"""
WITH docs AS (
  SELECT coalesce(lang, 'und') AS lang,
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text
  FROM documents),
pieces AS (
  SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws
  FROM (SELECT lang, unnest(regexp_split_to_array(text, '[.,;:!?\x0A-\x0D]')) AS piece FROM docs)),
words AS (SELECT lang, count(*) AS n FROM (SELECT lang, unnest(ws) FROM pieces) GROUP BY lang),
runs AS (
  SELECT lang, n, array_to_string(ws[i : i + n - 1], ' ') AS phrase
  FROM (SELECT lang, ws, n, unnest(range(1, len(ws) - n + 2)) AS i FROM pieces, (VALUES (1), (2), (3)) t(n))),
f AS MATERIALIZED (SELECT lang, n, phrase, count(*) AS a FROM runs GROUP BY ALL HAVING count(*) >= 10),
cuts AS (
  SELECT *, array_to_string(string_split(phrase, ' ')[1 : k], ' ') AS lhs, array_to_string(string_split(phrase, ' ')[k + 1 :], ' ') AS rhs
  FROM (SELECT *, unnest(range(1, n)) AS k FROM f WHERE n >= 2)),
scores AS (
  SELECT c.lang, c.phrase, c.n AS size, c.a, c.k, x.a AS l, y.a AS r, (1000000::HUGEINT * c.a * c.a) // (x.a::HUGEINT * y.a) AS score
  FROM cuts c JOIN f x ON x.lang = c.lang AND x.phrase = c.lhs JOIN f y ON y.lang = c.lang AND y.phrase = c.rhs),
best AS (SELECT * FROM scores QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
longer AS (
  SELECT lang, phrase, max(a) AS a FROM (
    SELECT lang, unnest([array_to_string(string_split(phrase, ' ')[1 : 2], ' '), array_to_string(string_split(phrase, ' ')[2 : 3], ' ')]) AS phrase, a
    FROM f WHERE n = 3) GROUP BY ALL),
kept AS (
  SELECT b.* FROM best b LEFT JOIN longer g ON g.lang = b.lang AND g.phrase = b.phrase AND b.size = 2
  WHERE g.a IS NULL OR 100 * g.a < 50 * b.a)
SELECT k.lang, row_number() OVER (PARTITION BY k.lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, w.n, score::BIGINT AS score
FROM kept k JOIN words w ON w.lang = k.lang
QUALIFY row_number() OVER (PARTITION BY k.lang ORDER BY score DESC, a DESC, phrase) <= 2000
"""
