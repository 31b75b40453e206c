"""Benchmark decontamination by q-gram lemma filtering and banded alignment.

Texts and benchmark items are lower-cased and white space is collapsed. An item, or each overlapping window of a long
one, may occur in a text with some edits. By the q-gram lemma, an occurrence of a window of m characters with at most k
edits shares at least m + 1 - q * (k + 1) q-grams with it, whose diagonals (text position less window position) differ
by k at most. So the q-grams of a text that the benchmark has are counted in diagonal bands that overlap by half, and
bands with enough of them are verified by banded alignment, all bands of a slice of text in step. A length of text
without enough q-grams of any window is passed over first. The text is neither shuffled nor cut.

Windows are eleven words long and start at every third word, or every 25 characters where words are long. So every passage of
13 words of an item, if these are 40 characters at least, and every passage of ``window + step`` characters holds a whole one.
Windows of the same content, such as those of a preamble that many items share, are one window with several owners. A window
that occurs without an edit is told by comparing bytes; alignment is for windows of items that no window found so. Items
too short for the lemma must occur exactly, with no letter or digit beside them.

The benchmark's windows are dealt out in blocks of bounded size; where there is more than one, a first pass holds all texts
against one bitmap of the whole benchmark's q-grams, and only texts with several of them close together are stored and
searched, block after block. So neither the driver nor an executor holds more than one block and that bitmap, and the corpus
is read as often for many blocks as for two. Characters are UTF-8 bytes.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ampline.llm.common import ByteRuns, Stored, longer_runs, n_shuffle, ragged, slices, table

BITMAP_BITS = 22
#: Pairs of a text's q-gram and a window that are counted at once, and bands that are aligned at once.
COUNTED, ALIGNED = 1 << 19, 1 << 12
#: Bytes of text that are searched at once; their hashes take sixteen times as much.
SEARCHED = 2 << 20
#: q-grams that every occurrence must share, and the most bits of the bitmap of a benchmark of several blocks (64 MB).
FEWEST, MOST_BITS, SEGMENT = 5, 29, 20
#: Letters, digits and bytes beyond ASCII.
WORD = np.zeros(256, bool)
WORD[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True


@dataclass(frozen=True)
class LeakConfig:
    q: int = 12
    #: Edits allowed, as a share of the window.
    edits: float = 0.06
    #: Longer items are cut into windows of ``words`` words, one at every ``every``-th word, of at least ``narrow`` and
    #: at most ``window`` characters, which start no more than ``step`` characters apart.
    words: int = 11
    every: int = 3
    narrow: int = 40
    window: int = 100
    step: int = 25
    #: Shorter items must occur exactly.
    least_chars: int = 30
    #: Characters of benchmark that are held at once.
    block_chars: int = 1 << 20


def normalised(text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of all texts, each text's offsets): lower case, one space for each run of white space."""
    low = pc.utf8_lower(text)
    lengths = pc.binary_length(low).to_numpy(zero_copy_only=False).astype(np.int64)
    at = np.frombuffer(low.buffers()[1], np.int32)[low.offset : low.offset + len(low) + 1].astype(np.int64)
    data = np.frombuffer(low.buffers()[2], np.uint8)[at[0] : at[-1]] if low.buffers()[2] is not None else np.zeros(0, np.uint8)
    white = (data == 32) | ((data >= 9) & (data <= 13))
    keep = np.ones(len(data), bool)
    keep[1:] = ~(white[1:] & white[:-1])
    out = np.where(white, np.uint8(32), data)[keep]
    return out, np.concatenate(([0], np.cumsum(keep)))[np.concatenate(([0], np.cumsum(lengths)))]


def _words64(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each position on, as an integer."""
    padded = np.concatenate((data, np.zeros(16, np.uint8)))
    out = np.empty(len(data) + 8, np.uint64)
    for i in range(8):
        part = padded[i:]
        view = part[: len(part) // 8 * 8].view("<u8")
        out[i::8][: len(view)] = view[: len(out[i::8])]
    return out[: len(data)]


def grams(data: np.ndarray, q: int) -> np.ndarray:
    """A 64-bit hash of the q (8 to 16) bytes from each position on."""
    n = max(0, len(data) - q + 1)
    whole = _words64(data)
    h = whole[:n] * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(32)
    h = (h ^ whole[q - 8 : q - 8 + n]) * np.uint64(0xC2B2AE3D27D4EB4F)
    return h ^ (h >> np.uint64(29))


def window_spans(data: np.ndarray, config: LeakConfig) -> list[tuple[int, int]]:
    """Where the windows of a normalised item start and end."""
    n, space = len(data), data == 32
    begin = np.flatnonzero(~space & np.append(True, space[:-1])) if n else np.zeros(0, np.int64)
    end = np.flatnonzero(~space & np.append(space[1:], True)) + 1 if n else begin
    if n <= config.window and len(begin) <= config.words:
        return [(0, n)]
    spans = set()
    for k in range(0, len(begin), config.every):
        start, after = int(begin[k]), int(begin[k + config.every]) if k + config.every < len(begin) else n
        last = int(end[k + config.words - 1]) if k + config.words <= len(begin) else n + 1
        stop = min(max(last, start + config.narrow), start + config.window)
        if stop <= n:
            spans.add((start, stop))
        spans.update((s, s + config.window) for s in range(start + config.step, min(after, n - config.window + 1), config.step))
    first = int(begin[-config.words]) if len(begin) >= config.words else 0
    spans.add((max(0, min(max(first, n - config.window), n - config.narrow)), n))
    return sorted(spans)


def budget(m: int, config: LeakConfig) -> int:
    """Edits that a window of m characters may have; few enough for the lemma to ask for FEWEST q-grams, or for what a short window has."""
    return min(int(m * config.edits), max((m + 1 - FEWEST) // config.q - 1, 0))


def windows_of(items: list[tuple[int, str | None]], config: LeakConfig) -> list[tuple[int, str]]:
    """(item, window) of all items in normalised form; items that are too short are a window each."""
    out = []
    for item, text in items:
        data, _ = normalised(pa.array([(text or "").strip()], pa.string()))
        if len(data) < max(config.least_chars, config.q):
            if WORD[data].any():
                out.append((item, data.tobytes()))
        else:
            out += [(item, data[a:b].tobytes()) for a, b in window_spans(data, config)]
    return out


class BenchmarkIndex:
    """Windows of benchmark items, the items that own each, and where each of their q-grams stands."""

    def __init__(self, windows: list[tuple[int, bytes]], config: LeakConfig):
        self.config, self._automaton = config, None
        q, place_of, owners, starts, sizes, texts, base = config.q, {}, [], [], [], [], 0
        self.short: dict[bytes, set[int]] = {}
        for item, part in windows:
            if len(part) < max(config.least_chars, q):
                self.short.setdefault(part, set()).add(item)
                continue
            if part not in place_of:
                place_of[part] = len(owners)
                owners.append(set())
                starts.append(base)
                sizes.append(len(part))
                texts.append(np.frombuffer(part, np.uint8))
                base += len(part)
            owners[place_of[part]].add(item)
        self.size = np.array(sizes, np.int64)
        self.edits = np.array([budget(m, config) for m in sizes], np.int64)
        self.needed = np.maximum(self.size + 1 - q * (self.edits + 1), 1)
        self.n_owners = np.array([len(x) for x in owners], np.int64)
        self.first_owner = np.cumsum(self.n_owners) - self.n_owners
        self.owner = np.array([i for x in owners for i in sorted(x)], np.int64)
        flat = np.concatenate(texts) if texts else np.zeros(0, np.uint8)
        begin = np.array(starts, np.int64)
        self.pattern = np.zeros((len(sizes), int(self.size.max(initial=0))), np.uint8)
        for k, (s, m) in enumerate(zip(starts, sizes, strict=True)):
            self.pattern[k, :m] = flat[s : s + m]
        each = np.maximum(self.size - q + 1, 0)
        at = ragged(begin, each)
        gram, window = grams(flat, q)[at], np.repeat(np.arange(len(sizes), dtype=np.int32), each)
        place = (at - np.repeat(begin, each)).astype(np.int32)
        order = np.argsort(gram, kind="stable")
        self.keys, first = np.unique(gram[order], return_index=True)
        self.first = np.append(first, len(gram))
        self.window, self.place = window[order], place[order]
        self.bitmap = np.zeros(1 << BITMAP_BITS, bool)
        self.bitmap[(self.keys >> np.uint64(64 - BITMAP_BITS)).astype(np.int64)] = True

    def hits(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(position, key index) of the text's q-grams that the benchmark has."""
        h = grams(data, self.config.q)
        at = np.flatnonzero(self.bitmap[(h >> np.uint64(64 - BITMAP_BITS)).astype(np.int64)])
        key = np.minimum(np.searchsorted(self.keys, h[at]), len(self.keys) - 1)
        same = self.keys[key] == h[at]
        return at[same], key[same]

    def bands(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Rows (text, window, first diagonal in that text) of the bands with enough q-grams, each once."""
        at, key = self.hits(data)
        # a hit counts if some window's needed number of hits, this one among them, lies within reach
        few, reach = int(self.needed.min()), int((self.size + self.edits).max())
        if len(at) < few:
            return np.zeros((0, 3), np.int64)
        dense = np.flatnonzero(at[few - 1 :] - at[: len(at) - few + 1] <= reach)
        marks = np.zeros(len(at) + 1, np.int64)
        np.add.at(marks, dense, 1)
        np.add.at(marks, dense + few, -1)
        kept = np.cumsum(marks[:-1]) > 0
        at, key = at[kept], key[kept]
        doc = np.searchsorted(offsets, at, side="right") - 1
        inside = at + self.config.q <= offsets[doc + 1]
        at, key, doc = at[inside], key[inside], doc[inside]
        # texts are moved apart, so that no band holds hits of two
        apart = 4 * reach
        at = at + doc * apart
        counts = self.first[key + 1] - self.first[key]
        total = np.concatenate(([0], np.cumsum(counts)))
        found, start = [np.zeros((0, 3), np.int64)], 0
        while start < len(at):
            # pieces of bounded work that overlap by the reach of a window, so that each occurrence lies in one whole
            stop = max(int(np.searchsorted(total, total[start] + COUNTED, side="right")) - 1, int(np.searchsorted(at, at[start] + 2 * reach, side="right")))
            found.append(self._counted(at[start:stop], key[start:stop], doc[start:stop], counts[start:stop], apart))
            if stop >= len(at):
                break
            start = int(np.searchsorted(at, at[stop] - reach))
        cells = np.concatenate(found)
        cells[:, 2] -= offsets[cells[:, 0]]
        return np.unique(cells, axis=0)

    def _counted(self, at: np.ndarray, key: np.ndarray, doc: np.ndarray, counts: np.ndarray, apart: int) -> np.ndarray:
        post = ragged(self.first[key], counts)
        window, doc = self.window[post].astype(np.int64), np.repeat(doc, counts)
        diagonal = np.repeat(at, counts) - self.place[post] + apart  # not below 0
        half = self.edits[window] + 1
        found = []
        for shift in (0, 1):
            band = (diagonal + shift * half) // (2 * half)
            cells, one, n = np.unique(window << 36 | band, return_index=True, return_counts=True)
            good = n >= self.needed[cells >> 36]
            w, d = cells[good] >> 36, doc[one[good]]
            h = self.edits[w] + 1
            found.append(np.stack([d, w, (cells[good] & ((1 << 36) - 1)) * 2 * h - shift * h - apart - d * apart], axis=1))
        return np.concatenate(found)

    def aligned(self, data: np.ndarray, offsets: np.ndarray, cells: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start in the text, end, edits) of the closest occurrence on diagonals near each band.

        Row i of the table holds, for each diagonal, the least edits that match the window's first i characters so that
        the text part ends there; the part may start anywhere in the band. What lies outside of the text matches nothing.
        """
        doc, window, low = cells.T
        m, lanes, steps = self.size[window], self._lanes(window), int(self.size[window[0]])  # longest first
        begin, n, text = self._around(data, offsets, cells, lanes, steps)
        pattern, lane = self.pattern[window], np.arange(lanes, dtype=np.int32)
        cost = np.zeros((len(cells), lanes), np.int32)
        start = np.broadcast_to(lane, cost.shape).copy()
        live = np.searchsorted(-m, -np.arange(steps), side="left")
        for i, c in enumerate(live.tolist()):
            now, from_ = cost[:c], start[:c]
            same = now + (text[:c, i : i + lanes] != pattern[:c, i : i + 1])  # one character of each
            drop = np.full_like(now, 1 << 20)  # a character of the window is missing
            drop[:, :-1] = now[:, 1:] + 1
            dropped = np.roll(from_, -1, axis=1)
            less = drop < same
            now, from_ = np.where(less, drop, same), np.where(less, dropped, from_)
            level = now - lane  # then characters that only the text has
            least = np.minimum.accumulate(level, axis=1)
            origin = np.maximum.accumulate(np.where(level <= least, lane, 0), axis=1)
            cost[:c], start[:c] = least + lane, np.take_along_axis(from_, origin, axis=1)
        best = cost.argmin(1)
        row = np.arange(len(cells))
        return np.clip(begin + start[row, best], 0, n), np.clip(begin + best + m, 0, n), cost[row, best]

    def _lanes(self, window: np.ndarray) -> int:
        return 4 * int(self.edits[window].max()) + 5

    def _around(self, data: np.ndarray, offsets: np.ndarray, cells: np.ndarray, lanes: int, steps: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(first place read for each cell, length of its text, what is read there; 255 outside of the text)"""
        doc, window, low = cells.T
        begin, n = low - self.edits[window] - 1, offsets[doc + 1] - offsets[doc]
        reads = begin[:, None] + np.arange(lanes + steps)
        ok = (reads >= 0) & (reads < n[:, None])
        return begin, n, np.where(ok, data[np.clip(offsets[doc][:, None] + reads, 0, len(data) - 1)], np.uint8(255))

    def equal(self, data: np.ndarray, offsets: np.ndarray, cells: np.ndarray) -> np.ndarray:
        """Where each cell's window stands near its band without an edit, the first place; -1 if nowhere."""
        window = cells[:, 1]
        lanes, steps = self._lanes(window), int(self.size[window].max())
        begin, _, text = self._around(data, offsets, cells, lanes, steps)
        pattern = self.pattern[window]
        beyond = np.arange(pattern.shape[1]) >= self.size[window][:, None]
        out = np.full(len(cells), -1)
        for lane in range(lanes - 1, -1, -1):
            same = ((text[:, lane : lane + steps] == pattern[:, :steps]) | beyond[:, :steps]).all(1)
            out[same] = begin[same] + lane
        return out

    def _owned(self, cells: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(cell, item) of the items that own each cell's window."""
        many = self.n_owners[cells[:, 1]]
        return np.repeat(np.arange(len(cells)), many), self.owner[ragged(self.first_owner[cells[:, 1]], many)]

    def find(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Rows (text, item, start, end, edits) of the closest passage of each item in each text, by text and item; positions in the normalised text."""
        rows = [np.zeros((0, 5), np.int64)]
        if len(self.keys) and len(data):
            cells = self.bands(data, offsets)
            cells = cells[np.argsort(-self.size[cells[:, 1]], kind="stable")]
            at = np.concatenate([np.zeros(0, np.int64), *(self.equal(data, offsets, cells[k : k + ALIGNED]) for k in range(0, len(cells), ALIGNED))])
            cell, item = self._owned(cells[at >= 0])
            doc, begin, size = cells[at >= 0][cell, 0], at[at >= 0][cell], self.size[cells[at >= 0][cell, 1]]
            rows.append(np.stack([doc, item, begin, begin + size, np.zeros_like(doc)], axis=1))
            # nothing is closer than that: windows are left whose items are not all found in their text
            found = set(zip(doc.tolist(), item.tolist(), strict=True))
            rest = cells[at < 0]
            cell, item = self._owned(rest)
            new = np.array([pair not in found for pair in zip(rest[cell, 0].tolist(), item.tolist(), strict=True)], bool)
            rest = rest[np.unique(cell[new])]
            for k in range(0, len(rest), ALIGNED):
                part = rest[k : k + ALIGNED]
                start, end, edits = self.aligned(data, offsets, part)
                good = edits <= self.edits[part[:, 1]]
                each, item = self._owned(part[good])
                rows.append(np.stack([part[good][each, 0], item, start[good][each], end[good][each], edits[good][each]], axis=1))
        if self.short and len(data):
            rows.append(self._exact(data, offsets))
        found = np.concatenate(rows)
        found = found[np.lexsort((found[:, 2], found[:, 4], found[:, 1], found[:, 0]))]
        first = np.ones(len(found), bool)
        first[1:] = (found[1:, :2] != found[:-1, :2]).any(1)
        return found[first]

    def _exact(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Occurrences of short items that have no letter or digit beside them."""
        import ahocorasick

        if self._automaton is None:
            self._automaton = ahocorasick.Automaton()
            for text, items in self.short.items():
                self._automaton.add_word(text.decode("latin-1"), (len(text), items))  # a character for each byte
            self._automaton.make_automaton()
        rows = []
        for doc, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)):
            part = data[a:b]
            seen: set[int] = set()
            for last, (size, items) in self._automaton.iter(part.tobytes().decode("latin-1")):
                start, end = last + 1 - size, last + 1
                # an item's own edge may be a sign; then what is beside it doesn't matter
                if (start and WORD[part[start]] and WORD[part[start - 1]]) or (end < b - a and WORD[part[last]] and WORD[part[end]]):
                    continue
                rows += [(doc, item, start, end, 0) for item in items - seen]
                seen |= items
        return np.array(rows, np.int64).reshape(-1, 5)

    def __getstate__(self) -> dict:
        return {**self.__dict__, "_automaton": None}


def _find(index) -> Callable:
    names = ["id", "item_id", "start", "end", "edits"]

    def run(batches):
        for batch in slices(batches, "text", SEARCHED):
            rows = index.value.find(*normalised(batch.column("text")))
            if len(rows):
                yield pa.record_batch([batch.column("id").take(pa.array(rows[:, 0])), *(pa.array(x) for x in rows[:, 1:].T)], names=names)

    return run


def _flag(index, column: str) -> Callable:
    def run(batches):
        for batch in slices(batches, "text", SEARCHED):
            rows = index.value.find(*normalised(batch.column("text")))
            ends = np.searchsorted(rows[:, 0], np.arange(batch.num_rows + 1))
            items = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(rows[:, 1]))
            yield batch.set_column(batch.schema.get_field_index(column), column, items)

    return run


def _cut(config: LeakConfig) -> Callable:
    def run(batches):
        for batch in slices(batches, "text", SEARCHED):
            found = windows_of(list(zip(batch.column("item_id").to_pylist(), batch.column("text").to_pylist(), strict=True)), config)
            yield pa.record_batch([pa.array([i for i, _ in found], pa.int64()), pa.array([w for _, w in found], pa.binary())], names=["item_id", "part"])

    return run


def cut_windows(benchmark: DataFrame, config: LeakConfig) -> tuple[DataFrame, int]:
    """(item_id, part, block): windows of all items, those of one content in one block; and the number of blocks of about block_chars."""
    given = benchmark.where("item_id is not null and text is not null")
    plain = given.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    cut = plain.mapInArrow(_cut(config), "item_id long, part binary").distinct()
    total = cut.agg(F.sum(F.octet_length("part"))).first()[0] or 0
    n = max(1, -(-total // config.block_chars))
    return cut.withColumn("block", F.pmod(F.xxhash64("part"), F.lit(n))), n


def index_block(cut: DataFrame, block: int, config: LeakConfig) -> BenchmarkIndex:
    """The index of one block, about config.block_chars characters."""
    rows = cut.where(F.col("block") == block).select("item_id", "part").collect()
    return BenchmarkIndex(sorted((x.item_id, bytes(x.part)) for x in rows), config)


def _word_runs(text: pa.Array) -> tuple[ByteRuns, list[np.ndarray], list[np.ndarray]]:
    """(words, places and hashes of runs of 1, 2, ... words within a text) as many as a short item may have."""
    runs = ByteRuns(pc.utf8_lower(text), WORD)
    each, at = runs.hashes(), np.arange(len(runs))
    places, hashes, now = [], [], each
    for n in range(1, 17):
        places.append(at)
        hashes.append(longer_runs(now, np.uint64(n)))
        go = at + n < len(runs)
        go[go] = runs.text[at[go]] == runs.text[at[go] + n]
        at, now = at[go], longer_runs(now[go], each[at[go] + n])
    return runs, places, hashes


def _bits(config: LeakConfig, bits: int) -> Callable:
    """Bits of the q-grams of windows and of the words of short items, by segment."""

    def run(batches):
        for batch in batches:
            held = [np.zeros(0, np.uint64)]
            for part in batch.column("part").to_pylist():
                if len(part) >= max(config.least_chars, config.q):
                    held.append(grams(np.frombuffer(part, np.uint8), config.q))
                else:
                    runs, _, hashes = _word_runs(pa.array([part.decode()]))
                    held.append(hashes[len(runs) - 1][:1])
            cell = np.unique((np.concatenate(held) >> np.uint64(64 - bits)).astype(np.int64))
            for segment in np.unique(cell >> SEGMENT).tolist():
                mine = np.zeros(1 << SEGMENT, bool)
                mine[cell[cell >> SEGMENT == segment] & (1 << SEGMENT) - 1] = True
                yield pa.record_batch([pa.array([segment], pa.int32()), pa.array([np.packbits(mine).tobytes()], pa.binary())], names=["segment", "bits"])

    return run


def _either(batches):
    at, held = None, np.zeros(0, np.uint8)
    for batch in batches:
        for segment, bits in zip(batch.column("segment").to_pylist(), batch.column("bits"), strict=True):
            part = np.frombuffer(bits.as_py(), np.uint8)
            if segment != at and at is not None:
                yield pa.record_batch([pa.array([at], pa.int32()), pa.array([held.tobytes()], pa.binary())], names=["segment", "bits"])
            at, held = segment, held | part if segment == at else part
    if at is not None:
        yield pa.record_batch([pa.array([at], pa.int32()), pa.array([held.tobytes()], pa.binary())], names=["segment", "bits"])


def benchmark_bitmap(cut: DataFrame, n: int, config: LeakConfig) -> np.ndarray:
    """A bit for each q-gram of the benchmark, about one in eight set, or more beyond MOST_BITS; merged by segment, with a bounded size."""
    bits = min(MOST_BITS, max(SEGMENT, (8 * n * config.block_chars).bit_length()))
    schema = "segment int, bits binary"
    parts = cut.select("part").mapInArrow(_bits(config, bits), schema)
    merged = parts.repartition(n_shuffle(cut.sparkSession), "segment").sortWithinPartitions("segment").mapInArrow(_either, schema)
    out = np.zeros((1 << bits) // 8, np.uint8)
    width = (1 << SEGMENT) // 8
    for r in merged.toLocalIterator():
        out[r.segment * width : (r.segment + 1) * width] = np.frombuffer(r.bits, np.uint8)
    return out


def _possible(bitmap, config: LeakConfig) -> Callable:
    """Keeps rows whose text has FEWEST q-grams of the benchmark within a window's reach, or the words of a short item."""
    reach = config.window + budget(config.window, config)

    def known(h: np.ndarray) -> np.ndarray:
        bits = bitmap.value
        cell = h >> np.uint64(64 - (len(bits) * 8).bit_length() + 1)
        return (bits[(cell >> np.uint64(3)).astype(np.int64)] >> (np.uint64(7) - (cell & np.uint64(7))).astype(np.uint8)) & 1 == 1

    def run(batches):
        for batch in slices(batches, "text", SEARCHED):
            data, offsets = normalised(batch.column("text"))
            keep = np.zeros(batch.num_rows, bool)
            at = np.flatnonzero(known(grams(data, config.q)))
            doc = np.searchsorted(offsets, at, side="right") - 1
            close = (at[FEWEST - 1 :] - at[: max(0, len(at) - FEWEST + 1)] <= reach) & (doc[FEWEST - 1 :] == doc[: max(0, len(at) - FEWEST + 1)])
            keep[doc[FEWEST - 1 :][close]] = True
            runs, places, hashes = _word_runs(batch.column("text"))
            for place, h in zip(places, hashes, strict=True):
                keep[runs.text[place[known(h)]]] = True
            yield batch.filter(pa.array(keep))

    return run


def _leaks(texts: DataFrame, cut: DataFrame, n: int, config: LeakConfig) -> DataFrame:
    """find's rows for texts (id, text); of several blocks each is searched, in the texts that a first pass leaves, and its rows are stored before the next."""
    sc, found = texts.sparkSession.sparkContext, []
    schema = f"id {texts.schema['id'].dataType.simpleString()}, item_id long, start long, end long, edits long"
    if n == 1:
        return texts.mapInArrow(_find(sc.broadcast(index_block(cut, 0, config))), schema)
    cut = Stored(cut, "leak-windows").df
    bitmap = sc.broadcast(benchmark_bitmap(cut, n, config))
    left = Stored(texts.mapInArrow(_possible(bitmap, config), texts.schema), "leak-texts").df
    bitmap.destroy()
    for k in range(n):
        index = sc.broadcast(index_block(cut, k, config))
        found.append(Stored(left.mapInArrow(_find(index), schema), "leaks").df)
        index.destroy()
    best = F.min_by(F.struct("start", "end", "edits"), F.struct("edits", "start")).alias("x")
    return reduce(DataFrame.unionByName, found).groupBy("id", "item_id").agg(best).select("id", "item_id", "x.*")


def flag_leaks(docs: DataFrame, benchmark: DataFrame, config: LeakConfig = LeakConfig(), column: str = "leaked_items") -> DataFrame:
    """``docs`` with leaked_items (or ``column``): the sorted ids of the benchmark items of which the text holds a passage; often empty.

    Null and empty texts hold none. Null and empty items, and short ones without a letter or digit, are left out; with an
    empty benchmark nothing is found. Items that repeat an id are one item. Columns and repeated rows of docs stay as they
    are; a column of docs that is called as the new one is replaced. An empty table gives no rows.
    """
    out = docs.drop(column)
    cut, n = cut_windows(benchmark, config)
    if n == 1:
        index = docs.sparkSession.sparkContext.broadcast(index_block(cut, 0, config))
        plain = out.withColumn("text", F.col("text").cast("string")).withColumn("ampline_text_is_null", F.col("text").isNull())
        plain = plain.withColumn(column, F.array().cast("array<long>"))
        made = plain.mapInArrow(_flag(index, column), plain.schema)
        return made.withColumn("text", F.when(~F.col("ampline_text_is_null"), F.col("text"))).select(*out.columns, column)
    # what a text holds depends on the text alone, so texts are told apart by digest, and no copy of the table is stored
    digest = F.sha2(F.coalesce(F.col("text").cast("string"), F.lit("")), 256)
    some = out.select(digest.alias("id"), F.col("text").cast("string").alias("text"))
    leaks = _leaks(some, cut, n, config)
    items = leaks.groupBy(F.col("id").alias("ampline_text")).agg(F.sort_array(F.collect_set("item_id")).alias(column))
    empty = F.array().cast("array<long>")
    keyed = out.withColumn("ampline_text", digest)
    return keyed.join(items, "ampline_text", "left").withColumn(column, F.coalesce(column, empty)).select(*out.columns, column)


def find_leaks(docs: DataFrame, benchmark: DataFrame, config: LeakConfig = LeakConfig()) -> DataFrame:
    """A row per document and item: doc_id, item_id, start, end and edits of the closest passage in the normalised text, the first of equals."""
    cut, n = cut_windows(benchmark, config)
    texts = docs.select(F.col("doc_id").cast("long").alias("id"), "text")
    return _leaks(texts, cut, n, config).withColumnRenamed("id", "doc_id")


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    flagged = flag_leaks(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return flagged.select("doc_id", (F.size("leaked_items") > 0).alias("contaminated"), "leaked_items")
