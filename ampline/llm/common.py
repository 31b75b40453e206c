"""Helpers that the corpus operators share: shared storage, bounded text slices, columnar words."""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextvars import ContextVar

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that a task turns into numpy arrays at once; a longer text is handled alone.
SLICE_BYTES = 4 << 20
#: Rows that a Python worker is sent at once, at most; texts are long, and Spark's default counts rows of numbers.
BATCH_ROWS = 2_000

_own_dir: dict[str, str] = {}
#: What the work that is under way has stored or kept so far, in stored_alone.
_made: ContextVar[list | None] = ContextVar("made", default=None)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``; where that is unset and all run in one process, one of our own."""
    given = spark.conf.get("spark.checkpoint.dir", None)
    if given:
        return given.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    app = spark.sparkContext.applicationId
    if app not in _own_dir:
        _own_dir[app] = "file://" + tempfile.mkdtemp(prefix="ampline-")
        spark.sparkContext.setCheckpointDir(_own_dir[app])
    return _own_dir[app]


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


class Stored:
    """A table written to the shared folder: its rows outlive the executors that made them, and the plan starts anew.

    It goes when ``drop`` is called; what a returned plan still reads goes when the driver ends.
    """

    def __init__(self, df: DataFrame, name: str):
        self.spark = df.sparkSession
        self.path = fresh_path(self.spark, name)
        df.write.parquet(self.path)
        at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
        at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at)
        self.df = self.spark.read.schema(df.schema).parquet(self.path)
        _note(self)

    def drop(self) -> None:
        remove(self.spark, self.path)


class Kept:
    """A small table kept on the executors' disks; what a lost executor held is made again from the plan above it."""

    def __init__(self, df: DataFrame):
        self.df = df.persist(StorageLevel.DISK_ONLY)
        _note(self)

    def drop(self) -> None:
        self.df.unpersist()


def _note(made: Stored | Kept) -> None:
    if (all_made := _made.get()) is not None:
        all_made.append(made)


def stored_alone(make: Callable[[], DataFrame], name: str) -> Stored:
    """What ``make`` returns, stored; all that was stored or kept on the way to it is dropped."""
    before = _made.set([])
    try:
        out = Stored(make(), name)
        for made in _made.get():
            if made is not out:
                made.drop()
    finally:
        _made.reset(before)
    _note(out)
    return out


def remove(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    with contextlib.suppress(Exception):  # a folder that is gone already is no loss
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def n_shuffle(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def small_batches(spark: SparkSession) -> None:
    """Keeps what JVM and Python hold of a table of texts at once small: for pipelines, whose workers go through many stages."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    given = int(spark.conf.get(key))
    if not 0 < given <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def release() -> None:
    """Gives back to the system what Arrow and the C library keep of freed memory, as Python workers outlive their tasks."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(AttributeError):  # not every C library has it
        ctypes.CDLL(None).malloc_trim(0)


def slices(batches: Iterator[pa.RecordBatch], column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cuts batches so that each holds about ``limit`` bytes of the text column; null texts become empty."""
    for batch in batches:
        if not batch.num_rows:
            continue
        i = batch.schema.get_field_index(column)
        text = pc.fill_null(batch.column(i).cast(pa.string()), "")
        batch = batch.set_column(i, column, text)
        ends = np.cumsum(pc.binary_length(text).to_numpy(zero_copy_only=False).astype(np.int64))
        start = 0
        while start < batch.num_rows:
            base = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, base + limit, side="right")))
            yield batch.slice(start, stop - start)
            start = stop
        del batch, text
        release()


def split_words(text: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """ASCII-white-space words of each text: (offsets of each text's words, code of each word, distinct words)."""
    split = pc.ascii_split_whitespace(text)
    flat = split.flatten().dictionary_encode()
    offsets = split.offsets.to_numpy().astype(np.int64)
    offsets -= offsets[0]
    codes = flat.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    if (empty := pc.index(flat.dictionary, "").as_py()) >= 0:  # before leading and after trailing white space
        keep = codes != empty
        offsets = np.concatenate(([0], np.cumsum(keep)))[offsets]
        codes = codes[keep]
    return offsets, codes, flat.dictionary


def words_of(text: pa.Array) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """As split_words, with the distinct words as a list."""
    offsets, codes, vocab = split_words(text)
    return offsets, codes, vocab.to_numpy(zero_copy_only=False).tolist()


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Positions start, start + 1, ... of every run, runs one after the other."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return np.repeat(starts - (ends - lengths), lengths) + np.arange(total)


def sums_between(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sum of values[offsets[i]:offsets[i + 1]] for each i; 0 where that is empty."""
    total = np.concatenate((np.zeros(1, values.dtype), np.cumsum(values)))
    return total[offsets[1:]] - total[offsets[:-1]]


#: Odd multipliers and random bytes of hash_runs.
_STEP, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
_BYTES = np.random.default_rng(13).integers(1, 2**63, 256, np.uint64)


def mixed(h: np.ndarray) -> np.ndarray:
    """Spreads 64-bit hashes."""
    h = (h ^ (h >> np.uint64(32))) * _MIX
    return h ^ (h >> np.uint64(29))


class ByteRuns:
    """Maximal runs of bytes of one kind within a text, A-Z lower-cased; bytes of kind 0 are in no run.

    ``data`` and ``offsets`` are the bytes of the runs, ``text`` is the row of each, ``start`` its place in ``whole``, the bytes of all rows.
    """

    def __init__(self, text: pa.Array, kinds: np.ndarray):
        low = pc.ascii_lower(text)
        at = np.frombuffer(low.buffers()[1], np.int32)[low.offset : low.offset + len(low) + 1].astype(np.int64)
        self.whole = np.frombuffer(low.buffers()[2], np.uint8)[at[0] : at[-1]] if low.buffers()[2] is not None else np.zeros(0, np.uint8)
        at -= at[0]
        kind = kinds[self.whole]
        inside = kind != 0
        first = inside.copy()
        first[1:] &= kind[1:] != kind[:-1]
        begin = at[:-1][at[:-1] < len(kind)]
        first[begin] = inside[begin]
        self.start = np.flatnonzero(first)
        self.data = self.whole[inside]
        self.offsets = np.append(np.cumsum(inside)[self.start] - 1, len(self.data)) if len(self.start) else np.zeros(1, np.int64)
        self.text = np.searchsorted(at, self.start, side="right") - 1

    def __len__(self) -> int:
        return len(self.start)

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each run's bytes."""
        if not len(self):
            return np.zeros(0, np.uint64)
        length = np.diff(self.offsets)
        power = np.cumprod(np.full(int(length.max()), _STEP, np.uint64))
        place = np.arange(len(self.data)) - np.repeat(self.offsets[:-1], length)
        return mixed(np.add.reduceat(_BYTES[self.data] * power[place], self.offsets[:-1]))

    def encoded(self) -> pa.DictionaryArray:
        buffers = [None, pa.py_buffer(self.offsets.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(self.data))]
        return pa.Array.from_buffers(pa.string(), len(self), buffers).dictionary_encode()


def longer_runs(hashes: np.ndarray, more: np.ndarray) -> np.ndarray:
    """Hashes of sequences that are one element longer."""
    return mixed(hashes * _STEP + more)


def fold(doc_id: str, n: int) -> F.Column:
    """crc32 of the id's decimal text modulo n; null ids fall in fold -1."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % n, F.lit(-1))
