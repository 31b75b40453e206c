"""Token-ID output: flat files of unsigned integers with 64-bit offsets, read back through memory maps.

Texts are range-partitioned by id; each task writes one shard, ``ids`` (the token ids of its texts, one after the
other, 16 bits wide where the vocabulary allows) and ``idx`` (for each text an 8-byte end offset in ids, its doc_id and
a null mark). Shard sizes, one row a shard, give each shard's base as a prefix sum; so no text, id list or
offset passes the driver. A task names its files after its attempt, and the manifest takes the names that committed
tasks return, so a lost executor leaves at most an orphan file.
"""

from __future__ import annotations

import json
import os
import re
import uuid
import zlib
from collections.abc import Callable
from functools import lru_cache
from itertools import accumulate

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ampline.llm.common import fresh_path, n_shuffle, ragged, slices, split_words, table

END_ID = 2
#: Distinct pieces whose ids a task keeps; beyond that it starts afresh, with the same results.
CACHED_PIECES = 200_000
#: Bytes of text that are encoded at once.
ENCODED_BYTES = 4 << 20

#: Words that the tokenizer's normaliser only lower-cases and its splitter cuts only between letters and marks.
_PLAIN = r"^(?P<letters>[A-Za-zÀ-ÖØ-öø-ÿ]*)(?P<marks>[!-&(-/:-@\[-`{-~]*)$"
#: Pieces that are encoded as one text.
_JOINED = 4096


def public_tokenizer(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@lru_cache(maxsize=2)
def _encoder(path: str) -> WordEncoder:
    return WordEncoder(path)


class WordEncoder:
    """Ids of words, put together from the ids of pieces; each distinct piece is encoded once.

    The tokenizer's normaliser and splitter never look past white space, so a text's ids are its words' ids one
    after the other. A plain word is two pieces, its letters in lower case and its marks; any other word is one. Many
    pieces are encoded as one text: plain ones without normaliser and splitter, told apart by the ids that end a word;
    others with a special token between them.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        kinds = json.dumps([spec.get("normalizer"), spec.get("pre_tokenizer")])
        suffix = spec["model"].get("end_of_word_suffix")
        apart = [t for t in spec["added_tokens"] if t["special"] and not (t["normalized"] or t["single_word"] or t["lstrip"] or t["rstrip"])]
        self.by_word = '"invert": true' in kinds and "\\\\s\\\\p{L}" in kinds and bool(suffix) and bool(apart)
        self.tokenizer = Tokenizer.from_file(path)
        self.wide = self.tokenizer.get_vocab_size() > 1 << 16
        if self.by_word:
            self.between, self.specials = apart[-1], [t["content"] for t in spec["added_tokens"]]
            self.bare = Tokenizer.from_file(path)
            self.bare.normalizer = normalizers.Sequence([])
            self.bare.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
            self.last = np.zeros(self.tokenizer.get_vocab_size(), bool)
            self.last[[k for t, k in self.tokenizer.get_vocab().items() if t.endswith(suffix)]] = True
        self.clear()

    def clear(self) -> None:
        self.place = {"": 0}
        self.flat = np.zeros(0, np.uint32)
        self.starts = np.zeros(1, np.int64)
        self.lengths = np.zeros(1, np.int64)

    def _joined(self, tokenizer, words: list[str], between: str) -> np.ndarray:
        texts = [between.join(words[k : k + _JOINED]) + between for k in range(0, len(words), _JOINED)]
        return np.concatenate([np.zeros(0, np.uint32), *(np.array(x.ids, np.uint32) for x in tokenizer.encode_batch_fast(texts, add_special_tokens=False))])

    def _plain(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        ids = self._joined(self.bare, pieces, " ")
        ends = np.flatnonzero(self.last[ids])
        assert len(ends) == len(pieces)
        return ids, np.diff(ends, prepend=-1)

    def _other(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        alone = {k for k, w in enumerate(words) if any(x in w for x in self.specials)}
        ids = self._joined(self.tokenizer, ["" if k in alone else w for k, w in enumerate(words)], self.between["content"])
        marks = np.flatnonzero(ids == self.between["id"])
        assert len(marks) == len(words)
        lengths = np.diff(marks, prepend=-1) - 1
        parts = np.split(np.delete(ids, marks), np.cumsum(lengths)[:-1]) if words else []
        for k in alone:
            parts[k] = np.array(self.tokenizer.encode(words[k], add_special_tokens=False).ids, np.uint32)
            lengths[k] = len(parts[k])
        return np.concatenate([np.zeros(0, np.uint32), *parts]), lengths

    def _places(self, pieces: pa.Array, encode: Callable) -> np.ndarray:
        """The place of each piece; new ones are encoded. The empty piece is at place 0."""
        coded = pieces.dictionary_encode()
        known = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        new = [x for x in known if x not in self.place]
        if new:
            n = len(self.place)
            self.place.update(zip(new, range(n, n + len(new)), strict=True))
            ids, lengths = encode(new)
            self.starts = np.concatenate((self.starts, len(self.flat) + np.cumsum(lengths) - lengths))
            self.lengths = np.concatenate((self.lengths, lengths))
            self.flat = np.concatenate((self.flat, ids))
        at = np.fromiter(map(self.place.__getitem__, known), np.int64, len(known))
        return at[coded.indices.to_numpy(zero_copy_only=False)] if len(known) else np.zeros(0, np.int64)

    def words(self, vocab: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids of all words, one word after the other; where each word's ids start; how many they are)"""
        if len(self.place) > CACHED_PIECES:
            self.clear()
        cut = pc.extract_regex(vocab, _PLAIN)
        plain = cut.is_valid().to_numpy(zero_copy_only=False)
        pieces = np.zeros((len(vocab), 2), np.int64)
        some = cut.drop_null()
        pieces[plain, 0] = self._places(pc.utf8_lower(pc.struct_field(some, "letters")), self._plain)
        pieces[plain, 1] = self._places(pc.struct_field(some, "marks"), self._plain)
        pieces[~plain, 0] = self._places(vocab.filter(pa.array(~plain)), self._other)
        sizes = self.lengths[pieces]
        flat = self.flat[ragged(self.starts[pieces.ravel()], sizes.ravel())]
        lengths = sizes.sum(1)
        return flat, np.cumsum(lengths) - lengths, lengths

    def encode(self, text: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, each ended by end_id; number of ids of each text)"""
        if not self.by_word:
            lists = [[*x.ids, end_id] for x in self.tokenizer.encode_batch_fast(text.to_pylist(), add_special_tokens=False)]
            return np.fromiter((i for x in lists for i in x), np.uint32), np.fromiter(map(len, lists), np.int64, len(lists))
        offsets, codes, vocab = split_words(text)
        flat, starts, lengths = self.words(vocab)
        sizes = lengths[codes]
        ends = np.concatenate(([0], np.cumsum(sizes)))[offsets[1:]]
        counts = np.diff(ends, prepend=0) + 1
        out = np.full(int(counts.sum()), end_id, np.uint32)
        body = np.ones(len(out), bool)
        body[np.cumsum(counts) - 1] = False
        out[body] = flat[ragged(starts[codes], sizes)]
        return out, counts


def _write(root: str, tokenizer: str, end_id: int) -> Callable:
    schema = pa.schema([("shard", pa.int64()), ("file", pa.string()), ("n_docs", pa.int64()), ("n_ids", pa.int64())])

    def run(batches):
        shard, encoder = TaskContext.get().partitionId(), _encoder(tokenizer)
        kind = np.dtype("<u4" if encoder.wide else "<u2")
        name = f"shard-{shard:06d}-{uuid.uuid4().hex}"
        fs, at = pafs.FileSystem.from_uri(root)
        counts, ids, nulls = [], [], []
        with fs.open_output_stream(f"{at}/{name}.ids") as out:
            for batch in slices(batches, "text", ENCODED_BYTES):
                flat, n = encoder.encode(batch.column("text"), end_id)
                out.write(flat.astype(kind).tobytes())
                doc = batch.column("doc_id")
                counts.append(n)
                nulls.append(doc.is_null().to_numpy(zero_copy_only=False))
                ids.append(doc.fill_null(0).to_numpy())
        encoder.clear()
        if not counts:
            fs.delete_file(f"{at}/{name}.ids")
            return
        rows = np.rec.fromarrays([np.cumsum(np.concatenate(counts)), np.concatenate(ids), np.concatenate(nulls)], dtype=INDEX)
        with fs.open_output_stream(f"{at}/{name}.idx") as out:
            out.write(rows.tobytes())
        yield pa.record_batch([[shard], [name], [len(rows)], [int(rows.end[-1])]], schema=schema)

    return run


#: A row of an idx file: ids of the shard up to and with this text, its doc_id, and whether that was null.
INDEX = np.dtype([("end", "<u8"), ("doc_id", "<i8"), ("is_null", "?")])


def write_token_files(docs: DataFrame, root: str, tokenizer: str | None = None, end_id: int = END_ID) -> list[dict]:
    """Writes ``docs`` (doc_id, text) under ``root`` in ascending doc_id order; returns the manifest, one entry a shard."""
    spark, path = docs.sparkSession, tokenizer or public_tokenizer()
    order = ["doc_id", "key", "row"]  # an id or a text that repeats any number of times is dealt out too
    texts = docs.selectExpr("cast(doc_id as long) doc_id", "text").withColumns({"key": F.xxhash64("text"), "row": F.monotonically_increasing_id()})
    ordered = texts.repartitionByRange(n_shuffle(spark), *order).sortWithinPartitions(*order).select("doc_id", "text")
    where = _made(spark, root)
    shards = sorted(map(tuple, ordered.mapInArrow(_write(where, path, end_id), "shard long, file string, n_docs long, n_ids long").collect()))
    bases = [0, *accumulate(x[3] for x in shards)]
    return [{"file": f"{where}/{x[1]}", "n_docs": x[2], "n_ids": x[3], "base": b, "bits": 32 if _encoder(path).wide else 16} for x, b in zip(shards, bases, strict=False)]


def _made(spark: SparkSession, root: str) -> str:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).mkdirs(at)
    return root if "://" in root else f"file://{root}" if root.startswith("/") else re.sub("^file:/+", "file:///", root)


def _mapped(fs: pafs.FileSystem, at: str, kind: np.dtype) -> np.ndarray:
    """A memory map of a local file; where the store isn't local, the bytes as Arrow's buffer."""
    if isinstance(fs, pafs.LocalFileSystem):
        with pa.memory_map(at) as f:
            return np.frombuffer(f.read_buffer(), kind)
    with fs.open_input_file(at) as f:
        return np.frombuffer(f.read_buffer(), kind)


def _read(batches):
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])
    for batch in batches:
        for x in batch.to_pylist():
            fs, at = pafs.FileSystem.from_uri(x["file"])
            rows, flat = _mapped(fs, f"{at}.idx", INDEX), _mapped(fs, f"{at}.ids", np.dtype("<u2" if x["bits"] == 16 else "<u4"))
            ends = rows["end"].astype(np.int64)
            starts = np.concatenate(([0], ends[:-1]))
            for k in range(0, len(rows), 4096):
                part = slice(k, k + 4096)
                crc = [zlib.crc32(flat[a:b].astype("<u4").tobytes()) for a, b in zip(starts[part], ends[part], strict=True)]
                ids = pa.array(rows["doc_id"][part], mask=rows["is_null"][part])
                yield pa.record_batch([ids, pa.array(starts[part] + x["base"]), pa.array(ends[part] - starts[part]), pa.array(crc, pa.int64())], schema=schema)


def read_token_files(spark: SparkSession, manifest: list[dict]) -> DataFrame:
    """doc_id, start (ids of all texts before), n_tokens and ids_crc32 of every text, from the files."""
    rows = [(x["file"], x["base"], x["bits"]) for x in manifest]
    shards = spark.createDataFrame(rows, "file string, base long, bits int").repartition(max(1, len(rows)))
    return shards.mapInArrow(_read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_files(docs: DataFrame, root: str | None = None, tokenizer: str | None = None, end_id: int = END_ID) -> DataFrame:
    """Writes the files and describes each text from them.

    One row per input row, in ascending doc_id order of ``start``. Null or empty text is the end id alone; null ids
    come first; rows that repeat an id follow each other by a hash of their text. An empty table writes no shard and gives no rows.
    Further columns are ignored.
    """
    spark = docs.sparkSession
    return read_token_files(spark, write_token_files(docs, root or fresh_path(spark, "token-files"), tokenizer, end_id))


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files(table(spark, sf_dir, "documents"))
