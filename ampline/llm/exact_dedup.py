"""Exact dedup by deterministic block naming.

A normalised text is cut into blocks of fixed size. Distinct blocks are sorted and numbered; a text becomes the
sequence of its blocks' numbers. Adjacent numbers are then paired, distinct pairs sorted and numbered, and so on
until a text has a single number. Numbers are given to contents one to one, so two texts of the same number of
rounds have the same number exactly if they are equal: no fingerprint decides.

Only distinct blocks are shuffled as text, after a map-side merge, so a third of all rows being one text costs no
more than its copies' numbers. Blocks travel back to their texts by a 128-bit hash; the run checks that no two
distinct blocks share one and takes another seed if they do.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ampline.llm.common import Stored, slices, stored_alone, table

BLOCK_BYTES = 4096

_SIGNED = 1 << 63


def _blocks(batch: pa.RecordBatch, size: int, seed: int) -> Iterator[tuple[int, int, int, bytes, int, int]]:
    """(row, position, blocks in the row, block, two hashes) of the lower-cased (A-Z) texts; an empty text is one empty block."""
    for row, text in enumerate(pc.ascii_lower(batch.column("text")).cast(pa.binary()).to_pylist()):
        n = max(1, -(-len(text) // size))
        for k in range(n):
            part = text[k * size : (k + 1) * size]
            h = xxhash.xxh3_128_intdigest(part, seed)
            yield row, k, n, part, (h >> 64) - _SIGNED, (h & (2**64 - 1)) - _SIGNED


def _contents(size: int, seed: int) -> Callable:
    schema = pa.schema([("h1", pa.int64()), ("h2", pa.int64()), ("block", pa.binary())])

    def run(batches):
        for batch in slices(batches, "text"):
            _, _, _, block, h1, h2 = zip(*_blocks(batch, size, seed), strict=True)
            yield pa.record_batch([pa.array(h1, pa.int64()), pa.array(h2, pa.int64()), pa.array(block, pa.binary())], schema=schema)

    return run


def _places(size: int, seed: int) -> Callable:
    schema = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("sha", pa.binary()), ("pos", pa.int64()), ("n", pa.int64()), ("h1", pa.int64()), ("h2", pa.int64())])

    def run(batches):
        seen = TaskContext.get().partitionId() << 40
        for batch in slices(batches, "text"):
            row, pos, n, _, h1, h2 = (list(x) for x in zip(*_blocks(batch, size, seed), strict=True))
            sha = [hashlib.sha256(x).digest() for x in pc.ascii_lower(batch.column("text")).cast(pa.binary()).to_pylist()]
            at = np.array(row, np.int64)
            first = np.array(pos) == 0
            yield pa.record_batch(
                [
                    pa.array(at + seen),
                    batch.column("doc_id").take(pa.array(at)),
                    pa.array([sha[r] if f else None for r, f in zip(row, first, strict=True)], pa.binary()),
                    pa.array(pos, pa.int64()),
                    pa.array(n, pa.int64()),
                    pa.array(h1, pa.int64()),
                    pa.array(h2, pa.int64()),
                ],
                schema=schema,
            )
            seen += batch.num_rows

    return run


def _numbered(distinct: DataFrame, *by: str) -> DataFrame:
    """One integer for each row: the place in the sorted order of the row's hash partition, partitions one after the other."""
    return distinct.sortWithinPartitions(*by).withColumn("name", F.monotonically_increasing_id())


def _block_names(texts: DataFrame, size: int) -> tuple[Stored, int]:
    for seed in range(64):
        blocks = texts.select("text").mapInArrow(_contents(size, seed), "h1 long, h2 long, block binary")
        names = Stored(_numbered(blocks.distinct(), "block", "h1", "h2").select("h1", "h2", "name"), "block-names")
        if names.df.groupBy("h1", "h2").count().where("count > 1").isEmpty():
            return names, seed
        names.drop()
    raise RuntimeError("no seed keeps the hashes of distinct blocks apart")


def _identities(texts: DataFrame, block_bytes: int) -> DataFrame:
    """row, doc_id, sha, level, name: (level, name) is the text's identity."""
    blocks, seed = _block_names(texts, block_bytes)
    places = texts.mapInArrow(_places(block_bytes, seed), "row long, doc_id long, sha binary, pos long, n long, h1 long, h2 long")
    named = Stored(places.join(blocks.df, ["h1", "h2"]).select("row", "doc_id", "sha", "pos", "n", "name"), "named-0")
    blocks.drop()

    longest = named.df.agg(F.max("n")).first()[0] or 1
    ids = named.df.where("pos = 0").select("row", "doc_id", "sha")
    level, rest, done = 0, named.df.select("row", "pos", "n", "name"), []
    while True:
        done.append(rest.where("n = 1").select("row", F.lit(level).alias("level"), "name"))
        if longest <= 1:
            break
        level, longest = level + 1, (longest + 1) // 2
        pairs = (
            rest.where("n > 1")
            .groupBy("row", F.expr("pos div 2").alias("pos"))
            .agg(
                F.max(F.when(F.col("pos") % 2 == 0, F.col("name"))).alias("left"),
                F.coalesce(F.max(F.when(F.col("pos") % 2 == 1, F.col("name"))), F.lit(-1)).alias("right"),
                F.first(F.expr("(n + 1) div 2")).alias("n"),
            )
        )
        names = Stored(_numbered(pairs.select("left", "right").distinct(), "left", "right"), f"pair-names-{level}")
        rest = Stored(pairs.join(names.df, ["left", "right"]).select("row", "pos", "n", "name"), f"named-{level}").df
        names.drop()

    identity = done[0]
    for more in done[1:]:
        identity = identity.unionByName(more)
    return ids.join(identity, "row")


def exact_duplicates(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after lower-casing A-Z. Null text counts as empty, so null and empty texts form
    one group. The row with the largest doc_id stays (null ids come below all others; of rows that repeat a text
    and an id, exactly one stays). An empty table gives no rows; further columns of ``docs`` are not read.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"))
    rows = stored_alone(lambda: _identities(texts, block_bytes), "identities").df
    best = F.max(F.struct(F.col("doc_id"), -F.col("row")))
    groups = Stored(rows.groupBy("level", "name").agg(F.count("*").alias("group_size"), best.alias("best")), "groups").df
    return rows.join(groups, ["level", "name"]).select(
        "doc_id",
        F.col("best.doc_id").alias("keep_id"),
        "group_size",
        (F.col("row") == -F.col("best.col2")).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
    )


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(table(spark, sf_dir, "documents"))


ORACLE = """
WITH t AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS norm FROM documents)
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       doc_id = max(doc_id) OVER g AS kept, sha256(norm) AS text_sha256
FROM t WINDOW g AS (PARTITION BY norm)
"""
