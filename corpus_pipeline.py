"""The corpus pipeline: language ID, near duplicates, decontamination, mixing, token files.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of ``documents``.
Every stage works on all that its predecessor kept, and its decisions take effect on the rows that it returns.
"""

from __future__ import annotations

import gc
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ampline.llm.common import Stored, release, small_batches, stored_alone, table
from ampline.llm.decontaminate import flag_leaks
from ampline.llm.jaccard_join import JaccardConfig, similar_components
from ampline.llm.language import fit, with_language, with_letters
from ampline.llm.mixing import draw
from ampline.llm.token_files import token_files

#: Near duplicates: sets of five-word shingles with a Jaccard similarity of 0.8 or more.
NEAR = JaccardConfig(words=5, num=80, den=100)
#: Ids up to which the list of rows to drop is broadcast.
BROADCAST_IDS = 1_000_000
#: Share of a text's words with letters that its language must hold at least.
LEAST_SHARE = 0.5


def _ready(spark: SparkSession) -> None:
    """Small batches for the workers; and the driver lets go of what earlier stages collected or planned."""
    small_batches(spark)
    gc.collect()
    release()


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops what is in no language, and fills in a missing ``lang``.

    Dropped are null texts, texts without a letter, and mixtures in which no language holds half of the words with
    letters. Where ``lang`` is null the predicted language takes its place; a given one stays. With no labelled row to
    learn from no language can be told, and texts with letters stay as they are. All rows of one text fare alike.
    """
    _ready(spark)
    model = fit(docs)
    if model is None:
        return with_letters(docs)
    told = with_language(docs, model, ("ampline_lang", "ampline_share"))
    kept = told.where((F.col("ampline_lang") != "und") & (F.col("ampline_share") >= LEAST_SHARE))
    return kept.withColumn("lang", F.coalesce("lang", "ampline_lang")).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps of each group of near duplicates one row: of those with the least doc_id, the first stored.

    Groups and decisions are by stored row, so repeated ids and rows without an id are rows like others; an id comes
    before none. Texts of white space and null texts are in no group and stay. An empty table stays empty.
    """
    _ready(spark)
    keyed = Stored(docs.withColumn("ampline_row", F.monotonically_increasing_id()), "keyed").df
    found = similar_components(keyed.select(F.col("ampline_row").alias("doc_id"), "text"), NEAR)
    near = Stored(found.select(F.col("doc_id").alias("ampline_row"), "component_id"), "near")
    parts = near.df
    best = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "ampline_row"))
    first = keyed.select("ampline_row", "doc_id").join(parts, "ampline_row").groupBy("component_id").agg(best.alias("best"))
    drop = Stored(parts.select("ampline_row").join(first.select("best.ampline_row"), "ampline_row", "left_anti"), "drop").df
    near.drop()
    few = drop.count() <= BROADCAST_IDS
    return keyed.join(F.broadcast(drop) if few else drop, "ampline_row", "left_anti").select(*docs.columns)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a passage of the benchmark; null and empty texts hold none and stay."""
    _ready(spark)
    flagged = flag_leaks(docs, table(spark, sf_dir, "benchmark"), column="ampline_leaks")
    return flagged.where(F.size("ampline_leaks") == 0).select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Draws documents so that the sources have their target weights; a row for each copy drawn.

    A null source is a source; sources without words are not drawn.
    """
    _ready(spark)
    return draw(docs).select(*docs.columns)


def write_token_files(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Writes the token files, and describes each text from them: doc_id, start, n_tokens, ids_crc32; a row for each row of docs."""
    _ready(spark)
    return token_files(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("decontaminate", decontaminate),
    ("mix_sources", mix_sources),
    ("token_files", write_token_files),
]

#: SQL can't express the stages; tests/llm/test_pipeline.py holds them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn, each written and read again; what a stage was made from goes once it is written."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        made = stored_alone(lambda stage=stage, docs=docs: stage(spark, docs, sf_dir), name)
        if before:
            before.drop()
        docs, before = made.df, made
    return STAGES[-1][1](spark, docs, sf_dir)
