"""Order operators in batch form: early answers from predecessors, and when each batch is released in order."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ampline.config import DetectorConfig
from ampline.functions.scalar import distance


def early_answers(features: DataFrame, config: DetectorConfig) -> DataFrame:
    """stream_id, seq, answer: 0 if there is surely no event, 1 if it takes waiting; without evictions.

    Each feature is sent to its successors by position and grouped there, so no stream has to pass through one task.
    """
    r = config.early_radius
    first = features.groupBy("stream_id").agg(F.min("seq").alias("first_seq"))
    sent = features.withColumn("k", F.explode(F.expr(f"sequence(1, {r})"))).select("stream_id", (F.col("seq") + F.col("k")).alias("seq"), "k", F.col("ln_p").alias("p"), F.col("ln_q").alias("q"))
    near = features.join(sent, ["stream_id", "seq"]).groupBy("stream_id", "seq", "ln_p", "ln_q").agg(F.array_sort(F.collect_list(F.struct("k", "p", "q"))).alias("past"))
    close = lambda x, p, q: F.coalesce(distance(x["p"], x["q"], p, q) <= config.eps, F.lit(False))
    hits = F.filter("past", lambda x: close(x, F.col("ln_p"), F.col("ln_q")))
    rows = near.withColumn("hit", F.try_element_at(hits, F.lit(1)))
    run = F.size(F.filter("past", lambda x: x["k"] <= F.coalesce(F.col("hit.k"), F.lit(r))))
    gap = run < F.coalesce(F.col("hit.k"), F.lit(r))
    again = F.exists("past", lambda x: (x["k"] > F.col("hit.k")) & close(x, F.col("hit.p"), F.col("hit.q")))
    answer = F.when(gap, 1).when(F.col("hit").isNull(), 0).when(again, 0).otherwise(1)
    told = rows.withColumn("answer", answer).select("stream_id", "seq", "answer")
    start = F.col("seq") - F.col("first_seq") <= r
    every = features.select("stream_id", "seq").join(told, ["stream_id", "seq"], "left").join(first, "stream_id")
    return every.select("stream_id", "seq", F.when(start, 0).otherwise(F.coalesce("answer", F.lit(1))).alias("answer"))


def released(flushed: DataFrame, block: int = 1024) -> DataFrame:
    """stream_id, seq, flush_at, released_at: the response after which all batches up to this one are closed; null if one never is.

    A running maximum in two levels: within blocks of positions, and over the blocks' maxima.
    """
    rows = flushed.select("stream_id", "seq", "flush_at").withColumn("block", F.expr(f"seq div {block}"))
    inner = Window.partitionBy("stream_id", "block").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    outer = Window.partitionBy("stream_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = rows.groupBy("stream_id", "block").agg(F.max("flush_at").alias("most"), F.count("*").alias("n"))
    before = blocks.select("stream_id", "block", F.max("most").over(outer).alias("earlier"), F.coalesce(F.sum("n").over(outer), F.lit(0)).alias("rows_before"))
    joined = rows.withColumns({"top": F.max("flush_at").over(inner), "nth": F.count("*").over(inner)}).join(before, ["stream_id", "block"])
    unbroken = F.col("rows_before") + F.col("nth") == F.col("seq") + 1
    return joined.select("stream_id", "seq", "flush_at", F.when(unbroken, F.greatest("top", F.coalesce("earlier", F.col("top")))).alias("released_at"))
