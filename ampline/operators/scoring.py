"""Scores of results against a truth."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def truth_of(results: DataFrame) -> DataFrame:
    """stream_id, s, truth_d of a run that is taken as the truth."""
    return results.groupBy("stream_id", "s").agg(F.max("d").alias("truth_d"))


def first_answers(results: DataFrame) -> DataFrame:
    """Of several answers for one position the first counts."""
    return results.groupBy("stream_id", "s").agg(F.min_by(F.struct("d", "event_s"), "emit_ord").alias("x")).select("stream_id", "s", "x.d", "x.event_s")


def latest_answers(results: DataFrame) -> DataFrame:
    return results.groupBy("stream_id", "s").agg(F.max_by(F.struct("d", "event_s"), "emit_ord").alias("x")).select("stream_id", "s", "x.d", "x.event_s")


def score(results: DataFrame, truth: DataFrame) -> DataFrame:
    """stream_id, answers, false_positives, false_negatives, unknown (answers without a truth)."""
    joined = first_answers(results).join(truth, ["stream_id", "s"], "left")
    d, t = F.col("d"), F.col("truth_d")
    return joined.groupBy("stream_id").agg(
        F.count("*").alias("answers"), F.count_if((d == 1) & (t == 0)).alias("false_positives"), F.count_if((d == 0) & (t == 1)).alias("false_negatives"), F.count_if(t.isNull()).alias("unknown")
    )


def score_stream(results: DataFrame, truth: DataFrame, time: str = "ts", every: str = "1 minute", lateness: str = "20 seconds") -> DataFrame:
    """``score`` in flight, of two streams: stream_id, start, answers, false_positives, false_negatives, unknown of each ``every``.

    Results and truth (stream_id, s, truth_d) both carry ``time``, the time of position s, so all answers for a position and
    its truth have the same. The first answer by emit_ord counts, and of several truths the largest. A window is scored once,
    when the time of both streams is ``lateness`` past its end; an answer whose truth has not come by then is unknown, and
    what comes later is dropped and counted in the query's progress. Positions without an answer don't count.
    """
    during = F.window(time, every).alias("during")
    answers = results.withWatermark(time, lateness).groupBy(during, "stream_id", "s").agg(F.min_by("d", "emit_ord").alias("d"))
    known = truth.withWatermark(time, lateness).groupBy(during, "stream_id", "s").agg(F.max("truth_d").alias("truth_d"))
    joined = answers.join(known, ["during", "stream_id", "s"], "left")
    d, t = F.col("d"), F.col("truth_d")
    scored = joined.groupBy("during", "stream_id").agg(
        F.count("*").alias("answers"), F.count_if((d == 1) & (t == 0)).alias("false_positives"), F.count_if((d == 0) & (t == 1)).alias("false_negatives"), F.count_if(t.isNull()).alias("unknown")
    )
    return scored.select("stream_id", F.col("during.start").alias("start"), "answers", "false_positives", "false_negatives", "unknown")
