"""Samples to features: one partial and one final aggregation by batch, all in the JVM.

A feature is (ln of active power, ln of reactive power) of the samples of a batch. Missing samples count as ``filler``
volts and amperes; as each adds filler squared to all three sums, none has to be generated.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ampline.config import DetectorConfig
from ampline.functions.scalar import batch_id, ln, offset_in_batch

_SUMS = ("vv", "cc", "vc")


def sums(samples: DataFrame, *keys: str) -> DataFrame:
    v, c = F.col("voltage"), F.col("current")
    return samples.groupBy(*keys).agg(F.count("*").alias("n_samples"), F.sum(v * v).alias("vv"), F.sum(c * c).alias("cc"), F.sum(v * c).alias("vc"))


def features_from_sums(totals: DataFrame, config: DetectorConfig, fill: bool) -> DataFrame:
    size, kept = config.samples_per_feature, [x for x in totals.columns if x not in _SUMS]
    missing = F.greatest(F.lit(size) - F.col("n_samples"), F.lit(0)) if fill else F.lit(0)
    vv, cc, vc = ((F.col(x) + missing * F.lit(config.filler * config.filler)).cast("double") / size for x in _SUMS)
    powers = totals.withColumns({"p": vc, "apparent": F.sqrt(vv) * F.sqrt(cc)})
    reactive = F.col("apparent") * F.col("apparent") - F.col("p") * F.col("p")
    return powers.select(*kept, ln(F.col("p")).alias("ln_p"), F.when(reactive > 0, F.ln(F.sqrt(reactive))).alias("ln_q"))


def quality(config: DetectorConfig) -> F.Column:
    """True for a feature of too few samples."""
    return F.col("n_samples") < F.lit(config.good_share * config.samples_per_feature) - F.lit(1e-9)


def clean_features(samples: DataFrame, config: DetectorConfig) -> DataFrame:
    """stream_id, seq, n_samples, ln_p, ln_q of samples whose ``i`` says the batch."""
    rows = samples.withColumn("seq", batch_id("i", config.samples_per_feature))
    return features_from_sums(sums(rows, "stream_id", "seq"), config, fill=False)


def gap_filled_features(samples: DataFrame, config: DetectorConfig) -> DataFrame:
    """Features of all samples of a batch, whenever they arrived; missing ones filled; is_bad by their number."""
    rows = samples.withColumn("seq", batch_id("i", config.samples_per_feature))
    return features_from_sums(sums(rows, "stream_id", "seq"), config, fill=True).withColumn("is_bad", quality(config))


def placed(samples: DataFrame, config: DetectorConfig) -> DataFrame:
    """Samples that arrive in their own response, with their offset in it; late and early ones are left out."""
    rows = samples.withColumn("offset", offset_in_batch("i", "arrival", config.samples_per_feature))
    return rows.where(F.col("offset").between(0, config.samples_per_feature - 1))


def last_write_features(samples: DataFrame, config: DetectorConfig) -> DataFrame:
    """Features of each response as it arrives: of samples for one place the last counts, empty places are filled."""
    last = placed(samples, config).groupBy("stream_id", "arrival", "i").agg(F.max_by(F.struct("voltage", "current"), "pos").alias("last"))
    rows = last.select("stream_id", F.col("arrival").alias("seq"), "last.voltage", "last.current")
    seen = samples.select("stream_id", F.col("arrival").alias("seq")).distinct()
    zero = F.lit(0)
    totals = seen.join(sums(rows, "stream_id", "seq"), ["stream_id", "seq"], "left").select("stream_id", "seq", F.coalesce("n_samples", zero).alias("n_samples"), *[F.coalesce(x, zero).alias(x) for x in _SUMS])
    return features_from_sums(totals, config, fill=True)


def flushed_slots(samples: DataFrame, config: DetectorConfig, at_end: bool = False) -> DataFrame:
    """When each batch's slot is closed, and its feature: stream_id, seq, flush_at, n_samples, ln_p, ln_q, is_bad.

    A slot gathers a batch's samples over responses. It is closed after the response with which it holds exactly
    samples_per_feature, or once late_batches responses have come since its own; later samples are left to ``stragglers``.
    Of a slot with too many samples the first count. Slots that no response closes are left out, unless ``at_end``.

    The samples are summed by response once; slots are closed on these sums. Samples themselves are looked at again only
    for a response that brings a slot more than it takes.
    """
    size = config.samples_per_feature
    grown = _grown(_keyed(samples, config), config, at_end).where("arrival <= flush_at")
    whole = grown.where(F.col("held") <= size).select("stream_id", "seq", "flush_at", "n_samples", *_SUMS)
    crossed = grown.where((F.col("held") > size) & (F.col("held") - F.col("n_samples") < size))
    left = crossed.select("stream_id", "seq", "arrival", "flush_at", (F.lit(size) - F.col("held") + F.col("n_samples")).alias("left"))
    nth = F.row_number().over(Window.partitionBy("stream_id", "seq", "arrival").orderBy("pos"))
    over = _keyed(samples, config).join(left, ["stream_id", "seq", "arrival"]).withColumn("nth", nth).where(F.col("nth") <= F.col("left"))
    both = whole.unionByName(sums(over, "stream_id", "seq", "flush_at"))
    totals = both.groupBy("stream_id", "seq", "flush_at").agg(*[F.sum(x).alias(x) for x in ("n_samples", *_SUMS)])
    return features_from_sums(totals, config, fill=True).withColumn("is_bad", quality(config))


def slot_times(samples: DataFrame, config: DetectorConfig, at_end: bool = False) -> DataFrame:
    """stream_id, seq, flush_at of flushed_slots, without the features."""
    return _grown(_keyed(samples, config), config, at_end).groupBy("stream_id", "seq").agg(F.min("flush_at").alias("flush_at"))


def stragglers(samples: DataFrame, config: DetectorConfig) -> DataFrame:
    """Samples that come after their slot was closed."""
    late = _grown(_keyed(samples, config), config, False).where("arrival > flush_at").select("stream_id", "seq", "arrival")
    return _keyed(samples, config).join(late, ["stream_id", "seq", "arrival"], "left_semi")


def _keyed(samples: DataFrame, config: DetectorConfig) -> DataFrame:
    return samples.withColumn("seq", batch_id("i", config.samples_per_feature))


def _grown(keyed: DataFrame, config: DetectorConfig, at_end: bool) -> DataFrame:
    """Sums by slot and response: stream_id, seq, arrival, n_samples, vv, cc, vc, held (samples so far), flush_at."""
    slot = Window.partitionBy("stream_id", "seq")
    so_far = slot.orderBy("arrival").rowsBetween(Window.unboundedPreceding, 0)
    summed = sums(keyed, "stream_id", "seq", "arrival")
    rows = summed.withColumn("held", F.sum("n_samples").over(so_far))
    whole = F.min(F.when(F.col("held") == config.samples_per_feature, F.col("arrival"))).over(slot)
    timeout = F.greatest(F.col("seq") + config.late_batches, F.min("arrival").over(slot))
    closed = rows.withColumn("flush_at", F.least(F.coalesce(whole, timeout), timeout))
    ends = summed.groupBy("stream_id").agg(F.max("arrival").alias("last"))  # from the sums, so that samples are read once
    joined = closed.join(ends, "stream_id")
    return (joined.withColumn("flush_at", F.least("flush_at", "last")) if at_end else joined.where("flush_at <= last")).drop("last")
