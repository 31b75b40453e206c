"""Samples from tables and JSON.

A sample is (stream_id, arrival, pos, i, voltage, current): the stream, the response that brought it and its place in
that, its own number, and the two readings, exact decimals where the source has them, so that sums don't depend on order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ampline.config import DetectorConfig
from ampline.functions.scalar import batch_id

RECORDS = "records array<struct<i: bigint, voltage: double, current: double>>"


def event_samples(spark: SparkSession, sf_dir: str, config: DetectorConfig) -> DataFrame:
    """The ``events`` table as one clean stream: event_id, value and props.k are i, voltage and current."""
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "value", "props")
    return rows.select(
        F.expr("event_id % 1").alias("stream_id"),  # 0, but a key that the planner keeps in joins
        F.expr(f"event_id div {config.samples_per_feature}").alias("arrival"),
        F.col("event_id").alias("pos"),
        F.col("event_id").alias("i"),
        F.col("value").cast("decimal(18,2)").alias("voltage"),
        F.get_json_object("props", "$.k").cast("decimal(18,0)").alias("current"),
    )


def meter_samples(spark: SparkSession, sf_dir: str, config: DetectorConfig, features: int = 200) -> DataFrame:
    """The ``events`` table as meters of ``features`` batches each: runs of consecutive events, each run a stream of its own."""
    size = features * config.samples_per_feature
    rows = event_samples(spark, sf_dir, config)
    i = F.col("i") % size
    return rows.select(F.expr(f"i div {size}").alias("stream_id"), F.expr(f"(i % {size}) div {config.samples_per_feature}").alias("arrival"), i.alias("pos"), i.alias("i"), "voltage", "current")


def user_samples(spark: SparkSession, sf_dir: str, config: DetectorConfig) -> DataFrame:
    """The ``events`` table as one stream per user, numbered by event_id."""
    from pyspark.sql import Window

    rows = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "user_id", "value", "props")
    i = (F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")) - 1).cast("long")
    numbered = rows.select(F.col("user_id").alias("stream_id"), i.alias("i"), F.col("value").cast("decimal(18,2)").alias("voltage"), F.get_json_object("props", "$.k").cast("decimal(18,0)").alias("current"))
    return numbered.select("stream_id", batch_id("i", config.samples_per_feature).alias("arrival"), F.col("i").alias("pos"), "i", "voltage", "current")


def dirty(samples: DataFrame) -> DataFrame:
    """A dirty stream made of a clean one by fixed rules: one sample in 97 is missing, one in 101 comes twice (the second
    time one volt higher), one in 13 comes up to 22 responses late."""
    i = F.col("i")
    kept = samples.where(i % 97 != 0).withColumn("arrival", F.col("arrival") + F.when(i % 13 == 0, i % 23).otherwise(0))
    twice = kept.withColumn("again", F.explode(F.when(i % 101 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
    return twice.withColumns({"pos": i * 2 + F.col("again"), "voltage": (F.col("voltage") + F.col("again")).cast("decimal(18,2)")}).drop("again")


def to_json_batches(samples: DataFrame) -> DataFrame:
    """A row per response with its body: {"records": [{"i", "voltage", "current"}, ...]}."""
    record = F.struct("i", F.col("voltage").cast("double").alias("voltage"), F.col("current").cast("double").alias("current"))
    bodies = samples.groupBy("stream_id", "arrival").agg(F.array_sort(F.collect_list(F.struct("pos", record.alias("r")))).alias("rs"))
    return bodies.select("stream_id", "arrival", F.to_json(F.struct(F.expr("transform(rs, x -> x.r)").alias("records"))).alias("body"))


def from_json_batches(bodies: DataFrame) -> DataFrame:
    """Samples of response bodies (stream_id, arrival, body). Bodies without records, as empty and control ones, give none."""
    parsed = bodies.withColumn("x", F.from_json("body", RECORDS)).where("x.records is not null")
    return parsed.select("stream_id", "arrival", F.posexplode("x.records").alias("at", "r")).select("stream_id", "arrival", F.col("at").cast("long").alias("pos"), "r.i", "r.voltage", "r.current")


def read_json_stream(spark: SparkSession, path: str, stream_id: int = 0) -> DataFrame:
    """Streaming samples of a folder of response files, one body a line: {"arrival": n, "records": [...]}."""
    rows = spark.readStream.schema(f"arrival bigint, {RECORDS}").json(path).where("records is not null")
    return rows.select(F.lit(stream_id).cast("long").alias("stream_id"), "arrival", F.posexplode("records").alias("at", "r")).select("stream_id", "arrival", F.col("at").cast("long").alias("pos"), "r.i", "r.voltage", "r.current")
