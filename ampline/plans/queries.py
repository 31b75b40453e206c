"""The detector's queries over the ``events`` table: ten samples a feature, eps 0.1; clean, or made dirty by fixed rules."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ampline.config import FIXTURE as C
from ampline.functions.scalar import batch_id, event_point, offset_in_batch, result_json
from ampline.operators import clustering, features, grid, model, order, quality, scoring
from ampline.sources.samples import dirty, event_samples, from_json_batches, meter_samples, to_json_batches, user_samples
from ampline.streaming.batch import detect_clean, detect_counters, detect_dirty_fill, detect_dirty_reordered
from ampline.streaming.blocks import detect_in_blocks

Query = Callable[[SparkSession, str], DataFrame]
PLACES = 6


def _rounded(df: DataFrame) -> DataFrame:
    return df.select(*[F.round(c, PLACES).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return event_samples(spark, sf_dir, C)


def disordered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dirty(clean(spark, sf_dir))


def windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clustering.windowed(features.clean_features(clean(spark, sf_dir), C))


def _clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clustering.dbscan(windows(spark, sf_dir), C)


def _losses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return model.pair_loss(_clusters(spark, sf_dir), C)


def _stream_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the whole stream as one window, with border points."""
    return grid.dbscan_grid(features.clean_features(clean(spark, sf_dir), C), replace(C, min_pts=4, eps=C.eps / 2))


def meters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return meter_samples(spark, sf_dir, C)


def _projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = C.samples_per_feature
    rows = disordered(spark, sf_dir)
    return rows.select("arrival", "pos", "i", batch_id("i", size).alias("seq"), offset_in_batch("i", "arrival", size).alias("offset"))


def _reordered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect_dirty_reordered(dirty(meters(spark, sf_dir)), C, finish=True)


def _scores(answers: DataFrame, spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.score(answers, scoring.truth_of(detect_clean(meters(spark, sf_dir), C)))


def _bodies(answers: DataFrame) -> DataFrame:
    return answers.select("stream_id", "s", result_json(F.col("s"), F.col("d"), F.col("event_s")).alias("body"))


def power_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(features.clean_features(clean(spark, sf_dir), C))


QUERIES: dict[str, Query] = {
    "samples_from_json": lambda s, d: from_json_batches(to_json_batches(clean(s, d))).select("arrival", "pos", "i", "voltage", "current"),
    "batch_id_projection": _projection,
    "batch_offset_filter": lambda s, d: features.placed(disordered(s, d), C).select("arrival", "pos", "i", "offset"),
    "power_features": power_features,
    "user_power_features": lambda s, d: _rounded(features.clean_features(user_samples(s, d, C), C)),
    "features_last_write_wins": lambda s, d: _rounded(features.last_write_features(disordered(s, d), C)),
    "features_gap_filled": lambda s, d: _rounded(features.gap_filled_features(disordered(s, d), C)),
    "feature_quality_flag": lambda s, d: features.gap_filled_features(disordered(s, d), C).select("seq", "n_samples", "is_bad"),
    "slot_flush": lambda s, d: _rounded(features.flushed_slots(disordered(s, d), C)),
    "stragglers": lambda s, d: features.stragglers(disordered(s, d), C).select("arrival", "pos", "i", "seq"),
    "reorder_frontier": lambda s, d: order.released(features.slot_times(disordered(s, d), C)),
    "early_answer": lambda s, d: order.early_answers(features.clean_features(clean(s, d), C), C),
    "quality_counters": lambda s, d: quality.quality_counters(disordered(s, d), C),
    "late_samples": lambda s, d: quality.late_samples(disordered(s, d), C).select("arrival", "pos", "i", "lag"),
    "lateness_mean": lambda s, d: quality.lateness_mean(disordered(s, d), C),
    "lateness_quartiles": lambda s, d: quality.lateness_quartiles(disordered(s, d), C),
    "lateness_histogram": lambda s, d: quality.lateness_histogram(disordered(s, d), C),
    "feature_gap_count": lambda s, d: clustering.gap_count(windows(s, d), C),
    "neighbor_pairs": lambda s, d: _rounded(clustering.neighbour_pairs(windows(s, d), C)),
    "neighbor_pairs_stream": lambda s, d: _rounded(grid.grid_pairs(features.clean_features(clean(s, d), C), replace(C, eps=C.eps / 4))),
    "dbscan_stream": _stream_clusters,
    "core_points": lambda s, d: clustering.core_points(windows(s, d), C),
    "noise_points": lambda s, d: clustering.noise_points(windows(s, d), C),
    "dbscan_window": _clusters,
    "cluster_stats": lambda s, d: _rounded(clustering.cluster_stats(_clusters(s, d))),
    "locality_filter": lambda s, d: clustering.local_clusters(clustering.cluster_stats(_clusters(s, d)), C).drop("loc"),
    "cluster_size_histogram": lambda s, d: clustering.cluster_size_histogram(_clusters(s, d)),
    "cluster_kind_counters": lambda s, d: clustering.cluster_kind_counters(_clusters(s, d)),
    "cluster_pairs": lambda s, d: model.cluster_pairs(_clusters(s, d), C),
    "event_intervals": lambda s, d: model.event_intervals(_clusters(s, d), C),
    "pair_loss": _losses,
    "best_pair": lambda s, d: model.best_pair(_losses(s, d), C),
    "event_point": lambda s, d: model.best_pair(_losses(s, d), C).select("window_id", event_point("first_noise", "last_noise").alias("event_s")),
    "backward_suffix_check": lambda s, d: model.backward_suffixes(windows(s, d), C),
    "detect_clean": lambda s, d: detect_clean(meters(s, d), C),
    "detect_clean_stream": lambda s, d: detect_in_blocks(features.clean_features(clean(s, d), C), C, block=250),
    "detect_clean_users": lambda s, d: detect_clean(user_samples(s, d, C), C),
    "detect_counters": lambda s, d: detect_counters(meters(s, d), C),
    "detect_dirty_fill": lambda s, d: detect_dirty_fill(dirty(meters(s, d)), C),
    "detect_dirty_reorder": _reordered,
    "first_answers": lambda s, d: scoring.first_answers(_reordered(s, d)),
    "result_json": lambda s, d: _bodies(detect_clean(meters(s, d), C)),
    "score_results": lambda s, d: _scores(_reordered(s, d), s, d),
    "score_fill_results": lambda s, d: _scores(detect_dirty_fill(dirty(meters(s, d)), C), s, d),
}
