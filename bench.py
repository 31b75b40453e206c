"""Times the headline queries; prints one JSON line."""

import json
import os
import time

SF_DIR, CPUS = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
NAMES = ["power_features", "features_gap_filled", "slot_flush", "quality_counters", "neighbor_pairs", "dbscan_window", "best_pair", "detect_clean", "detect_clean_users", "detect_dirty_reorder"]


def main() -> None:
    from pyspark.sql import SparkSession

    from ampline.plans.queries import QUERIES

    spark = (
        SparkSession.builder.master(f"local[{CPUS}]")
        .config("spark.sql.shuffle.partitions", CPUS)
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")

    def timed(name: str) -> float:
        start = time.perf_counter()
        QUERIES[name](spark, SF_DIR).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - start

    took = {}
    for name in NAMES:
        timed(name)  # compiles
        took[name] = round(sorted(timed(name) for _ in range(3))[1], 3)
    print(json.dumps({"metric": "median seconds, warm, summed over queries", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": SF_DIR.rsplit("sf", 1)[-1]}))


if __name__ == "__main__":
    main()
