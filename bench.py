"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; one JSON line with seconds by query.

Each query is run once at the smallest scale to start workers and compile, then timed once in full
(all result rows are written to the no-op sink).
"""

from __future__ import annotations

import json
import os
import sys
import time

HEADLINE = [
    "quality_components", "soft_rating", "policy_hard", "reason_intersections", "classification_report", "pair_histogram", "threshold_edges", "nearest_neighbor", "component_sweep", "centroid_margin",
    "cluster_metrics_all", "verify_sweep", "verify_cv", "average_precision", "detector_curve", "appearance_tracks", "gap_tracks", "interval_overlap", "constrained_clusters", "diverse_topk", "stratified_sample",
]


def main() -> None:
    sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
    from pyspark.sql import SparkSession

    from lumenframe.plans import registry

    cpus = os.environ.get("BENCH_CPUS", "8")
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench").config("spark.sql.shuffle.partitions", cpus).config("spark.ui.enabled", "false").config("spark.driver.memory", "12g")
        .config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    small = os.path.join(os.path.dirname(folder.rstrip("/")), "sf0.001")
    took: dict[str, float] = {}
    for name in HEADLINE:
        if os.path.isdir(small):
            registry.QUERIES[name](spark, small).write.format("noop").mode("overwrite").save()
        began = time.perf_counter()
        registry.QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        took[name] = round(time.perf_counter() - began, 3)
        print(f"{name}: {took[name]} s", file=sys.stderr)
    spark.stop()
    print(json.dumps({"metric": "headline queries, total wall time", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(folder.rstrip("/"))}))


if __name__ == "__main__":
    main()
