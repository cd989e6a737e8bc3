"""Time the headline queries; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import SparkSession

from contrail import catalog

HEADLINE = (
    "suppress_repeats", "flights", "flight_bounds", "asof_nearest", "motion", "plane_stats",
    "series_chunks", "top_planes", "dedup_within", "valid_frame_check", "decode_identification",
    "decode_velocity", "zone_times", "zones_by_grid", "level_matches", "live_alerts",
    "thin_per_bucket", "registry_lookup", "archive_status", "plane_summaries",
    "qualified_levels",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("contrail-bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="contrail-bench-"))
        .config("spark.sql.sessionWindow.merge.sessions.in.local.partition", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("OFF")
    spark.read.parquet(f"{sf_dir}/events.parquet").count()
    queries, seconds, warm = catalog.queries(), {}, {}
    for name in sys.argv[1:] or HEADLINE:
        for figures in (seconds, warm):
            if figures is warm and seconds[name] > 10:
                continue  # long ones are mostly work, not compiling
            start = time.time()
            queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            figures[name] = round(time.time() - start, 3)
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(seconds.values()), 3),
        "unit": "sec", "queries": seconds, "warm": warm, "sf": os.path.basename(sf_dir.rstrip("/")),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
