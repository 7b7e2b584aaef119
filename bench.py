"""Times the headline queries after a warm-up; prints one JSON line. BENCH_RUNS=3 takes medians of three runs."""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import SparkSession  # noqa: E402

from ridespark.workloads import QUERIES  # noqa: E402

FOLDER = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
# fixed, heavy or fitted queries are measured by name on request: BENCH_QUERIES=a,b
HEADLINE = [
    "signals_engineered",
    "signal_deltas",
    "flow_field",
    "flow_grid",
    "windows_stats",
    "window_zscore",
    "window_labels",
    "telemetry_rms",
    "nearest_asof",
    "pitch_rate",
    "vehicle_motion",
    "gps_track",
    "rolling_median",
    "interest_channels",
    "rank_global",
    "video_summary",
    "top_segments",
    "merge_ranges",
    "segment_recall",
    "ndcg",
    "select_greedy_budget",
    "timeline_positions",
    "timeline_sync",
    "snap_beats",
    "combined_grid",
    "training_table",
    "pearson",
    "spearman",
    "column_profile",
    "sequence_audit",
    "covering_entries",
    "request_lists",
    "flight_log",
    # heavy: edits, fits, live forms, reports
    "score_report",
    "edit_timelines",
    "ranker_pairwise",
    "class_probabilities",
    "live_windows",
    "live_deltas",
]


def main() -> None:
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]")
        .appName("bench")
        .config("spark.sql.shuffle.partitions", CPUS)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "8g"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    names = os.environ.get("BENCH_QUERIES")
    names = names.split(",") if names else HEADLINE
    QUERIES["window_zscore"](spark, FOLDER).write.format("noop").mode("overwrite").save()
    seconds = {}
    for name in names:
        runs = []
        for _ in range(int(os.environ.get("BENCH_RUNS", "1"))):
            start = time.perf_counter()
            QUERIES[name](spark, FOLDER).write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - start)
        seconds[name] = round(statistics.median(runs), 3)
    print(
        json.dumps(
            {
                "metric": "total seconds over headline queries",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(FOLDER.rstrip("/")).removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
