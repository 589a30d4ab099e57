"""Time the headline queries and print one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8) set the
input and the local width. Every query runs once to warm up and then BENCH_RUNS
times (default 3); the median counts. A run materialises every output row and column.
"""

from __future__ import annotations

import json
import os
import statistics
import tempfile
import time

from pyspark.sql import SparkSession

from fleetspan.registry import all_entries

HEADLINE = [
    "w04_current_waits",
    "w01_share_of_total",
    "w03_share_per_snapshot",
    "a02_wait_trend",
    "a09_growth_projection",
    "a14_baseline_variance",
    "a15_index_maintenance_summary",
    "a17_failed_logins",
    "a25_job_summary",
    "a29_daily_sales",
    "j01_blocking_pairs",
    "j02_lock_waits",
    "j03_blocking_chains",
    "j07_duplicate_index_columns",
    "j08_duplicate_indexes",
    "j11_server_overview",
    "j17_permissions",
    "j24_employee_activity",
    "p11_classify_log",
    "p38_setting_changes",
    "s08_upsert_query_stats",
    "t01_top_queries",
    "c01_check_alerts",
    "c03_health_report",
    "s01_history_round_trip",
    "r01_stream_ingest",
    "r04_stream_membership_changes",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("bench")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="bench-"))  # one machine: its own folder is the shared one
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    entries = all_entries()
    seconds = {}
    for name in HEADLINE:
        times = []
        for _ in range(runs + 1):
            start = time.perf_counter()
            entries[name].run(spark, sf_dir).write.format("noop").mode("overwrite").save()
            times.append(time.perf_counter() - start)
        seconds[name] = round(statistics.median(times[1:]), 3)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "headline_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
