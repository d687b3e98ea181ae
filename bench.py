"""Time the registered queries and print one JSON line.

``BENCH_SF_DIR`` names the data, ``BENCH_CPUS`` the cores, ``BENCH_QUERIES`` a comma-separated choice ("all" for
every registered query) and ``BENCH_RUNS`` how often each one runs; the median counts.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

from weirworks.plans.load import REGISTRY
from weirworks.session import local_session

# One or two queries per operator family.
HEADLINE = (
    "revenue_by_segment", "source_csv", "source_parquet", "target_partitioned_orc", "map_apply", "filter_between", "filter_negated_in_or",
    "route_groups", "join_inner", "join_salted", "merge_upsert", "lookup_dimension", "aggregate_basic", "aggregate_distinct", "aggregate_shape",
    "dedup_keep_latest", "union_distinct", "snapshot_difference", "missing_fill_mode_by_group", "row_identifier",
    "sql_top_orders_per_customer", "sql_running_and_sliding", "sql_cube", "sql_asof_join", "sql_correlated_mean", "sql_pivot",
    "run_window_summary", "run_changes", "run_breakdowns", "metric_series", "log_tail", "failure_signatures", "script_migration_scan",
    "lineage_nodes", "lineage_depth", "quality_rules", "pii_row_audit", "pii_row_masking", "pii_row_hashing", "column_loss", "join_health",
    "search_typos", "preview_ordered", "session_idle", "window_sliding", "stream_window_tumbling", "stream_latest_run",
)


def timed(spark, run, folder: str) -> float:
    start = time.perf_counter()
    # The noop sink computes every row and column without moving them to the driver.
    run(spark, folder).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    chosen = os.environ.get("BENCH_QUERIES", "")
    names = list(REGISTRY) if chosen == "all" else [n for n in chosen.split(",") if n] or list(HEADLINE)
    spark = local_session(cores, "weirworks-bench")
    spark.sparkContext.setLogLevel("ERROR")
    seconds = {}
    for name in names:
        took = [timed(spark, REGISTRY[name].run, folder) for _ in range(runs)]
        seconds[name] = round(statistics.median(took), 3)
        print(f"{name} {seconds[name]} first {took[0]:.3f}", file=sys.stderr, flush=True)
    print(
        json.dumps(
            {
                "metric": "total_query_seconds",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": folder.rstrip("/").rsplit("sf", 1)[-1],
                "cores": cores,
                "runs": runs,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
