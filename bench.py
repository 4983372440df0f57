"""Time the headline queries and print one JSON line.

BENCH_SF_DIR   input directory (default /root/testdata/sf0.1)
BENCH_CPUS     local cores (default all)
BENCH_RUNS     timed runs per query after one warm-up run (default 1); the median counts
BENCH_QUERIES  comma-separated names instead of the headline list
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

from comarca.plans import CATALOG
from comarca.session import local_session

HEADLINE = [
    "type_columns",
    "agg_entities",
    "annualize",
    "splice_priority",
    "union_all_blocks",
    "pivot_conditional",
    "join_multi_left",
    "median_by_group",
    "describe_table",
    "column_profile",
    "spearman_pooled_within_changes",
    "expect_total_equals_members",
    "table_diff_tolerance",
    "export_year_matrix",
    "build_index",
    "build_index_members",
    "fe_fit",
    "wild_cluster_bootstrap_controls",
    "placebo_permute",
    "jackknife_units",
    "spec_curve",
    "event_study",
    "moran_i",
    "rolling_origin",
    "rolling_origin_arma",
    "legacy_variables",
    "pca_multi",
    "contrast_family",
    "quality_gate",
    "scenario_fanout",
    "stream_annualize",
]


def timed(spark, name: str, sf_dir: str) -> float:
    start = time.perf_counter()
    CATALOG[name].run(spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "*")
    runs = int(os.environ.get("BENCH_RUNS", "1"))
    names = [n for n in os.environ.get("BENCH_QUERIES", "").split(",") if n] or HEADLINE
    cores = os.cpu_count() if cpus == "*" else int(cpus)
    spark = local_session(cpus, partitions=cores)
    seconds = {}
    for name in names:
        timed(spark, name, sf_dir)  # warm-up: code generation and plan compilation of this query
        seconds[name] = round(statistics.median(timed(spark, name, sf_dir) for _ in range(runs)), 3)
        print(f"{name}: {seconds[name]}", file=sys.stderr, flush=True)
    sf = os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet").count()
    print(
        json.dumps(
            {
                "metric": "headline_total_seconds",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": sf,
                "lineitem_rows": rows,
                "cores": cores,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
