"""Headline queries, timed; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from twinpeak.session import build_session  # noqa: E402
from twinpeak.workload import registry  # noqa: E402

HEADLINE = (
    "analyze_pairs", "analyze_status_counts", "sum_eic", "fragment_spectra", "dia_nearest_window",
    "pair_similarity", "ms1_annotate", "ms1_adaptive_calls", "run_comparison", "annotate_results",
    "ms2_views", "bh_adjust", "effect_sizes", "threshold_grid_fit", "binary_metrics", "shadow_apply",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "bench",
        **{
            "spark.master": f"local[{cpus}]",
            "spark.sql.shuffle.partitions": cpus if cpus.isdigit() else "8",
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            "spark.driver.memory": os.environ.get("BENCH_MEMORY", "16g"),
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    queries, seconds = registry.queries(), {}
    # Code is loaded and compiled once before anything is timed.
    small = os.path.join(os.path.dirname(sf_dir.rstrip("/")), "sf0.001")
    if os.path.isdir(small):
        queries["analyze_pairs"](spark, small).write.format("noop").mode("overwrite").save()
    for name in HEADLINE:
        started = time.perf_counter()
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - started, 3)
    targets = spark.read.parquet(f"{sf_dir}/customer.parquet").count()
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
                "targets_per_sec": round(targets / seconds["analyze_pairs"], 1),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
