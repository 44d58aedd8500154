"""Time the headline queries; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "cohort_exclusions",
    "exclusion_waterfall",
    "base_rates",
    "numeric_profile",
    "orphan_counts",
    "activity_features",
    "activity_volume",
    "activity_breadth",
    "submission_stats",
    "due_not_submitted",
    "feature_table",
    "percentile_nonnull_only",
    "threshold_sweep",
    "average_precision",
    "recall_at_budget",
    "calibration_ece",
    "slice_metrics",
    "bootstrap_interval",
    "psi_numeric",
    "module_decomposition",
    "grouped_contribution",
    "returning_performance",
    "rd_standard_errors",
    "rd_covariate_balance",
    "density_test_binned",
]


def main() -> None:
    from cohortlens.catalog import load
    from cohortlens.functions.session import local_session

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session("bench", cpus, int(cpus) if cpus.isdigit() else 8)
    spark.sparkContext.setLogLevel("ERROR")
    queries, _ = load()
    queries["split_label"](spark, sf_dir).collect()
    took: dict[str, float] = {}
    for name in HEADLINE:
        start = time.time()
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        took[name] = round(time.time() - start, 3)
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(took.values()), 3),
                "unit": "sec",
                "queries": took,
                "sf": sf_dir.rsplit("sf", 1)[-1].strip("/"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
