"""Times the headline queries on $BENCH_SF_DIR with local[$BENCH_CPUS]; prints one JSON line."""
from __future__ import annotations

import json
import os
import sys
import time

from segstat import queries as registered
from segstat.session import local_session

# One or two headline queries per family.
HEADLINE = [
    "flagship_site_report",
    "A06_signal_stats", "A08_site_quality", "A09_duplicate_groups",
    "B11_quarantine_records", "B13_box_audit",
    "C05_preprocess", "C07_baseline", "C13_classify_events", "C14_longest_contiguous_run",
    "D08_min_lag_correlation", "D09_features28", "D11_feature_quality",
    "E03_cohort_difference",
    "F02_holdout_split", "F04_nested_folds",
    "G01_auroc", "G10_evaluate", "G12_bootstrap_intervals", "G13_paired_difference", "G23_spearman",
    "H16_feature_response", "H19_extreme_cases", "H26_box_suppression",
    "I06_annotation_agreement", "J02_partition_suppression", "K08_exact_quantiles",
    "M03_resource_windows", "M04_counter_rate",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    spark = local_session(cpus, "segstat-bench", "16g", 8)
    # One untimed query starts the JVM's workers and code generation.
    registered.QUERIES["G04_brier"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    times: dict[str, float] = {}
    for name in names:
        start = time.time()
        registered.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - start, 3)
    label = os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")
    print(json.dumps({"metric": "headline_total_seconds", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": float(label) if label.replace(".", "", 1).isdigit() else label}))
    spark.stop()


if __name__ == "__main__":
    main()
