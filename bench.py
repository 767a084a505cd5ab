"""Time the headline queries and print one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8) choose data and cores. Every
query runs once to warm up and then BENCH_RUNS times (default 2); the median counts.
"""

from __future__ import annotations

import json
import os
import statistics
import time

from underwrite.plans import catalog
from underwrite.session import build_session

HEADLINE = (
    "b12_derived_ratios",
    "d02_expectations",
    "d07_exact_medians",
    "w07_one_row_per_id",
    "d24_auc_gini",
    "d29_confusion_rates",
    "d31_optimal_threshold",
    "d34_auc_interval",
    "d37_pairwise_comparison",
    "d46_reliability_table",
    "d48_gains_table",
    "d49_vintage_stability",
    "d39_bootstrap_interval",
    "d14_feature_drift",
    "d18_weight_of_evidence",
    "w05_ddm",
    "w06_page_hinkley",
    "c01_delayed_labels",
    "p01_policy_decision",
    "p04_sticky_assignment",
    "p08_concept_report",
    "p13_comparable_population",
    "o02_top_factors",
    "o05_bounded_sample",
    "t01_tumbling_windows",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "2"))
    spark = build_session("bench", cpus, spark__sql__shuffle__partitions=cpus, spark__driver__memory="12g")
    spark.sparkContext.setLogLevel("ERROR")
    seconds = {}
    for name in HEADLINE:
        plan = catalog.QUERIES[name].plan
        times = []
        for _ in range(runs + 1):
            start = time.perf_counter()
            plan(spark, sf_dir).write.format("noop").mode("overwrite").save()
            times.append(time.perf_counter() - start)
        seconds[name] = round(statistics.median(times[1:] or times), 3)
    total = round(sum(seconds.values()), 3)
    sf = os.path.basename(os.path.normpath(sf_dir)).removeprefix("sf")
    print(json.dumps({"metric": "headline_queries_total", "value": total, "unit": "sec", "queries": seconds, "sf": sf}))
    spark.stop()


if __name__ == "__main__":
    main()
