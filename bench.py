"""Headline queries: warm wall time per query, median of three runs, as one JSON line."""

from __future__ import annotations

import json
import os
import statistics
import time

from creditspark.plans import QUERIES
from creditspark.session import build_session

HEADLINE = [
    "a01_portfolio_kpis", "a07_risk_mix_by_month", "a10_vintage_analysis", "a11_cohort_retention", "r01_composite_risk", "r02_risk_by_level",
    "e08_features_demographic", "a18_describe", "a25_quality_score", "a27_correlation_matrix", "c04_outlier_flags", "e21_psi", "v04_roc_auc",
    "v07_threshold_sweep", "l05_fairness_report", "w07_linear_forecast",
]


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session("bench", f"local[{cpus}]", **{
        "spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "12g", "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    times = {}
    for name in HEADLINE:
        runs = []
        for i in range(4):
            start = time.perf_counter()
            QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - start)
        times[name] = round(statistics.median(runs[1:]), 4)  # the first run warms up
    print(json.dumps({"metric": "headline_total_warm_seconds", "value": round(sum(times.values()), 4), "unit": "sec", "queries": times,
                      "sf": os.path.basename(sf.rstrip("/"))}))
    spark.stop()


if __name__ == "__main__":
    main()
