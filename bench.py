"""Warm run times of the headline queries; prints one JSON line."""

from __future__ import annotations

import json
import os
import statistics
import time

from casewatch.registry.queries import all_queries
from casewatch.session import local_session

HEADLINE = [
    "alerts_recent_weeks", "alerts_by_year", "weekly_aggregate", "disease_summary",
    "weekly_series", "department_ranking", "municipality_ranking", "age_distribution",
    "sex_by_place", "clean_cases", "text_normalize", "date_parse_two_pass",
    "dedupe_cases", "quality_report", "reject_split", "upsert_predictions",
    "monthly_panel", "temporal_features", "prior_features", "inference_lags",
    "stratified_split", "describe_table", "correlation_matrix", "box_stats",
]
# Whole jobs, run once.
JOBS = ["full_etl", "forest_train_score"]
RUNS = int(os.environ.get("BENCH_RUNS", "3"))


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cores)
    known = all_queries()
    times = {}
    for name in HEADLINE + JOBS:
        runs = []
        for _ in range(1 if name in JOBS else RUNS):
            start = time.perf_counter()
            known[name](spark, folder).write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - start)
        times[name] = round(statistics.median(runs), 3)
    print(json.dumps({
        "metric": "total_warm_median_seconds", "value": round(sum(times.values()), 3),
        "unit": "sec", "queries": times, "sf": os.path.basename(folder.rstrip("/")),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
