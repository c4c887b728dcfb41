"""Times the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from barloom.catalog import all_queries
from barloom.session import local_session, release_scratch

HEADLINE = [
    "latest_features",
    "window_features",
    "window_features_unchecked",
    "screener_indicators",
    "asof_join",
    "dataset_build",
    "window_sequences",
    "bar_quality",
    "label_alignment",
    "duplicates_keep_last",
    "screen",
    "time_split",
    "stratified_split",
    "roc_auc",
    "score_summary",
    "numeric_summary",
    "spearman",
    "model_intersection",
    "overlap_counts",
    "future_return_buckets",
    "validate_logistic_regression",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session("barloom-bench", cpus, int(cpus) if cpus.isdigit() else 8)
    names = sys.argv[1:] or HEADLINE
    queries = all_queries()
    queries["bars_in_range"](spark, sf_dir).write.format("noop").mode("overwrite").save()  # start the JVM
    seconds = {}
    for name in names:
        start = time.perf_counter()
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
        release_scratch(spark)
    total = round(sum(seconds.values()), 3)
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": total,
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
                "cpus": cpus,
            }
        )
    )


if __name__ == "__main__":
    main()
