"""Time the headline queries and print one JSON line.

BENCH_SF_DIR   input folder (default /root/testdata/sf0.1)
BENCH_CPUS     local cores (default 8)
BENCH_QUERIES  comma-separated names instead of the headline list
Every query is built and run to the last row ``RUNS`` times; the best run counts.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from riskloom.plans import queries as registry  # noqa: E402
from riskloom.session import build_session, remove_work  # noqa: E402

HEADLINE = [
    "flags", "json_parse", "validate_transactions", "windowed_features", "trailing_window",
    "trailing_direct", "labeled_transactions", "pit_join", "training_set", "feature_matrix",
    "stratified_split", "online_user_features", "score_features", "confusion_metrics", "roc_auc",
    "top3_contributors", "reasons", "amount_histogram", "histogram_quantile", "prediction_rate_5m",
    "velocity_60s", "windowed_append_stream", "trailing_update_stream",
    "pit_join_any_age", "exact_trailing_5m", "bronze_replay", "flags_stream", "scores_stream",
    "training_set_from_layers", "shapley_fixed_trees", "gain_importances_fixed", "counter_rate_5m",
    "sketched_quantiles",
]
RUNS = 3


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = [n for n in os.environ.get("BENCH_QUERIES", "").split(",") if n] or HEADLINE
    spark = build_session(
        "riskloom-bench", f"local[{cpus}]", int(cpus),
        {
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            "spark.driver.memory": "8g",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    rows = registry.tables.read_events(spark, sf_dir).count()
    queries = registry.queries()
    # Start the JVM's compilers and the Python workers before the clock does.
    queries["training_set"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    seconds = {}
    for name in names:
        runs = []
        for _ in range(RUNS):
            start = time.perf_counter()
            queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - start)
        seconds[name] = round(min(runs), 3)
        remove_work(spark)
    spark.stop()
    print(json.dumps({
        "metric": "total seconds of the headline queries, best of %d runs" % RUNS,
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
        "events": rows,
        "events_per_sec": {n: round(rows / s) for n, s in seconds.items()},
        "cpus": int(cpus),
    }))


if __name__ == "__main__":
    main()
