"""Time the headline queries and print one JSON line.

Environment: BENCH_SF_DIR (table folder), BENCH_CPUS (local cores).
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from tillwise.plans import catalog, tables  # noqa: E402
from tillwise.session import build_session  # noqa: E402

HEADLINE = [
    "retail_tx", "customer_360", "revenue_at_risk", "campaign_roi", "customer_segments", "clv_trends_monthly",
    "clv_insights", "geo_city", "geo_rollup", "what_if_formula", "one_hot", "targets", "zscore", "exact_split",
    "numeric_profile", "corr_long", "dq_drift", "dq_summary", "class_metrics", "roc_auc", "error_percentiles",
    "threshold_tuning", "gd_linear_exact", "stump_round", "score_logistic_regression_classification",
    "score_decision_tree_classification", "score_random_forest_classification", "score_least_squares_regression",
    "score_boosted_trees_regression", "score_mlp_classification", "score_kmeans_classification",
    "score_stumps_classification", "corr_wide", "stratified_split", "sample_lines",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "tillwise-bench",
        f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": cpus,
            "spark.driver.memory": "12g",
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    queries = catalog.all_queries()
    spark.read.parquet(f"{sf_dir}/orders.parquet").groupBy("o_orderpriority").count().collect()  # start workers
    times = {}
    start = time.perf_counter()
    tables.customers(spark, sf_dir)  # built once, read by most queries below: a line of its own
    times["customer_build"] = round(time.perf_counter() - start, 3)
    for name in HEADLINE:
        start = time.perf_counter()
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
        print(f"{name} {times[name]}", file=sys.stderr, flush=True)
    print(
        json.dumps(
            {
                "metric": "total time of headline queries",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
