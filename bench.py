"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Every query runs once on the smallest tables first, so the times are those of a
warm session.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import SparkSession  # noqa: E402

from tabsense.plans.catalog import QUERIES  # noqa: E402

HEADLINE = [
    "numeric_profile", "categorical_profile", "datetime_profile_orders", "describe_all", "null_counts", "distinct_counts",
    "duplicate_count", "semantic_types", "column_health", "table_health", "clean_table", "eda_report", "standard_scale",
    "quantile_bins", "datetime_parts", "histogram", "box_stats", "scatter_density", "ttest_welch", "mann_whitney", "kruskal",
    "levene", "normality", "correlation_pairs", "spearman", "pareto_drivers", "subgroup_disparity", "insight_scan",
    "kpi_scorecard", "isolation_forest", "knn_classify", "classification_metrics", "regression_metrics",
    "revenue_by_segment", "region_quarter", "top_part", "csv_export_roundtrip", "leaderboard", "leaderboard_regression",
    "batch_score",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench")
        .config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    spark.sparkContext.setLogLevel("OFF")
    spark.range(1000).selectExpr("sum(id)").collect()
    # compile and warm up on the smallest tables, then time
    small = os.environ.get("BENCH_WARM_DIR", "/root/testdata/sf0.001")
    if os.path.isdir(small):
        for name in names:
            QUERIES[name](spark, small).write.format("noop").mode("overwrite").save()
    times = {}
    for name in names:
        start = time.time()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - start, 3)
    print(json.dumps({
        "metric": "total_query_time", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
        "sf": os.path.basename(folder.rstrip("/")).replace("sf", ""),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
