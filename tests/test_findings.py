"""Insights, report tables and chart data."""

import pytest
from pyspark.sql import functions as F

from tabsense.operators import charts, insights, report


def test_pareto_found(spark):
    rows = [("A", 100.0)] * 85 + [(f"s{i}", 1.0) for i in range(8)]
    df = spark.createDataFrame(rows, "category string, revenue double")
    for task in (10**6, 2):
        r = insights.pareto_drivers(df, ["category"], ["revenue"], one_task_rows=task).first()
        assert r["is_driver"] and (r["top_count"], r["groups"], r["leading_groups"]) == (1, 9, "A")
        assert r["covered_pct"] == 99.9


def test_pareto_needs_rows_groups_and_a_positive_total(spark):
    few = spark.createDataFrame([("a", 1.0)] * 5, "c string, x double")
    two = spark.createDataFrame([("a", 1.0)] * 30 + [("b", 1.0)], "c string, x double")
    negative = spark.createDataFrame([("a", -1.0)] * 10 + [("b", -2.0), ("d", -3.0)], "c string, x double")
    for df in (few, two, negative):
        assert not insights.pareto_drivers(df, ["c"], ["x"]).first()["is_driver"]


def test_equal_totals_tie_whatever_the_order_of_rows(spark):
    rows = [("b", 0.1), ("b", 0.2), ("b", 0.3), ("a", 0.3), ("a", 0.2), ("a", 0.1), ("c", 1e-12), ("d", float("inf")), ("e", 1e25)]
    df = spark.createDataFrame(rows, "c string, x double").coalesce(1)
    got = insights.pareto_table(df, "c", "x").orderBy("position").collect()
    assert [r["group"] for r in got] == ["d", "e", "a", "b", "c"]
    assert [r["total"] for r in got] == [float("inf"), 1e25, 0.6, 0.6, 1e-12]
    names = insights.pareto_drivers(df.where("c in ('a', 'b')"), ["c"], ["x"]).first()["leading_groups"]
    assert names == "a, b"


def test_disparity(spark):
    rows = [("Basic", 10.0)] * 40 + [("Enterprise", 35.0)] * 10 + [("Tiny", 900.0)] * 2
    df = spark.createDataFrame(rows, "tier string, value double")
    r = insights.subgroup_disparity(df.where("tier <> 'Tiny'"), ["tier"], ["value"]).first()
    assert r["is_disparity"] and r["group"] == "Enterprise" and r["severity"] == "Medium"
    # groups under five rows do not count, but they are part of the baseline
    with_tiny = insights.subgroup_disparity(df, ["tier"], ["value"]).first()
    assert with_tiny["group"] == "Enterprise" and with_tiny["eligible_groups"] == 2


def test_scan_ranks_and_limits(spark):
    rows = [(i, None if i % 10 < 7 else "x", "A" if i < 90 else f"c{i % 9}", 500.0 if i < 90 else 1.0) for i in range(100)]
    df = spark.createDataFrame(rows + rows[:3], "id int, col_a string, cat string, val double")
    found = insights.insight_scan(df).collect()
    assert found[0]["id"] == "risk_high_missingness" and found[0]["severity"] == "Critical"
    assert found[0]["metrics"]["worst_column"] == "col_a"
    # the first metric that hits stands for the category
    assert "pareto_cat_id" in [r["id"] for r in found] and "risk_duplicates" in [r["id"] for r in found]
    assert [r["impact"] for r in found] == sorted((r["impact"] for r in found), reverse=True)
    assert insights.insight_scan(df, 2).count() == 2
    b = insights.insight_briefing(df).first()
    assert b["rows"] == 103 and b["critical"] == 1 and "Missing values" in b["risks"]


def test_clean_table_has_no_findings(spark):
    df = spark.createDataFrame([(i, "ab"[i % 2]) for i in range(40)], "n int, c string")
    assert insights.insight_scan(df).count() == 0
    assert insights.insight_briefing(df).first()["signals"] == ""


def test_report(spark):
    df = spark.createDataFrame([(1, "a"), (None, "b"), (3, None)], "a int, b string")
    k = report.kpi_scorecard(df).first()
    assert (k["missing_cells"], k["duplicate_rows"]) == (2, 0) and k["integrity_score"] == 33.3
    full = report.kpi_scorecard(spark.range(50).toDF("x")).first()
    assert full["integrity_score"] == 100.0
    c = report.column_summary(df).orderBy("position").collect()
    assert [(r["column"], r["non_null"], r["unique"], r["null_pct"]) for r in c] == [("a", 2, 2, 33.3), ("b", 2, 2, 33.3)]
    f = [(r["finding"], r["value"]) for r in report.report_findings(df).orderBy("seq").collect()]
    assert f == [("missing_cells", 2), ("no_duplicates", 0), ("numeric_columns", 1)]
    assert report.quality_score(df).first()["quality_score"] == 50


def test_charts(spark):
    df = spark.createDataFrame([(float(i), "ab"[i % 2], i % 3) for i in range(60)] + [(None, "a", 0)], "x double, g string, k int")
    hist = charts.histogram(df, "x", 10).collect()
    assert len(hist) == 10 and sum(r["count"] for r in hist) == 60 and max(r["bucket"] for r in hist) == 9
    assert sum(r["count"] for r in charts.histogram(df, "x", 4, "g").collect()) == 60
    box = {r["group"]: r for r in charts.box_stats(df.unionByName(spark.createDataFrame([(9999.0, "a", 1)], df.schema)), "g", "x").collect()}
    assert box["a"]["outliers"] == 1 and box["a"]["whisker_high"] == 58.0
    pie = charts.share_of_total(df, "g", "x").collect()
    assert sum(r["pct"] for r in pie) == pytest.approx(100)
    assert charts.scatter_points(df, "x", "k", colour="g").count() == 60
    assert sum(r["count"] for r in charts.scatter_density(df, "x", "k", 5).collect()) == 60
    area = charts.area_series(df, F.col("k"), "x", "g").orderBy("x", "group").collect()
    assert area[1]["stacked"] == area[0]["total"] + area[1]["total"]
    line = charts.line_series(df, F.col("k"), ["x"], name="k").collect()
    assert [r["k"] for r in line] == [0, 1, 2] and sum(r["x"] for r in line) == sum(range(60))
    heat = charts.pivot_heatmap(df, F.col("k"), "g", "x", ["a", "b"])
    assert heat.columns == ["row", "a", "b"] and heat.count() == 3
