"""Profiles against hand-computed values."""

import datetime as dt

import pandas as pd
import pytest

from tabsense.operators import profile


@pytest.fixture
def mixed(spark):
    return spark.createDataFrame(
        [
            ("O1", 100.0, 1, "A", "Yes", "2024-01-01"), ("O2", 250.0, 2, "B", "No", "2024-02-01"),
            ("O3", 80.0, 1, "A", "Yes", "2024-03-01"), ("O4", 400.0, 5, "C", "No", "2024-04-01"),
            ("O5", 175.0, 3, "A", "Yes", "2024-05-08"),
        ],
        "order_id string, revenue double, units int, category string, churn string, signup_date string",
    )


TYPES = {
    "order_id": "id_text", "revenue": "numeric", "units": "numeric", "category": "categorical", "churn": "boolean",
    "signup_date": "datetime",
}


def test_numeric(mixed):
    r = profile.numeric_profile(mixed, ["revenue"]).first()
    s = pd.Series([100.0, 250, 80, 400, 175])
    assert (r["mean"], r["min"], r["max"], r["count"], r["median"]) == (201.0, 80.0, 400.0, 5, 175.0)
    assert r["std"] == round(s.std(), 4) and r["skewness"] == round(s.skew(), 4)
    assert (r["q1"], r["q3"], r["iqr"], r["outlier_count"]) == (100.0, 250.0, 150.0, 0)


def test_numeric_of_constant_empty_and_text(spark):
    df = spark.createDataFrame([(7.0, None, "1"), (7.0, None, " 3 "), (7.0, None, "bad")], "c double, e double, t string")
    got = {r["column"]: r for r in profile.numeric_profile(df, ["c", "e", "t"]).collect()}
    assert got["c"]["std"] == 0.0 and got["c"]["skewness"] == 0.0 and got["c"]["median"] == 7.0
    assert got["e"]["count"] == 0 and got["e"]["mean"] == 0.0
    assert got["t"]["count"] == 2 and got["t"]["mean"] == 2.0


def test_categorical(mixed):
    rows = profile.categorical_profile(mixed, ["category", "churn"]).collect()
    top = {(r["column"], r["rank"]): (r["value"], r["count"], r["pct"]) for r in rows}
    assert top[("category", 1)] == ("A", 3, 60.0)
    assert {r["cardinality"] for r in rows if r["column"] == "category"} == {3}
    # ties go to the smaller value
    assert top[("category", 2)][0] == "B"


def test_categorical_limit(spark):
    df = spark.createDataFrame([(f"v{i % 30}",) for i in range(900)], "c string")
    out = profile.categorical_profile(df, ["c"])
    assert out.count() == 10 and out.first()["cardinality"] == 30


def test_datetime(mixed):
    r = profile.datetime_profile(mixed, ["signup_date"]).first()
    assert (r["min_date"], r["max_date"], r["date_range_days"]) == ("2024-01-01", "2024-05-08", 128)
    assert r["detected_frequency"] == "monthly" and r["null_count"] == 0


@pytest.mark.parametrize("dates,label", [
    (["2024-01-01", "2024-01-02"], "irregular"),
    (["2024-01-01", "2024-01-02", "2024-01-03"], "daily"),
    (["2024-01-01", "2024-01-08", "2024-01-15"], "weekly"),
    (["2024-01-01", "2024-04-01", "2024-07-01"], "quarterly"),
    (["2021-01-01", "2022-01-01", "2023-01-01"], "yearly"),
    (["2024-01-01", "2024-01-01", "2024-01-01", "2024-06-01"], "daily"),
])
def test_cadence(spark, dates, label):
    df = spark.createDataFrame([(d,) for d in dates], "d string")
    assert profile.cadence(df, ["d"]).first()["cadence"] == label


def test_gaps_are_whole_days_not_midnights(spark):
    # gaps: 2 hours over midnight, 49 hours, 3 hours, 25 hours
    times = [dt.datetime(2024, 1, 1, 23), dt.datetime(2024, 1, 2, 1), dt.datetime(2024, 1, 4, 2), dt.datetime(2024, 1, 4, 5),
             dt.datetime(2024, 1, 5, 6)]
    df = spark.createDataFrame([(t,) for t in times] + [(None,)], "t timestamp")
    r = profile.date_facts(df, ["t"]).first()
    assert (r["values"], r["null_count"], r["median_gap_days"]) == (5, 1, 0.5)


def test_unreadable_dates(spark):
    df = spark.createDataFrame([("2024-01-01",), ("soon",), (None,), ("31/12/2024",)], "d string")
    r = profile.datetime_profile(df, ["d"]).first()
    assert (r["null_count"], r["max_date"]) == (2, "2024-12-31")
    none = profile.datetime_profile(spark.createDataFrame([("x",)], "d string"), ["d"]).first()
    assert (none["min_date"], none["date_range_days"], none["detected_frequency"]) == ("N/A", 0, "irregular")


def test_report_and_headlines(mixed):
    rows = profile.eda_report(mixed, TYPES).collect()
    assert {r["kind"] for r in rows} == {"numeric", "categorical", "datetime"}
    assert {r["column"] for r in rows} == {"revenue", "units", "category", "churn", "signup_date"}
    facts = {r["fact"]: r for r in profile.eda_headlines(mixed, TYPES).collect()}
    assert facts["rows"]["number"] == 5 and facts["most_variable"]["column"] == "revenue"
    assert facts["top_value"]["text"] == "A" and facts["time_span"]["number"] == 128


def test_describe_and_schema(mixed):
    d = {r["column"]: r for r in profile.describe_all(mixed).collect()}
    assert d["category"]["top"] == "A" and d["category"]["freq"] == 3 and d["category"]["mean"] is None
    assert d["revenue"]["q50"] == 175.0 and d["revenue"]["unique"] is None
    s = {r["column"]: r for r in profile.schema_summary(mixed, TYPES).collect()}
    assert s["units"]["non_null"] == 5 and s["category"]["samples"] == "A | A | C"
