"""Types, audit and cleaning, one behaviour per test."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tabsense.functions.columns import to_moment
from tabsense.operators import dates
from tabsense.operators import quality
from tabsense.operators.basics import (
    complete_rows, distinct_counts, drop_column, duplicate_count, first_rows, iqr_outliers, labels, null_counts, project,
    prune_all_null, shape,
)


@pytest.fixture
def simple(spark):
    return spark.createDataFrame(
        [
            ("C1", 25, 100.0, "Gold", "Yes", "2023-01-01", "  hello "),
            ("C2", None, 250.5, "Silver", "No", "2023-02-15", "fine"),
            ("C3", 41, None, "Gold", "yes", "2023-03-10", "ok"),
            ("C4", 33, 80.0, "Gold", "no", "2023-04-01", "good text"),
            ("C5", 29, 90.0, "Silver", "Y", "2023-05-05", " x"),
        ],
        "customer_id string, age int, revenue double, category string, churn string, signup_date string, notes string",
    )


def test_types(simple):
    got = quality.types_of(simple)
    assert got == {
        "customer_id": "id_text", "age": "numeric", "revenue": "numeric", "category": "categorical", "churn": "boolean",
        "signup_date": "datetime", "notes": "categorical",
    }


@pytest.mark.parametrize("values,schema,name,want", [
    ([0, 1, 1, None], "int", "flag", "boolean"),
    ([0, 1, 2], "int", "n", "numeric"),
    ([True, False], "boolean", "b", "boolean"),
    ([None, None], "string", "nothing", "text"),
    ([" 45 ", "1068.00", "missing"], "string", "charge", "numeric"),
    (["2023-01-15", "15/02/2023", "2023/03/10"], "string", "join_date", "datetime"),
    (["2023-01-15", "soon"], "string", "join_date", "categorical"),
    (["a", "b"], "string", "sku", "id_text"),
    ([f"v{i}" for i in range(25)], "string", "name", "id_text"),
    ([f"v{i}" for i in range(40)] * 2, "string", "name", "text"),
    ([f"v{i}" for i in range(40)] * 10, "string", "name", "categorical"),
    ([dt.datetime(2024, 1, 1), dt.datetime(2024, 1, 2)], "timestamp", "seen", "datetime"),
])
def test_type_rules(spark, values, schema, name, want):
    df = spark.createDataFrame([(v,) for v in values], f"{name} {schema}")
    assert quality.types_of(df) == {name: want}


def test_audit(simple):
    h = {r["column"]: r for r in quality.column_health(simple).collect()}
    assert h["age"]["missing_count"] == 1 and h["age"]["missing_pct"] == 20.0
    assert h["notes"]["has_padding"] and "edge whitespace" in h["notes"]["warnings"]
    assert not h["category"]["has_padding"] and h["category"]["unique_count"] == 2
    t = quality.table_health(simple).first()
    assert (t["total_rows"], t["total_columns"], t["duplicate_rows"], t["missing_cells"]) == (5, 7, 0, 2)
    assert quality.health_anomalies(simple).count() == 0
    assert [tuple(r) for r in quality.health_recommendations(simple).collect()] == [("trim_whitespace", "notes")]


def test_null_tokens_count_as_missing_and_clean_to_null(spark):
    tokens = ["n/a", "N/A", "none", "NA", "null", "valid", "NULL", "N.A."]
    df = spark.createDataFrame([(t,) for t in tokens], "val string")
    assert quality.column_health(df).first()["missing_count"] == 7
    assert [r["val"] for r in quality.clean_table(df).where("val IS NOT NULL").collect()] == ["valid"]


def test_sparse_column_is_an_anomaly(spark):
    df = spark.createDataFrame([(i, None if i < 8 else 1.0) for i in range(10)], "id int, sparse double")
    assert [tuple(r) for r in quality.health_anomalies(df).collect()] == [("high_missingness", "sparse", 80.0)]


def test_duplicates_and_order_of_steps(spark):
    rows = [(1, "a"), (2, "b"), (3, "c"), (1, "a"), (2, "b"), (3, " c")]
    df = spark.createDataFrame(rows, "x int, y string")
    assert duplicate_count(df).first()["duplicates"] == 2
    cleaned = sorted(tuple(r) for r in quality.clean_table(df).collect())
    # the padded row differs when duplicates are removed, so it stays
    assert cleaned == [(1, "a"), (2, "b"), (3, "c"), (3, "c")]
    log = {(r["step"], r["column"]): r["affected"] for r in quality.clean_log(df).collect()}
    assert log == {("remove_duplicates", None): 2, ("trim_whitespace", "y"): 1}


def test_coercion_threshold(spark):
    df = spark.createDataFrame([("1", "1"), ("2 ", "x"), ("3", "y"), ("4", "2"), ("1d", "3")], "a string, b string")
    out = quality.clean_table(df)
    assert dict(out.dtypes) == {"a": "double", "b": "string"}
    assert sorted(r["a"] for r in out.collect() if r["a"] is not None) == [1.0, 2.0, 3.0, 4.0]
    assert dict(quality.clean_table(df, coerce_numeric=False).dtypes)["a"] == "string"


def test_clean_table_unchanged(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "x int, y string")
    assert quality.clean_log(df).count() == 0
    assert sorted(map(tuple, quality.clean_table(df).collect())) == [(1, "a"), (2, "b")]


def test_unicode_whitespace_is_trimmed(spark):
    df = spark.createDataFrame([(" a\t",), ("b　",), ("c\n",)], "t string")
    assert sorted(r["t"] for r in quality.clean_table(df).collect()) == ["a", "b", "c"]


def test_basics(spark, simple):
    assert project(simple).columns == simple.columns
    assert project(simple, ["age"]).columns == ["age"]
    with pytest.raises(ValueError):
        drop_column(simple, "nope")
    assert "age" not in drop_column(simple, "age").columns
    assert [r["customer_id"] for r in first_rows(simple, ["customer_id"], 2).collect()] == ["C1", "C2"]
    assert first_rows(simple, ["customer_id"], None).count() == 5
    assert tuple(shape(simple).first()) == (5, 7)
    assert {r["column"]: r["nulls"] for r in null_counts(simple).collect()}["revenue"] == 1
    assert complete_rows(simple, ["age", "revenue"]).count() == 3
    empty = simple.withColumn("void", F.lit(None).cast("string"))
    assert "void" not in prune_all_null(empty).columns
    assert [r["label"] for r in labels(simple, "category").collect()] == ["Gold", "Silver"]


def test_distinct_counts_of_long_text(spark):
    df = spark.createDataFrame([("x" * 200 + str(i % 7), i % 3) for i in range(50)], "t string, k int")
    assert {r["column"]: r["distinct"] for r in distinct_counts(df).collect()} == {"t": 7, "k": 3}


def test_nan_is_missing(spark):
    df = spark.createDataFrame([(1.0,), (float("nan"),), (None,)], "x double")
    assert null_counts(df).first()["nulls"] == 2
    assert distinct_counts(df).first()["distinct"] == 1


def test_iqr_outliers(spark):
    df = spark.createDataFrame([(float(i),) for i in range(20)] + [(500.0,)], "x double")
    assert [r["x"] for r in iqr_outliers(df, "x").collect()] == [500.0]


def test_date_texts(spark):
    shapes = {
        "1/5/2024": "2024-01-05 00:00:00", "2024-01-15T10:00:00Z": "2024-01-15 10:00:00", "2024-01-15 10:00:00.123": "2024-01-15 10:00:00.123",
        "2024-01-15 10:00": "2024-01-15 10:00:00", "Jan 5, 2024": "2024-01-05 00:00:00", "20240115": "2024-01-15 00:00:00",
        "15-02-2023": "2023-02-15 00:00:00", "15/02/2023": "2023-02-15 00:00:00", "12/31/2023 9:05": "2023-12-31 09:05:00",
        "September 15, 2023": "2023-09-15 00:00:00", "Sept 15, 2023": "2023-09-15 00:00:00", "3 march 2024": "2024-03-03 00:00:00",
        "2024-01-15T10:00:00.5+05:30": "2024-01-15 10:00:00.5", "15.2.2023": "2023-02-15 00:00:00", " 2023/3/1 ": "2023-03-01 00:00:00",
        "Market 5, 2024": None, "2024-13-01": None, "31/31/2024": None, "12345678": None, "10:00": None, "": None, "text 1": None,
    }
    rows = spark.createDataFrame([(k,) for k in shapes] + [(None,)], "t string")
    got = {r["t"]: r["m"] for r in rows.select("t", to_moment(F.col("t")).cast("timestamp_ntz").cast("string").alias("m")).collect()}
    assert got == {**shapes, None: None}


@pytest.mark.parametrize("text,want", [
    ("01/15/24", "2024-01-15 00:00:00"), ("2024-01", "2024-01-01 00:00:00"), ("01/15/2024 3:05 PM", "2024-01-15 15:05:00"), ("Mon, 15 Jan 2024", "2024-01-15 00:00:00"),
    ("1/5/70", "1970-01-05 00:00:00"), ("24-01-15", "2015-01-24 00:00:00"), ("2024-01-15 12:30:01 a.m.", "2024-01-15 00:30:01"), ("Jan 2024", "2024-01-01 00:00:00"),
    ("Tuesday 16 January 2024 09:10", "2024-01-16 09:10:00"), ("2024-13", None), ("Monday", None), ("12:30 PM", None), ("1234-56", None), ("99/99/99", None),
])
def test_more_dates(spark, text, want):
    got = spark.createDataFrame([(text,)], "d string").select(to_moment(F.col("d")).cast("string").alias("d")).first()["d"]
    assert got == want


def test_one_order_for_a_column(spark):
    df = spark.createDataFrame([("13/01/2024", "01/13/2024", "13/01/24", "x"), ("02/01/2024", "02/01/2024", "2/1/24", None), ("05.03.2024", None, " 3/4/2024 ", "y")], "a string, b string, c string, d string")
    assert dates.day_first_columns(df, df.columns) == {"a", "c"}
    rows = dates.parse_dates(df, df.columns).select(*[F.date_format(c, "yyyy-MM-dd").alias(c) for c in "abcd"]).collect()
    assert [r["a"] for r in rows] == ["2024-01-13", "2024-01-02", "2024-03-05"] and [r["b"] for r in rows] == ["2024-01-13", "2024-02-01", None]
    assert [r["c"] for r in rows] == ["2024-01-13", "2024-01-02", "2024-04-03"] and {r["d"] for r in rows} == {None}
    shapes = {(r["column"], r["shape"]): (r["n"], r["readable"], r["day_first"]) for r in dates.date_shapes(df).collect()}
    assert shapes["a", "99/99/9999"] == (2, 2, 1) and shapes["d", "A"] == (2, 0, 0)


@pytest.mark.parametrize("lookup_rows", [0, 3, 1000])
def test_repeated_date_texts_are_read_once_or_cell_by_cell(spark, lookup_rows):
    rows = [(i, ["03/04/24", " 25/12/24 ", None, "no date"][i % 4], f"2024-01-{i % 28 + 1:02d}", "2024-05") for i in range(80)]
    df = spark.createDataFrame(rows, "id int, a string, b string, c string")
    got = dates.parse_dates(df, ["a", "b", "c", "id"], lookup_rows)
    assert got.columns == df.columns and got.count() == 80
    day = [F.date_format(c, "yyyy-MM-dd").alias(c) for c in "abc"]
    want = [(i, ["2024-04-03", "2024-12-25", None, None][i % 4], b, "2024-05-01") for i, _, b, _ in rows]
    assert [tuple(r) for r in got.select("id", *day).orderBy("id").collect()] == want
