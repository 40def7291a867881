"""Feature columns, versions and diffs with closed-form values."""

import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from tabsense.operators import features as fe
from tabsense.operators.versions import VersionedTable, dataset_diff
from tabsense.storage import new_folder


@pytest.fixture
def sample(spark):
    days = [dt.datetime(2024, 1, d) for d in range(5, 10)]
    return spark.createDataFrame(
        list(zip([10.0, 50.0, 200.0, 1000.0, 5000.0], [1, 2, 5, 10, 20], days, "ABABA")),
        "sales double, quantity int, ts timestamp, category string",
    )


def column(df, c):
    return [r[c] for r in df.orderBy("quantity").collect()]


def test_log_and_sqrt(sample):
    out, action = fe.log_transform(sample, "sales")
    assert column(out, "sales_log")[0] == pytest.approx(math.log1p(10)) and action.target == "sales_log"
    out, _ = fe.sqrt_transform(sample, "quantity", "root")
    assert column(out, "root")[1] == pytest.approx(math.sqrt(2))


def test_log_of_negative_and_missing_is_zero(spark):
    df = spark.createDataFrame([(-5.0,), (None,), (float("nan"),)], "x double")
    assert {r["x_log"] for r in fe.log_transform(df, "x")[0].collect()} == {0.0}


def test_scaling(sample):
    z = column(fe.standard_scale(sample, "sales")[0], "sales_zscore")
    assert sum(z) == pytest.approx(0) and sum(v * v for v in z) / 5 == pytest.approx(1)
    m = column(fe.minmax_scale(sample, "sales")[0], "sales_scaled")
    assert min(m) == 0 and max(m) == 1


def test_scaling_constant_and_null(spark):
    df = spark.createDataFrame([(7.0, 1.0), (None, None), (7.0, 3.0)], "c double, x double")
    for f in (fe.standard_scale, fe.minmax_scale):
        out, _ = f(df, "c", "k")
        assert [r["k"] for r in out.collect()] == [0.0, 0.0, 0.0]
        out, _ = f(df, "x", "k")
        assert sum(r["k"] is None for r in out.collect()) == 1


def test_bins(sample, spark):
    out, _ = fe.bin_column(sample, "sales", 2)
    assert column(out, "sales_bin_index") == [0, 0, 0, 1, 1]
    wide, _ = fe.bin_column(sample, "quantity", 2, "width")
    assert column(wide, "quantity_bin_index") == [0, 0, 0, 0, 1]
    # equal edges are merged
    df = spark.createDataFrame([(1.0,)] * 8 + [(2.0,), (None,)], "x double")
    assert {r["x_bin_index"] for r in fe.bin_column(df, "x", 4)[0].collect()} == {0, None}


def test_date_parts(sample):
    out, _ = fe.date_parts(sample, "ts")
    assert column(out, "ts_dayofweek") == [4, 5, 6, 0, 1] and column(out, "ts_is_weekend") == [0, 1, 1, 0, 0]
    assert "ts_year" not in out.columns
    gone = sample.withColumn("ts", F.lit(None).cast("timestamp"))
    assert set(column(fe.date_parts(gone, "ts")[0], "ts_is_weekend")) == {0}


def test_interaction(sample):
    assert column(fe.interaction(sample, "sales", "quantity")[0], "sales_x_quantity")[1] == 100.0
    assert column(fe.interaction(sample, "sales", "quantity", "ratio")[0], "sales_per_quantity")[0] == pytest.approx(10 / 1.000001)
    with pytest.raises(ValueError):
        fe.interaction(sample, "sales", "quantity", "power")
    with pytest.raises(ValueError):
        fe.remove_column(sample, "nope")


def test_versions(spark, sample):
    t = VersionedTable(spark, new_folder(spark, "v"))
    assert t.commit(sample, name="Raw") == 0 and not t.can_undo
    logged, action = fe.log_transform(t.read(), "sales")
    assert t.commit(logged, action) == 1 and t.can_undo and not t.can_redo
    assert t.undo() == 0 and "sales_log" not in t.read().columns and t.can_redo
    assert t.redo() == 1 and "sales_log" in t.read().columns
    assert t.redo() is None and t.jump_to(9) is None
    assert t.jump_to(0) == 0 and t.undo() is None
    slim, action = fe.remove_column(t.read(), "category")
    assert t.commit(slim, action) == 1
    log = t.audit_log().orderBy("version").collect()
    assert [(r["name"], r["rows"], r["columns"], r["is_current"]) for r in log] == [
        ("Raw", 5, 4, False), ("dropped category", 5, 3, True)]
    # a second reader sees the same state
    assert VersionedTable(spark, t.root).version == 1
    assert t.read(0).columns == sample.columns
    with pytest.raises(ValueError):
        t.read(5)


def test_a_commit_that_died_is_not_seen(spark, sample, monkeypatch):
    t = VersionedTable(spark, new_folder(spark, "v"))
    t.commit(sample, name="Raw")
    with monkeypatch.context() as m:
        m.setattr(VersionedTable, "_put", lambda *_: (_ for _ in ()).throw(RuntimeError("lost")))
        with pytest.raises(RuntimeError):
            t.commit(sample.limit(1))
    assert t.version == 0 and t.read().count() == 5
    assert t.commit(sample.limit(2), name="Next") == 1 and t.read().count() == 2
    assert [r["name"] for r in VersionedTable(spark, t.root).audit_log().orderBy("version").collect()] == ["Raw", "Next"]


def test_two_writers_give_two_versions(spark, sample):
    from concurrent.futures import ThreadPoolExecutor

    root = new_folder(spark, "v")
    VersionedTable(spark, root).commit(sample, name="Raw")
    with ThreadPoolExecutor(4) as pool:
        got = list(pool.map(lambda n: VersionedTable(spark, root).commit(sample.limit(n), name=f"w{n}"), range(1, 5)))
    t = VersionedTable(spark, root)
    log = {r["version"]: (r["name"], r["rows"]) for r in t.audit_log().collect()}
    assert sorted(got) == [1, 2, 3, 4] and {log[v] for v in got} == {(f"w{n}", n) for n in range(1, 5)}
    assert all(t.read(v).count() == log[v][1] for v in got)


def test_a_taken_number_is_not_overwritten(spark, sample):
    t = VersionedTable(spark, new_folder(spark, "v"))
    t.commit(sample, name="Raw")
    assert not t._put(0, {"kind": "move", "version": 0}) and t._put(1, {"kind": "move", "version": 0})
    assert t.events().count() == 2


def test_diff(sample):
    after, _ = fe.log_transform(sample.drop("category").where("quantity > 1"), "sales")
    after = after.withColumn("quantity", F.when(F.col("quantity") > 2, F.col("quantity")))
    d = dataset_diff(sample, after).first()
    assert (d["rows_delta"], d["cols_delta"], d["missing_delta"]) == (-1, 0, 1)
    assert (d["columns_added"], d["columns_removed"]) == ("sales_log", "category")
