"""Order statistics against numpy and brute force, on every route."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tabsense.operators import ordering, ranks
from tabsense.operators.ordering import (
    average_ranks, grouped_quantiles, numeric_quantiles, quantiles, running_totals,
)

PROBS = [0.0, 0.1, 0.25, 0.5, 0.75, 0.95, 1.0]


@pytest.fixture(scope="module")
def skewed(spark):
    """One key holds most rows, one value a third of them, and there are gaps."""
    rng = np.random.default_rng(5)
    x = rng.exponential(10, 6000)
    x[rng.random(6000) < 0.33] = 3.5
    g = np.where(rng.random(6000) < 0.7, "hot", np.char.add("g", rng.integers(0, 9, 6000).astype(str)))
    pdf = pd.DataFrame({"id": range(6000), "g": g, "x": x, "y": rng.normal(size=6000)})
    pdf.loc[::17, "x"] = np.nan
    return pdf, spark.createDataFrame(pdf).repartition(5)


@pytest.mark.parametrize("state,task", [(10**6, 10**6), (10, 10**6), (10, 5)])
def test_quantiles_match_numpy(skewed, monkeypatch, state, task):
    monkeypatch.setattr(ordering, "BRACKET_SAMPLE", 1500)
    pdf, df = skewed
    cells = {c: F.when(~F.isnan(c), F.col(c)) for c in ("x", "y")}
    got = quantiles(df, cells, PROBS, one_state_rows=state, one_task_rows=task)
    for c in ("x", "y"):
        assert np.allclose(got[c], np.quantile(pdf[c].dropna(), PROBS), rtol=1e-12)


def test_brackets_that_miss_are_opened(skewed, monkeypatch):
    pdf, df = skewed
    monkeypatch.setattr(ordering, "_bracket", lambda p, i, m, q: (1e9, 2e9))
    got = quantiles(df, {"y": F.col("y")}, [0.5], one_state_rows=10)
    assert got["y"][0] == pytest.approx(pdf["y"].median())


def test_quantiles_of_nothing(spark):
    df = spark.createDataFrame([(None,), (None,)], "x double")
    assert numeric_quantiles(df, ["x"], [0.5]) == {"x": None}


@pytest.mark.parametrize("state,hot,task", [(10**6, 1000, 10**6), (1000, 1000, 10**6), (100, 1000, 50), (100, 2, 10**6), (100, 2, 50)])
def test_grouped_quantiles_match_numpy(skewed, monkeypatch, state, hot, task):
    monkeypatch.setattr(ordering, "BRACKET_SAMPLE", 2000)
    pdf, df = skewed
    value = F.when(~F.isnan("x"), F.col("x"))
    out = grouped_quantiles(df, ["g"], value, PROBS, one_state_rows=state, hot_keys=hot, one_task_rows=task)
    got = {r["g"]: r["q"] for r in out.collect()}
    want = pdf.dropna().groupby("g")["x"].apply(lambda s: np.quantile(s, PROBS))
    assert set(got) == set(want.index)
    for g in want.index:
        assert np.allclose(got[g], want[g], rtol=1e-12), g


def test_grouped_quantiles_of_counted_rows(skewed):
    pdf, df = skewed
    counted = df.where(~F.isnan("x")).groupBy("g", "x").agg(F.count("*").alias("c"))
    for state in (10**6, 100):
        out = grouped_quantiles(counted, ["g"], F.col("x"), [0.5], weight="c", one_state_rows=state)
        want = pdf.dropna().groupby("g")["x"].median()
        for r in out.collect():
            assert r["q"][0] == pytest.approx(want[r["g"]])


@pytest.mark.parametrize("task", [10**6, 3])
def test_average_ranks(skewed, task):
    pdf, df = skewed
    s = pdf["x"].dropna()
    want = dict(zip(s, s.rank()))
    rows = average_ranks(df, F.when(~F.isnan("x"), F.col("x")), one_task_rows=task).collect()
    assert len(rows) == s.nunique()
    assert all(want[r["value"]] == r["avg_rank"] for r in rows)


@pytest.mark.parametrize("task", [10**6, 3])
def test_running_totals_by_key(skewed, task):
    pdf, df = skewed
    out = running_totals(
        df.select("id", "g", F.lit(2).alias("w")), [F.desc("id")], {"w": "before"}, ["g"], one_task_rows=task
    ).toPandas()
    want = pdf.sort_values("id", ascending=False).assign(w=2)
    want["before"] = want.groupby("g")["w"].cumsum() - 2
    merged = out.merge(want[["id", "before"]], on="id")
    assert (merged["before_x"] == merged["before_y"]).all() and len(merged) == len(pdf)


def test_stitched_ranks(skewed):
    """A value with a third of the rows lies in several partitions; runs of ties cross their edges."""
    pdf, df = skewed
    cells = {"x": F.when(~F.isnan("x"), F.col("x")), "y": F.col("y"), "k": (F.col("id") % 3).cast("double"), "one": F.lit(1.0)}
    spark = df.sparkSession
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "23")
    try:
        out = ranks.stitched_ranks(df, cells, "id")
        rows = out.collect()
        hot = out.where("column = 'one'").groupBy(F.spark_partition_id()).count().collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert len(hot) > 4 and max(r["count"] for r in hot) < 2500
    table = pd.DataFrame({"x": pdf["x"], "y": pdf["y"], "k": pdf["id"] % 3, "one": 1.0}).rank()
    got = {(r["_row"], r["column"]): r["avg_rank"] for r in rows}
    assert got == {(i, c): table[c][i] for c in table for i in range(len(pdf)) if not np.isnan(table[c][i])}


def test_ranks_of_nothing_and_of_nan(spark):
    df = spark.createDataFrame([(1, None, float("nan")), (2, None, 1.0), (3, None, float("nan"))], "id bigint, a double, b double")
    got = {(r["_row"], r["column"]): r["avg_rank"] for r in ranks.stitched_ranks(df, {"a": F.col("a"), "b": F.col("b")}, "id").collect()}
    assert got == {(2, "b"): 1.0, (1, "b"): 2.5, (3, "b"): 2.5}
    assert ranks.rank_table(df.where("false"), {"a": F.col("a")}).count() == 0


def test_runs_of_ties_cross_batches(spark, skewed):
    """Batches of three cells: most runs go on in the next batch, some in the next partition."""
    _, df = skewed
    df = df.where("id < 400").select("id", (F.col("id") % 4).cast("double").alias("k"), F.floor(F.col("id") / 5).cast("double").alias("f"))
    before = {k: spark.conf.get(k) for k in ("spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.shuffle.partitions")}
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    try:
        rows = ranks.stitched_ranks(df, {"k": F.col("k"), "f": F.col("f")}, "id").collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    table = df.toPandas().set_index("id")[["k", "f"]].rank()
    assert len(rows) == 2 * len(table)
    assert all(table[r["column"]][r["_row"]] == r["avg_rank"] for r in rows)


def test_sorted_cells_are_kept_by_batches(spark, monkeypatch):
    """One row per cell took longer to write and read again than to sort."""
    kept = []
    real = ranks.materialize
    monkeypatch.setattr(ranks, "materialize", lambda df: kept.append(real(df)) or kept[-1])
    df = spark.range(20_000).select("id", (F.col("id") * 7919 % 20_011).cast("double").alias("x"), (F.col("id") % 3).cast("double").alias("y"))
    out = ranks.stitched_ranks(df, {"x": F.col("x"), "y": F.col("y")}, "id")
    assert out.agg(F.count("*"), F.sum("avg_rank")).first() == (40_000, 20_000 * 20_001.0)
    assert sum(k.count() for k in kept) < 100
