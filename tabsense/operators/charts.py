"""The numbers behind charts: every mark is computed from all rows of the table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import named, number
from ..storage import lookup_side
from .ordering import ONE_TASK_ROWS, grouped_quantiles, running_totals


def _bucket(c: Column, lo: float, hi: float, n: int) -> Column:
    """Left-closed buckets of equal width; the maximum falls in the last one."""
    if hi == lo:
        return F.lit(0).cast("bigint")
    return F.least(F.floor((c - F.lit(lo)) / F.lit((hi - lo) / n)), F.lit(n - 1)).cast("bigint")


def histogram(df: DataFrame, column: str, bins: int = 30, colour: str | None = None) -> DataFrame:
    """``(bucket, lo, hi, [colour], count)`` of the non-empty buckets."""
    c = number(df, column)
    r = df.agg(F.min(c).alias("lo"), F.max(c).alias("hi")).first()
    lo, hi = (r["lo"], r["hi"]) if r["lo"] is not None else (0.0, 0.0)
    keys = [_bucket(c, lo, hi, bins).alias("bucket")] + ([named(colour).alias("colour")] if colour else [])
    width = (hi - lo) / bins
    counted = df.where(c.isNotNull()).groupBy(*keys).agg(F.count(F.lit(1)).alias("count"))
    return counted.select(
        "bucket", F.round(F.lit(lo) + F.col("bucket") * width, 4).alias("lo"),
        F.round(F.lit(lo) + (F.col("bucket") + 1) * width, 4).alias("hi"), *(["colour"] if colour else []), "count",
    )


def box_stats(df: DataFrame, group: str, column: str, one_task_rows: int = ONE_TASK_ROWS) -> DataFrame:
    """Quartiles, whiskers and number of outliers per group."""
    rows = df.select(named(group).alias("group"), number(df, column).alias("x")).where(F.col("x").isNotNull())
    q = grouped_quantiles(rows, ["group"], F.col("x"), [0.25, 0.5, 0.75], one_task_rows).select(
        "group", F.col("q")[0].alias("q1"), F.col("q")[1].alias("median"), F.col("q")[2].alias("q3")
    )
    iqr = F.col("q3") - F.col("q1")
    inside = F.col("x").between(F.col("q1") - 1.5 * iqr, F.col("q3") + 1.5 * iqr)
    return rows.join(lookup_side(q), "group").groupBy("group").agg(
        F.count("x").alias("count"), F.round(F.max("q1"), 4).alias("q1"), F.round(F.max("median"), 4).alias("median"),
        F.round(F.max("q3"), 4).alias("q3"), F.round(F.min(F.when(inside, F.col("x"))), 4).alias("whisker_low"),
        F.round(F.max(F.when(inside, F.col("x"))), 4).alias("whisker_high"), F.count_if(~inside).alias("outliers"),
    )


def money_sum(c: Column) -> Column:
    """An exact, order-independent sum of values with two decimals."""
    return F.sum(c.cast("decimal(18,2)")).cast("double")


def _total(df: DataFrame, value: str, exact: bool) -> Column:
    return money_sum(number(df, value)) if exact else F.sum(number(df, value))


def share_of_total(df: DataFrame, names: str, value: str, exact: bool = False) -> DataFrame:
    """Pie slices: ``(name, total, pct)``."""
    sums = df.groupBy(named(names).alias("name")).agg(_total(df, value, exact).alias("total"))
    whole = sums.agg(F.sum("total").alias("_whole"))
    return sums.crossJoin(F.broadcast(whole)).select(
        "name", "total", F.round(F.try_divide("total", "_whole") * 100, 2).alias("pct")
    )


def bar_totals(df: DataFrame, x: str, y: str, colour: str | None = None, exact: bool = False) -> DataFrame:
    keys = [named(x).alias("x")] + ([named(colour).alias("colour")] if colour else [])
    return df.groupBy(*keys).agg(_total(df, y, exact).alias("total"))


def line_series(df: DataFrame, x: Column, measures: Sequence[str], exact: bool = False, name: str = "x") -> DataFrame:
    """One row per x with the sum of every measure, in x order."""
    return df.groupBy(x.alias(name)).agg(*[_total(df, m, exact).alias(m) for m in measures]).orderBy(named(name))


def area_series(df: DataFrame, x: Column, y: str, group: str, exact: bool = False) -> DataFrame:
    """``(x, group, total, stacked)``: the bands of a stacked area."""
    sums = df.groupBy(x.alias("x"), named(group).alias("group")).agg(_total(df, y, exact).alias("total"))
    below = running_totals(sums, [F.asc("group")], {"total": "_below"}, ["x"])
    return below.withColumn("stacked", F.col("_below") + F.col("total")).drop("_below")


def scatter_points(df: DataFrame, x: str, y: str, size: str | None = None, colour: str | None = None) -> DataFrame:
    """All points with both coordinates."""
    extra = [named(c).alias(n) for n, c in (("size", size), ("colour", colour)) if c]
    points = df.select(number(df, x).alias("x"), number(df, y).alias("y"), *extra)
    return points.where(F.col("x").isNotNull() & F.col("y").isNotNull())


def scatter_density(df: DataFrame, x: str, y: str, bins: int = 20, exact: bool = False) -> DataFrame:
    """Points and coordinate sums per cell of a ``bins`` x ``bins`` grid: a scatter of any number of rows."""
    cx, cy = number(df, x), number(df, y)
    rows = df.where(cx.isNotNull() & cy.isNotNull())
    r = rows.agg(F.min(cx).alias("x0"), F.max(cx).alias("x1"), F.min(cy).alias("y0"), F.max(cy).alias("y1")).first()
    lo = {k: r[k] if r[k] is not None else 0.0 for k in ("x0", "x1", "y0", "y1")}
    return rows.groupBy(
        _bucket(cx, lo["x0"], lo["x1"], bins).alias("x_bin"), _bucket(cy, lo["y0"], lo["y1"], bins).alias("y_bin")
    ).agg(F.count(F.lit(1)).alias("count"), _total(df, x, exact).alias("x_sum"), _total(df, y, exact).alias("y_sum"))


def pivot_heatmap(
    df: DataFrame, row: Column, column: str, value: str, column_values: Sequence[str], exact: bool = False
) -> DataFrame:
    """One row per ``row``, one column per value of ``column``, summed."""
    return df.groupBy(row.alias("row")).pivot(column, list(column_values)).agg(_total(df, value, exact))
