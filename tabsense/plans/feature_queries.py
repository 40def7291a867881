"""Feature columns, chart data, preset business questions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import anomaly, charts, correlation, features
from ..storage import load
from .derived import MESSY_SQL, messy_orders
from .registry import query

KEY = "o_orderkey"


def _orders(spark, folder):
    return load(spark, folder, "orders").select(KEY, "o_totalprice")


def _shown(df, *names):
    return df.select(KEY, *[F.round(n, 4).alias(n) for n in names])


@query("log_sqrt", sql="""
SELECT event_id, round(ln(1 + greatest(coalesce(x, 0), 0)), 4) AS x_log, round(sqrt(greatest(coalesce(x, 0), 0)), 4) AS x_sqrt
FROM (SELECT event_id, CASE WHEN event_type <> 'error' THEN value - 20 END AS x FROM events)""")
def log_sqrt(spark, folder):
    e = load(spark, folder, "events").select(
        "event_id", F.when(F.col("event_type") != "error", F.col("value") - 20).alias("x")
    )
    out, _ = features.log_transform(e, "x")
    out, _ = features.sqrt_transform(out, "x")
    return out.select("event_id", F.round("x_log", 4).alias("x_log"), F.round("x_sqrt", 4).alias("x_sqrt"))


@query("standard_scale", sql=f"""
WITH {MESSY_SQL}, s AS (SELECT avg(sparse) AS m, stddev_pop(sparse) AS sd FROM messy)
SELECT o_orderkey, round((sparse - m) / sd, 4) AS sparse_zscore, CAST(0.0 AS DOUBLE) AS constant_zscore FROM messy, s""")
def standard_scale(spark, folder):
    out, _ = features.standard_scale(messy_orders(spark, folder), "sparse")
    out, _ = features.standard_scale(out, "constant")
    return _shown(out, "sparse_zscore", "constant_zscore")


@query("minmax_scale", sql=f"""
WITH {MESSY_SQL}, s AS (SELECT min(sparse) AS lo, max(sparse) AS hi FROM messy)
SELECT o_orderkey, round((sparse - lo) / (hi - lo), 4) AS sparse_scaled, CAST(0.0 AS DOUBLE) AS constant_scaled FROM messy, s""")
def minmax_scale(spark, folder):
    out, _ = features.minmax_scale(messy_orders(spark, folder), "sparse")
    out, _ = features.minmax_scale(out, "constant")
    return _shown(out, "sparse_scaled", "constant_scaled")


@query("quantile_bins", sql="""
WITH q AS (SELECT min(o_totalprice) AS e0, quantile_cont(o_totalprice, 0.25) AS e1, quantile_cont(o_totalprice, 0.5) AS e2,
  quantile_cont(o_totalprice, 0.75) AS e3, max(o_totalprice) AS e4 FROM orders),
b AS (SELECT o_orderkey, CASE WHEN o_totalprice <= e1 THEN 0 WHEN o_totalprice <= e2 THEN 1 WHEN o_totalprice <= e3 THEN 2 ELSE 3 END AS i,
  [e0, e1, e2, e3, e4] AS e FROM orders, q)
SELECT o_orderkey, CAST(i AS INTEGER) AS o_totalprice_bin_index, round(e[i + 1], 4) AS o_totalprice_bin_lo, round(e[i + 2], 4) AS o_totalprice_bin_hi FROM b""")
def quantile_bins(spark, folder):
    out, _ = features.bin_column(_orders(spark, folder), "o_totalprice")
    return out.select(KEY, "o_totalprice_bin_index", *[F.round(f"o_totalprice_bin_{k}", 4).alias(f"o_totalprice_bin_{k}") for k in ("lo", "hi")])


@query("width_bins", sql="""
WITH s AS (SELECT min(o_totalprice) AS lo, max(o_totalprice) AS hi FROM orders),
b AS (SELECT o_orderkey, lo, hi, CASE WHEN o_totalprice <= lo + (hi - lo) * 1 / 5 THEN 0 WHEN o_totalprice <= lo + (hi - lo) * 2 / 5 THEN 1
  WHEN o_totalprice <= lo + (hi - lo) * 3 / 5 THEN 2 WHEN o_totalprice <= lo + (hi - lo) * 4 / 5 THEN 3 ELSE 4 END AS i FROM orders, s)
SELECT o_orderkey, CAST(i AS INTEGER) AS o_totalprice_bin_index, round(lo + (hi - lo) * i / 5, 4) AS o_totalprice_bin_lo,
  round(CASE WHEN i = 4 THEN hi ELSE lo + (hi - lo) * (i + 1) / 5 END, 4) AS o_totalprice_bin_hi FROM b""")
def width_bins(spark, folder):
    out, _ = features.bin_column(_orders(spark, folder), "o_totalprice", 5, "width")
    return out.select(KEY, "o_totalprice_bin_index", *[F.round(f"o_totalprice_bin_{k}", 4).alias(f"o_totalprice_bin_{k}") for k in ("lo", "hi")])


@query("datetime_parts", sql="""
SELECT o_orderkey, CAST(year(d) AS INTEGER) AS d_year, CAST(month(d) AS INTEGER) AS d_month, CAST(day(d) AS INTEGER) AS d_day,
  CAST(isodow(d) - 1 AS INTEGER) AS d_dayofweek, CAST(coalesce(isodow(d) >= 6, false) AS INTEGER) AS d_is_weekend
FROM (SELECT o_orderkey, CASE WHEN o_orderstatus <> 'P' THEN o_orderdate END AS d FROM orders)""")
def datetime_parts(spark, folder):
    o = load(spark, folder, "orders").select(KEY, F.when(F.col("o_orderstatus") != "P", F.col("o_orderdate")).alias("d"))
    out, _ = features.date_parts(o, "d", ["year", "month", "day", "dayofweek", "is_weekend"])
    return out.drop("d")


@query("interaction", sql=f"""
WITH {MESSY_SQL} SELECT o_orderkey, round(coalesce(sparse, 0) * constant, 4) AS sparse_x_constant,
  round(constant / (coalesce(sparse, 0) + 1e-6), 4) AS constant_per_sparse FROM messy""")
def interaction(spark, folder):
    out, _ = features.interaction(messy_orders(spark, folder), "sparse", "constant")
    out, _ = features.interaction(out, "constant", "sparse", "ratio")
    return _shown(out, "sparse_x_constant", "constant_per_sparse")


@query("median_impute", sql=f"""
WITH {MESSY_SQL}, m AS (SELECT quantile_cont(sparse, 0.5) AS med FROM messy)
SELECT o_orderkey, round(coalesce(sparse, med), 4) AS sparse, constant FROM messy, m""")
def median_impute(spark, folder):
    m = messy_orders(spark, folder).select(KEY, "sparse", "constant", F.lit(None).cast("double").alias("void"))
    return _shown(anomaly.median_impute(m, ["sparse", "constant", "void"]), "sparse", "constant")


@query("robust_scale", sql=f"""
WITH {MESSY_SQL}, q AS (SELECT quantile_cont(sparse, 0.25) AS a, quantile_cont(sparse, 0.5) AS b, quantile_cont(sparse, 0.75) AS c FROM messy)
SELECT o_orderkey, round((sparse - b) / (c - a), 4) AS sparse, CAST(0.0 AS DOUBLE) AS constant FROM messy, q""")
def robust_scale(spark, folder):
    return _shown(anomaly.robust_scale(messy_orders(spark, folder), ["sparse", "constant"]), "sparse", "constant")


# --- chart data -------------------------------------------------------------------------


def _histogram_sql(table: str, c: str, bins: int, colour: str | None = None) -> str:
    col = f", {colour} AS colour" if colour else ""
    return f"""
WITH s AS (SELECT min(CAST({c} AS DOUBLE)) AS a, max(CAST({c} AS DOUBLE)) AS b FROM {table}),
t AS (SELECT CAST(least(floor((CAST({c} AS DOUBLE) - a) / ((b - a) / {bins})), {bins - 1}) AS BIGINT) AS bucket, a, (b - a) / {bins} AS w{col}
  FROM {table}, s WHERE {c} IS NOT NULL)
SELECT bucket, round(a + bucket * w, 4) AS lo, round(a + (bucket + 1) * w, 4) AS hi{', colour' if colour else ''}, count(*) AS "count"
FROM t GROUP BY ALL"""


@query("histogram", sql=_histogram_sql("orders", "o_totalprice", 30))
def histogram(spark, folder):
    return charts.histogram(load(spark, folder, "orders"), "o_totalprice")


@query("histogram_by_group", sql=_histogram_sql("events", "value", 12, "event_type"))
def histogram_by_group(spark, folder):
    return charts.histogram(load(spark, folder, "events"), "value", 12, "event_type")


@query("box_stats", sql="""
WITH q AS (SELECT lang AS g, quantile_cont(CAST(n_chars AS DOUBLE), 0.25) AS q1, quantile_cont(CAST(n_chars AS DOUBLE), 0.5) AS med,
  quantile_cont(CAST(n_chars AS DOUBLE), 0.75) AS q3 FROM documents GROUP BY lang),
t AS (SELECT g, q1, med, q3, CAST(n_chars AS DOUBLE) AS x, n_chars BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1) AS inside
  FROM documents JOIN q ON lang = g)
SELECT g AS "group", count(*) AS "count", round(max(q1), 4) AS q1, round(max(med), 4) AS median, round(max(q3), 4) AS q3,
  min(x) FILTER (inside) AS whisker_low, max(x) FILTER (inside) AS whisker_high, count(*) FILTER (NOT inside) AS outliers
FROM t GROUP BY g""")
def box_stats(spark, folder):
    return charts.box_stats(load(spark, folder, "documents"), "lang", "n_chars")


MONEY = "CAST(sum(CAST({} AS DECIMAL(18,2))) AS DOUBLE)"


@query("share_of_total", sql=f"""
WITH s AS (SELECT o_orderpriority AS name, {MONEY.format('o_totalprice')} AS total FROM orders GROUP BY 1)
SELECT name, total, round(total / (SELECT sum(total) FROM s) * 100, 2) AS pct FROM s""")
def share_of_total(spark, folder):
    return charts.share_of_total(load(spark, folder, "orders"), "o_orderpriority", "o_totalprice", exact=True)


@query("bar_totals", sql=f"""
SELECT l_returnflag AS x, l_linestatus AS colour, {MONEY.format('l_extendedprice')} AS total FROM lineitem GROUP BY ALL""")
def bar_totals(spark, folder):
    return charts.bar_totals(load(spark, folder, "lineitem"), "l_returnflag", "l_extendedprice", "l_linestatus", exact=True)


@query("line_series", sql=f"""
SELECT strftime(l_shipdate, '%Y-%m') AS x, {MONEY.format('l_quantity')} AS l_quantity, {MONEY.format('l_extendedprice')} AS l_extendedprice
FROM lineitem GROUP BY 1""")
def line_series(spark, folder):
    month = F.date_format("l_shipdate", "yyyy-MM")
    return charts.line_series(load(spark, folder, "lineitem"), month, ["l_quantity", "l_extendedprice"], exact=True)


@query("area_series", sql=f"""
WITH s AS (SELECT strftime(o_orderdate, '%Y-%m') AS x, o_orderstatus AS "group", {MONEY.format('o_totalprice')} AS total FROM orders GROUP BY ALL)
SELECT x, "group", total, round(sum(total) OVER (PARTITION BY x ORDER BY "group"), 2) AS stacked FROM s""")
def area_series(spark, folder):
    month = F.date_format("o_orderdate", "yyyy-MM")
    out = charts.area_series(load(spark, folder, "orders"), month, "o_totalprice", "o_orderstatus", exact=True)
    return out.withColumn("stacked", F.round("stacked", 2))


@query("scatter_points", sql="""
SELECT CAST(l_quantity AS DOUBLE) AS x, l_extendedprice AS y, l_discount AS size, l_returnflag AS colour FROM lineitem""")
def scatter_points(spark, folder):
    return charts.scatter_points(load(spark, folder, "lineitem"), "l_quantity", "l_extendedprice", "l_discount", "l_returnflag")


@query("scatter_density", sql=f"""
WITH s AS (SELECT min(l_quantity) AS x0, max(l_quantity) AS x1, min(l_extendedprice) AS y0, max(l_extendedprice) AS y1 FROM lineitem)
SELECT CAST(least(floor((l_quantity - x0) / ((x1 - x0) / 20)), 19) AS BIGINT) AS x_bin,
  CAST(least(floor((l_extendedprice - y0) / ((y1 - y0) / 20)), 19) AS BIGINT) AS y_bin,
  count(*) AS "count", {MONEY.format('l_quantity')} AS x_sum, {MONEY.format('l_extendedprice')} AS y_sum
FROM lineitem, s GROUP BY 1, 2""")
def scatter_density(spark, folder):
    return charts.scatter_density(load(spark, folder, "lineitem"), "l_quantity", "l_extendedprice", exact=True)


@query("pivot_heatmap", sql=f"""
SELECT strftime(o_orderdate, '%Y') AS "row", {', '.join(
    f"CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) FILTER (o_orderstatus = '{s}') AS DOUBLE) AS {s}" for s in 'FOP')}
FROM orders GROUP BY 1""")
def pivot_heatmap(spark, folder):
    year = F.date_format("o_orderdate", "yyyy")
    return charts.pivot_heatmap(load(spark, folder, "orders"), year, "o_orderstatus", "o_totalprice", ["F", "O", "P"], exact=True)


# --- preset business questions -------------------------------------------------------------


def revenue():
    """Price less discount, in exact decimals."""
    share = F.lit(1).cast("decimal(3,2)") - F.col("l_discount").cast("decimal(3,2)")
    return F.col("l_extendedprice").cast("decimal(18,2)") * share


REVENUE_SQL = "CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2)) * (CAST(1 AS DECIMAL(3,2)) - CAST(l_discount AS DECIMAL(3,2)))) AS DOUBLE)"


@query("revenue_by_segment", sql=f"""
SELECT c_mktsegment, round({REVENUE_SQL}, 2) AS revenue, count(*) AS lines
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey GROUP BY 1""")
def revenue_by_segment(spark, folder):
    """Discounted line value summed per market segment."""
    # summed per order first: the joins then move orders, not lines
    lines = load(spark, folder, "lineitem").groupBy("l_orderkey").agg(F.sum(revenue()).alias("r"), F.count(F.lit(1)).alias("n"))
    orders = load(spark, folder, "orders").select("o_orderkey", "o_custkey")
    customers = load(spark, folder, "customer").select("c_custkey", "c_mktsegment")
    joined = lines.join(orders, lines.l_orderkey == orders.o_orderkey).join(customers, orders.o_custkey == customers.c_custkey)
    return joined.groupBy("c_mktsegment").agg(F.round(F.sum("r").cast("double"), 2).alias("revenue"), F.sum("n").alias("lines"))


@query("monthly_revenue", sql=f"""
SELECT strftime(o_orderdate, '%Y-%m') AS month, {MONEY.format('o_totalprice')} AS sales, count(*) AS orders FROM orders GROUP BY 1 ORDER BY 1""")
def monthly_revenue(spark, folder):
    """Order value and count per calendar month."""
    return (
        load(spark, folder, "orders").groupBy(F.date_format("o_orderdate", "yyyy-MM").alias("month"))
        .agg(charts.money_sum(F.col("o_totalprice")).alias("sales"), F.count(F.lit(1)).alias("orders")).orderBy("month")
    )


@query("top_part", sql=f"""
SELECT p_partkey, p_name, round({REVENUE_SQL}, 2) AS revenue FROM lineitem JOIN part ON l_partkey = p_partkey
GROUP BY 1, 2 ORDER BY 3 DESC, 1 LIMIT 1""")
def top_part(spark, folder):
    """The part that earned the most, by name."""
    sums = load(spark, folder, "lineitem").groupBy("l_partkey").agg(F.sum(revenue()).alias("r"))
    # summed before the join: one row per part meets one row per part
    parts = load(spark, folder, "part").select("p_partkey", "p_name")
    joined = sums.join(parts, sums.l_partkey == parts.p_partkey)
    return joined.select("p_partkey", "p_name", F.round(F.col("r").cast("double"), 2).alias("revenue")).orderBy(
        F.desc("revenue"), "p_partkey").limit(1)


@query("quantity_distribution", sql=_histogram_sql("lineitem", "l_quantity", 10))
def quantity_distribution(spark, folder):
    """Histogram of the ordered quantities."""
    return charts.histogram(load(spark, folder, "lineitem"), "l_quantity", 10)


@query("revenue_quantity_corr", sql="""
SELECT round(corr(l_extendedprice * (1 - l_discount), l_quantity), 4) AS correlation, count(*) AS n FROM lineitem""")
def revenue_quantity_corr(spark, folder):
    """Pearson correlation of line value and quantity."""
    amount = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    return load(spark, folder, "lineitem").agg(
        F.round(correlation.safe_corr(amount, F.col("l_quantity")), 4).alias("correlation"), F.count(F.lit(1)).alias("n")
    )


@query("region_quarter", sql=f"""
SELECT r_name, {', '.join(f"CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) FILTER (quarter(o_orderdate) = {i}) AS DOUBLE) AS q{i}" for i in (1, 2, 3, 4))}
FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1""")
def region_quarter(spark, folder):
    """Order value per region and quarter."""
    price = F.col("o_totalprice").cast("decimal(18,2)")
    per_customer = load(spark, folder, "orders").groupBy("o_custkey", F.quarter("o_orderdate").alias("q")).agg(F.sum(price).alias("s"))
    # 25 nations and 5 regions, whatever the scale
    places = load(spark, folder, "nation").join(load(spark, folder, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    joined = per_customer.join(load(spark, folder, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(
        F.broadcast(places.select("n_nationkey", "r_name")), F.col("c_nationkey") == F.col("n_nationkey"))
    return joined.groupBy("r_name").agg(*[F.sum(F.when(F.col("q") == i, F.col("s"))).cast("double").alias(f"q{i}") for i in (1, 2, 3, 4)])
