"""Projection, filters, counts, profiles."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import basics, hypothesis, profile
from ..storage import load
from .registry import query, union_all

PRICES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
LINE_KEY = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]


@query("project_limit", sql="""
SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_orderkey LIMIT 100""")
def project_limit(spark, folder):
    return basics.first_rows(load(spark, folder, "orders"), ["o_orderkey"], 100, ["o_orderkey", "o_totalprice"])


@query("drop_column", sql="SELECT c_custkey, c_name, c_nationkey, c_mktsegment FROM customer")
def drop_column(spark, folder):
    return basics.drop_column(load(spark, folder, "customer"), "c_acctbal")


@query("prune_all_null", sql="SELECT s_suppkey, s_acctbal FROM supplier")
def prune_all_null(spark, folder):
    s = load(spark, folder, "supplier").select(
        "s_suppkey", "s_acctbal", F.lit(None).cast("double").alias("empty"),
        F.when(F.col("s_suppkey") < 0, F.col("s_name")).alias("never"),
    )
    return basics.prune_all_null(s)


@query("cohort_filter", sql="SELECT * FROM customer WHERE CAST(c_nationkey AS VARCHAR) = '7'")
def cohort_filter(spark, folder):
    return basics.cohort(load(spark, folder, "customer"), "c_nationkey", "7")


@query("dropna_pair", sql="""
SELECT doc_id, quality, n_chars FROM documents LEFT JOIN labels USING (doc_id)
WHERE quality IS NOT NULL AND n_chars IS NOT NULL""")
def dropna_pair(spark, folder):
    both = load(spark, folder, "documents").join(load(spark, folder, "labels"), "doc_id", "left")
    return basics.complete_rows(both.select("doc_id", "quality", "n_chars"), ["quality", "n_chars"])


@query("iqr_outlier_rows", sql="""
WITH q AS (SELECT round(quantile_cont(value, 0.25), 4) AS q1, round(quantile_cont(value, 0.75), 4) AS q3 FROM events)
SELECT event_id, value FROM events, q
WHERE value < q1 - 1.5 * (q3 - q1) OR value > q3 + 1.5 * (q3 - q1)""")
def iqr_outlier_rows(spark, folder):
    return basics.iqr_outliers(load(spark, folder, "events").select("event_id", "value"), "value")


@query("table_shape", sql='SELECT count(*) AS "rows", CAST(11 AS BIGINT) AS "columns" FROM lineitem')
def table_shape(spark, folder):
    return basics.shape(load(spark, folder, "lineitem"))


@query("null_counts", sql=union_all(
    f"SELECT '{c}' AS \"column\", count(*) - count({c}) AS nulls FROM (SELECT * FROM documents LEFT JOIN labels USING (doc_id))"
    for c in ["doc_id", "text", "lang", "source", "n_chars", "quality", "toxic"]))
def null_counts(spark, folder):
    return basics.null_counts(load(spark, folder, "documents").join(load(spark, folder, "labels"), "doc_id", "left"))


@query("distinct_counts", sql=union_all(
    f"SELECT '{c}' AS \"column\", count(DISTINCT {c}) AS \"distinct\" FROM documents"
    for c in ["doc_id", "text", "lang", "source", "n_chars"]))
def distinct_counts(spark, folder):
    return basics.distinct_counts(load(spark, folder, "documents"))


@query("duplicate_count", sql="""
SELECT CAST(coalesce(sum(n - 1), 0) AS BIGINT) AS duplicates FROM (SELECT count(*) AS n FROM documents GROUP BY text)""")
def duplicate_count(spark, folder):
    return basics.duplicate_count(load(spark, folder, "documents").select("text"))


@query("dedup_rows", sql="SELECT DISTINCT c_nationkey, c_mktsegment FROM customer")
def dedup_rows(spark, folder):
    return basics.distinct_rows(load(spark, folder, "customer").select("c_nationkey", "c_mktsegment"))


@query("group_labels", sql="SELECT DISTINCT p_brand AS label FROM part ORDER BY 1 LIMIT 10")
def group_labels(spark, folder):
    return basics.labels(load(spark, folder, "part"), "p_brand")


# --- profiles -------------------------------------------------------------------


def numeric_profile_sql(table: str, columns) -> str:
    return union_all(f"""
SELECT '{c}' AS "column", count(v) AS "count", coalesce(round(avg(v), 4), 0.0) AS mean,
  round(max(q2), 4) AS median, coalesce(round(stddev_samp(v), 4), 0.0) AS std, round(min(v), 4) AS "min",
  round(max(v), 4) AS "max", max(q1) AS q1, max(q3) AS q3, round(max(q3) - max(q1), 4) AS iqr,
  count(*) FILTER (v < q1 - 1.5 * (q3 - q1) OR v > q3 + 1.5 * (q3 - q1)) AS outlier_count,
  coalesce(round(skewness(v), 4), 0.0) AS skewness
FROM (SELECT CAST({c} AS DOUBLE) AS v FROM {table}) t,
  (SELECT round(quantile_cont(CAST({c} AS DOUBLE), 0.25), 4) AS q1, quantile_cont(CAST({c} AS DOUBLE), 0.5) AS q2,
     round(quantile_cont(CAST({c} AS DOUBLE), 0.75), 4) AS q3 FROM {table}) q""" for c in columns)


@query("numeric_profile", sql=numeric_profile_sql("lineitem", PRICES))
def numeric_profile(spark, folder):
    return profile.numeric_profile(load(spark, folder, "lineitem"), PRICES)


@query("numeric_profile_events", sql=numeric_profile_sql("events", ["user_id", "value"]))
def numeric_profile_events(spark, folder):
    return profile.numeric_profile(load(spark, folder, "events"), ["user_id", "value"])


def categorical_sql(table: str, columns, top: int = 10) -> str:
    return union_all(f"""
SELECT '{c}' AS "column", cardinality, rank, value, n AS "count", round(n / total * 100, 1) AS pct FROM (
  SELECT CAST({c} AS VARCHAR) AS value, count(*) AS n, count(*) OVER () AS cardinality,
    CAST(sum(count(*)) OVER () AS BIGINT) AS total,
    row_number() OVER (ORDER BY count(*) DESC, CAST({c} AS VARCHAR)) AS rank
  FROM {table} WHERE {c} IS NOT NULL GROUP BY CAST({c} AS VARCHAR)) WHERE rank <= {top}""" for c in columns)


@query("categorical_profile", sql=categorical_sql("orders", ["o_orderpriority", "o_orderstatus"]))
def categorical_profile(spark, folder):
    return profile.categorical_profile(load(spark, folder, "orders"), ["o_orderpriority", "o_orderstatus"])


@query("categorical_profile_conversations", sql=categorical_sql("conversations", ["role", "text", "turn"]))
def categorical_profile_conversations(spark, folder):
    return profile.categorical_profile(load(spark, folder, "conversations"), ["role", "text", "turn"])


def cadence_sql(table: str, c: str) -> str:
    return f"""
SELECT '{c}' AS "column", count({c}) AS "values", median_gap_days, CASE WHEN count({c}) < 3 THEN 'irregular'
  WHEN median_gap_days <= 1 THEN 'daily' WHEN median_gap_days <= 8 THEN 'weekly' WHEN median_gap_days <= 35 THEN 'monthly'
  WHEN median_gap_days <= 100 THEN 'quarterly' ELSE 'yearly' END AS cadence
FROM {table}, (SELECT CAST(quantile_cont(floor((epoch_us({c}) - epoch_us(before)) / 86400000000.0), 0.5) AS DOUBLE) AS median_gap_days
  FROM (SELECT {c}, lag({c}) OVER (ORDER BY {c}) AS before FROM {table}) WHERE before IS NOT NULL)
GROUP BY median_gap_days"""


@query("cadence", sql=cadence_sql("events", "ts"))
def cadence(spark, folder):
    return profile.cadence(load(spark, folder, "events"), ["ts"])


@query("cadence_by_user_first_event", sql="WITH f AS (SELECT user_id, min(ts) AS first_seen FROM events GROUP BY 1)" + cadence_sql("f", "first_seen"))
def cadence_first(spark, folder):
    firsts = load(spark, folder, "events").groupBy("user_id").agg(F.min("ts").alias("first_seen"))
    return profile.cadence(firsts, ["first_seen"])


def datetime_sql(table: str, c: str) -> str:
    return f"""
SELECT '{c}' AS "column", strftime(min({c}), '%Y-%m-%d') AS min_date, strftime(max({c}), '%Y-%m-%d') AS max_date,
  CAST(floor((epoch_us(max({c})) - epoch_us(min({c}))) / 86400000000.0) AS BIGINT) AS date_range_days,
  (SELECT cadence FROM ({cadence_sql(table, c)})) AS detected_frequency, count(*) - count({c}) AS null_count
FROM {table}"""


@query("datetime_profile", sql=datetime_sql("events", "ts") + "\nUNION ALL\n" + datetime_sql("events", "prev"). replace(
    "FROM events", "FROM (SELECT date_trunc('day', ts) AS prev FROM events)"))
def datetime_profile(spark, folder):
    e = load(spark, folder, "events").select("ts", F.date_trunc("day", "ts").alias("prev"))
    return profile.datetime_profile(e, ["ts", "prev"])


@query("datetime_profile_orders", sql=datetime_sql("orders", "o_orderdate"))
def datetime_profile_orders(spark, folder):
    return profile.datetime_profile(load(spark, folder, "orders"), ["o_orderdate"])


@query("moments", sql=union_all(f"""
SELECT '{c}' AS "column", n AS "count", round(m3 / pow(m2, 1.5), 4) AS skewness, round(m4 / (m2 * m2) - 3, 4) AS kurtosis
FROM (SELECT count(*) AS n, avg(pow({c} - m, 2)) AS m2, avg(pow({c} - m, 3)) AS m3, avg(pow({c} - m, 4)) AS m4
  FROM lineitem, (SELECT avg({c}) AS m FROM lineitem))""" for c in PRICES))
def moments(spark, folder):
    return profile.moments(load(spark, folder, "lineitem"), PRICES)


def describe_sql(table: str, texts, numbers) -> str:
    parts = [f"""
SELECT '{c}' AS "column", count(v) AS "count", CAST(NULL AS BIGINT) AS "unique", CAST(NULL AS VARCHAR) AS top,
  CAST(NULL AS BIGINT) AS freq, round(avg(v), 4) AS mean, round(stddev_samp(v), 4) AS std, round(min(v), 4) AS "min",
  round(quantile_cont(v, 0.25), 4) AS q25, round(quantile_cont(v, 0.5), 4) AS q50, round(quantile_cont(v, 0.75), 4) AS q75,
  round(max(v), 4) AS "max" FROM (SELECT CAST({c} AS DOUBLE) AS v FROM {table})""" for c in numbers]
    parts += [f"""
SELECT '{c}', CAST(sum(n) AS BIGINT), count(*), arg_min(v, {{'a': -n, 'b': v}}), max(n), CAST(NULL AS DOUBLE), NULL, NULL, NULL, NULL, NULL, NULL
FROM (SELECT {c} AS v, count(*) AS n FROM {table} GROUP BY {c})""" for c in texts]
    return union_all(parts)


@query("describe_all", sql=describe_sql("part", ["p_name", "p_brand", "p_type"], ["p_partkey", "p_size", "p_retailprice"]))
def describe_all(spark, folder):
    return profile.describe_all(load(spark, folder, "part"))


@query("cohort_summary", sql="""
SELECT l_returnflag AS "group", count(*) AS size, round(avg(l_extendedprice), 4) AS mean,
  round(quantile_cont(l_extendedprice, 0.5), 4) AS median FROM lineitem GROUP BY 1""")
def cohort_summary(spark, folder):
    return hypothesis.cohort_summary(load(spark, folder, "lineitem"), "l_returnflag", "l_extendedprice")
