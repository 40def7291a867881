"""Types, audit, cleaning, EDA report, sources, sinks, versions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.columns import to_moment
from ..operators import basics, dates, features, profile, quality, versions
from ..sources import delimited, sinks
from ..storage import load, new_folder
from .basic_queries import categorical_sql, datetime_sql, numeric_profile_sql
from .derived import (
    MESSY_KINDS, MESSY_SQL, TYPE_CASE, facts_sql, messy_orders, sql_moment, sql_number, sql_strip, sql_token,
)
from .registry import query, union_all

EVENT_KINDS = {"event_id": "number", "ts": "moment", "user_id": "number", "event_type": "text", "value": "number", "props": "text"}
CUSTOMER_KINDS = {"c_custkey": "number", "c_name": "text", "c_nationkey": "number", "c_acctbal": "number", "c_mktsegment": "text"}
MESSY_FACTS = f"WITH {MESSY_SQL}, facts AS ({facts_sql('messy', MESSY_KINDS)})"
DUPES = "(SELECT CAST(sum(n - 1) AS BIGINT) AS duplicates FROM (SELECT " + ", ".join(MESSY_KINDS) + ", count(*) AS n FROM messy GROUP BY ALL))"


@query("null_tokens", sql=f"""
WITH {MESSY_SQL} SELECT o_orderkey, amount_text FROM messy WHERE {sql_token('amount_text')}""")
def null_tokens(spark, folder):
    return basics.null_token_rows(messy_orders(spark, folder), "amount_text").select("o_orderkey", "amount_text")


@query("whitespace_cells", sql=f"""
WITH {MESSY_SQL} SELECT o_orderkey, status_text FROM messy WHERE status_text <> {sql_strip('status_text')}""")
def whitespace_cells(spark, folder):
    return basics.padded_rows(messy_orders(spark, folder), "status_text").select("o_orderkey", "status_text")


@query("trim_text", sql=f"""
WITH {MESSY_SQL} SELECT o_orderkey, {sql_strip('amount_text')} AS amount_text, {sql_strip('status_text')} AS status_text FROM messy""")
def trim_text(spark, folder):
    m = messy_orders(spark, folder).select("o_orderkey", "amount_text", "status_text")
    return basics.trim_text(m, ["amount_text", "status_text"])


@query("coerce_numeric", sql=f"""
WITH {MESSY_SQL} SELECT o_orderkey, {sql_number('amount_text')} AS amount_text, {sql_number('grade_text')} AS grade_text FROM messy""")
def coerce_numeric(spark, folder):
    m = messy_orders(spark, folder).select("o_orderkey", "amount_text", "grade_text")
    return basics.coerce_numeric(m, ["amount_text", "grade_text"])


@query("parse_dates", sql=f"""
WITH {MESSY_SQL} SELECT o_orderkey, strftime({sql_moment('joined_date')}, '%Y-%m-%d') AS joined FROM messy""")
def parse_dates(spark, folder):
    return messy_orders(spark, folder).select(
        "o_orderkey", F.date_format(to_moment(F.col("joined_date")), "yyyy-MM-dd").alias("joined")
    )


@query("semantic_types", sql=f"""
WITH facts AS ({facts_sql('events', EVENT_KINDS)}) SELECT "column", {TYPE_CASE} AS semantic_type FROM facts""")
def semantic_types(spark, folder):
    return quality.column_types(load(spark, folder, "events"))


@query("semantic_types_customer", sql=f"""
WITH facts AS ({facts_sql('customer', CUSTOMER_KINDS)}) SELECT "column", {TYPE_CASE} AS semantic_type FROM facts""")
def semantic_types_customer(spark, folder):
    return quality.column_types(load(spark, folder, "customer"))


@query("semantic_types_messy", sql=f'{MESSY_FACTS} SELECT "column", {TYPE_CASE} AS semantic_type FROM facts')
def semantic_types_messy(spark, folder):
    return quality.column_types(messy_orders(spark, folder))


@query("semantic_types_pages", sql=f"""
WITH facts AS ({facts_sql('pages', {'page_id': 'number', 'url': 'text', 'html': 'text'})})
SELECT "column", {TYPE_CASE} AS semantic_type FROM facts""")
def semantic_types_pages(spark, folder):
    return quality.column_types(load(spark, folder, "pages"))


@query("column_health", sql=f"""{MESSY_FACTS}
SELECT "column", {TYPE_CASE} AS semantic_type, total AS "rows", total - non_null + tokens AS missing_count,
  round((total - non_null + tokens) / total * 100, 2) AS missing_pct, uniq AS unique_count,
  concat_ws(' | ', smallest, shortest, largest) AS samples, padded > 0 AS has_padding,
  concat_ws('; ', CASE WHEN padded > 0 THEN 'edge whitespace' END,
    CASE WHEN total - non_null + tokens > 0 THEN 'missing values' END) AS warnings
FROM facts""")
def column_health(spark, folder):
    return quality.column_health(messy_orders(spark, folder))


@query("table_health", sql=f"""{MESSY_FACTS}
SELECT max(total) AS total_rows, CAST({len(MESSY_KINDS)} AS BIGINT) AS total_columns, max(duplicates) AS duplicate_rows,
  CAST(sum(total - non_null + tokens) AS BIGINT) AS missing_cells,
  round(sum(total - non_null + tokens) / (max(total) * {len(MESSY_KINDS)}) * 100, 2) AS missing_pct
FROM facts, {DUPES}""")
def table_health(spark, folder):
    return quality.table_health(messy_orders(spark, folder))


@query("health_anomalies", sql=f"""{MESSY_FACTS}
SELECT 'duplicate_rows' AS kind, CAST(NULL AS VARCHAR) AS "column", CAST(duplicates AS DOUBLE) AS value FROM {DUPES} WHERE duplicates > 0
UNION ALL SELECT 'high_missingness', "column", round((total - non_null + tokens) / total * 100, 2) FROM facts
WHERE (total - non_null + tokens) / total * 100 > 40""")
def health_anomalies(spark, folder):
    return quality.health_anomalies(messy_orders(spark, folder))


@query("health_recommendations", sql=f"""{MESSY_FACTS}
SELECT 'remove_duplicates' AS action, CAST(NULL AS VARCHAR) AS "column" FROM {DUPES} WHERE duplicates > 0
UNION ALL SELECT 'trim_whitespace', "column" FROM facts WHERE padded > 0""")
def health_recommendations(spark, folder):
    return quality.health_recommendations(messy_orders(spark, folder))


def _clean(c: str) -> str:
    return f"CASE WHEN NOT {sql_token(c)} THEN {sql_strip(c)} END"


@query("clean_table", sql=f"""
WITH {MESSY_SQL}, u AS (SELECT DISTINCT * FROM messy)
SELECT o_orderkey, {sql_number(f"({_clean('amount_text')})")} AS amount_text, {_clean('grade_text')} AS grade_text,
  {_clean('status_text')} AS status_text, {_clean('flag_text')} AS flag_text, {_clean('joined_date')} AS joined_date,
  sparse, constant FROM u""")
def clean_table(spark, folder):
    return quality.clean_table(messy_orders(spark, folder))


SWITCHES = ("remove_duplicates", "strip_whitespace", "normalize_nulls", "coerce_numeric")


def clean_log_sql(off: str | None) -> str:
    """The log with one of the switches off."""
    kept = lambda c: sql_strip(c) if off != "strip_whitespace" else c
    filled = lambda c: f"CASE WHEN NOT {sql_token(c)} THEN {kept(c)} END" if off != "normalize_nulls" else kept(c)
    steps = [f"SELECT 'remove_duplicates' AS step, CAST(NULL AS VARCHAR) AS \"column\", duplicates AS affected FROM {DUPES}"] if off != "remove_duplicates" else []
    for c, k in MESSY_KINDS.items():
        if k == "text":
            numbers = f"count({sql_number(f'({filled(c)})')})"
            steps += [f"SELECT 'trim_whitespace' AS step, '{c}' AS \"column\", count(*) FILTER ({c} <> {sql_strip(c)}) AS affected FROM u"] if off != "strip_whitespace" else []
            steps += [f"SELECT 'null_tokens', '{c}', count(*) FILTER ({sql_token(c)}) FROM u"] if off != "normalize_nulls" else []
            steps += [f"SELECT 'coerce_numeric', '{c}', CASE WHEN {numbers} / count({filled(c)}) >= 0.8 THEN {numbers} ELSE 0 END FROM u"] if off != "coerce_numeric" else []
    distinct = "" if off == "remove_duplicates" else "DISTINCT "
    return f"WITH {MESSY_SQL}, u AS (SELECT {distinct}* FROM messy) SELECT * FROM ({union_all(steps)}) WHERE affected > 0"


@query("clean_log", sql=clean_log_sql(None))
def clean_log(spark, folder):
    return quality.clean_log(messy_orders(spark, folder))


def _log_without(switch: str):
    @query(f"clean_log_no_{switch}", sql=clean_log_sql(switch))
    def log(spark, folder):
        return quality.clean_log(messy_orders(spark, folder), **{switch: False})


for _switch in SWITCHES:
    _log_without(_switch)


# --- report -----------------------------------------------------------------------

EDA_NUMERIC = ["count", "mean", "median", "std", "min", "max", "q1", "q3", "iqr", "outlier_count", "skewness"]


def eda_sql(table, numbers, categories, dates) -> str:
    parts = []
    if numbers:
        parts += [f"""SELECT 'numeric' AS kind, "column", '{f}' AS item, CAST("{f}" AS DOUBLE) AS number, CAST(NULL AS VARCHAR) AS text
FROM ({numeric_profile_sql(table, numbers)})""" for f in EDA_NUMERIC]
    if categories:
        parts.append(f"""SELECT 'categorical' AS kind, "column", 'top_' || CAST(rank AS VARCHAR) AS item, CAST("count" AS DOUBLE) AS number, value AS text
FROM ({categorical_sql(table, categories)})""")
        parts.append(f"SELECT 'categorical', \"column\", 'top_' || CAST(rank AS VARCHAR) || '_pct', pct, value FROM ({categorical_sql(table, categories)})")
        parts.append(f"SELECT 'categorical', \"column\", 'cardinality', CAST(cardinality AS DOUBLE), NULL FROM ({categorical_sql(table, categories)}) WHERE rank = 1")
    for c in dates:
        d = datetime_sql(table, c)
        parts += [f"SELECT 'datetime', \"column\", '{i}', CAST(NULL AS DOUBLE), {i} FROM ({d})" for i in ("min_date", "max_date", "detected_frequency")]
        parts += [f"SELECT 'datetime', \"column\", '{i}', CAST({i} AS DOUBLE), NULL FROM ({d})" for i in ("date_range_days", "null_count")]
    return union_all(parts)


@query("eda_report", sql=eda_sql("events", ["event_id", "user_id", "value"], ["event_type", "props"], ["ts"]))
def eda_report(spark, folder):
    e = load(spark, folder, "events")
    return profile.eda_report(e, quality.types_of(e))


@query("eda_headlines", sql=f"""
WITH p AS ({numeric_profile_sql('events', ['event_id', 'user_id', 'value'])}),
v AS (SELECT * FROM p ORDER BY std DESC LIMIT 1)
SELECT 1 AS seq, 'rows' AS fact, CAST(NULL AS VARCHAR) AS "column", CAST(NULL AS VARCHAR) AS text, CAST(count(*) AS DOUBLE) AS number FROM events
UNION ALL SELECT 2, 'columns', NULL, NULL, 6.0
UNION ALL SELECT 3, 'most_variable', "column", NULL, std FROM v
UNION ALL SELECT 4, 'most_variable_min', "column", NULL, "min" FROM v
UNION ALL SELECT 5, 'most_variable_max', "column", NULL, "max" FROM v
UNION ALL SELECT 6, 'has_outliers', "column", NULL, CAST(outlier_count AS DOUBLE) FROM p WHERE outlier_count > 0
UNION ALL (SELECT 7, 'top_value', "column", value, pct FROM ({categorical_sql('events', ['event_type', 'props'], 1)})
  ORDER BY cardinality DESC, "column" LIMIT 1)
UNION ALL SELECT 8, 'time_span', "column", min_date || ' to ' || max_date || ', ' || detected_frequency, CAST(date_range_days AS DOUBLE)
  FROM ({datetime_sql('events', 'ts')})""")
def eda_headlines(spark, folder):
    e = load(spark, folder, "events")
    return profile.eda_headlines(e, quality.types_of(e))


@query("schema_summary", sql=f"""
WITH facts AS ({facts_sql('documents', {'doc_id': 'number', 'text': 'text', 'lang': 'text', 'source': 'text', 'n_chars': 'number'})})
SELECT CAST(position AS INTEGER) AS position, "column", {TYPE_CASE} AS semantic_type, non_null,
  concat_ws(' | ', substr(smallest, 1, 60), substr(shortest, 1, 60), substr(largest, 1, 60)) AS samples FROM facts""")
def schema_summary(spark, folder):
    d = load(spark, folder, "documents")
    return profile.schema_summary(d, quality.types_of(d))


# --- sources and sinks ----------------------------------------------------------------


@query("dates_by_column", sql="""
SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS short, strftime(date_trunc('month', o_orderdate), '%Y-%m-%d') AS month,
  strftime(o_orderdate + to_hours(o_orderkey % 24), '%Y-%m-%d %H:%M') AS spoken FROM orders""")
def dates_by_column(spark, folder):
    """Day first throughout, though many of the days could be months; months only; week days and hours of the half day."""
    day = F.col("o_orderdate").cast("timestamp")
    spoken = F.date_format(F.timestamp_add("HOUR", F.col("o_orderkey") % 24, day), "EEE, dd MMM yyyy hh:mm a")
    rows = load(spark, folder, "orders").select("o_orderkey", F.date_format(day, "dd/MM/yy").alias("short"), F.date_format(day, "yyyy-MM").alias("month"), spoken.alias("spoken"))
    got = dates.parse_dates(rows, ["short", "month", "spoken"])
    return got.select("o_orderkey", F.date_format("short", "yyyy-MM-dd").alias("short"), F.date_format("month", "yyyy-MM-dd").alias("month"), F.date_format("spoken", "yyyy-MM-dd HH:mm").alias("spoken"))


@query("date_shapes", sql=f"""
WITH {MESSY_SQL}, c AS (SELECT trim(joined_date) AS v FROM messy WHERE joined_date IS NOT NULL)
SELECT 'joined_date' AS "column", regexp_replace(v, '[0-9]', '9', 'g') AS shape, count(*) AS n, count(*) AS readable,
  count(*) FILTER (regexp_matches(v, '^[0-9]{{2}}/') AND TRY_CAST(v[1:2] AS INT) > 12) AS day_first,
  count(*) FILTER (regexp_matches(v, '^[0-9]{{2}}/') AND TRY_CAST(v[4:5] AS INT) > 12) AS month_first FROM c GROUP BY 2""")
def date_shapes(spark, folder):
    return dates.date_shapes(messy_orders(spark, folder), ["joined_date"])


@query("csv_load", sql=f"""
WITH {MESSY_SQL}
SELECT o_orderkey, amount_text, grade_text, status_text, flag_text, joined_date, sparse, constant,
  CASE WHEN o_orderkey % 3 = 0 THEN 'first' || chr(10) || 'second; "third" ' || o_orderkey ELSE 'one line' END AS note FROM messy""")
def csv_load(spark, folder):
    path = new_folder(spark, "csv")
    opts = {"header": True, "sep": ";", "escape": '"', "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
    broken = F.concat(F.lit('first\nsecond; "third" '), F.col("o_orderkey").cast("string"))
    note = F.when(F.col("o_orderkey") % 3 == 0, broken).otherwise("one line")
    messy_orders(spark, folder).withColumn("note", note).write.options(**opts).csv(path)
    return delimited.load_delimited(spark, path)


@query("csv_split_records", sql="""
SELECT c_custkey, c_name, CASE WHEN c_custkey % 2 = 0 THEN c_name || chr(10) || 'says "' || c_mktsegment || '", twice' ELSE c_mktsegment END AS note FROM customer""")
def csv_split_records(spark, folder):
    """One file whose records cross its chunks."""
    path = new_folder(spark, "csv")
    said = F.concat("c_name", F.lit('\nsays "'), "c_mktsegment", F.lit('", twice'))
    rows = load(spark, folder, "customer").select("c_custkey", "c_name", F.when(F.col("c_custkey") % 2 == 0, said).otherwise(F.col("c_mktsegment")).alias("note"))
    rows.coalesce(1).write.options(header=True, escape='"').csv(path)
    return delimited.load_delimited(spark, path, chunk_bytes=16_000)


@query("csv_mixed_folder", sql="""
SELECT o_orderkey, o_custkey, CASE o_orderkey % 3 WHEN 0 THEN 'é ' || o_orderstatus WHEN 1 THEN 'ü ' || o_orderstatus ELSE 'ö' || chr(10) || o_orderstatus END AS name,
  CASE WHEN o_orderkey % 3 = 1 THEN NULL ELSE o_totalprice END AS price FROM orders""")
def csv_mixed_folder(spark, folder):
    """Files of one folder with their own encoding, delimiter, columns and order of columns."""
    path = new_folder(spark, "csv")
    orders = load(spark, folder, "orders")
    name = lambda head: F.concat(F.lit(head), "o_orderstatus").alias("name")
    price = F.col("o_totalprice").alias("price")
    kinds = [
        (["o_orderkey", "o_custkey", name("é "), price], {"sep": ","}),
        (["o_custkey", name("ü "), "o_orderkey"], {"sep": ";", "encoding": "ISO-8859-1"}),
        ([price, name("ö\n"), "o_orderkey", "o_custkey"], {"sep": "\t"}),
    ]
    for i, (columns, options) in enumerate(kinds):
        orders.where(F.col("o_orderkey") % 3 == i).select(*columns).write.options(header=True, escape='"', **options).mode("append").csv(path)
    return delimited.load_delimited(spark, path)


@query("csv_export_roundtrip", sql="SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_returnflag FROM lineitem")
def csv_export_roundtrip(spark, folder):
    path = new_folder(spark, "export")
    key = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
    sinks.export_csv(load(spark, folder, "lineitem"), path, key, [*key, "l_extendedprice", "l_returnflag"])
    return delimited.load_delimited(spark, path)


@query("json_records", sql="""
SELECT '{"c_custkey":' || c_custkey || ',"c_name":"' || c_name || '","c_nationkey":' || c_nationkey || ',"c_mktsegment":"' || c_mktsegment || '"}' AS record
FROM customer ORDER BY c_custkey LIMIT 500""")
def json_records(spark, folder):
    c = load(spark, folder, "customer").select("c_custkey", "c_name", "c_nationkey", "c_mktsegment")
    return sinks.json_records(c, ["c_custkey"])


# --- versions -----------------------------------------------------------------------------


def _history(spark, folder):
    table = versions.VersionedTable(spark, new_folder(spark, "versions"))
    orders = load(spark, folder, "orders")
    table.commit(orders, name="Baseline")
    logged, action = features.log_transform(table.read(), "o_totalprice")
    table.commit(logged, action)
    parts, action = features.date_parts(table.read(), "o_orderdate")
    table.commit(parts, action)
    table.undo()
    slim, action = features.remove_column(table.read(), "o_orderpriority")
    table.commit(slim, action)
    return table


@query("version_commit", sql="SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, round(ln(1 + o_totalprice), 4) AS o_totalprice_log FROM orders")
def version_commit(spark, folder):
    return _history(spark, folder).read().drop("o_orderdate").withColumn("o_totalprice_log", F.round("o_totalprice_log", 4))


@query("version_log", sql="""
SELECT CAST(v AS BIGINT) AS version, n AS name, (SELECT count(*) FROM orders) AS "rows", CAST(c AS BIGINT) AS "columns", v = 2 AS is_current, a AS action, p AS parameters
FROM (VALUES (0, 'Baseline', 6, 'Baseline', ''), (1, 'log1p of o_totalprice', 7, 'log1p of o_totalprice', ''),
  (2, '3 bins', 10, 'o_totalprice in 3 bins (uniform)', 'n_bins=3, strategy=uniform')) t(v, n, c, a, p)""")
def version_log(spark, folder):
    table = _history(spark, folder)
    table.undo()
    bins, action = features.bin_column(table.read(), "o_totalprice", 3, "uniform")
    table.commit(bins, action, "3 bins")
    said = F.transform(F.array_sort(F.map_entries("parameters")), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return table.audit_log().drop("at").withColumn("parameters", F.array_join(said, ", "))


@query("dataset_diff", sql=f"""
WITH {MESSY_SQL}, u AS (SELECT DISTINCT * FROM messy),
b AS (SELECT count(*) AS n, {' + '.join(f'count(*) - count({c})' for c in MESSY_KINDS)} AS miss FROM messy),
a AS (SELECT count(*) AS n, count(*) - count({_clean('amount_text')}) + count(*) - count({_clean('grade_text')})
  + count(*) - count({_clean('status_text')}) + count(*) - count({_clean('joined_date')}) + count(*) - count(sparse) AS miss FROM u)
SELECT b.n AS rows_before, a.n AS rows_after, a.n - b.n AS rows_delta, CAST(8 AS BIGINT) AS cols_before, CAST(8 AS BIGINT) AS cols_after,
  CAST(0 AS BIGINT) AS cols_delta, 'amount_text_log' AS columns_added, 'constant' AS columns_removed,
  b.miss AS missing_before, a.miss AS missing_after, a.miss - b.miss AS missing_delta FROM a, b""")
def dataset_diff(spark, folder):
    before = messy_orders(spark, folder)
    after, _ = features.log_transform(quality.clean_table(before).drop("constant"), "amount_text")
    return versions.dataset_diff(before, after)
