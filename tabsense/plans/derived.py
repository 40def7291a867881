"""Tables derived from the given ones, once in Spark and once in SQL.

The given tables are clean, so cleaning and risk operators read a messy view of
``orders`` and a concentrated view of ``events``. All rows are kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import BOOLEAN_TOKENS, DATE_WORDS, ID_WORDS, NULL_TOKENS, NUMBER_PATTERN, WHITESPACE, any_word
from ..storage import load


def messy_orders(spark: SparkSession, folder: str) -> DataFrame:
    o = load(spark, folder, "orders")
    k, day = F.col("o_orderkey"), F.col("o_orderdate")
    whole = F.floor("o_totalprice").cast("bigint").cast("string")
    iso = F.date_format(day, "yyyy-MM-dd")
    base = o.select(
        "o_orderkey",
        F.when(k % 13 == 0, " N/A ").when(k % 13 == 1, "missing").otherwise(F.concat(F.lit("  "), whole, F.lit(" ")))
        .alias("amount_text"),
        F.when(k % 2 == 0, "n.a.").when(k % 5 == 0, "12").otherwise("abc").alias("grade_text"),
        F.when(k % 7 != 0, F.concat(F.lit(" "), "o_orderstatus")).alias("status_text"),
        F.when(k % 3 == 0, "Yes").when(k % 3 == 1, "no").otherwise("Y").alias("flag_text"),
        F.when(k % 3 == 0, iso).when(k % 3 == 1, F.date_format(day, "yyyy/MM/dd"))
        .when(F.dayofmonth(day) > 12, F.date_format(day, "dd/MM/yyyy")).otherwise(iso).alias("joined_date"),
        F.when(k % 10 >= 6, F.col("o_totalprice")).alias("sparse"),
        F.lit(7.0).alias("constant"),
    )
    copies = base.where(k % 50 == 0)
    padded = base.where(k % 51 == 0).withColumn("flag_text", F.concat("flag_text", F.lit(" ")))
    return base.unionByName(copies).unionByName(padded)


MESSY_SQL = """base AS (
  SELECT o_orderkey,
    CASE WHEN o_orderkey % 13 = 0 THEN ' N/A ' WHEN o_orderkey % 13 = 1 THEN 'missing'
      ELSE '  ' || CAST(CAST(floor(o_totalprice) AS BIGINT) AS VARCHAR) || ' ' END AS amount_text,
    CASE WHEN o_orderkey % 2 = 0 THEN 'n.a.' WHEN o_orderkey % 5 = 0 THEN '12' ELSE 'abc' END AS grade_text,
    CASE WHEN o_orderkey % 7 <> 0 THEN ' ' || o_orderstatus END AS status_text,
    CASE WHEN o_orderkey % 3 = 0 THEN 'Yes' WHEN o_orderkey % 3 = 1 THEN 'no' ELSE 'Y' END AS flag_text,
    CASE WHEN o_orderkey % 3 = 0 THEN strftime(o_orderdate, '%Y-%m-%d')
      WHEN o_orderkey % 3 = 1 THEN strftime(o_orderdate, '%Y/%m/%d')
      WHEN day(o_orderdate) > 12 THEN strftime(o_orderdate, '%d/%m/%Y')
      ELSE strftime(o_orderdate, '%Y-%m-%d') END AS joined_date,
    CASE WHEN o_orderkey % 10 >= 6 THEN o_totalprice END AS sparse,
    CAST(7.0 AS DOUBLE) AS constant
  FROM orders),
messy AS (
  SELECT * FROM base
  UNION ALL SELECT * FROM base WHERE o_orderkey % 50 = 0
  UNION ALL SELECT * REPLACE (flag_text || ' ' AS flag_text) FROM base WHERE o_orderkey % 51 = 0)"""

MESSY_KINDS = {
    "o_orderkey": "number", "amount_text": "text", "grade_text": "text", "status_text": "text", "flag_text": "text",
    "joined_date": "text", "sparse": "number", "constant": "number",
}


def planted_events(spark: SparkSession, folder: str) -> DataFrame:
    e = load(spark, folder, "events")
    u = F.col("user_id") % 10
    base = e.select(
        "event_id", F.when(u == 0, "A").otherwise(F.concat(F.lit("L"), u.cast("string"))).alias("segment"), "event_type",
        F.when(F.col("event_id") % 10 >= 6, F.col("event_type")).alias("note"),
        F.when(u == 0, F.col("value") * 200).otherwise(F.col("value")).alias("amount"),
    )
    return base.unionByName(base.where(F.col("event_id") % 50 == 0))


PLANTED_SQL = """base AS (
  SELECT event_id, CASE WHEN user_id % 10 = 0 THEN 'A' ELSE 'L' || CAST(user_id % 10 AS VARCHAR) END AS segment,
    event_type, CASE WHEN event_id % 10 >= 6 THEN event_type END AS note,
    CASE WHEN user_id % 10 = 0 THEN value * 200 ELSE value END AS amount
  FROM events),
planted AS (SELECT * FROM base UNION ALL SELECT * FROM base WHERE event_id % 50 = 0)"""


# --- SQL counterparts of the column expressions ---------------------------------


def _list(values) -> str:
    return ", ".join(f"'{v}'" for v in values)


def sql_strip(c: str) -> str:
    return f"trim({c}, '{WHITESPACE}')"


def sql_token(c: str) -> str:
    return f"coalesce(lower({sql_strip(c)}) IN ({_list(NULL_TOKENS)}), false)"


def sql_number(c: str) -> str:
    s = sql_strip(c)
    return f"CASE WHEN regexp_matches({s}, '{NUMBER_PATTERN}') THEN TRY_CAST({s} AS DOUBLE) END"


def sql_moment(c: str) -> str:
    s = sql_strip(c)
    formats = ["%Y-%m-%d", "%Y/%m/%d", "%m/%d/%Y", "%d/%m/%Y", "%Y-%m-%d %H:%M:%S", "%Y-%m-%dT%H:%M:%S"]
    return "coalesce(" + ", ".join(f"try_strptime({s}, '{f}')" for f in formats) + ")"


def facts_sql(table: str, kinds: dict[str, str]) -> str:
    """One row of audit facts per column, as the body of a SELECT."""
    parts = []
    for i, (c, kind) in enumerate(kinds.items()):
        if kind == "text":
            filled = f"CASE WHEN NOT {sql_token(c)} THEN {c} END"
            body = (
                f"count(*) FILTER ({sql_token(c)}) AS tokens, "
                f"count(*) FILTER ({c} <> {sql_strip(c)}) AS padded, "
                f"count(*) FILTER (lower({sql_strip(c)}) IN ({_list(BOOLEAN_TOKENS)})) AS boolean_like, "
                f"count({sql_number(f'({filled})')}) AS numeric_like, count({sql_moment(c)}) AS date_like, "
                f"min({c}) AS smallest, arg_min({c}, {{'a': length({c}), 'b': {c}}}) AS shortest, max({c}) AS largest"
            )
        elif kind == "number":
            d = f"CAST({c} AS DOUBLE)"
            body = (
                f"0 AS tokens, 0 AS padded, count(*) FILTER ({c} IN (0, 1)) AS boolean_like, count({c}) AS numeric_like, "
                f"0 AS date_like, CAST(min({d}) AS VARCHAR) AS smallest, "
                f"CAST(arg_min({d}, {{'a': abs({d}), 'b': {d}}}) AS VARCHAR) AS shortest, CAST(max({d}) AS VARCHAR) AS largest"
            )
        else:
            s = f"CAST({c} AS VARCHAR)"
            body = (
                f"0 AS tokens, 0 AS padded, 0 AS boolean_like, 0 AS numeric_like, count({c}) AS date_like, "
                f"min({s}) AS smallest, min({s}) AS shortest, max({s}) AS largest"
            )
        parts.append(
            f"SELECT {i} AS position, '{c}' AS \"column\", '{kind}' AS kind, {any_word(c, DATE_WORDS)} AS dated, "
            f"{any_word(c, ID_WORDS)} AS keyed, count(*) AS total, count({c}) AS non_null, "
            f"count(DISTINCT {c}) AS uniq, {body} FROM {table}"
        )
    return "\nUNION ALL\n".join(parts)


TYPE_CASE = """CASE WHEN non_null = 0 THEN 'text' WHEN boolean_like = non_null THEN 'boolean'
  WHEN kind = 'number' THEN 'numeric'
  WHEN non_null - tokens > 0 AND numeric_like = non_null - tokens THEN 'numeric'
  WHEN kind = 'moment' THEN 'datetime' WHEN dated AND date_like = non_null THEN 'datetime'
  WHEN keyed THEN 'id_text' WHEN uniq = total AND uniq > 20 THEN 'id_text'
  WHEN uniq <= 30 OR uniq / total < 0.15 THEN 'categorical' ELSE 'text' END"""
