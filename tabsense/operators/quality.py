"""Semantic types, health audit and cleaning."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import (
    DATE_WORDS, ID_WORDS, any_word, is_boolean_token, is_moment, is_null_token, is_numeric, is_padded, is_text, named,
    present, spread_rows, storage, strip, to_moment, to_number,
)
from .basics import distinct_counts, distinct_where_unclear, duplicate_count
from .ordering import long_form


FACTS = [
    "column", "rows", "non_null", "tokens", "padded", "boolean_like", "numeric_like", "date_like", "smallest", "shortest",
    "largest",
]
# columns per scan: keeps one aggregate inside generated code
COLUMNS_PER_SCAN = 4


def _measures(df: DataFrame, name: str) -> list[Column]:
    """The audit measures of one column, in the order of FACTS after ``rows``."""
    none = F.lit(0).cast("bigint")
    if is_text(df, name):
        v = named(name)
        filled = F.when(~is_null_token(v), v)
        shortest = F.min(F.when(v.isNotNull(), F.struct(F.length(v).alias("k"), v.alias("v"))))["v"]
        return [
            F.count(v), F.count_if(is_null_token(v)), F.count_if(is_padded(v)), F.count_if(is_boolean_token(v)),
            F.count(to_number(filled)), F.count(to_moment(v)), F.min(v), shortest, F.max(v),
        ]
    if is_numeric(df, name):
        v = present(df, name).cast("double")
        shortest = F.min(F.when(v.isNotNull(), F.struct(F.abs(v).alias("k"), v.alias("v"))))["v"]
        return [
            F.count(v), none, none, F.count_if(v.isin(0.0, 1.0)), F.count(v), none,
            F.min(v).cast("string"), shortest.cast("string"), F.max(v).cast("string"),
        ]
    v = named(name).cast("string")
    held = F.count(v)
    return [
        held, none, none, held if isinstance(storage(df, name), T.BooleanType) else none, none,
        held if is_moment(df, name) else none, F.min(v), F.min(v), F.max(v),
    ]


def column_facts(df: DataFrame) -> DataFrame:
    """Everything the audit reads off the cells, one row per column, no shuffle of cells.

    The measures are global aggregates: text minima under a grouping would make
    Spark sort all cells. The samples are the smallest, shortest and largest value.
    """
    parts = []
    for start in range(0, len(df.columns), COLUMNS_PER_SCAN):
        part = df.columns[start : start + COLUMNS_PER_SCAN]
        aggs = [m.alias(f"m{i}_{j}") for i, c in enumerate(part) for j, m in enumerate(_measures(df, c))]
        wide = df.agg(F.count(F.lit(1)).alias("rows"), *aggs)
        parts.append(wide.select(spread_rows(FACTS, [
            [F.lit(c), F.col("rows"), *[F.col(f"m{i}_{j}") for j in range(len(FACTS) - 2)]] for i, c in enumerate(part)
        ])))
    return reduce(DataFrame.unionByName, parts)


def _type_rule(df: DataFrame) -> Column:
    """The decision table, first match wins; name tests are substring tests."""
    name = F.col("column")
    nums = name.isin([c for c in df.columns if is_numeric(df, c)])
    native = name.isin([c for c in df.columns if is_moment(df, c)])
    dated = name.isin([c for c in df.columns if any_word(c, DATE_WORDS)])
    keyed = name.isin([c for c in df.columns if any_word(c, ID_WORDS)])
    held, filled = F.col("non_null"), F.col("non_null") - F.col("tokens")
    unique = F.col("unique_count")
    return (
        F.when(held == 0, "text")
        .when(F.col("boolean_like") == held, "boolean")
        .when(nums, "numeric")
        .when((filled > 0) & (F.col("numeric_like") == filled), "numeric")
        .when(native, "datetime")
        .when(dated & (F.col("date_like") == held), "datetime")
        .when(keyed, "id_text")
        .when((unique == F.col("rows")) & (unique > 20), "id_text")
        .when((unique <= 30) | (unique / F.col("rows") < 0.15), "categorical")
        .otherwise("text")
    )


def column_types(df: DataFrame) -> DataFrame:
    """``(column, semantic_type)``.

    Distinct values matter only for columns no earlier rule can decide, and the
    exact count only where an estimate is close to a bound of the rules.
    """
    facts = column_facts(df)
    undecided = [
        c for c in df.columns
        if not is_numeric(df, c) and not is_moment(df, c) and not any_word(c, ID_WORDS)
    ]
    if undecided:
        clear = lambda d, n: d > 60 and (d < 0.13 * n or 0.17 * n < d < 0.9 * n)
        counts = distinct_where_unclear(df, undecided, clear).withColumnRenamed("distinct", "unique_count")
        facts = facts.join(F.broadcast(counts), "column", "left")
    else:
        facts = facts.withColumn("unique_count", F.lit(None).cast("bigint"))
    return facts.select("column", _type_rule(df).alias("semantic_type"))


def types_of(df: DataFrame) -> dict[str, str]:
    """Semantic types on the driver (one entry per column)."""
    return {r["column"]: r["semantic_type"] for r in column_types(df).collect()}


def column_health(df: DataFrame) -> DataFrame:
    """Type, missing share, distinct count, samples and warnings per column."""
    facts = column_facts(df).join(
        F.broadcast(distinct_counts(df).withColumnRenamed("distinct", "unique_count")), "column"
    )
    missing = F.col("rows") - F.col("non_null") + F.col("tokens")
    share = missing / F.greatest(F.col("rows"), F.lit(1)) * 100
    warnings = F.concat_ws(
        "; ", F.when(F.col("padded") > 0, F.lit("edge whitespace")), F.when(missing > 0, F.lit("missing values"))
    )
    return facts.select(
        "column", _type_rule(df).alias("semantic_type"), "rows", missing.alias("missing_count"),
        F.round(share, 2).alias("missing_pct"), "unique_count",
        F.concat_ws(" | ", "smallest", "shortest", "largest").alias("samples"),
        (F.col("padded") > 0).alias("has_padding"), warnings.alias("warnings"),
    )


def table_health(df: DataFrame) -> DataFrame:
    """Rows, columns, duplicate rows and missing cells (null tokens count as missing)."""
    facts = column_facts(df).agg(
        F.max("rows").alias("total_rows"),
        F.sum(F.col("rows") - F.col("non_null") + F.col("tokens")).alias("missing_cells"),
    )
    width = len(df.columns)
    return facts.crossJoin(F.broadcast(duplicate_count(df))).select(
        F.coalesce("total_rows", F.lit(0)).alias("total_rows"), F.lit(width).cast("bigint").alias("total_columns"),
        F.col("duplicates").alias("duplicate_rows"), F.coalesce("missing_cells", F.lit(0)).alias("missing_cells"),
        F.round(
            F.coalesce("missing_cells", F.lit(0)) / F.greatest(F.coalesce("total_rows", F.lit(0)) * width, F.lit(1)) * 100, 2
        ).alias("missing_pct"),
    )


def health_anomalies(df: DataFrame) -> DataFrame:
    """``(kind, column, value)``: duplicate rows, and columns over 40 % missing."""
    dup = duplicate_count(df).where("duplicates > 0").select(
        F.lit("duplicate_rows").alias("kind"), F.lit(None).cast("string").alias("column"),
        F.col("duplicates").cast("double").alias("value"),
    )
    f = column_facts(df)
    pct = (F.col("rows") - F.col("non_null") + F.col("tokens")) / F.col("rows") * 100
    high = f.where(pct > 40).select(
        F.lit("high_missingness").alias("kind"), "column", F.round(pct, 2).alias("value")
    )
    return dup.unionByName(high)


def health_recommendations(df: DataFrame) -> DataFrame:
    """``(action, column)``: what cleaning would change."""
    dup = duplicate_count(df).where("duplicates > 0").select(
        F.lit("remove_duplicates").alias("action"), F.lit(None).cast("string").alias("column")
    )
    trim = column_facts(df).where("padded > 0").select(F.lit("trim_whitespace").alias("action"), "column")
    return dup.unionByName(trim)


COERCE_SHARE = 0.80


def _texts(df: DataFrame) -> list[str]:
    return [c for c in df.columns if is_text(df, c)]


def _repaired(df: DataFrame, strip_whitespace: bool, normalize_nulls: bool) -> DataFrame:
    fixes = {}
    for c in _texts(df):
        v = strip(named(c)) if strip_whitespace else named(c)
        fixes[c] = F.when(~is_null_token(v), v) if normalize_nulls else v
    return df.withColumns(fixes) if fixes else df


def _coercible(df: DataFrame) -> list[str]:
    """Text columns of which at least 80 % of the values read as numbers."""
    texts = _texts(df)
    if not texts:
        return []
    row = df.agg(*[
        (F.count(to_number(named(c))) / F.nullif(F.count(named(c)), F.lit(0))).alias(f"r{i}") for i, c in enumerate(texts)
    ]).first()
    return [c for i, c in enumerate(texts) if row[f"r{i}"] is not None and row[f"r{i}"] >= COERCE_SHARE]


def clean_table(
    df: DataFrame, remove_duplicates: bool = True, strip_whitespace: bool = True, normalize_nulls: bool = True,
    coerce_numeric: bool = True,
) -> DataFrame:
    """Deduplicate, then trim, then null out tokens, then turn text into numbers.

    The order matters: rows that become equal only by trimming are kept.
    """
    out = df.dropDuplicates() if remove_duplicates else df
    out = _repaired(out, strip_whitespace, normalize_nulls)
    if coerce_numeric:
        numbers = _coercible(out)
        if numbers:
            out = out.withColumns({c: to_number(named(c)) for c in numbers})
    return out


def clean_log(
    df: DataFrame, remove_duplicates: bool = True, strip_whitespace: bool = True, normalize_nulls: bool = True,
    coerce_numeric: bool = True,
) -> DataFrame:
    """``(step, column, affected)`` for the steps of :func:`clean_table` that change something, under the same switches.

    Equal rows are grouped once; the number of rows removed and all counts of the columns are
    one aggregate over the groups, whose single row reaches the driver.
    """
    texts = _texts(df)
    rows = df.groupBy(*[named(c) for c in df.columns]).agg(F.count(F.lit(1)).alias("_copies")) if remove_duplicates else df.withColumn("_copies", F.lit(1))
    facts = [F.coalesce(F.sum(F.col("_copies") - 1), F.lit(0)).alias("copies")]
    for i, c in enumerate(texts):
        v, s, token = named(c), strip(named(c)), is_null_token(named(c))
        kept = s if strip_whitespace else v
        filled = F.when(~token, kept) if normalize_nulls else kept
        facts += [F.count_if(v != s).alias(f"t{i}"), F.count_if(token).alias(f"n{i}"), F.count(filled).alias(f"h{i}"), F.count(to_number(filled)).alias(f"d{i}")]
    row = rows.agg(*facts).first()
    steps = [("remove_duplicates", None, row["copies"])] if remove_duplicates else []
    for i, c in enumerate(texts):
        held, numbers = row[f"h{i}"], row[f"d{i}"]
        steps += [("trim_whitespace", c, row[f"t{i}"])] if strip_whitespace else []
        steps += [("null_tokens", c, row[f"n{i}"])] if normalize_nulls else []
        steps += [("coerce_numeric", c, numbers)] if coerce_numeric and held and numbers / held >= COERCE_SHARE else []
    return df.sparkSession.createDataFrame([x for x in steps if x[2] > 0], "step string, column string, affected bigint")
