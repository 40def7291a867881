"""Small relational operators: projection, filters, counts, limits, distinct."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import is_null_token, is_padded, is_text, named, number, present, strip
from ..functions.rounding import half_up
from .ordering import numeric_quantiles


def _require(df: DataFrame, columns: Sequence[str]) -> None:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"Column not found: {', '.join(missing)}")


def project(df: DataFrame, columns: Sequence[str] = ()) -> DataFrame:
    """The chosen columns; none chosen means all."""
    _require(df, columns)
    return df.select(*[named(c) for c in columns]) if columns else df


def first_rows(df: DataFrame, order: Sequence[str], n: int | None, columns: Sequence[str] = ()) -> DataFrame:
    """The first ``n`` rows in key order (all rows when ``n`` is None)."""
    _require(df, order)
    if n is None:
        return project(df, columns)
    return project(df.orderBy(*[named(c) for c in order]).limit(n), columns)


def drop_column(df: DataFrame, column: str) -> DataFrame:
    _require(df, [column])
    return df.drop(column)


def prune_all_null(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Drop the columns that hold no value at all."""
    chosen = list(columns or df.columns)
    counts = df.agg(*[F.count(present(df, c)).alias(c) for c in chosen]).first()
    dead = [c for c in chosen if counts[c] == 0]
    return df.drop(*dead)


def cohort(df: DataFrame, column: str, value: str) -> DataFrame:
    _require(df, [column])
    return df.where(named(column).cast("string") == value)


def complete_rows(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows where none of the columns is missing (null or NaN)."""
    _require(df, columns)
    return df.dropna(subset=list(columns))


def null_token_rows(df: DataFrame, column: str) -> DataFrame:
    return df.where(is_null_token(named(column)))


def padded_rows(df: DataFrame, column: str) -> DataFrame:
    return df.where(is_padded(named(column)))


def iqr_fences(df: DataFrame, column: str) -> tuple[float, float]:
    """Fences from quartiles rounded to four places."""
    q = numeric_quantiles(df, [column], [0.25, 0.75])[column]
    if q is None:
        return 0.0, 0.0
    q1, q3 = half_up(q[0], 4), half_up(q[1], 4)
    return q1 - 1.5 * (q3 - q1), q3 + 1.5 * (q3 - q1)


def iqr_outliers(df: DataFrame, column: str) -> DataFrame:
    """Rows outside the fences. The fences are literals, so the scan can prune on them."""
    low, high = iqr_fences(df, column)
    c = number(df, column)
    return df.where((c < low) | (c > high))


def shape(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("rows")).withColumn("columns", F.lit(len(df.columns)).cast("bigint"))


def spread(row: DataFrame, columns: Sequence[str], name: str) -> DataFrame:
    """One wide row of per-column values to ``(column, name)`` rows."""
    return row.unpivot([], [named(c) for c in columns], "column", name)


def null_counts(df: DataFrame) -> DataFrame:
    counts = df.agg(*[F.count_if(present(df, c).isNull()).alias(c) for c in df.columns])
    return spread(counts, df.columns, "nulls")


LONG_TEXT = 64


def short_key(c: Column) -> Column:
    """A text as a grouping key: itself, or its digest where it is long, so that no shuffle moves whole documents.

    The digest is written longer than any text that is kept, so the two never meet.
    """
    return F.when(F.length(c) > LONG_TEXT, F.rpad(F.sha2(c, 256), LONG_TEXT + 1, "#")).otherwise(c)


def estimate_distinct(c: Column) -> Column:
    """Distinct non-null values, about 1 % off, from a 16 KB sketch of the value hashes."""
    return F.hll_sketch_estimate(F.hll_sketch_agg(F.when(c.isNotNull(), F.xxhash64(c)), 14))


def distinct_counts(df: DataFrame, columns: Sequence[str] | None = None, approximate: bool = False) -> DataFrame:
    """Distinct non-null values per column, in one aggregate.

    Long texts are counted by their digest.
    """
    chosen = list(columns or df.columns)
    cells = {c: present(df, c) for c in chosen}
    if approximate:
        return spread(df.agg(*[estimate_distinct(c).alias(n) for n, c in cells.items()]), chosen, "distinct")
    cells |= {c: short_key(named(c)) for c in chosen if is_text(df, c)}
    return spread(df.agg(*[F.count_distinct(c).alias(n) for n, c in cells.items()]), chosen, "distinct")


def distinct_where_unclear(
    df: DataFrame, columns: Sequence[str], clear: Callable[[int, int], bool]
) -> DataFrame:
    """``(column, distinct)`` for rules that compare it with a bound.

    An estimate (one scan, no shuffle of values) is kept where
    ``clear(estimate, rows)`` says that no rule can turn on its error; the other
    columns are counted exactly.
    """
    row = df.agg(
        F.count(F.lit(1)).alias("_rows"),
        *[estimate_distinct(present(df, c)).alias(f"d{i}") for i, c in enumerate(columns)],
    ).first()
    kept = [(c, row[f"d{i}"]) for i, c in enumerate(columns) if clear(row[f"d{i}"], row["_rows"])]
    done = {c for c, _ in kept}
    exact = [c for c in columns if c not in done]
    estimates = df.sparkSession.createDataFrame(kept, "column string, distinct bigint")
    return estimates.unionByName(distinct_counts(df, exact)) if exact else estimates


def duplicate_facts(df: DataFrame) -> DataFrame:
    """``(duplicates, rows)``: rows beyond the first of each identical set, and all rows.

    Copies collapse before the shuffle, so a row repeated many times is no hot key.
    Long texts are compared by their digest.
    """
    keys = [(short_key(named(c)) if is_text(df, c) else named(c)).alias(f"_k{i}") for i, c in enumerate(df.columns)]
    sets = df.select(*keys).groupBy(*[f"_k{i}" for i in range(len(keys))]).agg(F.count(F.lit(1)).alias("_n"))
    return sets.agg(
        F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).alias("duplicates"), F.coalesce(F.sum("_n"), F.lit(0)).alias("rows")
    )


def duplicate_count(df: DataFrame) -> DataFrame:
    return duplicate_facts(df).select("duplicates")


def distinct_rows(df: DataFrame) -> DataFrame:
    return df.dropDuplicates()


def labels(df: DataFrame, column: str, n: int = 10) -> DataFrame:
    """The first ``n`` group labels in order."""
    c = present(df, column).cast("string")
    return df.select(c.alias("label")).where(F.col("label").isNotNull()).distinct().orderBy("label").limit(n)


def trim_text(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.withColumns({c: strip(named(c)) for c in columns})


def coerce_numeric(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.withColumns({c: number(df, c) for c in columns})
