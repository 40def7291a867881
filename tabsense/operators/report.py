"""The tables of an executive report."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import named, numeric_columns, present, spread_rows
from .basics import distinct_counts, duplicate_count
from .quality import table_health


def _sizes(df: DataFrame) -> DataFrame:
    nulls = [F.count_if(present(df, c).isNull()) for c in df.columns]
    return df.agg(F.count(F.lit(1)).alias("total_rows"), sum(nulls[1:], nulls[0]).alias("missing_cells"))


def kpi_scorecard(df: DataFrame) -> DataFrame:
    """Rows, columns, missing cells, duplicates and the integrity score, in one row."""
    width = len(df.columns)
    cells = F.col("total_rows") * width
    missing_pct = F.coalesce(F.try_divide(F.col("missing_cells"), cells), F.lit(0.0)) * 100
    dup_pct = F.coalesce(F.try_divide(F.col("duplicate_rows"), F.col("total_rows")), F.lit(0.0)) * 100
    both = _sizes(df).crossJoin(F.broadcast(duplicate_count(df).withColumnRenamed("duplicates", "duplicate_rows")))
    return both.select(
        "total_rows", F.lit(width).cast("bigint").alias("total_columns"), "missing_cells", "duplicate_rows",
        F.greatest(F.round(100 - missing_pct * 2 - dup_pct * 1.5, 1), F.lit(0.0)).alias("integrity_score"),
    )


def column_summary(df: DataFrame, first: int = 15) -> DataFrame:
    """Storage type, non-null and distinct values, null share of the first columns of the schema."""
    cols = df.columns[:first]
    table = df.select(*[named(c) for c in cols])
    info = df.sparkSession.createDataFrame(
        [(i, c, df.schema[c].dataType.simpleString()) for i, c in enumerate(cols)], "position int, column string, dtype string"
    )
    # one row per column from here on
    held = df.agg(F.count(F.lit(1)).alias("_rows"), *[F.count(present(df, c)).alias(c) for c in cols]).unpivot(
        ["_rows"], [named(c) for c in cols], "column", "non_null"
    )
    small = held.join(F.broadcast(distinct_counts(table)), "column")
    return info.join(F.broadcast(small), "column").select(
        "position", "column", "dtype", "non_null", F.col("distinct").alias("unique"),
        F.round(F.coalesce(F.try_divide(F.col("_rows") - F.col("non_null"), F.col("_rows")), F.lit(0.0)) * 100, 1).alias("null_pct"),
    )


def report_findings(df: DataFrame) -> DataFrame:
    """``(seq, finding, value)``: missing cells, duplicates, number of numeric columns."""
    k = kpi_scorecard(df)
    numbers = len(numeric_columns(df))
    missing, dups = F.col("missing_cells"), F.col("duplicate_rows")
    return k.select(spread_rows(["seq", "finding", "value"], [
        [F.lit(1), F.when(missing > 0, "missing_cells").otherwise("complete"), missing],
        [F.lit(2), F.when(dups > 0, "duplicate_rows").otherwise("no_duplicates"), dups],
        [F.lit(3), F.lit("numeric_columns"), F.lit(numbers).cast("bigint")],
    ])).where((F.col("finding") != "numeric_columns") | (F.col("value") > 0))


def quality_score(df: DataFrame) -> DataFrame:
    """The dashboard score, on the missing share that counts null tokens too."""
    h = table_health(df)
    return h.select(
        "missing_pct", "duplicate_rows",
        F.greatest(F.lit(0), (100 - F.col("missing_pct") * 1.5 - F.col("duplicate_rows") * 2).cast("bigint"))
        .cast("bigint").alias("quality_score"),
    )
