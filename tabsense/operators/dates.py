"""Dates written as text: the shapes that occur in a column, and one reading for all of its cells."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import is_text, named, strip, to_moment
from ..storage import BROADCAST_ROWS, lookup_side, materialize
from .ordering import long_form, value_counts

# two numbers before a year of two or four digits
NUMBERS = r"^([0-9]{1,2})([/.-])([0-9]{1,2})\2([0-9]{2}|[0-9]{4})(?![0-9])"


def _part(text: Column, group: int) -> Column:
    return F.regexp_extract(text, NUMBERS, group).try_cast("int")


def date_shapes(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """``(column, shape, n, readable, day_first, month_first)`` of the text columns.

    A shape has 9 for a digit and A for a word. ``readable`` counts the cells that are moments,
    ``day_first`` and ``month_first`` those that tell the order of their two numbers, as one of
    them is above 12. Cells of over 40 characters are no dates and share the shape ``long``.
    """
    names = [c for c in (columns or df.columns) if is_text(df, c)]
    cells = long_form(df, {c: strip(named(c)) for c in names}).where("value is not null") if names else None
    if cells is None:
        return df.sparkSession.createDataFrame([], "column string, shape string, n bigint, readable bigint, day_first bigint, month_first bigint")
    v = F.col("value")
    shape = F.when(F.length(v) > 40, "long").otherwise(F.translate(F.regexp_replace(v, r"[A-Za-z]+", "A"), "012345678", "999999999"))
    first, second = _part(v, 1), _part(v, 3)
    return cells.groupBy("column", shape.alias("shape")).agg(
        F.count(F.lit(1)).alias("n"), F.count(to_moment(v)).alias("readable"),
        F.count_if((first > 12) & (second <= 12)).alias("day_first"), F.count_if((second > 12) & (first <= 12)).alias("month_first"),
    )


def _vote(cell: Column) -> Column:
    """1 where a cell shows the day before the month, -1 where after it."""
    first, second = _part(strip(cell), 1), _part(strip(cell), 3)
    return F.when((first > 12) & (second <= 12), 1).when((second > 12) & (first <= 12), -1)


def day_first_columns(df: DataFrame, columns: Sequence[str]) -> set[str]:
    """Text columns in which more cells show the day before the month than after it; one scan."""
    names = [c for c in columns if is_text(df, c)]
    if not names:
        return set()
    row = df.agg(*[F.sum(_vote(named(c))).alias(f"v{i}") for i, c in enumerate(names)]).first()
    return {c for i, c in enumerate(names) if (row[f"v{i}"] or 0) > 0}


def parse_dates(df: DataFrame, columns: Sequence[str], lookup_rows: int = BROADCAST_ROWS) -> DataFrame:
    """The text columns as moments, the order of day and month settled for each column as a whole; unreadable cells are null.

    Dates repeat: a column with at most ``lookup_rows`` distinct texts, as estimated, has each of them read
    once and looked up for its cells. The cells of any other column are read one by one.
    """
    names = [c for c in columns if is_text(df, c)]
    if not names:
        return df
    estimates = df.agg(*[F.approx_count_distinct(named(c)).alias(f"d{i}") for i, c in enumerate(names)]).first()
    few = [c for i, c in enumerate(names) if estimates[f"d{i}"] <= lookup_rows]
    many = [c for c in names if c not in few]
    swapped = day_first_columns(df, many)
    out = df.withColumns({c: to_moment(named(c), c in swapped) for c in many})
    if not few:
        return out
    texts = materialize(value_counts(df, {c: named(c) for c in few}).select("column", "value", "n", _vote(F.col("value")).alias("vote")))
    votes = {r["column"]: r["votes"] for r in texts.groupBy("column").agg(F.sum(F.col("n") * F.col("vote")).alias("votes")).collect()}
    for i, c in enumerate(few):
        mine = texts.where(F.col("column") == c).select(F.col("value").alias(f"_t{i}"), to_moment(F.col("value"), (votes.get(c) or 0) > 0).alias(f"_m{i}"))
        out = out.join(lookup_side(mine), named(c) == F.col(f"_t{i}"), "left").drop(f"_t{i}")
    return out.select(*[F.col(f"_m{few.index(c)}").alias(c) if c in few else named(c) for c in df.columns])
