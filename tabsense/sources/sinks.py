"""Where results go: CSV, JSON records, report tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.basics import first_rows

RECORD_LIMIT = 500  # a question's result table shows no more than this


def export_csv(df: DataFrame, path: str, order: Sequence[str], columns: Sequence[str] = (), n: int | None = None) -> None:
    """The current view: chosen columns, first ``n`` rows in key order. All rows when ``n`` is None."""
    view = first_rows(df, order, n, columns)
    view.write.option("header", True).option("timestampNTZFormat", "yyyy-MM-dd'T'HH:mm:ss").csv(path)


def json_records(df: DataFrame, order: Sequence[str], limit: int = RECORD_LIMIT) -> DataFrame:
    """The first rows as JSON records; null fields are kept and dates are ISO."""
    top = df.orderBy(*order).limit(limit)
    return top.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("record"))


def write_tables(tables: dict[str, DataFrame], folder: str, fmt: str = "parquet") -> None:
    """Each report table under its name."""
    for name, table in tables.items():
        table.write.format(fmt).save(f"{folder.rstrip('/')}/{name}")
