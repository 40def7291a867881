"""Pieces that several of the operators share."""

from __future__ import annotations

import string
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import materialize

# word separators: space and the five ASCII line and tab characters
SPACES = r"[\x20\x09-\x0D]+"


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z and nothing else."""
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def let(value: str, name: str, body: str) -> str:
    """SQL for ``body`` with ``name`` standing for ``value``, which is evaluated once per row.

    Without it the optimizer may put a computed array inside a lambda and evaluate
    it again for every element.
    """
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def texts_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text) of every row and nothing else, so that other columns cannot clash; a null text is empty."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def slices(batches: Iterator[pa.RecordBatch], most_bytes: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    """The same rows in smaller batches, so that working memory follows the bytes and not the number of rows."""
    for batch in batches:
        rows = batch.num_rows
        if rows:
            step = max(1, int(rows * most_bytes / max(batch.nbytes, 1)))
            for at in range(0, rows, step):
                yield batch.slice(at, step)


def words_of(text: str) -> list[bytes]:
    """Words of a text as UTF-8, A-Z in lower case. ``bytes.split`` parts at exactly the characters of SPACES."""
    return text.encode("utf-8", "surrogatepass").lower().split()


def word_count(text_col: str = "text") -> Column:
    """Number of words of a text, as a long; 0 for null."""
    flat = f"coalesce(`{text_col}`, '')"
    for separator in ("\\t", "\\n", "\\u000B", "\\u000C", "\\r"):
        flat = f"replace({flat}, '{separator}', ' ')"
    return F.expr(f"cast(size(array_remove(split({flat}, ' '), '')) as bigint)")


# a table is sent to every executor only below both of these, as counted
SIDE_ROWS = 200_000
SIDE_BYTES = 32_000_000


def sized_side(df: DataFrame) -> DataFrame:
    """The small side of a join, computed once: broadcast if its counted rows and bytes are few, else joined by a shuffle that Spark may split."""
    table = materialize(df)
    width = sum((F.coalesce(F.octet_length(f"`{f.name}`"), F.lit(0)) if f.dataType.simpleString() == "string" else F.lit(8)) for f in table.schema.fields)
    rows, size = table.agg(F.count(F.lit(1)), F.coalesce(F.sum(width), F.lit(0))).first()
    return F.broadcast(table) if rows <= SIDE_ROWS and size <= SIDE_BYTES else table


HOT_ROWS = 10_000


def join_by_size(left: DataFrame, right: DataFrame, key: str, size: str, how: str = "inner", bound: int = HOT_ROWS) -> DataFrame:
    """``left`` joined with the one row per key of ``right``, whose column ``size`` says how often the key stands in ``left``.

    Keys that stand there more than ``bound`` times are few, at most rows / bound, and are sent
    to where the rows lie; all others are joined by a shuffle. ``how`` is inner or left.
    """
    hot = sized_side(right.where(F.col(size) > bound))
    cold = right.where(F.col(size) <= bound)
    rest = left.join(hot.select(key), key, "left_anti")
    return left.join(hot, key).unionByName(rest.join(cold, key, how))
