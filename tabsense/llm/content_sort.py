"""Exact duplicates by sorting whole normalised texts.

Rows are dealt to ranges of the normalised text by sampled splitters and sorted inside each
range by Spark's external sort, so equal texts lie side by side, and a group is a run of
neighbours that are equal in full. The splitters see the first characters and a hash of the
lower-cased text, both short, so the driver's sample does not grow with the texts.

Only a text whose hash stands in over PART_ROWS rows, as counted before, gets a salt, by
which splitters can fall inside its group. Each part then keeps one row, with its text, and
these few rows are sorted and compared with their neighbours in full in turn.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import store
from .common import ascii_lower, sized_side

HEAD = 32
PART_ROWS = 1_000  # a larger group is sorted in parts of about so many rows
MOST_PARTS = 1_024


def _source(docs: DataFrame, id_col: str, text_col: str, body: Column) -> DataFrame:
    return docs.select(body, F.col(id_col).cast("long").alias("_id"), F.xxhash64(F.lower(F.coalesce(F.col(text_col), F.lit("")))).alias("_tie"))


def _neighbours(rows: DataFrame, text: Column, largest: bool) -> DataFrame:
    """Adds to (_id, _tie, ...) _sha and what the run of equal neighbours tells: _best, _n, _place (1: stays).

    _parts is null where the run is the whole group; else _salt names the part, and its row
    that stays carries the text in _kept_text. ``text`` is read off the other columns.
    """
    text, count = F.coalesce(text, F.lit("")), F.count(F.lit(1))
    hot = sized_side(rows.groupBy("_tie").agg(count.alias("_rows")).where(F.col("_rows") > PART_ROWS).select("_tie", F.least(F.ceil(F.col("_rows") / PART_ROWS), F.lit(MOST_PARTS)).alias("_parts")))
    number = F.xxhash64(F.coalesce("_id", F.monotonically_increasing_id()))  # rows with one id share a part, rows without an id are spread
    ranged = rows.join(hot, "_tie", "left").withColumns({
        "_head": ascii_lower(F.left(text, F.lit(HEAD))),
        "_salt": F.when(F.col("_parts").isNull(), 0).otherwise(F.pmod(number, F.col("_parts"))),
    }).repartitionByRange("_head", "_tie", "_salt")
    same = Window.partitionBy("_head", "_tie", "_salt", "_norm").orderBy(_order(largest))
    whole = same.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return (
        ranged.withColumn("_norm", ascii_lower(text))
        .withColumn("_place", F.row_number().over(same))
        .withColumn("_best", F.first("_id").over(whole))
        .withColumn("_n", count.over(whole))
        .withColumn("_sha", F.sha2(F.col("_norm"), 256))
        .withColumn("_kept_text", F.when(F.col("_parts").isNotNull() & (F.col("_place") == 1), F.col("_norm")))
        .drop("_norm", "_head")
    )


def _order(largest: bool, id_col: str = "_id") -> Column:
    return F.col(id_col).desc_nulls_last() if largest else F.col(id_col).asc_nulls_last()


def _merged(local: DataFrame, largest: bool) -> DataFrame:
    """Of the parts of large groups, by part and text: the id that stays, the rows of the group, and whether the part has the row that stays."""
    same = Window.partitionBy("_tie", "_kept_text").orderBy(_order(largest, "_best"), "_salt")
    whole = same.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return sized_side(local.where("_kept_text is not null").select(
        "_tie", "_salt", "_sha", F.first("_best").over(whole).alias("_keep"), F.sum("_n").over(whole).alias("_size"), (F.row_number().over(same) == 1).alias("_first")))


def duplicate_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest") -> DataFrame:
    """doc_id, keep_id, group_size, kept and text_sha256 of every row.

    A null text is the empty text, and empty texts are equal. ``keep`` is ``smallest`` or
    ``largest``; a null id loses against any other and forms keep_id only where all ids of
    the group are null. Of rows with the same id and text exactly one is kept. Other
    columns are ignored; an empty table gives an empty result.
    """
    largest = _largest(keep)
    rows = _source(docs, id_col, text_col, F.col(text_col).alias("_text"))
    local = store(_neighbours(rows, F.col("_text"), largest).drop("_text"), "content-sort")
    rows = local.drop("_kept_text").join(_merged(local, largest), ["_tie", "_salt", "_sha"], "left")
    whole = F.col("_parts").isNull()
    return rows.select(
        F.col("_id").alias("doc_id"), F.when(whole, F.col("_best")).otherwise(F.col("_keep")).alias("keep_id"), F.when(whole, F.col("_n")).otherwise(F.col("_size")).alias("group_size"),
        ((F.col("_place") == 1) & (whole | F.col("_first"))).alias("kept"), F.col("_sha").alias("text_sha256"),
    )


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest") -> DataFrame:
    """The rows that stay, with all their columns as they came. Nulls and ties as in ``duplicate_groups``.

    The rows that stay in their part are written once; only parts of large groups meet again.
    """
    largest = _largest(keep)
    rows = _source(docs, id_col, text_col, F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"))
    local = store(_neighbours(rows, F.col("_row")[text_col], largest).where("_place = 1"), "content-sort")
    rows = local.drop("_kept_text").join(_merged(local, largest), ["_tie", "_salt", "_sha"], "left")
    return rows.where("_parts is null or _first").select("_row.*")


def _largest(keep: str) -> bool:
    if keep not in ("smallest", "largest"):
        raise ValueError("keep is 'smallest' or 'largest'")
    return keep == "largest"


SQL = """
WITH t AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS norm FROM documents),
g AS (SELECT norm, max(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY norm)
SELECT t.doc_id, g.keep_id, g.group_size, t.doc_id = g.keep_id AS kept, sha256(t.norm) AS text_sha256 FROM t JOIN g USING (norm)
"""
