"""Average ranks of many columns at once, whatever their distinct values and ties.

All cells are sorted by (column, value, row) over ranges, so a value that holds a third of
the rows is spread over tasks as well. They are kept as arrays, of their rows and of the
starts of runs of equal cells. Each partition reports how many cells of a column it
has and how often its first and last value occur in it; from these few numbers follow the
ranks before each partition and the whole length of a run of ties that crosses its edges.
A second pass streams through the sorted partitions and gives every cell its rank. Nothing
is joined on a value.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import named
from ..storage import materialize
from .ordering import long_form

EDGES = "part int, column int, n long, low double, n_low long, high double, n_high long"
PACKED = f"{EDGES}, runs array<int>, rows array<long>"
RANKS = "_row long, column int, avg_rank double"


def _same(a: float, b: float) -> bool:
    return a == b or (a != a and b != b)


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted cells as one row per batch and column: their rows, where runs of equal cells start, and the first and the last value with their numbers."""
    for batch in batches:
        if not batch.num_rows:
            continue
        columns, value = batch["column"].to_numpy(), batch["value"].to_numpy()
        other = columns[1:] != columns[:-1]
        differs = (value[1:] != value[:-1]) & ~(np.isnan(value[1:]) & np.isnan(value[:-1]))
        starts = np.flatnonzero(np.r_[True, other])
        ends = np.r_[starts[1:], len(columns)]
        runs = np.flatnonzero(np.r_[True, other | differs])
        at = np.r_[np.searchsorted(runs, starts), len(runs)]
        sizes = np.diff(np.r_[runs, len(columns)])
        inside = runs - np.repeat(starts, np.diff(at))
        yield pa.RecordBatch.from_arrays(
            [batch["_part"].take(pa.array(starts)), pa.array(columns[starts]), pa.array(ends - starts), pa.array(value[starts]), pa.array(sizes[at[:-1]]), pa.array(value[ends - 1]),
             pa.array(sizes[at[1:] - 1]), pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(inside, pa.int32())),
             pa.ListArray.from_arrays(pa.array(np.r_[starts, len(columns)], pa.int32()), batch["_row"])],
            [f.split(" ")[0] for f in PACKED.split(", ")],
        )


def _segments(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, float, float, np.ndarray, np.ndarray]]:
    """(partition, column, first value, last value, starts of runs, rows) of the packed cells, in order."""
    for batch in batches:
        for i in range(batch.num_rows):
            yield *(batch[k][i].as_py() for k in ("part", "column", "low", "high")), *(batch[k][i].values.to_numpy() for k in ("runs", "rows"))


def _edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per column of the partition."""
    found: dict[tuple[int, int], tuple] = {}
    for batch in batches:
        for e in batch.to_pylist():
            key, first, last = (e["part"], e["column"]), e["low"], e["high"]
            n, low, n_low, high, n_high = found.get(key, (0, first, 0, first, 0))
            n_low += e["n_low"] if _same(first, low) else 0
            n_high = (n_high if _same(last, high) else 0) + e["n_high"]
            found[key] = (n + e["n"], low, n_low, last, n_high)
    if found:
        rows = [(*key, *facts) for key, facts in found.items()]
        kinds = (pa.int32(), pa.int32(), pa.int64(), pa.float64(), pa.int64(), pa.float64(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], [f.split(" ")[0] for f in EDGES.split(", ")])


def _carried(edges: list) -> dict[tuple[int, int], tuple[int, dict[float, tuple[int, int]]]]:
    """For each partition and column: cells before it, and for its first and last value how often it occurs before and in all."""
    total: dict[tuple[int, float], int] = {}
    seen: dict[tuple[int, float], int] = {}
    before: dict[int, int] = {}
    key = lambda e, v: (e["column"], "nan" if v != v else v)

    def values(e) -> list[tuple[float, int]]:
        return [(e["low"], e["n_low"])] if _same(e["low"], e["high"]) else [(e["low"], e["n_low"]), (e["high"], e["n_high"])]

    for e in edges:
        for v, n in values(e):
            total[key(e, v)] = total.get(key(e, v), 0) + n
    out = {}
    for e in edges:
        out[e["part"], e["column"]] = (before.get(e["column"], 0), {k[1]: (seen.get(k, 0), total[k]) for k in (key(e, v) for v, _ in values(e))})
        before[e["column"]] = before.get(e["column"], 0) + e["n"]
        for v, n in values(e):
            seen[key(e, v)] = seen.get(key(e, v), 0) + n
    return out


@dataclass
class _Run:
    """Equal cells that the next batch may go on with: where they start and, unless their rank is known, their rows."""

    column: int
    value: float
    start: int
    rank: float | None
    rows: list[np.ndarray]


def _ranked(carried: dict):
    def table(column: int, rows: np.ndarray, ranks: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(rows), pa.array(np.full(len(rows), column, np.int32)), pa.array(ranks)], ["_row", "column", "avg_rank"])

    def closed(run: _Run) -> Iterator[pa.RecordBatch]:
        """The cells of a run that lies within its partition."""
        if run.rank is None:
            rows = np.concatenate(run.rows)
            yield table(run.column, rows, np.full(len(rows), run.start + (len(rows) + 1) / 2))

    def ranked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run, before = None, {}
        for part, column, low, high, firsts, rows in _segments(batches):
            start, edges = carried[part, column]
            at = before.get(column, start)
            before[column] = at + len(rows)
            sizes = np.diff(np.r_[firsts, len(rows)])
            ranks = at + firsts + (sizes + 1) / 2
            given = np.ones(len(firsts), bool)

            def opened(i: int) -> _Run:
                value, begin = high if i else low, at + int(firsts[i])
                edge = edges.get("nan" if value != value else value)
                return _Run(column, value, begin, None if edge is None else begin - edge[0] + (edge[1] + 1) / 2, [])

            # only the first and the last run of a batch can go on in another one, or in another partition
            for i in dict.fromkeys((0, len(firsts) - 1)):
                if i or run is None or run.column != column or not _same(run.value, low):
                    if run is not None:
                        yield from closed(run)
                    run = opened(i)
                if run.rank is None:
                    run.rows.append(rows[firsts[i] : firsts[i] + sizes[i]])
                    given[i] = False
                else:
                    ranks[i] = run.rank
            shown = np.repeat(given, sizes)
            if shown.any():
                yield table(column, rows[shown], np.repeat(ranks, sizes)[shown])
        if run is not None:
            yield from closed(run)

    return ranked


def _cell_ranks(df: DataFrame, cells: Sequence[Column], row: str) -> DataFrame:
    """``(_row, column, avg_rank)``; a column goes by its number, which is shorter to sort, keep and send than its name."""
    named_rows = df.select(named(row).alias("_row"), *[c.cast("double").alias(str(i)) for i, c in enumerate(cells)])
    long = long_form(named_rows, {str(i): named(str(i)) for i in range(len(cells))}, ["_row"]).where("value is not null")
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    long = long.select("_row", F.col("column").cast("int").alias("column"), "value")
    ranged = long.repartitionByRange(parts, "column", "value", "_row").sortWithinPartitions("column", "value")
    # kept by batches: cell by cell they would take longer to write and read than to sort
    packed = materialize(ranged.withColumn("_part", F.spark_partition_id()).mapInArrow(_packed, PACKED))
    # one entry per partition and column in it: at most partitions plus columns
    edges = packed.drop("runs", "rows").mapInArrow(_edges, EDGES).collect()
    return packed.select("part", "column", "low", "high", "runs", "rows").mapInArrow(_ranked(_carried(sorted(edges, key=lambda e: e["part"]))), RANKS)


def stitched_ranks(df: DataFrame, cells: dict[str, Column], row: str) -> DataFrame:
    """``(_row, column, avg_rank)`` of the non-null cells: 1-based ranks, ties averaged.

    ``row`` is a bigint column that names the rows. One shuffle, for all columns.
    """
    name = F.element_at(F.array(*[F.lit(n) for n in cells]), F.col("column") + 1)
    return _cell_ranks(df, list(cells.values()), row).select("_row", name.alias("column"), "avg_rank")


def rank_table(df: DataFrame, cells: dict[str, Column], keep: Sequence[str] = ()) -> DataFrame:
    """The table with every cell replaced by its average rank; two shuffles for all columns. Columns named in ``keep`` stay as they are."""
    values = [c.cast("double").alias(n) for n, c in cells.items()]
    numbered = materialize(df.select(*values, *[named(k) for k in keep]).withColumn("_row", F.monotonically_increasing_id()))
    ranks = _cell_ranks(numbered, [named(n) for n in cells], "_row")
    wide = ranks.groupBy("_row").agg(*[F.max(F.when(F.col("column") == i, F.col("avg_rank"))).alias(n) for i, n in enumerate(cells)])
    if keep:
        wide = numbered.select("_row", *[named(k) for k in keep]).join(wide, "_row", "left")
    return wide.drop("_row")
