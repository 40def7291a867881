"""Pairwise correlations with p-values."""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import named, number, numeric_columns
from ..functions.rounding import half_up
from ..functions.special import student_two_sided
from ..storage import BROADCAST_ROWS, materialize
from .ordering import ranks_by_key, value_counts
from .ranks import rank_table

PAIRS = (
    "var1 string, var2 string, n bigint, coefficient double, p_value double, is_significant boolean, "
    "strength string, symbol string"
)
# up to this many pairs are one aggregate in generated code; more of them share one pass of matrix products
PAIRS_PER_AGGREGATE = 12
SUMS = ["n", "x", "y", "xx", "yy", "xy"]


def safe_corr(x: Column, y: Column) -> Column:
    """Pearson r over the complete pairs; null when a side is constant, where ``corr`` would raise."""
    spread = F.stddev_pop(F.when(y.isNotNull(), x)) * F.stddev_pop(F.when(x.isNotNull(), y))
    return F.try_divide(F.covar_pop(x, y), spread)


def _p_value(r: float, n: int) -> float:
    if math.isnan(r):
        return math.nan
    if abs(r) >= 1:
        return 0.0
    return student_two_sided(r * math.sqrt((n - 2) / (1 - r * r)), n - 2)


def _strength(r: float) -> str:
    for bound, label in ((0.7, "Strong"), (0.4, "Moderate"), (0.2, "Weak")):
        if abs(r) >= bound:
            return label
    return "Negligible"


def _symbol(p: float) -> str:
    for bound, label in ((0.001, "***"), (0.01, "**"), (0.05, "*")):
        if p < bound:
            return label
    return "ns"


def _pair_row(a: str, b: str, n: int, r: float | None, alpha: float) -> tuple:
    r = math.nan if r is None else max(-1.0, min(1.0, r)) if not math.isnan(r) else r
    r, p = (0.0, 1.0) if n < 4 else (r, _p_value(r, n))
    shown = lambda x, k: None if math.isnan(x) else half_up(x, k)
    return a, b, n, shown(r, 4), shown(p, 6), bool(p < alpha), _strength(r), _symbol(p)


def _pearson(df: DataFrame, pairs: Sequence[tuple[str, str]], plain: set[str]) -> list[tuple[int, float | None]]:
    """``(n, r)`` per pair, in one scan. ``plain`` columns are known to be complete and not constant."""
    if len(pairs) > PAIRS_PER_AGGREGATE:
        return _pearson_by_products(df, pairs)
    aggs = []
    for i, (a, b) in enumerate(pairs):
        x, y = number(df, a), number(df, b)
        r = F.corr(x, y) if a in plain and b in plain else safe_corr(x, y)
        aggs += [F.count_if(x.isNotNull() & y.isNotNull()).alias(f"n{i}"), r.alias(f"r{i}")]
    if not aggs:
        return []
    row = df.agg(*aggs).first()
    return [(row[f"n{i}"], row[f"r{i}"]) for i in range(len(pairs))]


def _pearson_by_products(df: DataFrame, pairs: Sequence[tuple[str, str]]) -> list[tuple[int, float | None]]:
    """``(n, r)`` per pair from the sums over its complete rows.

    Each partition adds up matrix products of its batches, centred on the column means, and
    gives one row per pair; the pairs are then summed. A side whose smallest and largest value
    over the complete rows agree is constant, which the sums alone could not tell.
    """
    names = list(dict.fromkeys(c for p in pairs for c in p))
    cells = [number(df, c) for c in names]
    centre = np.array([v or 0.0 for v in df.agg(*[F.avg(c).alias(f"m{i}") for i, c in enumerate(cells)]).first()])
    left, right = (np.array([names.index(p[side]) for p in pairs]) for side in (0, 1))

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        size = len(names)
        sums = {k: np.zeros((size, size)) for k in ("n", "x", "xx", "xy")}
        low, high = np.full((size, size), np.inf), np.full((size, size), -np.inf)
        for pdf in batches:
            raw = pdf.to_numpy("float64") - centre
            held = ~np.isnan(raw)
            x, m = np.where(held, raw, 0.0), held.astype("float64")
            sums["n"] += m.T @ m
            sums["x"] += x.T @ m
            sums["xx"] += (x * x).T @ m
            sums["xy"] += x.T @ x
            # the smallest and largest of column i over the rows that hold column j
            full = held.all()
            for j in range(1 if full else size):
                rows, to = (raw, slice(None)) if full else (raw[held[:, j]], slice(j, j + 1))
                if len(rows):
                    low[:, to] = np.fmin(low[:, to], np.fmin.reduce(rows, axis=0)[:, None])
                    high[:, to] = np.fmax(high[:, to], np.fmax.reduce(rows, axis=0)[:, None])
        at, back = (left, right), (right, left)
        yield pd.DataFrame({
            "pair": np.arange(len(left)), "n": sums["n"][at], "x": sums["x"][at], "y": sums["x"][back], "xx": sums["xx"][at],
            "yy": sums["xx"][back], "xy": sums["xy"][at], "lx": low[at], "hx": high[at], "ly": low[back], "hy": high[back],
        })

    fields = ", ".join(f"{k} double" for k in [*SUMS, "lx", "hx", "ly", "hy"])
    parts = df.select(*[c.alias(f"c{i}") for i, c in enumerate(cells)]).mapInPandas(add, f"pair bigint, {fields}")
    got = parts.groupBy("pair").agg(
        *[F.sum(k).alias(k) for k in SUMS], *[f(k).alias(k) for k, f in (("lx", F.min), ("ly", F.min), ("hx", F.max), ("hy", F.max))]
    ).collect()  # one row per pair of columns
    out: list[tuple[int, float | None]] = [(0, None)] * len(pairs)
    for r in got:
        n, r_ = r["n"], None
        if n and r["lx"] < r["hx"] and r["ly"] < r["hy"]:
            spread = (n * r["xx"] - r["x"] ** 2) * (n * r["yy"] - r["y"] ** 2)
            r_ = (n * r["xy"] - r["x"] * r["y"]) / math.sqrt(spread) if spread > 0 else None
        out[r["pair"]] = (int(n), r_)
    return out


def _usable(df: DataFrame, columns: Sequence[str] | None) -> tuple[DataFrame, list[str], set[str], set[str]]:
    """The columns that hold values; those without gaps; those without gaps that vary. One scan."""
    chosen = list(columns or numeric_columns(df))
    if not chosen:
        return df, [], set(), set()
    table = df.select(*[named(c) for c in chosen])
    cells = {c: number(table, c) for c in chosen}
    row = table.agg(F.count(F.lit(1)).alias("_n"), *[
        e for i, c in enumerate(cells.values()) for e in (F.count(c).alias(f"n{i}"), (F.min(c) < F.max(c)).alias(f"v{i}"))
    ]).first()
    held = [c for i, c in enumerate(chosen) if row[f"n{i}"] > 0]
    full = {c for i, c in enumerate(chosen) if c in held and row[f"n{i}"] == row["_n"]}
    return table.select(*[named(c) for c in held]), held, full, {c for i, c in enumerate(chosen) if c in full and row[f"v{i}"]}


def _frame(df: DataFrame, rows: list[tuple]) -> DataFrame:
    rows.sort(key=lambda r: (-(abs(r[3]) if r[3] is not None else -1.0), r[0], r[1]))
    return df.sparkSession.createDataFrame(rows, PAIRS)


def correlation_pairs(df: DataFrame, columns: Sequence[str] | None = None, alpha: float = 0.05) -> DataFrame:
    """Pearson r over the complete rows of every pair, all pairs of a batch in one scan."""
    table, cols, _, plain = _usable(df, columns)
    pairs = list(itertools.combinations(cols, 2))
    got = _pearson(table, pairs, plain)
    return _frame(df, [_pair_row(a, b, n, r, alpha) for (a, b), (n, r) in zip(pairs, got)])


def spearman(
    df: DataFrame, columns: Sequence[str] | None = None, alpha: float = 0.05, lookup_rows: int = BROADCAST_ROWS
) -> DataFrame:
    """Pearson r of the average ranks.

    Columns without missing cells are ranked once and share one ranked table;
    a pair with missing cells is ranked on its own complete rows. The ranks of a column of at
    most ``lookup_rows`` distinct values, as estimated, are looked up; the cells of the
    others are sorted over ranges and brought back by row, whatever their number.
    """
    table, cols, complete, plain = _usable(df, columns)
    if len(cols) < 2:
        return df.sparkSession.createDataFrame([], PAIRS)
    full = [c for c in cols if c in complete]
    pairs = list(itertools.combinations(cols, 2))
    shared = [p for p in pairs if p[0] in full and p[1] in full]
    results: dict[tuple[str, str], tuple] = {}

    def ranked(rows: DataFrame, names: Sequence[str]) -> DataFrame:
        cells = {c: number(rows, c) for c in names}
        kinds = rows.agg(*[F.approx_count_distinct(c).alias(f"d{i}") for i, c in enumerate(cells.values())]).first()
        few = {n: c for (n, c), kind in zip(cells.items(), kinds) if kind <= lookup_rows}
        many = {n: c for n, c in cells.items() if n not in few}
        out = rows.select(*[c.alias(n) for n, c in cells.items()])
        if many:
            out = rank_table(out, {n: named(n) for n in many}, list(few))
        if few:
            ranks = materialize(ranks_by_key(value_counts(rows, few), ["column"]).select("column", "value", "avg_rank"))
        for i, c in enumerate(few):
            mine = ranks.where(F.col("column") == c).select(F.col("value").alias(f"_v{i}"), F.col("avg_rank").alias(f"_r{i}"))
            out = out.join(F.broadcast(mine), named(c) == F.col(f"_v{i}")).drop(f"_v{i}", c).withColumnRenamed(f"_r{i}", c)
        return out.select(*[named(c) for c in names])

    if shared:
        results.update(zip(shared, _pearson(ranked(table, full), shared, plain)))
    for a, b in pairs:
        if (a, b) not in results:
            rows = table.select(number(table, a).alias(a), number(table, b).alias(b)).dropna()
            results[a, b] = _pearson(ranked(rows, [a, b]), [(a, b)], set())[0]
    return _frame(df, [_pair_row(a, b, *results[a, b], alpha) for a, b in pairs])


def corr_matrix(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Long-form symmetric matrix ``(var1, var2, coefficient)`` with 1.0 on the diagonal."""
    table, cols, _, plain = _usable(df, columns)
    pairs = list(itertools.combinations(cols, 2))
    rows = [(c, c, 1.0) for c in cols]
    for (a, b), (_, r) in zip(pairs, _pearson(table, pairs, plain)):
        v = None if r is None or math.isnan(r) else half_up(r, 4)
        rows += [(a, b, v), (b, a, v)]
    return df.sparkSession.createDataFrame(rows, "var1 string, var2 string, coefficient double")
