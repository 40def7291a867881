"""Order statistics: value counts, running totals, exact quantiles, average ranks.

None of them sorts a whole table in one task. Equal values are counted first, so
a value that fills a third of the table is one row afterwards. What is left is
put in order by range partitioning, and each partition adds the totals of the
partitions before it.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..functions.columns import named, number
from ..storage import materialize

# Up to this many rows one task may order a frame; measured, never assumed.
ONE_TASK_ROWS = 1_000_000
# Up to this many cells of a key one task may hold as a quantile state.
ONE_STATE_ROWS = 200_000
# Rows drawn to bracket the quantiles before the exact search inside the brackets.
BRACKET_SAMPLE = 100_000
# Half-widths of a bracket in rank share; the first one that is safe for the sample is used.
MARGINS = [0.009, 0.02, 0.08]
# Keys handled by brackets at once; their facts travel by broadcast.
HOT_KEYS = 1000


def long_form(df: DataFrame, cells: dict[str, Column], keys: Sequence[str] = ()) -> DataFrame:
    """One row ``(keys, column, value)`` per cell. The cells must share a type."""
    wide = df.select(*[named(k) for k in keys], *[c.alias(n) for n, c in cells.items()])
    return wide.unpivot([named(k) for k in keys], [named(n) for n in cells], "column", "value")


def value_counts(df: DataFrame, cells: dict[str, Column], keys: Sequence[str] = ()) -> DataFrame:
    """``(keys, column, value, n)`` of the non-null cells; combined map-side."""
    return (
        long_form(df, cells, keys)
        .where(F.col("value").isNotNull())
        .groupBy(*keys, "column", "value")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def running_totals(
    frame: DataFrame, order: Sequence[Column], weights: dict[str, str], keys: Sequence[str] = (),
    one_task_rows: int = ONE_TASK_ROWS, materialized: bool = False, at_most: int | None = None,
) -> DataFrame:
    """Add ``weights[w]`` = sum of ``w`` over all earlier rows of the same key (exclusive).

    A frame that is measured to be small takes a plain window. A larger one is
    range partitioned on (keys, order) and written, which fixes the partition
    numbers; a key that spans partitions receives the totals of those before.
    ``at_most`` is a row count the caller has proven, which saves the measuring.
    """
    here = [named(k) for k in keys]
    if at_most is None or at_most > one_task_rows:
        frame = frame if materialized else materialize(frame)
        at_most = frame.count()
    if at_most <= one_task_rows:
        w = Window.partitionBy(*(here or [F.lit(0)])).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
        return frame.withColumns({out: F.coalesce(F.sum(src).over(w), F.lit(0)) for src, out in weights.items()})

    parts = int(frame.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = materialize(
        frame.repartitionByRange(parts, *here, *order).withColumn("_part", F.spark_partition_id())
    )
    slices = ranged.groupBy("_part", *here).agg(*[F.sum(s).alias(f"_w{i}") for i, s in enumerate(weights)])
    before = Window.partitionBy(*(here or [F.lit(0)])).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    carried = slices.select(
        "_part", *here,
        *[F.coalesce(F.sum(f"_w{i}").over(before), F.lit(0)).alias(f"_c{i}") for i in range(len(weights))],
    )
    inside = Window.partitionBy("_part", *here).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    local = ranged.withColumns(
        {f"_l{i}": F.coalesce(F.sum(s).over(inside), F.lit(0)) for i, s in enumerate(weights)}
    )
    # keys may be null: join null-safe
    left, right = local.alias("l"), carried.alias("c")
    match = F.col("l._part") == F.col("c._part")
    for k in keys:
        match = match & F.col(f"l.`{k}`").eqNullSafe(F.col(f"c.`{k}`"))
    return left.join(right, match).select(
        *[F.col(f"l.`{c}`") for c in frame.columns],
        *[(F.col(f"l._l{i}") + F.col(f"c._c{i}")).alias(out) for i, out in enumerate(weights.values())],
    )


# --- quantiles ---------------------------------------------------------------


def _array(probs: Sequence[float]) -> Column:
    return F.array(*[F.lit(float(p)) for p in probs])


def _small_keys(cells: DataFrame, keys: Sequence[str], probs: Sequence[float], counted: bool = False) -> DataFrame:
    """For keys whose cells, or distinct values when ``counted``, fit one state."""
    if counted:
        cells = cells.groupBy(*keys, "value").agg(F.sum("n").alias("n"))
    return cells.groupBy(*keys).agg(F.percentile("value", _array(probs), F.col("n")).alias("q"))


def _ordered_keys(cells: DataFrame, keys: Sequence[str], probs: Sequence[float], one_task_rows: int) -> DataFrame:
    """For many large keys: all distinct values are put in order by range."""
    counted = materialize(cells.groupBy(*keys, "value").agg(F.sum("n").alias("n")))
    ranked = running_totals(counted, [F.col("value")], {"n": "before"}, keys, one_task_rows, materialized=True)
    sizes = counted.groupBy(*keys).agg(F.sum("n").alias("total"))
    h = [(F.col("total") - 1) * F.lit(float(p)) for p in probs]
    return _pick(ranked.join(sizes, list(keys)), keys, [F.floor(x) for x in h], [F.ceil(x) for x in h], [x - F.floor(x) for x in h])


def _pick(ranked: DataFrame, keys: Sequence[str], low: Sequence[Column], high: Sequence[Column], part: Sequence[Column]) -> DataFrame:
    """Interpolate between the values that cover the 0-based positions ``low`` and ``high``."""
    covers = lambda k: F.max(F.when((F.col("before") <= k) & (F.col("before") + F.col("n") > k), F.col("value")))
    aggs = [
        e for i in range(len(low))
        for e in (covers(low[i]).alias(f"_a{i}"), covers(high[i]).alias(f"_b{i}"), F.max(part[i]).alias(f"_f{i}"))
    ]
    between = [F.col(f"_a{i}") + (F.col(f"_b{i}") - F.col(f"_a{i}")) * F.col(f"_f{i}") for i in range(len(low))]
    return ranked.groupBy(*keys).agg(*aggs).select(*keys, F.array(*between).alias("q"))


def _bracket(p: float, i: int, m: int, q: Sequence[float] | None) -> tuple[float, float]:
    """The edges around the i-th quantile that a sample of ``m`` cells allows."""
    needed = 5 * math.sqrt(p * (1 - p) / m) + 5 / m if m else math.inf
    for j, margin in enumerate(MARGINS):
        if margin >= needed:
            at = 2 * (i * len(MARGINS) + j)
            return (q[at] if p > margin else -math.inf), (q[at + 1] if p < 1 - margin else math.inf)
    return -math.inf, math.inf


def _near(value: Column, lo: Sequence, hi: Sequence) -> tuple[list[Column], list[Column], Column]:
    """Per quantile: below its bracket, inside it; and inside any bracket."""
    below = [value < x for x in lo]
    inside = [value.between(x, y) for x, y in zip(lo, hi)]
    return below, inside, reduce(lambda a, b: a | b, inside)


def _near_counts(value: Column, n: Column, lo: Sequence, hi: Sequence, tag: str = "") -> list[Column]:
    below, inside, anywhere = _near(value, lo, hi)
    total = lambda test: F.coalesce(F.sum(F.when(test, n)), F.lit(0))
    return [
        e for i in range(len(below)) for e in (
            total(below[i]).alias(f"b{i}{tag}"), total(inside[i]).alias(f"i{i}{tag}"),
            total(below[i] & anywhere).alias(f"c{i}{tag}"),
        )
    ]


class _Cells:
    """Cells in long form, one key column or more: brackets travel as a broadcast table."""

    def __init__(self, cells: DataFrame, keys: Sequence[str], sizes: dict[tuple, int]):
        self.keys, self.sizes, self.spark = list(keys), sizes, cells.sparkSession
        self.key_schema = [cells.schema[k] for k in keys]
        only = self.spark.createDataFrame(list(sizes), T.StructType(self.key_schema))
        self.cells = cells.join(F.broadcast(only), self.keys, "left_semi")

    def sample(self) -> DataFrame:
        return self.cells.sample(fraction=min(1.0, BRACKET_SAMPLE / sum(self.sizes.values())), seed=7)

    def _edged(self, edges: dict) -> DataFrame:
        doubles = T.ArrayType(T.DoubleType())
        schema = T.StructType([*self.key_schema, T.StructField("_lo", doubles), T.StructField("_hi", doubles)])
        rows = [(*k, [e[0] for e in es], [e[1] for e in es]) for k, es in edges.items()]
        return self.cells.join(F.broadcast(self.spark.createDataFrame(rows, schema)), self.keys)

    @staticmethod
    def _arrays(edges: dict):
        size = len(next(iter(edges.values())))
        return [F.col("_lo")[i] for i in range(size)], [F.col("_hi")[i] for i in range(size)]

    def counts(self, edges: dict) -> dict[tuple, dict]:
        lo, hi = self._arrays(edges)
        rows = self._edged(edges).groupBy(*self.keys).agg(*_near_counts(F.col("value"), F.col("n"), lo, hi)).collect()
        return {tuple(r[k] for k in self.keys): r.asDict() for r in rows}

    def candidates(self, edges: dict) -> DataFrame:
        lo, hi = self._arrays(edges)
        return self._edged(edges).where(_near(F.col("value"), lo, hi)[2])


class _Columns:
    """Columns of one table: brackets are literals, and only near cells leave the wide form."""

    def __init__(self, df: DataFrame, columns: dict[str, Column], sizes: dict[tuple, int]):
        self.df, self.columns, self.sizes, self.spark = df, columns, sizes, df.sparkSession
        self.keys, self.key_schema = ["column"], [T.StructField("column", T.StringType())]

    def sample(self) -> DataFrame:
        share = min(1.0, BRACKET_SAMPLE / max(self.sizes.values()))
        rows = self.df.select(*[c.alias(k) for k, c in self.columns.items()]).sample(fraction=share, seed=7)
        return _unit_cells(rows, {k: named(k) for k in self.columns})

    def counts(self, edges: dict) -> dict[tuple, dict]:
        out, names = {}, list(self.columns)
        for start in range(0, len(names), 4):
            part = names[start : start + 4]
            row = self.df.agg(*[
                e for j, k in enumerate(part) for e in _near_counts(
                    self.columns[k], F.lit(1).cast("bigint"), [F.lit(x) for x, _ in edges[(k,)]], [F.lit(y) for _, y in edges[(k,)]], f"_{j}")
            ]).first()
            for j, k in enumerate(part):
                out[(k,)] = {f"{t}{i}": row[f"{t}{i}_{j}"] for t in "bic" for i in range(len(edges[(k,)]))}
        return out

    def candidates(self, edges: dict) -> DataFrame:
        near = {}
        for k, c in self.columns.items():
            anywhere = _near(c, [F.lit(x) for x, _ in edges[(k,)]], [F.lit(y) for _, y in edges[(k,)]])[2]
            near[k] = F.when(anywhere, c)
        return _unit_cells(self.df, near)


def _bracketed(source: _Cells | _Columns, probs: Sequence[float], one_task_rows: int) -> DataFrame:
    """``(keys, q)`` for up to HOT_KEYS keys with too many cells for one task.

    A sample proposes a bracket around each quantile; one scan counts the rows
    below and inside; only the values inside are counted, shuffled and put in
    order. A bracket that misses its target is opened fully, so the answer stays
    exact.
    """
    keys, sizes = source.keys, source.sizes
    shares = [min(1.0, max(0.0, p + side * m)) for p in probs for m in MARGINS for side in (-1, 1)]
    drawn = source.sample().groupBy(*keys).agg(
        F.count(F.lit(1)).alias("m"), F.percentile("value", _array(shares), F.col("n")).alias("q")
    )
    sampled = {tuple(r[k] for k in keys): (r["m"], r["q"]) for r in drawn.collect()}
    edges = {key: [_bracket(p, i, *sampled.get(key, (0, None))) for i, p in enumerate(probs)] for key in sizes}
    while True:
        missed, targets, most = False, [], 0
        for key, r in source.counts(edges).items():
            low, high, part = [], [], []
            for i, p in enumerate(probs):
                h = (sizes[key] - 1) * p
                first = math.floor(h)
                last = min(first + 1, sizes[key] - 1)
                below, inside = r[f"b{i}"], r[f"i{i}"]
                if not (below <= first and last < below + inside):
                    edges[key][i] = (-math.inf, math.inf)
                    missed = True
                # position among the candidates
                low.append(first + r[f"c{i}"] - below)
                high.append(last + r[f"c{i}"] - below)
                part.append(h - first)
                most += inside
            targets.append((*key, low, high, part))
        if not missed:
            break
    longs, doubles = T.ArrayType(T.LongType()), T.ArrayType(T.DoubleType())
    schema = T.StructType([
        *source.key_schema, T.StructField("_low", longs), T.StructField("_high", longs), T.StructField("_share", doubles)
    ])
    counted = source.candidates(edges).groupBy(*keys, "value").agg(F.sum("n").alias("n"))
    ranked = running_totals(counted, [F.col("value")], {"n": "before"}, keys, one_task_rows, at_most=most)
    aimed = ranked.join(F.broadcast(source.spark.createDataFrame(targets, schema)), keys)
    at = lambda name: [F.col(name)[i] for i in range(len(probs))]
    return _pick(aimed, keys, at("_low"), at("_high"), at("_share"))


def quantiles(
    df: DataFrame, cells: dict[str, Column], probs: Sequence[float], sizes: dict[str, int] | None = None,
    one_task_rows: int = ONE_TASK_ROWS, one_state_rows: int = ONE_STATE_ROWS,
) -> dict[str, list[float] | None]:
    """Exact linear-interpolation quantiles per column (one small list per column).

    ``sizes`` holds the non-null rows per column when the caller has counted them.
    """
    if not cells:
        return {}
    if sizes is None:
        row = df.agg(*[F.count(c).alias(f"n{i}") for i, c in enumerate(cells.values())]).first()
        sizes = {name: row[f"n{i}"] for i, name in enumerate(cells)}
    out: dict[str, list[float] | None] = {name: None for name in cells}
    held = {k: c for k, c in cells.items() if sizes[k] > 0}
    hot = {k: c for k, c in held.items() if sizes[k] > one_state_rows}
    cold = {k: c for k, c in held.items() if k not in hot}
    parts = []
    if cold:
        parts.append(_small_keys(_unit_cells(df, cold), ["column"], probs))
    if hot:
        rows = {(k,): sizes[k] for k in hot}
        parts.append(_bracketed(_Columns(df, hot, rows), probs, one_task_rows))
    for p in parts:
        out.update({r["column"]: list(r["q"]) for r in p.collect()})
    return out


def _unit_cells(df: DataFrame, cells: dict[str, Column]) -> DataFrame:
    return long_form(df, cells).where(F.col("value").isNotNull()).withColumn("n", F.lit(1).cast("bigint"))


def numeric_quantiles(df: DataFrame, columns: Sequence[str], probs: Sequence[float], **kw):
    return quantiles(df, {c: number(df, c) for c in columns}, probs, **kw)


def grouped_quantiles(
    df: DataFrame, keys: Sequence[str], value: Column, probs: Sequence[float], one_task_rows: int = ONE_TASK_ROWS,
    one_state_rows: int = ONE_STATE_ROWS, weight: str | None = None, hot_keys: int = HOT_KEYS,
) -> DataFrame:
    """``(keys, q)``: exact quantiles of ``value`` within each group as an array.

    Small groups finish in one aggregate; up to ``hot_keys`` hot groups are
    bracketed. Where more groups are large, their distinct values are counted
    first, and if that does not help, everything is ordered by range.
    Rows with a null key or value are left out. ``weight`` names a column of row
    counts when the rows are counted already.
    """
    n = named(weight) if weight else F.lit(1).cast("bigint")
    cells = df.select(*[named(k) for k in keys], value.cast("double").alias("value"), n.alias("n")).dropna()
    key_schema = T.StructType([cells.schema[k] for k in keys])
    for counted in (False, True):
        facts = cells.groupBy(*keys).agg(
            F.sum("n").alias("n"),
            (F.approx_count_distinct("value") if counted else F.count(F.lit(1))).alias("states"),
        )
        large = facts.where(F.col("states") > one_state_rows).limit(hot_keys + 1).collect()
        if not large:
            return _small_keys(cells, keys, probs, counted)
        if len(large) <= hot_keys:
            sizes = {tuple(r[k] for k in keys): r["n"] for r in large}
            hot = df.sparkSession.createDataFrame(list(sizes), key_schema)
            cold = cells.join(F.broadcast(hot), list(keys), "left_anti")
            return _small_keys(cold, keys, probs, counted).unionByName(
                _bracketed(_Cells(cells, keys, sizes), probs, one_task_rows)
            )
    return _ordered_keys(cells, keys, probs, one_task_rows)


def grouped_median(df: DataFrame, keys: Sequence[str], value: Column, name: str = "median", **kw) -> DataFrame:
    return grouped_quantiles(df, keys, value, [0.5], **kw).select(*keys, F.col("q")[0].alias(name))


# --- ranks -------------------------------------------------------------------


def ranks_by_key(counted: DataFrame, keys: Sequence[str] = (), one_task_rows: int = ONE_TASK_ROWS, materialized: bool = False) -> DataFrame:
    """``(keys, value, n, avg_rank)`` from value counts: 1-based ranks, ties averaged."""
    ranked = running_totals(counted, [F.col("value")], {"n": "before"}, keys, one_task_rows, materialized)
    return ranked.select(*keys, "value", "n", (F.col("before") + (F.col("n") + 1) / 2).cast("double").alias("avg_rank"))


def average_ranks(df: DataFrame, value: Column, one_task_rows: int = ONE_TASK_ROWS) -> DataFrame:
    """``(value, n, avg_rank)`` of the distinct values of one column."""
    counted = (
        df.select(value.alias("value")).where(F.col("value").isNotNull())
        .groupBy("value").agg(F.count(F.lit(1)).alias("n"))
    )
    return ranks_by_key(counted, (), one_task_rows)
