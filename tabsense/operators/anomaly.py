"""Multivariate anomalies with an isolation forest (Liu, Ting and Zhou 2008).

Each tree needs only 256 rows, so the forest is small whatever the table size:
a hash of the row key draws the rows, one task grows one tree, and all rows are
scored where they lie. The same key and seed give the same forest under any
partitioning.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.columns import named, number, numeric_columns
from ..storage import spread_out, store
from .basics import prune_all_null
from .ordering import ONE_TASK_ROWS, numeric_quantiles, quantiles

TREES = 100
ROWS_PER_TREE = 256
EULER = 0.5772156649015329


def median_impute(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Missing cells take the exact column median; columns without any value are dropped."""
    kept = [c for c in columns if c in prune_all_null(df.select(*[named(c) for c in columns])).columns]
    med = numeric_quantiles(df, kept, [0.5])
    out = df.drop(*[c for c in columns if c not in kept])
    return out.withColumns({c: F.coalesce(number(df, c), F.lit(med[c][0])) for c in kept})


def robust_scale(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(x - median) / IQR per column; an IQR of zero scales by one."""
    q = numeric_quantiles(df, columns, [0.25, 0.5, 0.75])
    cols = {}
    for c in columns:
        if q[c] is None:
            continue
        iqr = q[c][2] - q[c][0]
        cols[c] = (number(df, c) - F.lit(q[c][1])) / F.lit(iqr if iqr != 0 else 1.0)
    return df.withColumns(cols)


def average_path(n) -> np.ndarray:
    """Mean path length of an unsuccessful search among n rows."""
    n = np.asarray(n, dtype="float64")
    safe = np.maximum(n, 3)
    long = 2 * (np.log(safe - 1) + EULER) - 2 * (safe - 1) / safe
    return np.where(n > 2, long, np.where(n == 2, 1.0, 0.0))


def _grow(x: np.ndarray, rng: np.random.Generator, limit: int) -> list[tuple]:
    """Nodes ``(feature, threshold, left, right, path)``; feature -1 marks a leaf."""
    nodes: list[list] = []
    todo = [(np.arange(len(x)), 0, None, None)]
    while todo:
        rows, depth, parent, side = todo.pop()
        at = len(nodes)
        if parent is not None:
            nodes[parent][side] = at
        lo, hi = x[rows].min(axis=0), x[rows].max(axis=0)
        usable = np.flatnonzero(hi > lo)
        if depth >= limit or len(rows) < 2 or len(usable) == 0:
            nodes.append([-1, 0.0, -1, -1, depth + float(average_path(len(rows)))])
            continue
        f = int(rng.choice(usable))
        t = float(rng.uniform(lo[f], hi[f]))
        nodes.append([f, t, -1, -1, 0.0])
        below = x[rows, f] <= t
        todo += [(rows[~below], depth + 1, at, 3), (rows[below], depth + 1, at, 2)]
    return [tuple(n) for n in nodes]


# rows that walk all trees together: the positions stay in the cache
ROWS_PER_WALK = 1024
NODES = "tree int, node int, feature int, threshold double, lo int, hi int, path double"


def grow_forest(
    df: DataFrame, features: Sequence[str], key: Sequence[str], rows: int, trees: int = TREES,
    rows_per_tree: int = ROWS_PER_TREE, seed: int = 42,
) -> DataFrame:
    """The node table of the forest: at most ``trees * 2 * rows_per_tree`` rows."""
    psi = min(rows_per_tree, rows)
    span = 1 << 30
    pool_rows = trees * rows_per_tree
    h = F.pmod(F.xxhash64(*[named(k) for k in key], F.lit(seed)), F.lit(span))
    # one hash per row draws the pool; the trees then draw from the pool only
    pool = df.select(*[named(k).alias(f"_k{i}") for i, k in enumerate(key)], h.alias("_h"), *[named(f) for f in features])
    if rows > 2 * pool_rows:
        pool = pool.where(F.col("_h") < F.lit(int(span * (2.0 * pool_rows / rows))))
        size = 2 * pool_rows
    else:
        size = rows
    th = F.pmod(F.xxhash64(F.col("_h"), *[f"_k{i}" for i in range(len(key))], F.lit(seed), F.col("_tree")), F.lit(span))
    drawn = pool.withColumn("_tree", F.explode(F.sequence(F.lit(0), F.lit(trees - 1)))).withColumn("_t", th)
    share = 4.0 * psi / size
    if share < 1.0:
        drawn = drawn.where(F.col("_t") < F.lit(int(span * share)))
    ties = [f"_k{i}" for i in range(len(key))]
    w = Window.partitionBy("_tree").orderBy("_t", *ties)
    drawn = drawn.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= psi)
    limit = math.ceil(math.log2(max(psi, 2)))
    names = list(features)

    def grow(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_r")
        tree = int(pdf["_tree"].iloc[0])
        nodes = _grow(pdf[names].to_numpy("float64"), np.random.default_rng([seed, tree]), limit)
        return pd.DataFrame(
            [(tree, i, *n) for i, n in enumerate(nodes)],
            columns=["tree", "node", "feature", "threshold", "lo", "hi", "path"],
        )

    return drawn.groupBy("_tree").applyInPandas(grow, NODES)


def forest_score(spark: SparkSession, nodes: DataFrame, psi: int, features: Sequence[Column]) -> Column:
    """The score of a row as a column; lower means more anomalous. Only the features travel to Python."""
    table = nodes.toPandas().sort_values(["tree", "node"])  # bounded by trees * 2 * rows per tree
    # one table for all trees: a leaf leads back to itself, so every row takes the same number of steps
    roots = np.flatnonzero(table["node"].to_numpy() == 0)
    base = np.repeat(roots, np.diff(np.append(roots, len(table))))
    inner = table["feature"].to_numpy() >= 0
    at = np.arange(len(table))
    child = np.column_stack([np.where(inner, base + table[c].to_numpy(), at) for c in ("lo", "hi")]).ravel()
    forest = (roots, np.where(inner, table["feature"], 0), table["threshold"].to_numpy(), child, table["path"].to_numpy())
    shared = spark.sparkContext.broadcast(forest)
    norm, steps = float(average_path(psi)), math.ceil(math.log2(max(psi, 2)))

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.Series]:
        roots, feature, threshold, child, path = shared.value
        for pdf in batches:
            x = pdf.to_numpy("float64")
            mean = np.empty(len(x))
            for start in range(0, len(x), ROWS_PER_WALK):
                rows = x[start : start + ROWS_PER_WALK]
                at = np.tile(roots, (len(rows), 1))
                for _ in range(steps):
                    right = ~(np.take_along_axis(rows, feature[at], 1) <= threshold[at])
                    at = child[2 * at + right]
                mean[start : start + ROWS_PER_WALK] = path[at].sum(axis=1) / len(roots)
            yield pd.Series(-np.power(2.0, -mean / norm) if norm > 0 else np.full(len(x), -1.0))

    return F.pandas_udf(score, "double")(F.struct(*[f.alias(f"f{i}") for i, f in enumerate(features)]))


def isolation_forest(
    df: DataFrame, key: Sequence[str], features: Sequence[str] | None = None, contamination: float = 0.05,
    seed: int = 42, trees: int = TREES, one_task_rows: int = ONE_TASK_ROWS,
) -> DataFrame:
    """The table with ``score``, ``severity`` (0 normal to 1 anomalous), ``is_anomaly`` and ``status``.

    The share ``contamination`` with the lowest scores is flagged.
    """
    chosen = list(features or [c for c in numeric_columns(df) if c not in key])
    counts = df.agg(F.count(F.lit(1)).alias("_n"), *[F.count(number(df, c)).alias(f"c{i}") for i, c in enumerate(chosen)]).first()
    used = [c for i, c in enumerate(chosen) if counts[f"c{i}"] > 0]
    if len(used) < 2:
        raise ValueError("an isolation forest needs two numeric columns or more")
    if counts["_n"] < 10:
        raise ValueError("an isolation forest needs ten rows or more")
    holes = [c for c in used if counts[f"c{chosen.index(c)}"] < counts["_n"]]
    med = numeric_quantiles(df, holes, [0.5], one_task_rows=one_task_rows)
    # splits do not change under per-column scaling, so the features are used as they are
    cells = [F.coalesce(number(df, c), F.lit(med[c][0])) if c in holes else number(df, c) for c in used]
    ks, fs = [f"_key{i}" for i in range(len(key))], [f"_f{i}" for i in range(len(used))]
    ready = df.select(*[named(k).alias(n) for k, n in zip(key, ks)], *[c.alias(n) for c, n in zip(cells, fs)])
    psi = min(ROWS_PER_TREE, counts["_n"])
    nodes = grow_forest(ready, fs, ks, counts["_n"], trees, ROWS_PER_TREE, seed)
    # every row is scored once and written with its score, under plain names; the bounds below and the result read it back
    score = forest_score(df.sparkSession, nodes, psi, cells)
    plain = {c: f"_c{i}" for i, (c, kind) in enumerate(df.dtypes) if kind != "void" and c != "score"}
    rows = spread_out(df, counts["_n"])
    scored = store(rows.select(*[named(c).alias(n) for c, n in plain.items()], score.alias("score")), "scores")
    s = scored.agg(F.min("score").alias("lo"), F.max("score").alias("hi")).first()
    cut = quantiles(scored, {"score": F.col("score")}, [contamination], {"score": counts["_n"]}, one_task_rows)["score"][0]
    flat = s["hi"] <= s["lo"]
    severity = F.lit(0.0) if flat else F.round(1 - (F.col("score") - F.lit(s["lo"])) / F.lit(s["hi"] - s["lo"]), 4)
    whole = scored.select(*[F.col("score") if c == "score" else F.col(plain[c]).alias(c) if c in plain else F.lit(None).alias(c) for c in df.columns], *([] if "score" in df.columns else ["score"]))
    return whole.withColumns({"severity": severity, "is_anomaly": F.col("score") < F.lit(cut)}).withColumn(
        "status", F.when(F.col("is_anomaly"), "Anomaly").otherwise("Inlier")
    )


def anomaly_summary(marked: DataFrame, contamination: float = 0.05) -> DataFrame:
    hits = F.count_if(F.col("is_anomaly"))
    return marked.agg(F.count(F.lit(1)).alias("total_records"), hits.alias("outlier_count")).select(
        "total_records", "outlier_count",
        F.round(F.try_divide("outlier_count", "total_records") * 100, 2).alias("outlier_pct"),
        F.lit(contamination).alias("contamination"),
    )


def anomaly_topk(marked: DataFrame, key: Sequence[str], n: int = 20) -> DataFrame:
    """The ``n`` most anomalous flagged rows with all their columns."""
    return marked.where("is_anomaly").orderBy(F.desc("severity"), *[F.asc(k) for k in key]).limit(n)
