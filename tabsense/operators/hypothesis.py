"""Hypothesis tests. Spark reduces the rows to sufficient statistics; only the
tail probability of the one resulting statistic is worked out on the driver."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from fractions import Fraction
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.columns import named, number
from ..functions.rounding import half_up
from ..functions.special import chi2_sf, f_sf, normal_sf, student_two_sided
from ..storage import lookup_side, materialize
from .ordering import ONE_TASK_ROWS, grouped_median, long_form, ranks_by_key

TEST_ROW = (
    "test_name string, statistic double, p_value double, is_significant boolean, groups bigint, observations bigint"
)
TWO_ROW = TEST_ROW + (
    ", group_a string, group_b string, size_a bigint, size_b bigint, mean_a double, mean_b double, "
    "median_a double, median_b double"
)
# Shapiro-Wilk looks at no more than this many values of a group; a choice of test judges larger groups by K-squared over all values
SHAPIRO_ROWS = 500
# possible U values that are counted out; with more of them the sum of uniforms agrees to six places
EXACT_VALUES = 100_000
NORMALITY_SWITCH = 5000


def observations(df: DataFrame, group: str, metric: str, groups: Sequence[str] | None = None) -> DataFrame:
    """``(g, x)`` of the readable values of the chosen groups."""
    g = named(group).cast("string")
    rows = df.select(g.alias("g"), number(df, metric).alias("x")).where(F.col("g").isNotNull() & F.col("x").isNotNull())
    return rows.where(F.col("g").isin(list(groups))) if groups is not None else rows


def _p(x: float) -> float | None:
    return None if x is None or math.isnan(x) else half_up(x, 6)


def _stat(x: float) -> float | None:
    return None if x is None or math.isnan(x) else half_up(x, 4)


def cohort_summary(df: DataFrame, group: str, metric: str, groups: Sequence[str] | None = None, **kw) -> DataFrame:
    """Size, mean and exact median per group, as a test of these groups sees them."""
    obs = observations(df, group, metric, groups)
    sizes = obs.groupBy("g").agg(F.count("x").alias("size"), F.round(F.avg("x"), 4).alias("mean"))
    med = grouped_median(obs, ["g"], F.col("x"), **kw)
    return sizes.join(med, "g").select(F.col("g").alias("group"), "size", "mean", F.round("median", 4).alias("median"))


def _counted(obs: DataFrame) -> DataFrame:
    """``(g, value, c)``, written once: sizes, medians and ranks are all read off it."""
    return materialize(obs.groupBy("g", F.col("x").alias("value")).agg(F.count(F.lit(1)).alias("c")))


def _pair_facts(obs: DataFrame, a: str, b: str, counted: DataFrame | None = None, **kw) -> dict[str, dict]:
    """Size, mean, variance and median of the two groups."""
    facts = obs.groupBy("g").agg(F.count("x").alias("n"), F.avg("x").alias("m"), F.var_samp("x").alias("v"))
    if counted is None:
        med = grouped_median(obs, ["g"], F.col("x"), "med", **kw)
    else:
        med = grouped_median(counted, ["g"], F.col("value"), "med", weight="c", **kw)
    got = {r["g"]: r.asDict() for r in facts.collect()}
    if any(got.get(k, {"n": 0})["n"] < 3 for k in (a, b)):
        raise ValueError("a two-sample test needs three numbers or more on each side")
    for r in med.collect():
        got[r["g"]]["med"] = r["med"]
    return got


def _exact_u_p(u: float, n1: int, n2: int) -> float:
    """Two-sided p of Mann-Whitney without ties, the smaller side having eight values or fewer.

    ``u`` is the larger statistic, so its mirror ``n1 * n2 - u`` ends the lower tail. The
    number of arrangements per U are the coefficients of the product of
    ``(1 - q^(n2 + i)) / (1 - q^i)`` over the values ``i`` of the smaller side.
    """
    few, many = sorted((n1, n2))
    last = n1 * n2 - math.ceil(u)
    if n1 * n2 <= EXACT_VALUES:
        ways = np.zeros(last + 1, dtype=object)
        ways[0] = 1
        for i in range(1, few + 1):
            if many + i <= last:
                ways[many + i :] = ways[many + i :] - ways[: last + 1 - many - i]
            for r in range(min(i, last + 1)):
                ways[r::i] = np.add.accumulate(ways[r::i])
        tail = float(Fraction(int(ways.sum()), math.comb(n1 + n2, few)))
    else:
        # U is spread like a sum of `few` uniforms with the same variance (Irwin and Hall)
        s = Fraction(few, 2) + Fraction((last + 0.5 - n1 * n2 / 2) / math.sqrt(many * (n1 + n2 + 1)))
        terms = [(-1) ** k * math.comb(few, k) * (s - k) ** few for k in range(few + 1) if s > k]
        tail = float(sum(terms, Fraction(0)) / math.factorial(few))
    return min(1.0, 2.0 * tail)


def two_sample_test(
    df: DataFrame, group: str, metric: str, a: str, b: str, test: str | None = None, alpha: float = 0.05,
    one_task_rows: int = ONE_TASK_ROWS,
) -> DataFrame:
    """``test``: student, welch, mann_whitney, or None to choose by normality and spread."""
    obs = observations(df, group, metric, [a, b])
    if test is None:
        test = recommend_test(df, group, metric, [a, b]).first()["test"]
    counted = _counted(obs) if test == "mann_whitney" else None
    got = _pair_facts(obs, a, b, counted, one_task_rows=one_task_rows)
    n1, n2 = got[a]["n"], got[b]["n"]
    m1, m2, v1, v2 = got[a]["m"], got[b]["m"], got[a]["v"], got[b]["v"]
    if test in ("student", "welch"):
        if test == "student":
            dof = n1 + n2 - 2.0
            se2 = ((n1 - 1) * v1 + (n2 - 1) * v2) / dof * (1 / n1 + 1 / n2)
        else:
            se2 = v1 / n1 + v2 / n2
            dof = se2**2 / ((v1 / n1) ** 2 / (n1 - 1) + (v2 / n2) ** 2 / (n2 - 1)) if se2 else math.nan
        stat = (m1 - m2) / math.sqrt(se2) if se2 else math.nan
        p = student_two_sided(stat, dof) if se2 else math.nan
    elif test == "mann_whitney":
        sums, ties = _rank_sums(counted, one_task_rows)
        stat = sums[a] - n1 * (n1 + 1) / 2
        u = max(stat, n1 * n2 - stat)
        n = n1 + n2
        exact = min(n1, n2) <= 8 and ties == 0
        p = _exact_u_p(u, n1, n2) if exact else _u_normal(u, n1, n2, n, ties)
    else:
        raise ValueError(f"no two-sample test is called {test!r}")
    row = (
        test, _stat(stat), _p(p), bool(p < alpha), 2, n1 + n2, a, b, n1, n2, half_up(m1, 4), half_up(m2, 4),
        half_up(got[a]["med"], 4), half_up(got[b]["med"], 4),
    )
    return df.sparkSession.createDataFrame([row], TWO_ROW)


def _u_normal(u: float, n1: int, n2: int, n: int, ties: float) -> float:
    s2 = n1 * n2 / 12 * ((n + 1) - ties / (n * (n - 1)))
    return min(1.0, 2 * normal_sf((u - n1 * n2 / 2 - 0.5) / math.sqrt(s2))) if s2 > 0 else math.nan


def _rank_facts(counted: DataFrame, one_task_rows: int) -> DataFrame:
    """``(g, n, r, t)`` per group: size, rank sum, and its part of the tie term sum(t^3 - t)."""
    pooled = counted.groupBy("value").agg(F.sum("c").alias("n"))
    ranks = ranks_by_key(pooled, (), one_task_rows)
    size = F.col("n").cast("double")
    return counted.join(ranks, "value").groupBy("g").agg(
        F.sum("c").alias("n"), F.sum(F.col("c") * F.col("avg_rank")).alias("r"),
        # a value tied n times adds n (n^2 - 1); its c rows of this group carry c/n of that
        F.sum(F.col("c") * (size * size - 1)).alias("t"),
    )


def _rank_sums(counted: DataFrame, one_task_rows: int) -> tuple[dict[str, float], float]:
    """Rank sum per group and the tie term, for the chosen few groups."""
    rows = _rank_facts(counted, one_task_rows).collect()
    return {r["g"]: r["r"] for r in rows}, float(sum(r["t"] for r in rows))


def multi_group_test(
    df: DataFrame, group: str, metric: str, groups: Sequence[str] | None = None, test: str | None = None,
    alpha: float = 0.05, one_task_rows: int = ONE_TASK_ROWS,
) -> DataFrame:
    """``test``: anova, kruskal, or None (ANOVA when every group looks normal). All groups by default."""
    obs = observations(df, group, metric, groups)
    facts = materialize(_group_moments(obs))
    small = facts.where("n < 3").orderBy("g").limit(1).collect()
    if small:
        raise ValueError(f"group {small[0]['g']!r} needs three numbers or more")
    if groups is not None:
        absent = sorted({str(g) for g in groups} - {str(r["g"]) for r in facts.where(F.col("g").cast("string").isin([str(g) for g in groups])).select("g").collect()})
        if absent:
            raise ValueError(f"no numbers in the named groups {absent}")
    if test is None:
        named_groups = list(groups) if groups is not None else None
        test = recommend_test(df, group, metric, named_groups, multi=True).first()["test"]
    if test == "anova":
        stat, p, k, n = _anova(facts)
    elif test == "kruskal":
        s = _rank_facts(_counted(obs), one_task_rows).agg(
            F.count(F.lit(1)).alias("k"), F.sum("n").alias("n"), F.sum(F.col("r") * F.col("r") / F.col("n")).alias("q"),
            F.sum("t").alias("t"),
        ).first()
        k, n = s["k"], s["n"]
        if k < 2:
            raise ValueError("a comparison needs two groups or more")
        spread = 1 - s["t"] / (float(n) ** 3 - n)
        stat = (12 / (n * (n + 1.0)) * s["q"] - 3 * (n + 1)) / spread if spread else math.nan
        p = chi2_sf(stat, k - 1) if spread else math.nan
    else:
        raise ValueError(f"no test of several groups is called {test!r}")
    return df.sparkSession.createDataFrame([(test, _stat(stat), _p(p), bool(p < alpha), k, n)], TEST_ROW)


def _group_moments(obs: DataFrame) -> DataFrame:
    return obs.groupBy("g").agg(F.count("x").alias("n"), F.avg("x").alias("m"), F.var_samp("x").alias("v"))


def _anova(facts: DataFrame) -> tuple[float, float, int, int]:
    """F from materialized per-group moments; aggregating them keeps many groups off the driver."""
    centre = facts.agg((F.sum(F.col("n") * F.col("m")) / F.sum("n")).alias("centre")).first()["centre"]
    s = facts.agg(
        F.count(F.lit(1)).alias("k"), F.sum("n").alias("n"),
        F.sum((F.col("n") - 1) * F.coalesce(F.col("v"), F.lit(0.0))).alias("within"),
        F.sum(F.col("n") * F.pow(F.col("m") - F.lit(centre), 2)).alias("between"),
    ).first()
    k, n, between = s["k"], s["n"], s["between"]
    if k < 2:
        raise ValueError("a comparison needs two groups or more")
    if not s["within"] or n <= k:
        return math.nan, math.nan, k, n
    stat = (between / (k - 1)) / (s["within"] / (n - k))
    return stat, f_sf(stat, k - 1, n - k), k, n


def _levene(obs: DataFrame, one_task_rows: int) -> tuple[float, float, int, int]:
    med = grouped_median(obs, ["g"], F.col("x"), "med", one_task_rows=one_task_rows)
    away = obs.join(lookup_side(med), "g").select("g", F.abs(F.col("x") - F.col("med")).alias("x"))
    return _anova(materialize(_group_moments(away)))


def levene(
    df: DataFrame, group: str, metric: str, groups: Sequence[str] | None = None, alpha: float = 0.05,
    one_task_rows: int = ONE_TASK_ROWS,
) -> DataFrame:
    """Equality of spread: ANOVA on the distance of each value from its group median."""
    stat, p, k, n = _levene(observations(df, group, metric, groups), one_task_rows)
    return df.sparkSession.createDataFrame([("levene", _stat(stat), _p(p), bool(p < alpha), k, n)], TEST_ROW)


# --- normality ---------------------------------------------------------------

# fixed values: Royston's coefficients (AS R94), constant first
SW_C1 = [0.0, 0.221157, -0.147981, -2.07119, 4.434685, -2.706056]
SW_C2 = [0.0, 0.042981, -0.293762, -1.752461, 5.682633, -3.582633]
SW_C3 = [0.544, -0.39978, 0.025054, -0.0006714]
SW_C4 = [1.3822, -0.77857, 0.062767, -0.0020322]
SW_C5 = [-1.5861, -0.31082, -0.083751, 0.0038915]
SW_C6 = [-0.4803, -0.082676, 0.0030302]
SW_G = [-2.273, 0.459]


def _poly(coef: Sequence[float], x: float) -> float:
    return sum(c * x**i for i, c in enumerate(coef))


def shapiro_wilk(values: Sequence[float]) -> tuple[float, float]:
    """W and its p-value for one bounded sample (Royston 1995)."""
    x = sorted(values)
    n = len(x)
    if n < 3 or x[0] == x[-1]:
        return 1.0, 1.0
    inv = NormalDist().inv_cdf
    m = [inv((i - 0.375) / (n + 0.25)) for i in range(1, n + 1)]
    s, u = sum(v * v for v in m), 1 / math.sqrt(n)
    if n == 3:
        a = [-math.sqrt(0.5), 0.0, math.sqrt(0.5)]
    else:
        last = _poly(SW_C1, u) + m[-1] / math.sqrt(s)
        if n <= 5:
            phi = (s - 2 * m[-1] ** 2) / (1 - 2 * last**2)
            a = [v / math.sqrt(phi) for v in m]
        else:
            second = _poly(SW_C2, u) + m[-2] / math.sqrt(s)
            phi = (s - 2 * m[-1] ** 2 - 2 * m[-2] ** 2) / (1 - 2 * last**2 - 2 * second**2)
            a = [v / math.sqrt(phi) for v in m]
            a[-2], a[1] = second, -second
        a[-1], a[0] = last, -last
    mean = math.fsum(x) / n
    w = math.fsum(ai * (xi - mean) for ai, xi in zip(a, x)) ** 2 / math.fsum((xi - mean) ** 2 for xi in x)
    w = min(w, 1.0)
    if w == 1.0:
        return w, 1.0
    if n == 3:
        p = 6 / math.pi * (math.asin(math.sqrt(w)) - math.asin(math.sqrt(0.75)))
        return w, max(0.0, p)
    if n <= 11:
        inner = _poly(SW_G, n) - math.log(1 - w)
        if inner <= 0:
            return w, 0.0
        z = (-math.log(inner) - _poly(SW_C3, n)) / math.exp(_poly(SW_C4, n))
    else:
        log_n = math.log(n)
        z = (math.log(1 - w) - _poly(SW_C5, log_n)) / math.exp(_poly(SW_C6, log_n))
    return w, normal_sf(z)


def shapiro_by_group(
    df: DataFrame, group: str, metrics: Sequence[str], key: Sequence[str], groups: Sequence[str] | None = None,
    max_rows: int = SHAPIRO_ROWS,
) -> DataFrame:
    """One Shapiro-Wilk row per (column, group), all in one job.

    The test reads a fixed number of values per group. They are drawn by a hash
    of the key: the same ones however the table is partitioned. The rank limit is
    applied before the shuffle, so a hot group sends no more than that.
    """
    g = named(group).cast("string")
    pick = F.xxhash64(*[named(k) for k in key])
    cells = long_form(
        df.withColumns({"_g": g, "_h": pick}), {m: number(df, m) for m in metrics}, ["_g", "_h"]
    ).where(F.col("value").isNotNull() & F.col("_g").isNotNull())
    if groups is not None:
        cells = cells.where(F.col("_g").isin(list(groups)))
    w = Window.partitionBy("column", "_g").orderBy("_h", "value")
    drawn = cells.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= max_rows)

    def test(pdf: pd.DataFrame) -> pd.DataFrame:
        w_stat, p = shapiro_wilk(pdf["value"].tolist())
        # under eight values normality is assumed
        normal = True if len(pdf) < 8 else p > 0.05
        return pd.DataFrame({
            "column": [pdf["column"].iloc[0]], "group": [pdf["_g"].iloc[0]], "tested": [len(pdf)],
            "statistic": [half_up(w_stat, 4)], "p_value": [half_up(p, 6)], "is_normal": [bool(normal)],
        })

    return drawn.groupBy("column", "_g").applyInPandas(
        test, "column string, group string, tested bigint, statistic double, p_value double, is_normal boolean"
    )


def normal_groups(obs: DataFrame, max_rows: int = SHAPIRO_ROWS) -> DataFrame:
    """``(g, n, is_normal)`` from every value of ``(g, x)``.

    Groups of up to ``max_rows`` values take Shapiro-Wilk, larger ones K-squared from
    their moments. Under eight values normality is assumed, likewise without spread.
    """
    shape = [F.count("x").alias("n"), F.skewness("x").alias("s"), F.kurtosis("x").alias("k")]
    facts = materialize(obs.groupBy("g").agg(*shape))
    few = obs.join(lookup_side(facts.where(F.col("n").between(8, max_rows)).select("g")), "g", "left_semi")

    def by_order(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"g": [pdf["g"].iloc[0]], "ok": [shapiro_wilk(pdf["x"].tolist())[1] > 0.05]})

    def by_moments(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            flat = pdf["s"].isna()
            ok = [bool(f) or dagostino_k2(n, s, k)[1] > 0.05 for n, s, k, f in zip(pdf["n"], pdf["s"], pdf["k"], flat)]
            yield pd.DataFrame({"g": pdf["g"], "ok": ok})

    checked = few.groupBy("g").applyInPandas(by_order, "g string, ok boolean").unionByName(
        facts.where((F.col("n") >= 8) & (F.col("n") > max_rows)).mapInPandas(by_moments, "g string, ok boolean")
    )
    return facts.join(checked, "g", "left").select("g", "n", F.coalesce("ok", F.lit(True)).alias("is_normal"))


def recommend_test(
    df: DataFrame, group: str, metric: str, groups: Sequence[str] | None, multi: bool = False, max_rows: int = SHAPIRO_ROWS,
) -> DataFrame:
    """``(test, all_normal, equal_variance)``; see ``normal_groups`` for ``max_rows``.

    Two samples: both normal and equal spread -> student; both normal -> welch;
    else mann_whitney. More groups: anova when all are normal, else kruskal.
    """
    obs = observations(df, group, metric, groups)
    seen = normal_groups(obs, max_rows).agg(
        F.min("n").alias("least"), F.count(F.lit(1)).alias("k"), F.bool_and("is_normal").alias("normal")
    ).first()
    least = 3 if multi else 5
    if (seen["least"] or 0) < least or seen["k"] < 2 or (groups is not None and seen["k"] < len(set(groups))):
        raise ValueError(f"every group needs {least} numbers or more to choose a test")
    normal = seen["normal"]
    if multi:
        equal, test = None, "anova" if normal else "kruskal"
    else:
        equal = _levene(obs, ONE_TASK_ROWS)[1] > 0.05  # false without a p-value: nothing speaks for equal variances
        test = "mann_whitney" if not normal else ("student" if equal else "welch")
    return df.sparkSession.createDataFrame(
        [(test, bool(normal), equal)], "test string, all_normal boolean, equal_variance boolean"
    )


def dagostino_k2(n: int, g1: float, excess: float) -> tuple[float, float]:
    """K-squared from the population moments (D'Agostino; Anscombe and Glynn)."""
    y = g1 * math.sqrt((n + 1) * (n + 3) / (6.0 * (n - 2)))
    beta = 3.0 * (n * n + 27 * n - 70) * (n + 1) * (n + 3) / ((n - 2.0) * (n + 5) * (n + 7) * (n + 9))
    w2 = math.sqrt(2 * (beta - 1)) - 1
    zs = math.asinh(y / math.sqrt(2 / (w2 - 1))) / math.sqrt(0.5 * math.log(w2))
    mean = 3.0 * (n - 1) / (n + 1)
    var = 24.0 * n * (n - 2) * (n - 3) / ((n + 1.0) ** 2 * (n + 3) * (n + 5))
    x = (excess + 3 - mean) / math.sqrt(var)
    b1 = 6.0 * (n * n - 5 * n + 2) / ((n + 7) * (n + 9)) * math.sqrt(6.0 * (n + 3) * (n + 5) / (n * (n - 2.0) * (n - 3)))
    a = 6 + 8 / b1 * (2 / b1 + math.sqrt(1 + 4 / b1**2))
    d = 1 + x * math.sqrt(2 / (a - 4))
    zk = (1 - 2 / (9 * a) - math.copysign(((1 - 2 / a) / abs(d)) ** (1 / 3), d)) / math.sqrt(2 / (9 * a))
    k2 = zs * zs + zk * zk
    return k2, math.exp(-k2 / 2)


def normality(df: DataFrame, columns: Sequence[str], switch: int = NORMALITY_SWITCH) -> DataFrame:
    """One row per column: Shapiro-Wilk below ``switch`` values, D'Agostino-Pearson from there on."""
    cells = {c: number(df, c) for c in columns}
    facts = {
        r["column"]: r for r in long_form(df, cells).groupBy("column").agg(
            F.count("value").alias("n"), F.skewness("value").alias("s"), F.kurtosis("value").alias("k")
        ).collect()
    }
    for c in columns:
        if facts[c]["n"] < 8:
            raise ValueError(f"{c!r} needs eight numbers or more for a normality test")
    few = [c for c in columns if facts[c]["n"] < switch]
    tested = {}
    if few:
        # fewer than `switch` values per group, as just counted
        small = long_form(df, {c: cells[c] for c in few}).where(F.col("value").isNotNull())

        def test(pdf: pd.DataFrame) -> pd.DataFrame:
            w, p = shapiro_wilk(pdf["value"].tolist())
            return pd.DataFrame({"column": [pdf["column"].iloc[0]], "w": [w], "p": [p]})

        tested = {r["column"]: (r["w"], r["p"]) for r in small.groupBy("column").applyInPandas(
            test, "column string, w double, p double").collect()}
    rows = []
    for c in columns:
        f = facts[c]
        constant = f["s"] is None or math.isnan(f["s"])
        if c in tested:
            stat, p = tested[c]
        else:
            stat, p = (math.nan, math.nan) if constant else dagostino_k2(f["n"], f["s"], f["k"])
        rows.append((
            c, f["n"], _stat(stat), _p(p), bool(p > 0.05),
            None if constant else half_up(f["s"], 2), None if constant else half_up(f["k"], 2),
        ))
    return df.sparkSession.createDataFrame(
        rows, "column string, n bigint, statistic double, p_value double, is_normal boolean, skewness double, kurtosis double"
    )
