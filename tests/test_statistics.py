"""Tests, normality and correlation against published values and closed forms."""

import itertools
import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tabsense.functions import special
from tabsense.operators import correlation, hypothesis as h


def frame(spark, groups):
    rows = [(i, g, float(v)) for i, (g, v) in enumerate((g, v) for g, vs in groups.items() for v in vs)]
    return spark.createDataFrame(rows, "id bigint, g string, x double")


def test_tail_probabilities():
    # table values
    assert special.student_two_sided(2.228, 10) == pytest.approx(0.05, abs=1e-4)
    assert special.f_sf(4.10, 2, 10) == pytest.approx(0.05, abs=2e-4)
    assert special.chi2_sf(3.841, 1) == pytest.approx(0.05, abs=1e-4)
    assert special.normal_sf(1.959964) == pytest.approx(0.025, abs=1e-7)
    # closed forms
    for x in (0.1, 2.0, 30.0):
        assert special.chi2_sf(x, 2) == pytest.approx(math.exp(-x / 2))
        assert special.chi2_sf(x, 4) == pytest.approx(math.exp(-x / 2) * (1 + x / 2))
        assert special.student_two_sided(x, 1) == pytest.approx(1 - 2 / math.pi * math.atan(x))
        assert special.f_sf(x, 2, 2) == pytest.approx(1 / (1 + x))


def test_student_and_welch(spark):
    df = frame(spark, {"a": [1, 2, 3, 4, 5], "b": [2, 4, 6, 8, 10]})
    s = h.two_sample_test(df, "g", "x", "a", "b", "student").first()
    assert s["statistic"] == pytest.approx(-1.8974, abs=1e-4) and s["p_value"] == pytest.approx(0.0943, abs=1e-3)
    w = h.two_sample_test(df, "g", "x", "a", "b", "welch").first()
    assert w["statistic"] == pytest.approx(-1.8974, abs=1e-4) and w["p_value"] > s["p_value"]
    assert (w["mean_a"], w["median_b"], w["size_a"]) == (3.0, 6.0, 5)


def brute_u(a, b):
    u = sum((x > y) + 0.5 * (x == y) for x in a for y in b)
    pooled, n1 = a + b, len(a)
    far = max(u, n1 * len(b) - u)
    hits = total = 0
    for pick in itertools.combinations(range(len(pooled)), n1):
        rest = [pooled[i] for i in range(len(pooled)) if i not in pick]
        hits += sum(pooled[i] > y for i in pick for y in rest) >= far
        total += 1
    return u, min(1.0, 2 * hits / total)


def test_mann_whitney_exact(spark):
    a, b = [1.1, 2.2, 3.3, 9.9], [4.4, 5.5, 6.6, 7.7, 8.8]
    u, p = brute_u(a, b)
    r = h.two_sample_test(frame(spark, {"a": a, "b": b}), "g", "x", "a", "b", "mann_whitney").first()
    assert r["statistic"] == u and r["p_value"] == pytest.approx(p, abs=1e-6)


@pytest.mark.parametrize("task", [10**6, 4])
def test_mann_whitney_with_ties(spark, task):
    rng = np.random.default_rng(1)
    a, b = rng.integers(0, 20, 60).tolist(), (rng.integers(0, 20, 70) + 4).tolist()
    ranks = pd.Series(a + b).rank()
    u = ranks[:60].sum() - 60 * 61 / 2
    df = frame(spark, {"a": a, "b": b}).repartition(4)
    r = h.two_sample_test(df, "g", "x", "a", "b", "mann_whitney", one_task_rows=task).first()
    assert r["statistic"] == u and r["is_significant"]


def test_anova_levene_kruskal(spark):
    rng = np.random.default_rng(2)
    groups = {"A": rng.normal(100, 15, 60), "B": rng.normal(115, 15, 60), "C": rng.normal(101, 15, 60)}
    df = frame(spark, groups)
    means = {k: v.mean() for k, v in groups.items()}
    grand = np.concatenate(list(groups.values())).mean()
    ssb = sum(60 * (m - grand) ** 2 for m in means.values())
    ssw = sum(((v - v.mean()) ** 2).sum() for v in groups.values())
    r = h.multi_group_test(df, "g", "x", test="anova").first()
    assert r["statistic"] == pytest.approx(ssb / 2 / (ssw / 177), abs=1e-3) and r["is_significant"] and r["groups"] == 3
    ranks = pd.Series(np.concatenate(list(groups.values()))).rank().to_numpy().reshape(3, 60)
    hh = 12 / (180 * 181) * (ranks.sum(axis=1) ** 2 / 60).sum() - 3 * 181
    for task in (10**6, 7):
        k = h.multi_group_test(df, "g", "x", test="kruskal", one_task_rows=task).first()
        assert k["statistic"] == pytest.approx(hh, abs=1e-3) and k["p_value"] == pytest.approx(math.exp(-hh / 2), abs=1e-6)
    assert not h.levene(df, "g", "x").first()["is_significant"]
    assert h.two_sample_test(df, "g", "x", "A", "B").first()["is_significant"]
    assert not h.two_sample_test(df, "g", "x", "A", "C").first()["is_significant"]


def test_choice_of_test(spark):
    z = [h.NormalDist().inv_cdf((i + 0.5) / 100) for i in range(100)]
    df = frame(spark, {"a": z, "b": [v + 1 for v in z], "wide": [v * 9 for v in z], "exp": [math.exp(2 * v) for v in z]})
    pick = lambda a, b: h.recommend_test(df, "g", "x", [a, b]).first()["test"]
    assert pick("a", "b") == "student" and pick("a", "wide") == "welch" and pick("a", "exp") == "mann_whitney"
    assert h.recommend_test(df, "g", "x", ["a", "b", "wide"], multi=True).first()["test"] == "anova"
    assert h.recommend_test(df, "g", "x", None, multi=True).first()["test"] == "kruskal"


def test_too_few_values(spark):
    df = frame(spark, {"a": [1, 2], "b": [1, 2, 3, 4]})
    with pytest.raises(ValueError):
        h.two_sample_test(df, "g", "x", "a", "b", "student")
    with pytest.raises(ValueError):
        h.multi_group_test(df, "g", "x", test="anova")
    with pytest.raises(ValueError):
        h.multi_group_test(df, "g", "x", ["b"], test="anova")
    with pytest.raises(ValueError):
        h.recommend_test(df, "g", "x", ["a", "b"])
    with pytest.raises(ValueError):
        h.normality(df, ["x"])


def test_shapiro_published_value():
    w, p = h.shapiro_wilk([148, 154, 158, 160, 161, 162, 166, 170, 182, 195, 236])
    assert w == pytest.approx(0.78881, abs=1e-5) and p == pytest.approx(0.006704, abs=1e-5)


def test_normality(spark):
    z = [h.NormalDist().inv_cdf((i + 0.5) / 200) for i in range(200)]
    df = spark.createDataFrame([(v, -math.log((i + 0.5) / 200)) for i, v in enumerate(z)], "n double, e double")
    for switch in (5000, 100):
        got = {r["column"]: r["is_normal"] for r in h.normality(df, ["n", "e"], switch).collect()}
        assert got == {"n": True, "e": False}


def test_shapiro_sample_does_not_depend_on_partitions(spark):
    df = spark.range(4000).select("id", (F.col("id") % 3).alias("g"), F.sin("id").alias("x"))
    one = h.shapiro_by_group(df.repartition(7), "g", ["x"], ["id"]).orderBy("group").collect()
    two = h.shapiro_by_group(df.coalesce(1), "g", ["x"], ["id"]).orderBy("group").collect()
    assert one == two and {r["tested"] for r in one} == {500}


def test_correlation(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=50)
    pdf = pd.DataFrame({"x": x, "y": 2 * x + rng.normal(scale=0.2, size=50), "z": rng.random(50), "k": 1.0})
    pdf.loc[3, "z"] = np.nan
    df = spark.createDataFrame(pdf)
    pairs = {(r["var1"], r["var2"]): r for r in correlation.correlation_pairs(df).collect()}
    assert pairs["x", "y"]["coefficient"] > 0.9 and pairs["x", "y"]["symbol"] == "***" and pairs["x", "y"]["strength"] == "Strong"
    assert pairs["x", "z"]["n"] == 49 and pairs["x", "z"]["coefficient"] == pytest.approx(pdf[["x", "z"]].corr().iloc[0, 1], abs=1e-4)
    assert pairs["x", "k"]["coefficient"] is None and pairs["x", "k"]["symbol"] == "ns"
    m = {(r["var1"], r["var2"]): r["coefficient"] for r in correlation.corr_matrix(df, ["x", "y"]).collect()}
    assert m["x", "x"] == 1.0 and m["x", "y"] == m["y", "x"]


@pytest.mark.parametrize("lookup", [10**6, 0])
def test_spearman(spark, lookup):
    rng = np.random.default_rng(4)
    pdf = pd.DataFrame({"a": rng.integers(0, 9, 80).astype(float), "b": rng.normal(size=80), "c": rng.normal(size=80)})
    pdf["b"] += pdf["a"] / 3
    pdf.loc[::9, "c"] = np.nan
    got = {(r["var1"], r["var2"]): r for r in correlation.spearman(spark.createDataFrame(pdf), lookup_rows=lookup).collect()}
    for a, b in itertools.combinations("abc", 2):
        both = pdf[[a, b]].dropna()
        assert got[a, b]["coefficient"] == pytest.approx(both.rank().corr().iloc[0, 1], abs=1e-4)
        assert got[a, b]["n"] == len(both)


def test_spearman_sorts_only_columns_of_many_values(spark, monkeypatch):
    rng = np.random.default_rng(5)
    pdf = pd.DataFrame({"few": rng.integers(0, 9, 400).astype(float), "many": rng.normal(size=400), "two": rng.integers(0, 2, 400).astype(float)})
    pdf["many"] += pdf["few"]
    sorted_ = []
    real = correlation.rank_table
    monkeypatch.setattr(correlation, "rank_table", lambda df, cells, *rest: sorted_.append(list(cells)) or real(df, cells, *rest))
    got = {(r["var1"], r["var2"]): r for r in correlation.spearman(spark.createDataFrame(pdf), lookup_rows=50).collect()}
    assert sorted_ == [["many"]]
    for a, b in itertools.combinations(pdf, 2):
        assert got[a, b]["coefficient"] == pytest.approx(pdf[[a, b]].rank().corr().iloc[0, 1], abs=1e-4) and got[a, b]["n"] == 400


def test_few_rows_have_no_correlation(spark):
    df = spark.createDataFrame([(1.0, 2.0), (2.0, 4.0), (3.0, 6.0)], "a double, b double")
    r = correlation.correlation_pairs(df).first()
    assert (r["coefficient"], r["p_value"]) == (0.0, 1.0)


def test_exact_u_counts_arrangements():
    for n1, n2 in ((1, 5), (3, 4), (5, 2), (4, 4)):
        spread = [sum(places) - n1 * (n1 - 1) // 2 for places in itertools.combinations(range(n1 + n2), n1)]
        for u in range((n1 * n2 + 1) // 2, n1 * n2 + 1):
            expected = min(1.0, 2 * sum(x >= u for x in spread) / len(spread))
            assert h._exact_u_p(u, n1, n2) == pytest.approx(expected, abs=1e-12)


def test_exact_u_does_not_jump_with_size(monkeypatch):
    for n1, n2, share in ((8, 12_000, 0.8), (12_400, 8, 0.55), (3, 30_000, 0.99), (1, 90_000, 0.97)):
        u = int(n1 * n2 * share)
        counted = h._exact_u_p(u, n1, n2)
        monkeypatch.setattr(h, "EXACT_VALUES", 0)
        assert h._exact_u_p(u, n1, n2) == pytest.approx(counted, abs=4e-7)
        monkeypatch.undo()


def test_large_groups_are_judged_by_all_values(spark):
    draw = random.Random(5)
    df = frame(spark, {"few": [draw.gauss(0, 1) for _ in range(40)], "many": [draw.gauss(0, 1) for _ in range(900)], "flat": [2.0] * 600,
                       "tail": [draw.expovariate(1) for _ in range(900)], "tiny": [0.0, 0.0, 9.0]})
    got = {r["g"]: r["is_normal"] for r in h.normal_groups(h.observations(df, "g", "x")).collect()}
    assert got == {"few": True, "many": True, "flat": True, "tail": False, "tiny": True}


def test_many_pairs_agree_with_single_ones(spark, monkeypatch):
    draw = np.random.default_rng(3)
    data = pd.DataFrame(draw.normal(size=(300, 5)) + [0, 1e6, -5, 2, 9], columns=list("abcde"))
    data["e"], data["f"] = 0.1, data["a"] * 2 + data["b"] * 0.1
    data.loc[::3, "c"] = None
    data.loc[data["c"].notna(), "d"] = 0.7
    data["empty_with_a"] = data["a"].where(data["a"] > 9)
    data.loc[0, "empty_with_a"] = 1.0
    df = spark.createDataFrame(data.astype(object).where(data.notna(), None), ", ".join(f"{c} double" for c in data.columns)).repartition(3)
    rows = {(r["var1"], r["var2"]): r.asDict() for r in correlation.correlation_pairs(df).collect()}
    assert len(rows) == 21 and rows["c", "d"]["coefficient"] is None and rows["a", "e"]["coefficient"] is None
    monkeypatch.setattr(correlation, "PAIRS_PER_AGGREGATE", 100)
    assert rows == {(r["var1"], r["var2"]): r.asDict() for r in correlation.correlation_pairs(df).collect()}
