"""Hypothesis tests, correlations, insights, report tables."""

from __future__ import annotations

import itertools

from pyspark.sql import functions as F

from ..operators import correlation, hypothesis, insights, ordering, ranks, report
from ..storage import load
from .basic_queries import LINE_KEY, PRICES
from .derived import MESSY_KINDS, MESSY_SQL, PLANTED_SQL, facts_sql, messy_orders, planted_events
from .registry import query, union_all


def _lines(spark, folder):
    return load(spark, folder, "lineitem")


SAMPLES = """g AS (SELECT l_returnflag AS g, count(*) AS n, avg(l_extendedprice) AS m, var_samp(l_extendedprice) AS v,
  round(quantile_cont(l_extendedprice, 0.5), 4) AS med FROM lineitem WHERE l_returnflag IN ('A', 'R') GROUP BY 1),
p AS (SELECT a.n AS n1, b.n AS n2, a.m AS m1, b.m AS m2, a.v AS v1, b.v AS v2, a.med AS d1, b.med AS d2
  FROM g a, g b WHERE a.g = 'A' AND b.g = 'R')"""
PAIR_COLUMNS = """CAST(2 AS BIGINT) AS groups, n1 + n2 AS observations, 'A' AS group_a, 'R' AS group_b, n1 AS size_a, n2 AS size_b,
  round(m1, 4) AS mean_a, round(m2, 4) AS mean_b, d1 AS median_a, d2 AS median_b"""


# Tail probabilities as midpoint sums of the density, a million steps of 2e-5 from the statistic on.


def tail_sql(log_density: str) -> str:
    """The area under a density given as its logarithm at ``y``, the distance from the statistic."""
    return f"(SELECT sum(exp({log_density})) * 2e-5 FROM (SELECT (i + 0.5) * 2e-5 AS y FROM range(1000000) AS steps(i)))"


def t_p_sql(t: str, dof: str) -> str:
    v = f"({dof})"
    return "2 * " + tail_sql(f"lgamma(({v} + 1) / 2) - lgamma({v} / 2) - ln({v} * pi()) / 2 - ({v} + 1) / 2 * ln(1 + pow(abs({t}) + y, 2) / {v})")


def normal_p_sql(z: str) -> str:
    return "least(1.0, 2 * " + tail_sql(f"-pow({z} + y, 2) / 2 - ln(2 * pi()) / 2") + ")"


def f_p_sql(f: str, d1: str, d2: str) -> str:
    """By the beta density over the log odds ``w`` of d2 / (d2 + d1 f), downwards."""
    a, b, w = f"({d2} / 2)", f"({d1} / 2)", f"(ln({d2} / ({d1} * {f})) - y)"
    return tail_sql(f"lgamma({a} + {b}) - lgamma({a}) - lgamma({b}) - {a} * ln(1 + exp(-{w})) - {b} * ln(1 + exp({w}))")


def pair_test_sql(name: str, facts: str, p: str, source: str = "p") -> str:
    """``facts``: select items over n1 .. v2 that give at least ``stat``; ``p``: its p-value from them."""
    return f"""WITH {SAMPLES} SELECT '{name}' AS test_name, round(stat, 4) AS statistic, round(pv, 6) AS p_value, pv < 0.05 AS is_significant, {PAIR_COLUMNS}
FROM (SELECT *, {p} AS pv FROM (SELECT *, {facts} FROM {source}))"""


@query("ttest_student", sql=pair_test_sql(
    "student", "(m1 - m2) / sqrt(((n1 - 1) * v1 + (n2 - 1) * v2) / (n1 + n2 - 2) * (1 / n1 + 1 / n2)) AS stat", t_p_sql("stat", "n1 + n2 - 2")))
def ttest_student(spark, folder):
    return hypothesis.two_sample_test(_lines(spark, folder), "l_returnflag", "l_extendedprice", "A", "R", "student")


@query("ttest_welch", sql=pair_test_sql(
    "welch", """(m1 - m2) / sqrt(v1 / n1 + v2 / n2) AS stat,
  pow(v1 / n1 + v2 / n2, 2) / (pow(v1 / n1, 2) / (n1 - 1) + pow(v2 / n2, 2) / (n2 - 1)) AS dof""", t_p_sql("stat", "dof")))
def ttest_welch(spark, folder):
    return hypothesis.two_sample_test(_lines(spark, folder), "l_returnflag", "l_extendedprice", "A", "R", "welch")


def ranks_sql(rows: str) -> str:
    """Average ranks of ``x`` over a relation with columns g and x."""
    return f"""(SELECT g, x, rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2 AS r,
  count(*) OVER (PARTITION BY x) AS t FROM ({rows}))"""


PAIR_ROWS = "SELECT l_returnflag AS g, l_extendedprice AS x FROM lineitem WHERE l_returnflag IN ('A', 'R')"


@query("mann_whitney", sql=pair_test_sql(
    "mann_whitney", """greatest(stat, CAST(n1 AS DOUBLE) * n2 - stat) AS u,
  CAST(n1 AS DOUBLE) * n2 / 12 * (n1 + n2 + 1 - ties / (CAST(n1 + n2 AS DOUBLE) * (n1 + n2 - 1))) AS var,
  (u - CAST(n1 AS DOUBLE) * n2 / 2 - 0.5) / sqrt(var) AS z""", normal_p_sql("z"),
    f"""(SELECT *, ra - n1 * (n1 + 1) / 2 AS stat FROM p, (SELECT sum(r) FILTER (g = 'A') AS ra, sum(CAST(t AS DOUBLE) * t - 1) AS ties
  FROM {ranks_sql(PAIR_ROWS)}))"""))
def mann_whitney(spark, folder):
    return hypothesis.two_sample_test(_lines(spark, folder), "l_returnflag", "l_extendedprice", "A", "R", "mann_whitney")


def anova_sql(name: str, rows: str) -> str:
    return f"""SELECT '{name}' AS test_name, round(f, 4) AS statistic, round(p, 6) AS p_value, p < 0.05 AS is_significant, k AS groups,
  CAST(n AS BIGINT) AS observations FROM (SELECT *, {f_p_sql('f', '(k - 1)', '(n - k)')} AS p
FROM (SELECT k, n, (ssb / (k - 1)) / (ssw / (n - k)) AS f
FROM (SELECT count(*) AS k, CAST(sum(c) AS DOUBLE) AS n, sum((c - 1) * v) AS ssw, sum(c * pow(m - gm, 2)) AS ssb
  FROM (SELECT g, count(*) AS c, avg(x) AS m, var_samp(x) AS v FROM ({rows}) GROUP BY g), (SELECT avg(x) AS gm FROM ({rows})))))"""


def cohorts_sql(table: str, g: str, x: str) -> str:
    return f"""SELECT CAST({g} AS VARCHAR) AS "group", count({x}) AS size, round(avg({x}), 4) AS mean,
  round(quantile_cont({x}, 0.5), 4) AS median FROM {table} WHERE {g} IS NOT NULL AND {x} IS NOT NULL GROUP BY 1"""


@query("anova_groups", sql=cohorts_sql("orders", "o_orderpriority", "o_totalprice"))
def anova_groups(spark, folder):
    return hypothesis.cohort_summary(load(spark, folder, "orders"), "o_orderpriority", "o_totalprice")


@query("kruskal_groups", sql=cohorts_sql("(SELECT * FROM lineitem WHERE l_returnflag IN ('A', 'N'))", "l_returnflag", "l_extendedprice"))
def kruskal_groups(spark, folder):
    return hypothesis.cohort_summary(_lines(spark, folder), "l_returnflag", "l_extendedprice", ["A", "N"])


@query("anova", sql=anova_sql("anova", "SELECT o_orderpriority AS g, o_totalprice AS x FROM orders"))
def anova(spark, folder):
    return hypothesis.multi_group_test(load(spark, folder, "orders"), "o_orderpriority", "o_totalprice", test="anova")


@query("anova_many_groups", sql=anova_sql("anova", "SELECT CAST(user_id AS VARCHAR) AS g, value AS x FROM events"))
def anova_many_groups(spark, folder):
    return hypothesis.multi_group_test(load(spark, folder, "events"), "user_id", "value", test="anova")


def kruskal_sql(rows: str, p_value: str) -> str:
    return f"""WITH r AS {ranks_sql(rows)},
h AS (SELECT k, n, (12 / (n * (n + 1)) * q - 3 * (n + 1)) / (1 - ties / (pow(n, 3) - n)) AS h
  FROM (SELECT count(*) AS k, CAST(sum(c) AS DOUBLE) AS n, sum(s * s / c) AS q FROM (SELECT g, count(*) AS c, sum(r) AS s FROM r GROUP BY g)),
    (SELECT sum(CAST(t AS DOUBLE) * t - 1) AS ties FROM r))
SELECT 'kruskal' AS test_name, round(h, 4) AS statistic, round({p_value}, 6) AS p_value, {p_value} < 0.05 AS is_significant,
  k AS groups, CAST(n AS BIGINT) AS observations FROM h"""


@query("kruskal", sql=kruskal_sql("SELECT l_returnflag AS g, l_extendedprice AS x FROM lineitem", "exp(-h / 2)"))
def kruskal(spark, folder):
    return hypothesis.multi_group_test(_lines(spark, folder), "l_returnflag", "l_extendedprice", test="kruskal")


@query("kruskal_priorities", sql=kruskal_sql("SELECT o_orderpriority AS g, o_totalprice AS x FROM orders", "exp(-h / 2) * (1 + h / 2)"))
def kruskal_priorities(spark, folder):
    return hypothesis.multi_group_test(load(spark, folder, "orders"), "o_orderpriority", "o_totalprice", test="kruskal")


@query("levene", sql=anova_sql("levene", """
SELECT l_returnflag AS g, abs(l_extendedprice - med) AS x FROM lineitem JOIN (SELECT l_returnflag AS f,
  quantile_cont(l_extendedprice, 0.5) AS med FROM lineitem GROUP BY 1) ON f = l_returnflag"""))
def levene(spark, folder):
    return hypothesis.levene(_lines(spark, folder), "l_returnflag", "l_extendedprice")


@query("avg_rank", sql=f"SELECT x AS value, any_value(t) AS n, any_value(r) AS avg_rank FROM {ranks_sql('SELECT 1 AS g, l_quantity AS x FROM lineitem')} GROUP BY x")
def avg_rank(spark, folder):
    return ordering.average_ranks(_lines(spark, folder), F.col("l_quantity"))


@query("avg_rank_prices", sql=f"SELECT x AS value, any_value(t) AS n, any_value(r) AS avg_rank FROM {ranks_sql('SELECT 1 AS g, o_totalprice AS x FROM orders')} GROUP BY x")
def avg_rank_prices(spark, folder):
    return ordering.average_ranks(load(spark, folder, "orders"), F.col("o_totalprice"))


@query("avg_rank_prices_large", sql=f"SELECT x AS value, any_value(t) AS n, any_value(r) AS avg_rank FROM {ranks_sql('SELECT 1 AS g, o_totalprice AS x FROM orders')} GROUP BY x")
def avg_rank_prices_large(spark, folder):
    """The plan of a table that no single task may order."""
    return ordering.average_ranks(load(spark, folder, "orders"), F.col("o_totalprice"), one_task_rows=1_000)


@query("avg_rank_by_row", sql=f"""
SELECT k AS o_orderkey, col AS "column", r AS avg_rank FROM (
  SELECT o_orderkey AS k, 'o_totalprice' AS col, rank() OVER (ORDER BY o_totalprice) + (count(*) OVER (PARTITION BY o_totalprice) - 1) / 2 AS r FROM orders
  UNION ALL SELECT o_orderkey, 'o_custkey', rank() OVER (ORDER BY o_custkey) + (count(*) OVER (PARTITION BY o_custkey) - 1) / 2 FROM orders
  UNION ALL SELECT o_orderkey, 'half', CASE WHEN o_orderkey % 3 = 0 THEN (count(*) FILTER (o_orderkey % 3 = 0) OVER () + 1) / 2 ELSE count(*) FILTER (o_orderkey % 3 = 0) OVER () + (count(*) FILTER (o_orderkey % 3 <> 0) OVER () + 1) / 2 END FROM orders)""")
def avg_rank_by_row(spark, folder):
    """Ranks of every row in three columns, one of which has two values only."""
    cells = {"o_totalprice": F.col("o_totalprice"), "o_custkey": F.col("o_custkey"), "half": F.when(F.col("o_orderkey") % 3 == 0, 0).otherwise(1)}
    return ranks.stitched_ranks(load(spark, folder, "orders"), cells, "o_orderkey").withColumnRenamed("_row", "o_orderkey")


@query("shapiro_by_group")
def shapiro_by_group(spark, folder):
    return hypothesis.shapiro_by_group(_lines(spark, folder), "l_returnflag", PRICES, LINE_KEY)


def k2_sql(table: str, c: str) -> str:
    return f"""
SELECT '{c}' AS "column", CAST(n AS BIGINT) AS n, round(zs * zs + zk * zk, 4) AS statistic, round(exp(-(zs * zs + zk * zk) / 2), 6) AS p_value,
  exp(-(zs * zs + zk * zk) / 2) > 0.05 AS is_normal, round(g1, 2) AS skewness, round(g2, 2) AS kurtosis
FROM (SELECT *, asinh(y / sqrt(2 / (w2 - 1))) / sqrt(0.5 * ln(w2)) AS zs,
  (1 - 2 / (9 * a) - sign(d) * pow((1 - 2 / a) / abs(d), 1.0 / 3)) / sqrt(2 / (9 * a)) AS zk
FROM (SELECT *, 1 + x * sqrt(2 / (a - 4)) AS d FROM (SELECT *, sqrt(2 * (b - 1)) - 1 AS w2, 6 + 8 / b1 * (2 / b1 + sqrt(1 + 4 / (b1 * b1))) AS a
FROM (SELECT *, g1 * sqrt((n + 1) * (n + 3) / (6 * (n - 2))) AS y,
  3 * (n * n + 27 * n - 70) * (n + 1) * (n + 3) / ((n - 2) * (n + 5) * (n + 7) * (n + 9)) AS b,
  (g2 + 3 - 3 * (n - 1) / (n + 1)) / sqrt(24 * n * (n - 2) * (n - 3) / (pow(n + 1, 2) * (n + 3) * (n + 5))) AS x,
  6 * (n * n - 5 * n + 2) / ((n + 7) * (n + 9)) * sqrt(6 * (n + 3) * (n + 5) / (n * (n - 2) * (n - 3))) AS b1
FROM (SELECT n, m3 / pow(m2, 1.5) AS g1, m4 / (m2 * m2) - 3 AS g2 FROM (SELECT CAST(count(*) AS DOUBLE) AS n, avg(pow({c} - m, 2)) AS m2,
  avg(pow({c} - m, 3)) AS m3, avg(pow({c} - m, 4)) AS m4 FROM {table}, (SELECT avg({c}) AS m FROM {table})))))))"""


def normal_sql(table: str, g: str, x: str, groups) -> str:
    """Whether every group looks normal by K-squared, as groups of over 500 values are judged."""
    each = union_all(k2_sql(f"(SELECT {x} FROM {table} WHERE {g} = '{v}')", x) for v in groups)
    return f"(SELECT bool_and(is_normal) AS ok FROM ({each}))"


PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]


@query("test_recommendation", sql=f"""
SELECT CASE WHEN NOT ok THEN 'mann_whitney' WHEN p > 0.05 THEN 'student' ELSE 'welch' END AS test, ok AS all_normal, p > 0.05 AS equal_variance
FROM {normal_sql('lineitem', 'l_returnflag', 'l_extendedprice', ['A', 'R'])}, (SELECT p_value AS p FROM ({anova_sql('levene', """
SELECT l_returnflag AS g, abs(l_extendedprice - med) AS x FROM lineitem JOIN (SELECT l_returnflag AS f,
  quantile_cont(l_extendedprice, 0.5) AS med FROM lineitem GROUP BY 1) ON f = l_returnflag WHERE l_returnflag IN ('A', 'R')""")}))""")
def test_recommendation(spark, folder):
    return hypothesis.recommend_test(_lines(spark, folder), "l_returnflag", "l_extendedprice", ["A", "R"])


@query("test_recommendation_multi", sql=f"""
SELECT CASE WHEN ok THEN 'anova' ELSE 'kruskal' END AS test, ok AS all_normal, CAST(NULL AS BOOLEAN) AS equal_variance
FROM {normal_sql('orders', 'o_orderpriority', 'o_totalprice', PRIORITIES)}""")
def test_recommendation_multi(spark, folder):
    return hypothesis.recommend_test(load(spark, folder, "orders"), "o_orderpriority", "o_totalprice", None, multi=True)


@query("shapiro_tested", sql=union_all(f"""
SELECT '{c}' AS "column", l_returnflag AS "group", least(count({c}), 500) AS tested, true AS in_bounds FROM lineitem GROUP BY 2""" for c in PRICES))
def shapiro_tested(spark, folder):
    out = hypothesis.shapiro_by_group(_lines(spark, folder), "l_returnflag", PRICES, LINE_KEY)
    return out.select("column", "group", "tested", (F.col("statistic").between(0.0, 1.0) & F.col("p_value").between(0.0, 1.0)).alias("in_bounds"))


@query("normality", sql=union_all(k2_sql("events", c) for c in ["value", "user_id"]))
def normality(spark, folder):
    # the switch point is put under the table size, so that all rows enter the moment test
    return hypothesis.normality(load(spark, folder, "events"), ["value", "user_id"], switch=500)


@query("normality_small_column")
def normality_small(spark, folder):
    return hypothesis.normality(load(spark, folder, "supplier"), ["s_acctbal", "s_nationkey"])


# --- correlations -----------------------------------------------------------------------

STRENGTH = "CASE WHEN abs(r) >= 0.7 THEN 'Strong' WHEN abs(r) >= 0.4 THEN 'Moderate' WHEN abs(r) >= 0.2 THEN 'Weak' ELSE 'Negligible' END"
LINE_NUMBERS = ["l_orderkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def pair_row_sql(a: str, b: str, facts: str) -> str:
    """``facts``: a relation of one row ``(n, r)``."""
    return f"""
SELECT '{a}' AS var1, '{b}' AS var2, n, round(r, 4) AS coefficient, round(p, 6) AS p_value, p < 0.05 AS is_significant, {STRENGTH} AS strength,
  CASE WHEN p < 0.001 THEN '***' WHEN p < 0.01 THEN '**' WHEN p < 0.05 THEN '*' ELSE 'ns' END AS symbol
FROM (SELECT *, CASE WHEN abs(r) >= 1 THEN 0.0 ELSE {t_p_sql('t', 'n - 2')} END AS p
FROM (SELECT *, r * sqrt((n - 2) / greatest(1 - r * r, 1e-300)) AS t FROM {facts}))"""


def pairs_sql(table: str, columns) -> str:
    return union_all(pair_row_sql(a, b, f"(SELECT count(*) AS n, corr({a}, {b}) AS r FROM {table} WHERE {a} IS NOT NULL AND {b} IS NOT NULL)")
                     for a, b in itertools.combinations(columns, 2))


@query("correlation_pairs", sql=pairs_sql("lineitem", LINE_NUMBERS))
def correlation_pairs(spark, folder):
    return correlation.correlation_pairs(_lines(spark, folder), LINE_NUMBERS)


WIDE_NUMBERS = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", *LINE_NUMBERS[1:], "rare"]
WIDE_SQL = "WITH w AS (SELECT *, CASE WHEN l_partkey % 3 = 0 THEN l_quantity + l_tax END AS rare FROM lineitem)"


@query("correlation_pairs_wide", sql=WIDE_SQL + pairs_sql("w", WIDE_NUMBERS))
def correlation_pairs_wide(spark, folder):
    rare = F.when(F.col("l_partkey") % 3 == 0, F.col("l_quantity") + F.col("l_tax"))
    return correlation.correlation_pairs(_lines(spark, folder).withColumn("rare", rare), WIDE_NUMBERS)


@query("correlation_pairs_with_gaps", sql="WITH j AS (SELECT n_chars, quality, toxic FROM documents LEFT JOIN labels USING (doc_id))"
       + pairs_sql("j", ["n_chars", "quality", "toxic"]))
def correlation_pairs_with_gaps(spark, folder):
    j = load(spark, folder, "documents").join(load(spark, folder, "labels"), "doc_id", "left")
    return correlation.correlation_pairs(j, ["n_chars", "quality", "toxic"])


def spearman_sql(table: str, a: str, b: str) -> str:
    rank = lambda c: f"rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2"
    return pair_row_sql(a, b, f"""(SELECT count(*) AS n, corr(x, y) AS r
FROM (SELECT {rank(a)} AS x, {rank(b)} AS y FROM {table} WHERE {a} IS NOT NULL AND {b} IS NOT NULL))""")


@query("spearman", sql=union_all(spearman_sql("lineitem", a, b) for a, b in itertools.combinations(PRICES, 2)))
def spearman(spark, folder):
    return correlation.spearman(_lines(spark, folder), PRICES)


@query("spearman_large", sql=union_all(spearman_sql("lineitem", a, b) for a, b in itertools.combinations(PRICES, 2)))
def spearman_large(spark, folder):
    """The plan of columns with too many distinct values to look up."""
    return correlation.spearman(_lines(spark, folder), PRICES, lookup_rows=0)


@query("spearman_with_gaps", sql="WITH j AS (SELECT n_chars, quality, toxic FROM documents LEFT JOIN labels USING (doc_id))"
       + union_all(spearman_sql("j", a, b) for a, b in itertools.combinations(["n_chars", "quality", "toxic"], 2)))
def spearman_with_gaps(spark, folder):
    j = load(spark, folder, "documents").join(load(spark, folder, "labels"), "doc_id", "left")
    return correlation.spearman(j, ["n_chars", "quality", "toxic"])


@query("corr_matrix", sql=union_all(
    f"SELECT '{a}' AS var1, '{b}' AS var2, round({'1.0' if a == b else f'corr({a}, {b})'}, 4)::DOUBLE AS coefficient FROM {'(SELECT 1)' if a == b else 'part'}"
    for a in ["p_partkey", "p_size", "p_retailprice"] for b in ["p_partkey", "p_size", "p_retailprice"]))
def corr_matrix(spark, folder):
    return correlation.corr_matrix(load(spark, folder, "part"), ["p_partkey", "p_size", "p_retailprice"])


# --- insights -----------------------------------------------------------------------------


def group_sql(table: str, c: str, m: str) -> str:
    return f"(SELECT CAST({c} AS VARCHAR) AS g, count(*) AS n, sum({m}) AS s FROM {table} WHERE {c} IS NOT NULL AND {m} IS NOT NULL GROUP BY 1)"


@query("pareto_table", sql=f"""
SELECT g AS "group", round(s, 2) AS total, row_number() OVER (ORDER BY s DESC, g) AS position,
  round(sum(s) OVER (ORDER BY s DESC, g) / sum(s) OVER (), 4) AS share FROM (SELECT user_id AS g, sum(value) AS s FROM events GROUP BY 1)""")
def pareto_table(spark, folder):
    out = insights.pareto_table(load(spark, folder, "events"), "user_id", "value")
    return out.select("group", F.round("total", 2).alias("total"), "position", F.round("share", 4).alias("share"))


def pareto_sql(table: str, c: str, m: str) -> str:
    return f"""
SELECT '{c}' AS category, '{m}' AS metric, k AS groups, CAST(n AS BIGINT) AS "rows", round(total, 2) AS total, top_count,
  round(top_count / k, 4) AS top_ratio, round(covered * 100, 1) AS covered_pct, leading_groups,
  n >= 10 AND total > 0 AND k >= 3 AND top_count / k <= 0.3 AS is_driver
FROM (SELECT max(k) AS k, max(n_all) AS n, max(total) AS total, max(top_count) AS top_count, max(share) FILTER (i = top_count) AS covered,
  string_agg(g, ', ' ORDER BY i) FILTER (i <= 3 AND i <= top_count) AS leading_groups
FROM (SELECT *, count(*) FILTER (share <= 0.8) OVER () + 1 AS top_count
FROM (SELECT g, row_number() OVER (ORDER BY s DESC, g) AS i, sum(s) OVER (ORDER BY s DESC, g) / sum(s) OVER () AS share,
  sum(s) OVER () AS total, sum(n) OVER () AS n_all, count(*) OVER () AS k FROM {group_sql(table, c, m)})))"""


@query("pareto_drivers", sql=f"WITH {PLANTED_SQL}" + union_all(
    pareto_sql("planted", c, m) for c in ["segment", "event_type", "note"] for m in ["event_id", "amount"]))
def pareto_drivers(spark, folder):
    out = insights.pareto_drivers(planted_events(spark, folder), ["segment", "event_type", "note"], ["event_id", "amount"])
    return out.withColumn("total", F.round("total", 2))


@query("pareto_customers", sql=pareto_sql("orders", "o_custkey", "o_totalprice"))
def pareto_customers(spark, folder):
    out = insights.pareto_drivers(load(spark, folder, "orders"), ["o_custkey"], ["o_totalprice"])
    return out.withColumn("total", F.round("total", 2))


@query("subgroup_ratio", sql="""
SELECT CAST(user_id AS VARCHAR) AS "group", count(*) AS n, round(avg(value), 4) AS mean, round(avg(value) / (SELECT avg(value) FROM events), 4) AS ratio
FROM events GROUP BY 1""")
def subgroup_ratio(spark, folder):
    out = insights.subgroup_ratio(load(spark, folder, "events"), "user_id", "value")
    return out.select("group", "n", F.round("mean", 4).alias("mean"), F.round("ratio", 4).alias("ratio"))


def disparity_sql(table: str, c: str, m: str) -> str:
    return f"""
SELECT '{c}' AS category, '{m}' AS metric, "rows", eligible_groups, g AS "group", round(top, 2) AS group_mean, round(base, 2) AS baseline,
  round(top / base, 2) AS ratio, "rows" >= 20 AND eligible_groups >= 2 AND top / base >= 1.8 AS is_disparity,
  CASE WHEN "rows" >= 20 AND eligible_groups >= 2 AND top / base >= 1.8 THEN CASE WHEN top / base > 2.5 THEN 'High' ELSE 'Medium' END END AS severity
FROM (SELECT count(*) AS eligible_groups, max(s / n) AS top, arg_min(g, {{'a': -s / n, 'b': g}}) AS g FROM {group_sql(table, c, m)} WHERE n >= 5),
  (SELECT count(*) AS "rows", avg({m}) AS base FROM {table} WHERE {c} IS NOT NULL AND {m} IS NOT NULL)"""


@query("subgroup_disparity", sql=f"WITH {PLANTED_SQL}" + union_all(
    disparity_sql("planted", c, m) for c in ["segment", "event_type"] for m in ["event_id", "amount"]))
def subgroup_disparity(spark, folder):
    return insights.subgroup_disparity(planted_events(spark, folder), ["segment", "event_type"], ["event_id", "amount"])


SCAN_SQL = f"""WITH {PLANTED_SQL},
miss AS (SELECT *, round(nulls / total * 100, 1) AS pct FROM (SELECT 'note' AS c, count(*) - count(note) AS nulls, count(*) AS total FROM planted)),
dup AS (SELECT *, round(d / total * 100, 1) AS pct FROM (SELECT CAST(sum(n - 1) AS BIGINT) AS d, CAST(sum(n) AS BIGINT) AS total FROM (SELECT count(*) AS n FROM
  (SELECT event_id, segment, event_type, note, amount FROM planted) GROUP BY event_id, segment, event_type, note, amount))),
par AS (SELECT * FROM ({union_all(f"SELECT {i} AS ci, {j} AS mi, * FROM ({pareto_sql('planted', c, m)})"
    for i, c in enumerate(['segment', 'event_type', 'note']) for j, m in enumerate(['event_id', 'amount']))})
  WHERE is_driver QUALIFY row_number() OVER (PARTITION BY ci ORDER BY mi) = 1),
dis AS (SELECT * FROM ({union_all(f"SELECT {i} AS ci, {j} AS mi, * FROM ({disparity_sql('planted', c, m)})"
    for i, c in enumerate(['segment', 'event_type', 'note']) for j, m in enumerate(['event_id', 'amount']))})
  WHERE is_disparity QUALIFY row_number() OVER (PARTITION BY ci ORDER BY mi) = 1),
skew AS (SELECT * FROM (SELECT 0 AS mi, 'event_id' AS c, skewness(event_id) AS g FROM planted UNION ALL SELECT 1, 'amount', skewness(amount) FROM planted)
  WHERE abs(g) > 2.5 ORDER BY mi LIMIT 1),
found AS (
SELECT 0 AS seq, 'risk_high_missingness' AS id, 'Missing values: ''' || c || ''' lacks ' || CAST(pct AS VARCHAR) || '%' AS headline, 'Quality Risk' AS category,
  CASE WHEN pct > 40 THEN 'Critical' ELSE 'High' END AS severity, CASE WHEN pct > 40 THEN 9.0 ELSE 7.5 END::DOUBLE AS impact FROM miss WHERE nulls / total > 0.15
UNION ALL SELECT 1, 'risk_duplicates', 'Duplicate rows: ' || d || ' (' || CAST(pct AS VARCHAR) || '%)', 'Quality Risk',
  CASE WHEN pct > 5 THEN 'High' ELSE 'Medium' END, 7.0 FROM dup WHERE d > 0
UNION ALL SELECT 100 + ci, 'pareto_' || category || '_' || metric, 'Concentration: top ' || top_count || ' of ' || groups || ' ' || category
  || ' groups hold ' || CAST(covered_pct AS VARCHAR) || '% of ' || metric, 'Key Driver', 'High', 8.5 FROM par
UNION ALL SELECT 200 + ci, 'disparity_' || category || '_' || metric, 'Subgroup: ''' || "group" || ''' is ' || CAST(ratio AS VARCHAR) || 'x the mean of ' || metric,
  'Growth Signal', severity, 7.8 FROM dis
UNION ALL SELECT 300, 'skew_' || c, 'Extreme ' || CASE WHEN g > 0 THEN 'right' ELSE 'left' END || ' skew in ''' || c || ''': ' || CAST(round(g, 2) AS VARCHAR),
  'Anomaly Alert', 'Medium', 6.5 FROM skew),
top AS (SELECT * FROM found ORDER BY impact DESC, seq LIMIT 6)"""


@query("insight_scan", sql=f"{SCAN_SQL} SELECT CAST(seq AS INTEGER) AS seq, id, headline, category, severity, impact FROM top")
def insight_scan(spark, folder):
    return insights.insight_scan(planted_events(spark, folder)).drop("metrics")


@query("insight_briefing", sql=f"""{SCAN_SQL}
SELECT (SELECT count(*) FROM planted) AS "rows", CAST(5 AS BIGINT) AS "columns", count(*) AS insights, count(*) FILTER (severity = 'Critical') AS critical,
  (SELECT coalesce(string_agg(headline, '; ' ORDER BY impact DESC, seq), '') FROM (SELECT * FROM top WHERE category IN ('Key Driver', 'Growth Signal') ORDER BY impact DESC, seq LIMIT 2)) AS signals,
  (SELECT coalesce(string_agg(headline, '; ' ORDER BY impact DESC, seq), '') FROM (SELECT * FROM top WHERE category NOT IN ('Key Driver', 'Growth Signal') ORDER BY impact DESC, seq LIMIT 2)) AS risks
FROM top""")
def insight_briefing(spark, folder):
    return insights.insight_briefing(planted_events(spark, folder))


# --- report tables -----------------------------------------------------------------------------

MESSY_SIZES = f"""(SELECT count(*) AS n, {' + '.join(f'count(*) - count({c})' for c in MESSY_KINDS)} AS missing FROM messy),
  (SELECT CAST(sum(c - 1) AS BIGINT) AS d FROM (SELECT count(*) AS c FROM messy GROUP BY {', '.join(MESSY_KINDS)}))"""


@query("kpi_scorecard", sql=f"""
WITH {MESSY_SQL} SELECT n AS total_rows, CAST(8 AS BIGINT) AS total_columns, missing AS missing_cells, d AS duplicate_rows,
  greatest(round(100 - missing / (n * 8) * 100 * 2 - d / n * 100 * 1.5, 1), 0.0) AS integrity_score FROM {MESSY_SIZES}""")
def kpi_scorecard(spark, folder):
    return report.kpi_scorecard(messy_orders(spark, folder))


@query("column_summary", sql=f"WITH {MESSY_SQL}" + union_all(
    f"SELECT CAST({i} AS INTEGER) AS position, '{c}' AS \"column\", '{'bigint' if i == 0 else 'string' if k == 'text' else 'double'}' AS dtype, "
    f"count({c}) AS non_null, count(DISTINCT {c}) AS \"unique\", round((count(*) - count({c})) / count(*) * 100, 1) AS null_pct FROM messy"
    for i, (c, k) in enumerate(MESSY_KINDS.items())))
def column_summary(spark, folder):
    return report.column_summary(messy_orders(spark, folder))


@query("report_findings", sql=f"""
WITH {MESSY_SQL}, s AS (SELECT * FROM {MESSY_SIZES})
SELECT 1 AS seq, CASE WHEN missing > 0 THEN 'missing_cells' ELSE 'complete' END AS finding, missing AS value FROM s
UNION ALL SELECT 2, CASE WHEN d > 0 THEN 'duplicate_rows' ELSE 'no_duplicates' END, d FROM s
UNION ALL SELECT 3, 'numeric_columns', 3""")
def report_findings(spark, folder):
    return report.report_findings(messy_orders(spark, folder))


@query("quality_score", sql="""
SELECT 0.0::DOUBLE AS missing_pct, d AS duplicate_rows, greatest(0, CAST(trunc(100 - 0.0 * 1.5 - d * 2) AS BIGINT)) AS quality_score
FROM (SELECT CAST(coalesce(sum(n - 1), 0) AS BIGINT) AS d FROM (SELECT count(*) AS n FROM (SELECT c_nationkey, c_mktsegment, c_custkey FROM customer) GROUP BY ALL))""".replace("GROUP BY ALL", "GROUP BY c_nationkey, c_mktsegment, c_custkey"))
def quality_score(spark, folder):
    return report.quality_score(load(spark, folder, "customer").select("c_custkey", "c_nationkey", "c_mktsegment"))


@query("quality_score_messy", sql=f"""
WITH {MESSY_SQL}, facts AS ({facts_sql('messy', MESSY_KINDS)}),
h AS (SELECT round(sum(total - non_null + tokens) / (max(total) * 8) * 100, 2) AS missing_pct FROM facts),
d AS (SELECT d FROM {MESSY_SIZES})
SELECT missing_pct, d AS duplicate_rows, greatest(0, CAST(trunc(100 - missing_pct * 1.5 - d * 2) AS BIGINT)) AS quality_score FROM h, d""")
def quality_score_messy(spark, folder):
    return report.quality_score(messy_orders(spark, folder))
