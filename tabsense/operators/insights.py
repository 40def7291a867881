"""Ranked findings: concentration, subgroup disparity, missingness, duplicates, skew."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import named, number, numeric_columns, other_columns, present, spread_rows
from ..storage import materialize
from .basics import duplicate_facts
from .ordering import ONE_TASK_ROWS, long_form, running_totals

# fixed values
PARETO_SHARE = 0.80
PARETO_HEAD = 0.30
DISPARITY_RATIO = 1.8
MISSING_SHARE = 0.15
SKEW_LIMIT = 2.5

INSIGHT = ["seq", "id", "headline", "category", "severity", "impact", "metrics"]


def exact_sum(x: Column) -> Column:
    """The sum of a double, the same in any order of the rows, so that equal totals tie: as decimals where these hold every value, else plain."""
    d = x.try_cast("decimal(28,10)")
    held = F.bool_and(x.isNull() | F.coalesce(d.cast("double") == x, F.lit(False)))
    return F.coalesce(F.when(held, F.try_sum(d).cast("double")), F.sum(x))


def group_sums(df: DataFrame, category: str, metric: str) -> DataFrame:
    """``(group, total)`` over rows where both sides are present."""
    x = number(df, metric)
    return (
        df.where(present(df, category).isNotNull() & x.isNotNull())
        .groupBy(named(category).alias("group")).agg(exact_sum(x).alias("total"))
    )


def group_facts(df: DataFrame, categories: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """``(category, metric, group, n, total, seen)`` for all pairs, from one scan.

    ``n`` counts readable metric cells, ``seen`` rows where neither cell is null.
    """
    cats = {c: present(df, c).cast("string") for c in categories}
    base = df.select(
        *[c.alias(f"c{i}") for i, c in enumerate(cats.values())],
        *[number(df, m).alias(f"m{i}") for i, m in enumerate(metrics)],
        *[present(df, m).isNotNull().alias(f"p{i}") for i, m in enumerate(metrics)],
    )
    keep = [f"{k}{i}" for k in "mp" for i in range(len(metrics))]
    tall = base.select(*keep, spread_rows(["category", "group"], [
        [F.lit(c), F.col(f"c{i}")] for i, c in enumerate(categories)
    ])).where(F.col("group").isNotNull())
    sums = tall.groupBy("category", "group").agg(*[
        e for i in range(len(metrics)) for e in (
            F.count(f"m{i}").alias(f"n{i}"), exact_sum(F.col(f"m{i}")).alias(f"s{i}"), F.count_if(F.col(f"p{i}")).alias(f"r{i}"),
        )
    ])
    return sums.select("category", "group", spread_rows(["metric", "n", "total", "seen"], [
        [F.lit(m), F.col(f"n{i}"), F.col(f"s{i}"), F.col(f"r{i}")] for i, m in enumerate(metrics)
    ]))


def running_share(facts: DataFrame, keys: Sequence[str], one_task_rows: int = ONE_TASK_ROWS) -> DataFrame:
    """Groups by falling total with ``position`` and cumulative ``share`` within each key."""
    # the sums are small next to the rows and are read three times below
    counted = materialize(facts.withColumn("_one", F.lit(1).cast("bigint")))
    ranked = running_totals(
        counted, [F.desc("total"), F.asc("group")], {"total": "_above", "_one": "_rank"}, keys, one_task_rows, materialized=True
    )
    # one row per key, and the keys are pairs of columns
    whole = counted.groupBy(*keys).agg(F.sum("total").alias("grand_total"), F.count(F.lit(1)).alias("groups"))
    joined = ranked.join(F.broadcast(whole), list(keys)) if keys else ranked.crossJoin(F.broadcast(whole))
    return joined.drop("_one").withColumns({
        "position": F.col("_rank") + 1,
        "share": F.try_divide(F.col("_above") + F.col("total"), F.col("grand_total")),
    }).drop("_above", "_rank")


def pareto_table(df: DataFrame, category: str, metric: str, one_task_rows: int = ONE_TASK_ROWS) -> DataFrame:
    """``(group, total, position, share)``: group totals with the running share."""
    return running_share(group_sums(df, category, metric), [], one_task_rows).select("group", "total", "position", "share")


def pareto_drivers(
    df: DataFrame, categories: Sequence[str], metrics: Sequence[str], threshold: float = PARETO_SHARE,
    one_task_rows: int = ONE_TASK_ROWS,
) -> DataFrame:
    """One row per pair: how many leading groups pass the threshold, and whether that is a concentration."""
    facts = group_facts(df, categories, metrics).where("n > 0").select("category", "metric", "group", "n", "total")
    shares = running_share(facts, ["category", "metric"], one_task_rows)
    pairs = shares.groupBy("category", "metric").agg(
        F.max("groups").alias("groups"), F.sum("n").alias("rows"), F.max("grand_total").alias("total"),
        (F.count_if(F.col("share") <= threshold) + 1).alias("top_count"),
    )
    # at most three names per pair
    heads = shares.join(F.broadcast(pairs.select("category", "metric", "top_count")), ["category", "metric"])
    head_facts = heads.groupBy("category", "metric").agg(
        F.max(F.when(F.col("position") == F.col("top_count"), F.col("share"))).alias("covered"),
        *[F.max(F.when((F.col("position") == k) & (F.col("top_count") >= k), F.col("group"))).alias(f"g{k}") for k in (1, 2, 3)],
    )
    ratio = F.col("top_count") / F.col("groups")
    driver = (F.col("rows") >= 10) & (F.col("total") > 0) & (F.col("groups") >= 3) & (ratio <= PARETO_HEAD)
    return pairs.join(head_facts, ["category", "metric"]).select(
        "category", "metric", "groups", "rows", "total", "top_count",
        F.round(ratio, 4).alias("top_ratio"), F.round(F.col("covered") * 100, 1).alias("covered_pct"),
        F.concat_ws(", ", "g1", "g2", "g3").alias("leading_groups"), driver.alias("is_driver"),
    )


def subgroup_ratio(df: DataFrame, category: str, metric: str) -> DataFrame:
    """``(group, n, mean, ratio)``: mean of every group against the overall mean."""
    facts = group_facts(df, [category], [metric]).where("n > 0")
    whole = facts.agg((F.sum("total") / F.sum("n")).alias("baseline"))
    return facts.crossJoin(F.broadcast(whole)).select(
        "group", "n", (F.col("total") / F.col("n")).alias("mean"),
        F.try_divide(F.col("total") / F.col("n"), F.col("baseline")).alias("ratio"),
    )


def subgroup_disparity(df: DataFrame, categories: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """One row per pair: the group with the highest mean and its ratio to the baseline."""
    facts = group_facts(df, categories, metrics)
    mean = F.try_divide(F.col("total"), F.col("n"))
    large = F.col("n") >= 5
    # highest mean first, then the smaller name: one struct per pair, no window
    pairs = facts.groupBy("category", "metric").agg(
        F.sum("seen").alias("rows"), F.try_divide(F.sum("total"), F.sum("n")).alias("baseline"),
        F.count_if(large).alias("eligible"),
        F.min(F.when(large, F.struct((-mean).alias("k"), F.col("group").alias("g")))).alias("b"),
        F.min(F.when(large, F.struct(mean.alias("k"), F.col("group").alias("g")))).alias("l"),
    )
    # against a negative baseline the lowest mean has the highest ratio
    pick = F.when(F.col("baseline") < 0, F.col("l.g")).otherwise(F.col("b.g"))
    top = F.when(F.col("baseline") < 0, F.col("l.k")).otherwise(-F.col("b.k"))
    ratio = F.try_divide(top, F.col("baseline"))
    hit = (F.col("rows") >= 20) & (F.col("eligible") >= 2) & (ratio >= DISPARITY_RATIO)
    return pairs.select(
        "category", "metric", "rows", F.col("eligible").alias("eligible_groups"), pick.alias("group"),
        F.round(top, 2).alias("group_mean"), F.round("baseline", 2).alias("baseline"), F.round(ratio, 2).alias("ratio"),
        F.coalesce(hit, F.lit(False)).alias("is_disparity"),
        F.when(hit, F.when(ratio > 2.5, "High").otherwise("Medium")).alias("severity"),
    )


# --- the scan ----------------------------------------------------------------


def _text(c: Column) -> Column:
    return c.cast("string")


def _insight(seq, id_, headline, category, severity, impact, metrics: dict[str, Column]) -> list[Column]:
    pairs = [e for k, v in metrics.items() for e in (F.lit(k), _text(v))]
    return [
        seq.cast("int").alias("seq"), id_.alias("id"), headline.alias("headline"), F.lit(category).alias("category"),
        severity.alias("severity"), impact.cast("double").alias("impact"), F.create_map(*pairs).alias("metrics"),
    ]


def _positions(columns: Sequence[str], name: str) -> Column:
    return F.array_position(F.array(*[F.lit(c) for c in columns]), F.col(name)) - 1


def missing_risk(df: DataFrame) -> DataFrame:
    nulls = df.agg(*[F.count_if(present(df, c).isNull()).alias(c) for c in df.columns], F.count(F.lit(1)).alias("_rows"))
    tall = nulls.unpivot(["_rows"], [named(c) for c in df.columns], "column", "nulls").where(
        F.try_divide(F.col("nulls"), F.col("_rows")) > MISSING_SHARE
    )
    worst = F.min(F.struct((-F.col("nulls")).alias("k"), _positions(df.columns, "column").alias("p"), F.col("column").alias("c")))
    s = tall.agg(F.count(F.lit(1)).alias("columns"), worst.alias("w"), F.max("_rows").alias("rows")).where("columns > 0")
    s = s.withColumns({"column": F.col("w.c"), "pct": F.round(-F.col("w.k") / F.col("rows") * 100, 1)})
    high = F.col("pct") > 40
    return s.select(*_insight(
        F.lit(0), F.lit("risk_high_missingness"),
        F.concat(F.lit("Missing values: '"), "column", F.lit("' lacks "), _text(F.col("pct")), F.lit("%")),
        "Quality Risk", F.when(high, "Critical").otherwise("High"), F.when(high, 9.0).otherwise(7.5),
        {"missing_columns": F.col("columns"), "worst_column": F.col("column"), "worst_null_pct": F.col("pct")},
    ))


def duplicate_risk(df: DataFrame) -> DataFrame:
    s = duplicate_facts(df).where("duplicates > 0").withColumn("pct", F.round(F.col("duplicates") / F.col("rows") * 100, 1))
    return s.select(*_insight(
        F.lit(1), F.lit("risk_duplicates"),
        F.concat(F.lit("Duplicate rows: "), _text(F.col("duplicates")), F.lit(" ("), _text(F.col("pct")), F.lit("%)")),
        "Quality Risk", F.when(F.col("pct") > 5, "High").otherwise("Medium"), F.lit(7.0),
        {"duplicates": F.col("duplicates"), "duplicate_rate": F.col("pct")},
    ))


def _first_hit(frame: DataFrame, categories: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """For each category the hit with the earliest metric (pairs are few: schema-bounded)."""
    at = frame.withColumns({"_c": _positions(categories, "category"), "_m": _positions(metrics, "metric")})
    first = at.groupBy("category").agg(F.min("_m").alias("_m"))
    return at.join(F.broadcast(first), ["category", "_m"])


def pareto_findings(df: DataFrame, categories: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    hits = _first_hit(pareto_drivers(df, categories, metrics).where("is_driver"), categories, metrics)
    return hits.select(*_insight(
        F.lit(100) + F.col("_c"), F.concat_ws("_", F.lit("pareto"), "category", "metric"),
        F.concat(F.lit("Concentration: top "), _text(F.col("top_count")), F.lit(" of "), _text(F.col("groups")), F.lit(" "),
                 F.col("category"), F.lit(" groups hold "), _text(F.col("covered_pct")), F.lit("% of "), F.col("metric")),
        "Key Driver", F.lit("High"), F.lit(8.5),
        {"top_count": F.col("top_count"), "category_count": F.col("groups"), "share_percentage": F.col("covered_pct")},
    ))


def disparity_findings(df: DataFrame, categories: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    hits = _first_hit(subgroup_disparity(df, categories, metrics).where("is_disparity"), categories, metrics)
    return hits.select(*_insight(
        F.lit(200) + F.col("_c"), F.concat_ws("_", F.lit("disparity"), "category", "metric"),
        F.concat(F.lit("Subgroup: '"), "group", F.lit("' is "), _text(F.col("ratio")), F.lit("x the mean of "), F.col("metric")),
        "Growth Signal", F.col("severity"), F.lit(7.8),
        {"group": F.col("group"), "group_mean": F.col("group_mean"), "baseline": F.col("baseline")},
    ))


def skew_findings(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    s = long_form(df, {c: number(df, c) for c in columns}).groupBy("column").agg(
        F.count("value").cast("double").alias("n"), F.skewness("value").alias("g")
    ).where("n >= 10")
    skew = F.col("g") * F.sqrt(F.col("n") * (F.col("n") - 1)) / (F.col("n") - 2)
    hits = s.withColumn("skew", F.round(skew, 2)).where((F.abs(skew) > SKEW_LIMIT) & ~F.isnan(skew))
    first = hits.withColumn("_m", _positions(columns, "column")).orderBy("_m").limit(1)
    side = F.when(F.col("skew") > 0, "right").otherwise("left")
    return first.select(*_insight(
        F.lit(300), F.concat_ws("_", F.lit("skew"), "column"),
        F.concat(F.lit("Extreme "), side, F.lit(" skew in '"), "column", F.lit("': "), _text(F.col("skew"))),
        "Anomaly Alert", F.lit("Medium"), F.lit(6.5), {"column": F.col("column"), "skewness": F.col("skew")},
    ))


def insight_scan(
    df: DataFrame, max_insights: int = 6, categories: Sequence[str] | None = None, metrics: Sequence[str] | None = None
) -> DataFrame:
    """The findings of a table, strongest first. Only the number of findings is limited, not the rows read.

    ``categories`` and ``metrics`` name the columns that are looked at, all by default;
    every pair of them shares one scan.
    """
    cats, nums = list(categories or other_columns(df)), list(metrics or numeric_columns(df))
    # categories are compared as text; nested columns cannot be grouped that way
    cats = [c for c in cats if not isinstance(df.schema[c].dataType, (T.ArrayType, T.MapType, T.StructType, T.BinaryType))]
    parts = [missing_risk(df), duplicate_risk(df)]
    if cats and nums:
        parts.append(pareto_findings(df, cats, nums))
        parts.append(disparity_findings(df, cats, nums))
    if nums:
        parts.append(skew_findings(df, nums))
    every = reduce(DataFrame.unionByName, parts)
    return every.orderBy(F.desc("impact"), F.asc("seq")).limit(max_insights).select(*INSIGHT)


def insight_briefing(df: DataFrame, max_insights: int = 6) -> DataFrame:
    """One row: table size, number of findings, and the two leading signals and risks."""
    found = insight_scan(df, max_insights)
    signal = F.col("category").isin("Key Driver", "Growth Signal")
    ranked = F.struct((-F.col("impact")).alias("i"), F.col("seq").alias("s"), F.col("headline").alias("h"))
    # `found` has no more than max_insights rows
    pick = lambda keep: F.array_sort(F.collect_list(F.when(keep, ranked)))
    lists = found.agg(
        F.count(F.lit(1)).alias("insights"), F.count_if(F.col("severity") == "Critical").alias("critical"),
        pick(signal).alias("a"), pick(~signal).alias("b"),
    )
    two = lambda name: F.array_join(F.transform(F.slice(F.col(name), 1, 2), lambda x: x["h"]), "; ")
    size = df.agg(F.count(F.lit(1)).alias("rows"))
    return lists.crossJoin(F.broadcast(size)).select(
        "rows", F.lit(len(df.columns)).cast("bigint").alias("columns"), "insights", "critical",
        two("a").alias("signals"), two("b").alias("risks"),
    )
