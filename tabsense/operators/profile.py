"""Column profiles: numeric, categorical, datetime; describe; the EDA report."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.columns import is_numeric, moment, number, numeric_columns, other_columns, present, spread_rows, wall_micros
from ..functions.rounding import half_up
from .ordering import long_form, quantiles, value_counts

NUMERIC_PROFILE = (
    "column string, count bigint, mean double, median double, std double, min double, max double, "
    "q1 double, q3 double, iqr double, outlier_count bigint, skewness double"
)


def safe(x: float | None, places: int = 4) -> float:
    return 0.0 if x is None or math.isnan(x) or math.isinf(x) else half_up(x, places)


def adjusted_skewness(n: int, population: float | None) -> float:
    """Sample-size adjusted skewness; 0 when undefined."""
    if n < 3 or population is None or math.isnan(population):
        return 0.0
    return population * math.sqrt(n * (n - 1)) / (n - 2)


def moments_of(df: DataFrame, cells: dict) -> dict[str, dict]:
    """Count, mean, spread, extremes and shape of every column, one scan per twelve columns."""
    out: dict[str, dict] = {}
    names = list(cells)
    # at most 12 columns per aggregate keep it inside generated code
    for start in range(0, len(names), 12):
        part = names[start : start + 12]
        aggs = []
        for i, name in enumerate(part):
            c = cells[name]
            aggs += [
                F.count(c).alias(f"n{i}"), F.avg(c).alias(f"mean{i}"), F.stddev_samp(c).alias(f"std{i}"),
                F.min(c).alias(f"min{i}"), F.max(c).alias(f"max{i}"), F.skewness(c).alias(f"skew{i}"),
            ]
        row = df.agg(*aggs).first()
        for i, name in enumerate(part):
            out[name] = {k: row[f"{k}{i}"] for k in ("n", "mean", "std", "min", "max", "skew")}
    return out


def numeric_profile(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """One row per numeric column. Quartiles are exact; fences use the rounded quartiles."""
    spark = df.sparkSession
    chosen = list(columns or numeric_columns(df))
    if not chosen:
        return spark.createDataFrame([], NUMERIC_PROFILE)
    cells = {c: number(df, c) for c in chosen}
    facts = moments_of(df, cells)
    quarts = quantiles(df, cells, [0.25, 0.5, 0.75], {c: f["n"] for c, f in facts.items()})
    fences = {}
    for c in chosen:
        q1, _, q3 = [safe(x) for x in (quarts[c] or [None] * 3)]
        fences[c] = (q1, q3, q1 - 1.5 * (q3 - q1), q3 + 1.5 * (q3 - q1))
    outside = df.agg(
        *[F.count_if((cells[c] < fences[c][2]) | (cells[c] > fences[c][3])).alias(f"o{i}") for i, c in enumerate(chosen)]
    ).first()
    rows = []
    for i, c in enumerate(chosen):
        f, (q1, q3, _, _) = facts[c], fences[c]
        rows.append((
            c, f["n"], safe(f["mean"]), safe(quarts[c][1] if quarts[c] else None), safe(f["std"]), safe(f["min"]),
            safe(f["max"]), q1, q3, half_up(q3 - q1, 4), outside[f"o{i}"], safe(adjusted_skewness(f["n"], f["skew"])),
        ))
    return spark.createDataFrame(rows, NUMERIC_PROFILE)


def categorical_profile(df: DataFrame, columns: Sequence[str], top_n: int = 10) -> DataFrame:
    """``(column, cardinality, rank, value, count, pct)``: the most frequent values.

    The rank filter is applied before the shuffle as well (a group limit), so a
    column with many values never reaches one task as a whole.
    """
    cells = {c: present(df, c).cast("string") for c in columns}
    counted = value_counts(df, cells)
    totals = counted.groupBy("column").agg(F.sum("n").alias("_total"), F.count(F.lit(1)).alias("cardinality"))
    by_size = Window.partitionBy("column").orderBy(F.desc("n"), F.asc("value"))
    top = counted.withColumn("rank", F.row_number().over(by_size)).where(F.col("rank") <= top_n)
    # totals: one row per profiled column
    return top.join(F.broadcast(totals), "column").select(
        "column", "cardinality", F.col("rank").cast("bigint").alias("rank"), "value", F.col("n").alias("count"),
        F.round(F.col("n") / F.col("_total") * 100, 1).alias("pct"),
    )


DAY_MICROS = 86_400_000_000


def date_facts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``(column, values, null_count, lo, hi, median_gap_days)`` from one scan; times in microseconds.

    Timestamps of one calendar day lie under a day apart, so they only add gaps
    of zero; across days only the last of one and the first of the next matter.
    The window therefore runs over days, of which a calendar has a fixed number.
    Cells without a date make up one more row per column.
    """
    cells = {c: wall_micros(moment(df, c)) for c in columns}
    days = (
        long_form(df, cells).groupBy("column", F.floor(F.col("value") / DAY_MICROS).alias("day"))
        .agg(F.count(F.lit(1)).alias("n"), F.min("value").alias("first"), F.max("value").alias("last"))
    )
    w = Window.partitionBy("column").orderBy(F.asc_nulls_first("day"))
    dated = F.col("day").isNotNull()
    steps = days.withColumn("gap", F.floor((F.col("first") - F.lag("last").over(w)) / DAY_MICROS))
    zero, none = F.lit(0).cast("bigint"), F.lit(None).cast("bigint")
    # one row for the gap to the day before, one for the gaps within the day
    both = steps.select("column", "first", "last", spread_rows(["gap", "weight", "values", "nulls"], [
        [F.col("gap"), F.lit(1).cast("bigint"), F.when(dated, F.col("n")), F.when(~dated, F.col("n"))],
        [F.when(dated, zero), F.col("n") - 1, none, none],
    ]))
    return both.groupBy("column").agg(
        F.coalesce(F.sum("values"), F.lit(0)).alias("values"), F.coalesce(F.sum("nulls"), F.lit(0)).alias("null_count"),
        F.min("first").alias("lo"), F.max("last").alias("hi"), F.percentile("gap", 0.5, F.col("weight")).alias("median_gap_days"),
    )


def _cadence_label() -> Column:
    m = F.col("median_gap_days")
    return (
        F.when(F.col("values") < 3, "irregular").when(m <= 1, "daily").when(m <= 8, "weekly")
        .when(m <= 35, "monthly").when(m <= 100, "quarterly").otherwise("yearly")
    )


def cadence(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``(column, values, median_gap_days, cadence)``."""
    return date_facts(df, columns).select("column", "values", "median_gap_days", _cadence_label().alias("cadence"))


def datetime_profile(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Range, cadence and the cells that are null or cannot be read, per date column."""
    day = lambda c: F.date_format(F.date_from_unix_date(F.floor(F.col(c) / DAY_MICROS).cast("int")), "yyyy-MM-dd")
    span = F.floor((F.col("hi") - F.col("lo")) / DAY_MICROS)
    return date_facts(df, columns).select(
        "column", F.coalesce(day("lo"), F.lit("N/A")).alias("min_date"), F.coalesce(day("hi"), F.lit("N/A")).alias("max_date"),
        F.coalesce(span, F.lit(0)).cast("bigint").alias("date_range_days"), _cadence_label().alias("detected_frequency"),
        "null_count",
    )


def moments(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Population skewness and excess kurtosis per column."""
    cells = {c: number(df, c) for c in columns}
    return long_form(df, cells).groupBy("column").agg(
        F.count("value").alias("count"), F.round(F.skewness("value"), 4).alias("skewness"),
        F.round(F.kurtosis("value"), 4).alias("kurtosis"),
    )


DESCRIBE = (
    "column string, count bigint, unique bigint, top string, freq bigint, mean double, std double, "
    "min double, q25 double, q50 double, q75 double, max double"
)


def describe_all(df: DataFrame) -> DataFrame:
    """One row per column: the text part for text columns, the number part for numbers."""
    nums = numeric_columns(df)
    texts = other_columns(df)
    parts = []
    if nums:
        p = numeric_profile(df, nums)
        parts.append(p.select(
            "column", "count", F.lit(None).cast("bigint").alias("unique"), F.lit(None).cast("string").alias("top"),
            F.lit(None).cast("bigint").alias("freq"), "mean", "std", "min", F.col("q1").alias("q25"),
            F.col("median").alias("q50"), F.col("q3").alias("q75"), "max",
        ))
    if texts:
        counted = value_counts(df, {c: present(df, c).cast("string") for c in texts})
        # largest count first, then the smaller value
        best = F.min(F.struct((-F.col("n")).alias("k"), F.col("value").alias("v")))
        facts = counted.groupBy("column").agg(
            F.sum("n").alias("count"), F.count(F.lit(1)).alias("unique"), best.alias("b")
        )
        every = df.sparkSession.createDataFrame([(c,) for c in texts], "column string")
        null = [F.lit(None).cast("double").alias(n) for n in ("mean", "std", "min", "q25", "q50", "q75", "max")]
        parts.append(every.join(facts, "column", "left").select(
            "column", F.coalesce("count", F.lit(0)).alias("count"), F.coalesce("unique", F.lit(0)).alias("unique"),
            F.col("b.v").alias("top"), (-F.col("b.k")).alias("freq"), *null,
        ))
    out = parts[0]
    return out.unionByName(parts[1]) if len(parts) > 1 else out


def eda_report(df: DataFrame, types: dict[str, str] | None = None) -> DataFrame:
    """All profiles as ``(kind, column, item, number, text)`` rows.

    ``types`` maps column to semantic type; text and id columns are skipped.
    Without it every number is profiled and nothing else.
    """
    types = types or {c: "numeric" for c in df.columns if is_numeric(df, c)}
    of = lambda *kinds: [c for c in df.columns if types.get(c) in kinds]
    parts = []
    if cols := of("numeric"):
        p = numeric_profile(df, cols)
        fields = [f.name for f in p.schema.fields if f.name != "column"]
        parts.append(
            p.select("column", *[F.col(f).cast("double").alias(f) for f in fields])
            .unpivot(["column"], fields, "item", "number")
            .select(F.lit("numeric").alias("kind"), "column", "item", "number", F.lit(None).cast("string").alias("text"))
        )
    if cols := of("categorical", "boolean"):
        p = categorical_profile(df, cols)
        top, no_text = F.concat(F.lit("top_"), F.col("rank").cast("string")), F.lit(None).cast("string")
        # the cardinality goes along with the first value only
        items = spread_rows(["item", "number", "text"], [
            [top, F.col("count").cast("double"), F.col("value")], [F.concat(top, F.lit("_pct")), F.col("pct"), F.col("value")],
            [F.when(F.col("rank") == 1, "cardinality"), F.col("cardinality").cast("double"), no_text],
        ])
        parts.append(p.select("column", items).where("item is not null").select(F.lit("categorical").alias("kind"), "column", "item", "number", "text"))
    if cols := of("datetime"):
        p = datetime_profile(df, cols)
        no_number, no_text = F.lit(None).cast("double"), F.lit(None).cast("string")
        words = [[F.lit(i), no_number, F.col(i)] for i in ("min_date", "max_date", "detected_frequency")]
        counts = [[F.lit(i), F.col(i).cast("double"), no_text] for i in ("date_range_days", "null_count")]
        parts.append(
            p.select("column", spread_rows(["item", "number", "text"], words + counts))
            .select(F.lit("datetime").alias("kind"), "column", "item", "number", "text")
        )
    if not parts:
        return df.sparkSession.createDataFrame([], "kind string, column string, item string, number double, text string")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def eda_headlines(df: DataFrame, types: dict[str, str]) -> DataFrame:
    """The few facts that open a report: ``(seq, fact, column, text, number)``."""
    spark = df.sparkSession
    schema = "seq int, fact string, column string, text string, number double"
    of = lambda *kinds: [c for c in df.columns if types.get(c) in kinds]
    out = df.agg(F.count(F.lit(1)).cast("double").alias("number")).select(
        F.lit(1).alias("seq"), F.lit("rows").alias("fact"), F.lit(None).cast("string").alias("column"),
        F.lit(None).cast("string").alias("text"), "number",
    ).unionByName(spark.createDataFrame([(2, "columns", None, None, float(len(df.columns)))], schema))
    if cols := of("numeric"):
        # one row per column from here on
        prof = numeric_profile(df, cols).collect()
        top = sorted(prof, key=lambda r: (-r["std"], cols.index(r["column"])))[0]
        rows = [
            (3, "most_variable", top["column"], None, top["std"]),
            (4, "most_variable_min", top["column"], None, top["min"]),
            (5, "most_variable_max", top["column"], None, top["max"]),
        ]
        rows += [(6, "has_outliers", r["column"], None, float(r["outlier_count"])) for r in prof if r["outlier_count"]]
        out = out.unionByName(spark.createDataFrame(rows, schema))
    if cols := of("categorical", "boolean"):
        p = categorical_profile(df, cols, top_n=1)
        widest = p.orderBy(F.desc("cardinality"), F.array_position(F.array(*[F.lit(c) for c in cols]), F.col("column"))).limit(1)
        out = out.unionByName(widest.select(
            F.lit(7).alias("seq"), F.lit("top_value").alias("fact"), "column", F.col("value").alias("text"),
            F.col("pct").alias("number"),
        ))
    if cols := of("datetime"):
        p = datetime_profile(df, cols[:1])
        out = out.unionByName(p.select(
            F.lit(8).alias("seq"), F.lit("time_span").alias("fact"), "column",
            F.concat("min_date", F.lit(" to "), "max_date", F.lit(", "), "detected_frequency").alias("text"),
            F.col("date_range_days").cast("double").alias("number"),
        ))
    return out


def schema_summary(df: DataFrame, types: dict[str, str]) -> DataFrame:
    """``(position, column, semantic_type, non_null, samples)``, text cut at 60 characters."""
    from .quality import column_facts

    known = df.sparkSession.createDataFrame(
        [(i, c, types.get(c, df.schema[c].dataType.simpleString())) for i, c in enumerate(df.columns)],
        "position int, column string, semantic_type string",
    )
    cut = lambda c: F.substring(c, 1, 60)
    return known.join(F.broadcast(column_facts(df)), "column").select(
        "position", "column", "semantic_type", "non_null",
        F.concat_ws(" | ", cut("smallest"), cut("shortest"), cut("largest")).alias("samples"),
    )
