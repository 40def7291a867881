"""Quality rules as a ledger of failure bits.

``ledger`` evaluates every rule once and stores the measurements with one bit per
failed rule. Policies are versioned masks over these bits, so a new policy or an
ablation reads the ledger and no text. All of it is SQL functions inside one scan.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let

WINDOW = 5


@dataclass(frozen=True)
class Rule:
    name: str
    fails: str  # SQL over the measurements; null counts as passed


# The position in this list is the bit; append new rules, never reorder.
RULES = (
    Rule("few_words", "n_words < 10"),
    Rule("repeated_windows", "100 * n_repeat_words > 20 * n_words"),
    Rule("many_symbols", "10 * n_symbols > 3 * n_words"),
    Rule("repeated_lines", "10 * n_dup_lines > 3 * n_lines"),
    Rule("shouting", "2 * n_upper > word_chars"),
    Rule("exclamations", "10 * n_exclaim > 3 * n_words"),
    Rule("word_length", "word_chars < 2 * n_words or word_chars > 25 * n_words"),
)
BITS = {rule.name: i for i, rule in enumerate(RULES)}

# version -> the rules that reject; v2 leaves out the rule whose ablation gives back good texts only
POLICIES = {
    "base": ("few_words", "repeated_windows"),
    "v1": tuple(rule.name for rule in RULES),
    "v2": tuple(rule.name for rule in RULES if rule.name != "repeated_lines"),
}


def mask_of(policy: tuple[str, ...]) -> int:
    return sum(1 << BITS[name] for name in policy)


HASHED = "xxhash64(ws[i], ws[i + 1], ws[i + 2], ws[i + 3], ws[i + 4])"


def _repeats(words: str) -> str:
    """Words in windows that occur twice or more, for a text where window hashes repeat.

    Window hashes share a long with the window's place, so one sort of plain longs brings
    equal hashes together; only those windows are then compared word by word.
    """
    place_bits = "cast(ceil(log2(size(ws) + 1)) as int)"
    packed = f"sort_array(transform(sequence(0, size(ws) - {WINDOW}), i -> (shiftleft(shiftright({HASHED}, pb), pb) | cast(i as bigint))))"
    near = "filter(ps, (p, j) -> (j > 0 and shiftright(p, pb) = shiftright(ps[greatest(j - 1, 0)], pb)) or (j < size(ps) - 1 and shiftright(p, pb) = shiftright(ps[least(j + 1, size(ps) - 1)], pb)))"
    places = "transform(cs, p -> cast(p & (shiftleft(1L, pb) - 1) as int))"
    grams = f"sort_array(transform({places}, i -> struct(concat_ws(' ', slice(ws, i + 1, {WINDOW})) as g, i as i)))"
    equal = "filter(gs, (x, j) -> (j > 0 and x.g = gs[greatest(j - 1, 0)].g) or (j < size(gs) - 1 and x.g = gs[least(j + 1, size(gs) - 1)].g))"
    covered = f"aggregate(transform(qs, (q, j) -> if(j < size(qs) - 1, least({WINDOW}, qs[least(j + 1, size(qs) - 1)] - q), {WINDOW})), 0L, (s, v) -> s + v)"
    exact = let(grams, "gs", let(f"sort_array(transform({equal}, x -> x.i))", "qs", covered))
    return let(words, "ws", let(place_bits, "pb", let(packed, "ps", let(near, "cs", f"if(size(cs) = 0, 0L, {exact})"))))


def measured(rows: DataFrame, text_col: str) -> DataFrame:
    """Adds every measurement of the text column, and drops the column; characters are code points.

    The steps build on columns that are used more than once, so each is computed once per row.
    """
    flat = f"coalesce(`{text_col}`, '')"
    for separator in ("\\t", "\\n", "\\u000B", "\\u000C", "\\r"):
        flat = f"replace({flat}, '{separator}', ' ')"
    lines = f"filter(split(coalesce(`{text_col}`, ''), '\\n'), l -> l rlike r'[^\\x20\\x09-\\x0D]')"
    step = rows.withColumns({"_flat": F.expr(flat), "_lines": F.expr(lines)})
    step = step.withColumn("_words", F.expr("array_remove(split(_flat, ' '), '')"))
    hashes = f"if(size(_words) < {WINDOW}, array(), transform(sequence(0, size(_words) - {WINDOW}), i -> {HASHED.replace('ws', '_words')}))"
    step = step.withColumn("_hashes", F.expr(hashes))
    out = {
        # adds 0, but is not deterministic to the optimizer: a filter on the ledger is then not
        # rewritten as one on the text, which would repeat all of this once per rule
        "n_words": "size(_words) + least(spark_partition_id(), 0)",
        "word_chars": "length(replace(_flat, ' ', ''))",
        "n_symbols": "length(_flat) - length(regexp_replace(_flat, '[#*$%&|<>]+', ''))",
        "n_lines": "size(_lines)",
        "n_dup_lines": "size(_lines) - size(array_distinct(_lines))",
        "n_repeat_words": f"if(size(_hashes) = size(array_distinct(_hashes)), 0L, {_repeats('_words')})",
        "n_upper": "length(_flat) - length(regexp_replace(_flat, r'\\p{Lu}+', ''))",
        "n_exclaim": "length(_flat) - length(replace(_flat, '!', ''))",
    }
    kept = [f"`{c}`" for c in rows.columns if c != text_col]
    return step.selectExpr(*kept, *[f"cast({sql} as bigint) as {name}" for name, sql in out.items()])


def failed_bits() -> Column:
    """One bit for each failed rule, over the measurement columns."""
    return F.expr(" | ".join(f"if({rule.fails}, {1 << i}L, 0L)" for i, rule in enumerate(RULES)))


def ledger(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, all measurements and failed_bits, one row per row of ``docs``.

    A null or empty text has no words and fails ``few_words`` only. Lines without a word do
    not count. Other columns are ignored, repeated rows stay repeated, an empty table gives
    an empty ledger. Windows are compared as words, so the counts are exact.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return measured(rows, "text").withColumn("failed_bits", failed_bits())


def apply_policy(rows: DataFrame, version: str) -> DataFrame:
    """Adds kept: no bit of the policy's mask is set."""
    return rows.withColumn("kept", F.col("failed_bits").bitwiseAND(F.lit(mask_of(POLICIES[version])).cast("long")) == 0)


def ablations(rows: DataFrame) -> DataFrame:
    """version, rule, n_failed (rows the rule hits), n_only (rows that would stay without it), n_rejected, n_rows.

    The ledger shrinks to a count per distinct bit pattern first, at most two to the power of
    the number of rules, and every policy is read off those counts.
    """
    spark = rows.sparkSession
    patterns = rows.groupBy("failed_bits").agg(F.count(F.lit(1)).alias("n"))
    wanted = spark.createDataFrame([(v, r, 1 << BITS[r], mask_of(p)) for v, p in POLICIES.items() for r in p], "version string, rule string, bit long, mask long")
    hit = F.col("failed_bits").bitwiseAND(F.col("mask"))
    count = lambda cond: F.coalesce(F.sum(F.when(cond, F.col("n"))), F.lit(0)).cast("long")
    joined = F.broadcast(wanted).join(patterns, F.lit(True), "left")
    return joined.groupBy("version", "rule").agg(
        count(F.col("failed_bits").bitwiseAND(F.col("bit")) != 0).alias("n_failed"), count(hit == F.col("bit")).alias("n_only"),
        count(hit != 0).alias("n_rejected"), count(F.lit(True)).alias("n_rows"),
    )


def keep_good(docs: DataFrame, version: str = "v2", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that the policy keeps, with their columns as they came."""
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")
    rows = docs.select(row, F.col(text_col).alias("_text"))
    return apply_policy(measured(rows, "_text").withColumn("failed_bits", failed_bits()), version).where("kept").select("_row.*")


SQL = r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws,
  list_filter(string_split(text, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS ls FROM t),
g AS (SELECT doc_id, i, ws[i : i + 4] AS gram FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 3)) AS i FROM w)),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, gram) AS c FROM g) WHERE c > 1),
d AS (SELECT doc_id, least(5, coalesce(lead(i) OVER (PARTITION BY doc_id ORDER BY i) - i, 5)) AS step FROM r),
q AS (SELECT doc_id, sum(step) AS n FROM d GROUP BY doc_id),
m AS (SELECT w.doc_id, len(ws) AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g')) AS word_chars,
  length(text) - length(regexp_replace(text, '[#*$%&|<>]+', '', 'g')) AS n_symbols,
  len(ls) AS n_lines, len(ls) - len(list_distinct(ls)) AS n_dup_lines, coalesce(q.n, 0) AS n_repeat_words,
  length(text) - length(regexp_replace(text, '\p{Lu}+', '', 'g')) AS n_upper,
  length(text) - length(regexp_replace(text, '!+', '', 'g')) AS n_exclaim FROM w LEFT JOIN q ON q.doc_id = w.doc_id),
b AS (SELECT *, """ + " + ".join(f"CASE WHEN {rule.fails} THEN {1 << i} ELSE 0 END" for i, rule in enumerate(RULES)) + r""" AS failed_bits FROM m)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols,
  CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words,
  (failed_bits & 3) <> 0 AS base_failed, (failed_bits & """ + str(mask_of(POLICIES["v2"])) + r""") = 0 AS kept, CAST(failed_bits AS BIGINT) AS failed_bits FROM b
"""
