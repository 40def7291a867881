"""Preference pairs from conversations.

The longest common prefix of the turns of the chosen and the rejected conversation becomes
the prompt, rendered once; what follows becomes two completions, each with the stretches
that are trained on: the text and end mark of assistant turns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

END = "<|end|>"
_RENDER = f"concat('<|', coalesce(t.role, 'unknown'), '|>\\n', coalesce(t.text, ''), '{END}\\n')"


def conversations(turns: DataFrame) -> DataFrame:
    """(conv_id, turns): the turns of a conversation in order of turn, then role and text; nulls come first.

    A conversation becomes one record, as the rendered pair does.
    """
    turn = F.struct(F.col("turn").cast("long").alias("turn"), F.col("role").alias("role"), F.col("text").alias("text"))
    return turns.groupBy(F.col("conv_id").cast("long").alias("conv_id")).agg(F.sort_array(F.collect_list(turn)).alias("turns"))


def swapped_replies(turns: DataFrame) -> DataFrame:
    """(pair_id, chosen, rejected): each conversation up to its last assistant turn, against the same with another's reply.

    The other conversation is the one whose id differs in the last bit; its last assistant
    text takes the place of the own one. Conversations without an assistant turn, without that
    partner or with a null id give no pair.
    """
    said = "transform(turns, t -> coalesce(t.role = 'assistant', false))"
    full = conversations(turns).withColumn("_n", F.expr(f"if(array_contains({said}, true), size(turns) - array_position(reverse({said}), true) + 1, 0)")).where("_n > 0")
    reply = full.select(F.expr("conv_id ^ 1L").alias("conv_id"), F.expr("element_at(turns, cast(_n as int)).text").alias("_reply"))
    return full.join(reply, "conv_id").select(
        F.col("conv_id").alias("pair_id"),
        F.expr("slice(turns, 1, cast(_n as int))").alias("chosen"),
        F.expr("concat(slice(turns, 1, cast(_n as int) - 1), array(named_struct('turn', element_at(turns, cast(_n as int)).turn, 'role', 'assistant', 'text', _reply)))").alias("rejected"),
    )


def _mask(turns: str) -> str:
    begin = "length(concat('<|', coalesce(t.role, 'unknown'), '|>\\n'))"
    stop = f"s.at + {begin} + length(coalesce(t.text, '')) + {len(END)}"
    span = f"array(concat(s.at + {begin}, ':', {stop}))"
    grown = f"named_struct('at', s.at + length({_RENDER}), 'out', if(t.role = 'assistant', concat(s.out, {span}), s.out))"
    return f"array_join(aggregate({turns}, named_struct('at', 0, 'out', cast(array() as array<string>)), (s, t) -> {grown}, s -> s.out), ',')"


def format_pairs(pairs: DataFrame) -> DataFrame:
    """pair_id, n_prompt_turns, prompt, chosen, rejected, chosen_mask, rejected_mask and usable of every pair.

    ``pairs`` has pair_id and the turn arrays chosen and rejected (a null array is empty). Turns
    are equal when role and text are, nulls being equal to nulls. A mask lists start:end in code
    points of the completion, comma-joined. ``usable`` is false where a completion has nothing
    to train on, as when one conversation begins with the whole other one. Roles that are null
    are rendered as unknown, null texts as empty. Repeated rows give a row each.
    """
    rows = pairs.select("pair_id", F.expr("coalesce(chosen, array())").alias("c"), F.expr("coalesce(rejected, array())").alias("r"))
    equal = "transform(arrays_zip(slice(c, 1, least(size(c), size(r))) as a, slice(r, 1, least(size(c), size(r))) as b), z -> z.a.role <=> z.b.role and z.a.text <=> z.b.text)"
    equal = equal.replace(" as a", "").replace(" as b", "").replace("z.a.", "z.`0`.").replace("z.b.", "z.`1`.")
    rows = rows.withColumn("same", F.expr(equal))
    rows = rows.withColumn("n", F.expr("cast(if(array_contains(same, false), array_position(same, false) - 1, size(same)) as int)"))
    rows = rows.withColumns({"ct": F.expr("slice(c, n + 1, size(c))"), "rt": F.expr("slice(r, n + 1, size(r))")})
    text = lambda turns: f"array_join(transform({turns}, t -> {_RENDER}), '')"
    out = rows.selectExpr(
        "pair_id", "cast(n as bigint) as n_prompt_turns", f"{text('slice(c, 1, n)')} as prompt", f"{text('ct')} as chosen", f"{text('rt')} as rejected",
        f"{_mask('ct')} as chosen_mask", f"{_mask('rt')} as rejected_mask")
    return out.withColumn("usable", F.expr("chosen_mask != '' and rejected_mask != ''"))


def _sql() -> str:
    render = "'<|' || coalesce(role, 'unknown') || '|>' || chr(10) || coalesce(text, '') || '<|end|>' || chr(10)"
    side = lambda name: f"""
{name}_c AS (SELECT s.pair_id, pos, role, text, {render} AS line,
  coalesce(sum(length({render})) OVER (PARTITION BY s.pair_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS gone
  FROM {name} s JOIN p ON p.pair_id = s.pair_id WHERE pos > n),
{name}_t AS (SELECT pair_id, string_agg(line, '' ORDER BY pos) AS body,
  coalesce(string_agg((gone + length('<|' || role || '|>' || chr(10))) || ':' || (gone + length(line) - 1), ',' ORDER BY pos) FILTER (WHERE role = 'assistant'), '') AS mask
  FROM {name}_c GROUP BY pair_id)"""  # noqa: E731
    return f"""
WITH t AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS pos FROM conversations),
l AS (SELECT conv_id, max(pos) AS n FROM t WHERE role = 'assistant' GROUP BY conv_id),
reply AS (SELECT t.conv_id, t.text FROM t JOIN l ON l.conv_id = t.conv_id AND l.n = t.pos),
chosen AS (SELECT t.conv_id AS pair_id, t.pos, t.role, t.text FROM t JOIN l ON l.conv_id = t.conv_id JOIN reply o ON o.conv_id = xor(t.conv_id, 1) WHERE t.pos <= l.n),
rejected AS (SELECT t.conv_id AS pair_id, t.pos, t.role, CASE WHEN t.pos = l.n THEN o.text ELSE t.text END AS text
  FROM t JOIN l ON l.conv_id = t.conv_id JOIN reply o ON o.conv_id = xor(t.conv_id, 1) WHERE t.pos <= l.n),
p AS (SELECT c.pair_id, coalesce(min(c.pos) FILTER (WHERE c.role IS DISTINCT FROM r.role OR c.text IS DISTINCT FROM r.text) - 1, max(c.pos)) AS n
  FROM chosen c JOIN rejected r ON r.pair_id = c.pair_id AND r.pos = c.pos GROUP BY c.pair_id),
head AS (SELECT c.pair_id, string_agg({render}, '' ORDER BY c.pos) AS prompt FROM chosen c JOIN p ON p.pair_id = c.pair_id WHERE c.pos <= p.n GROUP BY c.pair_id),
{side("chosen").strip()},
{side("rejected").strip()}
SELECT p.pair_id, CAST(p.n AS BIGINT) AS n_prompt_turns, coalesce(head.prompt, '') AS prompt, coalesce(a.body, '') AS chosen, coalesce(b.body, '') AS rejected,
  coalesce(a.mask, '') AS chosen_mask, coalesce(b.mask, '') AS rejected_mask, coalesce(a.mask, '') <> '' AND coalesce(b.mask, '') <> '' AS usable
FROM p LEFT JOIN head ON head.pair_id = p.pair_id LEFT JOIN chosen_t a ON a.pair_id = p.pair_id LEFT JOIN rejected_t b ON b.pair_id = p.pair_id
"""


SQL = _sql()
