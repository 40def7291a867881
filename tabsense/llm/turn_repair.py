"""Conversations repaired at least cost, with shared suffixes.

After damage each row of a conversation becomes one symbol: its role as far as the grammar
knows it, and its fault. Conversations with the same symbols are repaired alike, so only
distinct signatures go on. Read from the end they share their suffixes: sorted by their
reverse, dealt to ranges, neighbouring signatures have the longest suffixes in common, and
a task keeps the nodes of the current signature on a stack. A node, that is one suffix, is
made once; for each state of the grammar it holds the least cost from there to the end and
the edit that begins the best audit, whose rest lies in the node behind it. Signatures that
share a suffix across the edge of a range make its nodes once in each range.

Two audits of one node and state never begin with the same letter (an edit's initial fixes
the next state), so the least first letter among the cheapest gives the least audit.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import materialize
from .common import sized_side

# fixed values: costs of the edits, and the initials of their names
KEEP, REROLE, DELETE, INSERT = ("K", 0), ("R", 2), ("D", 3), ("I", 2)
TRUNCATED = 1
WHITE = " \t\n\u000b\f\r"

# states of the grammar (s?(ua)+)?: nothing yet, after system, after user, after assistant
NEXT = {"s": (1, None, None, None), "u": (2, 2, None, 2), "a": (None, None, 3, None)}
FILL = (2, 2, 3, 2)  # the state behind an inserted or reroled row
FILLED = ("user", "user", "assistant", "user")
DELETED = "d"  # symbol of a row that has to go; other rows: initial of the role or o, upper case where truncated

Costs = tuple[int, int, int, int]


@lru_cache(maxsize=None)
def _solve(symbol: str, rest: Costs | None) -> tuple[Costs, str]:
    """Costs and first letters of a node, by the costs of the node behind it (None: the end)."""
    options: list[dict[str, int]] = [{} for _ in FILL]
    for state, option in enumerate(options):
        if rest is None:
            if state in (0, 3):
                option[""] = 0
            continue
        option["D"] = DELETE[1] + rest[state]
        if symbol != DELETED:
            extra = TRUNCATED if symbol.isupper() else 0
            option["R"] = REROLE[1] + extra + rest[FILL[state]]
            to = NEXT.get(symbol.lower(), (None,) * 4)[state]
            if to is not None:
                option["K"] = KEEP[1] + extra + rest[to]
    cost = [min(o.values(), default=1 << 30) for o in options]
    for _ in FILL:
        cost = [min(c, INSERT[1] + cost[FILL[s]]) for s, c in enumerate(cost)]
    letters = []
    for state, option in enumerate(options):
        option["I"] = INSERT[1] + cost[FILL[state]]
        letters.append(min(letter for letter, c in option.items() if c == cost[state]))
    return (cost[0], cost[1], cost[2], cost[3]), " ".join(letters)


class Suffixes:
    """The nodes of the current signature, the end at the bottom."""

    def __init__(self) -> None:
        self.made = 0
        self.symbols: list[str] = []
        self.nodes: list[tuple[int, Costs, list[str]]] = [self._node("", None)]  # cost taken off, costs above it, letters

    def _node(self, symbol: str, rest: Costs | None, base: int = 0) -> tuple[int, Costs, list[str]]:
        cost, letters = _solve(symbol, rest)
        least = min(cost)
        self.made += 1
        return base + least, tuple(c - least for c in cost), letters.split(" ")  # few different costs remain, so each kind of node is solved once

    def repair(self, reverse: str) -> tuple[int, str]:
        """Cost and audit of a signature, given by its reverse."""
        keep = 0
        for a, b in zip(self.symbols, reverse):
            if a != b:
                break
            keep += 1
        del self.symbols[keep:], self.nodes[keep + 1 :]
        for symbol in reverse[keep:]:
            base, costs, _ = self.nodes[-1]
            self.nodes.append(self._node(symbol, costs, base))
            self.symbols.append(symbol)
        cost, audit, state = self.nodes[-1][0] + self.nodes[-1][1][0], [], 0
        at = len(self.symbols)
        while letter := self.nodes[at][2][state]:
            audit.append(letter)
            if letter in "RI":
                state = FILL[state]
            elif letter == "K":
                state = NEXT[self.symbols[at - 1].lower()][state]
            at -= letter != "I"
        return cost, "".join(audit)


def _repair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    shared = Suffixes()
    for batch in batches:
        found = [(r[::-1], *shared.repair(r)) for r in batch["reverse"].to_pylist()]
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*found), (pa.string(), pa.int64(), pa.string()))], ["signature", "cost", "audit"])


def cheapest_edits(signatures: DataFrame) -> DataFrame:
    """(signature, cost, audit) of the distinct values of ``signature``."""
    reverse = signatures.select(F.reverse("signature").alias("reverse")).distinct()
    return reverse.repartitionByRange("reverse").sortWithinPartitions("reverse").mapInArrow(_repair, "signature string, cost long, audit string")


def damaged(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text and gone of all rows after damage; dropped rows stay, marked as gone, so that no conversation is lost."""
    shown = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.pmod(F.crc32(F.concat(shown("conv_id"), F.lit(":"), shown("turn"))), F.lit(20))
    rows = conversations.select("conv_id", F.col("turn").cast("long").alias("turn"), shown("role").alias("_role"), shown("text").alias("_text"), kind.alias("_kind"))
    return rows.select(
        "conv_id", "turn", F.when(F.col("_kind") == 4, "user").otherwise(F.col("_role")).alias("role"),
        F.when(F.col("_kind") == 1, "").when(F.col("_kind") == 2, F.regexp_replace("_text", "[.!?]", "")).otherwise(F.col("_text")).alias("text"),
        (F.col("_kind") == 0).alias("gone"), F.explode(F.array_repeat(F.lit(0), F.when(F.col("_kind") == 3, 2).otherwise(1))).alias("_copy"),
    ).drop("_copy")


def _order() -> list[Column]:
    """Rows of one turn lie by role and then by the digest of their text, so copies lie side by side."""
    return [F.col("turn").asc_nulls_first(), F.col("role"), F.col("digest")]


def faults(rows: DataFrame) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal and signature of each conversation, from (conv_id, turn, role, text, gone)."""
    last = F.right(F.rtrim(F.col("text"), F.lit(WHITE)), F.lit(1))
    slim = rows.select("conv_id", "turn", "role", "gone", F.sha2("text", 256).alias("digest"), last.alias("last"))
    here = Window.partitionBy("conv_id", "gone").orderBy(*_order())
    earlier = F.row_number().over(Window.partitionBy("conv_id", "gone", "role", "digest").orderBy("place")) > 1
    initial = F.left("role", F.lit(1))
    placed = slim.withColumns({"place": F.row_number().over(here), "before": F.lag(initial).over(here), "turn_before": F.lag("turn").over(here)})
    fault = F.when(F.col("last") == "", "blank").when(earlier, "duplicate").when(~F.col("last").isin(".", "!", "?"), "truncated")
    marked = placed.withColumn("fault", fault)
    known = F.when(initial.isin(*NEXT), initial).otherwise("o")
    symbol = F.when(F.col("fault").isin("blank", "duplicate"), DELETED).when(F.col("fault") == "truncated", F.upper(known)).otherwise(known)
    new_turn = F.col("turn").isNotNull() & ~F.col("turn").eqNullSafe(F.col("turn_before"))
    jump = F.col("before").isNotNull() & ~F.concat("before", initial).isin("su", "ua", "au")
    there = lambda cond: F.coalesce(F.sum(F.when(cond & ~F.col("gone"), 1).otherwise(0)), F.lit(0))
    turn = F.when(~F.col("gone"), F.col("turn")).cast("decimal(20,0)")
    path = F.transform(F.sort_array(F.collect_list(F.when(~F.col("gone"), F.struct("place", symbol.alias("symbol"))))), lambda x: x["symbol"])
    gaps = F.coalesce(F.max(turn) - F.min(turn) + 1 - there(new_turn), F.lit(0))
    return marked.groupBy("conv_id").agg(
        F.least(gaps, F.lit((1 << 63) - 1)).cast("long").alias("gaps"), *[there(F.coalesce(F.col("fault") == f, F.lit(False))).alias(f) for f in ("blank", "duplicate", "truncated")],
        there(jump).alias("illegal"), F.array_join(path, "").alias("signature"))


def _hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per conversation: its first row has the audit, the others come in order and are hashed as they pass."""
    kinds = [pa.string(), pa.string(), *[pa.int64()] * 6, pa.string(), pa.string()]
    names = ["key", "signature", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]

    class Text:
        def __init__(self, head: tuple) -> None:
            self.head, self.edits, self.state, self.hash, self.first = head, iter(head[-1]), 0, hashlib.sha256(), True

        def add(self, role: str, text: str) -> None:
            self.hash.update(f"{'' if self.first else chr(10)}{role}:{text}".encode("utf-8", "surrogatepass"))
            self.first = False

        def fill(self, text: str) -> None:
            self.add(FILLED[self.state], text)
            self.state = FILL[self.state]

        def row(self, role: str, text: str) -> None:
            for edit in self.edits:
                if edit == "I":
                    self.fill("")
                    continue
                if edit == "R":
                    self.fill(text)
                elif edit == "K":
                    self.add(role, text)
                    self.state = NEXT[role[0]][self.state]
                return

        def end(self) -> tuple:
            for _ in self.edits:  # only insertions are left
                self.fill("")
            return (*self.head, self.hash.hexdigest())

    now = None
    for batch in batches:
        done = []
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            head, role, text = row[:-2], row[-2], row[-1]
            if head[1] is not None:
                done += [now.end()] if now else []
                now = Text(head)
            else:
                now.row(role, text)
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*done), kinds)], names)
    if now:
        yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(now.end(), kinds)], names)


def repair(conversations: DataFrame) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit and repaired_sha256 of every conversation, after damage.

    Null roles and texts are one space, a null turn is one space in the damage key and sorts
    first, null ids form one conversation. Rows of one turn are taken by role and then by the
    SHA-256 of their text. A role without a character can't be kept. Repeated rows are
    duplicates, a conversation that damage leaves without rows has zeros and the digest of
    nothing, other columns are ignored, an empty table gives none. A conversation's rows
    stream through its task in order and are never held together.
    """
    kind = dict(conversations.dtypes)["conv_id"]
    rows = damaged(conversations)
    found = materialize(faults(rows))
    solved = sized_side(cheapest_edits(found.select("signature")))
    columns = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit"]
    heads = found.join(solved, "signature").select(F.col("conv_id").cast("string").alias("key"), "signature", *columns)
    lines = rows.where(~F.col("gone")).select(F.col("conv_id").cast("string").alias("key"), "turn", "role", "text", F.sha2("text", 256).alias("digest"))
    stream = heads.unionByName(lines, allowMissingColumns=True).repartition("key").sortWithinPartitions(F.col("key").asc_nulls_first(), F.col("signature").isNull(), *_order())
    out = stream.select("key", "signature", *columns, "role", "text").mapInArrow(
        _hashes, "key string, signature string, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string")
    return out.select(F.col("key").cast(kind).alias("conv_id"), *columns, "repaired_sha256")


def _sql() -> str:
    """The same repair row by row from the end, every state with its cost, audit and lines."""
    add = lambda cost, letter, of, line: f"{{'c': {of}.c + {cost}, 'a': '{letter}' || {of}.a, 't': {f'list_prepend({line}, {of}.t)' if line else f'{of}.t'}}}"
    keeps = {0: [("s", "f1"), ("u", "f2")], 1: [("u", "f2")], 2: [("a", "f3")], 3: [("u", "f2")]}
    fill = {s: "f3" if s == 2 else "f2" for s in range(4)}
    name = {s: "assistant" if s == 2 else "user" for s in range(4)}
    states = []
    for s in range(4):
        options = [add(3, "D", f"f{s}", "")] + [f"CASE WHEN r.fault IS DISTINCT FROM 'must' THEN {add('2 + r.extra', 'R', fill[s], f'{chr(39)}{name[s]}:{chr(39)} || r.text')} END"]
        options += [f"CASE WHEN r.fault IS DISTINCT FROM 'must' AND r.initial = '{i}' THEN {add('r.extra', 'K', to, 'r.line')} END" for i, to in keeps[s]]
        states.append(f"list_min(list_filter([{', '.join(options)}], lambda o: o IS NOT NULL)) AS b{s}")
    insert = lambda s, to: f"least({s}, {add(2, 'I', to, repr('assistant:' if s == 'b2' else 'user:'))})"
    end = lambda cost, audit, lines: f"{{'c': {cost}, 'a': '{audit}', 't': {lines}::VARCHAR[]}}"
    return rf"""
WITH RECURSIVE tbl AS (SELECT list(list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS t FROM range(256) x(i)),
k AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, concat(coalesce(conv_id::VARCHAR, ' '), ':', coalesce(turn::VARCHAR, ' ')) AS key FROM conversations),
h AS (SELECT k.*, xor(list_reduce(list_prepend(4294967295, list_transform(range(1, length(key) + 1), lambda j: ascii(key[j])::BIGINT)), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % 20 AS kind FROM k, tbl),
d AS (SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
  CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(CASE WHEN kind = 3 THEN 2 ELSE 1 END)) AS copy FROM h WHERE kind <> 0),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text), copy) AS i FROM d),
m AS (SELECT *, role[1] AS initial, lag(role[1]) OVER (PARTITION BY conv_id ORDER BY i) AS before,
  CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate'
  WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') THEN 'truncated' END AS kind FROM o),
r AS (SELECT conv_id, i, initial, text, role || ':' || text AS line, CASE WHEN kind IN ('blank', 'duplicate') THEN 'must' END AS fault, CASE WHEN kind = 'truncated' THEN 1 ELSE 0 END AS extra FROM m),
g AS (SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (kind = 'blank') AS blank, count(*) FILTER (kind = 'duplicate') AS duplicate,
  count(*) FILTER (kind = 'truncated') AS truncated, count(*) FILTER (before || initial NOT IN ('su', 'ua', 'au')) AS illegal FROM m GROUP BY conv_id),
p AS (SELECT conv_id, n + 1 AS i, {end(0, '', '[]')} AS f0, {end(4, 'II', "['user:', 'assistant:']")} AS f1, {end(2, 'I', "['assistant:']")} AS f2, {end(0, '', '[]')} AS f3 FROM g
UNION ALL SELECT conv_id, i, {insert('b0', 'f2')}, {insert('b1', 'f2')}, f2, f3 FROM (SELECT *, {insert('b2', 'b3')} AS f2, {insert('b3', 'b2')} AS f3 FROM (
  SELECT p.conv_id, r.i, {', '.join(states)} FROM p JOIN r ON r.conv_id IS NOT DISTINCT FROM p.conv_id AND r.i = p.i - 1)))
SELECT c.conv_id, coalesce(g.gaps, 0)::BIGINT AS gaps, coalesce(g.blank, 0)::BIGINT AS blank, coalesce(g.duplicate, 0)::BIGINT AS duplicate, coalesce(g.truncated, 0)::BIGINT AS truncated,
  coalesce(g.illegal, 0)::BIGINT AS illegal, coalesce(p.f0.c, 0)::BIGINT AS cost, coalesce(p.f0.a, '') AS audit, sha256(coalesce(array_to_string(p.f0.t, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN g ON g.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN p ON p.conv_id IS NOT DISTINCT FROM c.conv_id AND p.i = 1
"""


SQL = _sql()
