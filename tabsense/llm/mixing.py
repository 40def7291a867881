"""Mixing sources to target weights.

The sources form a tree (domain, language, source). A token budget at the root is shared
among children by weight, but no child gets more than its subtree can give in the allowed
epochs; what it cannot take goes to its siblings by their weights, and only what a whole
family cannot take goes to the siblings of the parent. Each leaf then reads its documents
in a seeded order, epoch after epoch, until its budget is met.

Only sums per node and per slice of a leaf are gathered. A leaf of any size is cut by
hash slices: whole slices are taken or left by their sums, and only the one slice in
which the budget ends is put in order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import sized_side

SLICE_ROWS = 10_000


def _share(nodes: DataFrame, parents: list[str], name: str) -> DataFrame:
    """Adds _got to nodes with _budget (of the parent), _weight and _cap, all whole numbers.

    In the order of cap per weight, a child is full when the rest of the budget gives it its
    cap or more; the others share what the full ones leave, down to single tokens by the
    largest remainder, ties by name.
    """
    ratio = F.col("_cap") / F.col("_weight")
    order = Window.partitionBy(*parents).orderBy(ratio, name)
    before = F.coalesce(F.sum("_cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    behind = F.sum("_weight").over(order.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    exact = lambda c: c.cast("decimal(19,0)")
    step = nodes.withColumns({"_before": before, "_behind": behind})
    full = exact(F.col("_cap")) * exact(F.col("_behind")) <= exact(F.col("_weight")) * exact(F.greatest(F.col("_budget") - F.col("_before"), F.lit(0)))
    step = step.withColumn("_full", full & (F.col("_budget") >= F.col("_before")))
    family = Window.partitionBy(*parents)
    left = F.col("_budget") - F.coalesce(F.sum(F.when(F.col("_full"), F.col("_cap"))).over(family), F.lit(0))
    open_weight = F.sum(F.when(~F.col("_full"), F.col("_weight"))).over(family)
    step = step.withColumns({"_left": F.greatest(left, F.lit(0)), "_open": open_weight})
    product = exact(F.col("_weight")) * exact(F.col("_left"))
    step = step.withColumns({
        "_floor": F.when(F.col("_full"), F.col("_cap")).otherwise(F.floor((product - product % exact(F.col("_open"))) / exact(F.col("_open"))).cast("long")),
        "_frac": F.when(~F.col("_full"), product % exact(F.col("_open"))),
    })
    spare = F.col("_left") - F.coalesce(F.sum(F.when(~F.col("_full"), F.col("_floor"))).over(family), F.lit(0))
    turn = F.row_number().over(Window.partitionBy(*parents).orderBy(F.col("_full"), F.col("_frac").desc_nulls_last(), name))
    step = step.withColumns({"_spare": spare, "_turn": turn})
    got = F.col("_floor") + F.when(~F.col("_full") & (F.col("_turn") <= F.col("_spare")), 1).otherwise(0)
    return step.withColumn("_got", got).drop("_before", "_behind", "_full", "_left", "_open", "_floor", "_frac", "_spare", "_turn")


def budgets(leaves: DataFrame, path: list[str], weights: dict[tuple[str, ...], int], budget: Column, epochs: int) -> DataFrame:
    """(path..., rows, tokens, target) for each leaf; ``leaves`` has path, rows and tokens.

    ``weights`` maps the beginning of a path to a whole weight; a node that it does not name
    weighs 1, a weight of 0 takes the node out. ``budget`` is an expression over ``total``, the tokens of all leaves.
    """
    spark = leaves.sparkSession
    named = spark.createDataFrame([("\u0000".join(k), int(w)) for k, w in weights.items()] or [("\u0000none", 1)], "_key string, _named long")
    nodes = leaves.withColumn("_cap", F.col("tokens") * epochs)
    for depth in range(len(path), 0, -1):
        # weights of every level, and caps that leave out what has no weight
        key = F.concat_ws("\u0000", *path[:depth])
        nodes = nodes.join(F.broadcast(named), key == F.col("_key"), "left").withColumn(f"_w{depth}", F.coalesce("_named", F.lit(1))).drop("_key", "_named")
        nodes = nodes.withColumn("_cap", F.when(F.col(f"_w{depth}") > 0, F.col("_cap")).otherwise(0))
    total = leaves.agg(F.coalesce(F.sum("tokens"), F.lit(0)).cast("long").alias("total")).select(budget.cast("long").alias("_budget"))
    state = nodes.crossJoin(F.broadcast(total))  # one row
    for depth in range(1, len(path) + 1):
        keys = path[:depth]
        level = state.where("_cap > 0").groupBy(*keys).agg(F.first("_budget").alias("_budget"), F.first(f"_w{depth}").alias("_weight"), F.sum("_cap").cast("long").alias("_cap"))
        shared = _share(level, keys[:-1], keys[-1]).select(*keys, F.col("_got"))
        state = state.join(shared, keys, "left").withColumn("_budget", F.coalesce("_got", F.lit(0))).drop("_got")
    return state.select(*path, "rows", "tokens", F.col("_budget").alias("target"))


def mix(docs: DataFrame, path: list[str], weights: dict[tuple[str, ...], int], size: Column, budget: Column, epochs: int = 4, seed: int = 7, id_col: str = "doc_id") -> DataFrame:
    """The chosen rows with all their columns and epoch, tokens and tokens_taken; a row comes once for each epoch it is read in.

    A leaf with target t and n tokens reads t div n whole epochs and the beginning of one more;
    the last row of that beginning may be taken in part (tokens_taken < tokens). ``size`` gives
    the tokens of a row (null: 0); rows without tokens come along where their place falls inside
    the budget. A null in the path is a node of its own, the empty name. Repeated rows count
    each. If the table is empty, or has no tokens, nothing is chosen. Result columns named like
    columns of ``docs`` replace them.
    """
    names = [f"_p{i}" for i in range(len(path))]
    carried = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")
    rows = docs.select(carried, *[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(n) for c, n in zip(path, names)], F.coalesce(size, F.lit(0)).cast("long").alias("_tokens"), F.col(id_col).alias("_id"))
    leaves = rows.groupBy(*names).agg(F.count(F.lit(1)).alias("rows"), F.sum("_tokens").alias("tokens"))
    plan = budgets(leaves, names, weights, budget, epochs).where("target > 0").select(
        *names, F.expr("target div tokens").alias("_whole"), F.expr("target % tokens").alias("_rest"), F.ceil(F.col("rows") / SLICE_ROWS).cast("long").alias("_slices"))
    planned = sized_side(plan)
    order = F.xxhash64(F.lit(seed), F.col("_whole"), F.col("_id"))
    rows = rows.join(planned, names).withColumn("_order", order).withColumn("_slice", F.expr("pmod(_order, _slices)"))

    # the slice in which each budget ends
    along = Window.partitionBy(*names).orderBy("_slice")
    sums = rows.where("_rest > 0").groupBy(*names, "_slice").agg(F.sum("_tokens").alias("_sum"), F.first("_rest").alias("_rest"))
    ends = sums.withColumn("_upto", F.sum("_sum").over(along)).where("_upto >= _rest")
    cut = ends.groupBy(*names).agg(F.min("_slice").alias("_cut"), F.min_by(F.col("_upto") - F.col("_sum"), "_slice").alias("_base"))
    rows = rows.join(sized_side(cut), names, "left")
    inside = Window.partitionBy(*names).orderBy("_order", "_id", F.xxhash64("_row.*")).rowsBetween(Window.unboundedPreceding, -1)
    edge = rows.where("_slice = _cut").withColumn("_start", F.col("_base") + F.coalesce(F.sum("_tokens").over(inside), F.lit(0)))
    whole = rows.where("_cut is null or _slice != _cut").withColumn("_start", F.expr("if(_slice < _cut, 0L, _rest)"))
    both = whole.unionByName(edge)
    last = F.when(F.col("_start") < F.col("_rest"), F.when(F.col("_slice") == F.col("_cut"), F.least(F.col("_tokens"), F.col("_rest") - F.col("_start"))).otherwise(F.col("_tokens")))
    reads = F.expr("concat(if(_whole > 0, transform(sequence(0L, greatest(_whole, 1L) - 1), e -> named_struct('epoch', e, 'taken', _tokens)), array()), if(_last is null, array(), array(named_struct('epoch', _whole, 'taken', _last))))")
    chosen = both.withColumn("_last", last).withColumn("_read", F.explode(reads))
    own = [F.col("_row")[c].alias(c) for c in docs.columns if c not in ("epoch", "tokens", "tokens_taken")]
    return chosen.select(*own, F.col("_read.epoch").alias("epoch"), F.col("_tokens").alias("tokens"), F.col("_read.taken").alias("tokens_taken"))
