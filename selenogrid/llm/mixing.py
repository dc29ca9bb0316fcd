"""Mixing sources to target weights: budgets that go down a tree of domains, languages and sources.

A node's budget is shared among its children by weight. A child cannot take more than its tokens times the epochs
allowed; what it cannot take goes to its siblings by their weights, and a shortage leaves the parent only when all its
children are full, because a parent's own limit is the sum of its children's. A leaf takes its documents for as many
whole epochs as its budget holds, and of one more epoch, in a seeded order of its own, the first documents that fit.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from selenogrid.llm.base import spread, word_count
from selenogrid.session import write_table

LEVELS = ("domain", "lang", "source")
#: Ranges of the seeded order in which tokens are summed; documents are looked at singly in one range of each leaf.
RANGES = 4096


def _joined(a: DataFrame, b: DataFrame, names: Sequence[str], how: str = "inner") -> DataFrame:
    """Join on names of which any may be null; the columns of ``a`` stay."""
    other = b.select(*[F.col(c).alias(f"_r_{c}") if c in names else F.col(c) for c in b.columns])
    on = F.lit(True)
    for c in names:
        on = on & F.col(c).eqNullSafe(F.col(f"_r_{c}"))
    return a.join(other, on, how).drop(*[f"_r_{c}" for c in names])


def weight_of(name: str, weights: Mapping[str, float], default: float = 1.0) -> Column:
    out = F.lit(default)
    for value, w in weights.items():
        out = F.when(F.col(name) == value, float(w)).otherwise(out)
    return out


def budgets(leaves: DataFrame, levels: Sequence[str], weights: Mapping[str, Mapping[str, float]], share: float, epochs: int) -> DataFrame:
    """``leaves`` (the levels, n_docs, tokens) with ``budget``, whole tokens.

    The whole budget is ``share`` of all tokens. ``weights`` gives weights among siblings by level and value, 1 where it
    names none; a child of weight 0 gets nothing.
    """
    level = leaves.withColumn("room", F.col("tokens").cast("double") * epochs)
    given = leaves.agg((F.sum("tokens") * share).alias("given"))
    for depth, name in enumerate(levels):
        path = list(levels[: depth + 1])
        up = path[:-1]
        nodes = level.groupBy(*path).agg(F.sum("room").alias("room"))
        nodes = _joined(nodes, given, up) if up else nodes.crossJoin(given)  # one row at the root
        nodes = nodes.withColumn("weight", weight_of(name, weights.get(name, {})))
        nodes = nodes.withColumn("fills_at", F.when(F.col("weight") > 0, F.col("room") / F.col("weight")).otherwise(float("inf")))
        by = Window.partitionBy(*up)
        first = by.orderBy("fills_at", F.col(name).asc_nulls_first())
        before = F.coalesce(F.sum(F.when(F.col("weight") > 0, F.col("room"))).over(first.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
        onward = F.sum("weight").over(first.rowsBetween(Window.currentRow, Window.unboundedFollowing))
        nodes = nodes.withColumn("rate", F.when(F.col("weight") > 0, (F.col("given") - before) / onward))
        nodes = nodes.withColumn("open", F.col("fills_at") > F.col("rate"))
        level_rate = F.max(F.when(F.col("open"), F.col("rate"))).over(by)
        share_ = F.when(F.col("weight") <= 0, 0.0).when(F.col("open"), F.col("weight") * level_rate).otherwise(F.col("room"))
        given = nodes.select(*path, share_.alias("given"))
    out = _joined(leaves, given, list(levels))
    return out.select(*leaves.columns, F.floor(F.col("given") + 1e-6).cast("long").alias("budget"))


def plan(docs: DataFrame, levels: Sequence[str], weights: Mapping[str, Mapping[str, float]], share: float, epochs: int, seed: int,
         text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row a leaf: the levels, n_docs, tokens, budget, ``whole`` epochs, and the last place (``last_h``, ``last_id``) of the
    further epoch that is taken; null where none is.

    A null level is a value of its own, at its weight of 1; a null text has no tokens and a null id counts as ''. Repeated rows count
    each and are taken or left together, as are different rows of one id: they have one place in the order, so a budget is
    undershot rather than split between them. A leaf without tokens has no budget. An empty table gives no rows.
    """
    rows = write_table(docs.select(*levels, F.col(doc_id).alias("id"), word_count(text).alias("n_tokens")), "mix-tokens")
    leaves = rows.groupBy(*levels).agg(F.count(F.lit(1)).alias("n_docs"), F.sum("n_tokens").alias("tokens"))
    leaves = budgets(write_table(leaves, "mix-leaves"), levels, weights, share, epochs)
    whole = F.when(F.col("tokens") > 0, F.expr("budget div tokens")).otherwise(0).cast("long")
    leaves = write_table(leaves.withColumn("whole", whole).withColumn("rest", F.col("budget") - F.col("whole") * F.col("tokens")), "mix-budgets")
    rows = _joined(rows, leaves.filter("rest > 0").select(*levels, "whole", "rest"), levels)
    rows = rows.withColumn("h", spread(seed, "whole", "id")).withColumn("range", F.shiftright("h", 48).cast("int"))
    rows = write_table(rows, "mix-order")
    sums = rows.groupBy(*levels, "range").agg(F.sum("n_tokens").alias("n"), F.min("rest").alias("rest"))
    upto = F.sum("n").over(Window.partitionBy(*levels).orderBy("range").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    sums = sums.withColumn("upto", upto).withColumn("before", F.col("upto") - F.col("n"))
    edge = sums.filter("before <= rest and upto > rest")
    edge = edge.groupBy(*levels).agg(F.min("range").alias("range"), F.min_by("before", "range").alias("before"))
    near = _joined(rows, edge, [*levels, "range"])
    order = Window.partitionBy(*levels).orderBy("h", "id").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    near = near.withColumn("so_far", F.col("before") + F.sum("n_tokens").over(order)).filter("so_far <= rest")
    last = near.groupBy(*levels).agg(F.max(F.struct("h", "id")).alias("last"))
    inside = _joined(rows.select(*levels, "range", "h", "id"), edge.select(*levels, F.col("range").alias("edge")), levels, "left")
    below = inside.filter("edge is null or range < edge").groupBy(*levels).agg(F.max(F.struct("h", "id")).alias("last"))
    last = last.unionByName(below).groupBy(*levels).agg(F.max("last").alias("last"))
    out = _joined(leaves, last, levels, "left")
    return out.select(*levels, "n_docs", "tokens", "budget", "whole", F.col("last.h").alias("last_h"), F.col("last.id").alias("last_id"))


def mix(docs: DataFrame, leaves: DataFrame, levels: Sequence[str], seed: int, doc_id: str = "doc_id") -> DataFrame:
    """The documents of the mixture, once for every epoch that takes them, with ``epoch`` (from 0). Texts are not shuffled
    unless the table of leaves is too large for the planner to broadcast.

    Rows keep all their columns, whatever their names but ``epoch``; repeated rows are repeated. Documents of a leaf that ``leaves`` does
    not name are left out, and so is all of a leaf whose budget is 0. An empty table gives no rows.
    """
    whole = docs.select(F.struct(*docs.columns).alias("_doc"), *levels, F.col(doc_id).alias("_id"))
    rows = _joined(whole, write_table(leaves, "mix-plan"), levels)
    h = spread(seed, "whole", "_id")
    after = F.coalesce((h < F.col("last_h")) | ((h == F.col("last_h")) & F.coalesce(F.col("_id") <= F.col("last_id"), F.col("_id").isNull())), F.lit(False))
    times = F.col("whole").cast("int") + after.cast("int")
    rows = rows.withColumn("_times", times).filter("_times > 0")
    return rows.select("_doc", F.explode(F.sequence(F.lit(0), F.col("_times") - 1)).alias("epoch")).select("_doc.*", "epoch")
