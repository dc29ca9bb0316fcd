"""Sums, places and neighbours along an order within groups, for groups of any size.

A table is cut into ranges of its groups and their order, each about as large as a task should hold. What a range passes on to the next ones
is one row, so only those rows meet in one place; the rest is done range by range.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from selenogrid.session import settle, write_table

#: Rows that are put in order at once.
PART = 1_000_000


def running_sums(table: DataFrame, by: Sequence[str], order: Column, weight: str) -> DataFrame:
    """``table`` with ``upto``, the sum of ``weight`` over the rows of the group up to and with this one; ``order`` is unique within a group.

    The written table is cut into ranges of (``by``, ``order``) of about :data:`PART` rows, so a group of any size spreads over as many
    tasks as it needs. Sums of whole ranges are added up first, one row for each range of a group, and given to the rows.
    """
    by, (ranged, parts) = list(by), _ranges(table, by, [order])
    inner = Window.partitionBy(*by, *parts).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = ranged.withColumn("upto", F.sum(weight).over(inner))
    if not parts:
        return out
    before = _before(ranged.groupBy(*by, "_part").agg(F.sum(weight).alias("_t")), by)
    return out.join(before, [*by, "_part"]).withColumn("upto", F.col("upto") + F.col("_before")).drop("_part", "_before")


def positions(table: DataFrame, by: Sequence[str], order: Sequence[Column], out: str) -> DataFrame:
    """``table`` with ``out``, the place of each row within its group from 1; cut into ranges as in :func:`running_sums`."""
    by, (ranged, parts) = list(by), _ranges(table, by, order)
    numbered = ranged.withColumn(out, F.row_number().over(Window.partitionBy(*by, *parts).orderBy(*order)))
    if not parts:
        return numbered
    before = _before(ranged.groupBy(*by, "_part").agg(F.count(F.lit(1)).alias("_t")), by)
    return numbered.join(before, [*by, "_part"]).withColumn(out, (F.col(out) + F.col("_before")).cast("int")).drop("_part", "_before")


def carried(table: DataFrame, by: Sequence[str], order: Column, value: Column, out: str, ahead: bool = False) -> DataFrame:
    """``table`` with ``out``, the last ``value`` that is not NULL up to and with each row, or the first from it on where ``ahead``."""
    by, (ranged, parts) = list(by), _ranges(table, by, [order])
    inner = Window.partitionBy(*by, *parts).orderBy(order)
    if ahead:
        near = F.first(value, ignorenulls=True).over(inner.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    else:
        near = F.last(value, ignorenulls=True).over(inner.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    rows = ranged.withColumn(out, near)
    if not parts:
        return rows
    at = F.when(value.isNotNull(), order)
    ends = ranged.groupBy(*by, "_part").agg((F.min_by(value, at) if ahead else F.max_by(value, at)).alias("_e"))
    w = Window.partitionBy(*by).orderBy("_part")
    beyond = F.first("_e", ignorenulls=True).over(w.rowsBetween(1, Window.unboundedFollowing)) if ahead else F.last("_e", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    far = settle(ends.select(*by, "_part", beyond.alias("_far")))
    return rows.join(far, [*by, "_part"]).withColumn(out, F.coalesce(out, "_far")).drop("_part", "_far")


def _ranges(table: DataFrame, by: list[str], order: Sequence[Column]) -> tuple[DataFrame, list[str]]:
    n = -(-table.count() // PART)
    if n <= 1:
        return table, []
    return write_table(table.repartitionByRange(n, *by, *order).withColumn("_part", F.spark_partition_id()), "ranges"), ["_part"]


def _before(totals: DataFrame, by: list[str]) -> DataFrame:
    run = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    return settle(totals.select(*by, "_part", F.coalesce(F.sum("_t").over(run), F.lit(0)).alias("_before")))
