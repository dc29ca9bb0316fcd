"""Per-region statistics, exact quantiles and ranks that never gather one region in one task."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from selenogrid.operators.ordered import running_sums
from selenogrid.session import settle, write_table

#: Inverse of the rank error of the sketches that bound the wanted ranks. Groups of fewer than 50 times as many rows are ranked whole.
ACCURACY = 10_000


def region_stats(df: DataFrame, aggs: Mapping[str, Column], by: Sequence[str] = ("region",)) -> DataFrame:
    """Partial aggregates first, then one row per group; settled so that its measured size steers the join."""
    return settle(df.groupBy(*by).agg(*[a.alias(n) for n, a in aggs.items()]))


def attach(df: DataFrame, stats: DataFrame, by: Sequence[str] = ("region",)) -> DataFrame:
    return df.join(stats, list(by), "left")


def quantile_name(name: str, p: float) -> str:
    return f"{name}_p{p * 100:g}".replace(".", "_")


def quantiles(
    df: DataFrame,
    spec: Mapping[str, tuple[Column, Sequence[float]]],
    by: Sequence[str] = ("region",),
    aggs: Mapping[str, Column] | None = None,
    accuracy: int = ACCURACY,
) -> DataFrame:
    """Exact quantiles (linear interpolation, nodata skipped): one row per group, columns ``name_pNN``.

    ``spec`` maps a name to its column and probabilities; ``aggs`` adds plain aggregates of the group. Groups without any value
    have a row only if ``aggs`` are asked for.

    ``df`` should be a written table. A first scan counts. Groups of fewer than 50 x ``accuracy`` rows, of which there may be many, are ranked
    whole: one shuffle of the bare values, no sketch. Larger ones are scanned twice more. A sketch of every column, whose rank error is
    bounded, gives two values that enclose each wanted rank. Then rows are counted, by value, between such two values, and all rows below
    them as one; both scans combine before they shuffle, so a value that most rows hold costs one row a task. What is left, about
    6 / ``accuracy`` of the rows for each rank, is put in order.
    """
    by, names = list(by), list(spec)
    slots = [(i, n, float(p)) for i, n in enumerate(names) for p in spec[n][1]]
    values = {n: c.cast("double") for n, (c, _) in spec.items()}
    whole = 50 * accuracy
    sizes = {f"_n{i}": F.count(values[n]) for i, n in enumerate(names)}
    bounds = settle(df.groupBy(*by).agg(*[a.alias(n) for n, a in {**sizes, **(aggs or {})}.items()]))
    big = F.greatest(*[F.col(c) for c in sizes], F.lit(0)) >= whole
    large = bounds.filter(big)
    if large.limit(1).count():
        ends = _ranked(df.join(large.select(*by), by, "left_anti"), bounds.filter(~big), slots, values, by).unionByName(
            _enclosed(df.join(large.select(*by), by, "left_semi"), large, slots, values, by, accuracy))
    else:
        ends = _ranked(df, bounds, slots, values, by)
    ends = ends.withColumn("q", F.col("a") + (F.col("b") - F.col("a")) * (F.col("pos") - F.floor("pos")))
    out = [F.max(F.when(F.col("want") == slot, F.col("q"))).alias(quantile_name(n, p)) for slot, (_, n, p) in enumerate(slots)]
    found = ends.groupBy(*by).agg(*out)
    if aggs:
        found = bounds.select(*by, *aggs).join(found, by, "left")
    return settle(found)


def _asked(sizes: DataFrame, slots: list, by: list[str], slot_of: Callable[[int, int], Column]) -> DataFrame:
    """``(by, slot, want, pos)``: the positions, counted from 0, that each group is asked for, and the slot where its values are."""
    wanted = F.explode(F.array(*[
        F.struct(slot_of(i, slot).alias("slot"), F.lit(slot).alias("want"), ((F.col(f"_n{i}") - 1) * p).alias("pos")) for slot, (i, _, p) in enumerate(slots)]))
    return sizes.select(*by, wanted.alias("w")).select(*by, "w.slot", "w.want", "w.pos").filter("pos >= 0")


def _ranked(df: DataFrame, sizes: DataFrame, slots: list, values: dict[str, Column], by: list[str]) -> DataFrame:
    """``(by, want, pos, a, b)`` of small groups: the values on either side of each position, from the group's own order."""
    marks = [F.struct(F.lit(i).alias("slot"), v.alias("v")) for i, v in enumerate(values.values())]
    rows = df.select(*by, F.explode(F.array(*marks)).alias("m")).select(*by, "m.slot", "m.v").filter("v IS NOT NULL")
    placed = rows.withColumn("place", F.row_number().over(Window.partitionBy(*by, "slot").orderBy("v")) - 1)
    asked = _asked(sizes, slots, by, lambda i, _: F.lit(i))
    hit = asked.join(placed, [*by, "slot"]).filter((F.col("place") >= F.floor("pos")) & (F.col("place") <= F.ceil("pos")))
    return hit.groupBy(*by, "want", "pos").agg(F.min("v").alias("a"), F.max("v").alias("b"))


def _enclosed(df: DataFrame, sizes: DataFrame, slots: list, values: dict[str, Column], by: list[str], accuracy: int) -> DataFrame:
    """The same of large groups, of which only the rows near each wanted rank are put in order."""
    slack, whole, sketch = 3.0 / accuracy, 50 * accuracy, {}
    for i, (n, v) in enumerate(values.items()):
        ends = [e for j, _, p in slots if j == i for e in (max(0.0, p - slack), min(1.0, p + slack))]
        sketch[f"_e{i}"] = F.percentile_approx(v, ends, accuracy)
    sketched = settle(df.groupBy(*by).agg(*[a.alias(n) for n, a in sketch.items()]).join(sizes.select(*by, *[f"_n{i}" for i in range(len(values))]), by))
    marks, nth = [], {}
    for slot, (i, n, _) in enumerate(slots):
        j = nth[i] = nth.get(i, -1) + 1
        v, small = values[n], F.col(f"_n{i}") < whole
        low, high = F.col(f"_e{i}")[2 * j], F.col(f"_e{i}")[2 * j + 1]
        mark = F.struct(F.lit(slot).alias("slot"), F.when(small | (v >= low), v).alias("v"))
        # a column with few values is ranked whole, once, under its first slot
        all_ = small & v.isNotNull() if j == 0 else F.lit(False)
        marks.append(F.when(all_ | (~small & (v <= high)), mark))
    rows = df.join(sketched, by)
    seen = rows.select(*by, F.explode(F.array(*marks)).alias("m")).filter("m IS NOT NULL")
    counts = write_table(seen.groupBy(*by, "m.slot", "m.v").agg(F.count(F.lit(1)).alias("k")), "quantile-values")
    placed = running_sums(counts, [*by, "slot"], F.col("v"), "k")
    first = {i: min(s for s, x in enumerate(slots) if x[0] == i) for i, _, _ in slots}
    asked = _asked(sketched, slots, by, lambda i, slot: F.when(F.col(f"_n{i}") < whole, first[i]).otherwise(slot))
    # the two rows on either side of the position, counted from 0
    hit = asked.join(placed, [*by, "slot"]).filter((F.col("upto") > F.floor("pos")) & (F.col("upto") - F.col("k") <= F.ceil("pos")))
    return hit.groupBy(*by, "want", "pos").agg(F.min("v").alias("a"), F.max("v").alias("b"))


def running_counts(df: DataFrame, value: Column, by: Sequence[str], weight: Column | None = None) -> DataFrame:
    """``(by, v, k, upto)``: rows per distinct value and rows with a value not above it; with ``weight``, sums of it instead.

    Values are counted before they are put in order, so a value that most rows hold is one row.
    """
    one = F.lit(1) if weight is None else weight
    base = df.select(*by, value.cast("double").alias("v"), one.cast("long").alias("w")).filter(F.col("v").isNotNull())
    return running_sums(write_table(base.groupBy(*by, "v").agg(F.sum("w").alias("k")), "values"), by, F.col("v"), "k")


def average_ranks(df: DataFrame, value: str, out: str, by: Sequence[str]) -> DataFrame:
    """Tie-averaged rank of ``value`` within ``by``, attached by an equi-join on the value."""
    ranks = running_counts(df, F.col(value), by).select(
        *by, F.col("v").alias(value), (F.col("upto") - (F.col("k") - 1) / 2.0).alias(out)
    )
    return df.join(ranks, [*by, value])


def ordered_index(df: DataFrame, by: Sequence[str], bucket: Column, order: Sequence[str], out: str) -> DataFrame:
    """Zero-based position of every row within ``by``; ``bucket`` must not decrease along the order.

    Rows are numbered inside a bucket and shifted by the counts of earlier buckets, so that a hot group spreads over as
    many tasks as it has buckets.
    """
    by = list(by)
    work = df.withColumn("_b", bucket)
    counts = work.groupBy(*by, "_b").agg(F.count(F.lit(1)).alias("_k"))
    run = Window.partitionBy(*by).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    shift = counts.select(*by, "_b", F.coalesce(F.sum("_k").over(run), F.lit(0)).alias("_before"))
    inner = Window.partitionBy(*by, "_b").orderBy(*order)
    numbered = work.withColumn("_i", F.row_number().over(inner)).join(shift, [*by, "_b"])
    return numbered.withColumn(out, (F.col("_before") + F.col("_i") - 1).cast("int")).drop("_b", "_i", "_before")
