"""Spaced top sites, re-ranking, waypoints and goals."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from selenogrid.functions import geo
from selenogrid.functions.describe import fixed
from selenogrid.operators import neighbourhood as nb
from selenogrid.session import write_table


def candidates(scores: DataFrame, by: Sequence[str], score: str, min_sep: int) -> DataFrame:
    """Cells that equal the maximum of their neighbourhood and score above 0. Cells at 0 exceed none of these, so they stay behind."""
    narrow = scores.filter(F.col(score) > 0).select(*by, "height", "width", "row", "col", score)
    return nb.derive(narrow, [nb.local_maximum(score, min_sep)], by=by).filter("is_peak").select(*by, "row", "col", score)


def spaced_top(found: DataFrame, by: Sequence[str], score: str, n: int = 10, min_sep: float = 50.0) -> DataFrame:
    """Greedy by score (ties by row, column): take a candidate unless an accepted one is nearer than ``min_sep``.

    All groups go at once. With tiles as wide as the spacing, a candidate that is the best of its tile and of the eight around it is the best
    within reach, so the greedy walk takes it whatever happens elsewhere; a round accepts all of these and drops what is too near
    to them, and what comes after the ``n``-th accepted one of its group. The best one left is always accepted, so rounds end, and
    tiles only ever pass on their best.
    """
    by, side = list(by), max(1, math.ceil(min_sep))
    tile = [*by, "tr", "tc"]
    order = F.struct(F.col("s"), (-F.col("row")).alias("r"), (-F.col("col")).alias("c"))
    around = F.explode(F.array(*[F.struct(F.lit(dr).alias("r"), F.lit(dc).alias("c")) for dr in (-1, 0, 1) for dc in (-1, 0, 1)])).alias("m")
    moved = [(F.col("tr") + F.col("m.r")).alias("tr"), (F.col("tc") + F.col("m.c")).alias("tc")]
    other = {c: f"_{c}" for c in tile}
    same = reduce(lambda x, y: x & y, [F.col(c).eqNullSafe(F.col(o)) for c, o in other.items()])
    best_first = Window.partitionBy(*by).orderBy(F.desc("s"), "row", "col")
    left = write_table(found.select(*by, "row", "col", F.col(score).alias("s"), F.floor(F.col("row") / side).alias("tr"), F.floor(F.col("col") / side).alias("tc")), "candidates")
    taken = left.select(*by, "row", "col", "s").limit(0)
    while left.limit(1).count():
        best = left.groupBy(*tile).agg(F.max(order).alias("best"))
        top = best.select("*", around).select(*by, *moved, "best").groupBy(*tile).agg(F.max("best").alias("top"))
        now = best.join(top.withColumnsRenamed(other), same).filter("best = top")
        now = write_table(now.select(*tile, (-F.col("best.r")).alias("row"), (-F.col("best.c")).alias("col"), F.col("best.s").alias("s")), "accepted")
        ranked = taken.unionByName(now.select(*by, "row", "col", "s")).withColumn("k", F.row_number().over(best_first)).filter(F.col("k") <= n)
        ranked = write_table(ranked, "sites")
        taken = ranked.drop("k")
        near = now.select("*", around).select(*by, *moved, F.col("row").alias("n_row"), F.col("col").alias("n_col"))
        away = F.hypot(F.col("row") - F.col("n_row"), F.col("col") - F.col("n_col"))
        rest = left.join(near.withColumnsRenamed(other), same & ((away < min_sep) | (away == 0)), "left_anti")
        last = ranked.filter(F.col("k") == n).select(*by, order.alias("last"))
        left = write_table(rest.join(last, by, "left").filter(F.col("last").isNull() | (order > F.col("last"))).drop("last"), "candidates")
    return taken.select(*by, F.row_number().over(best_first).alias("rank"), "row", "col", F.col("s").alias(score))


def reasoning() -> Column:
    """One sentence: the first rule that matches."""
    lat, lon = fixed(F.col("lat"), 2), fixed(F.col("lon"), 2)
    where = F.concat(lat, F.lit("°S, "), lon, F.lit("°E."))
    s, m = fixed(F.col("safety"), 2), fixed(F.col("mission"), 2)
    kind = F.col("mission_type")
    return (
        F.when(F.col("safety") > 0.85, F.concat(
            F.lit("Exceptionally flat, low-roughness terrain (safety="), s, F.lit(") ideal for safe touchdown at "), where))
        .when((kind == "water_ice") & (F.col("lat") < -88.5), F.concat(
            F.lit("Near-polar location ("), lat,
            F.lit("°S) maximises access to permanently shadowed regions for ice prospecting (mission="), m, F.lit(").")))
        .when(kind == "geological", F.concat(
            F.lit("Diverse terrain with elevation transitions at "), lat,
            F.lit("°S offers high geological sampling value (mission="), m, F.lit(").")))
        .when((kind == "atmospheric") & (F.col("elevation") > 0), F.concat(
            F.lit("Elevated ridge at "), fixed(F.col("elevation"), 0),
            F.lit(" m provides extended sunlight exposure for power generation (mission="), m, F.lit(").")))
        .otherwise(F.concat(F.lit("Balanced safety ("), s, F.lit(") and science ("), m, F.lit(") score at "), where))
    )


def top_sites(
    scores: DataFrame, missions: DataFrame, n: int = 10, min_sep: int = 50, scores_at: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """Ranked sites of every mission with their layer values and the reason for choosing them.

    ``scores_at`` gives the scores of some cells alone; where it is given, ``scores`` is read once, for the final score.
    """
    by = ["mission_id", "region"]
    picked = spaced_top(candidates(scores, by, "final", min_sep), by, "final", n, float(min_sep))
    rows = picked.drop("final").join(scores_at(picked) if scores_at else scores, [*by, "row", "col"])
    lon, lat = geo.cell_to_lonlat(*[F.col(c) for c in ("row", "col", "resolution_m", "origin_x", "origin_y")])
    rows = rows.withColumn("lon", lon).withColumn("lat", lat)
    rows = rows.join(missions.select("mission_id", "mission_type"), "mission_id")
    return rows.select(*by, "mission_type", "rank", "row", "col", "lon", "lat", "elevation", "slope", "roughness",
                       "safety", "mission", "final", "science", reasoning().alias("reasoning"))


def with_sunlight(found: DataFrame, regions: DataFrame, cells: DataFrame, layer: str) -> DataFrame:
    """Sunlight at each site, through its coordinates. The cell that holds the point is read: rounding a centre
    coordinate would fall on a half and could move by one."""
    at = found.join(regions, "region")
    r, c = geo.lonlat_to_containing_cell(*[F.col(n) for n in ("lon", "lat", "resolution_m", "origin_x", "origin_y")])
    r, c, _ = geo.clamp_cell(r, c, F.col("height"), F.col("width"))
    keyed = at.select(*found.columns, r.alias("_r"), c.alias("_c"))
    light = cells.select("region", F.col("row").alias("_r"), F.col("col").alias("_c"),
                         F.round(layer, 3).alias("sunlight_fraction"))
    return keyed.join(light, ["region", "_r", "_c"], "left").drop("_r", "_c")


def rerank_by_class(sites: DataFrame, classes: DataFrame) -> DataFrame:
    """Science targets gain 0.1 (at most 1), hazard cells drop to 0, and ranks follow; ties keep their order.

    ``classes`` gives ``cls`` by region, row and col, and by mission where classes depend on the rover.
    """
    joined = sites.join(classes, [c for c in classes.columns if c != "cls"], "left")
    adjusted = (
        F.when(F.col("cls") == 4, F.least(F.lit(1.0), F.col("final") + 0.1)).when(F.col("cls") == 0, 0.0).otherwise(F.col("final"))
    )
    w = Window.partitionBy("mission_id", "region").orderBy(F.desc("adjusted"), "rank")
    return joined.withColumn("adjusted", adjusted).withColumn("new_rank", F.row_number().over(w))


def keep_requested(sites: DataFrame, missions: DataFrame) -> DataFrame:
    return sites.join(missions.select("mission_id", "n_results"), "mission_id").filter(
        F.col("rank") <= F.greatest(F.lit(1), F.col("n_results"))
    )


def within_reach(sites: DataFrame, max_dist: float) -> DataFrame:
    """Sites within range of the first site; the whole list where the filter would leave none."""
    w = Window.partitionBy("mission_id", "region")
    start = {c: F.max(F.when(F.col("rank") == 1, F.col(c))).over(w) for c in ("row", "col")}
    far = F.hypot(F.col("row") - start["row"], F.col("col") - start["col"])
    work = sites.withColumn("start_cells", far).withColumn("near", far <= max_dist)
    return work.withColumn("_n", F.sum(F.col("near").cast("int")).over(w)).filter("near OR _n = 0").drop("_n")


def _site_order() -> Column:
    """Best first for the mission: nearest the pole, roughest, or highest."""
    return (
        F.when(F.col("mission_type") == "water_ice", -F.col("lat"))
        .when(F.col("mission_type") == "geological", F.col("roughness"))
        .otherwise(F.col("elevation"))
    )


def science_rank(sites: DataFrame, missions: DataFrame) -> DataFrame:
    """Order of a mission's sites by 0.6 final + 0.4 science where it has experiments, else by rank."""
    work = sites.join(missions.select("mission_id", F.size("science_experiments").alias("_n")), "mission_id")
    blend = F.when(F.col("_n") > 0, 0.6 * F.col("final") + 0.4 * F.col("science"))
    w = Window.partitionBy("mission_id", "region").orderBy(F.desc("science_blend"), "rank")
    return work.withColumn("science_blend", blend).withColumn("science_rank", F.row_number().over(w)).drop("_n")


def waypoints(sites: DataFrame, anomalies: DataFrame, missions: DataFrame, n: int = 3) -> DataFrame:
    """Relevant anomalies by strength, then sites by the mission's rule, no cell twice, ``n`` for each mission."""
    # the mission's rule decides; the science order only breaks its ties
    rule = science_rank(sites, missions).select("mission_id", "region", "row", "col", F.lit(1).alias("source"),
                                                _site_order().alias("value"), F.col("science_rank").alias("tie"))
    relevant = (
        missions.select("mission_id", "region", "mission_type").join(anomalies, "region")
        .filter(F.array_contains("recommended_for", F.col("mission_type")))
        .select("mission_id", "region", "row", "col", F.lit(0).alias("source"), F.col("anomaly_strength").alias("value"),
                F.col("cluster").cast("int").alias("tie"))
    )
    have_sites = sites.select("mission_id", "region").distinct()
    both = rule.unionByName(relevant.join(have_sites, ["mission_id", "region"], "left_semi"))
    order = [F.asc("source"), F.desc("value"), F.asc("tie")]
    first = Window.partitionBy("mission_id", "region", "row", "col").orderBy(*order)
    pick = Window.partitionBy("mission_id", "region").orderBy(*order)
    # a site is skipped where an anomaly already stands; anomalies are kept as they come
    unique = both.withColumn("_k", F.row_number().over(first)).filter("source = 0 OR _k = 1").drop("_k")
    return unique.withColumn("waypoint", F.row_number().over(pick)).filter(F.col("waypoint") <= n).select(
        "mission_id", "region", "waypoint", "row", "col", "source"
    )


def goals(points: DataFrame, sites: DataFrame, targets: DataFrame) -> DataFrame:
    """Goals in the order they are tried: the user's target, waypoints, then sites 2 to 5; never the start itself."""
    start = sites.filter("rank = 1").select("mission_id", "region", F.col("row").alias("s_row"), F.col("col").alias("s_col"))
    tried = (
        targets.select("mission_id", "region", "row", "col", F.lit(0).alias("attempt"))
        .unionByName(points.select("mission_id", "region", "row", "col", F.col("waypoint").alias("attempt")))
        .unionByName(sites.filter(F.col("rank").between(2, 5)).select(
            "mission_id", "region", "row", "col", (F.col("rank") + 100).alias("attempt")))
    )
    return tried.join(start, ["mission_id", "region"]).filter(
        (F.col("row") != F.col("s_row")) | (F.col("col") != F.col("s_col"))
    )
