"""Safety, mission and final scores of every cell for every mission, and the science value map.

A mission names the region it asks for, so missions meet cells by an equi-join on the region; the mission side is small
and its size is the planner's to check. Only the flat-ground box depends on the rover: it runs before missions join, carries
the cell's other layers along, and the join with the missions needs no further shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from selenogrid.functions.numeric import clip, or_one, truth, zero_if_null
from selenogrid.operators import neighbourhood as nb
from selenogrid.operators.distance import distance_to_mask
from selenogrid.operators.grid import GEOMETRY, box_shares
from selenogrid.operators.mobility import mobility_risk, terrain_softness
from selenogrid.operators.quantiles import attach
from selenogrid.session import write_table

# fixed values of the scoring model
WEIGHTS = (0.35, 0.25, 0.20, 0.05, 0.15)
WEIGHTS_WITH_MOBILITY = (0.33, 0.23, 0.18, 0.05, 0.11, 0.10)
SHADOW_REACH_M = 5000.0
SHADOW_BUFFER_M = 2000.0
EXPERIMENTS = ["volatile_detection", "mineralogy", "thermal_environment", "geomorphology", "space_weathering"]

def passable(max_slope: Column) -> Column:
    return F.col("elevation").isNotNull() & truth(F.col("slope") <= max_slope)


def in_shadow() -> Column:
    """Real shadow layer where the region has one, else the lowest 15 % of the terrain."""
    return F.when(F.col("has_psr"), truth(F.col("psr") >= 0.5)).otherwise(
        nb.filled("elevation") <= F.col("elevation_p15")
    )


def mission_layers(cells: DataFrame, resolution_m: float, radii: list[int], sunlight: str = "illumination") -> DataFrame:
    """All mission-independent layers of scoring, science, clustering and classification.

    ``radii`` are the flat-ground radii (in cells) that missions ask for; prominence depends on them. ``sunlight`` names
    the column used as sunlight where the region has one.
    """
    work = cells.withColumn("sunlight", F.col(sunlight))
    known = nb.facts(work)
    # only what the stencils read travels through their shuffle; the rest joins afterwards
    work = attach(work, known.select("region", *nb.MEANS)).withColumn("in_shadow", in_shadow())
    work = distance_to_mask(work, F.col("in_shadow"), "shadow_m")
    layers = [
        nb.roughness_variety(), nb.gradient("grad_elev", nb.filled("elevation")),
        nb.gradient("grad_slope", F.col("slope")), nb.illumination_gradient(), nb.rim_multiplier(), nb.depression(),
        nb.sunlight_proxy(resolution_m), nb.elevation_zscore(), nb.contrast(), nb.mean_slope(), nb.relief_deviation(),
        *[nb.prominence(f"prom_{r}", max(2 * r + 1, 3)) for r in radii],
    ]
    work = attach(nb.derive(work, layers), known.drop(*nb.MEANS))
    return (
        work.withColumn("lat", nb.latitude())
        .withColumn("softness", terrain_softness())
        .withColumn("rough_z", nb.roughness_zscore())
    )


def flat_radius(missions: DataFrame, resolution_m: float) -> DataFrame:
    return missions.withColumn(
        "flat_px", F.greatest(F.lit(1), F.bround(F.col("min_flat_radius_m") / resolution_m)).cast("int")
    )


def edge_margin() -> Column:
    """0 within 2 % of the side (at least 10 cells) of the region's edge, else 1."""
    m = F.greatest(F.floor(F.col("height") * 0.02), F.lit(10))
    inside = F.col("row").between(m, F.col("height") - 1 - m) & F.col("col").between(m, F.col("width") - 1 - m)
    return F.when(inside, 1.0).otherwise(0.0)


def slope_score(max_slope: Column) -> Column:
    return zero_if_null(clip(1.0 / (1.0 + F.exp(8.0 * (F.col("slope") / max_slope - 0.75))), 0.0, 1.0))


def roughness_score(wheel_radius: Column) -> Column:
    return zero_if_null(F.exp(-F.col("roughness") / F.greatest(wheel_radius * 20.0, F.lit(0.1))))


def quality_score() -> Column:
    share = zero_if_null(clip(F.col("quality") / or_one(F.col("quality_max")), 0.0, 1.0))
    return F.when(F.col("has_quality"), share).otherwise(1.0)


def safety_score(parts: list[Column], weights: tuple[float, ...], ok: Column) -> Column:
    """Weighted parts times the rim multiplier; 0 where the rover cannot stand."""
    total = sum((w * p for w, p in zip(weights[1:], parts[1:], strict=True)), weights[0] * parts[0])
    return F.when(ok, total * F.col("rim_mult")).otherwise(0.0)


def shadow_proximity() -> Column:
    return F.coalesce(clip(1.0 - F.col("shadow_m") / SHADOW_REACH_M, 0.0, 1.0), F.lit(0.0))


def latitude_score() -> Column:
    return clip((-82.0 - F.col("lat")) / 6.0, 0.0, 1.0)


def shadow_penalty(intent: Column, power: Column) -> Column:
    dark = F.col("in_shadow")
    near = truth(F.col("shadow_m") < SHADOW_BUFFER_M)
    avoid = F.when(dark, 0.0).when(near, 0.3).otherwise(1.0)
    rim = F.when(dark, F.when(power == "solar", 0.1).otherwise(0.3)).otherwise(1.0)
    return F.when(intent == "enter", 1.0).when(intent == "avoid", avoid).otherwise(rim)


def water_ice_score(intent: Column, power: Column) -> Column:
    psr = shadow_proximity() * shadow_penalty(intent, power)
    sun = F.when(F.col("has_sunlight"), zero_if_null(F.col("sunlight"))).otherwise(F.col("sun_proxy"))
    w_psr, w_sun = F.when(power == "solar", 0.25).otherwise(0.50), F.when(power == "solar", 0.45).otherwise(0.20)
    return 0.30 * latitude_score() + w_psr * psr + w_sun * sun


def geological_score() -> Column:
    away = F.col("lat") - F.col("lat_p50")
    return (0.40 * F.col("rough_var") + 0.35 * F.col("grad_elev") + 0.25 * F.exp(-(away * away) / 4.5)) * edge_margin()


def _span(lo: str, hi: str) -> Column:
    return clip((nb.filled("elevation") - F.col(lo)) / F.greatest(F.col(hi) - F.col(lo), F.lit(1.0)), 0.0, 1.0)


def atmospheric_score() -> Column:
    high, ridge = _span("elevation_p5", "elevation_p95"), _span("elevation_p50", "elevation_p95")
    lit = F.when(F.col("has_sunlight"), zero_if_null(F.col("sunlight"))).otherwise(high)
    with_sky = 0.6 * zero_if_null(F.col("sky_visibility")) + 0.4 * lit
    return F.when(F.col("has_sky_visibility"), with_sky).otherwise(0.5 * ridge + 0.5 * high)


def mission_score(mission_type: Column, intent: Column, power: Column) -> Column:
    base = (
        F.when(mission_type == "water_ice", water_ice_score(intent, power))
        .when(mission_type == "geological", geological_score())
        .otherwise(atmospheric_score())
    )
    with_earth = clip(base + 0.1 * zero_if_null(F.col("earth_visibility")), 0.0, 1.0)
    bonus = F.when(F.col("has_earth_visibility"), with_earth).otherwise(base)
    return F.when(F.col("elevation").isNotNull(), zero_if_null(bonus)).otherwise(0.0)


def blend(safety: Column, mission: Column, priority: Column) -> Column:
    """Two fixed weightings, safety first below priority 0.5; 0 where safety is 0."""
    mixed = F.when(priority < 0.5, 0.7 * safety + 0.3 * mission).otherwise(0.4 * safety + 0.6 * mission)
    return F.when(safety == 0, 0.0).otherwise(mixed)


def final_score() -> Column:
    """Blend, and 0 for solar rovers inside a real shadow layer."""
    dark = (F.col("power_source") == "solar") & F.col("has_psr") & truth(F.col("psr") >= 0.5)
    return F.when(dark, 0.0).otherwise(blend(F.col("safety"), F.col("mission"), F.col("priority")))


MISSION_COLUMNS = [
    "mission_id", "region", "mission_type", "power_source", "psr_intent", "max_slope_deg", "flat_px", "wheel_radius_m",
    "wheel_width_m", "rover_mass_kg", "n_wheels", "priority", "science_experiments",
]
SCORE_COLUMNS = ["mission_id", "region", "row", "col", *GEOMETRY, "elevation", "slope", "roughness"]


def _flat_ground(layers: DataFrame, asked: DataFrame) -> DataFrame:
    """``(region, row, col, _flats)``: flat-ground scores of a cell, in the order of the pairs of slope limit and radius that missions of its
    region ask for. Half of the square passable is a full score. Only the slope travels."""
    slope = F.when(F.col("elevation").isNotNull(), F.col("slope"))
    shares = box_shares(layers, slope, asked, "_shares")
    return shares.select("region", "row", "col", F.transform("_shares", lambda s: clip(s / 0.5, 0.0, 1.0)).alias("_flats"))


def mission_cells(layers: DataFrame, missions: DataFrame, radii: list[int], only: DataFrame | None = None) -> DataFrame:
    """Every cell of the region a mission asks for, with the flat-ground and prominence scores at its own radius.

    Flat ground depends on the slope limit and the radius only: it is counted for the pairs asked for, and a cell takes its few scores
    along, so wide cells are shuffled once for all missions. Where ``only`` names cells by region, row and col, flat ground is still
    counted from all of them, but no others meet missions.
    """
    key = ["region", "row", "col"]
    wanted = layers if only is None else layers.join(only.select(*key).distinct(), key, "left_semi")
    place = F.dense_rank().over(Window.partitionBy("region").orderBy("max_slope_deg", "flat_px"))
    placed = missions.select(*MISSION_COLUMNS, place.alias("_place"))
    asked = placed.select("region", F.col("_place").alias("place"), F.col("max_slope_deg").alias("limit"), F.col("flat_px").alias("radius")).distinct()
    work = wanted.join(_flat_ground(layers, asked), key)
    proms = F.array(*[F.col(f"prom_{r}") for r in radii])
    work = work.select(*[c for c in work.columns if not c.startswith("prom_")], proms.alias("_proms"))
    nth = F.coalesce(*[F.when(F.col("flat_px") == r, F.lit(i + 1)) for i, r in enumerate(radii)])
    work = work.join(placed.withColumn("_pr", nth), "region")
    return work.withColumn("flat_sub", F.element_at("_flats", F.col("_place"))).withColumn(
        "prom_sub", F.element_at("_proms", F.col("_pr"))).drop("_flats", "_proms", "_pr", "_place")


def sub_scores(work: DataFrame) -> DataFrame:
    return (
        work.withColumn("passable", passable(F.col("max_slope_deg")))
        .withColumn("slope_sub", slope_score(F.col("max_slope_deg")))
        .withColumn("rough_sub", roughness_score(F.col("wheel_radius_m")))
        .withColumn("qual_sub", quality_score())
        .withColumn("mobility_risk", mobility_risk())
    )


def score_terrain(
    layers: DataFrame, missions: DataFrame, radii: list[int], with_mobility: bool = True, keep: list[str] | None = None,
    only: DataFrame | None = None,
) -> DataFrame:
    """Safety, mission and final score of every (mission, cell), or of the cells in ``only``, in one shuffle after the layers."""
    work = sub_scores(mission_cells(layers, missions, radii, only))
    parts = [F.col(c) for c in ("slope_sub", "rough_sub", "qual_sub", "flat_sub", "prom_sub")]
    if with_mobility:
        parts.append(clip(1.0 - F.col("mobility_risk"), 0.0, 1.0))
    weights = WEIGHTS_WITH_MOBILITY if with_mobility else WEIGHTS
    work = work.withColumn("safety", safety_score(parts, weights, F.col("passable"))).withColumn(
        "mission", mission_score(F.col("mission_type"), F.col("psr_intent"), F.col("power_source"))
    )
    work = work.withColumn("final", final_score()).withColumn("science", science_value())
    return work.select(*SCORE_COLUMNS, "passable", "mobility_risk", *(keep or []), "safety", "mission", "final", "science")


def once(scores: DataFrame, *columns: str) -> DataFrame:
    """These columns, the last of them made once for each row: a later filter on it would have its whole expression written out twice, in a
    method too long to compile. It stays above the generator."""
    *kept, value = columns
    return scores.select(*kept, F.explode(F.array(value)).alias(value))


def standing(layers: DataFrame, missions: DataFrame) -> DataFrame:
    """Where each rover can stand, with the risk and the science there, as among the scores: what routes ask of them. Flat ground is not counted."""
    work = layers.join(missions.select(*MISSION_COLUMNS), "region")
    return work.select("mission_id", "region", "row", "col", "resolution_m", "slope", passable(F.col("max_slope_deg")).alias("passable"),
                       mobility_risk().alias("mobility_risk"), science_value().alias("science"))


# --- science value ---------------------------------------------------------------------------------------------------


def science_proximity() -> Column:
    return 0.6 * shadow_proximity() + 0.4 * latitude_score()


def volatile_value() -> Column:
    cold = F.coalesce(F.col("coltemp"), F.lit(1.0))
    near = science_proximity()
    return F.when(F.col("has_coltemp"), 0.6 * (1.0 - cold) + 0.4 * near).otherwise(near)


def mineral_value() -> Column:
    return F.when(F.col("any_minirf_cpr"), zero_if_null(F.col("minirf_cpr"))).otherwise(F.col("grad_elev"))


def thermal_value() -> Column:
    near = science_proximity()
    return F.when(F.col("any_illumination"), F.col("grad_illum")).otherwise(clip(near * (1.0 - near) * 4.0, 0.0, 1.0))


def landform_value() -> Column:
    return F.when(F.col("any_mas_560m"), 0.6 * F.col("mas_560m") + 0.4 * (1.0 - F.col("hurst"))).otherwise(
        F.col("rough_var")
    )


def weathering_value() -> Column:
    steep = clip(F.coalesce(F.col("slope"), F.col("slope_mean")) / 35.0, 0.0, 1.0)
    return F.when(F.col("any_freshness"), 0.5 * F.col("freshness") + 0.5 * (1.0 - F.col("hurst"))).otherwise(
        0.5 * F.col("rough_var") + 0.5 * steep
    )


def science_parts() -> dict[str, Column]:
    values = [volatile_value(), mineral_value(), thermal_value(), landform_value(), weathering_value()]
    return {name: zero_if_null(v) for name, v in zip(EXPERIMENTS, values, strict=True)}


def science_value() -> Column:
    """Best of the chosen experiments; 0 when none is chosen."""
    chosen = [
        F.when(F.array_contains("science_experiments", name), F.greatest(F.lit(0.0), v))
        for name, v in science_parts().items()
    ]
    return F.coalesce(F.greatest(*chosen), F.lit(0.0))


# --- proxy mode and sunlight ------------------------------------------------------------------------------------------

ANCILLARY = ["psr", "illumination", "sky_visibility", "earth_visibility", "quality", "crater_density", "coltemp"]
ZEROED = ["minirf_cpr", "mas_57m", "mas_225m", "mas_560m", "hurst", "ldsm_err", "freshness", "spectral_slope"]


def without_ancillary(cells: DataFrame) -> DataFrame:
    """Cells as a region without any co-registered layer would hold them."""
    out = cells
    for name in ANCILLARY:
        out = out.withColumn(name, F.lit(None).cast("double"))
    for name in ZEROED:
        out = out.withColumn(name, F.lit(0.0))
    return out


def radii_of(missions: DataFrame) -> list[int]:
    """Distinct flat-ground radii in cells; valid missions allow 50 to 2000 m, so the list is short."""
    return sorted(r[0] for r in missions.select("flat_px").distinct().collect())


def stored_layers(cells: DataFrame, resolution_m: float, radii: list[int]) -> DataFrame:
    return write_table(mission_layers(cells, resolution_m, radii), "layers")
