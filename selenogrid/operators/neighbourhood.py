"""Neighbourhood layers, each declared once and computed together from a single stencil pass."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from selenogrid.functions.geo import cell_to_lonlat
from selenogrid.functions.numeric import clip, or_one, truth, zero_if_null
from selenogrid.operators.grid import Box, Shift, difference, tiled
from selenogrid.operators.quantiles import attach, quantile_name, quantiles
from selenogrid.operators.terrain import deviation
from selenogrid.session import write_table

# fixed values of the scoring model
EXTREME_SLOPE_DEG = 35.0
RIM_RADIUS_CELLS = 8
RIM_TOP_BAND_M = 50.0
PROMINENCE_FULL_M = 200.0
DEPRESSION_FULL_M = 200.0
SUN_PROXY_RADIUS_M = 3000.0
SUN_PROXY_SPAN_M = 500.0


@dataclass(frozen=True)
class Layer:
    """A layer over stencil outputs: ``raw`` first, then ``finish(raw, scale)`` where ``scale`` is a regional quantile."""

    name: str
    raw: Column
    boxes: Sequence[Box] = ()
    shifts: Sequence[Shift] = ()
    scale_p: float | None = None
    finish: Callable[[Column, Column | None], Column] | None = None


def unit(x: Column, scale: Column) -> Column:
    return zero_if_null(clip(x / or_one(scale), 0.0, 1.0))


def filled(name: str) -> Column:
    """Nodata replaced by the regional mean (from :func:`facts`)."""
    return F.coalesce(F.col(name), F.col(f"{name}_mean"))


def magnitude(name: str, value: Column, spacing: Column | float = 1.0) -> Column:
    dx, dy = difference(name, value, spacing)
    return F.sqrt(dx * dx + dy * dy)


def gradient(out: str, value: Column) -> Layer:
    """Change per cell, over its 95th percentile."""
    return Layer(out, magnitude(f"_{out}", value), shifts=[Shift(f"_{out}", value)], scale_p=0.95, finish=unit)


def illumination_gradient() -> Layer:
    value = F.col("illumination")
    return Layer(
        "grad_illum", magnitude("_grad_illum", value, F.col("resolution_m")), shifts=[Shift("_grad_illum", value)],
        scale_p=0.95, finish=lambda x, s: zero_if_null(clip(x / F.greatest(F.coalesce(s, F.lit(1.0)), F.lit(1e-6)), 0.0, 1.0)),
    )


def roughness_variety(size: int = 20) -> Layer:
    """Local deviation of roughness; centring on the mean leaves it unchanged and keeps digits."""
    z = F.coalesce(F.col("roughness") - F.col("roughness_mean"), F.lit(0.0))
    boxes = [Box("_rv_m", "mean", z, size), Box("_rv_q", "mean", z * z, size)]
    return Layer("rough_var", deviation(F.col("_rv_q"), F.col("_rv_m")), boxes, scale_p=0.95, finish=unit)


def rim_multiplier() -> Layer:
    size = 2 * RIM_RADIUS_CELLS + 1
    near_wall = F.col("_rim_wall") > 0  # a count, so that the wide box costs two running sums
    on_top = truth(F.col("elevation") >= F.col("_rim_top") - RIM_TOP_BAND_M)
    return Layer(
        "rim_mult", F.when(near_wall, F.when(on_top, 0.85).otherwise(0.40)).otherwise(1.0),
        [
            Box("_rim_wall", "sum", truth(F.col("slope") >= EXTREME_SLOPE_DEG).cast("int"), size),
            Box("_rim_top", "max", F.coalesce(F.col("elevation"), F.lit(-1e9)), size),
        ],
    )


def prominence(out: str, size: int) -> Layer:
    z = zero_if_null(F.col("elevation"))
    value = clip((z - F.col(f"_{out}")) / PROMINENCE_FULL_M, 0.0, 1.0)
    return Layer(out, F.when(F.col("elevation").isNotNull(), value).otherwise(0.0), [Box(f"_{out}", "mean", z, size)])


def flat_fraction(out: str, passable: Column, radius: int) -> Layer:
    """Share of passable cells in the square of this radius; half of them is a full score."""
    share = F.col(f"_{out}") / float((2 * radius + 1) ** 2)
    return Layer(out, clip(share / 0.5, 0.0, 1.0), [Box(f"_{out}", "sum", passable.cast("int"), 2 * radius + 1)])


def depression(size: int = 5) -> Layer:
    z = zero_if_null(F.col("elevation"))
    return Layer("depression", clip(clip(F.col("_dep") - z, 0.0, None) / DEPRESSION_FULL_M, 0.0, 1.0),
                 [Box("_dep", "mean", z, size)])


def sunlight_proxy(resolution_m: float) -> Layer:
    size = 2 * max(3, int(SUN_PROXY_RADIUS_M / resolution_m)) + 1
    z = filled("elevation")
    value = clip((z - F.col("_psi")) / SUN_PROXY_SPAN_M + 0.5, 0.0, 1.0)
    return Layer("sun_proxy", F.when(F.col("elevation").isNull(), 0.0).otherwise(value), [Box("_psi", "mean", z, size)])


def elevation_zscore(size: int = 25) -> Layer:
    """Distance from the local mean in local deviations; nodata neighbours are left out, nodata cells score 0."""
    z = F.col("elevation") - F.col("elevation_mean")
    spread = deviation(F.col("_ez_q"), F.col("_ez_m")) + 1e-6
    return Layer("elev_z", zero_if_null(F.abs(z - F.col("_ez_m")) / spread),
                 [Box("_ez_m", "avg", z, size, "elevation"), Box("_ez_q", "avg", z * z, size, "elevation")])


def contrast(size: int = 5) -> Layer:
    """Local relief, over its 95th percentile, not bounded above."""
    relief = F.when(F.col("elevation").isNotNull(), F.col("_c_hi") - F.col("_c_lo"))
    return Layer(
        "contrast", relief,
        [Box("_c_hi", "max", F.col("elevation"), size), Box("_c_lo", "min", F.col("elevation"), size)],
        scale_p=0.95, finish=lambda x, s: zero_if_null(clip(x / or_one(s), 0.0, None)),
    )


def mean_slope(size: int = 3) -> Layer:
    return Layer("mean_slope", zero_if_null(F.col("_ms") / 90.0), [Box("_ms", "avg", F.col("slope"), size)])


def relief_deviation(size: int = 3) -> Layer:
    """Local deviation of elevation over the largest absolute elevation; nodata counts as 0 m."""
    z = zero_if_null(F.col("elevation"))
    return Layer("std_elev", deviation(F.col("_se_q"), F.col("_se_m")) / or_one(F.col("elevation_abs")),
                 [Box("_se_m", "mean", z, size), Box("_se_q", "mean", z * z, size)])


def local_maximum(score: str, size: int) -> Layer:
    top = F.col(f"_{score}_top")
    return Layer("is_peak", (F.col(score) == top) & (F.col(score) > 0), [Box(f"_{score}_top", "max", F.col(score), size)])


def roughness_zscore() -> Column:
    return zero_if_null(clip((F.col("roughness") - F.col("roughness_mean")) / (F.col("roughness_std") + 1e-6), 0.0, None))


MEANS = ["elevation_mean", "roughness_mean", "slope_mean", "elevation_abs", "elevation_p15", "has_psr"]


def facts(cells: DataFrame) -> DataFrame:
    """Everything the layers and scores need to know about a region as a whole, from one aggregate."""
    lat = latitude()
    spec = {
        "elevation": (F.col("elevation"), [0.05, 0.15, 0.5, 0.95]),
        "roughness": (F.col("roughness"), [0.95]),
        "lat": (lat, [0.5]),
    }
    aggs = {
        "elevation_mean": F.avg("elevation"), "roughness_mean": F.avg("roughness"), "slope_mean": F.avg("slope"),
        "roughness_std": F.stddev_pop("roughness"), "roughness_max": F.max("roughness"),
        "elevation_min": F.min("elevation"), "elevation_max": F.max("elevation"),
        "elevation_abs": F.max(F.abs("elevation")), "quality_max": F.max("quality"),
        **{f"has_{n}": F.count(n) > 0 for n in ("psr", "illumination", "sunlight", "sky_visibility", "earth_visibility",
                                                "crater_density", "quality", "coltemp")},
        **{f"any_{n}": F.coalesce(F.max(F.abs(n)) > 0, F.lit(False)) for n in
           ("minirf_cpr", "illumination", "mas_560m", "freshness", "ldsm_err")},
    }
    return quantiles(cells, spec, aggs=aggs)


def latitude() -> Column:
    """Latitude of a cell's upper-left corner, the convention of the score formulas."""
    return cell_to_lonlat(F.col("row"), F.col("col"), F.col("resolution_m"), F.col("origin_x"), F.col("origin_y"), 0.0)[1]


def derive(cells: DataFrame, layers: Sequence[Layer], by: Sequence[str] = ("region",), tile: int = 256) -> DataFrame:
    """Add the layers: one stencil for all of them, then one aggregate for all their scales."""
    work = tiled(
        cells, [b for la in layers for b in la.boxes], [s for la in layers for s in la.shifts], by=by, tile=tile
    )
    scaled = [la for la in layers if la.scale_p is not None]
    work = work.select(*cells.columns, *[la.raw.alias(la.name) for la in layers])
    if not scaled:
        return work
    # written, so that the scales read one column each instead of repeating the shuffle and its windows
    work = write_table(work, "stencil")
    spec = {f"_scale_{la.name}": (F.col(la.name), [la.scale_p]) for la in scaled}
    work = attach(work, quantiles(work, spec, by=by), by)
    final = {la.name: la.finish(F.col(la.name), F.col(quantile_name(f"_scale_{la.name}", la.scale_p))) for la in scaled}
    return work.select(
        *cells.columns, *[final[la.name].alias(la.name) if la.name in final else F.col(la.name) for la in layers]
    )
