"""Crater density grid from a point catalogue."""

from __future__ import annotations

from math import pi

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from selenogrid.functions import geo
from selenogrid.operators.grid import densify, stencil, Box
from selenogrid.operators.quantiles import attach, region_stats

SOUTH_CUT = -65.0
MIN_DIAMETER_KM = 0.1


def crater_cells(craters: DataFrame, grid: DataFrame) -> DataFrame:
    """Count and area-weighted sum (areas in cells) of craters in every cell of the grid that holds any."""
    kept = craters.filter((F.col("lat") <= SOUTH_CUT) & (F.col("diam_km") >= MIN_DIAMETER_KM)).join(grid, F.lit(True))
    r, c = geo.lonlat_to_containing_cell(*[F.col(n) for n in ("lon", "lat", "resolution_m", "origin_x", "origin_y")])
    radius = F.col("diam_km") * 500.0 / F.col("resolution_m")
    return (
        kept.withColumn("row", r).withColumn("col", c)
        .filter("row >= 0 AND row < height AND col >= 0 AND col < width")
        .groupBy("region", "row", "col")
        .agg(F.count(F.lit(1)).alias("n_craters"), F.sum(pi * radius * radius).alias("area"))
    )


def crater_density(craters: DataFrame, grid: DataFrame, size: int = 5) -> DataFrame:
    """Smoothed area density scaled to 0-255 (floor); all 0 where there are no craters."""
    dense = densify(crater_cells(craters, grid), grid).fillna({"area": 0.0, "n_craters": 0})
    smooth = stencil(dense, [Box("smooth", "mean", F.col("area"), size)])
    work = attach(smooth, region_stats(smooth, {"top": F.max("smooth")}))
    scaled = F.floor(F.least(F.lit(255.0), F.col("smooth") / F.when(F.col("top") > 0, F.col("top")) * 255.0))
    return work.select("region", "row", "col", "n_craters", "area", F.coalesce(scaled, F.lit(0)).cast("int").alias("density"))
