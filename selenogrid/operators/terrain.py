"""Slope, aspect and roughness of a dense elevation grid."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from selenogrid.operators.grid import Box, Shift, difference, tiled
from selenogrid.operators.quantiles import attach, region_stats

RAD_TO_DEG = 57.29577951308232


def slope_of(dx: Column, dy: Column) -> Column:
    return F.atan(F.sqrt(dx * dx + dy * dy)) * RAD_TO_DEG


def aspect_of(dx: Column, dy: Column, elevation: Column) -> Column:
    """Degrees clockwise from north; NULL on flat cells and at nodata."""
    deg = F.atan2(dx, -dy) * RAD_TO_DEG
    flat = (dx == 0) & (dy == 0)
    return F.when(elevation.isNotNull() & ~flat, F.when(deg < 0, deg + 360.0).otherwise(deg))


def deviation(mean_sq: Column, mean: Column) -> Column:
    """Population deviation from box means, never below zero."""
    return F.sqrt(F.greatest(mean_sq - mean * mean, F.lit(0.0)))


def terrain_layers(cells: DataFrame, tile: int = 256) -> DataFrame:
    """Add ``slope``, ``aspect`` and ``roughness`` (3x3 deviation, nodata filled by the region mean and re-masked).

    Elevation is centred on the region mean first: the deviation does not change, the fill becomes zero, and the squares
    stay small enough for the subtraction to keep its digits.
    """
    stats = region_stats(cells, {"e_mean": F.avg("elevation")})
    work = attach(cells, stats).withColumn("_z", F.coalesce(F.col("elevation") - F.col("e_mean"), F.lit(0.0)))
    work = tiled(
        work,
        boxes=[Box("_m", "mean", F.col("_z"), 3), Box("_q", "mean", F.col("_z") * F.col("_z"), 3)],
        shifts=[Shift("_e", F.col("elevation"))],
        tile=tile,
    )
    dx, dy = difference("_e", F.col("elevation"), F.col("resolution_m"))
    work = work.withColumn("_dx", dx).withColumn("_dy", dy)
    rough = F.when(F.col("elevation").isNotNull(), deviation(F.col("_q"), F.col("_m")))
    return work.select(
        *cells.columns,
        slope_of(F.col("_dx"), F.col("_dy")).alias("slope"),
        aspect_of(F.col("_dx"), F.col("_dy"), F.col("elevation")).alias("aspect"),
        rough.alias("roughness"),
    )
