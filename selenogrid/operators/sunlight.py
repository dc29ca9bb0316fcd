"""Sunlight where no illumination layer exists, and the light of a given day."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from selenogrid.functions import geo
from selenogrid.functions.numeric import clip
from selenogrid.operators.quantiles import attach, region_stats
from selenogrid.operators.resample import upsample_linear

# fixed values: shares of sunlight by latitude, ridge bonus, basin penalty, polar factor for solar rovers
POLAR_FLOOR, HIGH_LATITUDE, PLAIN = 0.05, 0.7, 0.5
RIDGE_BONUS, BASIN_PENALTY, POLAR_SOLAR = 0.2, 0.3, 0.6


def estimate_sunlight(cells: DataFrame, step: int = 1, solar: bool = False) -> DataFrame:
    """Latitude bands with ridge and basin terms on every cell, or on a stride sample upsampled linearly; 0 at nodata."""
    work = attach(cells, region_stats(cells, {"e_mean": F.avg("elevation")}))
    some = work.filter((F.col("row") % step == 0) & (F.col("col") % step == 0))
    _, lat = geo.cell_to_lonlat(*[F.col(c) for c in ("row", "col", "resolution_m", "origin_x", "origin_y")])
    base = F.when(lat < -89.0, POLAR_FLOOR).when(lat > -85.0, HIGH_LATITUDE).otherwise(PLAIN)
    ridge = F.when(F.col("elevation") > F.col("e_mean") + 500.0, clip(base + RIDGE_BONUS, 0.0, 1.0)).otherwise(base)
    basin = F.when(F.col("elevation") < F.col("e_mean") - 1000.0, clip(ridge - BASIN_PENALTY, 0.0, 1.0)).otherwise(ridge)
    value = F.when((lat < -88.0) & F.lit(solar), basin * POLAR_SOLAR).otherwise(basin)
    coarse = some.select(
        "region", (F.col("row") / step).cast("int").alias("row"), (F.col("col") / step).cast("int").alias("col"),
        F.ceil(F.col("height") / step).cast("int").alias("n_rows"), F.ceil(F.col("width") / step).cast("int").alias("n_cols"),
        value.alias("sunlight"))
    fine = upsample_linear(coarse, cells, "sunlight")
    return cells.join(fine, ["region", "row", "col"]).withColumn(
        "sunlight", F.when(F.col("elevation").isNull(), 0.0).otherwise(clip(F.col("sunlight"), 0.0, 1.0)))
