"""Soft-terrain risk of every cell for every rover."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from selenogrid.functions.numeric import clip, or_one, zero_if_null
from selenogrid.functions.physics import STUCK_SHARE_OF_RADIUS, sinkage_m, soft_index


def smoothness() -> Column:
    return zero_if_null(1.0 - clip(F.col("roughness") / or_one(F.col("roughness_p95")), 0.0, 1.0))


def terrain_softness() -> Column:
    """Depressions, smooth ground and dense cratering collect loose soil."""
    return soft_index(F.col("depression"), smoothness(), F.col("crater_density"), F.col("has_crater_density"))


def mobility_risk() -> Column:
    """Sinkage over the depth at which the wheel is stuck; 0 at nodata."""
    z = sinkage_m(F.col("rover_mass_kg"), F.col("wheel_width_m"), F.col("wheel_radius_m"), F.col("n_wheels"),
                  F.col("softness"))
    stuck = F.greatest(STUCK_SHARE_OF_RADIUS * F.col("wheel_radius_m"), F.lit(1e-6))
    return F.when(F.col("elevation").isNotNull(), clip(z / stuck, 0.0, 1.0)).otherwise(0.0)
