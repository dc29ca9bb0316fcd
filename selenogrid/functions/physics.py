"""Rover physics as column expressions: wheel sinkage, rolling resistance, sun elevation, energy of a step."""

from __future__ import annotations

from math import pi

from pyspark.sql import Column
from pyspark.sql import functions as F

from selenogrid.functions.numeric import clip, zero_if_null

# fixed values: regolith, gravity, and the softening of the two moduli at the loosest soil
COHESIVE_MODULUS_PA = 1400.0
FRICTIONAL_MODULUS_PA_M = 820_000.0
GRAVITY = 1.62
SOFTENING = (0.50, 0.60)
STUCK_SHARE_OF_RADIUS = 0.50
# fixed values: drive power, slope and regeneration factors, rolling surcharge
BASE_POWER_W = 100.0
CLIMB_FACTOR = 3.0
REGEN_SHARE = 0.3
ROLLING_BASE = 0.015
DEFAULT_BATTERY_WH = 1000.0
DEFAULT_SPEED_KMH = 0.5
# fixed values: battery thresholds, idle draw, sun geometry
STOP_PCT = 20.0
RESUME_PCT = 80.0
IDLE_W = 25.0
SYNODIC_DAYS = 29.530589
OBLIQUITY_DEG = 1.5424
SQRT2 = 1.4142135623730951


def sinkage_m(mass: Column, width: Column, radius: Column, n_wheels: Column, soft: Column) -> Column:
    """Depth at which a rigid wheel carries its load on soil with a linear pressure-sinkage law."""
    soft = clip(soft, 0.0, 1.0)
    b, r = F.greatest(width, F.lit(1e-6)), F.greatest(radius, F.lit(1e-6))
    load = mass * GRAVITY / F.greatest(n_wheels, F.lit(1))
    modulus = COHESIVE_MODULUS_PA * (1.0 - SOFTENING[0] * soft) / b + FRICTIONAL_MODULUS_PA_M * (1.0 - SOFTENING[1] * soft)
    return F.pow(load / (2.0 * b * F.sqrt(2.0 * r) * modulus), F.lit(2.0 / 3.0))


def rolling_resistance(sinkage: Column, radius: Column) -> Column:
    r = F.greatest(radius, F.lit(1e-6))
    return 2.0 / 3.0 * F.sqrt(F.greatest(sinkage, F.lit(0.0)) / (2.0 * r))


def soft_index(depression: Column, smoothness: Column, craters: Column, has_craters: Column) -> Column:
    with_craters = 0.5 * depression + 0.3 * smoothness + 0.2 * zero_if_null(clip(craters, 0.0, 1.0))
    return clip(F.when(has_craters, with_craters).otherwise(0.6 * depression + 0.4 * smoothness), 0.0, 1.0)


def sun_elevation_deg(day: Column) -> Column:
    return OBLIQUITY_DEG * F.sin(2.0 * pi * day / SYNODIC_DAYS)


def day_illumination(average: Column, day: Column) -> Column:
    share = clip((sun_elevation_deg(day) + OBLIQUITY_DEG) / (2.0 * OBLIQUITY_DEG), 0.0, 1.0)
    return clip(average * share, 0.0, 1.0)


def positive_or(x: Column, default: float) -> Column:
    return F.when(x > 0, x).otherwise(F.lit(default))
