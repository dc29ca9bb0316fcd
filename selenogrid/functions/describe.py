"""Words and bands for values. Bands are half-open, as listed."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: upper bounds and words
SLOPE_WORDS = [(5, "flat"), (15, "gentle"), (25, "moderate"), (None, "steep")]
ROUGHNESS_WORDS = [(5, "smooth"), (20, "moderate"), (50, "rough"), (None, "extremely rough")]
ELEVATION_PHRASES = [
    (-5000, "deep polar basin"), (-2000, "low basin floor"), (0, "below-datum depression"),
    (2000, "near-datum plateau"), (5000, "elevated highland"), (None, "prominent ridge summit"),
]
TERRAIN_CLASSES = ["HAZARD_ZONE", "RISKY_LANDING", "TRAVERSE_CORRIDOR", "SAFE_LANDING", "SCIENCE_TARGET"]


def band(x: Column, words: list[tuple[float | None, str]]) -> Column:
    out = F.lit(words[-1][1])
    for bound, word in reversed(words[:-1]):
        out = F.when(x < bound, word).otherwise(out)
    return F.when(x.isNotNull(), out)


def slope_word(deg: Column) -> Column:
    return band(deg, SLOPE_WORDS)


def roughness_word(m: Column) -> Column:
    return band(m, ROUGHNESS_WORDS)


def elevation_phrase(m: Column) -> Column:
    return F.concat(band(m, ELEVATION_PHRASES), F.lit(" at "), fixed(m, 0), F.lit(" m"))


def fixed(x: Column, digits: int) -> Column:
    return F.format_string(f"%.{digits}f", x)


def rank_tier(rank: Column) -> Column:
    return F.when(rank == 1, "primary").when(rank <= 5, "secondary").when(rank <= 10, "other")


def class_name(code: Column) -> Column:
    return F.element_at(F.array(*[F.lit(c) for c in TERRAIN_CLASSES]), code + 1)
