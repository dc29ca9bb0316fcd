"""Slope, aspect, roughness."""

from __future__ import annotations

from pyspark.sql import functions as F

from selenogrid.operators import terrain
from selenogrid.plans import steps  # noqa: F401
from selenogrid.plans.registry import query

KEY = ["region", "row", "col"]


@query("terrain_slope_aspect_roughness", """
SELECT region, row, col, round(slope, 6) AS slope_deg, round(aspect, 6) AS aspect_deg, round(roughness, 6) AS roughness_m
FROM terrain""", ["terrain"])
def slope_aspect_roughness(ws, tile: int = 256):
    return terrain.terrain_layers(ws.cells, tile).select(
        *KEY, F.round("slope", 6).alias("slope_deg"), F.round("aspect", 6).alias("aspect_deg"),
        F.round("roughness", 6).alias("roughness_m"),
    )


@query("terrain_across_tiles", """
SELECT region, row, col, round(slope, 6) AS slope_deg, round(aspect, 6) AS aspect_deg, round(roughness, 6) AS roughness_m
FROM terrain""", ["terrain"])
def across_tiles(ws):
    """The same with tiles of 16 cells, so that every region spans several."""
    return slope_aspect_roughness(ws, 16)
