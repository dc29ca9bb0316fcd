"""Closed-form south-polar stereographic geometry on the lunar sphere (Snyder), as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

RADIUS_M = 1_737_400.0
RADIUS_KM = 1737.4


def plane_to_lonlat(x: Column, y: Column) -> tuple[Column, Column]:
    rho = F.sqrt(x * x + y * y)
    return F.degrees(F.atan2(x, y)), -90.0 + 2.0 * F.degrees(F.atan(rho / (2.0 * RADIUS_M)))


def lonlat_to_plane(lon: Column, lat: Column) -> tuple[Column, Column]:
    rho = 2.0 * RADIUS_M * F.tan(F.radians(45.0 + lat / 2.0))
    return rho * F.sin(F.radians(lon)), rho * F.cos(F.radians(lon))


def cell_to_lonlat(row: Column, col: Column, res: Column, ox: Column, oy: Column, at: float = 0.5):
    """Longitude and latitude of a cell, at its centre (``at=0.5``) or at its upper-left corner (``at=0``)."""
    return plane_to_lonlat(ox + (col + at) * res, oy - (row + at) * res)


def lonlat_to_cell_float(lon: Column, lat: Column, res: Column, ox: Column, oy: Column) -> tuple[Column, Column]:
    x, y = lonlat_to_plane(lon, lat)
    return (oy - y) / res, (x - ox) / res


def lonlat_to_cell(lon: Column, lat: Column, res: Column, ox: Column, oy: Column) -> tuple[Column, Column]:
    """Nearest cell, rounding halves to even."""
    r, c = lonlat_to_cell_float(lon, lat, res, ox, oy)
    return F.bround(r).cast("int"), F.bround(c).cast("int")


def lonlat_to_containing_cell(lon: Column, lat: Column, res: Column, ox: Column, oy: Column):
    """The cell whose square holds the point: the exact inverse of ``cell_to_lonlat``."""
    r, c = lonlat_to_cell_float(lon, lat, res, ox, oy)
    return F.floor(r).cast("int"), F.floor(c).cast("int")


def great_circle_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    half_lat, half_lon = F.radians(lat2 - lat1) / 2.0, F.radians(lon2 - lon1) / 2.0
    a = F.pow(F.sin(half_lat), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(half_lon), 2)
    return 2.0 * RADIUS_KM * F.asin(F.sqrt(F.least(F.lit(1.0), a)))


def clamp_cell(row: Column, col: Column, height: Column, width: Column) -> tuple[Column, Column, Column]:
    """Cell forced into the grid, and whether it was inside."""
    inside = (row >= 0) & (row < height) & (col >= 0) & (col < width)
    return F.greatest(F.lit(0), F.least(row, height - 1)), F.greatest(F.lit(0), F.least(col, width - 1)), inside


def native_geometry(
    embedded_res: Column, embedded_x: Column, embedded_y: Column, map_scale: Column, offset_cells: Column
) -> tuple[Column, Column, Column]:
    """Cell size and upper-left origin: the file's own where it carries a sane one, else from the label's scale and the
    distance of the pole from the edge in cells. NULL where neither is known."""
    own = F.coalesce((embedded_res > 0) & (embedded_res < 1e8), F.lit(False))
    return (F.when(own, embedded_res).otherwise(map_scale), F.when(own, embedded_x).otherwise(-offset_cells * map_scale),
            F.when(own, embedded_y).otherwise(offset_cells * map_scale))
