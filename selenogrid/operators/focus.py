"""Sub-areas of a region: boxes, circles, squares, strides. Filters only, so that they reach the scan."""

from __future__ import annotations

from math import pi

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from selenogrid.functions import geo

KM_PER_DEGREE = 2 * pi * geo.RADIUS_KM / 360.0


def _at(df: DataFrame) -> tuple[Column, Column]:
    return geo.cell_to_lonlat(*[F.col(c) for c in ("row", "col", "resolution_m", "origin_x", "origin_y")])


def circle_bounds(lat: Column, lon: Column, radius_km: Column) -> dict[str, Column]:
    """Box around a circle; all longitudes where the circle nears the pole. Longitudes are in [0, 360)."""
    dlat = radius_km / KM_PER_DEGREE
    cos = F.abs(F.cos(F.radians(lat)))
    dlon = F.when(cos > 0.01, radius_km / (KM_PER_DEGREE * F.when(cos > 0.01, cos))).otherwise(180.0)
    return {"lon_min": F.pmod(lon - dlon, F.lit(360.0)), "lon_max": F.pmod(lon + dlon, F.lit(360.0)),
            "lat_min": lat - dlat, "lat_max": lat + dlat}


def in_lonlat_box(df: DataFrame, lon_min: Column, lon_max: Column, lat_min: Column, lat_max: Column) -> Column:
    """Cells by their own coordinates, so that boxes over the pole or the 0 meridian are whole."""
    lon, lat = _at(df)
    lon = F.pmod(lon, F.lit(360.0))
    wraps = F.when(lon_min <= lon_max, lon.between(lon_min, lon_max)).otherwise((lon >= lon_min) | (lon <= lon_max))
    return wraps & lat.between(lat_min, lat_max)


def in_circle(df: DataFrame, lat: Column, lon: Column, radius_km: Column) -> Column:
    clon, clat = _at(df)
    return geo.great_circle_km(clat, clon, lat, lon) <= radius_km


def crop(cells: DataFrame, row0: Column, row1: Column, col0: Column, col1: Column) -> DataFrame:
    """Rows and columns in the inclusive bounds, renumbered from 0, with the origin and extent moved to match."""
    r0, c0 = F.greatest(row0, F.lit(0)), F.greatest(col0, F.lit(0))
    r1, c1 = F.least(row1, F.col("height") - 1), F.least(col1, F.col("width") - 1)
    kept = cells.filter(F.col("row").between(r0, r1) & F.col("col").between(c0, c1))
    moved = {
        "origin_x": F.col("origin_x") + c0 * F.col("resolution_m"), "origin_y": F.col("origin_y") - r0 * F.col("resolution_m"),
        "height": r1 - r0 + 1, "width": c1 - c0 + 1, "row": F.col("row") - r0, "col": F.col("col") - c0,
    }
    return kept.select(*[moved[c].alias(c) if c in moved else F.col(c) for c in cells.columns])


def centred_square(cells: DataFrame, n: int) -> DataFrame:
    r0, c0 = F.floor((F.col("height") - n) / 2), F.floor((F.col("width") - n) / 2)
    return crop(cells, r0.cast("int"), (r0 + n - 1).cast("int"), c0.cast("int"), (c0 + n - 1).cast("int"))


def stride(cells: DataFrame, step: int) -> DataFrame:
    """Every ``step``-th row and column, renumbered, with resolution and extent to match."""
    kept = cells.filter((F.col("row") % step == 0) & (F.col("col") % step == 0))
    moved = {
        "row": F.col("row") / step, "col": F.col("col") / step,
        "height": F.ceil(F.col("height") / step), "width": F.ceil(F.col("width") / step),
    }
    out = {c: v.cast("int") for c, v in moved.items()} | {"resolution_m": F.col("resolution_m") * step}
    return kept.select(*[out[c].alias(c) if c in out else F.col(c) for c in cells.columns])


def decimation(height: int, width: int, target: int = 2500) -> int:
    return max(1, max(height, width) // target)


def axis_labels(regions: DataFrame, stride_cells: int = 1, n: int = 6) -> DataFrame:
    """Evenly spaced tick positions along the first column (latitude) and the first row (longitude)."""
    ticks = regions.select("*", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("tick"))

    def at(extent: str) -> Column:
        return F.bround(F.col("tick") * (F.floor((F.col(extent) + stride_cells - 1) / stride_cells) - 1) / (n - 1))

    geom = [F.col(c) for c in ("resolution_m", "origin_x", "origin_y")]
    _, lat = geo.cell_to_lonlat(at("height") * stride_cells, F.lit(0), *geom)
    lon, _ = geo.cell_to_lonlat(F.lit(0), at("width") * stride_cells, *geom)
    return ticks.select("region", "tick", at("height").cast("int").alias("row_tick"), lat.alias("lat"),
                        at("width").cast("int").alias("col_tick"), lon.alias("lon"))
