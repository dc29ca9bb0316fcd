"""Changing the grid: block means, reprojection by cell or tile of the source, fusion, sampling at points."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType

from selenogrid.functions import geo
from selenogrid.operators.grid import TILE


def block_mean(cells: DataFrame, factor: int, layers: list[str]) -> DataFrame:
    """Mean over blocks of ``factor`` x ``factor`` cells; a last block that is incomplete has the mean of the cells that it holds."""
    full_h, full_w = F.ceil(F.col("height") / factor), F.ceil(F.col("width") / factor)
    r, c = F.floor(F.col("row") / factor).cast("int"), F.floor(F.col("col") / factor).cast("int")
    return (
        cells.groupBy("region", full_h.cast("int").alias("height"), full_w.cast("int").alias("width"),
                 (F.col("resolution_m") * factor).alias("resolution_m"), "origin_x", "origin_y",
                 r.alias("row"), c.alias("col"))
        .agg(*[F.avg(n).alias(n) for n in layers])
    )


def target_grid(targets: DataFrame) -> DataFrame:
    """Cells of the target grids. ``targets``: region, t_height, t_width, t_resolution_m, t_origin_x, t_origin_y and the
    source geometry. Rows are dealt out before they become cells, so that no task makes a whole grid."""
    rows = targets.select("*", F.explode(F.sequence(F.lit(0), F.col("t_height") - 1)).alias("t_row")).repartition("region", "t_row")
    return rows.select("*", F.explode(F.sequence(F.lit(0), F.col("t_width") - 1)).alias("t_col"))


def _source(grid: DataFrame, half: float) -> tuple[Column, Column]:
    x = F.col("t_origin_x") + (F.col("t_col") + 0.5) * F.col("t_resolution_m")
    y = F.col("t_origin_y") - (F.col("t_row") + 0.5) * F.col("t_resolution_m")
    return (F.col("origin_y") - y) / F.col("resolution_m") - half, (x - F.col("origin_x")) / F.col("resolution_m") - half


def reproject_nearest(grid: DataFrame, cells: DataFrame, layers: list[str]) -> DataFrame:
    r, c = _source(grid, 0.0)
    keyed = grid.select("region", "t_row", "t_col", F.floor(r).cast("int").alias("row"), F.floor(c).cast("int").alias("col"))
    return keyed.join(cells.select("region", "row", "col", *layers), ["region", "row", "col"], "left").select(
        "region", "t_row", "t_col", *layers
    )


def corners(points: DataFrame, r: Column, c: Column) -> DataFrame:
    """Each point four times, with the cell and the bilinear weight of each corner."""
    r0, c0 = F.floor(r), F.floor(c)
    fr, fc = r - r0, c - c0
    four = F.array(*[
        F.struct((r0 + dr).cast("int").alias("row"), (c0 + dc).cast("int").alias("col"),
                 ((fr if dr else 1.0 - fr) * (fc if dc else 1.0 - fc)).alias("w"))
        for dr in (0, 1) for dc in (0, 1)
    ])
    return points.select("*", F.explode(four).alias("_k")).select(*points.columns, "_k.*")


def reproject_bilinear(grid: DataFrame, cells: DataFrame, layers: list[str], tile: int = TILE) -> DataFrame:
    """Weighted mean of the corners that hold data; NULL where none does.

    Targets and cells meet once, by tile of the source: a cell is copied only where a tile's last corner lies in the next one. Tiles are
    narrower where targets are finer than the source, so that a tile has about as many of them.
    """
    r, c = _source(grid, 0.5)
    finest = grid.agg(F.min(F.col("t_resolution_m") / F.col("resolution_m"))).collect()[0][0] or 1.0
    side = max(1, min(tile, int(tile * finest)))

    def home(pos: Column) -> Column:
        return F.floor(pos / side).cast("int")

    asked = grid.select("region", "t_row", "t_col", r.alias("_r"), c.alias("_c"), home(F.floor(r)).alias("tile_row"), home(F.floor(c)).alias("tile_col"))
    near = cells.select("region", "row", "col", *[F.col(n).cast("double").alias(n) for n in layers])
    for axis in ("row", "col"):
        near = near.select("*", F.explode(F.sequence(home(F.col(axis) - 1), home(F.col(axis)))).alias(f"tile_{axis}"))
    schema = StructType([*[asked.schema[n] for n in ("region", "t_row", "t_col")], *[near.schema[n] for n in layers]])
    arrow = pa.schema([(f.name, to_arrow_type(f.dataType)) for f in schema])

    def mean(asked: pa.Table, near: pa.Table) -> pa.Table:
        if not len(asked):
            return arrow.empty_table()
        first = [asked.column(n)[0].as_py() * side for n in ("tile_row", "tile_col")]
        pos = [asked.column(n).to_numpy() for n in ("_r", "_c")]
        low = [np.floor(p) for p in pos]
        share = [p - o for p, o in zip(pos, low, strict=True)]
        at = [(o - f).astype(np.int64) for o, f in zip(low, first, strict=True)]
        seat = tuple(near.column(n).to_numpy().astype(np.int64) - f for n, f in zip(("row", "col"), first, strict=True))
        out = asked.select(["region", "t_row", "t_col"])
        for n in layers:
            plane = np.full((side + 1, side + 1), np.nan)
            plane[seat] = near.column(n).to_numpy()
            total, weight = np.zeros(len(asked)), np.zeros(len(asked))
            for dr in (0, 1):
                for dc in (0, 1):
                    w = (share[0] if dr else 1.0 - share[0]) * (share[1] if dc else 1.0 - share[1])
                    x = plane[at[0] + dr, at[1] + dc]
                    known = ~np.isnan(x)
                    total += np.where(known, x * w, 0.0)
                    weight += np.where(known, w, 0.0)
            value = np.where(weight > 0, total / np.where(weight > 0, weight, 1.0), np.nan)
            out = out.append_column(n, pa.array(value, from_pandas=True))
        return out.cast(arrow)

    keys = ["region", "tile_row", "tile_col"]
    return asked.groupBy(*keys).cogroup(near.groupBy(*keys)).applyInArrow(mean, schema)


def sample_bilinear(points: DataFrame, cells: DataFrame, key: list[str], value: str) -> DataFrame:
    """Value at longitude and latitude; NULL outside the grid or when any corner is nodata.

    Positions are unrounded cell coordinates, so a point on a cell's corner coordinate takes that cell's value.
    """
    r, c = geo.lonlat_to_cell_float(*[F.col(n) for n in ("lon", "lat", "resolution_m", "origin_x", "origin_y")])
    near = corners(points.select(*key, "region", r.alias("_r"), c.alias("_c")), F.col("_r"), F.col("_c"))
    joined = near.join(cells.select("region", "row", "col", value), ["region", "row", "col"], "left")
    return joined.groupBy(*key).agg(
        F.when(F.count(value) == 4, F.sum(F.col(value) * F.col("w"))).alias(value)
    )


def upsample_linear(coarse: DataFrame, fine: DataFrame, value: str) -> DataFrame:
    """Linear interpolation with the first and last samples of both grids aligned. ``coarse`` has n_rows and n_cols."""

    def axis(pos: str, extent: str, n: str) -> Column:
        return F.when(F.col(extent) > 1, F.col(pos) * (F.col(n) - 1) / (F.col(extent) - 1)).otherwise(0.0)

    sizes = coarse.select("region", "n_rows", "n_cols").distinct()
    work = fine.select("region", "row", "col", "height", "width").join(sizes, "region").select(
        "region", F.col("row").alias("f_row"), F.col("col").alias("f_col"),
        axis("row", "height", "n_rows").alias("_r"), axis("col", "width", "n_cols").alias("_c"),
    )
    near = corners(work, F.col("_r"), F.col("_c"))
    joined = near.filter("w > 0").join(coarse.select("region", "row", "col", value), ["region", "row", "col"], "left")
    return joined.groupBy("region", "f_row", "f_col").agg(
        (F.sum(F.col(value) * F.col("w")) / F.sum("w")).alias(value)
    ).withColumnsRenamed({"f_row": "row", "f_col": "col"})


def fuse(stages: list[DataFrame], value: str) -> DataFrame:
    """Finest stage that holds data wins; stages are given coarse to fine and share the cell key."""
    key = ["region", "row", "col"]
    out = stages[0].select(*key, F.col(value).alias("s0"))
    for i, stage in enumerate(stages[1:], 1):
        out = out.join(stage.select(*key, F.col(value).alias(f"s{i}")), key, "full")
    names = [f"s{i}" for i in range(len(stages))]
    return out.select(*key, F.coalesce(*reversed(names)).alias(value), *names)
