"""Joins by nearness. Points meet cells through tile keys, so no job compares every pair of a region."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from selenogrid.functions import geo
from selenogrid.operators.distance import nearest_to_points
from selenogrid.session import write_table

BLOCK = 64


def near_cells(points: DataFrame, cells: DataFrame, reach: int, block: int = BLOCK) -> DataFrame:
    """Pairs of a point (``p_row``, ``p_col``) and the cells within ``reach`` rows and columns of it.

    Each point is copied to the few blocks its square touches; the join is on the block key.
    """

    def blocks(pos: str) -> Column:
        return F.sequence(F.floor((F.col(pos) - reach) / block), F.floor((F.col(pos) + reach) / block))

    left = points.select("*", F.explode(blocks("p_row")).alias("_br")).select("*", F.explode(blocks("p_col")).alias("_bc"))
    right = cells.withColumn("_br", F.floor(F.col("row") / block)).withColumn("_bc", F.floor(F.col("col") / block))
    pairs = left.join(right, ["region", "_br", "_bc"])
    inside = F.col("row").between(F.col("p_row") - reach, F.col("p_row") + reach) & F.col("col").between(
        F.col("p_col") - reach, F.col("p_col") + reach
    )
    return pairs.filter(inside).drop("_br", "_bc")


def snap_to_passable(points: DataFrame, passable: DataFrame, key: list[str], reach: int = 50) -> DataFrame:
    """Nearest passable cell: smallest square ring first, then squared distance, then scan order; NULL beyond reach.

    ``passable`` holds only passable cells, and shares every column of ``key`` that it has. Rings come first, so what is found within a few
    rings is final: points look at their own cell, then within reaches that grow fourfold, and only those that found nothing
    look farther.
    """
    shared = [k for k in key if k in passable.columns and k != "region"]
    cells = passable.select("region", "row", "col", *[F.col(k).alias(f"_c_{k}") for k in shared])
    dr, dc = F.col("row") - F.col("p_row"), F.col("col") - F.col("p_col")
    order = F.struct(F.greatest(F.abs(dr), F.abs(dc)), dr * dr + dc * dc, dr, dc, F.col("row"), F.col("col"))
    left = write_table(points.select(*dict.fromkeys([*key, "region", "p_row", "p_col"])), "snap-left")
    found, near = None, 0
    while True:
        if near:
            pairs = near_cells(left, cells, near)
            for k in shared:
                pairs = pairs.filter(F.col(k) == F.col(f"_c_{k}"))
        else:
            own = [F.col("p_row") == F.col("row"), F.col("p_col") == F.col("col"), *[F.col(k) == F.col(f"_c_{k}") for k in shared]]
            pairs = left.join(cells.withColumnRenamed("region", "_region"), reduce(lambda x, y: x & y, own, F.col("region") == F.col("_region")))
        best = pairs.groupBy(*key).agg(F.min(order).alias("_o")).select(*key, F.col("_o.row").alias("row"), F.col("_o.col").alias("col"))
        best = write_table(best, "snapped")
        found = best if found is None else found.unionByName(best)
        if near >= reach:
            break
        left = write_table(left.join(best, key, "left_anti"), "snap-left")
        if not left.limit(1).count():
            break
        near = min(reach, max(3, 4 * near))
    return points.join(found, key, "left")


def nearest_where(starts: DataFrame, targets: DataFrame, key: list[str]) -> DataFrame:
    """Nearest target cell of the start's region, the start itself excluded; ties go to the first in scan order."""
    near = nearest_to_points(starts, targets)
    dr, dc = F.col("near_row") - F.col("p_row"), F.col("near_col") - F.col("p_col")
    return near.select(*key, F.col("near_row").alias("row"), F.col("near_col").alias("col"), F.sqrt((dr * dr + dc * dc).cast("double")).alias("distance_cells"))


def nearest_site(landmarks: DataFrame, sites: DataFrame, key: list[str]) -> DataFrame:
    """Nearest top site to each landmark of the region, in cells and along the sphere; site lists are short."""
    pairs = landmarks.join(sites, "region")
    cells = F.sqrt(F.pow(F.col("row") - F.col("p_row"), 2) + F.pow(F.col("col") - F.col("p_col"), 2))
    km = geo.great_circle_km(F.col("p_lat"), F.col("p_lon"), F.col("lat"), F.col("lon"))
    return pairs.groupBy(*key).agg(
        F.min(F.struct(cells.alias("d"), F.col("rank").alias("rank"))).alias("_px"),
        F.min(F.struct(km.alias("d"), F.col("rank").alias("rank"))).alias("_km"),
    ).select(*key, F.col("_px.d").alias("distance_cells"), F.col("_px.rank").alias("rank_by_cells"),
             F.col("_km.d").alias("distance_km"), F.col("_km.rank").alias("rank_by_km"))


def lookup(points: DataFrame, cells: DataFrame, layers: list[str]) -> DataFrame:
    """Layer values at the cell of each point."""
    return points.join(cells.select("region", "row", "col", *layers), ["region", "row", "col"], "left")


def dilate(mask: DataFrame, steps: int) -> DataFrame:
    """Cells within ``steps`` edge-neighbour moves of a mask cell, inside the region."""
    offsets = [(dr, dc) for dr in range(-steps, steps + 1) for dc in range(-steps, steps + 1) if abs(dr) + abs(dc) <= steps]
    moves = F.array(*[F.struct(F.lit(dr).alias("dr"), F.lit(dc).alias("dc")) for dr, dc in offsets])
    moved = mask.select("region", "height", "width", "row", "col", F.explode(moves).alias("m")).select(
        "region", "height", "width", (F.col("row") + F.col("m.dr")).alias("row"), (F.col("col") + F.col("m.dc")).alias("col")
    )
    return moved.filter(
        (F.col("row") >= 0) & (F.col("row") < F.col("height")) & (F.col("col") >= 0) & (F.col("col") < F.col("width"))
    ).select("region", "row", "col").distinct()


def isolated(mask: DataFrame) -> DataFrame:
    """Mask cells off the edge with no masked edge neighbour: components of one cell."""
    moves = F.array(*[F.struct(F.lit(dr).alias("dr"), F.lit(dc).alias("dc")) for dr, dc in ((0, 1), (0, -1), (1, 0), (-1, 0))])
    touched = mask.select("region", F.explode(moves).alias("m"), "row", "col").select(
        "region", (F.col("row") + F.col("m.dr")).alias("row"), (F.col("col") + F.col("m.dc")).alias("col")
    ).distinct()
    interior = mask.filter(
        F.col("row").between(1, F.col("height") - 2) & F.col("col").between(1, F.col("width") - 2)
    )
    return interior.join(touched, ["region", "row", "col"], "left_anti").select("region", "row", "col")
