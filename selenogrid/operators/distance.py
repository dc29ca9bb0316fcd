"""Nearest masked cell of every cell, and the exact Euclidean distance to it: lower envelopes of parabolas, row by row.

Only masked cells travel. They are gathered by column and band of rows, and the last one above a band and the first one below it are handed
on from band to band, so a band knows the nearest masked row of each of its columns. A column then is a parabola over the row of a cell,
and a row's lower envelope gives the nearest masked cell of all its cells in one sweep. A band of rows is the unit of work: no halo, no
cut, and no list that grows with a region's height. Ties go to the first cell in scan order.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BAND = 32
NONE = np.int64(1) << 40


def _columns(masked: DataFrame, by: Sequence[str], band: int) -> DataFrame:
    """``(by, height, width, col, band, rows, above, below)`` for every band of each column that has a masked cell: the masked rows inside the
    band, at most ``band`` of them, and the nearest ones outside."""
    inside = masked.groupBy(*by, "col", F.floor(F.col("row") / band).cast("int").alias("_at")).agg(
        F.max("height").alias("height"), F.max("width").alias("width"), F.sort_array(F.collect_set("row")).alias("_rows"))
    w = Window.partitionBy(*by, "col").orderBy("_at")
    first, last = F.element_at("_rows", 1), F.element_at("_rows", -1)
    linked = inside.select("*", F.lag("_at").over(w).alias("_before"), F.lag(last).over(w).alias("_up"), F.lead(first).over(w).alias("_down"),
                           F.lead("_at").over(w).isNull().alias("_end"))
    final = F.when(F.col("_end"), F.floor((F.col("height") - 1) / band).cast("int")).otherwise(F.col("_at"))
    bands = linked.select("*", F.explode(F.sequence(F.coalesce(F.col("_before") + 1, F.lit(0)), final)).alias("band"))
    own = F.col("band") == F.col("_at")
    after = F.col("band") > F.col("_at")
    return bands.select(
        *by, "height", "width", "col", "band", F.when(own, F.col("_rows")).otherwise(F.array().cast("array<int>")).alias("rows"),
        F.when(after, last).otherwise(F.col("_up")).alias("above"), F.when(own, F.col("_down")).when(~after, first).alias("below"))


class _Band:
    """Nearest masked row above and below every cell of the masked columns of one band."""

    def __init__(self, columns: pd.DataFrame, band: int):
        columns = columns.sort_values("col", ignore_index=True)
        self.cols, self.width = columns["col"].to_numpy(np.int64), int(columns["width"].iloc[0])
        first = int(columns["band"].iloc[0]) * band
        self.rows = np.arange(first, min(first + band, int(columns["height"].iloc[0])), dtype=np.int64)
        inside = np.zeros((len(self.rows), len(self.cols)), bool)
        size = [len(r) for r in columns["rows"]]
        if sum(size):
            inside[np.concatenate(list(columns["rows"])).astype(np.int64) - first, np.repeat(np.arange(len(size)), size)] = True
        above = columns["above"].fillna(-1).to_numpy(np.int64)
        below = columns["below"].fillna(NONE).to_numpy(np.int64)
        here = self.rows[:, None]
        # one row more on either side, so that the masked rows strictly above or below a cell can be read as well
        self.up = np.maximum.accumulate(np.vstack([above, np.where(inside, here, -1)]), axis=0)
        self.down = np.minimum.accumulate(np.vstack([np.where(inside, here, NONE), below])[::-1], axis=0)[::-1]

    @staticmethod
    def _nearer(up: np.ndarray, down: np.ndarray, row: np.ndarray) -> np.ndarray:
        return np.where((up >= 0) & ((down == NONE) | (row - up <= down - row)), up, down)

    def nearest_rows(self, at: np.ndarray) -> np.ndarray:
        """For the rows at these positions of the band, the nearest masked row of each masked column, the upper one of two."""
        return self._nearer(self.up[at + 1], self.down[at], self.rows[at][:, None])

    def other(self, at: int, col: int) -> tuple[int, int] | None:
        """The nearest masked cell to a cell that is masked itself, by comparing the columns."""
        near = self.nearest_rows(np.array([at]))[0]
        own = np.searchsorted(self.cols, col)
        near[own] = self._nearer(self.up[at, own], self.down[at + 1, own], self.rows[at])
        left = near < NONE
        far = np.where(left, (near - self.rows[at]) ** 2 + (self.cols - col) ** 2, np.iinfo(np.int64).max)
        if not left.any():
            return None
        best = np.lexsort((self.cols, near, far))[0]
        return int(near[best]), int(self.cols[best])


def envelope(near: np.ndarray, rows: np.ndarray, cols: np.ndarray, width: int) -> np.ndarray:
    """For each row and each column 0 to ``width`` - 1 the position in ``cols`` of the nearest cell, where column ``cols[j]`` of row ``rows[i]`` has
    its nearest one in row ``near[i, j]``. Ties go to the lower row, then the lower column.

    Squares are multiplied by more than the number of columns and the rank by (row, column) is added, so no two parabolas meet at a
    whole column and everything stays in whole numbers. All rows sweep together.
    """
    n, k = near.shape
    scale = np.int64(k + 1)
    rank = np.empty((n, k), np.int64)
    np.put_along_axis(rank, np.argsort(near, axis=1, kind="stable"), np.arange(k)[None, :], axis=1)
    base = (near - rows[:, None]) ** 2 * scale + rank
    stack, start, top = np.zeros((n, k), np.int64), np.zeros((n, k), np.int64), np.zeros(n, np.int64)
    for q in range(1, k):
        live, from_ = np.arange(n), np.zeros(n, np.int64)
        while len(live):
            v = stack[live, top[live]]
            gain = scale * (cols[q] ** 2 - cols[v] ** 2) + base[live, q] - base[live, v]
            s = gain // (2 * scale * (cols[q] - cols[v])) + 1  # the first column where q is nearer than v
            beaten = s <= start[live, top[live]]
            from_[live[~beaten]] = s[~beaten]
            live = live[beaten]
            top[live] -= 1
            live = live[top[live] >= 0]
        put = np.flatnonzero(from_ < width)
        top[put] += 1
        stack[put, top[put]], start[put, top[put]] = q, from_[put]
    mark = np.zeros((n, width), np.int64)
    i, j = np.nonzero(np.arange(k)[None, :] <= top[:, None])
    mark[i, start[i, j]] = j
    return np.take_along_axis(stack, np.maximum.accumulate(mark, axis=1), axis=1)


def nearest_masked(cells: DataFrame, mask: Column, by: Sequence[str] = ("region",), band: int = BAND) -> DataFrame:
    """``(by, row, col, near_row, near_col)`` for every cell of each region that has a cell where ``mask`` holds."""
    by = list(by)
    columns = _columns(cells.filter(F.coalesce(mask, F.lit(False))).select(*by, "height", "width", "row", "col"), by, band)
    kinds = ", ".join(f"`{c}` {columns.schema[c].dataType.simpleString()}" for c in by)

    def sweep(pdf: pd.DataFrame) -> pd.DataFrame:
        b = _Band(pdf, band)
        near = b.nearest_rows(np.arange(len(b.rows)))
        best = envelope(near, b.rows, b.cols, b.width)
        out = {"row": np.repeat(b.rows, b.width), "col": np.tile(np.arange(b.width), len(b.rows)),
               "near_row": np.take_along_axis(near, best, axis=1).ravel(), "near_col": b.cols[best].ravel()}
        return pd.DataFrame({**{c: pdf[c].iloc[0] for c in by}, **out})

    return columns.groupBy(*by, "band").applyInPandas(sweep, f"{kinds}, row int, col int, near_row int, near_col int")


def distance_to_mask(cells: DataFrame, mask: Column, out: str, by: Sequence[str] = ("region",), band: int = BAND) -> DataFrame:
    """Add ``out``, metres to the nearest cell where ``mask`` holds; NULL in a region without any."""
    near = nearest_masked(cells, mask, by, band)
    dr, dc = F.col("near_row") - F.col("row"), F.col("near_col") - F.col("col")
    cells_away = near.select(*by, "row", "col", F.sqrt((dr.cast("long") * dr + dc.cast("long") * dc).cast("double")).alias("_away"))
    return cells.join(cells_away, [*by, "row", "col"], "left").select(*cells.columns, (F.col("_away") * F.col("resolution_m")).alias(out))


def nearest_to_points(points: DataFrame, targets: DataFrame, by: Sequence[str] = ("region",), band: int = BAND) -> DataFrame:
    """The points with ``near_row`` and ``near_col``, the nearest target other than the point itself; points without any are left out.

    ``points`` have ``p_row`` and ``p_col``, a cell of their region; ``targets`` have the region's height and width. Only the rows that hold
    a point are swept.
    """
    by = list(by)
    columns = _columns(targets.select(*by, "height", "width", "row", "col"), by, band)
    asked = points.select(*by, "p_row", "p_col", F.floor(F.col("p_row") / band).cast("int").alias("band")).distinct()
    kinds = ", ".join(f"`{c}` {columns.schema[c].dataType.simpleString()}" for c in by)

    def look(key: tuple, cols: pd.DataFrame, pts: pd.DataFrame) -> pd.DataFrame:
        found = []
        if len(cols) and len(pts):
            b = _Band(cols, band)
            at, which = np.unique(pts["p_row"].to_numpy(np.int64) - b.rows[0], return_inverse=True)
            near = b.nearest_rows(at)
            best = envelope(near, b.rows[at], b.cols, b.width)
            for w, r, c in zip(which, pts["p_row"], pts["p_col"], strict=True):
                j = best[w, c]
                hit = (int(near[w, j]), int(b.cols[j]))
                hit = b.other(int(at[w]), int(c)) if hit == (r, c) else hit
                if hit is not None:
                    found.append((*key[:-1], r, c, *hit))
        return pd.DataFrame(found, columns=[*by, "p_row", "p_col", "near_row", "near_col"])

    near = columns.groupBy(*by, "band").cogroup(asked.groupBy(*by, "band")).applyInPandas(look, f"{kinds}, p_row int, p_col int, near_row int, near_col int")
    return points.join(near, [*by, "p_row", "p_col"])
