"""Dense grids and the tile-with-halo stencil that every neighbourhood operator is built on.

Plan shape. Each cell is copied into every tile whose halo covers it, and mirrored copies are added where the halo hangs
over the region's edge (d c b a | a b c d). One shuffle on ``(by, tile)`` follows. Row windows are partitioned by
``(by, tile, row)`` and column windows by ``(by, tile, col)``; both are already satisfied by that shuffle, so any number
of windows runs on local sorts only. A tile is the largest unit of work, however large one region is.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import ArrayType, DoubleType, IntegralType, LongType, StructField, StructType

TILE = 256
WIDE = 8
GEOMETRY = ["height", "width", "resolution_m", "origin_x", "origin_y"]


def densify(cells: DataFrame, regions: DataFrame) -> DataFrame:
    """One row for every cell of every region; cells without data carry NULL layers."""
    rows = regions.select("region", *GEOMETRY, F.explode(F.sequence(F.lit(0), F.col("height") - 1)).alias("row"))
    # the rows of a region are dealt out before they become cells, so that no task makes a whole region
    skeleton = rows.repartition("region", "row").withColumn("col", F.explode(F.sequence(F.lit(0), F.col("width") - 1)))
    return skeleton.join(cells, ["region", "row", "col"], "left")


def frame(size: int) -> tuple[int, int]:
    """Offsets covered by a box of ``size``: even sizes reach one further back than forward."""
    return size // 2, size - 1 - size // 2


@dataclass(frozen=True)
class Box:
    """Separable box aggregate: sum, max, min, mean (no NULL in ``value``) or avg (over the non-NULL cells).

    Averages of the same size whose values are NULL together may share one count by giving the same ``nulls`` name.
    """

    out: str
    how: str
    value: Column
    size: int
    nulls: str = ""


@dataclass(frozen=True)
class Shift:
    """Values of the four edge neighbours, as ``out_w``, ``out_e``, ``out_n``, ``out_s``; NULL beyond the region."""

    out: str
    value: Column


def _images(pos: Column, n: Column, halo: int) -> Column:
    """The position and, near an edge, its mirror images: the grid repeats every two extents, as often as the halo reaches."""
    turns = (F.floor(F.lit(halo) / (2 * n)) + 1).cast("int")
    mirrored = F.flatten(F.transform(F.sequence(-turns, turns), lambda k: F.array(2 * k * n + pos, 2 * k * n - 1 - pos)))
    return F.when((pos >= halo) & (pos < n - halo), F.array(pos)).otherwise(mirrored)


def _tiles(pos: Column, n: Column, halo: int, tile: int) -> Column:
    last = F.floor((n - 1) / tile).cast("int")
    lo = F.greatest(F.lit(0), F.floor((pos - halo) / tile).cast("int"))
    hi = F.least(last, F.floor((pos + halo) / tile).cast("int"))
    return F.sequence(lo, hi)


def spread(cells: DataFrame, halo: int, by: Sequence[str] = ("region",), tile: int = TILE) -> DataFrame:
    """Copy cells into the tiles that need them and shuffle once on the tile key."""
    out = cells
    for axis, extent in (("row", "height"), ("col", "width")):
        pos, n = F.col(axis), F.col(extent)
        rest = [c for c in out.columns if c != axis]
        out = out.select(*rest, F.explode(_images(pos, n, halo)).alias(axis)).filter((pos >= -halo) & (pos < n + halo))
        out = out.select("*", F.explode(_tiles(pos, n, halo, tile)).alias(f"tile_{axis}"))
    return out.repartition(*by, "tile_row", "tile_col")


def _own(axis: str, extent: str, tile: int) -> Column:
    pos = F.col(axis)
    return (pos >= 0) & (pos < F.col(extent)) & (F.floor(pos / tile) == F.col(f"tile_{axis}"))


def _boxed(src: dict[str, tuple[str, str]], work: DataFrame, keep: list[str], window, extra: list[Column]) -> DataFrame:
    """One pass along an axis. ``src`` maps an output to (aggregate, input, size).

    Wide sums take the difference of two running sums, so their cost does not grow with the box; narrow ones and extrema
    use a sliding frame. The running sums restart in every tile, which keeps them short and their digits exact.
    """
    wide = {o: v for o, v in src.items() if v[0] == "sum" and v[2] >= WIDE}
    before = window.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    if wide:
        work = work.select("*", *[F.sum(v[1]).over(before).alias(f"_run_{o}") for o, v in wide.items()])
    fold = {"sum": F.sum, "max": F.max, "min": F.min}
    out = []
    for name, (how, value, size) in src.items():
        lo, hi = frame(size)
        if name in wide:
            run = f"_run_{name}"
            ahead = F.lead(run, hi).over(window) if hi else F.col(run)
            out.append((ahead - F.coalesce(F.lag(run, lo + 1).over(window), F.lit(0))).alias(name))
        else:
            out.append(fold[how](value).over(window.rowsBetween(-lo, hi)).alias(name))
    return work.select(*keep, *out, *extra)


def stencil(
    cells: DataFrame,
    boxes: Sequence[Box] = (),
    shifts: Sequence[Shift] = (),
    by: Sequence[str] = ("region",),
    tile: int = TILE,
) -> DataFrame:
    """Cells with all requested neighbourhood columns, from one shuffle and two local sorts. The grid must be dense."""
    halo = max([1 if shifts else 0] + [frame(b.size)[0] for b in boxes])
    kept = list(cells.columns)
    inputs, sums, counts = [], {}, {}
    for i, b in enumerate(boxes):
        inputs.append(b.value.alias(f"_b{i}"))
        how = "sum" if b.how in ("avg", "mean") else b.how
        sums[f"_x{i}"] = (how, f"_b{i}", b.size)
        if b.how == "avg":
            tag = f"_n_{b.nulls or i}_{b.size}"
            if tag not in counts:
                inputs.append(F.when(b.value.isNotNull(), 1).otherwise(0).alias(f"{tag}_in"))
                counts[tag] = ("sum", f"{tag}_in", b.size)
    inputs += [s.value.alias(f"_s{i}") for i, s in enumerate(shifts)]
    wide = [f"_b{i}" for i, b in enumerate(boxes) if sums[f"_x{i}"][0] == "sum" and b.size >= WIDE]
    work = cells.select("*", *inputs)
    if wide:  # a running sum needs a value in every cell; the count keeps averages right
        work = work.select(*[F.coalesce(c, F.lit(0)).alias(c) if c in wide else F.col(c) for c in work.columns])
    work = spread(work, halo, by, tile)
    keys = [*by, "tile_row", "tile_col"]
    plan = {**sums, **counts}

    def sides(window, pos: str, extent: str, back: str, ahead: str) -> list[Column]:
        out = []
        for i, s in enumerate(shifts):
            out.append(F.when(F.col(pos) > 0, F.lag(f"_s{i}").over(window)).alias(f"{s.out}_{back}"))
            out.append(F.when(F.col(pos) < F.col(extent) - 1, F.lead(f"_s{i}").over(window)).alias(f"{s.out}_{ahead}"))
        return out

    along_row = Window.partitionBy(*keys, "row").orderBy("col")
    own_keys = [*kept, "tile_row", "tile_col", *[f"_s{i}" for i in range(len(shifts))]]
    work = _boxed(plan, work, own_keys, along_row, sides(along_row, "col", "width", "w", "e"))
    work = work.filter(_own("col", "width", tile))
    along_col = Window.partitionBy(*keys, "col").orderBy("row")
    second = {o: (how, o, size) for o, (how, _, size) in plan.items()}
    row_sides = [f"{s.out}_{d}" for s in shifts for d in "we"]
    work = _boxed(second, work, [*kept, "tile_row", "tile_col", *row_sides], along_col,
                  sides(along_col, "row", "height", "n", "s"))
    work = work.filter(_own("row", "height", tile))
    final = []
    for i, b in enumerate(boxes):
        x = F.col(f"_x{i}")
        if b.how == "avg":
            n = F.col(f"_n_{b.nulls or i}_{b.size}")
            x = F.when(n > 0, x / F.when(n > 0, n))
        elif b.how == "mean":
            x = x / float(b.size * b.size)
        final.append(x.alias(b.out))
    return work.select(*kept, *row_sides, *[f"{s.out}_{d}" for s in shifts for d in "ns"], *final)


def _mirror(pos: np.ndarray, n: int) -> np.ndarray:
    """Positions after reflection at both edges; the edge cell repeats."""
    pos = np.mod(pos, 2 * n)
    return np.where(pos < n, pos, 2 * n - 1 - pos)


def _along(a: np.ndarray, how: str, size: int, halo: int) -> np.ndarray:
    """One box along the last axis, for the cells inside the halo. NaN is no value; sums have none."""
    (lo, hi), n = frame(size), a.shape[1] - 2 * halo
    if how == "sum" and size >= WIDE:
        run = np.cumsum(np.pad(a, ((0, 0), (1, 0))), axis=1)
        return run[:, halo + hi + 1:halo + hi + 1 + n] - run[:, halo - lo:halo - lo + n]
    fold = {"sum": np.add, "max": np.fmax, "min": np.fmin}[how]
    out = a[:, halo - lo:halo - lo + n].copy()
    for k in range(1 - lo, hi + 1):
        fold(out, a[:, halo + k:halo + k + n], out=out)
    return out


def _box(a: np.ndarray, how: str, size: int, halo: int) -> np.ndarray:
    return _along(_along(a, how, size, halo).T, how, size, halo).T


class _Tile:
    """A tile of one group with its halo: ``own`` tells which rows lie in the tile itself, ``at`` where they lie."""

    def __init__(self, table: pa.Table, tile: int, halo: int):
        one = {c: table.column(c)[0].as_py() for c in ("height", "width", "tile_row", "tile_col")}
        row, col = (table.column(c).to_numpy().astype(np.int64) for c in ("row", "col"))
        self.first, self.extent = np.array([one["tile_row"], one["tile_col"]]) * tile, np.array([one["height"], one["width"]])
        self.last = np.minimum(self.first + tile, self.extent)
        self.low, high = np.maximum(self.first - halo, 0), np.minimum(self.last + halo, self.extent)
        self.size, self.table, self.seat = high - self.low, table, (row - self.low[0], col - self.low[1])
        self.pick = np.ix_(*[_mirror(np.arange(f - halo, t + halo), n) - o for f, t, n, o in zip(self.first, self.last, self.extent, self.low, strict=True)])
        self.own = (row >= self.first[0]) & (row < self.last[0]) & (col >= self.first[1]) & (col < self.last[1])
        self.at = row[self.own] - self.first[0], col[self.own] - self.first[1]

    def plane(self, name: str) -> np.ndarray:
        """A column as an array over the tile and its halo, mirrored at the region's edges; NaN is nodata."""
        a = np.full(self.size, np.nan)
        a[self.seat] = self.table.column(name).to_numpy()
        return a[self.pick]


def tiled(
    cells: DataFrame,
    boxes: Sequence[Box] = (),
    shifts: Sequence[Shift] = (),
    by: Sequence[str] = ("region",),
    tile: int = TILE,
) -> DataFrame:
    """What :func:`stencil` gives, where a tile and its halo become arrays once they have met: cells are copied across the edges of
    tiles only, mirror images are made by position, and no row is sorted. Sums add up in the same order, so digits are the same."""
    by, kept = list(by), list(cells.columns)
    halo = max([1 if shifts else 0] + [frame(b.size)[0] for b in boxes])
    work = cells.select("*", *[b.value.alias(f"_b{i}") for i, b in enumerate(boxes)], *[s.value.alias(f"_s{i}") for i, s in enumerate(shifts)])
    kinds = {f.name: f.dataType for f in work.schema}
    fields = [StructField(f"{s.out}_{d}", kinds[f"_s{i}"]) for sides in ("we", "ns") for i, s in enumerate(shifts) for d in sides]
    for i, b in enumerate(boxes):
        kind = kinds[f"_b{i}"]
        whole = LongType() if b.how == "sum" and isinstance(kind, IntegralType) else DoubleType()
        fields.append(StructField(b.out, kind if b.how in ("max", "min") else whole))
    plan = [(b.how, b.size) for b in boxes]
    n_shifts, step = len(shifts), {"w": (0, -1), "e": (0, 1), "n": (-1, 0), "s": (1, 0)}
    for axis, extent in (("row", "height"), ("col", "width")):
        work = work.select("*", F.explode(_tiles(F.col(axis), F.col(extent), halo, tile)).alias(f"tile_{axis}"))

    def fold(table: pa.Table) -> pa.Table:
        t = _Tile(table, tile, halo)
        found = [None] * (4 * n_shifts)
        first, last, extent = t.first, t.last, t.extent
        nr, nc = last - first
        for i in range(n_shifts):
            a = t.plane(f"_s{i}")
            for d, (dr, dc) in step.items():
                x = a[halo + dr:halo + dr + nr, halo + dc:halo + dc + nc].copy()
                if d in "we" and (first[1] == 0 if d == "w" else last[1] == extent[1]):
                    x[:, 0 if d == "w" else -1] = np.nan
                if d in "ns" and (first[0] == 0 if d == "n" else last[0] == extent[0]):
                    x[0 if d == "n" else -1] = np.nan
                found[(0 if d in "we" else 2 * n_shifts) + 2 * i + (d in "es")] = x
        for i, (how, size) in enumerate(plan):
            a = t.plane(f"_b{i}")
            if how in ("max", "min"):
                found.append(_box(a, how, size, halo))
                continue
            total = _box(np.nan_to_num(a, nan=0.0), "sum", size, halo)
            if how == "mean":
                total = total / float(size * size)
            elif how == "avg":
                n = _box((~np.isnan(a)).astype(float), "sum", size, halo)
                total = np.where(n > 0, total / np.where(n > 0, n, 1.0), np.nan)
            found.append(total)
        mine = table.select(kept).filter(pa.array(t.own))
        for field, x in zip(out.fields[len(kept):], found, strict=True):
            mine = mine.append_column(field.name, pa.array(x[t.at], from_pandas=True).cast(arrow[field.name]))
        return mine

    out = StructType([*cells.schema.fields, *fields])
    arrow = {f.name: to_arrow_type(f.dataType) for f in fields}
    return work.groupBy(*by, "tile_row", "tile_col").applyInArrow(fold, out)


def box_shares(cells: DataFrame, value: Column, asked: DataFrame, out: str, by: Sequence[str] = ("region",), tile: int = TILE) -> DataFrame:
    """``(by, row, col, out)``: an array of the shares of a square's cells whose ``value`` is known and not above a limit.

    ``asked`` has ``by``, ``place`` (from 1, gapless), ``limit`` and ``radius`` of the square; the array is in the order of the places. All pairs of a group
    are counted on one copy of its cells, so cells are shuffled once however many pairs there are.
    """
    by = list(by)
    halo = asked.agg(F.max("radius")).collect()[0][0] or 0
    work = cells.select(*by, "height", "width", "row", "col", value.cast("double").alias("_b"))
    for axis, extent in (("row", "height"), ("col", "width")):
        work = work.select("*", F.explode(_tiles(F.col(axis), F.col(extent), halo, tile)).alias(f"tile_{axis}"))
    keys = [*by, "tile_row", "tile_col"]
    pairs = asked.join(work.select(*keys).distinct(), by).select(*keys, "place", "limit", "radius")
    met = work.groupBy(*keys).cogroup(pairs.toDF(*pairs.columns).groupBy(*keys))
    keep = [*by, "row", "col"]
    schema = StructType([*[work.schema[c] for c in keep], StructField(out, ArrayType(DoubleType()))])

    def fold(table: pa.Table, pairs: pa.Table) -> pa.Table:
        if not len(table) or not len(pairs):
            return arrow.empty_table()
        t = _Tile(table, tile, halo)
        a, found = t.plane("_b"), []
        for limit, radius in pairs.sort_by("place").select(["limit", "radius"]).to_pandas().itertuples(index=False):
            found.append(_box((a <= limit).astype(float), "sum", 2 * radius + 1, halo) / float((2 * radius + 1) ** 2))
        shares = np.stack(found, axis=-1)[t.at]
        ends = pa.array(np.arange(len(shares) + 1) * len(found), pa.int32())
        rows = table.select(keep).filter(pa.array(t.own))
        return rows.append_column(out, pa.ListArray.from_arrays(ends, pa.array(shares.ravel()))).cast(arrow)

    arrow = pa.schema([(f.name, to_arrow_type(f.dataType)) for f in schema])
    return met.applyInArrow(fold, schema)


def difference(name: str, value: Column, spacing: Column | float) -> tuple[Column, Column]:
    """Centred differences (east minus west, south minus north) from a :class:`Shift`, one-sided at the region's edge."""

    def axis(back: str, ahead: str, pos: str, extent: str) -> Column:
        b, a = F.col(f"{name}_{back}"), F.col(f"{name}_{ahead}")
        return (
            F.when(F.col(pos) == 0, (a - value) / spacing)
            .when(F.col(pos) == F.col(extent) - 1, (value - b) / spacing)
            .otherwise((a - b) / (2.0 * spacing))
        )

    return axis("w", "e", "col", "width"), axis("n", "s", "row", "height")
