"""Least-cost routes over the eight neighbours, for many missions at once.

Labels spread tile by tile. A task takes one (mission, tile) with the labels that entered it, settles the tile with
vector sweeps, and hands improved labels at its edge to the next tiles; rounds therefore grow with tiles crossed, not with
cells. Labels only ever improve, so every round's improvements are appended as a written table, by row of tiles, and the current label
of a cell is the minimum; a round reads those of its tiles only. The cost is the exact optimum; among equal costs the smallest (row, col) predecessor is taken.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from selenogrid.functions.numeric import clip, zero_if_null
from selenogrid.operators.batches import groups, whole_groups
from selenogrid.operators.proximity import snap_to_passable
from selenogrid.operators.scoring import once
from selenogrid.session import write_table

SLOPE_SCALE = 15.0
SOFT_FACTOR = 3.0
SOFT_BLOCK = 0.85
SQRT2 = 1.4142135623730951
MOVES = [(-1, -1), (-1, 0), (-1, 1), (0, -1), (0, 1), (1, -1), (1, 0), (1, 1)]
TILE = 64
GROUP = ["mission_id", "region", "tile_r", "tile_c"]
#: Rows that a task works on at once; a tile is never parted.
BATCH_ROWS = 100_000
#: Marks of rows that reach a tile beside its cells and the labels that enter it: labels it had before, and goals with the number of all of its mission's.
KNOWN, GOAL = -1.0, -2.0


def cell_cost(science: Column | None = None, priority: Column | None = None, risk: Column | None = None) -> Column:
    """Cost of entering a cell, NULL where it is blocked: steeper is dearer, science is cheaper, soft ground is dearer."""
    cost = F.col("resolution_m") * F.exp(F.col("slope") / SLOPE_SCALE)
    if science is not None:
        weight = priority * 0.5
        cost = cost * F.when(weight > 0, clip(1.0 - weight * science, 0.1, 1.0)).otherwise(1.0)
    if risk is not None:
        cost = F.when(risk < SOFT_BLOCK, cost * F.exp(risk * SOFT_FACTOR))
    return F.when(F.col("passable"), cost)


def mission_costs(scores: DataFrame, missions: DataFrame) -> DataFrame:
    """Open cells of every mission with their entry cost."""
    work = scores.join(missions.select("mission_id", "priority", F.size("science_experiments").alias("n_exp")), "mission_id")
    science = F.when(F.col("n_exp") > 0, F.col("science")).otherwise(0.0)
    cost = cell_cost(science, F.col("priority"), zero_if_null(F.col("mobility_risk")))
    return once(work.select("mission_id", "region", "row", "col", cost.alias("cost")), "mission_id", "region", "row", "col", "cost").filter("cost IS NOT NULL")


def snap_ends(ends: DataFrame, costs: DataFrame, key: list[str]) -> DataFrame:
    """Ends moved to the nearest open cell of their own mission; ends that cannot be are dropped."""
    return snap_to_passable(ends, costs, key).filter("row IS NOT NULL")


def _sweep(cost: np.ndarray, g: np.ndarray) -> np.ndarray:
    """Settle labels inside one tile: repeat the eight shifted minima until nothing improves."""
    h, w = cost.shape
    straight, across = cost, cost * SQRT2
    padded, offer = np.full((h + 2, w + 2), np.inf), np.empty((h, w))
    inner = padded[1:-1, 1:-1]
    inner[:] = g
    while True:
        best = inner.copy()
        for dr, dc in MOVES:
            np.add(padded[1 + dr:1 + dr + h, 1 + dc:1 + dc + w], across if dr and dc else straight, out=offer)
            np.minimum(best, offer, out=best)
        if not (best < inner).any():
            return best
        inner[:] = best


def least_cost(costs: DataFrame, starts: DataFrame, goals: DataFrame, tile: int = TILE) -> DataFrame:
    """Cheapest label ``g`` of the cells around each start, at least as far as that mission's goals.

    ``costs``: mission_id, region, row, col, cost. ``starts`` and ``goals``: mission_id, region, row, col. A label dearer
    than all goals of its mission, once they are all reached, is not spread further, nor kept where one tile holds them all.
    """
    key = ["mission_id", "region"]
    tiled = costs.withColumn("tile_r", F.floor(F.col("row") / tile).cast("int")).withColumn(
        "tile_c", F.floor(F.col("col") / tile).cast("int"))
    # stored by row of tiles, so that a round only reads the rows its labels have reached
    tiled = write_table(tiled.withColumn("band", F.col("tile_r")).repartition("band", *key, "tile_c"), "costs", ["band"])
    messages = starts.join(tiled.drop("band"), [*key, "row", "col"]).select(
        *key, "tile_r", "tile_c", "row", "col", F.lit(0.0).alias("base"), F.lit(0.0).alias("factor"))
    messages = write_table(messages, "messages")
    present = write_table(tiled.select(*key, "tile_r", "tile_c").distinct(), "tiles")
    wanted = write_table(goals.select(*key, "row", "col").distinct().withColumn("tile_r", F.floor(F.col("row") / tile).cast("int")).withColumn(
        "tile_c", F.floor(F.col("col") / tile).cast("int")).withColumn("n_goals", F.count(F.lit(1)).over(Window.partitionBy(*key))), "goals")
    asked = write_table(wanted.groupBy(*key).agg(F.count(F.lit(1)).alias("n_goals")), "goals")
    rounds: list[DataFrame] = []
    met: DataFrame | None = None
    while True:  # ends when no label is improved any more
        active = messages.select(*key, "tile_r", "tile_c").distinct()
        bands = [row[0] for row in messages.select("tile_r").distinct().collect()]  # at most one per row of tiles
        here = tiled.filter(F.col("band").isin(bands)).join(active, [*key, "tile_r", "tile_c"], "left_semi")
        entries = [here.select(*key, "tile_r", "tile_c", "row", "col", "cost", F.lit(None).cast("double").alias("base"),
                               F.lit(None).cast("double").alias("factor")),
                   messages.select(*key, "tile_r", "tile_c", "row", "col", F.lit(None).cast("double").alias("cost"), "base", "factor"),
                   wanted.join(active, [*key, "tile_r", "tile_c"], "left_semi").select(
                       *key, "tile_r", "tile_c", "row", "col", F.lit(None).cast("double").alias("cost"), F.col("n_goals").cast("double").alias("base"),
                       F.lit(GOAL).alias("factor"))]
        if rounds:
            # earlier labels are stored by row of tiles too, and only those of the tiles at work are read
            known = reduce(DataFrame.unionByName, rounds).filter(F.col("band").isin(bands)).join(active, [*key, "tile_r", "tile_c"], "left_semi")
            entries.append(known.select(*key, "tile_r", "tile_c", "row", "col", F.lit(None).cast("double").alias("cost"),
                                        F.col("g").alias("base"), F.lit(KNOWN).alias("factor")))
        work = reduce(DataFrame.unionByName, entries)
        group = [*key, "tile_r", "tile_c"]
        improved = work.repartition(*group).sortWithinPartitions(*group).mapInPandas(
            whole_groups(group, _settle(tile), BATCH_ROWS), "mission_id string, region string, tile_r int, tile_c int, row int, col int, g double, cost double")
        improved = write_table(improved.withColumn("band", F.col("tile_r")), "labels", ["band"])
        rounds.append(improved)
        moves = F.array(*[F.struct(F.lit(dr).alias("dr"), F.lit(dc).alias("dc"),
                                   F.lit(SQRT2 if dr and dc else 1.0).alias("f")) for dr, dc in MOVES])
        edge = (F.col("row") % tile).isin(0, tile - 1) | (F.col("col") % tile).isin(0, tile - 1)
        out = improved.filter(edge).select("*", F.explode(moves).alias("m")).select(
            *key, F.col("tile_r").alias("o_r"), F.col("tile_c").alias("o_c"), (F.col("row") + F.col("m.dr")).alias("row"),
            (F.col("col") + F.col("m.dc")).alias("col"), F.col("g").alias("base"), F.col("m.f").alias("factor"))
        out = out.withColumn("tile_r", F.floor(F.col("row") / tile).cast("int")).withColumn(
            "tile_c", F.floor(F.col("col") / tile).cast("int")).filter("tile_r <> o_r OR tile_c <> o_c")
        out = out.join(present, [*key, "tile_r", "tile_c"], "left_semi")  # nothing is sent to where no cell is open
        # the labels of the goals are kept from round to round
        hit = improved.join(wanted.select(*key, "row", "col"), [*key, "row", "col"]).select(*key, "row", "col", "g")
        met = write_table((hit if met is None else met.unionByName(hit)).groupBy(*key, "row", "col").agg(F.min("g").alias("g")), "met-goals")
        bound = met.groupBy(*key).agg(F.count(F.lit(1)).alias("n"), F.max("g").alias("bound")).join(asked, key).filter("n = n_goals").select(*key, "bound")
        out = out.join(bound, key, "left").filter("bound IS NULL OR base < bound")
        messages = write_table(out.select(*key, "tile_r", "tile_c", "row", "col", "base", "factor"), "messages")
        if not messages.limit(1).count():
            break
    if len(rounds) == 1:  # no label of a tile was improved later
        return rounds[0].select(*key, "row", "col", "g", "cost")
    return write_table(labels(rounds), "labels")


def labels(rounds: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, rounds).groupBy("mission_id", "region", "row", "col").agg(
        F.min("g").alias("g"), F.max("cost").alias("cost"))


def _settle(tile: int):
    def settle(rows: pd.DataFrame) -> pd.DataFrame:
        """Improved labels of every tile of a batch."""
        row, col, cost_of, base, factor = (rows[c].to_numpy() for c in ("row", "col", "cost", "base", "factor"))
        tile_r, tile_c = rows["tile_r"].to_numpy(), rows["tile_c"].to_numpy()
        is_cell = ~np.isnan(cost_of)
        firsts, parts = [], []
        for lo, hi in groups(rows, GROUP):
            r0, c0 = int(tile_r[lo]) * tile, int(tile_c[lo]) * tile
            cost, before = np.full((tile, tile), np.inf), np.full((tile, tile), np.inf)
            r, c, cell, f, b = row[lo:hi] - r0, col[lo:hi] - c0, is_cell[lo:hi], factor[lo:hi], base[lo:hi]
            cost[r[cell], c[cell]] = cost_of[lo:hi][cell]
            known, goal, fresh = ~cell & (f == KNOWN), ~cell & (f == GOAL), ~cell & (f >= 0)
            np.minimum.at(before, (r[known], c[known]), b[known])
            g, fr, fc = before.copy(), r[fresh], c[fresh]
            # a start enters at 0; any other label pays for the cell it enters, and a blocked cell stays out of reach
            price = np.where(f[fresh] == 0, 0.0, f[fresh] * cost[fr, fc])
            np.minimum.at(g, (fr, fc), b[fresh] + price)
            g = _sweep(cost, g)
            better = g < before
            if goal.any() and goal.sum() == b[goal][0]:  # this tile holds all goals, so nothing dearer is asked for
                better &= g <= g[r[goal], c[goal]].max()
            rr, cc = np.nonzero(better)
            firsts.append((lo, len(rr)))
            parts.append((rr + r0, cc + c0, g[rr, cc], cost[rr, cc]))
        at = np.repeat([lo for lo, _ in firsts], [n for _, n in firsts]).astype(int)
        out = rows.iloc[at][GROUP].reset_index(drop=True)
        for name, values in zip(("row", "col", "g", "cost"), zip(*parts, strict=True), strict=True):
            out[name] = np.concatenate(values).astype("int32" if name in ("row", "col") else "float64")
        return out

    return settle


def trace(found: DataFrame, starts: DataFrame, goals: DataFrame, tile: int = TILE) -> DataFrame:
    """Ordered steps from each mission's start to its goal, walked back one tile per task and round.

    A walking task holds the labels of one tile and of the ring around it, enough to find the neighbour that each label
    came through; only tiles on a path are ever visited.
    """
    key = ["mission_id", "region"]
    goals = goals.select(*key, "row", "col")
    ends = goals.join(found, [*key, "row", "col"]).select(*key, F.col("g").alias("goal_g"))

    def ring(axis: str) -> Column:
        lo, hi = F.floor((F.col(axis) - 1) / tile).cast("int"), F.floor((F.col(axis) + 1) / tile).cast("int")
        return F.explode(F.sequence(lo, hi))

    near = found.join(ends, key).filter("g <= goal_g").select(*key, "row", "col", "g", "cost", ring("row").alias("tile_r"))
    near = write_table(near.select("*", ring("col").alias("tile_c")).repartition(*key, "tile_r", "tile_c"), "near")
    first = starts.select(*key, F.col("row").alias("s_row"), F.col("col").alias("s_col"))
    walkers = write_table(goals.join(ends, key).select(
        *key, F.col("row").cast("int").alias("row"), F.col("col").cast("int").alias("col"), F.lit(0).alias("k")), "walkers")
    pieces: list[DataFrame] = []
    while walkers.limit(1).count():
        here = walkers.withColumn("tile_r", F.floor(F.col("row") / tile).cast("int")).withColumn(
            "tile_c", F.floor(F.col("col") / tile).cast("int")).withColumnsRenamed({"row": "w_row", "col": "w_col"})
        work = near.join(here.join(first, key), [*key, "tile_r", "tile_c"])
        group = [*key, "tile_r", "tile_c"]
        walked = write_table(work.repartition(*group).sortWithinPartitions(*group).mapInPandas(
            whole_groups(group, _walk(tile), BATCH_ROWS), "mission_id string, region string, row int, col int, k int, inside boolean"), "walked")
        pieces.append(walked.filter("inside"))
        walkers = walked.filter("NOT inside").select(*key, "row", "col", "k")
    if not pieces:
        return found.select(*key, F.lit(0).alias("step"), "row", "col").limit(0)
    steps = reduce(DataFrame.unionByName, pieces)
    total = steps.groupBy(*key).agg(F.max("k").alias("last"))
    return steps.join(total, key).select(*key, (F.col("last") - F.col("k")).cast("int").alias("step"), "row", "col")


def _walk(tile: int):
    def walk(rows: pd.DataFrame) -> pd.DataFrame:
        """Follow the cheapest incoming move until the start or the tile's edge; a last row outside enters the next tile."""
        names = ("row", "col", "g", "cost", "tile_r", "tile_c", "s_row", "s_col", "w_row", "w_col", "k")
        col = {c: rows[c].to_numpy() for c in names}
        firsts, steps = [], []
        for lo, hi in groups(rows, GROUP):
            home_r, home_c = int(col["tile_r"][lo]) * tile - 1, int(col["tile_c"][lo]) * tile - 1
            g, cost = np.full((tile + 2, tile + 2), np.inf), np.full((tile + 2, tile + 2), np.inf)
            rr, cc = col["row"][lo:hi] - home_r, col["col"][lo:hi] - home_c
            g[rr, cc], cost[rr, cc] = col["g"][lo:hi], col["cost"][lo:hi]
            start = (int(col["s_row"][lo]) - home_r, int(col["s_col"][lo]) - home_c)
            r, c, k, inside = int(col["w_row"][lo]) - home_r, int(col["w_col"][lo]) - home_c, int(col["k"][lo]), True
            path = [(r + home_r, c + home_c, k, True)]
            while (r, c) != start and inside:
                offers = [(g[r + dr, c + dc] + cost[r, c] * (SQRT2 if dr and dc else 1.0), r + dr, c + dc) for dr, dc in MOVES]
                _, r, c = min(offers)
                k, inside = k + 1, 1 <= r <= tile and 1 <= c <= tile
                path.append((r + home_r, c + home_c, k, inside))
            firsts.append((lo, len(path)))
            steps += path
        at = np.repeat([lo for lo, _ in firsts], [n for _, n in firsts])
        out = rows.iloc[at][GROUP[:2]].reset_index(drop=True)
        row, column, k, inside = zip(*steps, strict=True)
        return out.assign(row=np.array(row, "int32"), col=np.array(column, "int32"), k=np.array(k, "int32"), inside=np.array(inside, bool))

    return walk
