"""Density clusters found tile by tile.

Space is cut into cells of diameter eps and tiles of some cells a side. A task holds whole tiles: it counts neighbours and links cells
there, with vectors over all cells of its tiles at once. Only points within eps of a tile's side are copied to the next tile, and what leaves
a task is one row for a position and one for a cell; pairs of points are never written or shuffled.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from functools import reduce
from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from selenogrid.operators.batches import starts_group, whole_groups
from selenogrid.session import write_table

#: Rows that a task works on at once; a tile is never parted.
BATCH_ROWS = 100_000
#: Pairs that are compared at once.
CHUNK = 1_000_000
#: Cells that a neighbour may be away, and what a copy may lie outside its tile.
FAR = 3
#: What a row of a tile's findings tells: the component of a position, of a cell at home, of a cell seen from another tile.
PLACE, HOME, COPY = 0, 1, 2


def offsets(k: int) -> list[tuple[int, ...]]:
    """Moves to all cells that may hold a neighbour, the nearest first."""
    gap = {o: sum(max(0, abs(i) - 1) ** 2 for i in o) for o in product(range(-FAR, FAR + 1), repeat=k)}
    return sorted((o for o in gap if gap[o] <= k), key=lambda o: (gap[o], sum(i * i for i in o)))


class Places:
    """Rows of whole tiles: where each lies, as one number for tile and cell together."""

    def __init__(self, rows: pd.DataFrame, keys: Sequence[str], features: Sequence[str], side: float, wide: int):
        k, radix = len(features), wide + 4 * FAR
        self.x, code = rows[features].to_numpy(), rows["_o"].to_numpy()
        self.own, self.key = code == 3**k // 2, np.cumsum(starts_group(rows, keys)).astype(np.int64)
        for i in range(k):
            cell = np.floor(self.x[:, i] / side).astype(np.int64)
            home = cell // wide + code // 3 ** (k - 1 - i) % 3 - 1
            self.key = self.key * radix + (cell - home * wide + 2 * FAR)
        self.moves = [sum(o[i] * radix ** (k - 1 - i) for i in range(k)) for o in offsets(k)]


class Cells:
    """Points sorted by cell, with the bounds of each cell."""

    def __init__(self, key: np.ndarray, x: np.ndarray):
        self.order = np.argsort(key, kind="stable")
        self.x = x[self.order]
        self.keys, self.start, self.size = np.unique(key[self.order], return_index=True, return_counts=True)
        self.lo, self.hi = (f.reduceat(self.x, self.start) if len(key) else self.x for f in (np.minimum, np.maximum))

    def find(self, key: np.ndarray) -> np.ndarray:
        """The cell with each key, -1 where there is none."""
        if not len(self.keys):
            return np.full(len(key), -1)
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, at, -1)


def _square(parts: np.ndarray) -> np.ndarray:
    """Sum of squares in the order of the features, as any engine adds them."""
    return reduce(lambda a, b: a + b, [parts[:, i] * parts[:, i] for i in range(parts.shape[1])])


def _gap2(lo: np.ndarray, hi: np.ndarray, cells: Cells, b: np.ndarray) -> np.ndarray:
    return _square(np.maximum(0.0, np.maximum(lo - cells.hi[b], cells.lo[b] - hi)))


def _span2(lo: np.ndarray, hi: np.ndarray, cells: Cells, b: np.ndarray) -> np.ndarray:
    return _square(np.maximum(hi - cells.lo[b], cells.hi[b] - lo))


def _chunks(sizes: np.ndarray) -> Iterator[slice]:
    """Slices of consecutive items, of about as many pairs as are compared at once."""
    upto = np.cumsum(sizes)
    at = 0
    while at < len(sizes):
        end = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + CHUNK, "right")))
        yield slice(at, end)
        at = end


def _members(cells: Cells, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Every point of the cells ``b``, with its place in ``b``."""
    n = cells.size[b]
    which = np.repeat(np.arange(len(b)), n)
    return which, cells.start[b][which] + np.arange(len(which)) - (np.cumsum(n) - n)[which]


def counted(p: Places, asked: np.ndarray, cells: Cells, w: np.ndarray, eps2: float, enough: int) -> np.ndarray:
    """Weight of the cells' points within reach of each row asked for; counting may end once it is ``enough``."""
    n, left = np.zeros(len(asked), np.int64), np.arange(len(asked))
    total = np.add.reduceat(w, cells.start) if len(w) else w
    for move in p.moves:
        left = left[n[left] < enough]
        if not len(left):
            break
        b = cells.find(p.key[asked[left]] + move)
        a, b = left[b >= 0], b[b >= 0]
        x = p.x[asked[a]]
        sure, near = _span2(x, x, cells, b) <= eps2, _gap2(x, x, cells, b) <= eps2
        n[a[sure]] += total[b[sure]]
        a, b = a[near & ~sure], b[near & ~sure]
        for part in _chunks(cells.size[b]):
            which, at = _members(cells, b[part])
            hit = _square(p.x[asked[a[part]]][which] - cells.x[at]) <= eps2
            n[a[part]] += np.bincount(which, w[at] * hit, len(a[part])).astype(np.int64)
    return n


def _joined(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Links make one of two components; every item then points to the first of its own."""
    while True:
        a, b = root[a], root[b]
        a, b = a[a != b], b[a != b]
        if not len(a):
            return
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while (root[root] != root).any():
            root[:] = root[root]


def _touch(cells: Cells, a: int, b: int, eps2: float) -> bool:
    """Whether two cells of many points hold a pair within reach; only what is near the other cell's bounds is compared."""
    sides = []
    for one, other in ((a, b), (b, a)):
        x = cells.x[cells.start[one]:cells.start[one] + cells.size[one]]
        sides.append(x[_gap2(x, x, cells, np.full(len(x), other)) <= eps2])
    x, y = sides
    step = max(1, CHUNK // max(1, len(y)))
    for at in range(0, len(x), step):
        part = x[at:at + step]
        if (_square(np.repeat(part, len(y), 0) - np.tile(y, (len(part), 1))) <= eps2).any():
            return True
    return False


def linked(p: Places, cells: Cells, own: np.ndarray, eps2: float) -> np.ndarray:
    """Component of every cell: two are linked by any two points within reach. Cells that are both copies are linked where they are at home."""
    root, waiting = np.arange(len(cells.keys)), []
    for move in p.moves:
        if move <= 0:  # every pair once, and a cell's own points are within reach of each other
            continue
        b = cells.find(cells.keys + move)
        a = np.flatnonzero(b >= 0)
        b = b[a]
        keep = (own[a] | own[b]) & (root[a] != root[b])
        a, b = a[keep], b[keep]
        lo, hi = cells.lo[a], cells.hi[a]
        sure, near = _span2(lo, hi, cells, b) <= eps2, _gap2(lo, hi, cells, b) <= eps2
        _joined(root, a[sure], b[sure])
        waiting.append(np.stack([a[near & ~sure], b[near & ~sure]]))
    if not waiting:
        return root
    a, b = np.concatenate(waiting, axis=1)
    order = np.argsort(cells.size[a] * cells.size[b], kind="stable")
    a, b = a[order], b[order]
    while len(a):
        keep = root[a] != root[b]
        a, b = a[keep], b[keep]
        part = next(_chunks(cells.size[a] * cells.size[b]), slice(0))
        a0, b0, a, b = a[part], b[part], a[part.stop:], b[part.stop:]
        if len(a0) == 1 and cells.size[a0[0]] * cells.size[b0[0]] > CHUNK:
            hit = np.array([_touch(cells, a0[0], b0[0], eps2)])
        elif len(a0):
            which, at = _members(cells, a0)
            again, other = _members(cells, b0[which])
            near = _square(cells.x[at][again] - cells.x[other]) <= eps2
            hit = np.bincount(which[again], near, len(a0)) > 0
        else:
            break
        _joined(root, a0[hit], b0[hit])
    return root


def met(p: Places, asked: np.ndarray, cells: Cells, root: np.ndarray, eps2: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of a row asked for and a component of which a point is within its reach."""
    got = [], []
    for move in p.moves:
        b = cells.find(p.key[asked] + move)
        a = np.flatnonzero(b >= 0)
        b = b[a]
        x = p.x[asked[a]]
        near = _gap2(x, x, cells, b) <= eps2
        a, b = a[near], b[near]
        for part in _chunks(cells.size[b]):
            which, at = _members(cells, b[part])
            hit = np.bincount(which, _square(p.x[asked[a[part]]][which] - cells.x[at]) <= eps2, len(a[part])) > 0
            got[0].append(a[part][hit])
            got[1].append(root[b[part][hit]])
    a, c = (np.concatenate(g) if g else np.empty(0, np.int64) for g in got)
    pairs = np.unique(np.stack([a, c], 1), axis=0) if len(a) else np.empty((0, 2), np.int64)
    return asked[pairs[:, 0]], pairs[:, 1]


class Tiles:
    """Positions in tiles of ``wide`` cells a side; a step sends them to their tiles, and some of them to tiles that their balls touch."""

    def __init__(self, by: list[str], features: list[str], eps: float, wide: int):
        self.by, self.features, self.eps, self.wide = by, features, eps, wide
        self.k, self.side = len(features), eps / len(features)**0.5

    def tile(self, at: Column) -> Column:
        return F.floor(F.floor(at / self.side) / self.wide)

    def leaves(self) -> Column:
        """Whether the ball around a position touches another tile."""
        edge = self.eps * (1 + 1e-9)  # what lies at eps itself must not be lost to rounding
        return reduce(lambda x, y: x | y, [self.tile(F.col(f) - edge) != self.tile(F.col(f) + edge) for f in self.features])

    def sent(self, df: DataFrame, copied: Column) -> DataFrame:
        """Rows sorted by tile; those ``copied`` also in every other tile that their ball touches. ``_o`` says which one, seen from home."""
        edge = self.eps * (1 + 1e-9)
        for i, f in enumerate(self.features):
            x, home = F.col(f), self.tile(F.col(f))
            lo, hi = (F.when(copied, self.tile(end)).otherwise(home) for end in (x - edge, x + edge))
            df = df.withColumn(f"_t{i}", F.explode(F.sequence(lo, hi)))
        code = reduce(lambda a, b: a * 3 + b, [F.col(f"_t{i}") - self.tile(F.col(f)) + 1 for i, f in enumerate(self.features)])
        parts = [f"_t{i}" for i in range(self.k)]
        return df.withColumn("_o", code.cast("int")).withColumn("_t", F.xxhash64(*parts)).drop(*parts)

    def work(self, df: DataFrame, do: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
        keys = [*self.by, "_t"]
        return df.repartition(*keys).sortWithinPartitions(*keys).mapInPandas(whole_groups(keys, do, BATCH_ROWS), schema)

    def places(self, rows: pd.DataFrame) -> Places:
        return Places(rows, [*self.by, "_t"], self.features, self.side, self.wide)


def density_cluster(points: DataFrame, pos: DataFrame, tiles: Tiles, min_samples: int, components: Callable[..., DataFrame]) -> DataFrame:
    """``(by, id, cluster)`` of points whose distinct positions are ``pos``; see :func:`cluster.density_cluster`."""
    by, features, eps2 = tiles.by, tiles.features, tiles.eps * tiles.eps
    types = {**{c: points.schema[c].dataType.simpleString() for c in by}, **{f: "double" for f in features}}
    group = ", ".join(f"`{c}` {types[c]}" for c in by)
    shape = ", ".join(f"`{f}` double" for f in features)
    middle, open_ = 3**tiles.k // 2, tiles.leaves()

    def first(rows: pd.DataFrame) -> pd.DataFrame:
        """Neighbours in the tile itself, and the cell's least id."""
        p = tiles.places(rows)
        cells, w, pid = Cells(p.key, p.x), rows["w"].to_numpy(), rows["pid"].to_numpy()
        n = counted(p, np.arange(len(rows)), cells, w[cells.order], eps2, min_samples)
        node = np.empty(len(rows), np.int64)
        node[cells.order] = np.repeat(np.minimum.reduceat(pid[cells.order], cells.start), cells.size)
        return rows[[*by, *features, "pid", "w"]].assign(n=n, node=node)

    own = tiles.sent(pos, F.lit(False))
    pos = write_table(tiles.work(own, first, f"{group}, {shape}, pid bigint, w bigint, n bigint, node bigint"), "positions")

    def second(rows: pd.DataFrame) -> pd.DataFrame:
        """Neighbours in the tiles next to a position's own."""
        p = tiles.places(rows)
        home, away = np.flatnonzero(p.own), np.flatnonzero(~p.own)
        cells = Cells(p.key[home], p.x[home])
        n = counted(p, away, cells, rows["w"].to_numpy()[home][cells.order], eps2, min_samples)
        return rows.iloc[away][[*by, "pid"]].assign(n=n)[n > 0]

    # only what is near a side counts for other tiles
    asks = F.col("n") < min_samples
    near = tiles.sent(pos.filter(open_), asks)
    more = tiles.work(near, second, f"{group}, pid bigint, n bigint")
    few = pos.filter(asks & open_)
    reached = few.select(*by, "pid", "n").unionByName(more).groupBy(*by, "pid").agg(F.sum("n").alias("n")).filter(F.col("n") >= min_samples)
    late = few.join(reached.select(*by, "pid", F.lit(True).alias("late")), [*by, "pid"], "left")
    flagged = pos.filter(~(asks & open_)).withColumn("core", ~asks).unionByName(late.withColumn("core", F.coalesce("late", F.lit(False))).drop("late"))

    def third(rows: pd.DataFrame) -> pd.DataFrame:
        """Components of the cells with core points, and the borders that they reach."""
        p, core, pid, node = tiles.places(rows), rows["core"].to_numpy(), rows["pid"].to_numpy(), rows["node"].to_numpy()
        some = np.flatnonzero(core)
        cells = Cells(p.key[some], p.x[some])
        at = some[cells.order]
        lead = at[cells.start]
        mine = p.own[lead]
        root = linked(p, cells, mine, eps2)
        # a component is named by a cell of the tile itself; one without any is some other tile's to tell
        name = np.full(len(root), -1)
        np.maximum.at(name, root[mine], np.flatnonzero(mine))
        low = np.minimum.reduceat(pid[at], cells.start) if len(at) else pid[:0]
        rep = np.where(name[root] >= 0, node[lead[name[root]]], -1) if len(at) else pid[:0]
        told = name[root] >= 0 if len(at) else np.empty(0, bool)
        blank = {f: np.nan for f in features}
        star = rows.iloc[lead[told]][by].assign(**blank, kind=np.where(mine, HOME, COPY)[told], node=node[lead[told]], rep=rep[told], low=low[told])
        home = np.flatnonzero(p.own[at])
        cell_of = np.repeat(np.arange(len(cells.keys)), cells.size)
        inside = rows.iloc[at[home]][[*by, *features]].assign(kind=PLACE, node=0, rep=rep[cell_of[home]], low=0)
        own_cells = Cells(p.key[at[home]], p.x[at[home]])
        own_root = root[mine]
        asked = np.flatnonzero(~core)
        border, comp = met(p, asked, own_cells, own_root, eps2)
        outside = rows.iloc[border][[*by, *features]].assign(kind=PLACE, node=0, rep=rep[comp], low=0)
        return pd.concat([star, inside, outside], ignore_index=True)

    # a pair of cells in two tiles is settled in the later one; a border is looked at in all of its tiles
    sent = tiles.sent(flagged.select(*by, *features, "pid", "node", "core"), F.lit(True)).filter(~F.col("core") | (F.col("_o") >= middle))
    found = write_table(tiles.work(sent, third, f"{group}, {shape}, kind int, node bigint, rep bigint, low bigint"), "tile-parts")
    own = found.filter(F.col("kind") == HOME)
    links = found.filter(F.col("kind") == COPY).select(*by, "node", F.col("rep").alias("a_node")).join(
        own.select(*by, "node", F.col("rep").alias("b_node")), [*by, "node"]).select(*by, "a_node", "b_node").distinct()
    lowest = write_table(own.groupBy(*by, F.col("rep").alias("node")).agg(F.min("low").alias("low")), "tile-parts")
    whole = components(lowest.select(*by, "node"), links, by)
    named = whole.join(lowest, [*by, "node"])
    label = named.groupBy(*by, "label").agg(F.min("low").alias("cluster"))
    names = named.join(label, [*by, "label"]).select(*by, F.col("node").alias("rep"), "cluster")
    labelled = found.filter(F.col("kind") == PLACE).join(names, [*by, "rep"]).groupBy(*by, *features).agg(F.min("cluster").alias("cluster"))
    return points.join(labelled, [*by, *features], "left").select(*by, "id", "cluster")
