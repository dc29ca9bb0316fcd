"""Neighbours and density clustering of low-dimensional points by grid joins.

Points are rows ``(by, id, f0..fk)``. No step compares all points of a bucket with each other: identical points are
collapsed, and clusters are found tile by tile (``cluster_tiles``). Where a tile would hold too much for a task, buckets of diameter eps that
hold enough points become one node instead, and touching of two buckets is settled by bounding boxes that are refined only where they
straddle eps.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from selenogrid.operators import cluster_tiles
from selenogrid.operators.quantiles import running_counts
from selenogrid.session import write_table

#: Nodes that a node may meet, on average, in the buckets of a join.
MOST_CANDIDATES = 2048
#: Positions of a bucket that are compared with one another in one task.
MOST_IN_BUCKET = 1000
#: Positions of a tile that one task holds, and the sides a tile may have, in cells of diameter eps.
MOST_IN_TILE = 400_000
TILE_SIDES = (16, 8, 4)


def standardize(df: DataFrame, features: Sequence[str], by: Sequence[str]) -> DataFrame:
    """Zero mean and unit population deviation within ``by``; a constant feature keeps scale 1."""
    stats = df.groupBy(*by).agg(*[F.avg(f).alias(f"_m_{f}") for f in features], *[F.stddev_pop(f).alias(f"_s_{f}") for f in features])
    work = df.join(stats, list(by))
    scaled = {f: (F.col(f) - F.col(f"_m_{f}")) / F.when(F.col(f"_s_{f}") > 0, F.col(f"_s_{f}")).otherwise(1.0) for f in features}
    return work.select(*[scaled[c].alias(c) if c in scaled else F.col(c) for c in df.columns])


def _key(features: Sequence[str], side: float, origin: Sequence[float] | None = None) -> Column:
    return F.array(*[F.floor((F.col(f) - o) / side) for f, o in zip(features, origin or [0.0] * len(features), strict=True)])


def _in_reach(df: DataFrame, lo: Sequence[Column], hi: Sequence[Column], side: float, out: str) -> DataFrame:
    """A copy of each row for every bucket of this side that its box ``lo`` to ``hi`` touches."""
    for i, (x, y) in enumerate(zip(lo, hi, strict=True)):
        df = df.select("*", F.explode(F.sequence(F.floor(x / side), F.floor(y / side))).alias(f"_r{i}"))
    parts = [f"_r{i}" for i in range(len(lo))]
    return df.withColumn(out, F.array(*parts)).drop(*parts)


def _dist2(features: Sequence[str], a: str, b: str) -> Column:
    terms = [(F.col(f"{a}_{f}") - F.col(f"{b}_{f}")) * (F.col(f"{a}_{f}") - F.col(f"{b}_{f}")) for f in features]
    return reduce(lambda x, y: x + y, terms)


def _box_gap2(features: Sequence[str]) -> Column:
    """Squared least distance of two boxes ``a`` and ``b``."""
    gaps = [F.greatest(F.lit(0.0), F.col(f"a_lo_{f}") - F.col(f"b_hi_{f}"), F.col(f"b_lo_{f}") - F.col(f"a_hi_{f}")) for f in features]
    return reduce(lambda x, y: x + y, [g * g for g in gaps])


def _box_span2(features: Sequence[str]) -> Column:
    """Squared largest distance of two boxes."""
    spans = [F.greatest(F.col(f"a_hi_{f}") - F.col(f"b_lo_{f}"), F.col(f"b_hi_{f}") - F.col(f"a_lo_{f}")) for f in features]
    return reduce(lambda x, y: x + y, [s * s for s in spans])


def _boxes(df: DataFrame, group: Sequence[str], features: Sequence[str]) -> DataFrame:
    return df.groupBy(*group).agg(
        F.sum("w").alias("w"), *[F.min(f).alias(f"lo_{f}") for f in features], *[F.max(f).alias(f"hi_{f}") for f in features])


def _prefixed(df: DataFrame, keep: Sequence[str], p: str) -> DataFrame:
    return df.select(*[c if c in keep else F.col(c).alias(f"{p}_{c}") for c in df.columns])


def collapse(points: DataFrame, by: Sequence[str], features: Sequence[str]) -> DataFrame:
    """Distinct positions with their weight and smallest id."""
    return points.groupBy(*by, *features).agg(F.count(F.lit(1)).alias("w"), F.min("id").alias("pid"))


def density_cluster(
    points: DataFrame, features: Sequence[str], eps: float, min_samples: int, by: Sequence[str]
) -> DataFrame:
    """``(by, id, cluster)``: cluster is the smallest core id of the point's cluster, NULL for noise.

    A point is core when at least ``min_samples`` points, itself included, lie within eps. A border point joins the
    reachable cluster with the smallest label.
    """
    by, features = list(by), list(features)
    pos = write_table(collapse(points, by, features), "distinct")
    wide = _tile_side(pos, by, features, eps)
    if wide:
        return cluster_tiles.density_cluster(points, pos, cluster_tiles.Tiles(by, features, eps, wide), min_samples, components)
    return _by_buckets(points, pos, features, eps, min_samples, by)


def _tile_side(pos: DataFrame, by: list[str], features: list[str], eps: float) -> int | None:
    """Cells along a tile: as many as leave no more positions in it than a task holds; None where even the smallest tile holds more."""
    if len(features) > 4:  # the cells around a cell would be too many to look at
        return None
    at = [f"_t{i}" for i in range(len(features))]
    smallest = cluster_tiles.Tiles(by, features, eps, min(TILE_SIDES))
    tiles = pos.select(*by, *[smallest.tile(F.col(f)).alias(t) for f, t in zip(features, at, strict=True)]).groupBy(*by, *at).count()
    tiles = write_table(tiles, "tile-sizes")
    for wide in TILE_SIDES:
        up = [F.floor(F.col(t) / (wide // min(TILE_SIDES))).alias(t) for t in at]
        most = tiles.groupBy(*by, *up).agg(F.sum("count").alias("n")).agg(F.max("n")).first()[0]
        if (most or 0) <= MOST_IN_TILE:
            return wide
    return None


def _by_buckets(points: DataFrame, pos: DataFrame, features: list[str], eps: float, min_samples: int, by: list[str]) -> DataFrame:
    """The same by joins of nodes, which spill where a tile would not fit a task."""
    k = len(features)
    fine_side = eps / k**0.5
    pos = pos.withColumn("cell", _key(features, fine_side))
    sizes = pos.groupBy(*by, "cell").agg(F.sum("w").alias("cell_w"), F.min("pid").alias("cell_pid"))
    pos = pos.join(sizes, [*by, "cell"])
    # a crowded cell is one node; any other position is a node of its own
    crowded = F.col("cell_w") >= min_samples
    pos = pos.withColumn("crowded", crowded).withColumn("node", F.when(crowded, F.col("cell_pid")).otherwise(F.col("pid")))
    pos = write_table(pos.drop("cell", "cell_w", "cell_pid"), "positions")
    side = _join_side(pos, by, features, eps)
    pos = pos.withColumn("wide", _key(features, side))
    # nodes with bounding boxes; a node may lie in several buckets of the join, so it is kept apart by them
    boxes = _boxes(pos, [*by, "wide", "node", "crowded"], features)
    edge = eps * (1 + 1e-9)  # what lies at eps itself must not be lost to rounding
    left = _in_reach(_prefixed(boxes, by, "a"),
                     [F.col(f"a_lo_{f}") - edge for f in features], [F.col(f"a_hi_{f}") + edge for f in features], side, "b_wide")
    near = left.join(_prefixed(boxes, by, "b"), [*by, "b_wide"]).filter(_box_gap2(features) <= eps * eps)
    # pairs of crowded nodes only matter as links, which have no direction
    near = write_table(near.filter("NOT a_crowded OR a_node < b_node"), "near")
    # 1. core test of lone positions: whole boxes within eps count at once, straddling crowded ones point by point
    lone = near.filter("NOT a_crowded")
    inside = _box_span2(features) <= eps * eps
    whole = lone.filter(inside | ~F.col("b_crowded")).select(
        *by, F.col("a_node").alias("node"), F.col("b_w").alias("n"))  # lone boxes are points, so the gap decided them
    split = lone.filter(~inside & F.col("b_crowded"))
    part = _point_pairs(split, pos, by, features).filter(_dist2(features, "a", "b") <= eps * eps)
    counts = whole.unionByName(part.select(*by, F.col("a_node").alias("node"), F.col("b_w").alias("n")))
    lone_core = counts.groupBy(*by, "node").agg(F.sum("n").alias("n")).filter(F.col("n") >= min_samples).select(*by, "node")
    core = lone_core.unionByName(pos.filter("crowded").select(*by, "node").distinct())
    core = write_table(core, "core")
    # 2. links between core nodes, each pair settled by boxes first
    ends = core.select(*by, F.col("node").alias("a_node")), core.select(*by, F.col("node").alias("b_node"))
    pairs = near.filter("a_node < b_node").join(ends[0], [*by, "a_node"], "left_semi").join(ends[1], [*by, "b_node"], "left_semi")
    parts = _linked(core, pairs, pos, by, features, eps, fine_side)
    # 3. borders take the smallest label among core nodes within eps
    border = near.join(parts.select(*by, F.col("node").alias("b_node"), "label"), [*by, "b_node"]).filter("NOT a_crowded").join(
        core.select(*by, F.col("node").alias("a_node")), [*by, "a_node"], "left_anti")
    sure = border.filter(inside | ~F.col("b_crowded")).select(*by, F.col("a_node").alias("node"), "label")
    open_ = border.filter(~inside & F.col("b_crowded"))
    part = _point_pairs(open_, pos, by, features, ["label"]).filter(_dist2(features, "a", "b") <= eps * eps)
    attached = sure.unionByName(part.select(*by, F.col("a_node").alias("node"), "label")).groupBy(*by, "node").agg(F.min("label").alias("label"))
    named = parts.unionByName(attached)
    by_position = pos.join(named, [*by, "node"], "left").select(*by, *features, F.col("label").alias("cluster"))
    return points.join(by_position, [*by, *features], "left").select(*by, "id", "cluster")


def _point_pairs(pairs: DataFrame, pos: DataFrame, by: list[str], features: list[str], keep: Sequence[str] = ()) -> DataFrame:
    """Lone ``a`` positions against the positions of crowded node ``b``; few ``a`` rows meet any one ``b`` position."""
    a = pairs.select(*by, "a_node", *[F.col(f"a_lo_{f}").alias(f"a_{f}") for f in features], "b_node", "b_wide", *keep)
    b = pos.select(*by, F.col("node").alias("b_node"), F.col("wide").alias("b_wide"), F.col("w").alias("b_w"),
                   *[F.col(f).alias(f"b_{f}") for f in features])
    return a.join(b, [*by, "b_node", "b_wide"])


def _join_side(pos: DataFrame, by: list[str], features: list[str], eps: float) -> float:
    """Side of the buckets in which nodes meet: the widest, so that a node is copied to few of them, that leaves few candidates."""
    for wide in (4, 2):
        nodes = pos.select(*by, "node", _key(features, wide * eps).alias("c")).distinct()
        met = nodes.groupBy(*by, "c").count().agg((F.sum(F.col("count") * F.col("count")) / F.sum("count")).alias("m")).first()["m"]
        if met is None or met * (1 + 2 / wide) ** len(features) <= MOST_CANDIDATES:
            return wide * eps
    return eps


def _linked(core: DataFrame, pairs: DataFrame, pos: DataFrame, by: list[str], features: list[str], eps: float, side: float) -> DataFrame:
    """Components of core nodes, of which two are linked by any two points within eps.

    Boxes surely within eps link their nodes. Of the other pairs only those that nothing else has joined yet are refined, and of them only
    the parts of boxes that straddle eps: to an eighth of the side, and so on down to single positions.
    """
    key, sure = [*by, "a_node", "b_node"], _box_span2(features) <= eps * eps
    parts = components(core, pairs.filter(sure).select(*key), by)
    open_ = pairs.filter(~sure).select(*key, "a_wide", "b_wide", F.lit(None).cast("array<bigint>").alias("a_sub"), F.lit(None).cast("array<bigint>").alias("b_sub"))
    up = None
    for level in (side / 8, side / 64, side / 4096, 0.0):
        ends = [parts.select(*by, F.col("node").alias(f"{p}_node"), F.col("label").alias(f"_{p}")) for p in "ab"]
        todo = write_table(open_.join(ends[0], [*by, "a_node"]).join(ends[1], [*by, "b_node"]).filter("_a <> _b").drop("_a", "_b").distinct(), "straddling")
        if not todo.limit(1).count():
            break
        sub = _key(features, level) if level else F.array("pid")
        cells = _boxes(pos.withColumn("up", _key(features, up) if up else F.lit(0)).withColumn("sub", sub), [*by, "node", "wide", "up", "sub"], features)
        met = todo.withColumnsRenamed({"a_sub": "a_up", "b_sub": "b_up"})
        for p in "ab":
            on = [*by, f"{p}_node", f"{p}_wide", *([f"{p}_up"] if up else [])]
            met = (met if up else met.drop(f"{p}_up")).join(_prefixed(cells if up else cells.drop("up"), by, p).drop(f"{p}_w"), on)
        done = met.filter(_box_gap2(features) <= eps * eps).select(*key, "a_wide", "b_wide", "a_sub", "b_sub", sure.alias("sure"))
        if not level:  # of single positions the gap is the distance
            return _merged(parts, done.select(*key), by)
        done = write_table(done, "links")
        parts, open_, up = _merged(parts, done.filter("sure").select(*key), by), done.filter("NOT sure").drop("sure"), level
    return parts


def _merged(parts: DataFrame, links: DataFrame, by: list[str]) -> DataFrame:
    """Components that links join become one."""
    ends = [parts.select(*by, F.col("node").alias(f"{p}_node"), F.col("label").alias(f"_{p}")) for p in "ab"]
    pairs = links.distinct().join(ends[0], [*by, "a_node"]).join(ends[1], [*by, "b_node"]).filter("_a <> _b")
    pairs = write_table(pairs.select(*by, F.col("_a").alias("a_node"), F.col("_b").alias("b_node")).distinct(), "joined")
    if not pairs.limit(1).count():
        return parts
    nodes = pairs.select(*by, F.col("a_node").alias("node")).unionByName(pairs.select(*by, F.col("b_node").alias("node"))).distinct()
    roots = components(nodes, pairs, by).select(*by, F.col("node").alias("label"), F.col("label").alias("root"))
    return write_table(parts.join(roots, [*by, "label"], "left").select(*by, "node", F.coalesce("root", "label").alias("label")), "parts")


def components(nodes: DataFrame, links: DataFrame, by: Sequence[str]) -> DataFrame:
    """Smallest node id of every connected component, by minimum labels with pointer jumping, one written table a round."""
    by = list(by)
    both = links.select(*by, F.col("a_node").alias("node"), F.col("b_node").alias("other")).unionByName(
        links.select(*by, F.col("b_node").alias("node"), F.col("a_node").alias("other")))
    both = write_table(both.distinct(), "edges")
    state = write_table(nodes.select(*by, "node", F.col("node").alias("label")), "parts")
    while True:
        offers = both.join(state.select(*by, F.col("node").alias("other"), F.col("label").alias("seen")), [*by, "other"])
        low = state.select(*by, "node", F.col("label").alias("seen")).unionByName(offers.select(*by, "node", "seen"))
        low = low.groupBy(*by, "node").agg(F.min("seen").alias("seen"))
        hop = state.select(*by, F.col("node").alias("seen"), F.col("label").alias("jump"))
        joined = low.join(hop, [*by, "seen"], "left").join(state, [*by, "node"])
        fresh = joined.select(*by, "node", F.least(F.coalesce("jump", "seen"), "seen").alias("label"), F.col("label").alias("old"))
        fresh = write_table(fresh, "parts")
        state = fresh.select(*by, "node", "label")
        if not fresh.filter("label <> old").limit(1).count():
            return state


def kth_distance(points: DataFrame, features: Sequence[str], k: int, by: Sequence[str], start: float) -> DataFrame:
    """``(by, id, d)``: distance to the ``k``-th nearest point, the point itself included.

    A point is bounded by the ``k``-th nearest of its own bucket where that holds as many, else in buckets of twice the side. Only points
    whose ball of that radius leaves the bucket meet other buckets, and only those that the ball touches. The first side is halved until no
    bucket holds many positions, so crowded areas settle with small buckets; positions too close to part stay in one.
    """
    by, features = list(by), list(features)
    pos = write_table(collapse(points, by, features), "positions")
    side, least = start, start / 2**30
    low = pos.agg(*[F.min(f) for f in features]).first()
    origin = [x or 0.0 for x in low]  # buckets start at the least values, so wide ones hold everything
    while side > least and pos.groupBy(*by, _key(features, side, origin).alias("c")).count().filter(F.col("count") > MOST_IN_BUCKET).limit(1).count():
        side /= 2
    enough = pos.groupBy(*by).agg(F.sum("w").alias("n")).filter(F.col("n") >= k).select(*by)
    left, found = write_table(pos.join(enough, by, "left_semi"), "left"), []
    while left.limit(1).count():
        keyed = pos.withColumn("c", _key(features, side, origin))
        asked = left.withColumn("c", _key(features, side, origin))
        full = keyed.groupBy(*by, "c").agg(F.sum("w").alias("n")).filter(F.col("n") >= k).select(*by, "c")
        if not found:  # every position asks, and buckets are small
            rows = keyed.join(full, [*by, "c"], "left_semi").withColumn("_g", F.xxhash64("c"))
            rows = rows.repartition(*by, "_g").sortWithinPartitions(*by, "_g").select(*by, "_g", "pid", "w", *features)
            near = rows.mapInPandas(_bucket_bounds(by, features, k), _fields(rows, [*by, "pid", *features]) + ", d double")
        else:
            a = _prefixed(asked.join(full, [*by, "c"], "left_semi").drop("w"), [*by, "c"], "a")
            near = _kth(a.join(_prefixed(keyed, [*by, "c"], "b"), [*by, "c"]), by, features, k)
        near = write_table(near, "kth-bounds")
        found.append(_within_bound(near, pos, by, features, k, side, origin))
        left = write_table(left.join(near.select(*by, "pid"), [*by, "pid"], "left_anti"), "left")
        side *= 2
    got = reduce(DataFrame.unionByName, found) if found else pos.limit(0).select(*by, "pid", F.lit(0.0).alias("d"))
    named = pos.join(got, [*by, "pid"]).select(*by, *features, "d")
    return points.join(named, [*by, *features]).select(*by, "id", "d")


def _fields(df: DataFrame, names: Sequence[str]) -> str:
    return ", ".join(f"`{n}` {df.schema[n].dataType.simpleString()}" for n in names)


def _kth(pairs: DataFrame, by: list[str], features: list[str], k: int) -> DataFrame:
    """``(by, pid, features, d)``: distance from each ``a`` of the pairs to the ``k``-th nearest of its ``b``, counted by weight."""
    d = pairs.withColumn("d", F.sqrt(_dist2(features, "a", "b")))
    nearest = Window.partitionBy(*by, "a_pid").orderBy("d", "b_pid")
    # k positions are enough, since each weighs at least one; the rank filter prunes before the shuffle
    d = d.withColumn("_k", F.row_number().over(nearest)).filter(F.col("_k") <= k)
    reach = d.withColumn("upto", F.sum("b_w").over(nearest.rowsBetween(Window.unboundedPreceding, Window.currentRow))).filter(F.col("upto") >= k)
    return reach.groupBy(*by, F.col("a_pid").alias("pid")).agg(*[F.first(f"a_{f}").alias(f) for f in features], F.min("d").alias("d"))


def _within_bound(near: DataFrame, pos: DataFrame, by: list[str], features: list[str], k: int, side: float, origin: list[float]) -> DataFrame:
    """``(by, pid, d)``: the bound ``d`` where its ball stays in the bucket, else the distance found among all that the ball may hold."""
    edge = F.col("d") * (1 + 1e-9)
    at = [F.col(f) - o for f, o in zip(features, origin, strict=True)]
    leaves = reduce(lambda x, y: x | y, [F.floor((x - edge) / side) != F.floor((x + edge) / side) for x in at])
    a = _in_reach(near.filter(leaves), [x - edge for x in at], [x + edge for x in at], side, "c")
    gaps = [F.greatest(F.lit(0.0), F.col("c")[i] * side - x, x - (F.col("c")[i] + 1) * side) for i, x in enumerate(at)]
    a = _prefixed(a.filter(F.sqrt(reduce(lambda x, y: x + y, [g * g for g in gaps])) <= edge * (1 + 1e-9)), [*by, "c"], "a")
    pairs = a.join(_prefixed(pos.withColumn("c", _key(features, side, origin)), [*by, "c"], "b"), [*by, "c"])
    pairs = pairs.filter(F.sqrt(_dist2(features, "a", "b")) <= F.col("a_d") * (1 + 1e-9)).drop("a_d")
    return write_table(near.filter(~leaves).select(*by, "pid", "d").unionByName(_kth(pairs, by, features, k).select(*by, "pid", "d")), "kth")


def _bucket_bounds(by: list[str], features: list[str], k: int) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """For rows sorted by bucket: the distance from every position to the ``k``-th nearest of its bucket, counted by weight."""
    keys, out = [*by, "_g"], [*by, "pid", *features, "d"]

    def settle(rows: pd.DataFrame, cuts: np.ndarray) -> pd.DataFrame:
        x, w, d = rows[features].to_numpy(), rows["w"].to_numpy(), np.empty(len(rows))
        for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
            step = max(1, 1_000_000 // (hi - lo))
            for at in range(lo, hi, step):
                end = min(hi, at + step)
                sq = sum((x[at:end, None, j] - x[None, lo:hi, j]) ** 2 for j in range(len(features)))
                first = np.argpartition(sq, min(k, hi - lo) - 1, axis=1)[:, :k]  # each weighs at least one
                near = np.take_along_axis(sq, first, 1)
                order = np.argsort(near, axis=1, kind="stable")
                upto = np.take_along_axis(w[lo + first], order, 1).cumsum(1)
                d[at:end] = np.sqrt(np.take_along_axis(near, order, 1)[np.arange(end - at), (upto >= k).argmax(1)])
        return rows.assign(d=d)[out]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest = None
        for batch in batches:
            rows = batch if rest is None else pd.concat([rest, batch], ignore_index=True)
            new = np.zeros(len(rows), bool)
            for c in keys:
                new[1:] |= (rows[c].to_numpy()[1:] != rows[c].to_numpy()[:-1])
            cuts = np.r_[0, np.flatnonzero(new)]
            rest = rows.iloc[cuts[-1]:].reset_index(drop=True)
            if cuts[-1]:
                yield settle(rows.iloc[:cuts[-1]], cuts)
        if rest is not None and len(rest):
            yield settle(rest, np.array([0, len(rest)]))

    return run


def elbow(distances: DataFrame, value: str, by: Sequence[str]) -> DataFrame:
    """Knee of the descending curve: drop the top 1 %, scale both axes to [0, 1], take the point farthest from the
    diagonal. Equal values form runs whose deviation is linear, so their two ends stand for them."""
    by = list(by)
    runs = running_counts(distances, F.col(value), by)
    total = runs.groupBy(*by).agg(F.sum("k").alias("n"))
    work = runs.join(total, by).withColumn("skip", F.greatest(F.lit(1), F.floor(F.col("n") / 100)))
    first, last = F.col("n") - F.col("upto"), F.col("n") - F.col("upto") + F.col("k") - 1
    work = work.withColumn("i0", F.greatest(first, F.col("skip"))).withColumn("i1", last).filter("i1 >= skip")
    ends = work.groupBy(*by).agg(F.max("v").alias("hi"), F.min("v").alias("lo"))
    work = work.join(ends, by).select(*by, "v", "n", "skip", "hi", "lo", F.explode(F.array_distinct(F.array("i0", "i1"))).alias("i"))
    span = F.col("hi") - F.col("lo")
    x = (F.col("i") - F.col("skip")) / F.greatest(F.col("n") - F.col("skip") - 1, F.lit(1))
    off = F.when(span >= 1e-10, F.abs((F.col("v") - F.col("lo")) / F.when(span > 0, span) - (1.0 - x))).otherwise(0.0)
    best = F.max(F.struct(off.alias("off"), (-F.col("i")).alias("i"), F.col("v").alias("v")))
    return work.groupBy(*by).agg(best.alias("b")).select(*by, (-F.col("b.i")).alias("elbow_index"), F.col("b.v").alias("suggested"))


def silhouette(points: DataFrame, features: Sequence[str], label: str) -> DataFrame:
    """Mean silhouette over squared Euclidean distances of all clustered points; a point alone in its cluster counts 0.

    The mean squared distance from a point to a cluster follows from the cluster's size, sum and sum of squares, so points meet
    clusters and never one another; a few hundred points that lie together meet only clusters that may be the nearest of one of them.
    """
    features = list(features)
    some = points.filter(F.col(label).isNotNull()).select(F.col(label).alias("label"), *features)
    square = reduce(lambda x, y: x + y, [F.col(f) * F.col(f) for f in features])
    sums = some.groupBy("label").agg(F.count(F.lit(1)).alias("m"), F.sum(square).alias("q"), *[F.sum(f).alias(f"s_{f}") for f in features])
    clusters = sums.orderBy("label").toPandas()  # a few sums for each cluster
    scored = some.mapInPandas(_silhouettes(clusters, features), "s double")
    return scored.agg(F.avg("s").alias("silhouette"), F.count(F.lit(1)).alias("n_points"))


def _silhouettes(clusters: pd.DataFrame, features: list[str]) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    labels, m, q = (clusters[c].to_numpy() for c in ("label", "m", "q"))
    total = clusters[[f"s_{f}" for f in features]].to_numpy()
    mean = total / m[:, None] if len(m) else total
    spread = q / m - (mean * mean).sum(1)

    def settle(x: np.ndarray, own: np.ndarray) -> np.ndarray:
        lo, hi = x.min(0), x.max(0)
        least = (np.maximum(0.0, np.maximum(lo - mean, mean - hi)) ** 2).sum(1) + spread
        most = (np.maximum(hi - mean, mean - lo) ** 2).sum(1) + spread
        # one of the two nearest is not a point's own cluster
        bound = np.partition(most, 1)[1] if len(m) > 1 else np.inf
        near = np.flatnonzero(least <= bound + 1e-9 * (1.0 + np.abs(bound)))
        square = (x * x).sum(1)
        mine = (m[own] * square - 2.0 * (x * total[own]).sum(1) + q[own]) / np.maximum(m[own] - 1, 1)
        away = (m[near] * square[:, None] - 2.0 * x @ total[near].T + q[near]) / m[near]
        away[own[:, None] == near] = np.inf
        other = away.min(1, initial=np.inf)
        top = np.maximum(mine, other)
        known = (m[own] > 1) & np.isfinite(other)
        return np.where(known, (np.where(known, other, 0.0) - mine) / np.where(known & (top > 0), top, 1.0), 0.0)

    def together(x: np.ndarray, at: np.ndarray) -> Iterator[np.ndarray]:
        """Rows in parts of a few hundred, halved along their widest side."""
        if len(at) <= 256:
            yield at
            return
        axis, half = np.ptp(x[at], axis=0).argmax(), len(at) // 2
        order = at[np.argpartition(x[at, axis], half)]
        yield from together(x, order[:half])
        yield from together(x, order[half:])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            x, own, s = rows[features].to_numpy(), np.searchsorted(labels, rows["label"].to_numpy()), np.empty(len(rows))
            for part in together(x, np.arange(len(rows))) if len(rows) else ():
                s[part] = settle(x[part], own[part])
            yield pd.DataFrame({"s": s})

    return run
