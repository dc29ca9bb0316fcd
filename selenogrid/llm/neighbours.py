"""Embedding near-duplicates by NN-descent over class representatives.

Equal vectors are one. Lists of the nearest neighbours start from sketches: vectors that lie on the same sides of random
planes meet in blocks of bounded size. There are as many sketches as keep the chance that two vectors at the linking angle
never meet the same at every size. Then rounds of NN-descent, until few entries change: whoever share a neighbour are
compared, lists keep the nearest. Vectors within half the linking angle of one direction become a class: all pairs of a class are then linked for
sure and are counted, never listed, however large a group of near copies is. The lists of the leaders are made anew, and
a list whose farthest entry is still near enough to matter is saturated: it alone is enlarged until it is not. What remains are
the edges over the threshold between classes, which members that meet in sketches give too; where two classes straddle
the threshold, their members are compared. Links between classes are audited against all vectors; what further tries find
is added, and where that is not enough all classes are compared with all.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from selenogrid.llm.base import components
from selenogrid.session import write_table

LIST, SKETCHES, BLOCK = 8, 6, 256  # SKETCHES: those that are made at once, and the fewest
#: Chance that no sketch joins two vectors at the linking angle; further planes that split a crowd; share of entries that a last round changes.
MISS, DEEPER, SETTLED = 0.005, 16, 0.01
#: Vectors that a task holds at once, about.
ROWS = 4096
#: Vectors that an audit asks for at least, and by the square root of all; the recall that ends the search, and tries before all pairs.
QUERIES, BY_ROOT, RECALL, TRIES = 1000, 4, 0.95, 4
#: Angles are rounded by so much, on the safe side.
SLACK = 1e-7


def units(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """``(vec_id, unit)``: unit vectors as little-endian doubles in a binary; null where a vector is null or zero, or holds a null or
    non-finite component."""

    def unit(v) -> bytes | None:
        x = np.array([math.nan if e is None else e for e in v], np.float64) if v is not None else np.zeros(0)
        if not len(x) or not np.isfinite(x).all() or not x.any():
            return None
        x = x / np.abs(x).max()  # so that no square is lost
        return (x / math.sqrt(float(x @ x))).astype("<f8").tobytes()

    @F.pandas_udf("binary")
    def normed(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            yield pd.Series([unit(v) for v in part], dtype=object)

    return vectors.select(F.col(vec_id).alias("vec_id"), normed(embedding).alias("unit"))


def _matrix(raw, kind: str = "<f8") -> np.ndarray:
    return np.frombuffer(b"".join(raw), kind).reshape(len(raw), -1)


def _single(points: DataFrame) -> DataFrame:
    """``(id, x)``: the vectors in single precision, which is enough to search by."""

    @F.pandas_udf("binary")
    def short(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            yield pd.Series([v for v in map(bytes, _matrix(part).astype("<f4"))] if len(part) else [], dtype=object)

    return points.select("id", short("unit").alias("x"))


def _groups(part: pd.DataFrame, key: str) -> Iterator[np.ndarray]:
    """Row numbers of each group of two rows or more."""
    values = part[key].to_numpy()
    order = np.argsort(values, kind="stable")
    for rows in np.split(order, np.flatnonzero(np.diff(values[order])) + 1):
        if len(rows) > 1:
            yield rows


_FOUND = "id long, other long, cos double"


def _nearest(part: pd.DataFrame, key: str, k: int) -> pd.DataFrame:
    """The k nearest of each vector in each of its groups; a pair that meets in several of them is given once."""
    raw, own = part["x"].to_numpy(), part["id"].to_numpy(np.int64)
    ids, others, cosines = [], [], []
    for rows in _groups(part, key):
        x, i = _matrix(raw[rows], "<f4"), own[rows]
        cos = x @ x.T
        np.fill_diagonal(cos, -2)
        most = min(k, len(rows) - 1)
        top = np.argpartition(-cos, most - 1, axis=1)[:, :most]
        ids.append(np.repeat(i, most))
        others.append(i[top].ravel())
        cosines.append(np.take_along_axis(cos, top, 1).ravel())
    if not ids:
        return pd.DataFrame({"id": np.zeros(0, np.int64), "other": np.zeros(0, np.int64), "cos": np.zeros(0)})
    out = pd.DataFrame({"id": np.concatenate(ids), "other": np.concatenate(others), "cos": np.concatenate(cosines).astype(np.float64)})
    return out[out["id"] != out["other"]].drop_duplicates(["id", "other"])


def _best(found: DataFrame, k: int) -> DataFrame:
    """``(id, near)``: of all entries (id, other, cos) of an id, the k nearest, each other once, nearest first."""
    once = found.groupBy("id", "other").agg(F.max("cos").alias("cos"))
    return once.groupBy("id").agg(F.slice(F.sort_array(F.collect_list(F.struct("cos", "other")), asc=False), 1, k).alias("near"))


def _entries(lists: DataFrame) -> DataFrame:
    return lists.select("id", F.explode("near").alias("e")).select("id", "e.other", "e.cos")


def _bits(n: int) -> int:
    """Planes of a sketch: blocks hold half of ``BLOCK`` on average."""
    return max(1, math.ceil(math.log2(max(2, n) / (BLOCK / 2))))


def _sketches(n: int, angle: float) -> int:
    """Sketches among ``n`` vectors of which none joins two at ``angle`` with a chance of ``MISS``; a plane more is reckoned for crowds."""
    same = (1 - angle / math.pi) ** (_bits(n) + 1)
    return max(SKETCHES, math.ceil(math.log(MISS) / math.log1p(-same)))


def _sides(planes: np.ndarray, count: int):
    """Expression of a vector: ``count`` sketches, a bit for each of their planes that it is above."""
    bits = planes.shape[1] // count

    @F.pandas_udf("array<long>")
    def sketch(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            sides = (_matrix(part, "<f4") @ planes > 0).reshape(len(part), count, bits) if len(part) else np.zeros((0, count, bits))
            yield pd.Series(list((sides @ (1 << np.arange(bits))).astype(np.int64)), dtype=object)

    return sketch


def _blocks(points: DataFrame, n: int, dim: int, count: int, salt: int) -> Iterator[DataFrame]:
    """``points`` (id, x, ..) once a sketch with ``block`` and ``task``, a table for every ``SKETCHES`` of the ``count`` sketches.

    A crowded sketch is split by further planes, which seldom part near vectors. What these do not part is dealt, otherwise in every sketch.
    """
    bits = _bits(n)
    for first in range(0, count, SKETCHES):
        here = min(SKETCHES, count - first)
        planes = np.random.default_rng([salt, first]).standard_normal((dim, here * (bits + DEEPER)))

        rows = points.select("id", F.posexplode(_sides(planes, here)("x")).alias("t", "full"))
        rows = write_table(rows.withColumn("s", F.col("full").bitwiseAND(F.lit((1 << bits) - 1))), "sketches")
        size = F.count(F.lit(1))
        more = F.when(size > BLOCK, F.least(F.ceil(F.log2(size / (BLOCK / 2))), F.lit(DEEPER))).otherwise(0)
        crowds = write_table(rows.groupBy("t", "s").agg(more.cast("int").alias("more")), "crowds")
        rows = write_table(rows.join(crowds, ["t", "s"]).select("id", "t", F.expr(f"full & (shiftleft(1L, {bits} + more) - 1L)").alias("s"), "more"), "split")
        crowds = write_table(rows.groupBy("t", "s", "more").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("parts")), "crowds")
        block = F.xxhash64(F.lit(salt), F.col("t") + first, "s", "more", F.pmod(F.xxhash64("id", F.lit(salt), F.col("t") + first), F.col("parts")))
        rows = rows.join(crowds, ["t", "s", "more"]).select("id", block.alias("block")).join(points, "id")
        yield rows.withColumn("task", F.pmod("block", F.lit(max(8, here * n // ROWS))))


def _descend(points: DataFrame, lists: DataFrame, n: int, k: int, asked: DataFrame | None = None) -> DataFrame:
    """One round: the neighbours of a vector, and those whose neighbour it is, are compared with one another. Where only some ids are
    ``asked`` for, only groups that hold one of them meet, and only their lists are given."""
    out = lists.select(F.col("id").alias("a"), F.explode("near.other").alias("b"))
    edges = out.unionByName(out.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    edges = write_table(edges, "edges")
    if asked is not None:
        edges = write_table(edges.join(edges.join(asked.select(F.col("id").alias("b")), "b", "left_semi").select("a").distinct(), "a", "left_semi"), "edges")
    # those who have a very common neighbour meet in several groups; their own lists bring them together elsewhere too
    crowds = edges.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("parts"))
    edges = edges.join(write_table(crowds, "crowds"), "a")
    meeting = F.xxhash64("a", F.pmod(F.xxhash64("b"), F.col("parts")))
    met = edges.select(meeting.alias("meeting"), F.col("b").alias("id")).join(points, "id").withColumn("task", F.pmod("meeting", F.lit(max(8, n * k // ROWS))))
    fresh = met.groupBy("task").applyInPandas(lambda part: _nearest(part, "meeting", k), _FOUND)
    found = _entries(lists).unionByName(fresh)
    return _best(found if asked is None else found.join(asked, "id", "left_semi"), k)


def _changed(old: DataFrame, new: DataFrame) -> float:
    """Share of the entries of ``new`` that ``old`` has not."""
    both = new.join(old.select("id", F.col("near.other").alias("was")), "id", "left")
    fresh = F.size(F.array_except("near.other", F.coalesce("was", F.array().cast("array<long>"))))
    changed, all_ = both.agg(F.sum(fresh), F.sum(F.size("near"))).first()
    return (changed or 0) / max(1, all_ or 0)


def neighbour_lists(points: DataFrame, n: int, dim: int, wide: float, k: int = LIST, salt: int = 7) -> DataFrame:
    """``(id, near)`` for ``n`` ``points`` (id, x): about the k nearest by cosine, from sketches for the angle ``wide``. Rounds end when they
    change few entries."""
    lists = None
    for met in _blocks(points, n, dim, _sketches(n, wide), salt):
        found = met.groupBy("task").applyInPandas(lambda part: _nearest(part, "block", k), _FOUND)
        lists = write_table(_best(found if lists is None else _entries(lists).unionByName(found), k), "near")
    while True:
        before, lists = lists, write_table(_descend(points, lists, n, k), "near")
        if _changed(before, lists) <= SETTLED:
            return lists


def enlarged(points: DataFrame, lists: DataFrame, n: int, floor: float, k: int) -> DataFrame:
    """The lists of ``neighbour_lists``, those longer that are saturated: full, and their last entry at ``floor`` or above. Only they are
    made twice as long and refined, again and again; a crowd costs the rest of the table nothing."""
    while True:
        full = lists.filter((F.size("near") >= k) & (F.element_at("near", -1)["cos"] >= floor)).select("id")
        full = write_table(full, "saturated")
        count = full.count()
        if not count or k >= n - 1:
            return lists
        k = min(2 * k, n - 1)
        while True:
            more = write_table(_descend(points, lists, count, k, full), "near")
            changed = _changed(lists.join(full, "id", "left_semi"), more)
            lists = write_table(lists.join(full, "id", "left_anti").unionByName(more), "near")
            if changed <= SETTLED:
                break


_PAIRS = "a long, b long"


def _near_pairs(part: pd.DataFrame, key: str, wide: float) -> pd.DataFrame:
    """Labels ``(a, b)``, unlike ones, of rows (label, x, radius) of a group that are within ``wide`` and their radii of each other."""
    raw, label, radius = part["x"].to_numpy(), part["label"].to_numpy(np.int64), part["radius"].to_numpy()
    out = [np.zeros((0, 2), np.int64)]
    for rows in _groups(part, key):
        x, own, r = _matrix(raw[rows], "<f4"), label[rows], radius[rows]
        i, j = np.nonzero(np.triu(x @ x.T >= np.cos(np.minimum(math.pi, wide + 1e-3 + r[:, None] + r[None])), 1))
        pairs = np.sort(np.stack([own[i], own[j]], 1), axis=1)
        out.append(np.unique(pairs[pairs[:, 0] != pairs[:, 1]], axis=0))
    return pd.DataFrame(np.unique(np.concatenate(out), axis=0), columns=["a", "b"])


def _met(members: DataFrame, n: int, dim: int, wide: float, salt: int) -> DataFrame:
    """``(a, b)``: classes of which two of the ``n`` ``members`` (id, x, label, radius) meet in a sketch, within ``wide`` of each other."""
    out = None
    for met in _blocks(members, n, dim, _sketches(n, wide), salt):
        pairs = met.groupBy("task").applyInPandas(lambda part: _near_pairs(part, "block", wide), _PAIRS)
        out = write_table((pairs if out is None else out.unionByName(pairs)).distinct(), "met-pairs")
    return out


def _all_pairs(heads: DataFrame, n: int, wide: float) -> DataFrame:
    """``(a, b)``: the same for all of ``n`` ``heads`` (label, x, radius), each compared with each: parts meet two by two."""
    parts = math.ceil(n / 1024)
    rows = heads.withColumn("part", F.pmod(F.xxhash64("label"), F.lit(parts)).cast("int")).withColumn("with", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    rows = rows.withColumn("meeting", F.least("part", "with") * F.lit(parts).cast("long") + F.greatest("part", "with"))
    return rows.groupBy("meeting").applyInPandas(lambda part: _near_pairs(part, "meeting", wide), _PAIRS).distinct()


def _angle(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Angles between rows; by the chord, which is exact for small ones."""
    return 2 * np.arcsin(np.clip(np.linalg.norm(a - b, axis=1) / 2, 0, 1))


def _angles(rows: DataFrame, a: str, b: str) -> DataFrame:
    """``rows`` with ``angle`` between the unit vectors in the columns a and b, which go."""

    @F.pandas_udf("double")
    def angle(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for x, y in parts:
            yield pd.Series(_angle(_matrix(x), _matrix(y)) if len(x) else [], dtype="float64")

    return rows.withColumn("angle", angle(a, b)).drop(a, b)


def _centres(members: DataFrame) -> DataFrame:
    """``(label, centre)``: the direction of the sum of the members (label, unit). Sums are taken per batch first."""

    def partial(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            labels, at = np.unique(part["label"].to_numpy(np.int64), return_inverse=True)
            if len(labels):
                x = _matrix(part["unit"].to_numpy())
                sums = np.zeros((len(labels), x.shape[1]))
                np.add.at(sums, at, x)
                yield pd.DataFrame({"label": labels, "s": [v.tobytes() for v in sums]})

    def total(part: pd.DataFrame) -> pd.DataFrame:
        s = np.sum(_matrix(part["s"].to_numpy()), 0)
        norm = np.linalg.norm(s)
        return pd.DataFrame({"label": part["label"].iloc[:1], "centre": [(s / norm if norm > 0 else s).tobytes()]})

    sums = members.select("label", "unit").mapInPandas(partial, "label long, s binary")
    return sums.groupBy("label").applyInPandas(total, "label long, centre binary")


def _classes(points: DataFrame, lists: DataFrame, reach: float) -> DataFrame:
    """``(id, label)``: members of classes, all within ``reach`` of one direction; vectors in no class are left out.

    Chains of near neighbours are gathered, and those within reach of their chain's mean direction are its class. The rest are
    gathered again, now around the first of each chain, until no two of them are near.
    """
    near = write_table(_entries(lists).filter(F.col("cos") >= math.cos(reach)).select(F.least("id", "other").alias("a"), F.greatest("id", "other").alias("b")).distinct(), "near-pairs")
    done, mean = [], True
    while near.limit(1).count():
        chains = write_table(components(near), "chains")
        members = chains.join(points, F.col("node") == F.col("id")).select("id", "label", "unit")
        if mean:
            centres = _centres(members)
        else:
            centres = points.join(chains.select("label").distinct(), F.col("id") == F.col("label")).select("label", F.col("unit").alias("centre"))
        # a class is named by a member of its own: names of chains may come again
        fit = _angles(members.join(write_table(centres, "centres"), "label"), "unit", "centre").filter(F.col("angle") <= reach)
        fit = write_table(fit, "fit")
        name = write_table(fit.groupBy("label").agg(F.min("id").alias("name")), "names")
        done.append(write_table(fit.join(name, "label").select("id", F.col("name").alias("label")), "classes"))
        for end in ("a", "b"):
            near = near.join(fit.select(F.col("id").alias(end)), end, "left_anti")
        near, mean = write_table(near.select("a", "b"), "near-pairs"), False
    empty = points.sparkSession.createDataFrame([], "id long, label long")
    return reduce(DataFrame.unionByName, done, empty)


def _between(pairs: DataFrame, members: DataFrame, least: float) -> DataFrame:
    """Members of two classes compared one by one, for pairs of classes (a, b) that straddle the threshold: ``(a, b, id, n)``, n the
    vectors of the other class that id is linked with, copies included. Large classes meet in parts."""
    part = F.pmod(F.xxhash64("id"), F.col("parts")).cast("int")
    rows = members.withColumn("part", part)
    one = pairs.join(rows.select(F.col("label").alias("a"), "id", "part", "unit", "copies"), "a").join(
        members.select(F.col("label").alias("b"), F.col("parts").alias("of")).distinct(), "b").withColumn("q", F.explode(F.sequence(F.lit(0), F.col("of") - 1)))
    two = pairs.join(rows.select(F.col("label").alias("b"), "id", "part", "unit", "copies"), "b").join(
        members.select(F.col("label").alias("a"), F.col("parts").alias("of")).distinct(), "a").withColumn("q", F.explode(F.sequence(F.lit(0), F.col("of") - 1)))
    both = one.select("a", "b", F.lit(0).alias("side"), F.struct(F.col("part").alias("x"), F.col("q").alias("y")).alias("m"), "id", "unit", "copies").unionByName(
        two.select("a", "b", F.lit(1).alias("side"), F.struct(F.col("q").alias("x"), F.col("part").alias("y")).alias("m"), "id", "unit", "copies"))
    both = both.withColumn("meeting", F.xxhash64("a", "b", "m"))
    both = write_table(both, "meetings")
    both = both.withColumn("task", F.pmod("meeting", F.lit(max(8, both.count() // ROWS))))

    def compare(part: pd.DataFrame) -> pd.DataFrame:
        side, raw, copies, ids = part["side"].to_numpy(), part["unit"].to_numpy(), part["copies"].to_numpy(), part["id"].to_numpy()
        a, b, out = part["a"].to_numpy(), part["b"].to_numpy(), []
        for rows in _groups(part, "meeting"):
            i, j = rows[side[rows] == 0], rows[side[rows] == 1]
            if len(i) and len(j):
                linked = _matrix(raw[i]) @ _matrix(raw[j]).T >= least
                for mine, n in ((i, linked @ copies[j]), (j, linked.T @ copies[i])):
                    out += [(a[r], b[r], ids[r], c) for r, c in zip(mine[n > 0], n[n > 0], strict=True)]
        return pd.DataFrame(out, columns=["a", "b", "id", "n"])

    return both.select("task", "meeting", "a", "b", "side", "id", "unit", "copies").groupBy("task").applyInPandas(compare, "a long, b long, id long, n long")


def _audited(members: DataFrame, found: DataFrame, n: int, least: float) -> float:
    """Recall of the links between classes: the mean over the asked vectors with such links, compared with all ``n`` ``members`` (id, label,
    unit, copies), of the share that ``found`` (id, between) holds. 1 where none of those asked has any."""
    some = F.pmod(F.xxhash64("id", F.lit(3)), F.lit(max(1, n // max(QUERIES, math.isqrt(BY_ROOT**2 * n))))) == 0
    asked = members.filter(some).join(found, "id").select("unit", "label", "between").collect()  # by the root of n
    if not asked:
        return 1.0
    x, own = _matrix([bytes(r.unit) for r in asked]), np.array([r.label for r in asked])
    step = max(1, 4_000_000 // len(asked))

    def count(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(own), np.int64)
        for part in parts:
            for at in range(0, len(part), step):
                rows = part.slice(at, step)
                linked = (_matrix(rows.column("unit").to_pylist()) @ x.T >= least) & (rows.column("label").to_numpy(zero_copy_only=False)[:, None] != own)
                total += rows.column("copies").to_numpy(zero_copy_only=False) @ linked
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["i", "n"])

    there = members.select("unit", "label", "copies").mapInArrow(count, "i long, n long").groupBy("i").agg(F.sum("n").alias("n")).collect()
    return float(np.mean([min(1.0, asked[r.i].between / r.n) for r in there])) if there else 1.0


def _linked(points: DataFrame, n: int, dim: int, least: float) -> tuple[DataFrame, DataFrame]:
    """``(id, n)``, the links of each of the distinct ``points`` (id, unit, copies), and ``(id, root)``, the smallest id reachable."""
    wide = math.acos(least)
    k, salt = LIST, 7
    single = write_table(_single(points), "single")
    lists = neighbour_lists(single, n, dim, wide, k, salt)
    classes = write_table(_classes(points, lists, wide / 2 - SLACK), "classes")
    members = points.join(classes, "id", "left").withColumn("label", F.coalesce("label", "id"))
    members = write_table(members, "members")
    crowd = members.groupBy("label").agg(F.sum("copies").alias("weight"), F.count(F.lit(1)).alias("size"))
    crowd = write_table(crowd, "crowds")
    centre = _centres(members.join(crowd.filter("size > 1").select("label"), "label")).unionByName(
        members.join(crowd.filter("size = 1").select("label"), "label").select("label", F.col("unit").alias("centre")))
    centre = write_table(centre, "class-centres")
    spread = _angles(members.select("id", "label", "unit").join(centre, "label"), "unit", "centre").groupBy("label").agg(F.max("angle").alias("radius"))
    crowd = write_table(crowd.join(spread, "label"), "crowds")
    n2, widest = crowd.agg(F.count(F.lit(1)), F.max("radius")).first()
    floor = math.cos(min(math.pi, wide + 2 * widest + 1e-3))
    heads = write_table(_single(centre.select(F.col("label").alias("id"), F.col("centre").alias("unit"))), "single")
    rows = write_table(single.join(members.select("id", "label", F.lit(0.0).alias("radius")), "id"), "rows")
    label = members.select(F.col("id").alias("other"), F.col("label").alias("b"))
    own = _entries(lists).filter(F.col("cos") >= math.cos(wide + 1e-3)).join(members.select("id", F.col("label").alias("a")), "id").join(label, "other")
    known = write_table(own.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "known-pairs")
    parts = members.join(crowd.select("label", F.ceil(F.col("size") / BLOCK).cast("int").alias("parts")), "label").select("label", "id", "unit", "copies", "parts")
    for left in range(TRIES, -1, -1):
        if left:
            k2 = min(k, max(1, n2 - 1))
            # where no class was made the heads are the members, whose lists are there
            of_heads = lists if n2 == n and salt == 7 else neighbour_lists(heads, n2, dim, wide, k2, salt + 1)
            near = _entries(enlarged(heads, of_heads, n2, floor, k2)).filter(F.col("cos") >= floor)
            known = known.unionByName(near.select(F.least("id", "other").alias("a"), F.greatest("id", "other").alias("b")))
            if n2 < n:  # else members are the heads
                known = known.unionByName(_met(rows, n, dim, wide, salt + 1000))
        else:
            known = known.unionByName(_all_pairs(heads.withColumnRenamed("id", "label").join(crowd.select("label", "radius"), "label"), n2, wide))
        known = pairs = write_table(known.distinct(), "known-pairs")  # of all tries
        for end in ("a", "b"):
            side = crowd.join(centre, "label").select(F.col("label").alias(end), F.col("radius").alias(f"r_{end}"), F.col("weight").alias(f"w_{end}"), F.col("centre").alias(f"c_{end}"))
            pairs = pairs.join(side, end)
        pairs = write_table(_angles(pairs, "c_a", "c_b"), "class-pairs")
        reach = F.col("r_a") + F.col("r_b")
        sure = pairs.filter(F.col("angle") + reach <= wide - SLACK)
        open_ = pairs.filter((F.col("angle") + reach > wide - SLACK) & (F.col("angle") - reach <= wide + SLACK)).select("a", "b")
        met = write_table(_between(open_, parts, least), "between")
        whole = sure.select(F.col("a").alias("label"), F.col("w_b").alias("n")).unionByName(sure.select(F.col("b").alias("label"), F.col("w_a").alias("n")))
        whole = write_table(whole.groupBy("label").agg(F.sum("n").alias("sure")), "sure")
        single_links = write_table(met.groupBy("id").agg(F.sum("n").alias("met")), "met")
        between = F.coalesce("sure", F.lit(0)) + F.coalesce("met", F.lit(0))
        found = members.select("id", "label").join(crowd.select("label", "weight"), "label").join(whole, "label", "left").join(single_links, "id", "left")
        found = write_table(found.select("id", "label", between.cast("long").alias("between"), (F.col("weight") - 1 + between).cast("long").alias("n")), "found")
        if not left or _audited(members, found.select("id", "between"), n, least) >= RECALL:
            break
        k, salt = 2 * k, salt + 2
    edges = sure.select("a", "b").unionByName(met.select("a", "b")).distinct()
    roots = components(edges).select(F.col("node").alias("label"), F.col("label").alias("top"))
    names = found.select("id", "label").join(roots, "label", "left").select("id", F.coalesce("top", "label").alias("root"))
    return found.select("id", "n"), names


def near_duplicates(vectors: DataFrame, least: float = 0.95, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """``(vec_id, n_links, component_id, kept)``, row for row.

    Vectors that are null, zero, or hold a null or non-finite component link with nothing, nor do vectors of different lengths with each
    other. Equal vectors link; repeated ids count as vectors of their own. A null id is passed over where the smallest is sought.
    """
    rows = write_table(units(vectors, vec_id, embedding).withColumn("id", F.xxhash64("unit")), "units")
    points = rows.filter("unit is not null").groupBy("id", "unit").agg(F.min("vec_id").alias("first"), F.count(F.lit(1)).alias("copies"))
    points = write_table(points.withColumn("dim", (F.octet_length("unit") / 8).cast("int")), "points")
    found = names = None
    for dim, n in points.groupBy("dim").agg(F.count(F.lit(1)).alias("n")).orderBy("dim").collect():  # as many as there are lengths
        links, roots = _linked(points.filter(F.col("dim") == dim).select("id", "unit", "copies"), n, dim, least)
        found, names = (links, roots) if found is None else (found.unionByName(links), names.unionByName(roots))
    alone = rows.filter("unit is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    if found is None:
        out = alone
    else:
        names = write_table(names, "roots")
        least_id = write_table(names.join(points.select("id", "first"), "id").groupBy("root").agg(F.min("first").alias("component_id")), "least-ids")
        named = write_table(names.join(least_id, "root").join(found, "id").select("id", "n", "component_id"), "named")
        out = rows.filter("unit is not null").join(named, "id").select("vec_id", F.col("n").alias("n_links"), "component_id").unionByName(alone)
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
