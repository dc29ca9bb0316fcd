import numpy as np
import pytest
from pyspark.sql import functions as F

from grids import box, cells, grid
from selenogrid.operators import distance, terrain
from selenogrid.operators.grid import Box, Shift, box_shares, densify, stencil, tiled

T = np.tan


def run_terrain(spark, arrays):
    return terrain.terrain_layers(cells(spark, {n: {"elevation": a} for n, a in arrays.items()})).cache()


def test_slope_of_analytic_grids(spark):
    rr, cc = np.indices((30, 30)).astype(float)
    hole, corner = np.full((30, 30), 500.0), np.full((30, 30), 300.0)
    hole[15, 15], corner[0, 0] = np.nan, np.nan
    arrays = {
        "flat": np.full((30, 30), 1000.0), "ramp45": rr * 60, "ramp30": rr * 60 * T(np.radians(30)),
        "diag20": (rr + cc) * 60 * T(np.radians(20)) / np.sqrt(2), "hole": hole, "corner": corner,
        "check": np.where((rr + cc) % 2 == 0, 100.0, 200.0),
    }
    out = run_terrain(spark, arrays)
    slopes = {n: grid(out, "slope", (30, 30), n) for n in arrays}
    assert np.allclose(slopes["flat"], 0)
    for name, want in (("ramp45", 45), ("ramp30", 30), ("diag20", 20)):
        assert np.allclose(slopes[name], want)
    assert np.isnan(slopes["hole"][14, 15]) and slopes["hole"][13, 13] == 0 and slopes["hole"][15, 15] == 0
    assert np.isnan(slopes["corner"][0, 1]) and slopes["corner"][5, 5] == 0
    rough = grid(out, "roughness", (30, 30), "check")
    assert np.allclose(rough[1:-1, 1:-1], 49.6904, atol=1e-4)
    assert np.allclose(grid(out, "roughness", (30, 30), "flat"), 0)
    aspect = grid(out, "aspect", (30, 30), "ramp45")
    assert np.allclose(aspect, 180.0) and np.isnan(grid(out, "aspect", (30, 30), "flat")).all()
    assert np.isnan(grid(out, "roughness", (30, 30), "hole")[15, 15])


@pytest.mark.parametrize("tile", [7, 256])
def test_boxes_match_brute_force_across_tiles(spark, tile):
    rng = np.random.default_rng(3)
    a = rng.normal(size=(23, 19)) * 100
    a[rng.random(a.shape) < 0.1] = np.nan
    filled = np.nan_to_num(a)
    df = cells(spark, {"r": {"x": a}})
    sizes = (3, 10, 17, 25)
    boxes = []
    for s in sizes:
        boxes += [Box(f"avg{s}", "avg", F.col("x"), s), Box(f"max{s}", "max", F.col("x"), s), Box(f"min{s}", "min", F.col("x"), s),
                  Box(f"sum{s}", "sum", F.coalesce("x", F.lit(0.0)), s), Box(f"mean{s}", "mean", F.coalesce("x", F.lit(0.0)), s)]
    out = stencil(df, boxes, tile=tile).cache()
    assert out.count() == a.size
    for s in sizes:
        assert np.allclose(grid(out, f"avg{s}", a.shape), box(a, s, np.nanmean))
        assert np.allclose(grid(out, f"max{s}", a.shape), box(a, s, np.nanmax))
        assert np.allclose(grid(out, f"min{s}", a.shape), box(a, s, np.nanmin))
        assert np.allclose(grid(out, f"sum{s}", a.shape), box(filled, s, np.sum))
        assert np.allclose(grid(out, f"mean{s}", a.shape), box(filled, s, np.mean))


def test_stencil_shuffles_once(spark):
    a = np.arange(64.0).reshape(8, 8)
    out = stencil(cells(spark, {"r": {"x": a}}), [Box("m", "mean", F.col("x"), 3), Box("t", "max", F.col("x"), 5)])
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
    assert plan.count("Sort [") == 2


def test_densify_fills_missing_cells(spark):
    df = cells(spark, {"r": {"x": np.ones((4, 5))}})
    regions = df.select("region", "height", "width", "resolution_m", "origin_x", "origin_y").distinct()
    some = df.filter("row <> 2").select("region", "row", "col", "x")
    out = densify(some, regions)
    assert out.count() == 20 and out.filter("x IS NULL").count() == 5


def nearest(mask, r, c, other=False):
    """First masked cell in scan order among the nearest ones."""
    hits = [(int(a), int(b)) for a, b in np.argwhere(mask) if not (other and (a, b) == (r, c))]
    return min(hits, key=lambda h: ((h[0] - r) ** 2 + (h[1] - c) ** 2, h), default=None)


@pytest.mark.parametrize(("band", "share"), [(1, 0.03), (6, 0.03), (6, 0.4), (64, 0.1)])
def test_nearest_masked_cells_match_brute_force(spark, band, share):
    rng = np.random.default_rng(5)
    masks = {"r": rng.random((20, 17)) < share, "lattice": np.indices((13, 12)).sum(0) % 4 == 0, "wide": np.zeros((3, 40), bool), "none": np.zeros((5, 5), bool)}
    masks["wide"][1, [0, 39]] = True
    df = cells(spark, {n: {"m": m.astype(float)} for n, m in masks.items()})
    got = {(x.region, x.row, x.col): (x.near_row, x.near_col) for x in distance.nearest_masked(df, F.col("m") > 0, band=band).collect()}
    assert got == {(n, r, c): nearest(m, r, c) for n, m in masks.items() if m.any() for r, c in np.ndindex(m.shape)}
    metres = distance.distance_to_mask(df, F.col("m") > 0, "d", band=band).cache()
    want = [[np.hypot(*np.subtract(nearest(masks["r"], r, c), (r, c))) * 60 for c in range(17)] for r in range(20)]
    assert np.allclose(grid(metres, "d", (20, 17), "r"), want)
    assert metres.count() == sum(m.size for m in masks.values()) and metres.filter("region = 'none' AND d IS NOT NULL").count() == 0
    asked = [(n, r, c) for n, m in masks.items() for r, c in np.ndindex(m.shape) if (r * 7 + c) % 3 == 0]
    points = spark.createDataFrame([(i, *a) for i, a in enumerate(asked + asked[:5])], "id int, region string, p_row int, p_col int")
    near = distance.nearest_to_points(points, df.filter("m > 0"), band=band).collect()
    want = {i: nearest(masks[n], r, c, other=True) for i, (n, r, c) in enumerate(asked + asked[:5])}
    assert {x.id: (x.near_row, x.near_col) for x in near} == {i: w for i, w in want.items() if w is not None}


def test_envelope_of_one_target_and_of_far_rows():
    near = np.array([[100_000, 3]])
    assert distance.envelope(near, np.array([0]), np.array([0, 90_000]), 90_001)[0, [0, 44_999, 90_000]].tolist() == [1, 1, 1]
    assert distance.envelope(np.array([[5]]), np.array([0]), np.array([2]), 4).tolist() == [[0, 0, 0, 0]]


def test_boxes_wider_than_the_region(spark):
    a = np.arange(12.0).reshape(3, 4) ** 1.5
    out = stencil(cells(spark, {"r": {"x": a}}), [Box("m", "mean", F.col("x"), 31), Box("t", "max", F.col("x"), 15), Box("s", "sum", F.col("x"), 25)]).cache()
    for name, size, fold in (("m", 31, np.mean), ("t", 15, np.max), ("s", 25, np.sum)):
        assert np.allclose(grid(out, name, a.shape), box(a, size, fold))


@pytest.mark.parametrize("tile", [4, 7, 256])
def test_tiles_as_arrays_match_the_windows(spark, tile):
    rng = np.random.default_rng(8)
    regions = {n: {"x": np.where(rng.random(shape) < 0.2, np.nan, rng.normal(size=shape) * 100)} for n, shape in (("r", (23, 19)), ("flat", (3, 16)), ("one", (1, 1)))}
    df = cells(spark, regions).withColumn("tag", F.array(F.col("region")))
    x, z, n = F.col("x"), F.coalesce("x", F.lit(0.0)), F.col("x").isNotNull().cast("int")
    boxes = [b for s in (3, 10, 17) for b in (
        Box(f"avg{s}", "avg", x, s), Box(f"max{s}", "max", x, s), Box(f"min{s}", "min", x, s), Box(f"sum{s}", "sum", n, s), Box(f"mean{s}", "mean", z, s))]
    shifts = [Shift("v", x), Shift("w", z)]
    a, b = stencil(df, boxes, shifts, tile=tile), tiled(df, boxes, shifts, tile=tile)
    assert a.columns == b.columns and [f.dataType for f in a.schema] == [f.dataType for f in b.schema]
    assert sorted(map(str, a.collect())) == sorted(map(str, b.collect()))
    assert b.count() == 23 * 19 + 3 * 16 + 1 and b.filter("isnan(avg3) OR isnan(v_w)").count() == 0


def test_tiles_as_arrays_copy_no_cell_inside(spark):
    out = tiled(cells(spark, {"r": {"x": np.ones((64, 64))}}), [Box("m", "mean", F.col("x"), 25)])
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Window" not in plan and out.count() == 4096


@pytest.mark.parametrize("tile", [5, 256])
def test_shares_of_all_limits_from_one_copy(spark, tile):
    rng = np.random.default_rng(2)
    arrays = {n: np.where(rng.random(s) < 0.2, np.nan, rng.random(s) * 30) for n, s in (("a", (13, 9)), ("b", (4, 17)), ("unasked", (3, 3)))}
    df = cells(spark, {n: {"x": a} for n, a in arrays.items()})
    pairs = {"a": [(12.0, 1), (12.0, 3), (20.0, 2)], "b": [(7.5, 5)]}
    asked = spark.createDataFrame([(n, i + 1, *p) for n, ps in pairs.items() for i, p in enumerate(ps)][::-1], "region string, place int, limit double, radius int")
    out = box_shares(df, F.col("x"), asked, "s", tile=tile).cache()
    assert out.count() == 13 * 9 + 4 * 17
    for n, ps in pairs.items():
        for i, (limit, radius) in enumerate(ps):
            want = box((arrays[n] <= limit).astype(float), 2 * radius + 1, np.mean)
            assert np.allclose(grid(out.withColumn("one", F.get("s", F.lit(i))), "one", want.shape, n), want)
