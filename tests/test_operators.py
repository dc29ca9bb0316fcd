import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from grids import cells, dbscan, dijkstra, grid
from selenogrid.functions import geo, physics
from selenogrid.operators import batches, cluster, cluster_tiles, energy, evaluate, ordered, proximity, quantiles, resample, routing, sites
from selenogrid.session import write_table
from selenogrid.sources import ingest


def one(spark, **cols):
    return spark.range(1).select(*[c.alias(n) for n, c in cols.items()]).first()


def test_sinkage_and_rolling(spark):
    z = [physics.sinkage_m(F.lit(430.0), F.lit(0.2), F.lit(0.25), F.lit(6), F.lit(s)) * 1000 for s in (0.0, 0.2, 0.4, 0.6, 0.8, 1.0)]
    got = one(spark, **{f"z{i}": v for i, v in enumerate(z)})
    assert [round(v, 3) for v in got] == [6.269, 6.826, 7.525, 8.437, 9.686, 11.531]
    mu = one(spark, m=physics.rolling_resistance(z[0] / 1000, F.lit(0.25)))[0]
    assert round(mu, 5) == 0.07465


def test_recorded_pixels(spark):
    at = [F.lit(v) for v in (60.0, -304000.0, 304000.0)]
    r, c = geo.lonlat_to_cell(F.lit(-166.4), F.lit(-84.5), *at)
    r2, c2 = geo.lonlat_to_cell(F.lit(0.0), F.lit(-88.0), *at)
    got = one(spark, r=r, c=c, r2=r2, c2=c2)
    assert tuple(got) == (7770, 4413, 4056, 5067)


def test_round_trip_of_cell_centres(spark):
    at = [F.lit(v) for v in (60.0, -304000.0, 304000.0)]
    df = spark.range(500).select((F.col("id") * 7 + 100).alias("row"), (F.col("id") * 13 % 9000 + 200).alias("col"))
    lon, lat = geo.cell_to_lonlat(F.col("row"), F.col("col"), *at)
    r, c = geo.lonlat_to_containing_cell(lon, lat, *at)
    assert df.filter((r != F.col("row")) | (c != F.col("col"))).count() == 0


def route(spark, steps, arrays, speed=0.5, **rover):
    df = cells(spark, {"r": arrays}).withColumn("mobility_risk", F.lit(0.0))
    path = spark.createDataFrame([(1, "r", i, r, c) for i, (r, c) in enumerate(steps)], "route_id int, region string, step int, row int, col int")
    for name, value in {"speed_kmh": speed, "battery_wh": 1000.0, **rover}.items():
        path = path.withColumn(name, F.lit(value))
    return energy.legs(path, df, ["mobility_risk"])


def test_energy_of_straight_paths(spark):
    flat = {"elevation": np.zeros((51, 2)), "slope": np.zeros((51, 2))}
    level = energy.path_energy(route(spark, [(i, 0) for i in range(51)], flat), with_rolling=False).first()
    assert level["total_energy_wh"] == 600.0 and level["energy_risk"] == "MODERATE" and level["battery_feasible"]
    up = {"elevation": np.repeat(np.arange(11.0), 2).reshape(11, 2), "slope": np.full((11, 2), 10.0)}
    down = {"elevation": -up["elevation"], "slope": np.full((11, 2), 15.0)}
    steps = [(i, 0) for i in range(11)]
    assert energy.path_energy(route(spark, steps, up), with_rolling=False).first()["total_energy_wh"] == 182.5133
    got = energy.path_energy(route(spark, steps, down), with_rolling=False).first()
    assert (got["downhill_regen_wh"], got["total_energy_wh"]) == (9.3175, 110.6825)


def test_path_length_and_single_point(spark):
    flat = {"elevation": np.zeros((100, 100)), "slope": np.full((100, 100), 5.0)}
    got = energy.path_stats(route(spark, [(i, i) for i in range(100)], flat)).first()
    assert abs(got["total_distance_m"] - 8400.43) < 0.01 and abs(got["estimated_time_hrs"] - 16.8009) < 1e-3
    same = energy.path_stats(route(spark, [(5, 5)], flat)).first()
    assert same["total_distance_m"] == 0.0 and same["waypoint_count"] == 1


def ledger(steps, battery):
    """Stops of one route, step by step: (step, charge in percent, energy gained, hours)."""
    charge, out = battery, []
    for step, cost, rate in steps:
        charge = max(0.0, charge - cost)
        if charge <= 0.2 * battery:
            gained = 0.8 * battery - charge if rate > 0 else 0.0
            out.append((step, charge / battery * 100, gained, gained / rate if rate > 0 else None))
            charge = 0.8 * battery if rate > 0 else charge
    return out


@pytest.mark.parametrize("part", [7, ordered.PART])
def test_recharge_stops_are_the_ledger_step_by_step(spark, monkeypatch, part):
    monkeypatch.setattr(ordered, "PART", part)
    rng = np.random.default_rng(3)
    frames, want = [], {}
    scale = (physics.OBLIQUITY_DEG * math.sin(2 * math.pi * 7.4 / physics.SYNODIC_DAYS) + physics.OBLIQUITY_DEG) / (2 * physics.OBLIQUITY_DEG)
    for route_id, (n, battery, kind) in enumerate([(60, 100.0, "even"), (120, 50.0, "random"), (80, 37.0, "dark"), (40, 1e6, "random"), (90, 60.0, "rests"), (2, 10.0, "even"), (70, 30.0, "dear"), (1, 5.0, "even")]):
        light = np.where((np.arange(n) > 20) & (np.arange(n) < 30), 0.1, 0.9) if kind != "random" else rng.random(n)
        light = np.zeros(n) if kind == "dark" else light
        speed = {"dear": 0.05}.get(kind, 0.5)
        rise = np.r_[0.0, np.where(rng.random(n - 1) < 0.5, -1.0, 1.0)].cumsum() if kind == "rests" else np.zeros(n)
        slope = np.where(rng.random(n) < 0.5, 90.0, 0.0) if kind == "rests" else np.zeros(n)
        f = pd.DataFrame({"route_id": route_id, "step": range(n), "row": range(n), "col": 0, "slope": slope, "elevation": rise, "sunlight": light, "battery_wh": battery, "speed_kmh": speed,
                          "resolution_m": 60.0, "mobility_risk": 0.0, "solar_panel_w": 60.0, "mission_day": 7.4, "power_source": "solar"})
        f["p_row"], f["p_col"], f["p_elevation"] = f["row"].shift(), f["col"].shift(), f["elevation"].shift()
        flat = 100.0 * 60.0 / (speed * 1000.0)
        sine = np.sin(np.radians(slope))
        down = np.r_[False, np.diff(rise) < 0]
        cost = np.where(down, np.maximum(0, flat - flat * 0.3 * sine), flat * (1 + 3 * sine))
        rate = np.maximum(0.0, 60.0 * np.clip(light * scale, 0, 1) - 25.0)
        want[route_id] = ledger(list(zip(range(1, n), cost[1:], rate[1:])), battery)
        frames.append(f)
    frame = pd.concat(frames)
    rows = frame.astype(object).where(frame.notna(), None).values.tolist()
    kinds = {c: "int" if c in ("route_id", "step", "row", "col", "p_row", "p_col") else "string" if c == "power_source" else "double" for c in frame}
    rows = [[None if v is None else int(v) if kinds[c] == "int" else v for c, v in zip(frame, r)] for r in rows]
    work = spark.createDataFrame(rows, ", ".join(f"{c} {k}" for c, k in kinds.items()))
    got = {}
    for r in energy.recharge_stops(work).orderBy("route_id", "step").collect():
        got.setdefault(r["route_id"], []).append((r["step"], r["battery_at_stop_pct"], r["energy_gained_wh"], r["recharge_time_hrs"]))
    assert set(got) == {i for i, w in want.items() if w}
    for i, w in want.items():
        mine = got.get(i, [])
        assert [m[0] for m in mine] == [x[0] for x in w]
        for m, x in zip(mine, w):
            assert all((a is None and b is None) or abs(a - b) < 0.006 for a, b in zip(m[1:], x[1:]))
    assert any(x[3] is None for w in want.values() for x in w) and sum(map(len, want.values())) > 50


def greedy(points, n, sep):
    kept = []
    for r, c, s in sorted(points, key=lambda p: (-p[2], p[0], p[1])):
        if len(kept) < n and all(math.hypot(r - a, c - b) >= sep for a, b in kept):
            kept.append((r, c))
    return kept


@pytest.mark.parametrize(("n", "sep"), [(6, 12.0), (100, 5.5), (3, 1.0)])
def test_spaced_top_is_the_exact_greedy_result(spark, n, sep):
    rng = np.random.default_rng(1)
    groups = {}
    for g in ("a", "b", None):
        groups[g] = [(int(r), int(c), float(s)) for r, c, s in zip(rng.integers(0, 40, 80), rng.integers(0, 40, 80), rng.integers(1, 6, 80) / 10, strict=True)]
        groups[g] = list({(r, c): (r, c, s) for r, c, s in groups[g]}.values())
    df = spark.createDataFrame([(g, *p) for g, ps in groups.items() for p in ps], "grp string, row int, col int, s double")
    got = sites.spaced_top(df, ["grp"], "s", n, sep).collect()
    for g, ps in groups.items():
        mine = sorted((r["rank"], r["row"], r["col"]) for r in got if r["grp"] == g)
        assert mine == [(i + 1, *rc) for i, rc in enumerate(greedy(ps, n, sep))]
    assert sites.spaced_top(df.limit(0), ["grp"], "s", n, sep).count() == 0


def plan(spark, cost, start, goal, tile):
    rr, cc = np.nonzero(np.isfinite(cost))
    costs = spark.createDataFrame([("m", "r", int(a), int(b), float(cost[a, b])) for a, b in zip(rr, cc, strict=True)],
                                  "mission_id string, region string, row int, col int, cost double")
    ends = [spark.createDataFrame([("m", "r", *p)], "mission_id string, region string, row int, col int") for p in (start, goal)]
    found = routing.least_cost(costs, *ends, tile=tile)
    steps = routing.trace(found, *ends, tile=tile).orderBy("step").collect()
    return found, [(s["row"], s["col"]) for s in steps]


def test_route_matches_dijkstra_across_tiles(spark):
    rng = np.random.default_rng(2)
    cost = rng.random((14, 13)) * 5 + 1
    cost[rng.random(cost.shape) < 0.25] = np.inf
    start, goal = (0, 0), (13, 12)
    cost[start], cost[goal] = 1.0, 2.0
    want = dijkstra(cost, start)
    found, steps = plan(spark, cost, start, goal, 5)
    labels = {(r["row"], r["col"]): r["g"] for r in found.collect()}
    assert goal in want and abs(labels[goal] - want[goal]) < 1e-9
    assert steps[0] == start and steps[-1] == goal
    total = sum(cost[b] * (math.sqrt(2) if abs(a[0] - b[0]) + abs(a[1] - b[1]) == 2 else 1.0) for a, b in zip(steps, steps[1:], strict=False))
    assert abs(total - want[goal]) < 1e-9
    assert all(max(abs(a[0] - b[0]), abs(a[1] - b[1])) == 1 for a, b in zip(steps, steps[1:], strict=False))


def test_route_around_a_wall_and_none(spark):
    cost = np.full((20, 20), 60.0)
    cost[:16, 10] = np.inf
    _, steps = plan(spark, cost, (0, 0), (0, 19), 64)
    assert len(steps) == 33 and all(np.isfinite(cost[s]) for s in steps)
    cost[:, 10] = np.inf
    _, steps = plan(spark, cost, (0, 0), (0, 19), 64)
    assert steps == []


def test_snap_prefers_ring_then_distance_then_scan_order(spark):
    free = spark.createDataFrame([("r", 5, 9), ("r", 3, 5), ("r", 5, 3), ("r", 7, 7)], "region string, row int, col int")
    pts = spark.createDataFrame([(1, "r", 5, 5), (2, "r", 90, 90)], "id int, region string, p_row int, p_col int")
    got = {r["id"]: (r["row"], r["col"]) for r in proximity.snap_to_passable(pts, free, ["id"], 10).collect()}
    assert got == {1: (3, 5), 2: (None, None)}


@pytest.mark.parametrize("seed", [0, 1])
def test_density_clusters_match_brute_force(spark, seed):
    rng = np.random.default_rng(seed)
    blobs = [rng.normal(c, s, size=(n, 4)) for c, s, n in ((0.0, 0.03, 60), (0.35, 0.06, 40), (1.5, 0.15, 60))]
    x = np.vstack([*blobs, rng.uniform(-1, 3, size=(30, 4)), np.full((15, 4), 2.5)])
    want = dbscan(x, 0.2, 6)
    names = ["f0", "f1", "f2", "f3"]
    df = spark.createDataFrame(pd.DataFrame({"grp": "g", "id": np.arange(len(x)), **{n: x[:, i] for i, n in enumerate(names)}}))
    got = cluster.density_cluster(df, names, 0.2, 6, ["grp"]).toPandas().sort_values("id")
    assert got["cluster"].fillna(-1).astype(int).tolist() == want.tolist()
    if seed == 0:
        d = np.sort(np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1)), 1)[:, 4]
        kth = cluster.kth_distance(df, names, 5, ["grp"], 0.1).toPandas().sort_values("id")
        assert np.allclose(kth["d"], d)


@pytest.mark.parametrize(("accuracy", "part"), [(quantiles.ACCURACY, ordered.PART), (10, 40)])
def test_quantiles_of_outliers_ties_and_small_groups(spark, monkeypatch, accuracy, part):
    monkeypatch.setattr(ordered, "PART", part)
    rng = np.random.default_rng(4)
    values = {"a": rng.normal(size=5001), "b": np.r_[np.full(2500, 3.0), rng.random(200) * 1e6], "c": np.full(7, 2.0), "d": np.array([5.0]), "e": np.arange(4000.0),
              "f": np.r_[rng.normal(size=3000), 1e15, -1e12, np.full(200, 0.25)], "g": np.full(3, np.nan)}
    frame = pd.concat([pd.DataFrame({"region": n, "x": v}) for n, v in values.items()]).sample(frac=1, random_state=1)
    df = spark.createDataFrame(frame).withColumn("x", F.when(~F.isnan("x"), F.col("x"))).withColumn("y", -F.col("x")).repartition(5)
    probs = [0.0, 0.02, 0.3, 0.5, 0.95, 1.0]
    spec = {"x": (F.col("x"), probs), "y": (F.col("y"), [0.25])}
    got = quantiles.quantiles(df, spec, aggs={"n": F.count("x"), "rows": F.count(F.lit(1))}, accuracy=accuracy).toPandas().set_index("region")
    assert len(got) == len(values) and got.loc["g", "n"] == 0 and got.loc["g", "rows"] == 3 and got.loc["g"].isna().sum() == 7
    for n, v in values.items():
        if n != "g":
            assert np.allclose(got.loc[n, [quantiles.quantile_name("x", p) for p in probs]].to_numpy(float), np.quantile(v, probs))
            assert np.isclose(got.loc[n, "y_p25"], np.quantile(-v, 0.25)) and got.loc[n, "n"] == len(v)
    assert quantiles.quantiles(df, spec, accuracy=accuracy).count() == len(values) - 1


def test_many_small_groups_are_ranked_without_sketches(spark, monkeypatch):
    def none(*_):
        raise AssertionError("small groups need no sketch")

    monkeypatch.setattr(quantiles.F, "percentile_approx", none)
    v = np.random.default_rng(6).normal(size=(40, 50))
    df = spark.createDataFrame(pd.DataFrame({"region": np.repeat(np.arange(40), 50), "x": v.ravel()}))
    got = quantiles.quantiles(df, {"x": (F.col("x"), [0.05, 0.7])}).toPandas().set_index("region").sort_index()
    assert np.allclose(got[["x_p5", "x_p70"]].to_numpy(), np.quantile(v, [0.05, 0.7], axis=1).T)


def test_ranks_with_an_outlier_and_a_value_of_most_rows(spark, monkeypatch):
    monkeypatch.setattr(ordered, "PART", 50)
    rng = np.random.default_rng(8)
    v = np.r_[np.full(4500, 0.5), rng.normal(size=499), 1e15]
    df = spark.createDataFrame(pd.DataFrame({"g": np.r_[np.repeat("hot", 5000), ["z"] * 3], "v": np.r_[v, [2.0, 1.0, 2.0]]}))
    got = quantiles.running_counts(df, F.col("v"), ["g"]).toPandas()
    assert set(got.columns) == {"g", "v", "k", "upto"}
    for g, x in (("hot", v), ("z", np.array([2.0, 1.0, 2.0]))):
        mine = got[got.g == g].set_index("v").sort_index()
        want, k = np.unique(x, return_counts=True)
        assert mine.index.tolist() == want.tolist() and mine.k.tolist() == k.tolist() and mine.upto.tolist() == np.cumsum(k).tolist()
    one = spark.createDataFrame(pd.DataFrame({"g": ["u"] * 300 + ["w"], "a": list(range(150)) * 2 + [9], "b": list(range(300)) + [1]}))
    at = ordered.positions(one, ["g"], [F.desc("a"), F.col("b")], "place").toPandas()
    order = sorted(((-a, b) for a, b in zip(at[at.g == "u"].a, at[at.g == "u"].b)))
    assert [(-a, b) for a, b in at[at.g == "u"].sort_values("place")[["a", "b"]].itertuples(index=False)] == order
    assert sorted(at[at.g == "u"].place) == list(range(1, 301)) and at[at.g == "w"].place.tolist() == [1]


def test_silhouette_matches_all_pairs(spark):
    rng = np.random.default_rng(9)
    x = np.vstack([rng.normal(c, 0.3, size=(20, 2)) for c in (0.0, 1.0, 4.0)] + [[[9.0, 9.0]]])
    label = np.r_[np.repeat([0, 1, 2], 20), 3]
    d = ((x[:, None] - x[None]) ** 2).sum(-1)
    want = []
    for i, own in enumerate(label):
        mates = (label == own) & (np.arange(len(x)) != i)
        b = min(d[i, label == k].mean() for k in set(label) - {own})
        want.append((b - d[i, mates].mean()) / max(b, d[i, mates].mean()) if mates.any() else 0.0)
    df = spark.createDataFrame(pd.DataFrame({"f0": x[:, 0], "f1": x[:, 1], "label": label}))
    got = cluster.silhouette(df, ["f0", "f1"], "label").first()
    assert abs(got["silhouette"] - np.mean(want)) < 1e-9 and got["n_points"] == 61


def test_missing_values_are_errors_unless_optional(spark):
    fields = {**ingest.RANGES, **ingest.OPTIONAL_RANGES}
    schema = ", ".join(f"{c} double" for c in fields) + ", mission_day double, mission_type string, power_source string, psr_intent string, science_experiments array<string>"
    good = [sum(r) / 2 for r in fields.values()]
    good[list(fields).index("focus_lat_min")] = -80.0
    rows = [(*good, 3.0, "geological", "solar", "rim", ["mineralogy"]), tuple([None] * (len(fields) + 5)),
            (*[None if c in ingest.OPTIONAL_RANGES or c == "solar_panel_w" else g for c, g in zip(fields, good)], None, "geological", "rtg", "rim", [])]
    df = spark.createDataFrame(rows, schema)
    errors = [r[0] for r in df.select(ingest.mission_errors(df)).collect()]
    assert errors[0] == [] and errors[2] == []
    assert set(errors[1]) == {*ingest.RANGES, "mission_day", "mission_type", "power_source", "psr_intent", "science_experiments"}


def test_rank_correlation_with_ties(spark):
    rng = np.random.default_rng(6)
    a, b = rng.integers(0, 20, 300).astype(float), rng.integers(0, 20, 300).astype(float)
    df = spark.createDataFrame(pd.DataFrame({"g": "x", "a": a, "b": b}))
    want = np.corrcoef(pd.Series(a).rank(), pd.Series(b).rank())[0, 1]
    assert abs(evaluate.spearman(df, "a", "b", ["g"]).first()["spearman"] - want) < 1e-12


def test_ordered_index_spreads_a_hot_group(spark):
    df = spark.range(1000).select(F.lit("u").alias("g"), F.col("id"), (F.col("id") * 2).alias("t"))
    out = quantiles.ordered_index(df, ["g"], F.floor(F.col("t") / 100), ["t"], "i")
    assert out.filter("i <> id").count() == 0


def test_isolated_and_dilated_cells(spark):
    a = np.zeros((9, 9))
    a[4, 4] = a[1, 1] = a[1, 2] = a[0, 7] = 1
    mask = cells(spark, {"r": {"m": a}}).filter("m = 1")
    assert [(r["row"], r["col"]) for r in proximity.isolated(mask).collect()] == [(4, 4)]
    assert proximity.dilate(mask.filter("row = 4"), 2).count() == 13


def test_verdicts(spark):
    rows = [("p", "PASS"), ("p", "PASS"), ("w", "PASS"), ("w", "FAIL"), ("w", "FAIL"), ("f", "FAIL")]
    checks = spark.createDataFrame(rows, "suite string, result string")
    suites = spark.createDataFrame([("p",), ("w",), ("f",), ("e",)], "suite string")
    got = {r["suite"]: r["verdict"] for r in evaluate.verdict_of_all(suites, checks, ["suite"]).collect()}
    assert got == {"p": "PASS", "w": "WARN", "f": "FAIL", "e": "WARN"}


def test_grid_helper_reads_back(spark):
    a = np.arange(6.0).reshape(2, 3)
    assert (grid(cells(spark, {"r": {"x": a}}), "x", a.shape) == a).all()


def test_clusters_of_near_copies(spark, monkeypatch):
    """Copies that differ in the last digits are nodes of many positions: their links are settled without comparing all of them."""
    rng = np.random.default_rng(5)
    base = np.vstack([rng.normal(0.0, 0.25, size=(30, 4)), rng.uniform(-1, 2, size=(20, 4))])
    x = np.vstack([base + rng.normal(0, 1e-12, base.shape) for _ in range(12)])
    names = ["f0", "f1", "f2", "f3"]
    df = spark.createDataFrame(pd.DataFrame({"grp": "g", "id": np.arange(len(x)), **{n: x[:, i] for i, n in enumerate(names)}}))
    written = {}

    def count(frame, name, *rest):
        out = write_table(frame, name, *rest)
        written[name] = max(written.get(name, 0), out.count())
        return out

    monkeypatch.setattr(cluster, "write_table", count)
    got = cluster.density_cluster(df, names, 0.2, 10, ["grp"]).toPandas().sort_values("id")
    assert got["cluster"].fillna(-1).astype(int).tolist() == dbscan(x, 0.2, 10).tolist()
    # a bucket as wide as the copies are apart holds all twelve of them, and pairs of buckets are refined once
    assert written.get("links", 0) < len(base) ** 2
    d = np.sort(np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1)), 1)[:, 14]
    kth = cluster.kth_distance(df, names, 15, ["grp"], 0.1).toPandas().sort_values("id")
    assert np.allclose(kth["d"], d)


def test_cells_at_zero_are_not_sent_to_the_peaks(spark, monkeypatch):
    score = np.array([[0, 0, 0.5], [0.2, 0, 0], [0, 0.1, 0]])
    seen = []
    whole = sites.nb.derive
    monkeypatch.setattr(sites.nb, "derive", lambda cells, *a, **k: seen.append(cells.count()) or whole(cells, *a, **k))
    found = sites.candidates(cells(spark, {"A": {"final": score}}), ["region"], "final", 2)
    assert {(r["row"], r["col"]) for r in found.collect()} == {(0, 2), (1, 0)} and seen == [3]


@pytest.mark.parametrize("tile, fine", [(256, 90.0), (4, 90.0), (8, 15.0)])
def test_bilinear_across_tiles(spark, tile, fine):
    rng = np.random.default_rng(3)
    z = rng.normal(size=(11, 13))
    z[rng.random(z.shape) < 0.2] = np.nan
    source = cells(spark, {"A": {"z": z}})
    side = int(900 / fine)
    one = source.select("region", "resolution_m", "origin_x", "origin_y").distinct()
    target = one.selectExpr("*", f"{side} t_height", f"{side} t_width", f"{fine}D t_resolution_m", "-65D t_origin_x", "47D t_origin_y")
    rows = resample.reproject_bilinear(resample.target_grid(target), source, ["z"], tile).collect()
    assert len(rows) == side * side
    for got in rows:
        r, c = -(47 - (got["t_row"] + 0.5) * fine) / 60 - 0.5, (-65 + (got["t_col"] + 0.5) * fine) / 60 - 0.5
        r0, c0, total, weight = math.floor(r), math.floor(c), 0.0, 0.0
        for i, j in ((0, 0), (0, 1), (1, 0), (1, 1)):
            if 0 <= r0 + i < 11 and 0 <= c0 + j < 13 and not math.isnan(z[r0 + i, c0 + j]):
                w = abs(1 - i - (r - r0)) * abs(1 - j - (c - c0))
                total, weight = total + w * z[r0 + i, c0 + j], weight + w
        assert got["z"] == (pytest.approx(total / weight) if weight > 0 else None)


@pytest.mark.parametrize("sides, most", [((16, 8, 4), 10**6), ((4,), 10**6), ((4,), 0)])
def test_clusters_across_tiles_write_no_pairs(spark, monkeypatch, sides, most):
    """Clusters, borders and equal points that lie across the sides of tiles, in two groups; nothing grows with the pairs of points within reach."""
    monkeypatch.setattr(cluster, "TILE_SIDES", sides)
    monkeypatch.setattr(cluster, "MOST_IN_TILE", most)
    rng = np.random.default_rng(8)
    names, eps = ["f0", "f1", "f2", "f3"], 0.2
    line = np.linspace(-2, 2, 120)[:, None] * np.ones(4) + rng.normal(0, 0.02, (120, 4))
    x = np.vstack([line, rng.normal(0.4, 0.12, (300, 4)), rng.uniform(-2, 2, (150, 4)), np.full((12, 4), 1.6), np.full((9, 4), -0.4)])
    frames = [pd.DataFrame({"grp": g, "id": np.arange(len(x)) - 50, **{n: x[:, i] * scale for i, n in enumerate(names)}}) for g, scale in (("a", 1.0), ("b", 0.7))]
    df = spark.createDataFrame(pd.concat(frames))
    written = {}

    def count(frame, name, *rest):
        out = write_table(frame, name, *rest)
        written[name] = max(written.get(name, 0), out.count())
        return out

    for module in (cluster, cluster_tiles):
        monkeypatch.setattr(module, "write_table", count)
    got = cluster.density_cluster(df, names, eps, 8, ["grp"]).toPandas().sort_values(["grp", "id"])
    for frame in frames:
        want = dbscan(frame[names].to_numpy(), eps, 8)
        mine = got[got["grp"] == frame["grp"][0]]["cluster"]
        assert mine.isna().tolist() == (want < 0).tolist()
        assert mine.dropna().astype(int).tolist() == (want[want >= 0] - 50).tolist()
    if most:
        assert max(written.values()) <= 16 * len(x)


def test_dense_cells_of_two_tiles_are_linked_by_their_nearest_points():
    rng = np.random.default_rng(3)
    x = np.vstack([rng.uniform(0.0, 0.5, (1500, 2)), rng.uniform([1.2, 0.0], [1.7, 0.5], (1500, 2))])
    key = np.repeat([0, 2], 1500)
    cells = cluster_tiles.Cells(key, x)
    least = min(((x[:1500] - y) ** 2).sum(1).min() for y in x[1500:])
    assert cluster_tiles._touch(cells, 0, 1, least * (1 + 1e-12)) and not cluster_tiles._touch(cells, 0, 1, least * (1 - 1e-9))


def test_silhouette_of_many_clusters_prunes_them(spark):
    rng = np.random.default_rng(6)
    centre = rng.uniform(-20, 20, (900, 2))
    x = np.vstack([centre + rng.normal(0, 0.3, centre.shape) for _ in range(3)] + [rng.uniform(-20, 20, (1, 2))])
    label = np.r_[np.tile(np.arange(900), 3), 5000]
    df = spark.createDataFrame(pd.DataFrame({"label": label, "f0": x[:, 0], "f1": x[:, 1]})).withColumn("label", F.when(F.col("label") != 7, F.col("label")))
    keep = label != 7
    x, label = x[keep], label[keep]
    d = ((x[:, None] - x[None]) ** 2).sum(-1)
    want = []
    for i in range(len(x)):
        same = (label == label[i]) & (np.arange(len(x)) != i)
        others = pd.Series(d[i][label != label[i]]).groupby(label[label != label[i]]).mean().min()
        want.append((others - d[i][same].mean()) / max(others, d[i][same].mean()) if same.any() else 0.0)
    got = cluster.silhouette(df, ["f0", "f1"], "label")
    assert "NestedLoop" not in got._jdf.queryExecution().toString() and "Cartesian" not in got._jdf.queryExecution().toString()
    row = got.first()
    assert abs(row["silhouette"] - np.mean(want)) < 1e-9 and row["n_points"] == len(x)


def test_labels_stay_with_open_cells_and_within_goals(spark, monkeypatch):
    """One tile is one round: nothing is sent to tiles that are not there, and nothing dearer than the goals is kept."""
    cost = np.full((12, 12), 10.0)
    names = []

    def count(frame, name, *rest):
        names.append(name)
        return write_table(frame, name, *rest)

    monkeypatch.setattr(routing, "write_table", count)
    found, steps = plan(spark, cost, (2, 2), (2, 5), 64)
    assert names.count("labels") == 1 and steps == [(2, 2), (2, 3), (2, 4), (2, 5)]
    g = {(r["row"], r["col"]): r["g"] for r in found.collect()}
    assert max(g.values()) == g[2, 5] == 30.0 and (11, 11) not in g


@pytest.mark.parametrize("most", [1, 7, 1000])
def test_batches_part_no_group(most):
    rows = pd.DataFrame({"k": np.repeat(["a", "b", "c", "d"], [5, 1, 9, 2]), "v": np.arange(17)})
    seen = list(batches.whole_groups(["k"], lambda part: part, most)(rows.iloc[i:i + 3] for i in range(0, 17, 3)))
    assert pd.concat(seen)["v"].tolist() == list(range(17))
    assert sorted(k for part in seen for k in set(part["k"])) == ["a", "b", "c", "d"]
    assert [rows["k"][lo:hi].tolist() for lo, hi in batches.groups(rows, ["k"])] == [["a"] * 5, ["b"], ["c"] * 9, ["d"] * 2]
