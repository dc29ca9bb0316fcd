"""Top sites, ranking, waypoints, goals and joins by nearness."""

from __future__ import annotations

from pyspark.sql import functions as F

from selenogrid.functions import decode, describe, geo
from selenogrid.operators import classify, distance, proximity, sites
from selenogrid.plans.registry import cte, query
from selenogrid.plans.steps import box_sql, cell_sql, haversine_sql, lat_sql, lon_sql
from selenogrid.session import write_table

SEP = 10
MR = ["mission_id", "rank"]


def r6(name, digits=6):
    return F.round(name, digits).alias(name)


cte("peaks", box_sql("scores", SEP, {"top": ("max", "final")}, by="mission_id, region"), ["scores"])
cte("cands", """
SELECT mission_id, region, row, col, final FROM scores JOIN peaks USING (mission_id, region, row, col)
WHERE final = top AND final > 0""", ["scores", "peaks"])


def greedy_sql(src: str, by: str, n: int = 10, sep: int = SEP, score: str = "final") -> str:
    return f"""
SELECT {by}, CAST(generate_subscripts(picked, 1) AS INT) AS rank, unnest(picked).row AS row, unnest(picked).col AS col
FROM (SELECT {by}, list_reduce(list_transform(list(struct_pack(row := row, col := col) ORDER BY {score} DESC, row, col), lambda c: [c]),
    lambda acc, x: CASE WHEN len(acc) >= {n} OR len(list_filter(acc,
      lambda k: (k.row - x[1].row) ** 2 + (k.col - x[1].col) ** 2 < {sep * sep})) > 0 THEN acc ELSE list_concat(acc, x) END) AS picked
  FROM {src} GROUP BY {by})"""


cte("picked", greedy_sql("cands", "mission_id, region"), ["cands"])
cte("sites", f"""
SELECT s.mission_id, s.region, s.rank, s.row, s.col, {lon_sql("s.row", "s.col")} AS lon, {lat_sql("s.row", "s.col")} AS lat,
  c.* EXCLUDE (mission_id, region, row, col), m.mission_type, m.power_source, m.n_results, m.max_slope_deg
FROM picked s JOIN scores c USING (mission_id, region, row, col) JOIN missions m USING (mission_id, region)""",
    ["picked", "scores", "missions"])


@query("sites_candidates", "SELECT mission_id, row, col, round(final, 6) AS final FROM cands", ["cands"])
def sites_candidates(ws):
    return sites.candidates(ws.scores, ["mission_id", "region"], "final", SEP).select("mission_id", "row", "col", r6("final"))


REASON = """CASE
  WHEN safety > 0.85 THEN printf('Exceptionally flat, low-roughness terrain (safety=%.2f) ideal for safe touchdown at %.2f°S, %.2f°E.', round(safety, 2), round(lat, 2), round(lon, 2))
  WHEN mission_type = 'water_ice' AND lat < -88.5 THEN printf('Near-polar location (%.2f°S) maximises access to permanently shadowed regions for ice prospecting (mission=%.2f).', round(lat, 2), round(mission, 2))
  WHEN mission_type = 'geological' THEN printf('Diverse terrain with elevation transitions at %.2f°S offers high geological sampling value (mission=%.2f).', round(lat, 2), round(mission, 2))
  WHEN mission_type = 'atmospheric' AND elevation > 0 THEN printf('Elevated ridge at %.0f m provides extended sunlight exposure for power generation (mission=%.2f).', round(elevation, 0), round(mission, 2))
  ELSE printf('Balanced safety (%.2f) and science (%.2f) score at %.2f°S, %.2f°E.', round(safety, 2), round(mission, 2), round(lat, 2), round(lon, 2)) END"""


@query("sites_top", f"""
SELECT mission_id, region, rank, row, col, round(lon, 6) AS lon, round(lat, 6) AS lat, round(elevation, 6) AS elevation, round(slope, 6) AS slope,
  round(roughness, 6) AS roughness, round(safety, 6) AS safety, round(mission, 6) AS mission, round(final, 6) AS final,
  {REASON} AS reasoning FROM sites""", ["sites"])
def sites_top(ws):
    out = ws.ranked(SEP)
    return out.select("mission_id", "region", "rank", "row", "col", *[r6(c) for c in (
        "lon", "lat", "elevation", "slope", "roughness", "safety", "mission", "final")], "reasoning")


@query("sites_requested", """
SELECT mission_id, rank, CASE WHEN rank = 1 THEN 'primary' WHEN rank <= 5 THEN 'secondary' ELSE 'other' END AS tier
FROM sites WHERE rank <= greatest(1, n_results)""", ["sites"])
def sites_requested(ws):
    return sites.keep_requested(ws.sites, ws.missions).select(*MR, describe.rank_tier(F.col("rank")).alias("tier"))


@query("sites_rerank_by_class", """
WITH a AS (SELECT mission_id, rank, final, cls FROM sites JOIN (SELECT mission_id, region, row, col, CASE WHEN coalesce(slope > 25, false) OR coalesce(roughness > 200, false) THEN 0
  WHEN mission > 0.7 AND safety > 0.3 THEN 4 WHEN safety > 0.6 AND final > 0.5 THEN 3 WHEN safety BETWEEN 0.3 AND 0.6 THEN 2 ELSE 1 END AS cls FROM scores)
  USING (mission_id, region, row, col)),
b AS (SELECT *, CASE cls WHEN 4 THEN least(1, final + 0.1) WHEN 0 THEN 0 ELSE final END AS adjusted FROM a)
SELECT mission_id, rank, round(adjusted, 6) AS adjusted, CAST(row_number() OVER (PARTITION BY mission_id ORDER BY adjusted DESC, rank) AS INT) AS new_rank FROM b""",
       ["sites", "scores"])
def sites_rerank_by_class(ws):
    """By the class that the rules give each site for its own rover."""
    cls = classify.rule_label(*[F.col(c) for c in ("slope", "roughness", "safety", "mission", "final")])
    classes = ws.scores.select("mission_id", "region", "row", "col", cls.alias("cls"))
    return sites.rerank_by_class(ws.sites, classes).select(*MR, r6("adjusted"), "new_rank")


@query("sites_rerank_by_forest")
def sites_rerank_by_forest(ws):
    """By the class that the trained forest gives each site's cell; not stated in SQL, since the forest is not."""
    at = ws.labelled.join(ws.sites.select("region", "row", "col").distinct(), ["region", "row", "col"], "left_semi")
    # written, so that the forest passes once over the cells that hold a site, and over no others
    found = write_table(classify.predict(ws.forest, at).select("region", "row", "col", "cls"), "site-classes")
    out = sites.rerank_by_class(ws.sites, found)
    return out.select(*MR, "cls", r6("adjusted"), "new_rank")


@query("sites_within_reach", """
WITH d AS (SELECT s.mission_id, s.rank, sqrt(((s.row - t.row) ** 2 + (s.col - t.col) ** 2)::DOUBLE) AS d FROM sites s
  JOIN sites t ON t.mission_id = s.mission_id AND t.rank = 1)
SELECT mission_id, rank, round(d, 6) AS start_cells FROM d
WHERE d <= 25 OR (SELECT count(*) FROM d e WHERE e.mission_id = d.mission_id AND e.d <= 25) = 0""", ["sites"])
def sites_within_reach(ws):
    return sites.within_reach(ws.sites, 25.0).select(*MR, r6("start_cells"))


@query("site_layer_values", """
SELECT mission_id, layer, count(*) AS n, round(min(v), 6) AS lo, round(max(v), 6) AS hi, round(avg(v), 6) AS mean
FROM (SELECT mission_id, unnest(['illumination', 'psr', 'earth_visibility', 'sky_visibility']) AS layer,
  unnest([illumination, psr, earth_visibility, sky_visibility]) AS v FROM sites) GROUP BY ALL""", ["sites"])
def site_layer_values(ws):
    names = ["illumination", "psr", "earth_visibility", "sky_visibility"]
    at = proximity.lookup(ws.sites, ws.decoded, names)
    long = at.select("mission_id", F.explode(F.array(*[F.struct(F.lit(n).alias("layer"), F.col(n).alias("v")) for n in names])).alias("x"))
    return long.groupBy("mission_id", "x.layer").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.min("x.v"), 6).alias("lo"), F.round(F.max("x.v"), 6).alias("hi"), F.round(F.avg("x.v"), 6).alias("mean"))


@query("sites_science_rank", """
WITH b AS (SELECT mission_id, rank, CASE WHEN len(m.science_experiments) > 0 THEN 0.6 * s.final + 0.4 * s.science END AS v FROM sites s JOIN missions m USING (mission_id, region))
SELECT mission_id, rank, round(v, 6) AS science_blend, CAST(row_number() OVER (PARTITION BY mission_id ORDER BY v DESC NULLS LAST, rank) AS INT) AS science_rank FROM b""",
       ["sites", "missions"])
def sites_science_rank(ws):
    return sites.science_rank(ws.sites, ws.missions).select(*MR, r6("science_blend"), "science_rank")


SR, SC = cell_sql("lon", "lat")
cte("site_sun", f"""
SELECT s.mission_id, s.rank, CAST(round(CAST(c.illumination AS DECIMAL(18, 12)), 3) AS DOUBLE) AS sunlight_fraction
FROM (SELECT mission_id, region, rank, greatest(0, least(63, CAST(floor({SR}) AS INT))) AS r,
  greatest(0, least(63, CAST(floor({SC}) AS INT))) AS c FROM sites) s
LEFT JOIN cells c ON c.region = s.region AND c.row = s.r AND c.col = s.c""", ["sites", "cells"])


@query("site_sunlight", "SELECT mission_id, rank, sunlight_fraction FROM site_sun", ["site_sun"])
def site_sunlight(ws):
    return sites.with_sunlight(ws.sites, ws.regions, ws.cells, "illumination").select(*MR, "sunlight_fraction")


# --- distance to shadow, nearest shadow, nearest site, snapping ------------------------------------------------------


@query("distance_to_shadow", "SELECT region, row, col, round(shadow_m, 4) AS shadow_m FROM layers", ["layers"])
def distance_to_shadow(ws):
    return distance.distance_to_mask(ws.cells, decode.shadow(F.col("raw_psr")) >= 0.5, "shadow_m").select("region", "row", "col", r6("shadow_m", 4))


@query("distance_across_tiles", "SELECT region, row, col, round(shadow_m, 4) AS shadow_m FROM layers", ["layers"])
def distance_across_tiles(ws):
    """The same in bands of 5 rows, so that most nearest cells are handed on from band to band."""
    near = distance.distance_to_mask(ws.cells, decode.shadow(F.col("raw_psr")) >= 0.5, "shadow_m", band=5)
    return near.select("region", "row", "col", r6("shadow_m", 4))


@query("distance_to_shadow_uncut", """
SELECT a.region, a.row, a.col, arg_min({'r': b.row, 'c': b.col}, (a.row - b.row) ** 2 + (a.col - b.col) ** 2 + (b.row * 64 + b.col) / 100000.0::DOUBLE).r AS near_row,
  arg_min({'r': b.row, 'c': b.col}, (a.row - b.row) ** 2 + (a.col - b.col) ** 2 + (b.row * 64 + b.col) / 100000.0::DOUBLE).c AS near_col
FROM cells a JOIN cells b ON a.region = b.region AND b.raw_psr = 20000 GROUP BY ALL""", ["cells"])
def distance_to_shadow_uncut(ws):
    """The nearest shadow cell itself, however far."""
    return distance.nearest_masked(ws.cells, decode.shadow(F.col("raw_psr")) >= 0.5)


@query("nearest_shadow_goal", """
SELECT s.mission_id, arg_min(struct_pack(r := c.row, c := c.col), (s.row - c.row) ** 2 + (s.col - c.col) ** 2 + (c.row * 64 + c.col) / 100000.0::DOUBLE).r AS row,
  arg_min(struct_pack(r := c.row, c := c.col), (s.row - c.row) ** 2 + (s.col - c.col) ** 2 + (c.row * 64 + c.col) / 100000.0::DOUBLE).c AS col,
  round(min(sqrt(((s.row - c.row) ** 2 + (s.col - c.col) ** 2)::DOUBLE)), 6) AS distance_cells
FROM sites s JOIN decoded c ON c.region = s.region AND c.psr > 0.7 AND (c.row <> s.row OR c.col <> s.col) WHERE s.rank = 1 GROUP BY 1""",
       ["sites", "decoded"])
def nearest_shadow_goal(ws):
    starts = ws.sites.filter("rank = 1").select("mission_id", "region", F.col("row").alias("p_row"), F.col("col").alias("p_col"))
    return proximity.nearest_where(starts, ws.decoded.filter("psr > 0.7"), ["mission_id"]).select("mission_id", "row", "col", r6("distance_cells"))


cte("landmarks", """
SELECT s_suppkey AS landmark, region, height, width, resolution_m, origin_x, origin_y,
  -84.7 - (s_suppkey % 500) / 100.0::DOUBLE AS p_lat, (s_suppkey * 7 % 40)::DOUBLE - 15 AS p_lon
FROM supplier JOIN regions ON region = 'R' || CAST(s_suppkey % (SELECT count(*) FROM regions) AS VARCHAR)""", ["regions"])
LR, LC = cell_sql("p_lon", "p_lat")
cte("landmark_cells", f"""
SELECT *, CAST(round_even({LR}, 0) AS INT) AS raw_row, CAST(round_even({LC}, 0) AS INT) AS raw_col,
  CAST(round_even({LR}, 0) AS INT) BETWEEN 0 AND 63 AND CAST(round_even({LC}, 0) AS INT) BETWEEN 0 AND 63 AS inside,
  greatest(0, least(63, CAST(round_even({LR}, 0) AS INT))) AS p_row, greatest(0, least(63, CAST(round_even({LC}, 0) AS INT))) AS p_col
FROM landmarks""", ["landmarks"])


def landmarks(ws):
    n = ws.regions.count()
    k = F.col("s_suppkey")
    base = ws.source("supplier").select(
        k.alias("landmark"), F.concat(F.lit("R"), (k % n).cast("string")).alias("region"),
        (-84.7 - (k % 500) / 100.0).alias("p_lat"), ((k * 7 % 40).cast("double") - 15).alias("p_lon")).join(ws.regions, "region")
    r, c = geo.lonlat_to_cell(*[F.col(n) for n in ("p_lon", "p_lat", "resolution_m", "origin_x", "origin_y")])
    cr, cc, inside = geo.clamp_cell(r, c, F.col("height"), F.col("width"))
    return base.select("landmark", "region", "p_lat", "p_lon", cr.alias("p_row"), cc.alias("p_col"), inside.alias("inside"))


cte("near_site", f"""
SELECT l.landmark, l.inside, s.mission_id, min(sqrt(((s.row - p_row) ** 2 + (s.col - p_col) ** 2)::DOUBLE)) AS d_px,
  min({haversine_sql("p_lat", "p_lon", "s.lat", "s.lon")}) AS d_km
FROM landmark_cells l JOIN sites s USING (region) GROUP BY ALL""", ["landmark_cells", "sites"])


@query("nearest_site_to_landmark", """
SELECT landmark, mission_id, round(d_px, 6) AS distance_cells, round(d_km, 6) AS distance_km FROM near_site""", ["near_site"])
def nearest_site_to_landmark(ws):
    return proximity.nearest_site(landmarks(ws), ws.sites, ["landmark", "mission_id"]).select(
        "landmark", "mission_id", r6("distance_cells"), r6("distance_km"))


@query("snap_to_passable", """
WITH c AS (SELECT l.landmark, p_row, p_col, c.row, c.col, greatest(abs(c.row - p_row), abs(c.col - p_col)) AS ring,
  (c.row - p_row) ** 2 + (c.col - p_col) ** 2 AS d2 FROM landmark_cells l JOIN terrain c ON c.region = l.region
  AND c.elevation IS NOT NULL AND c.slope <= 12 AND greatest(abs(c.row - p_row), abs(c.col - p_col)) <= 50)
SELECT landmark, l.p_row, l.p_col, k.row, k.col FROM landmark_cells l LEFT JOIN
 (SELECT landmark, row, col FROM c QUALIFY row_number() OVER (PARTITION BY landmark ORDER BY ring, d2, row - p_row, col - p_col) = 1) k USING (landmark)""",
       ["landmark_cells", "terrain"])
def snap_to_passable(ws):
    free = ws.terrain.filter("elevation IS NOT NULL AND slope <= 12")
    return proximity.snap_to_passable(landmarks(ws).select("landmark", "region", "p_row", "p_col"), free, ["landmark"]).select(
        "landmark", "p_row", "p_col", "row", "col")


@query("hazard_around_sites", """
SELECT s.mission_id, s.rank, round(max(c.slope), 6) AS max_slope, round(max(c.elevation) - min(c.elevation), 6) AS relief,
  max(c.elevation) - min(c.elevation) > 50 AS crater
FROM sites s JOIN terrain c ON c.region = s.region AND c.row BETWEEN s.row - 2 AND s.row + 2 AND c.col BETWEEN s.col - 2 AND s.col + 2
GROUP BY 1, 2""", ["sites", "terrain"])
def hazard_around_sites(ws):
    pts = ws.sites.select(*MR, "region", F.col("row").alias("p_row"), F.col("col").alias("p_col"))
    near = proximity.near_cells(pts, ws.terrain.select("region", "row", "col", "slope", "elevation"), 2)
    relief = F.max("elevation") - F.min("elevation")
    return near.groupBy(*MR).agg(F.round(F.max("slope"), 6).alias("max_slope"), F.round(relief, 6).alias("relief"), (relief > 50).alias("crater"))
