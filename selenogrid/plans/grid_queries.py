"""Sources, decodes, predicates, geometry, focus areas and resampling."""

from __future__ import annotations

from pyspark.sql import functions as F

from selenogrid.functions import decode, describe, geo
from selenogrid.operators import focus, proximity, resample
from selenogrid.operators.grid import densify
from selenogrid.operators.quantiles import attach, region_stats
from selenogrid.operators.scoring import edge_margin, passable
from selenogrid.plans.registry import cte, query
from selenogrid.plans.steps import cell_sql, haversine_sql, lat_sql, lon_sql
from selenogrid.session import work_folder, write_table
from selenogrid.sources import demo_grid, ingest

KEY = ["region", "row", "col"]
GEOM = ["resolution_m", "origin_x", "origin_y"]


def geom():
    return [F.col(c) for c in GEOM]


def r6(name, digits=6):
    return F.round(name, digits).alias(name)


# --- sources -----------------------------------------------------------------------------------------------------


@query("load_tiles", "SELECT region, row, col, round(elevation, 6) AS elevation, round(illumination, 6) AS illumination FROM cells",
       ["cells"])
def load_tiles(ws):
    names = ["elevation", "illumination"]
    tiles = write_table(ingest.cells_to_tiles(ws.cells, names, 16), "tiles", ["region"])
    return ingest.attach_layers(ingest.tiles_to_cells(tiles, 16), names).select(*KEY, *[r6(n) for n in names])


@query("region_registry", """
SELECT r.region, height, width, resolution_m, origin_x, origin_y, height * resolution_m / 1000 AS side_km,
  count(elevation) AS n_cells, count(*) - count(elevation) AS n_nodata
FROM regions r JOIN cells c USING (region, height, width, resolution_m, origin_x, origin_y) GROUP BY ALL""", ["regions", "cells"])
def region_registry(ws):
    counts = ws.cells.groupBy("region").agg(F.count("elevation").alias("n_cells"),
                                            (F.count(F.lit(1)) - F.count("elevation")).alias("n_nodata"))
    return ws.regions.join(counts, "region").select(
        "*", (F.col("height") * F.col("resolution_m") / 1000).alias("side_km"))


@query("load_region", "SELECT region, row, col, round(elevation, 6) AS elevation FROM cells WHERE region = 'R0'", ["cells"])
def load_region(ws):
    return ingest.load_region(ws.cells, ws.regions, "R0").select(*KEY, r6("elevation"))


@query("load_uploaded", """
SELECT region, row, col, round(CASE WHEN region = 'R0' THEN CASE WHEN elevation <> 7 OR elevation IS NULL THEN elevation END
  ELSE CASE WHEN raw_dn NOT IN (0, -32768) AND raw_dn <> 7 THEN raw_dn * 0.5::DOUBLE END END, 6) AS metres FROM cells""", ["cells"])
def load_uploaded(ws):
    kind = F.when(F.col("region") == "R0", "float").otherwise("int16")
    value = F.when(kind == "float", F.col("elevation")).otherwise(F.col("raw_dn"))
    return ws.cells.select(*KEY, F.round(decode.uploaded_metres(value, kind, F.lit(7.0)), 6).alias("metres"))


@query("upload_plausibility", """
SELECT s_suppkey AS upload, round(abs(s_acctbal * 2000), 6) AS resolution_m, abs(s_acctbal * 2000) > 0 AND abs(s_acctbal * 2000) <= 1e7::DOUBLE AS plausible FROM supplier""", [])
def upload_plausibility(ws):
    """Every supplier's balance read as the signed pixel size of an uploaded grid."""
    size = F.col("s_acctbal").cast("double") * 2000
    return ws.source("supplier").select(F.col("s_suppkey").alias("upload"), F.round(F.abs(size), 6).alias("resolution_m"), decode.plausible_size(size).alias("plausible"))


@query("resolve_layer", """
WITH caller AS (SELECT region, row, col, raw_illum / 22500 AS illumination FROM sparse WHERE region = 'R0' AND quality >= 3),
bundled AS (SELECT region, row, col, illumination FROM sparse WHERE region <> 'R1'),
both_ AS (SELECT region, row, col, c.illumination AS a, b.illumination AS b FROM caller c FULL JOIN bundled b USING (region, row, col))
SELECT r.region, row, col, round(CASE WHEN r.region = 'R0' THEN a ELSE b END, 6) AS illumination, row IS NOT NULL AS present
FROM regions r LEFT JOIN both_ USING (region)""", ["sparse", "regions"])
def resolve_layer(ws):
    held = demo_grid.sparse_cells(ws.spark, ws.sf_dir)
    caller = held.filter("region = 'R0' AND quality >= 3").withColumn("illumination", F.col("raw_illum") / 22500)
    out = ingest.resolve_layer(caller, held.filter("region <> 'R1'"), ws.regions, "illumination")
    return out.select(*KEY, r6("illumination"), "present")


@query("attach_layers", """
SELECT region, row, col, round(illumination, 6) AS illumination, round(sky_visibility, 6) AS sky_visibility,
  round(earth_visibility, 6) AS earth_visibility, quality FROM sparse""", ["sparse"])
def attach_layers(ws):
    names = ["illumination", "sky_visibility", "earth_visibility", "quality"]
    long = demo_grid.sparse_cells(ws.spark, ws.sf_dir).select(*KEY, F.explode(F.array(*[
        F.struct(F.lit(n).alias("layer"), F.col(n).alias("value")) for n in names])).alias("x")).select(*KEY, "x.*")
    return ingest.attach_layers(long, names).select(*KEY, *[r6(n) for n in names])


CRATERS = """SELECT -65 - (c_custkey % 2500) / 100.0::DOUBLE AS lat, (c_custkey * 37 % 360)::DOUBLE AS lon,
  0.05 + (c_custkey % 400) / 100.0::DOUBLE AS diam_km FROM customer"""
cte("craters", CRATERS)


def craters(ws):
    k = F.col("c_custkey")
    return ws.source("customer").select(
        (-65 - (k % 2500) / 100.0).alias("lat"), (k * 37 % 360).cast("double").alias("lon"),
        (0.05 + (k % 400) / 100.0).alias("diam_km"), k)


@query("read_craters_csv", "SELECT round(lat, 6) AS lat, lon, round(diam_km, 6) AS diam_km FROM craters", ["craters"])
def read_craters_csv(ws):
    path = f"{work_folder(ws.spark)}/selenogrid/craters-csv"
    craters(ws).select(F.col("c_custkey").cast("string").alias("id"), "lat", "lon", "diam_km",
                       F.lit("surveyed").alias("remark")).write.mode("overwrite").option("header", True).csv(path)
    return ingest.read_craters(ws.spark, path).select(r6("lat"), "lon", r6("diam_km"))


cte("half", """
SELECT region, row // 2 AS row, col // 2 AS col, avg(elevation) AS elevation, avg(illumination) AS illumination
FROM cells GROUP BY ALL""", ["cells"])


@query("write_downsampled", """
SELECT region, row, col, round(elevation, 8) AS elevation, round(illumination, 8) AS illumination FROM half""", ["half"])
def write_downsampled(ws):
    small = resample.block_mean(ws.cells, 2, ["elevation", "illumination"])
    # a region's folder gets one file for every 256 rows, not one from every task
    small = small.repartition("region", F.floor(F.col("row") / 256))
    return write_table(small, "half", ["region"]).select(*KEY, r6("elevation", 8), r6("illumination", 8))


@query("block_mean_partial_blocks", """
SELECT region, row // 12 AS row, col // 12 AS col, round(avg(elevation), 6) AS elevation, 7200.0::DOUBLE AS resolution_m
FROM cells GROUP BY ALL""", ["cells"])
def block_mean_partial_blocks(ws):
    return resample.block_mean(ws.cells, 12, ["elevation"]).select(*KEY, r6("elevation"), "resolution_m")


@query("layer_inventory", """
WITH e AS (SELECT * FROM (VALUES ('elevation', true), ('quality', false), ('illumination', false), ('psr', false),
  ('earth_visibility', false), ('sky_visibility', false), ('minirf_cpr', false), ('mas_57m', false), ('mas_225m', false),
  ('mas_560m', false), ('hurst', false), ('ldsm_err', false), ('m3_oh_band', false)) t(layer, required)),
p AS (SELECT region, count(elevation) AS elevation, count(quality) AS quality, count(illumination) AS illumination,
  count(earth_visibility) AS earth_visibility, count(sky_visibility) AS sky_visibility FROM cells GROUP BY region),
u AS (UNPIVOT p ON elevation, quality, illumination, earth_visibility, sky_visibility INTO NAME layer VALUE n_values)
SELECT r.region, e.layer, e.required, coalesce(n_values, 0) AS n_values, CASE WHEN n_values > 0 THEN 'present'
  WHEN e.required THEN 'required missing' ELSE 'optional missing' END AS status
FROM regions r CROSS JOIN e LEFT JOIN u ON u.region = r.region AND u.layer = e.layer""", ["cells", "regions"])
def layer_inventory(ws):
    return ingest.inventory(ws.spark, ws.cells, ws.regions)


PRESET_VALUES = """(VALUES ('pragyan', 'geological', 12.0::DOUBLE, 54.0::DOUBLE, 0.1::DOUBLE, 0.075::DOUBLE),
  ('viper', 'water_ice', 20.0::DOUBLE, 450.0::DOUBLE, 0.8::DOUBLE, 0.25::DOUBLE),
  ('artemis_ltv', 'water_ice', 15.0::DOUBLE, 2000.0::DOUBLE, 1.5::DOUBLE, 0.4::DOUBLE),
  ('change7', 'water_ice', 20.0::DOUBLE, 500.0::DOUBLE, 0.5::DOUBLE, 0.15::DOUBLE),
  ('luna27', 'water_ice', 20.0::DOUBLE, 800.0::DOUBLE, 0.3::DOUBLE, 0.2::DOUBLE))
  p(preset_id, p_type, p_slope, p_battery, p_speed, p_wheel)"""


@query("preset_catalogue", f"""
SELECT m.mission_id, preset_id, p_slope >= max_slope_deg AS steeper, round(p_battery - battery_wh, 6) AS battery_gain
FROM missions m JOIN {PRESET_VALUES} ON p_type = mission_type""", ["missions"])
def preset_catalogue(ws):
    cat = ingest.presets(ws.spark).filter("profile IS NOT NULL").select("preset_id", "profile.*").select(
        "preset_id", "mission_type", F.col("max_slope_deg").alias("p_slope"), F.col("battery_wh").alias("p_battery"))
    return ws.missions.join(cat, "mission_type").select(
        "mission_id", "preset_id", (F.col("p_slope") >= F.col("max_slope_deg")).alias("steeper"),
        F.round(F.col("p_battery") - F.col("battery_wh"), 6).alias("battery_gain"))


@query("apply_preset", f"""
WITH req AS (SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'pragyan' WHEN 1 THEN 'viper' WHEN 2 THEN 'luna27' ELSE 'unlisted' END
    AS want, CASE p_partkey % 3 WHEN 0 THEN 'solar' ELSE 'rtg' END AS power_source FROM part)
SELECT p_partkey, power_source, preset_id, p_slope AS max_slope_deg, p_speed AS speed_kmh, p_wheel AS wheel_radius_m,
  CASE power_source WHEN 'solar' THEN p_battery ELSE 2000 END AS battery_wh,
  CASE power_source WHEN 'solar' THEN 50.0::DOUBLE END AS solar_panel_w, CASE power_source WHEN 'solar' THEN 7.4::DOUBLE END AS mission_day,
  0.5::DOUBLE AS priority
FROM req JOIN {PRESET_VALUES} ON preset_id = CASE WHEN want = 'unlisted' THEN 'viper' ELSE want END""")
def apply_preset(ws):
    k = F.col("p_partkey")
    want = F.when(k % 4 == 0, "pragyan").when(k % 4 == 1, "viper").when(k % 4 == 2, "luna27").otherwise("unlisted")
    req = ws.source("part").select("p_partkey", want.alias("preset_id"), F.when(k % 3 == 0, "solar").otherwise("rtg").alias("power_source"))
    return ingest.apply_preset(req, ingest.presets(ws.spark).filter("profile IS NOT NULL")).withColumn(
        "preset_id", F.when(F.col("preset_id") == "unlisted", "viper").otherwise(F.col("preset_id")))


@query("validate_missions", """
WITH m AS (SELECT p_partkey, CASE WHEN p_partkey % 19 <> 0 THEN CAST(p_size AS DOUBLE) END AS max_slope_deg, CAST(p_size AS DOUBLE) + 5 AS abs_max,
  CASE WHEN p_partkey % 23 <> 0 THEN CAST(p_partkey % 370 AS DOUBLE) END AS days, CASE WHEN p_partkey % 3 <> 0 THEN CAST(p_partkey % 29 AS DOUBLE) - 25 END AS target_lat, CAST(p_partkey % 13 AS DOUBLE) / 10 AS priority,
  CASE p_partkey % 5 WHEN 0 THEN 'water_ice' WHEN 1 THEN 'geological' WHEN 2 THEN 'atmospheric' WHEN 3 THEN 'water_ice' ELSE 'tourism' END AS mission_type,
  CASE p_partkey % 7 WHEN 6 THEN 'wind' WHEN 5 THEN 'solar' WHEN 4 THEN NULL ELSE 'rtg' END AS power_source,
  CASE WHEN p_partkey % 4 <> 0 THEN CAST(p_partkey % 31 AS DOUBLE) END AS mission_day,
  CASE p_partkey % 11 WHEN 10 THEN 'hover' ELSE 'rim' END AS psr_intent, p_partkey % 17 = 0 AS bad_exp,
  CAST(-80 - p_partkey % 9 AS DOUBLE) AS lo, CAST(-84 AS DOUBLE) AS hi FROM part),
e AS (SELECT p_partkey, concat_ws(',', CASE WHEN max_slope_deg IS NULL OR NOT max_slope_deg BETWEEN 1 AND 45 THEN 'max_slope_deg' END,
  CASE WHEN NOT abs_max BETWEEN 1 AND 45 THEN 'abs_max_slope_deg' END,
  CASE WHEN NOT priority BETWEEN 0 AND 1 THEN 'priority' END, CASE WHEN days IS NULL OR NOT days BETWEEN 1 AND 365 THEN 'mission_duration_days' END,
  CASE WHEN mission_day >= 29.530589 OR mission_day IS NULL AND (power_source = 'solar' OR power_source IS NULL) THEN 'mission_day' END,
  CASE WHEN mission_type = 'tourism' THEN 'mission_type' END, CASE WHEN power_source = 'wind' OR power_source IS NULL THEN 'power_source' END,
  CASE WHEN psr_intent = 'hover' THEN 'psr_intent' END, CASE WHEN bad_exp THEN 'science_experiments' END,
  CASE WHEN target_lat > 0 THEN 'target_lat' END, CASE WHEN lo >= hi THEN 'focus_lat' END) AS errors FROM m)
SELECT p_partkey, errors, CASE WHEN errors = '' THEN 'accepted' ELSE 'rejected' END AS verdict FROM e""")
def validate_missions(ws):
    k = F.col("p_partkey")
    kinds = F.array(*[F.lit(t) for t in ("water_ice", "geological", "atmospheric", "water_ice", "tourism")])
    m = ws.source("part").select(
        "p_partkey", F.when(k % 19 != 0, F.col("p_size").cast("double")).alias("max_slope_deg"),
        (F.col("p_size").cast("double") + 5).alias("abs_max_slope_deg"), F.when(k % 23 != 0, (k % 370).cast("double")).alias("mission_duration_days"),
        F.when(k % 3 != 0, (k % 29).cast("double") - 25).alias("target_lat"), (k % 13 / 10).alias("priority"),
        F.element_at(kinds, (k % 5 + 1).cast("int")).alias("mission_type"),
        F.when(k % 7 == 6, "wind").when(k % 7 == 5, "solar").when(k % 7 != 4, "rtg").alias("power_source"),
        F.when(k % 4 != 0, (k % 31).cast("double")).alias("mission_day"),
        F.when(k % 11 == 10, "hover").otherwise("rim").alias("psr_intent"),
        F.when(k % 17 == 0, F.array(F.lit("regolith_mechanics"))).otherwise(F.array(F.lit("mineralogy"))).alias("science_experiments"),
        (-80 - k % 9).cast("double").alias("focus_lat_min"), F.lit(-84.0).alias("focus_lat_max"))
    out = m.withColumn("errors", F.concat_ws(",", ingest.mission_errors(m)))
    return out.select("p_partkey", "errors", F.when(F.col("errors") == "", "accepted").otherwise("rejected").alias("verdict"))


# --- decodes and predicates ----------------------------------------------------------------------------------------


@query("decode_linear", """
SELECT region, row, col, CASE WHEN raw_dn NOT IN (0, -32768) THEN raw_dn * 0.5::DOUBLE END AS metres,
  CASE WHEN raw_illum IS NOT NULL THEN round(least(1, greatest(0, raw_illum / 22396)), 6) END AS illumination,
  CASE WHEN raw_earth IS NOT NULL THEN round(least(1, greatest(0, raw_earth / 25000)), 6) END AS earth,
  CASE WHEN raw_sky IS NOT NULL THEN round(least(1, greatest(0, (raw_sky + 31399) / 33918)), 6) END AS sky,
  CASE WHEN raw_psr = 20000 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS shadow,
  round(coalesce(CASE WHEN t > 0 THEN least(1, greatest(0, raw_cpr / t)) END, 0), 6) AS by_max
FROM cells JOIN (SELECT region, max(raw_cpr) AS t FROM cells GROUP BY region) USING (region)""".replace(
    "least(1, greatest(0, raw_cpr / t)) END", "CASE WHEN raw_cpr IS NOT NULL THEN least(1, greatest(0, raw_cpr / t)) END END"), ["cells"])
def decode_linear(ws):
    work = attach(ws.cells, region_stats(ws.cells, {"top": F.max("raw_cpr")}))
    return work.select(
        *KEY, decode.metres(F.col("raw_dn")).alias("metres"),
        F.round(decode.fraction(F.col("raw_illum"), decode.ILLUMINATION_FULL), 6).alias("illumination"),
        F.round(decode.fraction(F.col("raw_earth"), decode.EARTH_FULL), 6).alias("earth"),
        F.round(decode.fraction(F.col("raw_sky"), decode.SKY_RANGE, decode.SKY_MIN), 6).alias("sky"),
        decode.shadow(F.col("raw_psr")).alias("shadow"),
        F.round(F.coalesce(decode.by_max(F.col("raw_cpr"), F.col("top")), F.lit(0.0)), 6).alias("by_max"))


@query("fill_and_gate", """
SELECT region, row, col, round(coalesce(elevation, avg(elevation) OVER (PARTITION BY region)), 6) AS filled,
  elevation IS NOT NULL AND coalesce(slope <= 15, false) AS passable,
  CASE WHEN row BETWEEN 10 AND 53 AND col BETWEEN 10 AND 53 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS edge,
  CASE WHEN slope < 5 THEN 'flat' WHEN slope < 15 THEN 'gentle' WHEN slope < 25 THEN 'moderate' WHEN slope >= 25 THEN 'steep' END AS slope_word,
  CASE WHEN roughness < 5 THEN 'smooth' WHEN roughness < 20 THEN 'moderate' WHEN roughness < 50 THEN 'rough'
       WHEN roughness >= 50 THEN 'extremely rough' END AS rough_word,
  CASE WHEN elevation < -5000 THEN 'deep polar basin' WHEN elevation < -2000 THEN 'low basin floor'
       WHEN elevation < 0 THEN 'below-datum depression' WHEN elevation < 2000 THEN 'near-datum plateau'
       WHEN elevation < 5000 THEN 'elevated highland' WHEN elevation >= 5000 THEN 'prominent ridge summit' END AS elevation_word
FROM terrain""", ["terrain"])
def fill_and_gate(ws):
    work = attach(ws.terrain, region_stats(ws.terrain, {"e_mean": F.avg("elevation")}))
    return work.select(
        *KEY, F.round(F.coalesce("elevation", "e_mean"), 6).alias("filled"), passable(F.lit(15.0)).alias("passable"),
        edge_margin().alias("edge"), describe.slope_word(F.col("slope")).alias("slope_word"),
        describe.roughness_word(F.col("roughness")).alias("rough_word"),
        describe.band(F.col("elevation"), describe.ELEVATION_PHRASES).alias("elevation_word"))


# --- focus areas ---------------------------------------------------------------------------------------------------


@query("crop_latitude_box", f"""
SELECT region, row, col FROM cells WHERE {lat_sql()} BETWEEN -88.5 AND -86""", ["cells"])
def crop_latitude_box(ws):
    box = focus.in_lonlat_box(ws.cells, F.lit(0.0), F.lit(360.0), F.lit(-88.5), F.lit(-86.0))
    return ws.cells.filter(box).select(*KEY)


@query("crop_circle", f"""
SELECT region, row, col, round({haversine_sql(lat_sql(), lon_sql(), "-87.0::DOUBLE", "3.0::DOUBLE")}, 6) AS km
FROM cells WHERE {haversine_sql(lat_sql(), lon_sql(), "-87.0::DOUBLE", "3.0::DOUBLE")} <= 20""", ["cells"])
def crop_circle(ws):
    lon, lat = geo.cell_to_lonlat(F.col("row"), F.col("col"), *geom())
    km = geo.great_circle_km(lat, lon, F.lit(-87.0), F.lit(3.0))
    return ws.cells.filter(focus.in_circle(ws.cells, F.lit(-87.0), F.lit(3.0), F.lit(20.0))).select(
        *KEY, F.round(km, 6).alias("km"))


@query("circle_bounds", """
WITH c AS (SELECT c_custkey, -80 - (c_custkey % 1000) / 100.0::DOUBLE AS lat, (c_custkey * 37 % 360)::DOUBLE AS lon,
  1 + (c_custkey % 50)::DOUBLE AS r FROM customer),
k AS (SELECT *, 2 * pi() * 1737.4::DOUBLE / 360 AS kpd, abs(cos(radians(lat))) AS cl FROM c),
d AS (SELECT *, CASE WHEN cl > 0.01 THEN r / (kpd * cl) ELSE 180 END AS dlon FROM k)
SELECT c_custkey, round(lat - r / kpd, 6) AS lat_min, round(lat + r / kpd, 6) AS lat_max,
  round(lon - dlon - 360 * floor((lon - dlon) / 360), 6) AS lon_min, round(lon + dlon - 360 * floor((lon + dlon) / 360), 6) AS lon_max
FROM d""")
def circle_bounds(ws):
    k = F.col("c_custkey")
    c = ws.source("customer").select("c_custkey", (-80 - (k % 1000) / 100.0).alias("lat"),
                                     (k * 37 % 360).cast("double").alias("lon"), (1 + k % 50).cast("double").alias("r"))
    b = focus.circle_bounds(F.col("lat"), F.col("lon"), F.col("r"))
    return c.select("c_custkey", *[F.round(v, 6).alias(n) for n, v in b.items()])


@query("crop_square", """
SELECT region, row - 16 AS row, col - 16 AS col, 32 AS height, 32 AS width, origin_x + 16 * 600 AS origin_x,
  origin_y - 16 * 600 AS origin_y, round(elevation, 6) AS elevation
FROM cells WHERE row BETWEEN 16 AND 47 AND col BETWEEN 16 AND 47""", ["cells"])
def crop_square(ws):
    return focus.centred_square(ws.cells, 32).select(*KEY, "height", "width", "origin_x", "origin_y", r6("elevation"))


@query("stride_decimation", """
SELECT region, row // 5 AS row, col // 5 AS col, 13 AS height, 3000.0::DOUBLE AS resolution_m, round(elevation, 6) AS elevation
FROM cells WHERE row % 5 = 0 AND col % 5 = 0""", ["cells"])
def stride_decimation(ws):
    return focus.stride(ws.cells, 5).select(*KEY, "height", "resolution_m", r6("elevation"))


# --- geometry ------------------------------------------------------------------------------------------------------

R_SQL, C_SQL = cell_sql("lon", "lat")


@query("cell_coordinates", f"""
SELECT region, row, col, round({lon_sql()}, 6) AS lon, round({lat_sql()}, 6) AS lat, round({lat_sql(at=0.0)}, 6) AS corner_lat FROM cells""",
       ["cells"])
def cell_coordinates(ws):
    lon, lat = geo.cell_to_lonlat(F.col("row"), F.col("col"), *geom())
    _, corner = geo.cell_to_lonlat(F.col("row"), F.col("col"), *geom(), at=0.0)
    return ws.cells.select(*KEY, F.round(lon, 6).alias("lon"), F.round(lat, 6).alias("lat"), F.round(corner, 6).alias("corner_lat"))


cte("points", """
SELECT event_id, region, height, width, resolution_m, origin_x, origin_y, -84.6 - (event_id % 431) / 100.0::DOUBLE AS lat,
  ((event_id * 37) % 3600) / 10.0::DOUBLE AS lon
FROM events JOIN regions ON region = 'R' || CAST(event_id % (SELECT count(*) FROM regions) AS VARCHAR)""", ["regions"])


def points(ws):
    n = ws.regions.count()
    k = F.col("event_id")
    return ws.source("events").select(
        "event_id", F.concat(F.lit("R"), (k % n).cast("string")).alias("region"), (-84.6 - (k % 431) / 100.0).alias("lat"),
        (k * 37 % 3600 / 10.0).alias("lon")).join(ws.regions, "region")


@query("cells_of_points", f"""
SELECT event_id, round({R_SQL}, 6) AS row_f, round({C_SQL}, 6) AS col_f, CAST(round_even({R_SQL}, 0) AS INT) AS row,
  CAST(round_even({C_SQL}, 0) AS INT) AS col, CAST(floor({R_SQL}) AS INT) AS in_row, CAST(floor({C_SQL}) AS INT) AS in_col,
  greatest(0, least(CAST(round_even({R_SQL}, 0) AS INT), 63)) AS clamped_row,
  CAST(round_even({R_SQL}, 0) AS INT) BETWEEN 0 AND 63 AND CAST(round_even({C_SQL}, 0) AS INT) BETWEEN 0 AND 63 AS inside
FROM points""", ["points"])
def cells_of_points(ws):
    at = [F.col("lon"), F.col("lat"), *geom()]
    rf, cf = geo.lonlat_to_cell_float(*at)
    r, c = geo.lonlat_to_cell(*at)
    ir, ic = geo.lonlat_to_containing_cell(*at)
    cr, _, inside = geo.clamp_cell(r, c, F.col("height"), F.col("width"))
    return points(ws).select("event_id", F.round(rf, 6).alias("row_f"), F.round(cf, 6).alias("col_f"), r.alias("row"),
                             c.alias("col"), ir.alias("in_row"), ic.alias("in_col"), cr.alias("clamped_row"), inside.alias("inside"))


#: Pairs of a customer and a supplier that one task makes.
PAIRS_IN_TASK = 1_000_000


@query("great_circle", f"""
SELECT c_custkey, s_suppkey, round({haversine_sql("a.lat", "a.lon", "b.lat", "b.lon")}, 6) AS km
FROM (SELECT c_custkey, c_nationkey, -65 - (c_custkey % 2500) / 100.0::DOUBLE AS lat, (c_custkey * 37 % 360)::DOUBLE AS lon FROM customer) a
JOIN (SELECT s_suppkey, s_nationkey, -65 - (s_suppkey % 2500) / 100.0::DOUBLE AS lat, (s_suppkey * 37 % 360)::DOUBLE AS lon FROM supplier) b
  ON c_nationkey = s_nationkey""")
def great_circle(ws):
    def at(t, k, p):
        return ws.source(t).select(k, f"{p}_nationkey", (-65 - (F.col(k) % 2500) / 100.0).alias(f"{p}_lat"),
                                   (F.col(k) * 37 % 360).cast("double").alias(f"{p}_lon"))
    customers, suppliers = at("customer", "c_custkey", "c"), at("supplier", "s_suppkey", "s")
    sizes = customers.groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("m")).join(
        suppliers.groupBy("s_nationkey").agg(F.count(F.lit(1)).alias("n")), F.col("c_nationkey") == F.col("s_nationkey"))
    n_pairs = sizes.agg(F.sum(F.col("m") * F.col("n"))).first()[0] or 0
    # a small file of customers is one task, whatever it makes: they are dealt out by the pairs they will be in
    dealt = customers.repartition(n_pairs // PAIRS_IN_TASK + 1, "c_custkey")
    pairs = dealt.join(suppliers, F.col("c_nationkey") == F.col("s_nationkey"))
    km = geo.great_circle_km(F.col("c_lat"), F.col("c_lon"), F.col("s_lat"), F.col("s_lon"))
    return pairs.select("c_custkey", "s_suppkey", F.round(km, 6).alias("km"))


@query("catalogue_cells", f"""
WITH c AS (SELECT * FROM (VALUES (0, 'south_pole_75_90', 30.0::DOUBLE, -457000.0::DOUBLE, 457000.0::DOUBLE), (1, 'south_pole_80_90', 20.0::DOUBLE, -15199.5 * 20.0::DOUBLE, 15199.5 * 20.0::DOUBLE),
  (2, 'south_pole_85_90', 10.0::DOUBLE, -15167.5 * 10.0::DOUBLE, 15167.5 * 10.0::DOUBLE), (3, 'south_pole_87_90', 5.0::DOUBLE, -457000.0::DOUBLE, 457000.0::DOUBLE)) v(k, region_key, resolution_m, origin_x, origin_y)),
p AS (SELECT c_custkey, region_key, resolution_m, origin_x, origin_y, -85 - (c_custkey % 490) / 100.0::DOUBLE AS lat, (c_custkey * 37 % 360 + 0.31)::DOUBLE AS lon FROM customer JOIN c ON c_custkey % 4 = k)
SELECT c_custkey, region_key, CAST(floor({R_SQL}) AS INT) AS row, CAST(floor({C_SQL}) AS INT) AS col FROM p""")
def catalogue_cells(ws):
    """Points placed in the published products, by embedded or label-derived geometry."""
    cat = ingest.region_catalogue(ws.spark)
    k = F.element_at(F.create_map(*[x for i, row in enumerate(ingest.REGION_CATALOGUE) for x in (F.lit(row[0]), F.lit(i))]), F.col("region_key"))
    own = F.col("embedded")
    res, ox, oy = geo.native_geometry(F.when(own, F.col("native_res_m")), F.when(own, -457000.0), F.when(own, 457000.0),
                                      F.col("native_res_m"), F.col("offset_cells"))
    grid = cat.select("region_key", k.alias("k"), res.alias("resolution_m"), ox.alias("origin_x"), oy.alias("origin_y"))
    c = F.col("c_custkey")
    pts = ws.source("customer").select("c_custkey", (c % 4).alias("k"), (-85 - (c % 490) / 100.0).alias("lat"), (c * 37 % 360 + 0.31).cast("double").alias("lon"))
    r, cc = geo.lonlat_to_containing_cell(F.col("lon"), F.col("lat"), *geom())
    return pts.join(grid, "k").select("c_custkey", "region_key", r.alias("row"), cc.alias("col"))


@query("axis_labels", f"""
WITH t AS (SELECT r.*, CAST(i AS INT) AS tick, round_even(i * 31 / 5.0::DOUBLE, 0) AS p
  FROM (SELECT r.* FROM regions r JOIN cells c USING (region) WHERE c.row = 0 AND c.col = 0) r, range(6) a(i))
SELECT region, tick, CAST(p AS INT) AS row_tick, round({lat_sql("(p * 2)", "0")}, 6) AS lat, CAST(p AS INT) AS col_tick,
  round({lon_sql("0", "(p * 2)")}, 6) AS lon FROM t""", ["regions", "cells"])
def axis_labels(ws):
    return focus.axis_labels(ws.regions.join(ws.cells.filter("row = 0 AND col = 0").select("region"), "region"), 2).select(
        "region", "tick", "row_tick", r6("lat"), "col_tick", r6("lon"))


# --- resampling ----------------------------------------------------------------------------------------------------

cte("targets", """
SELECT r.*, r.origin_x + 130 AS t_ox, r.origin_y - 70 AS t_oy, 900.0::DOUBLE AS t_res, CAST(i AS INT) AS t_row, CAST(j AS INT) AS t_col
FROM regions r, range(42) a(i), range(42) b(j)""", ["regions"])
cte("sources_at", """
SELECT *, (origin_y - (t_oy - (t_row + 0.5) * t_res)) / resolution_m AS rf, ((t_ox + (t_col + 0.5) * t_res) - origin_x) / resolution_m AS cf
FROM targets""", ["targets"])


def targets(ws):
    t = ws.regions.select("*", F.lit(42).alias("t_height"), F.lit(42).alias("t_width"), F.lit(900.0).alias("t_resolution_m"),
                          (F.col("origin_x") + 130).alias("t_origin_x"), (F.col("origin_y") - 70).alias("t_origin_y"))
    return resample.target_grid(t)


@query("reproject_nearest", """
SELECT s.region, t_row, t_col, c.raw_psr, round(c.elevation, 6) AS elevation FROM sources_at s
LEFT JOIN cells c ON c.region = s.region AND c.row = floor(rf) AND c.col = floor(cf)""", ["sources_at", "cells"])
def reproject_nearest(ws):
    return resample.reproject_nearest(targets(ws), ws.cells, ["raw_psr", "elevation"]).select(
        "region", "t_row", "t_col", "raw_psr", r6("elevation"))


@query("reproject_bilinear", """
SELECT s.region, t_row, t_col, round(sum(c.elevation * w) / nullif(sum(CASE WHEN c.elevation IS NOT NULL THEN w END), 0), 6) AS elevation
FROM (SELECT *, floor(rf - 0.5) + dr AS r, floor(cf - 0.5) + dc AS c,
   CASE dr WHEN 1 THEN rf - 0.5 - floor(rf - 0.5) ELSE 1 - (rf - 0.5 - floor(rf - 0.5)) END
   * CASE dc WHEN 1 THEN cf - 0.5 - floor(cf - 0.5) ELSE 1 - (cf - 0.5 - floor(cf - 0.5)) END AS w
  FROM sources_at, range(2) a(dr), range(2) b(dc)) s
LEFT JOIN cells c ON c.region = s.region AND c.row = s.r AND c.col = s.c GROUP BY 1, 2, 3""", ["sources_at", "cells"])
def reproject_bilinear(ws):
    return resample.reproject_bilinear(targets(ws), ws.cells, ["elevation"]).select("region", "t_row", "t_col", r6("elevation"))


@query("reproject_cropped", """
SELECT s.region, t_row, t_col, CASE WHEN count(c.raw_illum) > 0 THEN round(least(1, greatest(0, sum(c.raw_illum * w) / sum(CASE WHEN c.raw_illum IS NOT NULL THEN w END) / 22396)), 6) END AS illumination
FROM (SELECT *, floor(rf - 0.5) + dr AS r, floor(cf - 0.5) + dc AS c,
   CASE dr WHEN 1 THEN rf - 0.5 - floor(rf - 0.5) ELSE 1 - (rf - 0.5 - floor(rf - 0.5)) END
   * CASE dc WHEN 1 THEN cf - 0.5 - floor(cf - 0.5) ELSE 1 - (cf - 0.5 - floor(cf - 0.5)) END AS w
  FROM sources_at, range(2) a(dr), range(2) b(dc) WHERE t_row BETWEEN 10 AND 29 AND t_col BETWEEN 10 AND 29) s
JOIN cells c ON c.region = s.region AND c.row = s.r AND c.col = s.c GROUP BY 1, 2, 3""", ["sources_at", "cells"])
def reproject_cropped(ws):
    window = targets(ws).filter("t_row BETWEEN 10 AND 29 AND t_col BETWEEN 10 AND 29")
    out = resample.reproject_bilinear(window, ws.cells, ["raw_illum"])
    return out.select("region", "t_row", "t_col", F.round(decode.fraction(F.col("raw_illum"), decode.ILLUMINATION_FULL), 6).alias("illumination"))


FUSED = """
stage1 AS (SELECT region, row, col, elevation AS e FROM sparse WHERE quality >= 1),
stage2 AS (SELECT region, row, col, elevation + 1 AS e FROM sparse WHERE quality >= 4),
stage3 AS (SELECT region, row, col, elevation + 2 AS e FROM sparse WHERE quality >= 7 OR col < 8)"""


@query("fuse_stages", f"""
WITH {FUSED} SELECT region, row, col, round(coalesce(s3.e, s2.e, s1.e), 6) AS elevation
FROM stage1 s1 FULL JOIN stage2 s2 USING (region, row, col) FULL JOIN stage3 s3 USING (region, row, col)""", ["sparse"])
def fuse_stages(ws):
    return fused(ws).select(*KEY, r6("elevation"))


def fused(ws):
    held = demo_grid.sparse_cells(ws.spark, ws.sf_dir)
    e = F.col("elevation")
    return resample.fuse([held, held.filter("quality >= 4").withColumn("elevation", e + 1),
                          held.filter("quality >= 7 OR col < 8").withColumn("elevation", e + 2)], "elevation")


@query("fusion_check", f"""
WITH {FUSED} SELECT c.region, count(*) - count(s1.e) AS nodata_1, count(*) - count(s2.e) AS nodata_2, count(*) - count(s3.e) AS nodata_3,
  count(*) - count(coalesce(s3.e, s2.e, s1.e)) AS nodata_fused,
  count(*) - count(coalesce(s3.e, s2.e, s1.e)) <= least(count(*) - count(s1.e), count(*) - count(s2.e), count(*) - count(s3.e)) AS ok
FROM cells c LEFT JOIN stage1 s1 USING (region, row, col) LEFT JOIN stage2 s2 USING (region, row, col)
LEFT JOIN stage3 s3 USING (region, row, col) GROUP BY c.region""", ["sparse", "cells"])
def fusion_check(ws):
    dense = densify(fused(ws), ws.regions)
    gap = {f"nodata_{i + 1}": F.sum(F.when(F.col(f"s{i}").isNull(), 1).otherwise(0)) for i in range(3)}
    gap["nodata_fused"] = F.sum(F.when(F.col("elevation").isNull(), 1).otherwise(0))
    out = dense.groupBy("region").agg(*[v.alias(n) for n, v in gap.items()])
    return out.withColumn("ok", F.col("nodata_fused") <= F.least("nodata_1", "nodata_2", "nodata_3"))


@query("sample_at_points", f"""
WITH p AS (SELECT event_id, region, {R_SQL} AS rf, {C_SQL} AS cf FROM points)
SELECT event_id, CASE WHEN count(c.elevation) = 4 THEN round(sum(c.elevation * w), 6) END AS elevation
FROM (SELECT *, floor(rf) + dr AS r, floor(cf) + dc AS c, CASE dr WHEN 1 THEN rf - floor(rf) ELSE 1 - (rf - floor(rf)) END
  * CASE dc WHEN 1 THEN cf - floor(cf) ELSE 1 - (cf - floor(cf)) END AS w FROM p, range(2) a(dr), range(2) b(dc)) s
LEFT JOIN cells c ON c.region = s.region AND c.row = s.r AND c.col = s.c GROUP BY event_id""", ["points", "cells"])
def sample_at_points(ws):
    return resample.sample_bilinear(points(ws), ws.cells, ["event_id"], "elevation").select("event_id", r6("elevation"))


@query("upsample_linear", """
WITH coarse AS (SELECT region, row // 16 AS row, col // 16 AS col, coalesce(illumination, 0) AS v FROM cells WHERE row % 16 = 0 AND col % 16 = 0),
f AS (SELECT region, row, col, row * 3 / 63.0::DOUBLE AS rf, col * 3 / 63.0::DOUBLE AS cf FROM cells)
SELECT s.region, s.row, s.col, round(sum(v * w) / sum(w), 6) AS illumination
FROM (SELECT f.*, floor(rf) + dr AS r, floor(cf) + dc AS c, CASE dr WHEN 1 THEN rf - floor(rf) ELSE 1 - (rf - floor(rf)) END
  * CASE dc WHEN 1 THEN cf - floor(cf) ELSE 1 - (cf - floor(cf)) END AS w FROM f, range(2) a(dr), range(2) b(dc)) s
JOIN coarse c ON c.region = s.region AND c.row = s.r AND c.col = s.c GROUP BY ALL""", ["cells"])
def upsample_linear(ws):
    coarse = focus.stride(ws.cells, 16).select("region", "row", "col", F.coalesce("illumination", F.lit(0.0)).alias("illumination"),
                                               F.col("height").alias("n_rows"), F.col("width").alias("n_cols"))
    return resample.upsample_linear(coarse, ws.cells, "illumination").select(*KEY, r6("illumination"))


# --- masks ---------------------------------------------------------------------------------------------------------


@query("dilate_nodata", """
SELECT DISTINCT c.region, c.row, c.col FROM cells c JOIN cells m ON m.region = c.region AND m.elevation IS NULL
  AND abs(m.row - c.row) + abs(m.col - c.col) <= 2""", ["cells"])
def dilate_nodata(ws):
    return proximity.dilate(ws.cells.filter("elevation IS NULL"), 2)


@query("isolated_nodata", """
SELECT c.region, c.row, c.col FROM cells c WHERE c.elevation IS NULL AND c.row BETWEEN 1 AND 62 AND c.col BETWEEN 1 AND 62
  AND NOT EXISTS (SELECT 1 FROM cells m WHERE m.region = c.region AND m.elevation IS NULL AND abs(m.row - c.row) + abs(m.col - c.col) = 1)""",
       ["cells"])
def isolated_nodata(ws):
    return proximity.isolated(ws.cells.filter("elevation IS NULL"))
