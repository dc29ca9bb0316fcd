"""Energy, battery ledger, mobility, sunlight and least-cost routes."""

from __future__ import annotations

from pyspark.sql import functions as F

from selenogrid.functions import physics
from selenogrid.operators import energy, routing, scoring, sunlight
from selenogrid.plans.registry import cte, query
from selenogrid.plans.score_steps import sinkage_sql
from selenogrid.plans.steps import cell_sql, lat_sql


def r(name, digits=4):
    return F.round(name, digits).alias(name)


cte("given", """
SELECT user_id AS route_id, 'R' || CAST(user_id % n AS VARCHAR) AS region,
  'Brand#' || CAST(1 + user_id % 25 AS VARCHAR) || '/R' || CAST(user_id % n AS VARCHAR) AS mission_id,
  CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS INT) AS step,
  CAST((event_id * 7) % 64 AS INT) AS row, CAST((event_id * 13) % 64 AS INT) AS col
FROM events, (SELECT count(*) AS n FROM regions)""", ["regions"])
cte("given_legs", """
SELECT s.*, c.slope, c.elevation, c.psr, c.quality, c.ldsm_err, c.illumination, c.mobility_risk, m.speed_kmh, m.battery_wh, m.power_source,
  m.solar_panel_w, m.mission_day, lag(s.row) OVER w AS p_row, lag(s.col) OVER w AS p_col, lag(c.elevation) OVER w AS p_elevation
FROM given s JOIN missions m USING (mission_id, region)
JOIN (SELECT d.region, d.row, d.col, d.slope, d.elevation, d.psr, d.quality, d.ldsm_err, d.illumination, x.mission_id, x.mobility_risk
  FROM scores x JOIN decoded2 d USING (region, row, col)) c USING (mission_id, region, row, col)
WINDOW w AS (PARTITION BY s.route_id ORDER BY s.step)""", ["given", "missions", "scores", "decoded2"])


def stats_sql(legs: str, key: str) -> str:
    return f"""
SELECT {key}, coalesce(sum(CASE WHEN p_row IS NOT NULL THEN 600 * CASE WHEN abs(row - p_row) + abs(col - p_col) = 2 THEN sqrt(2.0::DOUBLE) ELSE 1 END END), 0) AS total_distance_m,
  coalesce(max(slope), 0) AS max_slope_deg, coalesce(avg(slope), 0) AS mean_slope_deg, count(*) AS waypoint_count, max(speed_kmh) AS speed
FROM {legs} GROUP BY {key}"""


def energy_sql(legs: str, key: str) -> str:
    flat = ("(100 * 600 * CASE WHEN abs(row - p_row) = 1 AND abs(col - p_col) = 1 THEN sqrt(2.0::DOUBLE) ELSE 1 END"
            " / (speed_kmh * 1000))")
    return f"""
SELECT {key}, coalesce(sum(net + rolling), 0) AS total, coalesce(sum(CASE WHEN NOT down THEN net END), 0) AS uphill,
  coalesce(sum(CASE WHEN down THEN flat * 0.3 * s END), 0) AS regen, sum(flat * speed_kmh / 100) AS km, max(battery_wh) AS battery
FROM (SELECT *, CASE WHEN down THEN greatest(0, flat - flat * 0.3 * s) ELSE flat * (1 + 3 * s) END AS net,
    flat * 0.015 * (1 + 3 * coalesce(mobility_risk, 0)) AS rolling
  FROM (SELECT *, {flat} AS flat, sin(radians(coalesce(slope, 0))) AS s, coalesce(elevation < p_elevation, false) AS down FROM {legs})
  WHERE p_row IS NOT NULL) GROUP BY {key}"""


def soft_sql(legs: str, key: str) -> str:
    return f"""
SELECT {key}, avg(risk) AS mean, max(risk) AS top, avg(CASE WHEN risk > 0.6 THEN 1.0 ELSE 0.0 END) AS high
FROM (SELECT *, least(1, 0.4 * coalesce(psr, 0) + 0.3 * CASE WHEN quality IS NULL THEN 0 ELSE greatest(0, least(1, 1 - quality)) END
  + 0.3 * coalesce(ldsm_err, 0)) AS risk FROM {legs}) GROUP BY {key}"""


cte("given_stats", stats_sql("given_legs", "route_id"), ["given_legs"])
cte("given_energy", energy_sql("given_legs", "route_id"), ["given_legs"])
cte("given_soft", soft_sql("given_legs", "route_id"), ["given_legs"])


@query("path_stats", """
SELECT route_id, round(total_distance_m, 4) AS total_distance_m, round(total_distance_m / 1000, 4) AS total_distance_km,
  round(max_slope_deg, 4) AS max_slope_deg, round(mean_slope_deg, 4) AS mean_slope_deg,
  round(total_distance_m / 1000 / speed, 4) AS estimated_time_hrs, waypoint_count FROM given_stats""", ["given_stats"])
def path_stats(ws):
    out = energy.path_stats(ws.given_legs)
    return out.select("route_id", *[r(c) for c in out.columns if c not in ("route_id", "waypoint_count")], "waypoint_count")


@query("path_energy", """
SELECT route_id, round(total, 4) AS total_energy_wh, round(uphill, 4) AS uphill_energy_wh, round(regen, 4) AS downhill_regen_wh,
  round(total / km, 4) AS energy_per_km, round(total / battery * 100, 4) AS battery_pct_used,
  CASE WHEN total / battery * 100 < 40 THEN 'LOW' WHEN total / battery * 100 < 75 THEN 'MODERATE' ELSE 'HIGH' END AS energy_risk,
  round(total / battery * 100, 4) <= 100 AS battery_feasible FROM given_energy""", ["given_energy"])
def path_energy(ws):
    return energy.path_energy(ws.given_legs)


@query("path_soft_terrain", """
SELECT route_id, CAST(round(CAST(mean AS DECIMAL(28, 9)), 4) AS DOUBLE) AS mean_soft_risk, round(top, 4) AS max_soft_risk, round(100 * high, 1) AS soft_terrain_pct,
  CASE WHEN top > 0.7 THEN 'HIGH' WHEN top > 0.4 THEN 'MODERATE' ELSE 'LOW' END AS stuck_risk, top > 0.7 AS soft_terrain_warning
FROM given_soft""", ["given_soft"])
def path_soft_terrain(ws):
    return energy.soft_terrain(ws.given_legs)


def ledger_sql(legs: str, key: str) -> str:
    """Step by step along every route at once, by recursion over the step number."""
    flat = ("(100 * 600 * CASE WHEN abs(row - p_row) = 1 AND abs(col - p_col) = 1 THEN sqrt(2.0::DOUBLE) ELSE 1 END"
            " / (speed_kmh * 1000))")
    return f"""
SELECT *, CASE WHEN down THEN greatest(0, flat - flat * 0.3 * s) ELSE flat * (1 + 3 * s) END AS cost,
  solar_panel_w * light AS charge_w, greatest(0, solar_panel_w * light - 25) AS rate
FROM (SELECT {key}, step, row, col, battery_wh, solar_panel_w, {flat} AS flat, sin(radians(coalesce(slope, 0))) AS s,
    coalesce(elevation < p_elevation, false) AS down,
    least(1, coalesce(illumination, 0) * greatest(0, least(1, (1.5424 * sin(2 * pi() * mission_day / 29.530589) + 1.5424) / 3.0848))) AS light
  FROM {legs} WHERE p_row IS NOT NULL AND power_source = 'solar')"""


cte("given_ledger", ledger_sql("given_legs", "route_id"), ["given_legs"])
cte("given_walk", """
SELECT route_id, 0 AS step, max(battery_wh) AS charge, false AS halted, CAST(NULL AS DOUBLE) AS at_stop FROM given_ledger GROUP BY route_id
UNION ALL
SELECT w.route_id, l.step,
  CASE WHEN greatest(0, w.charge - l.cost) <= l.battery_wh * 0.2 AND l.rate > 0 THEN l.battery_wh * 0.8 ELSE greatest(0, w.charge - l.cost) END,
  greatest(0, w.charge - l.cost) <= l.battery_wh * 0.2, greatest(0, w.charge - l.cost)
FROM given_walk w JOIN given_ledger l ON l.route_id = w.route_id AND l.step = w.step + 1""", ["given_ledger"],
    head="given_walk(route_id, step, charge, halted, at_stop)")
cte("given_stops", """
SELECT w.route_id, w.step, l.row, l.col, l.light, l.charge_w, l.rate, at_stop / battery_wh * 100 AS pct,
  CASE WHEN rate > 0 THEN battery_wh * 0.8 - at_stop ELSE 0 END AS gained,
  CASE WHEN rate > 0 THEN (battery_wh * 0.8 - at_stop) / rate END AS hours
FROM given_walk w JOIN given_ledger l USING (route_id, step) WHERE halted""", ["given_walk", "given_ledger"])


@query("recharge_stops", """
SELECT route_id, step, row, col, round(light, 4) AS illumination_frac, round(charge_w, 2) AS charge_w, round(rate, 2) AS net_charge_rate_wh_hr,
  round(pct, 2) AS battery_at_stop_pct, round(gained, 2) AS energy_gained_wh, round(hours, 2) AS recharge_time_hrs FROM given_stops""",
       ["given_stops"])
def recharge_stops(ws):
    return ws.given_stops


@query("recharge_totals", """
SELECT route_id, count(*) AS n_stops, round(coalesce(sum(round(hours, 2)), 0), 2) AS recharge_hours,
  CAST(sum(CASE WHEN hours IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS infeasible FROM given_stops GROUP BY 1""", ["given_stops"])
def recharge_totals(ws):
    return energy.recharge_totals(ws.given_stops).withColumn("recharge_hours", F.round("recharge_hours", 2))


@query("science_along_route", """
SELECT route_id, round(avg(science), 6) AS mean_science, round(avg(CASE WHEN science > 0.5 THEN 1.0 ELSE 0.0 END), 6) AS rich_share
FROM given s JOIN scores x USING (mission_id, region, row, col) GROUP BY 1""", ["given", "scores"])
def science_along_route(ws):
    at = ws.given.join(ws.scores.select("mission_id", "region", "row", "col", "science"), ["mission_id", "region", "row", "col"])
    return at.groupBy("route_id").agg(F.round(F.avg("science"), 6).alias("mean_science"),
                                      F.round(F.avg((F.col("science") > 0.5).cast("double")), 6).alias("rich_share"))


@query("wheel_sinkage", f"""
SELECT mission_id, soft, round({sinkage_sql("rover_mass_kg", "wheel_width_m", "wheel_radius_m", "n_wheels", "soft")} * 1000, 6) AS sinkage_mm,
  round(2.0::DOUBLE / 3 * sqrt({sinkage_sql("rover_mass_kg", "wheel_width_m", "wheel_radius_m", "n_wheels", "soft")} / (2 * wheel_radius_m)), 8) AS rolling
FROM missions, (SELECT i / 5.0::DOUBLE AS soft FROM range(6) t(i))""", ["missions"])
def wheel_sinkage(ws):
    soft = ws.missions.select("*", F.explode(F.array(*[F.lit(i / 5) for i in range(6)])).alias("soft"))
    z = physics.sinkage_m(F.col("rover_mass_kg"), F.col("wheel_width_m"), F.col("wheel_radius_m"), F.col("n_wheels"), F.col("soft"))
    return soft.select("mission_id", "soft", F.round(z * 1000, 6).alias("sinkage_mm"),
                       F.round(physics.rolling_resistance(z, F.col("wheel_radius_m")), 8).alias("rolling"))


@query("day_illumination", """
SELECT mission_id, round(1.5424 * sin(2 * pi() * mission_day / 29.530589), 6) AS sun_elevation,
  round(avg(illumination * greatest(0, least(1, (1.5424 * sin(2 * pi() * mission_day / 29.530589) + 1.5424) / 3.0848))), 6) AS mean_light
FROM missions JOIN cells USING (region) GROUP BY mission_id, mission_day""", ["missions", "cells"])
def day_illumination(ws):
    work = ws.missions.select("mission_id", "region", "mission_day").join(ws.cells.select("region", "illumination"), "region")
    return work.groupBy("mission_id", "mission_day").agg(
        F.round(F.avg(physics.day_illumination(F.col("illumination"), F.col("mission_day"))), 6).alias("mean_light")
    ).select("mission_id", F.round(physics.sun_elevation_deg(F.col("mission_day")), 6).alias("sun_elevation"), "mean_light")


@query("estimate_sunlight", f"""
WITH m AS (SELECT c.*, avg(elevation) OVER (PARTITION BY region) AS em, {lat_sql()} AS la FROM cells c),
b AS (SELECT region, row // 16 AS row, col // 16 AS col, la, elevation, em, CASE WHEN la < -89 THEN 0.05 WHEN la > -85 THEN 0.7 ELSE 0.5 END AS v0 FROM m WHERE row % 16 = 0 AND col % 16 = 0),
r AS (SELECT *, CASE WHEN elevation > em + 500 THEN greatest(0, least(1, v0 + 0.2)) ELSE v0 END AS v1 FROM b),
s AS (SELECT *, CASE WHEN elevation < em - 1000 THEN greatest(0, least(1, v1 - 0.3)) ELSE v1 END AS v2 FROM r),
k AS (SELECT region, row, col, CASE WHEN la < -88 THEN v2 * 0.6 ELSE v2 END::DOUBLE AS v FROM s),
f AS (SELECT region, row, col, elevation, row * 3 / 63.0::DOUBLE AS rf, col * 3 / 63.0::DOUBLE AS cf FROM cells)
SELECT f.region, f.row, f.col, CASE WHEN any_value(f.elevation) IS NULL THEN 0 ELSE round(sum(v * w) / sum(w), 6) END AS sunlight
FROM (SELECT f.*, floor(rf) + dr AS rr, floor(cf) + dc AS cc, CASE dr WHEN 1 THEN rf - floor(rf) ELSE 1 - (rf - floor(rf)) END
  * CASE dc WHEN 1 THEN cf - floor(cf) ELSE 1 - (cf - floor(cf)) END AS w FROM f, range(2) a(dr), range(2) b(dc)) f
JOIN k ON k.region = f.region AND k.row = f.rr AND k.col = f.cc GROUP BY 1, 2, 3""", ["cells"])
def estimate_sunlight(ws):
    return sunlight.estimate_sunlight(ws.cells, 16, True).select("region", "row", "col", r("sunlight", 6))


# --- least-cost routes -----------------------------------------------------------------------------------------------

cte("costs", """
SELECT x.mission_id, x.region, x.row, x.col, 600 * exp(slope / 15)
  * CASE WHEN priority > 0 THEN greatest(0.1, least(1, 1 - priority * 0.5 * CASE WHEN len(science_experiments) > 0 THEN science ELSE 0 END)) ELSE 1 END
  * exp(3 * mobility_risk) AS cost
FROM scores x JOIN missions m USING (mission_id, region) WHERE passable AND mobility_risk < 0.85""", ["scores", "missions"])


@query("route_costs", "SELECT mission_id, row, col, round(cost, 4) AS cost FROM costs", ["costs"])
def route_costs(ws):
    return routing.mission_costs(scoring.standing(ws.layers, ws.missions), ws.missions).select("mission_id", "row", "col", r("cost"))


def snap_sql(points: str, cols: str) -> str:
    return f"""
SELECT {cols}, row, col FROM (SELECT {cols}, c.row, c.col, row_number() OVER (PARTITION BY {cols}
    ORDER BY greatest(abs(c.row - p_row), abs(c.col - p_col)), (c.row - p_row) ** 2 + (c.col - p_col) ** 2, c.row - p_row, c.col - p_col) AS k
  FROM {points} p JOIN costs c USING (mission_id, region) WHERE greatest(abs(c.row - p_row), abs(c.col - p_col)) <= 50) WHERE k = 1"""


TR, TC = cell_sql("target_lon", "target_lat")
cte("kept", "SELECT * FROM sites WHERE rank <= greatest(1, n_results)", ["sites"])
cte("user_targets", f"""
SELECT mission_id, region, CAST(round_even({TR}, 0) AS INT) AS row, CAST(round_even({TC}, 0) AS INT) AS col
FROM missions JOIN regions USING (region) WHERE target_lat IS NOT NULL""", ["missions", "regions"])
cte("site_value", """
SELECT mission_id, region, row, col, rank, CASE mission_type WHEN 'water_ice' THEN -lat WHEN 'geological' THEN roughness ELSE elevation END AS v FROM kept""", ["kept"])
cte("wp", """
WITH a AS (SELECT m.mission_id, m.region, a.row, a.col, 0 AS source, a.strength AS v, a.cluster AS tie FROM missions m JOIN anomalies a USING (region)
    WHERE list_contains(a.recommended_for, m.mission_type) AND m.mission_id IN (SELECT mission_id FROM kept)),
b AS (SELECT * FROM a UNION ALL SELECT s.mission_id, s.region, s.row, s.col, 1, s.v, s.rank FROM site_value s
    WHERE NOT EXISTS (SELECT 1 FROM a WHERE a.mission_id = s.mission_id AND a.row = s.row AND a.col = s.col))
SELECT mission_id, region, CAST(row_number() OVER (PARTITION BY mission_id ORDER BY source, v DESC, tie) AS INT) AS waypoint, row, col, source
FROM b QUALIFY row_number() OVER (PARTITION BY mission_id ORDER BY source, v DESC, tie) <= 3""", ["missions", "kept", "site_value", "anomalies"])
cte("attempts", """
SELECT t.mission_id, t.region, t.row AS p_row, t.col AS p_col, t.attempt FROM (
  SELECT mission_id, region, row, col, 0 AS attempt FROM user_targets UNION ALL SELECT mission_id, region, row, col, waypoint FROM wp
  UNION ALL SELECT mission_id, region, row, col, rank + 100 FROM kept WHERE rank BETWEEN 2 AND 5) t
JOIN kept k ON k.mission_id = t.mission_id AND k.rank = 1 AND (k.row <> t.row OR k.col <> t.col)""", ["user_targets", "wp", "kept"])
cte("first_sites", "SELECT mission_id, region, row AS p_row, col AS p_col FROM kept WHERE rank = 1", ["kept"])
cte("starts", snap_sql("first_sites", "mission_id, region"), ["first_sites", "costs"])
cte("tries", snap_sql("attempts", "mission_id, region, attempt"), ["attempts", "costs"])
MOVES_SQL = "(SELECT dr, dc, CASE WHEN dr <> 0 AND dc <> 0 THEN sqrt(2.0::DOUBLE) ELSE 1 END AS f FROM range(-1, 2) a(dr), range(-1, 2) b(dc) WHERE dr <> 0 OR dc <> 0)"
cte("reach", f"""
SELECT mission_id, row, col, 0.0::DOUBLE AS g FROM starts
UNION ALL
SELECT t.mission_id, t.row, t.col, min(s.g + t.cost * o.f) AS g FROM reach s, {MOVES_SQL} o, costs t
WHERE t.mission_id = s.mission_id AND t.row = s.row + o.dr AND t.col = s.col + o.dc
  AND s.g + t.cost * o.f < coalesce((SELECT r.g FROM recurring.reach r WHERE r.mission_id = t.mission_id AND r.row = t.row AND r.col = t.col), 1e300)
GROUP BY ALL""", ["starts", "costs"], head="reach(mission_id, row, col, g) USING KEY (mission_id, row, col)")
cte("chosen", """
SELECT t.mission_id, t.region, t.row, t.col, t.attempt, r.g FROM tries t JOIN reach r USING (mission_id, row, col)
QUALIFY row_number() OVER (PARTITION BY t.mission_id ORDER BY t.attempt) = 1""", ["tries", "reach"])


@query("waypoints", "SELECT mission_id, waypoint, row, col, source FROM wp", ["wp"])
def waypoints(ws):
    return ws.waypoints.select("mission_id", "waypoint", "row", "col", "source")


@query("goal_attempts", "SELECT mission_id, attempt, p_row, p_col FROM attempts", ["attempts"])
def goal_attempts(ws):
    return ws.attempts.select("mission_id", "attempt", F.col("row").alias("p_row"), F.col("col").alias("p_col"))


@query("route_least_cost", """
SELECT t.mission_id, t.attempt, t.row, t.col, round(r.g, 3) AS g, r.g IS NOT NULL AS reachable FROM tries t LEFT JOIN reach r USING (mission_id, row, col)""",
       ["tries", "reach"])
def route_least_cost(ws):
    at = ws.tries.join(ws.reach, ["mission_id", "region", "row", "col"], "left")
    return at.select("mission_id", "attempt", "row", "col", r("g", 3), F.col("g").isNotNull().alias("reachable"))


@query("route_chosen_goal", "SELECT mission_id, attempt, row, col, round(g, 3) AS g FROM chosen", ["chosen"])
def route_chosen_goal(ws):
    return ws.chosen.select("mission_id", "attempt", "row", "col", r("g", 3))


cte("back", f"""
SELECT t.mission_id, t.row, t.col, arg_min(struct_pack(r := s.row, c := s.col), s.g + t.cost * o.f) AS p
FROM costs t, {MOVES_SQL} o, reach s
WHERE s.mission_id = t.mission_id AND s.row = t.row - o.dr AND s.col = t.col - o.dc
  AND NOT EXISTS (SELECT 1 FROM starts z WHERE z.mission_id = t.mission_id AND z.row = t.row AND z.col = t.col)
GROUP BY ALL""", ["costs", "reach", "starts"])
cte("walked", """
SELECT mission_id, row, col, 0 AS k FROM chosen
UNION ALL SELECT w.mission_id, b.p.r, b.p.c, w.k + 1 FROM walked w JOIN back b ON b.mission_id = w.mission_id AND b.row = w.row AND b.col = w.col""",
    ["chosen", "back"], head="walked(mission_id, row, col, k)")
cte("planned", """
SELECT w.mission_id, m.region, CAST(max(k) OVER (PARTITION BY w.mission_id) - k AS INT) AS step, w.row, w.col
FROM walked w JOIN missions m USING (mission_id)""", ["walked", "missions"])


@query("route_steps", "SELECT mission_id, step, row, col FROM planned", ["planned"])
def route_steps(ws):
    return ws.planned.select("mission_id", "step", "row", "col")


cte("plan_legs", """
SELECT s.*, c.slope, c.elevation, c.psr, c.quality, c.ldsm_err, c.illumination, c.mobility_risk, m.speed_kmh, m.battery_wh, m.power_source,
  m.solar_panel_w, m.mission_day, lag(s.row) OVER w AS p_row, lag(s.col) OVER w AS p_col, lag(c.elevation) OVER w AS p_elevation
FROM planned s JOIN missions m USING (mission_id, region)
JOIN (SELECT d.region, d.row, d.col, d.slope, d.elevation, d.psr, d.quality, d.ldsm_err, d.illumination, x.mission_id, x.mobility_risk
  FROM scores x JOIN decoded2 d USING (region, row, col)) c USING (mission_id, region, row, col)
WINDOW w AS (PARTITION BY s.mission_id ORDER BY s.step)""", ["planned", "missions", "scores", "decoded2"])
cte("plan_stats0", stats_sql("plan_legs", "mission_id"), ["plan_legs"])
cte("plan_energy0", energy_sql("plan_legs", "mission_id"), ["plan_legs"])
cte("plan_soft0", soft_sql("plan_legs", "mission_id"), ["plan_legs"])
cte("plan_stats", """
SELECT m.mission_id, m.region, p.mission_id IS NOT NULL AS has_route, coalesce(total_distance_m / 1000, 0) AS km,
  coalesce(p.max_slope_deg, 0) AS max_slope, coalesce(p.mean_slope_deg, 0) AS mean_slope, coalesce(total_distance_m / 1000 / speed, 0) AS hours,
  coalesce(waypoint_count, 0) AS cells, coalesce(round(total, 4), 0) AS wh, coalesce(round(total / battery * 100, 4), 0) AS pct,
  coalesce(round(100 * high, 1), 0) AS soft_pct, coalesce(top > 0.7, false) AS soft_warning
FROM missions m LEFT JOIN plan_stats0 p USING (mission_id) LEFT JOIN plan_energy0 e USING (mission_id) LEFT JOIN plan_soft0 USING (mission_id)""",
    ["missions", "plan_stats0", "plan_energy0", "plan_soft0"])


@query("route_stats", """
SELECT mission_id, has_route, round(km, 4) AS km, round(max_slope, 4) AS max_slope, round(hours, 4) AS hours, cells, wh, pct,
  CASE WHEN pct < 40 THEN 'LOW' WHEN pct < 75 THEN 'MODERATE' ELSE 'HIGH' END AS energy_risk, pct <= 100 AS battery_feasible, soft_pct, soft_warning
FROM plan_stats""", ["plan_stats"])
def route_stats(ws):
    return ws.route_stats.select(
        "mission_id", "has_route", F.round("total_distance_km", 4).alias("km"), F.round("max_slope_deg", 4).alias("max_slope"),
        F.round("estimated_time_hrs", 4).alias("hours"), F.col("waypoint_count").alias("cells"), F.col("total_energy_wh").alias("wh"),
        F.col("battery_pct_used").alias("pct"), "energy_risk", "battery_feasible", F.col("soft_terrain_pct").alias("soft_pct"),
        F.col("soft_terrain_warning").alias("soft_warning"))
