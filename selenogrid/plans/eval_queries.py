"""Layer statistics, quantiles, percentiles, stability, invariants and verdicts."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from selenogrid.operators import classify, craters, evaluate, quantiles, scoring, sites
from selenogrid.plans.grid_queries import craters as crater_points
from selenogrid.plans.registry import cte, query
from selenogrid.plans.score_steps import score_steps
from selenogrid.plans.site_queries import SEP, greedy_sql, landmarks
from selenogrid.plans.steps import box_sql
from selenogrid.session import work_folder, write_table
from selenogrid.sources import ingest


def r(name, digits=6):
    return F.round(name, digits).alias(name)


STAT_LAYERS = ["elevation", "slope", "roughness", "illumination"]


@query("layer_statistics", " UNION ALL ".join(f"""
SELECT region, '{n}' AS layer, count({n}) AS n, round(100.0 * (count(*) - count({n})) / count(*), 6) AS nodata_pct, round(min({n}), 6) AS lo,
  round(max({n}), 6) AS hi, round(avg({n}), 6) AS mean FROM terrain GROUP BY region""" for n in STAT_LAYERS), ["terrain"])
def layer_statistics(ws):
    return evaluate.layer_statistics(ws.terrain, STAT_LAYERS).select("region", "layer", "n", r("nodata_pct"), r("lo"), r("hi"), r("mean"))


PROBS = [0.02, 0.05, 0.15, 0.3, 0.5, 0.7, 0.95, 0.98]
QSQL = "SELECT region, " + ", ".join(
    f"round(quantile_cont({n}, {p}), 6) AS {quantiles.quantile_name(n, p)}" for n in ("elevation", "slope") for p in PROBS) + " FROM terrain GROUP BY region"


def _spec():
    return {n: (F.col(n), PROBS) for n in ("elevation", "slope")}


@query("quantiles", QSQL, ["terrain"])
def quantiles_builtin(ws):
    out = quantiles.quantiles(ws.terrain, _spec())
    return out.select("region", *[r(c) for c in out.columns if c != "region"])


@query("quantiles_by_selection", QSQL, ["terrain"])
def quantiles_by_selection(ws):
    """The same where only the rows between the bounds of each rank are put in order, at whatever size."""
    out = quantiles.quantiles(ws.terrain, _spec(), accuracy=20)
    return out.select("region", *[r(c) for c in out.columns if c != "region"])


cte("marks_at", """
SELECT l.landmark, l.inside, s.mission_id, s.region, s.row, s.col, s.safety, s.mission, s.final, s.slope, s.roughness, s.illumination, s.psr, s.science
FROM landmark_cells l JOIN scores s ON s.region = l.region AND s.row = l.p_row AND s.col = l.p_col""", ["landmark_cells", "scores"])
cte("pct", """
SELECT m.landmark, m.mission_id, 100 * avg(CASE WHEN s.final <= m.final THEN 1.0 ELSE 0.0 END) AS p FROM marks_at m
JOIN scores s ON s.mission_id = m.mission_id AND s.final > 0 GROUP BY ALL""", ["marks_at", "scores"])
cte("p70", "SELECT mission_id, quantile_cont(final, 0.7) AS p70 FROM scores WHERE final > 0 GROUP BY 1", ["scores"])


def marks_at(ws, alone=False):
    """Scores at the landmarks' cells; ``alone`` where no other cell's score is wanted, so none is computed."""
    at = landmarks(ws).select("landmark", "inside", "region", F.col("p_row").alias("row"), F.col("p_col").alias("col"))
    scores = scoring.score_terrain(ws.layers, ws.missions, ws.radii, only=at) if alone else ws.scores
    extra = ws.decoded.select("region", "row", "col", "illumination", "psr")
    keep = scores.select("mission_id", "region", "row", "col", "safety", "mission", "final", "slope", "roughness", "science")
    return at.join(keep, ["region", "row", "col"]).join(extra, ["region", "row", "col"])


@query("landmark_percentile", """
SELECT m.landmark, m.mission_id, round(p, 4) AS percentile, final >= p70 AS in_top30 FROM marks_at m JOIN pct USING (landmark, mission_id) JOIN p70 USING (mission_id)""",
       ["marks_at", "pct", "p70"])
def landmark_percentile(ws):
    population = ws.scores.filter("final > 0")
    out = evaluate.percentile_of_score(marks_at(ws), population, "final", ["mission_id"], ["landmark"])
    top = quantiles.quantiles(population, {"final": (F.col("final"), [0.7])}, by=["mission_id"])
    return out.join(top, "mission_id").select("landmark", "mission_id", r("percentile", 4), (F.col("_s") >= F.col("final_p70")).alias("in_top30"))


@query("percentile_populations", """
WITH u AS (SELECT mission_id, row, col, 'safety' AS pop, mission FROM scores WHERE safety > 0 UNION ALL
  SELECT x.mission_id, row, col, 'slope', x.mission FROM scores x JOIN missions USING (mission_id, region) WHERE slope < max_slope_deg)
SELECT s.mission_id, s.rank, pop, round(100 * avg(CASE WHEN u.mission <= s.mission THEN 1.0 ELSE 0.0 END), 4) AS percentile
FROM sites s JOIN u USING (mission_id) GROUP BY ALL""", ["scores", "missions", "sites"])
def percentile_populations(ws):
    safe = ws.scores.filter("safety > 0").withColumn("pop", F.lit("safety"))
    gentle = ws.scores.join(ws.missions.select("mission_id", "max_slope_deg"), "mission_id").filter("slope < max_slope_deg").drop("max_slope_deg").withColumn("pop", F.lit("slope"))
    pts = ws.sites.select("mission_id", "rank", "mission")
    both = safe.select("mission_id", "pop", "mission").unionByName(gentle.select("mission_id", "pop", "mission"))
    pts = pts.withColumn("pop", F.explode(F.array(F.lit("safety"), F.lit("slope"))))
    out = evaluate.percentile_of_score(pts, both, "mission", ["mission_id", "pop"], ["rank"])
    return out.select("mission_id", "rank", "pop", r("percentile", 4))


@query("inside_outside_shadow", """
SELECT mission_id, round(avg(CASE WHEN psr >= 0.5 THEN final END), 6) AS mean_inside, round(avg(CASE WHEN NOT psr >= 0.5 THEN final END), 6) AS mean_outside,
  round(max(CASE WHEN psr >= 0.5 THEN final END), 6) AS max_inside, round(avg(CASE WHEN psr >= 0.5 THEN CASE WHEN final > 0 THEN 1.0 ELSE 0.0 END END), 6) AS positive_inside,
  round(avg(CASE WHEN NOT psr >= 0.5 THEN final END) - avg(CASE WHEN psr >= 0.5 THEN final END), 6) AS difference FROM scores GROUP BY 1""", ["scores"])
def inside_outside_shadow(ws):
    work = ws.scores.join(ws.decoded.select("region", "row", "col", "psr"), ["region", "row", "col"])
    out = evaluate.inside_outside(work, F.col("psr") >= 0.5, "final", ["mission_id"])
    return out.select("mission_id", *[r(c) for c in out.columns if c != "mission_id"])


@query("terrain_plausibility", """
SELECT region, round(min(elevation), 6) AS lo, round(max(elevation), 6) AS hi, round(avg(CASE WHEN slope IS NOT NULL THEN CASE WHEN slope < 35 THEN 1.0 ELSE 0.0 END END), 6) AS share_below_35,
  round((count(*) - count(elevation)) / count(*), 6) AS nodata_share, round(corr(slope, roughness), 6) AS slope_rough_corr,
  CAST(sum(CASE WHEN slope < 0 THEN 1 WHEN slope >= 0 THEN 0 END) AS BIGINT) AS negative_slopes FROM terrain GROUP BY 1""", ["terrain"])
def terrain_plausibility(ws):
    out = evaluate.plausibility(ws.terrain)
    return out.select("region", *[r(c) for c in ("lo", "hi", "share_below_35", "nodata_share", "slope_rough_corr")], "negative_slopes")


COVER = {"illumination": False, "psr": True, "earth_visibility": False, "sky_visibility": False}


@query("layer_coverage", " UNION ALL ".join(f"""
SELECT region, '{n}' AS layer, round(count({n}) / count(*), 6) AS valid, round(avg(CASE WHEN {n} IS NOT NULL THEN CASE WHEN {n} BETWEEN 0 AND 1 THEN 1.0 ELSE 0.0 END END), 6) AS in_range,
  {"round(avg(CASE WHEN psr IN (0, 1) THEN 0.0 ELSE 1.0 END), 6)" if m else "CAST(NULL AS DOUBLE)"} AS between_ FROM decoded2 GROUP BY region""" for n, m in COVER.items()), ["decoded2"])
def layer_coverage(ws):
    return evaluate.layer_coverage(ws.decoded, COVER).select("region", "layer", r("valid"), r("in_range"), F.round("between", 6).alias("between_"))


@query("score_invariants", """
SELECT mission_id, round(min(safety), 6) AS safety_lo, round(min(mission), 6) AS mission_lo, round(min(final), 6) AS final_lo, round(max(safety), 6) AS safety_hi,
  round(max(mission), 6) AS mission_hi, round(max(final), 6) AS final_hi, round(stddev_pop(final), 6) AS final_spread,
  CAST(sum(CASE WHEN NOT passable AND safety <> 0 THEN 1 ELSE 0 END) AS BIGINT) AS impassable_nonzero,
  CAST(sum(CASE WHEN safety = 0 AND final <> 0 THEN 1 ELSE 0 END) AS BIGINT) AS gate_broken, CAST(sum(CASE WHEN passable THEN 1 ELSE 0 END) AS BIGINT) AS n_passable
FROM scores GROUP BY 1""", ["scores"])
def score_invariants(ws):
    out = evaluate.score_invariants(ws.scores, ["mission_id"])
    whole = {"mission_id", "impassable_nonzero", "gate_broken", "n_passable"}
    return out.select(*[c if c in whole else r(c) for c in out.columns])


# --- weight sensitivity: one rover for every region ------------------------------------------------------------------

cte("missions_one", """
SELECT region, 'one/' || region AS mission_id, 'water_ice' AS mission_type, 'rtg' AS power_source, 'rim' AS psr_intent, 15.0::DOUBLE AS max_slope_deg,
  0.3::DOUBLE AS priority, 0.25::DOUBLE AS wheel_radius_m, 0.2::DOUBLE AS wheel_width_m, 150.0::DOUBLE AS rover_mass_kg, 6 AS n_wheels, 1 AS flat_px,
  CAST([] AS VARCHAR[]) AS science_experiments FROM regions""", ["regions"])
cte("limits_one", "SELECT DISTINCT region, max_slope_deg FROM missions_one", ["missions_one"])
score_steps("", True, mobility=False, name="scores_one", m="_one")
cte("variants", "SELECT * FROM (VALUES " + ", ".join(
    f"('{n}', {', '.join(f'{x}::DOUBLE' for x in w)})" for n, w in evaluate.WEIGHT_VARIANTS.items()) + ") v(variant, ws, wr, wq, wf, wp)")
cte("varied", """
SELECT *, CASE WHEN safety = 0 THEN 0 ELSE 0.7 * safety + 0.3 * mission END AS final
FROM (SELECT mission_id, region, variant, row, col, height, width, passable, mission, CASE WHEN passable
  THEN (ws * slope_sub + wr * rough_sub + wq * qual_sub + wf * flat_sub + wp * prom_sub) * rim_mult ELSE 0 END AS safety FROM scores_one, variants)""",
    ["scores_one", "variants"])
cte("varied_peaks", box_sql("varied", SEP, {"top": ("max", "final")}, by="region, variant"), ["varied"])
cte("varied_cands", "SELECT region, variant, row, col, final FROM varied JOIN varied_peaks USING (region, variant, row, col) WHERE final = top AND final > 0",
    ["varied", "varied_peaks"])
cte("varied_sites", greedy_sql("varied_cands", "region, variant"), ["varied_cands"])
cte("varied_rank", """
SELECT region, variant, row, col, rank() OVER w + (count(*) OVER (PARTITION BY region, variant, safety) - 1) / 2.0 AS rk FROM varied WHERE passable
WINDOW w AS (PARTITION BY region, variant ORDER BY safety)""", ["varied"])
cte("overlap", f"""
SELECT b.region, v.variant, count(DISTINCT CASE WHEN (b.row - v.row) ** 2 + (b.col - v.col) ** 2 < {SEP * SEP} THEN b.rank END) AS overlap
FROM varied_sites b JOIN varied_sites v ON b.region = v.region AND v.variant <> 'BASELINE' WHERE b.variant = 'BASELINE' GROUP BY ALL""", ["varied_sites"])
cte("rho", """
SELECT b.region, v.variant, corr(b.rk, v.rk) AS rho FROM varied_rank b JOIN varied_rank v USING (region, row, col)
WHERE b.variant = 'BASELINE' AND v.variant <> 'BASELINE' GROUP BY ALL""", ["varied_rank"])


@query("weight_overlap", "SELECT region, variant, overlap FROM overlap", ["overlap"])
def weight_overlap(ws):
    found = sites.spaced_top(sites.candidates(ws.varied, ["region", "variant"], "final", SEP), ["region", "variant"], "final", 10, SEP)
    return evaluate.stability_overlap(found, "variant", "BASELINE", ["region"], SEP)


@query("weight_rank_correlation", "SELECT region, variant, round(rho, 6) AS rho FROM rho", ["rho"])
def weight_rank_correlation(ws):
    return ws.rank_correlation.select("region", "variant", F.round("spearman", 6).alias("rho"))


@query("weight_sensitivity", """
SELECT region, round(avg(overlap), 4) AS mean_overlap, round(avg(rho), 6) AS mean_rho, CASE WHEN avg(overlap) >= 8 AND avg(rho) >= 0.92 THEN 'PASS'
  WHEN avg(overlap) >= 6 AND avg(rho) >= 0.8 THEN 'WARN' ELSE 'FAIL' END AS verdict FROM overlap JOIN rho USING (region, variant) GROUP BY 1""", ["overlap", "rho"])
def weight_sensitivity(ws):
    both = weight_overlap(ws).join(ws.rank_correlation, ["region", "variant"])
    out = both.groupBy("region").agg(F.avg("overlap").alias("o"), F.avg("spearman").alias("s"))
    return out.select("region", F.round("o", 4).alias("mean_overlap"), F.round("s", 6).alias("mean_rho"),
                      evaluate.sensitivity_verdict(F.col("o"), F.col("s")).alias("verdict"))


# --- checks and verdicts ---------------------------------------------------------------------------------------------

cte("combo", """
SELECT s.mission_id, s.region, s.mission_type, s.power_source, m.psr_intent, max(CASE WHEN rank = 1 THEN s.mission END) AS m1, max(CASE WHEN rank = 1 THEN s.final END) AS f1, max(CASE WHEN rank = 1 THEN s.psr END) AS p1,
  sum(CASE WHEN psr >= 0.5 THEN 1 ELSE 0 END) AS dark, min(CASE WHEN rank <= 3 THEN coalesce(shadow_m, 1e9) END) AS near, avg(CASE WHEN rank <= 3 THEN illumination END) AS lit,
  avg(CASE WHEN rank <= 3 THEN s.mission END) AS m3, avg(CASE WHEN rank <= 3 THEN s.elevation END) AS e3, any_value(f.e50) AS e50
FROM sites s JOIN missions m USING (mission_id, region) JOIN facts f USING (region) GROUP BY ALL""", ["sites", "missions", "facts"])
cte("combo_checks", """
SELECT mission_id, 'mission score positive' AS "check", CASE WHEN m1 > 0 THEN 'PASS' ELSE 'FAIL' END AS result FROM combo WHERE mission_type = 'water_ice' AND psr_intent = 'enter'
UNION ALL SELECT mission_id, 'shadow site not zeroed', CASE WHEN f1 > 0 THEN 'PASS' ELSE 'FAIL' END FROM combo WHERE mission_type = 'water_ice' AND psr_intent = 'enter' AND power_source = 'rtg' AND p1 >= 0.5
UNION ALL SELECT mission_id, 'final score positive', CASE WHEN f1 > 0 THEN 'PASS' ELSE 'FAIL' END FROM combo WHERE mission_type = 'water_ice'
UNION ALL SELECT mission_id, 'near shadow', CASE WHEN near <= 5000 THEN 'PASS' ELSE 'FAIL' END FROM combo WHERE mission_type = 'water_ice' AND psr_intent = 'rim' AND power_source = 'rtg'
UNION ALL SELECT mission_id, 'no solar site in shadow', CASE WHEN dark = 0 THEN 'PASS' ELSE 'FAIL' END FROM combo WHERE power_source = 'solar'
UNION ALL SELECT mission_id, 'top three lit', CASE WHEN lit > CASE mission_type WHEN 'geological' THEN 0.35 ELSE 0.4 END THEN 'PASS' ELSE 'FAIL' END FROM combo WHERE power_source = 'solar' AND psr_intent = 'avoid'
UNION ALL SELECT mission_id, 'geological diversity', CASE WHEN m3 > 0.6 THEN 'PASS' ELSE 'FAIL' END FROM combo WHERE mission_type = 'geological'
UNION ALL SELECT mission_id, 'above median elevation', CASE WHEN e3 > e50 THEN 'PASS' ELSE 'FAIL' END FROM combo WHERE mission_type = 'atmospheric'""", ["combo"])


@query("combination_checks", 'SELECT mission_id, "check", result FROM combo_checks', ["combo_checks"])
def combination_checks(ws):
    return ws.combination_checks.select("mission_id", "check", "result")


@query("combination_verdicts", """
SELECT mission_id, count(*) AS n, CAST(sum(CASE WHEN result = 'PASS' THEN 1 ELSE 0 END) AS BIGINT) AS n_pass,
  CASE WHEN count(*) = sum(CASE WHEN result = 'PASS' THEN 1 ELSE 0 END) THEN 'PASS'
    WHEN sum(CASE WHEN result = 'PASS' THEN 1 ELSE 0 END) >= greatest(count(*) // 2, 1) THEN 'WARN' ELSE 'FAIL' END AS verdict FROM combo_checks GROUP BY 1""", ["combo_checks"])
def combination_verdicts(ws):
    return evaluate.verdict(ws.combination_checks, ["mission_id"]).select("mission_id", "n", "n_pass", "verdict")


@query("suite_counts", 'SELECT "check", result, count(*) AS n FROM combo_checks GROUP BY 1, 2', ["combo_checks"])
def suite_counts(ws):
    return ws.combination_checks.groupBy("check", "result").agg(F.count(F.lit(1)).alias("n"))


@query("read_result_files", """
SELECT mission_id, count(*) AS n, CAST(sum(CASE WHEN result = 'PASS' THEN 1 ELSE 0 END) AS BIGINT) AS n_pass FROM combo_checks GROUP BY 1""", ["combo_checks"])
def read_result_files(ws):
    """Result files written by mission, read back with a fixed schema."""
    path = f"{work_folder(ws.spark)}/selenogrid/results-json-{uuid.uuid4().hex[:12]}"
    ingest.write_by_mission(ws.combination_checks.select("mission_id", "check", "result"), path, "json")
    back = ws.spark.read.schema("mission_id STRING, check STRING, result STRING, bucket INT").json(path)
    return back.groupBy("mission_id").agg(F.count(F.lit(1)).alias("n"), F.sum((F.col("result") == "PASS").cast("int")).alias("n_pass"))


@query("coverage_verdicts", """
SELECT landmark, mission_id, CASE WHEN NOT m.inside THEN CASE WHEN d_km < 500 THEN 'COVERAGE_BOUNDARY_MODERATE' ELSE 'COVERAGE_BOUNDARY_WEAK' END
  WHEN d_km < 200 AND final > 0.5 THEN 'STRONG' WHEN d_km < 500 AND final > 0.3 THEN 'MODERATE' WHEN final > 0.2 THEN 'WEAK' ELSE 'NOT_VALIDATED' END AS verdict
FROM marks_at m JOIN near_site n USING (landmark, mission_id)""", ["marks_at", "near_site"])
def coverage_verdicts(ws):
    from selenogrid.operators.proximity import nearest_site

    near = nearest_site(landmarks(ws), ws.sites, ["landmark", "mission_id"])
    return marks_at(ws).join(near, ["landmark", "mission_id"]).select(
        "landmark", "mission_id", evaluate.coverage_verdict(F.col("final"), F.col("distance_km"), F.col("inside")).alias("verdict"))


@query("traverse_verdicts", """
WITH p AS (SELECT s.mission_id, s.has_route, s.km, c.row, c.col, m.region, CASE WHEN n_results % 3 = 0 THEN NULL ELSE 5.0 * n_results END AS published,
  CASE n_results % 2 WHEN 0 THEN 0.3 ELSE 0.9 END AS tol, n_results % 4 <> 1 AS req FROM plan_stats s JOIN missions m USING (mission_id) LEFT JOIN chosen c USING (mission_id)),
q AS (SELECT p.*, d.psr FROM p LEFT JOIN decoded2 d ON d.region = p.region AND d.row = p.row AND d.col = p.col),
f AS (SELECT *, CASE WHEN published > 0 AND has_route THEN abs(km - published) / published <= tol END AS d_ok, CASE WHEN req THEN coalesce(psr >= 0.7, false) END AS s_ok FROM q)
SELECT mission_id, d_ok AS distance_ok, s_ok AS shadow_ok, CASE WHEN published IS NULL THEN coalesce(s_ok, false) WHEN NOT req THEN coalesce(d_ok, false)
  ELSE coalesce(d_ok, false) AND coalesce(s_ok, false) END AS validated FROM f""", ["plan_stats", "missions", "chosen", "decoded2"])
def traverse_verdicts(ws):
    n = F.col("n_results")
    at = ws.chosen.join(ws.decoded.select("region", "row", "col", "psr"), ["region", "row", "col"]).select("mission_id", "psr")
    work = ws.route_stats.join(ws.missions.select("mission_id", "n_results"), "mission_id").join(at, "mission_id", "left").select(
        "mission_id", F.when(F.col("has_route"), F.col("total_distance_km")).alias("km"), "psr",
        F.when(n % 3 != 0, 5.0 * n).alias("published"), F.when(n % 2 == 0, 0.3).otherwise(0.9).alias("tol"), (n % 4 != 1).alias("req"))
    flags = evaluate.traverse_verdicts(*[F.col(c) for c in ("km", "published", "tol", "psr", "req")])
    return work.select("mission_id", *[v.alias(k) for k, v in flags.items()])


@query("landmark_checks", """
SELECT landmark, mission_id, CASE WHEN slope <= 12 THEN 'PASS' ELSE 'FAIL' END AS slope_check, CASE WHEN roughness <= 5 THEN 'PASS' ELSE 'FAIL' END AS rough_check,
  CASE WHEN illumination > 0.1 THEN 'PASS' ELSE 'FAIL' END AS lit_check, CASE WHEN psr < 0.5 THEN 'PASS' ELSE 'FAIL' END AS dark_check,
  CASE WHEN p >= 50 THEN 'PASS' ELSE 'FAIL' END AS pct_check,
  CASE WHEN slope <= 12 AND roughness <= 5 AND illumination > 0.1 AND psr < 0.5 AND p >= 50 THEN 'PASS'
    WHEN (CASE WHEN slope <= 12 THEN 1 ELSE 0 END + CASE WHEN roughness <= 5 THEN 1 ELSE 0 END + CASE WHEN illumination > 0.1 THEN 1 ELSE 0 END
      + CASE WHEN psr < 0.5 THEN 1 ELSE 0 END + CASE WHEN p >= 50 THEN 1 ELSE 0 END) >= 2 THEN 'WARN' ELSE 'FAIL' END AS verdict
FROM marks_at m JOIN pct USING (landmark, mission_id)""", ["marks_at", "pct"])
def landmark_checks(ws):
    pct = evaluate.percentile_of_score(marks_at(ws), ws.scores.filter("final > 0"), "final", ["mission_id"], ["landmark"]).drop("_s")
    work = marks_at(ws).join(pct, ["landmark", "mission_id"])
    key = ["landmark", "mission_id"]
    names = {"slope": ("slope_check", F.col("slope") <= 12.0, F.col("slope"), "<= 12"), "roughness": ("rough_check", F.col("roughness") <= 5.0, F.col("roughness"), "<= 5"),
             "illumination": ("lit_check", F.col("illumination") > 0.1, F.col("illumination"), "> 0.1"), "shadow": ("dark_check", F.col("psr") < 0.5, F.col("psr"), "< 0.5"),
             "percentile": ("pct_check", F.col("percentile") >= 50.0, F.col("percentile"), ">= 50")}
    long = evaluate.checks_long(work, key, [evaluate.check(n, ok, v, want) for n, (_, ok, v, want) in names.items()])
    wide = long.groupBy(*key).agg(*[F.max(F.when(F.col("check") == n, F.col("result"))).alias(c) for n, (c, *_) in names.items()])
    return wide.join(evaluate.verdict(long, key).select(*key, "verdict"), key)


@query("ice_site_checks", """
WITH u AS (SELECT x.mission_id, x.mission FROM scores x JOIN missions m USING (mission_id, region) WHERE x.slope < m.max_slope_deg),
p AS (SELECT m.landmark, m.mission_id, 100 * avg(CASE WHEN u.mission <= m.mission THEN 1.0 ELSE 0.0 END) AS pct FROM marks_at m JOIN u USING (mission_id) GROUP BY ALL),
c AS (SELECT m.landmark, m.mission_id, coalesce(m.psr >= 0.5, false) AS dark, coalesce(pct >= 50, false) AS ranked,
  coalesce(0.6 * (1 - coalesce(l.coltemp, 1)) + 0.4 * (0.6 * prox + 0.4 * lat_score), 0) >= 0.3 AS volatile
  FROM marks_at m LEFT JOIN p USING (landmark, mission_id) JOIN layers l ON l.region = m.region AND l.row = m.row AND l.col = m.col)
SELECT landmark, mission_id, CASE WHEN dark THEN 'PASS' ELSE 'FAIL' END AS shadow_check, CASE WHEN ranked THEN 'PASS' ELSE 'FAIL' END AS mission_check,
  CASE WHEN volatile THEN 'PASS' ELSE 'FAIL' END AS volatile_check, CASE WHEN dark AND ranked THEN 'both' WHEN dark OR ranked THEN 'one' ELSE 'none' END AS verdict FROM c""",
       ["marks_at", "scores", "missions", "layers"])
def ice_site_checks(ws):
    """Every landmark held against what is known of an ice site: in shadow, better than half of the gentle terrain, volatiles likely."""
    gentle = ws.scores.join(ws.missions.select("mission_id", "max_slope_deg"), "mission_id").filter("slope < max_slope_deg")
    at = write_table(marks_at(ws), "marks")
    pct = evaluate.percentile_of_score(at, gentle, "mission", ["mission_id"], ["landmark"]).drop("_s")
    volatile = ws.layers.select("region", "row", "col", scoring.science_parts()["volatile_detection"].alias("volatile"))
    work = at.join(pct, ["landmark", "mission_id"], "left").join(volatile, ["region", "row", "col"])
    checks = evaluate.ice_site(F.col("psr"), F.col("percentile"), F.col("volatile"))
    return work.select("landmark", "mission_id", *[v.alias(k) for k, v in checks.items()])


@query("planned_and_actual", """
SELECT a.landmark, a.mission_id, round(sqrt(((a.row - b.row) ** 2 + (a.col - b.col) ** 2)::DOUBLE) * 0.6, 6) AS offset_km, round(a.final - b.final, 6) AS score_gain,
  abs(a.slope - 12) <= 5 AS slope_match FROM marks_at a JOIN marks_at b ON b.mission_id = a.mission_id AND b.landmark = (a.landmark + (SELECT count(*) FROM regions))""", ["marks_at", "regions"])
def planned_and_actual(ws):
    n = ws.regions.count()
    at = write_table(marks_at(ws, alone=True), "marks")
    other = at.select("mission_id", (F.col("landmark") - n).alias("landmark"), F.col("row").alias("b_row"), F.col("col").alias("b_col"), F.col("final").alias("b_final"))
    return at.join(other, ["mission_id", "landmark"]).select(
        "landmark", "mission_id", F.round(F.hypot(F.col("row") - F.col("b_row"), F.col("col") - F.col("b_col")) * 0.6, 6).alias("offset_km"),
        F.round(F.col("final") - F.col("b_final"), 6).alias("score_gain"), (F.abs(F.col("slope") - 12.0) <= 5.0).alias("slope_match"))


@query("with_and_without_layers", """
WITH a AS (SELECT mission_id, CASE WHEN max(final) > 0.8 THEN 'high' WHEN max(final) > 0 THEN 'some' END AS v FROM scores GROUP BY 1),
b AS (SELECT mission_id, CASE WHEN max(final) > 0.8 THEN 'high' WHEN max(final) > 0 THEN 'some' END AS v FROM scores_px GROUP BY 1)
SELECT mission_id, a.v AS with_layers, b.v AS without, a.v IS DISTINCT FROM b.v AS changed FROM a FULL JOIN b USING (mission_id)""", ["scores", "scores_px"])
def with_and_without_layers(ws):
    def level(s):
        top = F.max("final")
        return s.groupBy("mission_id").agg(F.when(top > 0.8, "high").when(top > 0, "some").alias("v"))
    bare = scoring.score_terrain(ws.proxy_layers, ws.missions, ws.radii)
    return evaluate.changed(level(ws.scores), level(bare), ["mission_id"], "v")


@query("set_logic", """
SELECT m.mission_id, EXISTS (SELECT 1 FROM sites s WHERE s.mission_id = m.mission_id) AS has_sites, NOT EXISTS (SELECT 1 FROM chosen c WHERE c.mission_id = m.mission_id) AS no_goal,
  CAST(5 - len(science_experiments) AS INT) AS missing FROM missions m""", ["missions", "sites", "chosen"])
def set_logic(ws):
    ids = ws.missions.select("mission_id")
    sited = ids.join(ws.sites, "mission_id", "left_semi").withColumn("has_sites", F.lit(True))
    lost = ids.join(ws.chosen, "mission_id", "left_anti").withColumn("no_goal", F.lit(True))
    all_exp = F.array(*[F.lit(e) for e in scoring.EXPERIMENTS])
    return ws.missions.join(sited, "mission_id", "left").join(lost, "mission_id", "left").select(
        "mission_id", F.coalesce("has_sites", F.lit(False)).alias("has_sites"), F.coalesce("no_goal", F.lit(False)).alias("no_goal"),
        F.size(F.array_except(all_exp, F.col("science_experiments"))).alias("missing"))


@query("best_and_worst_landmark", """
SELECT mission_id, arg_max(landmark, final * 1e6 + landmark / 1e6) AS best, arg_min(landmark, final * 1e6 + landmark / 1e6) AS worst FROM marks_at GROUP BY 1""", ["marks_at"])
def best_and_worst_landmark(ws):
    return evaluate.best_and_worst(marks_at(ws, alone=True), "landmark", "final", ["mission_id"])


@query("ridge_goals", """
WITH o AS (SELECT * FROM (VALUES (0, -20, 0), (1, 20, 0), (2, 0, -20), (3, 0, 20), (4, -14, 14), (5, 14, -14), (6, -14, -14), (7, 14, 14), (8, -10, 0), (9, 10, 0), (10, 0, -10), (11, 0, 10)) v(attempt, dr, dc))
SELECT s.mission_id, attempt, t.row, t.col FROM sites s, o JOIN terrain t ON t.region = s.region AND t.row = s.row + dr AND t.col = s.col + dc
WHERE s.rank = 1 AND t.slope <= s.max_slope_deg""".replace("FROM sites s, o JOIN terrain t ON", "FROM sites s CROSS JOIN o JOIN terrain t ON"), ["sites", "terrain"])
def ridge_goals(ws):
    starts = ws.sites.filter("rank = 1").join(ws.missions.select("mission_id", "max_slope_deg"), "mission_id")
    return evaluate.ridge_goals(starts, ws.terrain, 0.2)


@query("persist_by_mission", "SELECT mission_id, count(*) AS n, round(sum(final), 6) AS total FROM sites GROUP BY 1", ["sites"])
def persist_by_mission(ws):
    """The results of every mission, written and read back; a reader of one mission opens the folder of its bucket only."""
    path = f"{work_folder(ws.spark)}/selenogrid/sites-by-mission-{uuid.uuid4().hex[:12]}"
    ingest.write_by_mission(ws.sites.drop("reasoning"), path)
    back = ws.spark.read.parquet(path)
    return back.groupBy("mission_id").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("final"), 6).alias("total"))


# --- craters ---------------------------------------------------------------------------------------------------------

GRID = "200 AS height, 200 AS width, 8100.0::DOUBLE AS resolution_m, -810000.0::DOUBLE AS origin_x, 810000.0::DOUBLE AS origin_y"
cte("crater_cells", f"""
WITH p AS (SELECT diam_km, 2 * 1737400.0::DOUBLE * tan(radians(45 + lat / 2)) AS rho, lon FROM craters WHERE lat <= -65 AND diam_km >= 0.1),
k AS (SELECT CAST(floor((810000 - rho * cos(radians(lon))) / 8100) AS INT) AS row, CAST(floor((rho * sin(radians(lon)) + 810000) / 8100) AS INT) AS col, diam_km FROM p)
SELECT i::INT AS row, j::INT AS col, 'south' AS region, 200 AS height, 200 AS width, coalesce(n, 0) AS n_craters, coalesce(area, 0) AS area
FROM range(200) a(i), range(200) b(j) LEFT JOIN (SELECT row, col, count(*) AS n, sum(pi() * (diam_km * 500 / 8100) ** 2) AS area FROM k GROUP BY ALL) c ON c.row = i AND c.col = j""".replace(
    "FROM range(200) a(i), range(200) b(j) LEFT JOIN", "FROM range(200) a(i) CROSS JOIN range(200) b(j) LEFT JOIN"), ["craters"])
cte("crater_smooth", box_sql("crater_cells", 5, {"sm": ("avg", "area")}), ["crater_cells"])


@query("crater_density", """
SELECT row, col, n_craters, round(area, 6) AS area, CAST(floor(least(255, sm / (SELECT max(sm) FROM crater_smooth) * 255 + 1e-9)) AS INT) AS density
FROM crater_cells JOIN crater_smooth USING (region, row, col)""", ["crater_cells", "crater_smooth"])
def crater_density(ws):
    grid = ws.spark.range(1).select(F.lit("south").alias("region"), F.lit(200).alias("height"), F.lit(200).alias("width"), F.lit(8100.0).alias("resolution_m"),
                                    F.lit(-810000.0).alias("origin_x"), F.lit(810000.0).alias("origin_y"))
    return craters.crater_density(crater_points(ws), grid).select("row", "col", "n_craters", r("area"), "density")


# --- classes ---------------------------------------------------------------------------------------------------------

cte("rule_labels", """
SELECT mission_id, region, row, col, CASE WHEN coalesce(slope > 25, false) OR coalesce(roughness > 200, false) THEN 0 WHEN mission > 0.7 AND safety > 0.3 THEN 4 WHEN safety > 0.6 AND final > 0.5 THEN 3
  WHEN safety BETWEEN 0.3 AND 0.6 THEN 2 ELSE 1 END AS cls FROM scores""", ["scores"])


def rule_classes(ws):
    cls = classify.rule_label(*[F.col(c) for c in ("slope", "roughness", "safety", "mission", "final")])
    return ws.scores.select("mission_id", "region", "row", "col", cls.alias("cls"))


@query("rule_labels", "SELECT mission_id, row, col, cls FROM rule_labels", ["rule_labels"])
def rule_labels(ws):
    return rule_classes(ws).select("mission_id", "row", "col", "cls")


@query("class_distribution", """
SELECT mission_id, CAST(c AS INT) AS cls, CAST(sum(CASE WHEN cls = c THEN 1 ELSE 0 END) AS BIGINT) AS n, round(avg(CASE WHEN cls = c THEN 1.0 ELSE 0.0 END), 6) AS share
FROM rule_labels, range(5) t(c) GROUP BY 1, 2""", ["rule_labels"])
def class_distribution(ws):
    return classify.class_distribution(rule_classes(ws), ("mission_id",)).select("mission_id", "cls", "n", r("share"))


FEATS = ", ".join(f"round({c}, 6) AS {c}" for c in classify.FEATURES)
cte("features", """
SELECT region, row, col, coalesce((elevation - e_min) / greatest(e_max - e_min, 1e-6), 0) AS elev_n, coalesce(slope / 90, 0) AS slope_n,
  coalesce(roughness / CASE WHEN r_max > 1e-6 THEN r_max ELSE 1 END, 0) AS rough_n, coalesce(quality, 0) AS quality_n, mean_slope, std_elev, grad_slope, -(lat + 90) / 10 AS lat_n
FROM layers""", ["layers"])


@query("class_features", f"SELECT region, row, col, {FEATS} FROM features", ["features"])
def class_features(ws):
    return classify.features(ws.layers).select("region", "row", "col", *[r(c) for c in classify.FEATURES])


@query("confusion_matrix", "SELECT quality AS truth, toxic AS guess, count(*) AS n FROM labels GROUP BY 1, 2")
def confusion_matrix(ws):
    return classify.confusion(ws.source("labels"), "quality", "toxic")


@query("class_metrics", """
WITH m AS (SELECT quality AS t, toxic AS g, count(*) AS n FROM labels GROUP BY 1, 2)
SELECT c AS cls, round(coalesce(2.0 * sum(CASE WHEN t = c AND g = c THEN n ELSE 0 END) / nullif(sum(CASE WHEN t = c THEN n ELSE 0 END) + sum(CASE WHEN g = c THEN n ELSE 0 END), 0), 0), 6) AS f1,
  CAST(sum(CASE WHEN t = c THEN n ELSE 0 END) AS BIGINT) AS support, round(sum(CASE WHEN t = g THEN n ELSE 0 END) / sum(n), 6) AS accuracy
FROM m, (SELECT t AS c FROM m UNION SELECT g FROM m) GROUP BY 1""")
def class_metrics(ws):
    return classify.metrics(classify.confusion(ws.source("labels"), "quality", "toxic"))


cte("labelled", """
SELECT region, row, col, CASE WHEN coalesce(l.slope > 25, false) OR coalesce(l.roughness > 200, false) THEN 0 WHEN v.mission > 0.7 AND v.safety > 0.3 THEN 4
  WHEN v.safety > 0.6 AND v.final > 0.5 THEN 3 WHEN v.safety BETWEEN 0.3 AND 0.6 THEN 2 ELSE 1 END AS label
FROM varied v JOIN layers l USING (region, row, col) WHERE variant = 'BASELINE'""", ["varied", "layers"])
cte("labelled_places", """
SELECT *, row_number() OVER (PARTITION BY label ORDER BY md5('42|' || region || '|' || row || '|' || col), region, row, col) - 1 AS pos,
  count(*) OVER (PARTITION BY label) AS n, count(*) OVER () AS n_all FROM labelled""", ["labelled"])
cte("labelled_split", """
SELECT region, row, col, label, CASE WHEN pos < floor(n * least(1, 60000 / n_all::DOUBLE) * (50000 / 60000::DOUBLE) + 0.5) THEN 'train'
  WHEN pos < floor(n * least(1, 60000 / n_all::DOUBLE) + 0.5) THEN 'validation' END AS fold FROM labelled_places""", ["labelled_places"])


@query("class_folds", "SELECT region, row, col, label, CAST(pos % 5 AS INT) AS fold FROM labelled_places", ["labelled_places"])
def class_folds(ws):
    """Stratified folds of every labelled cell."""
    return classify.folds(ws.labelled).select("region", "row", "col", "label", F.col("fold").cast("int").alias("fold"))


@query("class_split", "SELECT * FROM labelled_split", ["labelled_split"])
def class_split(ws):
    return classify.stratified(ws.labelled).select("region", "row", "col", "label", "fold")


@query("class_forest", """
SELECT label AS cls, count(*) AS support, true AS accurate FROM labelled_split WHERE fold = 'validation' GROUP BY label""", ["labelled_split"])
def class_forest(ws):
    """Train, save, load, predict, and measure on held-out cells: rows of each class, and whether eight in ten of all are right."""
    path = f"{work_folder(ws.spark)}/selenogrid/forest-{uuid.uuid4().hex[:12]}"
    classify.save(ws.forest, path)
    held = classify.stratified(ws.labelled).filter("fold = 'validation'")
    out = classify.predict(classify.load(ws.spark, path), held)
    found = classify.metrics(classify.confusion(out, "label", "cls")).filter("support > 0")
    return found.select("cls", "support", (F.col("accuracy") >= 0.8).alias("accurate"))


@query("class_every_cell", "SELECT region, count(*) AS n_cells, count(*) AS n_predicted, true AS agrees FROM labelled GROUP BY region", ["labelled"])
def class_every_cell(ws):
    """A class for every cell of every region, and whether eight in ten are the rules' own."""
    right = F.avg((F.col("cls") == F.col("label")).cast("double"))
    return ws.predicted.groupBy("region").agg(F.count(F.lit(1)).alias("n_cells"), F.sum(F.col("cls").between(0, 4).cast("long")).alias("n_predicted"), (right >= 0.8).alias("agrees"))


@query("class_importances", "SELECT CAST(r AS INT) AS rank, true AS is_share FROM range(1, 4) t(r) WHERE EXISTS (SELECT 1 FROM labelled)", ["labelled"])
def class_importances(ws):
    return classify.importances(ws.spark, ws.forest).select("rank", F.col("importance").between(0.0, 1.0).alias("is_share"))


@query("class_cross_validation", """
SELECT CAST(pos % 5 AS INT) AS fold, label AS cls, count(*) AS support, true AS accurate FROM labelled_places GROUP BY ALL""", ["labelled_places"])
def class_cross_validation(ws):
    """Rows of each class in each fold, and whether eight in ten of the fold's rows are right."""
    return ws.fold_metrics.filter("support > 0").select(F.col("fold").cast("int").alias("fold"), "cls", "support", (F.col("accuracy") >= 0.8).alias("accurate"))


@query("class_fold_summary", """
SELECT count(DISTINCT pos % 5) AS n_folds, true AS accurate, true AS steady FROM labelled_places""", ["labelled_places"])
def class_fold_summary(ws):
    return classify.fold_summary(ws.fold_metrics).select("n_folds", (F.col("mean_accuracy") >= 0.8).alias("accurate"), (F.col("deviation") <= 0.05).alias("steady"))
