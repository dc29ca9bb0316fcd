"""Checking SQL for decoded layers, regional facts, layers and scores."""

from __future__ import annotations

from selenogrid.plans import steps  # noqa: F401
from selenogrid.plans.registry import cte
from selenogrid.plans.steps import box_sql, edge_sql
from selenogrid.sources.demo_grid import MISSION_FIELDS


def clip01(e: str) -> str:
    return f"CASE WHEN ({e}) IS NULL THEN NULL ELSE greatest(0, least(1, {e})) END"


P95 = {"minirf_cpr": "raw_cpr", "mas_57m": "raw_mas57", "mas_225m": "raw_mas225", "mas_560m": "raw_mas560",
       "ldsm_err": "raw_err"}
cte("decode_scales", "SELECT region, " + ", ".join(
    f"quantile_cont(CASE WHEN {r} >= 0 THEN {r} END, 0.95) AS q_{n}" for n, r in P95.items()) + """,
  quantile_cont(raw_hurst, 0.02) AS h2, quantile_cont(raw_hurst, 0.98) AS h98 FROM cells GROUP BY region""", ["cells"])
cte("decoded", f"""
SELECT t.* EXCLUDE (raw_dn, raw_illum, raw_psr, raw_earth, raw_sky, raw_coltemp, raw_cpr, raw_mas57, raw_mas225, raw_mas560,
    raw_hurst, raw_err, raw_crater),
  CASE WHEN raw_psr = 20000 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS psr, {clip01("raw_coltemp / 255")} AS coltemp,
  {clip01("raw_crater / 255")} AS crater_density,
  {", ".join(f"{clip01(f'CASE WHEN {r} >= 0 THEN {r} END / greatest(q_{n}, 1e-6)')} AS {n}" for n, r in P95.items())},
  CASE WHEN raw_hurst IS NULL THEN NULL WHEN h98 > h2 THEN greatest(0, least(1, (raw_hurst - h2) / (h98 - h2))) ELSE 0 END
    AS hurst
FROM terrain t JOIN decode_scales USING (region)""", ["terrain", "decode_scales"])
cte("decoded2", f"""
SELECT d.*, {clip01("mas_57m / CASE WHEN mas_225m > 0 THEN mas_225m ELSE 1e-6 END")} AS freshness,
  {clip01("(mas_225m - mas_57m + 1e-6) / ln(225.0::DOUBLE / 57.0::DOUBLE)")} AS spectral_slope,
  -90 + 2 * degrees(atan(sqrt((origin_x + col * resolution_m) ** 2 + (origin_y - row * resolution_m) ** 2)
    / (2 * 1737400.0::DOUBLE))) AS lat
FROM decoded d""", ["decoded"])
cte("facts", """
SELECT region, avg(elevation) AS e_mean, avg(roughness) AS r_mean, avg(slope) AS s_mean, stddev_pop(roughness) AS r_std,
  max(roughness) AS r_max, min(elevation) AS e_min, max(elevation) AS e_max, max(abs(elevation)) AS e_abs,
  max(quality) AS q_max, quantile_cont(elevation, 0.05) AS e5, quantile_cont(elevation, 0.15) AS e15,
  quantile_cont(elevation, 0.5) AS e50, quantile_cont(elevation, 0.95) AS e95, quantile_cont(roughness, 0.95) AS r95,
  quantile_cont(lat, 0.5) AS lat50 FROM decoded2 GROUP BY region""", ["decoded2"])


def layer_steps(x: str, anc: bool) -> None:
    """Layers with ancillary products, or (``anc=False``) the proxies used where a region has none."""
    mask = "coalesce(psr >= 0.5, false)" if anc else "ef <= e15"
    cte(f"input{x}", f"""
    SELECT d.*, f.* EXCLUDE (region), coalesce(elevation, e_mean) AS ef, coalesce(elevation, 0) AS e0,
      coalesce(roughness - r_mean, 0) AS rz, elevation - e_mean AS ec, coalesce(slope, s_mean) AS sf
    FROM decoded2 d JOIN facts f USING (region)""", ["decoded2", "facts"])
    cte(f"mask{x}", f"SELECT region, row, col, {mask} AS in_shadow FROM input{x}", [f"input{x}"])
    cte(f"dist{x}", f"""
    SELECT a.region, a.row, a.col,
      min(sqrt(((a.row - b.row) ** 2 + (a.col - b.col) ** 2)::DOUBLE) * 600) AS d
    FROM mask{x} a JOIN mask{x} b ON a.region = b.region AND b.in_shadow
    GROUP BY ALL""", [f"mask{x}"])
    cte(f"b20{x}", box_sql(f"input{x}", 20, {"m": ("avg", "rz"), "q": ("avg", "rz * rz")}), [f"input{x}"])
    cte(f"b17{x}", box_sql(f"input{x}", 17, {"wall": ("max", "CASE WHEN slope >= 35 THEN 1 ELSE 0 END"),
                                            "top": ("max", "coalesce(elevation, -1e9)")}), [f"input{x}"])
    cte(f"b5{x}", box_sql(f"input{x}", 5, {"m0": ("avg", "e0"), "hi": ("max", "elevation"), "lo": ("min", "elevation")}),
        [f"input{x}"])
    cte(f"b11{x}", box_sql(f"input{x}", 11, {"psi": ("avg", "ef")}), [f"input{x}"])
    cte(f"b25{x}", box_sql(f"input{x}", 25, {"m": ("avg", "ec"), "q": ("avg", "ec * ec")}), [f"input{x}"])
    cte(f"b3{x}", box_sql(f"input{x}", 3, {"s3": ("avg", "slope"), "em": ("avg", "e0"), "eq": ("avg", "e0 * e0")}),
        [f"input{x}"])
    for r in (1, 2, 3):
        cte(f"p{r}{x}", box_sql(f"input{x}", 2 * r + 1, {f"pm{r}": ("avg", "e0")}), [f"input{x}"])
    cte(f"ge{x}", edge_sql(f"input{x}", "ef", "1"), [f"input{x}"])
    cte(f"gs{x}", edge_sql(f"input{x}", "slope", "1"), [f"input{x}"])
    cte(f"gi{x}", edge_sql(f"input{x}", "illumination" if anc else "CAST(NULL AS DOUBLE)", "resolution_m"), [f"input{x}"])
    cte(f"rawl{x}", f"""
    SELECT i.*, m.in_shadow, d.d AS shadow_m,
      sqrt(greatest(b20.q - b20.m * b20.m, 0)) AS rv, sqrt(ge.dx ** 2 + ge.dy ** 2) AS g_e,
      sqrt(gs.dx ** 2 + gs.dy ** 2) AS g_s, sqrt(gi.dx ** 2 + gi.dy ** 2) AS g_i,
      CASE WHEN wall > 0 THEN CASE WHEN coalesce(elevation >= top - 50, false) THEN 0.85::DOUBLE ELSE 0.4::DOUBLE END
           ELSE 1.0::DOUBLE END AS rim_mult,
      greatest(0, least(1, greatest(0, b5.m0 - e0) / 200)) AS depression,
      CASE WHEN elevation IS NULL THEN 0 ELSE greatest(0, least(1, (ef - psi) / 500 + 0.5)) END AS sun_proxy,
      coalesce(abs(ec - b25.m) / (sqrt(greatest(b25.q - b25.m * b25.m, 0)) + 1e-6), 0) AS elev_z,
      CASE WHEN elevation IS NOT NULL THEN hi - lo END AS relief,
      coalesce(s3 / 90, 0) AS mean_slope,
      sqrt(greatest(eq - em * em, 0)) / CASE WHEN e_abs > 1e-6 THEN e_abs ELSE 1 END AS std_elev,
      coalesce(greatest((roughness - r_mean) / (r_std + 1e-6), 0), 0) AS rough_z,
      {", ".join(f"CASE WHEN elevation IS NULL THEN 0 ELSE greatest(0, least(1, (e0 - pm{r}) / 200)) END AS prom_{r}"
                 for r in (1, 2, 3))}
    FROM input{x} i JOIN mask{x} m USING (region, row, col) LEFT JOIN dist{x} d USING (region, row, col)
    JOIN b20{x} b20 USING (region, row, col) JOIN b17{x} USING (region, row, col) JOIN b5{x} b5 USING (region, row, col)
    JOIN b11{x} USING (region, row, col) JOIN b25{x} b25 USING (region, row, col) JOIN b3{x} USING (region, row, col)
    JOIN p1{x} USING (region, row, col) JOIN p2{x} USING (region, row, col) JOIN p3{x} USING (region, row, col)
    JOIN ge{x} ge USING (region, row, col) JOIN gs{x} gs USING (region, row, col) JOIN gi{x} gi USING (region, row, col)
    """, [f"{b}{x}" for b in ("input", "mask", "dist", "b20", "b17", "b5", "b11", "b25", "b3", "p1", "p2", "p3", "ge", "gs", "gi")])
    cte(f"lscale{x}", f"""
    SELECT region, quantile_cont(rv, 0.95) AS rv95, quantile_cont(g_e, 0.95) AS ge95, quantile_cont(g_s, 0.95) AS gs95,
      quantile_cont(g_i, 0.95) AS gi95, quantile_cont(relief, 0.95) AS c95 FROM rawl{x} GROUP BY region""", [f"rawl{x}"])

    def unit(e: str, s: str) -> str:
        return f"coalesce(greatest(0, least(1, {e} / CASE WHEN {s} > 1e-6 THEN {s} ELSE 1 END)), 0)"

    crater = "coalesce(crater_density, 0)"
    smooth = "coalesce(1 - greatest(0, least(1, roughness / CASE WHEN r95 > 1e-6 THEN r95 ELSE 1 END)), 0)"
    soft = f"0.5 * depression + 0.3 * {smooth} + 0.2 * {crater}" if anc else f"0.6 * depression + 0.4 * {smooth}"
    # greatest and least skip NULL, so nodata is kept apart where it would otherwise turn into a bound
    cte(f"layers{x}", f"""
    SELECT l.*, CASE WHEN rv IS NULL THEN 0 ELSE {unit("rv", "rv95")} END AS rough_var,
      CASE WHEN g_e IS NULL THEN 0 ELSE {unit("g_e", "ge95")} END AS grad_elev,
      CASE WHEN g_s IS NULL THEN 0 ELSE {unit("g_s", "gs95")} END AS grad_slope,
      CASE WHEN g_i IS NULL THEN 0 ELSE greatest(0, least(1, g_i / greatest(coalesce(gi95, 1), 1e-6))) END AS grad_illum,
      CASE WHEN relief IS NULL THEN 0 ELSE greatest(0, relief / CASE WHEN c95 > 1e-6 THEN c95 ELSE 1 END) END AS contrast,
      greatest(0, least(1, {soft})) AS softness,
      coalesce(greatest(0, least(1, 1 - shadow_m / 5000)), 0) AS prox,
      greatest(0, least(1, (-82 - lat) / 6)) AS lat_score
    FROM rawl{x} l JOIN lscale{x} USING (region)""", [f"rawl{x}", f"lscale{x}"])


layer_steps("", True)
layer_steps("_px", False)

cte("missions", f"""
SELECT region, {", ".join(f"{t} AS {c}" for c, t in MISSION_FIELDS.items())},
  list_filter([CASE WHEN b % 2 = 1 THEN 'volatile_detection' END, CASE WHEN b // 2 % 2 = 1 THEN 'mineralogy' END,
    CASE WHEN b // 4 % 2 = 1 THEN 'thermal_environment' END, CASE WHEN b // 8 % 2 = 1 THEN 'geomorphology' END,
    CASE WHEN b // 16 % 2 = 1 THEN 'space_weathering' END], lambda e: e IS NOT NULL) AS science_experiments,
  1 + b % 3 AS flat_px
FROM (SELECT p_brand, CAST(substr(p_brand, 7) AS INT) AS b,
        'R' || CAST(p_partkey % (SELECT count(*) FROM regions) AS VARCHAR) AS region, count(*) AS n_parts
      FROM part GROUP BY ALL)""", ["regions"])
cte("limits", "SELECT DISTINCT region, max_slope_deg FROM missions", ["missions"])


def sinkage_sql(mass: str, width: str, radius: str, wheels: str, soft: str) -> str:
    return (f"(({mass} * 1.62 / greatest({wheels}, 1)) / (2 * greatest({width}, 1e-6) * sqrt(2 * greatest({radius}, 1e-6))"
            f" * (1400 * (1 - 0.5 * {soft}) / greatest({width}, 1e-6) + 820000 * (1 - 0.6 * {soft}))))"
            f" ** (2.0::DOUBLE / 3.0::DOUBLE)")


def score_steps(x: str, anc: bool, mobility: bool = True, name: str | None = None, m: str = "") -> None:
    name = name or f"scores{x}"
    if f"flats{x}{m}" not in _flats:
        _flats.add(f"flats{x}{m}")
        cte(f"standing{x}{m}", f"""
        SELECT l.region, height, width, row, col, max_slope_deg,
          CASE WHEN elevation IS NOT NULL AND coalesce(slope <= max_slope_deg, false) THEN 1 ELSE 0 END AS ok
        FROM layers{x} l JOIN limits{m} USING (region)""", [f"layers{x}", f"limits{m}"])
        for r in (1, 2, 3):
            cte(f"flat{r}{x}{m}", box_sql(f"standing{x}{m}", 2 * r + 1, {"n_ok": ("sum", "ok")}, by="region, max_slope_deg"),
                [f"standing{x}{m}"])
        cte(f"flats{x}{m}", " UNION ALL ".join(
            f"SELECT region, max_slope_deg, row, col, {r} AS flat_px, least(1, n_ok / {(2 * r + 1) ** 2}.0::DOUBLE / 0.5)"
            f" AS flat_sub FROM flat{r}{x}{m}" for r in (1, 2, 3)), [f"flat{r}{x}{m}" for r in (1, 2, 3)])
    qual = ("coalesce(greatest(0, least(1, quality / CASE WHEN q_max > 1e-6 THEN q_max ELSE 1 END)), 0)"
            if anc else "1.0::DOUBLE")
    qual = f"CASE WHEN quality IS NULL THEN 0 ELSE {qual} END" if anc else qual
    sun = "coalesce(illumination, 0)" if anc else "sun_proxy"
    high = "greatest(0, least(1, (ef - e5) / greatest(e95 - e5, 1)))"
    ridge = "greatest(0, least(1, (ef - e50) / greatest(e95 - e50, 1)))"
    atmo = ("0.6 * coalesce(sky_visibility, 0) + 0.4 * coalesce(illumination, 0)" if anc
            else f"0.5 * {ridge} + 0.5 * {high}")
    base = f"""CASE mission_type
      WHEN 'water_ice' THEN 0.3 * lat_score
        + CASE power_source WHEN 'solar' THEN 0.25 ELSE 0.5 END * prox
          * CASE psr_intent WHEN 'enter' THEN 1
              WHEN 'avoid' THEN CASE WHEN in_shadow THEN 0 WHEN coalesce(shadow_m < 2000, false) THEN 0.3 ELSE 1 END
              ELSE CASE WHEN in_shadow THEN CASE power_source WHEN 'solar' THEN 0.1 ELSE 0.3 END ELSE 1 END END
        + CASE power_source WHEN 'solar' THEN 0.45 ELSE 0.2 END * {sun}
      WHEN 'geological' THEN (0.4 * rough_var + 0.35 * grad_elev + 0.25 * exp(-((lat - lat50) ** 2) / 4.5))
        * CASE WHEN row BETWEEN 10 AND 53 AND col BETWEEN 10 AND 53 THEN 1 ELSE 0 END
      ELSE {atmo} END"""
    bonus = f"greatest(0, least(1, {base} + 0.1 * coalesce(earth_visibility, 0)))" if anc else base
    w = ("0.33", "0.23", "0.18", "0.05", "0.11") if mobility else ("0.35", "0.25", "0.2", "0.05", "0.15")
    mob = " + 0.1 * (1 - mobility_risk)" if mobility else ""
    dark = "power_source = 'solar' AND coalesce(psr >= 0.5, false)" if anc else "false"
    near = "(0.6 * prox + 0.4 * lat_score)"
    if anc:
        parts = [f"0.6 * (1 - coalesce(coltemp, 1)) + 0.4 * {near}", "minirf_cpr", "grad_illum",
                 "0.6 * mas_560m + 0.4 * (1 - hurst)", "0.5 * freshness + 0.5 * (1 - hurst)"]
    else:
        parts = [near, "grad_elev", f"greatest(0, least(1, 4 * {near} * (1 - {near})))", "rough_var",
                 "0.5 * rough_var + 0.5 * greatest(0, least(1, sf / 35))"]
    exps = ["volatile_detection", "mineralogy", "thermal_environment", "geomorphology", "space_weathering"]
    best = ", ".join(f"CASE WHEN list_contains(science_experiments, '{e}') THEN coalesce({p}, 0) ELSE 0 END"
                     for e, p in zip(exps, parts, strict=True))
    risk = sinkage_sql("rover_mass_kg", "wheel_width_m", "wheel_radius_m", "n_wheels", "softness")
    cte(f"{name}_sub", f"""
    SELECT l.*, m.* EXCLUDE (region), f.flat_sub,
      elevation IS NOT NULL AND coalesce(slope <= m.max_slope_deg, false) AS passable,
      coalesce(1 / (1 + exp(8 * (slope / m.max_slope_deg - 0.75))), 0) AS slope_sub,
      coalesce(exp(-roughness / greatest(wheel_radius_m * 20, 0.1)), 0) AS rough_sub, {qual} AS qual_sub,
      CASE flat_px WHEN 1 THEN prom_1 WHEN 2 THEN prom_2 ELSE prom_3 END AS prom_sub,
      CASE WHEN elevation IS NULL THEN 0 ELSE least(1, {risk} / greatest(0.5 * wheel_radius_m, 1e-6)) END AS mobility_risk
    FROM layers{x} l JOIN missions{m} m USING (region)
    JOIN flats{x}{m} f USING (region, max_slope_deg, flat_px, row, col)""", [f"layers{x}", f"missions{m}", f"flats{x}{m}"])
    cte(name, f"""
    SELECT mission_id, region, row, col, height, width, resolution_m, origin_x, origin_y, elevation, slope, roughness, passable,
      mobility_risk, slope_sub, rough_sub, qual_sub, flat_sub, prom_sub, rim_mult, illumination, psr, sky_visibility,
      earth_visibility, in_shadow, shadow_m, safety, mission, science,
      CASE WHEN {dark} THEN 0 WHEN safety = 0 THEN 0
           WHEN priority < 0.5 THEN 0.7 * safety + 0.3 * mission ELSE 0.4 * safety + 0.6 * mission END AS final
    FROM (SELECT s.*, greatest({best}) AS science,
        CASE WHEN passable THEN ({w[0]} * slope_sub + {w[1]} * rough_sub + {w[2]} * qual_sub + {w[3]} * flat_sub
          + {w[4]} * prom_sub{mob}) * rim_mult ELSE 0 END AS safety,
        CASE WHEN elevation IS NULL THEN 0 ELSE {bonus} END AS mission
      FROM {name}_sub s)""", [f"{name}_sub"])


_flats: set[str] = set()
score_steps("", True)
score_steps("_px", False)
score_steps("", True, mobility=False, name="scores_nomob")
