"""Mission reports as columns: one row per mission, sentences filled from its best sites and its route."""

from __future__ import annotations

from string import Formatter

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from selenogrid.functions.describe import ELEVATION_PHRASES, ROUGHNESS_WORDS, SLOPE_WORDS, band, class_name

# fixed values: sentences; a field names a column of the brief, with Python's number formats
TEXT = {
    "summary": "{rover_name} {kind} mission analysis identified {n_sites} candidate landing sites across the lunar south pole region. "
               "The primary landing site at {abs_lat1:.2f}°S, {lon1:.2f}°E is {suitability}, with safety score {safety1:.2f} and mission "
               "score {mission1:.2f}. This report provides terrain characterisation, traverse planning, risk assessment, and operational "
               "recommendations for the {kind} mission profile.",
    "site": "PRIMARY SITE (Rank 1): {abs_lat1:.2f}°S, {lon1:.2f}°E",
    "terrain": "  Terrain: {elev_word} at {elev1:.0f} m. Slope {slope1:.1f}° ({slope_word}), roughness {rough1:.1f} m ({rough_word}).",
    "class": "  Terrain class: {class1}.",
    "second": "\nCOMPARISON (Rank 1 vs Rank 2): Rank 1 leads by {d_safety:+.2f} safety score and {d_mission:+.2f} mission score. Rank 2 site at "
              "{abs_lat2:.2f}°S, {lon2:.2f}°E has slope {slope2:.1f}° vs {slope1:.1f}° and roughness {rough2:.1f} m vs {rough1:.1f} m.",
    "third": "Rank 3 site at {abs_lat3:.2f}°S, {lon3:.2f}°E: final score {final3:.2f}, slope {slope3:.1f}°, roughness {rough3:.1f} m.",
    "no_path": "No viable traverse path was identified between the primary landing site and the nearest science waypoint. This may indicate "
               "terrain impassability or insufficient flat corridor between sites. Manual route replanning or site reselection is recommended.",
    "path": "Planned traverse: {km:.2f} km across {cells} waypoints. Estimated duration: {hours:.1f} hrs at nominal {speed_kmh} km/h. "
            "Slope profile — mean: {mean_slope:.1f}°, peak: {peak:.1f}°.",
    "steep": "WARNING: Steepest section reaches {peak:.1f}°. Reduced traverse speed and increased wheel slip risk at this segment.",
    "soft": "TERRAIN CAUTION: {soft_pct:.0f}% of traverse path crosses terrain with elevated soft soil risk indicators (PSR-adjacent terrain, "
            "low DEM confidence, uncertain slope). Wheel sinkage assessment requires ground-truth soil data. Mission planners should review "
            "flagged path segments before final approval. Source: Heiken et al. 1991, Lunar Sourcebook.",
    "firm": "Terrain bearing capacity: LOW RISK along planned traverse corridor.",
    "terrain_low": "1. TERRAIN RISK — LOW: slope {slope1:.1f}° and roughness {rough1:.1f} m within safe thresholds.",
    "terrain_high": "1. TERRAIN RISK — HIGH: slope {slope1:.1f}° or roughness {rough1:.1f} m exceeds operational limits.",
    "terrain_mid": "1. TERRAIN RISK — MODERATE: slope {slope1:.1f}° and roughness {rough1:.1f} m require careful navigation.",
    "sun_high": "2. POWER RISK — HIGH: sunlight fraction {sun:.2f} — site is in or near permanently shadowed region (PSR); solar generation critically limited.",
    "sun_mid": "2. POWER RISK — MODERATE: sunlight fraction {sun:.2f} — partial shadowing expected; solar panels will experience reduced output.",
    "sun_low": "2. POWER RISK — LOW: sunlight fraction {sun:.2f} — adequate solar illumination expected.",
    "basin_high": "2. POWER RISK — HIGH: elevation {elev1:.0f} m likely within permanently shadowed basin — solar generation severely limited.",
    "basin_mid": "2. POWER RISK — MODERATE: elevation {elev1:.0f} m may experience extended shadow periods.",
    "basin_low": "2. POWER RISK — LOW: elevation {elev1:.0f} m expected adequate solar illumination.",
    "rtg": "2. POWER RISK — LOW: RTG power source provides continuous generation independent of illumination.",
    "nav_none": "3. NAVIGATION RISK — HIGH: no viable path found — terrain passability unconfirmed.",
    "nav_low": "3. NAVIGATION RISK — LOW: path max slope {peak:.1f}° well within rover {max_slope_deg}° capability.",
    "nav_mid": "3. NAVIGATION RISK — MODERATE: path max slope {peak:.1f}° approaching rover {max_slope_deg}° limit.",
    "nav_high": "3. NAVIGATION RISK — HIGH: path max slope {peak:.1f}° near or exceeding rover {max_slope_deg}° limit.",
    "ice_1": "Subsurface ice detection using neutron spectrometry at {abs_lat1:.2f}°S {lon1:.2f}°E permanently shadowed region",
    "ice_2": "Volatile mapping across {dist} km traverse corridor",
    "ice_3": "Regolith sampling at crater floor elevation {elev1:.0f} m",
    "geo_1": "Stratigraphic analysis of elevation transition zone at {abs_lat1:.2f}°S {lon1:.2f}°E",
    "geo_2": "Impact melt sampling at roughness anomaly sites along traverse",
    "geo_3": "Mineralogical survey across {dist} km traverse",
    "air_1": "Solar wind interaction measurement at ridge elevation {elev1:.0f} m near {abs_lat1:.2f}°S",
    "air_2": "Exospheric composition sampling across illuminated {dist} km traverse",
    "air_3": "Dust particle flux measurement at exposed high-altitude landing site",
    "anomaly_1": "Investigate {a_kind1} cluster at {a_lat1:.2f}°S {a_lon1:.2f}°E (strength {a_strength1:.2f}, {a_cells1} pixels)",
    "anomaly_2": "Investigate {a_kind2} cluster at {a_lat2:.2f}°S {a_lon2:.2f}°E (strength {a_strength2:.2f}, {a_cells2} pixels)",
    "why_unsafe": "primary site safety score {safety1:.2f} below minimum threshold of 0.30",
    "why_no_path": "no viable traverse path identified between landing site and science targets",
    "why_marginal": "safety score {safety1:.2f} in marginal range (0.30–0.60)",
    "why_steep": "path max slope {peak:.1f}° exceeds 80% of rover capability ({max_slope_deg}°)",
    "why_nominal": "safety score {safety1:.2f} above threshold; path max slope {peak:.1f}° within rover {max_slope_deg}° capability",
    "go": "Proceed with {abs_lat1:.2f}°S, {lon1:.2f}°E as primary landing target.",
    "go_ice": "Deploy neutron spectrometer immediately post-landing for subsurface volatile survey.",
    "go_geo": "Begin camera and spectrometer survey of immediate landing zone before traverse.",
    "go_air": "Initialise atmospheric sensors and commence baseline measurements post-landing.",
    "go_drive": "Execute {km:.1f} km traverse at {speed_kmh} km/h over estimated {hours:.1f} hrs to primary science target.",
    "wait": "Consider additional orbital reconnaissance before committing to primary site.",
    "wait_slope": "Traverse slope risk is elevated — path peak {peak:.1f}° approaches rover limit. Consider alternative routing.",
    "wait_site": "Landing site safety score {safety1:.2f} is marginal. Verify terrain clearance with higher-resolution imagery.",
    "wait_second": "Maintain {abs_lat2:.2f}°S, {lon2:.2f}°E (Rank 2) as contingency landing site.",
    "wait_search": "Identify contingency landing site from extended search area.",
    "stop_1": "Mission replanning recommended — primary site does not meet safety thresholds.",
    "stop_2": "Evaluate expanded search area or alternative power/mobility configurations.",
    "stop_3": "Consult terrain data for alternative approach corridor.",
    "none_summary": "No viable landing sites were identified in the analysis area.",
    "none_site": "Insufficient site data.",
    "none_path": "No path analysis available.",
    "none_risk": "Unable to assess risk without site data.",
    "none_why": "no landing sites identified",
    "none_1": "Mission replanning recommended — no viable sites found.",
    "none_2": "Evaluate expanded search area or relaxed rover constraints.",
    "line": "{rover_name} ({title}, {power}, PSR={psr_intent}) — analysis complete. Top landing site at {abs_lat1:.2f}°S, {lon1:.2f}°E: "
            "safety {safety1:.2f}, mission {mission1:.2f}{sun_note}. Traverse: {km:.1f} km, {hours:.1f} h, battery {pct:.0f}%.",
    "battery": "⚠ BATTERY WARNING: path requires {pct:.0f}% of {battery_wh:.0f} Wh capacity ({over:.0f}% over limit). "
               "Increase battery_wh or choose a closer waypoint. | ",
    "stops": " | Solar: {n_stops} recharge stop(s), est. {stop_hours:.1f} h total.",
    "dark_stops": " ⚠ {infeasible} stop(s) have NO viable charging (shadow zone).",
}


def say(name: str) -> Column:
    """Fill a sentence from columns."""
    parts = []
    for text, field, spec, _ in Formatter().parse(TEXT[name]):
        if text:
            parts.append(F.lit(text))
        if field:
            parts.append(F.format_string(f"%{spec}", F.col(field)) if spec else F.col(field).cast("string"))
    return F.concat(*parts)


def suitability() -> Column:
    return F.when(F.col("safety1") > 0.6, "suitable").when(F.col("safety1") >= 0.3, "presenting moderate risk").otherwise("high-risk")


def brief(missions: DataFrame, sites: DataFrame, routes: DataFrame, anomalies: DataFrame, stops: DataFrame) -> DataFrame:
    """One row per mission with everything the sentences need. ``sites`` may have ``cls``, the terrain class of each. Lists per mission are three sites and two anomalies long."""
    site = {"lat": "lat", "lon": "lon", "elev": "elevation", "slope": "slope", "rough": "roughness", "safety": "safety",
            "mission": "mission", "final": "final"}
    top = sites.groupBy("mission_id").agg(
        F.count(F.lit(1)).alias("n_sites"), F.max(F.when(F.col("rank") == 1, class_name(F.col("cls")) if "cls" in sites.columns else F.lit(None).cast("string"))).alias("class1"), F.max(F.when(F.col("rank") == 1, F.col("sunlight_fraction"))).alias("sun"),
        *[F.max(F.when(F.col("rank") == i, F.col(c))).alias(f"{n}{i}") for i in (1, 2, 3) for n, c in site.items()])
    entry = F.struct((-F.col("anomaly_strength")).alias("s"), "cluster", "anomaly_type", "lat", "lon", "pixel_count")
    # the two strongest of each region and mission type are found before missions meet them
    kinds = anomalies.select("region", entry.alias("e"), F.explode(F.array_distinct("recommended_for")).alias("mission_type"))
    place = F.row_number().over(Window.partitionBy("region", "mission_type").orderBy("e"))
    two = kinds.withColumn("_place", place).filter("_place <= 2").select("region", "mission_type", "e.*")
    relevant = missions.select("mission_id", "region", "mission_type").join(two, ["region", "mission_type"])
    strongest = relevant.groupBy("mission_id").agg(F.array_sort(F.collect_list(F.struct("s", "cluster", "anomaly_type", "lat", "lon", "pixel_count"))).alias("a"))
    out = missions.join(top, "mission_id", "left").join(routes, "mission_id", "left").join(strongest, "mission_id", "left").join(
        stops, "mission_id", "left")
    fields = {}
    for i in (1, 2):
        a = F.get("a", F.lit(i - 1))
        fields |= {f"a_kind{i}": F.lower(F.replace(a["anomaly_type"], F.lit("_"), F.lit(" "))), f"a_lat{i}": F.abs(a["lat"]),
                   f"a_lon{i}": a["lon"], f"a_strength{i}": -a["s"], f"a_cells{i}": a["pixel_count"]}
    kind = F.replace("mission_type", F.lit("_"), F.lit(" "))
    return out.select(
        "*", kind.alias("kind"), F.initcap(kind).alias("title"), F.upper("power_source").alias("power"), suitability().alias("suitability"),
        *[F.abs(f"lat{i}").alias(f"abs_lat{i}") for i in (1, 2, 3)],
        (F.col("safety1") - F.col("safety2")).alias("d_safety"), (F.col("mission1") - F.col("mission2")).alias("d_mission"),
        band(F.col("elev1"), ELEVATION_PHRASES).alias("elev_word"), band(F.col("slope1"), SLOPE_WORDS).alias("slope_word"),
        band(F.col("rough1"), ROUGHNESS_WORDS).alias("rough_word"),
        F.when(F.col("has_route"), F.format_string("%.1f", "km")).otherwise("unknown").alias("dist"),
        (F.col("pct") - 100.0).alias("over"),
        F.when(F.col("sun").isNotNull(), F.format_string(", sunlight %.0f%%", F.col("sun") * 100)).otherwise("").alias("sun_note"),
        *[v.alias(n) for n, v in fields.items()],
    )


def _lines(*parts: Column, sep: str = "\n") -> Column:
    return F.concat_ws(sep, *parts)


def site_analysis() -> Column:
    return _lines(say("site"), say("terrain"), say("class"), F.when(F.col("n_sites") >= 2, say("second")), F.when(F.col("n_sites") >= 3, say("third")))


def path_analysis() -> Column:
    text = _lines(say("path"), F.when(F.col("peak") > 15, say("steep")), F.when(F.col("soft_warning"), say("soft")).otherwise(say("firm")), sep=" ")
    return F.when(F.col("has_route"), text).otherwise(say("no_path"))


def risk_assessment() -> Column:
    slope, rough = F.col("slope1"), F.col("rough1")
    terrain = F.when((slope < 10) & (rough < 10), say("terrain_low")).when((slope > 20) | (rough > 30), say("terrain_high")).otherwise(say("terrain_mid"))
    lit = F.when(F.col("sun") < 0.2, say("sun_high")).when(F.col("sun") < 0.5, say("sun_mid")).otherwise(say("sun_low"))
    basin = F.when(F.col("elev1") < -3000, say("basin_high")).when(F.col("elev1") < -1000, say("basin_mid")).otherwise(say("basin_low"))
    power = F.when(F.col("power_source") != "solar", say("rtg")).when(F.col("sun").isNotNull(), lit).otherwise(basin)
    cap = F.col("max_slope_deg")
    nav = F.when(~F.col("has_route"), say("nav_none")).when(F.col("peak") < cap * 0.5, say("nav_low")).when(
        F.col("peak") < cap * 0.8, say("nav_mid")).otherwise(say("nav_high"))
    return _lines(terrain, power, nav)


def objectives() -> Column:
    def three(stem: str) -> Column:
        return F.array(*[say(f"{stem}_{i}") for i in (1, 2, 3)])

    base = F.when(F.col("mission_type") == "water_ice", three("ice")).when(F.col("mission_type") == "geological", three("geo")).otherwise(three("air"))
    return F.concat(base, F.array_compact(F.array(say("anomaly_1"), say("anomaly_2"))))


def steep_path() -> Column:
    return F.col("peak") >= F.col("max_slope_deg") * 0.8


def feasibility() -> Column:
    s = F.col("safety1")
    return (
        F.when(F.col("n_sites").isNull() | (s < 0.3) | ~F.col("has_route"), "HIGH_RISK")
        .when((s <= 0.6) | steep_path(), "MARGINAL").otherwise("NOMINAL")
    )


def reasons() -> Column:
    s = F.col("safety1")
    marginal = F.array_compact(F.array(F.when(s <= 0.6, say("why_marginal")), F.when(steep_path(), say("why_steep"))))
    return (
        F.when(F.col("n_sites").isNull(), F.array(say("none_why"))).when(s < 0.3, F.array(say("why_unsafe")))
        .when(~F.col("has_route"), F.array(say("why_no_path"))).when(feasibility() == "MARGINAL", marginal)
        .otherwise(F.array(say("why_nominal")))
    )


def recommendations() -> Column:
    kind = F.col("mission_type")
    first = F.when(kind == "water_ice", say("go_ice")).when(kind == "geological", say("go_geo")).otherwise(say("go_air"))
    go = F.array(say("go"), first, say("go_drive"))
    wait = F.array(say("wait"), F.when(steep_path(), say("wait_slope")).otherwise(say("wait_site")),
                   F.when(F.col("n_sites") >= 2, say("wait_second")).otherwise(say("wait_search")))
    stop = F.array(say("stop_1"), say("stop_2"), say("stop_3"))
    none = F.array(say("none_1"), say("none_2"), say("stop_3"))
    return F.when(F.col("n_sites").isNull(), none).when(feasibility() == "NOMINAL", go).when(feasibility() == "MARGINAL", wait).otherwise(stop)


def report(work: DataFrame) -> DataFrame:
    """The eight report fields; missions without sites get the fixed report."""
    has = F.col("n_sites").isNotNull()
    return work.select(
        "mission_id", F.when(has, say("summary")).otherwise(say("none_summary")).alias("executive_summary"),
        F.when(has, site_analysis()).otherwise(say("none_site")).alias("landing_site_analysis"),
        F.when(has, path_analysis()).otherwise(say("none_path")).alias("path_analysis"),
        F.when(has, risk_assessment()).otherwise(say("none_risk")).alias("risk_assessment"),
        F.when(has, objectives()).otherwise(F.array().cast("array<string>")).alias("science_objectives"),
        feasibility().alias("feasibility_status"), reasons().alias("feasibility_reasons"), recommendations().alias("recommendations"),
    )


def summary_line() -> Column:
    """One line, with a battery warning before it and a note on recharge stops after it."""
    warn = F.when(~F.col("feasible"), say("battery")).otherwise("")
    dark = F.when(F.col("infeasible") > 0, say("dark_stops")).otherwise("")
    stops = F.when((F.col("power_source") == "solar") & (F.col("n_stops") > 0), F.concat(say("stops"), dark)).otherwise("")
    return F.concat(warn, say("line"), stops)
