"""Written tables that jobs share: each is built once per session and input folder, then read by every later job."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from selenogrid.functions import geo
from selenogrid.functions.decode import decode_layers
from selenogrid.operators import anomalies, classify, cluster, energy, evaluate, report, routing, scoring, sites, terrain
from selenogrid.operators.mobility import mobility_risk
from selenogrid.session import compile_in_pieces, write_table
from selenogrid.sources import demo_grid


def stored(build: Callable[[Workspace], DataFrame]) -> property:
    """Property whose frame is written under the work folder at first use."""

    @wraps(build)
    def get(self: Workspace) -> DataFrame:
        if build.__name__ not in self._tables:
            self._tables[build.__name__] = write_table(build(self), build.__name__)
        return self._tables[build.__name__]

    return property(get)


class Workspace:
    _open: dict[tuple[str, str], Workspace] = {}

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = compile_in_pieces(spark), sf_dir
        self._tables: dict[str, DataFrame] = {}

    @classmethod
    def of(cls, spark: SparkSession, sf_dir: str) -> Workspace:
        key = (spark.sparkContext.applicationId, sf_dir)
        if key not in cls._open or cls._open[key].spark is not spark:
            cls._open[key] = cls(spark, sf_dir)
        return cls._open[key]

    def source(self, name: str) -> DataFrame:
        return demo_grid.table(self.spark, self.sf_dir, name)

    @stored
    def regions(self) -> DataFrame:
        return demo_grid.regions(self.spark, self.sf_dir)

    @stored
    def cells(self) -> DataFrame:
        """Dense base grid with raw layers, clustered by region, row and column for row-group pruning."""
        dense = demo_grid.densify(demo_grid.sparse_cells(self.spark, self.sf_dir), self.regions)
        return dense.sortWithinPartitions("region", "row", "col")

    @stored
    def terrain(self) -> DataFrame:
        """Base grid with slope, aspect and roughness."""
        return terrain.terrain_layers(self.cells).sortWithinPartitions("region", "row", "col")

    @stored
    def decoded(self) -> DataFrame:
        """Terrain with decoded layers in place of raw counts."""
        full = decode_layers(self.terrain)
        return full.select(*[c for c in full.columns if not c.startswith("raw_")])

    @stored
    def missions(self) -> DataFrame:
        found = demo_grid.missions(self.spark, self.sf_dir, self.regions)
        return scoring.flat_radius(found, demo_grid.RESOLUTION_M)

    @property
    def radii(self) -> list[int]:
        return scoring.radii_of(self.missions)

    @stored
    def layers(self) -> DataFrame:
        """All mission-independent layers."""
        return scoring.mission_layers(self.decoded, demo_grid.RESOLUTION_M, self.radii)

    @stored
    def proxy_layers(self) -> DataFrame:
        """The same for regions without any ancillary product."""
        return scoring.mission_layers(
            scoring.without_ancillary(self.decoded), demo_grid.RESOLUTION_M, self.radii
        )

    @stored
    def scores(self) -> DataFrame:
        """Safety, mission and final score of every (mission, cell)."""
        return scoring.score_terrain(self.layers, self.missions, self.radii)

    @stored
    def sites(self) -> DataFrame:
        """Ranked sites of every mission; spacing suits the 64-cell grids."""
        return self.ranked(10)

    def ranked(self, spacing: int) -> DataFrame:
        """Ranked sites from the table of scores where there is one. Else scores are made in passing, and again for the cells that hold a site."""
        if "scores" in self._tables:
            return sites.top_sites(self.scores, self.missions, 10, spacing)
        passing = scoring.once(scoring.score_terrain(self.layers, self.missions, self.radii), "mission_id", "region", "height", "width", "row", "col", "final")
        return sites.top_sites(passing, self.missions, 10, spacing,
                               lambda at: scoring.score_terrain(self.layers, self.missions, self.radii, only=at))

    @stored
    def cell_clusters(self) -> DataFrame:
        """Density clusters of every region's cells, on all of them."""
        return anomalies.cluster_cells(anomalies.cell_points(self.layers))

    @stored
    def anomalies(self) -> DataFrame:
        return anomalies.summarize(anomalies.cell_points(self.layers), self.cell_clusters, self.cells)

    @stored
    def vectors_scaled(self) -> DataFrame:
        """The four anomaly features of all cells of all regions, scaled together."""
        cells = anomalies.cell_points(anomalies.feature_layers(self.terrain))
        number = F.substring("region", 2, 20).cast("long") * 1_000_000_000_000
        named = [F.col(c).alias(f"f{i}") for i, c in enumerate(anomalies.FEATURES)]
        return cluster.standardize(cells.select(F.lit("all").alias("grp"), (number + F.col("id")).alias("id"), *named), self.FOUR, ["grp"])

    FOUR = ["f0", "f1", "f2", "f3"]

    @stored
    def vector_clusters(self) -> DataFrame:
        return cluster.density_cluster(self.vectors_scaled.select("grp", "id", *self.FOUR), self.FOUR, 0.18, 10, ["grp"])

    @stored
    def vector_kth(self) -> DataFrame:
        return cluster.kth_distance(self.vectors_scaled.select("grp", "id", *self.FOUR), self.FOUR, 10, ["grp"], 1.0)

    # --- routes ----------------------------------------------------------------------------------------------------

    @stored
    def given(self) -> DataFrame:
        return demo_grid.route_steps(self.spark, self.sf_dir, self.regions.count())

    def _legs(self, steps: DataFrame, key: list[str]) -> DataFrame:
        """Steps meet the cells of their region once; the risk is computed for them alone, so no other cell is scored."""
        wheels = ["wheel_radius_m", "wheel_width_m", "rover_mass_kg", "n_wheels"]
        facts = self.layers.groupBy("region").agg(F.max("any_ldsm_err").alias("any_ldsm_err"))
        rover = self.missions.select("mission_id", "speed_kmh", "battery_wh", "power_source", "solar_panel_w", "mission_day", *wheels)
        work = energy.legs(steps.join(rover, "mission_id"), self.layers, ["softness", "psr", "quality", "ldsm_err", "illumination"], key)
        work = work.withColumn("mobility_risk", mobility_risk()).drop("softness", *wheels)
        return work.join(facts, "region").withColumn("sunlight", F.col("illumination"))

    @stored
    def given_legs(self) -> DataFrame:
        return self._legs(self.given, ["route_id"])

    @stored
    def given_stops(self) -> DataFrame:
        return energy.recharge_stops(self.given_legs)

    @stored
    def kept_sites(self) -> DataFrame:
        return sites.keep_requested(self.sites, self.missions).drop("n_results")

    @stored
    def waypoints(self) -> DataFrame:
        return sites.waypoints(self.kept_sites, self.anomalies, self.missions)

    @stored
    def attempts(self) -> DataFrame:
        wanted = self.missions.filter("target_lat IS NOT NULL").join(self.regions, "region")
        r, c = geo.lonlat_to_cell(*[F.col(n) for n in ("target_lon", "target_lat", "resolution_m", "origin_x", "origin_y")])
        return sites.goals(self.waypoints, self.kept_sites, wanted.select("mission_id", "region", r.alias("row"), c.alias("col")))

    @stored
    def costs(self) -> DataFrame:
        return routing.mission_costs(scoring.standing(self.layers, self.missions), self.missions)

    @stored
    def starts(self) -> DataFrame:
        first = self.kept_sites.filter("rank = 1").select("mission_id", "region", F.col("row").alias("p_row"), F.col("col").alias("p_col"))
        return routing.snap_ends(first, self.costs, ["mission_id", "region"])

    @stored
    def tries(self) -> DataFrame:
        wanted = self.attempts.select("mission_id", "region", "attempt", F.col("row").alias("p_row"), F.col("col").alias("p_col"))
        return routing.snap_ends(wanted, self.costs, ["mission_id", "region", "attempt"])

    @stored
    def reach(self) -> DataFrame:
        """Least cost from every mission's first site, as far as its goals."""
        return routing.least_cost(self.costs, self.starts, self.tries)

    @stored
    def chosen(self) -> DataFrame:
        """The first goal, in the order tried, that can be reached."""
        at = self.tries.join(self.reach, ["mission_id", "region", "row", "col"])
        best = F.min(F.struct("attempt", "row", "col", "g")).alias("b")
        return at.groupBy("mission_id", "region").agg(best).select("mission_id", "region", "b.*")

    @stored
    def planned(self) -> DataFrame:
        return routing.trace(self.reach, self.starts, self.chosen)

    @stored
    def planned_legs(self) -> DataFrame:
        return self._legs(self.planned, ["mission_id"])

    @stored
    def planned_stops(self) -> DataFrame:
        return energy.recharge_stops(self.planned_legs, ["mission_id"])

    @stored
    def route_stats(self) -> DataFrame:
        """Statistics, energy and soft-terrain exposure of the planned routes; zeros where there is none."""
        key = ["mission_id"]
        legs = self.planned_legs
        full = energy.path_stats(legs, key).join(energy.path_energy(legs, key), key).join(energy.soft_terrain(legs, key), key)
        return energy.with_zero_record(self.missions, full, key)

    # --- evaluation and reports --------------------------------------------------------------------------------------

    def _varied(self, variants: Sequence[str]) -> DataFrame:
        rover = self.regions.select(
            "region", F.concat(F.lit("one/"), "region").alias("mission_id"), F.lit("water_ice").alias("mission_type"), F.lit("rtg").alias("power_source"),
            F.lit("rim").alias("psr_intent"), F.lit(15.0).alias("max_slope_deg"), F.lit(0.3).alias("priority"), F.lit(0.25).alias("wheel_radius_m"),
            F.lit(0.2).alias("wheel_width_m"), F.lit(150.0).alias("rover_mass_kg"), F.lit(6).alias("n_wheels"), F.lit(1).alias("flat_px"),
            F.array().cast("array<string>").alias("science_experiments"))
        parts = scoring.sub_scores(scoring.mission_cells(self.layers, rover, [1]))
        subs = [F.col(c) for c in ("slope_sub", "rough_sub", "qual_sub", "flat_sub", "prom_sub")]
        mission = scoring.mission_score(F.col("mission_type"), F.col("psr_intent"), F.col("power_source"))
        runs = F.array(*[F.struct(F.lit(n).alias("variant"), scoring.safety_score(subs, evaluate.WEIGHT_VARIANTS[n], F.col("passable")).alias("safety"))
                         for n in variants])
        long = parts.select("region", "height", "width", "row", "col", "passable", "priority", mission.alias("mission"), F.explode(runs).alias("v"))
        return long.select("region", "height", "width", "row", "col", "passable", "mission", "v.variant", "v.safety",
                           scoring.blend(F.col("v.safety"), F.col("mission"), F.col("priority")).alias("final"))

    @stored
    def varied(self) -> DataFrame:
        """Scores of one rover in every region under every weight variant."""
        return self._varied(list(evaluate.WEIGHT_VARIANTS))

    @stored
    def rank_correlation(self) -> DataFrame:
        """Rank correlation of every variant's safety with the baseline's, over passable cells."""
        passable = self.varied.filter("passable").select("region", "row", "col", "variant", "safety")
        base = passable.filter("variant = 'BASELINE'").select("region", "row", "col", F.col("safety").alias("base"))
        both = passable.filter("variant <> 'BASELINE'").join(base, ["region", "row", "col"])
        return evaluate.spearman(both, "base", "safety", ["region", "variant"])

    @stored
    def combination_checks(self) -> DataFrame:
        """Rules that hold for a mission by its type, power and intent, from its ranked sites."""
        near = self.layers.select("region", "row", "col", "psr", "shadow_m", "illumination", "elevation_p50")
        at = self.sites.drop("mission_type").join(near, ["region", "row", "col"]).join(
            self.missions.select("mission_id", "mission_type", "power_source", "psr_intent"), "mission_id")
        three = F.col("rank") <= 3
        m = at.groupBy("mission_id", "mission_type", "power_source", "psr_intent").agg(
            F.max(F.when(F.col("rank") == 1, F.col("mission"))).alias("m1"), F.max(F.when(F.col("rank") == 1, F.col("final"))).alias("f1"),
            F.max(F.when(F.col("rank") == 1, F.col("psr"))).alias("p1"), F.sum((F.col("psr") >= 0.5).cast("int")).alias("dark"), F.min(F.when(three, F.coalesce("shadow_m", F.lit(1e9)))).alias("near"),
            F.avg(F.when(three, F.col("illumination"))).alias("lit"), F.avg(F.when(three, F.col("mission"))).alias("m3"),
            F.avg(F.when(three, F.col("elevation"))).alias("e3"), F.max("elevation_p50").alias("e50"))
        ice, solar = F.col("mission_type") == "water_ice", F.col("power_source") == "solar"
        rules = [
            (ice & (F.col("psr_intent") == "enter"), "mission score positive", F.col("m1") > 0, "m1", "> 0"),
            (ice & (F.col("psr_intent") == "enter") & ~solar & (F.col("p1") >= 0.5), "shadow site not zeroed", F.col("f1") > 0, "f1", "> 0"),
            (ice, "final score positive", F.col("f1") > 0, "f1", "> 0"),
            (ice & (F.col("psr_intent") == "rim") & ~solar, "near shadow", F.col("near") <= 5000, "near", "<= 5000"),
            (solar, "no solar site in shadow", F.col("dark") == 0, "dark", "0"),
            (solar & (F.col("psr_intent") == "avoid"), "top three lit",
             F.col("lit") > F.when(F.col("mission_type") == "geological", 0.35).otherwise(0.4), "lit", "> 0.40"),
            (F.col("mission_type") == "geological", "geological diversity", F.col("m3") > 0.6, "m3", "> 0.60"),
            (F.col("mission_type") == "atmospheric", "above median elevation", F.col("e3") > F.col("e50"), "e3", "> median"),
        ]
        return evaluate.checks_long(m, ["mission_id"], [
            F.when(applies, evaluate.check(name, ok, F.col(value), want)) for applies, name, ok, value, want in rules])

    @stored
    def labelled(self) -> DataFrame:
        """Features of every cell with the rule label of its region's sensitivity rover."""
        one = self._varied(["BASELINE"]).join(self.layers.select("region", "row", "col", "slope", "roughness"), ["region", "row", "col"])
        return classify.labelled(self.layers, one)

    @property
    def forest(self):
        """The classifier, trained once on the training fold."""
        if not hasattr(self, "_forest"):
            self._forest = classify.train(classify.stratified(self.labelled).filter("fold = 'train'"))
        return self._forest

    @stored
    def predicted(self) -> DataFrame:
        """The forest's class of every cell of every region, beside the rule label."""
        return classify.predict(self.forest, self.labelled).select("region", "row", "col", "label", "cls")

    @stored
    def fold_metrics(self) -> DataFrame:
        return classify.cross_validate(self.labelled)

    @stored
    def brief(self) -> DataFrame:
        lit = sites.with_sunlight(self.kept_sites, self.regions, self.cells, "illumination")
        classes = classify.rule_label(*[F.col(c) for c in ("slope", "roughness", "safety", "mission", "final")])
        lit = lit.withColumn("cls", classes)
        routes = self.route_stats.select(
            "mission_id", "has_route", F.col("total_distance_km").alias("km"), F.col("waypoint_count").alias("cells"), F.col("estimated_time_hrs").alias("hours"),
            F.col("max_slope_deg").alias("peak"), F.col("mean_slope_deg").alias("mean_slope"), F.col("soft_terrain_pct").alias("soft_pct"),
            F.col("soft_terrain_warning").alias("soft_warning"), F.col("battery_pct_used").alias("pct"), F.col("battery_feasible").alias("feasible"))
        stops = energy.recharge_totals(self.planned_stops, ["mission_id"]).select(
            "mission_id", "n_stops", F.round("recharge_hours", 2).alias("stop_hours"), "infeasible")
        return report.brief(self.missions, lit, routes, self.anomalies, stops)
