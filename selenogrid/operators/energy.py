"""Path statistics, energy, soft-terrain exposure and the battery ledger of many routes at once.

Steps meet their predecessor by an equi-join on (route, step), which spreads one very long route like any other rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from selenogrid.functions import physics as ph
from selenogrid.functions.numeric import clip, steady_round, zero_if_null
from selenogrid.operators.ordered import carried, running_sums
from selenogrid.session import write_table


def legs(steps: DataFrame, cells: DataFrame, layers: Sequence[str], key: Sequence[str] = ("route_id",)) -> DataFrame:
    """Every step with its cell's layers and the cell it came from (NULL at the start)."""
    shared = [c for c in ("mission_id", "region", "row", "col") if c in cells.columns]
    at = steps.join(cells.select(*shared, "resolution_m", "elevation", "slope", *layers), shared, "left")
    before = at.select(*key, (F.col("step") + 1).alias("step"), F.col("row").alias("p_row"), F.col("col").alias("p_col"),
                       F.col("elevation").alias("p_elevation"))
    return at.join(before, [*key, "step"], "left")


def path_stats(work: DataFrame, key: Sequence[str] = ("route_id",)) -> DataFrame:
    """Length (a move of |dr| + |dc| = 2 is diagonal), slopes over all cells including the first, and time."""
    moved = F.abs(F.col("row") - F.col("p_row")) + F.abs(F.col("col") - F.col("p_col"))
    metres = F.when(F.col("p_row").isNotNull(), F.col("resolution_m") * F.when(moved == 2, ph.SQRT2).otherwise(1.0))
    total = zero_if_null(F.sum(metres))
    speed = F.max("speed_kmh")
    return work.groupBy(*key).agg(
        total.alias("total_distance_m"), (total / 1000.0).alias("total_distance_km"),
        zero_if_null(F.max("slope")).alias("max_slope_deg"), zero_if_null(F.avg("slope")).alias("mean_slope_deg"),
        F.when(speed > 0, total / 1000.0 / F.when(speed > 0, speed)).otherwise(0.0).alias("estimated_time_hrs"),
        F.count(F.lit(1)).alias("waypoint_count"),
    )


def step_energy(with_rolling: bool = True) -> dict[str, Column]:
    """Per step: drive energy uphill or level, energy regained downhill, rolling surcharge; slope at the destination."""
    speed = ph.positive_or(F.col("speed_kmh"), ph.DEFAULT_SPEED_KMH)
    diagonal = (F.abs(F.col("row") - F.col("p_row")) == 1) & (F.abs(F.col("col") - F.col("p_col")) == 1)
    metres = F.col("resolution_m") * F.when(diagonal, ph.SQRT2).otherwise(1.0)
    flat = ph.BASE_POWER_W * metres / (speed * 1000.0)
    sine = F.sin(F.radians(zero_if_null(F.col("slope"))))
    down = F.coalesce(F.col("elevation") < F.col("p_elevation"), F.lit(False))
    regen = F.when(down, flat * ph.REGEN_SHARE * sine).otherwise(0.0)
    climb = F.when(~down, flat * (1.0 + ph.CLIMB_FACTOR * sine)).otherwise(0.0)
    net = F.when(down, F.greatest(F.lit(0.0), flat - regen)).otherwise(climb)
    rolling = flat * ph.ROLLING_BASE * (1.0 + 3.0 * zero_if_null(F.col("mobility_risk"))) if with_rolling else F.lit(0.0)
    is_step = F.col("p_row").isNotNull()
    return {n: F.when(is_step, v) for n, v in
            {"step_m": metres, "climb_wh": climb, "regen_wh": regen, "net_wh": net, "rolling_wh": rolling}.items()}


def energy_band(pct: Column) -> Column:
    return F.when(pct < 40.0, "LOW").when(pct < 75.0, "MODERATE").otherwise("HIGH")


def path_energy(work: DataFrame, key: Sequence[str] = ("route_id",), with_rolling: bool = True) -> DataFrame:
    step = work.select(*key, "battery_wh", *[v.alias(n) for n, v in step_energy(with_rolling).items()])
    total = zero_if_null(F.sum(F.col("net_wh") + F.col("rolling_wh")))
    km = F.sum("step_m") / 1000.0
    battery = ph.positive_or(F.max("battery_wh"), ph.DEFAULT_BATTERY_WH)
    sums = step.groupBy(*key).agg(
        total.alias("total_energy_wh"), zero_if_null(F.sum("climb_wh")).alias("uphill_energy_wh"),
        zero_if_null(F.sum("regen_wh")).alias("downhill_regen_wh"),
        F.when(km > 0, total / F.when(km > 0, km)).otherwise(0.0).alias("energy_per_km"),
        (total / battery * 100.0).alias("battery_pct_used"),
    )
    return sums.select(
        *key, *[F.round(c, 4).alias(c) for c in sums.columns if c not in key],
        energy_band(F.col("battery_pct_used")).alias("energy_risk"),
        (F.round("battery_pct_used", 4) <= 100.0).alias("battery_feasible"),
    )


def soft_risk() -> Column:
    """Shadow, thin data and uncertain slope; without a slope-error layer the first two carry all the weight."""
    psr = zero_if_null(F.col("psr"))
    thin = zero_if_null(clip(1.0 - F.col("quality"), 0.0, 1.0))
    three = 0.4 * psr + 0.3 * thin + 0.3 * zero_if_null(F.col("ldsm_err"))
    return F.least(F.lit(1.0), F.when(F.col("any_ldsm_err"), three).otherwise(0.5 * psr + 0.5 * thin))


def soft_terrain(work: DataFrame, key: Sequence[str] = ("route_id",)) -> DataFrame:
    risk = work.select(*key, soft_risk().alias("r")).groupBy(*key).agg(
        F.avg("r").alias("mean"), F.max("r").alias("top"), F.avg((F.col("r") > 0.6).cast("double")).alias("high"))
    return risk.select(
        *key, steady_round(F.col("mean"), 4).alias("mean_soft_risk"), F.round("top", 4).alias("max_soft_risk"),
        F.round(100.0 * F.col("high"), 1).alias("soft_terrain_pct"),
        F.when(F.col("top") > 0.7, "HIGH").when(F.col("top") > 0.4, "MODERATE").otherwise("LOW").alias("stuck_risk"),
        (F.col("top") > 0.7).alias("soft_terrain_warning"),
    )


def recharge_stops(work: DataFrame, key: Sequence[str] = ("route_id",)) -> DataFrame:
    """Forced stops of solar rovers along their routes; an infeasible stop is recorded at every step until some cell allows charging.

    After a full charge at step g the charge at step i is what is left of it after the energy spent between, a difference of running
    sums, so the step that forces the next stop is the first one whose running sum exceeds that of g by the usable charge. The charge
    resumes at the first step from there on whose cell lets the battery gain. That successor is found for every cell where the rover
    could charge, all at once; which of them a route really stops at follows by pointer doubling from its start, in as many
    rounds as the logarithm of the most stops. A step without a known cost costs nothing.
    """
    key = list(key)
    lit = ph.day_illumination(zero_if_null(F.col("sunlight")), F.col("mission_day"))
    solar = work.filter((F.col("power_source") == "solar") & (F.col("solar_panel_w") > 0) & F.col("p_row").isNotNull())
    steps = solar.select(
        *key, "step", "row", "col", ph.positive_or(F.col("battery_wh"), ph.DEFAULT_BATTERY_WH).alias("battery"),
        zero_if_null(step_energy(False)["net_wh"]).alias("cost"), lit.alias("light"), (F.col("solar_panel_w") * lit).alias("charge"),
        F.greatest(F.lit(0.0), F.col("solar_panel_w") * lit - ph.IDLE_W).alias("rate"))
    start = steps.groupBy(*key).agg(F.max("battery").alias("battery")).withColumn("step", F.lit(0)).withColumn("cost", F.lit(0.0)).withColumn("rate", F.lit(0.0))
    steps = write_table(steps.unionByName(start, allowMissingColumns=True), "ledger")
    spent = running_sums(steps, key, F.col("step"), "cost").withColumnRenamed("upto", "spent")
    steps = write_table(carried(write_table(spent, "ledger"), key, F.col("step"), F.when(F.col("rate") > 0, F.col("step")), "charges_at", ahead=True), "ledger")
    nodes = _successors(steps, key)
    reached = _reached(nodes, key)
    # what the charge counts from, at the step after each stop that happened
    resume = F.col("battery") * ph.RESUME_PCT / 100.0
    full = F.when(F.col("node") == 0, F.col("battery")).otherwise(resume)
    since = reached.select(*key, (F.col("node") + 1).alias("step"), F.struct(F.col("spent").alias("spent"), full.alias("full"), "halts_at").alias("since"))
    told = write_table(steps.join(since, [*key, "step"], "left"), "ledger")
    rows = carried(told, key, F.col("step"), F.col("since"), "from").filter("step > 0 AND step >= from.halts_at")
    charge = F.greatest(F.lit(0.0), F.col("from.full") - (F.col("spent") - F.col("from.spent")))
    can = F.col("rate") > 0
    gained = F.when(can, resume - charge).otherwise(0.0)
    return rows.select(
        *key, "step", "row", "col", F.round("light", 4).alias("illumination_frac"), F.round("charge", 2).alias("charge_w"),
        F.round("rate", 2).alias("net_charge_rate_wh_hr"), F.round(charge / F.col("battery") * 100.0, 2).alias("battery_at_stop_pct"),
        F.round(gained, 2).alias("energy_gained_wh"), F.round(F.when(can, gained / F.when(can, F.col("rate"))), 2).alias("recharge_time_hrs"))


def _successors(steps: DataFrame, key: list[str]) -> DataFrame:
    """``(key, node, battery, spent, halts_at, next)``: for the start and every step that can charge, the step that halts the rover next after
    a full charge there, and the step where it charges then; NULL where there is none.

    Running sums are looked up bucket by bucket, a bucket being one usable charge wide, so neither a route nor its stops meet in one window.
    """
    usable = F.col("battery") * (ph.RESUME_PCT - ph.STOP_PCT) / 100.0
    first = F.col("battery") * (100.0 - ph.STOP_PCT) / 100.0
    width = F.floor(F.col("at") / usable)
    asked = steps.filter("rate > 0 OR step = 0").select(*key, "battery", "spent", F.col("step").alias("node"), (F.col("spent") + F.when(F.col("step") == 0, first).otherwise(usable)).alias("at"))
    marks = steps.filter("cost > 0").select(*key, "battery", F.col("spent").alias("at"), "step")
    both = marks.unionByName(asked, allowMissingColumns=True).withColumn("bucket", width)
    from_here = Window.partitionBy(*key, "bucket").orderBy("at").rangeBetween(Window.currentRow, Window.unboundedFollowing)
    local = write_table(both.withColumn("here", F.min("step").over(from_here)), "ledger")
    later = Window.partitionBy(*key).orderBy("bucket").rowsBetween(1, Window.unboundedFollowing)
    beyond = local.groupBy(*key, "bucket").agg(F.min("step").alias("s")).select(*key, "bucket", F.first("s", ignorenulls=True).over(later).alias("beyond"))
    nodes = local.filter("node IS NOT NULL").join(beyond, [*key, "bucket"]).select(*key, "node", "battery", "spent", F.coalesce("here", "beyond").alias("halts_at"))
    then = steps.select(*key, F.col("step").alias("halts_at"), F.col("charges_at").alias("next"))
    return write_table(nodes.join(then, [*key, "halts_at"], "left"), "ledger")


def _reached(nodes: DataFrame, key: list[str]) -> DataFrame:
    """The nodes on each route's way from its start: every round doubles the length of the jumps and marks where marked nodes jump to."""
    ways = nodes.select(*key, "node", F.col("next").alias("jump"), (F.col("node") == 0).alias("on"))
    have = -1
    while True:
        ways = write_table(ways, "ledger-ways")
        count = ways.filter("on").count()
        if count == have:
            return nodes.join(ways.filter("on").select(*key, "node"), [*key, "node"])
        have = count
        hit = ways.filter("on AND jump IS NOT NULL").select(*key, F.col("jump").alias("node"), F.lit(True).alias("hit")).distinct()
        on = ways.select(*key, F.col("node").alias("jump"), F.col("jump").alias("far"))
        ways = ways.join(on, [*key, "jump"], "left").join(hit, [*key, "node"], "left").select(
            *key, "node", F.col("far").alias("jump"), (F.col("on") | F.coalesce("hit", F.lit(False))).alias("on"))


def recharge_totals(stops: DataFrame, key: Sequence[str] = ("route_id",)) -> DataFrame:
    return stops.groupBy(*key).agg(
        F.count(F.lit(1)).alias("n_stops"), zero_if_null(F.sum("recharge_time_hrs")).alias("recharge_hours"),
        F.sum(F.col("recharge_time_hrs").isNull().cast("int")).alias("infeasible"))


ZERO_STATS = {
    "total_distance_m": 0.0, "total_distance_km": 0.0, "max_slope_deg": 0.0, "mean_slope_deg": 0.0, "estimated_time_hrs": 0.0,
    "waypoint_count": 0, "total_energy_wh": 0.0, "uphill_energy_wh": 0.0, "downhill_regen_wh": 0.0, "energy_per_km": 0.0,
    "battery_pct_used": 0.0, "energy_risk": "LOW", "battery_feasible": True, "mean_soft_risk": 0.0, "max_soft_risk": 0.0,
    "soft_terrain_pct": 0.0, "stuck_risk": "LOW", "soft_terrain_warning": False,
}


def with_zero_record(missions: DataFrame, stats: DataFrame, key: Sequence[str]) -> DataFrame:
    """Statistics of every mission; the zero record where there is no route."""
    both = missions.select(*key).join(stats.withColumn("has_route", F.lit(True)), list(key), "left")
    return both.select(*key, F.coalesce("has_route", F.lit(False)).alias("has_route"), *[
        F.coalesce(F.col(n), F.lit(v)).alias(n) for n, v in ZERO_STATS.items() if n in stats.columns])
