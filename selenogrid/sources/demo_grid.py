"""Grid, route and catalogue views over the driver's tables: the inputs the registered queries run on.

``lineitem`` becomes one 64 x 64 elevation grid per 5000 orders, so regions, and the work, grow with the table. All layers
are integer sums divided once, so their values do not depend on row order. The texts are plain SQL that any engine reads.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from selenogrid.operators.grid import densify
from selenogrid.operators.quantiles import ordered_index

SIDE = 64
ORDERS_PER_REGION = 5000
RESOLUTION_M = 600.0

REGION = f"'R' || CAST(CAST(floor(l_orderkey / {ORDERS_PER_REGION}) AS INT) AS VARCHAR(12))"
ROW = f"CAST(l_orderkey % {SIDE} AS INT)"
COL = f"CAST(l_partkey % {SIDE} AS INT)"


def _mean(term: str) -> str:
    return f"CAST(sum(CAST({term} AS BIGINT)) AS DOUBLE) / count(*)"


LAYERS = {
    "elevation": f"{_mean('round(l_extendedprice * 100)')} / 9000 - 590",
    "quality": "CAST(count(*) AS DOUBLE)",
    "illumination": f"{_mean('l_quantity')} / 50",
    "sky_visibility": f"{_mean('round(l_tax * 100)')} / 8",
    "earth_visibility": f"{_mean('round(l_discount * 100)')} / 10",
    # raw counts, as a file would hold them
    "raw_dn": "CASE WHEN min(l_linenumber) = 7 THEN -32768 WHEN max(l_linenumber) = 1 THEN 0 "
              "ELSE CAST(min(l_partkey) AS INT) END",
    "raw_illum": _mean("l_quantity * 450"),
    "raw_psr": "CASE WHEN min(l_linenumber) >= 4 THEN 20000 ELSE 0 END",
    "raw_earth": _mean("round(l_discount * 100) * 2600"),
    "raw_sky": f"{_mean('round(l_tax * 100) * 4300')} - 31500",
    "raw_coltemp": _mean("(l_suppkey * 5 + l_linenumber) % 256"),
    "raw_cpr": f"{_mean('(l_partkey * 7 + l_suppkey) % 23')} - 2",
    "raw_mas57": f"{_mean('l_suppkey % 40')} - 4",
    "raw_mas225": f"{_mean('l_partkey % 40')} - 4",
    "raw_mas560": f"{_mean('(l_partkey + l_suppkey) % 40')} - 4",
    "raw_hurst": f"{_mean('l_linenumber * 10')} / 140 + 0.5",
    "raw_err": f"{_mean('(l_partkey * 3 + l_linenumber) % 11')} - 0.5",
    "raw_crater": _mean("l_linenumber * 40"),
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per region: size, resolution and origin. Origins differ, and the last of four holds the pole."""
    k = F.floor(F.col("l_orderkey") / ORDERS_PER_REGION).cast("int")
    return (
        table(spark, sf_dir, "lineitem").select(k.alias("k")).distinct()
        .select(
            F.concat(F.lit("R"), F.col("k").cast("string")).alias("region"),
            F.lit(SIDE).alias("height"), F.lit(SIDE).alias("width"), F.lit(RESOLUTION_M).alias("resolution_m"),
            F.lit(-20000.0).alias("origin_x"), (150000.0 - 38400.0 * (F.col("k") % 4)).alias("origin_y"),
        )
    )


def sparse_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells that have data, straight from the item table: one partial aggregate and one shuffle."""
    return (
        table(spark, sf_dir, "lineitem")
        .groupBy(
            F.concat(F.lit("R"), F.floor(F.col("l_orderkey") / ORDERS_PER_REGION).cast("string")).alias("region"),
            F.expr(ROW).alias("row"), F.expr(COL).alias("col"),
        )
        .agg(*[F.expr(text).alias(name) for name, text in LAYERS.items()])
    )


def dense_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return densify(sparse_cells(spark, sf_dir), regions(spark, sf_dir))


# one rover request per brand and region, over the whole part table
MISSION_FIELDS = {
    "mission_id": "p_brand || '/' || region",
    "rover_name": "'Rover ' || CAST(b AS VARCHAR(12))",
    "mission_type": "CASE b % 3 WHEN 0 THEN 'water_ice' WHEN 1 THEN 'geological' ELSE 'atmospheric' END",
    "power_source": "CASE b % 2 WHEN 0 THEN 'solar' ELSE 'rtg' END",
    "psr_intent": "CASE CAST(floor(b / 3) AS INT) % 3 WHEN 0 THEN 'rim' WHEN 1 THEN 'enter' ELSE 'avoid' END",
    "max_slope_deg": "CAST(10 + b % 15 AS DOUBLE)",
    "min_flat_radius_m": "CAST(600 * (1 + b % 3) AS DOUBLE)",
    "priority": "CAST(b % 11 AS DOUBLE) / 10",
    "speed_kmh": "CAST(1 + b % 10 AS DOUBLE) / 10",
    "battery_wh": "CAST(200 + 150 * (b % 8) AS DOUBLE)",
    "solar_panel_w": "CAST(30 + 40 * (b % 6) AS DOUBLE)",
    "mission_day": "CAST(b AS DOUBLE) + 0.4",
    "wheel_radius_m": "CAST(5 + 5 * (b % 5) AS DOUBLE) / 100",
    "wheel_width_m": "CAST(5 + b AS DOUBLE) / 100",
    "rover_mass_kg": "CAST(26 + 20 * b AS DOUBLE)",
    "n_wheels": "4 + 2 * (b % 2)",
    "n_results": "1 + b % 10",
    "n_parts": "n_parts",
    "target_lat": "CASE WHEN b % 5 = 0 THEN CAST(-86 AS DOUBLE) END",
    "target_lon": "CASE WHEN b % 5 = 0 THEN CAST(5 * b AS DOUBLE) END",
}


def missions(spark: SparkSession, sf_dir: str, grids: DataFrame) -> DataFrame:
    n = grids.count()
    groups = (
        table(spark, sf_dir, "part")
        .groupBy(
            "p_brand", F.expr("CAST(substr(p_brand, 7) AS INT)").alias("b"),
            F.concat(F.lit("R"), (F.col("p_partkey") % n).cast("string")).alias("region"),
        )
        .agg(F.count(F.lit(1)).alias("n_parts"))
    )
    bits = [
        F.when(F.floor(F.col("b") / 2**i) % 2 == 1, F.lit(name))
        for i, name in enumerate(
            ["volatile_detection", "mineralogy", "thermal_environment", "geomorphology", "space_weathering"]
        )
    ]
    return groups.select(
        "region", *[F.expr(t).alias(c) for c, t in MISSION_FIELDS.items()],
        F.array_compact(F.array(*bits)).alias("science_experiments"),
    )


def route_steps(spark: SparkSession, sf_dir: str, n_regions: int) -> DataFrame:
    """One given route per user; steps jump, so that they also cover non-adjacent moves. Users map to a region and to the
    rover request that drives it. Positions are counted hour by hour, so one busy user is no single task."""
    events = table(spark, sf_dir, "events").select("user_id", "event_id", "ts")
    hour = F.date_trunc("hour", "ts")
    numbered = ordered_index(events, ["user_id"], hour, ["ts", "event_id"], "step")
    region = F.concat(F.lit("R"), (F.col("user_id") % n_regions).cast("string"))
    return numbered.select(
        F.col("user_id").alias("route_id"), region.alias("region"),
        F.concat(F.lit("Brand#"), (1 + F.col("user_id") % 25).cast("string"), F.lit("/"), region).alias("mission_id"),
        "step", ((F.col("event_id") * 7) % SIDE).cast("int").alias("row"), ((F.col("event_id") * 13) % SIDE).cast("int").alias("col"),
    )
