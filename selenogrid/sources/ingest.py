"""Loading layers into the cell table, and the checks around it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

TILE_SCHEMA = T.StructType([
    T.StructField("region", T.StringType()), T.StructField("tile_r", T.IntegerType()),
    T.StructField("tile_c", T.IntegerType()), T.StructField("layer", T.StringType()),
    T.StructField("values", T.ArrayType(T.DoubleType())),
])
CRATER_SCHEMA = "id STRING, lat DOUBLE, lon DOUBLE, diam_km DOUBLE, remark STRING"

# fixed values: layers a region may have, and whether analysis needs them
LAYER_INVENTORY = [
    ("elevation", True), ("quality", False), ("illumination", False), ("psr", False), ("earth_visibility", False),
    ("sky_visibility", False), ("minirf_cpr", False), ("mas_57m", False), ("mas_225m", False), ("mas_560m", False),
    ("hurst", False), ("ldsm_err", False), ("m3_oh_band", False),
]


def tiles_to_cells(tiles: DataFrame, tile: int) -> DataFrame:
    """Import form to long cells. Values lie row by row inside their tile."""
    return tiles.select(
        "region", "layer", "tile_r", "tile_c", F.posexplode("values").alias("i", "value")
    ).select(
        "region", "layer", (F.col("tile_r") * tile + F.floor(F.col("i") / tile)).cast("int").alias("row"),
        (F.col("tile_c") * tile + F.col("i") % tile).cast("int").alias("col"), "value",
    )


def cells_to_tiles(cells: DataFrame, layers: list[str], tile: int) -> DataFrame:
    """The export form; a tile is the largest group. The grid must be dense and its extent a multiple of the tile."""
    long = cells.select(
        "region", "row", "col", F.explode(F.array(*[
            F.struct(F.lit(n).alias("layer"), F.col(n).cast("double").alias("value")) for n in layers
        ])).alias("x")
    )
    cell = F.struct((F.col("row") % tile).alias("r"), (F.col("col") % tile).alias("c"), F.col("x.value").alias("v"))
    groups = long.groupBy(
        "region", F.floor(F.col("row") / tile).cast("int").alias("tile_r"),
        F.floor(F.col("col") / tile).cast("int").alias("tile_c"), F.col("x.layer").alias("layer"),
    ).agg(F.array_sort(F.collect_list(cell)).alias("s"))
    return groups.select("region", "tile_r", "tile_c", "layer", F.transform("s", lambda s: s.v).alias("values"))


def attach_layers(long: DataFrame, layers: list[str]) -> DataFrame:
    """Long cells to one wide row per cell, by one aggregate instead of a join per layer."""
    return long.groupBy("region", "row", "col").agg(
        *[F.max(F.when(F.col("layer") == n, F.col("value"))).alias(n) for n in layers]
    )


def load_region(cells: DataFrame, regions: DataFrame, key: str) -> DataFrame:
    """Cells of one region; an unknown key is an error. The filter reaches the scan."""
    if not regions.filter(F.col("region") == key).limit(1).count():
        raise ValueError(f"unknown region {key!r}")
    return cells.filter(F.col("region") == key)


def resolve_layer(caller: DataFrame, bundled: DataFrame, regions: DataFrame, name: str) -> DataFrame:
    """A caller's own layer where the region has one, else the bundled one; whether any exists is a regional flag."""
    own = caller.select("region").distinct().withColumn("own", F.lit(True))
    both = caller.select("region", "row", "col", F.col(name).alias("a")).join(
        bundled.select("region", "row", "col", F.col(name).alias("b")), ["region", "row", "col"], "full"
    )
    held = both.select("region").distinct().withColumn("present", F.lit(True))
    return (
        both.join(own, "region", "left").join(regions.select("region").join(held, "region", "left"), "region", "right")
        .select("region", "row", "col", F.when(F.col("own"), F.col("a")).otherwise(F.col("b")).alias(name),
                F.coalesce("present", F.lit(False)).alias("present"))
    )


def write_by_mission(df: DataFrame, path: str, kind: str = "parquet", buckets: int = 16) -> None:
    """Results of many missions in one folder for each of a few buckets of missions, one file each: not a folder a mission."""
    bucket = F.pmod(F.xxhash64("mission_id"), F.lit(buckets)).cast("int")
    df.withColumn("bucket", bucket).repartition("bucket").write.mode("errorifexists").partitionBy("bucket").format(kind).save(path)


def inventory(spark: SparkSession, cells: DataFrame, regions: DataFrame) -> DataFrame:
    """Expected against present layers of every region."""
    known = [n for n, _ in LAYER_INVENTORY if n in cells.columns]
    counts = cells.groupBy("region").agg(*[F.count(n).alias(n) for n in known])
    entries = F.array(*[F.struct(F.lit(n).alias("layer"), F.col(n).alias("n_values")) for n in known])
    present = counts.select("region", F.explode(entries).alias("x")).select("region", "x.*").filter("n_values > 0")
    expected = spark.createDataFrame(LAYER_INVENTORY, "layer STRING, required BOOLEAN")
    wanted = regions.select("region").join(expected, F.lit(True))
    return wanted.join(present, ["region", "layer"], "left").select(
        "region", "layer", "required", F.coalesce("n_values", F.lit(0)).alias("n_values"),
        F.when(F.col("n_values").isNotNull(), "present").when(F.col("required"), "required missing")
        .otherwise("optional missing").alias("status"),
    )


def read_craters(spark: SparkSession, path: str) -> DataFrame:
    """Three columns of the catalogue; the reader skips the others."""
    return spark.read.schema(CRATER_SCHEMA).option("header", True).csv(path).select("lat", "lon", "diam_km")


MISSION_TYPES = ["water_ice", "geological", "atmospheric"]
POWER_SOURCES = ["rtg", "solar"]
INTENTS = ["rim", "enter", "avoid"]
EXPERIMENT_IDS = ["volatile_detection", "mineralogy", "thermal_environment", "geomorphology", "space_weathering"]
# fixed values: accepted ranges
RANGES = {
    "max_slope_deg": (1, 45), "abs_max_slope_deg": (1, 45), "min_flat_radius_m": (50, 2000), "speed_kmh": (0.01, 10), "battery_wh": (10, 20000),
    "solar_panel_w": (1, 5000), "wheel_radius_m": (0.01, 2), "rover_mass_kg": (1, 5000), "wheel_width_m": (0.01, 1),
    "n_wheels": (1, 12), "priority": (0, 1), "n_results": (1, 10), "mission_duration_days": (1, 365),
}
# fixed values: accepted ranges of what a request may leave out
OPTIONAL_RANGES = {
    "focus_lat_min": (-90, 0), "focus_lat_max": (-90, 0), "focus_center_lat": (-90, 0), "focus_center_lon": (0, 360),
    "focus_radius_km": (1, 2000), "target_lat": (-90, 0), "target_lon": (0, 360),
}
SOLAR_ONLY = ("solar_panel_w", "mission_day")
SYNODIC_DAYS = 29.530589


def mission_errors(missions: DataFrame) -> Column:
    """Names of the fields a mission row gets wrong; an empty list means it is accepted.

    A missing value is wrong, except for the focus, the target, and what only solar rovers need.
    """
    bad = []

    def need(name: str, good: Column, optional: Column | bool = False) -> None:
        absent = F.col(name).isNull() & (F.lit(optional) if isinstance(optional, bool) else optional)
        bad.append(F.when(~(absent | F.coalesce(good, F.lit(False))), F.lit(name)))

    not_solar = F.coalesce(F.col("power_source") != "solar", F.lit(False))
    for c, (lo, hi) in RANGES.items():
        if c in missions.columns:
            need(c, F.col(c).between(lo, hi), not_solar if c in SOLAR_ONLY else False)
    need("mission_day", (F.col("mission_day") >= 0) & (F.col("mission_day") < SYNODIC_DAYS), not_solar)
    for name, allowed in (("mission_type", MISSION_TYPES), ("power_source", POWER_SOURCES), ("psr_intent", INTENTS)):
        need(name, F.col(name).isin(allowed))
    known = F.array(*[F.lit(e) for e in EXPERIMENT_IDS])
    need("science_experiments", F.size(F.array_except("science_experiments", known)) == 0)
    for c, (lo, hi) in OPTIONAL_RANGES.items():
        if c in missions.columns:
            need(c, F.col(c).between(lo, hi), True)
    if "focus_lat_min" in missions.columns:
        bad.append(F.when(F.col("focus_lat_min") >= F.col("focus_lat_max"), F.lit("focus_lat")))
    return F.array_compact(F.array(*bad))


PROFILE_SCHEMA = (
    "rover_name STRING, mission_type STRING, power_source STRING, max_slope_deg DOUBLE, abs_max_slope_deg DOUBLE, "
    "speed_kmh DOUBLE, battery_wh DOUBLE, solar_panel_w DOUBLE, wheel_radius_m DOUBLE, rover_mass_kg DOUBLE, "
    "wheel_width_m DOUBLE, n_wheels INT, mission_duration_days DOUBLE, priority DOUBLE, psr_intent STRING, "
    "science_experiments ARRAY<STRING>"
)
# fixed values: published rover figures
PRESETS = [
    ("pragyan", "Pragyan (Chandrayaan-3)", "ISRO", (
        "Pragyan", "geological", "solar", 12.0, 18.0, 0.1, 54.0, 50.0, 0.075, 26.0, 0.05, 6, 14.0, 0.4, "avoid",
        ["geomorphology", "space_weathering"])),
    ("viper", "VIPER (NASA)", "NASA", (
        "VIPER", "water_ice", "solar", 20.0, 30.0, 0.8, 450.0, 450.0, 0.25, 430.0, 0.20, 6, 100.0, 0.4, "rim",
        ["volatile_detection", "mineralogy"])),
    ("artemis_ltv", "Artemis LTV (NASA)", "NASA", (
        "Artemis LTV", "water_ice", "rtg", 15.0, 22.0, 1.5, 2000.0, 0.0, 0.40, 900.0, 0.30, 6, 14.0, 0.3, "rim",
        ["volatile_detection", "geomorphology"])),
    ("change7", "Chang'e-7 Rover (CNSA)", "CNSA", (
        "Chang'e-7 Rover", "water_ice", "solar", 20.0, 30.0, 0.5, 500.0, 200.0, 0.15, 140.0, 0.12, 6, 90.0, 0.5, "rim",
        ["volatile_detection", "mineralogy"])),
    ("luna27", "Luna-27 (Roscosmos)", "Roscosmos", (
        "Luna-27", "water_ice", "rtg", 20.0, 28.0, 0.3, 800.0, 0.0, 0.20, 200.0, 0.15, 6, 180.0, 0.4, "enter",
        ["volatile_detection", "thermal_environment"])),
    ("custom", "Custom Rover", "", None),
]


def presets(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(
        PRESETS, f"preset_id STRING, preset_name STRING, agency STRING, profile STRUCT<{PROFILE_SCHEMA.replace(' STRING', ': STRING').replace(' DOUBLE', ': DOUBLE').replace(' INT', ': INT').replace(' ARRAY<', ': ARRAY<')}>"
    )


def apply_preset(requests: DataFrame, catalogue: DataFrame) -> DataFrame:
    """Preset figures under the request's mission, power and intent; solar rovers get panel and day, others a larger
    battery; an unknown preset falls back to ``viper``."""
    known = requests.join(catalogue.select("preset_id", F.lit(True).alias("_known")), "preset_id", "left")
    keyed = known.withColumn("preset_id", F.when(F.col("_known"), F.col("preset_id")).otherwise("viper")).drop("_known")
    solar = F.col("power_source") == "solar"
    return keyed.join(catalogue.select("preset_id", "profile"), "preset_id").select(
        *requests.columns, "profile.max_slope_deg", "profile.speed_kmh", "profile.wheel_radius_m",
        F.when(solar, F.col("profile.battery_wh")).otherwise(2000.0).alias("battery_wh"),
        F.when(solar, 50.0).alias("solar_panel_w"), F.when(solar, 7.4).alias("mission_day"),
        F.lit(0.5).alias("priority"),
    )


# fixed values: published elevation products; key, coverage, native and working cell size (m), cells from edge to pole,
# count-to-metre scale, whether the file embeds its own geometry
REGION_CATALOGUE = [
    ("south_pole_75_90", "75-90 S", 30.0, 90.0, None, 1.0, True),
    ("south_pole_80_90", "80-90 S", 20.0, 100.0, 15199.5, 0.5, False),
    ("south_pole_85_90", "85-90 S", 10.0, 30.0, 15167.5, 0.5, False),
    ("south_pole_87_90", "87-90 S", 5.0, 15.0, None, 0.5, True),
]


def region_catalogue(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(
        REGION_CATALOGUE, "region_key STRING, coverage STRING, native_res_m DOUBLE, working_res_m DOUBLE, offset_cells DOUBLE, "
        "dn_scale DOUBLE, embedded BOOLEAN")
