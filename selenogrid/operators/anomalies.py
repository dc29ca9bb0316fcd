"""Anomalous terrain: features, clusters, and what each cluster is good for."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from selenogrid.functions import geo
from selenogrid.operators import neighbourhood as nb
from selenogrid.operators.cluster import density_cluster, standardize
from selenogrid.operators.grid import GEOMETRY
from selenogrid.operators.quantiles import attach, region_stats

FEATURES = ["elev_z", "rough_z", "grad_slope", "contrast"]
EPS = 0.18
MIN_SAMPLES = 10
MIN_CELLS = 5
# fixed values: anomaly type to the missions it serves
RECOMMENDED = {
    "THERMAL_PROXY": ["water_ice", "geological"], "ELEVATION_ANOMALY": ["geological", "atmospheric"],
    "ROUGHNESS_ANOMALY": ["geological"], "SLOPE_TRANSITION": ["geological", "atmospheric"],
}


def feature_layers(terrain: DataFrame) -> DataFrame:
    """The layers of :data:`FEATURES` alone, for jobs that read no other; the same values as among all mission layers."""
    narrow = terrain.select("region", *GEOMETRY, "row", "col", "elevation", "slope", "roughness")
    known = region_stats(narrow, {"elevation_mean": F.avg("elevation"), "roughness_mean": F.avg("roughness"), "roughness_std": F.stddev_pop("roughness")})
    found = nb.derive(attach(narrow, known), [nb.gradient("grad_slope", F.col("slope")), nb.elevation_zscore(), nb.contrast()])
    return found.withColumn("rough_z", nb.roughness_zscore())


def cell_points(layers: DataFrame) -> DataFrame:
    """Cells as points; the id is the position in scan order."""
    return layers.select("region", (F.col("row").cast("long") * F.col("width") + F.col("col")).alias("id"), "row", "col", *FEATURES)


def sample(points: DataFrame, n: int, seed: int = 42) -> DataFrame:
    """The sampling operator: the same ``n`` rows on every run, spread by hash."""
    return points.orderBy(F.xxhash64("region", "row", "col", F.lit(seed)), "region", "id").limit(n)


def cluster_cells(points: DataFrame, eps: float = EPS, min_samples: int = MIN_SAMPLES) -> DataFrame:
    scaled = standardize(points, FEATURES, ["region"])
    return density_cluster(scaled.select("region", "id", *FEATURES), FEATURES, eps, min_samples, ["region"])


def kind(dominant: Column, elevation: Column) -> Column:
    return (
        F.when((dominant == 1) & (elevation < -3000.0), "THERMAL_PROXY").when(dominant.isin(1, 4), "ELEVATION_ANOMALY")
        .when(dominant == 2, "ROUGHNESS_ANOMALY").otherwise("SLOPE_TRANSITION")
    )


def recommended(anomaly_type: Column) -> Column:
    table = F.create_map(*[x for t, m in RECOMMENDED.items() for x in (F.lit(t), F.array(*[F.lit(i) for i in m]))])
    return table[anomaly_type]


def summarize(points: DataFrame, clusters: DataFrame, cells: DataFrame) -> DataFrame:
    """One row per cluster of at least five cells: rounded centroid, dominant raw feature, its mean as strength."""
    members = points.join(clusters.filter("cluster IS NOT NULL"), ["region", "id"])
    sums = members.groupBy("region", "cluster").agg(
        F.count(F.lit(1)).alias("pixel_count"),
        F.bround(F.sum("row") / F.count(F.lit(1))).cast("int").alias("row"),
        F.bround(F.sum("col") / F.count(F.lit(1))).cast("int").alias("col"),
        F.array(*[F.avg(f) for f in FEATURES]).alias("means"),
    ).filter(F.col("pixel_count") >= MIN_CELLS)
    at = sums.join(cells.select("region", "row", "col", "elevation", "resolution_m", "origin_x", "origin_y"), ["region", "row", "col"])
    lon, lat = geo.cell_to_lonlat(*[F.col(c) for c in ("row", "col", "resolution_m", "origin_x", "origin_y")])
    top = F.array_max("means")
    dominant = F.array_position(F.col("means"), top)
    return at.select(
        "region", "cluster", "row", "col", lat.alias("lat"), lon.alias("lon"), "pixel_count",
        kind(dominant, F.col("elevation")).alias("anomaly_type"), top.alias("anomaly_strength"),
    ).withColumn("recommended_for", recommended(F.col("anomaly_type")))
