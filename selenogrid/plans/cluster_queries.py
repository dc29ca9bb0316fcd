"""Neighbours, density clustering, anomalies."""

from __future__ import annotations

from pyspark.sql import functions as F

from selenogrid.operators import anomalies, cluster
from selenogrid.operators.ordered import positions
from selenogrid.plans.registry import cte, query

F4 = ["f0", "f1", "f2", "f3"]
# the four anomaly features of the cells of all regions together
cte("vec", "SELECT CAST(substr(region, 2) AS BIGINT) * 1000000000000 + row * 64 + col AS id, " + ", ".join(
    f"{c} AS {f}" for f, c in zip(F4, anomalies.FEATURES, strict=True)) + " FROM layers", ["layers"])
cte("vecs", "SELECT id, " + ", ".join(
    f"({f} - avg({f}) OVER ()) / coalesce(nullif(stddev_pop({f}) OVER (), 0), 1) AS {f}" for f in F4) + " FROM vec", ["vec"])


@query("standardize", "SELECT id, round(f0, 5) AS f0, round(f1, 5) AS f1, round(f2, 5) AS f2, round(f3, 5) AS f3 FROM vecs", ["vecs"])
def standardize(ws):
    return ws.vectors_scaled.select("id", *[F.round(f, 5).alias(f) for f in F4])


def pairs_sql(src, by, eps):
    d2 = " + ".join(f"(a.{f} - b.{f}) ** 2" for f in F4)
    on = f"a.{by} = b.{by}" if by else "true"
    keys = f"a.{by}, " if by else ""
    return f"SELECT {keys}a.id AS a, b.id AS b FROM {src} a JOIN {src} b ON {on} AND {d2} <= {eps * eps}"


def dbscan_steps(p: str, src: str, by: str, eps: float, m: int) -> None:
    k, kj = (f"{by}, ", f"{by}, ") if by else ("", "")
    using = f"USING ({by}, id)" if by else "USING (id)"
    same = f"s.{by} = e.{by} AND " if by else ""
    cte(f"{p}_pairs", pairs_sql(src, by, eps), [src])
    cte(f"{p}_core", f"SELECT {k}a AS id FROM {p}_pairs GROUP BY ALL HAVING count(*) >= {m}", [f"{p}_pairs"])
    ca = f"SELECT {by + ', ' if by else ''}id FROM {p}_core"
    both = (f"({by}, a) IN ({ca}) AND ({by}, b) IN ({ca})" if by else f"a IN ({ca}) AND b IN ({ca})")
    cte(f"{p}_edges", f"SELECT {k}a, b FROM {p}_pairs WHERE {both}", [f"{p}_pairs", f"{p}_core"])
    cte(f"{p}_cc", f"""
SELECT {k}id, id AS label FROM {p}_core
UNION ALL
SELECT {f"e.{by}, " if by else ""}e.b, min(s.label) FROM {p}_cc s JOIN {p}_edges e ON {same}e.a = s.id
WHERE s.label < (SELECT r.label FROM recurring.{p}_cc r WHERE {f"r.{by} = e.{by} AND " if by else ""}r.id = e.b) GROUP BY ALL""",
        [f"{p}_core", f"{p}_edges"], head=f"{p}_cc({kj}id, label) USING KEY ({kj}id)")
    near = f"p.{by} = c.{by} AND " if by else ""
    cte(f"{p}_labels", f"""
SELECT {f"s.{by}, " if by else ""}s.id, coalesce(c.label, b.label) AS cluster FROM {src} s LEFT JOIN {p}_cc c {using}
LEFT JOIN (SELECT {f"p.{by}, " if by else ""}p.a AS id, min(c.label) AS label FROM {p}_pairs p JOIN {p}_cc c ON {near}p.b = c.id GROUP BY ALL) b {using}""",
        [src, f"{p}_cc", f"{p}_pairs"])


dbscan_steps("vdb", "vecs", "", 0.18, 10)


@query("density_cluster_vectors", "SELECT id, cluster FROM vdb_labels", ["vdb_labels"])
def density_cluster_vectors(ws):
    return ws.vector_clusters.select("id", "cluster")


cte("kth", """
SELECT a.id, min(sqrt((a.f0 - b.f0) ** 2 + (a.f1 - b.f1) ** 2 + (a.f2 - b.f2) ** 2 + (a.f3 - b.f3) ** 2), 10)[10] AS d
FROM vecs a, vecs b GROUP BY a.id""", ["vecs"])


@query("kth_distance", "SELECT id, round(d, 5) AS d FROM kth", ["kth"])
def kth_distance(ws):
    return ws.vector_kth.select("id", F.round("d", 5).alias("d"))


@query("elbow", """
WITH s AS (SELECT d, row_number() OVER (ORDER BY d DESC) - 1 AS i, count(*) OVER () AS n FROM kth),
w AS (SELECT *, greatest(1, n // 100) AS skip FROM s WHERE i >= greatest(1, n // 100)),
z AS (SELECT *, max(d) OVER () AS hi, min(d) OVER () AS lo FROM w)
SELECT CAST(i AS BIGINT) AS elbow_index, round(d, 5) AS suggested, CASE WHEN abs(round(d, 5) - 0.18) <= 0.2 THEN 'PASS' WHEN abs(round(d, 5) - 0.18) <= 0.4 THEN 'WARN' ELSE 'FAIL' END AS verdict
FROM z ORDER BY abs((d - lo) / (hi - lo) - (1 - (i - skip) / (n - skip - 1)::DOUBLE)) DESC, i LIMIT 1""", ["kth"])
def elbow(ws):
    out = cluster.elbow(ws.vector_kth, "d", ["grp"])
    off = F.abs(F.round("suggested", 5) - 0.18)
    return out.select(F.col("elbow_index").cast("bigint").alias("elbow_index"), F.round("suggested", 5).alias("suggested"),
                      F.when(off <= 0.2, "PASS").when(off <= 0.4, "WARN").otherwise("FAIL").alias("verdict"))


@query("silhouette", """
WITH v AS (SELECT * FROM vecs JOIN vdb_labels USING (id) WHERE cluster IS NOT NULL),
m AS (SELECT a.id, a.cluster AS la, b.cluster AS lb, avg((a.f0 - b.f0) ** 2 + (a.f1 - b.f1) ** 2 + (a.f2 - b.f2) ** 2 + (a.f3 - b.f3) ** 2) AS d
  FROM v a JOIN v b ON a.id <> b.id GROUP BY ALL),
p AS (SELECT id, max(CASE WHEN la = lb THEN d END) AS own, min(CASE WHEN la <> lb THEN d END) AS other FROM m GROUP BY id)
SELECT round(avg(coalesce((other - own) / greatest(own, other), 0)), 6) AS silhouette, count(*) AS n_points FROM p""", ["vecs", "vdb_labels"])
def silhouette(ws):
    """Of the clusters that were found."""
    found = ws.vectors_scaled.join(ws.vector_clusters.select("id", "cluster"), "id")
    return cluster.silhouette(found, F4, "cluster").select(F.round("silhouette", 6).alias("silhouette"), "n_points")


@query("cluster_sizes", """
SELECT coalesce(cluster, -1) AS cluster, count(*) AS n FROM vdb_labels GROUP BY 1""", ["vdb_labels"])
def cluster_sizes(ws):
    return ws.vector_clusters.groupBy(F.coalesce("cluster", F.lit(-1)).alias("cluster")).agg(F.count(F.lit(1)).alias("n"))


dbscan_steps("vdb2", "vecs", "", 0.25, 10)


@query("cluster_sizes_two_eps", """
SELECT '0.18' AS eps, coalesce(cluster, -1) AS cluster, count(*) AS n FROM vdb_labels GROUP BY ALL UNION ALL
SELECT '0.25', coalesce(cluster, -1), count(*) FROM vdb2_labels GROUP BY ALL""", ["vdb_labels", "vdb2_labels"])
def cluster_sizes_two_eps(ws):
    other = cluster.density_cluster(ws.vectors_scaled.select("grp", "id", *F4), F4, 0.25, 10, ["grp"])
    both = ws.vector_clusters.withColumn("eps", F.lit("0.18")).unionByName(other.withColumn("eps", F.lit("0.25")))
    return both.groupBy("eps", F.coalesce("cluster", F.lit(-1)).alias("cluster")).agg(F.count(F.lit(1)).alias("n"))


cte("cellpts", "SELECT region, row * 64 + col AS id, " + ", ".join(
    f"({c} - avg({c}) OVER w) / coalesce(nullif(stddev_pop({c}) OVER w, 0), 1) AS {f}"
    for f, c in zip(F4, anomalies.FEATURES, strict=True)) + " FROM layers WINDOW w AS (PARTITION BY region)", ["layers"])
dbscan_steps("cdb", "cellpts", "region", 0.18, 10)
cte("anomalies", """
SELECT region, cluster, CAST(round_even(sum(row) / count(*), 0) AS INT) AS row, CAST(round_even(sum(col) / count(*), 0) AS INT) AS col, count(*) AS pixel_count,
  greatest(avg(elev_z), avg(rough_z), avg(grad_slope), avg(contrast)) AS strength,
  CASE WHEN avg(elev_z) >= greatest(avg(rough_z), avg(grad_slope), avg(contrast)) THEN 'ELEVATION_ANOMALY'
    WHEN avg(rough_z) >= greatest(avg(grad_slope), avg(contrast)) THEN 'ROUGHNESS_ANOMALY'
    WHEN avg(grad_slope) >= avg(contrast) THEN 'SLOPE_TRANSITION' ELSE 'ELEVATION_ANOMALY' END AS anomaly_type,
  CASE WHEN avg(rough_z) > avg(elev_z) AND avg(rough_z) >= greatest(avg(grad_slope), avg(contrast)) THEN ['geological'] ELSE ['geological', 'atmospheric'] END AS recommended_for
FROM layers l JOIN cdb_labels d ON d.region = l.region AND d.id = l.row * 64 + l.col AND d.cluster IS NOT NULL
GROUP BY l.region, cluster HAVING count(*) >= 5""".replace("SELECT region, cluster, CAST", "SELECT l.region, cluster, CAST", 1), ["layers", "cdb_labels"])


@query("density_cluster_cells", "SELECT region, id, cluster FROM cdb_labels", ["cdb_labels"])
def density_cluster_cells(ws):
    return ws.cell_clusters.select("region", F.col("id").cast("int").alias("id"), F.col("cluster").cast("int").alias("cluster"))


@query("anomalies", """
SELECT region, CAST(cluster AS BIGINT) AS cluster, row, col, pixel_count, round(strength, 5) AS anomaly_strength, anomaly_type,
  array_to_string(recommended_for, ',') AS recommended_for,
  CAST(row_number() OVER (PARTITION BY region ORDER BY round(strength, 5) DESC, cluster) AS INT) AS place FROM anomalies""", ["anomalies"])
def anomaly_list(ws):
    s = F.round("anomaly_strength", 5)
    return positions(ws.anomalies, ["region"], [s.desc(), F.col("cluster")], "place").select("region", "cluster", "row", "col", "pixel_count", s.alias("anomaly_strength"), "anomaly_type",
                               F.concat_ws(",", "recommended_for").alias("recommended_for"), "place")


@query("anomaly_type_counts", "SELECT region, anomaly_type, count(*) AS n FROM anomalies GROUP BY 1, 2", ["anomalies"])
def anomaly_type_counts(ws):
    return ws.anomalies.groupBy("region", "anomaly_type").agg(F.count(F.lit(1)).alias("n"))


@query("sample_cells")
def sample_cells(ws):
    """The sampling operator: 20,000 cells by hash."""
    # the draw reads places only, so no layer is made for it
    places = ws.cells.select("region", (F.col("row").cast("long") * F.col("width") + F.col("col")).alias("id"), "row", "col")
    return anomalies.sample(places, 20_000).select("region", "id")
