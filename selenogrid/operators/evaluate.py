"""Statistics, percentiles, stability and verdicts over scores, sites and published places."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from selenogrid.operators.quantiles import average_ranks, running_counts

# fixed values: weights of slope, roughness, quality, flatness, prominence
WEIGHT_VARIANTS = {
    "BASELINE": (0.35, 0.25, 0.20, 0.05, 0.15), "VARIANT_1": (0.45, 0.25, 0.20, 0.05, 0.05),
    "VARIANT_2": (0.25, 0.35, 0.20, 0.05, 0.15), "VARIANT_3": (0.35, 0.25, 0.30, 0.05, 0.05),
    "VARIANT_4": (0.35, 0.15, 0.20, 0.15, 0.15), "VARIANT_5": (0.45, 0.25, 0.10, 0.05, 0.15),
    "VARIANT_6": (0.35, 0.35, 0.10, 0.05, 0.15), "VARIANT_7": (0.25, 0.25, 0.20, 0.05, 0.25),
}


def layer_statistics(cells: DataFrame, layers: Sequence[str], by: Sequence[str] = ("region",)) -> DataFrame:
    """Count, share of nodata, least, greatest and mean of every layer, long form, from one aggregate."""
    aggs = [F.struct(F.lit(n).alias("layer"), F.count(n).alias("n"),
                     (100.0 * F.avg(F.col(n).isNull().cast("int"))).alias("nodata_pct"), F.min(n).alias("lo"),
                     F.max(n).alias("hi"), F.avg(n).alias("mean")).alias(n) for n in layers]
    return cells.groupBy(*by).agg(*aggs).select(*by, F.explode(F.array(*layers)).alias("x")).select(*by, "x.*")


def percentile_of_score(points: DataFrame, population: DataFrame, score: str, by: Sequence[str], keep: Sequence[str]) -> DataFrame:
    """100 x share of the population (already limited to passable cells) that does not exceed each point's score.

    Points take their place among the counts of the population's values, as values that count nothing; they never meet its rows.
    """
    by = list(by)
    asked = points.select(*by, *keep, F.col(score).cast("double").alias("_s")).distinct()
    values = population.select(*by, F.col(score).cast("double").alias("_v"), F.lit(1).alias("_w")).unionByName(
        asked.select(*by, F.col("_s").alias("_v"), F.lit(0).alias("_w")))
    ranks = running_counts(values, F.col("_v"), by, F.col("_w")).select(*by, F.col("v").alias("_s"), "upto")
    sizes = population.filter(F.col(score).isNotNull()).groupBy(*by).agg(F.count(F.lit(1)).alias("_n"))
    placed = asked.join(sizes, by).join(ranks, [*by, "_s"], "left")
    return placed.select(*by, *keep, "_s", (100.0 * (F.col("upto") / F.col("_n"))).alias("percentile"))


def spearman(df: DataFrame, a: str, b: str, by: Sequence[str]) -> DataFrame:
    """Rank correlation with tie-averaged ranks; nothing is sampled."""
    ranked = average_ranks(average_ranks(df, a, "_ra", by), b, "_rb", by)
    return ranked.groupBy(*by).agg(F.corr("_ra", "_rb").alias("spearman"))


def stability_overlap(sites: DataFrame, variant: str, baseline: str, by: Sequence[str], max_dist: float) -> DataFrame:
    """Baseline sites that have a site of the variant nearer than ``max_dist`` cells."""
    base = sites.filter(F.col(variant) == baseline).select(*by, F.col("rank").alias("b_rank"), F.col("row").alias("b_row"), F.col("col").alias("b_col"))
    others = sites.filter(F.col(variant) != baseline)
    near = base.join(others, list(by)).filter(F.hypot(F.col("row") - F.col("b_row"), F.col("col") - F.col("b_col")) < max_dist)
    hit = near.select(*by, variant, "b_rank").distinct().groupBy(*by, variant).agg(F.count(F.lit(1)).alias("overlap"))
    return others.select(*by, variant).distinct().join(hit, [*by, variant], "left").fillna({"overlap": 0})


def sensitivity_verdict(overlap: Column, rho: Column) -> Column:
    return F.when((overlap >= 8.0) & (rho >= 0.92), "PASS").when((overlap >= 6.0) & (rho >= 0.80), "WARN").otherwise("FAIL")


def check(name: str, ok: Column, value: Column, expected: str, soft: bool = False) -> Column:
    """One check as a struct; a missed soft check only warns. An unknown outcome counts as missed."""
    miss = "WARN" if soft else "FAIL"
    return F.struct(F.lit(name).alias("check"), F.when(ok, "PASS").otherwise(miss).alias("result"),
                    F.coalesce(value.cast("string"), F.lit("")).alias("value"), F.lit(expected).alias("expected"))


def checks_long(df: DataFrame, keys: Sequence[str], checks: Sequence[Column]) -> DataFrame:
    """One row per check that applies (NULL structs are left out)."""
    return df.select(*keys, F.explode(F.array_compact(F.array(*checks))).alias("c")).select(*keys, "c.*")


def verdict(checks: DataFrame, by: Sequence[str]) -> DataFrame:
    """All pass: PASS; at least half (integer half, at least one): WARN; else FAIL."""
    counts = checks.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.sum((F.col("result") == "PASS").cast("int")).alias("n_pass"))
    half = F.greatest(F.floor(F.col("n") / 2), F.lit(1))
    return counts.withColumn("verdict", F.when(F.col("n_pass") == F.col("n"), "PASS").when(F.col("n_pass") >= half, "WARN").otherwise("FAIL"))


def verdict_of_all(suites: DataFrame, checks: DataFrame, by: Sequence[str]) -> DataFrame:
    """Verdicts of every suite; a suite without checks is WARN."""
    return suites.join(verdict(checks, by), list(by), "left").fillna({"n": 0, "n_pass": 0, "verdict": "WARN"})


def coverage_verdict(final: Column, km: Column, inside: Column) -> Column:
    outside = F.when(km < 500, "COVERAGE_BOUNDARY_MODERATE").otherwise("COVERAGE_BOUNDARY_WEAK")
    return (
        F.when(~inside, outside).when((km < 200) & (final > 0.5), "STRONG").when((km < 500) & (final > 0.3), "MODERATE")
        .when(final > 0.2, "WEAK").otherwise("NOT_VALIDATED")
    )


def ice_site(psr: Column, mission_percentile: Column, volatile: Column) -> dict[str, Column]:
    """Checks of a known ice site; the verdict is by shadow and mission percentile, volatiles are told beside it. Unknown counts as no."""
    dark, ranked = (F.coalesce(c, F.lit(False)) for c in (psr >= 0.5, mission_percentile >= 50.0))
    word = lambda ok: F.when(ok, "PASS").otherwise("FAIL")
    return {"shadow_check": word(dark), "mission_check": word(ranked), "volatile_check": word(F.coalesce(volatile >= 0.3, F.lit(False))),
            "verdict": F.when(dark & ranked, "both").when(dark | ranked, "one").otherwise("none")}


def traverse_verdicts(km: Column, published: Column, tolerance: Column, psr: Column, psr_required: Column) -> dict[str, Column]:
    """Three-valued flags: NULL where a check does not apply; the last one is decided, unknown counting as no."""
    distance = F.when((published > 0) & km.isNotNull(), F.abs(km - published) / published <= tolerance)
    shadow = F.when(psr_required, F.coalesce(psr >= 0.70, F.lit(False)))
    d, s = F.coalesce(distance, F.lit(False)), F.coalesce(shadow, F.lit(False))
    return {"distance_ok": distance, "shadow_ok": shadow,
            "validated": F.when(published.isNull(), s).when(~psr_required, d).otherwise(d & s)}


def inside_outside(df: DataFrame, inside: Column, score: str, by: Sequence[str]) -> DataFrame:
    """Mean, greatest and positive share of a score inside and outside a mask, and the difference of the means."""
    s = F.col(score)
    return df.groupBy(*by).agg(
        F.avg(F.when(inside, s)).alias("mean_inside"), F.avg(F.when(~inside, s)).alias("mean_outside"),
        F.max(F.when(inside, s)).alias("max_inside"), F.avg(F.when(inside, (s > 0).cast("int"))).alias("positive_inside"),
        (F.avg(F.when(~inside, s)) - F.avg(F.when(inside, s))).alias("difference"),
    )


def changed(a: DataFrame, b: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Two runs side by side; NULL equals NULL, and a key missing from one run counts as changed."""
    both = a.select(*keys, F.col(value).alias("with_layers")).join(b.select(*keys, F.col(value).alias("without")), list(keys), "full")
    return both.withColumn("changed", ~F.col("with_layers").eqNullSafe(F.col("without")))


def score_invariants(scores: DataFrame, by: Sequence[str]) -> DataFrame:
    """Ranges, spread, and the counts that must be zero."""
    broken = ~F.col("passable") & (F.col("safety") != 0)
    gate = (F.col("safety") == 0) & (F.col("final") != 0)
    names = ("safety", "mission", "final")
    return scores.groupBy(*by).agg(
        *[F.min(n).alias(f"{n}_lo") for n in names], *[F.max(n).alias(f"{n}_hi") for n in names],
        F.stddev_pop("final").alias("final_spread"), F.sum(broken.cast("int")).alias("impassable_nonzero"),
        F.sum(gate.cast("int")).alias("gate_broken"), F.sum(F.col("passable").cast("int")).alias("n_passable"),
    )


def plausibility(terrain: DataFrame, by: Sequence[str] = ("region",)) -> DataFrame:
    ok = F.col("elevation").isNotNull()
    return terrain.groupBy(*by).agg(
        F.min("elevation").alias("lo"), F.max("elevation").alias("hi"),
        F.avg(F.when(F.col("slope").isNotNull(), (F.col("slope") < 35).cast("int"))).alias("share_below_35"),
        F.avg((~ok).cast("int")).alias("nodata_share"), F.corr("slope", "roughness").alias("slope_rough_corr"),
        F.sum((F.col("slope") < 0).cast("int")).alias("negative_slopes"),
    )


def layer_coverage(cells: DataFrame, layers: Mapping[str, bool], by: Sequence[str] = ("region",)) -> DataFrame:
    """Share in [0, 1] of each layer and, for masks, the share that is neither 0 nor 1."""
    aggs = [F.struct(
        F.lit(n).alias("layer"), F.avg(F.col(n).isNotNull().cast("int")).alias("valid"),
        F.avg(F.when(F.col(n).isNotNull(), F.col(n).between(0, 1).cast("int"))).alias("in_range"),
        (F.avg(F.when(F.col(n).isNotNull(), (~F.col(n).isin(0.0, 1.0)).cast("int"))) if mask else F.lit(None).cast("double")).alias("between"),
    ).alias(n) for n, mask in layers.items()]
    return cells.groupBy(*by).agg(*aggs).select(*by, F.explode(F.array(*layers)).alias("x")).select(*by, "x.*")


def best_and_worst(df: DataFrame, name: str, score: str, by: Sequence[str] = ()) -> DataFrame:
    """Ties go to the first name."""
    return df.groupBy(*by).agg(
        F.max_by(name, F.struct(F.col(score), F.col(name))).alias("best"), F.min_by(name, F.struct(F.col(score), F.col(name))).alias("worst"))


# fixed values: short-range goal offsets in cells, far to near
RIDGE_OFFSETS = [(-100, 0), (100, 0), (0, -100), (0, 100), (-70, 70), (70, -70), (-70, -70), (70, 70), (-50, 0), (50, 0), (0, -50), (0, 50)]


def ridge_goals(starts: DataFrame, terrain: DataFrame, scale: float = 1.0) -> DataFrame:
    """The twelve offsets around a start that lie on passable cells, in the order they are tried."""
    offsets = F.array(*[F.struct(F.lit(i).alias("attempt"), F.lit(int(dr * scale)).alias("dr"), F.lit(int(dc * scale)).alias("dc"))
                        for i, (dr, dc) in enumerate(RIDGE_OFFSETS)])
    moved = starts.select("mission_id", "region", "max_slope_deg", F.explode(offsets).alias("o"), "row", "col").select(
        "mission_id", "region", "max_slope_deg", "o.attempt", (F.col("row") + F.col("o.dr")).alias("row"), (F.col("col") + F.col("o.dc")).alias("col"))
    return moved.join(terrain.select("region", "row", "col", "slope"), ["region", "row", "col"]).filter(
        F.col("slope") <= F.col("max_slope_deg")).select("mission_id", "attempt", "row", "col")
