"""Neighbourhood layers, decoded layers, scores and the science map."""

from __future__ import annotations

from pyspark.sql import functions as F

from selenogrid.functions.decode import decode_layers
from selenogrid.operators import neighbourhood as nb
from selenogrid.operators import scoring
from selenogrid.plans import score_steps  # noqa: F401
from selenogrid.plans.registry import query

KEY = ["region", "row", "col"]


def rounded(df, keys, cols, digits=6):
    return df.select(*keys, *[F.round(c, digits).alias(c) for c in cols])


def rounded_sql(src, keys, cols, digits=6):
    return f"SELECT {', '.join(keys)}, {', '.join(f'round({c}, {digits}) AS {c}' for c in cols)} FROM {src}"


DECODED = ["psr", "coltemp", "crater_density", "minirf_cpr", "mas_57m", "mas_225m", "mas_560m", "hurst", "ldsm_err",
           "freshness", "spectral_slope"]


@query("decode_layers", rounded_sql("decoded2", KEY, DECODED), ["decoded2"])
def decoded(ws):
    return rounded(decode_layers(ws.cells), KEY, DECODED)


LAYER_COLS = ["rough_var", "grad_elev", "grad_slope", "grad_illum", "rim_mult", "depression", "sun_proxy", "elev_z",
              "contrast", "mean_slope", "std_elev", "prom_1", "prom_2", "prom_3", "rough_z", "softness", "shadow_m", "lat"]


@query("neighbourhood_layers", rounded_sql("layers", KEY, LAYER_COLS), ["layers"])
def neighbourhood_layers(ws):
    return rounded(scoring.mission_layers(ws.decoded, 600.0, ws.radii), KEY, LAYER_COLS)


@query("neighbourhood_layers_proxy", rounded_sql("layers_px", KEY, LAYER_COLS), ["layers_px"])
def neighbourhood_layers_proxy(ws):
    return rounded(ws.proxy_layers, KEY, LAYER_COLS)


SCORES = ["safety", "mission", "final", "science", "mobility_risk"]
MKEY = ["mission_id", "row", "col"]


@query("score_terrain", rounded_sql("scores", MKEY, SCORES), ["scores"])
def score_terrain(ws):
    return rounded(scoring.score_terrain(ws.layers, ws.missions, ws.radii), MKEY, SCORES)


@query("score_terrain_proxy", rounded_sql("scores_px", MKEY, SCORES), ["scores_px"])
def score_terrain_proxy(ws):
    return rounded(scoring.score_terrain(ws.proxy_layers, ws.missions, ws.radii), MKEY, SCORES)


@query("score_terrain_without_mobility", rounded_sql("scores_nomob", MKEY, ["safety", "final"]), ["scores_nomob"])
def score_terrain_without_mobility(ws):
    return rounded(
        scoring.score_terrain(ws.layers, ws.missions, ws.radii, with_mobility=False), MKEY, ["safety", "final"]
    )


SUBS = ["slope_sub", "rough_sub", "qual_sub", "flat_sub", "prom_sub", "rim_mult"]


@query("score_parts", rounded_sql("scores_sub", MKEY, SUBS), ["scores_sub"])
def score_parts(ws):
    return rounded(scoring.sub_scores(scoring.mission_cells(ws.layers, ws.missions, ws.radii)), MKEY, SUBS)


@query("stencil_gradients", rounded_sql("layers", KEY, ["grad_elev", "grad_slope"]), ["layers"])
def stencil_gradients(ws):
    work = nb.attach(ws.decoded.withColumn("sunlight", F.col("illumination")), nb.facts(
        ws.decoded.withColumn("sunlight", F.col("illumination"))))
    out = nb.derive(work, [nb.gradient("grad_elev", nb.filled("elevation")), nb.gradient("grad_slope", F.col("slope"))])
    return rounded(out, KEY, ["grad_elev", "grad_slope"])
