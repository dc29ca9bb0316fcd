"""Raw counts to physical layers. NULL is nodata throughout."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from selenogrid.functions.numeric import clip, nan_to_null
from selenogrid.operators.quantiles import attach, quantiles

# fixed values: full scales and markers of the source products
NODATA_COUNTS = (0, -32768)
DN_SCALE = 0.5
ILLUMINATION_FULL = 22396.0
EARTH_FULL = 25000.0
SKY_MIN = -31399.0
SKY_RANGE = 33918.0
BYTE_FULL = 255.0
SHADOW_COUNT = 20000
LARGEST_PIXEL_M = 1e7
EMPTY_SCALE = {"minirf_cpr": 1.0, "mas": 40.0, "ldsm_err": 5.0}


def metres(raw: Column, scale: float = DN_SCALE) -> Column:
    return F.when(~raw.isin(*NODATA_COUNTS), raw * scale)


def uploaded_metres(value: Column, kind: Column, header_nodata: Column) -> Column:
    """User grids: float files are metres already, integer files are counts with nodata markers."""
    kept = F.when(header_nodata.isNull() | (value != header_nodata), nan_to_null(value))
    return F.when(kind == "float", kept).otherwise(metres(kept))


def plausible_size(pixel: Column) -> Column:
    """Whether an uploaded grid's signed pixel size can be metres: not zero, not beyond :data:`LARGEST_PIXEL_M`; false where unknown."""
    return F.coalesce((F.abs(pixel) > 0) & (F.abs(pixel) <= LARGEST_PIXEL_M), F.lit(False))


def fraction(raw: Column, full: float, offset: float = 0.0) -> Column:
    return clip((raw - offset) / full, 0.0, 1.0)


def shadow(raw: Column) -> Column:
    """1 in permanent shadow, else 0; nodata counts as lit."""
    return F.when(raw == SHADOW_COUNT, 1.0).otherwise(0.0)


def non_negative(raw: Column) -> Column:
    return F.when(raw >= 0, raw)


def by_p95(raw: Column, p95: Column, empty: float) -> Column:
    return clip(non_negative(raw) / F.greatest(F.coalesce(p95, F.lit(empty)), F.lit(1e-6)), 0.0, 1.0)


def stretch(raw: Column, lo: Column, hi: Column) -> Column:
    """2nd to 98th percentile to [0, 1]; a constant or empty layer is 0 everywhere."""
    return F.when(hi > lo, clip((raw - lo) / F.when(hi > lo, hi - lo), 0.0, 1.0)).otherwise(0.0)


def by_max(raw: Column, top: Column) -> Column:
    return F.when(top > 0, clip(raw / F.when(top > 0, top), 0.0, 1.0)).otherwise(0.0)


def freshness(mas57: Column, mas225: Column) -> Column:
    return clip(mas57 / F.when(mas225 > 0, mas225).otherwise(1e-6), 0.0, 1.0)


def spectral_slope(mas57: Column, mas225: Column) -> Column:
    """Rise of median slope from the 57 m to the 225 m baseline, per e-fold of baseline."""
    return clip((mas225 - mas57 + 1e-6) / F.log(F.lit(225.0) / F.lit(57.0)), 0.0, 1.0)


PRODUCTS = ["minirf_cpr", "mas_57m", "mas_225m", "mas_560m", "hurst", "ldsm_err"]
_RAW = dict(zip(PRODUCTS, ["raw_cpr", "raw_mas57", "raw_mas225", "raw_mas560", "raw_hurst", "raw_err"], strict=True))


def decode_layers(cells: DataFrame) -> DataFrame:
    """Add every decoded layer. All percentile scales of a region come from one aggregate.

    A product that a region lacks altogether becomes 0 there; a hole in a product that is present stays NULL.
    """
    spec = {p: (non_negative(F.col(_RAW[p])), [0.95]) for p in PRODUCTS if p != "hurst"}
    spec["hurst"] = (F.col("raw_hurst"), [0.02, 0.98])
    has = {f"n_{p}": F.count(_RAW[p]) for p in PRODUCTS}
    work = attach(cells, quantiles(cells, spec, aggs={**has, "cpr_top": F.max("raw_cpr")}))
    out = {
        "psr": shadow(F.col("raw_psr")),
        "coltemp": fraction(F.col("raw_coltemp"), BYTE_FULL),
        "crater_density": fraction(F.col("raw_crater"), BYTE_FULL),
    }
    for p in PRODUCTS:
        if p == "hurst":
            value = stretch(F.col("raw_hurst"), F.col("hurst_p2"), F.col("hurst_p98"))
            value = F.when(F.col("raw_hurst").isNotNull(), value)
        else:
            value = by_p95(F.col(_RAW[p]), F.col(f"{p}_p95"), EMPTY_SCALE["mas" if p.startswith("mas") else p])
        out[p] = F.when(F.col(f"n_{p}") == 0, F.lit(0.0)).otherwise(value)
    work = work.select(*cells.columns, *[v.alias(n) for n, v in out.items()])
    return work.withColumn("freshness", freshness(F.col("mas_57m"), F.col("mas_225m"))).withColumn(
        "spectral_slope", spectral_slope(F.col("mas_57m"), F.col("mas_225m"))
    )
