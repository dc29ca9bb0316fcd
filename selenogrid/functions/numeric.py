"""Column helpers with the engine's NULL rules: NULL is nodata and propagates unless a function says otherwise."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clip(x: Column, lo: float, hi: float | None) -> Column:
    """Bound ``x``; NULL stays NULL (``greatest`` and ``least`` alone would drop it)."""
    bounded = F.greatest(F.lit(lo), x) if hi is None else F.greatest(F.lit(lo), F.least(F.lit(hi), x))
    return F.when(x.isNotNull(), bounded)


def nan_to_null(x: Column) -> Column:
    """Ingest rule: NaN is never stored."""
    return F.when(~F.isnan(x), x)


def zero_if_null(x: Column) -> Column:
    return F.coalesce(x, F.lit(0.0))


def or_one(scale: Column) -> Column:
    """A normaliser that is tiny or absent counts as 1."""
    return F.when(scale > 1e-6, scale).otherwise(F.lit(1.0))


def truth(pred: Column) -> Column:
    """Comparison with nodata is false."""
    return F.coalesce(pred, F.lit(False))


def floor_div(x: Column, n: int | Column) -> Column:
    return F.floor(x / n).cast("int")


def steady_round(x: Column, digits: int) -> Column:
    """Round through a decimal, so that noise far below the shown digits cannot tip a half."""
    return F.round(x.cast("decimal(28,9)"), digits).cast("double")
