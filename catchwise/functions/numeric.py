"""Number guards, clamps, band classification and rounding."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType


def finite(c: Column, *, positive: bool = False) -> Column:
    """The number, or NULL when it is missing, NaN, infinite or (optionally) not positive."""
    d = c.cast("double")
    ok = d.isNotNull() & ~F.isnan(d) & (F.abs(d) != float("inf"))
    if positive:
        ok = ok & (d > 0)
    return F.when(ok, d)


def param(c: Column, default: float, lo: float | None = None, hi: float | None = None) -> Column:
    """Finite value or the default, clamped to ``[lo, hi]``."""
    out = F.coalesce(finite(c), F.lit(float(default)))
    if lo is not None:
        out = F.greatest(F.lit(float(lo)), out)
    if hi is not None:
        out = F.least(F.lit(float(hi)), out)
    return out


def classify(c: Column, bands: tuple, fallback: str) -> Column:
    """Label of the first band whose ceiling lies above the value; NULL stays NULL."""
    out = None
    for ceiling, label in bands:
        out = (F.when(c < ceiling, label) if out is None else out.when(c < ceiling, label))
    return F.when(c.isNotNull(), out.otherwise(fallback))


# Class bands (fixed values): upper limit, label; last item is the label above all limits.
SHAPE_BANDS = (((0.3, "Sangat memanjang"), (0.5, "Memanjang"), (0.75, "Agak kompak")), "Kompak")
ELONGATION_BANDS = (((0.5, "Sangat memanjang"), (0.7, "Memanjang"), (0.8, "Agak memanjang"), (0.9, "Oval")),
                    "Mendekati membulat")
DENSITY_BANDS = (((1.0, "Rendah"), (2.0, "Sedang"), (3.5, "Tinggi")), "Sangat tinggi")
SLOPE_BANDS = (((8.0, "Datar"), (15.0, "Landai"), (25.0, "Agak curam"), (40.0, "Curam")), "Sangat curam")


def rounded(df: DataFrame, digits: int, only: list[str] | None = None) -> DataFrame:
    """Round every double column (report edge only)."""
    return df.select(*[
        F.round(f.name, digits).alias(f.name)
        if isinstance(f.dataType, (DoubleType, FloatType)) and (only is None or f.name in only) else F.col(f.name)
        for f in df.schema.fields
    ])


def guarded_ratio(a: Column, b: Column) -> Column:
    return a / F.when(b > 0, b)
