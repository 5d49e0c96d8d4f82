"""Rainfall and reference-evapotranspiration series: validation and long form."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catchwise.operators import ordered


def read_halfmonth_rain(df: DataFrame, unit: str = "mm") -> DataFrame:
    """Problems of a dated half-month raster: day not 1 or 16, repeated or unsorted dates.

    ``df``: ``band, period_start``.  Empty result = valid.
    """
    if unit != "mm":
        raise ValueError("half-month rain must be in mm")
    seq = ordered.neighbours(df, [], ["band"], ["period_start"], ahead=False)
    return seq.select("band", "period_start", F.when(~F.day("period_start").isin(1, 16), "day_not_1_or_16")
                      .when(F.col("prev.period_start") >= F.col("period_start"), "not_ascending").alias("reason")
                      ).filter("reason is not null")


def daily_gaps(df: DataFrame) -> DataFrame:
    """Breaks in a daily date axis (missing or repeated days), one row per break."""
    dates = df.select("date").groupBy("date").agg(F.count("*").alias("n"))
    seq = ordered.neighbours(dates, [], ["date"], ["date"], ahead=False)
    gap = F.datediff("date", F.col("prev.date"))
    return seq.select("date", F.coalesce(gap, F.lit(1)).alias("gap_days"), "n").filter("gap_days <> 1 or n > 1")


def read_daily_rain(df: DataFrame, unit: str = "mm") -> DataFrame:
    """Long daily rain ``(date, cell, mm)``: NaN and fill become NULL; negatives raise."""
    if unit.lower() not in ("mm", "mm/day", "mm/d"):
        raise ValueError("daily rain must be in mm per day")
    mm = F.when(F.isnan("mm"), None).otherwise(F.col("mm"))
    return df.withColumn("mm", F.when((mm < 0) | (mm == float("inf")), F.raise_error(F.lit("negative or infinite rain"))).otherwise(mm))


def date_spine(df: DataFrame, start: str = "start", end: str = "end") -> DataFrame:
    """One row per point and day from ``start`` to ``end``."""
    return df.select("point_id", F.explode(F.sequence(F.col(start), F.col(end))).alias("date"))


def et0_problems(et0: DataFrame, span: DataFrame, unit: str = "mm") -> DataFrame:
    """Days without a usable value: missing from the series, NULL, NaN, infinite or negative.

    ``et0``: ``point_id, date, et0_mm``; ``span``: ``point_id, start, end``.  A partial
    series is refused as a whole, so any row returned here rejects its point.
    """
    if unit != "mm":
        raise ValueError("ET0 must be in mm")
    want = date_spine(span)
    joined = want.join(et0, ["point_id", "date"], "left")
    v = F.col("et0_mm")
    return joined.select("point_id", "date", F.when(v.isNull(), "missing").when(F.isnan(v) | (F.abs(v) == float("inf")), "not_finite")
                         .when(v < 0, "negative").alias("reason")).filter("reason is not null")
