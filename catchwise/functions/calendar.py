"""Half-month calendar: 24 periods a year, numbered 0..23."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def period(date: Column) -> Column:
    """Half-month number: days 1-15 are even, the rest of the month odd."""
    return (2 * (F.month(date) - 1) + (F.day(date) >= 16).cast("int")).cast("int")


def halfmonth_days(year: Column, period_no: Column) -> Column:
    """15, or the days left in the month."""
    month = F.floor(period_no / 2) + 1
    last = F.day(F.last_day(F.make_date(year.cast("int"), month.cast("int"), F.lit(1))))
    return F.when(period_no % 2 == 0, 15).otherwise(last - 15).cast("int")


def period_start(year: Column, period_no: Column) -> Column:
    month = (F.floor(period_no / 2) + 1).cast("int")
    return F.make_date(year.cast("int"), month, F.when(period_no % 2 == 0, 1).otherwise(16))


def discharge_from_depth(depth_mm: Column, area_km2: Column, days: Column) -> Column:
    """Runoff depth over an area in a number of days, as m3/s."""
    return depth_mm * area_km2 * 1000.0 / (days * 86400.0)


def depth_from_discharge(q: Column, area_km2: Column, days: Column) -> Column:
    return q * days * 86400.0 / (area_km2 * 1000.0)
