"""Areal rainfall and half-month climate of catchments."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catchwise.functions.calendar import halfmonth_days, period, period_start
from catchwise.runtime import cut, small

#: Rain of at most so many rows is sent to the weights; one task then makes about so many weighted rows.
SENT_ROWS, TASK_ROWS = 250_000, 2_000_000
MIN_COVERAGE = 0.95
WET_DAY_MM = 1.0


def areal_rain(rain: DataFrame, weights: DataFrame, areas: DataFrame, time_cols: list[str]) -> DataFrame:
    """Area-weighted mean per catchment and time step, with coverage of the whole catchment.

    ``rain``: ``cell, mm`` and ``time_cols``; ``weights``: ``point_id, cell, w``;
    ``areas``: ``point_id, area``.  Missing cells shrink the coverage, never the rain to zero.
    Weights times steps is far more than either table: where the rain is counted to be small, catchments
    are spread over as many tasks as that product needs, and their sums need no further shuffle.
    """
    valid = F.col("mm").isNotNull() & ~F.isnan("mm")
    rain, weights = cut(rain.select("cell", "mm", *time_cols)), weights.filter("w > 0")
    size = rain.groupBy("cell").count().agg(F.sum("count").alias("rows"), F.max("count").alias("steps")).first()
    if (size["rows"] or 0) <= SENT_ROWS:
        tasks = max(int(rain.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(weights.count() * (size["steps"] or 0) / TASK_ROWS))
        joined = weights.repartition(tasks, "point_id").join(F.broadcast(rain), "cell")
    else:
        joined = rain.join(small(weights), "cell")
    per_step = joined.groupBy("point_id", *time_cols).agg(
        F.sum(F.when(valid, F.col("w"))).alias("_area"), F.sum(F.when(valid, F.col("w") * F.col("mm"))).alias("_wet"),
        F.count_if((F.col("mm") < 0) | (F.col("mm") == float("inf"))).alias("invalid_cells"))
    return per_step.join(small(areas), "point_id").select(
        "point_id", *time_cols, (F.col("_wet") / F.col("_area")).alias("mm"),
        F.least(F.lit(1.0), F.coalesce("_area", F.lit(0.0)) / F.col("area")).alias("coverage"), "invalid_cells")


def split_coverage(areal: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Accepted and rejected steps: coverage of at least 95 % and no invalid cell."""
    ok = (F.col("coverage") >= MIN_COVERAGE) & (F.col("invalid_cells") == 0)
    return areal.filter(ok), areal.filter(~ok)


def annual_mean(areal: DataFrame) -> DataFrame:
    """Mean annual rain of each catchment from half-month means."""
    return areal.groupBy("point_id").agg(
        F.min("coverage").alias("coverage_min"), (F.sum("mm") / F.count_distinct("year")).alias("mean_annual_mm"))


def trim_tail(daily: DataFrame) -> DataFrame:
    """Mark each day: kept, trimmed tail, inner gap (error) or partial tail (error)."""
    good = F.col("coverage") >= MIN_COVERAGE
    last = daily.groupBy("point_id").agg(F.max(F.when(good, F.col("date"))).alias("_last"))
    after = F.col("_last").isNull() | (F.col("date") > F.col("_last"))
    return daily.join(last, "point_id").select(
        *daily.columns,
        F.when(~after & good, "kept").when(~after, "error_inner_gap").when(F.col("coverage") > 0, "error_partial_tail")
        .otherwise("trimmed").alias("tail_status"))


def halfmonth(daily: DataFrame) -> DataFrame:
    """Daily ``point_id, date, p_mm, et0_mm`` to complete half-months.

    A period enters only when every one of its days carries both values.
    """
    keyed = daily.select("point_id", F.year("date").alias("year"), period(F.col("date")).alias("period"), "date", "p_mm", "et0_mm")
    both = F.col("p_mm").isNotNull() & F.col("et0_mm").isNotNull()
    agg = keyed.groupBy("point_id", "year", "period").agg(
        F.count_if(both).cast("int").alias("_seen"), F.sum("p_mm").alias("p_mm"), F.sum("et0_mm").alias("et0_mm"),
        F.count_if(F.col("p_mm") >= WET_DAY_MM).cast("int").alias("wet_days"))
    days = halfmonth_days(F.col("year"), F.col("period"))
    return agg.filter(F.col("_seen") == days).select(
        "point_id", "year", "period", period_start(F.col("year"), F.col("period")).alias("start"), days.alias("days"),
        "p_mm", "et0_mm", "wet_days")


def halfmonth_problems(daily: DataFrame, climate: DataFrame) -> DataFrame:
    """Points whose climate cannot drive a model: bad start day, inner gap, under 24 periods."""
    starts = daily.groupBy("point_id").agg(F.min("date").alias("first"))
    step = F.col("year") * 24 + F.col("period")
    spans = climate.groupBy("point_id").agg(F.count("*").alias("n"), (F.max(step) - F.min(step) + 1).alias("span"))
    return starts.join(spans, "point_id", "left").select("point_id", F.when(~F.day("first").isin(1, 16), "start_not_1_or_16")
        .when(F.coalesce("n", F.lit(0)) < 24, "under_24_periods").when(F.col("n") != F.col("span"), "inner_gap").alias("reason")
    ).filter("reason is not null")


def halfmonth_cells(daily: DataFrame) -> DataFrame:
    """Per-cell half-month totals; NULL unless every day of the period is valid."""
    keyed = daily.select("cell", F.year("date").alias("year"), period(F.col("date")).alias("period"), "mm")
    agg = keyed.groupBy("cell", "year", "period").agg(F.count("mm").alias("_n"), F.sum("mm").alias("_mm"))
    days = halfmonth_days(F.col("year"), F.col("period"))
    return agg.select("cell", "year", "period", F.when(F.col("_n") == days, F.col("_mm")).alias("mm"))


def top_cells(rain: DataFrame, n: int = 30) -> DataFrame:
    """Highest cell values, value descending then position, with a domain-edge flag."""
    edge = rain.agg(F.min("row").alias("r0"), F.max("row").alias("r1"), F.min("col").alias("c0"), F.max("col").alias("c1"))
    top = rain.filter("mm is not null").orderBy(F.desc("mm"), "date", "row", "col").limit(n)
    return top.join(F.broadcast(edge)).select(
        "date", "row", "col", "mm",
        (F.col("row").isin(F.col("r0"), F.col("r1")) | F.col("col").isin(F.col("c0"), F.col("c1"))).alias("on_edge"))


def top_domain_means(rain: DataFrame, n: int = 30) -> DataFrame:
    """Highest domain means with cosine-latitude weights and the count of valid cells."""
    w = F.cos(F.radians("lat"))
    ok = F.col("mm").isNotNull()
    return rain.groupBy("date").agg(
        (F.sum(F.when(ok, w * F.col("mm"))) / F.nullif(F.sum(F.when(ok, w)), F.lit(0.0))).alias("mean_mm"), F.count("mm").alias("valid_cells"),
        F.count("*").alias("cells")).orderBy(F.desc("mean_mm"), "date").limit(n)
