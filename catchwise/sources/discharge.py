"""Half-monthly discharge records: wide sheets in, long rows out, bad input set aside."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PERIODS = 24
FIRST_YEAR = 1000


def ingest_discharge(wide: DataFrame, *, allow_missing: bool = False, current_year=None) -> tuple[DataFrame, DataFrame]:
    """Split ``(gauge, year, v array<double>)`` into accepted long rows and rejected sheets rows.

    Rules: a wholly blank row is skipped; the year is a whole number from 1000 to the
    current one and unique per gauge; 24 values; each finite and >= 0; blanks only with
    ``allow_missing``, and then at least one value per gauge.  Missing stays NULL.
    """
    now = F.year(F.current_date()) if current_year is None else F.lit(current_year)
    year = F.col("year").cast("double")
    bad_value = F.exists("v", lambda x: x.isNotNull() & (F.isnan(x) | (x < 0) | (F.abs(x) == float("inf"))))
    blanks = F.exists("v", lambda x: x.isNull())
    rows = wide.filter(~(F.col("year").isNull() & F.forall("v", lambda x: x.isNull())))
    checked = rows.withColumn("reason", (
        F.when(year.isNull() | (F.floor(year) != year) | (year < FIRST_YEAR) | (year > now), "year_invalid")
        .when(F.size("v") != PERIODS, "not_24_periods")
        .when(bad_value, "value_invalid")
        .when(F.lit(not allow_missing) & blanks, "value_missing")
    ))
    repeats = rows.groupBy("gauge", "year").agg(F.count("*").alias("_n")).filter("_n > 1").select("gauge", "year", F.lit(True).alias("_dup"))
    checked = checked.join(repeats, ["gauge", "year"], "left").withColumn(
        "reason", F.coalesce("reason", F.when(F.col("_dup"), "year_duplicate"))).drop("_dup")
    if allow_missing:
        empty = rows.groupBy("gauge").agg(F.bool_and(F.forall("v", lambda x: x.isNull())).alias("_empty"))
        checked = checked.join(empty, "gauge", "left").withColumn(
            "reason", F.coalesce("reason", F.when(F.col("_empty"), "no_observation"))).drop("_empty")
    rejected = checked.filter("reason is not null")
    accepted = checked.filter("reason is null").select("gauge", F.col("year").cast("int").alias("year"), F.posexplode("v").alias("period", "q"))
    return accepted, rejected


def strict(accepted: DataFrame, rejected: DataFrame) -> DataFrame:
    """Raise on the first rejected row instead of setting it aside."""
    first = rejected.select("gauge", "year", "reason").limit(1).collect()
    if first:
        raise ValueError(f"discharge of {first[0]['gauge']} {first[0]['year']}: {first[0]['reason']}")
    return accepted


def wide_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    """Turn 24 value columns in calendar order into the array form; order is checked."""
    if len(columns) != PERIODS:
        raise ValueError("24 half-month columns are required, in calendar order")
    present = [c for c in df.columns if c in columns]
    if present != list(columns):
        raise ValueError("half-month columns are missing or out of order")
    return df.select("gauge", "year", F.array(*[F.col(c).cast("double") for c in columns]).alias("v"))


def to_wide(df: DataFrame, keys: list[str], value: str = "q") -> DataFrame:
    """Year x 24 matrix; periods without a value stay NULL."""
    return df.groupBy(*keys, "year").pivot("period", list(range(PERIODS))).agg(F.first(value))


def upload_statistics(df: DataFrame) -> DataFrame:
    """Missing count of each gauge: years x 24 minus the observed values."""
    return df.groupBy("gauge").agg(
        F.count_distinct("year").alias("years"), F.count("q").alias("observed")
    ).withColumn("missing_count", F.col("years") * PERIODS - F.col("observed"))


def union_sheets(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), frames)
