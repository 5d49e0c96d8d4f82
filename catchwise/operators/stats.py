"""Series statistics, dependable-flow curves, volumes and fit metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from catchwise.functions.calendar import halfmonth_days
from catchwise.operators import ordered

# Exceedance percentages reported for every series (fixed values)
EXCEEDANCES = (10, 20, 25, 30, 40, 50, 60, 70, 80, 90, 95)


def weibull_at(sorted_values: Column, exceedance: float) -> Column:
    """Excel-style exclusive quantile of a sorted array; NULL outside the sample."""
    n = F.size(sorted_values)
    rank = (n + 1) * (1 - exceedance / 100)
    pos = F.least(F.greatest(rank, F.lit(1.0)), n.cast("double"))
    lo = F.floor(pos).cast("int")
    a = F.try_element_at(sorted_values, lo)
    b = F.coalesce(F.try_element_at(sorted_values, lo + 1), a)
    return F.when((n > 0) & (rank >= 1 - 1e-12) & (rank <= n + 1e-12), a + (pos - lo) * (b - a))


def basic_stats(value: str = "q") -> list[Column]:
    v = F.col(value)
    mean, std = F.avg(v), F.stddev_samp(v)
    return [F.count(v).alias("count"), F.count_if(v == 0).alias("zero_count"), F.min(v).alias("min"), F.max(v).alias("max"),
            mean.alias("mean"), F.when(F.count(v) > 1, std).alias("std"),
            F.when(F.count(v) > 1, std / F.when(mean > 0, mean)).alias("cv")]


def series_stats(df: DataFrame, by: list[str], value: str = "q", *, bounded: bool = False) -> DataFrame:
    """Count, zeros, min, max, mean, median, sample std, cv and 11 exceedance quantiles.

    ``bounded`` says that the calendar limits a group (one value per half-month of a
    record), so its values may sit in one array; any other grouping takes the
    range-partitioned order statistics, whatever its size.
    """
    base = basic_stats(value)
    if bounded:
        agg = df.groupBy(*by).agg(*base, F.sort_array(F.collect_list(F.col(value))).alias("_v"))
        return agg.select(*by, "count", "zero_count", "min", "max", "mean", weibull_median("_v").alias("median"), "std", "cv",
                          *[weibull_at(F.col("_v"), e).alias(f"q{e}") for e in EXCEEDANCES])
    agg = df.groupBy(*by).agg(*base)
    wq = ordered.quantiles(df, by, value, [1 - e / 100 for e in EXCEEDANCES], weibull=True)
    names = {round(1 - e / 100, 6): f"q{e}" for e in EXCEEDANCES}
    wide = wq.groupBy(*by).agg(*[F.max(F.when(F.abs(F.col("prob") - p) < 1e-9, F.col("q"))).alias(n) for p, n in names.items()])
    # the median is the exclusive quantile at one half for every sample size
    wide = wide.withColumn("median", F.col("q50"))
    return agg.join(F.broadcast(wide)) if not by else agg.join(wide, by, "left")


def weibull_median(name: str) -> Column:
    s = F.col(name)
    n = F.size(s)
    return F.when(n > 0, (F.try_element_at(s, F.floor((n + 1) / 2).cast("int")) + F.try_element_at(s, (F.floor(n / 2) + 1).cast("int"))) / 2)


def period_stats(df: DataFrame, key: str, value: str = "q") -> DataFrame:
    """The same statistics per half-month: dependable-flow curves."""
    return series_stats(df, [key, "period"], value, bounded=True)


def volume(df: DataFrame, key: str, value: str = "q") -> DataFrame:
    """Total volume in m3: discharge times the seconds of each half-month."""
    days = halfmonth_days(F.col("year"), F.col("period"))
    return df.groupBy(key).agg(F.sum(F.col(value) * days * 86400.0).alias("volume_m3"))


def fit_metrics(df: DataFrame, by: list[str], observed: str = "observed", predicted: str = "predicted") -> DataFrame:
    """Count, RMSE, bias, NSE, KGE (population deviations) and percent bias; NULL where undefined."""
    pairs = df.filter(F.col(observed).isNotNull() & F.col(predicted).isNotNull())
    o, p = F.col(observed), F.col(predicted)
    a = pairs.groupBy(*by).agg(
        F.count("*").alias("count"), F.avg((p - o) * (p - o)).alias("_mse"), F.avg(p - o).alias("bias"), F.var_pop(o).alias("_vo"),
        F.stddev_pop(o).alias("_so"), F.stddev_pop(p).alias("_sp"), F.avg(o).alias("_mo"), F.avg(p).alias("_mp"), F.covar_pop(o, p).alias("_c"))
    so, sp, mo = (F.when(F.col(c) > 0, F.col(c)) for c in ("_so", "_sp", "_mo"))
    kge = 1 - F.sqrt((F.col("_c") / (so * sp) - 1) ** 2 + (sp / so - 1) ** 2 + (F.col("_mp") / mo - 1) ** 2)
    usable = (F.col("count") > 1) & (F.col("_so") > 0) & (F.col("_sp") > 0) & (F.col("_mo") > 0)
    return a.select(*by, "count", F.sqrt("_mse").alias("rmse"), "bias",
                    (1 - F.col("_mse") / F.when(F.col("_vo") > 0, F.col("_vo"))).alias("nse"), F.when(usable, kge).alias("kge"),
                    (100 * (F.col("_mp") - F.col("_mo")) / mo).alias("pbias_pct"))


def year_ranges(df: DataFrame, key: str) -> DataFrame:
    """Years per key as text such as '2001-2004, 2007' (years bound the group)."""
    from pyspark.sql import Window as W

    years = df.select(key, "year").distinct()
    island = F.col("year") - F.row_number().over(W.partitionBy(key).orderBy("year"))
    runs = years.withColumn("_g", island).groupBy(key, "_g").agg(F.min("year").alias("a"), F.max("year").alias("b"))
    text = F.when(F.col("a") == F.col("b"), F.col("a").cast("string")).otherwise(F.concat_ws("–", "a", "b"))
    items = F.sort_array(F.collect_list(F.struct("a", text.alias("t"))))
    return runs.groupBy(key).agg(items.alias("_i")).select(key, F.array_join(F.transform("_i", lambda s: s["t"]), ", ").alias("years"))
