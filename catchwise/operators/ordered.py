"""Ordered computations over groups of any size.

A plain window puts a whole group into one task.  These helpers range-partition
the rows by ``(keys, order)`` first, work inside the resulting buckets and carry
only one summary row per (bucket, group) across, so a group holding a third of
all rows is spread over as many tasks as its size asks for.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from catchwise.runtime import cut, small


def bucketed(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Rows with a ``_bucket`` number that grows with ``(keys, order)``."""
    ranged = df.repartitionByRange(*[F.col(k) for k in keys], *[F.col(o) for o in order])
    return cut(ranged.withColumn("_bucket", F.spark_partition_id()))


def _join_by_bucket(rows: DataFrame, side: DataFrame, keys: list[str]) -> DataFrame:
    """Attach one summary row per (bucket, group); NULL keys form a group of their own."""
    named = side.withColumnsRenamed({"_bucket": "_kb", **{k: f"_k{i}" for i, k in enumerate(keys)}})
    match = reduce(lambda x, y: x & y, [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)], F.col("_bucket") == F.col("_kb"))
    return rows.join(named, match)


def running_sum(df: DataFrame, keys: list[str], order: list[str], sums: dict[str, str],
                *, bucketed_already: bool = False) -> DataFrame:
    """Add ``out = cumulative sum of col`` for each ``out -> col`` of ``sums``."""
    rows = df if bucketed_already else bucketed(df, keys, order)
    inside = W.partitionBy("_bucket", *keys).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    totals = rows.groupBy("_bucket", *keys).agg(*[F.sum(c).alias(f"_t_{o}") for o, c in sums.items()])
    before = W.partitionBy(*keys).orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    offsets = totals.select("_bucket", *keys, *[
        F.coalesce(F.sum(f"_t_{o}").over(before), F.lit(0)).alias(f"_o_{o}") for o in sums])
    part = rows.select("*", *[F.sum(c).over(inside).alias(f"_i_{o}") for o, c in sums.items()])
    joined = _join_by_bucket(part, offsets, keys)
    return joined.select(*[c for c in rows.columns if c != "_bucket"],
                         *[(F.col(f"_i_{o}") + F.col(f"_o_{o}")).alias(o) for o in sums])


def row_numbers(df: DataFrame, keys: list[str], order: list[str], out: str = "rn") -> DataFrame:
    """Position of each row inside its group, 1-based."""
    return running_sum(df.withColumn("_one", F.lit(1).cast("long")), keys, order, {out: "_one"}).drop("_one")


def neighbours(df: DataFrame, keys: list[str], order: list[str], cols: list[str], *, ahead: bool) -> DataFrame:
    """Add ``prev`` (or ``next`` when ``ahead``): a struct of ``cols`` from the adjacent row."""
    rows = bucketed(df, keys, order)
    name = "next" if ahead else "prev"
    step = F.lead if ahead else F.lag
    inside = W.partitionBy("_bucket", *keys).orderBy(*order)
    payload = F.struct(*cols)
    rank = F.struct(*order)
    pick = F.min_by if ahead else F.max_by
    edges = rows.groupBy("_bucket", *keys).agg(pick(payload, rank).alias("_edge"))
    across = edges.select("_bucket", *keys, step("_edge").over(W.partitionBy(*keys).orderBy("_bucket")).alias("_far"))
    part = rows.withColumn(name, step(payload).over(inside))
    joined = _join_by_bucket(part, across, keys).withColumn(name, F.coalesce(name, "_far"))
    return joined.select(*df.columns, name)


def quantiles(df: DataFrame, keys: list[str], value: str, probs: list[float], *, weibull: bool = False) -> DataFrame:
    """Exact quantiles per group: ``keys, prob, q``; NULL values are left out.

    Linear interpolation between order statistics; ``weibull`` uses rank
    ``(n+1)p`` and yields NULL outside the sample instead of clipping.
    """
    clean = df.filter(F.col(value).isNotNull()).select(*keys, F.col(value).alias("_v"))
    # equal values collapse into one counted row, so ties never swell a bucket
    counted = clean.groupBy(*keys, "_v").agg(F.count("*").alias("_c"))
    rows = bucketed(counted, keys, ["_v"])
    totals = cut(rows.groupBy("_bucket", *keys).agg(F.sum("_c").alias("_t")))
    sizes = totals.groupBy(*keys).agg(F.sum("_t").alias("_n"))
    wanted = sizes.select(*keys, "_n", F.explode(F.array(*[F.lit(float(p)) for p in probs])).alias("prob"))
    if weibull:
        rank = (F.col("_n") + 1) * F.col("prob")
        inside = (rank >= 1 - 1e-12) & (rank <= F.col("_n") + 1e-12)
        pos = F.when(inside, F.least(F.greatest(rank, F.lit(1.0)), F.col("_n").cast("double")))
    else:
        pos = F.lit(1.0) + (F.col("_n") - 1) * F.col("prob")
    wanted = wanted.withColumn("_pos", pos).withColumn("_lo", F.floor("_pos")).withColumn("_fr", F.col("_pos") - F.col("_lo"))
    # a wanted rank goes to the bucket whose counts hold it (two if it falls between), and meets the values of that bucket only
    upto = F.sum("_t").over(W.partitionBy(*keys).orderBy("_bucket").rowsBetween(W.unboundedPreceding, 0))
    ranges = totals.select("_bucket", *keys, (upto - F.col("_t")).alias("_from"), upto.alias("_to"))
    holds = lambda rank: (rank > F.col("_from")) & (rank <= F.col("_to"))
    met = wanted.join(ranges, keys) if keys else F.broadcast(wanted).join(ranges)
    routed = met.filter(holds(F.col("_lo")) | holds(F.col("_lo") + 1)).select("_bucket", *keys, "prob", "_lo", "_fr", "_from")
    inner = F.sum("_c").over(W.partitionBy("_bucket", *keys).orderBy("_v").rowsBetween(W.unboundedPreceding, 0))
    spans = rows.withColumn("_in", inner)
    hit = spans.join(small(routed), ["_bucket", *keys]).select(*keys, "_v", "prob", "_lo", "_fr", (F.col("_from") + F.col("_in") - F.col("_c") + 1).alias("_first"), (F.col("_from") + F.col("_in")).alias("_hi"))
    lo = (F.col("_lo") >= F.col("_first")) & (F.col("_lo") <= F.col("_hi"))
    hi = (F.col("_lo") + 1 >= F.col("_first")) & (F.col("_lo") + 1 <= F.col("_hi"))
    got = hit.filter(lo | hi).groupBy(*keys, "prob").agg(
        F.max(F.when(lo, F.col("_v"))).alias("_a"), F.max(F.when(hi, F.col("_v"))).alias("_b"), F.max("_fr").alias("_fr"))
    value_at = F.col("_a") + F.when(F.col("_fr") > 0, F.col("_fr") * (F.col("_b") - F.col("_a"))).otherwise(0.0)
    return wanted.select(*keys, "prob").join(got, [*keys, "prob"], "left").select(*keys, "prob", value_at.alias("q"))
