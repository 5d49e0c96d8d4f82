"""Byte-balanced shards by sampled splitters, in DataFrame operations only.

Rows are ordered by (group key, order key). A sample drawn with probability in proportion to a row's weight (half its
share of all bytes, half its share of all rows) gives quantile boundaries, which cut the order into ranges; ranges
that hold more than twice their due are sampled again inside and subdivided, down to single rows of one group if
need be. Exact byte and row counts of the ranges then place every range in the whole order, a window inside a range
places its rows, and a row's byte position decides its shard, so shards differ by little more than one group or row.

Rows of one group (equal texts) stay together unless the group is larger than ``1 / TOGETHER`` of a shard; larger
ones are cut where the shard is full. The result depends on the rows alone, not on the sample.

Null keys count as empty or smallest, null or negative sizes as 0; rows equal in every key are interchangeable and
dealt out by a number given when the table is first written. An empty table gives an empty table. Columns of the
input named ``shard`` or ``slot`` are replaced; names that begin with an underscore are reserved.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from catchwise.runtime import Cut

#: Groups of up to this part of a shard are never cut.
TOGETHER = 200
#: Ranges a shard at least, sampled rows a range, rows a range is meant to hold at most, and bounds on ranges and rounds.
RANGES, DRAWN, ROWS, MOST_RANGES, ROUNDS = 16, 32, 500_000, 8_192, 6
KEY = ["_group", "_order", "_tie"]


def _literal(values: list, kind: str) -> Column:
    return F.array(*[F.lit(v) for v in values]).cast(f"array<{kind}>")


def _range_of(splitters: list[tuple]) -> Column:
    """How many splitters are at or below the row's key: a binary search over a constant array."""
    if not splitters:
        return F.lit(0)
    rows = F.array(*[F.struct(F.lit(g).alias("g"), F.lit(o).cast("long").alias("o"), F.lit(t).cast("long").alias("t")) for g, o, t in splitters])
    own = F.struct(F.col("_group").alias("g"), F.col("_order").alias("o"), F.col("_tie").alias("t"))
    steps = [1 << b for b in range(len(splitters).bit_length() - 1, -1, -1)]
    return F.aggregate(
        F.array(*[F.lit(s) for s in steps]), F.lit(0),
        lambda found, step: F.when((found + step <= len(splitters)) & (F.get(rows, found + step - 1) <= own), found + step).otherwise(found),
    )


def _draws(base: DataFrame, rate: Column) -> DataFrame:
    """Rows whose fixed uniform number is below ``rate``, with the weight each stands for."""
    uniform = F.shiftrightunsigned(F.xxhash64(*KEY, F.lit(17)), 11) / F.lit(float(1 << 53))
    return base.withColumn("_rate", rate).filter(uniform < F.col("_rate")).select(*KEY, "_part", (F.col("_weight") / F.least(F.lit(1.0), F.col("_rate"))).alias("_stands"))


def _boundaries(drawn: list, pieces: int) -> list[tuple]:
    """Quantile boundaries of one range's weighted sample; between groups while it holds several, else between rows."""
    drawn = sorted(drawn, key=lambda r: (r["_group"], r["_order"], r["_tie"]))
    several = drawn[0]["_group"] != drawn[-1]["_group"]
    total, seen, out = sum(r["_stands"] for r in drawn), 0.0, []
    for r in drawn:
        if seen * pieces >= total * (len(out) + 1):
            out.append((r["_group"], None, None) if several else (r["_group"], r["_order"], r["_tie"]))
        seen += r["_stands"]
    if several and drawn[0]["_group"] in {g for g, _, _ in out}:
        out = [b for b in out if b[0] != drawn[0]["_group"]]
    if several and not out:
        out = [(next(r["_group"] for r in drawn if r["_group"] != drawn[0]["_group"]), None, None)]
    return out


def _sorted(splitters: set[tuple]) -> list[tuple]:
    low = -(1 << 63)
    return sorted(splitters, key=lambda s: (s[0], low if s[1] is None else s[1], low if s[2] is None else s[2]))


def shards(df: DataFrame, group: Column, order: Column, size: Column, n_shards: int) -> DataFrame:
    """``df`` with ``shard`` (0 to ``n_shards`` - 1) and ``slot`` (gapless from 0 inside a shard)."""
    kept = [c for c in df.columns if c not in ("shard", "slot")]
    numbered = df.select(
        *kept, F.coalesce(group.cast("string"), F.lit("")).alias("_group"), F.coalesce(order.cast("long"), F.lit(-(1 << 63))).alias("_order"),
        F.xxhash64(F.monotonically_increasing_id()).alias("_tie"), F.greatest(F.coalesce(size.cast("long"), F.lit(0)), F.lit(0)).alias("_size"))
    base = Cut(numbered)
    rows, total = base.df.agg(F.count("*"), F.coalesce(F.sum("_size"), F.lit(0))).first()
    if not rows:
        return base.df.select(*kept, F.lit(0).alias("shard"), F.lit(0).cast("long").alias("slot"))
    ranges = min(MOST_RANGES, max(RANGES * n_shards, rows // ROWS))
    weight = F.col("_size") / F.lit(2.0 * max(total, 1)) + F.lit(0.5 / rows)
    weighed = base.df.withColumn("_weight", weight)

    drawn = _draws(weighed.withColumn("_part", F.lit(0)), F.col("_weight") * ranges * DRAWN).collect()  # about ranges * DRAWN rows
    splitters = _sorted(set(_boundaries(drawn, ranges))) if drawn else []
    for _ in range(ROUNDS):
        parts = weighed.withColumn("_part", _range_of(splitters))
        held = {r[0]: r for r in parts.groupBy("_part").agg(F.sum("_weight"), F.sum("_size"), F.count("*"), F.min(F.struct(*KEY)) != F.max(F.struct(*KEY))).collect()}
        overfull = {p: r for p, r in held.items() if r[1] > 2.0 / ranges and r[4]}
        if not overfull:
            break
        rates = F.create_map(*[F.lit(v) for p, r in overfull.items() for v in (p, DRAWN * max(2.0, r[1] * ranges) / r[1])])
        again = _draws(parts.filter(F.col("_part").isin(list(overfull))), F.col("_weight") * F.element_at(rates, F.col("_part"))).collect()
        inside: dict[int, list] = {}
        for r in again:
            inside.setdefault(r["_part"], []).append(r)
        new = _sorted(set(splitters) | {b for p, own in inside.items() for b in _boundaries(own, int(overfull[p][1] * ranges) + 1)})
        if len(new) == len(splitters):
            break
        splitters = new
    else:
        parts = weighed.withColumn("_part", _range_of(splitters))
        held = {r[0]: r for r in parts.groupBy("_part").agg(F.sum("_weight"), F.sum("_size"), F.count("*")).collect()}

    bytes_before, rows_before = [0], [0]
    for p in range(len(splitters) + 1):
        own = held.get(p)
        bytes_before.append(bytes_before[-1] + (own[2] if own else 0))
        rows_before.append(rows_before[-1] + (own[3] if own else 0))
    inside, by_group = W.partitionBy("_part").orderBy(*KEY), W.partitionBy("_part").orderBy("_group")
    first = F.get(_literal(bytes_before, "long"), F.col("_part"))
    placed = (
        parts.withColumn("_row", F.row_number().over(inside)).withColumn("_end", F.sum("_size").over(inside.rowsBetween(W.unboundedPreceding, 0)))
        .withColumn("_group_end", F.sum("_size").over(by_group)).withColumn("_group_size", F.sum("_size").over(W.partitionBy("_part", "_group")))
        .withColumn("_at", first + F.when(F.col("_group_size") * (TOGETHER * n_shards) <= total, F.col("_group_end") - F.col("_group_size")).otherwise(F.col("_end") - F.col("_size")))
        .select(*kept, (F.get(_literal(rows_before, "long"), F.col("_part")) + F.col("_row") - 1).alias("_rank"),
                F.least(F.lit(n_shards - 1), F.expr(f"_at * {n_shards} div {max(total, 1)}")).cast("int").alias("shard")))
    ranked = Cut(placed)
    base.drop()
    starts = dict(ranked.df.groupBy("shard").agg(F.min("_rank")).collect())
    return ranked.df.select(*kept, "shard", (F.col("_rank") - F.get(_literal([starts.get(s) for s in range(n_shards)], "long"), F.col("shard"))).alias("slot"))


def write_shards(df: DataFrame, path: str, files_per_shard: int) -> None:
    """Write records that carry ``shard`` and ``slot``, one folder a shard, each in ``files_per_shard`` files of consecutive slots' hash."""
    n = files_per_shard * (1 + (df.agg(F.max("shard")).first()[0] or 0))
    df.repartition(n, "shard", F.pmod(F.col("slot"), F.lit(files_per_shard))).sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
