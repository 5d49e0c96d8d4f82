"""Mixing sources to target weights by subset-sum budget fitting.

Documents are counted by exact length in every source. A source's target first buys whole repeats of the source; the
rest is a budget that a choice of documents must meet. Every length gives the same share of its documents, rounded
down; single documents of the lengths rounded down most come next, and while more than ``TABLE`` words are missing the
lengths that still fit are shared out again. A bounded knapsack over the remaining (length, count) pairs closes what is
left, exactly where lengths allow. If words are still missing, the shortest longer document is added and what is then
too much is taken back in the same way (or the reverse), as long as that comes nearer; choices among documents longer
than ``TABLE`` are not all compared, so a source of such documents alone may stay a little off. Within a length the
documents with the smallest seeded hash are taken; their last hash is found from counts of hash buckets, so no group
is ranked in one task, and the documents themselves are never shuffled.

Null sizes count as 0, null sources form a source of their own (last in order), null ids come first. Repeated rows
count singly: where the last place of a length falls among rows with one id, so many of them are taken as fit. A
source without words has target 0. Columns of the input named like an added column are replaced; names that begin
with an underscore are reserved.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from catchwise.llm.common import WORD, side
from catchwise.runtime import Cut

#: A target stops at so many times its source's size.
REPEATS = 3
#: Words of the budget that the knapsack table covers.
TABLE = 1 << 16
#: Rows a hash bucket is meant to hold, and buckets a length of a source at most.
BUCKET_ROWS, BUCKETS = 256, 4096
SEED = 20


def words(text: str) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sources: DataFrame, weights: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """``sources`` (source, source_size) with ``target``: weighted shares of all sizes, none above ``REPEATS`` times its source.

    The level at which shares stop follows from sums over capped and open sources; each round sends two sums to the
    driver and can only cap more sources.
    """
    ordered = W.orderBy(F.col("source").asc_nulls_last())  # one row a source
    weighed = Cut(sources.withColumn("weight", F.get(F.array(*[F.lit(w) for w in weights]), F.pmod(F.row_number().over(ordered) - 1, F.lit(len(weights))).cast("int")).cast("long"))).df
    total = weighed.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0]
    level, capped = 0.0, -1
    while True:
        stops = F.col("weight") * F.lit(level) >= F.col("source_size") * REPEATS if capped >= 0 else F.lit(False)
        n, bound, open_weight = weighed.agg(F.count(F.when(stops, 1)), F.coalesce(F.sum(F.when(stops, F.col("source_size") * REPEATS)), F.lit(0)), F.coalesce(F.sum(F.when(~stops, F.col("weight"))), F.lit(0))).first()
        if n == capped:
            break
        capped = n
        level = (total - bound) / open_weight if open_weight else level
    return weighed.select("source", "source_size", F.least(F.col("weight") * F.lit(level), (F.col("source_size") * REPEATS).cast("double")).alias("target"))


def knapsack(lengths: Iterable[int], counts: Iterable[int], budget: int) -> dict[int, int]:
    """How many of each length to take so that their sum comes as near to ``budget`` as can be (the lower of two)."""
    room = 2 * budget  # beyond it, nothing is nearer than taking none
    reached = np.zeros(room + 1, dtype=bool)
    reached[0] = True
    by = np.full(room + 1, -1, dtype=np.int64)
    bundles: list[tuple[int, int]] = []
    for length, count in zip(lengths, counts, strict=True):
        left, k = min(int(count), room // max(length, 1)), 1
        while left > 0 and length > 0 and not reached[budget]:
            size = min(k, left)
            new = np.zeros_like(reached)
            new[size * length:] = reached[: room + 1 - size * length]
            new &= ~reached
            by[new] = len(bundles)
            bundles.append((length, size))
            reached |= new
            left -= size
            k *= 2
    sums = np.flatnonzero(reached)
    at, taken = int(sums[np.argmin(np.abs(sums - budget))]), {}
    while at:
        length, size = bundles[by[at]]
        taken[length] = taken.get(length, 0) + size
        at -= length * size
    return taken


def near(lengths: np.ndarray, counts: np.ndarray, budget: int) -> np.ndarray:
    """How many of each length to take: even shares until at most ``TABLE`` words are left or all documents left are longer than that, then the knapsack."""
    take, left, open_ = np.zeros(len(lengths), dtype=np.int64), budget, counts
    while size := int((open_ * lengths).sum()):
        exact = open_ * min(1.0, left / size)
        more = np.minimum(np.floor(exact).astype(np.int64), open_)
        left -= int((more * lengths).sum())
        for i in np.argsort(-(exact - more), kind="stable"):
            if left <= TABLE:
                break
            if more[i] < open_[i] and 0 < lengths[i] <= left:
                more[i] += 1
                left -= int(lengths[i])
        take += more
        if left <= TABLE:
            break
        open_ = np.where((lengths > 0) & (lengths <= left), counts - take, 0)
    if 0 < left <= TABLE:
        more = knapsack(lengths.tolist(), (counts - take).tolist(), left)
        take += np.array([more.get(int(length), 0) for length in lengths], dtype=np.int64)
    return take


def fit(lengths: np.ndarray, counts: np.ndarray, target: float) -> tuple[int, np.ndarray]:
    """Whole repeats of the source, then how many documents of each length once more."""
    size = int((lengths * counts).sum())
    take = np.zeros(len(lengths), dtype=np.int64)
    if size == 0 or target <= 0:
        return 0, take
    repeats = int(min(REPEATS, (target + 1e-6) // size))
    rest = round(target - repeats * size)
    if repeats == REPEATS or rest <= 0:
        return repeats, take
    take = near(lengths, counts, rest)
    left = rest - int((take * lengths).sum())
    while left:
        sign = 1 if left > 0 else -1
        free, back = (counts - take, take) if left > 0 else (take, counts - take)
        longer = np.flatnonzero((free > 0) & (lengths > abs(left)))
        if not len(longer):
            break
        one = longer[np.argmin(lengths[longer])]
        step = -near(lengths, np.where(lengths > 0, back, 0), int(lengths[one]) - abs(left))
        step[one] += 1
        after = left - sign * int((step * lengths).sum())
        if abs(after) >= abs(left):
            break
        take, left = take + sign * step, after
    return repeats, take


def _fit_source(rows: pd.DataFrame) -> pd.DataFrame:
    rows = rows.sort_values("_size", ascending=False, ignore_index=True)
    repeats, take = fit(rows["_size"].to_numpy(), rows["n"].to_numpy(), float(rows["target"].iloc[0]))
    return rows.assign(repeats=repeats, take=take)[["_source", "_size", "n", "source_size", "target", "repeats", "take"]]


def mix(df: DataFrame, doc_id: str, source: str, size: Column) -> DataFrame:
    """``df`` with ``size``, ``source_size``, ``target`` and ``copies`` (how often the mix takes the row)."""
    added = {"size", "source_size", "target", "copies"} - {doc_id, source}
    keyed = df.select(*[c for c in df.columns if c not in added], size.cast("long").alias("_words")).withColumns({
        "_size": F.coalesce("_words", F.lit(0)), "_source": F.coalesce(F.concat(F.lit("="), F.col(source).cast("string")), F.lit("")),
        "_id": F.coalesce(F.col(doc_id).cast("long"), F.lit(-(1 << 63))), "_draw": F.shiftrightunsigned(F.xxhash64(F.col(doc_id).cast("long"), F.lit(SEED)), 1)})
    rows = Cut(keyed.select(F.col(source).cast("string").alias("source"), "_source", "_size", "_id", "_draw")).df
    counts = Cut(rows.groupBy("_source", "source", "_size").agg(F.count("*").alias("n"))).df
    goal = Cut(targets(counts.groupBy("source").agg(F.sum(F.col("n") * F.col("_size")).alias("source_size")))).df
    goal = goal.withColumn("_source", F.coalesce(F.concat(F.lit("="), "source"), F.lit(""))).drop("source")
    plan = counts.join(goal, "_source").groupBy("_source").applyInPandas(_fit_source, "_source string, _size long, n long, source_size long, target double, repeats int, take long")
    planned = Cut(plan.withColumn("_buckets", F.least(F.lit(BUCKETS), F.ceil(F.col("n") / BUCKET_ROWS))))

    partly = rows.join(side(planned).filter("take > 0 and take < n").select("_source", "_size", "take", "_buckets"), ["_source", "_size"])
    partly = partly.withColumn("_bucket", F.least(F.col("_buckets") - 1, F.floor(F.col("_draw") / F.lit(float(1 << 63)) * F.col("_buckets"))))
    seen = W.partitionBy("_source", "_size").orderBy("_bucket").rowsBetween(W.unboundedPreceding, 0)
    filled = partly.groupBy("_source", "_size", "_bucket", "take").agg(F.count("*").alias("here")).withColumn("upto", F.sum("here").over(seen))
    last = Cut(filled.filter("upto >= take and upto - here < take").select("_source", "_size", "_bucket", (F.col("take") - F.col("upto") + F.col("here")).alias("place")))
    near = partly.join(side(last), ["_source", "_size", "_bucket"])
    bucket = W.partitionBy("_source", "_size", "_bucket")
    ranked = near.select("_source", "_size", "_bucket", "place", "_draw", "_id").withColumn("_rank", F.row_number().over(bucket.orderBy("_draw", "_id")))
    alike = W.partitionBy("_source", "_size", "_bucket", "_draw", "_id")
    ends = ranked.withColumn("_alike", F.count("*").over(alike)).withColumn("_first", F.min("_rank").over(alike)).filter(F.col("_rank") == F.col("place"))
    whole = planned.df.join(
        ends.select("_source", "_size", F.col("_draw").alias("last_draw"), F.col("_id").alias("last_id"), F.when(F.col("_alike") > F.col("place") - F.col("_first") + 1, F.col("place") - F.col("_first") + 1).alias("last_of")),
        ["_source", "_size"], "left")
    whole = Cut(whole.select(
        "_source", "_size", F.col("source_size").alias("_source_size"), F.col("target").alias("_target"), F.col("repeats").alias("_repeats"),
        F.when(F.col("take") == F.col("n"), 1).when(F.col("take") == 0, 0).alias("_all_taken"), F.col("last_draw").alias("_last_draw"), F.col("last_id").alias("_last_id"), F.col("last_of").alias("_last_of")))

    kept = [c for c in df.columns if c not in added]
    met = keyed.join(side(whole), ["_source", "_size"])
    key, end = F.struct("_draw", "_id"), F.struct(F.col("_last_draw").alias("_draw"), F.col("_last_id").alias("_id"))
    on_end = F.col("_last_of").isNotNull() & (key == end)
    once = F.coalesce(F.col("_all_taken"), F.when(key <= end, 1).otherwise(0))
    out = lambda frame, more: frame.select(*kept, F.col("_size").alias("size"), F.col("_source_size").alias("source_size"), F.col("_target").alias("target"), (F.col("_repeats") + more).cast("int").alias("copies"))
    if whole.df.filter("_last_of is not null").isEmpty():
        return out(met, once)
    place = F.row_number().over(W.partitionBy("_source", "_size").orderBy("_draw"))
    tied = met.filter(on_end).withColumn("_place", place)
    return out(met.filter(~F.coalesce(on_end, F.lit(False))), once).unionByName(out(tied, F.when(F.col("_place") <= F.col("_last_of"), 1).otherwise(0)))


def repeat_rows(df: DataFrame, copies: str = "copies") -> DataFrame:
    """Every row as often as ``copies`` says, 0 to ``REPEATS`` times."""
    return df.withColumn("_again", F.explode(F.array_repeat(F.lit(0), F.col(copies)))).drop("_again")
