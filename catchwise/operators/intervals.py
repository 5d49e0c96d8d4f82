"""Enter and leave numbers of trees: nesting becomes two comparisons.

A walk through a forest that visits a node before its children numbers the nodes; ``leave`` is the number after the last node
of the subtree. ``inner`` lies in ``outer`` exactly when ``outer.enter < inner.enter < outer.leave``. The numbers follow
from subtree sizes (one fold), the sizes of earlier siblings (a running sum) and sums along the way down (one more fold).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from catchwise.operators import doubling, ordered
from catchwise.runtime import Cut


def tree_intervals(tree: DataFrame) -> DataFrame:
    """``node, parent, enter, leave, depth`` of the forest ``tree(node, parent)``; siblings are visited by node."""
    ones = tree.select("node", F.lit(1).cast("long").alias("size"))
    sized = tree.join(doubling.fold_upstream(tree, ones, {"size": F.sum}), "node")
    earlier = ordered.running_sum(sized, ["parent"], ["node"], {"upto": "size"})
    # numbers used up between the parent and the node; roots follow one another
    step = F.col("upto") - F.col("size") + F.when(F.col("parent").isNull(), 0).otherwise(1)
    steps = Cut(earlier.select("node", "parent", "size", step.cast("double").alias("step")))
    down = doubling.to_terminal(steps.df.select("node", "parent", "step"), {"above": "step"})
    first = steps.df.select(F.col("node").alias("terminal"), F.col("step").alias("first"))
    enter = (F.col("above") + F.col("first")).cast("long")
    made = down.join(first, "terminal").join(steps.df.select("node", "parent", "size"), "node")
    out = Cut(made.select("node", "parent", enter.alias("enter"), (enter + F.col("size")).alias("leave"), F.col("hops").alias("depth")))
    steps.drop()
    return out.df


def inside(inner: str, outer: str) -> Column:
    """Whether the struct or alias ``inner`` lies in ``outer``."""
    return (F.col(f"{outer}.enter") < F.col(f"{inner}.enter")) & (F.col(f"{inner}.enter") < F.col(f"{outer}.leave"))


def nested_pairs(places: DataFrame, ids: list[str]) -> DataFrame:
    """``inner, outer`` (structs of ``ids``) of all rows of ``places`` where one lies in the other.

    An interval is cut into blocks of powers of two, and a number lies in one block of every power, so pairs meet in an
    equality join that makes the answer's rows and no others.
    """
    top = places.agg(F.coalesce(F.max("leave"), F.lit(0))).first()[0]
    powers = F.sequence(F.lit(0), F.lit(max(1, int(top).bit_length())))
    who = F.struct(*ids)
    # the numbers below the outer node are enter + 1 to leave - 1
    low, high = F.col("enter") + 1, F.col("leave")
    unit = F.pow(F.lit(2.0), F.col("k")).cast("long")
    begin, end = F.floor((low + unit - 1) / unit), F.floor(high / unit)
    some = begin < end
    blocks = places.filter("leave > enter + 1").select(who.alias("outer"), "enter", "leave", F.explode(powers).alias("k")).select(
        "outer", "k", F.explode(F.array_compact(F.array(F.when(some & (begin % 2 == 1), begin), F.when(some & (end % 2 == 1), end - 1)))).alias("block"))
    numbers = places.select(who.alias("inner"), "enter", F.explode(powers).alias("k")).select("inner", "k", F.floor(F.col("enter") / unit).alias("block"))
    return blocks.distinct().join(numbers, ["k", "block"]).select("inner", "outer")


def counts_along(places: DataFrame, keys: list[str], ids: list[str]) -> DataFrame:
    """``ids, above, below``: how many rows with equal ``keys`` each row lies in, and how many lie in it.

    Entering and leaving are events on one line; running sums at a row's own numbers give both counts, so no pair is listed.
    """
    def event(at: Column, kind: str, enters: int, leaves: int):
        return F.struct(at.alias("at"), F.lit(kind).alias("kind"), F.lit(enters).cast("long").alias("enters"), F.lit(leaves).cast("long").alias("leaves"))

    # at one number leaving comes before asking what was open, and that before entering; a row asks three times
    order = F.array(event(F.col("leave"), "a_leave", 0, 1), event(F.col("enter"), "b_open", 0, 0), event(F.col("enter"), "c_enter", 1, 0), event(F.col("enter"), "d_own", 0, 0),
                    event(F.col("leave"), "b_last", 0, 0))
    events = places.select(*keys, *ids, F.inline(order))
    summed = ordered.running_sum(events, keys, ["at", "kind", *ids], {"n_enter": "enters", "n_leave": "leaves"})
    asked = lambda kind, c: F.max(F.when(F.col("kind") == kind, F.col(c)))
    each = summed.groupBy(*keys, *ids).agg(asked("b_open", "n_enter").alias("e0"), asked("b_open", "n_leave").alias("l0"), asked("d_own", "n_enter").alias("e1"), asked("b_last", "n_enter").alias("e2"))
    return each.select(*keys, *ids, (F.col("e0") - F.col("l0")).alias("above"), (F.col("e2") - F.col("e1")).alias("below"))


def places_of_pairs(nested: DataFrame, rows: DataFrame) -> DataFrame:
    """``point_id, enter, leave, depth`` of ``rows(point_id)`` from all ordered pairs ``upstream_point, downstream_point``."""
    depth = nested.groupBy(F.col("upstream_point").alias("point_id")).agg(F.count("*").alias("n"))
    below = nested.join(depth.withColumnRenamed("point_id", "downstream_point"), "downstream_point", "left")
    parent = below.groupBy(F.col("upstream_point").alias("node")).agg(F.max_by("downstream_point", F.struct(F.coalesce("n", F.lit(0)), "downstream_point")).alias("parent"))
    tree = Cut(rows.select(F.col("point_id").alias("node")).distinct().join(parent, "node", "left"))
    return tree_intervals(tree.df).select(F.col("node").alias("point_id"), "enter", "leave", "depth")
