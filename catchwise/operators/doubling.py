"""Pointer doubling on functional graphs (every node has at most one successor).

River links drain to one downstream link and raster cells drain to one
neighbour, so both are functional graphs.  After round ``k`` a pointer spans
``2**k`` hops: a network of depth ``d`` is finished after ``log2(d)`` rounds and
each round handles at most one row per node.  Nothing is collected; the only
value that reaches the driver is the count of unfinished rows.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from catchwise.runtime import Cut, cut, cuts, union_all

MAX_ROUNDS = 40  # 2**40 hops: deeper than any network that could be stored


class CyclicNetwork(ValueError):
    """The successor graph contains a loop, so no terminal can be reached."""


def _check_rounds(round_no: int) -> None:
    if round_no > MAX_ROUNDS:
        raise CyclicNetwork("downstream pointers do not terminate; run find_cycles()")


def _frontier(start: DataFrame, jump: Callable[[DataFrame, DataFrame], DataFrame]) -> DataFrame:
    """Doubling over ``node, ptr, done, ...`` that sets finished rows aside.

    ``jump(live, known)`` moves unfinished rows on over what is known of the rows they point to.  A round writes the rows
    that were unfinished before it and nothing else, so a finished row is written once and never joined by its pointer
    again: no round gathers the rows of a basin at its terminal.
    """
    rounds = [Cut(start, count_if=~F.col("done"))]
    while rounds[-1].count:
        _check_rounds(len(rounds))
        live = rounds[-1].df.filter(~F.col("done"))
        known = union_all([*[r.df.filter("done") for r in rounds], live])
        rounds.append(Cut(jump(live, known), count_if=~F.col("done")))
    return union_all([r.df.filter("done") for r in rounds])


def to_terminal(nodes: DataFrame, carry: dict[str, str] | None = None) -> DataFrame:
    """Terminal node, hop count and carried sums for every node.

    ``nodes``: ``node, parent`` (NULL parent = terminal) and the columns named in
    ``carry`` values.  Each ``carry`` item ``out -> col`` sums ``col`` over the
    path from the node down to, and without, the terminal.
    """
    carry = carry or {}
    ends = F.col("parent").isNull()
    start = nodes.select(
        "node", F.coalesce("parent", "node").alias("ptr"), ends.alias("done"), F.when(ends, 0).otherwise(1).cast("long").alias("hops"),
        *[F.when(ends, 0.0).otherwise(F.coalesce(F.col(c), F.lit(0.0))).alias(o) for o, c in carry.items()])

    def jump(live: DataFrame, known: DataFrame) -> DataFrame:
        other = known.select(F.col("node").alias("_n"), *[F.col(c).alias(f"_{c}") for c in ("ptr", "done", "hops", *carry)])
        return live.join(other, F.col("ptr") == F.col("_n"), "left").select(
            # a pointer that has no row of its own leaves the table: it is a terminal
            "node", F.coalesce("_ptr", "ptr").alias("ptr"), F.coalesce("_done", F.lit(True)).alias("done"), (F.col("hops") + F.coalesce("_hops", F.lit(0))).alias("hops"),
            *[(F.col(o) + F.coalesce(f"_{o}", F.lit(0.0))).alias(o) for o in carry])

    return _frontier(start, jump).select("node", F.col("ptr").alias("terminal"), "hops", *carry)


def fold_upstream(nodes: DataFrame, values: DataFrame, aggs: dict[str, Callable[[Column], Column]],
                  keys: list[str] | None = None) -> DataFrame:
    """Aggregate ``values`` over every node's upstream set (itself included).

    ``S[k+1](v) = S[k](v) + sum of S[k](u) over u whose 2**k-th successor is v`` -
    every descendant enters exactly once, so any commutative, associative
    aggregate works.  ``nodes``: ``node, parent``; ``values``: ``node``, ``keys``,
    one column per entry of ``aggs``.
    """
    keys = keys or []
    if keys:
        return _fold_by_key(nodes, values, aggs, keys)
    folded = [fn(F.col(c)).alias(c) for c, fn in aggs.items()]
    start = nodes.select("node", F.col("parent").alias("jump")).join(
        values.groupBy("node").agg(*folded), "node", "left")
    live = F.col("jump").isNotNull()
    state = Cut(start, count_if=live)
    round_no = 0
    while state.count:
        round_no += 1
        _check_rounds(round_no)
        t = state.df
        moving = t.filter(live)
        merged = t.select("node", *aggs).unionByName(
            moving.select(F.col("jump").alias("node"), *aggs)).groupBy("node").agg(*folded)
        far = moving.select(F.col("node").alias("jump"), F.col("jump").alias("_far"))
        onward = moving.select("node", "jump").join(far, "jump").select("node", F.col("_far").alias("jump"))
        new = Cut(merged.join(onward, "node", "left").select("node", "jump", *aggs), count_if=live)
        state.drop()
        state = new
    return state.df.drop("jump").filter(reduce(lambda a, b: a | b, [F.col(c).isNotNull() for c in aggs]))


def _onward(jumps: DataFrame) -> DataFrame:
    """Pointers twice as long; those that would leave the network drop out."""
    far = jumps.select(F.col("node").alias("jump"), F.col("jump").alias("_far"))
    return jumps.join(far, "jump").select("node", F.col("_far").alias("jump"))


def _fold_by_key(nodes: DataFrame, values: DataFrame, aggs: dict, keys: list[str]) -> DataFrame:
    group = ["node", *keys]
    folded = [fn(F.col(c)).alias(c) for c, fn in aggs.items()]
    first = nodes.filter(F.col("parent").isNotNull()).select("node", F.col("parent").alias("jump"))
    state, jumps = cuts((values.groupBy(*group).agg(*folded), None), (first, F.lit(True)))
    round_no = 0
    while jumps.count:
        round_no += 1
        _check_rounds(round_no)
        message = state.df.join(jumps.df, "node").select(F.col("jump").alias("node"), *keys, *aggs)
        merged = state.df.unionByName(message).groupBy(*group).agg(*folded)
        new_state, new_jumps = cuts((merged, None), (_onward(jumps.df), F.lit(True)))
        state.drop()
        jumps.drop()
        state, jumps = new_state, new_jumps
    jumps.drop()
    return state.df


def first_marked(nodes: DataFrame, marked: DataFrame) -> DataFrame:
    """First marked node met going downstream, the node itself included.

    ``nodes``: ``node, parent``; ``marked``: ``node``.  Nodes that leave the
    network without meeting a mark are absent from the result.
    """
    flags = marked.select("node", F.lit(True).alias("_mark")).distinct()
    done = F.coalesce("_mark", F.lit(False))
    start = nodes.join(flags, "node", "left").select("node", F.when(done, F.col("node")).otherwise(F.col("parent")).alias("ptr"), done.alias("done")).filter("ptr is not null")

    def jump(live: DataFrame, known: DataFrame) -> DataFrame:
        other = known.select(F.col("node").alias("_n"), F.col("ptr").alias("_p"), F.col("done").alias("_d"))
        return live.join(other, F.col("ptr") == F.col("_n")).select("node", F.col("_p").alias("ptr"), F.col("_d").alias("done"))

    return _frontier(start, jump).select("node", F.col("ptr").alias("mark"))


def ancestors(tree: DataFrame) -> DataFrame:
    """All (node, ancestor) pairs of a tree ``node, parent`` - as many rows as pairs exist."""
    first = tree.filter(F.col("parent").isNotNull())
    pairs, jumps = cuts((first.select("node", F.col("parent").alias("ancestor")), None), (first.select("node", F.col("parent").alias("jump")), F.lit(True)))
    round_no = 0
    while jumps.count:
        round_no += 1
        _check_rounds(round_no)
        far_pairs = pairs.df.select(F.col("node").alias("jump"), "ancestor")
        grown = pairs.df.unionByName(jumps.df.join(far_pairs, "jump").select("node", "ancestor"))
        new_pairs, new_jumps = cuts((grown, None), (_onward(jumps.df), F.lit(True)))
        pairs.drop()
        jumps.drop()
        pairs, jumps = new_pairs, new_jumps
    jumps.drop()
    return pairs.df


def on_cycles(nodes: DataFrame) -> DataFrame:
    """Nodes that lie on a loop: the images left after more hops than there are nodes."""
    jumps = Cut(nodes.filter(F.col("parent").isNotNull()).select("node", F.col("parent").alias("jump")),
                count_if=F.lit(True))
    total = jumps.count
    span = 1
    while span <= total and jumps.count:
        new = Cut(_onward(jumps.df), count_if=F.lit(True))
        jumps.drop()
        jumps = new
        span *= 2
    return cut(jumps.df.select(F.col("jump").alias("node")).distinct())
