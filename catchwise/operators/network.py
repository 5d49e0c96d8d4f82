"""River-network operators: closure, levels, accumulation, longest path, Strahler."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from catchwise.operators import doubling, ordered
from catchwise.operators import intervals as iv
from catchwise.runtime import cut, small

CONNECTOR_LENGTH_M = 1e-9


def _graph(links: DataFrame) -> DataFrame:
    return links.select(F.col("linkno").alias("node"), F.col("downstream_id").alias("parent"))


# --- identifiers and topology checks -------------------------------------------------

def duplicate_ids(df: DataFrame, key: str) -> DataFrame:
    """Keys that occur more than once, with their count."""
    return df.groupBy(F.col(key).alias("id")).agg(F.count("*").alias("n")).filter("n > 1")


def resolve_downstream(links: DataFrame, subbasins: DataFrame) -> DataFrame:
    """Skip connector reaches (no subbasin, or no length) between real reaches.

    ``links``: ``linkno, downstream_id`` (-1 or NULL = network outlet), ``length_m``.
    Returns real links with the first real link downstream.  A loop made of
    connectors raises; a pointer to an unknown link is reported as ``broken``.
    """
    subs = subbasins.select(F.col("polygon_id").alias("linkno"), F.lit(True).alias("has_polygon"))
    base = links.join(subs, "linkno", "left").select(
        "linkno",
        F.when(F.col("downstream_id") >= 0, F.col("downstream_id")).alias("raw_ds"),
        (F.col("has_polygon") & (F.coalesce("length_m", F.lit(0.0)) > CONNECTOR_LENGTH_M)).alias("real"),
    ).withColumn("real", F.coalesce("real", F.lit(False)))
    base = cut(base)
    nodes = base.select(F.col("linkno").alias("node"), F.col("raw_ds").alias("parent"))
    real = base.filter("real").select(F.col("linkno").alias("node"))
    # the first real reach at or below each reach; connectors pass the pointer on
    first = doubling.first_marked(nodes, real).withColumnRenamed("node", "raw_ds").withColumnRenamed("mark", "downstream_id")
    known = base.select(F.col("linkno").alias("raw_ds"), F.lit(True).alias("_known"))
    return (
        base.filter("real").select("linkno", "raw_ds")
        .join(first, "raw_ds", "left").join(known, "raw_ds", "left")
        .select("linkno", "raw_ds", "downstream_id",
                (F.col("raw_ds").isNotNull() & F.col("_known").isNull()).alias("broken"))
    )


def find_cycles(links: DataFrame) -> DataFrame:
    """Links on a loop, with ``kind`` 'self' for links that name themselves."""
    loops = doubling.on_cycles(_graph(links)).withColumnRenamed("node", "linkno")
    return links.select("linkno", "downstream_id").join(loops, "linkno", "left_semi").withColumn(
        "kind", F.when(F.col("linkno") == F.col("downstream_id"), "self").otherwise("loop")
    )


def basin_level(links: DataFrame) -> DataFrame:
    """Network id (terminal link) and number of hops to it."""
    return doubling.to_terminal(_graph(links)).select(
        F.col("node").alias("linkno"), F.col("terminal").alias("basin_id"), F.col("hops").alias("level_to_outlet")
    )


def id_mismatches(left: DataFrame, right: DataFrame, key: str, left_name: str, right_name: str) -> DataFrame:
    """Ids present on one side only, both directions."""
    a = left.select(F.col(key).alias("id")).distinct()
    b = right.select(F.col(key).alias("id")).distinct()
    return (
        a.join(b, "id", "left_anti").select("id", F.lit(f"missing_in_{right_name}").alias("problem"))
        .unionByName(b.join(a, "id", "left_anti").select("id", F.lit(f"missing_in_{left_name}").alias("problem")))
    )


# --- upstream sets ---------------------------------------------------------------------

def outlet_tree(links: DataFrame, outlets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Cut the network at the outlets.

    Returns ``(owner, tree)``: ``owner(linkno, outlet)`` names the first outlet at or
    below every link, ``tree(node, parent)`` chains outlet links to the next one.
    """
    marks = outlets.select(F.col("linkno").alias("node")).distinct()
    owner = doubling.first_marked(_graph(links), marks).select(
        F.col("node").alias("linkno"), F.col("mark").alias("outlet")
    )
    below = owner.select(F.col("linkno").alias("downstream_id"), F.col("outlet").alias("parent"))
    tree = cut(
        links.join(marks.withColumnRenamed("node", "linkno"), "linkno", "left_semi")
        .select("linkno", "downstream_id").join(below, "downstream_id", "left")
        .select(F.col("linkno").alias("node"), "parent")
    )
    return owner, tree


def upstream(links: DataFrame, outlets: DataFrame) -> DataFrame:
    """Upstream closure ``(outlet, linkno)`` of every outlet link, itself included."""
    owner, tree = outlet_tree(links, outlets)
    chains = tree.select(F.col("node").alias("_own"), F.col("node").alias("outlet")).unionByName(
        doubling.ancestors(tree).select(F.col("node").alias("_own"), F.col("ancestor").alias("outlet"))
    )
    return owner.withColumnRenamed("outlet", "_own").join(chains, "_own").select("outlet", "linkno")


def accumulate(links: DataFrame, measures: list[str]) -> DataFrame:
    """Sum of each measure and number of links at or above every link."""
    values = links.select(
        F.col("linkno").alias("node"), *[F.coalesce(F.col(m), F.lit(0.0)).alias(m) for m in measures],
        F.lit(1).cast("long").alias("upstream_count"),
    )
    out = doubling.fold_upstream(_graph(links), values, {**{m: F.sum for m in measures}, "upstream_count": F.sum})
    return out.withColumnRenamed("node", "linkno")


def rollup_to_outlets(links: DataFrame, outlets: DataFrame, values: DataFrame, aggs: dict,
                      keys: list[str] | None = None, parts=None) -> DataFrame:
    """Aggregate per-link values over each outlet's upstream set without listing the set.

    Values are combined per owning outlet first (partial aggregation), then the
    small outlet tree is folded; the closure itself is never built.
    """
    owner, tree = parts or outlet_tree(links, outlets)
    keys = keys or []
    own = values.join(owner, "linkno").groupBy(F.col("outlet").alias("node"), *keys).agg(
        *[fn(F.col(c)).alias(c) for c, fn in aggs.items()]
    )
    return doubling.fold_upstream(tree, own, aggs, keys).withColumnRenamed("node", "outlet")


# --- longest path ------------------------------------------------------------------------

def distance_to_terminal(links: DataFrame) -> DataFrame:
    """``(linkno, terminal, path_m)``: length from the link's top down to the terminal's foot."""
    graph = links.select(F.col("linkno").alias("node"), F.col("downstream_id").alias("parent"),
                         F.col("length_m").alias("length_m"))
    walked = doubling.to_terminal(graph, {"above_m": "length_m"})
    own = links.select(F.col("linkno").alias("terminal"), F.coalesce("length_m", F.lit(0.0)).alias("_t"))
    return walked.join(own, "terminal").select(
        F.col("node").alias("linkno"), "terminal", "hops", (F.col("above_m") + F.col("_t")).alias("path_m")
    )


def main_stems(links: DataFrame) -> DataFrame:
    """Longest-path decomposition: each link's headwater and the path length up to it.

    Two links share a main path exactly when they share the headwater, so the path
    of any outlet is an equality join on ``headwater`` - no walking.
    Paths of equal length (to a thousandth of a millimetre: sums differ in their last bits
    by the order of adding) are ties and go to the smaller headwater id.
    """
    dist = cut(distance_to_terminal(links))
    values = dist.select(F.col("linkno").alias("node"),
                         F.struct(F.round("path_m", 6).alias("r"), (-F.col("linkno")).alias("n"), F.col("path_m").alias("d")).alias("best"))
    best = doubling.fold_upstream(_graph(links), values, {"best": F.max})
    return (
        best.select(F.col("node").alias("linkno"), (-F.col("best.n")).alias("headwater"), F.col("best.d").alias("_top"))
        .join(dist, "linkno")
        .join(links.select("linkno", F.coalesce("length_m", F.lit(0.0)).alias("_len")), "linkno")
        .select("linkno", "headwater", "hops", F.col("path_m").alias("station_top_m"),
                (F.col("_top") - F.col("path_m") + F.col("_len")).alias("main_length_m"))
    )


def longest_path(links: DataFrame, outlets: DataFrame, stems: DataFrame | None = None) -> DataFrame:
    """``(outlet, linkno, step, main_length_m)``: links of the main path, outlet first."""
    stems = cut(main_stems(links)) if stems is None else stems
    heads = stems.join(outlets.select("linkno").distinct(), "linkno", "left_semi").select(
        F.col("linkno").alias("outlet"), "headwater", F.col("hops").alias("_from"), "main_length_m"
    )
    members = stems.select("headwater", "linkno", "hops")
    return (
        heads.join(members, "headwater").filter(F.col("hops") >= F.col("_from"))
        .select("outlet", "linkno", (F.col("hops") - F.col("_from") + 1).alias("step"), "main_length_m")
    )


# --- drainage metrics ----------------------------------------------------------------------

def strahler_heads(links: DataFrame) -> DataFrame:
    """Links that end a maximal chain of equal order: ``linkno, strm_order, is_head``."""
    below = links.select(F.col("linkno").alias("downstream_id"), F.col("strm_order").alias("_ds_order"))
    return links.filter("strm_order > 0").join(below, "downstream_id", "left").select(
        "linkno", "strm_order",
        (F.col("_ds_order").isNull() | (F.col("_ds_order") != F.col("strm_order"))).alias("is_head"),
    )


def strahler_counts(links: DataFrame, outlets: DataFrame, parts=None) -> DataFrame:
    """``(outlet, strm_order, streams, bifurcation_ratio)``.

    Inside one upstream set the outlet link always ends a stream, even when the
    reach below it has the same order.
    """
    parts = parts or outlet_tree(links, outlets)
    heads = cut(strahler_heads(links))
    values = heads.filter("is_head").select("linkno", "strm_order", F.lit(1).cast("long").alias("streams"))
    inner = rollup_to_outlets(links, outlets, values, {"streams": F.sum}, ["strm_order"], parts)
    own = heads.filter("not is_head").join(outlets.select("linkno").distinct(), "linkno", "left_semi").select(
        F.col("linkno").alias("outlet"), "strm_order", F.lit(1).cast("long").alias("streams")
    )
    counts = inner.unionByName(own).groupBy("outlet", "strm_order").agg(F.sum("streams").alias("streams"))
    w = W.partitionBy("outlet").orderBy("strm_order")
    return counts.withColumn("_next", F.lead(F.struct("strm_order", "streams")).over(w)).select(
        "outlet", "strm_order", "streams",
        F.when(F.col("_next.strm_order") == F.col("strm_order") + 1,
               F.col("streams") / F.col("_next.streams")).alias("bifurcation_ratio"),
    )


def junctions(links: DataFrame) -> DataFrame:
    """Links with two or more links draining into them."""
    return links.filter(F.col("downstream_id").isNotNull()).groupBy(F.col("downstream_id").alias("linkno")).agg(
        F.count("*").alias("incoming")
    ).filter("incoming >= 2")


def drainage_metrics(links: DataFrame, outlets: DataFrame, area: str = "area_km2") -> DataFrame:
    """Network metrics of every outlet's upstream set in one fold.

    ``links`` needs ``linkno, downstream_id, length_m, slope, strm_order`` and the local ``area``.
    """
    links = cut(links)
    parts = outlet_tree(links, outlets)
    below = links.select(F.col("linkno").alias("downstream_id"), F.col("strm_order").alias("_ds"))
    joined = links.join(below, "downstream_id", "left").join(junctions(links).select("linkno", F.lit(1).cast("long").alias("_j")), "linkno", "left")
    sloped = (F.col("length_m") > 0) & F.col("slope").isNotNull()
    head = F.col("_ds").isNull() | (F.col("_ds") != F.col("strm_order"))
    zero, one = F.lit(0).cast("long"), F.lit(1).cast("long")
    values = cut(joined.select(
        "linkno", F.coalesce("strm_order", F.lit(0)).alias("strm_order"), one.alias("link_count"), F.coalesce("length_m", F.lit(0.0)).alias("length_m"), F.coalesce(F.col(area), F.lit(0.0)).alias("area_km2"),
        F.when(sloped, F.col("slope") * F.col("length_m")).otherwise(0.0).alias("slope_m"), F.when(sloped, F.col("length_m")).otherwise(0.0).alias("sloped_m"),
        F.coalesce("_j", zero).alias("junction_count"), F.when((F.col("strm_order") > 0) & head, one).otherwise(zero).alias("streams")))
    sums = ("link_count", "length_m", "area_km2", "slope_m", "sloped_m", "junction_count", "streams")
    # one fold keyed by order carries every measure; orders are a handful per network
    by_order = rollup_to_outlets(links, outlets, values, {c: F.sum for c in sums}, ["strm_order"], parts)
    # the outlet link ends a stream of its own set even when the reach below has the same order
    extra = values.filter("streams = 0 and strm_order > 0").join(outlets.select("linkno").distinct(), "linkno", "left_semi").select(
        F.col("linkno").alias("outlet"), "strm_order", one.alias("_x"))
    by_order = by_order.join(extra, ["outlet", "strm_order"], "left").withColumn("streams", F.col("streams") + F.coalesce("_x", zero)).drop("_x")
    # orders bound this group to a few rows, so the ratio of neighbouring orders is a small window
    nxt = F.lead(F.struct("strm_order", "streams")).over(W.partitionBy("outlet").orderBy("strm_order"))
    ratio = F.when((F.col("_n.strm_order") == F.col("strm_order") + 1) & (F.col("_n.streams") > 0) & (F.col("streams") > 0), F.col("streams") / F.nullif(F.col("_n.streams"), zero))
    by_order = by_order.withColumn("_n", nxt).withColumn("_ratio", ratio)
    first = F.col("strm_order") == 1
    out = by_order.groupBy("outlet").agg(
        *[F.sum(c).alias(c) for c in sums if c != "streams"], F.sum("streams").alias("stream_count"), F.max(F.when(F.col("strm_order") > 0, F.col("strm_order"))).alias("stream_order_max"),
        F.sum(F.when(first, F.col("length_m")).otherwise(0.0)).alias("source_m"), F.sum(F.when(first, F.col("streams")).otherwise(zero)).alias("source_count"), F.avg("_ratio").alias("bifurcation_ratio"))
    return with_drainage_ratios(out)


def with_drainage_ratios(df: DataFrame) -> DataFrame:
    """Densities, frequencies and source factors from the summed measures."""
    km = F.col("length_m") / 1000.0
    area = F.when(F.col("area_km2") > 0, F.col("area_km2"))
    return df.select(
        "outlet", "link_count", "stream_count", "stream_order_max", "junction_count", "bifurcation_ratio", "area_km2",
        km.alias("total_stream_length_km"),
        (km / F.nullif(F.col("stream_count"), F.lit(0))).alias("mean_stream_length_km"),
        (km / area).alias("drainage_density"),
        (F.col("stream_count") / area).alias("stream_frequency"),
        (F.col("junction_count") / area).alias("junction_density"),
        (F.col("slope_m") / F.nullif(F.col("sloped_m"), F.lit(0.0)) * 100.0).alias("network_mean_slope_pct"),
        (F.col("source_m") / 1000.0).alias("source_stream_length_km"),
        F.col("source_count").alias("source_stream_count"),
        (F.col("source_m") / F.nullif(F.col("length_m"), F.lit(0.0))).alias("source_factor"),
        (F.col("source_count") / F.nullif(F.col("stream_count"), F.lit(0))).alias("source_frequency"),
    )


# --- relations between outlets ----------------------------------------------------------------

def point_places(links: DataFrame, points: DataFrame) -> DataFrame:
    """``points`` with the ``enter``, ``leave`` and ``depth`` of their link in the tree of outlets."""
    _, tree = outlet_tree(links, points)
    return cut(points.join(iv.tree_intervals(tree).drop("parent").withColumnRenamed("node", "linkno"), "linkno"))


def _same_area(a: str, b: str):
    return F.abs(F.col(a) - F.col(b)) <= F.greatest(F.lit(1e-6), 1e-5 * F.greatest(F.col(a), F.col(b), F.lit(1.0)))


def _shared_link_pairs(points: DataFrame) -> DataFrame:
    """Pairs of points on one link: the same outlet, or the smaller area upstream."""
    a = points.select(F.col("point_id").alias("pa"), "linkno", F.col("area_km2").alias("aa"))
    b = points.select(F.col("point_id").alias("pb"), "linkno", F.col("area_km2").alias("ab"))
    same = _same_area("aa", "ab")
    ahead = same | (F.col("aa") < F.col("ab"))
    return a.join(b, "linkno").filter("pa < pb").select(
        F.when(ahead, F.col("pa")).otherwise(F.col("pb")).alias("upstream_point"),
        F.when(ahead, F.col("pb")).otherwise(F.col("pa")).alias("downstream_point"),
        F.when(same, "same_outlet").otherwise("same_flow_path").alias("relation"),
    )


def flow_path_pairs(links: DataFrame, points: DataFrame) -> DataFrame:
    """All ordered pairs of points on one flow path: ``(upstream_point, downstream_point, relation)``.

    ``points``: ``point_id, linkno, area_km2``.  Every pair not listed here lies on
    different branches (same basin) or in different basins; those follow from the
    two basin codes alone, so they are never enumerated - see ``classify_pairs``.
    """
    across = iv.nested_pairs(point_places(links, points), ["point_id"]).select(
        F.col("inner.point_id").alias("upstream_point"), F.col("outer.point_id").alias("downstream_point"), F.lit("same_flow_path").alias("relation"))
    return across.unionByName(_shared_link_pairs(points))


def next_downstream(links: DataFrame, points: DataFrame) -> DataFrame:
    """Nearest point below each point: ``(upstream_point, downstream_point)``, one row per point at most.

    Flow-path relation is transitive, so these links carry all of it in linear size.
    Points on one link are ordered by area, then id.  ``points``: ``point_id, linkno, area_km2``.
    """
    same = ordered.neighbours(points.select("point_id", "linkno", "area_km2"), ["linkno"], ["area_km2", "point_id"], ["point_id"], ahead=True)
    _, tree = outlet_tree(links, points)
    top = points.groupBy(F.col("linkno").alias("parent")).agg(F.min(F.struct("area_km2", "point_id")).alias("_f")).select("parent", F.col("_f.point_id").alias("_below"))
    below = tree.join(top, "parent").select(F.col("node").alias("linkno"), "_below")
    return same.join(below, "linkno", "left").select(F.col("point_id").alias("upstream_point"), F.coalesce(F.col("next.point_id"), F.col("_below")).alias("downstream_point")).filter(
        "downstream_point is not null")


def _placed(points: DataFrame, name: str) -> DataFrame:
    return points.select(F.col("point_id").alias(f"point_{name}"), F.struct("linkno", "area_km2", "enter", "leave", *(["basin_code"] if "basin_code" in points.columns else [])).alias(name))


def classify_pairs(pairs: DataFrame, links: DataFrame, points: DataFrame) -> DataFrame:
    """Relation of each requested pair ``(point_a, point_b)``: two comparisons of enter and leave numbers."""
    placed = point_places(links, points)
    j = pairs.join(_placed(placed, "a"), "point_a").join(_placed(placed, "b"), "point_b")
    shared = (F.col("a.linkno") == F.col("b.linkno")) & (F.col("point_a") != F.col("point_b"))
    same = shared & _same_area("a.area_km2", "b.area_km2")
    # on one link the smaller area is upstream, and of equal areas the smaller id is named first
    first = F.when(same, F.col("point_a") < F.col("point_b")).otherwise(F.col("a.area_km2") < F.col("b.area_km2"))
    up = F.when(shared, first).when(iv.inside("a", "b"), True).when(iv.inside("b", "a"), False)
    return j.withColumn("_up", up).select(
        "point_a", "point_b",
        F.when(same, "same_outlet").when(F.col("_up").isNotNull(), "same_flow_path").when(F.col("a.basin_code") == F.col("b.basin_code"), "same_basin_different_branch")
        .otherwise("different_basin").alias("relation"),
        F.when(F.col("_up"), F.col("point_a")).when(~F.col("_up"), F.col("point_b")).alias("upstream_point"),
        F.when(F.col("_up"), F.col("point_b")).when(~F.col("_up"), F.col("point_a")).alias("downstream_point"))


def relation_counts(links: DataFrame, points: DataFrame) -> DataFrame:
    """Number of partners of each point per relation, without listing pairs of different links.

    Partners up and down the flow path are counted on the line of enter and leave numbers, once over all points and
    once among those of the same basin code.
    """
    placed = point_places(links, points)
    both = F.col("above") + F.col("below")
    every = iv.counts_along(placed, [], ["point_id"]).select("point_id", both.alias("_path"))
    coded = iv.counts_along(placed, ["basin_code"], ["point_id"]).select("point_id", both.alias("_in_path"))
    shared = _shared_link_pairs(points)
    mine = shared.select(F.col("upstream_point").alias("point_id"), F.col("downstream_point").alias("_o"), "relation").unionByName(
        shared.select(F.col("downstream_point").alias("point_id"), F.col("upstream_point").alias("_o"), "relation"))
    code = points.select(F.col("point_id").alias("_o"), F.col("basin_code").alias("_oc"))
    own = points.select("point_id", "basin_code")
    linked = mine.join(code, "_o").join(own, "point_id").groupBy("point_id").agg(
        F.count_if(F.col("relation") == "same_outlet").alias("_so"), F.count_if(F.col("relation") == "same_flow_path").alias("_sp"), F.count_if(F.col("_oc") == F.col("basin_code")).alias("_si"))
    per_code = points.groupBy("basin_code").agg(F.count("*").alias("_n"))
    total = points.count()
    zero = F.lit(0)
    so, sp, si = (F.coalesce(c, zero) for c in ("_so", "_sp", "_si"))
    path = F.coalesce("_path", zero) + sp
    within = F.coalesce(F.col("_n"), F.lit(1)) - 1 - F.coalesce("_in_path", zero) - si
    return (
        own.join(small(per_code), "basin_code", "left").join(every, "point_id", "left").join(coded, "point_id", "left").join(linked, "point_id", "left")
        .select("point_id", so.cast("long").alias("same_outlet"), path.cast("long").alias("same_flow_path"), within.cast("long").alias("same_basin_different_branch"),
                (F.lit(total) - 1 - so - path - within).cast("long").alias("different_basin"))
    )


def chain_segments(links: DataFrame, points: DataFrame) -> DataFrame:
    """Consecutive outlets by (area, id) within a network and the area between them.

    ``is_chain`` says whether every outlet of the network drains into the next one.
    ``points``: ``point_id, linkno, area_km2, basin_id``.
    """
    placed = point_places(links, points)
    near = ordered.neighbours(placed, ["basin_id"], ["area_km2", "point_id"], ["point_id", "area_km2", "linkno", "enter", "leave"], ahead=True)
    # on one link the next by (area, id) is downstream
    linked = (F.col("linkno") == F.col("next.linkno")) | ((F.col("next.enter") < F.col("enter")) & (F.col("enter") < F.col("next.leave")))
    steps = near.filter("next is not null").select(
        "basin_id", F.col("point_id").alias("upstream_point"), F.col("next.point_id").alias("downstream_point"),
        F.greatest(F.lit(0.0), F.col("next.area_km2") - F.col("area_km2")).alias("incremental_area_km2"), linked.alias("linked"))
    flag = steps.groupBy("basin_id").agg(F.bool_and("linked").alias("is_chain"))
    return steps.join(flag, "basin_id").select("basin_id", "upstream_point", "downstream_point", "incremental_area_km2", "linked", "is_chain")


def incremental_area(tree: DataFrame, areas: DataFrame) -> DataFrame:
    """Area of each outlet minus the areas of the outlets draining directly into it."""
    nested = tree.filter(F.col("parent").isNotNull()).join(areas.withColumnRenamed("outlet", "node"), "node")
    taken = nested.groupBy(F.col("parent").alias("outlet")).agg(F.sum("area_km2").alias("_taken"))
    return areas.join(taken, "outlet", "left").select(
        "outlet", "area_km2",
        F.greatest(F.lit(0.0), F.col("area_km2") - F.coalesce("_taken", F.lit(0.0))).alias("incremental_area_km2"))
