"""Main-channel operators that combine topology and geometry."""

from __future__ import annotations


from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catchwise.operators import doubling
from catchwise.operators.spatial import _projected, near_segments
from catchwise.runtime import cut, small, union_all


def _distance_to_link(points: DataFrame, segs: DataFrame, link_col: str) -> DataFrame:
    """Distance of each point to the link named in ``link_col``: adds ``d`` per row."""
    s = segs.select(F.col("linkno").alias(link_col), "x1", "y1", "x2", "y2")
    return _projected(points.join(s, link_col))


def reach_outlet(links: DataFrame, segs: DataFrame) -> DataFrame:
    """Downstream end point of each reach from topology, with the method used.

    Nearest end to the downstream reach; at a network outlet the end farthest from
    the incoming reaches; an isolated reach keeps its last point.
    """
    ends = segs.groupBy("linkno").agg(F.min_by(F.struct("x1", "y1"), F.struct("part", "seq")).alias("a"), F.max_by(F.struct("x2", "y2"), F.struct("part", "seq")).alias("b"))
    tips = ends.select("linkno", F.explode(F.array(F.struct(F.lit(0).alias("i"), F.col("a.x1").alias("x"), F.col("a.y1").alias("y")),
                                                   F.struct(F.lit(1).alias("i"), F.col("b.x2").alias("x"), F.col("b.y2").alias("y")))).alias("t")).select("linkno", "t.*")
    tips = cut(tips)
    down = tips.join(links.filter("downstream_id is not null").select("linkno", "downstream_id"), "linkno")
    d_down = _distance_to_link(down, segs, "downstream_id").groupBy("linkno", "i", "x", "y").agg(F.min("d").alias("d"))
    by_down = d_down.groupBy("linkno").agg(F.min(F.struct(F.round("d", 7).alias("d"), "i", "x", "y")).alias("_d"))
    up = tips.join(links.filter("downstream_id is not null").select(F.col("downstream_id").alias("linkno"), F.col("linkno").alias("up_id")), "linkno")
    d_up = _distance_to_link(up, segs, "up_id").groupBy("linkno", "i", "x", "y").agg(F.min("d").alias("d"))
    by_up = d_up.groupBy("linkno").agg(F.max(F.struct(F.round("d", 7).alias("d"), (-F.col("i")).alias("k"), "x", "y")).alias("_u"))
    last = tips.filter("i = 1").select("linkno", F.struct("x", "y").alias("_l"))
    return last.join(by_down, "linkno", "left").join(by_up, "linkno", "left").select(
        "linkno", F.coalesce(F.col("_d.x"), F.col("_u.x"), F.col("_l.x")).alias("outlet_x"), F.coalesce(F.col("_d.y"), F.col("_u.y"), F.col("_l.y")).alias("outlet_y"),
        F.when(F.col("_d").isNotNull(), "nearest_downstream_reach").when(F.col("_u").isNotNull(), "farthest_from_upstream_reaches").otherwise("source_end_fallback").alias("method"))


def roots(links: DataFrame, members: DataFrame, segs: DataFrame, outlets: DataFrame) -> DataFrame:
    """Root reaches of each catchment: links whose downstream link lies outside it.

    ``members``: ``point_id, linkno``; ``outlets``: ``point_id, x, y``.  ``chosen`` marks
    the roots nearest to the outlet, within max(0.01, distance * 1e-6).
    """
    own = members.join(links.select("linkno", "downstream_id"), "linkno")
    inside = members.select("point_id", F.col("linkno").alias("downstream_id"))
    top = own.join(inside, ["point_id", "downstream_id"], "left_anti").select("point_id", "linkno")
    d = _projected(top.join(outlets.select("point_id", "x", "y"), "point_id").join(segs.select("linkno", "x1", "y1", "x2", "y2"), "linkno")).groupBy("point_id", "linkno").agg(F.min("d").alias("distance_m"))
    best = d.groupBy("point_id").agg(F.min("distance_m").alias("_m"))
    limit = F.col("_m") + F.greatest(F.lit(0.01), F.col("_m") * 1e-6)
    return d.join(best, "point_id").select("point_id", "linkno", "distance_m", (F.col("distance_m") <= limit).alias("chosen"))


def reselect_root(candidates: DataFrame) -> DataFrame:
    """Pick the root path; when it is shorter than 0.98 of the centroidal path, look at roots near the outlet.

    ``candidates``: ``point_id, linkno, distance_m, chosen, path_m, expected_m, centroid_m``.
    """
    near = candidates.groupBy("point_id").agg(F.min("distance_m").alias("_near"))
    c = candidates.join(near, "point_id")
    reach = F.col("_near") + F.greatest(F.lit(1000.0), F.least(F.lit(5000.0), F.coalesce("expected_m", "centroid_m") * 0.03))
    first = c.filter("chosen").groupBy("point_id").agg(F.max(F.struct("path_m", (-F.col("linkno")).alias("n"))).alias("_f"))
    ok = c.filter((F.col("path_m") >= F.col("centroid_m") * 0.98) & (F.col("distance_m") <= reach))
    other = ok.groupBy("point_id").agg(F.min(F.struct(F.abs(F.col("path_m") - F.coalesce("expected_m", "path_m")).alias("g"), "distance_m", "linkno", "path_m")).alias("_o"))
    lim = candidates.groupBy("point_id").agg(F.max("centroid_m").alias("_c"))
    j = first.join(other, "point_id", "left").join(lim, "point_id")
    swap = (F.col("_f.path_m") < F.col("_c") * 0.98) & F.col("_o").isNotNull()
    return j.select("point_id", F.when(swap, F.col("_o.linkno")).otherwise(-F.col("_f.n")).alias("linkno"),
                    F.when(swap, F.col("_o.path_m")).otherwise(F.col("_f.path_m")).alias("path_m"), (swap & (F.col("_o.linkno") != -F.col("_f.n"))).alias("reselected"))


def link_fit(segs: DataFrame, reference: DataFrame, reference_m: float) -> DataFrame:
    """Agreement of each link with a reference flow path: ``linkno, length_m, fit, progress_m``.

    Points sampled along the link are matched to the nearest reference segment
    (``seg_id, x1, y1, x2, y2, station``); fit = .40 mean exp(-(d/s)^2) + .30 progress
    + .20 exp(-(median d / s)^2) + .10 share within s.
    """
    tol = max(75.0, min(750.0, reference_m * 0.004))
    scale = max(350.0, tol, min(1800.0, 0.025 * reference_m))
    corridor = max(600.0, scale * 1.35)
    length = F.hypot(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1"))
    n = F.greatest(F.lit(7), F.least(F.lit(25), F.ceil(length / tol).cast("int") + 5))
    s = segs.withColumns({"_len": length, "_n": n}).filter("_len > 0").withColumn("i", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))
    f = F.col("i") / (F.col("_n") - 1)
    pts = cut(s.select("linkno", "part", "seq", "i", "_len", (F.col("x1") + f * (F.col("x2") - F.col("x1"))).alias("x"), (F.col("y1") + f * (F.col("y2") - F.col("y1"))).alias("y")))
    ids = ["linkno", "part", "seq", "i"]
    # the nearest segment counts however far it lies: rings grow until every sample has one
    at = F.col("station") + F.col("t") * F.hypot(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1"))
    line = cut(reference.select("seg_id", "station", "x1", "y1", "x2", "y2"))
    reach, missing, found = max(4 * scale, corridor), pts.select(*ids, "x", "y").filter("x is not null and y is not null"), []
    while reach < 1e12 and not line.isEmpty() and not missing.isEmpty():
        hit = near_segments(missing, line, reach)
        found.append(cut(hit.groupBy(*ids).agg(F.min(F.struct(F.round("d", 7).alias("d"), at.alias("s"))).alias("_b"))))
        missing, reach = cut(missing.join(found[-1].select(*ids), ids, "left_anti")), reach * 2
    best = union_all(found) if found else pts.limit(0).select(*ids, F.struct(F.lit(0.0).alias("d"), F.lit(0.0).alias("s")).alias("_b"))
    j = pts.join(best, ids, "left")
    d = F.col("_b.d")
    part = j.groupBy("linkno", "part", "seq").agg(
        F.first("_len").alias("_len"), F.avg(F.coalesce(F.exp(-(d / scale) * (d / scale)), F.lit(0.0))).alias("_p"),
        F.avg(F.coalesce((d <= scale).cast("double"), F.lit(0.0))).alias("_c"), (F.max("_b.s") - F.min("_b.s")).alias("_span"),
        F.percentile(F.coalesce(d, F.lit(1e9)), 0.5).alias("_md"), F.max(F.when(d <= corridor, F.col("_b.s"))).alias("_pg"))
    prog = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(F.col("_span") / F.greatest(F.col("_len"), F.lit(1e-9)), F.lit(0.0))))
    fit = 0.40 * F.col("_p") + 0.30 * prog + 0.20 * F.exp(-(F.col("_md") / scale) * (F.col("_md") / scale)) + 0.10 * F.col("_c")
    return part.groupBy("linkno").agg(F.sum("_len").alias("length_m"), F.sum(F.col("_len") * fit).alias("fit"), F.coalesce(F.max("_pg"), F.lit(0.0)).alias("progress_m"))


def aligned_path(links: DataFrame, fits: DataFrame, outlets: DataFrame, reference_m: float) -> DataFrame:
    """Main path by agreement with the reference: ``outlet, linkno, step``.

    Each headwater-to-outlet path scores ``progress_ratio * (.35 + .65 mean fit)``; the
    candidates of an outlet are the headwaters above it, compared on sums carried
    down the network by pointer doubling.
    """
    from catchwise.operators import network as net

    graph = links.select("linkno", "downstream_id", "length_m").join(small(fits.select("linkno", "fit", "progress_m")), "linkno", "left").select(
        F.col("linkno").alias("node"), F.col("downstream_id").alias("parent"), F.coalesce("length_m", F.lit(0.0)).alias("length_m"),
        F.coalesce("fit", F.lit(0.0)).alias("fit"), F.coalesce("progress_m", F.lit(0.0)).alias("progress_m"))
    graph = cut(graph)
    down = cut(doubling.to_terminal(graph, {"len_below": "length_m", "fit_below": "fit"}))
    heads = graph.select("node").join(graph.select(F.col("parent").alias("node")), "node", "left_anti")
    chain = cut(net.upstream(links, outlets)).withColumnRenamed("linkno", "node")
    cand = chain.join(heads, "node", "left_semi").join(down, "node").join(graph.select("node", "length_m", "fit"), "node")
    base = down.select(F.col("node").alias("outlet"), F.col("len_below").alias("_ol"), F.col("fit_below").alias("_of"), F.col("hops").alias("_oh"))
    own = graph.select(F.col("node").alias("outlet"), F.col("length_m").alias("_xl"), F.col("fit").alias("_xf"))
    cand = cand.join(base, "outlet").join(own, "outlet").select(
        "outlet", F.col("node").alias("head"), (F.col("len_below") - F.col("_ol") + F.col("_xl")).alias("path_m"), (F.col("fit_below") - F.col("_of") + F.col("_xf")).alias("fit"),
        F.col("hops").alias("_hh"), "_oh")
    # furthest progress over the links of a candidate path: path links are the head's ancestors
    steps = doubling.ancestors(graph.select("node", "parent")).join(heads, "node", "left_semi").unionByName(heads.select("node", F.col("node").alias("ancestor")))
    hops = down.select(F.col("node").alias("ancestor"), "hops")
    on_path = cut(steps.join(hops, "ancestor").join(graph.select(F.col("node").alias("ancestor"), "progress_m"), "ancestor").withColumnRenamed("node", "head"))
    prog = cand.join(on_path, "head").filter(F.col("hops") >= F.col("_oh")).groupBy("outlet", "head").agg(F.max("progress_m").alias("progress_m"))
    ratio = F.col("progress_m") / reference_m
    mean = F.coalesce(F.col("fit") / F.nullif(F.col("path_m"), F.lit(0.0)), F.lit(0.0))
    key = F.struct((ratio * (0.35 + 0.65 * mean)).alias("s"), ratio.alias("r"), mean.alias("m"), F.col("path_m"), (-F.col("head")).alias("h"))
    best = cand.join(prog, ["outlet", "head"]).groupBy("outlet").agg(F.max(key).alias("_b"), F.first("_oh").alias("_oh")).select("outlet", (-F.col("_b.h")).alias("head"), F.col("_b.s").alias("score"), "_oh")
    return best.join(on_path, "head").filter(F.col("hops") >= F.col("_oh")).select("outlet", F.col("ancestor").alias("linkno"), (F.col("hops") - F.col("_oh") + 1).alias("step"), "score")


def assemble_channel(path: DataFrame, segs: DataFrame) -> DataFrame:
    """Outlet-to-upstream line of each main path with every link turned the right way.

    ``path``: ``outlet, linkno, step``; ``segs`` one chain per link.  A link is flipped
    when its far end is nearer to the previous link; adds the station at its start.
    """
    from catchwise.operators import ordered

    ends = segs.groupBy("linkno").agg(F.min_by(F.struct("x1", "y1"), F.struct("part", "seq")).alias("a"), F.max_by(F.struct("x2", "y2"), F.struct("part", "seq")).alias("b"),
                                      F.sum(F.hypot(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1"))).alias("length_m"))
    p = path.select("outlet", "linkno", "step").join(ends, "linkno")
    prev = p.select("outlet", (F.col("step") + 1).alias("step"), F.col("a").alias("pa"), F.col("b").alias("pb"))
    j = p.join(prev, ["outlet", "step"], "left")
    def gap(x, y, q):
        return F.least(F.hypot(x - F.col(f"{q}a.x1"), y - F.col(f"{q}a.y1")), F.hypot(x - F.col(f"{q}b.x2"), y - F.col(f"{q}b.y2")))
    flipped = F.coalesce(gap(F.col("b.x2"), F.col("b.y2"), "p") < gap(F.col("a.x1"), F.col("a.y1"), "p"), F.lit(False))
    j = j.withColumn("flipped", flipped)
    run = ordered.running_sum(j, ["outlet"], ["step"], {"_cum": "length_m"})
    return run.select("outlet", "linkno", "step", "flipped", "length_m", (F.col("_cum") - F.col("length_m")).alias("station_m"),
                      F.when(F.col("flipped"), F.struct(F.col("b.x2").alias("x"), F.col("b.y2").alias("y"))).otherwise(F.struct(F.col("a.x1").alias("x"), F.col("a.y1").alias("y"))).alias("start"))


