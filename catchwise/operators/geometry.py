"""Polygons and lines as edge and segment tables.

``edges``: ``poly_id, part, ring, seq, x1, y1, x2, y2`` (ring 0 = outer boundary,
counter-clockwise; holes clockwise).  ``segments``: ``linkno, part, seq, x1, y1, x2, y2``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from catchwise.operators import ordered
from catchwise.runtime import small

HOLE_AREA_M2 = 62_500.0


def _cross() -> Column:
    return F.col("x1") * F.col("y2") - F.col("x2") * F.col("y1")


def ring_areas(edges: DataFrame) -> DataFrame:
    """Unsigned area of every ring."""
    return edges.groupBy("poly_id", "part", "ring").agg((F.abs(F.sum(_cross())) / 2).alias("ring_area"))


def polygon_measures(edges: DataFrame) -> DataFrame:
    """Area, perimeter and centroid of each polygon; holes count negative through their direction."""
    cr = _cross()
    agg = edges.groupBy("poly_id").agg(
        (F.sum(cr) / 2).alias("area"), F.sum(F.hypot(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1"))).alias("perimeter"),
        F.sum((F.col("x1") + F.col("x2")) * cr).alias("_mx"), F.sum((F.col("y1") + F.col("y2")) * cr).alias("_my"))
    six = F.nullif(F.col("area") * 6, F.lit(0.0))
    return agg.select("poly_id", "area", "perimeter", (F.col("_mx") / six).alias("cx"), (F.col("_my") / six).alias("cy"))


def largest_component(edges: DataFrame) -> DataFrame:
    """Edges of the part with the largest net area (smaller part number on ties)."""
    size = edges.groupBy("poly_id", "part").agg((F.sum(_cross()) / 2).alias("_a"))
    best = size.groupBy("poly_id").agg(F.max(F.struct("_a", (-F.col("part")).alias("p"))).alias("_b"))
    keep = best.select("poly_id", (-F.col("_b.p")).alias("part"))
    return edges.join(keep, ["poly_id", "part"], "left_semi")


def clean_polygon(edges: DataFrame, min_hole_m2: float = HOLE_AREA_M2) -> DataFrame:
    """Fill holes below the size threshold."""
    tiny = ring_areas(edges.filter("ring > 0")).filter(F.col("ring_area") < min_hole_m2)
    return edges.join(tiny, ["poly_id", "part", "ring"], "left_anti")


def topology_tolerances(df: DataFrame, cell: str = "cell_m") -> DataFrame:
    """Area, snapping and contact tolerances that follow from the raster cell size."""
    c = F.col(cell)
    return df.withColumns({
        "area_tolerance_m2": 4 * c * c, "snap_tolerance_m": F.least(F.lit(60.0), F.greatest(F.lit(12.0), 1.5 * c)),
        "contact_tolerance_m": F.least(F.lit(2.0), F.greatest(F.lit(0.5), 0.05 * c))})


def dissolve(edges: DataFrame, groups: DataFrame) -> DataFrame:
    """Boundary edges of polygon groups: an edge shared by two members cancels.

    ``groups``: ``group_id, poly_id``.  Neighbours must share vertices; each edge keeps
    the direction it had on its only owner.
    """
    lo = F.when((F.col("x1") < F.col("x2")) | ((F.col("x1") == F.col("x2")) & (F.col("y1") <= F.col("y2"))), True).otherwise(False)
    g = edges.join(groups, "poly_id").withColumns({
        "ax": F.when(lo, F.col("x1")).otherwise(F.col("x2")), "ay": F.when(lo, F.col("y1")).otherwise(F.col("y2")),
        "bx": F.when(lo, F.col("x2")).otherwise(F.col("x1")), "by": F.when(lo, F.col("y2")).otherwise(F.col("y1"))})
    return g.groupBy("group_id", "ax", "ay", "bx", "by").agg(
        F.count("*").alias("_n"), F.first(F.struct("x1", "y1", "x2", "y2")).alias("_e")).filter("_n = 1").select("group_id", "_e.*")


def missing_polygons(groups: DataFrame, edges: DataFrame) -> DataFrame:
    """Group members without a polygon (an error for the group)."""
    return groups.join(edges.select("poly_id").distinct(), "poly_id", "left_anti")


def outside_mask(dissolved: DataFrame, world: tuple[float, float, float, float] = (-180.0, -90.0, 180.0, 90.0)) -> DataFrame:
    """World rectangle with the coverage boundary as holes: ``ring, x1, y1, x2, y2``."""
    spark = dissolved.sparkSession
    a, b, c, d = world
    outer = spark.createDataFrame([(0, a, b, c, b), (0, c, b, c, d), (0, c, d, a, d), (0, a, d, a, b)], "ring int, x1 double, y1 double, x2 double, y2 double")
    holes = dissolved.select(F.lit(1).alias("ring"), F.col("x2").alias("x1"), F.col("y2").alias("y1"), F.col("x1").alias("x2"), F.col("y1").alias("y2"))
    return outer.unionByName(holes)


def cumulative_distance(vertices: DataFrame, key: str) -> DataFrame:
    """Distance along a vertex sequence: ``station`` of ``key, seq, x, y``."""
    seq = ordered.neighbours(vertices, [key], ["seq"], ["x", "y"], ahead=False)
    step = F.coalesce(F.hypot(F.col("x") - F.col("prev.x"), F.col("y") - F.col("prev.y")), F.lit(0.0))
    return ordered.running_sum(seq.withColumn("_step", step).drop("prev"), [key], ["seq"], {"station": "_step"}).drop("_step")


def line_length_m(vertices: DataFrame, key: str) -> DataFrame:
    """Great-circle length of polylines in lon/lat: ``key, length_m``."""
    from catchwise.functions.projection import haversine_m

    seq = ordered.neighbours(vertices, [key], ["seq"], ["lon", "lat"], ahead=False).filter("prev is not null")
    step = haversine_m(F.col("prev.lon"), F.col("prev.lat"), F.col("lon"), F.col("lat"))
    return seq.groupBy(key).agg(F.sum(step).alias("length_m"))


def densify(edges: DataFrame, step: Column) -> DataFrame:
    """Split edges into equal pieces no longer than ``step``: ``poly_id, part, ring, seq, piece, x1..y2``."""
    length = F.hypot(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1"))
    n = F.greatest(F.lit(1), F.ceil(length / step)).cast("int")
    out = edges.withColumn("_n", n).withColumn("piece", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))
    a, b = F.col("piece") / F.col("_n"), (F.col("piece") + 1) / F.col("_n")
    dx, dy = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    return out.select("poly_id", "part", "ring", "seq", "piece", (F.col("x1") + a * dx).alias("x1"), (F.col("y1") + a * dy).alias("y1"),
                      (F.col("x1") + b * dx).alias("x2"), (F.col("y1") + b * dy).alias("y2"))


# --- rectangle and half-plane cuts ---------------------------------------------------------

def _clamped(y: Column, lo: Column, hi: Column) -> Column:
    return F.greatest(lo, F.least(hi, y))


def _antiderivative(y: Column, lo: Column, hi: Column) -> Column:
    """Integral of clamp(y, lo, hi) from lo to y."""
    return (F.when(y <= lo, lo * (y - lo)).when(y <= hi, (y * y - lo * lo) / 2).otherwise((hi * hi - lo * lo) / 2 + hi * (y - hi)))


def cell_weights(edges: DataFrame, *, x0: float, y0: float, cell: float, width: int, height: int) -> DataFrame:
    """Exact area of every grid cell inside every polygon: ``poly_id, row, col, w``.

    Cutting a polygon with a rectangle only clamps the height under each edge, so each
    edge adds a closed-form integral to the cells of the columns it spans.  The window
    is the polygon's own bounding box.
    """
    box = edges.groupBy("poly_id").agg(F.max(F.greatest("y1", "y2")).alias("_top"), F.min(F.least("y1", "y2")).alias("_bot"))
    e = edges.filter("x1 <> x2").join(small(box), "poly_id")
    def col_of(x):
        return F.floor((x - x0) / cell).cast("int")
    def row_of(y):
        return F.floor((y0 - y) / cell).cast("int")
    c_lo, c_hi = F.greatest(F.lit(0), col_of(F.least("x1", "x2"))), F.least(F.lit(width - 1), col_of(F.greatest("x1", "x2")))
    r_lo, r_hi = F.greatest(F.lit(0), row_of(F.col("_top"))), F.least(F.lit(height - 1), row_of(F.col("_bot")))
    e = e.withColumns({"_c0": c_lo, "_c1": c_hi, "_r0": r_lo, "_r1": r_hi}).filter("_c0 <= _c1 and _r0 <= _r1")
    e = e.withColumn("col", F.explode(F.sequence("_c0", "_c1"))).withColumn("row", F.explode(F.sequence("_r0", "_r1")))
    left, right = x0 + F.col("col") * cell, x0 + (F.col("col") + 1) * cell
    hi, lo = y0 - F.col("row") * cell, y0 - (F.col("row") + 1) * cell
    m = (F.col("y2") - F.col("y1")) / (F.col("x2") - F.col("x1"))
    xa, xb = _clamped(F.col("x1"), left, right), _clamped(F.col("x2"), left, right)
    e = e.withColumns({"_xa": xa, "_xb": xb, "_m": m, "_lo": lo, "_hi": hi})
    ya = F.col("y1") + F.col("_m") * (F.col("_xa") - F.col("x1"))
    yb = F.col("y1") + F.col("_m") * (F.col("_xb") - F.col("x1"))
    flat = F.abs(yb - ya) < 1e-9
    under = F.when(flat, _clamped((ya + yb) / 2, F.col("_lo"), F.col("_hi")) * (F.col("_xb") - F.col("_xa"))).otherwise(
        (_antiderivative(yb, F.col("_lo"), F.col("_hi")) - _antiderivative(ya, F.col("_lo"), F.col("_hi"))) / F.nullif(F.col("_m"), F.lit(0.0)))
    # counter-clockwise rings run right to left along the top, hence the minus sign
    piece = -(under - F.col("_lo") * (F.col("_xb") - F.col("_xa")))
    return e.withColumn("_p", piece).groupBy("poly_id", "row", "col").agg(F.sum("_p").alias("w")).filter(F.col("w") > 1e-6)


def half_plane_area(edges: DataFrame, axes: DataFrame) -> DataFrame:
    """Area of each polygon on the far side of a divider: ``poly_id, area, upstream_area``.

    ``axes``: ``poly_id, ox, oy, ax, ay``; the divider passes through ``a`` square to
    ``o -> a`` and the far side looks away from ``o``.  In the axis frame the part
    beyond the divider is the integral of ``max(u, 0)`` along the edges.
    """
    j = edges.join(small(axes), "poly_id")
    n = F.hypot(F.col("ax") - F.col("ox"), F.col("ay") - F.col("oy"))
    j = j.withColumn("_n", n).filter("_n > 1e-9")
    ux, uy = (F.col("ax") - F.col("ox")) / F.col("_n"), (F.col("ay") - F.col("oy")) / F.col("_n")
    def along(x, y):
        return (x - F.col("ax")) * ux + (y - F.col("ay")) * uy
    def across(x, y):
        return -(x - F.col("ax")) * uy + (y - F.col("ay")) * ux
    j = j.withColumns({"_u1": along(F.col("x1"), F.col("y1")), "_u2": along(F.col("x2"), F.col("y2")),
                       "_v1": across(F.col("x1"), F.col("y1")), "_v2": across(F.col("x2"), F.col("y2"))})
    du, dv = F.col("_u2") - F.col("_u1"), F.col("_v2") - F.col("_v1")
    def half_square(u):
        return F.when(u > 0, u * u / 2).otherwise(0.0)
    piece = F.when(F.abs(du) < 1e-12, F.greatest(F.lit(0.0), F.col("_u1")) * dv).otherwise(
        dv * (half_square(F.col("_u2")) - half_square(F.col("_u1"))) / F.nullif(du, F.lit(0.0)))
    return j.withColumn("_p", piece).groupBy("poly_id").agg((F.sum(_cross()) / 2).alias("area"), F.sum("_p").alias("upstream_area"))


def sections(edges: DataFrame, axes: DataFrame) -> DataFrame:
    """Parts of the divider inside the polygon: ``poly_id, tag, v0, v1, length`` along the divider.

    ``axes``: ``poly_id, tag, ox, oy, ax, ay``.  Crossings are sorted along the divider and
    paired; the array holds one polygon's crossings with one line.
    """
    j = edges.join(small(axes), "poly_id")
    n = F.hypot(F.col("ax") - F.col("ox"), F.col("ay") - F.col("oy"))
    j = j.withColumn("_n", n).filter("_n > 1e-9")
    ux, uy = (F.col("ax") - F.col("ox")) / F.col("_n"), (F.col("ay") - F.col("oy")) / F.col("_n")
    u1 = (F.col("x1") - F.col("ax")) * ux + (F.col("y1") - F.col("ay")) * uy
    u2 = (F.col("x2") - F.col("ax")) * ux + (F.col("y2") - F.col("ay")) * uy
    v1 = -(F.col("x1") - F.col("ax")) * uy + (F.col("y1") - F.col("ay")) * ux
    v2 = -(F.col("x2") - F.col("ax")) * uy + (F.col("y2") - F.col("ay")) * ux
    j = j.withColumns({"_u1": u1, "_u2": u2, "_v1": v1, "_v2": v2}).filter("(_u1 > 0) <> (_u2 > 0)")
    at = F.col("_v1") + (0 - F.col("_u1")) / F.nullif(F.col("_u2") - F.col("_u1"), F.lit(0.0)) * (F.col("_v2") - F.col("_v1"))
    got = j.withColumn("_v", at).groupBy("poly_id", "tag").agg(F.sort_array(F.collect_list("_v")).alias("_vs"))
    pairs = F.transform(F.sequence(F.lit(0), F.floor(F.size("_vs") / 2).cast("int") - 1), lambda i: F.struct(
        F.element_at("_vs", (2 * i + 1).cast("int")).alias("v0"), F.element_at("_vs", (2 * i + 2).cast("int")).alias("v1")))
    return got.filter(F.size("_vs") >= 2).select("poly_id", "tag", F.inline(pairs)).withColumn("length", F.col("v1") - F.col("v0"))


def section_width(parts: DataFrame) -> DataFrame:
    """Width of the part holding or nearest to the anchor: ``poly_id, tag, width``."""
    gap = F.greatest(F.lit(0.0), F.col("v0"), -F.col("v1"))
    return parts.groupBy("poly_id", "tag").agg(F.min(F.struct(F.round(gap, 9).alias("g"), F.col("v0"), F.col("length"))).alias("_b")).select(
        "poly_id", "tag", F.col("_b.length").alias("width"))


def gama_shape(edges: DataFrame, stations: DataFrame) -> DataFrame:
    """Widths at a quarter and three quarters of L, their ratio, RUA and SIM.

    ``stations``: ``poly_id, ox, oy`` (outlet), ``qx, qy`` (1/4 L), ``tx, ty`` (3/4 L),
    ``lx, ly`` (upstream end of the centroidal path).
    """
    def axis(tag, x, y):
        return stations.select("poly_id", F.lit(tag).alias("tag"), "ox", "oy", F.col(x).alias("ax"), F.col(y).alias("ay"))

    w = section_width(sections(edges, axis("WL", "qx", "qy").unionByName(axis("WU", "tx", "ty"))))
    widths = w.groupBy("poly_id").agg(F.max(F.when(F.col("tag") == "WL", F.col("width"))).alias("wl"), F.max(F.when(F.col("tag") == "WU", F.col("width"))).alias("wu"))
    au = half_plane_area(edges, stations.select("poly_id", "ox", "oy", F.col("lx").alias("ax"), F.col("ly").alias("ay")))
    rua = F.col("upstream_area") / F.nullif(F.col("area"), F.lit(0.0))
    ok = F.when((rua > 0) & (rua <= 1), rua)
    wf = F.col("wu") / F.when(F.col("wl") > 0, F.col("wl"))
    return widths.join(au, "poly_id", "outer").select("poly_id", "wl", "wu", wf.alias("width_factor"), F.when(ok.isNotNull(), F.col("upstream_area")).alias("upstream_area"),
                                                      ok.alias("relative_upstream_area"), (wf * ok).alias("symmetry_factor"))


def gama_construction(stations: DataFrame) -> DataFrame:
    """Audit points and axes of the construction: ``poly_id, parameter, kind, x1, y1, x2, y2``."""
    def point(tag, x, y):
        return F.struct(F.lit(tag).alias("parameter"), F.lit("point").alias("kind"), F.col(x).alias("x1"), F.col(y).alias("y1"), F.col(x).alias("x2"), F.col(y).alias("y2"))
    def line(tag, x, y):
        return F.struct(F.lit(tag).alias("parameter"), F.lit("line").alias("kind"), F.col("ox").alias("x1"), F.col("oy").alias("y1"), F.col(x).alias("x2"), F.col(y).alias("y2"))
    items = F.array(point("X", "ox", "oy"), point("A", "qx", "qy"), point("B", "tx", "ty"), point("C", "lx", "ly"),
                    line("XA", "qx", "qy"), line("XB", "tx", "ty"), line("XC", "lx", "ly"))
    return stations.select("poly_id", F.inline(items)).withColumn("length_m", F.hypot(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")))
