"""Finished boundaries of cell catchments: rings, contact with the official boundary, stitching, smoothing, gates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catchwise.operators import boundary as bd
from catchwise.operators import geometry as ge
from catchwise.operators import ordered, rings
from catchwise.runtime import cut, small
from catchwise.sources.rasters import cell_id

RING = ["poly_id", "part", "ring"]


def _ring_id():
    return F.concat_ws("|", "poly_id", "part", "ring")


def vertices_of(edges: DataFrame) -> DataFrame:
    """Edge starts as ring vertices ``ring_id, seq, x, y``."""
    return edges.select(_ring_id().alias("ring_id"), F.col("seq").cast("long").alias("seq"), F.col("x1").alias("x"), F.col("y1").alias("y"))


def edges_of(vertices: DataFrame, names: DataFrame) -> DataFrame:
    """Closed edges of ring vertices; ``names``: ``ring_id`` and the ring's ``poly_id, part, ring``."""
    nxt = ordered.neighbours(vertices, ["ring_id"], ["seq"], ["x", "y"], ahead=True)
    first = vertices.groupBy("ring_id").agg(F.min_by(F.struct("x", "y"), "seq").alias("first"))
    to = F.coalesce("next", "first")
    return nxt.join(first, "ring_id").join(names, "ring_id").select(*RING, "seq", F.col("x").alias("x1"), F.col("y").alias("y1"), to["x"].alias("x2"), to["y"].alias("y2"))


def arc_vertices(arcs: DataFrame, reference: DataFrame) -> DataFrame:
    """Vertices of chosen reference arcs in the direction of their runs: ``run_id, pos, x, y``.

    ``arcs``: rows of ``best_arc``; ``reference``: rows of ``ring_segments``. An arc starts ``from_s`` along its ring and wraps.
    """
    j = arcs.select("run_id", "ref_id", "arc", "from_s", "arc_m").join(reference, "ref_id").withColumn("lap", F.explode(F.array(F.lit(0), F.lit(1)))).withColumns({
        "a": F.greatest(F.col("from_s"), F.col("s0") + F.col("lap") * F.col("ring_m")), "z": F.least(F.col("from_s") + F.col("arc_m"), F.col("s1") + F.col("lap") * F.col("ring_m"))}).filter("z > a")
    ends = j.withColumn("s", F.explode(F.array("a", "z")))
    share = (F.col("s") - F.col("lap") * F.col("ring_m") - F.col("s0")) / (F.col("s1") - F.col("s0"))
    along = F.col("s") - F.col("from_s")
    pos = F.round(F.when(F.col("arc") == "forward", along).otherwise(F.col("arc_m") - along), 6)
    spots = ends.select("run_id", pos.alias("pos"), (F.col("x1") + share * (F.col("x2") - F.col("x1"))).alias("x"), (F.col("y1") + share * (F.col("y2") - F.col("y1"))).alias("y"))
    # neighbouring pieces share a vertex
    return spots.groupBy("run_id", "pos").agg(F.min("x").alias("x"), F.min("y").alias("y"))


def stitched(pieces: DataFrame, smoothed: DataFrame, reference: DataFrame, match_m: float) -> DataFrame:
    """Rings whose contact runs follow the reference: ``ring_id, seq, x, y``.

    ``pieces``: rows of ``contact_runs``; ``smoothed``: vertices ``ring_id, seq, x, y`` of the same pieces, numbered by
    ``seq * STRIDE + piece``. A run without an acceptable arc keeps its smoothed vertices.
    """
    run_id = F.concat_ws("|", _ring_id(), F.col("run"))
    named = cut(pieces.select(_ring_id().alias("ring_id"), run_id.alias("run_id"), "run", "matched", (F.col("seq") * STRIDE + F.col("piece")).alias("seq"), F.col("x1").alias("x"), F.col("y1").alias("y"),
                              F.col("x2").alias("xe"), F.col("y2").alias("ye")))
    # the last run closes the ring: its pieces before the first change come after all others
    span = named.groupBy("ring_id").agg(F.max("seq").alias("top"), F.max("run").alias("last_run"), F.min(F.when(F.col("run") == 0, F.col("seq"))).alias("first"))
    wraps = (F.col("run") == F.col("last_run")) & (F.col("run") > 0) & (F.col("seq") < F.col("first"))
    placed = cut(named.join(span, "ring_id").withColumn("at", F.when(wraps, F.col("seq") + F.col("top") + 1).otherwise(F.col("seq"))).drop("top", "last_run", "first"))
    ends = placed.filter("matched").groupBy("run_id").agg(F.max_by(F.struct("at", "xe", "ye"), "at").alias("e"))
    line = placed.filter("matched").select("run_id", F.col("at").alias("seq"), "x", "y").unionByName(ends.select("run_id", (F.col("e.at") + 1).alias("seq"), F.col("e.xe").alias("x"), F.col("e.ye").alias("y")))
    arcs = cut(bd.best_arc(line, reference, match_m))
    own = placed.join(arcs.select("run_id"), "run_id", "left_anti").select("ring_id", "run", F.col("at").cast("double").alias("pos"), "seq").join(
        smoothed, ["ring_id", "seq"]).select("ring_id", "run", "pos", "x", "y")
    runs = placed.select("ring_id", "run", "run_id").distinct()
    other = arc_vertices(arcs, reference).join(runs, "run_id").select("ring_id", "run", "pos", "x", "y")
    return ordered.row_numbers(own.unionByName(other), ["ring_id"], ["run", "pos"], "n").select("ring_id", F.col("n").alias("seq"), "x", "y")


#: Pieces of one edge at most; a raster edge of this many steps would be thousands of kilometres long.
STRIDE = 1_000_000


def cells_inside(edges: DataFrame, grid: dict) -> DataFrame:
    """``poly_id, row, col``: cells with more than half of their area inside."""
    box = edges.agg(F.max(F.greatest("x1", "x2")).alias("x"), F.min(F.least("y1", "y2")).alias("y")).first()
    if box.x is None:
        return edges.select("poly_id", F.lit(0).alias("row"), F.lit(0).alias("col")).limit(0)
    width, height = int((box.x - grid["x0"]) / grid["cell"]) + 2, int((grid["y0"] - box.y) / grid["cell"]) + 2
    return ge.cell_weights(edges, **grid, width=width, height=height).filter(F.col("w") > grid["cell"] ** 2 / 2).select("poly_id", "row", "col")


def finish_boundaries(members: DataFrame, *, grid: dict, zones: DataFrame | None = None, basin_of: DataFrame | None = None, basin_edges: DataFrame | None = None, basin_cells: DataFrame | None = None,
                      match_m: float = bd.MATCH_M, smooth_m: float = bd.SMOOTH_M, simplify_m: float = bd.SIMPLIFY_M) -> dict[str, DataFrame]:
    """Rings of every catchment and what becomes of them beside the official boundary.

    ``members``: ``point_id, row, col``, or ``point_id, zone`` with ``zones`` (``row, col, zone``, a row a cell); ``basin_of``: ``point_id, basin_code``; ``basin_edges``: official polygons by
    ``poly_id`` = basin code; ``basin_cells``: ``row, col, basin_code``. Small holes are filled and the largest part stays.
    A boundary that follows most of its basin's becomes that polygon, one that touches it follows it along the contact,
    all others are smoothed; a stitched boundary that leaves its catchment is given up for the smoothed one.
    Returns ``raw`` and ``final`` edges, ``runs`` of contact, and one ``summary`` row a catchment.
    """
    area = grid["cell"] ** 2
    if zones is None:
        # each cell is a zone of its own
        members = members.select("point_id", "row", "col", cell_id(F.col("row"), F.col("col")).alias("zone")).distinct()
        zones = cut(members.select("row", "col", "zone").distinct())
    sized = cut(zones.groupBy("zone").agg(F.count("*").alias("cells")))
    members = cut(members.select("point_id", "zone").distinct().join(sized, "zone"))
    traced = rings.ring_edges(rings.trace_edges(rings.zone_half_edges(zones, members)), **grid)
    raw = cut(ge.clean_polygon(ge.largest_component(traced)))
    names = cut(raw.select(_ring_id().alias("ring_id"), *RING).distinct())
    code = members.select("point_id").distinct().withColumn("basin_code", F.lit(None).cast("long")) if basin_of is None else basin_of
    owner = cut(code.select(F.col("point_id").alias("poly_id"), "basin_code"))
    if basin_edges is None:
        none = "seg_id long, x1 double, y1 double, x2 double, y2 double, basin_code long"
        reference, by_basin = raw.sparkSession.createDataFrame([], none), None
    else:
        by_basin = cut(basin_edges)
        reference = by_basin.select(F.monotonically_increasing_id().alias("seg_id"), "x1", "y1", "x2", "y2", F.col("poly_id").alias("basin_code"))
    pieces = cut(bd.contact_runs(bd.classify_contacts(raw, reference, match_m, owner=owner), match_m))
    runs = cut(bd.run_summary(pieces))
    dense = pieces.select(*RING, (F.col("seq") * STRIDE + F.col("piece")).alias("seq"), "x1", "y1")
    smoothed = cut(bd.smooth(dense.select(_ring_id().alias("ring_id"), "seq", F.col("x1").alias("x"), F.col("y1").alias("y")), smooth_m))

    sizes = members.groupBy(F.col("point_id").alias("poly_id")).agg(F.sum("cells").alias("raw_cells"))
    facts = bd.diagnostics(runs).join(sizes, "poly_id").join(small(owner), "poly_id", "left")
    if by_basin is not None:
        basins = zones.join(basin_cells, ["row", "col"]).groupBy("zone", "basin_code").agg(F.count("*").alias("n"))
        inside = members.select(F.col("point_id").alias("poly_id"), "zone").join(small(owner), "poly_id").join(basins, ["zone", "basin_code"]).groupBy("poly_id").agg((F.sum("n") * area).alias("overlap_m2"))
        official = ge.polygon_measures(by_basin).select(F.col("poly_id").alias("basin_code"), F.col("area").alias("reference_m2"))
        facts = facts.join(inside, "poly_id", "left").join(official, "basin_code", "left")
    else:
        facts = facts.withColumns({"overlap_m2": F.lit(0.0), "reference_m2": F.lit(None).cast("double")})
    facts = facts.withColumns({"has_reference": F.col("reference_m2").isNotNull(), "matched_m": F.col("contact_m"), "raw_m2": F.col("raw_cells") * area, "overlap_m2": F.coalesce("overlap_m2", F.lit(0.0))})
    modes = cut(bd.stitch_mode(facts))

    plain = cut(edges_of(bd.simplify(smoothed, simplify_m), names))
    final = plain.join(modes.filter("mode <> 'full_reference'").select("poly_id"), "poly_id", "left_semi")
    checks = None
    if by_basin is not None:
        of_mode = lambda df, m: df.join(modes.filter(F.col("mode") == m).select("poly_id"), "poly_id", "left_semi")
        joined = of_mode(pieces, "hybrid")
        ring = bd.ring_segments(by_basin.filter("part = 0"))
        sewn = cut(edges_of(bd.simplify(stitched(joined, smoothed, ring, match_m), simplify_m), names))
        shape = cut(cells_inside(sewn, grid))
        both = shape.join(zones, ["row", "col"]).join(members.select(F.col("point_id").alias("poly_id"), "zone"), ["poly_id", "zone"]).groupBy("poly_id").agg(F.count("*").alias("shared_cells"))
        counted = shape.groupBy("poly_id").agg(F.count("*").alias("candidate_cells")).join(both, "poly_id", "left").join(sizes, "poly_id").na.fill(0, ["shared_cells"])
        checks = cut(bd.candidate_gate(counted).select("poly_id", "jaccard", "area_ratio", "accepted"))
        good = checks.filter("accepted").select("poly_id")
        official = by_basin.withColumnRenamed("poly_id", "basin_code").join(modes.filter("mode = 'full_reference'").select("poly_id", "basin_code"), "basin_code")
        final = final.join(good, "poly_id", "left_anti").select(*raw.columns).unionByName(sewn.join(good, "poly_id", "left_semi").select(*raw.columns)).unionByName(
            official.select("poly_id", F.col("part").cast("long").alias("part"), F.col("ring").cast("long").alias("ring"), F.col("seq").cast("long").alias("seq"), "x1", "y1", "x2", "y2"))
    final = cut(final.select(*raw.columns))
    measured = ge.polygon_measures(final).select("poly_id", (F.col("area") / 1e6).alias("final_km2"), (F.col("perimeter") / 1000).alias("perimeter_km"), "cx", "cy")
    out = modes.join(measured, "poly_id", "left").withColumn("raw_km2", F.col("raw_m2") / 1e6)
    empty = [F.lit(None).cast("double").alias("jaccard"), F.lit(None).cast("double").alias("area_ratio"), F.lit(None).cast("boolean").alias("accepted")]
    out = out.join(checks, "poly_id", "left") if checks is not None else out.select("*", *empty)
    mode = F.when((F.col("mode") == "hybrid") & ~F.coalesce("accepted", F.lit(False)), "hybrid_rejected").otherwise(F.col("mode"))
    summary = bd.adjustment(out).select(F.col("poly_id").alias("point_id"), mode.alias("boundary_mode"), "raw_match_percent", "boundary_m", "contact_m", "contact_percent", "contact_runs", "internal_runs",
                                        "raw_cells", "raw_km2", "final_km2", "boundary_adjustment_km2", "perimeter_km", "cx", "cy", "jaccard", "area_ratio")
    return {"raw": raw, "final": final, "runs": runs, "summary": summary}
