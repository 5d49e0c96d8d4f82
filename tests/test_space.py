"""Cells, geometry and spatial joins against brute force."""

import math
import random

import pytest
from pyspark.sql import functions as F

from catchwise.functions import projection as pj
from catchwise.operators import boundary as bd
from catchwise.operators import d8, ordered, zonal
from catchwise.operators import geometry as ge
from catchwise.operators import spatial as sp
from catchwise.plans import network as pn

SEG = "linkno long, part int, seq int, x1 double, y1 double, x2 double, y2 double, ds_cont_area_km2 double"
EDGE = "poly_id long, part int, ring int, seq int, x1 double, y1 double, x2 double, y2 double"


def ring(poly, pts, part=0, ring_no=0):
    return [(poly, part, ring_no, i, *map(float, a), *map(float, b)) for i, (a, b) in enumerate(zip(pts, pts[1:] + pts[:1]))]


def dist(p, a, b):
    dx, dy = b[0] - a[0], b[1] - a[1]
    t = max(0, min(1, ((p[0] - a[0]) * dx + (p[1] - a[1]) * dy) / (dx * dx + dy * dy)))
    return math.hypot(p[0] - a[0] - t * dx, p[1] - a[1] - t * dy)


def test_nearest_link_equals_brute_force(spark):
    rng = random.Random(3)
    segs = [(i, 0, 0, *(rng.uniform(0, 3000) for _ in range(4)), float(i % 5)) for i in range(1, 60)]
    pts = [(f"p{i}", rng.uniform(-200, 3200), rng.uniform(-200, 3200)) for i in range(150)]
    got = {r.point_id: (r.linkno, r.snap_distance_m) for r in sp.nearest_link(spark.createDataFrame(pts, "point_id string, x double, y double"), spark.createDataFrame(segs, SEG), 120.0).collect()}
    for pid, x, y in pts:
        best = min((dist((x, y), s[3:5], s[5:7]), s[0]) for s in segs)
        assert got[pid] == ((best[1], pytest.approx(best[0], abs=1e-6)) if best[0] <= 120 else (None, None))


def test_pip_and_clip_on_a_concave_polygon(spark):
    shape = [(0, 0), (1000, 0), (1000, 1000), (600, 1000), (600, 300), (400, 300), (400, 1000), (0, 1000)]
    hole = [(100, 100), (100, 200), (200, 200), (200, 100)]
    edges = spark.createDataFrame(ring(1, shape) + ring(1, hole, ring_no=1), EDGE)
    pts = spark.createDataFrame([("in", 50.0, 50.0), ("notch", 500.0, 600.0), ("hole", 150.0, 150.0), ("edge", 0.0, 500.0), ("out", 1200.0, 10.0)], "point_id string, x double, y double")
    got = {r.point_id: r.poly_id for r in sp.pip_join(pts, edges, size=250.0).collect()}
    assert got == {"in": 1, "notch": None, "hole": None, "edge": 1, "out": None}
    seg = spark.createDataFrame([(7, 0, 0, -100.0, 600.0, 1100.0, 600.0, 0.0), (8, 0, 0, 10.0, 10.0, 50.0, 10.0, 0.0)], SEG)
    parts = sp.clip_lines(seg, edges, size=250.0).collect()
    assert sum(r.length_m for r in parts if r.linkno == 7) == pytest.approx(800.0) and sum(r.length_m for r in parts if r.linkno == 8) == pytest.approx(40.0)
    m = ge.polygon_measures(edges).first()
    assert m.area == pytest.approx(1e6 - 200 * 700 - 1e4)
    w = ge.cell_weights(edges, x0=0.0, y0=1000.0, cell=150.0, width=10, height=10)
    assert w.agg(F.sum("w")).first()[0] == pytest.approx(m.area)


def test_half_plane_and_sections(spark):
    edges = spark.createDataFrame(ring(1, [(0, 0), (2000, 0), (2000, 1000), (0, 1000)]), EDGE)
    st = spark.createDataFrame([(1, 0.0, 500.0, 500.0, 500.0, 1500.0, 500.0, 1000.0, 500.0)], "poly_id long, ox double, oy double, qx double, qy double, tx double, ty double, lx double, ly double")
    r = ge.gama_shape(edges, st).first()
    assert (r.wl, r.wu, r.width_factor, r.relative_upstream_area, r.symmetry_factor) == (1000.0, 1000.0, 1.0, 0.5, 0.5)


def test_utm_round_trip_and_haversine(spark):
    df = spark.createDataFrame([(110.5, -7.8), (111.0, 0.0), (109.2, -8.3)], "lon double, lat double")
    x, y = pj.to_utm(F.col("lon"), F.col("lat"))
    df = df.withColumns({"x": x, "y": y})
    lon, lat = pj.from_utm(F.col("x"), F.col("y"))
    for r in df.select("*", lon.alias("lo"), lat.alias("la"), pj.haversine_m(F.col("lon"), F.col("lat"), F.lit(110.5), F.lit(-7.8)).alias("d")).collect():
        assert (r.lo, r.la) == (pytest.approx(r.lon, abs=1e-9), pytest.approx(r.lat, abs=1e-9))
        if r.lon == 111.0:
            assert (r.x, r.y) == (pytest.approx(500000.0), pytest.approx(10000000.0))


def test_d8_strip_channel_threshold(spark):
    cells = spark.range(200).select(F.lit(0).alias("row"), F.col("id").cast("int").alias("col"), F.lit(1).alias("d8"))
    graph = d8.flow_graph(cells)
    counts, plen = d8.contributing_cells(graph), d8.upslope_length(graph)
    assert counts.agg(F.max("cells")).first()[0] == 200 and plen.agg(F.max("plen")).first()[0] == 199.0
    start = d8.path_start(spark.createDataFrame([("a", 0, 199)], "point_id string, row int, col int"), cells, plen)
    path = d8.d8_flowpath(graph, d8.upward_chain(graph, plen), start)
    head = d8.channel_head(path, counts, 900.0).first()
    assert head.threshold_cells == 167 and path.count() == 200 and head.head_step == 33 and head.channel_cells_len * 30 / 1000 == pytest.approx(0.99)


def test_stencil_equals_brute_force(spark):
    rng = random.Random(5)
    z = {(r, c): float(rng.randint(1, 9)) for r in range(6) for c in range(7) if rng.random() < 0.85}
    df = spark.createDataFrame([(r, c, v) for (r, c), v in z.items()], "row int, col int, z double")
    offsets = [(-1, 0), (-1, 1), (0, 1), (1, 1), (1, 0), (1, -1), (0, -1), (-1, -1)]
    for t in zonal.local_terrain(df, 10.0).collect():
        near = [(i, z.get((t.row + a, t.col + b))) for i, (a, b) in enumerate(offsets, 1)]
        diffs = [abs(v - t.z) for _, v in near if v is not None]
        drops = [(t.z - v, -i) for i, v in near if v is not None and t.z > v]
        assert t.slope_pct == (pytest.approx(max(diffs) * 10) if diffs else None) and t.aspect_idx == (-max(drops)[1] if drops else None)


def test_shared_edge_and_cell_boundary(spark):
    boxes = spark.createDataFrame(ring(1, [(0, 0), (100, 0), (100, 200), (0, 200)]) + ring(2, [(100, 0), (200, 0), (200, 200), (100, 200)]), EDGE)
    assert [(r.a, r.b, r.length) for r in sp.shared_edges(boxes).collect()] == [(1, 2, 200.0)]
    cells = spark.createDataFrame([("a", r, c) for r in range(3) for c in range(2)], "point_id string, row int, col int")
    m = pn.boundary_measures(pn.catchment_boundaries(cells, x0=0.0, y0=0.0, cell=10.0)).first()
    assert (m.area, m.perimeter, m.cx, m.cy) == (600.0, 100.0, 10.0, -15.0)


def test_ordered_helpers_on_one_hot_group(spark):
    df = spark.range(5000).select(F.when(F.col("id") < 4000, "hot").otherwise("cold").alias("k"), "id", F.lit(2).alias("v"))
    run = {(r.k, r.id): r.s for r in ordered.running_sum(df, ["k"], ["id"], {"s": "v"}).collect()}
    assert all(run[("hot", i)] == 2 * (i + 1) for i in range(4000)) and run[("cold", 4999)] == 2000
    nxt = ordered.neighbours(df, ["k"], ["id"], ["id"], ahead=True).collect()
    assert all((r.next.id == r.id + 1) if r.id not in (3999, 4999) else r.next is None for r in nxt)
    med = {r.k: r.q for r in ordered.quantiles(df.withColumn("id", F.col("id").cast("double")), ["k"], "id", [0.5]).collect()}
    assert med == {"hot": 1999.5, "cold": 4499.5}


def test_contact_corridor_and_best_arc(spark):
    square = spark.createDataFrame(ring(1, [(0, 0), (1000, 0), (1000, 1000), (0, 1000)]), EDGE)
    run = spark.createDataFrame([(1, 0, 0.0, 0.0), (1, 1, 500.0, 204.0), (1, 2, 1000.0, 0.0)], "run_id long, seq long, x double, y double")
    arc = bd.best_arc(run, bd.ring_segments(square), 120.0).first()
    assert arc.arc == "forward" and arc.arc_m == pytest.approx(1000.0)


def test_simplify_keeps_corners(spark):
    pts = [(0, 0), (50, 0.5), (100, 0), (100, 100), (50, 100.5), (0, 100)]
    df = spark.createDataFrame([(1, i, float(x), float(y)) for i, (x, y) in enumerate(pts)], "ring_id long, seq long, x double, y double")
    assert sorted(r.seq for r in bd.simplify(df, 3.0).collect()) == [0, 2, 3, 5]
    few = spark.createDataFrame([(1, 0, 0.0, 0.0), (1, 1, 9.0, 1.0)], "ring_id long, seq long, x double, y double")
    assert [(r.x, r.y) for r in bd.smooth(few, 150.0).orderBy("seq").collect()] == [(0.0, 0.0), (9.0, 1.0)]


def test_settlement_sides_are_told_in_the_given_plane(spark, tmp_path):
    # seen from P432, name 75874 lies 0.0806 off the axis: over the limit around the point, under it in UTM
    from catchwise import catalog

    spark.createDataFrame([(432, "S", 2, 0.0)], "s_suppkey long, s_name string, s_nationkey int, s_acctbal double").write.parquet(f"{tmp_path}/supplier.parquet")
    rows = [(k, f"Customer#{k:09d}", 2, 0.0, "X") for k in (75629, 75874)]
    spark.createDataFrame(rows, "c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string").write.parquet(f"{tmp_path}/customer.parquet")
    duckdb = pytest.importorskip("duckdb").connect()
    for t in ("supplier", "customer"):
        duckdb.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    out = [tuple(r) for r in catalog.queries()["c11_settlement_name"](spark, str(tmp_path)).collect()]
    assert out == duckdb.execute(catalog.oracles()["c11_settlement_name"]).fetchall()
