"""Queries over raster cells: scans, terrain, land cover, flow directions, catchments."""

from pyspark.sql import functions as F

from catchwise.catalog.base import query
from catchwise.functions.numeric import rounded
from catchwise.operators import d8, zonal
from catchwise.runtime import cut
from catchwise.sources import rasters as rs
from catchwise.sources import testbed as tb

C = f"WITH RECURSIVE {tb.CELLS_SQL}"
FL = f"WITH RECURSIVE {tb.FLOW_SQL}"
FO = f"WITH RECURSIVE {tb.FLOW_SQL}, {tb.CELL_OUTLETS_SQL}"


@query("a5_scan_cells", C + " SELECT row, col, z FROM cells WHERE x BETWEEN 615 AND 2400 AND y BETWEEN -2100 AND -300")
def a5(spark, sf):
    return rs.scan_cells(tb.cells(spark, sf), (615.0, -2100.0, 2400.0, -300.0), **tb.GRID).select("row", "col", "z")


@query("a6_sample_cells", f"WITH {tb.CELLS_SQL}, {tb.OUTLETS_SQL} SELECT o.point_id, c.z FROM outlets o LEFT JOIN cells c ON c.row = floor((o.linkno * 41.0) / 30) AND c.col = floor((o.linkno * 37.0) / 30)")
def a6(spark, sf):
    pts = tb.outlet_links(spark, sf).select("point_id", (F.col("linkno") * 37.0).alias("x"), (F.col("linkno") * -41.0).alias("y"))
    return rs.sample_cells(pts, tb.cells(spark, sf), "z", **tb.GRID).select("point_id", "z")


@query("z34_raster_qa", C + " SELECT d8, count(*) AS cells, d8 BETWEEN 1 AND 8 AS valid FROM cells GROUP BY 1")
def z34(spark, sf):
    return rs.raster_qa(tb.cells(spark, sf))


@query("z34_grid_alignment", C + """, e AS (SELECT min(row) AS r0, max(row) AS r1, min(col) AS c0, max(col) AS c1, count(*) AS n, round(min(x), 6) AS x, round(max(y), 6) AS y FROM cells)
 SELECT r0 AS r0_a, r1 AS r1_a, c0 AS c0_a, c1 AS c1_a, n AS n_a, CAST(x AS DOUBLE) AS x_a, CAST(y AS DOUBLE) AS y_a, r0 AS r0_b, r1 AS r1_b, c0 AS c0_b, c1 AS c1_b, n AS n_b, CAST(x AS DOUBLE) AS x_b, CAST(y AS DOUBLE) AS y_b, true AS aligned FROM e""")
def z34_alignment(spark, sf):
    c = tb.cells(spark, sf)
    return rs.grid_alignment(c, c.withColumn("z", F.col("z") + 1))


TERRAIN = C + """, nb(dr, dc, i) AS (VALUES (-1, 0, 1), (-1, 1, 2), (0, 1, 3), (1, 1, 4), (1, 0, 5), (1, -1, 6), (0, -1, 7), (-1, -1, 8)),
 pr AS (SELECT c.row, c.col, c.point_id, c.z, nb.i, n.z AS nz, n.point_id AS np FROM cells c CROSS JOIN nb LEFT JOIN cells n ON n.row = c.row + nb.dr AND n.col = c.col + nb.dc),
 terrain AS (SELECT row, col, any_value(point_id) AS point_id, any_value(z) AS z, max(abs(nz - z)) / 30 * 100 AS slope_pct,
    CAST(arg_max(i, (z - nz, -i)) FILTER (z - nz > 0) AS INTEGER) AS aspect_idx, bool_or(np IS NULL OR np <> point_id) AS on_divide FROM pr GROUP BY row, col)"""


def _terrain(spark, sf):
    return zonal.local_terrain(tb.cells(spark, sf), 30.0, "point_id")


@query("z2_slope8", TERRAIN + " SELECT row, col, round(slope_pct, 6) AS slope_pct, on_divide FROM terrain")
def z2(spark, sf):
    return rounded(_terrain(spark, sf).select("row", "col", "slope_pct", "on_divide"), 6)


@query("z3_aspect8", TERRAIN + " SELECT row, col, aspect_idx FROM terrain")
def z3(spark, sf):
    return _terrain(spark, sf).select("row", "col", "aspect_idx")


@query("z3_aspect_distribution", TERRAIN + """, n(i, name) AS (VALUES (1, 'Utara'), (2, 'Timur Laut'), (3, 'Timur'), (4, 'Tenggara'), (5, 'Selatan'), (6, 'Barat Daya'), (7, 'Barat'), (8, 'Barat Laut')),
  c AS (SELECT point_id, aspect_idx, count(*) AS cells FROM terrain WHERE aspect_idx IS NOT NULL GROUP BY 1, 2)
 SELECT point_id, name AS aspect, cells, round(cells / sum(cells) OVER (PARTITION BY point_id) * 100, 6) AS area_pct,
   row_number() OVER (PARTITION BY point_id ORDER BY cells DESC, aspect_idx) = 1 AS dominant FROM c JOIN n ON n.i = aspect_idx""")
def z3_dist(spark, sf):
    return rounded(zonal.aspect_distribution(_terrain(spark, sf)), 6)


@query("z1_elevation_stats", TERRAIN + """, o AS (SELECT point_id, arg_max(z, row * 125 + col) AS oz FROM cells GROUP BY 1)
 SELECT point_id, count(*) AS cells, min(z) AS min_m, round(avg(z), 6) AS mean_m, max(z) AS max_m, round(max(z) - min(z), 6) AS range_m,
   round(coalesce(max(z) FILTER (on_divide), max(z)) - any_value(oz), 6) AS relief_m, round(avg(z) - any_value(oz), 6) AS mean_height_above_outlet_m FROM terrain JOIN o USING (point_id) GROUP BY 1""")
def z1(spark, sf):
    out = zonal.elevation_stats(_terrain(spark, sf), tb.block_outlets(tb.cells(spark, sf)))
    return rounded(out, 6, ["mean_m", "range_m", "relief_m", "mean_height_above_outlet_m"])


@query("z4_slope_distribution", TERRAIN + """ SELECT point_id, round(avg(slope_pct), 6) AS mean_pct, round(count(*) FILTER (slope_pct < 8) / count(*) * 100, 6) AS class1_pct, round(count(*) FILTER (slope_pct >= 8 AND slope_pct < 15) / count(*) * 100, 6) AS class2_pct,
   round(count(*) FILTER (slope_pct >= 15 AND slope_pct < 25) / count(*) * 100, 6) AS class3_pct, round(count(*) FILTER (slope_pct >= 25 AND slope_pct < 40) / count(*) * 100, 6) AS class4_pct, round(count(*) FILTER (slope_pct >= 40) / count(*) * 100, 6) AS class5_pct,
   round(quantile_cont(slope_pct, 0.95), 6) AS p95_pct, CASE WHEN avg(slope_pct) < 8 THEN 'Datar' WHEN avg(slope_pct) < 15 THEN 'Landai' WHEN avg(slope_pct) < 25 THEN 'Agak curam' WHEN avg(slope_pct) < 40 THEN 'Curam' ELSE 'Sangat curam' END AS slope_class FROM terrain GROUP BY 1""")
def z4(spark, sf):
    return rounded(zonal.slope_distribution(_terrain(spark, sf)), 6)


@query("z5_hypsometry", C + """, b AS (SELECT point_id, (avg(z) - min(z)) / (max(z) - min(z)) AS hi, quantile_cont(z, [0.1, 0.25, 0.5, 0.75, 0.9]) AS q FROM cells GROUP BY 1)
 SELECT point_id, round(hi, 8) AS hypsometric_integral, CASE WHEN hi >= 0.6 THEN 'Muda' WHEN hi >= 0.35 THEN 'Dewasa' ELSE 'Tua' END AS stage, round(q[1], 8) AS p10, round(q[2], 8) AS p25, round(q[3], 8) AS p50, round(q[4], 8) AS p75, round(q[5], 8) AS p90 FROM b""")
def z5(spark, sf):
    return rounded(zonal.hypsometry(tb.cells(spark, sf)), 8)


def _areas(cells):
    return cells.groupBy("point_id").agg((F.count("*") * 0.0009).alias("area_km2"))


@query("z6_landcover", C + f""", lab AS (SELECT unnest({[int(k) for k in zonal.LANDCOVER]}) AS lc, unnest({list(zonal.LANDCOVER.values())!r}) AS name),
  c AS (SELECT point_id, lc, count(*) AS cells FROM cells GROUP BY 1, 2)
 SELECT point_id, c.lc, name, cells, round(cells / sum(cells) OVER w * 100, 6) AS area_pct, round(cells / sum(cells) OVER w * (sum(cells) OVER w * 0.0009), 6) AS area_km2 FROM c JOIN lab USING (lc) WINDOW w AS (PARTITION BY point_id)""")
def z6(spark, sf):
    c = tb.cells(spark, sf)
    return rounded(zonal.landcover(c, _areas(c)), 6)


@query("z6_landcover_groups", C + " SELECT point_id, " + ", ".join(f"round(count(*) FILTER (lc IN {codes}) / count(*) * 100, 6) AS {n}" for n, codes in zonal.LAND_GROUPS.items()) + " FROM cells GROUP BY 1")
def z6_groups(spark, sf):
    return rounded(zonal.landcover_groups(tb.cells(spark, sf)), 6)


@query("z7_curve_number", C + """, v AS (SELECT point_id, cn, cn > 0 AND cn <= 100 AS ok FROM cells),
  a AS (SELECT point_id, avg(cn) FILTER (ok) AS m, count(*) FILTER (ok) AS n, count(*) AS t, count(*) FILTER (ok AND cn < 60) AS b1, count(*) FILTER (ok AND cn >= 60 AND cn < 70) AS b2, count(*) FILTER (ok AND cn >= 70 AND cn < 80) AS b3,
    count(*) FILTER (ok AND cn BETWEEN 80 AND 90) AS b4, count(*) FILTER (ok AND cn > 90) AS b5, count(*) FILTER (ok AND cn >= 80) AS h FROM v GROUP BY 1)
 SELECT point_id, round(m, 6) AS cn, round(b1 / n * 100, 6) AS bin1_pct, round(b2 / n * 100, 6) AS bin2_pct, round(b3 / n * 100, 6) AS bin3_pct, round(b4 / n * 100, 6) AS bin4_pct, round(b5 / n * 100, 6) AS bin5_pct,
   round(h / n * 100, 6) AS high_cn_pct, round((t - n) / t * 100, 6) AS invalid_pct, round(25400 / m - 254, 6) AS retention_mm,
   CASE WHEN m >= 80 THEN 'Potensi limpasan tinggi' WHEN m >= 70 THEN 'Potensi limpasan sedang' ELSE 'Potensi limpasan relatif rendah' END AS runoff_reading,
   CASE WHEN 25400 / m - 254 < 64 THEN 'Retensi relatif rendah' WHEN 25400 / m - 254 < 127 THEN 'Retensi sedang' ELSE 'Retensi relatif tinggi' END AS retention_reading,
   CASE WHEN h / n >= 0.5 THEN 'Dominan' WHEN h / n >= 0.25 THEN 'Signifikan' ELSE 'Terbatas' END AS high_cn_reading FROM a""")
def z7(spark, sf):
    return rounded(zonal.curve_number(tb.cells(spark, sf)), 6)


LS = C + """, ls AS (SELECT point_id, list_extract(['Flat to undulating volcanic plains', '-', 'Braided river floodplains', 'Undulating karstic plains'], lc % 4 + 1) AS t,
   list_extract(['Hills', 'Plains', 'Mountains'], row % 3 + 1) AS p, list_extract(['Flat', 'Hilly'], col % 2 + 1) AS r FROM cells)"""


@query("z8_landsystem", LS + """, g AS (
  SELECT point_id, 'classes' AS level, CASE WHEN t = '-' THEN 'badan air' ELSE t || '; ' || p || '; ' || r END AS name, count(*) AS n FROM ls GROUP BY 1, 2, 3
  UNION ALL SELECT point_id, 'land_types', t, count(*) FROM ls GROUP BY 1, 2, 3
  UNION ALL SELECT point_id, 'physiographies', p, count(*) FROM ls GROUP BY 1, 2, 3
  UNION ALL SELECT point_id, 'relief_classes', r, count(*) FROM ls GROUP BY 1, 2, 3),
  tot AS (SELECT point_id, count(*) AS a FROM ls GROUP BY 1),
  top AS (SELECT point_id, arg_max(name, (n, name)) AS name FROM g WHERE level = 'classes' AND name <> 'badan air' GROUP BY 1)
 SELECT g.point_id, level, g.name, round(CAST(n * 0.0009 AS DOUBLE), 6) AS area_km2, round(n / a * 100, 6) AS area_pct, level = 'classes' AND g.name = top.name AS dominant FROM g JOIN tot USING (point_id) JOIN top ON top.point_id = g.point_id""")
def z8(spark, sf):
    def pick(names, i):
        return F.element_at(F.array(*[F.lit(n) for n in names]), (i + 1).cast("int"))

    c = tb.cells(spark, sf).select(
        "point_id", pick(("Flat to undulating volcanic plains", "-", "Braided river floodplains", "Undulating karstic plains"), F.col("lc") % 4).alias("land_type"),
        pick(("Hills", "Plains", "Mountains"), F.col("row") % 3).alias("physiography"), pick(("Flat", "Hilly"), F.col("col") % 2).alias("relief"))
    return rounded(zonal.landsystem(c, 0.0009), 6)


CA = C + f", {tb.LAND_CLASSES_SQL}, ca AS (SELECT point_id, class, count(*) * 0.0009 AS area_km2 FROM cells JOIN lclass USING (row, col) GROUP BY 1, 2)"


@query("c8_class_area", CA + " SELECT point_id, class, round(CAST(area_km2 AS DOUBLE), 6) AS area_km2 FROM ca")
def c8(spark, sf):
    return rounded(zonal.class_area(tb.cells(spark, sf), tb.land_classes(spark, sf), 0.0009), 6)


@query("z9_distribution", CA + """, t AS (SELECT point_id, count(*) * 0.0009 AS area, count(*) * 0.0009 * CASE WHEN any_value(link_id) % 5 = 0 THEN 0.9 ELSE 1 END AS cov FROM cells GROUP BY 1),
  s AS (SELECT point_id, sum(area_km2) AS sm, coalesce(sum(area_km2) FILTER (class = 'C' AND CAST(substr(point_id, 2) AS BIGINT) % 4 = 1), 0) AS unk FROM ca GROUP BY 1),
  r AS (SELECT *, CASE WHEN cov / area < 0.95 THEN 'coverage' WHEN unk / sm > 0.05 THEN 'unknown_share' END AS reason FROM t JOIN s USING (point_id))
 SELECT DISTINCT r.point_id, CASE WHEN reason IS NULL THEN CASE WHEN class = 'C' AND CAST(substr(r.point_id, 2) AS BIGINT) % 4 = 1 THEN 'Tidak diketahui' ELSE class END END AS class,
   CASE WHEN reason IS NULL THEN round(CAST(area_km2 / sm AS DOUBLE), 6) END AS fraction, round(CAST(least(1, cov / area) AS DOUBLE), 6) AS coverage, reason FROM r JOIN ca USING (point_id)""")
def z9(spark, sf):
    c = tb.cells(spark, sf)
    areas = zonal.class_area(c, tb.land_classes(spark, sf), 0.0009)
    n = F.expr("CAST(substring(point_id, 2) AS BIGINT)")
    areas = areas.withColumn("class", F.when(~((F.col("class") == "C") & (n % 4 == 1)), F.col("class")))
    totals = _areas(c).withColumn("covered_km2", F.col("area_km2") * F.when((n + 1) % 5 == 0, 0.9).otherwise(1.0))
    return rounded(zonal.distribution(areas, totals), 6)


CW = C + """, bas AS (SELECT row, col, CAST(row // 40 * 10 + (col + 5) // 40 AS BIGINT) AS basin_code FROM cells WHERE (row + col) % 50 <> 0),
  pairs AS (SELECT c.link_id AS polygon_id, b.basin_code, count(*) AS n FROM cells c LEFT JOIN bas b USING (row, col) GROUP BY 1, 2),
  cw AS (SELECT polygon_id, arg_max(basin_code, (n, -basin_code)) FILTER (basin_code IS NOT NULL) AS basin_code, max(n) FILTER (basin_code IS NOT NULL) AS on_, sum(n) AS al FROM pairs GROUP BY 1)"""


def _crosswalk(spark, sf):
    c = tb.cells(spark, sf)
    basins = c.filter((F.col("row") + F.col("col")) % 50 != 0).select("row", "col", (F.floor(F.col("row") / 40) * 10 + F.floor((F.col("col") + 5) / 40)).alias("basin_code"))
    return zonal.crosswalk(c.select(F.col("link_id").alias("polygon_id"), "row", "col"), basins), basins


@query("c5_crosswalk", CW + " SELECT polygon_id, basin_code, round(on_ / al, 6) AS overlap_ratio, on_ AS overlap_cells FROM cw")
def c5(spark, sf):
    return rounded(_crosswalk(spark, sf)[0], 6)


@query("c6_supported_basins", CW + """ SELECT b.basin_code, round(coalesce(sum(on_), 0) / any_value(n), 6) AS coverage_ratio, count(on_) AS subbasin_count, coalesce(sum(on_), 0) / any_value(n) >= 0.9 AS supported
 FROM (SELECT basin_code, count(*) AS n FROM bas GROUP BY 1) b LEFT JOIN cw ON cw.basin_code = b.basin_code GROUP BY 1""")
def c6(spark, sf):
    cross, basins = _crosswalk(spark, sf)
    return rounded(zonal.supported_basins(cross, basins), 6)


# --- flow directions --------------------------------------------------------------------------

def _graph(spark, sf):
    return cut(d8.flow_graph(tb.cells(spark, sf)))


def _k(node="node"):
    return (F.floor(F.col(node) / rs.STRIDE) * 125 + F.col(node) % rs.STRIDE).alias("k")


@query("g15_contributing_cells", FL + " SELECT cur AS k, count(*) AS cells FROM down GROUP BY 1")
def g15_counts(spark, sf):
    return d8.contributing_cells(_graph(spark, sf)).select(_k(), "cells")


@query("g14_upslope_length", FL + " SELECT cur AS k, round(max(dist), 6) AS plen FROM down GROUP BY 1")
def g14_plen(spark, sf):
    return d8.upslope_length(_graph(spark, sf)).select(_k(), F.round("plen", 6).alias("plen"))


@query("g9_d8_catchment", FO + " SELECT point_id, d.k FROM couts o JOIN down d ON d.cur = o.k")
def g9(spark, sf):
    pts = tb.cell_outlets(spark, sf).withColumn("node", rs.cell_id(F.col("row"), F.col("col")))
    out = d8.d8_catchment(_graph(spark, sf), pts)
    return out.join(pts.select("point_id", F.col("node").alias("outlet")), "outlet").select("point_id", _k())


HYB = f"""WITH RECURSIVE {tb.CELLS_SQL}, {tb.CELL_OUTLETS_SQL}, {tb.LINKS_SQL},
 recv AS (SELECT c.k, t.k AS r FROM cells c JOIN cells t ON t.row = c.row + CASE WHEN c.d8 IN (7, 8) THEN 1 ELSE 0 END AND t.col = c.col + CASE WHEN c.d8 IN (1, 8) THEN 1 ELSE 0 END AND t.link_id = c.link_id),
 up(outlet, k) AS (SELECT DISTINCT k, k FROM couts UNION ALL SELECT u.outlet, r.k FROM up u JOIN recv r ON r.r = u.k),
 closure(o, linkno) AS (SELECT linkno, linkno FROM links UNION ALL SELECT c.o, l.linkno FROM closure c JOIN links l ON l.downstream_id = c.linkno),
 oc AS (SELECT p.point_id, p.k, c.link_id FROM couts p JOIN cells c USING (k)),
 loc AS (SELECT outlet, count(*) AS n FROM up GROUP BY 1),
 per AS (SELECT link_id, count(*) AS n FROM cells GROUP BY 1),
 ups AS (SELECT o, count(*) AS units, coalesce(sum(n), 0) AS n FROM closure LEFT JOIN per ON per.link_id = linkno WHERE linkno <> o GROUP BY 1)"""


@query("g10_hybrid_catchment", HYB + """ SELECT point_id, oc.link_id AS linkno, loc.n AS local_cells, coalesce(units, 0) AS full_upstream_units, CAST(loc.n + coalesce(ups.n, 0) AS BIGINT) AS total_cells
 FROM oc JOIN loc ON loc.outlet = oc.k LEFT JOIN ups ON ups.o = oc.link_id""")
def g10(spark, sf):
    return d8.hybrid_catchment(tb.cells(spark, sf), tb.cell_outlets(spark, sf), tb.links(spark, sf))


@query("g10_hybrid_cells", HYB + """ SELECT oc.point_id, c.row, c.col FROM oc JOIN up ON up.outlet = oc.k JOIN cells c ON c.k = up.k
 UNION ALL SELECT oc.point_id, c.row, c.col FROM oc JOIN closure cl ON cl.o = oc.link_id AND cl.linkno <> cl.o JOIN cells c ON c.link_id = cl.linkno""")
def g10_cells(spark, sf):
    return d8.hybrid_cells(tb.cells(spark, sf), tb.cell_outlets(spark, sf), tb.links(spark, sf))


PATH = FO + """, plen AS MATERIALIZED (SELECT cur AS k, round(max(dist), 6) AS plen FROM down GROUP BY 1),
 cnt AS MATERIALIZED (SELECT cur AS k, count(*) AS cells FROM down GROUP BY 1),
 best AS MATERIALIZED (SELECT r.r AS k, arg_max(r.k, (p.plen, -r.k)) AS u, arg_max(r.step, (p.plen, -r.k)) AS step FROM recv r JOIN plen p USING (k) WHERE r.r IS NOT NULL GROUP BY 1),
 starts AS MATERIALIZED (SELECT o.point_id, arg_min(c.k, (CASE WHEN greatest(abs(c.row - oc.row), abs(c.col - oc.col)) <= 1 THEN 1 WHEN greatest(abs(c.row - oc.row), abs(c.col - oc.col)) <= 2 THEN 2
     WHEN greatest(abs(c.row - oc.row), abs(c.col - oc.col)) <= 3 THEN 3 ELSE 5 END, -p.plen, c.k)) AS k
   FROM couts o JOIN cells oc ON oc.k = o.k JOIN down d ON d.cur = o.k JOIN cells c ON c.k = d.k AND abs(c.row - oc.row) <= 5 AND abs(c.col - oc.col) <= 5 JOIN plen p ON p.k = c.k GROUP BY 1),
 path(point_id, k, step, station) AS (SELECT point_id, k, CAST(0 AS BIGINT), CAST(0 AS DOUBLE) FROM starts UNION ALL SELECT p.point_id, b.u, p.step + 1, p.station + b.step FROM path p JOIN best b USING (k))"""


def _path(spark, sf):
    graph = _graph(spark, sf)
    pts = tb.cell_outlets(spark, sf).withColumn("node", rs.cell_id(F.col("row"), F.col("col")))
    plen = cut(d8.upslope_length(graph).withColumn("plen", F.round("plen", 6)))
    members = d8.d8_catchment(graph, pts).join(pts.select("point_id", F.col("node").alias("outlet")), "outlet").select("point_id", "node")
    starts = d8.path_start(pts, tb.cells(spark, sf), plen, members)
    return graph, cut(d8.d8_flowpath(graph, cut(d8.upward_chain(graph, plen)), starts))


@query("g14_d8_flowpath", PATH + " SELECT point_id, k, step, round(station, 6) AS station FROM path")
def g14(spark, sf):
    _, path = _path(spark, sf)
    return path.select("point_id", _k(), "step", F.round("station", 6).alias("station"))


@query("g15_channel_head", PATH + """ SELECT point_id, 167 AS threshold_cells, arg_max(step, step) FILTER (cells >= 167) AS head_step, round(max(station) FILTER (cells >= 167), 6) AS channel_cells_len, round(max(station), 6) AS path_cells_len
 FROM path JOIN cnt USING (k) GROUP BY 1""")
def g15(spark, sf):
    graph, path = _path(spark, sf)
    return rounded(d8.channel_head(path, d8.contributing_cells(graph), 900.0), 6)


@query("g16_path_stations", PATH + """, pp AS (SELECT p.point_id, p.step, c.x, c.y, p.station * 30 AS s FROM path p JOIN cells c USING (k)),
 cen AS (SELECT o.point_id, avg(c.x) AS cx, avg(c.y) AS cy FROM couts o JOIN down d ON d.cur = o.k JOIN cells c ON c.k = d.k GROUP BY 1),
 seg AS (SELECT a.point_id, a.step, a.x, a.y, a.s, b.x AS x2, b.y AS y2, b.s AS s2 FROM pp a JOIN pp b ON b.point_id = a.point_id AND b.step = a.step + 1),
 tt AS (SELECT seg.*, cx, cy, least(1, greatest(0, ((cx - x) * (x2 - x) + (cy - y) * (y2 - y)) / ((x2 - x) * (x2 - x) + (y2 - y) * (y2 - y)))) AS t FROM seg JOIN cen USING (point_id)),
 lca AS (SELECT point_id, arg_min(s + t * (s2 - s), (round(sqrt(pow(x + t * (x2 - x) - cx, 2) + pow(y + t * (y2 - y) - cy, 2)), 9), step)) AS lca FROM tt GROUP BY 1),
 ln AS (SELECT pp.point_id, max(s) AS len, arg_min(x, step) AS x0, arg_min(y, step) AS y0, arg_max(x, step) AS xu, arg_max(y, step) AS yu FROM pp GROUP BY 1),
 mk AS (SELECT point_id, unnest(['out', 'up', 'lca', 'p10', 'p85']) AS m, unnest([0, len, lca, len * 0.1, len * 0.85]) AS ms FROM ln JOIN lca USING (point_id)),
 sp AS (SELECT mk.point_id, m, round(arg_min(x + (ms - s) / (s2 - s) * (x2 - x), step), 6) AS px, round(arg_min(y + (ms - s) / (s2 - s) * (y2 - y), step), 6) AS py FROM mk JOIN seg ON seg.point_id = mk.point_id AND ms BETWEEN s AND s2 GROUP BY 1, 2),
 z AS (SELECT sp.point_id, max(z) FILTER (m = 'out') AS zo, max(z) FILTER (m = 'up') AS zu, max(z) FILTER (m = 'lca') AS zl, max(z) FILTER (m = 'p10') AS z10, max(z) FILTER (m = 'p85') AS z85
   FROM sp LEFT JOIN cells c ON c.row = floor(-py / 30) AND c.col = floor(px / 30) GROUP BY 1)
 SELECT ln.point_id, round(len, 3) AS length_m, round(lca, 3) AS lca_m, round(len * 0.75, 3) AS l10_85_m, round((zu - zo) / nullif(len, 0) * 100, 3) AS slope_pct, round((zl - zo) / nullif(lca, 0) * 100, 3) AS lca_slope_pct,
   round((z85 - z10) / nullif(len * 0.75, 0) * 100, 3) AS slope_10_85_pct, round(len / nullif(sqrt(pow(xu - x0, 2) + pow(yu - y0, 2)), 0), 3) AS sinuosity FROM ln LEFT JOIN lca USING (point_id) LEFT JOIN z USING (point_id)""")
def g16(spark, sf):
    graph, path = _path(spark, sf)
    pts = tb.cell_outlets(spark, sf).withColumn("node", rs.cell_id(F.col("row"), F.col("col")))
    members = d8.d8_catchment(graph, pts).join(pts.select("point_id", F.col("node").alias("outlet")), "outlet")
    centers = members.join(graph.select("node", "row", "col"), "node").groupBy("point_id").agg(
        F.avg((F.col("col") + 0.5) * 30.0).alias("cx"), F.avg(-(F.col("row") + 0.5) * 30.0).alias("cy"))
    line = path.select("point_id", "step", ((F.col("col") + 0.5) * 30.0).alias("x"), (-(F.col("row") + 0.5) * 30.0).alias("y"), (F.col("station") * 30.0).alias("station"))
    return rounded(d8.path_stations(line, centers, tb.cells(spark, sf), **tb.GRID), 3)


@query("c16_nested_donors", FO + """ SELECT a.point_id AS inner_point, b.point_id AS outer_point, CAST(1 AS DOUBLE) AS shared_ratio FROM couts a JOIN down d ON d.k = a.k JOIN couts b ON b.k = d.cur WHERE a.k <> b.k""")
def c16(spark, sf):
    pts = tb.cell_outlets(spark, sf).withColumn("node", rs.cell_id(F.col("row"), F.col("col")))
    return d8.nested_donors(_graph(spark, sf), pts)


# catchments blurred by one cell to the east, as smoothing does: they leak over their neighbours
def _blurred(spark, sf):
    graph = _graph(spark, sf)
    pts = tb.cell_outlets(spark, sf).withColumn("node", rs.cell_id(F.col("row"), F.col("col")))
    raw = d8.d8_catchment(graph, pts).join(pts.select("point_id", F.col("node").alias("outlet")), "outlet").join(graph.select("node", "row", "col"), "node").select("point_id", "row", "col")
    raw = cut(raw)
    east = raw.withColumn("col", F.col("col") + 1).filter("col < 125")
    return raw.unionByName(east).distinct(), d8.outlet_places(graph, pts), raw.groupBy("point_id").agg(F.count("*").alias("raw_cells"))


REC = FO + """, raw AS MATERIALIZED (SELECT o.point_id, c.row, c.col FROM couts o JOIN down d ON d.cur = o.k JOIN cells c ON c.k = d.k),
 mem AS MATERIALIZED (SELECT * FROM raw UNION SELECT point_id, row, col + 1 FROM raw WHERE col + 1 < 125),
 nest AS MATERIALIZED (SELECT a.point_id AS up, b.point_id AS dn FROM couts a JOIN down d ON d.k = a.k JOIN couts b ON b.k = d.cur WHERE a.k <> b.k),
 sz AS MATERIALIZED (SELECT point_id, count(*) AS rc FROM raw GROUP BY 1),
 outs AS MATERIALIZED (SELECT DISTINCT m.point_id, m.row, m.col FROM mem m JOIN nest n ON n.up = m.point_id WHERE NOT EXISTS (SELECT 1 FROM mem q WHERE q.point_id = n.dn AND q.row = m.row AND q.col = m.col)),
 cl AS MATERIALIZED (SELECT * FROM mem EXCEPT SELECT * FROM outs),
 rk AS MATERIALIZED (SELECT row, col, point_id, coalesce(inside, []) AS inside, row_number() OVER (PARTITION BY row, col ORDER BY rc DESC, point_id) AS r
   FROM cl JOIN sz USING (point_id) LEFT JOIN (SELECT up AS point_id, list(dn) AS inside FROM nest GROUP BY 1) USING (point_id)),
 turn AS (SELECT row, col, point_id, r, true AS keep, [point_id] AS held FROM rk WHERE r = 1
  UNION ALL SELECT k.row, k.col, k.point_id, k.r, list_has_all(k.inside, t.held), CASE WHEN list_has_all(k.inside, t.held) THEN list_append(t.held, k.point_id) ELSE t.held END
   FROM rk k JOIN turn t ON t.row = k.row AND t.col = k.col AND k.r = t.r + 1),
 jd AS MATERIALIZED (SELECT row, col, point_id, keep FROM turn)"""


@query("g21_reconcile", REC + " SELECT point_id, CAST(row * 125 + col AS BIGINT) AS k FROM jd WHERE keep")
def g21(spark, sf):
    kept, _ = d8.reconcile_places(*_blurred(spark, sf))
    return kept.select("point_id", _k())


@query("g21_reconcile_qa", REC + """ SELECT m.point_id, count(*) AS raw_cells, (SELECT count(*) FROM outs o WHERE o.point_id = m.point_id) AS outside_cells, (SELECT count(*) FROM jd WHERE jd.point_id = m.point_id AND NOT keep) AS overlap_cells FROM mem m GROUP BY 1""")
def g21_qa(spark, sf):
    return d8.reconcile_places(*_blurred(spark, sf))[1]


@query("g20_incremental_cells", FO + """, mem AS (SELECT point_id, d.k FROM couts o JOIN down d ON d.cur = o.k),
  nest AS (SELECT a.point_id AS up, b.point_id AS dn FROM couts a JOIN down d ON d.k = a.k JOIN couts b ON b.k = d.cur WHERE a.k <> b.k)
 SELECT point_id, k FROM mem m WHERE NOT EXISTS (SELECT 1 FROM mem q JOIN nest n ON n.up = q.point_id WHERE n.dn = m.point_id AND q.k = m.k)""")
def g20_cells(spark, sf):
    graph = _graph(spark, sf)
    pts = tb.cell_outlets(spark, sf).withColumn("node", rs.cell_id(F.col("row"), F.col("col")))
    # owner cells are exactly the catchment minus its nested catchments
    owner, _ = d8.catchment_owner(graph, pts)
    return owner.join(pts.select("point_id", F.col("node").alias("mark")), "mark").select("point_id", _k())
