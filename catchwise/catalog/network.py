"""Queries over the river network."""

from pyspark.sql import functions as F

from catchwise.catalog.base import query, table
from catchwise.operators import network as net
from catchwise.sources import testbed as tb

HEAD = f"WITH RECURSIVE {tb.LINKS_SQL}, {tb.OUTLETS_SQL}, {tb.CLOSURE_SQL}"
FULL = f"""WITH RECURSIVE {tb.LINKS_SQL},
 closure(outlet, linkno) AS (
  SELECT linkno, linkno FROM links
  UNION ALL
  SELECT c.outlet, l.linkno FROM closure c JOIN links l ON l.downstream_id = c.linkno)"""


def _points(spark, sf):
    acc = net.accumulate(tb.links(spark, sf), ["area_km2"]).select("linkno", "area_km2")
    return tb.outlet_links(spark, sf).join(acc, "linkno")


POINTS = HEAD + """, points AS (
  SELECT o.point_id, o.linkno, o.basin_code, sum(l.area_km2) AS area_km2
  FROM outlets o JOIN closure c ON c.outlet = o.linkno JOIN links l ON l.linkno = c.linkno
  GROUP BY ALL)"""


@query("g1_upstream", HEAD + " SELECT outlet, linkno FROM closure")
def g1(spark, sf):
    return net.upstream(tb.links(spark, sf), tb.outlet_links(spark, sf))


# connectors: parts whose size is a multiple of five have no subbasin
RAW_LINKS = f"""WITH RECURSIVE {tb.LINKS_SQL},
 flagged AS (SELECT linkno, downstream_id, CAST(round(slope * 1000) AS BIGINT) % 5 <> 0 AS is_real FROM links),
 walk(linkno, raw_ds, cur) AS (
  SELECT linkno, downstream_id, downstream_id FROM flagged WHERE is_real
  UNION ALL
  SELECT w.linkno, w.raw_ds, f.downstream_id FROM walk w JOIN flagged f ON f.linkno = w.cur WHERE NOT f.is_real)
 SELECT w.linkno, w.raw_ds, w.cur AS downstream_id, false AS broken
 FROM walk w LEFT JOIN flagged f ON f.linkno = w.cur WHERE w.cur IS NULL OR f.is_real"""


@query("g2_resolve_downstream", RAW_LINKS)
def g2(spark, sf):
    links = tb.links(spark, sf)
    subs = links.filter(F.round(F.col("slope") * 1000).cast("long") % 5 != 0).select(F.col("linkno").alias("polygon_id"))
    return net.resolve_downstream(links, subs)


# a loop is planted: the root drains into link 5, and link 7 names itself
@query("g3_find_cycles", f"""WITH RECURSIVE {tb.LINKS_SQL},
 looped AS (SELECT linkno, CASE WHEN linkno = 1 THEN 5 WHEN linkno = 7 THEN 7 ELSE downstream_id END AS downstream_id FROM links),
 walk(start, cur, hops) AS (
  SELECT linkno, downstream_id, 1 FROM looped
  UNION ALL
  SELECT w.start, l.downstream_id, w.hops + 1 FROM walk w JOIN looped l ON l.linkno = w.cur
  WHERE w.hops < 30 AND w.cur <> w.start)
 SELECT DISTINCT l.linkno, l.downstream_id, CASE WHEN l.linkno = l.downstream_id THEN 'self' ELSE 'loop' END AS kind
 FROM walk w JOIN looped l ON l.linkno = w.start WHERE w.cur = w.start""")
def g3(spark, sf):
    links = tb.links(spark, sf).withColumn(
        "downstream_id", F.when(F.col("linkno") == 1, F.lit(5)).when(F.col("linkno") == 7, F.lit(7))
        .otherwise(F.col("downstream_id")))
    return net.find_cycles(links)


@query("g4_basin_level", f"""WITH RECURSIVE {tb.LINKS_SQL},
 walk(linkno, basin_id, level_to_outlet) AS (
  SELECT linkno, linkno, CAST(0 AS BIGINT) FROM links WHERE downstream_id IS NULL
  UNION ALL
  SELECT l.linkno, w.basin_id, w.level_to_outlet + 1 FROM walk w JOIN links l ON l.downstream_id = w.linkno)
 SELECT * FROM walk""")
def g4(spark, sf):
    return net.basin_level(tb.links(spark, sf))


@query("g5_accumulate", FULL + """
 SELECT c.outlet AS linkno, round(sum(l.area_km2), 6) AS area_km2, round(sum(l.length_m), 4) AS length_m,
        count(*) AS upstream_count
 FROM closure c JOIN links l ON l.linkno = c.linkno GROUP BY 1""")
def g5(spark, sf):
    acc = net.accumulate(tb.links(spark, sf), ["area_km2", "length_m"])
    return acc.select("linkno", F.round("area_km2", 6).alias("area_km2"), F.round("length_m", 4).alias("length_m"),
                      "upstream_count")


@query("g6_duplicate_ids", "SELECT l_orderkey AS id, count(*) AS n FROM lineitem GROUP BY 1 HAVING count(*) > 1")
def g6(spark, sf):
    return net.duplicate_ids(table(spark, sf, "lineitem"), "l_orderkey")


STEMS = FULL + """,
 root_m(linkno, path_m) AS (
  SELECT linkno, length_m FROM links WHERE downstream_id IS NULL
  UNION ALL
  SELECT l.linkno, r.path_m + l.length_m FROM root_m r JOIN links l ON l.downstream_id = r.linkno),
 best AS (
  SELECT c.outlet, arg_min(c.linkno, (-round(r.path_m, 6), c.linkno)) AS headwater, max(r.path_m) AS top_m
  FROM closure c JOIN root_m r ON r.linkno = c.linkno GROUP BY 1)"""


@query("g11_longest_path", STEMS + f""", outlets2 AS (SELECT s_suppkey + 1 AS linkno FROM supplier),
 path(outlet, linkno, step, hw, total) AS (
  SELECT b.outlet, b.outlet, CAST(1 AS BIGINT), b.headwater, b.top_m - r.path_m + l.length_m
  FROM best b JOIN outlets2 o ON o.linkno = b.outlet JOIN root_m r ON r.linkno = b.outlet JOIN links l ON l.linkno = b.outlet
  UNION ALL
  SELECT p.outlet, l.linkno, p.step + 1, p.hw, p.total FROM path p JOIN links l ON l.downstream_id = p.linkno
  JOIN best b ON b.outlet = l.linkno AND b.headwater = p.hw)
 SELECT outlet, linkno, step, round(total, 4) AS main_length_m FROM path""")
def g11(spark, sf):
    out = net.longest_path(tb.links(spark, sf), tb.outlet_links(spark, sf))
    return out.select("outlet", "linkno", "step", F.round("main_length_m", 4).alias("main_length_m"))


STRAHLER = HEAD + """,
 cl AS (SELECT c.outlet, l.* FROM closure c JOIN links l ON l.linkno = c.linkno),
 counts AS (
  SELECT a.outlet, a.strm_order, count(*) AS streams
  FROM cl a LEFT JOIN cl b ON b.outlet = a.outlet AND b.linkno = a.downstream_id
  WHERE b.linkno IS NULL OR b.strm_order <> a.strm_order GROUP BY 1, 2),
 ratios AS (
  SELECT a.outlet, a.strm_order, a.streams, CAST(a.streams AS DOUBLE) / b.streams AS bifurcation_ratio
  FROM counts a LEFT JOIN counts b ON b.outlet = a.outlet AND b.strm_order = a.strm_order + 1)"""


@query("g17_strahler_counts", STRAHLER + " SELECT outlet, strm_order, streams, round(bifurcation_ratio, 6) AS bifurcation_ratio FROM ratios")
def g17(spark, sf):
    out = net.strahler_counts(tb.links(spark, sf), tb.outlet_links(spark, sf))
    return out.withColumn("bifurcation_ratio", F.round("bifurcation_ratio", 6)).withColumn("streams", F.col("streams").cast("long"))


@query("g18_junctions", f"""WITH {tb.LINKS_SQL}
 SELECT downstream_id AS linkno, count(*) AS incoming FROM links WHERE downstream_id IS NOT NULL
 GROUP BY 1 HAVING count(*) >= 2""")
def g18(spark, sf):
    return net.junctions(tb.links(spark, sf))


@query("z10_drainage", STRAHLER + """,
 sums AS (
  SELECT outlet, count(*) AS link_count, max(strm_order) AS stream_order_max, sum(length_m) / 1000 AS km,
         sum(area_km2) AS area_km2, sum(slope * length_m) / sum(length_m) * 100 AS network_mean_slope_pct,
         coalesce(sum(length_m) FILTER (strm_order = 1), 0) AS source_m, sum(length_m) AS length_m
  FROM cl GROUP BY 1),
 st AS (
  SELECT outlet, CAST(sum(streams) AS BIGINT) AS stream_count, avg(bifurcation_ratio) AS bifurcation_ratio,
         CAST(coalesce(sum(streams) FILTER (strm_order = 1), 0) AS BIGINT) AS source_stream_count FROM ratios GROUP BY 1),
 ju AS (
  SELECT outlet, count(*) AS junction_count FROM (
    SELECT outlet, downstream_id FROM cl WHERE linkno <> outlet GROUP BY 1, 2 HAVING count(*) >= 2) GROUP BY 1)
 SELECT s.outlet, link_count, stream_count, stream_order_max, coalesce(junction_count, 0) AS junction_count,
        round(bifurcation_ratio, 6) AS bifurcation_ratio, round(area_km2, 6) AS area_km2,
        round(km, 6) AS total_stream_length_km, round(km / stream_count, 6) AS mean_stream_length_km,
        round(km / area_km2, 6) AS drainage_density, round(stream_count / area_km2, 6) AS stream_frequency,
        round(coalesce(junction_count, 0) / area_km2, 6) AS junction_density,
        round(network_mean_slope_pct, 6) AS network_mean_slope_pct, round(source_m / 1000, 6) AS source_stream_length_km,
        source_stream_count, round(source_m / length_m, 6) AS source_factor,
        round(CAST(source_stream_count AS DOUBLE) / stream_count, 6) AS source_frequency,
        CASE WHEN km / area_km2 < 1 THEN 'Rendah' WHEN km / area_km2 < 2 THEN 'Sedang'
             WHEN km / area_km2 < 3.5 THEN 'Tinggi' ELSE 'Sangat tinggi' END AS density_class
 FROM sums s JOIN st USING (outlet) LEFT JOIN ju USING (outlet)""")
def z10(spark, sf):
    from catchwise.functions.numeric import DENSITY_BANDS, classify, rounded

    df = net.drainage_metrics(tb.links(spark, sf), tb.outlet_links(spark, sf))
    df = df.withColumn("density_class", classify(F.col("drainage_density"), *DENSITY_BANDS))
    return rounded(df, 6)


@query("c14_pair_relations", POINTS + """
 SELECT a.point_id AS upstream_point, b.point_id AS downstream_point, 'same_flow_path' AS relation
 FROM closure c JOIN points a ON a.linkno = c.linkno JOIN points b ON b.linkno = c.outlet WHERE a.linkno <> b.linkno""")
def c14(spark, sf):
    return net.flow_path_pairs(tb.links(spark, sf), _points(spark, sf))


@query("c14_classify_pairs", POINTS + """, pairs AS (
  SELECT 'P' || a.s_suppkey AS point_a, 'P' || (a.s_suppkey // 3) AS point_b FROM supplier a WHERE a.s_suppkey > 0)
 SELECT point_a, point_b,
        CASE WHEN u.outlet IS NOT NULL OR d.outlet IS NOT NULL THEN 'same_flow_path'
             WHEN a.basin_code = b.basin_code THEN 'same_basin_different_branch' ELSE 'different_basin' END AS relation,
        CASE WHEN d.outlet IS NOT NULL THEN point_a WHEN u.outlet IS NOT NULL THEN point_b END AS upstream_point,
        CASE WHEN d.outlet IS NOT NULL THEN point_b WHEN u.outlet IS NOT NULL THEN point_a END AS downstream_point
 FROM pairs JOIN points a ON a.point_id = point_a JOIN points b ON b.point_id = point_b
 LEFT JOIN closure u ON u.outlet = a.linkno AND u.linkno = b.linkno
 LEFT JOIN closure d ON d.outlet = b.linkno AND d.linkno = a.linkno""")
def c14_classify(spark, sf):
    pairs = table(spark, sf, "supplier").filter("s_suppkey > 0").select(
        F.concat(F.lit("P"), "s_suppkey").alias("point_a"),
        F.concat(F.lit("P"), F.expr("s_suppkey div 3")).alias("point_b"))
    return net.classify_pairs(pairs, tb.links(spark, sf), _points(spark, sf))


@query("c14_relation_counts", POINTS + """, flow AS (
   SELECT a.point_id AS pa, b.point_id AS pb, a.basin_code = b.basin_code AS same_code
   FROM points a JOIN points b ON a.point_id <> b.point_id
   WHERE EXISTS (SELECT 1 FROM closure c WHERE (c.outlet = a.linkno AND c.linkno = b.linkno) OR (c.outlet = b.linkno AND c.linkno = a.linkno))),
  agg AS (SELECT pa, count(*) AS n, count(*) FILTER (same_code) AS n_same FROM flow GROUP BY 1)
 SELECT p.point_id, CAST(0 AS BIGINT) AS same_outlet, coalesce(n, 0) AS same_flow_path,
        (SELECT count(*) FROM points q WHERE q.basin_code = p.basin_code) - 1 - coalesce(n_same, 0) AS same_basin_different_branch,
        (SELECT count(*) FROM points q WHERE q.basin_code <> p.basin_code) - (coalesce(n, 0) - coalesce(n_same, 0)) AS different_basin
 FROM points p LEFT JOIN agg ON agg.pa = p.point_id""")
def c14_counts(spark, sf):
    return net.relation_counts(tb.links(spark, sf), _points(spark, sf))


@query("c15_id_mismatches", f"""WITH {tb.LINKS_SQL}
 SELECT linkno AS id, 'missing_in_orders' AS problem FROM links WHERE linkno NOT IN (SELECT o_custkey FROM orders)
 UNION ALL
 SELECT DISTINCT o_custkey, 'missing_in_links' FROM orders WHERE o_custkey NOT IN (SELECT linkno FROM links)""")
def c15(spark, sf):
    orders = table(spark, sf, "orders").select(F.col("o_custkey").alias("linkno"))
    return net.id_mismatches(tb.links(spark, sf), orders, "linkno", "links", "orders")


@query("g19_chain_segments", POINTS + """, steps AS (
   SELECT basin_code AS basin_id, point_id AS upstream_point, linkno, area_km2,
          lead(point_id) OVER w AS downstream_point, lead(linkno) OVER w AS ds_link, lead(area_km2) OVER w AS ds_area
   FROM points WINDOW w AS (PARTITION BY basin_code ORDER BY round(area_km2, 6), point_id)),
 l AS (SELECT s.*, c.outlet IS NOT NULL AS linked FROM steps s
       LEFT JOIN closure c ON c.outlet = s.ds_link AND c.linkno = s.linkno WHERE downstream_point IS NOT NULL)
 SELECT basin_id, upstream_point, downstream_point, round(greatest(0, ds_area - area_km2), 6) AS incremental_area_km2,
        linked, bool_and(linked) OVER (PARTITION BY basin_id) AS is_chain FROM l""")
def g19(spark, sf):
    points = _points(spark, sf).withColumnRenamed("basin_code", "basin_id").withColumn("area_km2", F.round("area_km2", 6))
    out = net.chain_segments(tb.links(spark, sf), points)
    return out.withColumn("incremental_area_km2", F.round("incremental_area_km2", 6))


@query("g20_incremental_area", POINTS + """, nearest AS (
   SELECT a.point_id, a.linkno, a.area_km2, arg_min(b.linkno, b.area_km2) AS parent
   FROM points a JOIN closure c ON c.linkno = a.linkno JOIN points b ON b.linkno = c.outlet
   WHERE b.linkno <> a.linkno GROUP BY ALL),
  taken AS (SELECT parent, sum(area_km2) AS t FROM nearest GROUP BY 1)
 SELECT p.linkno AS outlet, round(p.area_km2, 6) AS area_km2,
        round(greatest(0, p.area_km2 - coalesce(t, 0)), 6) AS incremental_area_km2
 FROM points p LEFT JOIN taken ON taken.parent = p.linkno""")
def g20(spark, sf):
    from catchwise.functions.numeric import rounded

    links, points = tb.links(spark, sf), _points(spark, sf)
    _, tree = net.outlet_tree(links, points)
    areas = points.select(F.col("linkno").alias("outlet"), "area_km2")
    return rounded(net.incremental_area(tree, areas), 6)


@query("c14_next_downstream", POINTS + """ SELECT a.point_id AS upstream_point, arg_min(b.point_id, b.area_km2) AS downstream_point
 FROM points a JOIN closure c ON c.linkno = a.linkno JOIN points b ON b.linkno = c.outlet WHERE a.linkno <> b.linkno GROUP BY 1""")
def c14_next(spark, sf):
    return net.next_downstream(tb.links(spark, sf), _points(spark, sf))
