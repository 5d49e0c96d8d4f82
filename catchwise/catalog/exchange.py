"""Queries over ingest, text functions, sinks and streams."""

import uuid

from pyspark.sql import functions as F

from catchwise.catalog.base import ORACLES, query, table
from catchwise.catalog.response import INPUT_SQL
from catchwise.functions import text as tx
from catchwise.functions.numeric import finite, param, rounded
from catchwise.operators import hydrograph as hg
from catchwise.operators import morphometry as mo
from catchwise.operators import stats as st
from catchwise.runtime import Cut, cut, scratch_root
from catchwise.sinks import publish as pb
from catchwise.sinks import reports as rp
from catchwise.sinks import vector as vc
from catchwise.sources import discharge as sd
from catchwise.sources import layers as ly
from catchwise.sources import outlets as ol
from catchwise.sources import testbed as tb
from catchwise.streaming import flows as fl

REQUIRED = {"part": ["p_partkey", "p_retailprice"], "supplier": ["s_suppkey"], "orders": ["o_orderkey", "o_totalprice"], "lineitem": ["l_shipdate", "l_quantity"]}


@query("a1_load_layers", " UNION ALL ".join(f"SELECT '{n}' AS layer, count(*) AS row_count FROM {n}" for n in REQUIRED))
def a1(spark, sf):
    layers = ly.load_layers(spark, sf, REQUIRED)
    frames = [df.agg(F.count("*").alias("row_count")).select(F.lit(n).alias("layer"), "row_count") for n, df in layers.items()]
    return sd.union_sheets(frames)


@query("a2_resolve_dataset", f"WITH {tb.LINKS_SQL} SELECT linkno, '1km2' AS dataset_id FROM links WHERE linkno % 3 = 1")
def a2(spark, sf):
    versions = tb.links(spark, sf).select("linkno", F.element_at(F.array(F.lit("current"), F.lit("1km2"), F.lit("0_5km2")), (F.col("linkno") % 3 + 1).cast("int")).alias("dataset_id"))
    return ly.resolve_dataset(versions, None, " 1km2 ")


RAWPTS = """raw AS (SELECT c_custkey AS k, CASE WHEN c_custkey % 31 = 0 THEN '' WHEN c_custkey % 17 = 0 THEN 'abc' WHEN c_custkey % 13 = 0 THEN '95,5' ELSE replace(CAST(-7.5 + (c_custkey % 1000) / 1000.0 AS VARCHAR), '.', ',') END AS lat,
  CASE WHEN c_custkey % 31 = 0 THEN '' ELSE replace(CAST(110 + (c_custkey * 7 % 1000) / 1000.0 AS VARCHAR), '.', ',') END AS lon, c_name || ' titik pengamatan' AS label, 'Kali ' || c_mktsegment AS river FROM customer),
 num AS (SELECT k, label, river, TRY_CAST(replace(lat, ',', '.') AS DOUBLE) AS la, TRY_CAST(replace(lon, ',', '.') AS DOUBLE) AS lo FROM raw WHERE lat <> '' OR lon <> '')"""


def _raw_points(spark, sf):
    k = F.col("c_custkey")
    def comma(c):
        return F.replace(c.cast("string"), F.lit("."), F.lit(","))
    return table(spark, sf, "customer").select(
        k.alias("k"), F.lit("a.xlsx").alias("file"), F.concat("c_name", F.lit(" titik pengamatan")).alias("NAMA TITIK"), F.concat(F.lit("Kali "), "c_mktsegment").alias("nama sungai"),
        F.when(k % 31 == 0, "").when(k % 17 == 0, "abc").when(k % 13 == 0, "95,5").otherwise(comma(-7.5 + (k % 1000) / 1000.0)).alias("Lintang"),
        F.when(k % 31 == 0, "").otherwise(comma(110 + (k * 7 % 1000) / 1000.0)).alias("Bujur"))


@query("a3_ingest_outlets", f"WITH {RAWPTS} SELECT k, substr(label, 1, 25) AS label, river AS river_name, round(la, 6) AS lat, round(lo, 6) AS lon FROM num WHERE la BETWEEN -90 AND 90 AND lo BETWEEN -180 AND 180")
def a3(spark, sf):
    return rounded(ol.ingest_outlets(_raw_points(spark, sf))[0].drop("file"), 6)


@query("a3_rejected", f"WITH {RAWPTS} SELECT k, CASE WHEN la IS NULL THEN 'not_a_number' ELSE 'out_of_range' END AS reason FROM num WHERE la IS NULL OR la NOT BETWEEN -90 AND 90")
def a3_rejected(spark, sf):
    return ol.ingest_outlets(_raw_points(spark, sf))[1].drop("file")


@query("a10_build_toponyms", f"WITH {tb.TOPONYMS_SQL} SELECT id, name, name_norm, category, CAST(lon AS DOUBLE) AS lon, CAST(lat AS DOUBLE) AS lat, CAST(priority AS INTEGER) AS priority FROM topo")
def a10(spark, sf):
    from catchwise.sources.toponyms import build_toponyms

    return build_toponyms(tb.toponyms_raw(spark, sf))


@query("a11_optional_layer", "SELECT s_suppkey, c_acctbal AS balance, c_acctbal IS NOT NULL AS balance_available FROM supplier LEFT JOIN (SELECT * FROM customer WHERE c_custkey % 3 <> 0) ON c_custkey = s_suppkey")
def a11(spark, sf):
    extra = table(spark, sf, "customer").filter("c_custkey % 3 <> 0").select(F.col("c_custkey").alias("s_suppkey"), F.col("c_acctbal").alias("balance"))
    return ly.optional(table(spark, sf, "supplier").select("s_suppkey"), extra, "s_suppkey", "balance")


@query("c4_subbasin_crosswalk", f"WITH {tb.LINKS_SQL} SELECT linkno AS polygon_id, n_name AS basin_name FROM links LEFT JOIN nation ON n_nationkey = linkno % 40")
def c4(spark, sf):
    cross = table(spark, sf, "nation").select(F.col("n_nationkey").cast("long").alias("code"), F.col("n_name").alias("basin_name"))
    subs = tb.links(spark, sf).select(F.col("linkno").alias("polygon_id"), (F.col("linkno") % 40).alias("code"))
    return subs.join(cross, "code", "left").select("polygon_id", "basin_name")


@query("c17_observation_climate", f"WITH {tb.CLIMATE_SQL}, {tb.DISCHARGE_SQL} SELECT point_id, year, period, q, round(p_mm, 6) AS p_mm FROM climate JOIN discharge USING (year, period) WHERE 'P' || substr(gauge, 2) = point_id")
def c17(spark, sf):
    obs = cut(tb.discharge(spark, sf).select(F.concat(F.lit("P"), F.expr("substring(gauge, 2)")).alias("point_id"), "year", "period", "q"))
    return tb.climate(spark, sf, obs).join(obs, ["point_id", "year", "period"]).select("point_id", "year", "period", "q", F.round("p_mm", 6).alias("p_mm"))


# --- text ---------------------------------------------------------------------------------------

NM = "list_extract(['Kali ', 'K. ', 'sungai ', 'S. ', '  ', ''], p_partkey % 6 + 1)"


@query("p8_river_names", f"""WITH n AS (SELECT p_partkey, {NM} || p_name AS raw FROM part), b AS (SELECT p_partkey, trim(regexp_replace(trim(raw), '^(Kali |K\\. |K |Sungai |S\\. |S )', '', 'i')) AS base FROM n)
 SELECT p_partkey, base AS base_name, 'Kali ' || base AS label, 'K. ' || base AS map_label FROM b""")
def p8(spark, sf):
    pre = F.element_at(F.array(*[F.lit(v) for v in ("Kali ", "K. ", "sungai ", "S. ", "  ", "")]), (F.col("p_partkey") % 6 + 1).cast("int"))
    df = table(spark, sf, "part").select("p_partkey", F.concat(pre, "p_name").alias("raw"))
    return df.select("p_partkey", tx.river_base_name(F.col("raw")).alias("base_name"), tx.river_label(F.col("raw")).alias("label"), tx.river_map_label(F.col("raw")).alias("map_label"))


@query("p9_search_text", "SELECT p_partkey, trim(regexp_replace(strip_accents(lower('  Désa   ' || p_name || ' ÀÑ ')), '\\s+', ' ', 'g')) AS norm FROM part")
def p9(spark, sf):
    return table(spark, sf, "part").select("p_partkey", tx.search_text(F.concat(F.lit("  Désa   "), "p_name", F.lit(" ÀÑ "))).alias("norm"))


@query("p10_safe_name", r"""SELECT p_partkey, regexp_replace(regexp_replace(regexp_replace(regexp_replace('K. ' || p_brand || '/' || p_name || ' (x)', '^[KS]\.\s*', 'K_', 'i'), '[^0-9A-Za-zÀ-ÿ_-]+', '_', 'g'), '_+', '_', 'g'), '^_+|_+$', '', 'g') AS file FROM part""")
def p10(spark, sf):
    return table(spark, sf, "part").select("p_partkey", tx.safe_name(F.concat(F.lit("K. "), "p_brand", F.lit("/"), "p_name", F.lit(" (x)")), "dta").alias("file"))


@query("p11_number_guards", "SELECT c_custkey, CASE WHEN c_acctbal > 0 THEN c_acctbal END AS positive, CAST(least(5000, greatest(100, coalesce(CASE WHEN c_custkey % 7 <> 0 THEN c_acctbal END, 1000))) AS DOUBLE) AS clamped FROM customer")
def p11(spark, sf):
    c = table(spark, sf, "customer")
    v = F.when(F.col("c_custkey") % 7 != 0, F.col("c_acctbal")).otherwise(float("nan"))
    return c.select("c_custkey", finite(F.col("c_acctbal"), positive=True).alias("positive"), param(v, 1000, 100, 5000).alias("clamped"))


# Relief names and their local wording (fixed values)
RELIEF = {"Flat": "datar", "Undulating": "bergelombang", "Rolling": "berombak", "Hilly": "berbukit", "Hillocky": "berbukit kecil", "Mountainous": "bergunung"}


@query("p13_translate", """SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 'datar' WHEN 1 THEN 'bergunung' WHEN 2 THEN 'relief belum teridentifikasi' WHEN 3 THEN 'relief belum teridentifikasi' ELSE lower(substr(p_type, 1, 1)) || substr(p_type, 2) END AS name FROM part""")
def p13(spark, sf):
    k = F.col("p_partkey") % 5
    raw = F.when(k == 0, "Flat").when(k == 1, " Mountainous ").when(k == 2, "-").when(k == 3, F.lit(None)).otherwise(F.col("p_type"))
    return table(spark, sf, "part").select("p_partkey", tx.translated(raw, RELIEF, "relief belum teridentifikasi").alias("name"))


@query("p14_number_text", """SELECT p_partkey, replace(printf('%.2f', p_retailprice), '.', ',') AS text, CASE WHEN p_partkey % 3 = 0 THEN p_brand WHEN p_partkey % 3 = 1 THEN p_brand || ' dan ' || p_type ELSE p_brand || ', ' || p_type || ' dan ' || p_name END AS joined FROM part""")
def p14(spark, sf):
    items = F.slice(F.array("p_brand", "p_type", "p_name"), F.lit(1), (F.col("p_partkey") % 3 + 1).cast("int"))
    return table(spark, sf, "part").select("p_partkey", tx.number_text(F.col("p_retailprice"), 2).alias("text"), tx.natural_join(items).alias("joined"))


@query("p15_narrative")
def p15(spark, sf):
    df = mo.response_class(mo.shape_ratios(tb.catchments(spark, sf)))
    land = F.array(F.struct(F.lit("dataran aluvial").alias("name"), (60.0 + F.col("s_suppkey") % 10).alias("area_pct")), F.struct(F.lit("lembah").alias("name"), (40.0 - F.col("s_suppkey") % 10).alias("area_pct")))
    return rp.narrative(df.withColumn("land_types", land))


# --- layers --------------------------------------------------------------------------------------

def _labelled(spark, sf):
    return tb.catchments(spark, sf).withColumns({
        "label": F.when(F.col("s_suppkey") % 4 != 0, F.concat(F.lit("Pos <"), "s_suppkey", F.lit(">"))).otherwise(""), "basin_name": F.concat(F.lit("DAS "), F.col("s_suppkey") % 7),
        "river_name": F.when(F.col("s_suppkey") % 5 != 0, F.concat(F.lit("Kali "), F.col("s_suppkey") % 9)), "source": F.lit("uji & coba"),
        "lat": -7.5 + F.col("s_suppkey") / 1000.0, "lon": 110 + F.col("s_suppkey") / 500.0})


LAB = f"""WITH {tb.CATCHMENTS_SQL}, lab AS (SELECT *, CASE WHEN s_suppkey % 4 <> 0 THEN 'Pos <' || s_suppkey || '>' ELSE point_id END AS nama, 'DAS ' || (s_suppkey % 7) AS basin_name,
  CASE WHEN s_suppkey % 5 <> 0 THEN 'Kali ' || (s_suppkey % 9) END AS river_name, -7.5 + s_suppkey / 1000.0 AS lat, 110 + s_suppkey / 500.0 AS lon FROM catchments)"""


#: Parts with their rings of every polygon, as text.
SHAPES = f"""{tb.POLYGONS_SQL}, gr AS (SELECT poly_id, part, ring, '[' || string_agg('[' || CAST(x1 AS VARCHAR) || ',' || CAST(y1 AS VARCHAR) || ']', ',' ORDER BY seq) || ',' || any_value(CASE WHEN seq = 0 THEN '[' || CAST(x1 AS VARCHAR) || ',' || CAST(y1 AS VARCHAR) || ']' END) || ']' AS c FROM edges GROUP BY 1, 2, 3),
  gp AS (SELECT poly_id, part, '[' || string_agg(c, ',' ORDER BY ring) || ']' AS c FROM gr GROUP BY 1, 2), shapes AS (SELECT poly_id, string_agg(c, ',' ORDER BY part) AS c FROM gp GROUP BY 1)"""


def _shapes(spark, sf):
    return tb.polygons(spark, sf).withColumn("poly_id", F.concat(F.lit("P"), "poly_id"))


@query("k1_catchment_layer", LAB + f""", {SHAPES} SELECT point_id AS ID, nama AS NAMA, round(area_km2, 6) AS LUAS_KM2, basin_name AS DAS, river_name AS SUNGAI, 'uji & coba' AS SUMBER,
   '{{"type":"MultiPolygon","coordinates":[' || c || ']}}' AS GEOMETRY FROM lab LEFT JOIN shapes ON poly_id = s_suppkey""")
def k1(spark, sf):
    return vc.with_areas(rounded(vc.catchment_layer(_labelled(spark, sf)), 6), _shapes(spark, sf))


@query("k4_kml_areas", LAB + f""", {tb.POLYGONS_SQL}, r AS (SELECT poly_id, part, ring, '<LinearRing><coordinates>' || string_agg(printf('%.8f,%.8f,0', x1, y1), ' ' ORDER BY seq) || ' ' || any_value(CASE WHEN seq = 0 THEN printf('%.8f,%.8f,0', x1, y1) END) || '</coordinates></LinearRing>' AS c FROM edges GROUP BY 1, 2, 3),
  g AS (SELECT poly_id, part, '<Polygon>' || string_agg(CASE WHEN ring = 0 THEN '<outerBoundaryIs>' || c || '</outerBoundaryIs>' ELSE '<innerBoundaryIs>' || c || '</innerBoundaryIs>' END, '' ORDER BY ring) || '</Polygon>' AS c FROM r GROUP BY 1, 2),
  m AS (SELECT poly_id, string_agg(c, '' ORDER BY part) AS c FROM g GROUP BY 1)
 SELECT point_id AS ID, '<Placemark><name>' || replace(replace(nama, '<', '&lt;'), '>', '&gt;') || '</name><ExtendedData><Data name="SUMBER"><value>uji &amp; coba</value></Data></ExtendedData><MultiGeometry>' || c || '</MultiGeometry></Placemark>' AS placemark FROM lab JOIN m ON poly_id = s_suppkey""")
def k4_areas(spark, sf):
    df = _labelled(spark, sf).select(F.col("point_id").alias("ID"), F.col("label").alias("NAMA"), F.col("source").alias("SUMBER"))
    return vc.areas_to_kml(df, _shapes(spark, sf), ["SUMBER"])


@query("k4_kml_lines", f"""WITH {tb.RINGS_SQL} SELECT ring_id AS ID, '<Placemark><name>R' || ring_id || '</name><LineString><coordinates>' || string_agg(printf('%.8f,%.8f,0', round(x, 3) + 0.0, round(y, 3) + 0.0), ' ' ORDER BY seq) || '</coordinates></LineString></Placemark>' AS placemark FROM rv GROUP BY 1""")
def k4_lines(spark, sf):
    v = tb.ring_vertices(spark, sf).select(F.col("ring_id").alias("ID"), "seq", (F.round("x", 3) + 0.0).alias("x"), (F.round("y", 3) + 0.0).alias("y"))
    return vc.lines_to_kml(v.select("ID").distinct().withColumn("NAMA", F.concat(F.lit("R"), "ID")), v, [])


@query("k2_outlet_layer", LAB + " SELECT point_id AS ID, nama AS NAMA, basin_name AS DAS, river_name AS SUNGAI, round(CAST(lat AS DOUBLE), 6) AS LINTANG, round(CAST(lon AS DOUBLE), 6) AS BUJUR FROM lab")
def k2(spark, sf):
    return rounded(vc.outlet_layer(_labelled(spark, sf)), 6)


@query("k3_geojson", f"""WITH {tb.POLYGONS_SQL}, r AS (SELECT poly_id, part, ring, '[' || string_agg('[' || CAST(x1 AS VARCHAR) || ',' || CAST(y1 AS VARCHAR) || ']', ',' ORDER BY seq) || ',' || any_value(CASE WHEN seq = 0 THEN '[' || CAST(x1 AS VARCHAR) || ',' || CAST(y1 AS VARCHAR) || ']' END) || ']' AS c FROM edges GROUP BY 1, 2, 3),
  p AS (SELECT poly_id, part, '[' || string_agg(c, ',' ORDER BY ring) || ']' AS c FROM r GROUP BY 1, 2), m AS (SELECT poly_id, string_agg(c, ',' ORDER BY part) AS c FROM p GROUP BY 1)
 SELECT poly_id, '{{"type":"Feature","properties":{{"NAMA":"D' || poly_id || '"}},"geometry":{{"type":"MultiPolygon","coordinates":[' || c || ']}}}}' AS feature FROM m""")
def k3(spark, sf):
    e = tb.polygons(spark, sf)
    return vc.to_geojson(e, e.select("poly_id").distinct().withColumn("NAMA", F.concat(F.lit("D"), "poly_id")))


@query("k4_kml", LAB + """ SELECT point_id AS ID, '<Placemark><name>' || replace(replace(nama, '<', '&lt;'), '>', '&gt;') || '</name><ExtendedData>' || CASE WHEN river_name IS NOT NULL THEN '<Data name="SUNGAI"><value>' || river_name || '</value></Data>' ELSE '' END
   || '<Data name="SUMBER"><value>uji &amp; coba</value></Data></ExtendedData><Point><coordinates>' || printf('%.8f,%.8f,0', CAST(lon AS DOUBLE), CAST(lat AS DOUBLE)) || '</coordinates></Point></Placemark>' AS placemark FROM lab""")
def k4(spark, sf):
    df = _labelled(spark, sf).select(F.col("point_id").alias("ID"), F.col("label").alias("NAMA"), "lon", "lat", F.col("river_name").alias("SUNGAI"), F.col("source").alias("SUMBER"))
    return vc.to_kml(df, ["SUNGAI", "SUMBER"])


@query("k5_export", LAB + " SELECT point_id, mode, round(area_km2, 6) AS area_km2 FROM lab CROSS JOIN (VALUES ('smoothed'), ('raw')) m(mode)")
def k5(spark, sf):
    df = _labelled(spark, sf).select("point_id", "area_km2", F.explode(F.array(F.lit("smoothed"), F.lit("raw"))).alias("mode"))
    paths = vc.export({"catchment": df}, f"{scratch_root(spark)}/export_{uuid.uuid4().hex}", formats=["parquet", "json"])
    return rounded(spark.read.parquet(paths[0]).select("point_id", "mode", "area_km2"), 6)


def _param_sql(tab, cols):
    return " UNION ALL ".join(f"SELECT point_id AS ID, nama AS NAMA, '{p}' AS PARAM, '{d}' AS KETERANGAN, round({cols[p]}, 6) AS NILAI, '{u}' AS SATUAN, '{k}' AS KIND, 'uji & coba' AS SUMBER FROM lab" for p, (d, u, k) in tab.items() if p in cols)


CHAR = {"MAIN_CHANNEL": "main_length_km", "L": "flow_length_km", "LCA": "flow_lc_km", "L10_85": "flow_length_km * 0.75", "L10": "flow_length_km * 0.1", "L85": "flow_length_km * 0.85"}
GAM = {"AU": "upstream_area_km2", "WL": "width_lower_km", "WU": "width_upstream_km", "A": "flow_length_km * 0.25", "B": "flow_length_km * 0.75"}


@query("k6_characteristic_layers", LAB + " " + _param_sql(vc.CHARACTERISTIC, CHAR))
def k6(spark, sf):
    df = _labelled(spark, sf).withColumns({p: F.expr(e) for p, e in CHAR.items()})
    return rounded(vc.characteristic_layers(df.select("point_id", "label", "source", *CHAR)), 6)


@query("k7_gama_layers", LAB + " " + _param_sql(vc.GAMA, GAM))
def k7(spark, sf):
    df = _labelled(spark, sf).withColumns({p: F.expr(e) for p, e in GAM.items()})
    return rounded(vc.gama_layers(df.select("point_id", "label", "source", *GAM)), 6)


@query("k8_drop_empty", "SELECT c_custkey, c_name, 'x' AS SUMBER FROM customer")
def k8(spark, sf):
    df = table(spark, sf, "customer").select("c_custkey", F.lit("x").alias("SUMBER"), F.lit(None).cast("string").alias("a"), F.lit(" ").alias("b"), F.lit(float("nan")).alias("c"), "c_name")
    return vc.drop_empty(df)


def _k9_value(c):
    return f"round({c}, 6)" if c in [*tb.CATCHMENT_EXPRS, "drainage_density", "stream_frequency", "form_factor"] else "CAST(NULL AS DOUBLE)"


def _k9_reading(c):
    if c not in rp.BANDS:
        return f"'{rp.READINGS[c]}'"
    v = _k9_value(c)
    return f"CASE WHEN {v} IS NULL THEN NULL " + " ".join(f"WHEN {v} >= {b} THEN '{n}'" if b is not None else f"ELSE '{n}'" for b, n in rp.BANDS[c]) + " END"


@query("k9_parameter_rows", f"WITH {tb.CATCHMENTS_SQL}, b AS (SELECT *, area_km2 / pow(flow_length_km, 2) AS form_factor FROM catchments) " + " UNION ALL ".join(
    f"SELECT point_id, {i} AS position, '{lab}' AS label, {_k9_value(c)} AS value, '{u}' AS unit, {_k9_reading(c)} AS interpretation FROM b" for i, (lab, c, u) in enumerate(rp.PARAMETERS, 1)))
def k9(spark, sf):
    keep = ["point_id", *tb.CATCHMENT_EXPRS, "drainage_density", "stream_frequency", "form_factor"]
    df = tb.catchments(spark, sf).withColumn("form_factor", F.col("area_km2") / F.col("flow_length_km") ** 2)
    return rounded(rp.parameter_rows(df.select(*keep)), 6)


@query("k10_hss_summary", f"SELECT i.point_id, m.method, coalesce(x.tp_hours IS NOT NULL, false) AS available, x.tp_hours, x.qp_m3s, x.tb_hours, x.equivalent_mm, x.volume_error_pct, "
       "CASE WHEN m.method = 'gama1' THEN concat_ws(',', CASE WHEN i.S IS NULL THEN 'S' END, CASE WHEN i.RUA IS NULL THEN 'RUA' END, CASE WHEN i.SIM IS NULL THEN 'SIM' END) WHEN m.method = 'limantara' AND i.S IS NULL THEN 'S' ELSE '' END AS missing_inputs "
       f"FROM ({INPUT_SQL} SELECT * FROM inputs) i CROSS JOIN (SELECT unnest({list(hg.METHODS)}) AS method) m LEFT JOIN ({ORACLES['h11_volume_check']}) x ON x.point_id = i.point_id AND x.method = m.method")
def k10(spark, sf):
    out = rp.hss_summary(hg.hydrographs(hg.resolve_inputs(tb.catchments(spark, sf))))
    return out.withColumn("volume_error_pct", F.round("volume_error_pct", 4)).withColumns({c: F.round(c, 6) for c in ("tp_hours", "qp_m3s", "tb_hours", "equivalent_mm")})


@query("k11_model_quantiles", f"WITH {tb.DISCHARGE_SQL}, s AS (SELECT gauge AS point_id, count(*) AS count, avg(q) AS mean, quantile_cont(q, 0.5) AS q50 FROM discharge GROUP BY 1) SELECT point_id, count, round(mean, 6) AS mean, 'Q50' AS quantile, round(q50, 6) AS value FROM s")
def k11(spark, sf):
    q = tb.discharge(spark, sf).withColumnRenamed("gauge", "point_id")
    _, long = rp.model_tables(q, st.series_stats(q, ["point_id"], bounded=True).select("point_id", "count", "mean", "q50"))
    return rounded(long, 6)


@query("k12_content_signature")
def k12(spark, sf):
    return pb.content_signature(table(spark, sf, "lineitem"))


@query("k13_differences", "SELECT o_orderkey, o_totalprice, 'a' AS side FROM orders WHERE o_orderkey % 1000 = 7 UNION ALL SELECT o_orderkey, o_totalprice + 1, 'b' FROM orders WHERE o_orderkey % 1000 = 7")
def k13(spark, sf):
    a = table(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    return pb.differences(a, a.withColumn("o_totalprice", F.when(F.col("o_orderkey") % 1000 == 7, F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice"))))


@query("k14_publish")
def k14(spark, sf):
    path = f"{scratch_root(spark)}/publish_{uuid.uuid4().hex}/links"
    pb.publish(tb.links(spark, sf).limit(0), path)
    pb.publish(tb.links(spark, sf), path)
    return spark.read.parquet(path)


# --- streams ---------------------------------------------------------------------------------------

def _drain(stream, sink, mode="append"):
    root = scratch_root(stream.sparkSession)
    q = stream.writeStream.outputMode(mode).trigger(availableNow=True).option("checkpointLocation", f"{root}/stream_{uuid.uuid4().hex}")
    handle = sink(q).start()
    handle.awaitTermination()


@query("s1_halfmonth_stream", f"""WITH d AS (SELECT l_suppkey % 8 AS cell, CAST(l_shipdate AS DATE) AS date, sum(CAST(l_quantity AS BIGINT)) AS q FROM lineitem GROUP BY 1, 2),
  p AS (SELECT cell, CAST(year(date) AS INTEGER) AS year, {tb.PERIOD_SQL.format(d='date')} AS period, sum(q) AS q, count(*) AS n FROM d GROUP BY 1, 2, 3),
  e AS (SELECT *, CASE WHEN period % 2 = 0 THEN make_date(year, period // 2 + 1, 15) ELSE last_day(make_date(year, period // 2 + 1, 1)) END AS fin, {tb.DAYS_SQL.format(p='period', y='year')} AS days FROM p)
 SELECT cell, year, period, CAST(q AS DOUBLE) / 100 AS mm, CAST(n AS INTEGER) AS days_seen, n = days AS complete FROM e""")
def s1(spark, sf):
    # the arriving feed has one row a cell and day, and every third row comes twice
    daily = table(spark, sf, "lineitem").groupBy((F.col("l_suppkey") % 8).alias("cell"), F.col("l_shipdate").cast("timestamp").alias("ts")).agg(F.sum(F.col("l_quantity").cast("long")).cast("double").alias("mm"))
    arrived = Cut(daily.withColumn("_n", F.explode(F.sequence(F.lit(1), F.when(F.dayofyear("ts") % 3 == 0, 2).otherwise(1)))).drop("_n"))
    feed = spark.readStream.schema(arrived.df.schema).parquet(arrived.path)
    out = f"{scratch_root(spark)}/s1_{uuid.uuid4().hex}"
    result = fl.halfmonth_totals(feed).withColumn("mm", F.col("mm") / 100)
    _drain(result, lambda w: w.foreachBatch(lambda b, i: b.withColumn("batch", F.lit(i)).write.mode("append").parquet(out)), "update")
    # the newest report of each period, so periods still open at the end are there too
    keys = ["cell", "year", "period"]
    newest = spark.read.parquet(out).groupBy(*keys).agg(F.max_by(F.struct("mm", "days_seen", "complete"), "batch").alias("r"))
    return newest.select(*keys, "r.*")


@query("s3_newest_request", "SELECT user_id AS client_id, arg_max(event_id, (ts, event_id)) AS request_id FROM events GROUP BY 1")
def s3(spark, sf):
    src = spark.readStream.schema(table(spark, sf, "events").schema).parquet(f"{sf}/events*.parquet")
    feed = src.select(F.col("user_id").alias("client_id"), F.col("event_id").alias("request_id"), "ts")
    out = f"{scratch_root(spark)}/s3_{uuid.uuid4().hex}"
    _drain(fl.newest_request(feed), lambda w: w.foreachBatch(lambda b, i: b.write.mode("overwrite").parquet(out)), "complete")
    return spark.read.parquet(out).select("client_id", "request_id")


@query("s4_guarded_ingest")
def s4(spark, sf):
    from catchwise.catalog.streamflow import _wide

    root = f"{scratch_root(spark)}/s4_{uuid.uuid4().hex}"
    wide = _wide(spark, sf)
    wide.write.parquet(f"{root}/in")
    src = spark.readStream.schema(wide.schema).parquet(f"{root}/in")
    guard = fl.guard_batches(lambda b: sd.ingest_discharge(b), f"{root}/ok", f"{root}/bad", ["gauge", "year"])
    _drain(src, lambda w: w.foreachBatch(guard))
    ok = spark.read.parquet(f"{root}/ok").select("gauge", "year", F.lit("accepted").alias("outcome"))
    bad = spark.read.parquet(f"{root}/bad").select("gauge", F.col("year").cast("int").alias("year"), F.col("reason").alias("outcome"))
    return ok.unionByName(bad).groupBy("gauge", "year", "outcome").agg(F.count("*").alias("rows"))


#: A year of the balance stream's feed arrives in as many files as it has so many rows.
FEED_ROWS = 100_000


def _balance_stream(spark, sf):
    root = f"{scratch_root(spark)}/s2_{uuid.uuid4().hex}"
    climate = tb.climate(spark, sf).select("point_id", "year", "period", "days", "p_mm", "et0_mm", "wet_days")
    climate = cut(climate)
    # one batch a year, in mixed order; the first one comes once more at the end
    rows = {r.year: r["count"] for r in climate.groupBy("year").count().collect()}
    years = sorted(rows, key=lambda y: (y * 5 % 7, y))
    files = max(1, min(rows.values(), default=0) // FEED_ROWS)
    for year in [*years, *years[:1]]:
        part = climate.filter(F.col("year") == year)
        (part.coalesce(1) if files == 1 else part.repartition(files)).write.mode("append").parquet(f"{root}/in")
    begin = climate.groupBy("point_id").agg(F.min(F.struct("year", "period")).alias("b")).select("point_id", F.col("b.year").alias("first_year"), F.col("b.period").alias("first_period"))
    key, provider = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    before = spark.conf.get(key, None)
    spark.conf.set(key, provider)
    try:
        src = spark.readStream.schema(climate.schema).option("maxFilesPerTrigger", files).parquet(f"{root}/in")
        result = fl.water_balance_stream(src, cut(tb.mock_parameters(spark, sf).join(begin, "point_id")))
        _drain(result, lambda w: w.format("parquet").option("path", f"{root}/out"))
    finally:
        spark.conf.set(key, before) if before else spark.conf.unset(key)
    return spark.read.parquet(f"{root}/out")


from catchwise.catalog.streamflow import MOCK  # noqa: E402


@query("s2_balance_stream", MOCK + " SELECT point_id, year, period, round(soil, 6) AS soil_mm, round(gw, 6) AS groundwater_mm, round(runoff, 6) AS runoff_mm FROM trace")
def s2(spark, sf):
    return rounded(_balance_stream(spark, sf).filter("status = 'done'").drop("status"), 6)


