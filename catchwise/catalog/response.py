"""Queries over catchment response: unit hydrographs, time of concentration, morphometry."""

from pyspark.sql import functions as F

from catchwise.catalog.base import query, table
from catchwise.functions.numeric import rounded
from catchwise.operators import concentration as tc
from catchwise.operators import hydrograph as hg
from catchwise.operators import morphometry as mo
from catchwise.sources import testbed as tb

INPUT_SQL = f"""WITH {tb.CATCHMENTS_SQL},
picked AS (
  SELECT *, main_length_km > 0 AND (main_lc_km IS NULL OR main_lc_km <= main_length_km * 1.001) AS ok FROM catchments),
inputs AS (
  SELECT point_id, area_km2 AS A,
         CASE WHEN ok THEN main_length_km ELSE coalesce(flow_length_km, main_length_km) END AS L,
         CASE WHEN ok THEN coalesce(main_lc_km, flow_lc_km) ELSE coalesce(flow_lc_km, main_lc_km) END AS Lc,
         CASE WHEN ok THEN main_slope_pct ELSE coalesce(flow_slope_pct, main_slope_pct) END / 100 AS S,
         total_stream_length_km AS Lt, source_stream_length_km AS L1, stream_count AS N, source_stream_count AS N1,
         width_upstream_km AS WU, width_lower_km AS WL, upstream_area_km2 AS AU, drainage_density AS D,
         junction_count AS JN, source_factor AS SF, source_frequency AS SN, width_factor AS WF,
         relative_upstream_area AS RUA, symmetry_factor AS SIM FROM picked)"""

# peak time, peak flow, base time, break points and shape values per method, Tr = 1 h
METHOD_SQL = {
    "scs": """SELECT point_id, 'scs' AS method, A, 1.0 AS dt, tp, 0.2083 * A / tp AS qp, 5 * tp AS tb,
      tp AS e1, NULL AS e2, NULL AS e3, NULL AS s1, NULL AS s2 FROM (SELECT *, pow(L * Lc, 0.3) + 0.5 AS tp FROM inputs)""",
    "nakayasu": """SELECT point_id, 'nakayasu', A, 1.0, tg + 0.8, A / (3.6 * (0.3 * (tg + 0.8) + 2 * tg)), tg + 0.8 + 17 * tg,
      tg + 0.8, 3 * tg + 0.8, 6 * tg + 0.8, 2 * tg, NULL
      FROM (SELECT *, CASE WHEN L >= 15 THEN 0.5279 + 0.058 * L ELSE 0.21 * pow(L, 0.7) END AS tg FROM inputs)""",
    "snyder_alexeyev": """SELECT point_id, 'snyder_alexeyev', A, 1.0, tp, 0.275 * A / tp, 10 * tp, tp, NULL, NULL,
      1.32 * 0.99 * 0.99 + 0.15 * 0.99 + 0.045, NULL
      FROM (SELECT *, greatest(0.05, CASE WHEN lag / 5.5 > 1 THEN lag + 0.25 * (1 - lag / 5.5) ELSE lag + 0.5 END) AS tp
            FROM (SELECT *, pow(L * Lc, 0.3) AS lag FROM inputs))""",
    "gama1": """SELECT point_id, 'gama1', A, 1.0, tr, 0.1836 * pow(A, 0.5886) * pow(JN, 0.2381) * pow(tr, -0.4008), tbase,
      tr, greatest(tr, tbase - 1), NULL, 0.5617 * pow(A, 0.1798) * pow(S, -0.1446) * pow(SF, -1.0897) * pow(D, 0.0452),
      greatest(tr, tbase - 1)
      FROM (SELECT *, greatest(27.4132 * pow(tr, 0.1457) * pow(S, -0.0986) * pow(SN, 0.7344) * pow(RUA, 0.2574), tr + 0.05) AS tbase
            FROM (SELECT *, 0.43 * pow(L / (100 * SF), 3) + 1.0665 * SIM + 1.2775 AS tr FROM inputs WHERE SIM IS NOT NULL AND S IS NOT NULL))""",
    "limantara": """SELECT point_id, 'limantara', A, 1.0, tg + 0.8,
      0.042 * pow(A, 0.451) * pow(L, 0.497) * pow(Lc, 0.356) * pow(S, -0.131) * pow(0.05, 0.168), tg + 0.8 + 3 / 0.175,
      tg + 0.8, NULL, NULL, NULL, NULL
      FROM (SELECT *, CASE WHEN L >= 15 THEN 0.5279 + 0.058 * L ELSE 0.21 * pow(L, 0.7) END AS tg FROM inputs WHERE S IS NOT NULL)""",
    "itb1b": """SELECT point_id, 'itb1b', A, 1.0, tp, A / (3.6 * exp(3.7 + lgamma(4.7) - 4.7 * ln(3.7)) * tp), 10 * tp, tp, NULL, NULL,
      3.7, NULL FROM (SELECT *, 0.81225 * pow(L, 0.6) + 0.5 AS tp FROM inputs)""",
    "itb2b": """SELECT point_id, 'itb2b', A, 1.0, tp, A / (3.6 * (1 / 2.7 + 1 / 0.84) * tp), 10 * tp, tp, NULL, NULL, 1.7, 0.84
      FROM (SELECT *, 0.0394 * L + 0.201 * sqrt(L) + 0.5 AS tp FROM inputs)""",
}
_SCS = " ".join(
    f"WHEN x <= {hg.SCS_T[i]} THEN {hg.SCS_Q[i-1]} + (x - {hg.SCS_T[i-1]}) * ({hg.SCS_Q[i]} - {hg.SCS_Q[i-1]}) / ({hg.SCS_T[i]} - {hg.SCS_T[i-1]})"
    for i in range(1, len(hg.SCS_T)))
RATIO_SQL = {
    "scs": f"CASE {_SCS} ELSE 0 END",
    "nakayasu": """CASE WHEN t <= tp THEN pow(x, 2.4) WHEN t <= tp + s1 THEN pow(0.3, (t - tp) / s1)
      WHEN t <= tp + 2.5 * s1 THEN pow(0.3, (t - tp + 0.5 * s1) / (1.5 * s1)) ELSE pow(0.3, (t - tp + 1.5 * s1) / (2 * s1)) END""",
    "snyder_alexeyev": "CASE WHEN x > 0 THEN pow(10, -s1 * (1 - x) * (1 - x) / x) ELSE 0 END",
    "gama1": """CASE WHEN t = max(t) OVER (PARTITION BY point_id) THEN 0
      WHEN t >= s2 THEN (CASE WHEN s2 > tp THEN exp(-(s2 - tp) / s1) ELSE 1 END) * greatest(0, least(1, (tb - t) / greatest(tb - s2, 1e-9)))
      WHEN t <= tp THEN x ELSE exp(-(t - tp) / s1) END""",
    "limantara": "CASE WHEN t <= tp THEN pow(x, 1.107) ELSE pow(10, 0.175 * (tp - t)) END",
    "itb1b": "pow(x * exp(1 - x), s1)",
    "itb2b": "CASE WHEN x <= 1 THEN pow(x, s1) ELSE exp((1 - x) * s2) END",
}


def _curve_ctes(method: str) -> str:
    return f"""{INPUT_SQL}, par AS ({METHOD_SQL['scs']} LIMIT 0), par2 AS (SELECT * FROM par UNION ALL {METHOD_SQL[method]}),
grid AS (
  SELECT point_id, unnest(list_distinct(list_transform(
    list_concat(list_transform(range(CAST(ceil(tb / dt + 0.5) AS BIGINT)), lambda i: i * dt),
                list_filter([e1, e2, e3], lambda e: e > 0 AND e < tb), [tb]), lambda v: round(v, 10)))) AS t FROM par2),
pts AS (SELECT p.*, g.t, g.t / p.tp AS x FROM par2 p JOIN grid g USING (point_id)),
ordn AS (SELECT *, qp * ({RATIO_SQL[method]}) AS q FROM pts),
seg AS (SELECT *, (t - lag(t) OVER w) * 3600 * (q + lag(q) OVER w) / 2 AS piece, row_number() OVER w - 1 AS step
        FROM ordn WINDOW w AS (PARTITION BY point_id ORDER BY t)),
vol AS (SELECT point_id, sum(piece) AS volume_m3 FROM seg GROUP BY 1)"""


def _method_query(number: int, method: str):
    sql = _curve_ctes(method) + """
 SELECT point_id, method, CAST(step AS INTEGER) AS step, round(t, 6) AS t_h, round(t / tp, 6) AS t_over_tp,
        round(q / qp, 6) AS q_over_qp, round(q, 6) AS q, round(q * (A * 1000 / volume_m3), 6) AS q_norm
 FROM seg JOIN vol USING (point_id)"""

    @query(f"h{number}_{method}", sql)
    def run(spark, sf):
        inputs = hg.resolve_inputs(tb.catchments(spark, sf))
        return rounded(hg.ordinates(hg.hydrographs(inputs, methods=[method])), 6)


for _i, _m in enumerate(hg.METHODS, 1):
    _method_query(_i, _m)


def _all_methods_summary() -> str:
    parts = []
    for m in hg.METHODS:
        parts.append(f"""SELECT * FROM ({_curve_ctes(m)}
  SELECT point_id, method, round(tp, 6) AS tp_hours, round(qp, 6) AS qp_m3s, round(tb, 6) AS tb_hours,
         round(volume_m3, 3) AS volume_m3, round(volume_m3 / (A * 1000), 6) AS equivalent_mm,
         round((volume_m3 - A * 1000) / (A * 1000) * 100, 4) AS volume_error_pct,
         round(A * 1000 / volume_m3, 8) AS normalization_factor FROM par2 JOIN vol USING (point_id))""")
    return " UNION ALL ".join(parts)


@query("h11_volume_check", _all_methods_summary())
def h11(spark, sf):
    curves = hg.hydrographs(hg.resolve_inputs(tb.catchments(spark, sf))).filter("available")
    return curves.select(
        "point_id", "method", F.round("tp_hours", 6).alias("tp_hours"), F.round("qp_m3s", 6).alias("qp_m3s"),
        F.round("tb_hours", 6).alias("tb_hours"), F.round("volume_m3", 3).alias("volume_m3"),
        F.round("equivalent_mm", 6).alias("equivalent_mm"), F.round("volume_error_pct", 4).alias("volume_error_pct"),
        F.round("normalization_factor", 8).alias("normalization_factor"))


@query("h8_dispatch", INPUT_SQL + """, m AS (SELECT unnest(['scs','nakayasu','snyder_alexeyev','gama1','limantara','itb1b','itb2b']) AS method),
 ok AS (SELECT point_id, method, CASE method WHEN 'gama1' THEN S IS NOT NULL AND RUA IS NOT NULL AND SIM IS NOT NULL
          WHEN 'limantara' THEN S IS NOT NULL ELSE true END AS available FROM inputs, m)
 SELECT point_id, CAST(count(*) AS BIGINT) AS requested_methods, count(*) FILTER (available) AS available_methods FROM ok GROUP BY 1""")
def h8(spark, sf):
    curves = hg.hydrographs(hg.resolve_inputs(tb.catchments(spark, sf)))
    return curves.groupBy("point_id").agg(F.count("*").alias("requested_methods"), F.count_if("available").alias("available_methods"))


@query("h9_inputs", INPUT_SQL + " SELECT point_id, " + ", ".join(f"round({c}, 6) AS {c}" for c in hg.INPUTS) + " FROM inputs")
def h9(spark, sf):
    return rounded(hg.resolve_inputs(tb.catchments(spark, sf)), 6)


@query("h10_time_grid", f"""WITH {tb.CATCHMENTS_SQL}, g AS (
  SELECT point_id, list_sort(list_distinct(list_transform(list_concat(
    list_transform(range(CAST(ceil(flow_length_km / 0.5 + 0.5) AS BIGINT)), lambda i: i * 0.5),
    list_filter([main_lc_km], lambda e: e > 0 AND e < flow_length_km), [flow_length_km]), lambda v: round(v, 10)))) AS t FROM catchments)
 SELECT point_id, CAST(len(t) AS INTEGER) AS n, round(t[-1], 6) AS t_last, round(list_sum(t), 5) AS t_sum FROM g""")
def h10(spark, sf):
    df = tb.catchments(spark, sf)
    df = df.selectExpr("point_id", hg.time_grid_sql("flow_length_km", "0.5D", ["main_lc_km"]) + " AS t")
    return df.select("point_id", F.size("t").alias("n"), F.round(F.element_at("t", -1), 6).alias("t_last"),
                     F.round(F.aggregate("t", F.lit(0.0), lambda a, v: a + v), 5).alias("t_sum"))


@query("h12_required_inputs", INPUT_SQL + """
 SELECT point_id, 'gama1' AS method, S IS NOT NULL AND RUA IS NOT NULL AS available,
   concat_ws(',', CASE WHEN S IS NULL THEN 'S' END, CASE WHEN RUA IS NULL THEN 'RUA' END, CASE WHEN SIM IS NULL THEN 'SIM' END) AS missing_inputs FROM inputs
 UNION ALL SELECT point_id, 'limantara', S IS NOT NULL, CASE WHEN S IS NULL THEN 'S' ELSE '' END FROM inputs""")
def h12(spark, sf):
    return hg.availability(hg.hydrographs(hg.resolve_inputs(tb.catchments(spark, sf)), methods=["gama1", "limantara"]))


OVERRIDES = """overrides AS (SELECT 'P' || s_suppkey AS point_id, CASE WHEN s_suppkey % 4 = 0 THEN 2.5 * s_suppkey END AS A,
   CASE WHEN s_suppkey % 3 = 0 THEN 0.02 * s_suppkey - 0.5 END AS L1, CASE WHEN s_suppkey % 5 = 0 THEN 1.5 END AS S_pct,
   CASE WHEN s_suppkey % 2 = 0 THEN 4.25 END AS WU FROM supplier)"""


@query("p24_overrides", INPUT_SQL + f""", {OVERRIDES}, j AS (
   SELECT i.* REPLACE (CASE WHEN o.A >= 1e-9 THEN o.A ELSE i.A END AS A, CASE WHEN o.L1 >= 0 THEN o.L1 ELSE i.L1 END AS L1,
      coalesce(o.S_pct / 100, i.S) AS S, coalesce(o.WU, i.WU) AS WU) FROM inputs i LEFT JOIN overrides o USING (point_id)),
 r AS (SELECT * REPLACE (Lt / A AS D, L1 / Lt AS SF, N1 / N AS SN, WU / WL AS WF, coalesce(AU / A, RUA) AS RUA) FROM j)
 SELECT point_id, {", ".join(f"round({c}, 6) AS {c}" for c in hg.INPUTS if c != "SIM")}, round(coalesce(WF * RUA, SIM), 6) AS SIM FROM r""")
def p24(spark, sf):
    edits = table(spark, sf, "supplier").select(
        F.concat(F.lit("P"), "s_suppkey").alias("point_id"), F.expr("CASE WHEN s_suppkey % 4 = 0 THEN 2.5 * s_suppkey END").alias("A"),
        F.expr("CASE WHEN s_suppkey % 3 = 0 THEN 0.02 * s_suppkey - 0.5 END").alias("L1"),
        F.expr("CASE WHEN s_suppkey % 5 = 0 THEN 1.5 END").alias("S_pct"), F.expr("CASE WHEN s_suppkey % 2 = 0 THEN 4.25 END").alias("WU"))
    return rounded(hg.apply_overrides(hg.resolve_inputs(tb.catchments(spark, sf)), edits), 6)


# --- time of concentration --------------------------------------------------------------------

TC_SQL = f"""WITH {tb.CATCHMENTS_SQL}, base AS (
  SELECT point_id, area_km2 AS a, main_length_km AS l, main_slope_pct / 100 AS s, flow_length_km AS f, mean_slope_pct AS y,
         mean_height_m AS h, CASE WHEN cn BETWEEN 50 AND 95 THEN cn END AS cn,
         0.5 + s_suppkey % 3 AS v, s_suppkey % 2 = 0 AS has_v, s_suppkey FROM catchments),
 est AS (
  SELECT point_id, a, unnest([
    {{'method': 'kirpich', 'hours': 0.0195 * pow(l * 1000, 0.77) * pow(s, -0.385) / 60, 'inside': a <= 200, 'other': 'Kesesuaian terbatas'}},
    {{'method': 'scs_lag', 'hours': pow(f * 3280.84, 0.8) * pow(1000 / cn - 9, 0.7) / (1140 * sqrt(y)), 'inside': a <= 49, 'other': 'Kesesuaian terbatas'}},
    {{'method': 'nrcs_velocity', 'hours': NULL, 'inside': true, 'other': 'Kesesuaian terbatas'}},
    {{'method': 'giandotti', 'hours': (4 * sqrt(a) + 1.5 * f) / (0.8 * sqrt(h)), 'inside': a >= 170, 'other': 'Pembanding'}},
    {{'method': 'temez', 'hours': 0.3 * pow(l, 0.76) * pow(s, -0.19), 'inside': a <= 3000, 'other': 'Pembanding'}},
    {{'method': 'bransby_williams', 'hours': 0.605 * l / (pow(100 * s, 0.2) * pow(a, 0.1)), 'inside': a <= 137, 'other': 'Pembanding'}},
    {{'method': 'kerby', 'hours': 0.828 * pow((50 + s_suppkey) * 3.28084 * 0.4, 0.467) * pow(0.05, -0.235) / 60, 'inside': false, 'other': 'Pembanding'}},
    {{'method': 'izzard', 'hours': NULL, 'inside': false, 'other': 'Kesesuaian terbatas'}},
    {{'method': 'passini', 'hours': 0.108 * pow(a * l, 1.0 / 3) / sqrt(s), 'inside': false, 'other': 'Pembanding'}},
    {{'method': 'ventura_heras', 'hours': 0.127 * sqrt(a / s), 'inside': false, 'other': 'Pembanding'}},
    {{'method': 'johnstone_cross', 'hours': 0.4623 * sqrt(l) * pow(s, -0.25), 'inside': a BETWEEN 64.8 AND 4206.1, 'other': 'Pembanding'}},
    {{'method': 'viparelli', 'hours': CASE WHEN has_v THEN f / (3.6 * v) END, 'inside': false, 'other': 'Kesesuaian terbatas'}}]) AS m FROM base),
 methods AS (SELECT point_id, m.method AS method, m.hours AS hours,
    CASE WHEN m.hours IS NOT NULL AND m.inside THEN 'Utama' ELSE m.other END AS status FROM est),
 counted AS (SELECT *, count(*) FILTER (status = 'Utama' AND hours > 0) OVER (PARTITION BY point_id) AS n_main FROM methods),
 cand AS (SELECT * FROM counted WHERE hours > 0 AND (status = 'Utama' OR (n_main < 2 AND status = 'Pembanding'))),
 mid AS (SELECT *, median(hours) OVER (PARTITION BY point_id) AS center FROM cand),
 kept AS (SELECT * FROM mid WHERE hours BETWEEN 0.5 * center AND 2 * center)"""


def _tc(spark, sf):
    df = tb.catchments(spark, sf).select(
        "point_id", "area_km2", F.col("main_length_km").alias("channel_length_km"), F.col("main_slope_pct").alias("channel_slope_pct"),
        "flow_length_km", F.col("mean_slope_pct").alias("basin_slope_pct"), "mean_height_m", "cn",
        (50.0 + F.col("s_suppkey")).alias("kerby_length_m"), F.lit(5.0).alias("kerby_slope_pct"), F.lit(0.4).alias("kerby_n"),
        F.expr("CASE WHEN s_suppkey % 2 = 0 THEN 0.5 + s_suppkey % 3 END").alias("viparelli_velocity_mps"))
    return tc.time_of_concentration(df)


@query("x1_tc_estimators", TC_SQL + " SELECT point_id, method, round(hours, 6) AS hours FROM methods")
def x1(spark, sf):
    return tc.method_rows(_tc(spark, sf)).select("point_id", "method", F.round("hours", 6).alias("hours"))


@query("x2_tc_status", TC_SQL + """ SELECT point_id, method, status, (point_id, method) IN (SELECT (point_id, method) FROM kept) AS used_for_recommendation FROM methods""")
def x2(spark, sf):
    return tc.method_rows(_tc(spark, sf)).select("point_id", "method", "status", "used_for_recommendation")


@query("x3_tc_recommendation", TC_SQL + """
 SELECT point_id, round(median(hours), 6) AS recommended_hours, count(*) AS used,
   CASE WHEN count(*) >= 3 AND max(hours) / min(hours) <= 1.35 THEN 'Tinggi'
        WHEN count(*) >= 2 AND max(hours) / min(hours) <= 2 THEN 'Sedang' ELSE 'Rendah' END AS agreement FROM kept GROUP BY 1""")
def x3(spark, sf):
    return _tc(spark, sf).select("point_id", F.round("recommended_hours", 6).alias("recommended_hours"),
                                 F.size("used_methods").cast("long").alias("used"), "agreement")


# --- morphometry ----------------------------------------------------------------------------------

@query("z11_morphometry", f"""WITH {tb.CATCHMENTS_SQL}, m AS (
  SELECT point_id, flow_length_km AS basin_length_km, area_km2 / pow(flow_length_km, 2) AS form_factor,
         4 * pi() * area_km2 / pow(perimeter_km, 2) AS circularity, 2 * sqrt(area_km2 / pi()) / flow_length_km AS elongation,
         relief_m / (flow_length_km * 1000) AS relief_ratio FROM catchments)
 SELECT point_id, round(basin_length_km, 6) AS basin_length_km, round(form_factor, 6) AS form_factor, round(circularity, 6) AS circularity,
        round(elongation, 6) AS elongation, round(relief_ratio, 6) AS relief_ratio,
        CASE WHEN form_factor < 0.3 THEN 'Sangat memanjang' WHEN form_factor < 0.5 THEN 'Memanjang' WHEN form_factor < 0.75 THEN 'Agak kompak' ELSE 'Kompak' END AS shape_class,
        CASE WHEN elongation < 0.5 THEN 'Sangat memanjang' WHEN elongation < 0.7 THEN 'Memanjang' WHEN elongation < 0.8 THEN 'Agak memanjang'
             WHEN elongation < 0.9 THEN 'Oval' ELSE 'Mendekati membulat' END AS elongation_class FROM m""")
def z11(spark, sf):
    df = mo.shape_ratios(tb.catchments(spark, sf)).select(
        "point_id", "basin_length_km", "form_factor", "circularity", "elongation", "relief_ratio", "shape_class", "elongation_class")
    return rounded(df, 6)


@query("z12_response_class", f"""WITH {tb.CATCHMENTS_SQL}, v AS (
  SELECT point_id, mean_slope_pct, drainage_density, list_filter([CASE WHEN area_km2 / pow(flow_length_km, 2) >= 0.5 THEN 1 ELSE -1 END,
     CASE WHEN drainage_density >= 2 THEN 1 ELSE -1 END, CASE WHEN mean_slope_pct >= 15 THEN 1 ELSE -1 END,
     CASE WHEN cn >= 80 THEN 1 WHEN cn IS NOT NULL THEN -1 END], lambda x: x IS NOT NULL) AS votes FROM catchments),
 s AS (SELECT *, list_sum(votes) / len(votes) AS sc FROM v)
 SELECT point_id, CAST(len(votes) AS INTEGER) AS response_factor_count, round(sc, 6) AS response_score,
   CASE WHEN sc >= 0.75 THEN 'Cepat' WHEN sc >= 0.25 THEN 'Sedang–Cepat' WHEN sc > -0.25 THEN 'Sedang' WHEN sc > -0.75 THEN 'Lambat–Sedang' ELSE 'Lambat' END AS response_class,
   CASE WHEN mean_slope_pct < 8 THEN 'Datar' WHEN mean_slope_pct < 15 THEN 'Landai' WHEN mean_slope_pct < 25 THEN 'Agak curam' WHEN mean_slope_pct < 40 THEN 'Curam' ELSE 'Sangat curam' END AS slope_class,
   CASE WHEN drainage_density < 1 THEN 'Rendah' WHEN drainage_density < 2 THEN 'Sedang' WHEN drainage_density < 3.5 THEN 'Tinggi' ELSE 'Sangat tinggi' END AS density_class FROM s""")
def z12(spark, sf):
    df = mo.response_class(mo.shape_ratios(tb.catchments(spark, sf)))
    return rounded(df.select("point_id", "response_factor_count", "response_score", "response_class", "slope_class", "density_class"), 6)


@query("z16_channel_guard", f"""WITH {tb.CATCHMENTS_SQL}, r AS (
  SELECT *, concat_ws(',', CASE WHEN main_lc_km > main_length_km + greatest(0.01, main_length_km * 1e-4) THEN 'lc_longer_than_length' END,
     CASE WHEN main_slope_pct IS NULL THEN 'slope_missing_or_zero' END) AS reasons FROM catchments)
 SELECT point_id, reasons, CASE WHEN reasons <> '' THEN round(flow_length_km, 6) END AS fallback_length_km,
   CASE WHEN reasons <> '' THEN round(flow_lc_km, 6) END AS fallback_lc_km, CASE WHEN reasons <> '' THEN round(flow_slope_pct, 6) END AS fallback_slope_pct FROM r""")
def z16(spark, sf):
    df = mo.channel_guard(tb.catchments(spark, sf))
    return rounded(df.select("point_id", F.array_join("channel_reasons", ",").alias("reasons"), "fallback_length_km",
                             "fallback_lc_km", "fallback_slope_pct"), 6)


def _with_tc(spark, sf):
    base = mo.shape_ratios(tb.catchments(spark, sf))
    hours = _tc(spark, sf).select("point_id", F.col("recommended_hours").alias("tc_hours"))
    return base.join(hours, "point_id", "left").withColumns({"built_up_pct": F.lit(None).cast("double"), "stream_order_max": F.col("stream_count") % 6 + 1})


@query("z17_key_indicators", TC_SQL + f""", tch AS (SELECT point_id, median(hours) AS tc_hours FROM kept GROUP BY 1),
 j AS (SELECT * FROM catchments LEFT JOIN tch USING (point_id))
 SELECT point_id, CAST(x.position AS INTEGER) AS position, x.label AS label, round(x.value, 6) AS value, x.unit AS unit FROM (
  SELECT point_id, unnest([{", ".join("{'position': %d, 'label': '%s', 'value': %s, 'unit': '%s'}" % (
     i, lab, {"form_factor": "area_km2 / pow(flow_length_km, 2)", "built_up_pct": "NULL", "stream_order_max": "stream_count % 6 + 1"}.get(c, c), u)
     for i, (lab, c, u) in enumerate(mo.KEY_INDICATORS, 1))}]) AS x FROM j)""")
def z17(spark, sf):
    return rounded(mo.key_indicators(_with_tc(spark, sf)), 6)
