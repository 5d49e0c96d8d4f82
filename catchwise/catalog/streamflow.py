"""Queries over rainfall, climate, discharge and streamflow models."""

from pyspark.sql import functions as F

from catchwise.catalog.base import query, table
from catchwise.functions.calendar import depth_from_discharge, discharge_from_depth, halfmonth_days, period, period_start
from catchwise.functions.numeric import rounded
from catchwise.operators import climate as cl
from catchwise.operators import learning as ml
from catchwise.operators import soil as so
from catchwise.operators import stats as st
from catchwise.operators import transfer as tr
from catchwise.operators import water_balance as wb
from catchwise.runtime import cut
from catchwise.sources import climate as sc
from catchwise.sources import discharge as sd
from catchwise.sources import testbed as tb

D = tb.DISCHARGE_SQL
DAYS = tb.DAYS_SQL.format(p="period", y="year")


# --- ingest ------------------------------------------------------------------------------------

def _wide(spark, sf):
    q = tb.discharge(spark, sf)
    v = F.expr("transform(sequence(0, 23), i -> m[i])")
    wide = q.groupBy("gauge", "year").agg(F.map_from_entries(F.collect_list(F.struct("period", "q"))).alias("m")).select("gauge", "year", v.alias("v"))
    return wide.withColumn("v", F.expr("""transform(v, (x, i) -> CASE WHEN gauge = 'G1' AND year = 1996 AND i = 3 THEN -1.0D
        WHEN gauge = 'G2' AND year = 1997 AND i = 5 THEN NULL ELSE x END)"""))


WIDE = f"""WITH {D}, w AS (SELECT gauge, year, period, CASE WHEN gauge = 'G1' AND year = 1996 AND period = 3 THEN -1.0
   WHEN gauge = 'G2' AND year = 1997 AND period = 5 THEN NULL ELSE q END AS q FROM discharge),
 bad AS (SELECT gauge, year, CASE WHEN bool_or(q < 0) THEN 'value_invalid' ELSE 'value_missing' END AS reason FROM w
   GROUP BY 1, 2 HAVING bool_or(q < 0) OR bool_or(q IS NULL))"""


@query("a4_ingest_discharge", WIDE + " SELECT gauge, year, period, q FROM w WHERE (gauge, year) NOT IN (SELECT (gauge, year) FROM bad)")
def a4(spark, sf):
    ok, _ = sd.ingest_discharge(_wide(spark, sf))
    return ok


@query("a4_rejected", WIDE + " SELECT * FROM bad")
def a4_rejected(spark, sf):
    _, bad = sd.ingest_discharge(_wide(spark, sf))
    return bad.select("gauge", "year", "reason")


@query("z27_upload_stats", WIDE + """ SELECT gauge, count(DISTINCT year) AS years, count(CASE WHEN q >= 0 THEN q END) AS observed,
  count(DISTINCT year) * 24 - count(CASE WHEN q >= 0 THEN q END) AS missing_count FROM w
  WHERE (gauge, year) NOT IN (SELECT (gauge, year) FROM bad WHERE reason = 'value_invalid') GROUP BY 1""")
def z27(spark, sf):
    ok, _ = sd.ingest_discharge(_wide(spark, sf), allow_missing=True)
    return sd.upload_statistics(ok)


@query("a7_halfmonth_bands", """SELECT band, period_start, reason FROM (
  SELECT o_orderkey AS band, CAST(o_orderdate AS DATE) AS period_start,
    CASE WHEN day(o_orderdate) NOT IN (1, 16) THEN 'day_not_1_or_16'
         WHEN lag(CAST(o_orderdate AS DATE)) OVER (ORDER BY o_orderkey) >= CAST(o_orderdate AS DATE) THEN 'not_ascending' END AS reason FROM orders)
 WHERE reason IS NOT NULL""")
def a7(spark, sf):
    return sc.read_halfmonth_rain(table(spark, sf, "orders").select(F.col("o_orderkey").alias("band"), F.to_date("o_orderdate").alias("period_start")))


@query("a8_daily_gaps", """SELECT date, gap_days, n FROM (
  SELECT date, CAST(coalesce(date - lag(date) OVER (ORDER BY date), 1) AS INTEGER) AS gap_days, n FROM (
    SELECT CAST(o_orderdate AS DATE) AS date, count(*) AS n FROM orders GROUP BY 1)) WHERE gap_days <> 1 OR n > 1""")
def a8(spark, sf):
    return sc.daily_gaps(table(spark, sf, "orders").select(F.to_date("o_orderdate").alias("date")))


@query("a8_daily_rain", f"WITH {tb.RAIN_SQL} SELECT date, cell, round(mm, 6) AS mm FROM rain_daily")
def a8_rain(spark, sf):
    return rounded(sc.read_daily_rain(tb.rain_daily(spark, sf)), 6)


@query("a9_et0_problems", f"""WITH {tb.RAIN_SQL}, have AS (
   SELECT DISTINCT l_suppkey % 8 AS cell, CAST(l_shipdate AS DATE) AS date FROM lineitem),
 want AS (SELECT c.cell, s.date FROM rcells c, spine s)
 SELECT 'C' || w.cell AS point_id, w.date, CASE WHEN h.cell IS NULL THEN 'missing' ELSE 'negative' END AS reason
 FROM want w LEFT JOIN have h ON h.cell = w.cell AND h.date = w.date WHERE h.cell IS NULL OR dayofyear(w.date) % 29 = 0""")
def a9(spark, sf):
    d = F.to_date("l_shipdate")
    cell = F.concat(F.lit("C"), F.col("l_suppkey") % 8)
    et0 = table(spark, sf, "lineitem").select(cell.alias("point_id"), d.alias("date")).distinct().withColumn(
        "et0_mm", F.when(F.dayofyear("date") % 29 == 0, -1.0).otherwise(3.0))
    cells = table(spark, sf, "supplier").select(F.concat(F.lit("C"), F.col("s_suppkey") % 8).alias("point_id")).distinct()
    span = cells.join(F.broadcast(tb._span(spark, sf).select(F.col("lo").alias("start"), F.col("hi").alias("end"))))
    return sc.et0_problems(et0, span)


# --- calendar and depth ----------------------------------------------------------------------------

@query("p18_halfmonth_days", f"WITH {D} SELECT gauge, year, period, {DAYS} AS days FROM discharge")
def p18(spark, sf):
    return tb.discharge(spark, sf).select("gauge", "year", "period", halfmonth_days(F.col("year"), F.col("period")).alias("days"))


@query("p19_period_key", f"""SELECT o_orderkey, {tb.PERIOD_SQL.format(d='o_orderdate')} AS period,
  make_date(year(o_orderdate), month(o_orderdate), CASE WHEN day(o_orderdate) >= 16 THEN 16 ELSE 1 END) AS start FROM orders""")
def p19(spark, sf):
    d = F.to_date("o_orderdate")
    return table(spark, sf, "orders").select("o_orderkey", period(d).alias("period"), period_start(F.year(d), period(d)).alias("start"))


@query("p20_depth_discharge", f"""WITH {D}, {tb.TRANSFER_SQL} SELECT gauge, year, period, round(q * {DAYS} * 86400 / (area_km2 * 1000), 6) AS depth_mm, round(q, 8) AS q_back
 FROM discharge JOIN donors USING (gauge)""")
def p20(spark, sf):
    days = halfmonth_days(F.col("year"), F.col("period"))
    df = tb.discharge(spark, sf).join(F.broadcast(tb.donors(spark, sf)), "gauge")
    depth = depth_from_discharge(F.col("q"), F.col("area_km2"), days)
    return df.select("gauge", "year", "period", F.round(depth, 6).alias("depth_mm"), F.round(discharge_from_depth(depth, F.col("area_km2"), days), 8).alias("q_back"))


# --- rainfall ---------------------------------------------------------------------------------------

AREAL = f"""WITH {tb.RAIN_SQL}, {tb.WEIGHTS_SQL}, hm AS (
  SELECT cell, CAST(year(date) AS INTEGER) AS year, {tb.PERIOD_SQL.format(d='date')} AS period, count(*) AS n, sum(mm) AS mm FROM rain_daily GROUP BY 1, 2, 3),
 cells_hm AS (SELECT cell, year, period, CASE WHEN n = {DAYS} THEN mm END AS mm FROM hm)"""


@query("z21_halfmonth_cells", AREAL + " SELECT cell, year, period, round(mm, 6) AS mm FROM cells_hm")
def z21(spark, sf):
    return rounded(cl.halfmonth_cells(tb.rain_daily(spark, sf)), 6)


@query("z18_areal_rain", AREAL + """ SELECT w.point_id, year, period, round(sum(w * mm) / sum(CASE WHEN mm IS NOT NULL THEN w END), 6) AS mm,
   round(least(1, coalesce(sum(CASE WHEN mm IS NOT NULL THEN w END), 0) / any_value(area)), 6) AS coverage, count(*) FILTER (mm < 0) AS invalid_cells
 FROM cells_hm JOIN weights w USING (cell) JOIN areas USING (point_id) GROUP BY 1, 2, 3""")
def z18(spark, sf):
    weights, areas = tb.rain_weights(spark, sf)
    return rounded(cl.areal_rain(cl.halfmonth_cells(tb.rain_daily(spark, sf)), weights, areas, ["year", "period"]), 6)


@query("z18_annual_mean", AREAL + """, a AS (SELECT point_id, year, period, sum(w * mm) / sum(w) AS mm, sum(w) / any_value(area) AS cov
   FROM cells_hm JOIN weights USING (cell) JOIN areas USING (point_id) WHERE mm IS NOT NULL GROUP BY 1, 2, 3)
 SELECT point_id, round(min(cov), 6) AS coverage_min, round(sum(mm) / count(DISTINCT year), 5) AS mean_annual_mm FROM a WHERE cov >= 0.95 GROUP BY 1""")
def z18_annual(spark, sf):
    weights, areas = tb.rain_weights(spark, sf)
    ok, _ = cl.split_coverage(cl.areal_rain(cl.halfmonth_cells(tb.rain_daily(spark, sf)), weights, areas, ["year", "period"]))
    out = cl.annual_mean(ok)
    return out.select("point_id", F.round("coverage_min", 6).alias("coverage_min"), F.round("mean_annual_mm", 5).alias("mean_annual_mm"))


@query("z19_trim_tail", """WITH d AS (
   SELECT 'C' || (o_custkey % 20) AS point_id, CAST(o_orderdate AS DATE) AS date, max(CASE WHEN month(o_orderdate) = 12 THEN 0 WHEN o_orderkey % 50 = 0 THEN 0.5 ELSE 1 END) AS coverage
   FROM orders GROUP BY 1, 2), l AS (SELECT point_id, max(date) AS last FROM d WHERE coverage >= 0.95 GROUP BY 1)
 SELECT point_id, date, CAST(coverage AS DOUBLE) AS coverage, CASE WHEN last IS NOT NULL AND date <= last THEN CASE WHEN coverage >= 0.95 THEN 'kept' ELSE 'error_inner_gap' END
   WHEN coverage > 0 THEN 'error_partial_tail' ELSE 'trimmed' END AS tail_status FROM d LEFT JOIN l USING (point_id)""")
def z19(spark, sf):
    cov = F.when(F.month("o_orderdate") == 12, 0.0).when(F.col("o_orderkey") % 50 == 0, 0.5).otherwise(1.0)
    daily = table(spark, sf, "orders").groupBy(F.concat(F.lit("C"), F.col("o_custkey") % 20).alias("point_id"), F.to_date("o_orderdate").alias("date")).agg(F.max(cov).alias("coverage"))
    return cl.trim_tail(daily)


@query("z20_halfmonth_climate", f"""WITH {tb.CLIMATE_SQL} SELECT point_id, year, period, start, days, round(p_mm, 6) AS p_mm, round(et0_mm, 6) AS et0_mm, wet_days FROM climate""")
def z20(spark, sf):
    return rounded(tb.climate(spark, sf), 6)


def _grid(spark, sf):
    c = F.col("cell")
    return tb.rain_daily(spark, sf).select("date", (c - c % 4).alias("_r"), "cell", "mm").select(
        "date", (F.col("_r") / 4).cast("int").alias("row"), (c % 4).cast("int").alias("col"), "mm", (-7.0 - F.col("_r") * 5).alias("lat"))


@query("z22_top_cells", f"""WITH {tb.RAIN_SQL}, g AS (SELECT date, CAST(cell // 4 AS INTEGER) AS row, CAST(cell % 4 AS INTEGER) AS col, mm FROM rain_daily)
 SELECT date, row, col, mm, row IN (SELECT min(row) FROM g UNION SELECT max(row) FROM g) OR col IN (SELECT min(col) FROM g UNION SELECT max(col) FROM g) AS on_edge
 FROM g ORDER BY mm DESC, date, row, col LIMIT 30""")
def z22(spark, sf):
    return cl.top_cells(_grid(spark, sf))


@query("z22_domain_means", f"""WITH {tb.RAIN_SQL}, g AS (SELECT date, mm, cos(radians(-7.0 - (cell // 4) * 20)) AS w FROM rain_daily)
 SELECT date, round(sum(w * mm) / sum(w), 6) AS mean_mm, count(mm) AS valid_cells, count(*) AS cells FROM g GROUP BY 1 ORDER BY sum(w * mm) / sum(w) DESC, date LIMIT 30""")
def z22_means(spark, sf):
    return rounded(cl.top_domain_means(_grid(spark, sf)), 6)


# --- series statistics ------------------------------------------------------------------------------

def _stats_sql(group: str, src: str) -> str:
    def exc(e):
        p = 1 - e / 100
        return f"""CASE WHEN ({p} * (n + 1)) >= 1 - 1e-12 AND ({p} * (n + 1)) <= n + 1e-12 THEN
          round(v[CAST(floor(least(greatest({p} * (n + 1), 1), n)) AS BIGINT)] + (least(greatest({p} * (n + 1), 1), n) - floor(least(greatest({p} * (n + 1), 1), n))) *
          (coalesce(v[CAST(floor(least(greatest({p} * (n + 1), 1), n)) AS BIGINT) + 1], v[n]) - v[CAST(floor(least(greatest({p} * (n + 1), 1), n)) AS BIGINT)]), 6) END AS q{e}"""
    return f"""SELECT {group}, n AS count, zero_count, round(mn, 6) AS min, round(mx, 6) AS max, round(mean, 6) AS mean, round(med, 6) AS median, round(std, 6) AS std,
      CASE WHEN mean > 0 THEN round(std / mean, 6) END AS cv, {", ".join(exc(e) for e in st.EXCEEDANCES)}
      FROM (SELECT {group}, count(q) AS n, count(*) FILTER (q = 0) AS zero_count, min(q) AS mn, max(q) AS mx, avg(q) AS mean, median(q) AS med, stddev_samp(q) AS std,
                   list_sort(list(q)) AS v FROM {src} GROUP BY {group})"""


@query("z23_series_stats", f"WITH {D} {_stats_sql('gauge', 'discharge')}")
def z23(spark, sf):
    return rounded(st.series_stats(tb.discharge(spark, sf), ["gauge"]), 6)


@query("z25_period_stats", f"WITH {D} {_stats_sql('gauge, period', 'discharge')}")
def z25(spark, sf):
    return rounded(st.period_stats(tb.discharge(spark, sf), "gauge"), 6)


@query("z24_percentile_exc", """WITH s AS (SELECT o_custkey % 10 AS grp, list_sort(list(o_totalprice)) AS v, count(*) AS n FROM orders GROUP BY 1),
  e AS (SELECT *, unnest([0.05, 0.5, 0.9]) AS prob FROM s), r AS (SELECT *, (n + 1) * prob AS rk FROM e)
 SELECT grp, CAST(prob AS DOUBLE) AS prob, CASE WHEN rk BETWEEN 1 AND n THEN round(v[CAST(floor(rk) AS BIGINT)] + (rk - floor(rk)) * (coalesce(v[CAST(floor(rk) AS BIGINT) + 1], 0) - v[CAST(floor(rk) AS BIGINT)]), 5) END AS q FROM r""")
def z24(spark, sf):
    from catchwise.operators.ordered import quantiles

    df = table(spark, sf, "orders").select((F.col("o_custkey") % 10).alias("grp"), "o_totalprice")
    return quantiles(df, ["grp"], "o_totalprice", [0.05, 0.5, 0.9], weibull=True).withColumn("q", F.round("q", 5))


@query("z26_volume", f"WITH {D} SELECT gauge, round(sum(q * {DAYS} * 86400), 2) AS volume_m3 FROM discharge GROUP BY 1")
def z26(spark, sf):
    return rounded(st.volume(tb.discharge(spark, sf), "gauge"), 2)


@query("p23_year_ranges", """WITH y AS (SELECT DISTINCT o_custkey AS gauge, CAST(year(o_orderdate) AS INTEGER) AS year FROM orders),
  i AS (SELECT *, year - row_number() OVER (PARTITION BY gauge ORDER BY year) AS g FROM y),
  r AS (SELECT gauge, min(year) AS a, max(year) AS b FROM i GROUP BY gauge, g)
 SELECT gauge, string_agg(CASE WHEN a = b THEN CAST(a AS VARCHAR) ELSE a || '–' || b END, ', ' ORDER BY a) AS years FROM r GROUP BY 1""")
def p23(spark, sf):
    df = table(spark, sf, "orders").select(F.col("o_custkey").alias("gauge"), F.year("o_orderdate").alias("year"))
    return st.year_ranges(df, "gauge")


METRICS = """count(*) AS count, round(sqrt(avg((p - o) * (p - o))), 6) AS rmse, round(avg(p - o), 6) AS bias, round(1 - avg((p - o) * (p - o)) / var_pop(o), 6) AS nse,
 round(1 - sqrt(pow(corr(o, p) - 1, 2) + pow(stddev_pop(p) / stddev_pop(o) - 1, 2) + pow(avg(p) / avg(o) - 1, 2)), 6) AS kge, round(100 * (avg(p) - avg(o)) / avg(o), 6) AS pbias_pct"""


@query("z28_fit_metrics", f"WITH {D}, j AS (SELECT a.gauge, a.q AS o, b.q * 1.1 AS p FROM discharge a JOIN discharge b ON b.gauge = a.gauge AND b.period = a.period AND b.year = a.year + 1) SELECT gauge, {METRICS} FROM j GROUP BY 1")
def z28(spark, sf):
    q = tb.discharge(spark, sf)
    nxt = q.select("gauge", (F.col("year") - 1).alias("year"), "period", (F.col("q") * 1.1).alias("predicted"))
    pairs = q.withColumnRenamed("q", "observed").join(nxt, ["gauge", "year", "period"])
    return rounded(st.fit_metrics(pairs, ["gauge"]), 6)


# --- area-ratio model ---------------------------------------------------------------------------------

T = f"WITH {D}, {tb.TRANSFER_SQL}, cy AS (SELECT donor_set, year FROM (SELECT DISTINCT gauge, year FROM discharge) JOIN donors USING (gauge) GROUP BY 1, 2 HAVING count(*) = (SELECT count(*) FROM donors d2 WHERE d2.donor_set = donors.donor_set))"
T = T.replace("(SELECT count(*) FROM donors d2 WHERE d2.donor_set = donors.donor_set)", "any_value(nd)").replace(
    "JOIN donors USING (gauge)", "JOIN (SELECT *, count(*) OVER (PARTITION BY donor_set) AS nd FROM donors) USING (gauge)", 1)


@query("m4_common_years", T + " SELECT donor_set, year FROM cy")
def m4(spark, sf):
    return tr.common_years(tb.discharge(spark, sf), tb.donors(spark, sf))


@query("m3_transfer", T + """ SELECT t.point_id, q.year, q.period, round(avg(q.q * pow(t.area_km2 / d.area_km2, 0.9)), 6) AS q,
   round(min(q.q * pow(t.area_km2 / d.area_km2, 0.9)), 6) AS q_min, round(max(q.q * pow(t.area_km2 / d.area_km2, 0.9)), 6) AS q_max
 FROM targets t JOIN donors d USING (donor_set) JOIN discharge q USING (gauge) JOIN cy ON cy.donor_set = t.donor_set AND cy.year = q.year GROUP BY 1, 2, 3""")
def m3(spark, sf):
    return rounded(tr.transfer(tb.discharge(spark, sf), tb.donors(spark, sf), tb.targets(spark, sf), 0.9), 6)


W_SQL = f"""{T}, {tb.SHARES_SQL}, dshare AS (SELECT d.gauge, d.donor_set, s.class, s.fraction FROM donors d JOIN shares s ON s.point_id = 'P' || substr(d.gauge, 2) WHERE s.layer = 'aquifer'),
 tshare AS (SELECT t.point_id, t.donor_set, s.class, s.fraction FROM targets t JOIN shares s USING (point_id) WHERE s.layer = 'aquifer'),
 pr AS (SELECT t.point_id, d.gauge, t.donor_set FROM targets t JOIN donors d USING (donor_set)),
 cls AS (SELECT DISTINCT class FROM shares WHERE layer = 'aquifer'),
 dist AS (SELECT p.point_id, p.gauge, sum(abs(coalesce(a.fraction, 0) - coalesce(b.fraction, 0))) / 2 AS d FROM pr p CROSS JOIN cls
    LEFT JOIN tshare a ON a.point_id = p.point_id AND a.class = cls.class LEFT JOIN dshare b ON b.gauge = p.gauge AND b.class = cls.class GROUP BY 1, 2),
 terr AS (SELECT t.point_id, d.gauge, (least(abs((50 + 7 * (CAST(substr(t.point_id, 2) AS BIGINT) % 60)) - (50 + 7 * (CAST(substr(d.gauge, 2) AS BIGINT) % 60))) / 1000.0, 1)
     + least(abs((3 + CAST(substr(t.point_id, 2) AS BIGINT) % 30) - (3 + CAST(substr(d.gauge, 2) AS BIGINT) % 30)) / 100.0, 1)) / 2 AS d FROM targets t JOIN donors d USING (donor_set))"""


def _distances(spark, sf):
    targets, donors = tb.targets(spark, sf), tb.donors(spark, sf)
    shares = tb.class_shares(spark, sf).filter("layer = 'aquifer'").select("point_id", "class", "fraction")
    gauge_shares = shares.withColumn("point_id", F.concat(F.lit("G"), F.expr("substring(point_id, 2)")))
    known = donors.select(F.col("gauge").alias("point_id"))
    both = shares.unionByName(gauge_shares.join(known, "point_id", "left_semi"))
    k = F.expr("CAST(substring(point_id, 2) AS BIGINT)")
    feats = targets.select("point_id").unionByName(donors.select(F.col("gauge").alias("point_id"))).select(
        "point_id", F.array((50 + 7 * (k % 60)).cast("double"), (3 + k % 30).cast("double")).alias("x"))
    return targets, donors, both, feats


@query("m1_class_distance", W_SQL + " SELECT point_id, gauge, round(d, 6) AS d FROM dist")
def m1(spark, sf):
    targets, donors, both, _ = _distances(spark, sf)
    return rounded(tr.class_distance(targets, donors, both), 6)


@query("m1_terrain_distance", W_SQL + " SELECT point_id, gauge, round(d, 6) AS d FROM terr")
def m1_terrain(spark, sf):
    targets, donors, _, feats = _distances(spark, sf)
    return rounded(tr.vector_distance(targets, donors, feats, "terrain"), 6)


@query("m1_rain_distance", AREAL + f""", {tb.TRANSFER_SQL}, pt AS (SELECT point_id, year, period, sum(w * mm) / sum(w) AS mm FROM cells_hm JOIN weights USING (cell) WHERE mm IS NOT NULL GROUP BY 1, 2, 3)
 SELECT t.point_id, d.gauge, round(sum(abs(a.mm - b.mm)) / sum(a.mm + b.mm), 6) AS d FROM targets t JOIN donors d USING (donor_set)
 JOIN pt a ON a.point_id = t.point_id JOIN pt b ON b.point_id = 'P' || substr(d.gauge, 2) AND b.year = a.year AND b.period = a.period GROUP BY 1, 2""")
def m1_rain(spark, sf):
    weights, areas = tb.rain_weights(spark, sf)
    rain = cl.areal_rain(cl.halfmonth_cells(tb.rain_daily(spark, sf)), weights, areas, ["year", "period"]).filter("mm is not null").select("point_id", "year", "period", "mm")
    targets, donors = tb.targets(spark, sf), tb.donors(spark, sf)
    mine = rain.withColumn("point_id", F.concat(F.lit("G"), F.expr("substring(point_id, 2)"))).join(donors.select(F.col("gauge").alias("point_id")), "point_id", "left_semi")
    return rounded(tr.rain_distance(targets, donors, rain.unionByName(mine)), 6)


WEIGHT_SQL = W_SQL + """, e AS (SELECT point_id, gauge, (dist.d + terr.d) / 2 AS distance, exp(-(dist.d + terr.d) / 2) AS x FROM dist JOIN terr USING (point_id, gauge)),
 wt AS (SELECT point_id, gauge, distance, x / sum(x) OVER (PARTITION BY point_id) AS weight FROM e)"""


def _weights(spark, sf):
    targets, donors, both, feats = _distances(spark, sf)
    return tr.donor_weights([tr.class_distance(targets, donors, both), tr.vector_distance(targets, donors, feats, "terrain")])


@query("m2_donor_weights", WEIGHT_SQL + " SELECT point_id, gauge, round(distance, 6) AS distance, round(weight, 6) AS weight FROM wt")
def m2(spark, sf):
    return rounded(_weights(spark, sf), 6)


@query("m3_weighted_transfer", WEIGHT_SQL + """ SELECT t.point_id, q.year, q.period, round(sum(wt.weight * q.q * pow(t.area_km2 / d.area_km2, 0.9)), 6) AS q,
   round(min(q.q * pow(t.area_km2 / d.area_km2, 0.9)), 6) AS q_min, round(max(q.q * pow(t.area_km2 / d.area_km2, 0.9)), 6) AS q_max
 FROM targets t JOIN wt USING (point_id) JOIN donors d USING (gauge) JOIN discharge q USING (gauge) JOIN cy ON cy.donor_set = t.donor_set AND cy.year = q.year GROUP BY 1, 2, 3""")
def m3w(spark, sf):
    return rounded(tr.transfer(tb.discharge(spark, sf), tb.donors(spark, sf), tb.targets(spark, sf), 0.9, _weights(spark, sf)), 6)


@query("c13_pairs", T + " SELECT point_id, gauge, round(t.area_km2 / d.area_km2, 6) AS area_ratio FROM targets t JOIN donors d USING (donor_set)")
def c13(spark, sf):
    return rounded(tr.pairs_with_distance(tb.targets(spark, sf), tb.donors(spark, sf)), 6)


@query("m5_leave_one_out", T + """, pr AS (SELECT h.gauge, q.year, q.period, q.q AS o, (SELECT 0) AS z, h.area_km2, h.donor_set FROM donors h JOIN discharge q USING (gauge) JOIN cy ON cy.donor_set = h.donor_set AND cy.year = q.year),
  pred AS (SELECT p.gauge, p.year, p.period, any_value(p.o) AS o, avg(q.q * p.area_km2 / d.area_km2) AS p FROM pr p JOIN donors d ON d.donor_set = p.donor_set AND d.gauge <> p.gauge
     JOIN discharge q ON q.gauge = d.gauge AND q.year = p.year AND q.period = p.period GROUP BY 1, 2, 3),
  a AS (SELECT gauge, quantile_cont(o, 0.5) AS oq, quantile_cont(p, 0.5) AS pq, sqrt(avg((p - o) * (p - o))) AS rmse, avg(p - o) AS bias FROM pred GROUP BY 1)
 SELECT gauge, round(oq, 6) AS observed_q50, round(pq, 6) AS predicted_q50, round(rmse, 6) AS rmse, round(bias, 6) AS bias, round(pq, 6) AS baseline_q50, round(abs(pq - oq) / oq * 100, 6) AS ape_q50_pct, round(abs(pq - oq) / oq * 100, 6) AS baseline_ape_q50_pct FROM a""")
def m5(spark, sf):
    return rounded(tr.leave_one_out(tb.discharge(spark, sf), tb.donors(spark, sf)), 6)


#: Similarity between the gauges of a set by aquifer classes and terrain, each gauge to itself included.
GAUGE_SQL = f"""{T}, {tb.SHARES_SQL}, sh AS (SELECT d.gauge, s.class, s.fraction FROM donors d JOIN shares s ON s.point_id = 'P' || substr(d.gauge, 2) WHERE s.layer = 'aquifer'),
 pg AS (SELECT h.gauge AS held, g.gauge, CAST(substr(h.gauge, 2) AS BIGINT) AS i, CAST(substr(g.gauge, 2) AS BIGINT) AS j FROM donors h JOIN donors g USING (donor_set)), cls AS (SELECT DISTINCT class FROM sh),
 ad AS (SELECT held, pg.gauge, any_value(i) AS i, any_value(j) AS j, sum(abs(coalesce(a.fraction, 0) - coalesce(b.fraction, 0))) / 2 AS d FROM pg CROSS JOIN cls
    LEFT JOIN sh a ON a.gauge = held AND a.class = cls.class LEFT JOIN sh b ON b.gauge = pg.gauge AND b.class = cls.class GROUP BY 1, 2),
 gw AS (SELECT held, gauge, exp(-(d + (least(abs(7 * (i % 60) - 7 * (j % 60)) / 1000.0, 1) + least(abs(i % 30 - j % 30) / 100.0, 1)) / 2) / 2) AS e FROM ad)"""


def similarity(spark, sf):
    """Group distances of any points or gauges to their donors."""
    _, donors, shares, feats = _distances(spark, sf)
    return lambda points: [tr.class_distance(points, donors, shares), tr.vector_distance(points, donors, feats, "terrain")]


@query("m5_weighted_leave_one_out", GAUGE_SQL + """, pred AS (SELECT h.gauge, o.year, o.period, any_value(o.q) AS o, sum(gw.e * q.q * h.area_km2 / d.area_km2) / sum(gw.e) AS p, avg(q.q * h.area_km2 / d.area_km2) AS b
   FROM donors h JOIN discharge o USING (gauge) JOIN cy ON cy.donor_set = h.donor_set AND cy.year = o.year JOIN donors d ON d.donor_set = h.donor_set AND d.gauge <> h.gauge
   JOIN discharge q ON q.gauge = d.gauge AND q.year = o.year AND q.period = o.period JOIN gw ON gw.held = h.gauge AND gw.gauge = d.gauge GROUP BY 1, 2, 3),
  a AS (SELECT gauge, quantile_cont(o, 0.5) AS oq, quantile_cont(p, 0.5) AS pq, quantile_cont(b, 0.5) AS bq, sqrt(avg((p - o) * (p - o))) AS rmse, avg(p - o) AS bias FROM pred GROUP BY 1)
 SELECT gauge, round(oq, 6) AS observed_q50, round(pq, 6) AS predicted_q50, round(bq, 6) AS baseline_q50, round(rmse, 6) AS rmse, round(bias, 6) AS bias, round(abs(pq - oq) / oq * 100, 6) AS ape_q50_pct, round(abs(bq - oq) / oq * 100, 6) AS baseline_ape_q50_pct FROM a""")
def m5_weighted(spark, sf):
    donors = tb.donors(spark, sf)
    weights = tr.donor_weights(similarity(spark, sf)(donors.select(F.col("gauge").alias("point_id"), "donor_set", "area_km2")))
    return rounded(tr.leave_one_out(tb.discharge(spark, sf), donors, weights=weights), 6)


@query("m6_model_problems", T + """ , bad AS (SELECT donor_set, point_id AS subject, CASE WHEN x < 0 THEN 'area_not_positive' END AS reason FROM (SELECT *, area_km2 - 60 AS x FROM targets) WHERE x <= 0)
 SELECT donor_set, subject, 'area_not_positive' AS reason FROM bad""")
def m6(spark, sf):
    targets = tb.targets(spark, sf).withColumn("area_km2", F.col("area_km2") - 60)
    return tr.model_problems(tb.discharge(spark, sf), tb.donors(spark, sf), targets)


@query("z33_warnings", T + """, r AS (SELECT point_id, t.donor_set, count(*) FILTER (t.area_km2 / d.area_km2 < 0.5 OR t.area_km2 / d.area_km2 > 2) AS n FROM targets t JOIN donors d USING (donor_set) GROUP BY 1, 2),
  g AS (SELECT donor_set, max(year) - min(year) + 1 <> count(*) AS gap FROM cy GROUP BY 1)
 SELECT point_id, n AS donors_outside_ratio, concat_ws(',', CASE WHEN n > 0 THEN 'area_ratio_outside_half_to_double' END, CASE WHEN gap THEN 'common_years_not_contiguous' END) AS warnings FROM r JOIN g USING (donor_set)""")
def z33(spark, sf):
    targets, donors = tb.targets(spark, sf), tb.donors(spark, sf)
    return tr.warnings(tr.pairs_with_distance(targets, donors), tr.common_years(tb.discharge(spark, sf), donors), targets)


@query("z33_extrapolation", W_SQL + """, f AS (SELECT d.donor_set, min(50 + 7 * (CAST(substr(gauge, 2) AS BIGINT) % 60)) AS lo1, max(50 + 7 * (CAST(substr(gauge, 2) AS BIGINT) % 60)) AS hi1,
    min(3 + CAST(substr(gauge, 2) AS BIGINT) % 30) AS lo2, max(3 + CAST(substr(gauge, 2) AS BIGINT) % 30) AS hi2 FROM donors d GROUP BY 1)
 SELECT point_id, (50 + 7 * (CAST(substr(point_id, 2) AS BIGINT) % 60)) NOT BETWEEN lo1 AND hi1 OR (3 + CAST(substr(point_id, 2) AS BIGINT) % 30) NOT BETWEEN lo2 AND hi2 AS extrapolates FROM targets JOIN f USING (donor_set)""")
def z33x(spark, sf):
    targets, donors, _, feats = _distances(spark, sf)
    return tr.extrapolation(targets, donors, feats)


@query("m17_year_matrix", f"WITH {D} SELECT gauge, year, " + ", ".join(f'max(CASE WHEN period = {p} THEN q END) AS "{p}"' for p in range(24)) + " FROM discharge GROUP BY 1, 2")
def m17(spark, sf):
    return sd.to_wide(tb.discharge(spark, sf), ["gauge"])


# --- soil ------------------------------------------------------------------------------------------------

PTF = f"""WITH {tb.SOIL_SQL}, {tb.SOIL_WEIGHTS_SQL}, u AS (SELECT *, sand / 10 AS s, silt / 10 AS t, clay / 10 AS c, bd / 100 AS b, carbon / 100 AS o, coarse / 1000 AS rk, swc0033 / 1000 AS fc, swc1500 / 1000 AS wp,
   CASE WHEN depth_idx <= 2 THEN 1 ELSE 0 END AS tp FROM soil_cells),
 k AS (SELECT *, list_sort([60.96 * pow(10, -0.884 + 0.0153 * s) * 10 / 24, 60.96 * pow(10, -0.6 + 0.0126 * s - 0.0064 * c) * 10 / 24,
    exp(7.755 + 0.0352 * t + 0.93 * tp - 0.967 * b * b - 0.000484 * c * c - 0.000322 * t * t + 0.001 / t - 0.129 / o - 0.643 * ln(t) - 0.01398 * b * c - 0.0973 * b * o + 0.02986 * tp * c - 0.03305 * tp * t) * 10 / 24,
    exp(1.9582 + 0.0308 * s - 0.6142 * b - 0.01566 * o) * 10 / 24]) AS ks,
    abs(s + t + c - 100) <= 5 AND t > 0 AND b > 0 AND b < 2.65 AND o > 0 AND o <= 100 AND rk >= 0 AND rk < 1 AND wp >= 0 AND fc > wp AND fc <= 1 AS ok FROM u),
 ptf AS (SELECT *, CASE WHEN ok THEN (fc - wp) * (1 - rk) END AS awc, CASE WHEN ok THEN (ks[2] + ks[3]) / 2 END AS ksat FROM k)"""


@query("z30_pedotransfer", PTF + """ SELECT row, col, depth_idx, ok AS valid, round(awc, 6) AS awc, round(ksat, 6) AS ksat, CASE WHEN ok THEN round(ks[1], 6) END AS ksat_min, CASE WHEN ok THEN round(ks[4], 6) END AS ksat_max FROM ptf""")
def z30(spark, sf):
    return rounded(so.pedotransfer(tb.soil_cells(spark, sf)).select("row", "col", "depth_idx", "valid", "awc", "ksat", "ksat_min", "ksat_max"), 6)


LAYERS = PTF + """, ly AS (SELECT w.point_id, depth_idx, sum(CASE WHEN ok THEN w END) / any_value(area) AS coverage, sum(w * awc) / sum(CASE WHEN ok THEN w END) AS awc,
   sum(w * ksat) / sum(CASE WHEN ok THEN w END) AS ksat FROM ptf JOIN sweights w USING (row, col) JOIN sareas a ON a.point_id = w.point_id GROUP BY 1, 2)"""


@query("z31_soil_layers", LAYERS + " SELECT point_id, depth_idx, round(coverage, 6) AS coverage, round(awc, 6) AS awc, round(ksat, 6) AS ksat FROM ly")
def z31_layers(spark, sf):
    w, a = tb.soil_weights(spark, sf)
    return rounded(so.soil_layers(tb.soil_cells(spark, sf).drop("point_id"), w, a).select("point_id", "depth_idx", "coverage", "awc", "ksat"), 6)


@query("z31_soil_parameters", LAYERS + """, z(depth_idx, dz) AS (VALUES (0, 50.0), (1, 100.0), (2, 150.0), (3, 300.0), (4, 400.0)),
  r AS (SELECT point_id, sum(awc * dz) AS smc, sum(dz) / sum(dz / ksat) AS ks FROM ly JOIN z USING (depth_idx) GROUP BY 1),
  c AS (SELECT point_id, min(coverage) AS cov FROM ly GROUP BY 1),
  p AS (SELECT *, CAST(substr(point_id, 2) AS BIGINT) AS n FROM r JOIN c USING (point_id)),
  l AS (SELECT *, CASE WHEN n % 5 = 4 THEN 0.6 * 0.95 ELSE 0.6 * 0.95 + 0.4 * 0.3 END AS land, 3.0 + n % 12 AS slope,
     CASE WHEN cov < 0.95 THEN 'soil_coverage' WHEN n % 5 = 4 THEN 'land_shares' END AS reason FROM p)
 SELECT point_id, CASE WHEN reason IS NULL THEN round(smc, 6) END AS smc_mm, CASE WHEN reason IS NULL THEN round(ks, 6) END AS ksat_mm_h,
   CASE WHEN reason IS NULL THEN round(least(1, pow(ks / (ks + 10) * (1 / (1 + slope / 15)) * land, 1.0 / 3)), 6) END AS infiltration,
   CASE WHEN reason IS NULL THEN round(CAST(1 - land AS DOUBLE), 6) END AS exposed_fraction, reason FROM l""")
def z31(spark, sf):
    w, a = tb.soil_weights(spark, sf)
    layers = so.soil_layers(tb.soil_cells(spark, sf).drop("point_id"), w, a)
    n = F.expr("CAST(substring(point_id, 2) AS BIGINT)")
    slope = a.select("point_id", (3.0 + n % 12).alias("slope_pct"))
    land = a.select("point_id", F.explode(F.array(F.struct(F.lit(2001).alias("code"), F.lit(0.6).alias("fraction")), F.struct(F.lit(20093).alias("code"), F.when(n % 5 == 4, 0.0).otherwise(0.4).alias("fraction")))).alias("x")).select("point_id", "x.*")
    return rounded(so.soil_parameters(layers, slope, land), 6)


@query("z29_soil_features", f"""WITH {tb.SOIL_SQL}, v AS (SELECT *, abs(sand + silt + clay - 1000) <= 50 AND sand BETWEEN 0 AND 1000 AND silt BETWEEN 0 AND 1000 AND clay BETWEEN 0 AND 1000 AS ok, cos(radians(lat)) AS w FROM soil_cells),
  th(depth_idx, f) AS (VALUES (0, 0.05), (1, 0.10), (2, 0.15), (3, 0.30), (4, 0.40)),
  l AS (SELECT point_id, depth_idx, count(*) FILTER (ok) / count(*) AS c, sum(w * sand) FILTER (ok) / sum(w) FILTER (ok) / 10 AS sand, sum(w * silt) FILTER (ok) / sum(w) FILTER (ok) / 10 AS silt,
    sum(w * clay) FILTER (ok) / sum(w) FILTER (ok) / 10 AS clay FROM v GROUP BY 1, 2)
 SELECT point_id, CASE WHEN min(c) >= 0.95 THEN round(sum(sand * f), 6) END AS sand, CASE WHEN min(c) >= 0.95 THEN round(sum(silt * f), 6) END AS silt, CASE WHEN min(c) >= 0.95 THEN round(sum(clay * f), 6) END AS clay
 FROM l JOIN th USING (depth_idx) GROUP BY 1""")
def z29(spark, sf):
    return rounded(so.soil_features(tb.soil_cells(spark, sf), 100), 6)


_TAU = "CASE class WHEN 'Endapan Lepas' THEN 90 WHEN 'Batuan Volkanik' THEN 75 WHEN 'Batuan Padu' THEN 45 WHEN 'Batugamping' THEN 30 END"
_PROD = "CASE class WHEN 'Produktif Tinggi' THEN 0.9 WHEN 'Produktif Sedang' THEN 0.6 WHEN 'Langka' THEN 0 WHEN 'Setempat Produktif' THEN 0.4 WHEN 'Produktif Rendah' THEN 0.2 END"


@query("z32_recession_prior", f"""WITH {tb.SHARES_SQL}, sc AS (SELECT point_id, layer, coverage, fraction, CASE WHEN layer = 'lithology' THEN {_TAU} ELSE {_PROD} END AS v FROM shares),
  w AS (SELECT point_id, layer, CASE WHEN max(coverage) >= 0.95 AND max(coverage) * sum(fraction) FILTER (v IS NOT NULL) / sum(fraction) >= 0.95 THEN sum(v * fraction) / sum(fraction) FILTER (v IS NOT NULL) END AS s FROM sc GROUP BY 1, 2),
  p AS (SELECT point_id, max(s) FILTER (layer = 'lithology') AS tl, max(s) FILTER (layer = 'aquifer') AS pr, max(s) FILTER (layer = 'groundwater_availability') AS av FROM w GROUP BY 1),
  t AS (SELECT *, tl * (0.75 + 0.5 * list_avg(list_filter([pr, av], lambda x: x IS NOT NULL))) AS tau FROM p)
 SELECT point_id, round(tl, 6) AS lithology_tau_days, round(pr, 6) AS productivity_score, round(av, 6) AS availability_score, round(tau, 6) AS tau_days, round(exp(-30 / tau), 6) AS k30, tau IS NOT NULL AS available FROM t""")
def z32(spark, sf):
    return rounded(so.recession_prior(tb.targets(spark, sf), tb.class_shares(spark, sf)), 6)


# --- water balance ------------------------------------------------------------------------------------------

STEP = """e.point_id, e.n, e.cap, e.infiltration, e.k30, e.m, e.p_mm, e.et0_mm, e.days, e.wet_days, s0, g0"""
MOCK = f"""WITH RECURSIVE {tb.CLIMATE_SQL}, {tb.MOCK_SQL},
 ser AS (SELECT c.*, row_number() OVER (PARTITION BY point_id ORDER BY year, period) AS n, p.smc_mm * p.smc_multiplier AS cap, p.infiltration AS inf, p.k30, p.exposed_fraction AS m, p.area_km2
   FROM climate c JOIN params p USING (point_id)),
 init AS (SELECT point_id, CAST(0 AS BIGINT) AS n, any_value(cap) / 2 AS soil, CAST(0 AS DOUBLE) AS gw, CAST(NULL AS DOUBLE) AS aet, CAST(NULL AS DOUBLE) AS rech, CAST(NULL AS DOUBLE) AS direct FROM ser GROUP BY 1),
 fold(point_id, n, soil, gw, aet, rech, direct, dgw) AS (
  SELECT point_id, n, soil, gw, aet, rech, direct, CAST(0 AS DOUBLE) FROM init
  UNION ALL
  SELECT point_id, n, least(cap, avail), g1, aet, rech, greatest(avail - cap, 0) - rech, g1 - gw FROM (
   SELECT *, pow(k30, days / 30) * gw + 0.5 * (1 + pow(k30, days / 30)) * rech AS g1 FROM (
    SELECT *, greatest(avail - cap, 0) * inf AS rech FROM (
     SELECT *, p_mm + soil - aet AS avail FROM (
      SELECT s.point_id, s.n, s.cap, s.inf, s.k30, s.p_mm, s.days, f.soil, f.gw, least(s.et0_mm * (1 - s.m / 20 * greatest(18 - s.wet_days * 30 / s.days, 0)), s.p_mm + f.soil) AS aet
      FROM fold f JOIN ser s ON s.point_id = f.point_id AND s.n = f.n + 1))))),
 trace AS (SELECT s.point_id, s.year, s.period, s.days, s.area_km2, f.aet, f.soil, f.gw, f.rech, f.direct, f.rech - f.dgw AS base, f.direct + f.rech - f.dgw AS runoff
   FROM fold f JOIN ser s USING (point_id, n))"""


def _trace(spark, sf):
    return wb.mock(tb.climate(spark, sf), tb.mock_parameters(spark, sf))


@query("m7_water_balance", MOCK + """ SELECT point_id, year, period, round(aet, 6) AS aet_mm, round(soil, 6) AS soil_mm, round(gw, 6) AS groundwater_mm, round(rech, 6) AS recharge_mm,
   round(direct, 6) AS direct_mm, round(base, 6) AS baseflow_mm, round(runoff, 6) AS runoff_mm FROM trace""")
def m7(spark, sf):
    return rounded(_trace(spark, sf).select("point_id", "year", "period", "aet_mm", "soil_mm", "groundwater_mm", "recharge_mm", "direct_mm", "baseflow_mm", "runoff_mm"), 6)


@query("m8_warmup", MOCK + """ SELECT point_id, year, period, round(runoff * area_km2 * 1000 / (days * 86400), 6) AS q FROM trace WHERE year >= (SELECT min(year) FROM trace) + 1""")
def m8(spark, sf):
    sim = wb.discharge(wb.after_warmup(_trace(spark, sf), 1), tb.mock_parameters(spark, sf))
    return rounded(sim.select("point_id", "year", "period", "q"), 6)


CFG = f"""WITH {tb.MOCK_SQL}, s AS (SELECT point_id, CASE WHEN s_suppkey % 3 = 0 THEN 2.6 ELSE 1.0 END AS a, infiltration AS b, coalesce(CASE WHEN s_suppkey % 4 = 0 THEN 0.99 END, k30) AS c FROM params)"""


@query("m9_configuration", CFG + """ SELECT point_id, least(2.0, greatest(0.5, a)) AS smc_multiplier, round(b, 6) AS infiltration, round(least(0.9, greatest(0.1, c)), 6) AS k30,
  concat_ws(',', CASE WHEN a > 2 THEN 'smc_multiplier' END, CASE WHEN c > 0.9 THEN 'k30' END) AS clipped, 'auto' AS mode, 'smc_multiplier,k30' AS active FROM s""")
def m9(spark, sf):
    p = tb.mock_parameters(spark, sf)
    over = p.select("point_id", F.expr("CASE WHEN s_suppkey % 3 = 0 THEN 2.6D END").alias("smc_multiplier"), F.expr("CASE WHEN s_suppkey % 4 = 0 THEN 0.99D END").alias("k30"))
    pts = p.select("point_id", F.col("infiltration").alias("gis_infiltration"), F.col("k30").alias("gis_k30"))
    return rounded(wb.configure(pts, mode="auto", bounds={"k30": (0.1, 0.9)}, fit=["smc_multiplier", "k30"], overrides=over), 6)


def _observed(spark, sf):
    """Observed series of the catchments that carry a gauge (P0..P7)."""
    return tb.discharge(spark, sf).select(F.concat(F.lit("P"), F.expr("substring(gauge, 2)")).alias("point_id"), "year", "period", "q")


OBS = f"obs AS (SELECT 'P' || substr(gauge, 2) AS point_id, year, period, q FROM discharge)"
GRID = f"""WITH RECURSIVE {tb.CLIMATE_SQL}, {tb.MOCK_SQL}, {D}, {OBS},
 cand AS (SELECT p.point_id, a.x AS ma, b.x AS inf, c.x AS k30, p.smc_mm * a.x AS cap, p.exposed_fraction AS m, p.area_km2, row_number() OVER () AS cid
   FROM params p, (SELECT 0.5 + i * 0.75 AS x FROM range(3) t(i)) a, (SELECT i * 0.5 AS x FROM range(3) t(i)) b, (SELECT 0.05 + i * 0.465 AS x FROM range(3) t(i)) c
   WHERE p.point_id IN (SELECT point_id FROM obs)),
 ser AS (SELECT *, row_number() OVER (PARTITION BY point_id ORDER BY year, period) AS n FROM climate WHERE point_id IN (SELECT point_id FROM obs)),
 fold(cid, n, soil, gw, runoff) AS (
  SELECT cid, CAST(0 AS BIGINT), cap / 2, CAST(0 AS DOUBLE), CAST(NULL AS DOUBLE) FROM cand
  UNION ALL
  SELECT cid, n, least(cap, avail), g1, greatest(avail - cap, 0) - rech + rech - (g1 - gw) FROM (
   SELECT *, pow(k30, days / 30) * gw + 0.5 * (1 + pow(k30, days / 30)) * rech AS g1 FROM (
    SELECT *, greatest(avail - cap, 0) * inf AS rech FROM (
      SELECT c.cid, s.n, c.cap, c.inf, c.k30, s.days, f.gw, s.p_mm + f.soil - least(s.et0_mm * (1 - c.m / 20 * greatest(18 - s.wet_days * 30 / s.days, 0)), s.p_mm + f.soil) AS avail
      FROM fold f JOIN cand c USING (cid) JOIN ser s ON s.point_id = c.point_id AND s.n = f.n + 1)))),
 mean AS (SELECT point_id, greatest(avg(q), 0.01) AS mq FROM obs JOIN ser USING (point_id, year, period) GROUP BY 1),
 scored AS (SELECT c.point_id, c.ma, c.inf, c.k30, count(*) AS pairs, sum(pow((f.runoff * c.area_km2 * 1000 / (s.days * 86400) - o.q) / mq, 2)) AS sse
   FROM fold f JOIN cand c USING (cid) JOIN ser s ON s.point_id = c.point_id AND s.n = f.n JOIN obs o ON o.point_id = s.point_id AND o.year = s.year AND o.period = s.period JOIN mean USING (point_id) GROUP BY ALL)"""
GRID = GRID.replace("JOIN mean USING (point_id) GROUP", "JOIN mean ON mean.point_id = c.point_id GROUP")


@query("m10_objective_grid", GRID + " SELECT point_id, round(CAST(ma AS DOUBLE), 6) AS smc_multiplier, round(CAST(inf AS DOUBLE), 6) AS infiltration, round(CAST(k30 AS DOUBLE), 6) AS k30, CAST(pairs AS INTEGER) AS pairs, round(sse, 4) AS sse FROM scored")
def m10_grid(spark, sf):
    p, obs = tb.mock_parameters(spark, sf), cut(_observed(spark, sf))
    cl_ = tb.climate(spark, sf, obs)
    gauged = p.join(obs.select("point_id").distinct(), "point_id", "left_semi")
    cand = wb.candidate_grid(gauged.select("point_id", *wb.PARAMETERS), wb.BOUNDS, 3, 1.0)
    out = wb.objective(cl_, obs, p, cand)
    return out.select("point_id", *[F.round(c, 6).alias(c) for c in wb.PARAMETERS], "pairs", F.round("sse", 4).alias("sse"))


@query("m10_calibrate")
def m10(spark, sf):
    p, obs = tb.mock_parameters(spark, sf), cut(_observed(spark, sf))
    gauged = p.join(obs.select("point_id").distinct(), "point_id", "left_semi")
    return wb.calibrate(tb.climate(spark, sf, obs), obs, p, gauged)


@query("m11_split", f"""WITH {tb.CLIMATE_SQL}, {D}, {OBS}, p AS (SELECT obs.*, count(*) OVER (PARTITION BY point_id) AS n, row_number() OVER (PARTITION BY point_id ORDER BY year, period) AS pos
   FROM obs JOIN climate USING (point_id, year, period))
 SELECT point_id, year, period, q, CASE WHEN n < 48 OR pos <= greatest(24, floor(n * 0.75)) THEN 'fit' ELSE 'test' END AS part, n >= 48 AS validated FROM p""")
def m11(spark, sf):
    obs = cut(_observed(spark, sf))
    return wb.split_observations(obs, tb.climate(spark, sf, obs))


@query("m12_transfer_parameters", f"""WITH {tb.MOCK_SQL}, pts AS (SELECT *, s_suppkey % 2 AS donor_set FROM params),
  fit AS (SELECT *, smc_multiplier * 1.3 AS fa, least(1, infiltration + 0.05) AS fb, k30 * 0.9 AS fc FROM pts WHERE s_suppkey < 8),
  w AS (SELECT t.point_id, exp(-least(abs(ln(t.smc_mm / f.smc_mm)) + abs(ln(t.ksat_mm_h / f.ksat_mm_h)) + abs(t.slope_pct - f.slope_pct) / 15, 700)) AS w, f.fa / f.smc_multiplier AS c0, f.fb - f.infiltration AS c1, f.fc - f.k30 AS c2,
     t.smc_multiplier AS a, t.infiltration AS b, t.k30 AS c FROM pts t JOIN fit f USING (donor_set))
 SELECT point_id, round(least(2, greatest(0.5, any_value(a) * (sum(w * c0) / sum(w)))), 6) AS smc_multiplier, round(least(1, greatest(0, any_value(b) + sum(w * c1) / sum(w))), 6) AS infiltration,
   round(least(0.98, greatest(0.05, any_value(c) + sum(w * c2) / sum(w))), 6) AS k30 FROM w GROUP BY 1""")
def m12(spark, sf):
    pts = tb.mock_parameters(spark, sf).withColumn("donor_set", F.col("s_suppkey") % 2)
    gauged = tb.donors(spark, sf).select(F.concat(F.lit("P"), F.expr("substring(gauge, 2)")).alias("point_id"))
    fitted = pts.join(F.broadcast(gauged), "point_id", "left_semi").withColumns({
        "fit_smc_multiplier": F.col("smc_multiplier") * 1.3, "fit_infiltration": F.least(F.lit(1.0), F.col("infiltration") + 0.05), "fit_k30": F.col("k30") * 0.9})
    return rounded(wb.transfer_parameters(pts, fitted), 6)


@query("m16_compare_observed", MOCK + f""", {D}, {OBS}, j AS (SELECT t.point_id, o.q AS o, t.runoff * t.area_km2 * 1000 / (t.days * 86400) AS p FROM trace t JOIN obs o USING (point_id, year, period)
   WHERE t.year >= (SELECT min(year) FROM trace) + 1) SELECT point_id, {METRICS} FROM j GROUP BY 1""")
def m16(spark, sf):
    obs = cut(_observed(spark, sf))
    trace = cut(wb.mock(tb.climate(spark, sf, obs), tb.mock_parameters(spark, sf)))
    sim = wb.discharge(wb.after_warmup(trace, 1), tb.mock_parameters(spark, sf))
    return rounded(wb.compare_observed(sim, obs), 6)


# --- learning -------------------------------------------------------------------------------------------------

def _static(spark, sf):
    return tb.mock_parameters(spark, sf).select("point_id", "area_km2", "smc_mm", "ksat_mm_h", "infiltration", "exposed_fraction",
                                                (100.0 + F.col("s_suppkey") % 50).alias("elevation_m"), "slope_pct")


@query("m13_ml_features", f"""WITH {tb.CLIMATE_SQL}, f AS (SELECT *, row_number() OVER w AS n, lag(p_mm, 1) OVER w AS l1, lag(p_mm, 2) OVER w AS l2, lag(p_mm, 3) OVER w AS l3,
   sum(p_mm) OVER (PARTITION BY point_id ORDER BY year, period ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING) AS s6 FROM climate WINDOW w AS (PARTITION BY point_id ORDER BY year, period))
 SELECT point_id, year, period, round(p_mm, 6) AS p_mm, round(wet_days / days, 6) AS wet_fraction, round(l1, 6) AS p_lag1, round(l2, 6) AS p_lag2, round(l3, 6) AS p_lag3, round(s6, 6) AS p_previous6,
   round(sin(2 * pi() * period / 24), 6) AS sin_season, round(cos(2 * pi() * period / 24), 6) AS cos_season FROM f WHERE n > 6""")
def m13(spark, sf):
    f = ml.ml_features(tb.climate(spark, sf), _static(spark, sf))
    return rounded(f.select("point_id", "year", "period", "p_mm", "wet_fraction", "p_lag1", "p_lag2", "p_lag3", "p_previous6", "sin_season", "cos_season"), 6)


@query("m14_train_runoff")
def m14(spark, sf):
    obs, static = cut(_observed(spark, sf)), _static(spark, sf)
    model = ml.train_runoff(ml.samples(ml.ml_features(tb.climate(spark, sf, obs), static), obs))
    return ml.predict_runoff(model, ml.ml_features(tb.climate(spark, sf), static))


@query("m15_ml_validate")
def m15(spark, sf):
    obs = cut(_observed(spark, sf))
    return ml.validate(ml.samples(ml.ml_features(tb.climate(spark, sf, obs), _static(spark, sf)), obs))
