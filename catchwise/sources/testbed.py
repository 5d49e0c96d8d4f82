"""Domain tables derived from the given star-schema tables.

Each function returns a DataFrame; the ``*_SQL`` strings next to it are the same
derivation as a common table expression for the SQL twins.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catchwise.runtime import table

# --- river network: parts form a binary tree -------------------------------------------


def links(spark: SparkSession, sf: str) -> DataFrame:
    part = table(spark, sf, "part")
    depth = F.floor(F.log2(F.col("linkno") + F.lit(0.5))).cast("int")
    deepest = part.agg(F.floor(F.log2(F.max("p_partkey") + 1.5)).cast("int").alias("maxdepth"))
    base = part.select(
        (F.col("p_partkey") + 1).alias("linkno"), F.col("p_retailprice").alias("length_m"),
        (F.col("p_size") / 1000.0).alias("slope"), (F.col("p_size") / 10.0).alias("area_km2"),
    )
    return base.join(F.broadcast(deepest)).select(
        "linkno",
        F.when(F.col("linkno") > 1, F.expr("linkno div 2")).alias("downstream_id"),
        "length_m", "slope", "area_km2",
        F.greatest(F.lit(1), F.col("maxdepth") - depth).cast("int").alias("strm_order"),
    )


LINKS_SQL = """
deepest AS (SELECT CAST(floor(log2(max(p_partkey) + 1.5)) AS INTEGER) AS maxdepth FROM part),
links AS (
  SELECT p_partkey + 1 AS linkno,
         CASE WHEN p_partkey > 0 THEN (p_partkey + 1) // 2 END AS downstream_id,
         p_retailprice AS length_m, p_size / 1000.0 AS slope, p_size / 10.0 AS area_km2,
         CAST(greatest(1, maxdepth - CAST(floor(log2(p_partkey + 1.5)) AS INTEGER)) AS INTEGER) AS strm_order
  FROM part, deepest)
"""


def outlet_links(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "supplier").select(
        F.concat(F.lit("P"), F.col("s_suppkey")).alias("point_id"),
        (F.col("s_suppkey") + 1).alias("linkno"), F.col("s_nationkey").alias("basin_code"),
    )


OUTLETS_SQL = """
outlets AS (
  SELECT 'P' || s_suppkey AS point_id, s_suppkey + 1 AS linkno, s_nationkey AS basin_code FROM supplier)
"""

CLOSURE_SQL = """
closure(outlet, linkno) AS (
  SELECT linkno, linkno FROM links WHERE linkno IN (SELECT linkno FROM outlets)
  UNION ALL
  SELECT c.outlet, l.linkno FROM closure c JOIN links l ON l.downstream_id = c.linkno)
"""

# --- catchments: one per supplier, measures by key arithmetic ------------------------------

CATCHMENT_EXPRS = {
    "area_km2": "15 + 3.0 * (s_suppkey % 97) + abs(s_acctbal) / 200",
    "main_length_km": "1.4 * pow(15 + 3.0 * (s_suppkey % 97), 0.6)",
    "main_lc_km": "CASE WHEN s_suppkey % 11 = 3 THEN 1.7 ELSE 0.8 END * pow(15 + 3.0 * (s_suppkey % 97), 0.6)",
    "main_slope_pct": "CASE WHEN s_suppkey % 17 <> 5 THEN 0.5 + (s_suppkey % 13) * 0.4 END",
    "flow_length_km": "1.6 * pow(15 + 3.0 * (s_suppkey % 97), 0.6)",
    "flow_lc_km": "0.85 * pow(15 + 3.0 * (s_suppkey % 97), 0.6)",
    "flow_slope_pct": "0.8 + (s_suppkey % 7) * 0.5",
    "total_stream_length_km": "1.7 * (15 + 3.0 * (s_suppkey % 97))",
    "stream_count": "5.0 + s_suppkey % 40",
    "source_stream_length_km": "0.9 * (15 + 3.0 * (s_suppkey % 97))",
    "source_stream_count": "3.0 + s_suppkey % 20",
    "width_upstream_km": "2.0 + (s_suppkey % 5) * 0.5",
    "width_lower_km": "3.0 + (s_suppkey % 3) * 0.7",
    "upstream_area_km2": "CASE WHEN s_suppkey % 19 <> 4 THEN 0.45 * (15 + 3.0 * (s_suppkey % 97)) END",
    "junction_count": "4.0 + s_suppkey % 30",
    "perimeter_km": "4.6 * sqrt(15 + 3.0 * (s_suppkey % 97))",
    "relief_m": "50.0 + (s_suppkey % 31) * 12",
    "mean_slope_pct": "3.0 + (s_suppkey % 29) * 1.3",
    "mean_height_m": "20.0 + (s_suppkey % 41) * 7",
    "cn": "CASE WHEN s_suppkey % 23 <> 7 THEN 45.0 + s_suppkey % 50 END",
}


def catchments(spark: SparkSession, sf: str) -> DataFrame:
    df = table(spark, sf, "supplier").select(
        F.concat(F.lit("P"), "s_suppkey").alias("point_id"), "s_suppkey",
        *[F.expr(e).cast("double").alias(c) for c, e in CATCHMENT_EXPRS.items()])
    return df.withColumns({
        "drainage_density": F.col("total_stream_length_km") / F.col("area_km2"),
        "stream_frequency": F.col("stream_count") / F.col("area_km2"),
        "source_factor": F.col("source_stream_length_km") / F.col("total_stream_length_km"),
        "source_frequency": F.col("source_stream_count") / F.col("stream_count"),
        "width_factor": F.col("width_upstream_km") / F.col("width_lower_km"),
        "relative_upstream_area": F.col("upstream_area_km2") / F.col("area_km2"),
    }).withColumn("symmetry_factor", F.col("width_factor") * F.col("relative_upstream_area"))


CATCHMENTS_SQL = "catch0 AS (SELECT 'P' || s_suppkey AS point_id, s_suppkey, " + ", ".join(
    f"CAST({e} AS DOUBLE) AS {c}" for c, e in CATCHMENT_EXPRS.items()) + """ FROM supplier),
catchments AS (
  SELECT *, total_stream_length_km / area_km2 AS drainage_density, stream_count / area_km2 AS stream_frequency,
         source_stream_length_km / total_stream_length_km AS source_factor,
         source_stream_count / stream_count AS source_frequency, width_upstream_km / width_lower_km AS width_factor,
         upstream_area_km2 / area_km2 AS relative_upstream_area,
         width_upstream_km / width_lower_km * (upstream_area_km2 / area_km2) AS symmetry_factor
  FROM catch0)
"""

# --- rainfall, ET0 and discharge from line items ---------------------------------------------


def _span(spark: SparkSession, sf: str) -> DataFrame:
    """First start of a half-month up to the last ship date (one row)."""
    lo, hi = F.min(F.to_date("l_shipdate")), F.max(F.to_date("l_shipdate"))
    b = table(spark, sf, "lineitem").agg(lo.alias("lo"), hi.alias("hi"))
    day = F.day("lo")
    first = F.when(day == 1, F.col("lo")).when(day <= 16, F.date_add(F.trunc("lo", "month"), 15)).otherwise(F.add_months(F.trunc("lo", "month"), 1))
    return b.select(first.alias("lo"), "hi")


def rain_daily(spark: SparkSession, sf: str) -> DataFrame:
    """``date, cell, mm`` on a complete day axis (the testbed defines an empty day as dry)."""
    days = _span(spark, sf).select(F.explode(F.sequence("lo", "hi")).alias("date"))
    cells = table(spark, sf, "supplier").select((F.col("s_suppkey") % 8).alias("cell")).distinct().agg(F.collect_list("cell").alias("cells"))
    axis = days.join(F.broadcast(cells)).select("date", F.explode("cells").alias("cell"))
    fell = table(spark, sf, "lineitem").groupBy(F.to_date("l_shipdate").alias("date"), (F.col("l_suppkey") % 8).alias("cell")).agg(
        F.sum(F.col("l_quantity").cast("long")).alias("_q"))
    return axis.join(fell, ["date", "cell"], "left").select("date", "cell", (F.coalesce("_q", F.lit(0)) / 100.0).alias("mm"))


RAIN_SQL = """
bounds AS (SELECT min(CAST(l_shipdate AS DATE)) AS lo, max(CAST(l_shipdate AS DATE)) AS hi FROM lineitem),
span AS (SELECT CASE WHEN day(lo) = 1 THEN lo WHEN day(lo) <= 16 THEN make_date(year(lo), month(lo), 16) ELSE CAST(date_trunc('month', lo) + INTERVAL 1 MONTH AS DATE) END AS lo, hi FROM bounds),
spine AS (SELECT CAST(unnest(generate_series(CAST(lo AS TIMESTAMP), CAST(hi AS TIMESTAMP), INTERVAL 1 DAY)) AS DATE) AS date FROM span),
rcells AS (SELECT DISTINCT s_suppkey % 8 AS cell FROM supplier),
fell AS (SELECT CAST(l_shipdate AS DATE) AS date, l_suppkey % 8 AS cell, sum(CAST(l_quantity AS BIGINT)) AS q FROM lineitem GROUP BY 1, 2),
rain_daily AS (SELECT s.date, c.cell, CAST(coalesce(f.q, 0) AS DOUBLE) / 100.0 AS mm
  FROM spine s CROSS JOIN rcells c LEFT JOIN fell f ON f.date = s.date AND f.cell = c.cell)
"""


def rain_weights(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Cell weights and full areas: each catchment touches three cells; every tenth is not fully covered."""
    s = table(spark, sf, "supplier")
    pid = F.concat(F.lit("P"), F.col("s_suppkey"))
    weights = s.select(pid.alias("point_id"), "s_suppkey", F.posexplode(F.array(F.lit(1.0), F.lit(0.5), F.lit(0.25))).alias("i", "w")).select(
        "point_id", ((F.col("s_suppkey") + F.col("i")) % 8).alias("cell"), "w")
    areas = s.select(pid.alias("point_id"), F.when(F.col("s_suppkey") % 10 == 9, 1.9).otherwise(1.75).alias("area"))
    return weights, areas


WEIGHTS_SQL = """
weights AS (SELECT 'P' || s_suppkey AS point_id, (s_suppkey + i) % 8 AS cell, CASE i WHEN 0 THEN 1.0 WHEN 1 THEN 0.5 ELSE 0.25 END AS w
  FROM supplier, (VALUES (0), (1), (2)) t(i)),
areas AS (SELECT 'P' || s_suppkey AS point_id, CASE WHEN s_suppkey % 10 = 9 THEN 1.9 ELSE 1.75 END AS area FROM supplier)
"""

PERIOD_SQL = "CAST(2 * (month({d}) - 1) + CASE WHEN day({d}) >= 16 THEN 1 ELSE 0 END AS INTEGER)"
DAYS_SQL = ("CAST(CASE WHEN {p} % 2 = 0 THEN 15 ELSE day(last_day(make_date(CAST({y} AS BIGINT), CAST({p} // 2 + 1 AS BIGINT), 1))) - 15 END AS INTEGER)")


def climate_daily(spark: SparkSession, sf: str, of: DataFrame | None = None) -> DataFrame:
    """Daily areal rain (9 decimals) and ET0 of every fully covered catchment, or of those among the points of ``of``."""
    from catchwise.operators.climate import areal_rain, split_coverage

    weights, areas = rain_weights(spark, sf)
    if of is not None:
        # the coverage filters keep Catalyst from carrying a later semi-join down to here
        weights = weights.join(of.select("point_id").distinct(), "point_id", "left_semi")
    ok, _ = split_coverage(areal_rain(rain_daily(spark, sf), weights, areas, ["date"]))
    return ok.select("point_id", "date", F.round("mm", 9).alias("p_mm"), (3 + F.sin(2 * 3.141592653589793 * F.dayofyear("date") / 365)).alias("et0_mm"))


def climate(spark: SparkSession, sf: str, of: DataFrame | None = None) -> DataFrame:
    from catchwise.operators.climate import halfmonth

    return halfmonth(climate_daily(spark, sf, of))


CLIMATE_SQL = RAIN_SQL + "," + WEIGHTS_SQL + f""",
areal AS (SELECT w.point_id, r.date, sum(w.w * r.mm) / sum(w.w) AS mm, least(1, sum(w.w) / any_value(a.area)) AS coverage
  FROM rain_daily r JOIN weights w USING (cell) JOIN areas a USING (point_id) GROUP BY 1, 2),
climate_daily AS (SELECT point_id, date, round(mm, 9) AS p_mm, 3 + sin(2 * pi() * dayofyear(date) / 365) AS et0_mm FROM areal WHERE coverage >= 0.95),
climate AS (
  SELECT point_id, CAST(year(date) AS INTEGER) AS year, {PERIOD_SQL.format(d='date')} AS period, min(date) AS start,
         CAST(count(*) AS INTEGER) AS days, sum(p_mm) AS p_mm, sum(et0_mm) AS et0_mm, CAST(count(*) FILTER (p_mm >= 1) AS INTEGER) AS wet_days
  FROM climate_daily GROUP BY 1, 2, 3
  HAVING count(*) = any_value({DAYS_SQL.format(p=PERIOD_SQL.format(d='date'), y='year(date)')}))
"""


def discharge(spark: SparkSession, sf: str) -> DataFrame:
    """Half-month discharge of eight gauges; only years with all 24 periods."""
    from catchwise.functions.calendar import period

    d = F.to_date("l_shipdate")
    li = table(spark, sf, "lineitem").select(
        F.concat(F.lit("G"), F.col("l_suppkey") % 8).alias("gauge"), F.year(d).alias("year"), period(d).alias("period"),
        F.round(F.col("l_extendedprice") * 100).cast("long").alias("cents"))
    agg = li.groupBy("gauge", "year", "period").agg((F.sum("cents") / 1e8).alias("q"))
    full = agg.groupBy("gauge", "year").agg(F.count("*").alias("n")).filter("n = 24").select("gauge", "year")
    return agg.join(F.broadcast(full), ["gauge", "year"], "left_semi")


DISCHARGE_SQL = f"""
q_all AS (SELECT 'G' || (l_suppkey % 8) AS gauge, CAST(year(l_shipdate) AS INTEGER) AS year, {PERIOD_SQL.format(d='l_shipdate')} AS period,
    CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS DOUBLE) / 1e8 AS q FROM lineitem GROUP BY 1, 2, 3),
discharge AS (SELECT * FROM q_all WHERE (gauge, year) IN (SELECT (gauge, year) FROM q_all GROUP BY gauge, year HAVING count(*) = 24))
"""


def donors(spark: SparkSession, sf: str) -> DataFrame:
    g = table(spark, sf, "supplier").select((F.col("s_suppkey") % 8).alias("g")).distinct()
    return g.select(F.concat(F.lit("G"), "g").alias("gauge"), (F.col("g") % 2).alias("donor_set"), (100 + 25.0 * F.col("g")).alias("area_km2"))


def targets(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "supplier").select(
        F.concat(F.lit("P"), "s_suppkey").alias("point_id"), (F.col("s_suppkey") % 2).alias("donor_set"), (15 + 3.0 * (F.col("s_suppkey") % 97)).alias("area_km2"))


TRANSFER_SQL = """
donors AS (SELECT DISTINCT 'G' || (s_suppkey % 8) AS gauge, s_suppkey % 8 % 2 AS donor_set, CAST(100 + 25 * (s_suppkey % 8) AS DOUBLE) AS area_km2 FROM supplier),
targets AS (SELECT 'P' || s_suppkey AS point_id, s_suppkey % 2 AS donor_set, CAST(15 + 3 * (s_suppkey % 97) AS DOUBLE) AS area_km2 FROM supplier)
"""

MOCK_EXPRS = {
    "smc_mm": "80.0 + s_suppkey % 90", "exposed_fraction": "(s_suppkey % 10) / 20.0", "smc_multiplier": "1.0",
    "infiltration": "0.2 + (s_suppkey % 7) * 0.1", "k30": "0.3 + (s_suppkey % 6) * 0.1", "area_km2": "15 + 3.0 * (s_suppkey % 97)",
    "ksat_mm_h": "2.0 + (s_suppkey % 11)", "slope_pct": "4.0 + (s_suppkey % 17)",
}


def mock_parameters(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "supplier").select(
        F.concat(F.lit("P"), "s_suppkey").alias("point_id"), "s_suppkey", *[F.expr(e).cast("double").alias(c) for c, e in MOCK_EXPRS.items()])


MOCK_SQL = "params AS (SELECT 'P' || s_suppkey AS point_id, s_suppkey, " + ", ".join(f"CAST({e} AS DOUBLE) AS {c}" for c, e in MOCK_EXPRS.items()) + " FROM supplier)"


# --- soil cells from parts -----------------------------------------------------------------------

SOIL_EXPRS = {
    "sand": "200.0 + (k * 7 + d * 31) % 400", "silt": "100.0 + (k * 3 + d) % 300",
    "clay": "1000.0 - (200 + (k * 7 + d * 31) % 400) - (100 + (k * 3 + d) % 300) + CASE WHEN k % 29 = 0 THEN 90 ELSE k % 5 END",
    "bd": "110.0 + k % 40", "coarse": "0.0 + k % 200", "carbon": "50.0 + k % 300", "swc0033": "250.0 + k % 100", "swc1500": "100.0 + k % 80",
}


def soil_cells(spark: SparkSession, sf: str) -> DataFrame:
    base = table(spark, sf, "part").select(F.col("p_partkey").alias("k"), F.explode(F.sequence(F.lit(0), F.lit(5))).alias("d"))
    return base.select(
        F.concat(F.lit("B"), F.expr("k div 250")).alias("point_id"), F.expr("CAST(k div 50 AS INT)").alias("row"), (F.col("k") % 50).cast("int").alias("col"),
        F.col("d").alias("depth_idx"), (-7.0 - F.expr("k div 50") * 0.01).alias("lat"), *[F.expr(e).cast("double").alias(c) for c, e in SOIL_EXPRS.items()])


SOIL_SQL = "soil_cells AS (SELECT 'B' || (k // 250) AS point_id, CAST(k // 50 AS INTEGER) AS row, CAST(k % 50 AS INTEGER) AS col, CAST(d AS INTEGER) AS depth_idx, -7.0 - (k // 50) * 0.01 AS lat, " + ", ".join(
    f"CAST({e} AS DOUBLE) AS {c}" for c, e in SOIL_EXPRS.items()) + " FROM (SELECT p_partkey AS k FROM part), (SELECT unnest(range(6)) AS d))"


def soil_weights(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    k = F.col("p_partkey")
    w = table(spark, sf, "part").select(F.concat(F.lit("B"), F.expr("p_partkey div 250")).alias("point_id"), F.expr("CAST(p_partkey div 50 AS INT)").alias("row"),
                                        (k % 50).cast("int").alias("col"), (1 + (k % 3) * 0.25).alias("w"))
    return w, w.groupBy("point_id").agg(F.sum("w").alias("area"))


SOIL_WEIGHTS_SQL = """
sweights AS (SELECT 'B' || (p_partkey // 250) AS point_id, CAST(p_partkey // 50 AS INTEGER) AS row, CAST(p_partkey % 50 AS INTEGER) AS col,
   1 + (p_partkey % 3) * 0.25 AS w FROM part),
sareas AS (SELECT point_id, sum(w) AS area FROM sweights GROUP BY 1)
"""


# --- class compositions per supplier -----------------------------------------------------------------

def class_shares(spark: SparkSession, sf: str) -> DataFrame:
    """Two classes per catchment and layer; fractions sum to one."""
    s = table(spark, sf, "supplier")
    half = (F.col("s_suppkey") % 5) / 10.0
    rows = F.array(
        *[F.struct(F.lit(layer).alias("layer"), F.element_at(F.array(*[F.lit(n) for n in names]), (F.col("s_suppkey") % len(names) + 1).cast("int")).alias("class"), (1 - half).alias("fraction"))
          for layer, names in SHARE_CLASSES.items()],
        *[F.struct(F.lit(layer).alias("layer"), F.element_at(F.array(*[F.lit(n) for n in names]), ((F.col("s_suppkey") + 1) % len(names) + 1).cast("int")).alias("class"), half.alias("fraction"))
          for layer, names in SHARE_CLASSES.items()])
    return s.select(F.concat(F.lit("P"), "s_suppkey").alias("point_id"), (F.col("s_suppkey") % 13 != 5).alias("_c"), F.inline(rows)).select(
        "point_id", "layer", "class", "fraction", F.when(F.col("_c"), 0.99).otherwise(0.9).alias("coverage")).filter("fraction > 0")


SHARE_CLASSES = {
    "lithology": ("Endapan Lepas", "Batuan Volkanik", "Batuan Padu", "Batugamping", "Tubuh Air"),
    "aquifer": ("Produktif Tinggi", "Produktif Sedang", "Langka"),
    "groundwater_availability": ("Setempat Produktif", "Produktif Rendah"),
}

SHARES_SQL = "shares AS (" + " UNION ALL ".join(
    f"""SELECT 'P' || s_suppkey AS point_id, '{layer}' AS layer, list_extract({list(names)!r}, (s_suppkey + {off}) % {len(names)} + 1) AS class,
    {frac} AS fraction, CASE WHEN s_suppkey % 13 <> 5 THEN 0.99 ELSE 0.9 END AS coverage FROM supplier WHERE {frac} > 0"""
    for layer, names in SHARE_CLASSES.items() for off, frac in ((0, "1 - (s_suppkey % 5) / 10.0"), (1, "(s_suppkey % 5) / 10.0"))) + ")"

# --- raster cells from orders: 125 columns, row-major by order key ------------------------------

LC_CODES = (2001, 2002, 2005, 20051, 2004, 20041, 2007, 20071, 3000, 2006, 2010, 20091, 20092, 20122, 6009, 20093, 20094, 2014, 20141, 2012, 5001, 20121, 5011, 50011)
GRID = {"x0": 0.0, "y0": 0.0, "cell": 30.0}


def cells(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("o_orderkey")
    row, col = F.expr("CAST(o_orderkey div 125 AS INT)"), (k % 125).cast("int")
    lc = F.element_at(F.array(*[F.lit(c) for c in LC_CODES]), (F.col("o_custkey") % 24 + 1).cast("int"))
    base = table(spark, sf, "orders").select(
        row.alias("row"), col.alias("col"), (F.col("o_totalprice") / 1000).alias("z"),
        F.when(F.col("o_custkey") % 3 == 0, 1).when(F.col("o_custkey") % 3 == 1, 7).otherwise(8).alias("d8"), F.when(F.col("o_custkey") % 97 != 0, (40 + F.col("o_custkey") % 70).cast("double")).otherwise(0.0).alias("cn"), lc.alias("lc"))
    block = F.floor(F.col("row") / 25) * 5 + F.floor(F.col("col") / 25)
    return base.withColumns({"x": (F.col("col") + 0.5) * 30.0, "y": -(F.col("row") + 0.5) * 30.0, "link_id": (block + 1).cast("long"), "point_id": F.concat(F.lit("B"), block)})


CELLS_SQL = f"""
cells0 AS (SELECT o_orderkey AS k, CAST(o_orderkey // 125 AS INTEGER) AS row, CAST(o_orderkey % 125 AS INTEGER) AS col, o_totalprice / 1000 AS z,
  CASE o_custkey % 3 WHEN 0 THEN 1 WHEN 1 THEN 7 ELSE 8 END AS d8, CASE WHEN o_custkey % 97 <> 0 THEN CAST(40 + o_custkey % 70 AS DOUBLE) ELSE 0 END AS cn,
  list_extract({list(LC_CODES)}, o_custkey % 24 + 1) AS lc FROM orders),
cells AS (SELECT *, (col + 0.5) * 30.0 AS x, -(row + 0.5) * 30.0 AS y, CAST(row // 25 * 5 + col // 25 + 1 AS BIGINT) AS link_id, 'B' || (row // 25 * 5 + col // 25) AS point_id FROM cells0)
"""

# receiver of each cell (NULL outside the grid) and every (cell, downstream cell, distance)
FLOW_SQL = CELLS_SQL + """,
recv AS (SELECT c.k, c.link_id, t.k AS r, t.link_id AS rlink, CASE WHEN t.k IS NULL THEN NULL WHEN c.d8 = 8 THEN sqrt(2.0) ELSE 1.0 END AS step
  FROM cells c LEFT JOIN cells t ON t.row = c.row + CASE WHEN c.d8 IN (7, 8) THEN 1 ELSE 0 END AND t.col = c.col + CASE WHEN c.d8 IN (1, 8) THEN 1 ELSE 0 END),
down(k, cur, dist) AS (SELECT k, k, CAST(0 AS DOUBLE) FROM recv UNION ALL SELECT d.k, r.r, d.dist + r.step FROM down d JOIN recv r ON r.k = d.cur WHERE r.r IS NOT NULL)
"""


def cell_outlets(spark: SparkSession, sf: str) -> DataFrame:
    """One outlet cell per supplier: ``point_id, row, col, linkno, x, y``."""
    n = table(spark, sf, "orders").agg(F.count("*").alias("n"))
    k = (F.col("s_suppkey") * 149 + 60) % F.col("n")
    base = table(spark, sf, "supplier").join(F.broadcast(n)).select(F.concat(F.lit("P"), "s_suppkey").alias("point_id"), k.alias("k"))
    base = base.select("point_id", "k", F.expr("CAST(k div 125 AS INT)").alias("row"), (F.col("k") % 125).cast("int").alias("col"))
    return base.withColumns({"x": (F.col("col") + 0.5) * 30.0, "y": -(F.col("row") + 0.5) * 30.0,
                             "linkno": (F.floor(F.col("row") / 25) * 5 + F.floor(F.col("col") / 25) + 1).cast("long")})


CELL_OUTLETS_SQL = """
couts AS (SELECT 'P' || s_suppkey AS point_id, (s_suppkey * 149 + 60) % (SELECT count(*) FROM orders) AS k FROM supplier)
"""


def block_outlets(cell_table: DataFrame) -> DataFrame:
    """Outlet height of each block: its last cell."""
    return cell_table.groupBy("point_id").agg(F.max_by("z", F.col("row") * 125 + F.col("col")).alias("outlet_z"))


def land_classes(spark: SparkSession, sf: str) -> DataFrame:
    names = F.array(F.lit("A"), F.lit("B"), F.lit("C"))
    return cells(spark, sf).select("row", "col", F.element_at(names, ((F.floor(F.col("row") / 10) + F.floor(F.col("col") / 10)) % 3 + 1).cast("int")).alias("class"))


LAND_CLASSES_SQL = "lclass AS (SELECT row, col, list_extract(['A', 'B', 'C'], (row // 10 + col // 10) % 3 + 1) AS class FROM cells)"

# --- polygons from suppliers, line segments from parts, places from customers -------------------

_SQUARE = ((0, 0, 1, 0), (1, 0, 1, 1), (1, 1, 0, 1), (0, 1, 0, 0))


def _square_rows(part: int, ring: int, x, y, side, clockwise: bool = False):
    rows = []
    for i, (a, b, c, d) in enumerate(reversed(_SQUARE) if clockwise else _SQUARE):
        p, q = ((c, d), (a, b)) if clockwise else ((a, b), (c, d))
        rows.append(F.struct(F.lit(part).alias("part"), F.lit(ring).alias("ring"), F.lit(i).alias("seq"),
                             (x + p[0] * side).cast("double").alias("x1"), (y + p[1] * side).cast("double").alias("y1"),
                             (x + q[0] * side).cast("double").alias("x2"), (y + q[1] * side).cast("double").alias("y2")))
    return rows


def polygons(spark: SparkSession, sf: str) -> DataFrame:
    """One 1 km square per supplier on a 40-wide grid; some with a hole, some with a small second part."""
    k = F.col("s_suppkey")
    x, y = (k % 40) * 1000, F.expr("s_suppkey div 40") * 1000
    s = table(spark, sf, "supplier")
    base = s.select(k.alias("poly_id"), F.inline(F.array(*_square_rows(0, 0, x, y, F.lit(1000)))))
    hole = s.filter(k % 3 == 0).select(k.alias("poly_id"), F.inline(F.array(*_square_rows(0, 1, x + 400, y + 400, 100 + 50 * (k % 5), True))))
    extra = s.filter(k % 4 == 1).select(k.alias("poly_id"), F.inline(F.array(*_square_rows(1, 0, x + 100000, y, F.lit(200)))))
    return base.unionByName(hole).unionByName(extra)


def _sq_sql(part, ring, x, y, side, cw, where):
    out = []
    for i, (a, b, c, d) in enumerate(reversed(_SQUARE) if cw else _SQUARE):
        p, q = ((c, d), (a, b)) if cw else ((a, b), (c, d))
        out.append(f"SELECT s_suppkey AS poly_id, {part} AS part, {ring} AS ring, {i} AS seq, CAST({x} + {p[0]} * ({side}) AS DOUBLE) AS x1, CAST({y} + {p[1]} * ({side}) AS DOUBLE) AS y1, "
                   f"CAST({x} + {q[0]} * ({side}) AS DOUBLE) AS x2, CAST({y} + {q[1]} * ({side}) AS DOUBLE) AS y2 FROM supplier WHERE {where}")
    return " UNION ALL ".join(out)


_PX, _PY = "(s_suppkey % 40) * 1000", "(s_suppkey // 40) * 1000"
PARCELS_SQL = f"parcels AS ({_sq_sql(0, 0, _PX, _PY, '1000', False, 'true')})"
POLYGONS_SQL = f"""{PARCELS_SQL}, edges AS (SELECT * FROM parcels UNION ALL {_sq_sql(0, 1, _PX + ' + 400', _PY + ' + 400', '100 + 50 * (s_suppkey % 5)', True, 's_suppkey % 3 = 0')}
  UNION ALL {_sq_sql(1, 0, _PX + ' + 100000', _PY, '200', False, 's_suppkey % 4 = 1')})"""


def points_xy(spark: SparkSession, sf: str) -> DataFrame:
    """One position per customer over the polygon grid, some exactly on edges."""
    k = F.col("c_custkey")
    return table(spark, sf, "customer").select(
        F.concat(F.lit("Q"), k).alias("point_id"), ((k * 7919) % 41000).cast("double").alias("x"),
        F.when(k % 11 == 0, ((k * 13) % 3 * 1000)).otherwise((k * 104729) % 3500).cast("double").alias("y"))


POINTS_XY_SQL = """pts AS (SELECT 'Q' || c_custkey AS point_id, CAST((c_custkey * 7919) % 41000 AS DOUBLE) AS x,
  CAST(CASE WHEN c_custkey % 11 = 0 THEN (c_custkey * 13) % 3 * 1000 ELSE (c_custkey * 104729) % 3500 END AS DOUBLE) AS y FROM customer)"""


def link_segments(spark: SparkSession, sf: str) -> DataFrame:
    """One segment per link from its own node to the downstream node, on a 50-wide grid."""
    l = links(spark, sf).filter("downstream_id is not null")
    def nx(c):
        return (F.col(c) % 50 * 1000).cast("double")
    def ny(c):
        return (F.expr(f"{c} div 50") * 1000).cast("double")
    return l.select("linkno", F.lit(0).alias("part"), F.lit(0).alias("seq"), nx("linkno").alias("x1"), ny("linkno").alias("y1"),
                    nx("downstream_id").alias("x2"), ny("downstream_id").alias("y2"), F.lit(0.0).alias("station"),
                    (F.col("area_km2") * 7).alias("ds_cont_area_km2"), F.concat(F.when(F.col("linkno") % 3 == 0, "Kali ").when(F.col("linkno") % 3 == 1, "K. ").otherwise(""), F.lit("R"), F.col("linkno")).alias("raw_name"),
                    (F.col("linkno") % 4 == 0).alias("_unnamed")).withColumn("river_name", F.when(~F.col("_unnamed"), F.col("raw_name"))).drop("raw_name", "_unnamed")


SEGMENTS_SQL = """segs AS (SELECT linkno, 0 AS part, 0 AS seq, CAST(linkno % 50 * 1000 AS DOUBLE) AS x1, CAST(linkno // 50 * 1000 AS DOUBLE) AS y1,
  CAST(downstream_id % 50 * 1000 AS DOUBLE) AS x2, CAST(downstream_id // 50 * 1000 AS DOUBLE) AS y2, area_km2 * 7 AS ds_cont_area_km2,
  CASE WHEN linkno % 4 <> 0 THEN 'Kali R' || linkno END AS river_label FROM links WHERE downstream_id IS NOT NULL)"""


def toponyms_raw(spark: SparkSession, sf: str) -> DataFrame:
    cats = ("Permukiman Lainnya", "Ibukota Desa", "Desa", "Kecamatan", "Kota", "Ibukota Kabupaten", "Gunung")
    k = F.col("c_custkey")
    return table(spark, sf, "customer").select(
        k.alias("id"), F.when(k % 50 == 7, "  ").otherwise(F.concat(F.lit("  "), F.col("c_name"), F.lit("  é"))).alias("name"),
        F.element_at(F.array(*[F.lit(c) for c in cats]), (k % 7 + 1).cast("int")).alias("category"),
        (110 + ((k * 37) % 1000) / 1000.0).alias("lon"), (-7.5 + ((k * 53) % 1000) / 1000.0).alias("lat"))


TOPONYMS_SQL = """topo AS (SELECT c_custkey AS id, c_name || '  é' AS name, lower(c_name) || ' e' AS name_norm,
  list_extract(['Permukiman Lainnya', 'Ibukota Desa', 'Desa', 'Kecamatan', 'Kota', 'Ibukota Kabupaten', 'Gunung'], c_custkey % 7 + 1) AS category,
  list_extract([0, 0, 1, 2, 3, 4, NULL], c_custkey % 7 + 1) AS priority,
  110 + ((c_custkey * 37) % 1000) / 1000.0 AS lon, -7.5 + ((c_custkey * 53) % 1000) / 1000.0 AS lat FROM customer WHERE c_custkey % 50 <> 7)"""


def lonlat_points(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("s_suppkey")
    return table(spark, sf, "supplier").select(F.concat(F.lit("P"), k).alias("point_id"), k.alias("k"),
                                               (110 + ((k * 91) % 1000) / 1000.0).alias("lon"), (-7.5 + ((k * 17) % 1000) / 1000.0).alias("lat"))


LONLAT_SQL = "lp AS (SELECT 'P' || s_suppkey AS point_id, s_suppkey AS k, 110 + ((s_suppkey * 91) % 1000) / 1000.0 AS lon, -7.5 + ((s_suppkey * 17) % 1000) / 1000.0 AS lat FROM supplier)"


def ring_vertices(spark: SparkSession, sf: str) -> DataFrame:
    """A wavy 36-vertex ring per supplier."""
    k = F.col("s_suppkey")
    v = table(spark, sf, "supplier").select(k.alias("ring_id"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(35).cast("long"))).alias("seq"))
    r = 600 + ((F.col("ring_id") * 7 + F.col("seq") * 13) % 11) * 4.0
    a = F.col("seq") * (3.141592653589793 / 18)
    return v.select("ring_id", "seq", (F.col("ring_id") * 2000 + r * F.cos(a)).alias("x"), (r * F.sin(a)).alias("y"))


RINGS_SQL = """rv AS (SELECT s_suppkey AS ring_id, i AS seq, s_suppkey * 2000 + (600 + ((s_suppkey * 7 + i * 13) % 11) * 4.0) * cos(i * pi() / 18) AS x,
  (600 + ((s_suppkey * 7 + i * 13) % 11) * 4.0) * sin(i * pi() / 18) AS y FROM supplier, (SELECT unnest(range(36)) AS i))"""
