"""Zonal analytics over the cell table: terrain, land cover, curve number, overlays."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from catchwise.functions.numeric import SLOPE_BANDS, classify
from catchwise.operators import ordered
from catchwise.runtime import small

# Compass order used for steepest-drop ties (fixed values)
ASPECTS = ("Utara", "Timur Laut", "Timur", "Tenggara", "Selatan", "Barat Daya", "Barat", "Barat Laut")
SLOPE_CLASSES = (("Datar", 0.0, 8.0), ("Landai", 8.0, 15.0), ("Agak curam", 15.0, 25.0), ("Curam", 25.0, 40.0), ("Sangat curam", 40.0, None))

# Land-cover labels (fixed values)
LANDCOVER = {
    2001: "Hutan lahan kering primer", 2002: "Hutan lahan kering sekunder", 2005: "Hutan rawa primer", 20051: "Hutan rawa sekunder",
    2004: "Hutan mangrove primer", 20041: "Hutan mangrove sekunder", 2007: "Semak belukar", 20071: "Semak belukar rawa", 3000: "Savana",
    2006: "Hutan tanaman industri", 2010: "Perkebunan", 20091: "Pertanian lahan kering", 20092: "Pertanian lahan kering bercampur semak",
    20122: "Transmigrasi", 6009: "Transmigrasi", 20093: "Sawah", 20094: "Tambak", 2014: "Tanah terbuka", 20141: "Pertambangan",
    2012: "Permukiman", 5001: "Tubuh air", 20121: "Pelabuhan udara/laut", 5011: "Rawa", 50011: "Rawa",
}
# Land-cover groups (fixed values)
LAND_GROUPS = {
    "forest_pct": (2001, 2002, 2005, 20051, 2004, 20041, 2006), "agriculture_pct": (20091, 20092, 20093, 2010, 20122, 6009),
    "built_up_pct": (2012, 20121), "open_land_pct": (2014, 20141), "water_pct": (5001, 20094, 5011, 50011),
}


def stencil(cells: DataFrame, cols: list[str]) -> DataFrame:
    """Add ``around``: the eight neighbours' ``cols`` in compass order from north.

    Two windows, one along rows and one along columns, replace an eight-fold join:
    each shuffle moves every cell once and a group is one raster row or column.
    Beside a gap a placeholder row passes the side values on, so diagonal neighbours
    are seen across missing cells too.
    """
    along = W.partitionBy("row").orderBy("col")
    mine = F.struct("col", F.struct(*cols).alias("v"))
    wide = cells.withColumns({"_p": F.lag(mine).over(along), "_q": F.lead(mine).over(along)})
    col = F.col("col")
    own = F.struct(*cols)
    left = F.when(F.col("_p.col") == col - 1, F.col("_p.v"))
    right = F.when(F.col("_q.col") == col + 1, F.col("_q.v"))

    def slot(at, body, centre, w, e):
        return F.struct(at.cast("int").alias("_col"), body.alias("_cell"), centre.alias("_c"), w.alias("_w"), e.alias("_e"))

    empty_cell = F.when(F.lit(False), F.struct(*cells.columns))
    nothing = F.when(F.lit(False), own)
    after = F.when(F.col("_q").isNull() | (F.col("_q.col") > col + 1), slot(col + 1, empty_cell, nothing, own, F.when(F.col("_q.col") == col + 2, F.col("_q.v"))))
    before = F.when(F.col("_p").isNull() | (F.col("_p.col") < col - 2), slot(col - 1, empty_cell, nothing, nothing, own))
    rows = wide.select("row", F.inline(F.array_compact(F.array(slot(col, F.struct(*cells.columns), own, left, right), after, before))))
    pack = F.struct("row", "_c", "_w", "_e")
    down = W.partitionBy("_col").orderBy("row")
    rows = rows.withColumns({"_n": F.lag(pack).over(down), "_s": F.lead(pack).over(down)}).filter("_cell is not null")
    rows = rows.withColumns({"_n": F.when(F.col("_n.row") == F.col("row") - 1, F.col("_n")), "_s": F.when(F.col("_s.row") == F.col("row") + 1, F.col("_s"))})
    return rows.select("_cell.*", F.array("_n._c", "_n._e", "_e", "_s._e", "_s._c", "_s._w", "_w", "_n._w").alias("around"))


def local_terrain(cells: DataFrame, cell_run: float, zone: str | None = None) -> DataFrame:
    """Slope percent, steepest-drop aspect and (with ``zone``) a divide flag per cell.

    Slope is the largest absolute height difference to any neighbour over one cell
    run, diagonals included.  A divide cell has a neighbour outside its zone.
    """
    cols = ["z"] + ([zone] if zone else [])
    s = stencil(cells, cols)
    diffs = F.transform("around", lambda n: F.abs(n["z"] - F.col("z")))
    drops = F.transform("around", lambda n: F.col("z") - n["z"])
    s = s.withColumns({"_d": F.array_max(F.array_compact(diffs)), "_drops": drops})
    best = F.array_max(F.array_compact("_drops"))
    s = s.withColumn("_best", F.when(best > 0, best))
    out = {"slope_pct": F.col("_d") / cell_run * 100.0,
           "aspect_idx": F.when(F.col("_best").isNotNull(), F.array_position("_drops", F.col("_best"))).cast("int")}
    if zone:
        out["on_divide"] = F.exists("around", lambda n: n.isNull() | ~n[zone].eqNullSafe(F.col(zone)))
    return s.withColumns(out).drop("around", "_d", "_drops", "_best")


def elevation_stats(terrain: DataFrame, outlets: DataFrame, key: str = "point_id") -> DataFrame:
    """Elevation range, mean, height above the outlet and relief (divide top minus outlet).

    ``outlets``: ``key, outlet_z``.
    """
    agg = terrain.filter("z is not null").groupBy(key).agg(
        F.count("*").alias("cells"), F.min("z").alias("min_m"), F.avg("z").alias("mean_m"), F.max("z").alias("max_m"),
        F.max(F.when(F.col("on_divide"), F.col("z"))).alias("_divide"))
    return agg.join(small(outlets), key, "left").select(
        key, "cells", "min_m", "mean_m", "max_m", (F.col("max_m") - F.col("min_m")).alias("range_m"),
        (F.coalesce("_divide", "max_m") - F.col("outlet_z")).alias("relief_m"), (F.col("mean_m") - F.col("outlet_z")).alias("mean_height_above_outlet_m"))


def slope_distribution(terrain: DataFrame, key: str = "point_id") -> DataFrame:
    """Mean and 95th percentile slope with the percent of cells per slope class."""
    s = F.col("slope_pct")
    valid = terrain.filter(s.isNotNull())
    shares = []
    for i, (_, lo, hi) in enumerate(SLOPE_CLASSES, 1):
        inside = (s >= lo) if hi is None else (s >= lo) & (s < hi)
        shares.append((F.count_if(inside) / F.count("*") * 100.0).alias(f"class{i}_pct"))
    agg = valid.groupBy(key).agg(F.avg(s).alias("mean_pct"), *shares)
    p95 = ordered.quantiles(valid, [key], "slope_pct", [0.95]).select(key, F.col("q").alias("p95_pct"))
    return agg.join(p95, key).withColumn("slope_class", classify(F.col("mean_pct"), *SLOPE_BANDS))


def aspect_distribution(terrain: DataFrame, key: str = "point_id") -> DataFrame:
    """Cells per aspect; the most frequent one (first in compass order on ties) is marked."""
    counts = terrain.filter("aspect_idx is not null").groupBy(key, "aspect_idx").agg(F.count("*").alias("cells"))
    total = counts.groupBy(key).agg(F.sum("cells").alias("_all"), F.max(F.struct("cells", (-F.col("aspect_idx")).alias("i"))).alias("_top"))
    name = F.element_at(F.array(*[F.lit(a) for a in ASPECTS]), F.col("aspect_idx"))
    return counts.join(total, key).select(key, name.alias("aspect"), "cells", (F.col("cells") / F.col("_all") * 100.0).alias("area_pct"),
                                          (F.col("aspect_idx") == -F.col("_top.i")).alias("dominant"))


def hypsometry(cells: DataFrame, key: str = "point_id") -> DataFrame:
    """Hypsometric integral, stage and elevation percentiles."""
    probs = (0.10, 0.25, 0.50, 0.75, 0.90)
    base = cells.filter("z is not null").groupBy(key).agg(F.min("z").alias("_lo"), F.max("z").alias("_hi"), F.avg("z").alias("_m"))
    hi = F.coalesce((F.col("_m") - F.col("_lo")) / F.nullif(F.col("_hi") - F.col("_lo"), F.lit(0.0)), F.lit(0.0))
    q = ordered.quantiles(cells, [key], "z", list(probs))
    wide = q.groupBy(key).agg(*[F.max(F.when(F.abs(F.col("prob") - p) < 1e-9, F.col("q"))).alias(f"p{round(p * 100)}") for p in probs])
    return base.select(key, hi.alias("hypsometric_integral"), F.when(hi >= 0.60, "Muda").when(hi >= 0.35, "Dewasa").otherwise("Tua").alias("stage")).join(wide, key)


def landcover(cells: DataFrame, areas: DataFrame, key: str = "point_id") -> DataFrame:
    """Class histogram per catchment: label, percent and km2 (``areas``: ``key, area_km2``)."""
    counts = cells.filter("lc is not null").groupBy(key, "lc").agg(F.count("*").alias("cells"))
    total = counts.groupBy(key).agg(F.sum("cells").alias("_all"))
    names = F.create_map(*[F.lit(x) for kv in LANDCOVER.items() for x in kv])
    share = F.col("cells") / F.col("_all")
    return counts.join(total, key).join(small(areas.select(key, "area_km2")), key, "left").select(
        key, "lc", F.coalesce(names[F.col("lc")], F.concat(F.lit("Kelas PL "), F.col("lc"))).alias("name"), "cells",
        (share * 100.0).alias("area_pct"), (share * F.col("area_km2")).alias("area_km2"))


def landcover_groups(cells: DataFrame, key: str = "point_id") -> DataFrame:
    """Percent of forest, agriculture, built-up, open land and water."""
    return cells.filter("lc is not null").groupBy(key).agg(
        *[(F.count_if(F.col("lc").isin(*codes)) / F.count("*") * 100.0).alias(n) for n, codes in LAND_GROUPS.items()])


def curve_number(cells: DataFrame, key: str = "point_id") -> DataFrame:
    """Mean curve number, bins, high share, retention and readings."""
    cn = F.col("cn")
    ok = (cn > 0) & (cn <= 100)
    bins = (cn < 60, (cn >= 60) & (cn < 70), (cn >= 70) & (cn < 80), (cn >= 80) & (cn <= 90), cn > 90)
    n = F.count_if(ok)
    some = F.when(n > 0, n)
    agg = cells.filter(cn.isNotNull()).groupBy(key).agg(
        F.avg(F.when(ok, cn)).alias("cn"), *[(F.count_if(ok & b) / some * 100.0).alias(f"bin{i}_pct") for i, b in enumerate(bins, 1)],
        (F.count_if(ok & (cn >= 80)) / some * 100.0).alias("high_cn_pct"), (F.count_if(~ok) / F.count("*") * 100.0).alias("invalid_pct"))
    m, high = F.col("cn"), F.col("high_cn_pct")
    kept = 25400.0 / m - 254.0
    # readings and bounds (fixed values)
    return agg.filter("cn is not null").withColumns({
        "retention_mm": kept,
        "runoff_reading": F.when(m >= 80, "Potensi limpasan tinggi").when(m >= 70, "Potensi limpasan sedang").otherwise("Potensi limpasan relatif rendah"),
        "retention_reading": F.when(kept < 64, "Retensi relatif rendah").when(kept < 127, "Retensi sedang").otherwise("Retensi relatif tinggi"),
        "high_cn_reading": F.when(high >= 50, "Dominan").when(high >= 25, "Signifikan").otherwise("Terbatas")})


# --- overlays ------------------------------------------------------------------------------

def class_area(cells: DataFrame, classes: DataFrame, cell_km2: float, key: str = "point_id") -> DataFrame:
    """Area of each class inside each catchment: cell equality join, then a group sum."""
    return cells.join(classes, ["row", "col"]).groupBy(key, "class").agg((F.count("*") * cell_km2).alias("area_km2"))


UNKNOWN_LAND = "tipe lahan belum teridentifikasi"


def landsystem(cells: DataFrame, cell_km2: float, key: str = "point_id") -> DataFrame:
    """Area by (type, physiography, relief) and by each attribute in one grouping-sets pass.

    Blank or '-' types count as water in the combined grouping; the dominant class is
    the largest that is not water.  ``level``: classes, land_types, physiographies, relief_classes.
    """
    def clean(c):
        t = F.trim(F.coalesce(F.col(c), F.lit("-")))
        return F.when((t == "") | (t == "-"), "-").otherwise(t)

    base = cells.select(key, clean("land_type").alias("land_type"), clean("physiography").alias("physiography"), clean("relief").alias("relief"))
    water = F.col("land_type") == "-"
    combined = base.select(key, F.when(water, "badan air").otherwise(F.col("land_type")).alias("c_type"),
                           F.when(water, "").otherwise(F.col("physiography")).alias("c_phys"), F.when(water, "").otherwise(F.col("relief")).alias("c_relief"),
                           "land_type", "physiography", "relief")
    k, full = F.col(key), [F.col("c_type"), F.col("c_phys"), F.col("c_relief")]
    every = [k, *full, F.col("land_type"), F.col("physiography"), F.col("relief")]
    sets = [[k, *full], [k, F.col("land_type")], [k, F.col("physiography")], [k, F.col("relief")]]
    g = combined.groupingSets(sets, *every).agg(
        F.count("*").alias("cells"), F.grouping("c_type").alias("g0"), F.grouping("land_type").alias("g1"), F.grouping("physiography").alias("g2"))
    level = F.when(F.col("g0") == 0, "classes").when(F.col("g1") == 0, "land_types").when(F.col("g2") == 0, "physiographies").otherwise("relief_classes")
    rows = g.select(key, level.alias("level"), F.when(F.col("g0") == 0, F.concat_ws("; ", "c_type", F.nullif(F.col("c_phys"), F.lit("")), F.nullif(F.col("c_relief"), F.lit(""))))
                    .otherwise(F.coalesce("land_type", "physiography", "relief")).alias("name"),
                    "cells", (F.coalesce("c_type", F.lit("")) == "badan air").alias("water"))
    total = base.groupBy(key).agg(F.count("*").alias("_all"))
    top = rows.filter("level = 'classes' and not water").groupBy(key).agg(F.max(F.struct("cells", "name")).alias("_top"))
    return rows.join(total, key).join(top, key, "left").select(
        key, "level", "name", (F.col("cells") * cell_km2).alias("area_km2"), (F.col("cells") / F.col("_all") * 100.0).alias("area_pct"),
        F.coalesce((F.col("level") == "classes") & (F.col("name") == F.col("_top.name")), F.lit(False)).alias("dominant"))


def distribution(areas: DataFrame, totals: DataFrame, *, minimum_coverage: float = 0.95, relative_to_catchment: bool = False, key: str = "point_id") -> DataFrame:
    """Class fractions behind the coverage, overlap and unknown-share guards.

    ``areas``: ``key, class, area_km2`` (NULL class = unknown); ``totals``: ``key, area_km2, covered_km2``.
    ``reason`` tells why a catchment has no fractions; the overlap guard is an error of the source.
    """
    named = areas.withColumn("class", F.coalesce("class", F.lit("Tidak diketahui")))
    sums = named.groupBy(key).agg(F.sum("area_km2").alias("_sum"), F.sum(F.when(F.col("class") == "Tidak diketahui", F.col("area_km2")).otherwise(0.0)).alias("_unknown"))
    t = totals.select(key, F.col("area_km2").alias("_area"), F.col("covered_km2").alias("_cov")).join(sums, key, "left")
    coverage = F.col("_cov") / F.col("_area")
    reason = (F.when(F.col("_sum") > F.col("_area") * 1.02, "classes_overlap").when(coverage < minimum_coverage, "coverage")
              .when(F.coalesce("_sum", F.lit(0.0)) <= 0, "no_class"))
    if minimum_coverage > 0:
        reason = F.coalesce(reason, F.when(F.col("_unknown") / F.nullif(F.col("_sum"), F.lit(0.0)) > 0.05, "unknown_share"))
    t = t.withColumns({"coverage": F.least(F.lit(1.0), coverage), "reason": reason})
    base = F.col("_area") if relative_to_catchment else F.col("_sum")
    return t.join(named, key, "left").select(key, F.when(F.col("reason").isNull(), F.col("class")).alias("class"),
                                             F.when(F.col("reason").isNull(), F.col("area_km2") / base).alias("fraction"), "coverage", "reason").distinct()


def crosswalk(subs: DataFrame, basins: DataFrame) -> DataFrame:
    """Largest-overlap basin of each subbasin from shared cells: ``(polygon_id, basin_code, overlap_ratio)``.

    Cell counts replace polygon areas, so a ratio is off by at most the boundary cells.
    """
    joined = subs.join(basins, ["row", "col"], "left")
    pairs = joined.groupBy("polygon_id", "basin_code").agg(F.count("*").alias("n"))
    size = pairs.groupBy("polygon_id").agg(F.sum("n").alias("_all"), F.max(F.when(F.col("basin_code").isNotNull(), F.struct("n", (-F.col("basin_code")).alias("b")))).alias("_best"))
    return size.select("polygon_id", (-F.col("_best.b")).alias("basin_code"), F.coalesce(F.col("_best.n") / F.col("_all"), F.lit(0.0)).alias("overlap_ratio"),
                       F.coalesce("_best.n", F.lit(0)).alias("overlap_cells"))


def supported_basins(cross: DataFrame, basins: DataFrame, minimum: float = 0.90) -> DataFrame:
    """Basins whose assigned subbasins cover at least 90 % of their cells."""
    size = basins.groupBy("basin_code").agg(F.count("*").alias("_n"))
    got = cross.filter("basin_code is not null").groupBy("basin_code").agg(F.sum("overlap_cells").alias("_got"), F.count("*").alias("subbasin_count"))
    ratio = F.coalesce(F.col("_got") / F.col("_n"), F.lit(0.0))
    return size.join(got, "basin_code", "left").select(
        "basin_code", ratio.alias("coverage_ratio"), F.coalesce("subbasin_count", F.lit(0)).cast("long").alias("subbasin_count"), (ratio >= minimum).alias("supported"))
