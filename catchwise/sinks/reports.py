"""Report tables: catchment parameters, hydrograph summaries, model tables, narrative."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from catchwise.functions.text import natural_join, number_text
from catchwise.sources.discharge import to_wide

# label, column, unit (fixed values)
PARAMETERS = (
    ("Luas DTA (A)", "area_km2", "km²"),
    ("Keliling (P)", "perimeter_km", "km"),
    ("Lintasan aliran terpanjang (L)", "flow_length_km", "km"),
    ("Lintasan aliran melalui sentroid (Lca)", "flow_lc_km", "km"),
    ("Lintasan aliran 10-85 (L10-85)", "flow_10_85_km", "km"),
    ("Elevasi minimum", "elev_min_m", "mdpl"),
    ("Elevasi rata-rata", "elev_mean_m", "mdpl"),
    ("Elevasi median", "elev_median_m", "mdpl"),
    ("Elevasi maksimum", "elev_max_m", "mdpl"),
    ("Elevasi batas tertinggi", "divide_max_m", "mdpl"),
    ("Elevasi outlet", "outlet_m", "mdpl"),
    ("Relief DTA (R)", "relief_m", "m"),
    ("Rentang elevasi (ΔZ)", "elev_range_m", "m"),
    ("Tinggi rata-rata di atas outlet (Hm)", "mean_height_m", "m"),
    ("Kemiringan rata-rata DTA (S)", "mean_slope_pct", "%"),
    ("Kemiringan maksimum", "slope_p95_pct", "%"),
    ("Faktor bentuk (Ff)", "form_factor", "-"),
    ("Rasio elongasi (Re)", "elongation", "-"),
    ("Rasio kebulatan (Rc)", "circularity", "-"),
    ("Rasio relief (RR)", "relief_ratio", "-"),
    ("Integral hipsometrik (HI)", "hypsometric_integral", "-"),
    ("Panjang total sungai (Lt)", "total_stream_length_km", "km"),
    ("Panjang sungai utama", "main_length_km", "km"),
    ("Kemiringan sungai utama (Sc)", "main_slope_pct", "%"),
    ("Kemiringan rata-rata jaringan", "network_mean_slope_pct", "%"),
    ("Sinuositas sungai utama", "sinuosity", "-"),
    ("Kemiringan lintasan aliran terpanjang (SL)", "flow_slope_pct", "%"),
    ("Kemiringan lintasan melalui sentroid (Sca)", "flow_lc_slope_pct", "%"),
    ("Kemiringan lintasan 10-85 (S10-85)", "flow_10_85_slope_pct", "%"),
    ("Kerapatan drainase (Dd)", "drainage_density", "km/km²"),
    ("Frekuensi sungai (Fs)", "stream_frequency", "sungai/km²"),
    ("Rasio percabangan (Rb)", "bifurcation_ratio", "-"),
    ("Tekstur drainase (Dt)", "drainage_texture", "sungai/km"),
    ("Jumlah percabangan", "junction_count", "percabangan"),
    ("Kerapatan percabangan", "junction_density", "percabangan/km²"),
    ("Orde sungai maksimum (Strahler)", "stream_order_max", "-"),
    ("Jumlah sungai (Nu)", "stream_count", "sungai"),
    ("Panjang sungai rata-rata (Lm)", "mean_stream_length_km", "km"),
    ("CN rata-rata tertimbang (CN-II)", "cn", "-"),
    ("Retensi potensial (S)", "retention_mm", "mm"),
    ("Luas area CN ≥ 80", "high_cn_pct", "%"),
    ("Nilai CN tidak valid", "invalid_pct", "%"),
)

# how a plain measure is read
READINGS = {
    "area_km2": "all land that drains to the outlet",
    "perimeter_km": "length of the smoothed divide",
    "flow_length_km": "from the outlet to the farthest cell along flow directions",
    "flow_lc_km": "flow path up to the point closest to the centroid",
    "flow_10_85_km": "the part of the flow path between a tenth and 85 hundredths of it",
    "elev_min_m": "lowest cell",
    "elev_mean_m": "mean of all cells",
    "elev_median_m": "half of the cells lie lower",
    "elev_max_m": "highest cell",
    "divide_max_m": "highest cell of the divide",
    "outlet_m": "cell of the outlet",
    "relief_m": "divide_max_m - outlet_m",
    "elev_range_m": "elev_max_m - elev_min_m",
    "mean_height_m": "elev_mean_m - outlet_m",
    "mean_slope_pct": "mean of all cells",
    "slope_p95_pct": "95 of 100 cells are flatter",
    "form_factor": "area / squared basin length",
    "elongation": "diameter of a circle of this area / basin length",
    "circularity": "area / area of a circle with this perimeter",
    "relief_ratio": "relief / longest flow path",
    "total_stream_length_km": "sum over all links",
    "main_length_km": "channel from the outlet to its head",
    "main_slope_pct": "fall of the main channel / its length",
    "network_mean_slope_pct": "mean over links, weighted by length",
    "sinuosity": "main channel / straight line between its ends",
    "flow_slope_pct": "fall of the longest flow path / its length",
    "flow_lc_slope_pct": "fall up to the centroid point / length",
    "flow_10_85_slope_pct": "fall between both marks / their distance",
    "drainage_density": "stream length / area",
    "stream_frequency": "Strahler streams / area",
    "bifurcation_ratio": "mean ratio of stream counts of successive orders",
    "drainage_texture": "Strahler streams / perimeter",
    "junction_count": "nodes where two links or more meet",
    "junction_density": "junctions / area",
    "stream_order_max": "order at the outlet",
    "stream_count": "Strahler streams",
    "mean_stream_length_km": "stream length / streams",
    "invalid_pct": "cells outside 1 to 100",
}

# measures read by class: lower bounds in falling order (fixed values)
BANDS = {
    "hypsometric_integral": ((0.60, "Muda"), (0.35, "Dewasa"), (None, "Tua")),
    "cn": ((80, "Potensi limpasan tinggi"), (70, "Potensi limpasan sedang"), (None, "Potensi limpasan relatif rendah")),
    "retention_mm": ((127, "Retensi relatif tinggi"), (64, "Retensi sedang"), (None, "Retensi relatif rendah")),
    "high_cn_pct": ((50, "Dominan"), (25, "Signifikan"), (None, "Terbatas")),
}


def reading(column: str, value: Column) -> Column:
    """Class of a banded measure, else the fixed reading; NULL where a banded value is absent."""
    if column not in BANDS:
        return F.lit(READINGS[column])
    out = F.when(value.isNull(), F.lit(None).cast("string"))
    for bound, name in BANDS[column]:
        out = out.otherwise(name) if bound is None else out.when(value >= bound, name)
    return out


def parameter_rows(df: DataFrame) -> DataFrame:
    """Long parameter report per catchment; absent measures stay NULL."""
    value = lambda c: (F.col(c) if c in df.columns else F.lit(None)).cast("double")
    items = F.array(*[F.struct(F.lit(i).alias("position"), F.lit(label).alias("label"), value(c).alias("value"), F.lit(u).alias("unit"), reading(c, value(c)).alias("interpretation"))
                      for i, (label, c, u) in enumerate(PARAMETERS, 1)])
    return df.select("point_id", F.inline(items))


def hss_summary(curves: DataFrame) -> DataFrame:
    """Hydrograph summary rows; unavailable methods keep a row with the missing inputs."""
    return curves.select("point_id", "method", "available", "tp_hours", "qp_m3s", "tb_hours", "equivalent_mm", "volume_error_pct", F.array_join("missing", ",").alias("missing_inputs"))


def model_tables(q: DataFrame, stats: DataFrame, key: str = "point_id") -> tuple[DataFrame, DataFrame]:
    """Year x 24 matrix and long quantile table of a model run."""
    quantiles = [c for c in stats.columns if c[:1] == "q" and c[1:].isdigit()]
    long = stats.select(key, "count", "mean", F.explode(F.array(*[F.struct(F.lit(c.upper()).alias("quantile"), F.col(c).alias("value")) for c in quantiles])).alias("s"))
    return to_wide(q, [key]), long.select(key, "count", "mean", "s.quantile", "s.value")


def narrative(df: DataFrame, decimal: str = ",") -> DataFrame:
    """Short text per catchment from its metrics; parts without a value are left out.

    ``land_types``: array of ``name, area_pct`` in falling order; the five largest are named.
    """
    top = F.slice("land_types", 1, 5)
    named = natural_join(F.transform(top, lambda s: F.concat(s["name"], F.lit(" "), number_text(s["area_pct"], 1, decimal), F.lit(" %"))))
    number = lambda label, c, digits, unit: F.when(F.col(c).isNotNull(), F.concat(F.lit(label), number_text(F.col(c), digits, decimal), F.lit(unit)))
    classed = lambda label, c: F.when(F.col(c).isNotNull(), F.concat(F.lit(label), F.lower(c)))
    parts = F.concat_ws("; ", F.when(F.size(top) > 0, F.concat(F.lit("Lahan: "), named)), number("lereng rata-rata ", "mean_slope_pct", 1, " %"), classed("kelas lereng ", "slope_class"),
                        number("drainase ", "drainage_density", 2, " km/km²"), classed("bentuk ", "shape_class"), number("CN ", "cn", 1, ""), classed("respons ", "response_class"))
    return df.select("point_id", F.concat(parts, F.lit(".")).alias("narrative"))
