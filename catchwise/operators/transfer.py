"""Area-ratio transfer of discharge from gauged donors to ungauged targets.

Targets and donors belong to a ``donor_set``.  With equal weights the transfer
factorises: ``Q_t = A_t**b * mean_d(Q_d / A_d**b)``; donors are averaged once per
half-month and every target scales the result, so no target-donor pair exists.
Only a similarity weighting needs pairs, and then the weight table is the result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from catchwise.operators.stats import weibull_at
from catchwise.runtime import small

GROUPS = ("aquifer", "soil", "landcover", "terrain", "rainfall")
# Physical scales of vector descriptors (fixed values)
SCALES = {"soil": (100.0, 100.0, 100.0), "terrain": (1000.0, 100.0)}


def check_exponent(b: float) -> float:
    if not 0 < b <= 3:
        raise ValueError("area exponent must be above 0 and at most 3")
    return float(b)


def common_years(q: DataFrame, donors: DataFrame) -> DataFrame:
    """Years recorded by every donor of a set: ``(donor_set, year)``."""
    years = q.select("gauge", "year").distinct().join(small(donors), "gauge")
    size = donors.groupBy("donor_set").agg(F.count("*").alias("_n"))
    return years.groupBy("donor_set", "year").agg(F.count("*").alias("_have")).join(small(size), "donor_set").filter(
        "_have = _n").select("donor_set", "year")


def scaled_donors(q: DataFrame, donors: DataFrame, b: float) -> DataFrame:
    """Donor discharge per unit area power on common years."""
    years = common_years(q, donors)
    return q.join(small(donors.select("gauge", "donor_set", "area_km2")), "gauge").join(small(years), ["donor_set", "year"], "left_semi").withColumn(
        "_s", F.col("q") / F.pow("area_km2", F.lit(b)))


def transfer(q: DataFrame, donors: DataFrame, targets: DataFrame, b: float = 1.0, weights: DataFrame | None = None) -> DataFrame:
    """``(point_id, year, period, q, q_min, q_max)`` for every target.

    ``donors``: ``gauge, donor_set, area_km2``; ``targets``: ``point_id, donor_set,
    area_km2``; ``weights``: optional ``point_id, gauge, weight``.
    """
    b = check_exponent(b)
    scaled = scaled_donors(q, donors, b)
    lift = F.pow("_at", F.lit(b))
    size = targets.select("point_id", "donor_set", F.col("area_km2").alias("_at"))
    envelope = scaled.groupBy("donor_set", "year", "period").agg(
        F.avg("_s").alias("_m"), F.min("_s").alias("_lo"), F.max("_s").alias("_hi"))
    # a set's series is bounded by its calendar, so the step per target is one small join
    base = size.join(small(envelope), "donor_set").select(
        "point_id", "year", "period", (F.col("_m") * lift).alias("q"), (F.col("_lo") * lift).alias("q_min"), (F.col("_hi") * lift).alias("q_max"))
    if weights is None:
        return base
    weighted = weights.join(small(scaled.select("gauge", "year", "period", "_s")), "gauge").groupBy("point_id", "year", "period").agg(
        F.sum(F.col("weight") * F.col("_s")).alias("_ws"))
    return base.drop("q").join(weighted, ["point_id", "year", "period"]).join(size.select("point_id", "_at"), "point_id").select(
        "point_id", "year", "period", (F.col("_ws") * lift).alias("q"), "q_min", "q_max")


def leave_one_out(q: DataFrame, donors: DataFrame, b: float = 1.0, weights: DataFrame | None = None) -> DataFrame:
    """Predict each gauge from the other gauges of its set: one job, no loop over gauges.

    The mean of the others is the set total minus the gauge itself.  With ``weights`` (rows of ``donor_weights`` for the
    gauges as targets, themselves among their donors) the weighted total less the gauge's own term is divided by the
    weight left, which is what weights over the other gauges alone would give.  ``baseline`` columns are those of equal
    weights.
    """
    b = check_exponent(b)
    scaled = scaled_donors(q, donors, b)
    total = scaled.groupBy("donor_set", "year", "period").agg(F.sum("_s").alias("_sum"), F.count("*").alias("_n"))
    lift = F.pow("area_km2", F.lit(b))
    pred = scaled.join(total, ["donor_set", "year", "period"]).filter("_n > 1").select(
        "gauge", "year", "period", F.col("q").alias("observed"), lift.alias("_lift"), "_s", ((F.col("_sum") - F.col("_s")) / F.nullif(F.col("_n") - 1, F.lit(0)) * lift).alias("baseline"))
    if weights is None:
        pred = pred.withColumn("predicted", F.col("baseline"))
    else:
        # a set's weights are a square of its few gauges, and its series is bounded by its calendar
        held = weights.select(F.col("point_id").alias("held"), "gauge", "weight")
        own = held.filter("held = gauge").select(F.col("held").alias("gauge"), F.col("weight").alias("_own"))
        sums = held.join(small(scaled.select("gauge", "year", "period", "_s")), "gauge").groupBy(F.col("held").alias("gauge"), "year", "period").agg(F.sum(F.col("weight") * F.col("_s")).alias("_ws"))
        others = (F.col("_ws") - F.col("_own") * F.col("_s")) / F.nullif(1 - F.col("_own"), F.lit(0.0))
        pred = pred.join(small(own), "gauge").join(sums, ["gauge", "year", "period"]).withColumn("predicted", others * F.col("_lift"))
    o, p = F.col("observed"), F.col("predicted")
    agg = pred.groupBy("gauge").agg(
        *[F.sort_array(F.collect_list(c)).alias(f"_{c}") for c in ("observed", "predicted", "baseline")],
        F.sqrt(F.avg((p - o) * (p - o))).alias("rmse"), F.avg(p - o).alias("bias"))
    out = agg.select("gauge", *[weibull_at(F.col(f"_{c}"), 50).alias(f"{c}_q50") for c in ("observed", "predicted", "baseline")], "rmse", "bias")
    known = F.when(F.col("observed_q50") > 0, F.col("observed_q50"))
    miss = lambda c: F.abs(F.col(c) - F.col("observed_q50")) / known * 100
    return out.withColumns({"ape_q50_pct": miss("predicted_q50"), "baseline_ape_q50_pct": miss("baseline_q50")})


# --- similarity ---------------------------------------------------------------------------

def class_distance(targets: DataFrame, donors: DataFrame, shares: DataFrame) -> DataFrame:
    """Half the summed absolute share difference: ``(point_id, gauge, d)``.

    ``1/2 sum|a-b| = (sum a + sum b)/2 - sum min(a, b)``, so only classes both sides
    hold need a join.  ``shares``: ``point_id, class, fraction``.
    """
    t = targets.select("point_id", "donor_set")
    d = donors.select("gauge", "donor_set")
    ts = shares.join(t, "point_id")
    ds = shares.withColumnRenamed("point_id", "gauge").join(small(d), "gauge")
    overlap = ts.select("point_id", "donor_set", "class", F.col("fraction").alias("fa")).join(
        small(ds.select("gauge", "donor_set", "class", F.col("fraction").alias("fb"))), ["donor_set", "class"]).groupBy("point_id", "gauge").agg(
        F.sum(F.least("fa", "fb")).alias("_min"))
    total_t = ts.groupBy("point_id", "donor_set").agg(F.sum("fraction").alias("_ta"))
    total_d = ds.groupBy("gauge", "donor_set").agg(F.sum("fraction").alias("_tb"))
    return total_t.join(small(total_d), "donor_set").join(overlap, ["point_id", "gauge"], "left").select(
        "point_id", "gauge", ((F.col("_ta") + F.col("_tb")) / 2 - F.coalesce("_min", F.lit(0.0))).alias("d"))


def vector_distance(targets: DataFrame, donors: DataFrame, features: DataFrame, group: str) -> DataFrame:
    """Mean of capped scaled differences of an array descriptor (soil or terrain)."""
    scales = SCALES[group]
    t = targets.select("point_id", "donor_set").join(features.select("point_id", F.col("x").alias("xa")), "point_id")
    d = donors.select("gauge", "donor_set").join(features.select(F.col("point_id").alias("gauge"), F.col("x").alias("xb")), "gauge")
    parts = [F.least(F.abs(F.element_at("xa", i) - F.element_at("xb", i)) / s, F.lit(1.0)) for i, s in enumerate(scales, 1)]
    return t.join(small(d), "donor_set").select("point_id", "gauge", (sum(parts[1:], parts[0]) / len(parts)).alias("d"))


def rain_distance(targets: DataFrame, donors: DataFrame, rain: DataFrame) -> DataFrame:
    """Summed absolute difference over summed rain on aligned half-months.

    ``rain``: ``point_id, year, period, mm``.
    """
    t = targets.select("point_id", "donor_set").join(rain, "point_id").withColumnRenamed("mm", "ma")
    d = donors.select("gauge", "donor_set").join(rain.withColumnRenamed("point_id", "gauge"), "gauge").withColumnRenamed("mm", "mb")
    agg = t.join(small(d), ["donor_set", "year", "period"]).groupBy("point_id", "gauge").agg(
        F.sum(F.abs(F.col("ma") - F.col("mb"))).alias("_d"), F.sum(F.col("ma") + F.col("mb")).alias("_t"))
    return agg.select("point_id", "gauge", F.coalesce(F.col("_d") / F.when(F.col("_t") > 0, F.col("_t")), F.lit(0.0)).alias("d"))


def donor_weights(distances: list[DataFrame]) -> DataFrame:
    """Weights ``exp(-d)/sum(exp(-d))`` with d the mean of the chosen group distances."""
    every = distances[0]
    for more in distances[1:]:
        every = every.unionByName(more)
    mean = every.groupBy("point_id", "gauge").agg(F.avg("d").alias("distance")).withColumn("_e", F.exp(-F.col("distance")))
    total = mean.groupBy("point_id").agg(F.sum("_e").alias("_all"))
    return mean.join(total, "point_id").select("point_id", "gauge", "distance", (F.col("_e") / F.col("_all")).alias("weight"))


def pairs_with_distance(targets: DataFrame, donors: DataFrame) -> DataFrame:
    """Target-donor rows of each donor set with their area ratio (the report table)."""
    return targets.select("point_id", "donor_set", F.col("area_km2").alias("_at")).join(
        small(donors.select("gauge", "donor_set", F.col("area_km2").alias("_ad"))), "donor_set").select(
        "point_id", "gauge", (F.col("_at") / F.col("_ad")).alias("area_ratio"))


# --- checks -----------------------------------------------------------------------------------

def model_problems(q: DataFrame, donors: DataFrame, targets: DataFrame) -> DataFrame:
    """Input rules of the model as rows ``(donor_set, subject, reason)``; empty = valid."""
    def rows(df, subject: Column, reason: str):
        return df.select("donor_set", subject.cast("string").alias("subject"), F.lit(reason).alias("reason"))

    dup_d = donors.groupBy("donor_set", "gauge").agg(F.count("*").alias("n")).filter("n > 1")
    dup_t = targets.groupBy("donor_set", "point_id").agg(F.count("*").alias("n")).filter("n > 1")
    sheets = donors.groupBy("donor_set", "sheet").agg(F.count("*").alias("n")).filter("n > 1") if "sheet" in donors.columns else None
    bad_d = donors.filter(F.col("area_km2").isNull() | ~(F.col("area_km2") > 0))
    bad_t = targets.filter(F.col("area_km2").isNull() | ~(F.col("area_km2") > 0))
    no_target = donors.select("donor_set").distinct().join(targets.select("donor_set").distinct(), "donor_set", "left_anti")
    no_years = donors.select("donor_set").distinct().join(common_years(q, donors).select("donor_set").distinct(), "donor_set", "left_anti")
    out = (rows(dup_d, F.col("gauge"), "duplicate_donor").unionByName(rows(dup_t, F.col("point_id"), "duplicate_target"))
           .unionByName(rows(bad_d, F.col("gauge"), "area_not_positive")).unionByName(rows(bad_t, F.col("point_id"), "area_not_positive"))
           .unionByName(rows(no_target, F.lit(None), "no_target")).unionByName(rows(no_years, F.lit(None), "no_common_years")))
    return out if sheets is None else out.unionByName(rows(sheets, F.col("sheet"), "sheet_used_twice"))


def warnings(pairs: DataFrame, years: DataFrame, targets: DataFrame, *, weighted: bool = False, groundwater: DataFrame | None = None) -> DataFrame:
    """Warning codes per target: area ratio outside 0.5-2 of some donor, broken year range, a lone donor that similarity
    cannot weigh (``weighted``), and donors in other or unmapped groundwater basins.

    ``groundwater``: ``point_id, classes`` (array of basin names) of targets and gauges with a map; a place without a row
    is not judged.  None of the codes changes weights or discharge.
    """
    unknown = "Tidak diketahui"  # fixed value
    judged = pairs.withColumns({"_differs": F.lit(None).cast("boolean"), "_unmapped": F.lit(None).cast("boolean")})
    if groundwater is not None:
        named = groundwater.select("point_id", F.array_remove("classes", unknown).alias("_a"))
        judged = pairs.join(named, "point_id", "left").join(small(named.select(F.col("point_id").alias("gauge"), F.col("_a").alias("_b"))), "gauge", "left").withColumns({
            "_unmapped": (F.size("_a") == 0) | (F.size("_b") == 0), "_differs": (F.size("_a") > 0) & (F.size("_b") > 0) & ~F.arrays_overlap("_a", "_b")})
    each = judged.groupBy("point_id").agg(
        F.count_if((F.col("area_ratio") < 0.5) | (F.col("area_ratio") > 2)).alias("donors_outside_ratio"), F.count("*").alias("_donors"),
        F.bool_or(F.col("_differs") & F.col("_a").isNotNull() & F.col("_b").isNotNull() if groundwater is not None else F.col("_differs")).alias("_differs"),
        F.bool_or(F.col("_unmapped") & F.col("_a").isNotNull() & F.col("_b").isNotNull() if groundwater is not None else F.col("_unmapped")).alias("_unmapped"))
    gaps = years.groupBy("donor_set").agg((F.max("year") - F.min("year") + 1 != F.count("*")).alias("_gap"))
    return targets.select("point_id", "donor_set").join(small(gaps), "donor_set", "left").join(each, "point_id", "left").select(
        "point_id", F.coalesce("donors_outside_ratio", F.lit(0)).cast("long").alias("donors_outside_ratio"),
        F.array_join(F.array_compact(F.array(
            F.when(F.col("donors_outside_ratio") > 0, "area_ratio_outside_half_to_double"),
            F.when(F.col("_gap"), "common_years_not_contiguous"),
            F.when((F.col("_donors") == 1) & F.lit(weighted), "one_donor_weight_is_one"),
            F.when(F.col("_differs"), "groundwater_basin_differs"),
            F.when(F.col("_unmapped"), "groundwater_basin_unmapped"))), ",").alias("warnings"))


def extrapolation(targets: DataFrame, donors: DataFrame, features: DataFrame) -> DataFrame:
    """Targets whose descriptor leaves the donors' range: ``(point_id, extrapolates)``."""
    d = donors.select("gauge", "donor_set").join(features.withColumnRenamed("point_id", "gauge"), "gauge")
    span = d.select("donor_set", F.posexplode("x").alias("i", "v")).groupBy("donor_set", "i").agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
    t = targets.select("point_id", "donor_set").join(features, "point_id").select("point_id", "donor_set", F.posexplode("x").alias("i", "v"))
    return t.join(small(span), ["donor_set", "i"]).groupBy("point_id").agg(F.bool_or((F.col("v") < F.col("lo")) | (F.col("v") > F.col("hi"))).alias("extrapolates"))
