"""Discharge, rainfall, transfer, soil and water balance against hand values."""

import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from catchwise.operators import climate as cl
from catchwise.operators import learning as ml
from catchwise.operators import soil as so
from catchwise.operators import stats as st
from catchwise.operators import transfer as tr
from catchwise.operators import water_balance as wb
from catchwise.operators.ordered import quantiles
from catchwise.plans.models import water_balance_model
from catchwise.sources.discharge import ingest_discharge, strict, upload_statistics

# Monthly water balance of a published spreadsheet: days, rain, wet days, ET, soil, recharge,
# groundwater, base flow, direct flow, runoff (fixed values)
MONTHS = [
    (31, 218.67079497907943, 31, 134.22612500000002, 51.0, 54.88903548640162, 84.79455072764117, 70.09448475876044, 29.55563449267779, 99.65011925143824),
    (28, 635.3933054393302, 28, 115.24799999999999, 51.0, 338.0944485355647, 283.27602301572296, 139.61297624748292, 182.05085690376558, 321.66383315124847),
    (31, 432.32853556485327, 31, 121.80519999999999, 51.0, 201.84016811715463, 273.80833224201245, 211.30785889086513, 108.68316744769862, 319.99102633856376),
    (30, 186.4040167364016, 30, 120.39600000000002, 51.0, 42.90521087866102, 154.32002739593486, 162.39351572473862, 23.10280585774055, 185.49632158247917),
    (31, 186.51815899581587, 31, 131.82207499999998, 51.0, 35.552454597280324, 95.21954191119892, 94.65294008201627, 19.14362939853556, 113.79656948055182),
    (30, 96.97154811715477, 30, 115.44299999999998, 32.5285481171548, 0.0, 42.848793860039514, 52.3707480511594, 0.0, 52.3707480511594),
    (31, 7.638912133891213, 31, 130.62005, 0.0, 0.0, 19.28195723701778, 23.566836623021732, 0.0, 23.566836623021732),
]


def climate_rows(points=("a",), years=4, start=2000):
    rows = []
    for p in points:
        for y in range(start, start + years):
            for k in range(24):
                first = dt.date(y, k // 2 + 1, 1 if k % 2 == 0 else 16)
                end = first.replace(day=15) if k % 2 == 0 else (first.replace(day=28) + dt.timedelta(days=4)).replace(day=1) - dt.timedelta(days=1)
                days = [(first + dt.timedelta(days=i)).timetuple().tm_yday for i in range((end - first).days + 1)]
                rain = [6 + 5 * math.cos(2 * math.pi * d / 365) for d in days]
                rows.append((p, y, k, len(days), sum(rain), 3.0 * len(days), sum(r >= 1 for r in rain)))
    return rows


CLIMATE = "point_id string, year int, period int, days int, p_mm double, et0_mm double, wet_days int"
PARAMS = "point_id string, smc_mm double, exposed_fraction double, smc_multiplier double, infiltration double, k30 double"


def test_spreadsheet_months(spark):
    soil, ground, clim, par = 51.0, 100.0, [], []
    for i, m in enumerate(MONTHS):
        clim.append((f"m{i}", 2003, 0, m[0], m[1], m[3], m[2]))
        par.append((f"m{i}", 51.0, 0.0, 1.0, 0.65, 0.45 ** (30 / m[0]), soil, ground))
        soil, ground = m[4], m[6]
    got = wb.mock(spark.createDataFrame(clim, CLIMATE), spark.createDataFrame(par, PARAMS + ", initial_soil_mm double, initial_groundwater_mm double")).orderBy("point_id").collect()
    for r, m in zip(got, MONTHS):
        assert (r.soil_mm, r.recharge_mm, r.groundwater_mm, r.baseflow_mm, r.direct_mm, r.runoff_mm) == pytest.approx(m[4:], abs=1e-10)
        assert abs(r.balance_error_mm) < 1e-10


def test_mass_balance_and_lengths(spark):
    rows = climate_rows(("a", "b")) + climate_rows(("c",), years=2)
    par = [(p, 120.0, 0.25, 1.0, 0.55, 0.6) for p in "abc"]
    got = wb.mock(spark.createDataFrame(rows, CLIMATE), spark.createDataFrame(par, PARAMS)).collect()
    assert len(got) == len(rows) and max(abs(r.balance_error_mm) for r in got) < 1e-10 and max(r.soil_mm for r in got) <= 120
    feb = [r.days for r in got if r.point_id == "a" and r.year == 2000 and r.period == 3]
    assert feb == [14]


def test_parameter_checks_and_warmup(spark):
    bad = spark.createDataFrame([("x", -1.0, 0.2, 1.0, 0.5, 0.5), ("y", 10.0, 0.2, 1.0, 1.5, 0.5), ("z", 10.0, 0.2, 1.0, 0.5, 1.0), ("ok", 10.0, 0.2, 1.0, 0.5, 0.5)], PARAMS)
    assert {r.point_id: r.reason for r in wb.parameter_problems(bad).collect()} == {"x": "capacity_not_positive", "y": "infiltration_outside_0_1", "z": "k30_outside_0_1"}
    clim = spark.createDataFrame(climate_rows(years=2), CLIMATE)
    assert wb.warmup_problems(clim, 1).count() == 0 and wb.warmup_problems(clim, 2).first().reason == "no_output_period"
    assert wb.warmup_problems(clim.filter("period <> 5"), 1).first().reason == "warmup_incomplete"


def test_calibration_recovers_synthetic_truth(spark):
    clim = spark.createDataFrame(climate_rows(("a", "b"), years=4), CLIMATE)
    pts = spark.createDataFrame([("a", 0, 100.0, 120.0, 8.0, 10.0, 0.25, 0.4, 0.5), ("b", 0, 50.0, 90.0, 6.0, 12.0, 0.2, 0.4, 0.5)],
                                "point_id string, donor_set int, area_km2 double, smc_mm double, ksat_mm_h double, slope_pct double, exposed_fraction double, infiltration double, k30 double")
    truth = pts.filter("point_id = 'a'").select("point_id", "smc_mm", "exposed_fraction", F.lit(1.2).alias("smc_multiplier"), F.lit(0.7).alias("infiltration"), F.lit(0.8).alias("k30"))
    obs = wb.discharge(wb.mock(clim, truth), pts).select("point_id", "year", "period", "q")
    out = water_balance_model(clim, pts, obs, mode="auto")
    fit = out["fitted"].first()
    assert fit.sse < 1e-3 and fit.infiltration == pytest.approx(0.7, abs=0.05) and fit.k30 == pytest.approx(0.8, abs=0.05)
    p = {r.point_id: r for r in out["parameters"].collect()}
    assert p["b"].k30 == pytest.approx(0.5 + fit.k30 - 0.5) and p["b"].infiltration == pytest.approx(fit.infiltration)
    assert out["comparison"].first().nse > 0.999


def test_configuration_modes(spark):
    pts = spark.createDataFrame([("a", 0.5, 0.99)], "point_id string, gis_infiltration double, gis_k30 double")
    over = spark.createDataFrame([("a", 3.0)], "point_id string, smc_multiplier double")
    auto = wb.configure(pts, mode="auto", overrides=over).first()
    assert (auto.smc_multiplier, auto.k30, auto.clipped) == (2.0, 0.98, "smc_multiplier,k30")
    assert wb.configure(pts, mode="gis", overrides=over).first().smc_multiplier == 1.0
    with pytest.raises(ValueError):
        wb.configure(pts, mode="other")


def test_quantiles_by_weibull(spark):
    df = spark.createDataFrame([("a", float(i)) for i in range(1, 13)] + [("b", 1.0)], "k string, q double")
    got = {(r.k, round(r.prob, 2)): r.q for r in quantiles(df, ["k"], "q", [0.1, 0.05], weibull=True).collect()}
    assert got[("a", 0.1)] == pytest.approx(1.3) and got[("b", 0.05)] is None
    s = st.series_stats(df, ["k"], bounded=True).filter("k = 'a'").first()
    t = st.series_stats(df, ["k"]).filter("k = 'a'").first()
    assert s.q90 == pytest.approx(1.3) == pytest.approx(t.q90) and s.median == t.median == 6.5


def test_record_rules(spark):
    good = [1.0] * 24
    rows = [("a", 2020.0, good), ("a", 2021.0, good), ("a", 2021.0, good), ("b", 2020.5, good), ("c", 2020.0, good[:5]), ("d", 2020.0, [None] + good[1:]), ("e", 2020.0, [-1.0] + good[1:]), ("f", 999.0, good), ("g", None, [None] * 24)]
    df = spark.createDataFrame(rows, "gauge string, year double, v array<double>")
    ok, bad = ingest_discharge(df)
    assert {(r.gauge, r.reason) for r in bad.collect()} == {("a", "year_duplicate"), ("b", "year_invalid"), ("c", "not_24_periods"), ("d", "value_missing"), ("e", "value_invalid"), ("f", "year_invalid")}
    assert ok.count() == 24
    with pytest.raises(ValueError):
        strict(ok, bad)
    one = spark.createDataFrame([("a", 2020.0, [4.0, 0.0, 2.0] + [None] * 21)], "gauge string, year double, v array<double>")
    kept, _ = ingest_discharge(one, allow_missing=True)
    u, s = upload_statistics(kept).first(), st.series_stats(kept, ["gauge"], bounded=True).first()
    assert (u.observed, u.missing_count) == (3, 21) and (s.zero_count, s.min, s.max, s["mean"], s.median, s.std, s.cv, s.q50) == (1, 0.0, 4.0, 2.0, 2.0, 2.0, 1.0, 2.0)


def test_transfer_weights_and_volume(spark):
    q = spark.createDataFrame([("A", y, p, 10.0) for y in (2020, 2021) for p in range(24)] + [("B", 2021, p, 30.0) for p in range(24)], "gauge string, year int, period int, q double")
    one = spark.createDataFrame([("A", 0, 100.0)], "gauge string, donor_set int, area_km2 double")
    two = spark.createDataFrame([("A", 0, 100.0), ("B", 0, 100.0)], "gauge string, donor_set int, area_km2 double")
    target = spark.createDataFrame([("T", 0, 200.0)], "point_id string, donor_set int, area_km2 double")
    flow = tr.transfer(q, one, target)
    assert {r.q for r in flow.collect()} == {20.0}
    assert st.volume(flow.filter("year = 2020"), "point_id").first().volume_m3 == 20 * 366 * 86400
    assert [r.year for r in tr.common_years(q, two).collect()] == [2021]
    shares = spark.createDataFrame([("T", "x", 1.0), ("A", "x", 1.0), ("B", "y", 1.0)], "point_id string, class string, fraction double")
    w = {r.gauge: r.weight for r in tr.donor_weights([tr.class_distance(target, two, shares)]).collect()}
    assert w["A"] == pytest.approx(1 / (1 + math.exp(-1))) and sum(w.values()) == pytest.approx(1)
    loo = {r.gauge: r for r in tr.leave_one_out(q, two).collect()}
    assert loo["A"].predicted_q50 == pytest.approx(30.0) and loo["A"].ape_q50_pct == pytest.approx(200.0)
    with pytest.raises(ValueError):
        tr.transfer(q, one, target, 3.5)


def test_weighted_leave_one_out_equals_weights_over_the_others(spark):
    import random

    rnd = random.Random(4)
    flows = {g: [rnd.uniform(1, 50) for _ in range(48)] for g in "ABCD"}
    areas = {"A": 100.0, "B": 150.0, "C": 80.0, "D": 300.0}
    apart = {(g, h): 0.0 if g == h else rnd.uniform(0.1, 2) for g in "ABCD" for h in "ABCD"}
    q = spark.createDataFrame([(g, 2020 + i // 24, i % 24, v) for g, vs in flows.items() for i, v in enumerate(vs)], "gauge string, year int, period int, q double")
    donors = spark.createDataFrame([(g, 0, a) for g, a in areas.items()], "gauge string, donor_set int, area_km2 double")
    d = spark.createDataFrame([(g, h, v) for (g, h), v in apart.items()], "point_id string, gauge string, d double")
    got = {r.gauge: r for r in tr.leave_one_out(q, donors, 0.8, tr.donor_weights([d])).collect()}
    for g in "ABCD":
        others = [h for h in "ABCD" if h != g]
        e = [math.exp(-apart[g, h]) for h in others]
        lifted = [[flows[h][i] * (areas[g] / areas[h]) ** 0.8 for h in others] for i in range(48)]
        made = [sum(w * v for w, v in zip(e, row, strict=True)) / sum(e) for row in lifted]
        median = lambda v: (sorted(v)[23] + sorted(v)[24]) / 2
        assert got[g].predicted_q50 == pytest.approx(median(made)) and got[g].baseline_q50 == pytest.approx(median([sum(r) / 3 for r in lifted]))
        assert got[g].bias == pytest.approx(sum(m - o for m, o in zip(made, flows[g], strict=True)) / 48)
        assert got[g].baseline_ape_q50_pct == pytest.approx(abs(got[g].baseline_q50 - median(flows[g])) / median(flows[g]) * 100)


def test_groundwater_changes_warnings_only(spark):
    from catchwise.plans import models as pm

    q = spark.createDataFrame([(g, 2020, p, v) for g, v in (("A", 10.0), ("B", 30.0)) for p in range(24)], "gauge string, year int, period int, q double")
    donors = spark.createDataFrame([("A", 0, 100.0), ("B", 0, 100.0)], "gauge string, donor_set int, area_km2 double")
    targets = spark.createDataFrame([("C", 0, 100.0), ("D", 0, 100.0), ("E", 0, 100.0)], "point_id string, donor_set int, area_km2 double")
    shares = spark.createDataFrame([("A", "x", 1.0), ("B", "y", 1.0), ("C", "x", 1.0), ("D", "y", 1.0), ("E", "x", 1.0)], "point_id string, class string, fraction double")
    ground = spark.createDataFrame([("A", ["a"]), ("B", ["a", "b"]), ("C", ["c"]), ("D", ["Tidak diketahui"])], "point_id string, classes array<string>")
    by_class = lambda points: [tr.class_distance(points, donors, shares)]
    plain, told = pm.area_ratio_model(q, donors, targets, distance=by_class), pm.area_ratio_model(q, donors, targets, distance=by_class, groundwater=ground)
    key = lambda df: sorted(map(tuple, df.collect()))
    assert key(plain["flow"]) == key(told["flow"]) and key(plain["weights"]) == key(told["weights"])
    assert {r.point_id: r.warnings for r in told["warnings"].collect()} == {"C": "groundwater_basin_differs", "D": "groundwater_basin_unmapped", "E": ""}
    means = {r.point_id: r["mean"] for r in told["statistics"].collect()}
    assert means["C"] == pytest.approx((10 * math.e + 30) / (1 + math.e)) and means["C"] < means["D"]
    one = pm.area_ratio_model(q.filter("gauge = 'A'"), donors.filter("gauge = 'A'"), targets, distance=lambda p: [tr.class_distance(p, donors.filter("gauge = 'A'"), shares)])
    assert {r.warnings for r in one["warnings"].collect()} == {"one_donor_weight_is_one"} and one["validation"].count() == 0
    with pytest.raises(ValueError, match="parameter_missing E"):
        pm.area_ratio_model(q, donors, targets, distance=lambda p: [tr.class_distance(p, donors, shares.filter("point_id <> 'E'"))])


def test_rain_distance(spark):
    t = spark.createDataFrame([("T", 0)], "point_id string, donor_set int")
    d = spark.createDataFrame([("G", 0)], "gauge string, donor_set int")
    for a, b, want in (((0, 0), (0, 0), 0.0), ((0, 10), (10, 0), 1.0), ((10, 10), (20, 20), 1 / 3)):
        rain = spark.createDataFrame([("T", 2000, i, float(v)) for i, v in enumerate(a)] + [("G", 2000, i, float(v)) for i, v in enumerate(b)], "point_id string, year int, period int, mm double")
        assert tr.rain_distance(t, d, rain).first().d == pytest.approx(want)


def test_areal_rain_missing_is_not_zero(spark):
    w = spark.createDataFrame([("a", 0, 0.2), ("a", 1, 0.8)], "point_id string, cell int, w double")
    area = spark.createDataFrame([("a", 1.0)], "point_id string, area double")
    rain = spark.createDataFrame([(0, 0, 10.0), (0, 1, 30.0), (1, 0, 10.0), (1, 1, None)], "t int, cell int, mm double")
    r = {x.t: x for x in cl.areal_rain(rain, w, area, ["t"]).collect()}
    assert r[0].mm == pytest.approx(26.0) and r[1].mm == 10.0 and r[1].coverage == pytest.approx(0.2)
    ok, bad = cl.split_coverage(cl.areal_rain(rain, w, area, ["t"]))
    assert ok.count() == 1 and bad.count() == 1


def test_pedotransfer_cell(spark):
    cell = spark.createDataFrame([(0, 0, 0, 400.0, 350.0, 250.0, 130.0, 100.0, 200.0, 300.0, 150.0)],
                                 "row int, col int, depth_idx int, sand double, silt double, clay double, bd double, coarse double, carbon double, swc0033 double, swc1500 double")
    r = so.pedotransfer(cell).first()
    s, t, c, bd, oc = 40, 35, 25, 1.3, 2.0
    eq = sorted(v * 10 / 24 for v in (
        60.96 * 10 ** (-0.884 + 0.0153 * s), 60.96 * 10 ** (-0.6 + 0.0126 * s - 0.0064 * c), math.exp(1.9582 + 0.0308 * s - 0.6142 * bd - 0.01566 * oc),
        math.exp(7.755 + 0.0352 * t + 0.93 - 0.967 * bd**2 - 0.000484 * c**2 - 0.000322 * t**2 + 0.001 / t - 0.129 / oc - 0.643 * math.log(t) - 0.01398 * bd * c - 0.0973 * bd * oc + 0.02986 * c - 0.03305 * t)))
    assert r.valid and r.awc == pytest.approx(0.135) and r.ksat == pytest.approx((eq[1] + eq[2]) / 2)


def test_recession_prior(spark):
    pts = spark.createDataFrame([("a",)], "point_id string")
    sh = spark.createDataFrame([("a", "lithology", "Endapan Lepas", 1.0, 1.0), ("a", "aquifer", "Produktif Tinggi", 1.0, 1.0)], "point_id string, layer string, class string, fraction double, coverage double")
    r = so.recession_prior(pts, sh).first()
    assert r.tau_days == pytest.approx(90 * (0.75 + 0.5 * 0.9)) and r.k30 == pytest.approx(math.exp(-30 / r.tau_days))


def test_learning_features_and_holdout(spark):
    clim = spark.createDataFrame(climate_rows(("a", "b"), years=3), CLIMATE)
    static = spark.createDataFrame([(p, 100.0, 120.0, 8.0, 0.5, 0.2, 300.0, 10.0) for p in "ab"],
                                   "point_id string, area_km2 double, smc_mm double, ksat_mm_h double, infiltration double, exposed_fraction double, elevation_m double, slope_pct double")
    feats = ml.ml_features(clim, static)
    assert feats.count() == 2 * (72 - 6)
    obs = clim.select("point_id", "year", "period", (F.col("p_mm") / 50).alias("q"))
    train = ml.samples(feats, obs)
    for algorithm in ("random_forest", "boosted_trees"):
        v = ml.validate(train, algorithm, trees=3).collect()
        assert {r.point_id for r in v} == {"a", "b"} and all(r.scheme == "leave_one_catchment_out" and r.nse > 0.5 for r in v)
    model = ml.train_runoff(train, trees=3)
    assert ml.predict_runoff(model, feats).filter("predicted < 0").count() == 0
    assert ml.importances(spark, model).count() == 16


def _counted(df, seen):
    """The frame with every row added to ``seen`` each time the frame is computed."""
    def run(batches):
        for b in batches:
            seen.add(len(b))
            yield b
    return df.mapInPandas(run, df.schema)


def test_calibration_computes_the_feed_once(spark):
    steps = [("P1", 2000 + i // 24, i % 24, 15, 40.0 + 30 * (i % 5), 50.0, 5) for i in range(48)]
    schema = "point_id string, year int, period int, days int, p_mm double, et0_mm double, wet_days int"
    seen, feed = spark.sparkContext.accumulator(0), spark.createDataFrame(steps, schema)
    points = spark.createDataFrame([("P1", 100.0, 0.1, 50.0, 1.0, 0.4, 0.5)], "point_id string, smc_mm double, exposed_fraction double, area_km2 double, smc_multiplier double, infiltration double, k30 double")
    observed = feed.select("point_id", "year", "period", (F.col("p_mm") / 20).alias("q"))
    out = wb.calibrate(_counted(feed, seen), observed, points, points, steps=3, rounds=2)
    assert out.count() == 1 and seen.value == 48


def test_training_computes_its_samples_once(spark):
    rows = spark.range(60).select(F.lit("P1").alias("point_id"), (2000 + F.expr("id div 24")).cast("int").alias("year"), (F.col("id") % 24).cast("int").alias("period"), F.lit(10.0).alias("area_km2"), F.lit(15).alias("n_days"),
                                  *[((F.col("id") * (i + 3)) % 17).cast("double").alias(c) for i, c in enumerate(ml.FEATURES)], F.col("id").cast("double").alias("depth_mm"), F.col("id").cast("double").alias("q"))
    seen = spark.sparkContext.accumulator(0)
    ml.train_runoff(_counted(rows, seen), trees=2)
    assert seen.value == 60
    seen = spark.sparkContext.accumulator(0)
    assert ml.validate(_counted(rows, seen), trees=2).count() == 1 and seen.value == 60


def test_preview_returns_the_recession_prior(spark, sf):
    from catchwise import catalog

    rows = {r.point_id: r for r in catalog.queries()["r9_parameter_preview"](spark, sf).collect()}
    tau = 90 * (0.75 + 0.5 * (0.9 + 0.4) / 2)
    assert rows["B0"].prior_available and (rows["B0"].tau_days, rows["B0"].k30) == pytest.approx((tau, math.exp(-30 / tau)), abs=1e-6)
    assert rows["B0"].reason is None or rows["B0"].smc_mm is None
