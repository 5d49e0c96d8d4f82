"""Hydrographs, times of concentration and morphometry against published values."""

import pytest
from pyspark.sql import functions as F

from catchwise.operators import concentration as tc
from catchwise.operators import hydrograph as hg
from catchwise.operators import morphometry as mo

GENERIC = dict(A=100.0, L=30.0, Lc=15.0, S=0.01, D=1.5, JN=25.0, SF=0.45, SN=0.55, WF=1.2, RUA=0.35, SIM=0.42)
PUBLISHED = dict(A=147.35, L=24.46, Lc=12.23, S=0.112, D=2.936, JN=263.0, SF=0.529, SN=0.505, WF=1.913, RUA=0.540, SIM=1.038)


def inputs(spark, values):
    return spark.range(1).select(F.lit("a").alias("point_id"), *[F.lit(values.get(c)).cast("double").alias(c) for c in hg.INPUTS])


def test_all_methods_and_common_schema(spark):
    curves = hg.hydrographs(inputs(spark, GENERIC)).collect()
    assert {r.method for r in curves} == set(hg.METHODS)
    for r in curves:
        assert r.available and r.t[0] == 0.0 and r.t == sorted(set(r.t)) and len(r.t) == len(r.q)
        assert r.normalization_factor * r.volume_m3 == pytest.approx(100_000.0)
    gama = next(r for r in curves if r.method == "gama1")
    assert gama.q[-1] == 0.0


def test_published_values(spark):
    r = {c.method: c for c in hg.hydrographs(inputs(spark, PUBLISHED), parameters={"snyder_alexeyev": {"Cp": 0.7}}).collect()}
    assert r["scs"].tp_hours == pytest.approx(6.031, abs=2e-3) and r["scs"].qp_m3s == pytest.approx(5.090, abs=2e-3) and r["scs"].equivalent_mm == pytest.approx(1.016, abs=2e-3)
    assert r["snyder_alexeyev"].tp_hours == pytest.approx(5.529, abs=2e-3) and r["snyder_alexeyev"].qp_m3s == pytest.approx(5.130, abs=2e-3)
    assert r["snyder_alexeyev"].equivalent_mm == pytest.approx(1.004, abs=2e-3)
    assert r["gama1"].tp_hours == pytest.approx(2.427, abs=2e-2) and r["gama1"].qp_m3s == pytest.approx(9.163, abs=2e-2) and r["gama1"].s1 == pytest.approx(3.974, abs=2e-2)
    assert r["itb1b"].s2 == pytest.approx(1.33275, abs=1e-4)


def test_itb1b_published(spark):
    c = hg.hydrographs(inputs(spark, PUBLISHED), methods=["itb1b"]).first()
    assert c.tp_hours == pytest.approx(0.81225 * 24.46 ** 0.6 + 0.5) and c.volume_error_pct == pytest.approx(0, abs=1.0)


def test_missing_inputs_and_interval(spark):
    gap = dict(GENERIC, S=None)
    r = {c.method: c for c in hg.hydrographs(inputs(spark, gap), tr=0.5).collect()}
    assert not r["gama1"].available and r["gama1"].missing == ["S"] and not r["limantara"].available
    assert r["scs"].available and r["scs"].dt_hours == 0.5 and r["scs"].t[1] == 0.5


def test_input_choice_and_overrides(spark):
    cols = ("area_km2 double, main_length_km double, main_lc_km double, main_slope_pct double, flow_length_km double, flow_lc_km double, flow_slope_pct double, source_stream_length_km double, "
            "source_stream_count double, total_stream_length_km double, stream_count double, width_upstream_km double, width_lower_km double, upstream_area_km2 double, drainage_density double, "
            "junction_count double, source_factor double, source_frequency double, width_factor double, relative_upstream_area double, symmetry_factor double")
    tail = (5.0, 4.0, 10.0, 8.0, 2.0, 4.0, 30.0, 0.1, 3.0, 0.5, 0.5, 0.5, 0.3, 0.15)
    df = spark.createDataFrame([("ok", 100.0, 20.0, 10.0, 1.0, 25.0, 12.0, 2.0, *tail), ("bad", 100.0, 5.0, 10.0, 1.0, 132.5, 84.09, 0.745, *tail)], "point_id string, " + cols)
    r = {x.point_id: x for x in hg.resolve_inputs(df).collect()}
    assert (r["ok"].L, r["ok"].Lc, r["ok"].S) == (20.0, 10.0, 0.01)
    assert (r["bad"].L, r["bad"].Lc, r["bad"].S) == (132.5, 84.09, pytest.approx(0.00745))
    edit = spark.createDataFrame([("ok", 50.0, 6.0, -1.0)], "point_id string, A double, WU double, L double")
    e = {x.point_id: x for x in hg.apply_overrides(hg.resolve_inputs(df), edit).collect()}["ok"]
    assert (e.A, e.L, e.D, e.WF, e.RUA, e.SIM) == (50.0, 20.0, 0.2, 1.5, 0.6, pytest.approx(0.9))


def test_time_of_concentration(spark):
    df = spark.createDataFrame([("a", 100.0, 20.0, 1.0, 25.0, 12.0, 300.0, 75.0)],
                               "point_id string, area_km2 double, channel_length_km double, channel_slope_pct double, flow_length_km double, basin_slope_pct double, mean_height_m double, cn double")
    rows = tc.method_rows(tc.time_of_concentration(df)).collect()
    v = {r.method: r for r in rows}
    assert [r.method for r in rows][:4] == ["kirpich", "scs_lag", "nrcs_velocity", "giandotti"] and len(rows) == 12
    assert v["kirpich"].hours == pytest.approx(0.0195 * 20000 ** 0.77 * 0.01 ** -0.385 / 60) and v["kirpich"].status == "Utama"
    assert v["giandotti"].status == "Pembanding" and v["scs_lag"].status == "Kesesuaian terbatas" and v["izzard"].hours is None


def test_response_classes(spark):
    got = spark.createDataFrame([(-1.0,), (-0.5,), (0.0,), (0.5,), (1.0,)], "s double").select(mo.response_label(F.col("s")).alias("c")).collect()
    assert [r.c for r in got] == ["Lambat", "Lambat–Sedang", "Sedang", "Sedang–Cepat", "Cepat"]


def test_shape(spark):
    df = spark.createDataFrame([("a", 2.0, 6.0, 2.0, None, 100.0)], "point_id string, area_km2 double, perimeter_km double, flow_length_km double, main_length_km double, relief_m double")
    r = mo.shape_ratios(df).first()
    assert r.form_factor == 0.5 and r.shape_class == "Agak kompak" and r.relief_ratio == 0.05
