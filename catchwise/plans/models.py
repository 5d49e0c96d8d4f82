"""Streamflow model runs, dataset comparison and rainfall review."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catchwise.operators import climate as cl
from catchwise.operators import learning as ml
from catchwise.operators import stats as st
from catchwise.operators import transfer as tr
from catchwise.operators import water_balance as wb
from catchwise.runtime import cut
from catchwise.sinks.publish import differences


def area_ratio_model(q: DataFrame, donors: DataFrame, targets: DataFrame, *, b: float = 1.0, distance: Callable[[DataFrame], list[DataFrame]] | None = None, groundwater: DataFrame | None = None) -> dict[str, DataFrame]:
    """Transfer, statistics, dependable flow, volume, validation and warnings; bad input raises first.

    ``distance(points)`` returns the chosen group distances of ``points`` (``point_id, donor_set, area_km2``) to their
    donors, one table ``point_id, gauge, d`` a group; a point without a distance in every group lacks a parameter and
    raises.  Gauges are weighed in the same pass as targets, so that held-out gauges need no second table.
    """
    q = cut(q)
    problem = tr.model_problems(q, donors, targets).limit(1).collect()
    if problem:
        raise ValueError(f"model input: {problem[0]['reason']} {problem[0]['subject'] or ''}")
    weights = held = None
    if distance is not None:
        gauges = donors.select(F.col("gauge").alias("point_id"), "donor_set", "area_km2")
        points = targets.select("point_id", "donor_set", "area_km2").unionByName(gauges)
        groups = [cut(g) for g in distance(points)]
        wanted = tr.pairs_with_distance(points, donors)
        for g in groups:
            lacks = wanted.join(g.filter("d is not null"), ["point_id", "gauge"], "left_anti").limit(1).collect()
            if lacks:
                raise ValueError(f"model input: parameter_missing {lacks[0]['point_id']} {lacks[0]['gauge']}")
        every = cut(tr.donor_weights(groups))
        held = every.join(gauges.select("point_id"), "point_id", "left_semi")
        weights = every.join(gauges.select("point_id"), "point_id", "left_anti")
    flow = cut(tr.transfer(q, donors, targets, b, weights))
    out = {"flow": flow, "statistics": st.series_stats(flow, ["point_id"], bounded=True), "dependable": st.period_stats(flow, "point_id"), "volume": st.volume(flow, "point_id"),
           "validation": tr.leave_one_out(q, donors, b, held),
           "warnings": tr.warnings(tr.pairs_with_distance(targets, donors), tr.common_years(q, donors), targets, weighted=distance is not None, groundwater=groundwater)}
    return out if weights is None else out | {"weights": weights}


def water_balance_model(climate: DataFrame, points: DataFrame, observed: DataFrame | None = None, *, mode: str = "gis", warmup_years: int = 3, bounds: dict | None = None,
                        fit: list[str] | None = None) -> dict[str, DataFrame]:
    """Configure, calibrate where gauged, transfer elsewhere, simulate and compare.

    ``points``: ``point_id, donor_set, area_km2, smc_mm, ksat_mm_h, slope_pct, exposed_fraction, infiltration, k30``.
    """
    climate = cut(climate)
    bad = wb.warmup_problems(climate, warmup_years).limit(1).collect()
    if bad:
        raise ValueError(f"{bad[0]['point_id']}: {bad[0]['reason']}")
    conf = wb.configure(points.select("point_id", F.col("infiltration").alias("gis_infiltration"), F.col("k30").alias("gis_k30")), mode=mode, bounds=bounds, fit=fit)
    static = points.drop(*wb.PARAMETERS)
    params = static.join(conf.select("point_id", *wb.PARAMETERS), "point_id")
    out: dict[str, DataFrame] = {}
    if mode == "auto" and observed is not None:
        usable = wb.after_warmup(climate, warmup_years).select("point_id", "year", "period")
        seen = cut(observed.join(usable, ["point_id", "year", "period"], "left_semi"))
        fitted = cut(wb.calibrate(climate.join(seen.select("point_id").distinct(), "point_id", "left_semi"), seen, params, params, bounds=bounds, fit=fit))
        best = fitted.select("point_id", *[F.col(c).alias(f"fit_{c}") for c in wb.PARAMETERS])
        gauged = params.join(best, "point_id")
        moved = wb.transfer_parameters(params.join(best, "point_id", "left_anti"), gauged, bounds=bounds)
        tuned = fitted.select("point_id", *wb.PARAMETERS).unionByName(moved)
        kept = params.join(tuned.select("point_id", *[F.col(c).alias(f"_t{c}") for c in wb.PARAMETERS]), "point_id", "left")
        params = cut(kept.select(*[c for c in params.columns if c not in wb.PARAMETERS], *[F.coalesce(f"_t{c}", c).alias(c) for c in wb.PARAMETERS]))
        out["fitted"] = fitted
    trace = cut(wb.discharge(wb.after_warmup(wb.mock(climate, params), warmup_years), points))
    out |= {"parameters": params, "trace": trace, "statistics": st.series_stats(trace, ["point_id"], bounded=True), "volume": st.volume(trace, "point_id")}
    if observed is not None:
        out["comparison"] = wb.compare_observed(trace, observed)
    return out


def learning_model(climate: DataFrame, static: DataFrame, observed: DataFrame, *, algorithm: str = "random_forest", trees: int | None = None, gauged: DataFrame | None = None) -> dict[str, DataFrame]:
    """Features, hold-out validation, final model and predictions.

    ``gauged``: the feed of the observed catchments, if it can be made apart from that of all.  Training then reads it
    alone, and the features of all catchments are made when the predictions are asked for.
    """
    feats = ml.ml_features(climate, static)
    if gauged is None:
        feats = cut(feats)
    train = cut(ml.samples(feats if gauged is None else ml.ml_features(gauged, static), observed))
    model = ml.train_runoff(train, algorithm, trees=trees)
    return {"validation": ml.validate(train, algorithm, trees=trees), "flow": ml.predict_runoff(model, feats), "importance": ml.importances(feats.sparkSession, model)}


def compare_versions(results: DataFrame, base: str, other: str) -> DataFrame:
    """Same outlets in two dataset versions: area difference in km2 and percent.

    ``results``: ``dataset_id, point_id, area_km2``; points of one version only keep a NULL side.
    """
    a = results.filter(F.col("dataset_id") == base).select("point_id", F.col("area_km2").alias("base_km2"))
    b = results.filter(F.col("dataset_id") == other).select("point_id", F.col("area_km2").alias("other_km2"))
    diff = F.col("other_km2") - F.col("base_km2")
    return a.join(b, "point_id", "full_outer").withColumns({"difference_km2": diff, "difference_pct": diff / F.nullif(F.col("base_km2"), F.lit(0.0)) * 100.0})


def review_rain(rain: DataFrame, rewritten: DataFrame, n: int = 30) -> dict[str, DataFrame]:
    """Extreme cells, extreme domain means and value differences after a rewrite."""
    return {"cells": cl.top_cells(rain, n), "means": cl.top_domain_means(rain, n), "differences": differences(rain, rewritten)}
