"""Tree-based runoff models on Spark ML with hold-out validation."""

from __future__ import annotations

import math
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from catchwise.functions.calendar import depth_from_discharge, discharge_from_depth
from catchwise.operators.stats import fit_metrics
from catchwise.runtime import cut, small, union_all

DYNAMIC = ["p_mm", "et0_mm", "wet_fraction", "days", "p_lag1", "p_lag2", "p_lag3", "p_previous6", "sin_season", "cos_season"]
STATIC = ["smc_mm", "ksat_mm_h", "infiltration", "exposed_fraction", "elevation_m", "slope_pct"]
FEATURES = DYNAMIC + STATIC
LAGS = 6
SEED = 42


def ml_features(climate: DataFrame, static: DataFrame) -> DataFrame:
    """Lagged rain, season and static descriptors; the first six periods are left out.

    The window holds one catchment's half-months, a calendar-bounded group.
    """
    w = W.partitionBy("point_id").orderBy("year", "period")
    angle = 2 * math.pi * F.col("period") / 24
    df = climate.withColumns({
        "_n": F.row_number().over(w), "wet_fraction": F.col("wet_days") / F.col("days"),
        "p_lag1": F.lag("p_mm", 1).over(w), "p_lag2": F.lag("p_mm", 2).over(w), "p_lag3": F.lag("p_mm", 3).over(w),
        "p_previous6": F.sum("p_mm").over(w.rowsBetween(-LAGS, -1)), "sin_season": F.sin(angle), "cos_season": F.cos(angle),
    }).filter(F.col("_n") > LAGS)
    return df.join(small(static), "point_id").select(
        "point_id", "year", "period", "area_km2", F.col("days").alias("n_days"),
        *[F.col(c).cast("double").alias(c) for c in FEATURES])


def samples(features: DataFrame, observed: DataFrame) -> DataFrame:
    """Training rows with runoff depth as target; features are made of observed catchments only."""
    features = features.join(observed.select("point_id").distinct(), "point_id", "left_semi")
    return features.join(observed.filter("q is not null").select("point_id", "year", "period", "q"), ["point_id", "year", "period"]).withColumn(
        "depth_mm", depth_from_discharge(F.col("q"), F.col("area_km2"), F.col("n_days")))


def estimator(algorithm: str, *, trees: int | None = None):
    from pyspark.ml.regression import GBTRegressor, RandomForestRegressor

    if algorithm == "random_forest":
        return RandomForestRegressor(featuresCol="features", labelCol="depth_mm", numTrees=trees or 160, maxDepth=12, minInstancesPerNode=3, seed=SEED)
    if algorithm == "boosted_trees":
        return GBTRegressor(featuresCol="features", labelCol="depth_mm", maxIter=trees or 200, maxDepth=3, stepSize=0.04, seed=SEED)
    raise ValueError("algorithm must be random_forest or boosted_trees")


def _vectors(df: DataFrame) -> DataFrame:
    from pyspark.ml.feature import VectorAssembler

    return VectorAssembler(inputCols=FEATURES, outputCol="features").transform(df)


def train_runoff(train: DataFrame, algorithm: str = "random_forest", *, trees: int | None = None):
    """Fitted model; needs 24 samples. Fitting reads them several times, so they are written once."""
    train = cut(train)
    if train.limit(24).count() < 24:
        raise ValueError("training needs 24 discharge-climate pairs after the six lag periods")
    return estimator(algorithm, trees=trees).fit(_vectors(train))


def predict_runoff(model, features: DataFrame) -> DataFrame:
    """Discharge from predicted depth, floored at zero."""
    out = model.transform(_vectors(features)).withColumn("depth_pred_mm", F.greatest("prediction", F.lit(0.0)))
    q = discharge_from_depth(F.col("depth_pred_mm"), F.col("area_km2"), F.col("n_days"))
    return out.select("point_id", "year", "period", "depth_pred_mm", q.alias("predicted"))


def importances(spark, model) -> DataFrame:
    values = [(n, float(v)) for n, v in zip(FEATURES, model.featureImportances.toArray())]
    return spark.createDataFrame(values, "feature string, importance double")


def folds(train: DataFrame) -> tuple[DataFrame, list[str]]:
    """Fold label per row: each catchment once, or the last quarter of a single one."""
    ids = [r[0] for r in train.select("point_id").distinct().orderBy("point_id").limit(2).collect()]
    if len(ids) > 1:
        return train.withColumn("fold", F.col("point_id")), "leave_one_catchment_out"
    w = W.partitionBy("point_id").orderBy("year", "period")
    n = F.count("*").over(W.partitionBy("point_id"))
    late = F.row_number().over(w) > F.greatest(F.lit(24), F.floor(n * 0.75))
    return train.withColumn("fold", F.when(late, F.col("point_id"))), "temporal_75_25"


def validate(train: DataFrame, algorithm: str = "random_forest", *, trees: int | None = None) -> DataFrame:
    """Hold-out metrics per fold; folds under 24 training or 6 test rows are skipped.

    One model a gauged catchment, several fitted at once so that their stages overlap.
    """
    labelled, scheme = folds(cut(train))
    labelled = cut(labelled)
    total = labelled.count()
    sizes = labelled.filter("fold is not null").groupBy("fold").count().orderBy("fold").collect()

    def held_out(fold: str) -> DataFrame:
        test = labelled.filter(F.col("fold") == fold)
        model = train_runoff(labelled.filter(~F.col("fold").eqNullSafe(F.lit(fold))), algorithm, trees=trees)
        scored = predict_runoff(model, test).join(test.select("point_id", "year", "period", F.col("q").alias("observed")), ["point_id", "year", "period"])
        return cut(fit_metrics(scored, ["point_id"]).withColumn("scheme", F.lit(scheme)))

    with ThreadPoolExecutor(4) as pool:
        results = list(pool.map(held_out, [r["fold"] for r in sizes if r["count"] >= 6 and total - r["count"] >= 24]))
    if not results:
        return fit_metrics(labelled.limit(0).withColumn("predicted", F.lit(0.0)).withColumn("observed", F.lit(0.0)), ["point_id"]).withColumn("scheme", F.lit(scheme))
    return union_all(results)
