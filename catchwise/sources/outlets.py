"""Outlet tables: template headers, decimal commas, range checks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Template headers, compared without case (fixed values)
HEADERS = {"nama titik": "label", "nama sungai": "river_name", "lintang": "lat", "bujur": "lon"}


def ingest_outlets(raw: DataFrame, *, max_points: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Accepted and rejected outlet rows of string columns with the template headers.

    Rows without both coordinates are skipped; a decimal comma is accepted; labels are
    cut to 25 and river names to 160 characters.  ``max_points`` limits the rows of one
    ``file`` where a service needs that; whole files beyond it are rejected, none is cut.
    """
    by_name = {c.strip().lower(): c for c in raw.columns}
    absent = [h for h in HEADERS if h not in by_name]
    if absent:
        raise ValueError("template columns missing: " + ", ".join(absent))
    extra = [c for c in raw.columns if c.strip().lower() not in HEADERS]
    text = {v: F.coalesce(F.trim(F.col(f"`{by_name[h]}`").cast("string")), F.lit("")) for h, v in HEADERS.items()}
    rows = raw.select(*extra, *[t.alias(f"_{n}") for n, t in text.items()]).filter("_lat <> '' or _lon <> ''")
    num = {c: F.replace(F.col(f"_{c}"), F.lit(","), F.lit(".")).try_cast("double") for c in ("lat", "lon")}
    rows = rows.withColumns(num)
    reason = (F.when(F.col("lat").isNull() | F.col("lon").isNull() | F.isnan("lat") | F.isnan("lon"), "not_a_number")
              .when(~F.col("lat").between(-90, 90) | ~F.col("lon").between(-180, 180), "out_of_range"))
    rows = rows.withColumn("reason", reason)
    if max_points is not None:
        big = rows.filter("reason is null").groupBy("file").agg(F.count("*").alias("_n")).filter(F.col("_n") > max_points).select("file", F.lit(True).alias("_big"))
        rows = rows.join(big, "file", "left").withColumn("reason", F.coalesce("reason", F.when(F.col("_big"), "too_many_points"))).drop("_big")
    ok = rows.filter("reason is null").select(*extra, F.substring("_label", 1, 25).alias("label"), F.substring("_river_name", 1, 160).alias("river_name"), "lat", "lon")
    return ok, rows.filter("reason is not null").select(*extra, "reason")
