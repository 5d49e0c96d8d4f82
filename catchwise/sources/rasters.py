"""Cell tables: tiles, window scans, point sampling and grid checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TILE = 768
#: multiplier that packs (row, col) into one long key
STRIDE = 1 << 31


def cell_id(row: Column, col: Column) -> Column:
    return row.cast("long") * STRIDE + col.cast("long")


def cell_row(node: Column) -> Column:
    return F.floor(node / STRIDE).cast("int")


def cell_col(node: Column) -> Column:
    return (node % STRIDE).cast("int")


def with_tile(cells: DataFrame) -> DataFrame:
    """Add the tile key that storage is partitioned by."""
    return cells.withColumn("tile", F.concat_ws("_", F.floor(F.col("row") / TILE), F.floor(F.col("col") / TILE)))


def scan_cells(cells: DataFrame, bbox: tuple[float, float, float, float], *, x0: float, y0: float, cell: float) -> DataFrame:
    """Cells whose centre lies in ``bbox`` (xmin, ymin, xmax, ymax); missing values dropped.

    The bounds turn into literal row and column limits, which prune row groups; with
    a ``tile`` column the touched tiles are listed too, which prunes directories.
    """
    xmin, ymin, xmax, ymax = bbox
    c_lo, c_hi = int((xmin - x0) // cell), int((xmax - x0) // cell)
    r_lo, r_hi = int((y0 - ymax) // cell), int((y0 - ymin) // cell)
    out = cells.filter(F.col("row").between(r_lo, r_hi) & F.col("col").between(c_lo, c_hi))
    if "tile" in cells.columns:
        names = [f"{r}_{c}" for r in range(r_lo // TILE, r_hi // TILE + 1) for c in range(c_lo // TILE, c_hi // TILE + 1)]
        out = out.filter(F.col("tile").isin(names))
    ok = F.col("z").isNotNull() & ~F.isnan("z") & (F.abs("z") != float("inf"))
    return out.filter(F.col("x").between(xmin, xmax) & F.col("y").between(ymin, ymax) & ok)


def locate(x: Column, y: Column, x0: float, y0: float, cell: float) -> tuple[Column, Column]:
    """Row and column of a position on a north-up grid."""
    return F.floor((y0 - y) / cell).cast("int"), F.floor((x - x0) / cell).cast("int")


def sample_cells(points: DataFrame, cells: DataFrame, value: str, *, x0: float, y0: float, cell: float, out: str | None = None) -> DataFrame:
    """Cell value under each point; NULL outside the grid."""
    row, col = locate(F.col("x"), F.col("y"), x0, y0, cell)
    keyed = points.withColumns({"_row": row, "_col": col})
    grid = cells.select(F.col("row").alias("_row"), F.col("col").alias("_col"), F.col(value).alias(out or value))
    return keyed.join(grid, ["_row", "_col"], "left").drop("_row", "_col")


def raster_qa(cells: DataFrame) -> DataFrame:
    """Rows per D8 code with a validity flag (codes 1 to 8 only)."""
    return cells.groupBy("d8").agg(F.count("*").alias("cells")).select("d8", "cells", F.coalesce(F.col("d8").between(1, 8), F.lit(False)).alias("valid"))


def grid_alignment(a: DataFrame, b: DataFrame) -> DataFrame:
    """Extent and size of two rasters side by side: ``aligned`` needs all equal."""
    def extent(df, tag):
        return df.agg(F.min("row").alias(f"r0_{tag}"), F.max("row").alias(f"r1_{tag}"), F.min("col").alias(f"c0_{tag}"), F.max("col").alias(f"c1_{tag}"),
                      F.count("*").alias(f"n_{tag}"), F.round(F.min("x"), 6).alias(f"x_{tag}"), F.round(F.max("y"), 6).alias(f"y_{tag}"))
    j = extent(a, "a").join(F.broadcast(extent(b, "b")))
    same = F.lit(True)
    for k in ("r0", "r1", "c0", "c1", "n", "x", "y"):
        same = same & F.col(f"{k}_a").eqNullSafe(F.col(f"{k}_b"))
    return j.withColumn("aligned", same)
