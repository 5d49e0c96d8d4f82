"""Whitening of embeddings with distributed block matrices.

Entries become whole numbers ``floor(1024 c) + 100000``, so sums, means and deviations are exact. Rows are centred on the
mean of all vectors, numbered without gaps inside their partition and laid into blocks of ``ROWS`` rows of a
``BlockMatrix``. The transpose times the matrix is the scatter; its middle dimension is split over the session's shuffle
partitions, so partial products meet and not the rows. The scatter, a square of the vector's length, is the only thing
that reaches the driver: ``eigh`` there gives the components, and a second block product projects every row on
components over the roots of their eigenvalues.

Vectors that are null or empty, or hold a null or non-finite entry, are left out, as are vectors with an entry of 2^40 or
more in size, whose whole numbers leave a double. Vectors of different lengths are fitted apart, each length on its
own list (one fit a length). Repeated rows and repeated or null keys are rows like others. A component without variance
(fewer vectors than dimensions, or a single vector) has no whitened value (null), and ``identity_error`` is taken over the
others. A deviation above the range of a long is null. An empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.mllib.linalg import DenseMatrix
from pyspark.mllib.linalg.distributed import BlockMatrix
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from catchwise.runtime import Cut, union_all

#: Rows of a block; a block of 1,024 rows of 768 doubles holds 6 MB.
ROWS = 1024
SCALE, SHIFT, LARGEST = 1024, 100_000, float(2**40)
#: Sums are carried in two parts, so that no sum of longs overflows.
PART = 26
SCHEMA = "component int, n long, deviation long, whitened double, explained double, identity_error double"


def whole(vector: str) -> F.Column:
    """The vector's whole numbers, null if it takes no part."""
    v = F.col(vector).cast("array<double>")
    good = F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < LARGEST)) & (F.size(v) > 0)
    return F.when(good, F.transform(v, lambda c: F.floor(c * SCALE) + SHIFT))


def numbered(rows: Cut, at: str, multiple: int) -> tuple[DataFrame, int]:
    """The cut's rows with ``block`` and ``slot``, and the number of blocks.

    ``at`` is the monotonic id the rows were written with. Blocks never span two written partitions; the sums over
    partitions run on one row a partition.
    """
    part, place = F.shiftright(at, 33), F.col(at).bitwiseAND((1 << 33) - 1)
    counts = rows.df.groupBy(part.alias("part")).agg((F.floor(F.max(place) / multiple) + 1).alias("blocks"))
    first = F.coalesce(F.sum("blocks").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = Cut(counts.select("part", first.alias("first"), "blocks"))
    total = starts.df.agg(F.max(F.col("first") + F.col("blocks"))).first()[0]
    placed = rows.df.withColumn("part", part).join(F.broadcast(starts.df.select("part", "first")), "part")
    return placed.select(*rows.df.columns, (F.col("first") + F.floor(place / multiple)).cast("int").alias("block"), (place % multiple).cast("int").alias("slot")), int(total or 0)


def _sums(rows: DataFrame, size: int) -> tuple[int, list[int]]:
    """Number of rows and the exact sum of every dimension: 2 longs a dimension reach the driver."""
    each = rows.select(F.posexplode("x").alias("pos", "v")).groupBy("pos").agg(
        F.count("*").alias("n"), F.sum(F.shiftright("v", PART)).alias("high"), F.sum(F.col("v").bitwiseAND((1 << PART) - 1)).alias("low"))
    sums = [0] * size
    n = 0
    for r in each.collect():
        n, sums[r.pos] = r.n, (r.high << PART) + r.low
    return n, sums


def scatter(matrix: BlockMatrix, splits: int) -> np.ndarray:
    """The transpose times the matrix, as a local array.

    The middle dimension is dealt over ``splits`` tasks (an argument of the Scala method that its Python form does not
    show): without it every block would go to the one task that owns the single block of the result.
    """
    turned = matrix.transpose()._java_matrix_wrapper
    product = turned.call("multiply", matrix._java_matrix_wrapper._java_model, splits)
    return BlockMatrix(product, matrix.colsPerBlock, matrix.colsPerBlock).toLocalMatrix().toArray()


def axes(covariance: np.ndarray, components: int) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues by falling size and unit eigenvectors as columns; each vector's largest entry is positive."""
    values, vectors = np.linalg.eigh((covariance + covariance.T) / 2)
    values, vectors = values[::-1][:components], vectors[:, ::-1][:, :components]
    largest = np.abs(vectors).argmax(axis=0)
    return values, vectors * np.where(vectors[largest, np.arange(vectors.shape[1])] < 0, -1.0, 1.0)


def _matrix(spark: SparkSession, placed: DataFrame, blocks: int, size: int) -> BlockMatrix:
    """Rows (block, slot, c) as a BlockMatrix; missing slots are zero rows, which add nothing to a scatter."""

    def lay(pdf: pd.DataFrame) -> pd.DataFrame:
        out = np.zeros((ROWS, size))
        out[pdf["slot"].to_numpy()] = np.stack(pdf["c"].to_numpy())
        # column-major, as matrices of the library are
        return pd.DataFrame({"block": pdf["block"].iloc[:1].to_numpy(), "cells": [out.ravel(order="F")]})

    laid = Cut(placed.groupBy("block").applyInPandas(lay, "block int, cells array<double>"))
    pieces = laid.df.rdd.map(lambda r: ((r.block, 0), DenseMatrix(ROWS, size, r.cells)))
    return BlockMatrix(pieces, ROWS, size, blocks * ROWS, size)


def _fit(spark: SparkSession, rows: Cut, size: int, components: int) -> DataFrame:
    n, sums = _sums(rows.df, size)
    means = [s // n for s in sums]
    rests = [s - n * m for s, m in zip(sums, means, strict=True)]
    # n x - S = n (x - m) - rest, with the whole mean m: small numbers wherever the deviation fits a long
    off = F.zip_with("x", F.array(*[F.lit(m) for m in means]).cast("array<long>"), lambda x, m: x - m)
    rest = F.array(*[F.lit(r) for r in rests]).cast("array<long>")
    rough = F.aggregate(F.zip_with("off", rest, lambda o, r: F.pow(o.cast("double") * n - r, F.lit(2.0))), F.lit(0.0), lambda a, d: a + d)
    exact = F.aggregate(F.zip_with("off", rest, lambda o, r: (o * n - r) * (o * n - r)), F.lit(0).cast("long"), lambda a, d: a + d)
    centred = F.zip_with("off", rest, lambda o, r: o - r.cast("double") / n)
    placed, blocks = numbered(rows, "at", ROWS)
    placed = placed.withColumn("off", off)

    splits = int(spark.conf.get("spark.sql.shuffle.partitions"))
    matrix = _matrix(spark, placed.select("block", "slot", centred.alias("c")), blocks, size).cache()
    covariance = scatter(matrix, splits) / n
    values, vectors = axes(covariance, components)
    spread = values > size * np.finfo(float).eps * max(values[0], 0.0)
    weights = np.where(spread, vectors / np.sqrt(np.where(spread, values, 1.0)), 0.0)
    count = len(values)
    turn = BlockMatrix(spark.sparkContext.parallelize([((0, 0), DenseMatrix(size, count, weights.ravel(order="F")))], 1), size, count, size, count)
    projected = matrix.multiply(turn).cache()
    error = np.abs(scatter(projected, splits) / n - np.eye(count))[np.ix_(spread, spread)]
    trace = float(np.trace(covariance))

    def unlay(blocks: Iterator) -> Iterator:
        for (block, _), cells in blocks:
            yield from ((block, slot, y) for slot, y in enumerate(cells.toArray().tolist()))

    y = Cut(spark.createDataFrame(projected.blocks.mapPartitions(unlay), "block int, slot int, y array<double>"))
    facts = [F.struct(F.lit(k + 1).alias("component"), (F.element_at("y", k + 1) if spread[k] else F.lit(None).cast("double")).alias("whitened"),
                      F.lit(float(values[k] / trace) if trace > 0 else None).cast("double").alias("explained")) for k in range(count)]
    joined = placed.select("key", "block", "slot", F.when(rough < 9.2233e18, exact).alias("deviation")).join(y.df, ["block", "slot"])
    return joined.select("key", "deviation", F.explode(F.array(*facts)).alias("f")).select(
        "key", "f.component", F.lit(n).cast("long").alias("n"), "deviation", "f.whitened", "f.explained", F.lit(float(error.max()) if error.size else None).cast("double").alias("identity_error"))


def whiten(df: DataFrame, key: str, vector: str, components: int = 8) -> DataFrame:
    """(key, component, n, deviation, whitened, explained, identity_error), one row a vector and component."""
    spark = df.sparkSession
    rows = Cut(df.select(F.col(key).alias("key"), whole(vector).alias("x")).filter("x is not null").withColumn("at", F.monotonically_increasing_id()))
    sizes = sorted(r[0] for r in rows.df.select(F.size("x")).distinct().collect())
    made = [_fit(spark, rows if len(sizes) == 1 else Cut(rows.df.filter(F.size("x") == s).withColumn("at", F.monotonically_increasing_id())), s, components) for s in sizes]
    empty = spark.createDataFrame([], f"key {df.schema[key].dataType.simpleString()}, {SCHEMA}")
    return (union_all(made) if made else empty).withColumnRenamed("key", key)
