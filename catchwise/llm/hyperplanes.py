"""Near-duplicate vectors by random-hyperplane sign hashing in several tables.

Vectors of one label and length are compared. Equal vectors are one *unit*. A unit's signs on ``bits`` random
hyperplanes form its key in each of several tables; the number of bits follows from the size of the largest label, so
that unrelated vectors fill buckets of about ``BUCKET`` units whatever the table's size, and the number of tables
follows from the bits, so that a pair at the threshold shares no bucket with odds under ``MISS``. Pairs of a bucket on
whose 256 further signs too few agree (odds under one in 10^10 at the threshold) are dropped, the others are
compared by exact cosine in double precision; links give components.

Vectors that are null, empty, zero or hold a null, infinite or undefined number link with nothing, as do those without
a label or an id. Every row counts as a vector: repeated rows are linked with each other. Columns of the input other
than the three named are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catchwise.llm.common import side
from catchwise.llm.graph import components
from catchwise.runtime import Cut

BUCKET, MISS, CHECKED = 32, 1e-5, 256
SEED = 4


def valid(vector: str) -> F.Column:
    """The vector is there, finite throughout and not zero."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    return F.coalesce(F.col(vector).isNotNull() & ~bad & F.exists(vector, lambda x: x != 0), F.lit(False))


def tables_for(largest: int, threshold: float) -> tuple[int, int, float]:
    """Bits a key and number of tables for so many units of a label; and the odds that two vectors at the threshold agree on a sign."""
    same = 1 - math.acos(threshold) / math.pi
    bits = max(4, min(62, math.ceil(math.log2(max(largest, 1) / BUCKET + 1))))
    return bits, max(1, math.ceil(math.log(MISS) / math.log1p(-(same**bits)))), same


def _planes(dim: int, n: int) -> np.ndarray:
    return np.random.default_rng([SEED, dim]).normal(size=(n, dim))


def hashed(units: DataFrame, bits: int, tables: int) -> DataFrame:
    """Adds ``keys`` (one long a table) and ``signs`` (four longs of further signs)."""

    def run(batches):
        for batch in batches:
            vectors = [np.asarray(v, dtype=np.float64) for v in batch.column(batch.schema.get_field_index("vector")).to_pylist()]
            keys = np.empty((len(vectors), tables), dtype=np.int64)
            signs = np.empty((len(vectors), CHECKED // 64), dtype=np.int64)
            sizes = np.array([len(v) for v in vectors])
            for dim in np.unique(sizes):
                own = np.flatnonzero(sizes == dim)
                positive = np.array([vectors[i] / np.abs(vectors[i]).max() for i in own]) @ _planes(int(dim), bits * tables + CHECKED).T > 0
                keys[own] = positive[:, : bits * tables].reshape(len(own), tables, bits) @ (1 << np.arange(bits, dtype=np.int64))
                signs[own] = np.packbits(positive[:, bits * tables :], axis=1).view(np.int64)
            added = [pa.array(list(keys), type=pa.list_(pa.int64())), pa.array(list(signs), type=pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *added], names=[*batch.schema.names, "keys", "signs"])

    from pyspark.sql.types import ArrayType, LongType, StructField, StructType

    return units.mapInArrow(run, StructType([*units.schema.fields, StructField("keys", ArrayType(LongType())), StructField("signs", ArrayType(LongType()))]))


def cosine(x: str, y: str) -> F.Column:
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return dot(x, y) / F.sqrt(dot(x, x) * dot(y, y))


def links(units: DataFrame, threshold: float) -> DataFrame:
    """(a, b), each pair of linked units once; ``units`` has unit, label, vector."""
    largest = units.groupBy("label", F.size("vector")).count().agg(F.coalesce(F.max("count"), F.lit(0))).first()[0]
    bits, tables, same = tables_for(largest, threshold)
    most = CHECKED - math.floor(CHECKED * same - 6.5 * math.sqrt(CHECKED * same * (1 - same)))
    keyed = Cut(hashed(units.select("unit", "label", "vector"), bits, tables))
    rows = keyed.df.select("unit", "label", F.size("vector").alias("dim"), "signs", F.posexplode("keys").alias("table", "key"))
    x, y = rows.alias("x"), rows.alias("y")
    differ = sum((F.bit_count(F.get("x.signs", F.lit(i)).bitwiseXOR(F.get("y.signs", F.lit(i)))) for i in range(CHECKED // 64)), F.lit(0))
    met = x.join(y, [F.col(f"x.{c}") == F.col(f"y.{c}") for c in ("label", "dim", "table", "key")] + [F.col("x.unit") < F.col("y.unit"), differ <= most])
    pairs = Cut(met.select(F.col("x.unit").alias("a"), F.col("y.unit").alias("b")).distinct())
    vectors = keyed.df.select("unit", "vector")
    whole = pairs.df.join(vectors.select(F.col("unit").alias("a"), F.col("vector").alias("left")), "a").join(vectors.select(F.col("unit").alias("b"), F.col("vector").alias("right")), "b")
    return whole.filter(cosine("left", "right") >= threshold).select("a", "b")


def groups(df: DataFrame, vec_id: str, vector: str, label: str, threshold: float) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row."""
    rows = df.select(F.col(vec_id).alias("vec_id"), F.col(label).alias("label"), F.col(vector).alias("vector"))
    takes_part = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & valid("vector")
    units = Cut(rows.filter(takes_part).groupBy("label", "vector").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies")).withColumn("unit", F.monotonically_increasing_id()))
    linked = Cut(links(units.df, threshold))
    ends = linked.df.select("a", "b").unionByName(linked.df.select(F.col("b").alias("a"), F.col("a").alias("b")))
    others = ends.join(units.df.select(F.col("unit").alias("b"), "copies"), "b").groupBy("a").agg(F.sum("copies").alias("others"))
    known = units.df.join(others.withColumnRenamed("a", "unit"), "unit", "left").join(components(linked.df).withColumnRenamed("id", "unit"), "unit", "left")
    known = Cut(known.select("label", "vector", "rep", F.coalesce("root", "unit").alias("root"), (F.col("copies") - 1 + F.coalesce("others", F.lit(0))).alias("n_links")))
    smallest = known.df.groupBy("root").agg(F.min("rep").alias("component_id"))
    named = Cut(known.df.join(smallest, "root").select("label", "vector", "n_links", "component_id"))
    out = rows.withColumn("label", F.when(takes_part, F.col("label"))).join(side(named, 2), ["label", "vector"], "left")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id")).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
