"""Integrity checks and staged publication of tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def content_signature(df: DataFrame) -> DataFrame:
    """Row count and an order-independent hash of the values, whatever the encoding."""
    cols = sorted(df.columns)
    h = F.xxhash64(*[F.col(c).cast("string") for c in cols])
    return df.agg(F.count("*").alias("rows"), F.lit(len(cols)).alias("columns"), F.bit_xor(h).alias("xor_hash"), F.sum(h.cast("decimal(38,0)")).alias("sum_hash"))


def differences(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows present on one side only, duplicates counted: ``side`` a or b."""
    if sorted(a.columns) != sorted(b.columns):
        raise ValueError("columns differ")
    b = b.select(*a.columns)
    return a.exceptAll(b).withColumn("side", F.lit("a")).unionByName(b.exceptAll(a).withColumn("side", F.lit("b")))


def assert_same(a: DataFrame, b: DataFrame) -> None:
    """Raise when a rewrite changed rows, columns or values."""
    if differences(a, b).limit(1).count():
        raise AssertionError("tables differ")


def publish(df: DataFrame, path: str, *, partition_by: list[str] | None = None) -> str:
    """Write beside the target, then swap folders; the old version goes only after the swap.

    The swap is two renames: atomic each on a file system, copies on most object stores, where a
    table format with its own commit is the better choice.
    """
    spark = df.sparkSession
    staging, backup = f"{path}__staging_{uuid.uuid4().hex}", f"{path}__backup_{uuid.uuid4().hex}"
    writer = df.write.mode("errorifexists")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(staging)
    jvm = spark._jvm
    p = {k: jvm.org.apache.hadoop.fs.Path(v) for k, v in (("t", path), ("s", staging), ("b", backup))}
    fs = p["t"].getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    had = fs.exists(p["t"])
    if had and not fs.rename(p["t"], p["b"]):
        raise OSError(f"cannot move {path} aside")
    if not fs.rename(p["s"], p["t"]):
        if had:
            fs.rename(p["b"], p["t"])
        raise OSError(f"cannot publish {path}")
    if had:
        fs.delete(p["b"], True)
    return path


def dataset_qa(links: DataFrame, subbasins: DataFrame, cycles: DataFrame, resolved: DataFrame, id_problems: DataFrame, supported: DataFrame) -> DataFrame:
    """One row of dataset counts and a PASS or FAIL status.

    Each input is aggregated to one row of its own before they meet.
    """
    def one(df, *aggs):
        return df.agg(*aggs).withColumn("_j", F.lit(1))

    parts = [
        one(links, F.count("*").alias("streams_raw")), one(subbasins, F.count("*").alias("subbasins")),
        one(resolved, F.count("*").alias("streams_runtime"), F.count_if(F.col("downstream_id").isNull() & ~F.col("broken")).alias("network_outlets"), F.count_if("broken").alias("broken_downstream")),
        one(cycles, F.count_if(F.col("kind") == "loop").alias("topology_cycles"), F.count_if(F.col("kind") == "self").alias("self_references")),
        one(id_problems, F.count("*").alias("id_problems")), one(supported, F.count_if("supported").alias("supported_basins")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.join(F.broadcast(p), "_j")
    bad = F.col("broken_downstream") + F.col("topology_cycles") + F.col("self_references") + F.col("id_problems")
    return out.drop("_j").withColumns({"connectors": F.col("streams_raw") - F.col("streams_runtime"), "status": F.when(bad == 0, "PASS").otherwise("FAIL")})
