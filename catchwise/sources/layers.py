"""Layer sets, dataset versions and optional sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catchwise.runtime import canonical_columns, require_columns

DEFAULT_DATASET = "current"


def missing_paths(spark: SparkSession, root: str, names: list[str]) -> list[str]:
    """Layer paths that do not exist (any Hadoop file system)."""
    jvm = spark._jvm
    conf = spark._jsparkSession.sessionState().newHadoopConf()
    out = []
    for n in names:
        path = jvm.org.apache.hadoop.fs.Path(f"{root}/{n}.parquet")
        if not path.getFileSystem(conf).exists(path):
            out.append(n)
    return out


def load_layers(spark: SparkSession, root: str, required: dict[str, list[str]]) -> dict[str, DataFrame]:
    """Read every layer of a set, failing once with the full list of missing inputs.

    ``required``: layer name -> columns it must carry; accepted alternative column
    names are renamed first.
    """
    absent = missing_paths(spark, root, list(required))
    if absent:
        raise FileNotFoundError("missing inputs: " + ", ".join(sorted(absent)))
    layers = {n: canonical_columns(spark.read.parquet(f"{root}/{n}.parquet")) for n in required}
    for n, cols in required.items():
        require_columns(layers[n], cols, n)
    return layers


def resolve_dataset(df: DataFrame, explicit: str | None = None, pointer: str | None = None) -> DataFrame:
    """Rows of one dataset version: explicit id, else the pointer, else 'current'.

    A literal filter on the partition column ``dataset_id`` prunes directories.
    """
    chosen = next((v.strip() for v in (explicit, pointer) if v and v.strip()), DEFAULT_DATASET)
    return df.filter(F.col("dataset_id") == chosen)


def optional(df: DataFrame, extra: DataFrame | None, on: str, column: str) -> DataFrame:
    """Left join of an optional source with an ``available`` flag; a missing layer is no error."""
    flag = f"{column}_available"
    if extra is None:
        return df.withColumns({column: F.lit(None), flag: F.lit(False)})
    joined = df.join(extra.select(on, column), on, "left")
    return joined.withColumn(flag, F.col(column).isNotNull())
