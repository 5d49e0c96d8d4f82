"""Session-level helpers: lineage cuts, size-checked broadcasts, column checks."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

#: A table is broadcast only while a cautious estimate of its rows in memory stays under this.
BROADCAST_LIMIT_BYTES = 32 * 1024 * 1024
#: Catalyst estimates from the bytes of files; rows take up to about so many times that in memory.
COMPRESSION = 8
STATIC, MEASURED = "spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"

_local_roots: dict[str, str] = {}


def scratch_root(spark: SparkSession) -> str:
    """Shared folder for cut tables: ``spark.checkpoint.dir`` of the session.

    Only a local-mode session without that setting gets a folder of its own;
    on a cluster a machine-local folder would not survive an executor.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    app = spark.sparkContext.applicationId
    if app not in _local_roots:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a shared folder on a cluster")
        _local_roots[app] = tempfile.mkdtemp(prefix="catchwise-")
        atexit.register(shutil.rmtree, _local_roots[app], ignore_errors=True)
    return _local_roots[app]


class Cut:
    """A frame written to the scratch folder and read back with short lineage.

    ``block_bytes`` bounds row groups where rows are megabytes long: Parquet else looks at sizes every hundred rows only,
    writers hold that many, and a reader decodes a whole row group at once.
    """

    def __init__(self, df: DataFrame, count_if: Column | None = None, compression: str | None = None, block_bytes: int | None = None):
        self.spark = df.sparkSession
        self.path = f"{scratch_root(self.spark)}/catchwise/{uuid.uuid4().hex}"
        schema = df.schema
        watch = None
        if count_if is not None:
            # counted while the rows are written, so no second job is needed
            watch = Observation(uuid.uuid4().hex)
            df = df.observe(watch, F.count(F.when(count_if, 1)).alias("n"))
        blocks = {"parquet.block.size": block_bytes, "parquet.page.size.row.check.min": 1} if block_bytes else {}
        df.write.options(**blocks).parquet(self.path, compression=compression)
        self.count = watch.get["n"] if watch is not None else None
        self.df = self.spark.read.schema(schema).parquet(self.path)

    def drop(self) -> None:
        """Remove the files once a later cut has replaced them."""
        jvm = self.spark._jvm
        target = jvm.org.apache.hadoop.fs.Path(self.path)
        target.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()).delete(target, True)


def cuts(*jobs: tuple[DataFrame, Column | None]) -> list[Cut]:
    """Several independent cuts at once, so their stages overlap."""
    with ThreadPoolExecutor(len(jobs)) as pool:
        return list(pool.map(lambda job: Cut(*job), jobs))


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the scratch folder; later plans start from the files."""
    return Cut(df).df


_given: dict[str, tuple[str, str | None]] = {}


def measured_broadcasts(spark: SparkSession, on: bool = True) -> None:
    """Let joins broadcast by measured sizes only, or (``on=False``) give the session its settings back.

    Before anything has run, Catalyst takes compressed files for rows and an exploded row for one
    row, and would send tables of millions of rows through the driver. The session's own
    threshold then holds for the bytes that a shuffle has counted; hinted broadcasts stay.
    """
    key = str(spark._jsparkSession.hashCode())
    if on and spark.conf.get(STATIC) != "-1":
        static, measured = spark.conf.get(STATIC), spark.conf.get(MEASURED, None)
        _given[key] = static, measured
        spark.conf.set(MEASURED, measured or static)
        spark.conf.set(STATIC, "-1")
    elif not on and key in _given:
        static, measured = _given.pop(key)
        if spark.conf.get(STATIC) != "-1":
            return  # set anew in the meantime
        spark.conf.set(STATIC, static)
        spark.conf.set(MEASURED, measured) if measured else spark.conf.unset(MEASURED)


def fits_broadcast(df: DataFrame, limit: int = BROADCAST_LIMIT_BYTES) -> bool:
    """True when Catalyst's size estimate proves the frame small enough to send.

    Exploded rows are not in that estimate, so a plan that explodes proves nothing.
    """
    plan = df._jdf.queryExecution().optimizedPlan()
    return int(str(plan.stats().sizeInBytes())) * COMPRESSION <= limit and "Generate " not in plan.toString()


def small(df: DataFrame, limit: int = BROADCAST_LIMIT_BYTES) -> DataFrame:
    """Hint a broadcast behind the size check; otherwise leave the join to AQE."""
    return F.broadcast(df) if fits_broadcast(df, limit) else df


def require_columns(df: DataFrame, names: list[str], what: str = "input") -> DataFrame:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"{what}: missing columns {', '.join(missing)}")
    return df


#: Alternative column names accepted in source tables (fixed values).
COLUMN_ALIASES = {
    "linkno": ["LINKNO"],
    "downstream_id": ["DSLINKNO", "downstream_linkno"],
    "us1": ["USLINKNO1", "upstream_linkno1"],
    "us2": ["USLINKNO2", "upstream_linkno2"],
    "strm_order": ["strmOrder"],
    "slope": ["Slope"],
    "length_m": ["Length"],
}


def canonical_columns(df: DataFrame) -> DataFrame:
    """Rename accepted alternative column names to the canonical ones."""
    for name, alternatives in COLUMN_ALIASES.items():
        if name in df.columns:
            continue
        for other in alternatives:
            if other in df.columns:
                df = df.withColumnRenamed(other, name)
                break
    return df


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), frames)


def nan_to_null(df: DataFrame) -> DataFrame:
    """Missing is NULL, never NaN and never zero."""
    from pyspark.sql.types import DoubleType, FloatType

    return df.select(
        *[
            F.when(~F.isnan(f.name), F.col(f.name)).alias(f.name)
            if isinstance(f.dataType, (DoubleType, FloatType)) else F.col(f.name)
            for f in df.schema.fields
        ]
    )


def table(spark: SparkSession, root: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{root}/{name}.parquet")


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Hash-partition by ``keys`` into the session's shuffle partitions before Python work.

    AQE would fold small inputs into one task; Python stages are bound by CPU, not bytes.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *[F.col(k) for k in keys])
