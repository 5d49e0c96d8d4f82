"""Helpers shared by the text operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType, _parse_datatype_string

from catchwise.runtime import Cut

#: Words of the contracts: runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"

#: Side tables are broadcast only when their written form is no larger than this.
BROADCAST_BYTES = 24 * 1024 * 1024


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def map_text(df: DataFrame, columns: list[str], fn: Callable[..., list], schema: str, rows: int = 256, keep_read: bool = True) -> DataFrame:
    """``df`` without ``columns`` plus the fields of ``schema``, made batch by batch without a shuffle.

    ``fn(*lists)`` gets one Python list per name in ``columns``, of at most ``rows`` rows, so that a worker holds few
    Python objects at a time, and returns one list per field of ``schema``.
    The columns read stay in the result unless ``schema`` names them or ``keep_read`` is false; a field of ``schema`` replaces a
    column of the same name, so clashing extra columns never fail.
    """
    added = _parse_datatype_string(schema)
    names = {f.name for f in added.fields}
    kept = [f for f in df.schema.fields if f.name not in names and (keep_read or f.name not in columns)]
    out = StructType(kept + list(added.fields))
    arrow = to_arrow_schema(out)
    n_kept = len(kept)
    kept_names = [f.name for f in kept]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (whole.slice(at, rows) for whole in batches for at in range(0, len(whole), rows)):
            made = fn(*[batch.column(batch.schema.get_field_index(c)).to_pylist() for c in columns])
            arrays = [batch.column(batch.schema.get_field_index(c)) for c in kept_names]
            arrays += [pa.array(v, type=arrow.field(n_kept + i).type) for i, v in enumerate(made)]
            yield pa.RecordBatch.from_arrays(arrays, names=arrow.names)
        pa.default_memory_pool().release_unused()

    return df.mapInArrow(run, out)


def written_bytes(cut: Cut) -> int:
    jvm = cut.spark._jvm
    path = jvm.org.apache.hadoop.fs.Path(cut.path)
    return path.getFileSystem(cut.spark._jsparkSession.sessionState().newHadoopConf()).getContentSummary(path).getLength()


def side(cut: Cut, expansion: int = 4) -> DataFrame:
    """The cut table, hinted for broadcast only when its files prove it small (``expansion``: bytes in memory a byte on disk)."""
    return F.broadcast(cut.df) if written_bytes(cut) * expansion <= BROADCAST_BYTES else cut.df
