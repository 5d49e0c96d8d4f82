"""Place-name table: named points only, normalised search text, category priority."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catchwise.functions.text import search_text
from catchwise.operators.spatial import SETTLEMENT_PRIORITY


def build_toponyms(raw: DataFrame) -> DataFrame:
    """``id, name, name_norm, category, lon, lat, priority`` from ``id, name, category, lon, lat``."""
    name = F.trim(F.col("name"))
    priority = F.create_map(*[F.lit(x) for kv in SETTLEMENT_PRIORITY.items() for x in kv])
    ok = name.isNotNull() & (name != "") & F.col("lon").between(-180, 180) & F.col("lat").between(-90, 90)
    return raw.filter(ok).select("id", name.alias("name"), search_text(F.col("name")).alias("name_norm"), F.trim("category").alias("category"),
                                 F.col("lon").cast("double").alias("lon"), F.col("lat").cast("double").alias("lat"), priority[F.trim("category")].alias("priority"))
