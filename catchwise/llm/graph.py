"""Connected components of an edge table, in rounds of joins and minima."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catchwise.runtime import Cut


def component_table(edges: DataFrame) -> Cut:
    """A written table (id, root) for every end of an edge that is not the smallest of its component; ``edges`` has longs ``a`` and ``b``.

    Alternates two moves until only stars around the smallest ends are left: hang every edge's larger end on the
    smallest neighbour of its smaller end, then hang the smaller neighbours of every end on the smallest of them.
    Self-links and null ends are ignored. Every round is written to the shared scratch folder; minima are combined
    before the shuffle, so a star's centre costs no task more than another key.
    """
    known = edges.filter("a is not null and b is not null and a <> b")
    now = Cut(known.select(F.greatest("a", "b").alias("big"), F.least("a", "b").alias("small")).distinct())
    while True:
        low = now.df.groupBy("big").agg(F.min("small").alias("low"), F.count("*").alias("n"))
        # done when every end hangs on one root and no root hangs on anything
        loose = low.filter("n > 1").limit(1).union(low.join(now.df.select(F.col("small").alias("big")), "big", "left_semi").limit(1))
        if loose.isEmpty():
            named = Cut(now.df.select(F.col("big").alias("id"), F.col("small").alias("root")))
            now.drop()
            return named
        up = low.select(F.col("big").alias("small"), "low")
        hung = now.df.join(up, "small", "left").select("big", F.coalesce("low", "small").alias("small")).distinct()
        least = hung.groupBy("big").agg(F.min("small").alias("low"))
        both = hung.join(least, "big").select(F.explode(F.array(
            F.struct(F.col("big"), F.col("low").alias("small")), F.struct(F.col("small").alias("big"), F.col("low").alias("small")))).alias("e"))
        after = Cut(both.select("e.big", "e.small").filter("big <> small").distinct())
        now.drop()
        now = after


def components(edges: DataFrame) -> DataFrame:
    """The rows of ``component_table``."""
    return component_table(edges).df
