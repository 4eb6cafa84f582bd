"""Positions in a total order, with no group in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lifeframe.session import materialize


def numbered(df: DataFrame, keys: Sequence[str], order: Sequence[str], name: str, weight: str | None = None) -> DataFrame:
    """``df`` with ``name``: how many rows of the same ``keys`` stand before a row in ``order``, nulls first.

    A row counts ``weight`` times, if that is given. Rows are dealt by ranges of (keys, order), so a key with very many rows
    lies in many ranges, and are numbered within their range; a range's offset is the sum of the ranges before it. The ranges
    are written before they are counted, so a lost task cannot move their bounds. Rows that agree in keys and order
    are interchangeable; count them beforehand if they may be many.
    """
    ranged = df.repartitionByRange(*keys, *order).withColumn("_range", F.spark_partition_id())
    held = materialize(ranged, "ranges")
    size = F.col(weight) if weight else F.lit(1).cast("long")
    sizes = held.groupBy(*keys, "_range").agg(F.sum(size).alias("_size"))
    before = Window.partitionBy(*keys).orderBy("_range") if keys else Window.orderBy("_range")  # one row per range
    offsets = sizes.select(*keys, "_range", F.coalesce(F.sum("_size").over(before.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    within = Window.partitionBy(*keys, "_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    local = held.withColumn("_local", F.coalesce(F.sum(size).over(within), F.lit(0)))
    there = offsets.select("_before", F.col("_range").alias("_at"), *(F.col(k).alias(f"_key{i}") for i, k in enumerate(keys)))
    same = F.col("_range") == F.col("_at")
    for i, key in enumerate(keys):
        same = same & F.col(key).eqNullSafe(F.col(f"_key{i}"))
    return local.join(there, same).select(*df.columns, (F.col("_local") + F.col("_before")).alias(name))
