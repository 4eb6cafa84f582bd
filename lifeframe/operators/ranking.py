"""Positions within groups that may be arbitrarily large."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def number_slices(
    df: DataFrame, keys: Sequence[str], slices: Sequence[str], order: Sequence[Column], carried: dict[str, Column] | None = None
) -> tuple[DataFrame, DataFrame]:
    """(rows numbered within their slice as ``_local``, one row per slice with its size ``_n``).

    ``carried`` adds aggregates per slice. Both frames read the same shuffle, so the input is computed once.
    """
    slice_ = Window.partitionBy(*keys, *slices)
    local = df.withColumn("_local", F.row_number().over(slice_.orderBy(*order)))
    sized = local.withColumns(
        {"_n": F.count(F.lit(1)).over(slice_), **{name: c.over(slice_) for name, c in (carried or {}).items()}}
    )
    return local, sized.filter("_local = 1").select(*keys, *slices, "_n", *(carried or {}))


def position_in_group(
    df: DataFrame,
    keys: Sequence[str],
    buckets: Sequence[Column],
    order: Sequence[Column],
    name: str = "position",
) -> DataFrame:
    """1-based position within ``keys``, ordered by ``buckets`` and then ``order``.

    ``buckets`` are the coarse leading part of the order; they and the keys must not be null. Rows are
    numbered per (keys, bucket), and each bucket's offset is the running sum of the bucket sizes before
    it. No task therefore sorts more than one bucket, and the running sum only sees one row per bucket.
    """
    slices = [f"_slice{i}" for i in range(len(buckets))]
    tagged = df.select("*", *(b.alias(n) for b, n in zip(buckets, slices)))
    local, sizes = number_slices(tagged, keys, slices, order)
    before = Window.partitionBy(*keys).orderBy(*slices).rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    joined = local.join(offsets, [*keys, *slices])
    return joined.withColumn(name, F.col("_local") + F.col("_before")).drop("_local", "_before", *slices)


def spread(value: Column, digits: int = 2) -> Column:
    """An order-free bucket of a value: the first hex digits of its md5."""
    return F.substring(F.md5(value), 1, digits)
