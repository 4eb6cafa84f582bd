"""As-of join: for every row the last (or next) event of its own key as of its own date."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def as_of(
    rows: DataFrame, events: DataFrame, key: str, date: str, event_date: str, values: Sequence[str], name: str = "event",
    forward: bool = False, strict: bool = False,
) -> DataFrame:
    """``rows`` with ``name``, a struct of ``event_date`` and ``values``: the last event on or before the row's ``date``.

    ``forward`` takes the first on or after it, and ``strict`` leaves out events of the day itself. Of several events of a day the one with the
    largest values counts. Rows without key or date, and rows without such an event, get null.

    Events, and the dates that are asked for, are made distinct per key and day first, combined per task, so a key with a third of all
    events or rows is at most one row per calendar day in what follows: one running value along the days of a key. Its rows are then joined with
    the answers by key and day, which Spark can divide where a day has very many.
    """
    event = F.struct(F.col(event_date), *values).alias(name)
    known = events.filter(F.col(key).isNotNull() & F.col(event_date).isNotNull())
    per_day = known.groupBy(F.col(key).alias("_k"), F.col(event_date).cast("date").alias("_d")).agg(F.max(event).alias(name))
    asked = rows.filter(F.col(key).isNotNull() & F.col(date).isNotNull()).select(
        F.col(key).alias("_k"), F.col(date).cast("date").alias("_d"), F.lit(True).alias("_asked")
    ).distinct()
    days = per_day.unionByName(asked, allowMissingColumns=True).groupBy("_k", "_d").agg(F.max(name).alias(name), F.max("_asked").alias("_asked"))
    order = Window.partitionBy("_k").orderBy(F.col("_d").desc() if forward else F.col("_d"))
    upto = order.rowsBetween(Window.unboundedPreceding, -1 if strict else Window.currentRow)
    answers = days.withColumn(name, F.last(name, ignorenulls=True).over(upto)).filter("_asked").drop("_asked")
    return rows.join(answers, (F.col(key) == F.col("_k")) & (F.col(date).cast("date") == F.col("_d")), "left").drop("_k", "_d")
