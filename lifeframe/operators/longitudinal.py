"""Merging deliveries into one record per person, and the record of who was seen when."""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lifeframe.functions import periods as P
from lifeframe.functions import persons as fn
from lifeframe.operators.intervals import overlapping

# Fixed value: which register's value is taken first when several know a field.
REGISTER_PRIORITY = (
    "bef", "mfr", "dod", "dodsaarsag", "vnds", "akm", "uddf", "ind",
    "lpr_adm", "lpr3_kontakter", "lpr_diag", "lpr3_diagnoser", "lpr_bes",
)
_BOOKKEEPING = ("pnr", "period", "registry", "source")


def _first_known(columns: Iterable[str], order: Column, latest: bool) -> list[Column]:
    pick = F.max_by if latest else F.min_by
    # A null order is ignored, so only rows that know the field compete for it.
    return [pick(F.col(c), F.when(F.col(c).isNotNull(), order)).alias(c) for c in columns]


def merge_periods(rows: DataFrame, prefer: str = "earliest", key: str = "pnr") -> DataFrame:
    """One row per person: each field's first known value in chronological order of the periods.

    Values of the same period are ordered by themselves, so the result does not depend on read order.
    Each field is one partially aggregated min-by: a person with very many rows shrinks to one row per
    task before the shuffle. ``prefer="latest"`` takes the last known value instead.
    """
    fields = [c for c in rows.columns if c not in _BOOKKEEPING and c != key]
    pick = F.max_by if prefer == "latest" else F.min_by
    aggregates = [
        pick(F.col(c), F.when(F.col(c).isNotNull(), F.struct("period.start", "period.end", F.col(c)))).alias(c)
        for c in fields
    ]
    return rows.filter(F.col(key).isNotNull()).groupBy(key).agg(*aggregates)


def merge_registers(
    merged: Mapping[str, DataFrame], priority: Sequence[str] = REGISTER_PRIORITY, key: str = "pnr"
) -> DataFrame:
    """Combine one-row-per-person frames of several registers; an earlier register fills a field first.

    All registers are stacked and aggregated once, so there is one shuffle on the person id.
    """
    rank = {name: i for i, name in enumerate(priority)}
    ordered = sorted(merged, key=lambda name: (rank.get(name, len(rank)), name))
    stacked = reduce(
        lambda a, b: a.unionByName(b, allowMissingColumns=True),
        (merged[name].drop("period", "registry", "source").withColumn("_rank", F.lit(i)) for i, name in enumerate(ordered)),
    )
    fields = [c for c in stacked.columns if c not in (key, "_rank")]
    return stacked.groupBy(key).agg(*_first_known(fields, F.col("_rank"), latest=False))


def longitudinal(
    deliveries: Mapping[str, DataFrame],
    registries: Iterable[str] | None = None,
    prefer: str = "earliest",
    priority: Sequence[str] = REGISTER_PRIORITY,
) -> DataFrame:
    """One row per person over all (or the selected) registers and periods.

    ``deliveries`` holds mapped rows with a ``period`` column per register.
    """
    chosen = set(registries) if registries is not None else set(deliveries)
    merged = {name: merge_periods(df, prefer) for name, df in deliveries.items() if name in chosen}
    if not merged:
        raise ValueError("no register selected")
    return merge_registers(merged, priority)


def presence(deliveries: Mapping[str, DataFrame], key: str = "pnr") -> DataFrame:
    """Which person was seen in which register and period: one row each, with a source label.

    Rows are made distinct on id and period before anything is formatted. The label is the delivered
    ``source`` where there is one (of several the smallest), else ``<registry>_<period>``.
    """
    label = P.period_label(F.col("period"))
    parts = []
    for name, df in deliveries.items():
        known = df.filter(F.col(key).isNotNull())
        if "source" in df.columns:
            once = known.groupBy(key, "period").agg(F.min("source").alias("source"))
        else:
            once = known.select(key, "period").distinct().withColumn("source", F.concat_ws("_", F.lit(name), label))
        parts.append(once.withColumn("registry", F.lit(name)))
    stacked = reduce(lambda a, b: a.unionByName(b), parts)
    return stacked.select(
        key, "registry", label.alias("label"), F.col("period.kind").alias("period_kind"),
        F.col("period.start").alias("period_start"), F.col("period.end").alias("period_end"), "source",
    )


def valid_at(persons: DataFrame, date: dt.date) -> DataFrame:
    return persons.filter(fn.alive_at(F.col("birth_date"), F.col("death_date"), F.lit(date)))


def date_range(seen: DataFrame) -> DataFrame:
    """First start and last end over all periods."""
    return seen.agg(F.min("period_start").alias("start"), F.max("period_end").alias("end"))


def all_periods(seen: DataFrame) -> DataFrame:
    return seen.select("registry", "label", "period_start", "period_end").distinct()


def person_periods(seen: DataFrame) -> DataFrame:
    """First and last period per person and register, and how many there are."""
    order = F.struct("period_start", "period_end")
    return seen.groupBy("pnr", "registry").agg(
        F.min_by("label", order).alias("earliest"),
        F.max_by("label", order).alias("latest"),
        F.count(F.lit(1)).alias("periods"),
    )


def sources_at(seen: DataFrame, date: dt.date) -> DataFrame:
    """Per person and register the periods that contain the date. The list is bounded by the calendar."""
    hit = seen.filter(F.lit(date).between(F.col("period_start"), F.col("period_end")))
    return hit.groupBy("pnr", "registry").agg(F.sort_array(F.collect_set("label")).alias("labels"))


def sources_between(seen: DataFrame, start: dt.date, end: dt.date) -> DataFrame:
    """Per person and register the periods that share a day with the range."""
    hit = seen.filter((F.col("period_end") >= F.lit(start)) & (F.col("period_start") <= F.lit(end)))
    return hit.groupBy("pnr", "registry").agg(F.sort_array(F.collect_set("label")).alias("labels"))


def sources_in(seen: DataFrame, windows: DataFrame, bounds: tuple[str, str], window: Sequence[str]) -> DataFrame:
    """Per person, register and ``window`` of a table the periods that share a day with it."""
    hit = overlapping(seen, windows.select(*window, *bounds), ("period_start", "period_end"), bounds)
    return hit.groupBy("pnr", "registry", *window).agg(F.sort_array(F.collect_set("label")).alias("labels"))


def register_counts(seen: DataFrame) -> DataFrame:
    """How many persons were seen in how many registers."""
    per_person = seen.select("pnr", "registry").distinct().groupBy("pnr").agg(F.count(F.lit(1)).alias("registries"))
    return per_person.groupBy("registries").agg(F.count(F.lit(1)).alias("persons"))


def period_counts(seen: DataFrame) -> DataFrame:
    """Persons per register and period; ``presence`` already holds each person once per period."""
    return seen.groupBy("registry", "label").agg(F.count(F.lit(1)).alias("persons"))


def gender_counts(persons: DataFrame) -> DataFrame:
    return persons.groupBy(F.coalesce("gender", F.lit("Unknown")).alias("gender")).agg(F.count(F.lit(1)).alias("persons"))


def seen_in(seen: DataFrame, label: str) -> DataFrame:
    """Persons with data of a given period."""
    return seen.filter(F.col("label") == label).select("pnr").distinct()


def coverage_calendar(seen: DataFrame) -> DataFrame:
    """Register by year: the period labels covered, as text."""
    return (
        seen.groupBy("registry", F.year("period_start").alias("year"))
        .agg(F.array_join(F.sort_array(F.collect_set("label")), ", ").alias("covered"))
    )


def enrichment_rates(persons: DataFrame, columns: Iterable[str]) -> DataFrame:
    """Share of persons with a known value, one row per column, in one pass."""
    wanted = list(columns)
    shares = persons.agg(*(F.avg(F.col(c).isNotNull().cast("int")).alias(c) for c in wanted))
    pairs = ", ".join(f"'{c}', `{c}`" for c in wanted)
    return shares.selectExpr(f"stack({len(wanted)}, {pairs}) as (field, share)")
