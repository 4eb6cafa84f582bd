"""Cohort restriction, id mapping, lookups and link tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lifeframe.sources import specs

ID_COLUMNS = ("PNR", "pnr", "CPR_BARN", "CPR", "cpr")


def detect_id(df: DataFrame) -> str:
    """The person id column of a frame."""
    for name in ID_COLUMNS:
        if name in df.columns:
            return name
    raise ValueError(f"no person id column among {df.columns}")


def cohort_ids(cohort: DataFrame, name: str) -> DataFrame:
    """The cohort's distinct, non-null ids under the given name."""
    source = detect_id(cohort)
    return cohort.select(F.col(source).alias(name)).filter(F.col(name).isNotNull()).distinct()


def restrict(df: DataFrame, cohort: DataFrame, id_column: str | None = None) -> DataFrame:
    """Rows whose person is in the cohort.

    No broadcast is forced: Spark broadcasts a cohort below its size threshold and shuffles a larger one,
    splitting hot ids at run time.
    """
    key = id_column or detect_id(df)
    return df.join(cohort.select(F.col(detect_id(cohort)).alias(key)), key, "left_semi")


def restrict_through(child: DataFrame, key: str, parent: DataFrame, cohort: DataFrame) -> DataFrame:
    """Child rows whose key belongs to a parent row of a cohort member."""
    return child.join(restrict(parent, cohort).select(key), key, "left_semi")


def restrict_registers(frames: Mapping[str, DataFrame], cohort: DataFrame) -> dict[str, DataFrame]:
    """Restrict every register, directly by its id or through its parent register.

    ``frames`` have the declared column names. A register whose parent is not given cannot be reached
    and is an error.
    """
    result = {}
    for name, df in frames.items():
        spec = specs.register(name)
        if spec.parent is None:
            result[name] = restrict(df, cohort, spec.id_column)
        elif spec.parent in frames:
            result[name] = restrict_through(df, spec.parent_key, frames[spec.parent], cohort)
        else:
            raise ValueError(f"{name} reaches persons through {spec.parent}, which is not loaded")
    return result


def record_links(parent: DataFrame, key: str, id_column: str) -> DataFrame:
    """One person per record key; of several the smaller id."""
    return parent.filter(F.col(key).isNotNull()).groupBy(key).agg(F.min(id_column).alias(id_column))


def attach_person(child: DataFrame, parent: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """Adds the parent's person id to rows that only carry a record key."""
    id_column = detect_id(parent)
    return child.join(record_links(parent, key, id_column), key, how)


def split_cohort(persons: DataFrame, condition_ids: DataFrame, key: str = "pnr") -> tuple[DataFrame, DataFrame]:
    """(persons in the condition set, persons outside it)."""
    ids = condition_ids.select(F.col(detect_id(condition_ids)).alias(key))
    return persons.join(ids, key, "left_semi"), persons.join(ids, key, "left_anti")


def enrich(persons: DataFrame, details: DataFrame, key: str = "pnr") -> DataFrame:
    """Adds detail columns onto known persons; persons without details are left out.

    Of several detail rows of a person one is taken as a whole: the one with fewest unknown values, of these the smallest.
    """
    added = [c for c in details.columns if c != key and c not in persons.columns]
    return persons.join(whole_row(details, key, added), key)


def whole_row(df: DataFrame, key: str, columns: list[str], first: Sequence[Column] = ()) -> DataFrame:
    """One row per key, never put together from several: least by ``first``, then fewest nulls, then by value."""
    if not columns:
        return df.select(key).distinct()
    unknown = sum((F.col(c).isNull().cast("int") for c in columns), F.lit(0))
    best = F.min_by(F.struct(*columns), F.struct(*first, unknown, *columns))
    return df.groupBy(key).agg(best.alias("_row")).select(key, *(F.col("_row")[c].alias(c) for c in columns))


def related(links: DataFrame, left_key: str, right_key: str, entities: DataFrame, key: str) -> DataFrame:
    """Entities linked from the left side: one row per link with the left key."""
    return links.select(left_key, F.col(right_key).alias(key)).join(entities, key)


def add_links(links: DataFrame, new: DataFrame) -> DataFrame:
    return links.unionByName(new.select(*links.columns)).distinct()


def remove_links(links: DataFrame, gone: DataFrame) -> DataFrame:
    return links.join(gone.select(*links.columns).distinct(), links.columns, "left_anti")


def lookup(df: DataFrame, key: Column, order: Column, name: str = "lookup_key") -> DataFrame:
    """One row per key: the first in the given order."""
    keyed = df.withColumn(name, key)
    row = F.min_by(F.struct(*df.columns), order).alias("_row")
    return keyed.filter(F.col(name).isNotNull()).groupBy(name).agg(row).select(name, "_row.*")


def multi_lookup(df: DataFrame, key: Column, name: str = "lookup_key") -> DataFrame:
    """All rows under their key, kept long so that a key with very many rows never becomes one value."""
    return df.withColumn(name, key).filter(F.col(name).isNotNull())
