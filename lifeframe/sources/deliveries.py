"""Listings of delivered files and the periods they cover.

A listing is a DataFrame with a ``path`` column; every operator on it is a plain DataFrame operation.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lifeframe.functions import periods as P
from lifeframe.operators.intervals import overlapping
from lifeframe.sources.files import listing

# Path fragments of the five hospital tables.
HOSPITAL_TABLES = {
    "lpr_adm": "lpr_adm", "lpr_diag": "lpr_diag", "lpr_bes": "lpr_bes",
    "lpr3_kontakter": "kontakter", "lpr3_diagnoser": "diagnoser",
}


def list_files(spark: SparkSession, directory: str, recursive: bool = True) -> DataFrame:
    """Paths of all Parquet files below a directory."""
    return listing(spark, directory, recursive).select("path")


def _date(value: dt.date | None) -> Column | None:
    return None if value is None else F.lit(value)


def with_period(files: DataFrame) -> DataFrame:
    """Adds the register (parent directory) and the period; ``undated`` has the files without one."""
    path = F.col("path")
    return (
        files.withColumn("registry", P.registry_of_path(path))
        .withColumn("period", P.period_of_path(path))
        .filter(F.col("period").isNotNull())
    )


def undated(files: DataFrame) -> DataFrame:
    """Files whose path names no period: what ``with_period`` and the period scans leave out."""
    return files.filter(P.period_of_path(F.col("path")).isNull())


def files_in_range(files: DataFrame, start: dt.date | None = None, end: dt.date | None = None) -> DataFrame:
    """Files whose period shares a day with the range."""
    return with_period(files).filter(P.period_overlaps(F.col("period"), _date(start), _date(end)))


def files_in_ranges(files: DataFrame, ranges: DataFrame, bounds: tuple[str, str]) -> DataFrame:
    """Each file with every range of a table that its period shares a day with; a null bound is open."""
    dated = with_period(files).withColumns({"_start": F.col("period.start"), "_end": F.col("period.end")})
    return overlapping(dated, ranges, ("_start", "_end"), bounds).drop("_start", "_end")


def files_of_year(files: DataFrame, year: int) -> DataFrame:
    return with_period(files).filter(F.col("period.year") == year)


def available_years(files: DataFrame) -> DataFrame:
    return with_period(files).select(F.col("period.year").alias("year")).distinct()


def latest_period(files: DataFrame) -> DataFrame:
    """The period that starts last, per register; of equal starts the one that ends last."""
    order = F.struct("period.start", "period.end", "period.kind")
    return with_period(files).groupBy("registry").agg(F.max_by("period", order).alias("period"))


def registry_periods(files: DataFrame) -> DataFrame:
    """Register (lower case) and each of its periods with the number of files, one row per period."""
    tagged = with_period(files).withColumn("label", P.period_label(F.col("period")))
    return tagged.groupBy(F.lower("registry").alias("registry"), "label").agg(
        F.min("period.start").alias("start"), F.max("period.end").alias("end"), F.count(F.lit(1)).alias("files")
    )


def pair_by_year(left: DataFrame, right: DataFrame) -> DataFrame:
    """Full outer pairing of two listings by year: ``year, left_path, right_path``."""
    def yearly(files: DataFrame, name: str) -> DataFrame:
        return (
            files.select(P.year_of_file(F.col("path")).alias("year"), F.col("path"))
            .filter(F.col("year").isNotNull())
            .groupBy("year")
            .agg(F.min("path").alias(name))
        )

    return yearly(left, "left_path").join(yearly(right, "right_path"), "year", "full")


def hospital_tables(files: DataFrame) -> DataFrame:
    """Which of the five hospital tables exist: ``table_name, files``."""
    path = F.lower("path")
    name = F.coalesce(
        *(F.when(path.contains(fragment), F.lit(table)) for table, fragment in HOSPITAL_TABLES.items())
    )
    return (
        files.withColumn("table_name", name)
        .filter(F.col("table_name").isNotNull())
        .groupBy("table_name")
        .agg(F.count(F.lit(1)).alias("files"))
    )


def hospital_availability(files: DataFrame) -> dict[str, bool]:
    """Whether each generation can be integrated; an error when no hospital table is found."""
    found = {row.table_name for row in hospital_tables(files).collect()}  # at most five rows
    if not found:
        raise ValueError("no hospital register files found")
    return {
        "lpr2": {"lpr_adm", "lpr_diag"} <= found,
        "lpr3": {"lpr3_kontakter", "lpr3_diagnoser"} <= found,
    }
