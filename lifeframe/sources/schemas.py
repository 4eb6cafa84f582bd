"""Comparing the schemas of many files."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lifeframe.session import materialize
from lifeframe.sources.files import StoredSchema, describe, listing


def footers(files: DataFrame) -> DataFrame:
    """One row per file and column of a listing: position, name, type and number of columns."""
    each = describe(files.select("path"))
    return each.select("path", F.size("columns").alias("fields"), F.posexplode("columns").alias("position", "column")).select(
        F.col("path").alias("file"), "position", F.col("column.name").alias("name"), F.col("column.type").alias("physical"), "fields"
    )


def compare_footers(found: DataFrame, reference: str) -> DataFrame:
    """Differences of every file from the reference file: ``file, reference, issue``; none for equal schemas."""
    # The reference's columns: one row per column of a single file.
    base = F.broadcast(
        found.filter(F.col("file") == reference).select(
            "position", F.col("name").alias("_name"), F.col("physical").alias("_physical"), F.col("fields").alias("_fields")
        )
    )
    others = found.filter(F.col("file") != reference).join(base, "position")
    issues = F.array_compact(
        F.array(
            F.when(
                (F.col("position") == 0) & (F.col("fields") != F.col("_fields")),
                F.format_string("field count: %d instead of %d", "fields", "_fields"),
            ),
            F.when(
                F.col("name") != F.col("_name"),
                F.format_string("field %d: %s instead of %s", "position", "name", "_name"),
            ),
            F.when(
                F.col("physical") != F.col("_physical"),
                F.format_string("field %d %s: %s instead of %s", "position", "name", "physical", "_physical"),
            ),
        )
    )
    return others.select("file", F.lit(reference).alias("reference"), F.explode(issues).alias("issue"))


def schema_report(spark: SparkSession, paths: Iterable[str]) -> DataFrame:
    """Compare each file with the first."""
    wanted = list(paths)
    files = spark.createDataFrame([(path,) for path in wanted], "path string")
    # Read by two branches of the comparison; one row per file and column.
    return compare_footers(materialize(footers(files), "footers"), wanted[0])


# Stored types and the Spark types they are read as. Times of day are read as their number of
# milliseconds or microseconds, because Spark refuses to infer a schema with the former.
_STORED = {
    "string": "string", "large_string": "string", "bool": "boolean", "double": "double", "float": "float",
    "int8": "tinyint", "int16": "smallint", "int32": "int", "int64": "bigint", "uint8": "smallint", "uint16": "int",
    "uint32": "bigint", "uint64": "decimal(20,0)", "date32[day]": "date", "binary": "binary", "large_binary": "binary",
    "time32[ms]": "int", "time64[us]": "bigint",
}
_PER_SECOND = {"time32[ms]": 1_000, "time64[us]": 1_000_000}


def spark_type(physical: str) -> str | None:
    """The Spark type that a stored type is read as; nothing for types that no register field can be delivered in."""
    values = re.fullmatch(r"dictionary<values=([^,]+),.*>", physical)
    if values:
        return spark_type(values[1])
    decimal = re.fullmatch(r"decimal\d*\((\d+), ?(\d+)\)", physical)
    if decimal:
        return f"decimal({decimal[1]},{decimal[2]})"
    if physical.startswith("timestamp["):
        return "timestamp" if "tz=" in physical else "timestamp_ntz"
    if physical.startswith("fixed_size_binary"):
        return "binary"
    item = re.fullmatch(r"(?:large_)?list<\w+: (.+?)(?: not null)?>", physical)
    if item:
        inner = spark_type(item[1])
        return f"array<{inner}>" if inner else None
    return _STORED.get(physical)


def read_stored(
    spark: SparkSession, paths: list[str], group: StoredSchema, wanted: Iterable[str] | None = None, recursive: bool = True, uri: str | None = None,
    where: Callable[[Column], Column] | None = None,
) -> DataFrame:
    """One scan of the files below ``paths`` that are stored alike; times of day become whole seconds since midnight.

    ``wanted`` are the columns to read (all if not given). One that is stored in a type that cannot be read is an error.
    ``uri`` adds the name of each row's file, and ``where`` narrows the files by it.
    """
    names = [n for n in group.columns if wanted is None or n in set(wanted)]
    unknown = [f"{n}: {group.columns[n]}" for n in names if spark_type(group.columns[n]) is None]
    if unknown:
        raise ValueError(f"no way to read {', '.join(unknown)} in {group.example}")
    # A scan needs a column to be declared, also where none is wanted.
    read = names or [n for n in group.columns if spark_type(group.columns[n])][:1]
    fields = ", ".join(f"`{n}` {spark_type(group.columns[n])}" for n in read)
    df = spark.read.schema(fields).option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", str(recursive).lower()).parquet(*paths)
    file = F.col("_metadata.file_path")
    for condition in ([group.where] if group.where is not None else []) + ([where(file)] if where else []):
        df = df.filter(condition)
    kept = [c for c in df.columns if c not in read or c in names]
    df = df.select(*kept, file.alias(uri)) if uri else df.select(*kept)
    per_second = {n: _PER_SECOND[group.columns[n]] for n in names if group.columns[n] in _PER_SECOND}
    return df.withColumns({n: F.floor(F.col(n) / unit).cast("int") for n, unit in per_second.items()}) if per_second else df


def common_type(kinds: set[str]) -> str:
    """The type that columns of several types are read as: the same, the wider number, else text."""
    whole = ("tinyint", "smallint", "int", "bigint")
    if len(kinds) == 1:
        return next(iter(kinds))
    if kinds <= set(whole):
        return max(kinds, key=whole.index)
    if kinds <= {*whole, "float", "double"}:
        return "double"
    return "timestamp_ntz" if kinds <= {"date", "timestamp_ntz"} else "string"


def read_compatible(spark: SparkSession, paths: Iterable[str]) -> DataFrame:
    """Rows of several files or directories after checking that the columns and types of all their files agree."""
    wanted = list(paths)
    found = materialize(footers(listing(spark, wanted)), "footers")
    reference = found.agg(F.min("file")).first()[0]
    issue = compare_footers(found, reference).orderBy("file", "issue").first()
    if issue:
        raise ValueError(f"{issue['file']} differs from {issue.reference}: {issue.issue}")
    return spark.read.option("recursiveFileLookup", "true").parquet(*wanted)
