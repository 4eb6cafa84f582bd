"""Delivered files as a table: what is there, how each file is stored, and how many rows it has.

A listing is Spark's own file index read as a DataFrame, so names never pass through a driver list. ``describe`` adds each
file's stored columns and its row count from its footer, in tasks. ``FileCatalog`` keeps the result as a stored table and reads only the footers of
files that are new or have changed since.

Scans choose their files by a predicate on the name that Spark gives every row's file; Spark applies it to its file index, so other files
are not opened. The predicate names folders or files only where that takes at most ``UNITS`` names; beyond it, it is computed
from the name.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Mapping
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lifeframe.session import materialize
from lifeframe.sources.versions import Versions

UNITS = 2000  # folders or files that a predicate may name
COLUMNS = "array<struct<name:string,type:string>>"
FILES = f"uri string, path string, size bigint, modified timestamp, columns {COLUMNS}, rows bigint"
# Schemes that Arrow's file systems know, by Spark's name for them.
_ARROW_SCHEMES = {"file": "file", "s3": "s3", "s3a": "s3", "s3n": "s3", "gs": "gs"}
# Settings of Spark's S3 file system and the arguments of Arrow's that mean the same.
_S3_SETTINGS = {
    "fs.s3a.access.key": "access_key", "fs.s3a.secret.key": "secret_key", "fs.s3a.session.token": "session_token",
    "fs.s3a.endpoint": "endpoint_override", "fs.s3a.endpoint.region": "region",
}


def decoded(uri: Column) -> Column:
    """The path that a file's name stands for."""
    return F.url_decode(F.replace(uri, F.lit("+"), F.lit("%2B")))


def name_of(uri: Column) -> Column:
    return F.substring_index(uri, "/", -1)


def folder_of(uri: Column) -> Column:
    return F.left(uri, F.length(uri) - F.length(name_of(uri)) - 1)


def listing(spark: SparkSession, paths: str | list[str], recursive: bool = True) -> DataFrame:
    """(uri, path, size, modified) of all Parquet files below some paths; no file is opened."""
    reader = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", str(recursive).lower())
    uri = F.col("_metadata.file_path")
    return reader.load(paths).select(uri.alias("uri"), decoded(uri).alias("path"), F.col("length").alias("size"), F.col("modificationTime").alias("modified"))


def store_settings(spark: SparkSession) -> dict[str, str]:
    """What the session says about object stores, as arguments of Arrow's file system."""
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    found = {name: conf.get(key) for key, name in _S3_SETTINGS.items() if conf.get(key)}
    if conf.get("fs.s3a.connection.ssl.enabled") == "false":
        found["scheme"] = "http"
    return found


def open_file(path: str, settings: Mapping[str, str]):
    """A file of a store that Arrow knows, opened with the session's settings."""
    import pyarrow.fs as pafs

    scheme, rest = path.split(":", 1) if "://" in path or path.startswith("file:") else ("file", path)
    kind = _ARROW_SCHEMES[scheme]
    if kind == "file":
        return pafs.LocalFileSystem().open_input_file("/" + rest.lstrip("/"))
    if kind == "s3":
        return pafs.S3FileSystem(**settings).open_input_file(rest.lstrip("/"))
    return pafs.FileSystem.from_uri(f"{kind}:{rest}")[0].open_input_file(rest.lstrip("/"))


def _footer(path: str, source) -> dict:
    import pyarrow.parquet as pq

    file = pq.ParquetFile(source)
    columns = [{"name": f.name, "type": str(f.type)} for f in file.schema_arrow]
    return {"path": path, "columns": columns, "rows": file.metadata.num_rows}


def describe(files: DataFrame) -> DataFrame:
    """``files`` with their stored ``columns`` and their ``rows``, read from the footers by tasks.

    Files in stores that Arrow does not know are read through Spark, with their whole content.
    """
    spark = files.sparkSession
    settings = store_settings(spark)
    scheme = F.when(F.col("path").rlike("^[A-Za-z0-9]+:/"), F.substring_index("path", ":", 1)).otherwise("file")
    known = scheme.isin(*_ARROW_SCHEMES)
    result = f"path string, columns {COLUMNS}, rows bigint"

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for path in batch["path"]:
                with open_file(path, settings) as handle:
                    rows.append(_footer(path, handle))
            yield pd.DataFrame(rows, columns=["path", "columns", "rows"])

    spread = files.select("path").filter(known).repartition(spark.sparkContext.defaultParallelism, "path")
    found = spread.mapInPandas(read, result)
    others = [r.path for r in files.select("path").filter(~known).limit(1).collect()]
    if others:
        found = found.unionByName(_from_content(files.filter(~known), result))
    return files.join(found, "path").select(*files.columns, "columns", "rows")


def _from_content(files: DataFrame, result: str) -> DataFrame:
    """Footers of files below the folders of ``files``; a row per folder passes through the driver."""
    import pyarrow as pa

    spark = files.sparkSession
    folders = [r.folder for r in files.select(F.regexp_extract("path", "^(.*)/[^/]+$", 1).alias("folder")).distinct().collect()]
    content = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(folders)
    named = content.select(decoded(F.col("_metadata.file_path")).alias("path"), "content").join(files.select("path"), "path", "left_semi")

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [_footer(path, pa.BufferReader(data)) for path, data in zip(batch["path"], batch["content"])]
            yield pd.DataFrame(rows, columns=["path", "columns", "rows"])

    return named.mapInPandas(read, result)


class FileCatalog:
    """A stored table of files, refreshed by a listing.

    ``refresh`` keeps the rows of files that have the size and time they had, reads the footers of all others, and forgets files that
    are gone. It writes the next version, which readers see when it is complete.
    """

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self._versions = spark, Versions(spark, path)

    def refresh(self, paths: str | list[str], recursive: bool = True) -> int:
        """How many footers were read."""
        found = listing(self.spark, paths, recursive)
        before = self._versions.read()
        if before is None:
            fresh = materialize(describe(found), "footers")
            after = fresh
        else:
            same = ["uri", "size", "modified"]
            kept = before.join(found.select(*same), same, "left_semi").select(*before.columns)
            fresh = materialize(describe(found.join(before.select(*same), same, "left_anti").select(*found.columns)), "footers")
            after = kept.unionByName(fresh)
        self._versions.write(after)
        self._versions.drop_older()
        return fresh.count()

    def files(self) -> DataFrame:
        """(uri, path, size, modified, columns, rows) of every file."""
        found = self._versions.read()
        if found is None:
            raise ValueError(f"no catalogue at {self._versions.path}; refresh it first")
        return found


@dataclass(frozen=True)
class StoredSchema:
    """Columns as some files store them, and which files these are: the ones that ``where`` holds for (all if there is none)."""

    columns: dict[str, str]
    where: Column | None
    example: str


def named(folders: Iterable[str], uris: Iterable[str], uri: Column) -> Column:
    """Whether a file lies in one of the folders or is one of the files."""
    folders, uris = list(folders), list(uris)
    found = F.lit(False)
    if folders:
        found = found | folder_of(uri).isin(*folders)
    return found | uri.isin(*uris) if uris else found


def stored_schemas(files: DataFrame) -> list[StoredSchema]:
    """The distinct schemas among described files, each with a predicate on the name that a scan gives a row's file.

    The commonest schema is that of all files that the others' predicates do not name, so names are needed for the exceptions only: of a folder
    that is stored alike its own name, else those of its files.
    """
    uri = F.col("_metadata.file_path")
    tagged = files.select("uri", "columns", F.xxhash64("columns").alias("kind"))
    alike = tagged.groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.first("columns").alias("columns"), F.min("uri").alias("example")).collect()
    kinds = sorted(alike, key=lambda r: (-r.n, r.example))
    columns = [{c["name"]: c["type"] for c in r["columns"]} for r in kinds]
    if len(kinds) <= 1:
        return [StoredSchema(c, None, r.example) for r, c in zip(kinds, columns)]
    foldered = tagged.withColumn("folder", folder_of(F.col("uri")))
    mixed = foldered.groupBy("folder").agg((F.min("kind") != F.max("kind")).alias("mixed"))
    odd = foldered.filter(F.col("kind") != kinds[0].kind).join(mixed, "folder")
    names = odd.select("kind", "mixed", F.when(F.col("mixed"), F.col("uri")).otherwise(F.col("folder")).alias("name")).distinct().collect()
    found = [named((r.name for r in names if r.kind == k.kind and not r.mixed), (r.name for r in names if r.kind == k.kind and r.mixed), uri) for k in kinds[1:]]
    rest = F.lit(True)
    for other in found:
        rest = rest & ~other
    return [StoredSchema(c, w, r.example) for r, c, w in zip(kinds, columns, [rest, *found])]
