"""Parquet scans: plain, filtered, restricted to a cohort, per register and per period."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Iterable, Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lifeframe.functions import periods as P
from lifeframe.operators import cohort as C
from lifeframe.operators.mapping import map_register
from lifeframe.session import materialize
from lifeframe.sources import deliveries, files, schemas, specs
from lifeframe.sources.adapt import adapt, adapt_register, convert
from lifeframe.sources.files import FileCatalog, listing
from lifeframe.sources.specs import RegisterSpec

PERIOD = "period"


def read_parquet(
    spark: SparkSession,
    path: str | list[str],
    schema: T.StructType | None = None,
    cohort: DataFrame | None = None,
    id_column: str | None = None,
    columns: Iterable[str] | None = None,
    predicate: Column | None = None,
    adapt_types: bool = True,
    recursive: bool = False,
) -> DataFrame:
    """One file, several files or a directory.

    Columns, predicate and declared schema are all part of the plan, so the Parquet reader sees the
    pruned columns and the pushed filters. Columns wanted but absent in every file become typed nulls
    under ``adapt_types`` and are left out otherwise. Files whose stored types differ are one scan per distinct schema,
    brought to the declared types, or without them to the type that holds all.
    """
    paths = [path] if isinstance(path, str) else path
    df = _scan(spark, paths, schema if adapt_types else None, recursive)
    if predicate is not None:
        df = df.filter(predicate)
    if cohort is not None:
        df = C.restrict(df, cohort, id_column)
    if schema is not None:
        if adapt_types:
            df = adapt(df, schema)
        else:
            present = [f.name for f in schema.fields if f.name in df.columns]
            df = df.select(*present) if present else df
    if columns is not None:
        df = df.select(*columns)
    return df


def _scan(spark: SparkSession, paths: list[str], schema: T.StructType | None, recursive: bool) -> DataFrame:
    reader = spark.read.option("recursiveFileLookup", "true") if recursive else spark.read
    found = listing(spark, paths, recursive)
    if len(found.take(2)) < 2:
        return reader.parquet(*paths)
    groups = files.stored_schemas(materialize(files.describe(found), "footers"))
    if len(groups) == 1:
        return reader.parquet(*paths)
    frames = [schemas.read_stored(spark, paths, g, recursive=recursive) for g in groups]
    if schema is None:
        kinds: dict[str, set[str]] = {}
        for df in frames:
            for f in df.schema:
                kinds.setdefault(f.name, set()).add(f.dataType.simpleString())
        schema = T.StructType([T.StructField(n, T.DataType.fromDDL(schemas.common_type(k))) for n, k in kinds.items()])
    # Columns of the declared types, and partition columns and others as they are.
    declared = {f.name: f.dataType for f in schema.fields}
    ready = [
        df.select(*(convert(F.col(f.name), f.dataType, declared.get(f.name, f.dataType)).alias(f.name) for f in df.schema)) for df in frames
    ]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), ready)


def read_register(
    spark: SparkSession,
    spec: RegisterSpec | str,
    path: str,
    cohort: DataFrame | None = None,
    recursive: bool = True,
    catalogue: FileCatalog | None = None,
) -> DataFrame:
    """A named or user-declared register under its declared column names and types.

    Deliveries of other years may store a column in another type, or lack it: files are grouped by stored schema
    (from the ``catalogue`` of the path, else by one job over their footers), each group is one scan, and each is adapted to the declaration.
    """
    spec = specs.register(spec) if isinstance(spec, str) else spec
    described = _below(catalogue.files(), path) if catalogue else materialize(files.describe(listing(spark, path, recursive)), "footers")
    df = _adapted(spark, spec, path, described, recursive)
    return df if cohort is None else C.restrict(df, cohort, spec.id_column)


def _below(described: DataFrame, path: str) -> DataFrame:
    """The files below a folder."""
    plain = lambda c: F.regexp_replace(c, "^file:/+", "/")
    root = path.rstrip("/")
    return described.filter(F.startswith(plain(F.col("path")), plain(F.lit(f"{root}/"))) | (plain(F.col("path")) == plain(F.lit(root))))


def _adapted(
    spark: SparkSession, spec: RegisterSpec, path: str, described: DataFrame, recursive: bool = True, uri: str | None = None,
    where: Callable[[Column], Column] | None = None,
) -> DataFrame:
    """Files under the declaration, with the name of each row's file as ``uri`` if wanted; one scan per distinct schema."""
    names = {n for f in spec.fields for n in f.names}
    frames = [
        adapt_register(schemas.read_stored(spark, [path], g, names, recursive, uri, where), spec, keep=[uri] if uri else ())
        for g in files.stored_schemas(described)
    ]
    return reduce(lambda a, b: a.unionByName(b), frames)


def read_registers(
    spark: SparkSession, sources: Mapping[str, str], cohort: DataFrame | None = None
) -> dict[str, DataFrame]:
    """Several registers by name; registers without a person id are restricted through their parent."""
    frames = {name: read_register(spark, name, path) for name, path in sources.items()}
    return C.restrict_registers(frames, cohort) if cohort is not None else frames


def stack_registers(frames: Mapping[str, DataFrame]) -> DataFrame:
    """One frame with a ``registry`` column; columns a register lacks are null."""
    tagged = [map_register(df, specs.register(name)).withColumn("registry", F.lit(name)) for name, df in frames.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)


def read_periods(
    spark: SparkSession,
    path: str,
    spec: RegisterSpec | str,
    start: dt.date | None = None,
    end: dt.date | None = None,
    cohort: DataFrame | None = None,
    period_label: str | None = None,
    with_source: bool = False,
    catalogue: FileCatalog | None = None,
    units: int = files.UNITS,
) -> DataFrame:
    """All deliveries of a register, or those of a date range or of one period, with their period.

    Files outside the range are neither described nor opened; no file in it gives an empty frame, and files without a period are left
    out (``deliveries.undated`` lists them). The number of scans is that of distinct stored schemas. A delivery is a folder
    that Spark wrote, of any number of files, or a file. Up to ``units`` deliveries are named in the scan's file predicate and rows
    get their period by a broadcast of as many rows; beyond it both are computed from the name of a row's file.
    ``with_source`` adds ``source = <registry>_<period>_<rows in the delivery>``.
    """
    spec = specs.register(spec) if isinstance(spec, str) else spec
    present = _below(catalogue.files(), path) if catalogue else listing(spark, path)
    dated = deliveries.files_in_range(present, start, end).drop("registry")
    if period_label is not None:
        dated = dated.filter(P.period_label(F.col(PERIOD)) == period_label)
    dated = materialize(dated if catalogue else files.describe(dated), "deliveries")
    # Pieces of a delivery take their period from the folder they lie in.
    piece = P.in_period_folder(F.col("path"))
    name = F.when(piece, files.folder_of(F.col("uri"))).otherwise(F.col("uri"))
    found = dated.select(piece.alias("piece"), name.alias("name"), PERIOD).distinct().limit(units + 1).collect()
    if not found:
        fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in spec.schema)
        return spark.createDataFrame([], f"{fields}, {PERIOD} {P.PERIOD_TYPE}" + (", source string" if with_source else ""))
    if len(found) <= units:
        folders, singles = ([r.name for r in found if r.piece is kind] for kind in (True, False))
        df = _adapted(spark, spec, path, dated, uri="_uri", where=lambda uri: (
            files.name_of(uri).startswith("part-") & files.named(folders, [], uri) | files.named([], singles, uri)
        ))
        deals = spark.createDataFrame([(r.name, r[PERIOD]) for r in found], f"_name string, {PERIOD} {P.PERIOD_TYPE}")
        folder = F.when(files.name_of(F.col("_uri")).startswith("part-"), files.folder_of(F.col("_uri")))
        key = folder if not singles else F.col("_uri") if not folders else F.when(folder.isin(*folders), folder).otherwise(F.col("_uri"))
        df = df.withColumn("_name", key).join(F.broadcast(deals), "_name").drop("_name", "_uri")
    else:
        def wanted(uri: Column) -> Column:
            period = P.period_of_path(files.decoded(uri))
            inside = P.period_overlaps(period, None if start is None else F.lit(start), None if end is None else F.lit(end))
            return inside if period_label is None else inside & (P.period_label(period) == period_label)

        df = _adapted(spark, spec, path, dated, uri="_uri", where=wanted)
        df = df.withColumn(PERIOD, P.period_of_path(files.decoded(F.col("_uri")))).drop("_uri")
    rows = None
    if cohort is not None:
        df = C.restrict(df, cohort, spec.id_column)
    elif with_source:
        rows = dated.groupBy(P.period_label(F.col(PERIOD)).alias("_label")).agg(F.sum("rows").alias("_rows"))
    return _with_source(df, spec.name, rows) if with_source else df


def _with_source(df: DataFrame, registry: str, rows: DataFrame | None = None) -> DataFrame:
    """``rows`` are the rows of each period label; counted if they are not known."""
    label = P.period_label(F.col(PERIOD))
    if rows is None:
        rows = df.groupBy(label.alias("_label")).agg(F.count(F.lit(1)).alias("_rows"))
    # One row per delivery period: its size is bounded by the calendar, not by the data.
    joined = df.withColumn("_label", label).join(F.broadcast(rows), "_label")
    source = F.concat_ws("_", F.lit(registry), F.col("_label"), F.col("_rows").cast("string"))
    return joined.withColumn("source", source).drop("_label", "_rows")
