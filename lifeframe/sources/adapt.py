"""Adapting delivered schemas to declared ones."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lifeframe.functions import dates
from lifeframe.sources.specs import RegisterSpec

EXACT, COMPATIBLE, INCOMPATIBLE = "exact", "compatible", "incompatible"

_INTEGER_RANK = {"tinyint": 1, "smallint": 2, "int": 3, "bigint": 4}
_TEMPORAL = {"date", "timestamp", "timestamp_ntz"}

REPORT_SCHEMA = "position int, field string, source_type string, target_type string, status string, strategy string"


def compatibility(source: T.DataType, target: T.DataType) -> str:
    """Whether a column may be adapted: equal, widening, text to and from dates, boolean outwards."""
    src, tgt = source.simpleString(), target.simpleString()
    if src == tgt:
        return EXACT
    widening = src in _INTEGER_RANK and tgt in _INTEGER_RANK and _INTEGER_RANK[src] < _INTEGER_RANK[tgt]
    to_float = tgt == "double" and (src in _INTEGER_RANK or src == "float")
    to_single = tgt == "float" and src in ("tinyint", "smallint", "int")
    dated = (src == "string" and tgt in _TEMPORAL) or (src in _TEMPORAL and tgt in _TEMPORAL | {"string"})
    boolean = src == "boolean" and (tgt in _INTEGER_RANK or tgt == "string")
    return COMPATIBLE if widening or to_float or to_single or dated or boolean else INCOMPATIBLE


def strategy(source: T.DataType, target: T.DataType) -> str:
    """How a pair of types is converted."""
    src, tgt = source.simpleString(), target.simpleString()
    if src == "string" and tgt in _TEMPORAL:
        return "date_parsing"
    if src in _TEMPORAL and tgt == "string":
        return "date_formatting"
    if isinstance(source, T.NumericType) and isinstance(target, T.NumericType):
        return "numeric_conversion"
    if src == "boolean":
        return "boolean_conversion"
    return "string_conversion" if tgt == "string" else "auto_cast"


def convert(
    value: Column, source: T.DataType, target: T.DataType, formats: Iterable[str] = dates.DATE_FORMATS
) -> Column:
    """Convert one column; what cannot be converted becomes null."""
    if source == target:
        return value
    how, tgt = strategy(source, target), target.simpleString()
    if how == "date_parsing":
        parsed = dates.parse_date(value, formats)
        return parsed if tgt == "date" else parsed.cast("timestamp_ntz").cast(target)
    if how == "date_formatting":
        return dates.format_date(value)
    return value.try_cast(target)


def missing_column(target: T.DataType) -> Column:
    return F.lit(None).cast(target)


def fetch(df: DataFrame, names: Iterable[str], target: T.DataType, required: bool = False, **options) -> Column:
    """The column delivered under one of the names, converted; several present ones fill each other's nulls."""
    wanted = list(names)
    present = [n for n in wanted if n in df.columns]
    if not present:
        if required:
            raise ValueError(f"required column missing: {wanted[0]}")
        return missing_column(target)
    return F.coalesce(*(convert(F.col(n), df.schema[n].dataType, target, **options) for n in present))


def adapt(
    df: DataFrame, target: T.StructType, strict: bool = True, formats: Iterable[str] = dates.DATE_FORMATS
) -> DataFrame:
    """Coerce to the target schema; missing columns become typed nulls.

    ``strict`` rejects pairs outside the compatibility rules; otherwise they are cast where possible.
    """
    if strict:
        bad = [
            f"{f.name}: {df.schema[f.name].dataType.simpleString()} -> {f.dataType.simpleString()}"
            for f in target.fields
            if f.name in df.columns and compatibility(df.schema[f.name].dataType, f.dataType) == INCOMPATIBLE
        ]
        if bad:
            raise ValueError("incompatible columns: " + ", ".join(bad))
    return df.select(*(fetch(df, [f.name], f.dataType, formats=formats).alias(f.name) for f in target.fields))


def adapt_register(df: DataFrame, spec: RegisterSpec, keep: Iterable[str] = ()) -> DataFrame:
    """Delivered columns under their declared names and types, aliases resolved; ``keep`` passes through."""
    return df.select(
        *(fetch(df, f.names, f.data_type, required=f.source == spec.id_column).alias(f.source) for f in spec.fields),
        *keep,
    )


def adaptation_report(spark: SparkSession, source: T.StructType, target: T.StructType) -> DataFrame:
    """Per target field: exact, compatible with a strategy, incompatible, or missing. One row per column."""
    by_name = {f.name: f.dataType for f in source.fields}
    rows = []
    for position, f in enumerate(target.fields):
        found, wanted = by_name.get(f.name), f.dataType.simpleString()
        if found is None:
            rows.append((position, f.name, None, wanted, "missing", None))
            continue
        status = compatibility(found, f.dataType)
        how = strategy(found, f.dataType) if status == COMPATIBLE else None
        rows.append((position, f.name, found.simpleString(), wanted, status, how))
    return spark.createDataFrame(rows, REPORT_SCHEMA)


def rename_columns(df: DataFrame, mapping: dict[str, str]) -> DataFrame:
    """Source names to canonical names; names that are absent are ignored."""
    return df.withColumnsRenamed(mapping)


# Canonical names of hospital columns in both generations.
LPR2_NAMES = {
    "PNR": "patient_id", "C_ADIAG": "primary_diagnosis", "C_DIAGTYPE": "diagnosis_type",
    "D_INDDTO": "admission_date", "D_UDDTO": "discharge_date",
}
LPR3_NAMES = {
    "CPR": "patient_id", "cpr": "patient_id", "aktionsdiagnose": "primary_diagnosis",
    "diagnosekode": "primary_diagnosis", "diagnosetype": "diagnosis_type", "diagnose_type": "diagnosis_type",
    "dato_start": "admission_date", "starttidspunkt": "admission_date",
    "dato_slut": "discharge_date", "sluttidspunkt": "discharge_date",
}
