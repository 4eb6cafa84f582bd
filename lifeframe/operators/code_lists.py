"""Diagnoses joined with tables of codes by prefix."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lifeframe.functions import icd

_LONGEST, _ALL = "longest", "all"


def prefixes_of(codes: DataFrame, column: str, lengths: list[int]) -> DataFrame:
    """``codes`` with ``_prefix``: one row for each of the lengths that a code reaches."""
    wanted = F.filter(F.array(*(F.lit(n) for n in lengths)), lambda n: n <= F.length(column))
    return codes.withColumn("_prefix", F.explode(F.transform(wanted, lambda n: F.left(F.col(column), n))))


def with_code_list(diagnoses: DataFrame, codes: DataFrame, prefix: str = "prefix", match: str = "longest", code: str = "diagnosis_code") -> DataFrame:
    """Diagnoses with the columns of the entries of a code list that their cleaned code starts with; others are left out.

    ``match="longest"`` takes the entry with the longest prefix (of equal ones the smallest row), ``"all"`` every one. The list is a table of any
    length: only the lengths of its prefixes pass through the driver, at most the length of a code. Distinct codes are looked up by
    equality under as many prefixes as there are lengths, and diagnoses are joined with what was found, so neither the plan nor the rows
    grow with the list. Column names of the list must not be among those of the diagnoses.
    """
    if match not in (_LONGEST, _ALL):
        raise ValueError(f"unknown way to match {match!r}")
    entries = codes.withColumn("_entry", icd.clean_code(F.col(prefix))).filter("length(_entry) > 0")
    lengths = sorted(r[0] for r in entries.select(F.length("_entry")).distinct().collect())
    distinct = diagnoses.select(icd.clean_code(F.col(code)).alias("_code")).filter("_code is not null").distinct()
    met = prefixes_of(distinct, "_code", lengths).join(entries, F.col("_prefix") == F.col("_entry"))
    if match == _LONGEST:
        ranked = met.groupBy("_code", F.length("_prefix").alias("_n")).agg(F.min(F.struct(*codes.columns)).alias("_row"))
        met = ranked.groupBy("_code").agg(F.max_by("_row", "_n").alias("_row")).select("_code", "_row.*")
    else:
        met = met.select("_code", *codes.columns)
    return diagnoses.join(met, icd.clean_code(F.col(code)) == F.col("_code")).drop("_code")
