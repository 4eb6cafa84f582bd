"""Hospital diagnoses from both register generations."""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lifeframe.functions import codes, icd
from lifeframe.operators import cohort as C
from lifeframe.sources import specs
from lifeframe.sources.adapt import fetch

DIAGNOSIS_COLUMNS = ("pnr", "diagnosis_code", "diagnosis_type", "diagnosis_date")


@dataclass(frozen=True)
class HospitalConfig:
    """Which generations to use, an optional inclusive date range, and column renames per generation."""

    use_lpr2: bool = True
    use_lpr3: bool = True
    start: dt.date | None = None
    end: dt.date | None = None
    lpr2_names: dict[str, str] = field(default_factory=dict)
    lpr3_names: dict[str, str] = field(default_factory=dict)

    @classmethod
    def lpr2_only(cls, **options) -> HospitalConfig:
        return cls(use_lpr3=False, **options)

    @classmethod
    def lpr3_only(cls, **options) -> HospitalConfig:
        return cls(use_lpr2=False, **options)


def _in_range(df: DataFrame, config: HospitalConfig, date: str) -> DataFrame:
    """Undated rows are kept."""
    if config.start is not None:
        df = df.filter(F.coalesce(F.col(date) >= F.lit(config.start), F.lit(True)))
    if config.end is not None:
        df = df.filter(F.coalesce(F.col(date) <= F.lit(config.end), F.lit(True)))
    return df


def _select(df: DataFrame, register: str, *sources: str) -> DataFrame:
    spec = specs.register(register)
    wanted = [spec.find(s) for s in sources]
    return df.select(*(fetch(df, f.names, f.data_type).alias(f.target) for f in wanted))


def from_admissions(adm: DataFrame, diag: DataFrame, config: HospitalConfig | None = None) -> DataFrame:
    """Older generation: the admission's own diagnosis plus the linked ones that differ from it.

    The date is the admission date. Record keys that are null link to nothing.
    """
    config = config or HospitalConfig()
    admitted = _select(adm.withColumnsRenamed(config.lpr2_names), "lpr_adm", "PNR", "RECNUM", "C_ADIAG", "D_INDDTO")
    admitted = _in_range(admitted.filter(F.col("pnr").isNotNull()), config, "admission_date")
    primary = admitted.filter(F.col("action_diagnosis").isNotNull()).select(
        "pnr",
        F.col("action_diagnosis").alias("diagnosis_code"),
        F.lit("Primary").alias("diagnosis_type"),
        F.col("admission_date").alias("diagnosis_date"),
    )
    linked = _select(diag.withColumnsRenamed(config.lpr2_names), "lpr_diag", "RECNUM", "C_DIAG", "C_DIAGTYPE")
    secondary = (
        admitted.join(linked.filter(F.col("diagnosis_code").isNotNull()), "record_number")
        .filter(~F.col("diagnosis_code").eqNullSafe(F.col("action_diagnosis")))
        .select(
            "pnr",
            "diagnosis_code",
            codes.decode(F.col("diagnosis_type"), "diagnosis_type").alias("diagnosis_type"),
            F.col("admission_date").alias("diagnosis_date"),
        )
    )
    return primary.unionByName(secondary)


def from_contacts(contacts: DataFrame, diag: DataFrame, config: HospitalConfig | None = None) -> DataFrame:
    """Newer generation: diagnoses of known contacts with the contact's person and start date.

    A contact delivered twice counts once, by its latest start and then its larger id.
    """
    config = config or HospitalConfig()
    started = _select(contacts.withColumnsRenamed(config.lpr3_names), "lpr3_kontakter", "CPR", "DW_EK_KONTAKT", "dato_start")
    known = started.filter(F.col("dw_ek_kontakt").isNotNull() & F.col("pnr").isNotNull())
    one = known.groupBy("dw_ek_kontakt").agg(F.max(F.struct("start_date", "pnr")).alias("c")).select(
        "dw_ek_kontakt", "c.pnr", F.col("c.start_date").alias("diagnosis_date")
    )
    coded = _select(
        diag.withColumnsRenamed(config.lpr3_names), "lpr3_diagnoser", "DW_EK_KONTAKT", "diagnosekode", "diagnosetype"
    ).filter(F.col("diagnosis_code").isNotNull())
    return coded.join(_in_range(one, config, "diagnosis_date"), "dw_ek_kontakt").select(
        "pnr",
        "diagnosis_code",
        codes.decode(F.col("diagnosis_type"), "diagnosis_type").alias("diagnosis_type"),
        "diagnosis_date",
    )


def hospital_diagnoses(
    adm: DataFrame | None = None,
    diag: DataFrame | None = None,
    contacts: DataFrame | None = None,
    contact_diag: DataFrame | None = None,
    config: HospitalConfig | None = None,
    cohort: DataFrame | None = None,
) -> DataFrame:
    """Diagnoses of all generations that are given and switched on, for the cohort.

    The cohort restricts admissions and contacts before they are joined, so rows outside it never shuffle.
    """
    config = config or HospitalConfig()
    if cohort is not None:
        adm = None if adm is None else C.restrict(adm, cohort)
        contacts = None if contacts is None else C.restrict(contacts, cohort)
    parts = []
    if config.use_lpr2 and adm is not None and diag is not None:
        parts.append(from_admissions(adm, diag, config))
    if config.use_lpr3 and contacts is not None and contact_diag is not None:
        parts.append(from_contacts(contacts, contact_diag, config))
    if not parts:
        raise ValueError("no hospital generation is both given and switched on")
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result


def with_prefixes(diagnoses: DataFrame, prefixes: Iterable[str]) -> DataFrame:
    """Diagnoses whose cleaned code starts with any of the codes."""
    return diagnoses.filter(icd.has_any_prefix(F.col("diagnosis_code"), prefixes))


def of_person(diagnoses: DataFrame, pnr: str) -> DataFrame:
    return diagnoses.filter(F.col("pnr") == pnr)


def first_per_code(diagnoses: DataFrame) -> DataFrame:
    """The earliest diagnosis per person and code."""
    others = [c for c in diagnoses.columns if c not in ("pnr", "diagnosis_code")]
    order = F.struct(F.coalesce("diagnosis_date", F.lit(dt.date(9999, 12, 31))), F.col("diagnosis_type"))
    row = F.min_by(F.struct(*others), order).alias("_row")
    return diagnoses.groupBy("pnr", "diagnosis_code").agg(row).select("pnr", "diagnosis_code", "_row.*")


def first_dates(diagnoses: DataFrame) -> DataFrame:
    """The earliest diagnosis date per person."""
    return diagnoses.groupBy("pnr").agg(F.min("diagnosis_date").alias("first_diagnosis_date"))
