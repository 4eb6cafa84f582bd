"""From register rows to person fields, incomes and diagnoses."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lifeframe.functions import codes, icd
from lifeframe.functions.persons import is_rural
from lifeframe.sources.adapt import fetch
from lifeframe.sources.specs import RegisterSpec


def map_register(df: DataFrame, spec: RegisterSpec, keep: Iterable[str] = ()) -> DataFrame:
    """Person fields of a register; rows without an id are dropped. Columns named by ``keep`` are passed through."""
    def value(f) -> Column:
        if f.expression is not None:
            return f.expression
        return fetch(df, f.names, f.data_type, required=f.source == spec.id_column)

    mapped = df.select(*(value(f).alias(f.target) for f in spec.fields), *keep)
    key = F.col(spec.id_field)
    return mapped.filter(key.isNotNull() & (F.trim(key) != ""))


def individuals(df: DataFrame, spec: RegisterSpec) -> DataFrame:
    """``map_register`` plus the rural flag where a municipality is known to the register."""
    mapped = map_register(df, spec)
    if "municipality_code" not in mapped.columns:
        return mapped
    return mapped.withColumn("is_rural", is_rural(F.col("municipality_code")))


def fill_missing(persons: DataFrame, details: DataFrame, key: str = "pnr") -> DataFrame:
    """Left join that fills only null fields of ``persons``; new fields are added.

    ``details`` must hold at most one row per person (merge several with the longitudinal merge first).
    """
    shared = [c for c in details.columns if c in persons.columns and c != key]
    added = [c for c in details.columns if c not in persons.columns]
    incoming = details.select(key, *(F.col(c).alias(f"_in_{c}") for c in shared), *added)
    joined = persons.join(incoming, key, "left")
    kept = [
        F.coalesce(F.col(c), F.col(f"_in_{c}")).alias(c) if c in shared else F.col(c) for c in persons.columns
    ]
    return joined.select(*kept, *added)


def _dated_counts(df: DataFrame, keys: list[str], date: str, name: str) -> DataFrame:
    """Per key the dates with how often each occurs.

    Counting per date comes first, so an entry list is bounded by the calendar however many rows a key has.
    """
    per_day = df.filter(F.col(date).isNotNull()).groupBy(*keys, date).agg(F.count(F.lit(1)).alias("n"))
    return per_day.groupBy(*keys).agg(
        F.sort_array(F.collect_list(F.struct(F.col(date).alias("date"), "n"))).alias(name),
        F.sum("n").alias(f"{name}_count"),
        F.max(date).alias(f"last_{name}_date"),
    )


def admissions_per_person(adm: DataFrame) -> DataFrame:
    """Mapped admissions to one row per person: distinct diagnoses, dated admissions and discharges, bed days."""
    facts = adm.groupBy("pnr").agg(
        F.sort_array(F.collect_set("action_diagnosis")).alias("diagnoses"),
        F.sum("length_of_stay").alias("hospitalization_days"),
        F.max_by("length_of_stay", F.struct("admission_date", "record_number")).alias("length_of_stay"),
    )
    admitted = _dated_counts(adm, ["pnr"], "admission_date", "admissions")
    discharged = _dated_counts(adm, ["pnr"], "discharge_date", "discharges")
    return facts.join(admitted, "pnr", "left").join(discharged, "pnr", "left")


def diagnosis_codes(diag: DataFrame) -> DataFrame:
    """Mapped diagnosis records to their distinct codes, main and non-blank additional, one row per code."""
    both = F.array_compact(F.array("diagnosis_code", F.when(F.trim("additional_diagnosis") != "", F.col("additional_diagnosis"))))
    return diag.select("record_number", F.explode(F.array_distinct(both)).alias("diagnosis_code")).distinct()


def visits_per_person(visits: DataFrame, adm: DataFrame) -> DataFrame:
    """Mapped outpatient visits to dated counts per person, through their admission."""
    links = adm.filter(F.col("record_number").isNotNull()).groupBy("record_number").agg(F.min("pnr").alias("pnr"))
    # Counted per record and day before the join, so a record with very many visits stays a few rows.
    per_day = visits.filter(F.col("visit_date").isNotNull()).groupBy("record_number", "visit_date").agg(
        F.count(F.lit(1)).alias("n")
    )
    days = per_day.join(links, "record_number").groupBy("pnr", "visit_date").agg(F.sum("n").alias("n"))
    return days.groupBy("pnr").agg(
        F.sort_array(F.collect_list(F.struct(F.col("visit_date").alias("date"), "n"))).alias("outpatient_visits"),
        F.sum("n").alias("outpatient_visits_count"),
    )


def contacts_per_person(contacts: DataFrame) -> DataFrame:
    """Mapped contacts to one row per person: dated starts and ends, emergency contacts, primary codes."""
    kind = F.col("contact_type")
    facts = contacts.groupBy("pnr").agg(
        F.count_if(F.coalesce(kind.contains("akut") | kind.contains("emergency"), F.lit(False))).alias(
            "emergency_visits_count"
        ),
        F.sort_array(
            F.collect_set(F.when(F.trim("primary_diagnosis") != "", F.col("primary_diagnosis")))
        ).alias("diagnoses"),
    )
    admitted = _dated_counts(contacts, ["pnr"], "start_date", "admissions")
    discharged = _dated_counts(contacts, ["pnr"], "end_date", "discharges")
    return facts.join(admitted, "pnr", "left").join(discharged, "pnr", "left")


def contact_diagnoses(diag: DataFrame) -> DataFrame:
    """Mapped contact diagnoses to one row per contact: distinct codes and types, disproved flag."""
    return diag.groupBy("dw_ek_kontakt").agg(
        F.sort_array(F.collect_set(F.when(F.trim("diagnosis_code") != "", F.col("diagnosis_code")))).alias("diagnoses"),
        F.sort_array(F.collect_set("diagnosis_type")).alias("diagnosis_types"),
        F.bool_or(F.lower(F.trim("later_disproved")).isin("ja", "yes", "true", "1")).alias("later_disproved"),
    )


def incomes(ind: DataFrame, default_year: Column | None = None) -> DataFrame:
    """Mapped income rows to ``(pnr, year, income_type, amount)``: total, salary, and their positive difference.

    The year is the row's own, else ``default_year`` (for example the period of the delivery). A ``period`` column of the
    rows is kept, so that a later delivery can correct an earlier one.
    """
    year = F.col("income_year") if default_year is None else F.coalesce("income_year", default_year)
    total, salary = F.col("annual_income"), F.col("employment_income")
    rest = F.when(total - salary > 0, total - salary)
    typed = F.stack(
        F.lit(3), F.lit("total_personal"), total, F.lit("salary"), salary, F.lit("other"), rest
    ).alias("income_type", "amount")
    return (
        ind.select("pnr", year.cast("int").alias("year"), typed, *(["period"] if "period" in ind.columns else []))
        .filter(F.col("amount").isNotNull() & F.col("pnr").isNotNull())
    )


def diagnoses(df: DataFrame) -> DataFrame:
    """Register rows with a person id to diagnoses.

    Either naming is read: DIAG or C_DIAG, DIAGTYPE (letters) or C_DIAGTYPE (numbers), INDDTO or D_INDDTO.
    """
    def pick(*names: str) -> Column:
        return next((F.col(n) for n in names if n in df.columns), F.lit(None))

    code = pick("DIAG", "C_DIAG").cast("string")
    if "DIAGTYPE" in df.columns:
        letter = F.col("DIAGTYPE")
        kind = F.when(letter == "A", "Primary").when(letter == "B", "Secondary").otherwise("Other")
    else:
        number = pick("C_DIAGTYPE").try_cast("int")
        kind = F.when(number == 1, "Primary").when(number == 2, "Secondary").otherwise("Other")
    scd = icd.simple_is_scd(code)
    return df.filter(F.col("PNR").isNotNull() & code.isNotNull()).select(
        F.col("PNR").alias("pnr"),
        code.alias("diagnosis_code"),
        kind.alias("diagnosis_type"),
        pick("INDDTO", "D_INDDTO").cast("date").alias("diagnosis_date"),
        scd.alias("is_scd"),
        F.when(scd, icd.simple_severity(code)).otherwise(F.lit(1)).alias("severity"),
    )


def causes_of_death(rows: DataFrame) -> DataFrame:
    """Mapped causes of death with cleaned codes and the chapters of the cause."""
    def cleaned(c: str) -> Column:
        return F.upper(F.trim(F.col(c)))

    return rows.select(
        "pnr", "death_date", cleaned("death_cause").alias("death_cause"), cleaned("death_condition").alias("death_condition"),
        icd.chapters(cleaned("death_cause")).alias("chapters"),
    )


def record_diagnoses(diag: DataFrame, adm: DataFrame) -> DataFrame:
    """Mapped diagnosis records to diagnoses with their person, through the admission's record number."""
    links = adm.filter(F.col("record_number").isNotNull()).groupBy("record_number").agg(
        F.min("pnr").alias("pnr"), F.min("admission_date").alias("diagnosis_date")
    )
    return diag.filter(F.col("diagnosis_code").isNotNull()).join(links, "record_number").select(
        "pnr",
        "diagnosis_code",
        codes.decode(F.col("diagnosis_type"), "diagnosis_type").alias("diagnosis_type"),
        "diagnosis_date",
    )
