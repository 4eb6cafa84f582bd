"""From registers to a study: population, disease, families, matched groups and their balance."""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lifeframe.operators import balance as B
from lifeframe.operators import chronic, cohort, diagnoses, families, income, mapping, matching
from lifeframe.operators import persons as people
from lifeframe.session import materialize
from lifeframe.sources.specs import register


@dataclass(frozen=True)
class Population:
    """Frames of a study population."""

    persons: DataFrame
    members: DataFrame
    families: DataFrame
    diagnoses: DataFrame
    chronic: DataFrame
    snapshots: DataFrame


def _mapped(registers: Mapping[str, DataFrame], name: str) -> DataFrame | None:
    """Person fields of a register, with the ``period`` of each row's delivery where it has one."""
    if name not in registers:
        return None
    keep = ["period"] if "period" in registers[name].columns else []
    return mapping.map_register(registers[name], register(name), keep)


def study_persons(registers: Mapping[str, DataFrame], index_date: dt.date | None = None) -> DataFrame:
    """Population register, completed by birth and death registers, one row per person.

    A person's row is one delivered row as a whole. Where the population rows carry the ``period`` of their delivery, it is the row
    of the last delivery that begins on or before ``index_date``, or of the first one after it for who is not in any before;
    without an index date it is the row of the last delivery.
    """
    base = _mapped(registers, "bef")
    wanted = ["gender", "birth_date", "mother_pnr", "father_pnr", "family_id", "children_count", "municipality_code", "immigration_type"]
    first = []
    if "period" in base.columns:
        start = F.unix_date("period.start")
        day = F.lit(None).cast("int") if index_date is None else F.unix_date(F.lit(index_date))
        after = F.coalesce(start > day, F.lit(False))
        first = [after, F.when(after, start).otherwise(-start), F.when(after, F.unix_date("period.end")).otherwise(-F.unix_date("period.end"))]
    one = cohort.whole_row(base, "pnr", wanted, first)
    births = _mapped(registers, "mfr")
    if births is not None:
        details = ["mother_pnr", "father_pnr", "birth_date", "birth_weight", "gestational_age", "apgar_score"]
        one = mapping.fill_missing(one, cohort.whole_row(births, "pnr", details))
    deaths = _mapped(registers, "dod")
    if deaths is None:
        return one.withColumn("death_date", F.lit(None).cast("date"))
    return one.join(people.death_dates(deaths), "pnr", "left")


def population(
    registers: Mapping[str, DataFrame],
    index_date: dt.date,
    cohort_frame: DataFrame | None = None,
    income_type: str = "total_personal",
    hospital: diagnoses.HospitalConfig | None = None,
    disease: chronic.ChronicConfig | None = None,
    keep: bool = True,
) -> Population:
    """Build and link the population: persons, migration, deaths, hospital diagnoses and incomes.

    ``registers`` holds raw register frames by register name; ``bef`` is required, the others are used when
    given. Snapshots carry the parents' summed income of the index year. With ``keep``, persons and
    diagnoses, from which everything else is derived, are written to the shared scratch folder once.
    """
    def kept(df: DataFrame, name: str) -> DataFrame:
        return materialize(df, name) if keep else df

    persons = study_persons(registers, index_date)
    if cohort_frame is not None:
        persons = cohort.restrict(persons, cohort_frame)
    persons = kept(persons, "study-persons")
    members = kept(families.family_members(persons), "study-members")
    built = families.build_families(members)
    events = None if "vnds" not in registers else people.migration_events(_mapped(registers, "vnds"))
    sick = diagnoses.hospital_diagnoses(
        registers.get("lpr_adm"), registers.get("lpr_diag"), registers.get("lpr3_kontakter"), registers.get("lpr3_diagnoser"),
        hospital, cohort_frame,
    )
    sick = kept(sick, "study-diagnoses")
    results = chronic.chronic_results(sick, disease, people.birth_dates(persons))
    shown = families.snapshot(members, index_date, events, results)
    if "ind" in registers:
        money = income.series(mapping.incomes(_mapped(registers, "ind"))).filter(
            (F.col("income_type") == income_type) & (F.col("year") == index_date.year)
        )
        per_family = (
            members.filter(F.col("role") != families.CHILD).select("family_id", "pnr")
            .join(money.select("pnr", "amount"), "pnr")
            .groupBy("family_id")
            .agg(F.sum("amount").alias("parental_income"))
        )
        shown = shown.join(per_family, "family_id", "left")
    return Population(persons, members, built, sick, results, shown)


@dataclass(frozen=True)
class MatchedStudy:
    pairs: DataFrame
    cases: DataFrame
    controls: DataFrame
    balance: DataFrame
    summary: DataFrame


def matched_study(
    people_frame: DataFrame, case_ids: DataFrame, index_date: dt.date, config: matching.MatchingConfig, education: DataFrame | None = None
) -> MatchedStudy:
    """Split persons by condition, match, and report the balance of the matched groups.

    Parents' birth dates, parental status and, from ``education``, the parents' education are attached for the criteria that ask for them.
    """
    criteria = config.criteria
    if criteria.match_parent_age or criteria.match_parental_status or criteria.match_education:
        people_frame = people.matching_attributes(people_frame, education)
    cases, controls = people.case_control_tables(people_frame, case_ids, index_date)
    result = matching.match(cases, controls, config)
    metrics = B.balance(result.matched_cases, result.matched_controls)
    return MatchedStudy(result.pairs, result.matched_cases, result.matched_controls, metrics, B.balance_summary(metrics))
