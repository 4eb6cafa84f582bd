"""Families: roles, snapshots at a date, siblings, selection and summary statistics.

Families are long tables. ``members`` is ``(family_id, pnr, role, birth_date, death_date, ...)`` with one
row per person and role; everything per family is one aggregate over it, partially aggregated before
its shuffle, so a family id shared by very many rows costs no more than any other.
"""

from __future__ import annotations

import datetime as dt
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lifeframe.functions import codes, icd
from lifeframe.functions import persons as fn
from lifeframe.functions.predicates import valid_at
from lifeframe.operators.intervals import overlapping
from lifeframe.operators.persons import with_residency
from lifeframe.operators.ranking import number_slices, spread

MOTHER, FATHER, CHILD = "mother", "father", "child"
# Stands for an unknown birth date: earlier than day number -719162, the first of year 1.
_BEFORE_ALL_DAYS = -1_000_000


def family_type(mother: Column, father: Column) -> Column:
    return (
        F.when(mother & father, F.lit("TwoParent"))
        .when(mother, F.lit("SingleMother"))
        .when(father, F.lit("SingleFather"))
        .otherwise(F.lit("NoParent"))
    )


def families_at(persons: DataFrame, date: dt.date) -> DataFrame:
    """One row per family id: members, children, and the type by the women and men who are no children."""
    child = fn.is_child(F.col("birth_date"), F.col("death_date"), F.lit(date))
    gender = codes.decode(F.col("gender"), "gender")
    counted = persons.filter(F.col("family_id").isNotNull()).groupBy("family_id").agg(
        F.count(F.lit(1)).alias("members"),
        F.count_if(child).alias("children"),
        F.count_if(~child & (gender == "Female")).alias("women"),
        F.count_if(~child & (gender == "Male")).alias("men"),
    )
    return counted.withColumn("family_type", family_type(F.col("women") > 0, F.col("men") > 0))


def family_parents(persons: DataFrame) -> DataFrame:
    """Mother and father per family with their person columns.

    A parent is linked by a member of the family and is itself among the persons. Where members link to
    several, the one linked most often is taken, then the larger id.
    """
    linked = persons.filter(F.col("family_id").isNotNull()).select(
        "family_id",
        F.stack(
            F.lit(2), F.lit(MOTHER), F.col("mother_pnr"), F.lit(FATHER), F.col("father_pnr")
        ).alias("role", "pnr"),
    )
    counted = linked.filter(F.col("pnr").isNotNull()).groupBy("family_id", "role", "pnr").agg(
        F.count(F.lit(1)).alias("_links")
    )
    details = _details(persons)
    known = counted.join(persons.select(*details), "pnr")
    best = F.max_by(F.struct(*details), F.struct("_links", "pnr")).alias("_parent")
    return known.groupBy("family_id", "role").agg(best).select("family_id", "role", "_parent.*")


def _details(persons: DataFrame) -> list[str]:
    return [c for c in persons.columns if c not in ("family_id", "mother_pnr", "father_pnr")]


def family_members(persons: DataFrame) -> DataFrame:
    """Parents and children per family.

    Children are members with a parent link who are not themselves a parent of that family. Parents are
    listed in the family of their children, wherever they are registered.
    """
    parents = family_parents(persons)
    linked = persons.filter(
        F.col("family_id").isNotNull() & (F.col("mother_pnr").isNotNull() | F.col("father_pnr").isNotNull())
    )
    children = linked.select("family_id", F.lit(CHILD).alias("role"), *_details(persons)).join(
        parents.select("family_id", "pnr"), ["family_id", "pnr"], "left_anti"
    )
    return parents.unionByName(children)


def study_persons(
    persons: DataFrame,
    index_date: dt.date,
    resident_only: bool = True,
    min_age: int | None = None,
    max_age: int | None = None,
    events: DataFrame | None = None,
) -> DataFrame:
    """Persons of a study: residents at the index date, within the age range.

    An unknown age fails the minimum and passes the maximum. Residency follows migration events when
    given and is being alive otherwise.
    """
    birth, death, when = F.col("birth_date"), F.col("death_date"), F.lit(index_date)
    result = persons
    if resident_only:
        result = result.filter(fn.alive_at(birth, death, when))
        if events is not None:
            result = with_residency(result, events, index_date).filter("resident").drop("resident")
    age = fn.age_at(birth, death, when)
    if min_age is not None:
        result = result.filter(F.coalesce(age >= min_age, F.lit(False)))
    if max_age is not None:
        result = result.filter(F.coalesce(age <= max_age, F.lit(True)))
    return result


def build_families(members: DataFrame, two_parent_only: bool = False) -> DataFrame:
    """Families with at least one child, and with both parents when asked for."""
    families = members.groupBy("family_id").agg(
        F.max(F.when(F.col("role") == MOTHER, F.col("pnr"))).alias("mother_pnr"),
        F.max(F.when(F.col("role") == FATHER, F.col("pnr"))).alias("father_pnr"),
        F.count_if(F.col("role") == CHILD).alias("children"),
    )
    families = families.filter(F.col("children") > 0)
    if two_parent_only:
        families = families.filter(F.col("mother_pnr").isNotNull() & F.col("father_pnr").isNotNull())
    return families.withColumn(
        "family_type", family_type(F.col("mother_pnr").isNotNull(), F.col("father_pnr").isNotNull())
    )


def snapshot(
    members: DataFrame,
    date: dt.date | Column,
    events: DataFrame | None = None,
    health: DataFrame | None = None,
    families: DataFrame | None = None,
) -> DataFrame:
    """Families as they were at a date, or each member's row at its own date.

    With a column as ``date`` the result has a row per family and ``snapshot_date``; ``at_own_dates`` gives families their dates.
    Children count when alive and resident, parents when resident. ``health`` is one row per person with
    ``first_scd_date`` and ``first_diagnosis_date`` (the chronic-disease results have both); a parent's
    comorbidity needs a diagnosis strictly before the date. ``families`` adds its attributes and, with
    ``valid_from``/``valid_to``, limits the result to families valid at the date.
    """
    own = isinstance(date, Column)
    birth, death, when = F.col("birth_date"), F.col("death_date"), F.col("snapshot_date") if own else F.lit(date)
    state = members.withColumn("snapshot_date", date).filter("snapshot_date is not null") if own else members
    if events is not None:
        state = with_residency(state, events, when if own else date)
    else:
        state = state.withColumn("resident", fn.alive_at(birth, death, when))
    first_scd = first_diagnosis = F.lit(None).cast("date")
    if health is not None:
        known = health.select(
            "pnr", F.col("first_scd_date").alias("_scd"), F.col("first_diagnosis_date").alias("_sick")
        )
        state = state.join(known, "pnr", "left")
        first_scd, first_diagnosis = F.col("_scd"), F.col("_sick")
    role, here = F.col("role"), F.col("resident")
    child_here = (role == CHILD) & here & fn.alive_at(birth, death, when)
    parent_here = role.isin(MOTHER, FATHER) & here
    per_family = state.groupBy("family_id", *(["snapshot_date"] if own else [])).agg(
        F.max(F.when((role == MOTHER) & here, F.col("pnr"))).alias("mother_pnr"),
        F.max(F.when((role == FATHER) & here, F.col("pnr"))).alias("father_pnr"),
        F.count_if(child_here).alias("children"),
        F.count_if(child_here & F.coalesce(first_scd <= when, F.lit(False))).alias("scd_children"),
        F.bool_or(parent_here & F.coalesce(first_diagnosis < when, F.lit(False))).alias("has_parental_comorbidity"),
        *(
            [F.max(F.when(role != CHILD, F.col("municipality_code"))).alias("municipality_code")]
            if "municipality_code" in members.columns
            else []
        ),
    )
    result = per_family.withColumns(
        {
            "family_type": family_type(F.col("mother_pnr").isNotNull(), F.col("father_pnr").isNotNull()),
            "has_scd_child": F.col("scd_children") > 0,
            "snapshot_date": when,
        }
    )
    if "municipality_code" in result.columns:
        result = result.withColumn("is_rural", fn.is_rural(F.col("municipality_code")))
    if families is not None:
        added = [c for c in families.columns if c == "family_id" or c not in result.columns]
        result = result.join(families.select(*added), "family_id")
        if "valid_from" in added:
            end = F.col("valid_to") if "valid_to" in added else F.lit(None).cast("date")
            result = result.filter(valid_at(F.col("valid_from"), end, when))
    return result


def at_own_dates(members: DataFrame, dates: DataFrame) -> DataFrame:
    """Members with the ``date`` of each row of ``dates`` (family_id, date) of their family: what ``snapshot`` takes for dates of their own."""
    return members.join(dates.select("family_id", "date").distinct(), "family_id")


def families_valid_in(families: DataFrame, windows: DataFrame, bounds: tuple[str, str]) -> DataFrame:
    """Each family with every window of a table that its validity shares a day with. A family without a start is never valid."""
    return overlapping(families.filter(F.col("valid_from").isNotNull()), windows, ("valid_from", "valid_to"), bounds)


def families_valid_at(families: DataFrame, date: dt.date) -> DataFrame:
    return families.filter(valid_at(F.col("valid_from"), F.col("valid_to"), F.lit(date)))


def families_of_type(families: DataFrame, kind: str) -> DataFrame:
    return families.filter(F.col("family_type") == kind)


def case_families(snapshots: DataFrame) -> DataFrame:
    return snapshots.filter("has_scd_child")


def control_families(snapshots: DataFrame) -> DataFrame:
    return snapshots.filter(~F.col("has_scd_child"))


def family_predicate(
    kind: str | None = None,
    min_children: int | None = None,
    max_children: int | None = None,
    municipality: str | None = None,
    rural: bool | None = None,
    has_scd_child: bool | None = None,
    parental_comorbidity: bool | None = None,
    support_network: bool | None = None,
    valid_on: dt.date | None = None,
):
    """One predicate over families or snapshots from the given conditions, all of which must hold."""
    equal = {
        "family_type": kind,
        "municipality_code": municipality,
        "is_rural": rural,
        "has_scd_child": has_scd_child,
        "has_parental_comorbidity": parental_comorbidity,
        "has_support_network": support_network,
    }

    def test(df: DataFrame) -> Column:
        hit = F.lit(True)
        for name, value in equal.items():
            if value is not None:
                hit = hit & F.coalesce(F.col(name) == F.lit(value), F.lit(False))
        if min_children is not None:
            hit = hit & (F.col("children") >= min_children)
        if max_children is not None:
            hit = hit & (F.col("children") <= max_children)
        if valid_on is not None:
            hit = hit & valid_at(F.col("valid_from"), F.col("valid_to"), F.lit(valid_on))
        return hit

    return test


def siblings(children: DataFrame) -> DataFrame:
    """Children of families with more than one: birth order, years to the previous child, any affected sibling.

    ``children`` is ``(family_id, pnr, birth_date[, has_scd])``. Unknown birth dates come first and have no
    gap; equal birth dates are ordered by a hash of the id. Children are numbered per slice of a birth
    date; only the slices of a family, bounded by the calendar, meet in one window.
    """
    flag = F.coalesce("has_scd", F.lit(False)) if "has_scd" in children.columns else F.lit(False)
    rows = children.filter(F.col("family_id").isNotNull()).select(
        "family_id", "pnr", flag.alias("has_scd"),
        F.coalesce(F.unix_date("birth_date"), F.lit(_BEFORE_ALL_DAYS)).alias("_day"),
        spread(F.col("pnr")).alias("_slice"),
    )
    local, slices = number_slices(
        rows, ["family_id"], ["_day", "_slice"], [F.md5("pnr"), F.col("pnr")], {"_any": F.max("has_scd")}
    )
    family = Window.partitionBy("family_id")
    earlier_slices = family.orderBy("_day", "_slice").rowsBetween(Window.unboundedPreceding, -1)
    earlier_days = family.orderBy("_day").rangeBetween(Window.unboundedPreceding, -1)
    placed = slices.withColumns(
        {
            "_before": F.coalesce(F.sum("_n").over(earlier_slices), F.lit(0)),
            "_before_day": F.coalesce(F.sum("_n").over(earlier_days), F.lit(0)),
            "_previous_day": F.max("_day").over(earlier_days),
            "siblings": F.sum("_n").over(family),
            "has_sibling_with_scd": F.max("_any").over(family),
        }
    ).filter(F.col("siblings") > 1).drop("_n", "_any")
    joined = local.join(placed, ["family_id", "_day", "_slice"]).withColumn(
        "birth_order", F.col("_local") + F.col("_before")
    )
    known = F.col("_day") > _BEFORE_ALL_DAYS
    # The birth date is restored from its day number, so that both uses of the rows read the same shuffle.
    birth = F.when(known, F.date_from_unix_date("_day"))
    gap_days = F.when(known & (F.col("birth_order") > F.col("_before_day") + 1), F.lit(0)).when(
        known & (F.col("_previous_day") > _BEFORE_ALL_DAYS), F.col("_day") - F.col("_previous_day")
    )
    return joined.select(
        "family_id", "pnr", birth.alias("birth_date"), "has_scd", "birth_order", "siblings",
        (gap_days / F.lit(365.25)).alias("years_since_previous"), "has_sibling_with_scd",
    )


def link_child_diagnoses(children: DataFrame, diagnoses: DataFrame) -> DataFrame:
    """Simple chronic-disease state per child: flag, first date, category, severity, origin.

    Diagnoses are reduced to one row per person before they meet the children.
    """
    code, date = F.col("diagnosis_code"), F.col("diagnosis_date")
    scd = icd.simple_is_scd(code)
    state = diagnoses.groupBy("pnr").agg(
        F.bool_or(scd).alias("has_scd"),
        F.min(F.when(scd, date)).alias("first_scd_date"),
        *(F.bool_or(F.coalesce(code.startswith(p), F.lit(False))).alias(f"_{p}") for p in ("C", "D80", "G71", "Q")),
    )
    category = (
        F.when(F.col("_C"), F.lit(1)).when(F.col("_D80"), F.lit(2)).when(F.col("_G71"), F.lit(4)).when(F.col("_Q"), F.lit(10))
    )
    known = F.coalesce("has_scd", F.lit(False))
    return children.join(state, "pnr", "left").select(
        *children.columns,
        known.alias("has_scd"),
        "first_scd_date",
        F.when(known, F.coalesce(category, F.lit(0))).alias("scd_category"),
        F.when(known, F.lit(2)).alias("disease_severity"),
        F.when(known, F.when(F.col("_Q"), "Congenital").otherwise("Acquired")).alias("disease_origin"),
    )


def had_scd_at(first_scd_date: Column, date: Column) -> Column:
    return F.coalesce(first_scd_date <= date, F.lit(False))


def with_onset_age(children: DataFrame) -> DataFrame:
    """Adds ``age_at_onset``: completed years when the first chronic diagnosis was made."""
    return children.withColumn(
        "age_at_onset", fn.age_at(F.col("birth_date"), F.col("death_date"), F.col("first_scd_date"))
    )


def parent_state(
    parents: DataFrame, diagnoses: DataFrame, incomes: DataFrame, date: dt.date, first_year: int, last_year: int
) -> DataFrame:
    """Per parent: any diagnosis, any strictly before the date, and income over the years.

    ``incomes`` is ``(pnr, year, amount)``. Both sides are aggregated per person before the join.
    """
    sick = diagnoses.groupBy("pnr").agg(
        F.lit(True).alias("has_comorbidity"), F.min("diagnosis_date").alias("first_diagnosis_date")
    )
    money = incomes.filter(F.col("year").between(first_year, last_year)).groupBy("pnr").agg(
        F.count(F.lit(1)).alias("income_years"), F.sum("amount").alias("income_total")
    )
    joined = parents.join(sick, "pnr", "left").join(money, "pnr", "left")
    return joined.withColumns(
        {
            "has_comorbidity": F.coalesce("has_comorbidity", F.lit(False)),
            "had_diagnosis_before": F.coalesce(F.col("first_diagnosis_date") < F.lit(date), F.lit(False)),
            "income_years": F.coalesce("income_years", F.lit(0)),
        }
    )


def parents_with_income_above(parents: DataFrame, threshold: float, column: str = "income") -> DataFrame:
    """Parents above a threshold; an unknown income counts as 0."""
    return parents.filter(F.coalesce(F.col(column), F.lit(0.0)) > threshold)


def basic_stats(persons: DataFrame, families: DataFrame, snapshots: DataFrame) -> DataFrame:
    """One row: persons, families, children in snapshots, two-parent families, families with an affected child."""
    shown = snapshots.agg(
        F.coalesce(F.sum("children"), F.lit(0)).alias("children"),
        F.count_if(F.col("family_type") == "TwoParent").alias("two_parent_families"),
        F.count_if("has_scd_child").alias("scd_families"),
    )
    parts = (
        persons.agg(F.count(F.lit(1)).alias("persons")),
        families.agg(F.count(F.lit(1)).alias("families")),
        shown,
    )
    stacked = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    return stacked.agg(*(F.max(c).alias(c) for c in stacked.columns))


def study_summary(snapshots: DataFrame) -> DataFrame:
    """Case and control families as ``(metric, value)`` rows: sizes, type shares, and the feasible ratio."""
    case = F.col("has_scd_child")
    types = ("TwoParent", "SingleMother", "SingleFather", "NoParent")
    row = snapshots.agg(
        F.count_if(case).alias("case_families"),
        F.count_if(~case).alias("control_families"),
        F.coalesce(F.sum(F.when(case, F.col("scd_children"))), F.lit(0)).alias("scd_children"),
        F.avg(F.when(case, F.col("children"))).alias("children_per_case_family"),
        F.avg(F.when(~case, F.col("children"))).alias("children_per_control_family"),
        *(F.count_if(case & (F.col("family_type") == t)).alias(f"case_{t}") for t in types),
    )
    cases, controls = F.col("case_families"), F.col("control_families")
    ratio = F.when((cases > 0) & (controls > 0), controls / cases)
    values = {
        "case_families": cases.cast("double"),
        "control_families": controls.cast("double"),
        "scd_children": F.col("scd_children").cast("double"),
        "children_per_case_family": F.col("children_per_case_family"),
        "children_per_control_family": F.col("children_per_control_family"),
        **{f"case_share_{t}": F.try_divide(F.col(f"case_{t}") * 100.0, cases) for t in types},
        "control_to_case_ratio": ratio,
        # 3: three to one is feasible, 1: one to one, 0: relax the criteria.
        "recommended_ratio": F.when(ratio >= 3, F.lit(3.0)).when(ratio >= 1, F.lit(1.0)).when(ratio.isNotNull(), F.lit(0.0)),
    }
    pairs = [part for name, value in values.items() for part in (F.lit(name), value)]
    return row.select(F.stack(F.lit(len(values)), *pairs).alias("metric", "value"))
