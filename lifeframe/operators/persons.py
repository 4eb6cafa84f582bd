"""Persons: selection by status, migration and death, roles, case and control tables."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lifeframe.functions import codes
from lifeframe.functions import persons as fn
from lifeframe.operators import cohort as C
from lifeframe.operators.asof import as_of


def on(date: dt.date | Column) -> Column:
    return date if isinstance(date, Column) else F.lit(date)


def with_status(persons: DataFrame, date: dt.date | Column) -> DataFrame:
    """Adds ``alive`` and ``age_at_date``, at one date or at each row's own."""
    birth, death, when = F.col("birth_date"), F.col("death_date"), on(date)
    return persons.withColumns(
        {"alive": fn.alive_at(birth, death, when), "age_at_date": fn.age_at(birth, death, when)}
    )


def alive(persons: DataFrame, date: dt.date | Column) -> DataFrame:
    return persons.filter(fn.alive_at(F.col("birth_date"), F.col("death_date"), on(date)))


def age_between(persons: DataFrame, low: int, high: int, date: dt.date | Column) -> DataFrame:
    """Persons of a known age in the inclusive range."""
    return persons.filter(fn.age_at(F.col("birth_date"), F.col("death_date"), on(date)).between(low, high))


def by_gender(persons: DataFrame, gender: str) -> DataFrame:
    return persons.filter(codes.decode(F.col("gender"), "gender") == gender)


def by_municipality(persons: DataFrame, municipality: str) -> DataFrame:
    return persons.filter(F.col("municipality_code") == municipality)


def children(persons: DataFrame, date: dt.date) -> DataFrame:
    """All persons who are under 18 and alive at the date."""
    return persons.filter(fn.is_child(F.col("birth_date"), F.col("death_date"), on(date)))


def parent_ids(persons: DataFrame) -> DataFrame:
    """Distinct ids occurring as someone's mother or father."""
    linked = persons.select(F.explode(F.array("mother_pnr", "father_pnr")).alias("pnr"))
    return linked.filter(F.col("pnr").isNotNull()).distinct()


def parents(persons: DataFrame) -> DataFrame:
    """Persons who occur as someone's mother or father."""
    return persons.join(parent_ids(persons), "pnr", "left_semi")


def with_role(persons: DataFrame, date: dt.date) -> DataFrame:
    """Adds ``role``: Child, Parent, ChildAndParent or Other."""
    marks = parent_ids(persons).withColumn("_parent", F.lit(True))
    child = fn.is_child(F.col("birth_date"), F.col("death_date"), on(date))
    joined = persons.join(marks, "pnr", "left")
    return joined.withColumn("role", fn.role_at(child, F.coalesce("_parent", F.lit(False)))).drop("_parent")


def relatives_of(persons: DataFrame, pnr: str) -> DataFrame:
    """Persons linked to one person as its mother, father, child or spouse."""
    own = persons.filter(F.col("pnr") == pnr)
    links = own.select(
        F.explode(F.array(*(F.col(c) for c in ("mother_pnr", "father_pnr", "spouse_pnr") if c in persons.columns)))
        .alias("pnr")
    )
    up = persons.join(links.filter(F.col("pnr").isNotNull()).distinct(), "pnr", "left_semi")
    down = persons.filter((F.col("mother_pnr") == pnr) | (F.col("father_pnr") == pnr))
    return up.unionByName(down).dropDuplicates(["pnr"])


def migration_events(vnds: DataFrame) -> DataFrame:
    """Mapped migration rows to events ``(pnr, event_date, is_emigration)``; undated rows are skipped.

    Codes are numbers (2 leaves) or letters (U leaves).
    """
    return vnds.filter(F.col("event_date").isNotNull()).select(
        "pnr", "event_date", F.coalesce(F.upper(F.trim("event_type")).isin("2", "U"), F.lit(False)).alias("is_emigration")
    )


def migration_counts(events: DataFrame) -> DataFrame:
    return events.agg(
        F.count_if("is_emigration").alias("emigrations"), F.count_if(~F.col("is_emigration")).alias("immigrations")
    )


def death_dates(dod: DataFrame) -> DataFrame:
    """One date per person, the latest of several; undated rows are skipped."""
    return dod.filter(F.col("death_date").isNotNull()).groupBy("pnr").agg(F.max("death_date").alias("death_date"))


def with_residency(persons: DataFrame, events: DataFrame, date: dt.date | Column) -> DataFrame:
    """Adds ``resident``: not dead before the date, and the last event up to it is no emigration.

    ``date`` is one date for all, or a column with each row's own. Events are reduced to one row per person (and day) before the join; an
    emigration wins a same-day tie. A row without a date of its own has an unknown status.
    """
    if isinstance(date, Column):
        own = as_of(persons.withColumn("_own", date), events, "pnr", "_own", "event_date", ["is_emigration"], "_last")
    else:
        last = (
            events.filter(F.col("event_date") <= on(date))
            .groupBy("pnr")
            .agg(F.max(F.struct("event_date", "is_emigration")).alias("_last"))
        )
        own = persons.withColumn("_own", on(date)).join(last, "pnr", "left")
    gone = F.coalesce(F.col("_last.is_emigration"), F.lit(False))
    dead = F.coalesce(F.col("death_date") < F.col("_own"), F.lit(False))
    return own.withColumn("resident", F.when(F.col("_own").isNotNull(), ~dead & ~gone)).drop("_last", "_own")


def birth_dates(persons: DataFrame) -> DataFrame:
    return persons.select("pnr", "birth_date").filter(F.col("birth_date").isNotNull())


def matching_attributes(persons: DataFrame, education: DataFrame | None = None) -> DataFrame:
    """``persons`` with what the criteria of matching ask for.

    Adds the parents' birth dates, ``parental_status`` by which parents are known, and from ``education`` (``pnr, education_code``)
    the parents' ``education_level``: the mother's code, else the father's. Each is joined as one row per person.
    """
    born = persons.filter(F.col("pnr").isNotNull()).groupBy("pnr").agg(F.min("birth_date").alias("_born"))
    df = persons
    for parent in ("mother", "father"):
        own = born.withColumnsRenamed({"pnr": f"{parent}_pnr", "_born": f"{parent}_birth_date"})
        df = df.join(own, f"{parent}_pnr", "left")
    mother, father = F.col("mother_pnr").isNotNull(), F.col("father_pnr").isNotNull()
    status = F.when(mother & father, "TwoParent").when(mother, "SingleMother").when(father, "SingleFather").otherwise("NoParent")
    df = df.withColumn("parental_status", status)
    if education is not None:
        level = education.filter(F.col("pnr").isNotNull()).groupBy("pnr").agg(F.max("education_code").alias("_level"))
        for parent in ("mother", "father"):
            df = df.join(level.withColumnsRenamed({"pnr": f"{parent}_pnr", "_level": f"_{parent}_level"}), f"{parent}_pnr", "left")
        df = df.withColumn("education_level", F.coalesce("_mother_level", "_father_level")).drop("_mother_level", "_father_level")
    return df


# Columns that matching may use, passed on where they are known.
_MATCHED_ON = (
    "children_count", "family_size", "municipality_code", "mother_pnr", "father_pnr", "mother_birth_date", "father_birth_date",
    "education_level", "parental_status", "immigration_type",
)


def case_control_tables(
    persons: DataFrame, condition_ids: DataFrame, index_date: dt.date, incomes: DataFrame | None = None
) -> tuple[DataFrame, DataFrame]:
    """Matching input for persons in and outside the condition set: id, birth, gender, age, income, and what matching may use.

    ``incomes`` is ``(pnr, amount)`` with one row per person.
    """
    table = persons.select(
        F.col("pnr"),
        F.col("birth_date"),
        F.col("gender"),
        fn.completed_years(F.col("birth_date"), on(index_date)).alias("age"),
        *(F.col(c) for c in _MATCHED_ON if c in persons.columns),
    )
    if incomes is not None:
        table = table.join(incomes.select("pnr", F.col("amount").alias("income")), "pnr", "left")
    return C.split_cohort(table, condition_ids)


def person_predicate(
    date: dt.date | None = None,
    age_range: tuple[int | None, int | None] | None = None,
    alive_on_date: bool = False,
    gender: str | None = None,
    origin: str | None = None,
    education: str | None = None,
    municipality: str | None = None,
    rural: bool | None = None,
):
    """One predicate from the given conditions, all of which must hold; an unknown age never passes."""
    def test(df: DataFrame) -> Column:
        birth, death = F.col("birth_date"), F.col("death_date")
        hit = F.lit(True)
        if age_range is not None:
            age, (low, high) = fn.age_at(birth, death, on(date)), age_range
            hit = hit & age.isNotNull()
            if low is not None:
                hit = hit & (age >= low)
            if high is not None:
                hit = hit & (age <= high)
        if alive_on_date:
            hit = hit & fn.alive_at(birth, death, on(date))
        if gender is not None:
            hit = hit & (codes.decode(F.col("gender"), "gender") == gender)
        if origin is not None:
            hit = hit & (codes.decode(F.col("origin"), "origin") == origin)
        if education is not None:
            hit = hit & (codes.decode(F.col("education_level"), "education") == education)
        if municipality is not None:
            hit = hit & (F.col("municipality_code") == municipality)
        if rural is not None:
            hit = hit & (fn.is_rural(F.col("municipality_code")) == F.lit(rural))
        return hit

    return test
