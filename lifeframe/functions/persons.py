"""Status of a person at a date, from birth, death and link columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ADULT_AGE = 18


def alive_at(birth: Column, death: Column, date: Column) -> Column:
    """Born on or before the date and not dead before it; false when the birth date is unknown."""
    return F.coalesce(birth <= date, F.lit(False)) & (death.isNull() | (death >= date))


def completed_years(birth: Column, date: Column) -> Column:
    """Calendar age: the birthday counts from its own month and day on."""
    def month_day(c: Column) -> Column:
        return F.month(c) * 100 + F.dayofmonth(c)

    not_yet = (month_day(date) < month_day(birth)).cast("int")
    return F.year(date) - F.year(birth) - not_yet


def age_at(birth: Column, death: Column, date: Column) -> Column:
    """Completed years, null unless the person is alive at the date."""
    return F.when(alive_at(birth, death, date), completed_years(birth, date))


def is_child(birth: Column, death: Column, date: Column) -> Column:
    return F.coalesce(age_at(birth, death, date) < ADULT_AGE, F.lit(False))


def is_rural(municipality: Column) -> Column:
    """Rural unless the code lies in 400..600; an unreadable code is rural, a missing one is not."""
    number = F.coalesce(municipality.try_cast("int"), F.lit(0))
    return F.when(municipality.isNull(), F.lit(False)).otherwise(~number.between(400, 600))


def role_at(child: Column, parent: Column) -> Column:
    return (
        F.when(child & parent, F.lit("ChildAndParent"))
        .when(child, F.lit("Child"))
        .when(parent, F.lit("Parent"))
        .otherwise(F.lit("Other"))
    )


def emigration_date(event_type: Column, event_date: Column) -> Column:
    return F.when(event_type == "U", event_date)


def immigration_date(event_type: Column, event_date: Column) -> Column:
    return F.when(event_type == "I", event_date)


def has_parents(mother: Column, father: Column) -> dict[str, Column]:
    """The four link tests, by name."""
    return {
        "has_mother": mother.isNotNull(),
        "has_father": father.isNotNull(),
        "has_both_parents": mother.isNotNull() & father.isNotNull(),
        "has_any_parent": mother.isNotNull() | father.isNotNull(),
    }
