"""Income series per person and per family.

Incomes are ``(pnr, year, income_type, amount)`` rows. A series holds at most one amount per year, so
windows within a series are bounded by the number of years.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SERIES = ("pnr", "income_type")


def series(incomes: DataFrame, order: Column | None = None) -> DataFrame:
    """One amount per person, type and year: the last by ``order``, of equal ones the larger.

    Without an order, rows that carry the ``period`` of their delivery are ordered by it: the later delivery holds.
    """
    if order is None and "period" in incomes.columns:
        order = F.struct("period.start", "period.end")
    amount = F.max("amount") if order is None else F.max_by("amount", F.struct(order, F.col("amount")))
    return incomes.groupBy("pnr", "income_type", "year").agg(amount.alias("amount"))


def slope(amount: Column, year: Column) -> Column:
    """Least-squares slope of amount on year, null for fewer than two points."""
    known = amount.isNotNull() & year.isNotNull()
    # Years are shifted to keep the sums of squares small; a shift does not change a slope.
    return F.when(F.count_if(known) >= 2, F.regr_slope(amount, (year - 2000).cast("double")))


def trajectories(incomes: DataFrame, keys: tuple[str, ...] = SERIES) -> DataFrame:
    """Per series: first and last year, number of years, mean and trend."""
    return incomes.groupBy(*keys).agg(
        F.min("year").alias("start_year"),
        F.max("year").alias("end_year"),
        F.count(F.lit(1)).alias("years"),
        F.avg("amount").alias("mean_income"),
        slope(F.col("amount"), F.col("year")).alias("trend"),
    )


def in_year(incomes: DataFrame, year: int) -> DataFrame:
    return incomes.filter(F.col("year") == year)


def as_pairs(incomes: DataFrame, keys: tuple[str, ...] = SERIES) -> DataFrame:
    """Per series its (year, amount) pairs in order; at most one pair per year."""
    return incomes.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("year", "amount"))).alias("pairs"))


def pre_post_difference(
    incomes: DataFrame, index_year: int, pre: int, post: int, keys: tuple[str, ...] = SERIES, amount: str = "amount"
) -> DataFrame:
    """Mean of the index year and ``post`` years after it minus the mean of ``pre`` years before; null if a side is empty."""
    year, value = F.col("year"), F.col(amount)
    before = F.avg(F.when(year.between(index_year - pre, index_year - 1), value))
    after = F.avg(F.when(year.between(index_year, index_year + post), value))
    return incomes.groupBy(*keys).agg((after - before).alias("difference"))


def interpolate(incomes: DataFrame, keys: tuple[str, ...] = SERIES) -> DataFrame:
    """Fill missing years inside each series on the line between the neighbours; adds ``interpolated``.

    Each known year generates the missing ones up to the next known year, so nothing is joined back.
    """
    following = Window.partitionBy(*keys).orderBy("year")
    next_year, next_amount = F.lead("year").over(following), F.lead("amount").over(following)
    spans = incomes.select(*keys, "year", "amount").withColumns({"_next": next_year, "_to": next_amount})
    last = F.coalesce(F.col("_next") - 1, F.col("year"))
    filled = spans.withColumn("_year", F.explode(F.sequence("year", last)))
    step = (F.col("_year") - F.col("year")) / (F.col("_next") - F.col("year"))
    inside = F.col("_year") > F.col("year")
    value = F.when(inside, F.col("amount") + (F.col("_to") - F.col("amount")) * step).otherwise(F.col("amount"))
    return filled.select(*keys, F.col("_year").alias("year"), value.alias("amount"), inside.alias("interpolated"))


def family_series(families: DataFrame, incomes: DataFrame, income_type: str) -> DataFrame:
    """Per family and year: mother's and father's amount and their sum over the joint range of years.

    ``families`` is ``(family_id, mother_pnr, father_pnr)``. Years one parent or both lack count as 0 in the
    sum; families where neither parent has a series are left out. Only the years themselves are joined;
    the grid of years between is generated.
    """
    parents = families.select(
        "family_id",
        F.stack(F.lit(2), F.lit("mother"), F.col("mother_pnr"), F.lit("father"), F.col("father_pnr")).alias("role", "pnr"),
    ).filter(F.col("pnr").isNotNull())
    own = incomes.filter(F.col("income_type") == income_type).select("pnr", "year", "amount")
    per_year = (
        parents.join(own, "pnr")
        .groupBy("family_id", "year")
        .agg(
            F.sum(F.when(F.col("role") == "mother", F.col("amount"))).alias("mother_amount"),
            F.sum(F.when(F.col("role") == "father", F.col("amount"))).alias("father_amount"),
        )
    )
    following = Window.partitionBy("family_id").orderBy("year")
    spans = per_year.withColumn("_next", F.lead("year").over(following))
    last = F.coalesce(F.col("_next") - 1, F.col("year"))
    grid = spans.withColumn("_year", F.explode(F.sequence("year", last)))
    known = F.col("_year") == F.col("year")
    mother, father = F.when(known, F.col("mother_amount")), F.when(known, F.col("father_amount"))
    return grid.select(
        "family_id",
        F.col("_year").alias("year"),
        mother.alias("mother_amount"),
        father.alias("father_amount"),
        (F.coalesce(mother, F.lit(0.0)) + F.coalesce(father, F.lit(0.0))).alias("combined_amount"),
    )


def income_gap(family: DataFrame) -> DataFrame:
    """Father's minus mother's amount in the years both have one."""
    return family.select("family_id", "year", (F.col("father_amount") - F.col("mother_amount")).alias("gap")).filter(
        F.col("gap").isNotNull()
    )


def income_gap_trend(family: DataFrame) -> DataFrame:
    """Slope of the gap over the years, null with fewer than two."""
    gap = F.col("father_amount") - F.col("mother_amount")
    year = F.when(gap.isNotNull(), F.col("year"))
    return family.groupBy("family_id").agg(slope(gap, year).alias("gap_trend"))


def primary_earner_share(family: DataFrame) -> DataFrame:
    """The larger amount over the sum, null where the sum is not positive."""
    mother = F.coalesce("mother_amount", F.lit(0.0))
    father = F.coalesce("father_amount", F.lit(0.0))
    share = F.when(mother + father > 0, F.greatest(mother, father) / (mother + father))
    return family.select("family_id", "year", share.alias("primary_share"))


def of_person(incomes: DataFrame, pnr: str, income_type: str | None = None) -> DataFrame:
    own = incomes.filter(F.col("pnr") == pnr)
    return own if income_type is None else own.filter(F.col("income_type") == income_type)
