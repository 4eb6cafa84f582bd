"""Income series (IN)."""

from __future__ import annotations

from pyspark.sql import functions as F

from conformance.frames import incomes, mapped, members
from conformance.registry import block, query
from conformance.family_queries import families
from lifeframe.functions import periods as P
from lifeframe.operators import income, mapping

SLOPE = "case when count({0}) >= 2 then regr_slope({0}, cast(year - 2000 as double)) end"


def _rounded(df, *columns):
    """To four decimals: amounts are whole cents, so no mean, slope or interpolated value lies on a rounding edge."""
    return df.withColumns({c: F.round(c, 4) for c in columns})


@query("in01_trajectories", "select pnr, income_type, min(year) as start_year, max(year) as end_year, count(*) as years from v_incomes group by pnr, income_type")
def _(spark, d):
    return income.trajectories(incomes(spark, d)).select("pnr", "income_type", "start_year", "end_year", "years")


@query(
    "in01_corrected_delivery",
    "select pnr, year, income_type, round(case when year < 1998 then amount / 2 else amount end, 4) as amount from v_incomes",
)
def _(spark, d):
    """Incomes before 1998 come again in the delivery of 2005, halved: the later delivery holds though it is the smaller amount."""
    first = mapped(spark, d, "ind").withColumn("period", P.year_period(F.col("income_year")))
    later = first.filter("income_year < 1998").withColumns(
        {
            "annual_income": F.col("annual_income") / 2, "employment_income": F.col("employment_income") / 2,
            "period": P.year_period(F.lit(2005)),
        }
    )
    return _rounded(income.series(mapping.incomes(first.unionByName(later))), "amount").select("pnr", "year", "income_type", "amount")


@query("in02_income_of_year", "select pnr, income_type, round(amount, 4) as amount from v_incomes where year = 1999")
def _(spark, d):
    return _rounded(income.in_year(incomes(spark, d), 1999), "amount").select("pnr", "income_type", "amount")


@query(
    "in02_pairs",
    "select pnr, income_type, string_agg(cast(year as varchar) || ':' || cast(cast(round(amount * 100) as bigint) as varchar), ',' order by year) as pairs from v_incomes group by pnr, income_type",
)
def _(spark, d):
    text = F.transform("pairs", lambda p: F.concat_ws(":", p["year"].cast("string"), F.round(p["amount"] * 100, 0).cast("long").cast("string")))
    return income.as_pairs(incomes(spark, d)).select("pnr", "income_type", F.array_join(text, ",").alias("pairs"))


@query("in03_mean_income", "select pnr, income_type, round(avg(amount), 4) as mean_income from v_incomes group by pnr, income_type")
def _(spark, d):
    return _rounded(income.trajectories(incomes(spark, d)).select("pnr", "income_type", "mean_income"), "mean_income")


@query("in04_trend", f"select pnr, income_type, round({SLOPE.format('amount')}, 4) as trend from v_incomes group by pnr, income_type")
def _(spark, d):
    return _rounded(income.trajectories(incomes(spark, d)).select("pnr", "income_type", "trend"), "trend")


@query(
    "in05_pre_post_difference",
    """select pnr, income_type, round(avg(case when year between 1998 and 2000 then amount end) - avg(case when year between 1995 and 1997 then amount end), 4) as difference
from v_incomes group by pnr, income_type""",
)
def _(spark, d):
    return _rounded(income.pre_post_difference(incomes(spark, d), 1998, 3, 2), "difference")


@query(
    "in06_interpolate",
    """with s as (select *, lead(year) over w as ny, lead(amount) over w as na from v_incomes window w as (partition by pnr, income_type order by year))
select pnr, income_type, cast(y as int) as year, round(case when y > year then amount + (na - amount) * ((y - year)::double / (ny - year)) else amount end, 4) as amount, y > year as interpolated
from (select *, unnest(generate_series(year, coalesce(ny - 1, year))) as y from s)""",
)
def _(spark, d):
    return _rounded(income.interpolate(incomes(spark, d)), "amount")


block(
    "family_income",
    """with p as (select f.family_id, r.role, case r.role when 'mother' then f.mother_pnr else f.father_pnr end as pnr from v_families f, (values ('mother'), ('father')) r(role)),
y as (select p.family_id, i.year, sum(case when role = 'mother' then amount end) as mother_amount, sum(case when role = 'father' then amount end) as father_amount
  from p join v_incomes i on i.pnr = p.pnr and i.income_type = 'total_personal' group by 1, 2),
g as (select family_id, unnest(generate_series(min(year), max(year))) as year from y group by family_id)
select g.family_id, cast(g.year as int) as year, y.mother_amount, y.father_amount, coalesce(y.mother_amount, 0) + coalesce(y.father_amount, 0) as combined_amount
from g left join y on y.family_id = g.family_id and y.year = g.year""",
)


def family_income(spark, d):
    return income.family_series(families.build_families(members(spark, d)), incomes(spark, d), "total_personal")


@query(
    "in07_family_series",
    "select family_id, year, round(mother_amount, 4) as mother_amount, round(father_amount, 4) as father_amount, round(combined_amount, 4) as combined_amount from v_family_income",
)
def _(spark, d):
    return _rounded(family_income(spark, d), "mother_amount", "father_amount", "combined_amount")


@query("in08_income_gap", "select family_id, year, round(father_amount - mother_amount, 4) as gap from v_family_income where father_amount - mother_amount is not null")
def _(spark, d):
    return _rounded(income.income_gap(family_income(spark, d)), "gap")


@query(
    "in08_income_gap_trend",
    """select family_id, round(case when count(gap) >= 2 then regr_slope(gap, y) end, 4) as gap_trend from (
  select family_id, father_amount - mother_amount as gap, case when father_amount - mother_amount is not null then cast(year - 2000 as double) end as y from v_family_income) group by family_id""",
)
def _(spark, d):
    return _rounded(income.income_gap_trend(family_income(spark, d)), "gap_trend")


@query(
    "in09_primary_earner_share",
    """select family_id, year, round(case when combined_amount > 0 then greatest(coalesce(mother_amount, 0), coalesce(father_amount, 0)) / combined_amount end, 6) as primary_share from v_family_income""",
)
def _(spark, d):
    return income.primary_earner_share(family_income(spark, d)).withColumn("primary_share", F.round("primary_share", 6))


@query("in10_of_person", "select year, income_type, round(amount, 4) as amount from v_incomes where pnr = '0000000077'")
def _(spark, d):
    return _rounded(income.of_person(incomes(spark, d), "0000000077"), "amount").drop("pnr")


@query("in10_filtered_count", "select income_type, count(*) as n from v_incomes where amount > 200000 group by income_type")
def _(spark, d):
    return incomes(spark, d).filter("amount > 200000").groupBy("income_type").agg(F.count(F.lit(1)).alias("n"))
