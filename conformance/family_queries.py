"""Families (FA)."""

from __future__ import annotations

import datetime

from pyspark.sql import functions as F

from conformance.filters import child_state
from conformance.frames import (
    AGE, ALIVE, CHILD, INDEX, INDEX_SQL, events, hospital, incomes, mapped, members, persons, snapshots, years,
)
from conformance.registry import block, query
from conformance.views import view
from lifeframe.functions import periods
from lifeframe.functions import persons as fn
from lifeframe.functions import predicates as P
from lifeframe.operators import families, income
from lifeframe.plans import study

TYPE = """case when {0} and {1} then 'TwoParent' when {0} then 'SingleMother' when {1} then 'SingleFather' else 'NoParent' end"""


@query(
    "fa01_families_at",
    f"""select family_id, members, children, women, men, {TYPE.format("women > 0", "men > 0")} as family_type from (
  select family_id, count(*) as members, count(*) filter (where {CHILD}) as children, count(*) filter (where not {CHILD} and gender = '2') as women,
    count(*) filter (where not {CHILD} and gender = '1') as men from v_persons where family_id is not null group by family_id)""",
)
def _(spark, d):
    return families.families_at(persons(spark, d), INDEX)


@query("fa02_family_members", "select family_id, role, pnr, birth_date from v_members")
def _(spark, d):
    return members(spark, d).select("family_id", "role", "pnr", "birth_date")


@query("fa03_study_persons", f"select pnr from v_resident where resident and {ALIVE} and coalesce({AGE} >= 1, false) and coalesce({AGE} <= 45, true)")
def _(spark, d):
    return families.study_persons(persons(spark, d), INDEX, True, 1, 45, events(spark, d)).select("pnr")


block(
    "families",
    f"""select family_id, mother_pnr, father_pnr, children, {TYPE.format("mother_pnr is not null", "father_pnr is not null")} as family_type from (
  select family_id, max(case when role = 'mother' then pnr end) as mother_pnr, max(case when role = 'father' then pnr end) as father_pnr,
    count(*) filter (where role = 'child') as children from v_members group by family_id) where children > 0""",
)


@query("fa04_build_families", "select * from v_families where mother_pnr is not null and father_pnr is not null")
def _(spark, d):
    return families.build_families(members(spark, d), two_parent_only=True)


@query("fa05_snapshot", "select * from v_snapshots_full")
def _(spark, d):
    return snapshots(spark, d)


def dated(spark, d):
    """Families with a validity: from the oldest child's birth to the youngest's eighteenth year."""
    ages = members(spark, d).filter("role = 'child'").groupBy("family_id").agg(
        F.min("birth_date").alias("valid_from"), F.add_months(F.max("birth_date"), 216).alias("valid_to")
    )
    return families.build_families(members(spark, d)).join(ages, "family_id")


block(
    "dated_families",
    """select f.*, a.valid_from, a.valid_to from v_families f join (select family_id, min(birth_date) as valid_from, cast(max(birth_date) + interval 216 month as date) as valid_to
from v_members where role = 'child' group by family_id) a on a.family_id = f.family_id""",
)


@query(
    "fa06_families_valid_at",
    f"select family_id, family_type, valid_from, valid_to from v_dated_families where valid_from <= {INDEX_SQL} and (valid_to is null or valid_to >= {INDEX_SQL}) and family_type = 'TwoParent'",
)
def _(spark, d):
    valid = families.families_valid_at(dated(spark, d), INDEX)
    return families.families_of_type(valid, "TwoParent").select("family_id", "family_type", "valid_from", "valid_to")


@query("fa07_case_and_control_families", "select family_id, has_scd_child as is_case from v_snapshots_full")
def _(spark, d):
    df = snapshots(spark, d)
    cases = families.case_families(df).select("family_id", F.lit(True).alias("is_case"))
    return cases.unionByName(families.control_families(df).select("family_id", F.lit(False).alias("is_case")))


@query(
    "fa08_family_size",
    "select family_id, children, has_scd_child, mother_pnr is not null and father_pnr is not null as has_both_parents from v_snapshots_full",
)
def _(spark, d):
    both = F.col("mother_pnr").isNotNull() & F.col("father_pnr").isNotNull()
    return snapshots(spark, d).select("family_id", "children", "has_scd_child", both.alias("has_both_parents"))


@query(
    "fa09_siblings",
    """select family_id, pnr, birth_date, has_scd, row_number() over w as birth_order, count(*) over (partition by family_id) as siblings,
  round(datediff('day', lag(birth_date) over w, birth_date) / 365.25, 6) as years_since_previous, bool_or(has_scd) over (partition by family_id) as has_sibling_with_scd
from v_child_state window w as (partition by family_id order by birth_date nulls first, md5(pnr), pnr)
qualify count(*) over (partition by family_id) > 1""",
)
def _(spark, d):
    return families.siblings(child_state(spark, d)).withColumn("years_since_previous", F.round("years_since_previous", 6))


@query("fa10_child_diagnoses", "select pnr, has_scd, first_scd_date, scd_category, disease_severity, disease_origin from v_child_state")
def _(spark, d):
    return child_state(spark, d).drop("family_id", "birth_date", "death_date")


ONSET = years("first_scd_date")


@query(
    "fa11_child_onset",
    f"""select pnr, first_scd_date, coalesce(first_scd_date <= {INDEX_SQL}, false) as had_at_index,
  case when birth_date <= first_scd_date and (death_date is null or death_date >= first_scd_date) then {ONSET} end as age_at_onset from v_child_state""",
)
def _(spark, d):
    df = families.with_onset_age(child_state(spark, d))
    return df.select(
        "pnr", "first_scd_date", families.had_scd_at(F.col("first_scd_date"), F.lit(INDEX)).alias("had_at_index"), "age_at_onset"
    )


@query(
    "fa12_parent_state",
    f"""select m.pnr, m.family_id, coalesce(h.n, 0) > 0 as has_comorbidity, coalesce(h.first < {INDEX_SQL}, false) as had_diagnosis_before,
  coalesce(i.years, 0) as income_years from v_members m
left join (select pnr, count(*) as n, min(diagnosis_date) as first from v_hospital group by pnr) h on h.pnr = m.pnr
left join (select pnr, count(*) as years from v_incomes where income_type = 'salary' and year between 1997 and 2000 group by pnr) i on i.pnr = m.pnr
where m.role <> 'child'""",
)
def _(spark, d):
    parents = members(spark, d).filter("role <> 'child'").select("family_id", "pnr")
    salary = incomes(spark, d).filter("income_type = 'salary'")
    df = families.parent_state(parents, hospital(spark, d), salary, INDEX, 1997, 2000)
    return df.select("pnr", "family_id", "has_comorbidity", "had_diagnosis_before", "income_years")


@query(
    "fa13_basic_stats",
    """select (select count(*) from v_persons) as persons, (select count(*) from v_families) as families, cast(sum(children) as bigint) as children,
  count(*) filter (where family_type = 'TwoParent') as two_parent_families, count(*) filter (where has_scd_child) as scd_families from v_snapshots_full""",
)
def _(spark, d):
    return families.basic_stats(persons(spark, d), families.build_families(members(spark, d)), snapshots(spark, d))


@query(
    "fa14_study_summary",
    """with s as (select count(*) filter (where has_scd_child) as c, count(*) filter (where not has_scd_child) as k,
  sum(scd_children) filter (where has_scd_child) as sick, avg(children) filter (where has_scd_child) as cc, avg(children) filter (where not has_scd_child) as kc,
  count(*) filter (where has_scd_child and family_type = 'TwoParent') as t2, count(*) filter (where has_scd_child and family_type = 'SingleMother') as tm,
  count(*) filter (where has_scd_child and family_type = 'SingleFather') as tf, count(*) filter (where has_scd_child and family_type = 'NoParent') as tn from v_snapshots_full)
select 'case_families' as metric, cast(c as double) as value from s union all select 'control_families', k from s union all select 'scd_children', sick from s
union all select 'children_per_case_family', cc from s union all select 'children_per_control_family', kc from s
union all select 'case_share_TwoParent', t2 * 100.0 / c from s union all select 'case_share_SingleMother', tm * 100.0 / c from s
union all select 'case_share_SingleFather', tf * 100.0 / c from s union all select 'case_share_NoParent', tn * 100.0 / c from s
union all select 'control_to_case_ratio', cast(k as double) / c from s
union all select 'recommended_ratio', case when cast(k as double) / c >= 3 then 3 when cast(k as double) / c >= 1 then 1 else 0 end from s""",
)
def _(spark, d):
    return families.study_summary(snapshots(spark, d))


@query(
    "fa15_study_population",
    """select s.family_id, s.family_type, s.children, s.scd_children, s.has_parental_comorbidity, coalesce(i.total, 0) > 500000 as well_off
from v_snapshots_full s left join (select family_id, sum(amount) as total from (
  select m.family_id, i.amount from v_members m join v_incomes i on i.pnr = m.pnr where m.role <> 'child' and i.income_type = 'total_personal' and i.year = 2000)
  group by family_id) i on i.family_id = s.family_id""",
)
def _(spark, d):
    registers = {n: view(spark, d, n) for n in (
        "bef", "mfr", "vnds", "dod", "lpr_adm", "lpr_diag", "lpr3_kontakter", "lpr3_diagnoser", "ind",
    )}
    population = study.population(registers, INDEX)
    rich = F.coalesce("parental_income", F.lit(0.0)) > 500000
    return population.snapshots.select(
        "family_id", "family_type", "children", "scd_children", "has_parental_comorbidity", rich.alias("well_off")
    )


@query(
    "fa15_study_population_many_deliveries",
    """select pnr, municipality_code, children_count from (
  select PNR as pnr, cast(100 + ((cast(PNR as bigint) + y) % 25) * 30 as varchar) as municipality_code, cast(y % 10 as int) as children_count,
    row_number() over (partition by PNR order by case y when 2000 then 1 when 1999 then 2 when 1998 then 3 when 2001 then 4 else 5 end) as r
  from v_bef cross join (select unnest([1998, 1999, 2000, 2001, 2002]) as y) where (cast(PNR as bigint) + y) % 3 <> 0 and (cast(PNR as bigint) % 50 <> 7 or y > 2000)) where r = 1""",
)
def _(spark, d):
    """Five deliveries, not everybody in each: a person's row is that of the last delivery begun by the index date, else of the first after it."""
    key, year = F.col("PNR").cast("long"), F.col("y")
    bef = view(spark, d, "bef").withColumn("y", F.explode(F.array(*(F.lit(y) for y in range(1998, 2003)))))
    bef = bef.filter(((key + year) % 3 != 0) & ((key % 50 != 7) | (year > 2000))).withColumns(
        {"KOM": (100 + ((key + year) % 25) * 30).cast("string"), "ANTAL_BOERN": (year % 10).cast("int"), "period": periods.year_period(year)}
    )
    return study.study_persons({"bef": bef.drop("y")}, INDEX).select("pnr", "municipality_code", "children_count")


@query(
    "fi15_family_filter_variants",
    """select family_id from v_dated_families f join (
  select family_id, max(case when role <> 'child' then municipality_code end) as municipality_code, bool_or(role <> 'child' and gender = '2' and coalesce(children_count, 0) > 2) as net
  from v_members group by family_id) m using (family_id)
where (family_type = 'TwoParent' and valid_from <= date '1999-06-01' and (valid_to is null or valid_to >= date '1999-06-01') and net)
   or (family_type = 'SingleMother' and municipality_code = '400')
   or (children >= 3 and not coalesce(try_cast(municipality_code as int), 0) between 400 and 600 and municipality_code is not null and not net)""",
)
def _(spark, d):
    """Type, municipality, rural, support network and validity, as any of three sets of conditions."""
    role = F.col("role")
    extra = members(spark, d).groupBy("family_id").agg(
        F.max(F.when(role != families.CHILD, F.col("municipality_code"))).alias("municipality_code"),
        F.bool_or((role != families.CHILD) & (F.col("gender") == "2") & (F.coalesce("children_count", F.lit(0)) > 2)).alias("has_support_network"),
    )
    df = dated(spark, d).join(extra, "family_id").withColumn("is_rural", fn.is_rural(F.col("municipality_code")))
    tests = (
        families.family_predicate(kind="TwoParent", valid_on=datetime.date(1999, 6, 1), support_network=True),
        families.family_predicate(kind="SingleMother", municipality="400"),
        families.family_predicate(min_children=3, rural=True, support_network=False),
    )
    return df.filter(P.any_of(*(t(df) for t in tests))).select("family_id")
