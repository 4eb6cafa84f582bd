"""Persons and longitudinal records (PE, LG)."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from conformance.frames import (
    AGE, ALIVE, CHILD, INDEX, INDEX_SQL, deliveries, events, mapped, persons, years,
)
from conformance.registry import block, query
from conformance.views import view
from lifeframe.functions import persons as fn
from lifeframe.functions import periods as P
from lifeframe.operators import longitudinal as L
from lifeframe.operators import persons as people
from lifeframe.operators.states import LongitudinalState, PresenceState
from lifeframe.session import scratch_path

def _life():
    return F.col("birth_date"), F.col("death_date"), F.lit(INDEX)


@query("pe01_alive_at", f"select pnr, {ALIVE} as alive from v_persons")
def _(spark, d):
    return persons(spark, d).select("pnr", fn.alive_at(*_life()).alias("alive"))


@query("pe02_age_at", f"select pnr, {AGE} as age from v_persons")
def _(spark, d):
    return persons(spark, d).select("pnr", fn.age_at(*_life()).alias("age"))


@query("pe03_completed_years", f"select pnr, {years(INDEX_SQL)} as age from v_persons")
def _(spark, d):
    return persons(spark, d).select("pnr", fn.completed_years(F.col("birth_date"), F.lit(INDEX)).alias("age"))


@query("pe04_resident_without_events", f"select pnr from v_persons where {ALIVE}")
def _(spark, d):
    return people.alive(persons(spark, d), INDEX).select("pnr")


@query("pe05_residency", "select pnr, resident from v_resident")
def _(spark, d):
    return people.with_residency(persons(spark, d), events(spark, d), INDEX).select("pnr", "resident")


@query("pe06_migration_events", "select pnr, event_date, is_emigration from v_events")
def _(spark, d):
    return events(spark, d)


@query("pe06_migration_counts", "select count(*) filter (where is_emigration) as emigrations, count(*) filter (where not is_emigration) as immigrations from v_events")
def _(spark, d):
    return people.migration_counts(events(spark, d))


@query("pe07_death_dates", "select PNR as pnr, max(D_DATO) as death_date from v_dodsaarsag where D_DATO is not null group by PNR")
def _(spark, d):
    return people.death_dates(mapped(spark, d, "dodsaarsag"))


@query("pe08_rural", "select pnr, case when municipality_code is null then false else not coalesce(try_cast(municipality_code as int), 0) between 400 and 600 end as is_rural from v_persons")
def _(spark, d):
    return persons(spark, d).select("pnr", fn.is_rural(F.col("municipality_code")).alias("is_rural"))


@query("pe09_is_child", f"select pnr, {CHILD} as child from v_persons")
def _(spark, d):
    return persons(spark, d).select("pnr", fn.is_child(*_life()).alias("child"))


PARENTS = "select mother_pnr from v_persons where mother_pnr is not null union select father_pnr from v_persons where father_pnr is not null"


@query("pe10_parents", f"select pnr from v_persons where pnr in ({PARENTS})")
def _(spark, d):
    return people.parents(persons(spark, d)).select("pnr")


@query(
    "pe11_roles",
    f"""select pnr, case when c and p then 'ChildAndParent' when c then 'Child' when p then 'Parent' else 'Other' end as role
from (select pnr, {CHILD} as c, pnr in ({PARENTS}) as p from v_persons)""",
)
def _(spark, d):
    return people.with_role(persons(spark, d), INDEX).select("pnr", "role")


@query("pe12_children", f"select pnr from v_persons where {CHILD}")
def _(spark, d):
    return people.children(persons(spark, d), INDEX).select("pnr")


@query(
    "pe13_parent_links",
    """select pnr, mother_pnr is not null as has_mother, father_pnr is not null as has_father, mother_pnr is not null and father_pnr is not null as has_both_parents,
  mother_pnr is not null or father_pnr is not null as has_any_parent from v_persons""",
)
def _(spark, d):
    tests = fn.has_parents(F.col("mother_pnr"), F.col("father_pnr"))
    return persons(spark, d).select("pnr", *(c.alias(n) for n, c in tests.items()))


@query("pe14_birth_dates", "select pnr, birth_date from v_persons where birth_date is not null")
def _(spark, d):
    return people.birth_dates(persons(spark, d))


@query(
    "pe15_migration_dates",
    "select PNR as pnr, case when HAEND_KODE = 2 then HAEND_DATO end as left_on, case when HAEND_KODE = 1 then HAEND_DATO end as came_on from v_vnds",
)
def _(spark, d):
    letter = F.when(F.col("event_type") == "2", "U").otherwise("I")
    df = mapped(spark, d, "vnds").withColumn("event_type", letter)
    kind, date = F.col("event_type"), F.col("event_date")
    return df.select("pnr", fn.emigration_date(kind, date).alias("left_on"), fn.immigration_date(kind, date).alias("came_on"))


@query(
    "lg01_merge_periods",
    """select PNR as pnr, arg_min(CIVST, PERIOD_YEAR) filter (where CIVST is not null) as marital_status, arg_min(KOM, PERIOD_YEAR) filter (where KOM is not null) as municipality_code
from v_bef_period group by PNR""",
)
def _(spark, d):
    return L.merge_periods(deliveries(spark, d)["bef"])


@query(
    "lg01_merge_periods_latest",
    """select PNR as pnr, arg_max(CIVST, PERIOD_YEAR) filter (where CIVST is not null) as marital_status, arg_max(KOM, PERIOD_YEAR) filter (where KOM is not null) as municipality_code
from v_bef_period group by PNR""",
)
def _(spark, d):
    return L.merge_periods(deliveries(spark, d)["bef"], prefer="latest")


LG2 = """select coalesce(b.pnr, i.pnr, a.PNR) as pnr, b.marital_status, b.municipality_code, cast(a.SOCIO13 as int) as socioeconomic_status,
  round(i.annual_income, 2) as annual_income, round(i.employment_income, 2) as employment_income
from (select PNR as pnr, arg_min(CIVST, PERIOD_YEAR) filter (where CIVST is not null) as marital_status, arg_min(KOM, PERIOD_YEAR) filter (where KOM is not null) as municipality_code
  from v_bef_period group by PNR) b
full join (select PNR as pnr, arg_min(PERINDKIALT_13, YEAR) filter (where PERINDKIALT_13 is not null) as annual_income,
  arg_min(LOENMV_13, YEAR) filter (where LOENMV_13 is not null) as employment_income from v_ind group by PNR) i on i.pnr = b.pnr
full join v_akm a on a.PNR = coalesce(b.pnr, i.pnr)"""


def _rounded(df):
    return df.withColumns({c: F.round(c, 2) for c in ("annual_income", "employment_income")})


@query("lg02_longitudinal", LG2)
def _(spark, d):
    return _rounded(L.longitudinal(deliveries(spark, d)))


@query(
    "lg03_selected_registers",
    """select PNR as pnr, round(arg_min(PERINDKIALT_13, YEAR) filter (where PERINDKIALT_13 is not null), 2) as annual_income,
  round(arg_min(LOENMV_13, YEAR) filter (where LOENMV_13 is not null), 2) as employment_income from v_ind group by PNR""",
)
def _(spark, d):
    return _rounded(L.longitudinal(deliveries(spark, d), registries=["ind"]))


@query("lg04_valid_persons", f"select count(*) as persons from v_persons where {ALIVE}")
def _(spark, d):
    return L.valid_at(persons(spark, d), INDEX).agg(F.count(F.lit(1)).alias("persons"))


def seen(spark, d):
    return L.presence(deliveries(spark, d))


@query("lg05_date_range", 'select min(period_start) as "start", max(period_end) as "end" from v_seen')
def _(spark, d):
    return L.date_range(seen(spark, d))


@query("lg05_all_periods", "select distinct registry, label, period_start, period_end from v_seen")
def _(spark, d):
    return L.all_periods(seen(spark, d))


@query("lg06_presence", "select pnr, registry, label, period_start, period_end, registry || '_' || label as source from v_seen")
def _(spark, d):
    return seen(spark, d).drop("period_kind")


@query("lg06_person_periods", "select pnr, registry, min(label) as earliest, max(label) as latest, count(*) as periods from v_seen group by pnr, registry")
def _(spark, d):
    return L.person_periods(seen(spark, d))


@query(
    "lg07_sources_at",
    "select pnr, registry, string_agg(distinct label, ',' order by label) as labels from v_seen where date '2000-02-15' between period_start and period_end group by pnr, registry",
)
def _(spark, d):
    return L.sources_at(seen(spark, d), dt.date(2000, 2, 15)).withColumn("labels", F.array_join("labels", ","))


@query(
    "lg08_sources_between",
    """select pnr, registry, string_agg(distinct label, ',' order by label) as labels from v_seen
where period_end >= date '1997-05-01' and period_start <= date '1999-01-31' group by pnr, registry""",
)
def _(spark, d):
    return L.sources_between(seen(spark, d), dt.date(1997, 5, 1), dt.date(1999, 1, 31)).withColumn("labels", F.array_join("labels", ","))


@query("lg09_register_counts", "select registries, count(*) as persons from (select pnr, count(distinct registry) as registries from v_seen group by pnr) group by registries")
def _(spark, d):
    return L.register_counts(seen(spark, d))


@query("lg09_period_counts", "select registry, label, count(distinct pnr) as persons from v_seen group by registry, label")
def _(spark, d):
    return L.period_counts(seen(spark, d))


@query("lg09_gender_counts", "select coalesce(gender, 'Unknown') as gender, count(*) as persons from v_persons group by 1")
def _(spark, d):
    return L.gender_counts(persons(spark, d))


@query("lg09_seen_in_period", "select distinct pnr from v_seen where label = '1999'")
def _(spark, d):
    return L.seen_in(seen(spark, d), "1999")


@query(
    "lg10_coverage_calendar",
    "select registry, cast(year(period_start) as int) as year, string_agg(distinct label, ', ' order by label) as covered from v_seen group by 1, 2",
)
def _(spark, d):
    return L.coverage_calendar(seen(spark, d))


_FIELDS = {
    "marital_status": "string", "municipality_code": "string", "annual_income": "double", "employment_income": "double", "socioeconomic_status": "int",
}


def _by_delivery(spark, d):
    """(register, label, rows) of every delivery, in no order of time."""
    found = []
    for name, df in deliveries(spark, d).items():
        for n, row in enumerate(sorted(r.label for r in df.select(P.period_label(F.col("period")).alias("label")).distinct().collect())):
            found.append((n * 7 % 5, name, row, df.filter(P.period_label(F.col("period")) == row)))
    return [f[1:] for f in sorted(found, key=lambda f: f[:3])]


def _folded(spark, d, state):
    for name, label, df in _by_delivery(spark, d):
        if name != "ind" or label in ("1994", "1997", "1999"):
            state.fold(df, name, label)
    return state


_IND_SQL = LG2.replace("from v_ind group by", "from v_ind where YEAR in (1994, 1997, 1999) group by")


@query("lg02_fold", _IND_SQL)
def _(spark, d):
    """Deliveries folded one by one into a stored state give what merging all of them gives."""
    return _rounded(_folded(spark, d, LongitudinalState(spark, scratch_path(spark, "state"), _FIELDS, buckets=8)).records())


@query(
    "lg01_fold_latest",
    """select PNR as pnr, arg_max(CIVST, PERIOD_YEAR) filter (where CIVST is not null) as marital_status, arg_max(KOM, PERIOD_YEAR) filter (where KOM is not null) as municipality_code
from v_bef_period where PERIOD_YEAR <> 1996 group by PNR""",
)
def _(spark, d):
    """Folded in two steps, a delivery twice, and one withdrawn."""
    fields = {f: _FIELDS[f] for f in ("marital_status", "municipality_code")}
    state = LongitudinalState(spark, scratch_path(spark, "state"), fields, prefer="latest", buckets=8)
    bef = deliveries(spark, d)["bef"]
    year = F.col("period.year")
    state.fold(bef.filter(year >= 1997), "bef", "late")
    state.fold(bef.filter(year < 1996), "bef", "early")
    state.fold(bef.filter(year == 1996), "bef", "1996")
    state.fold(bef.filter(year < 1996), "bef", "early")
    state.withdraw(bef.filter(year == 1996), "bef", "1996", {"bef": bef.filter(year != 1996)})
    return state.records()


@query(
    "lg06_presence_fold",
    "select pnr, registry, label, period_start, period_end, registry || '_' || label as source from v_seen where registry <> 'ind' or label in ('1994', '1997', '1999')",
)
def _(spark, d):
    return _folded(spark, d, PresenceState(spark, scratch_path(spark, "presence"), buckets=8)).records().drop("period_kind")
