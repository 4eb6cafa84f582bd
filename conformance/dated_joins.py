"""As-of and interval joins: every row at its own date, and intervals with tables of intervals (PE, FI, FA, LG, TP)."""

from __future__ import annotations

from pyspark.sql import functions as F

from conformance.family_queries import dated
from conformance.filters import _stays
from conformance.frames import alive, events, hospital, members, persons, years
from conformance.period_queries import _files
from conformance.person_queries import seen
from conformance.registry import block, query
from conformance.views import table
from lifeframe.functions import persons as fn
from lifeframe.operators import asof, chronic, families, intervals
from lifeframe.operators import longitudinal as L
from lifeframe.operators import persons as people
from lifeframe.sources import deliveries as D

# A date for each person, within the years of the migration events.
_OWN_SQL = "date '1992-06-01' + cast((cast(pnr as bigint) * 37) % 2500 as int)"
_OWN = "date_add(date '1992-06-01', cast((cast(pnr as bigint) * 37) % 2500 as int))"

block("own", f"select *, {_OWN_SQL} as own_date from v_persons")
block(
    "resident_own",
    """select p.pnr, p.own_date, not coalesce(p.death_date < p.own_date, false) and not coalesce(e.gone, false) as resident
from v_own p left join (
  select pnr, is_emigration as gone from (
    select o.pnr, e.is_emigration, row_number() over (partition by o.pnr order by e.event_date desc, e.is_emigration desc) as r
    from v_own o join v_events e on e.pnr = o.pnr and e.event_date <= o.own_date) where r = 1) e on e.pnr = p.pnr""",
)


@query("pe05_residency_own_date", "select pnr, own_date, resident from v_resident_own")
def _(spark, d):
    own = persons(spark, d).withColumn("own_date", F.expr(_OWN))
    return people.with_residency(own, events(spark, d), F.col("own_date")).select("pnr", "own_date", "resident")


@query(
    "pe06_event_before_and_after",
    """select pnr, own_date, (select max(event_date) from v_events e where e.pnr = o.pnr and e.event_date < own_date) as event_before,
  (select min(event_date) from v_events e where e.pnr = o.pnr and e.event_date >= own_date) as event_from_then_on from v_own o""",
)
def _(spark, d):
    own = persons(spark, d).select("pnr", F.expr(_OWN).alias("own_date"))
    before = asof.as_of(own, events(spark, d), "pnr", "own_date", "event_date", [], "before", strict=True)
    both = asof.as_of(before, events(spark, d), "pnr", "own_date", "event_date", [], "after", forward=True)
    return both.select("pnr", "own_date", F.col("before.event_date").alias("event_before"), F.col("after.event_date").alias("event_from_then_on"))


@query("fi20_status_own_date", f"select pnr, {alive('own_date')} as alive, case when {alive('own_date')} then {years('own_date')} end as age from v_own")
def _(spark, d):
    found = people.with_status(persons(spark, d), F.expr(_OWN))
    return found.select("pnr", "alive", F.col("age_at_date").alias("age"))


_FAMILY_DATE = "date '1993-01-01' + cast((cast(family_id as bigint) * 31) % 2000 as int)"
block(
    "family_dates",
    f"""select distinct family_id, {_FAMILY_DATE} as snapshot_date from v_members
union all select distinct family_id, {_FAMILY_DATE} + 800 from v_members""",
)
block(
    "members_then",
    """select m.*, f.snapshot_date, not coalesce(m.death_date < f.snapshot_date, false) and not coalesce((
    select arg_max(e.is_emigration, struct_pack(d := e.event_date, g := e.is_emigration)) from v_events e where e.pnr = m.pnr and e.event_date <= f.snapshot_date
  ), false) as resident from v_members m join v_family_dates f on f.family_id = m.family_id""",
)


@query(
    "fa05_snapshots_many_dates",
    f"""select m.family_id, snapshot_date, max(case when role = 'mother' and resident then m.pnr end) as mother_pnr,
  max(case when role = 'father' and resident then m.pnr end) as father_pnr,
  count(*) filter (where role = 'child' and resident and {alive("snapshot_date", "m.birth_date", "m.death_date")}) as children,
  count(*) filter (where role = 'child' and resident and {alive("snapshot_date", "m.birth_date", "m.death_date")} and coalesce(c.first_scd_date <= snapshot_date, false)) as scd_children,
  bool_or(role <> 'child' and resident and coalesce(h.first < snapshot_date, false)) as has_parental_comorbidity
from v_members_then m left join v_chronic c on c.pnr = m.pnr
left join (select pnr, min(diagnosis_date) as first from v_hospital group by pnr) h on h.pnr = m.pnr group by m.family_id, snapshot_date""",
)
def _(spark, d):
    """Every family at two dates of its own."""
    held = members(spark, d)
    first = F.expr("date_add(date '1993-01-01', cast((cast(family_id as bigint) * 31) % 2000 as int))")
    dates = held.select("family_id", F.explode(F.array(first, F.date_add(first, 800))).alias("date"))
    health = chronic.chronic_results(hospital(spark, d))
    found = families.snapshot(families.at_own_dates(held, dates), F.col("date"), events(spark, d), health)
    return found.select("family_id", "snapshot_date", "mother_pnr", "father_pnr", "children", "scd_children", "has_parental_comorbidity")


# Windows of some months around each year of orders, one open to either side.
block(
    "windows",
    """select y as window_id, case when y <> 1992 then make_date(y, 4, 15) end as window_start, case when y <> 1998 then make_date(y + 1, 2, 10) end as window_end
from (select distinct cast(year(o_orderdate) as int) as y from orders)""",
)


def windows(spark, d):
    y = table(spark, d, "orders").select(F.year("o_orderdate").alias("window_id")).distinct()
    return y.selectExpr(
        "window_id", "if(window_id <> 1992, make_date(window_id, 4, 15), null) as window_start",
        "if(window_id <> 1998, make_date(window_id + 1, 2, 10), null) as window_end",
    )


BOUNDS = ("window_start", "window_end")
_SHARES = "(window_end is null or {0} <= window_end) and (window_start is null or {1} is null or {1} >= window_start)"


@query(
    "lg08_overlap_join",
    f"""select pnr, registry, window_id, string_agg(distinct label, ',' order by label) as labels
from v_seen join v_windows on {_SHARES.format("period_start", "period_end")} group by pnr, registry, window_id""",
)
def _(spark, d):
    return L.sources_in(seen(spark, d), windows(spark, d), BOUNDS, ["window_id"]).withColumn("labels", F.array_join("labels", ","))


@query("fi21_valid_in_windows", f"select id, window_id from v_stays join v_windows on {_SHARES.format('valid_from', 'valid_to')}")
def _(spark, d):
    return intervals.overlapping(_stays(spark, d), windows(spark, d), ("valid_from", "valid_to"), BOUNDS).select("id", "window_id")


@query("fa06_families_valid_in", f"select family_id, window_id from v_dated_families join v_windows on {_SHARES.format('valid_from', 'valid_to')}")
def _(spark, d):
    return families.families_valid_in(dated(spark, d), windows(spark, d), BOUNDS).select("family_id", "window_id")


@query("tp09_files_in_ranges", f"select path, window_id from v_dated join v_windows on {_SHARES.format('period_start', 'period_end')}")
def _(spark, d):
    return D.files_in_ranges(_files(spark, d), windows(spark, d), BOUNDS).select("path", "window_id")


@query("tp05_days_in_stays", "select e.pnr, e.event_date, s.id from v_events e join v_stays s on s.pnr = e.pnr and e.event_date >= s.valid_from and (s.valid_to is null or e.event_date <= s.valid_to)")
def _(spark, d):
    """Migration events during a hospital stay of the same person."""
    stays = _stays(spark, d).filter("valid_from is not null")
    return intervals.containing(events(spark, d), stays, "event_date", "valid_from", "valid_to", ["pnr"]).select("pnr", "event_date", "id")
