"""Periods of files and dates (TP)."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from conformance.registry import block, query
from conformance.views import table, view
from lifeframe.functions import periods as P
from lifeframe.sources import deliveries as D

_TOKEN = "regexp_extract(path, '([^/]+)[.]parquet$', 1)"
block(
    "strict",
    f"""select path, t, case when regexp_full_match(t, '[0-9]{{4}}') then 'year' when regexp_full_match(t, '[0-9]{{6}}') then 'month'
  when regexp_full_match(t, '[0-9]{{4}}Q[1-4]') then 'quarter' when regexp_full_match(t, '[0-9]{{8}}') then 'day' end as kind
from (select path, {_TOKEN} as t from v_files)""",
)
block(
    "strict_bounds",
    """select path, t, kind, cast(substr(t,1,4) as int) as year,
  case kind when 'month' then cast(substr(t,5,2) as int) when 'quarter' then cast(substr(t,6,1) as int) when 'day' then cast(substr(t,5,4) as int) end as sub,
  case kind when 'year' then make_date(cast(substr(t,1,4) as int),1,1) when 'month' then make_date(cast(substr(t,1,4) as int), cast(substr(t,5,2) as int), 1)
    when 'quarter' then make_date(cast(substr(t,1,4) as int), cast(substr(t,6,1) as int)*3-2, 1)
    else make_date(cast(substr(t,1,4) as int), cast(substr(t,5,2) as int), cast(substr(t,7,2) as int)) end as period_start,
  cast(case kind when 'year' then make_date(cast(substr(t,1,4) as int),12,31)
    when 'month' then last_day(make_date(cast(substr(t,1,4) as int), cast(substr(t,5,2) as int), 1))
    when 'quarter' then last_day(make_date(cast(substr(t,1,4) as int), cast(substr(t,6,1) as int)*3, 1))
    else make_date(cast(substr(t,1,4) as int), cast(substr(t,5,2) as int), cast(substr(t,7,2) as int)) end as date) as period_end
from v_strict where kind is not null""",
)
# All listed files: the strict reading, and the dashed monthly files only the lenient reading knows.
block(
    "dated",
    """select path, upper(regexp_extract(path, '([^/]+)/[^/]+$', 1)) as registry, kind, year, sub, period_start, period_end from v_strict_bounds
union all
select path, upper(regexp_extract(path, '([^/]+)/[^/]+$', 1)), 'month', cast(y as int), cast(m as int), make_date(cast(y as int), cast(m as int), 1),
  cast(last_day(make_date(cast(y as int), cast(m as int), 1)) as date)
from (select path, regexp_extract(path, 'pop_([0-9]{4})-', 1) as y, regexp_extract(path, 'pop_[0-9]{4}-([0-9]{2})', 1) as m
  from v_files where path like '%/pop!_%' escape '!')""",
)


def _files(spark, d):
    return view(spark, d, "files")


def _flat(df, period="period", *others):
    p = F.col(period)
    return df.select(
        *others, p["kind"].alias("kind"), p["year"].alias("year"), p["sub"].alias("sub"),
        p["start"].alias("period_start"), p["end"].alias("period_end"),
    )


@query("tp01_strict_period", "select path, kind, year, sub, period_start, period_end from v_strict_bounds")
def _(spark, d):
    df = _files(spark, d).withColumn("period", P.strict_period(P.period_token(F.col("path"))))
    return _flat(df.filter("period is not null"), "period", "path")


@query(
    "tp02_lenient_period",
    f"""select path, case when regexp_full_match(t, '[0-9]{{4}}') then 'year' when regexp_full_match(t, '[0-9]{{4}}Q[1-4]') then 'quarter' else 'month' end as kind,
  cast(regexp_extract(t, '([0-9]{{4}})', 1) as int) as year,
  case when regexp_full_match(t, '[0-9]{{4}}') then null when regexp_full_match(t, '[0-9]{{4}}Q[1-4]') then cast(right(t, 1) as int)
    else cast(regexp_extract(t, '[0-9]{{4}}-?([0-9]{{2}})', 1) as int) end as sub
from (select path, {_TOKEN} as t from v_files)""",
)
def _(spark, d):
    df = _files(spark, d).withColumn("p", P.lenient_period(P.period_token(F.col("path"))))
    return df.select("path", "p.kind", "p.year", "p.sub")


@query("tp03_year_of_hospital_file", "select path, cast(regexp_extract(path, '([0-9]+)[.]parquet$', 1) as int) as year from v_hospital_files")
def _(spark, d):
    return view(spark, d, "hospital_files").select("path", P.year_of_file(F.col("path")).alias("year"))


_ORDER_DAY = "cast(o_orderdate as date)"


@query(
    "tp04_period_bounds",
    f"""select o_orderkey, cast(date_trunc('year', {_ORDER_DAY}) as date) as y0, cast(date_trunc('year', {_ORDER_DAY}) + interval 1 year - interval 1 day as date) as y1,
  cast(date_trunc('quarter', {_ORDER_DAY}) as date) as q0, cast(date_trunc('quarter', {_ORDER_DAY}) + interval 3 month - interval 1 day as date) as q1,
  cast(date_trunc('month', {_ORDER_DAY}) as date) as m0, cast(last_day({_ORDER_DAY}) as date) as m1 from orders""",
)
def _(spark, d):
    day = F.col("o_orderdate").cast("date")
    df = table(spark, d, "orders").select(
        "o_orderkey", *(P.period_from_date(day, k).alias(k) for k in (P.YEAR, P.QUARTER, P.MONTH))
    )
    return df.select(
        "o_orderkey", F.col("year.start").alias("y0"), F.col("year.end").alias("y1"), F.col("quarter.start").alias("q0"),
        F.col("quarter.end").alias("q1"), F.col("month.start").alias("m0"), F.col("month.end").alias("m1"),
    )


@query("tp05_period_contains", "select path, period_start <= date '1998-06-15' and period_end >= date '1998-06-15' as hit from v_dated")
def _(spark, d):
    df = D.with_period(_files(spark, d))
    return df.select("path", P.period_contains(F.col("period"), F.lit(dt.date(1998, 6, 15))).alias("hit"))


@query(
    "tp06_period_labels",
    """select path, case kind when 'year' then cast(year as varchar) when 'month' then cast(year as varchar) || lpad(cast(sub as varchar),2,'0')
    when 'quarter' then cast(year as varchar) || 'Q' || cast(sub as varchar) else cast(year as varchar) || lpad(cast(sub as varchar),4,'0') end as label,
  case kind when 'year' then cast(year as varchar) when 'month' then strftime(period_start, '%Y-%m')
    when 'quarter' then cast(year as varchar) || '-Q' || cast(sub as varchar) else strftime(period_start, '%Y-%m-%d') end as display, year from v_dated""",
)
def _(spark, d):
    p = F.col("period")
    return D.with_period(_files(spark, d)).select(
        "path", P.period_label(p).alias("label"), P.period_display(p).alias("display"), p["year"].alias("year")
    )


@query(
    "tp07_period_of_date",
    f"""select o_orderkey, cast(year({_ORDER_DAY}) as varchar) as y, strftime({_ORDER_DAY}, '%Y%m') as m,
  cast(year({_ORDER_DAY}) as varchar) || 'Q' || cast(quarter({_ORDER_DAY}) as varchar) as q from orders""",
)
def _(spark, d):
    day = F.col("o_orderdate").cast("date")
    return table(spark, d, "orders").select(
        "o_orderkey",
        *(P.period_label(P.period_from_date(day, k)).alias(n) for k, n in ((P.YEAR, "y"), (P.MONTH, "m"), (P.QUARTER, "q"))),
    )


@query("tp08_dated_listing", "select registry, path, kind, period_start, period_end from v_dated")
def _(spark, d):
    return _flat(D.with_period(_files(spark, d)), "period", "registry", "path").drop("year", "sub")


@query(
    "tp09_files_in_range",
    "select path from v_dated where period_end >= date '1997-03-10' and period_start <= date '1998-05-20'",
)
def _(spark, d):
    return D.files_in_range(_files(spark, d), dt.date(1997, 3, 10), dt.date(1998, 5, 20)).select("path")


@query("tp10_files_of_year", "select path from v_dated where year = 1999")
def _(spark, d):
    return D.files_of_year(_files(spark, d), 1999).select("path")


@query("tp10_available_years", "select distinct year from v_dated")
def _(spark, d):
    return D.available_years(_files(spark, d))


@query(
    "tp10_latest_period",
    """select registry, period_start, period_end from (select *, row_number() over (partition by registry
  order by period_start desc, period_end desc, kind desc) as r from v_dated) where r = 1""",
)
def _(spark, d):
    return D.latest_period(_files(spark, d)).select(
        "registry", F.col("period.start").alias("period_start"), F.col("period.end").alias("period_end")
    )


@query(
    "tp11_registry_periods",
    """select lower(registry) as registry, case kind when 'year' then cast(year as varchar) when 'month' then cast(year as varchar) || lpad(cast(sub as varchar),2,'0')
    when 'quarter' then cast(year as varchar) || 'Q' || cast(sub as varchar) else cast(year as varchar) || lpad(cast(sub as varchar),4,'0') end as label,
  min(period_start) as "start", max(period_end) as "end", count(*) as files from v_dated group by 1, 2""",
)
def _(spark, d):
    return D.registry_periods(_files(spark, d))


@query("tp12_registry_and_period", "select path, registry, period_start, period_end from v_dated")
def _(spark, d):
    path = F.col("path")
    return _flat(
        _files(spark, d).select(path, P.registry_of_path(path).alias("registry"), P.period_of_path(path).alias("period")),
        "period", "path", "registry",
    ).drop("kind", "year", "sub")


@query(
    "tp16_pair_files_by_year",
    """with f as (select path, cast(regexp_extract(path, '([0-9]+)[.]parquet$', 1) as int) as year from v_hospital_files),
a as (select year, min(path) as left_path from f where path like '%lpr!_adm%' escape '!' group by year),
b as (select year, min(path) as right_path from f where path like '%lpr!_diag%' escape '!' group by year)
select coalesce(a.year, b.year) as year, left_path, right_path from a full join b on a.year = b.year""",
)
def _(spark, d):
    files = view(spark, d, "hospital_files")
    return D.pair_by_year(files.filter(F.col("path").contains("lpr_adm")), files.filter(F.col("path").contains("lpr_diag")))


@query(
    "tp17_hospital_tables",
    """select case when path like '%lpr!_adm%' escape '!' then 'lpr_adm' when path like '%lpr!_diag%' escape '!' then 'lpr_diag' else 'lpr3_kontakter' end as table_name,
  count(*) as files from v_hospital_files group by 1""",
)
def _(spark, d):
    return D.hospital_tables(view(spark, d, "hospital_files"))
