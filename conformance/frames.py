"""Frames several queries start from, and the same frames as SQL blocks."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from conformance.registry import block
from conformance.views import view
from lifeframe.functions import periods as P
from lifeframe.operators import chronic, diagnoses, families, income, mapping
from lifeframe.operators import persons as people
from lifeframe.sources.specs import register

INDEX = dt.date(2000, 1, 1)
WINDOW = (dt.date(1995, 1, 1), dt.date(2001, 12, 31))


def mapped(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A register view as person fields."""
    return mapping.map_register(view(spark, sf_dir, name), register(name))


def persons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Population with death dates."""
    kept = ("pnr", "gender", "birth_date", "mother_pnr", "father_pnr", "family_id", "children_count", "municipality_code")
    base = mapped(spark, sf_dir, "bef").select(*kept)
    return base.join(people.death_dates(mapped(spark, sf_dir, "dod")), "pnr", "left")


block(
    "persons",
    """select b.PNR as pnr, b.KOEN as gender, b.FOED_DAG as birth_date, b.MOR_ID as mother_pnr, b.FAR_ID as father_pnr,
  b.FAMILIE_ID as family_id, b.ANTAL_BOERN as children_count, b.KOM as municipality_code, d.DODDATO as death_date
from v_bef b left join (select PNR, max(DODDATO) as DODDATO from v_dod group by PNR) d on d.PNR = b.PNR""",
)


def alive(date: str, birth: str = "birth_date", death: str = "death_date") -> str:
    return f"(coalesce({birth} <= {date}, false) and ({death} is null or {death} >= {date}))"


def years(date: str, birth: str = "birth_date") -> str:
    return (
        f"cast(year({date}) - year({birth}) - case when month({date})*100+day({date}) < month({birth})*100+day({birth})"
        f" then 1 else 0 end as int)"
    )


INDEX_SQL = "date '2000-01-01'"
ALIVE = alive(INDEX_SQL)
AGE = f"case when {ALIVE} then {years(INDEX_SQL)} end"
CHILD = f"coalesce({AGE} < 18, false)"


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return people.migration_events(mapped(spark, sf_dir, "vnds"))


block("events", "select PNR as pnr, HAEND_DATO as event_date, HAEND_KODE = 2 as is_emigration from v_vnds where HAEND_DATO is not null")
block(
    "resident",
    f"""select p.*, not coalesce(p.death_date < {INDEX_SQL}, false) and not coalesce(e.gone, false) as resident
from v_persons p left join (
  select pnr, is_emigration as gone from (
    select pnr, is_emigration, row_number() over (partition by pnr order by event_date desc, is_emigration desc) as r
    from v_events where event_date <= {INDEX_SQL}) where r = 1) e on e.pnr = p.pnr""",
)


def hospital(spark: SparkSession, sf_dir: str, **options) -> DataFrame:
    """Diagnoses of both generations."""
    names = ("lpr_adm", "lpr_diag", "lpr3_kontakter", "lpr3_diagnoser")
    return diagnoses.hospital_diagnoses(*(view(spark, sf_dir, n) for n in names), **options)


KIND = "case when {0} = 'A' then 'Primary' when {0} = 'B' then 'Secondary' else 'Other' end"
block(
    "lpr2",
    f"""select PNR as pnr, C_ADIAG as diagnosis_code, 'Primary' as diagnosis_type, D_INDDTO as diagnosis_date from v_lpr_adm
union all
select a.PNR, d.C_DIAG, {KIND.format("d.C_DIAGTYPE")}, a.D_INDDTO
from v_lpr_adm a join v_lpr_diag d on d.RECNUM = a.RECNUM where d.C_DIAG is distinct from a.C_ADIAG""",
)
block(
    "lpr3",
    f"""select k.CPR as pnr, d.diagnosekode as diagnosis_code, {KIND.format("d.diagnosetype")} as diagnosis_type,
  k.dato_start as diagnosis_date
from v_lpr3_diagnoser d join v_lpr3_kontakter k on k.DW_EK_KONTAKT = d.DW_EK_KONTAKT""",
)
block("hospital", "select * from v_lpr2 union all select * from v_lpr3")
# Fixed values, stated here on their own: first and last prefix, category, congenital, severity.
block(
    "rules",
    """select * from (values
('D610','D610',1,false,2), ('D613','D613',1,false,2), ('D618','D619',1,false,2), ('D762','D762',1,false,2),
('G310','G310',4,false,2), ('G318','G319',4,false,2), ('G702','G702',4,false,2), ('G811','G811',4,false,2), ('G821','G821',4,false,2),
('G824','G824',4,false,2), ('G941','G941',4,false,2), ('G710','G713',4,false,3), ('G736','G736',4,false,3), ('J448','J448',6,false,3),
('P910','P912',4,true,2), ('P941','P949',4,true,2), ('Q790','Q790',6,true,2), ('Q792','Q793',7,true,2), ('Q860','Q860',10,true,2),
('D55','D56',1,false,2), ('D57','D57',1,false,3), ('D58','D61',1,false,2), ('D64','D73',1,false,2), ('D76','D76',1,false,2),
('D80','D84',2,false,2), ('D86','D86',2,false,2), ('D89','D89',2,false,2),
('E10','E10',3,false,2), ('E22','E27',3,false,2), ('E31','E31',3,false,2), ('E34','E34',3,false,2), ('E70','E72',3,false,2), ('E74','E80',3,false,2),
('E83','E83',3,false,2), ('E84','E84',3,false,3), ('E85','E85',3,false,2), ('E88','E88',3,false,2),
('F84','F84',4,false,2), ('G11','G11',4,false,2), ('G12','G12',4,false,3), ('G13','G13',4,false,2), ('G23','G25',4,false,2), ('G31','G31',4,false,2),
('G37','G37',4,false,2), ('G40','G41',4,false,2), ('G60','G60',4,false,2), ('G70','G70',4,false,2), ('G71','G71',4,false,3), ('G72','G72',4,false,2),
('G80','G82',4,false,2), ('G91','G91',4,false,2),
('I12','I12',5,false,2), ('I27','I27',5,false,2), ('I30','I49',5,false,2), ('I50','I50',5,false,3), ('I51','I52',5,false,2), ('I81','I83',5,false,2),
('J41','J43',6,false,2), ('J44','J44',6,false,3), ('J45','J45',6,false,1), ('J47','J47',6,false,2), ('J60','J70',6,false,2), ('J84','J84',6,false,2), ('J96','J96',6,false,3),
('K21','K21',7,false,1), ('K50','K51',7,false,2), ('K70','K73',7,false,2), ('K74','K74',7,false,3), ('K75','K77',7,false,2), ('K86','K87',7,false,2), ('K90','K90',7,false,2),
('M05','M09',8,false,2), ('M30','M31',8,false,2), ('M32','M32',8,false,3), ('M33','M33',8,false,2), ('M34','M34',8,false,3), ('M35','M35',8,false,2),
('M40','M43',8,false,2), ('M45','M46',8,false,2),
('N01','N08',9,false,2), ('N11','N16',9,false,2), ('N18','N29',9,false,2),
('P27','P27',6,true,2), ('P57','P57',4,true,2), ('P91','P91',4,true,2), ('P94','P94',4,true,2),
('Q01','Q07',4,true,3), ('Q20','Q28',5,true,3), ('Q30','Q37',6,true,2), ('Q38','Q45',7,true,2), ('Q60','Q64',9,true,2), ('Q77','Q79',8,true,2),
('Q80','Q89',10,true,2), ('Q90','Q99',10,true,3)) r(first, last, category, congenital, severity)""",
)
block(
    "coded",
    """select h.*, coalesce(r4.category, r3.category, case when h.diagnosis_code like 'C%' then 1 end) as category,
  coalesce(r4.congenital, r3.congenital, case when h.diagnosis_code like 'C%' then false end) as congenital,
  case when substr(h.diagnosis_code,1,3) in ('N18','N19') and substr(h.diagnosis_code,4,1) between '4' and '9' then 3
    else coalesce(r4.severity, r3.severity, case when h.diagnosis_code like 'C%' then 3 end) end as severity
from v_hospital h left join v_rules r4 on length(r4.first) = 4 and length(h.diagnosis_code) >= 4 and substr(h.diagnosis_code,1,4) between r4.first and r4.last
left join v_rules r3 on length(r3.first) = 3 and length(h.diagnosis_code) >= 3 and substr(h.diagnosis_code,1,3) between r3.first and r3.last""",
)
block(
    "chronic",
    """select pnr, count(category) > 0 as has_scd, min(case when category is not null then diagnosis_date end) as first_scd_date,
  coalesce(string_agg(distinct lpad(cast(category as varchar), 2, '0'), ',' order by lpad(cast(category as varchar), 2, '0')), '') as categories,
  count(distinct category) as category_count, coalesce(max(case when category is not null then severity end), 0) as max_severity,
  coalesce(bool_or(congenital), false) as has_congenital, count(*) as hospitalization_count
from v_coded group by pnr""",
)


def results(spark: SparkSession, sf_dir: str, **options) -> DataFrame:
    return chronic.chronic_results(hospital(spark, sf_dir), chronic.ChronicConfig(**options), mapped(spark, sf_dir, "bef"))


def flat_results(df: DataFrame) -> DataFrame:
    """Results with the category list as text and fixed integer types, for comparison."""
    text = F.array_join(F.transform("scd_categories", lambda c: F.lpad(c.cast("string"), 2, "0")), ",")
    return df.select(
        "pnr", "has_scd", "first_scd_date", text.alias("categories"), F.col("category_count").cast("long"),
        F.col("max_severity"), "has_congenital", "hospitalization_count",
    )


def members(spark: SparkSession, sf_dir: str) -> DataFrame:
    return families.family_members(persons(spark, sf_dir))


block(
    "parents",
    """select family_id, role, pnr from (
  select family_id, role, pnr, row_number() over (partition by family_id, role order by links desc, pnr desc) as r from (
    select family_id, role, pnr, count(*) as links from (
      select family_id, 'mother' as role, mother_pnr as pnr from v_persons
      union all select family_id, 'father', father_pnr from v_persons)
    where pnr is not null and family_id is not null and pnr in (select pnr from v_persons) group by family_id, role, pnr))
where r = 1""",
)
block(
    "members",
    """select f.family_id, f.role, p.pnr, p.gender, p.birth_date, p.death_date, p.municipality_code, p.children_count
from v_parents f join v_persons p on p.pnr = f.pnr
union all
select c.family_id, 'child', c.pnr, c.gender, c.birth_date, c.death_date, c.municipality_code, c.children_count
from v_persons c where (c.mother_pnr is not null or c.father_pnr is not null) and c.family_id is not null
  and not exists (select 1 from v_parents f where f.family_id = c.family_id and f.pnr = c.pnr)""",
)


def snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Family snapshots at the index date with residency, chronic children and parental comorbidity."""
    health = chronic.chronic_results(hospital(spark, sf_dir))
    return families.snapshot(members(spark, sf_dir), INDEX, events(spark, sf_dir), health)


block(
    "snapshots",
    f"""select m.family_id, max(case when m.role = 'mother' and r.resident then m.pnr end) as mother_pnr,
  max(case when m.role = 'father' and r.resident then m.pnr end) as father_pnr,
  count(*) filter (where m.role = 'child' and r.resident and {alive(INDEX_SQL, "m.birth_date", "m.death_date")}) as children,
  count(*) filter (where m.role = 'child' and r.resident and {alive(INDEX_SQL, "m.birth_date", "m.death_date")}
    and coalesce(c.first_scd_date <= {INDEX_SQL}, false)) as scd_children,
  bool_or(m.role <> 'child' and r.resident and coalesce(h.first < {INDEX_SQL}, false)) as has_parental_comorbidity,
  max(case when m.role <> 'child' then m.municipality_code end) as municipality_code
from v_members m join v_resident r on r.pnr = m.pnr left join v_chronic c on c.pnr = m.pnr
left join (select pnr, min(diagnosis_date) as first from v_hospital group by pnr) h on h.pnr = m.pnr
group by m.family_id""",
)
block(
    "snapshots_full",
    f"""select *, case when mother_pnr is not null and father_pnr is not null then 'TwoParent'
  when mother_pnr is not null then 'SingleMother' when father_pnr is not null then 'SingleFather' else 'NoParent' end as family_type,
  scd_children > 0 as has_scd_child, {INDEX_SQL} as snapshot_date,
  case when municipality_code is null then false
    else not coalesce(try_cast(municipality_code as int), 0) between 400 and 600 end as is_rural
from v_snapshots""",
)


def incomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return income.series(mapping.incomes(mapped(spark, sf_dir, "ind")))


block(
    "incomes",
    """select * from (
  select PNR as pnr, YEAR as year, 'total_personal' as income_type, PERINDKIALT_13 as amount from v_ind
  union all select PNR, YEAR, 'salary', LOENMV_13 from v_ind
  union all select PNR, YEAR, 'other', case when PERINDKIALT_13 - LOENMV_13 > 0 then PERINDKIALT_13 - LOENMV_13 end from v_ind)
where amount is not null""",
)


def deliveries(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """Mapped rows with their period: yearly population and income, labour status in the first quarter of 2000."""
    bef = view(spark, sf_dir, "bef_period").withColumn("period", P.year_period(F.col("PERIOD_YEAR")))
    ind = view(spark, sf_dir, "ind").withColumn("period", P.year_period(F.col("YEAR")))
    akm = mapped(spark, sf_dir, "akm").withColumn("period", P.quarter_period(F.lit(2000), F.lit(1)))
    return {
        "bef": bef.select(F.col("PNR").alias("pnr"), F.col("CIVST").alias("marital_status"),
                          F.col("KOM").alias("municipality_code"), "period"),
        "ind": ind.select(F.col("PNR").alias("pnr"), F.col("PERINDKIALT_13").alias("annual_income"),
                          F.col("LOENMV_13").alias("employment_income"), "period"),
        "akm": akm,
    }


block(
    "seen",
    """select PNR as pnr, 'bef' as registry, cast(PERIOD_YEAR as varchar) as label, make_date(PERIOD_YEAR,1,1) as period_start,
  make_date(PERIOD_YEAR,12,31) as period_end from v_bef_period
union all select PNR, 'ind', cast(YEAR as varchar), make_date(YEAR,1,1), make_date(YEAR,12,31) from v_ind
union all select PNR, 'akm', '2000Q1', date '2000-01-01', date '2000-03-31' from v_akm""",
)
