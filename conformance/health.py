"""Hospital diagnoses and severe chronic disease (HL)."""

from __future__ import annotations

from pyspark.sql import functions as F

from conformance.frames import WINDOW, flat_results, hospital, mapped, results
from conformance.registry import block, query
from conformance.views import table, view
from lifeframe.functions import icd
from lifeframe.operators import chronic, diagnoses, mapping

COLUMNS = "pnr, diagnosis_code, diagnosis_type, diagnosis_date"


@query(
    "hl01_integrate_lpr2",
    f"select {COLUMNS} from v_lpr2 where diagnosis_date is null or diagnosis_date between date '1996-01-01' and date '1998-12-31'",
)
def _(spark, d):
    import datetime as dt

    config = diagnoses.HospitalConfig(start=dt.date(1996, 1, 1), end=dt.date(1998, 12, 31))
    return diagnoses.from_admissions(view(spark, d, "lpr_adm"), view(spark, d, "lpr_diag"), config)


@query("hl02_integrate_lpr3", f"select {COLUMNS} from v_lpr3 where diagnosis_date is null or diagnosis_date >= date '2000-07-01'")
def _(spark, d):
    import datetime as dt

    config = diagnoses.HospitalConfig.lpr3_only(start=dt.date(2000, 7, 1))
    return diagnoses.from_contacts(view(spark, d, "lpr3_kontakter"), view(spark, d, "lpr3_diagnoser"), config)


@query("hl03_hospital_diagnoses", f"select {COLUMNS} from v_hospital where pnr in (select CPR_BARN from v_mfr)")
def _(spark, d):
    return hospital(spark, d, cohort=mapped(spark, d, "mfr").select("pnr"))


@query(
    "hl05_clean_codes",
    """select l_orderkey, l_linenumber, upper(replace(trim(code), ' ', '')) as code, regexp_matches(upper(replace(trim(code), ' ', '')), '^[A-Z]') and length(replace(trim(code), ' ', '')) >= 3 as valid
from (select l_orderkey, l_linenumber, case l_partkey % 4 when 0 then ' e' || cast(l_partkey % 50 as varchar) || ' ' when 1 then 'J 4' || cast(l_partkey % 10 as varchar)
  when 2 then cast(l_partkey as varchar) else 'q' end as code from lineitem)""",
)
def _(spark, d):
    key = F.col("l_partkey")
    code = (
        F.when(key % 4 == 0, F.concat(F.lit(" e"), (key % 50).cast("string"), F.lit(" ")))
        .when(key % 4 == 1, F.concat(F.lit("J 4"), (key % 10).cast("string")))
        .when(key % 4 == 2, key.cast("string"))
        .otherwise("q")
    )
    df = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", code.alias("raw"))
    return df.select("l_orderkey", "l_linenumber", icd.clean_code(F.col("raw")).alias("code"), icd.is_valid_code(F.col("raw")).alias("valid"))


@query("hl06_categorize", "select pnr, diagnosis_code, diagnosis_date, category, congenital, severity from v_coded")
def _(spark, d):
    return chronic.categorize(hospital(spark, d)).select("pnr", "diagnosis_code", "diagnosis_date", "category", "congenital", "severity")


@query(
    "hl07_simple_rules",
    """select RECNUM, C_DIAG, C_DIAG in ('E10','G40','Q90','C50') or C_DIAG like 'C%' or C_DIAG like 'D80%' or C_DIAG like 'G71%' or C_DIAG like 'Q%' as is_scd,
  case when C_DIAG like 'C%' or C_DIAG like 'Q90%' then 3 else 2 end as severity, C_DIAG like 'Q%' as congenital from v_lpr_diag""",
)
def _(spark, d):
    code = F.col("C_DIAG")
    return view(spark, d, "lpr_diag").select(
        "RECNUM", "C_DIAG", icd.simple_is_scd(code).alias("is_scd"), icd.simple_severity(code).alias("severity"),
        icd.simple_is_congenital(code).alias("congenital"),
    )


@query(
    "hl08_chapter_category",
    """select RECNUM, C_DIAG, case when C_DIAG like 'C%' or (C_DIAG like 'D%' and substr(C_DIAG,2,2) <= '48') then 1
  when (C_DIAG like 'D%' and substr(C_DIAG,2,2) between '50' and '89') or C_DIAG like 'M35%' or C_DIAG like 'M30%' then 2
  when C_DIAG like 'E%' then 3 when C_DIAG like 'G%' then 4 when C_DIAG like 'I%' then 5 when C_DIAG like 'J%' then 6 when C_DIAG like 'K%' then 7
  when C_DIAG like 'M%' then 8 when C_DIAG like 'N%' then 9 when C_DIAG like 'Q%' then 10 else 0 end as category from v_lpr_diag""",
)
def _(spark, d):
    return view(spark, d, "lpr_diag").select("RECNUM", "C_DIAG", icd.chapter_category(F.col("C_DIAG")).alias("category"))


@query(
    "hl09_chapters",
    """select distinct C_DIAG, case substr(C_DIAG,1,1) when 'C' then 'II' when 'D' then 'II,III' when 'E' then 'IV' when 'F' then 'V' when 'G' then 'VI' when 'I' then 'IX'
  when 'J' then 'X' when 'K' then 'XI' when 'M' then 'XIII' when 'N' then 'XIV' when 'P' then 'XVI' when 'Q' then 'XVII' end as chapters from v_lpr_diag""",
)
def _(spark, d):
    codes = view(spark, d, "lpr_diag").select("C_DIAG").distinct()
    return codes.select("C_DIAG", F.array_join(icd.chapters(F.col("C_DIAG")), ",").alias("chapters"))


@query("hl10_chronic_results", "select * from v_chronic")
def _(spark, d):
    return flat_results(results(spark, d, start=WINDOW[0], end=WINDOW[1]))


block(
    "limited",
    """select c.pnr, c.diagnosis_date, c.category, c.severity, c.congenital, c.category is not null and not c.congenital
  and coalesce(c.diagnosis_date >= date '1997-01-01', true) and coalesce(c.diagnosis_date <= date '2000-06-30', true)
  and coalesce(cast(trunc(datediff('day', b.FOED_DAG, c.diagnosis_date) / 365) as int) between 2 and 30, true) as counts
from v_coded c left join v_bef b on b.PNR = c.pnr""",
)


@query(
    "hl10_chronic_results_limited",
    """select pnr, bool_or(counts) as has_scd, min(case when counts then diagnosis_date end) as first_scd_date,
  coalesce(string_agg(distinct lpad(cast(category as varchar),2,'0'), ',' order by lpad(cast(category as varchar),2,'0')) filter (where counts), '') as categories,
  count(distinct category) filter (where counts) as category_count, coalesce(max(severity) filter (where counts), 0) as max_severity,
  coalesce(bool_or(congenital) filter (where counts), false) as has_congenital, count(*) as hospitalization_count from v_limited group by pnr""",
)
def _(spark, d):
    import datetime as dt

    return flat_results(
        results(spark, d, start=dt.date(1997, 1, 1), end=dt.date(2000, 6, 30), min_age=2, max_age=30, include_congenital=False)
    )


block(
    "scored",
    """select *, case when hospitalization_count >= 5 then 3 when hospitalization_count >= 2 then 2 else 1 end as hospitalization_severity,
  case when category_count > 2 then 3 when category_count = 2 then 2 else 1 end as category_severity,
  case when onset_age < 2 then 3 when onset_age < 10 then 2 when onset_age is not null then 1 end as onset_severity
from (select c.*, cast(trunc(datediff('day', b.FOED_DAG, c.first_scd_date) / 365) as int) as onset_age from v_chronic c left join v_bef b on b.PNR = c.pnr)""",
)


def scored(spark, d, coarse=False):
    births = mapped(spark, d, "bef").select("pnr", "birth_date")
    df = results(spark, d).join(births, "pnr", "left")
    return chronic.with_severity_scores(df, (F.datediff("first_scd_date", "birth_date") / 365).cast("int"), coarse)


@query(
    "hl11_severity_scores",
    """select pnr, hospitalization_severity, category_severity, onset_severity,
  greatest(max_severity, hospitalization_severity, category_severity, coalesce(onset_severity, 0)) as combined_severity from v_scored""",
)
def _(spark, d):
    return scored(spark, d).select("pnr", "hospitalization_severity", "category_severity", "onset_severity", "combined_severity")


@query(
    "hl11_severity_scores_coarse",
    """select pnr, case when category_count > 1 then 3 else 1 end as category_severity,
  greatest(max_severity, hospitalization_severity, case when category_count > 1 then 3 else 1 end) as combined_severity from v_scored""",
)
def _(spark, d):
    return chronic.with_severity_scores(results(spark, d), coarse=True).select("pnr", "category_severity", "combined_severity")


@query(
    "hl12_severity_counts",
    """select greatest(max_severity, hospitalization_severity, category_severity, coalesce(onset_severity, 0)) as combined_severity, count(*) as persons
from v_scored where has_scd group by 1""",
)
def _(spark, d):
    return chronic.severity_counts(scored(spark, d))


@query("hl12_affected_count", "select count(*) as persons from v_chronic where has_scd")
def _(spark, d):
    return chronic.affected(results(spark, d)).agg(F.count(F.lit(1)).alias("persons"))


@query("hl13_first_per_code", "select pnr, diagnosis_code, min(diagnosis_date) as diagnosis_date from v_hospital group by pnr, diagnosis_code")
def _(spark, d):
    return diagnoses.first_per_code(hospital(spark, d)).select("pnr", "diagnosis_code", "diagnosis_date")


@query("hl13_of_person", "select diagnosis_code, diagnosis_type, diagnosis_date from v_hospital where pnr = '0000000042'")
def _(spark, d):
    return diagnoses.of_person(hospital(spark, d), "0000000042").drop("pnr")


@query(
    "hl14_record_diagnoses",
    """select a.PNR as pnr, d.C_DIAG as diagnosis_code, case d.C_DIAGTYPE when 'A' then 'Primary' when 'B' then 'Secondary' else 'Other' end as diagnosis_type,
  a.D_INDDTO as diagnosis_date from v_lpr_diag d join v_lpr_adm a on a.RECNUM = d.RECNUM""",
)
def _(spark, d):
    return mapping.record_diagnoses(mapped(spark, d, "lpr_diag"), mapped(spark, d, "lpr_adm"))
