"""Joins (JN)."""

from __future__ import annotations

from pyspark.sql import functions as F

from conformance.frames import INDEX, INDEX_SQL, events, hospital, incomes, mapped, members, persons
from conformance.registry import query
from conformance.views import table, view
from lifeframe.operators import cohort as C
from lifeframe.operators import diagnoses, families, longitudinal, mapping, matching

COHORT = "select PNR from v_bef where SEGMENT = 'BUILDING'"


def _cohort(spark, d):
    return view(spark, d, "bef").filter("SEGMENT = 'BUILDING'").select("PNR")


@query("jn01_restrict_to_cohort", f"select PNR, RECNUM from v_lpr_adm where PNR in ({COHORT})")
def _(spark, d):
    return C.restrict(view(spark, d, "lpr_adm"), _cohort(spark, d)).select("PNR", "RECNUM")


@query("jn02_restrict_through_parent", f"select RECNUM, C_DIAG from v_lpr_diag where RECNUM in (select RECNUM from v_lpr_adm where PNR in ({COHORT}))")
def _(spark, d):
    return C.restrict_through(view(spark, d, "lpr_diag"), "RECNUM", view(spark, d, "lpr_adm"), _cohort(spark, d)).select("RECNUM", "C_DIAG")


@query(
    "jn03_restrict_registers",
    f"""select 'lpr_adm' as registry, count(*) as n from v_lpr_adm where PNR in ({COHORT})
union all select 'lpr_diag', count(*) from v_lpr_diag where RECNUM in (select RECNUM from v_lpr_adm where PNR in ({COHORT}))
union all select 'mfr', count(*) from v_mfr where CPR_BARN in ({COHORT})
union all select 'lpr3_kontakter', count(*) from v_lpr3_kontakter where CPR in ({COHORT})
union all select 'lpr3_diagnoser', count(*) from v_lpr3_diagnoser where DW_EK_KONTAKT in (select DW_EK_KONTAKT from v_lpr3_kontakter where CPR in ({COHORT}))""",
)
def _(spark, d):
    names = ("lpr_adm", "lpr_diag", "mfr", "lpr3_kontakter", "lpr3_diagnoser")
    kept = C.restrict_registers({n: view(spark, d, n) for n in names}, _cohort(spark, d))
    counts = [df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(n).alias("registry"), "n") for n, df in kept.items()]
    result = counts[0]
    for part in counts[1:]:
        result = result.unionByName(part)
    return result


@query("jn04_attach_person", "select d.RECNUM, d.C_DIAG, a.PNR from v_lpr_diag d join v_lpr_adm a on a.RECNUM = d.RECNUM")
def _(spark, d):
    return C.attach_person(view(spark, d, "lpr_diag"), view(spark, d, "lpr_adm"), "RECNUM").select("RECNUM", "C_DIAG", "PNR")


@query("jn05_admissions_with_diagnoses", "select pnr, diagnosis_code, diagnosis_type, diagnosis_date from v_lpr2")
def _(spark, d):
    return diagnoses.from_admissions(view(spark, d, "lpr_adm"), view(spark, d, "lpr_diag"))


@query("jn06_contacts_with_diagnoses", "select pnr, diagnosis_code, diagnosis_type, diagnosis_date from v_lpr3")
def _(spark, d):
    return diagnoses.from_contacts(view(spark, d, "lpr3_kontakter"), view(spark, d, "lpr3_diagnoser"))


@query(
    "jn07_enrich_with_births",
    "select p.pnr, m.VAEGT as birth_weight, m.SVLNGD as gestational_age, m.APGAR5 as apgar_score from v_persons p join v_mfr m on m.CPR_BARN = p.pnr",
)
def _(spark, d):
    details = mapped(spark, d, "mfr").select("pnr", "birth_weight", "gestational_age", "apgar_score")
    return C.enrich(persons(spark, d), details).select("pnr", "birth_weight", "gestational_age", "apgar_score")


@query(
    "jn08_link_family_members",
    f"""select m.family_id, m.pnr, m.role, coalesce(h.n, 0) > 0 as has_comorbidity, coalesce(h.first < {INDEX_SQL}, false) as had_diagnosis_before,
  coalesce(i.years, 0) as income_years, round(i.total, 2) as income_total
from v_members m left join (select pnr, count(*) as n, min(diagnosis_date) as first from v_hospital group by pnr) h on h.pnr = m.pnr
left join (select pnr, count(*) as years, sum(amount) as total from v_incomes where income_type = 'total_personal' and year between 1996 and 2000 group by pnr) i on i.pnr = m.pnr
where m.role <> 'child'""",
)
def _(spark, d):
    parents = members(spark, d).filter("role <> 'child'").select("family_id", "pnr", "role")
    own = incomes(spark, d).filter("income_type = 'total_personal'")
    df = families.parent_state(parents, hospital(spark, d), own, INDEX, 1996, 2000)
    return df.select(
        "family_id", "pnr", "role", "has_comorbidity", "had_diagnosis_before", "income_years", F.round("income_total", 2).alias("income_total")
    )


URGENT = "select CPR from v_lpr3_kontakter where kontakttype like '%akut%'"


def sides(spark, d):
    """Children with an emergency contact as cases, all others as controls."""
    contacts = view(spark, d, "lpr3_kontakter")
    urgent = contacts.filter(F.col("kontakttype").contains("akut")).select(F.col("CPR").alias("pnr"))
    return C.split_cohort(persons(spark, d).filter("mother_pnr is not null"), urgent)


SIDES = f"""
c as (select * from v_persons where mother_pnr is not null and pnr in ({URGENT})),
k as (select * from v_persons where mother_pnr is not null and pnr not in ({URGENT}))"""
ELIGIBLE = """abs(datediff('day', c.birth_date, k.birth_date)) <= 30 and c.pnr <> k.pnr and coalesce(c.gender = k.gender, c.gender is null)
  and coalesce(abs(c.children_count - k.children_count) <= 1, c.children_count is null)"""


@query(
    "jn09_eligible_cells",
    f"""with {SIDES},
cc as (select birth_date, gender, children_count, count(*) as n from c group by all), kc as (select birth_date, gender, children_count, count(*) as n from k group by all)
select c.birth_date as case_birth_date, c.gender as case_gender, c.children_count as case_children_count, c.n as case_n,
  k.birth_date as control_birth_date, k.gender as control_gender, k.children_count as control_children_count, k.n as control_n
from cc c join kc k on {ELIGIBLE.replace("and c.pnr <> k.pnr ", "")}""",
)
def _(spark, d):
    criteria = matching.MatchingCriteria()
    cases, controls = (matching.prepare(s, criteria, "side") for s in sides(spark, d))
    pairs = matching.eligible_cells(matching.cells(cases, criteria), matching.cells(controls, criteria), criteria)
    return pairs.drop("case_cell", "control_cell")


PARENTS = matching.MatchingCriteria(match_family_size=False, match_parent_age=True, parent_birth_window_days=400)


def _with_parents(spark, d, side):
    """Persons with their parents' birth dates."""
    born = view(spark, d, "bef").select(F.col("PNR").alias("_p"), F.col("FOED_DAG").alias("_born"))
    for parent in ("mother", "father"):
        side = side.join(born, side[f"{parent}_pnr"] == born["_p"], "left").withColumnRenamed("_born", f"{parent}_birth_date").drop("_p")
    return side


_PARENT_SQL = "(select s.*, m.FOED_DAG as mother_birth_date, f.FOED_DAG as father_birth_date from {0} s left join v_bef m on m.PNR = s.mother_pnr left join v_bef f on f.PNR = s.father_pnr)"


@query(
    "jn09_eligible_counts_parent_windows",
    f"""with {SIDES}, cp as {_PARENT_SQL.format("c")}, kp as {_PARENT_SQL.format("k")}
select c.pnr, count(k.pnr) as eligible from cp c left join kp k on abs(datediff('day', c.birth_date, k.birth_date)) <= 30 and c.pnr <> k.pnr
  and coalesce(c.gender = k.gender, c.gender is null)
  and coalesce(abs(datediff('day', c.mother_birth_date, k.mother_birth_date)) <= 400, c.mother_birth_date is null)
  and coalesce(abs(datediff('day', c.father_birth_date, k.father_birth_date)) <= 400, c.father_birth_date is null)
group by c.pnr""",
)
def _(spark, d):
    return matching.eligible_counts(*(_with_parents(spark, d, s) for s in sides(spark, d)), PARENTS)


@query(
    "jn07_enrich_duplicates",
    """with r as (select PNR as pnr, cast(HFAUDD as varchar) as a, HF_KILDE as b from v_uddf
  union all select PNR, null, SOCIO13 from v_akm union all select PNR, SOCIO13, 'x' from v_akm)
select pnr, a, b from (select *, row_number() over (partition by pnr order by (a is null)::int + (b is null)::int, a, b) as n from r) where n = 1""",
)
def _(spark, d):
    """Three detail rows per person, one of them incomplete: the row taken is one of them."""
    school = view(spark, d, "uddf").select(F.col("PNR").alias("pnr"), F.col("HFAUDD").cast("string").alias("a"), F.col("HF_KILDE").alias("b"))
    work = view(spark, d, "akm").select(F.col("PNR").alias("pnr"), "SOCIO13")
    rows = school.unionByName(work.select("pnr", F.lit(None).cast("string").alias("a"), F.col("SOCIO13").alias("b")))
    rows = rows.unionByName(work.select("pnr", F.col("SOCIO13").alias("a"), F.lit("x").alias("b")))
    return C.enrich(rows.select("pnr").distinct(), rows)


@query(
    "jn10_split_cohort",
    "select PNR as pnr, PNR in (select PNR from v_dod) as affected from v_bef",
)
def _(spark, d):
    inside, outside = C.split_cohort(mapped(spark, d, "bef").select("pnr"), mapped(spark, d, "dod").select("pnr"))
    return inside.withColumn("affected", F.lit(True)).unionByName(outside.withColumn("affected", F.lit(False)))


def integrated(spark, d):
    base = mapped(spark, d, "bef").select("pnr", "gender", "birth_date")
    best = mapped(spark, d, "ind").groupBy("pnr").agg(F.max("annual_income").alias("annual_income"))
    return mapping.fill_missing(mapping.fill_missing(base, mapped(spark, d, "akm")), best)


@query(
    "jn11_integrate_registers",
    """select b.PNR as pnr, b.KOEN as gender, cast(a.SOCIO13 as int) as socioeconomic_status, round(i.income, 2) as annual_income
from v_bef b left join v_akm a on a.PNR = b.PNR left join (select PNR, max(PERINDKIALT_13) as income from v_ind group by PNR) i on i.PNR = b.PNR""",
)
def _(spark, d):
    return integrated(spark, d).select("pnr", "gender", "socioeconomic_status", F.round("annual_income", 2).alias("annual_income"))


@query(
    "jn11_enrichment_rates",
    """with j as (select a.SOCIO13 as s, i.PNR as i from v_bef b left join v_akm a on a.PNR = b.PNR left join (select distinct PNR from v_ind) i on i.PNR = b.PNR)
select 'socioeconomic_status' as field, avg(case when s is not null then 1.0::double else 0 end) as share from j
union all select 'annual_income', avg(case when i is not null then 1.0::double else 0 end) from j""",
)
def _(spark, d):
    return longitudinal.enrichment_rates(integrated(spark, d), ["socioeconomic_status", "annual_income"])


@query(
    "jn12_related_both_ways",
    """with l as (select distinct l_suppkey, l_partkey from lineitem)
select 'parts' as side, l.l_suppkey as from_id, p.p_partkey as id, p.p_name as name from l join part p on p.p_partkey = l.l_partkey
union all select 'suppliers', l.l_partkey, s.s_suppkey, s.s_name from l join supplier s on s.s_suppkey = l.l_suppkey""",
)
def _(spark, d):
    rows = table(spark, d, "lineitem")
    pairs = ("l_suppkey", "l_partkey")
    links = C.add_links(
        rows.filter("l_returnflag = 'R'").select(*pairs), rows.filter("l_returnflag <> 'R'").select(*pairs)
    )
    parts = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"))
    suppliers = table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"))
    down = C.related(links, "l_suppkey", "l_partkey", parts, "id")
    up = C.related(links, "l_partkey", "l_suppkey", suppliers, "id")
    return down.select(F.lit("parts").alias("side"), F.col("l_suppkey").alias("from_id"), "id", "name").unionByName(
        up.select(F.lit("suppliers").alias("side"), F.col("l_partkey").alias("from_id"), "id", "name")
    )


@query(
    "jn12_remove_links",
    """select distinct l_suppkey, l_partkey from lineitem
except select l_suppkey, l_partkey from lineitem where l_returnflag = 'R'""",
)
def _(spark, d):
    rows = table(spark, d, "lineitem")
    links = rows.select("l_suppkey", "l_partkey").distinct()
    return C.remove_links(links, rows.filter("l_returnflag = 'R'").select("l_suppkey", "l_partkey"))


@query("jn13_lookup", "select c_nationkey as lookup_key, arg_min(c_name, c_custkey) as c_name from customer group by c_nationkey")
def _(spark, d):
    rows = table(spark, d, "customer")
    return C.lookup(rows, F.col("c_nationkey"), F.col("c_custkey")).select("lookup_key", "c_name")


@query("jn13_multi_lookup", "select substr(c_name, length(c_name), 1) || c_mktsegment as lookup_key, c_custkey from customer")
def _(spark, d):
    key = F.concat(F.expr("substring(c_name, -1)"), F.col("c_mktsegment"))
    return C.multi_lookup(table(spark, d, "customer"), key).select("lookup_key", "c_custkey")
