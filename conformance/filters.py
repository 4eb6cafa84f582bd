"""Filters and predicates (FI), transforms (TR) and user functions (UD)."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from conformance.frames import AGE, ALIVE, CHILD, INDEX, INDEX_SQL, hospital, mapped, members, persons, results, snapshots
from conformance.registry import block, query
from conformance.views import table, view
from lifeframe.functions import codes, dates, icd
from lifeframe.functions import predicates as P
from lifeframe.operators import chronic, code_lists, diagnoses, families, mapping, transforms
from lifeframe.operators import persons as people
from lifeframe.sources.specs import RegisterField, RegisterSpec

ORDERS = "o_orderkey"


def _orders(spark, d):
    return table(spark, d, "orders")


@query("fi01_equal", "select o_orderkey from orders where o_orderstatus = 'F' and o_custkey <> 7")
def _(spark, d):
    return _orders(spark, d).filter((F.col("o_orderstatus") == "F") & (F.col("o_custkey") != 7)).select(ORDERS)


@query("fi02_order", "select o_orderkey from orders where o_totalprice >= 100000 and o_totalprice < 250000.5 and o_custkey > 10 and o_custkey <= 1200")
def _(spark, d):
    price, who = F.col("o_totalprice"), F.col("o_custkey")
    return _orders(spark, d).filter((price >= 100000) & (price < 250000.5) & (who > 10) & (who <= 1200)).select(ORDERS)


@query("fi03_membership", "select PNR from v_bef where ANTAL_BOERN not in (1, 2)")
def _(spark, d):
    return view(spark, d, "bef").filter(P.not_in(F.col("ANTAL_BOERN"), [1, 2])).select("PNR")


@query("fi03_membership_strict_nulls", "select PNR from v_bef where not coalesce(ANTAL_BOERN in (1, 2), false)")
def _(spark, d):
    return view(spark, d, "bef").filter(P.not_in(F.col("ANTAL_BOERN"), [1, 2], strict_nulls=True)).select("PNR")


@query("fi04_null_tests", "select PNR from v_bef where FAR_ID is null and MOR_ID is not null")
def _(spark, d):
    return view(spark, d, "bef").filter(F.col("FAR_ID").isNull() & F.col("MOR_ID").isNotNull()).select("PNR")


@query(
    "fi05_text_tests",
    "select o_orderkey from orders where (o_orderpriority like '%URGENT%' or o_orderpriority like '2-%') and not o_orderpriority like '%X'",
)
def _(spark, d):
    c = F.col("o_orderpriority")
    hit = (P.contains(c, "URGENT") | P.starts_with(c, "2-")) & ~P.ends_with(c, "X")
    return _orders(spark, d).filter(hit).select(ORDERS)


@query("fi06_logic", "select PNR from v_bef where (ANTAL_BOERN > 2 or KOEN = '1') and not (KOM = '130')")
def _(spark, d):
    hit = P.all_of(P.any_of(F.col("ANTAL_BOERN") > 2, F.col("KOEN") == "1"), P.negate(F.col("KOM") == "130"))
    return view(spark, d, "bef").filter(hit).select("PNR")


@query(
    "fi06_logic_strict_nulls",
    "select PNR from v_bef where case when ANTAL_BOERN is not null and KOEN is not null then ANTAL_BOERN > 2 or KOEN = '1' end",
)
def _(spark, d):
    hit = P.any_of(F.col("ANTAL_BOERN") > 2, F.col("KOEN") == "1", strict_nulls=True)
    return view(spark, d, "bef").filter(hit).select("PNR")


@query("fi07_constants", "select o_orderkey from orders where true and not false")
def _(spark, d):
    return _orders(spark, d).filter(P.always_true() & ~P.always_false()).select(ORDERS)


@query(
    "fi08_day_number_filter",
    "select o_orderkey from orders where datediff('day', date '1970-01-01', cast(o_orderdate as date)) > 10500 and o_orderpriority in ('1-URGENT', '2-HIGH')",
)
def _(spark, d):
    day = dates.day_number(F.col("o_orderdate").cast("date"))
    return _orders(spark, d).filter((day > 10500) & P.is_in(F.col("o_orderpriority"), ["1-URGENT", "2-HIGH"])).select(ORDERS)


@query("fi10_combined_filters", "select o_orderkey from orders where (o_totalprice > 300000 or o_orderstatus = 'P') and not o_custkey < 100")
def _(spark, d):
    dear = P.Predicate(lambda df: df["o_totalprice"] > 300000)
    pending = P.Predicate(lambda df: df["o_orderstatus"] == "P")
    early = P.Predicate(lambda df: df["o_custkey"] < 100)
    return P.apply_all(_orders(spark, d), [dear | pending, ~early]).select(ORDERS)


@query("fi11_date_range", "select o_orderkey from orders where cast(o_orderdate as date) between date '1996-02-01' and date '1997-07-31'")
def _(spark, d):
    hit = P.date_in_range(F.col("o_orderdate"), dt.date(1996, 2, 1), dt.date(1997, 7, 31))
    return _orders(spark, d).filter(hit).select(ORDERS)


@query("fi12_calendar_year", "select PNR, D_INDDTO from v_lpr_adm where year(D_INDDTO) = 1998")
def _(spark, d):
    return view(spark, d, "lpr_adm").filter(P.in_year(F.col("D_INDDTO"), 1998)).select("PNR", "D_INDDTO")


@query("fi13_drop_missing", "select PNR from v_bef where MOR_ID is not null and ANTAL_BOERN is not null")
def _(spark, d):
    return P.drop_missing(view(spark, d, "bef"), ["MOR_ID", "ANTAL_BOERN"]).select("PNR")


RURAL = "case when municipality_code is null then false else not coalesce(try_cast(municipality_code as int), 0) between 400 and 600 end"


@query(
    "fi14_person_filter",
    f"select pnr from v_persons where {AGE} between 5 and 40 and gender = '2' and {RURAL} and {ALIVE}",
)
def _(spark, d):
    test = people.person_predicate(INDEX, age_range=(5, 40), alive_on_date=True, gender="Female", rural=True)
    df = persons(spark, d)
    return df.filter(test(df)).select("pnr")


@query("fi15_family_filter", "select family_id from v_members where role = 'child' group by family_id having count(*) between 2 and 3")
def _(spark, d):
    built = families.build_families(members(spark, d))
    return built.filter(families.family_predicate(min_children=2, max_children=3)(built)).select("family_id")


@query(
    "fi16_snapshot_filter",
    """select family_id from v_snapshots_full where has_scd_child and has_parental_comorbidity and is_rural and children >= 1
union all select family_id from v_snapshots_full where not has_scd_child""",
)
def _(spark, d):
    df = snapshots(spark, d)
    case = families.family_predicate(has_scd_child=True, parental_comorbidity=True, rural=True, min_children=1)
    return df.filter(case(df) | families.family_predicate(has_scd_child=False)(df)).select("family_id")


@query("fi17_filter_persons", f"select pnr from v_persons where {ALIVE} and gender = '1' and municipality_code = '400'")
def _(spark, d):
    df = persons(spark, d)
    tests = [
        people.person_predicate(INDEX, alive_on_date=True), people.person_predicate(gender="Male"),
        people.person_predicate(municipality="400"),
    ]
    return P.apply_all(df, tests).select("pnr")


@query("fi18_predicate_algebra", "select p_partkey from part where (p_size > 20 and p_retailprice < 1500) or not (p_brand like 'Brand#1%')")
def _(spark, d):
    big = P.Predicate(lambda df: df["p_size"] > 20)
    cheap = P.Predicate(lambda df: df["p_retailprice"] < 1500)
    first = P.Predicate(lambda df: df["p_brand"].startswith("Brand#1"))
    return ((big & cheap) | ~first).apply(table(spark, d, "part")).select("p_partkey")


@query("fi19_opaque_predicate", "select p_partkey from part where p_size % 7 = 3 and p_retailprice > 905")
def _(spark, d):
    return transforms.filter_with(
        table(spark, d, "part"), lambda b: (b["p_size"] % 7 == 3) & (b["p_retailprice"] > 905), ["p_size", "p_retailprice"]
    ).select("p_partkey")


@query("fi20_alive", f"select pnr from v_persons where {ALIVE}")
def _(spark, d):
    return people.alive(persons(spark, d), INDEX).select("pnr")


@query("fi20_age_between", f"select pnr from v_persons where {AGE} between 0 and 17")
def _(spark, d):
    return people.age_between(persons(spark, d), 0, 17, INDEX).select("pnr")


@query("fi20_gender_and_municipality", "select pnr from v_persons where gender = '2' and municipality_code = '130'")
def _(spark, d):
    return people.by_municipality(people.by_gender(persons(spark, d), "Female"), "130").select("pnr")


@query(
    "fi20_relatives",
    """select pnr from v_persons where mother_pnr = '0000000005' or father_pnr = '0000000005'
or pnr in (select mother_pnr from v_persons where pnr = '0000000005') or pnr in (select father_pnr from v_persons where pnr = '0000000005')""",
)
def _(spark, d):
    return people.relatives_of(persons(spark, d), "0000000005").select("pnr")


block("stays", "select PNR as pnr, RECNUM as id, D_INDDTO as valid_from, case when V_SENGDAGE < 9 then D_UDDTO end as valid_to from v_lpr_adm")


def _stays(spark, d):
    return view(spark, d, "lpr_adm").select(
        F.col("PNR").alias("pnr"), F.col("RECNUM").alias("id"), F.col("D_INDDTO").alias("valid_from"),
        F.when(F.col("V_SENGDAGE") < 9, F.col("D_UDDTO")).alias("valid_to"),
    )


@query("fi21_valid_at", "select id from v_stays where valid_from <= date '1998-06-15' and (valid_to is null or valid_to >= date '1998-06-15')")
def _(spark, d):
    hit = P.valid_at(F.col("valid_from"), F.col("valid_to"), F.lit(dt.date(1998, 6, 15)))
    return _stays(spark, d).filter(hit).select("id")


@query("fi21_valid_during", "select id from v_stays where valid_from <= date '1998-06-30' and (valid_to is null or valid_to >= date '1998-06-01')")
def _(spark, d):
    hit = P.valid_during(F.col("valid_from"), F.col("valid_to"), F.lit(dt.date(1998, 6, 1)), F.lit(dt.date(1998, 6, 30)))
    return _stays(spark, d).filter(hit).select("id")


block(
    "child_state",
    """select m.family_id, m.pnr, m.birth_date, m.death_date, coalesce(s.has_scd, false) as has_scd, s.first_scd_date,
  case when s.has_scd then case when s.c then 1 when s.d80 then 2 when s.g71 then 4 when s.q then 10 else 0 end end as scd_category,
  case when s.has_scd then 2 end as disease_severity, case when s.has_scd then case when s.q then 'Congenital' else 'Acquired' end end as disease_origin
from v_members m left join (
  select pnr, bool_or(hit) as has_scd, min(case when hit then diagnosis_date end) as first_scd_date, bool_or(code like 'C%') as c,
    bool_or(code like 'D80%') as d80, bool_or(code like 'G71%') as g71, bool_or(code like 'Q%') as q
  from (select pnr, diagnosis_code as code, diagnosis_date, diagnosis_code in ('E10','G40','Q90','C50') or diagnosis_code like 'C%'
    or diagnosis_code like 'D80%' or diagnosis_code like 'G71%' or diagnosis_code like 'Q%' as hit from v_hospital) group by pnr) s on s.pnr = m.pnr
where m.role = 'child'""",
)


def child_state(spark, d):
    children = members(spark, d).filter("role = 'child'").select("family_id", "pnr", "birth_date", "death_date")
    return families.link_child_diagnoses(children, hospital(spark, d))


@query(
    "fi22_children_by_state",
    f"""select pnr, has_scd, coalesce(first_scd_date <= {INDEX_SQL}, false) as at_index, coalesce(scd_category = 1, false) as in_category,
  coalesce(disease_severity = 2, false) as moderate from v_child_state""",
)
def _(spark, d):
    known = lambda c: F.coalesce(c, F.lit(False))
    return child_state(spark, d).select(
        "pnr", "has_scd", families.had_scd_at(F.col("first_scd_date"), F.lit(INDEX)).alias("at_index"),
        known(F.col("scd_category") == 1).alias("in_category"), known(F.col("disease_severity") == 2).alias("moderate"),
    )


@query(
    "fi23_parents_by_income",
    """select m.pnr from v_members m left join (select pnr, max(amount) as income from v_incomes where income_type = 'salary' group by pnr) i
  on i.pnr = m.pnr where m.role <> 'child' and coalesce(i.income, 0) > 150000""",
)
def _(spark, d):
    from conformance.frames import incomes

    best = incomes(spark, d).filter("income_type = 'salary'").groupBy("pnr").agg(F.max("amount").alias("income"))
    parents = members(spark, d).filter("role <> 'child'").join(best, "pnr", "left")
    return families.parents_with_income_above(parents, 150000.0).select("pnr")


@query(
    "fi24_affected_subsets",
    """select pnr, has_scd, categories like '%01%' as blood, has_scd and max_severity >= 3 as severe from v_chronic""",
)
def _(spark, d):
    df = results(spark, d)
    keys = {n: f.select("pnr", F.lit(True).alias(n)) for n, f in (("blood", chronic.in_category(df, 1)), ("severe", chronic.at_least(df, 3)))}
    both = chronic.affected(df).unionByName(chronic.unaffected(df)).select("pnr", "has_scd")
    for frame in keys.values():
        both = both.join(frame, "pnr", "left")
    return both.fillna(False, ["blood", "severe"])


@query(
    "fi25_code_prefixes",
    "select pnr, diagnosis_code, diagnosis_date from v_hospital where diagnosis_code like 'E1%' or diagnosis_code like 'J45%' or diagnosis_code like 'Q%'",
)
def _(spark, d):
    return diagnoses.with_prefixes(hospital(spark, d), ["e1", " J45", "Q"]).select("pnr", "diagnosis_code", "diagnosis_date")


# A list of thousands of prefixes of one to six characters, most of which no diagnosis has.
block(
    "code_list",
    """select prefix, min(grp) as grp from (
  select substr(C_ADIAG, 1, cast(1 + o % 4 as int)) as prefix, cast(o % 11 as int) as grp from (select C_ADIAG, cast(RECNUM as bigint) as o from v_lpr_adm) where o % 3 = 0
  union all select 'Z' || cast(o_orderkey as varchar), cast(o_orderkey % 11 as int) from orders where o_orderkey % 2 = 0) group by prefix""",
)


def _code_list(spark, d):
    key = F.col("RECNUM").cast("long")
    own = view(spark, d, "lpr_adm").filter(key % 3 == 0).select(
        F.substring("C_ADIAG", F.lit(1), (1 + key % 4).cast("int")).alias("prefix"), (key % 11).cast("int").alias("grp")
    )
    others = table(spark, d, "orders").filter("o_orderkey % 2 = 0").selectExpr("'Z' || o_orderkey as prefix", "cast(o_orderkey % 11 as int) as grp")
    return own.unionByName(others).groupBy("prefix").agg(F.min("grp").alias("grp"))


@query("fi25_code_list", "select pnr, diagnosis_code, diagnosis_date, prefix, grp from v_hospital join v_code_list on starts_with(diagnosis_code, prefix)")
def _(spark, d):
    found = code_lists.with_code_list(hospital(spark, d), _code_list(spark, d), match="all")
    return found.select("pnr", "diagnosis_code", "diagnosis_date", "prefix", "grp")


@query(
    "hl13_first_per_list_entry",
    """select pnr, prefix, min(diagnosis_date) as first_date, count(*) as diagnoses from v_hospital join (
  select c, arg_max(prefix, length(prefix)) as prefix from (select distinct diagnosis_code as c from v_hospital) join v_code_list on starts_with(c, prefix) group by c)
on c = diagnosis_code group by pnr, prefix""",
)
def _(spark, d):
    """Each person's first diagnosis under the longest entry of the list that a code falls under."""
    found = code_lists.with_code_list(hospital(spark, d), _code_list(spark, d))
    return found.groupBy("pnr", "prefix").agg(F.min("diagnosis_date").alias("first_date"), F.count(F.lit(1)).alias("diagnoses"))


block(
    "background",
    """select b.PNR as pnr, b.FOED_DAG as birth_date, b.KOM as municipality_code, case substr(b.SEGMENT, 1, 1) when 'A' then 'DK' when 'B' then 'west' when 'F' then '3' when 'H' then ' Danish ' end as origin,
  case u.HFAUDD % 4 when 0 then 'low' when 1 then '2' when 2 then 'HIGH' when 3 then 'x' end as education_level from v_bef b left join v_uddf u on u.PNR = b.PNR""",
)


@query(
    "fi14_person_filter_background",
    """select pnr from v_background where (origin in ('DK', ' Danish ') and education_level = '2') or (origin = 'west' and not education_level = 'low' and not education_level is null)
  or (origin is null and (education_level is null or education_level = 'x') and municipality_code = '400')""",
)
def _(spark, d):
    """Origin and education, alone and nested: any of all, with one condition turned round."""
    letter, number = F.substring("SEGMENT", 1, 1), F.col("HFAUDD") % 4
    df = view(spark, d, "bef").join(view(spark, d, "uddf").select("PNR", "HFAUDD"), "PNR", "left").select(
        F.col("PNR").alias("pnr"), F.col("FOED_DAG").alias("birth_date"), F.lit(None).cast("date").alias("death_date"), F.col("KOM").alias("municipality_code"),
        F.when(letter == "A", "DK").when(letter == "B", "west").when(letter == "F", "3").when(letter == "H", " Danish ").alias("origin"),
        F.when(number == 0, "low").when(number == 1, "2").when(number == 2, "HIGH").when(number == 3, "x").alias("education_level"),
    )
    danish = people.person_predicate(origin="Danish", education="Medium")
    western = P.Predicate(people.person_predicate(origin="Western")) & ~P.Predicate(people.person_predicate(education="Low")) & (
        ~P.Predicate(people.person_predicate(education="Unknown")) | (lambda f: f["education_level"] == "x")
    )
    unknown = P.Predicate(people.person_predicate(origin="Unknown", education="Unknown", municipality="400"))
    return df.filter(P.any_of(danish(df), western(df), P.all_of(unknown(df), P.always_true()))).select("pnr")


@query("fi25_code_patterns", "select RECNUM from v_lpr_adm where C_ADIAG like 'C0%' or C_ADIAG = 'E370'")
def _(spark, d):
    code = F.col("C_ADIAG")
    return view(spark, d, "lpr_adm").filter(icd.matches_pattern(code, "C0*") | icd.matches_pattern(code, "E370")).select("RECNUM")


@query("fi26_by_attribute", f"select pnr from v_persons where municipality_code = '400' and {ALIVE}")
def _(spark, d):
    tests = [lambda df: df["municipality_code"] == "400", people.person_predicate(INDEX, alive_on_date=True)]
    return P.apply_all(persons(spark, d), tests).select("pnr")


@query("tr01_add_year", "select o_orderkey, cast(year(o_orderdate) as int) as year from orders")
def _(spark, d):
    return transforms.add_year(_orders(spark, d), "o_orderdate").select(ORDERS, "year")


@query("tr02_map_categories", "select o_orderkey, case o_orderstatus when 'F' then 'finished' when 'O' then 'open' end as o_orderstatus from orders")
def _(spark, d):
    return transforms.map_categories(_orders(spark, d), "o_orderstatus", {"F": "finished", "O": "open"}).select(ORDERS, "o_orderstatus")


@query("tr03_scale", "select p_partkey, cast(p_size as double) * 2.5 as p_size from part")
def _(spark, d):
    return transforms.scale(table(spark, d, "part"), "p_size", 2.5).select("p_partkey", "p_size")


@query(
    "tr04_postal_region",
    """select c_custkey, case when c_custkey % 13 = 0 then null when c_custkey % 11 = 0 then 'Unknown' else
  case cast(floor(((c_custkey * 37) % 10000) / 1000) as int) when 1 then 'Hovedstaden' when 2 then 'Hovedstaden' when 3 then 'Nordsjælland' when 4 then 'Sjælland' when 5 then 'Fyn'
    when 6 then 'Sydjylland' when 7 then 'Midtjylland' when 8 then 'Østjylland' when 9 then 'Nordjylland' else 'Unknown' end end as region from customer""",
)
def _(spark, d):
    key = F.col("c_custkey")
    code = F.when(key % 13 == 0, F.lit(None)).when(key % 11 == 0, F.lit("x")).otherwise((key * 37 % 10000).cast("string"))
    return transforms.add_postal_region(table(spark, d, "customer").withColumn("zip", code), "zip").select("c_custkey", "region")


@query("tr05_transform_batches", "select o_orderkey, o_totalprice * 2 as doubled from orders where o_orderstatus = 'O'")
def _(spark, d):
    def double_open(batch):
        kept = batch[batch["o_orderstatus"] == "O"]
        return kept.assign(doubled=kept["o_totalprice"] * 2)[["o_orderkey", "doubled"]]

    rows = _orders(spark, d).select("o_orderkey", "o_totalprice", "o_orderstatus")
    return transforms.transform_batches(rows, double_open, "o_orderkey long, doubled double")


@query("ud01_row_predicate", "select s_suppkey from supplier where s_acctbal > 0 and s_nationkey < 12")
def _(spark, d):
    return transforms.where(table(spark, d, "supplier"), lambda df: (df["s_acctbal"] > 0) & (df["s_nationkey"] < 12)).select("s_suppkey")


@query("ud02_batch_function", "select s_suppkey, upper(s_name) as s_name from supplier")
def _(spark, d):
    rows = table(spark, d, "supplier").select("s_suppkey", "s_name")
    return transforms.transform_batches(rows, lambda b: b.assign(s_name=b["s_name"].str.upper()), rows.schema)


@query("ud03_value_function", "select c_custkey, length(c_name) + 1 as width from customer")
def _(spark, d):
    def width(names):
        return names.str.len() + 1

    return transforms.derive(table(spark, d, "customer"), "c_name", width, "long", "width").select("c_custkey", "width")


@query(
    "ud04_user_register",
    "select lpad(cast(s_suppkey as varchar), 6, '0') as pnr, s_nationkey as country, round(s_acctbal * 2, 2) as doubled from supplier",
)
def _(spark, d):
    spec = RegisterSpec(
        "suppliers", "s_suppkey",
        (
            RegisterField("s_suppkey", "pnr", expression=codes.zero_padded(F.col("s_suppkey"), 6)),
            RegisterField("s_nationkey", "country", "int"),
            RegisterField("s_acctbal", "doubled", "double", expression=F.round(F.col("s_acctbal") * 2, 2)),
        ),
    )
    return mapping.map_register(table(spark, d, "supplier"), spec)
