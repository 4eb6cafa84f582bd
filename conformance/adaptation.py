"""Schema adaptation and register mapping (SA, FM)."""

from __future__ import annotations

import functools

from pyspark.sql import functions as F
from pyspark.sql import types as T

from conformance.frames import incomes, mapped
from conformance.registry import query
from conformance.views import table, view
from lifeframe.functions import codes, dates, icd
from lifeframe.operators import mapping
from lifeframe.sources import adapt
from lifeframe.sources.specs import REGISTERS, register, register_from_columns


ORDERS_TARGET = T.StructType(
    [
        T.StructField("o_orderkey", T.DoubleType()), T.StructField("o_orderdate", T.StringType()), T.StructField("o_orderstatus", T.StringType()),
        T.StructField("o_totalprice", T.IntegerType()), T.StructField("shipped", T.DateType()),
    ]
)


@query(
    "sa02_adaptation_report",
    """select * from (values (0, 'o_orderkey', 'bigint', 'double', 'compatible', 'numeric_conversion'),
  (1, 'o_orderdate', 'timestamp_ntz', 'string', 'compatible', 'date_formatting'), (2, 'o_orderstatus', 'string', 'string', 'exact', null),
  (3, 'o_totalprice', 'double', 'int', 'incompatible', null), (4, 'shipped', null, 'date', 'missing', null))
  as t(position, field, source_type, target_type, status, strategy)""",
)
def _(spark, d):
    return adapt.adaptation_report(spark, table(spark, d, "orders").schema, ORDERS_TARGET)


@query(
    "sa03_lenient_adaptation",
    """select cast(o_orderkey as double) as o_orderkey, strftime(o_orderdate, '%Y-%m-%d') as o_orderdate, o_orderstatus,
  cast(trunc(o_totalprice) as int) as o_totalprice, cast(null as date) as shipped from orders""",
)
def _(spark, d):
    """The pair that the rules call incompatible is cast where strictness is off."""
    return adapt.adapt(table(spark, d, "orders"), ORDERS_TARGET, strict=False)


# A view and the register its columns are taken for: the population register where none gives it away.
_RECOGNISED = {
    "bef": "bef", "akm": "bef", "uddf": "bef", "dod": "dod", "vnds": "bef", "lpr_adm": "lpr_adm", "lpr_diag": "lpr_adm", "ind": "ind",
}


@query(
    "sc09_register_from_columns",
    " union all ".join(f"select '{n}' as delivered, '{r}' as recognised, count(*) as n from v_{n}" for n, r in _RECOGNISED.items()),
)
def _(spark, d):
    frames = {n: view(spark, d, n) for n in _RECOGNISED}
    parts = [
        df.agg(F.lit(n).alias("delivered"), F.lit(register_from_columns(df.columns).name).alias("recognised"), F.count(F.lit(1)).alias("n"))
        for n, df in frames.items()
    ]
    return functools.reduce(lambda a, b: a.unionByName(b), parts)


@query(
    "sa01_adapt_schema",
    """select cast(o_orderkey as double) as o_orderkey, strftime(o_orderdate, '%Y-%m-%d') as o_orderdate, o_orderstatus, cast(null as date) as shipped from orders""",
)
def _(spark, d):
    target = T.StructType(
        [
            T.StructField("o_orderkey", T.DoubleType()), T.StructField("o_orderdate", T.StringType()),
            T.StructField("o_orderstatus", T.StringType()), T.StructField("shipped", T.DateType()),
        ]
    )
    return adapt.adapt(table(spark, d, "orders"), target)


_TEXT_DATE = """case o_orderkey % 9 when 0 then strftime(o_orderdate, '%Y-%m-%d') when 1 then strftime(o_orderdate, '%d-%m-%Y')
  when 2 then strftime(o_orderdate, '%m/%d/%Y') when 3 then strftime(o_orderdate, '%d.%m.%Y') when 4 then strftime(o_orderdate, '%Y%m%d')
  when 5 then strftime(o_orderdate, '%d %b %Y') when 6 then strftime(o_orderdate, '%d %B %Y') when 7 then strftime(o_orderdate, '%Y/%m/%d') else 'n/a' end"""


def _text_date(pattern_by_rest: dict[int, str]):
    day, result = F.col("o_orderdate"), None
    for rest, pattern in pattern_by_rest.items():
        hit, text = F.col("o_orderkey") % 9 == rest, F.date_format(day, pattern)
        result = F.when(hit, text) if result is None else result.when(hit, text)
    return result.otherwise("n/a")


_PATTERNS = {
    0: "yyyy-MM-dd", 1: "dd-MM-yyyy", 2: "MM/dd/yyyy", 3: "dd.MM.yyyy", 4: "yyyyMMdd", 5: "dd MMM yyyy", 6: "dd MMMM yyyy",
    7: "yyyy/MM/dd",
}


@query(
    "sa04_parse_dates",
    f"select o_orderkey, {_TEXT_DATE} as text, case when o_orderkey % 9 <> 8 then cast(o_orderdate as date) end as parsed from orders",
)
def _(spark, d):
    df = table(spark, d, "orders").select("o_orderkey", _text_date(_PATTERNS).alias("text"))
    return df.withColumn("parsed", dates.parse_date(F.col("text")))


@query(
    "sa05_parse_register_dates",
    """select o_orderkey, case o_orderkey % 9 when 0 then strftime(o_orderdate, '%Y-%m-%d') when 1 then strftime(o_orderdate, '%d/%m/%Y')
  when 2 then strftime(o_orderdate, '%Y%m%d') when 3 then upper(strftime(o_orderdate, '%d%b%Y')) else 'n/a' end as text,
  case when o_orderkey % 9 <= 3 then cast(o_orderdate as date) end as parsed from orders""",
)
def _(spark, d):
    text = _text_date({0: "yyyy-MM-dd", 1: "dd/MM/yyyy", 2: "yyyyMMdd", 3: "ddMMMyyyy"})
    shown = F.when(F.col("o_orderkey") % 9 == 3, F.upper(text)).otherwise(text)
    df = table(spark, d, "orders").select("o_orderkey", shown.alias("text"))
    return df.withColumn("parsed", dates.parse_register_date(F.col("text")))


@query(
    "sa06_parse_matching_dates",
    """select o_orderkey, case when o_orderkey % 9 in (0, 1, 2, 7) then cast(o_orderdate as date) end as parsed from orders""",
)
def _(spark, d):
    text = _text_date({0: "yyyy-MM-dd", 1: "dd-MM-yyyy", 2: "dd/MM/yyyy", 7: "yyyy/MM/dd"})
    df = table(spark, d, "orders").select("o_orderkey", text.alias("text"))
    return df.select("o_orderkey", dates.parse_matching_date(F.col("text")).alias("parsed"))


@query("sa07_format_dates", "select o_orderkey, strftime(o_orderdate, '%Y-%m-%d') as text from orders")
def _(spark, d):
    return table(spark, d, "orders").select("o_orderkey", dates.format_date(F.col("o_orderdate")).alias("text"))


@query(
    "sa08_days_and_millis",
    """select o_orderkey, epoch_ms(cast(cast(o_orderdate as date) as timestamp)) as millis, cast(o_orderdate as date) as day,
  cast(datediff('day', date '1970-01-01', cast(o_orderdate as date)) as int) as day_number from orders""",
)
def _(spark, d):
    df = table(spark, d, "orders").select("o_orderkey", dates.date_to_millis(F.col("o_orderdate").cast("date")).alias("millis"))
    day = dates.millis_to_date(F.col("millis"))
    return df.select("o_orderkey", "millis", day.alias("day"), dates.day_number(day).alias("day_number"))


@query(
    "sa09_casts",
    """select c_custkey, cast(c_nationkey as double) as as_double, cast(c_nationkey as varchar) as as_text, case when c_acctbal > 0 then 'true' else 'false' end as flag_text,
  cast(c_acctbal > 0 as int) as flag_number, try_cast(c_name as int) as bad from customer""",
)
def _(spark, d):
    df = table(spark, d, "customer").withColumn("flag", F.col("c_acctbal") > 0)
    conv = lambda c, t: adapt.convert(F.col(c), df.schema[c].dataType, t)
    return df.select(
        "c_custkey", conv("c_nationkey", T.DoubleType()).alias("as_double"), conv("c_nationkey", T.StringType()).alias("as_text"),
        conv("flag", T.StringType()).alias("flag_text"), conv("flag", T.IntegerType()).alias("flag_number"),
        conv("c_name", T.IntegerType()).alias("bad"),
    )


@query("sa10_missing_columns", "select c_custkey, cast(null as date) as absent_date, cast(null as double) as absent_number from customer")
def _(spark, d):
    return table(spark, d, "customer").select(
        "c_custkey", adapt.missing_column(T.DateType()).alias("absent_date"), adapt.missing_column(T.DoubleType()).alias("absent_number")
    )


@query(
    "sa11_fetch_column",
    "select PNR as pnr, try_cast(SOCIO13 as int) as status, cast(null as date) as moved from v_akm",
)
def _(spark, d):
    df = view(spark, d, "akm")
    return df.select(
        adapt.fetch(df, ["CPR", "PNR"], T.StringType(), required=True).alias("pnr"),
        adapt.fetch(df, ["SOCIO13"], T.IntegerType()).alias("status"),
        adapt.fetch(df, ["BOP_VFRA"], T.DateType()).alias("moved"),
    )


@query(
    "sa12_extractors",
    "select c_custkey, lpad(cast(c_nationkey as varchar), 3, '0') as nation_code, lower(c_mktsegment) as segment from customer",
)
def _(spark, d):
    return table(spark, d, "customer").select(
        "c_custkey", codes.zero_padded(F.col("c_nationkey"), 3).alias("nation_code"), F.lower("c_mktsegment").alias("segment")
    )


@query(
    "sa13_rename_columns",
    "select PNR as patient_id, RECNUM, C_ADIAG as primary_diagnosis, D_INDDTO as admission_date, D_UDDTO as discharge_date, V_SENGDAGE from v_lpr_adm",
)
def _(spark, d):
    return adapt.rename_columns(view(spark, d, "lpr_adm"), adapt.LPR2_NAMES)


@query(
    "sa14_cause_of_death",
    """select PNR as pnr, upper(trim(C_AARSAG)) as death_cause, upper(trim(C_TILSTAND)) as death_condition,
  case substr(C_AARSAG,1,1) when 'C' then 'II' when 'D' then 'II,III' when 'E' then 'IV' when 'F' then 'V' when 'G' then 'VI' when 'I' then 'IX'
   when 'J' then 'X' when 'K' then 'XI' when 'M' then 'XIII' when 'N' then 'XIV' when 'P' then 'XVI' when 'Q' then 'XVII' end as chapters from v_dodsaarsag""",
)
def _(spark, d):
    return mapping.causes_of_death(mapped(spark, d, "dodsaarsag")).select(
        "pnr", "death_cause", "death_condition", F.array_join("chapters", ",").alias("chapters")
    )


def _columns(name: str) -> list[str]:
    """Mapped columns of a register that its view delivers."""
    return [f.target for f in register(name).fields]


_PRESENT = {
    "bef": "PNR KOEN FOED_DAG MOR_ID FAR_ID FAMILIE_ID KOM ANTAL_BOERN",
    "akm": "PNR SOCIO13", "ind": "PNR PERINDKIALT_13 LOENMV_13 YEAR", "uddf": "PNR HFAUDD HF_KILDE HF_VFRA INSTNR",
    "vnds": "PNR HAEND_KODE HAEND_DATO", "mfr": "CPR_BARN CPR_MODER VAEGT SVLNGD APGAR5", "dod": "PNR DODDATO C_AARSAG",
    "dodsaarsag": "PNR C_AARSAG C_TILSTAND D_DATO", "lpr_adm": "PNR RECNUM C_ADIAG D_INDDTO D_UDDTO V_SENGDAGE",
    "lpr_diag": "RECNUM C_DIAG C_DIAGTYPE C_TILDIAG", "lpr_bes": "RECNUM D_AMBDTO",
    "lpr3_kontakter": "CPR DW_EK_KONTAKT dato_start dato_slut aktionsdiagnose kontakttype",
    "lpr3_diagnoser": "DW_EK_KONTAKT diagnosekode diagnosetype senere_afkraeftet",
}
_SQL_TYPES = {"int": "int", "string": "varchar", "double": "double", "date": "date"}


def _register_query(name: str) -> None:
    spec = register(name)
    fields = [(source, spec.find(source)) for source in _PRESENT[name].split()]
    chosen = ", ".join(f"cast({s} as {_SQL_TYPES[f.kind]}) as {f.target}" for s, f in fields)
    key = next(s for s, f in fields if f.source == spec.id_column)

    @query(f"fm01_map_{name}", f"select {chosen} from v_{name} where {key} is not null and trim({key}) <> ''")
    def _(spark, d):
        return mapped(spark, d, name).select(*(f.target for _, f in fields))


for _name in REGISTERS:
    _register_query(_name)


@query(
    "fm02_individuals",
    """select PNR as pnr, KOM as municipality_code, case when KOM is null then false else not coalesce(try_cast(KOM as int), 0) between 400 and 600 end as is_rural from v_bef""",
)
def _(spark, d):
    return mapping.individuals(view(spark, d, "bef"), register("bef")).select("pnr", "municipality_code", "is_rural")


def _dates_text(column):
    return F.array_join(
        F.transform(column, lambda e: F.concat(F.date_format(e["date"], "yyyy-MM-dd"), F.lit("x"), e["n"].cast("string"))), ","
    )


@query(
    "fm03_admissions_per_person",
    """with f as (select PNR as pnr, string_agg(distinct C_ADIAG, ',' order by C_ADIAG) as diagnoses, cast(sum(V_SENGDAGE) as bigint) as hospitalization_days,
  arg_max(V_SENGDAGE, (D_INDDTO, RECNUM)) as length_of_stay, count(D_INDDTO) as admissions_count, max(D_INDDTO) as last_admissions_date from v_lpr_adm group by PNR),
days as (select PNR as pnr, D_INDDTO as dd, count(*) as n from v_lpr_adm group by PNR, D_INDDTO)
select f.*, g.admissions from f join (select pnr, string_agg(strftime(dd, '%Y-%m-%d') || 'x' || cast(n as varchar), ',' order by dd) as admissions
from days group by pnr) g on g.pnr = f.pnr""",
)
def _(spark, d):
    df = mapping.admissions_per_person(mapped(spark, d, "lpr_adm"))
    return df.select(
        "pnr", F.array_join("diagnoses", ",").alias("diagnoses"), "hospitalization_days", "length_of_stay", "admissions_count",
        "last_admissions_date", _dates_text("admissions").alias("admissions"),
    )


@query(
    "fm04_diagnosis_codes",
    """select distinct RECNUM as record_number, code as diagnosis_code from (select RECNUM, C_DIAG as code from v_lpr_diag
union all select RECNUM, C_TILDIAG from v_lpr_diag where trim(C_TILDIAG) <> '') where code is not null""",
)
def _(spark, d):
    return mapping.diagnosis_codes(mapped(spark, d, "lpr_diag"))


@query(
    "fm05_visits_per_person",
    """with days as (select a.PNR as pnr, b.D_AMBDTO as dd, count(*) as n from v_lpr_bes b join v_lpr_adm a on a.RECNUM = b.RECNUM group by 1, 2)
select pnr, string_agg(strftime(dd, '%Y-%m-%d') || 'x' || cast(n as varchar), ',' order by dd) as visits, cast(sum(n) as bigint) as outpatient_visits_count from days group by pnr""",
)
def _(spark, d):
    df = mapping.visits_per_person(mapped(spark, d, "lpr_bes"), mapped(spark, d, "lpr_adm"))
    return df.select("pnr", _dates_text("outpatient_visits").alias("visits"), "outpatient_visits_count")


@query(
    "fm06_contacts_per_person",
    """select CPR as pnr, max(dato_start) as last_admissions_date, count(dato_start) as admissions_count, count(dato_slut) as discharges_count,
  count(*) filter (where kontakttype like '%akut%' or kontakttype like '%emergency%') as emergency_visits_count,
  string_agg(distinct aktionsdiagnose, ',' order by aktionsdiagnose) as diagnoses from v_lpr3_kontakter group by CPR""",
)
def _(spark, d):
    df = mapping.contacts_per_person(mapped(spark, d, "lpr3_kontakter"))
    return df.select(
        "pnr", "last_admissions_date", "admissions_count", "discharges_count", "emergency_visits_count",
        F.array_join("diagnoses", ",").alias("diagnoses"),
    )


@query(
    "fm07_contact_diagnoses",
    """select DW_EK_KONTAKT as dw_ek_kontakt, string_agg(distinct diagnosekode, ',' order by diagnosekode) as diagnoses,
  string_agg(distinct diagnosetype, ',' order by diagnosetype) as diagnosis_types, bool_or(senere_afkraeftet = 'Ja') as later_disproved
from v_lpr3_diagnoser group by DW_EK_KONTAKT""",
)
def _(spark, d):
    df = mapping.contact_diagnoses(mapped(spark, d, "lpr3_diagnoser"))
    return df.select(
        "dw_ek_kontakt", F.array_join("diagnoses", ",").alias("diagnoses"),
        F.array_join("diagnosis_types", ",").alias("diagnosis_types"), "later_disproved",
    )


@query(
    "fm09_fill_missing",
    """select b.PNR as pnr, coalesce(b.MOR_ID, m.CPR_MODER) as mother_pnr, m.VAEGT as birth_weight
from v_bef b left join v_mfr m on m.CPR_BARN = b.PNR""",
)
def _(spark, d):
    base = mapped(spark, d, "bef").select("pnr", "mother_pnr")
    return mapping.fill_missing(base, mapped(spark, d, "mfr").select("pnr", "mother_pnr", "birth_weight"))


@query("fm10_incomes", "select pnr, year, income_type, round(amount, 2) as amount from v_incomes")
def _(spark, d):
    return mapping.incomes(mapped(spark, d, "ind")).select("pnr", "year", "income_type", F.round("amount", 2).alias("amount"))


@query(
    "fm11_diagnoses",
    """select a.PNR as pnr, d.C_DIAG as diagnosis_code, 'Other' as diagnosis_type, a.D_INDDTO as diagnosis_date,
  d.C_DIAG in ('E10','G40','Q90','C50') or d.C_DIAG like 'C%' or d.C_DIAG like 'D80%' or d.C_DIAG like 'G71%' or d.C_DIAG like 'Q%' as is_scd,
  case when d.C_DIAG like 'C%' or d.C_DIAG like 'Q90%' then 3
   when d.C_DIAG like 'Q%' or d.C_DIAG like 'D80%' or d.C_DIAG like 'G71%' or d.C_DIAG in ('E10','G40') then 2 else 1 end as severity
from v_lpr_diag d join v_lpr_adm a on a.RECNUM = d.RECNUM""",
)
def _(spark, d):
    joined = view(spark, d, "lpr_diag").join(view(spark, d, "lpr_adm").select("PNR", "RECNUM", "D_INDDTO"), "RECNUM")
    return mapping.diagnoses(joined)


@query(
    "fm12_code_tables",
    """select c_custkey, case c_custkey % 4 when 1 then 'Male' when 2 then 'Female' else 'Unknown' end as gender,
  case c_custkey % 4 when 1 then 'Danish' when 2 then 'Western' when 3 then 'NonWestern' else 'Unknown' end as origin,
  case c_custkey % 4 when 1 then 'Low' when 2 then 'Medium' when 3 then 'High' else 'Unknown' end as education,
  case c_custkey % 8 when 1 then 'EmployedFullTime' when 2 then 'EmployedPartTime' when 3 then 'SelfEmployed' when 4 then 'Unemployed'
   when 5 then 'Student' when 6 then 'Retired' when 7 then 'OnLeave' else 'Other' end as job_situation,
  case c_custkey % 6 when 1 then 'TwoParent' when 2 then 'SingleMother' when 3 then 'SingleFather' when 4 then 'NoParent' else 'Unknown' end as family_type,
  case substr('UGFEPOLX', cast(c_custkey % 8 as int) + 1, 1) when 'U' then 'Unmarried' when 'G' then 'Married' when 'F' then 'Divorced' when 'E' then 'Widowed'
   when 'P' then 'RegisteredPartnership' when 'O' then 'DissolvedPartnership' when 'L' then 'LongestLivingPartner' else 'Unknown' end as marital_status,
  case c_custkey % 6 when 1 then 'Danish' when 2 then 'EuropeanUnion' when 3 then 'NonEUWithResidence' when 4 then 'TemporaryPermit' when 5 then 'Stateless' else 'Unknown' end as citizenship,
  case c_custkey % 8 when 1 then 'SingleFamilyHouse' when 2 then 'Apartment' when 3 then 'TerracedHouse' when 4 then 'Dormitory' when 5 then 'Institution' when 6 then 'Other' else 'Unknown' end as housing,
  case c_custkey % 12 when 1 then 'SelfEmployedWithEmployees' when 2 then 'SelfEmployedWithoutEmployees' when 3 then 'TopLevelEmployee' when 4 then 'MediumLevelEmployee'
   when 5 then 'BasicLevelEmployee' when 6 then 'OtherEmployee' when 7 then 'Unemployed' when 8 then 'Student' when 9 then 'Pensioner' when 10 then 'OtherInactive' else 'Unknown' end as socioeconomic,
  case c_custkey % 5 when 1 then 'Mild' when 2 then 'Moderate' when 3 then 'Severe' else 'None' end as severity,
  case c_custkey % 3 when 1 then 'Congenital' when 2 then 'Acquired' else 'None' end as disease_origin,
  case c_custkey % 4 when 1 then 'Primary' when 2 then 'Secondary' else 'Other' end as diagnosis_type
from customer""",
)
def _(spark, d):
    key = F.col("c_custkey")
    moduli = {
        "gender": 4, "origin": 4, "education": 4, "job_situation": 8, "family_type": 6, "citizenship": 6, "housing": 8,
        "socioeconomic": 12, "severity": 5, "disease_origin": 3, "diagnosis_type": 4,
    }
    marital = F.substring(F.lit("UGFEPOLX"), (key % 8 + 1).cast("int"), F.lit(1))
    return table(spark, d, "customer").select(
        "c_custkey", codes.decode(marital, "marital_status").alias("marital_status"),
        *(codes.decode(key % m, t).alias(t) for t, m in moduli.items()),
    )
