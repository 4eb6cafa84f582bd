"""Register-shaped views over the given tables, one text for both engines."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

# The views. P(x) is a person id, ICD(k) a code, ADD(d,n) a date plus days.
_TEXT = {
    "bef": """
select P(c_custkey) as PNR,
  case when c_custkey%5=0 then '2' when c_custkey%5=1 then '1' when c_custkey%3=0 then '1' else '2' end as KOEN,
  ADD(date '1945-01-01', case when c_custkey%5<2 then (c_custkey*7919)%10000 else 10957+(c_custkey*104729)%9000 end) as FOED_DAG,
  case when c_custkey%5>=2 then P(c_custkey - c_custkey%5) end as MOR_ID,
  case when c_custkey%5>=2 and c_custkey%7<>0 then P(c_custkey - c_custkey%5 + 1) end as FAR_ID,
  P(c_custkey - c_custkey%5) as FAMILIE_ID,
  case when c_custkey%11<>0 then cast(1+c_custkey%4 as int) end as ANTAL_BOERN,
  cast(100+c_nationkey*30 as varchar(4)) as KOM, c_mktsegment as SEGMENT, c_acctbal as ACCTBAL
from customer""",
    "bef_period": """
select P(o_custkey) as PNR, cast(extract(year from o_orderdate) as int) as PERIOD_YEAR,
  case when min(o_orderkey)%3<>0 then substr('UGFE', cast(min(o_orderkey)%4 as int)+1, 1) end as CIVST,
  case when min(o_orderkey)%2=0 then cast(100+(min(o_orderkey)%25)*30 as varchar(4)) end as KOM
from orders group by o_custkey, cast(extract(year from o_orderdate) as int)""",
    "akm": "select P(c_custkey) as PNR, cast(1+c_custkey%12 as varchar(3)) as SOCIO13 from customer where c_custkey%9<>0",
    "uddf": """
select P(c_custkey) as PNR, cast(1000+(c_custkey*13)%8000 as int) as HFAUDD, cast(c_custkey%40 as varchar(3)) as HF_KILDE,
  ADD(date '1985-01-01', (c_custkey*53)%4000) as HF_VFRA, cast(100000+c_custkey%500 as int) as INSTNR
from customer where c_custkey%4<>0""",
    "mfr": """
select P(c_custkey) as CPR_BARN, P(c_custkey - c_custkey%5) as CPR_MODER, cast(2000+(c_custkey*17)%2500 as int) as VAEGT,
  cast(34+c_custkey%8 as int) as SVLNGD, cast(5+c_custkey%6 as int) as APGAR5 from customer where c_custkey%5>=2""",
    "dod": """
select P(c_custkey) as PNR, case when c_custkey%4<>0 then ADD(date '1996-01-01', (c_custkey*31)%2000) end as DODDATO, ICD(c_custkey) as C_AARSAG
from customer where c_custkey%17=0""",
    "dodsaarsag": """
select P(c_custkey) as PNR, ICD(c_custkey) as C_AARSAG, ICD(c_custkey+5) as C_TILSTAND,
  case when c_custkey%4<>0 then ADD(date '1996-01-01', (c_custkey*31)%2000) end as D_DATO from customer where c_custkey%17=0""",
    "vnds": """
select P(o_custkey) as PNR, cast(1 + cast(floor(o_orderkey/20) as int)%2 as int) as HAEND_KODE,
  case when o_orderkey%23<>0 then cast(o_orderdate as date) end as HAEND_DATO from orders""",
    "lpr_adm": """
select P(o_custkey) as PNR, cast(o_orderkey as varchar(12)) as RECNUM, ICD(o_orderkey) as C_ADIAG,
  cast(o_orderdate as date) as D_INDDTO, ADD(cast(o_orderdate as date), o_orderkey%10) as D_UDDTO,
  cast(o_orderkey%10 as int) as V_SENGDAGE
from orders where o_orderdate < timestamp '2000-01-01 00:00:00'""",
    "lpr_diag": """
select cast(l_orderkey as varchar(12)) as RECNUM, ICD(l_partkey) as C_DIAG,
  case when l_linenumber=1 then 'A' when l_linenumber<5 then 'B' else 'H' end as C_DIAGTYPE,
  case when l_linenumber=2 then ICD(l_suppkey) end as C_TILDIAG from lineitem""",
    "lpr_bes": """
select cast(l_orderkey as varchar(12)) as RECNUM, cast(l_shipdate as date) as D_AMBDTO from lineitem""",
    "lpr3_kontakter": """
select P(o_custkey) as CPR, cast(o_orderkey as varchar(12)) as DW_EK_KONTAKT, cast(o_orderdate as date) as dato_start,
  ADD(cast(o_orderdate as date), o_orderkey%10) as dato_slut, ICD(o_orderkey) as aktionsdiagnose,
  case when o_orderpriority='1-URGENT' then 'akut kontakt' else 'planlagt' end as kontakttype
from orders where o_orderdate >= timestamp '2000-01-01 00:00:00'""",
    "lpr3_diagnoser": """
select cast(l_orderkey as varchar(12)) as DW_EK_KONTAKT, ICD(l_partkey) as diagnosekode,
  case when l_linenumber=1 then 'A' else 'B' end as diagnosetype,
  case when l_linenumber=7 then 'Ja' else 'Nej' end as senere_afkraeftet from lineitem""",
    "ind": """
select P(o_custkey) as PNR, cast(extract(year from o_orderdate) as int) as YEAR, round(sum(o_totalprice), 2) as PERINDKIALT_13,
  round(sum(case when o_orderstatus='F' then o_totalprice end), 2) as LOENMV_13
from orders group by o_custkey, cast(extract(year from o_orderdate) as int)""",
    "files": """
select distinct '/data/' || case when o_custkey%2=0 then 'bef' else 'akm' end || '/' || case
  when o_orderkey%5=0 then cast(extract(year from o_orderdate) as varchar(4))
  when o_orderkey%5=1 then cast(extract(year from o_orderdate) as varchar(4)) || lpad(cast(extract(month from o_orderdate) as varchar(2)), 2, '0')
  when o_orderkey%5=2 then cast(extract(year from o_orderdate) as varchar(4)) || 'Q' || cast(extract(quarter from o_orderdate) as varchar(1))
  when o_orderkey%5=3 then cast(extract(year from o_orderdate) as varchar(4)) || lpad(cast(extract(month from o_orderdate) as varchar(2)), 2, '0')
    || lpad(cast(extract(day from o_orderdate) as varchar(2)), 2, '0')
  else 'pop_' || cast(extract(year from o_orderdate) as varchar(4)) || '-' || lpad(cast(extract(month from o_orderdate) as varchar(2)), 2, '0')
  end || '.parquet' as path from orders""",
    "hospital_files": """
select distinct '/data/' || case when o_orderkey%3=0 then 'lpr_adm' when o_orderkey%3=1 then 'lpr_diag' else 'lpr3_kontakter' end || '/'
  || case when o_custkey%2=0 then '' else 'extract_' end || cast(extract(year from o_orderdate) as varchar(4)) || '.parquet' as path from orders
where not (o_orderkey%3=1 and o_orderdate < timestamp '1997-01-01 00:00:00')""",
}
_TABLES = ("customer", "orders", "lineitem")
_HELPERS = {
    "P": "lpad(cast({0} as varchar(12)), 10, '0')",
    "ICD": (
        "(substr('CDEFGIJKMNPQ', cast(({0}) % 12 as int) + 1, 1)"
        " || lpad(cast((cast(floor(({0}) / 12) as int) * 37) % 100 as varchar(3)), 2, '0')"
        " || cast(cast(({0}) % 10 as int) as varchar(2)))"
    ),
}
_ADD = {"spark": "date_add({0}, cast({1} as int))", "duckdb": "({0} + cast({1} as int))"}

VIEWS = tuple(_TEXT)


def _arguments(text: str, start: int) -> tuple[list[str], int]:
    depth, parts, current, i = 1, [], "", start
    while depth:
        ch = text[i]
        depth += (ch == "(") - (ch == ")")
        if ch == "," and depth == 1:
            parts.append(current.strip())
            current = ""
        elif depth:
            current += ch
        i += 1
    return [*parts, current.strip()], i


def expand(text: str, engine: str) -> str:
    """Replace the helper calls by the engine's own expressions, innermost last."""
    templates = {**_HELPERS, "ADD": _ADD[engine]}
    found = re.search(r"\b(P|ICD|ADD)\(", text)
    while found:
        arguments, end = _arguments(text, found.end())
        text = text[: found.start()] + templates[found.group(1)].format(*arguments) + text[end:]
        found = re.search(r"\b(P|ICD|ADD)\(", text)
    return text


def duckdb_view(name: str) -> str:
    return expand(_TEXT[name], "duckdb").strip()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The register view as a DataFrame."""
    text = expand(_TEXT[name], "spark")
    used = [t for t in _TABLES if re.search(rf"\bfrom {t}\b", text)]
    text = re.sub(r"\bfrom (customer|orders|lineitem)\b", r"from {\1}", text)
    return spark.sql(text, **{t: table(spark, sf_dir, t) for t in used})
