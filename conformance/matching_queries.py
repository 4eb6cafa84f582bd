"""Case-control matching and covariate balance (MA, BA)."""

from __future__ import annotations

from pyspark.sql import functions as F

from conformance.frames import INDEX, INDEX_SQL, mapped, persons, years
from conformance.joins import ELIGIBLE, SIDES, sides
from conformance.registry import block, query
from conformance.views import view
from lifeframe.operators import balance as B
from lifeframe.operators import matching as M
from lifeframe.operators import persons as people
from lifeframe.session import materialize, scratch_path
from lifeframe.sources import sinks

CONFIG = M.MatchingConfig(ratio=2, seed=7, matching_date=INDEX)


@query(
    "ma02_eligible_counts",
    f"""with {SIDES}
select c.pnr, count(k.pnr) as eligible from c left join k on {ELIGIBLE} group by c.pnr""",
)
def _(spark, d):
    return M.eligible_counts(*sides(spark, d))


EVERY_SWITCH = M.MatchingCriteria(
    birth_window_days=700, family_size_tolerance=2, match_parent_age=True, parent_birth_window_days=4000, require_both_parents=True,
    match_education=True, match_geography=True, match_parental_status=True, match_immigrant_background=True,
)


@query(
    "ma02_eligible_counts_every_criterion",
    """with a as (
  select b.PNR as pnr, b.FOED_DAG as birth_date, b.KOEN as gender, b.ANTAL_BOERN as children_count, b.KOM as municipality_code, substr(b.SEGMENT, 1, 1) as immigration_type,
    m.FOED_DAG as mother_birth_date, f.FOED_DAG as father_birth_date, coalesce(mu.HFAUDD, fu.HFAUDD) % 3 as education_level, b.PNR in (select PNR from v_akm where SOCIO13 < '5') as is_case
  from v_bef b left join v_bef m on m.PNR = b.MOR_ID left join v_bef f on f.PNR = b.FAR_ID left join v_uddf mu on mu.PNR = b.MOR_ID left join v_uddf fu on fu.PNR = b.FAR_ID
  where b.MOR_ID is not null and b.FAR_ID is not null)
select c.pnr, count(k.pnr) as eligible from a c left join a k on not k.is_case and abs(datediff('day', c.birth_date, k.birth_date)) <= 700
  and coalesce(c.gender = k.gender, c.gender is null) and coalesce(abs(c.children_count - k.children_count) <= 2, c.children_count is null)
  and coalesce(abs(datediff('day', c.mother_birth_date, k.mother_birth_date)) <= 4000, c.mother_birth_date is null)
  and coalesce(abs(datediff('day', c.father_birth_date, k.father_birth_date)) <= 4000, c.father_birth_date is null)
  and coalesce(c.education_level = k.education_level, c.education_level is null) and coalesce(c.municipality_code = k.municipality_code, c.municipality_code is null)
  and coalesce(c.immigration_type = k.immigration_type, c.immigration_type is null)
where c.is_case group by c.pnr""",
)
def _(spark, d):
    """All criteria at once, on attributes attached by the library."""
    background = view(spark, d, "bef").select(F.col("PNR").alias("pnr"), F.substring("SEGMENT", 1, 1).alias("immigration_type"))
    school = mapped(spark, d, "uddf").select("pnr", (F.col("education_code") % 3).alias("education_code"))
    everyone = people.matching_attributes(persons(spark, d).join(background, "pnr"), school)
    ids = view(spark, d, "akm").filter("SOCIO13 < '5'").select("PNR")
    return M.eligible_counts(*people.case_control_tables(everyone, ids, INDEX), EVERY_SWITCH)


@query("ma04_matching_input", "select PNR as pnr, FOED_DAG as birth_date, KOEN as gender, ANTAL_BOERN as children_count from v_bef where PNR is not null and FOED_DAG is not null")
def _(spark, d):
    return M.prepare(view(spark, d, "bef"), M.MatchingCriteria(), "persons").select("pnr", "birth_date", "gender", "children_count")


def _match(spark, d):
    return M.match(*sides(spark, d), CONFIG)


@query(
    "ma03_match",
    f"""with recursive {SIDES},
p as (select pnr, ('0x' || substr(md5('7:' || pnr), 1, 8))::bigint as point from v_persons),
e as (select c.pnr as case_pnr, k.pnr as control_pnr, dense_rank() over (order by c.pnr) as turn, (((q.point - o.point) % 4294967296) + 4294967296) % 4294967296 as away
  from c join k on {ELIGIBLE} join p o on o.pnr = c.pnr join p q on q.pnr = k.pnr),
g as (
  select 0::bigint as turn, []::varchar[] as used, []::varchar[] as drawn
  union all
  select g.turn + 1, list_concat(g.used, d.drawn), d.drawn from g join lateral (
    select coalesce(list(e.control_pnr order by e.away, e.control_pnr), [])[:2] as drawn from e where e.turn = g.turn + 1 and not list_contains(g.used, e.control_pnr)) d on true
  where g.turn < (select max(turn) from e))
select distinct e.case_pnr, t.control_pnr from (select turn, unnest(drawn) as control_pnr from g) t join e on e.turn = t.turn""",
)
def _(spark, d):
    """The draw itself: case by case, the first two eligible controls clockwise from the case's point that no earlier case took."""
    return _match(spark, d).pairs.select("case_pnr", "control_pnr")


@query(
    "ma03_match_rules",
    f"with {SIDES} select pnr as case_pnr, true as within_ratio, true as eligible, true as not_shared, true as exhausted_or_full from c",
)
def _(spark, d):
    """What holds whichever controls are drawn: a case has no more than the
    ratio, all of them eligible and its own, and fewer only if every eligible control went to an earlier case."""
    cases, controls = (M.prepare(s, CONFIG.criteria, "side") for s in sides(spark, d))
    pairs = materialize(_match(spark, d).pairs.select("case_pnr", "control_pnr"), "ma03-pairs")
    attributes = CONFIG.criteria.columns
    c = cases.select(F.col("pnr").alias("case_pnr"), *(F.col(a).alias(f"c_{a}") for a in attributes))
    k = controls.select(F.col("pnr").alias("control_pnr"), *(F.col(a).alias(f"k_{a}") for a in attributes))
    fits = F.expr(
        "abs(datediff(c_birth_date, k_birth_date)) <= 30 and case_pnr <> control_pnr and coalesce(c_gender = k_gender, c_gender is null)"
        " and coalesce(abs(c_children_count - k_children_count) <= 1, c_children_count is null)"
    )
    users = pairs.groupBy("control_pnr").agg(F.count(F.lit(1)).alias("users"))
    each = pairs.join(c, "case_pnr").join(k, "control_pnr").join(users, "control_pnr")
    have = each.groupBy("case_pnr").agg(
        F.count(F.lit(1)).alias("n"), F.bool_and(fits).alias("eligible"), F.bool_and(F.col("users") == 1).alias("not_shared")
    )
    # The latest taker of each cell's controls; who is free counts as later than any.
    last = (
        controls.select(F.col("pnr").alias("control_pnr"), M.cell_key(CONFIG.criteria).alias("control_cell"))
        .join(pairs, "control_pnr", "left").groupBy("control_cell").agg(F.max(F.coalesce("case_pnr", F.lit("~"))).alias("taker"))
    )
    edges = M.eligible_cells(M.cells(cases, CONFIG.criteria), M.cells(controls, CONFIG.criteria), CONFIG.criteria)
    open_to = edges.select("case_cell", "control_cell").join(last, "control_cell").groupBy("case_cell").agg(F.max("taker").alias("taker"))
    shown = cases.select(F.col("pnr").alias("case_pnr"), M.cell_key(CONFIG.criteria).alias("case_cell"))
    n = F.coalesce("n", F.lit(0))
    return shown.join(have, "case_pnr", "left").join(open_to, "case_cell", "left").select(
        "case_pnr", (n <= CONFIG.ratio).alias("within_ratio"), F.coalesce("eligible", F.lit(True)).alias("eligible"),
        F.coalesce("not_shared", F.lit(True)).alias("not_shared"),
        ((n == CONFIG.ratio) | F.coalesce(F.col("taker") <= F.col("case_pnr"), F.lit(True))).alias("exhausted_or_full"),
    )


# With more wanted than there are controls nothing is left to chance: a control goes to its earliest case.
EVERYONE = M.MatchingConfig(ratio=1_000_000, seed=7, matching_date=INDEX)


@query(
    "ma03_match_everyone",
    f"""with {SIDES},
p as (select min(c.pnr) as case_pnr, k.pnr as control_pnr from c join k on {ELIGIBLE} group by k.pnr)
select p.case_pnr, c.birth_date as case_birth_date, p.control_pnr, k.birth_date as control_birth_date, {INDEX_SQL} as matching_date
from p join c on c.pnr = p.case_pnr join k on k.pnr = p.control_pnr""",
)
def _(spark, d):
    return M.match(*sides(spark, d), EVERYONE).pairs


@query(
    "ma05_matched_rows",
    f"""with {SIDES},
p as (select min(c.pnr) as case_pnr, k.pnr as control_pnr from c join k on {ELIGIBLE} group by k.pnr)
select 'case' as side, pnr, birth_date, gender from c where pnr in (select case_pnr from p)
union all select 'control', pnr, birth_date, gender from k where pnr in (select control_pnr from p)""",
)
def _(spark, d):
    result = M.match(*sides(spark, d), EVERYONE)
    shown = ("pnr", "birth_date", "gender")
    cases = result.matched_cases.select(F.lit("case").alias("side"), *shown)
    return cases.unionByName(result.matched_controls.select(F.lit("control").alias("side"), *shown))


@query(
    "ma07_case_control_tables",
    f"""select v_bef.PNR in (select d.PNR from v_dod d) as is_case, v_bef.PNR as pnr, FOED_DAG as birth_date, KOEN as gender, {years(INDEX_SQL, "FOED_DAG")} as age, round(i.amount, 2) as income
from v_bef left join (select pnr, amount from v_incomes where income_type = 'total_personal' and year = 2000) i on i.pnr = v_bef.PNR""",
)
def _(spark, d):
    from conformance.frames import incomes

    money = incomes(spark, d).filter("income_type = 'total_personal' and year = 2000")
    cases, controls = people.case_control_tables(persons(spark, d), mapped(spark, d, "dod").select("pnr"), INDEX, money)
    both = cases.withColumn("is_case", F.lit(True)).unionByName(controls.withColumn("is_case", F.lit(False)))
    return both.select("is_case", "pnr", "birth_date", "gender", "age", F.round("income", 2).alias("income"))


def groups(spark, d):
    """Persons with a death record against the others, with a number, a text and a flag column."""
    bef = view(spark, d, "bef").select(
        F.col("PNR").alias("pnr"), F.col("ANTAL_BOERN").alias("children"), F.col("ACCTBAL").alias("account"),
        F.col("SEGMENT").alias("segment"), F.col("KOEN").alias("gender"), (F.col("ACCTBAL") > 0).alias("solvent"),
    )
    dead = view(spark, d, "dod").select(F.col("PNR").alias("pnr"))
    return bef.join(dead, "pnr", "left_semi"), bef.join(dead, "pnr", "left_anti")


block(
    "groups",
    """select PNR as pnr, ANTAL_BOERN as children, ACCTBAL as account, SEGMENT as segment, KOEN as gender, ACCTBAL > 0 as solvent,
  PNR in (select PNR from v_dod) as is_case from v_bef""",
)


def _numeric(column: str) -> str:
    return f"""select '{column}' as name, false as categorical, avg({column}) filter (where is_case) as m1, avg({column}) filter (where not is_case) as m0,
  coalesce(stddev_samp({column}) filter (where is_case), 0) as s1, coalesce(stddev_samp({column}) filter (where not is_case), 0) as s0 from v_groups"""


def _share(name: str, hit: str) -> str:
    return f"""select {name} as name, true as categorical, m1, m0, sqrt(m1*(1-m1)) as s1, sqrt(m0*(1-m0)) as s0 from (
  select avg(case when {hit} then 1.0::double else 0 end) filter (where is_case) as m1, avg(case when {hit} then 1.0::double else 0 end) filter (where not is_case) as m0
  from v_groups)"""


def _top(column: str) -> str:
    top = f"(select {column} from v_groups where {column} is not null group by {column} order by count(*) desc, {column} limit 1)"
    return _share(f"'{column}_' || {top}", f"{column} = {top}")


block("numeric_metrics", f"{_numeric('children')} union all {_numeric('account')}")
block("text_metrics", f"{_top('segment')} union all {_top('gender')}")
block("flag_metrics", _share("'solvent_TRUE'", "solvent"))
block("metrics", "select * from v_numeric_metrics union all select * from v_text_metrics union all select * from v_flag_metrics")
block("smd", "select case when s1 = 0 and s0 = 0 then 0 else (m1 - m0) / sqrt((s1*s1 + s0*s0) / 2) end as smd from v_metrics")
FINISHED = """select name, categorical, round(m1, 6) as case_mean, round(m0, 6) as control_mean, round(s1, 6) as case_sd, round(s0, 6) as control_sd,
  round(case when s1 = 0 and s0 = 0 then 0 else (m1 - m0) / sqrt((s1*s1 + s0*s0) / 2) end, 6) as smd from """


def _rounded(df):
    return df.withColumns({c: F.round(c, 6) for c in ("case_mean", "control_mean", "case_sd", "control_sd", "smd")})


@query("ba01_numeric_balance", FINISHED + "v_numeric_metrics")
def _(spark, d):
    return _rounded(B.numeric_balance(*groups(spark, d), ["children", "account"]))


@query("ba02_categorical_balance", FINISHED + "v_text_metrics")
def _(spark, d):
    return _rounded(B.categorical_balance(*groups(spark, d), ["segment", "gender"]))


@query("ba03_boolean_balance", FINISHED + "v_flag_metrics")
def _(spark, d):
    return _rounded(B.boolean_balance(*groups(spark, d), ["solvent"]))


def everyone(spark, d):
    """Both groups in one frame, with a flag."""
    bef = view(spark, d, "bef").select(
        F.col("PNR").alias("pnr"), F.col("ANTAL_BOERN").alias("children"), F.col("ACCTBAL").alias("account"),
        F.col("SEGMENT").alias("segment"), F.col("KOEN").alias("gender"), (F.col("ACCTBAL") > 0).alias("solvent"),
    )
    dead = view(spark, d, "dod").select(F.col("PNR").alias("pnr")).distinct().withColumn("is_case", F.lit(True))
    return bef.join(dead, "pnr", "left")


@query("ba04_balance", FINISHED + "v_metrics")
def _(spark, d):
    is_case = F.coalesce("is_case", F.lit(False))
    return _rounded(B.balance_of(everyone(spark, d), {"dead": (is_case, ~is_case)}, ("pnr", "is_case")).drop("comparison"))


def _numbers_of(comparison: str, case: str, control: str) -> str:
    cells = " union all ".join(
        f"""select '{comparison}' as comparison, '{c}' as name, avg({c}) filter (where {case}) as m1, avg({c}) filter (where {control}) as m0,
  coalesce(stddev_samp({c}) filter (where {case}), 0) as s1, coalesce(stddev_samp({c}) filter (where {control}), 0) as s0 from v_groups""" for c in ("children", "account")
    )
    return cells


@query(
    "ba04_several_comparisons",
    f"""select comparison, name, round(m1, 6) as case_mean, round(m0, 6) as control_mean, round(case when s1 = 0 and s0 = 0 then 0 else (m1 - m0) / sqrt((s1*s1 + s0*s0) / 2) end, 6) as smd
from ({_numbers_of("dead", "is_case", "not is_case")} union all {_numbers_of("dead women", "is_case and gender = '2'", "not is_case and gender = '2'")}
union all {_numbers_of("women", "gender = '2'", "true")})""",
)
def _(spark, d):
    """Comparisons that share rows, from one pass: the dead and the others, the same among women, and women with all."""
    is_case, women = F.coalesce("is_case", F.lit(False)), F.col("gender") == "2"
    sides = {"dead": (is_case, ~is_case), "dead women": (is_case & women, ~is_case & women), "women": (women, F.lit(True))}
    found = B.balance_of(everyone(spark, d), sides, ("pnr", "is_case", "segment", "gender", "solvent"))
    return _rounded(found).select("comparison", "name", "case_mean", "control_mean", "smd")


@query(
    "ba05_balance_summary",
    f"""select count(*) as total_covariates, count(*) filter (where abs(smd) > 0.1) as imbalanced_covariates, round(max(abs(smd)), 6) as max_smd, round(avg(abs(smd)), 6) as mean_abs_smd
from v_smd""",
)
def _(spark, d):
    df = B.balance_summary(B.balance(*groups(spark, d)))
    return df.withColumns({c: F.round(c, 6) for c in ("max_smd", "mean_abs_smd")})


@query(
    "sc14_balance_csv",
    f"""select name as "Covariate", case when categorical then 'Categorical' else 'Continuous' end as "Type", printf('%.6f', case_mean) as "Case Mean",
  printf('%.6f', control_mean) as "Control Mean", printf('%.6f', case_sd) as "Case SD", printf('%.6f', control_sd) as "Control SD", printf('%.6f', smd) as "Std Diff"
from ({FINISHED} v_metrics)
union all select 'Total covariates', cast(count(*) as varchar), null, null, null, null, null from v_metrics
union all select 'Imbalanced covariates (std diff > 0.1)', cast(count(*) filter (where abs(smd) > 0.1) as varchar), null, null, null, null, null from ({FINISHED} v_metrics)
union all select 'Maximum standardized difference', printf('%.6f', max(abs(smd))), null, null, null, null, null from v_smd
union all select 'Mean absolute standardized difference', printf('%.6f', avg(abs(smd))), null, null, null, null, null from v_smd""",
)
def _(spark, d):
    path = scratch_path(spark, "balance")
    sinks.write_balance_csv(B.balance(*groups(spark, d)), path)
    return spark.read.option("header", "true").csv(path)
