"""Null and edge rules on small frames."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from lifeframe.functions import icd, persons as fn, predicates as P
from lifeframe.operators import balance, chronic, cohort, diagnoses, families, income, longitudinal
from lifeframe.operators import persons as people
from lifeframe.functions import periods

D = dt.date


def one(spark, column):
    return spark.range(1).select(column).first()[0]


@pytest.mark.parametrize(
    ("birth", "day", "age"),
    [
        (D(2000, 2, 29), D(2021, 2, 28), 20), (D(2000, 2, 29), D(2021, 3, 1), 21), (D(2000, 6, 15), D(2020, 6, 14), 19),
        (D(2000, 6, 15), D(2020, 6, 15), 20), (D(2020, 1, 1), D(2020, 1, 1), 0), (D(2020, 1, 2), D(2020, 1, 1), None), (None, D(2020, 1, 1), None),
    ],
)
def test_age(spark, birth, day, age):
    none = F.lit(None).cast("date")
    assert one(spark, fn.age_at(F.lit(birth).cast("date"), none, F.lit(day))) == age


def test_no_age_after_death(spark):
    assert one(spark, fn.age_at(F.lit(D(2000, 1, 1)), F.lit(D(2010, 1, 1)), F.lit(D(2010, 1, 2)))) is None
    assert one(spark, fn.age_at(F.lit(D(2000, 1, 1)), F.lit(D(2010, 1, 1)), F.lit(D(2010, 1, 1)))) == 10


@pytest.mark.parametrize(("code", "rural"), [("399", True), ("400", False), ("600", False), ("601", True), ("x", True), (None, False)])
def test_rural(spark, code, rural):
    assert one(spark, fn.is_rural(F.lit(code).cast("string"))) is rural


def test_strict_nulls(spark):
    true, null = F.lit(True), F.lit(None).cast("boolean")
    assert one(spark, P.any_of(true, null)) is True
    assert one(spark, P.any_of(true, null, strict_nulls=True)) is None
    assert one(spark, P.all_of(F.lit(False), null)) is False
    assert one(spark, P.all_of(F.lit(False), null, strict_nulls=True)) is None
    unknown = F.lit(None).cast("string")
    assert one(spark, P.not_in(unknown, ["a"])) is None
    assert one(spark, P.not_in(unknown, ["a"], strict_nulls=True)) is True
    assert one(spark, ~P.contains(unknown, "a", strict_nulls=True)) is True


def test_no_bounds_keep_null_dates(spark):
    df = spark.createDataFrame([(D(2020, 1, 1),), (None,)], "d date")
    assert df.filter(P.date_in_range(F.col("d"))).count() == 2
    assert df.filter(P.date_in_range(F.col("d"), end=D(2021, 1, 1))).count() == 1


def test_unknown_column_is_an_error(spark):
    with pytest.raises(ValueError, match="unknown"):
        P.drop_missing(spark.range(1), ["nope"])


@pytest.mark.parametrize(
    ("code", "expected"),
    [
        ("C", (1, False, 3)), ("C50", (1, False, 3)), ("D6", None), ("d610", (1, False, 2)), (" E10 ", (3, False, 2)),
        ("N184", (9, False, 3)), ("N183", (9, False, 2)), ("N18", (9, False, 2)), ("N195", (9, False, 3)), ("N18X", (9, False, 2)),
        ("Q792", (7, True, 2)), ("Q795", (8, True, 2)), ("Q790", (6, True, 2)), ("E730", None), ("G711", (4, False, 3)),
        ("P945", (4, True, 2)), ("P940", (4, True, 2)), ("D619", (1, False, 2)), ("D63", None), ("D85", None), ("J45", (6, False, 1)),
        ("", None), (None, None), ("Q999", (10, True, 3)), ("M059", (8, False, 2)), ("N17", None), ("I50", (5, False, 3)),
    ],
)
def test_categories(spark, code, expected):
    df = spark.createDataFrame([(code,)], "diagnosis_code string")
    row = chronic.categorize(df).first()
    assert (None if row.category is None else (row.category, row.congenital, row.severity)) == expected


def test_chronic_results(spark):
    rows = [
        ("1", "E10", "Primary", D(2010, 5, 1)), ("1", "E10", "Primary", D(2010, 5, 1)), ("1", "Q900", "Other", D(2009, 1, 1)),
        ("1", "J00", "Other", D(2001, 1, 1)), ("2", "J00", "Other", None), ("3", "C50", "Other", None),
    ]
    df = spark.createDataFrame(rows, "pnr string, diagnosis_code string, diagnosis_type string, diagnosis_date date")
    found = {r.pnr: r for r in chronic.chronic_results(df).collect()}
    one_ = found["1"]
    assert (one_.has_scd, one_.first_scd_date, one_.scd_categories, one_.max_severity, one_.has_congenital) == (True, D(2009, 1, 1), [3, 10], 3, True)
    assert (one_.hospitalization_count, one_.category_count, one_.first_diagnosis_date) == (4, 2, D(2001, 1, 1))
    assert (found["2"].has_scd, found["2"].max_severity, found["2"].scd_categories) == (False, 0, [])
    assert (found["3"].has_scd, found["3"].first_scd_date) == (True, None)
    births = spark.createDataFrame([("1", D(2009, 1, 1))], "pnr string, birth_date date")
    config = chronic.ChronicConfig(min_age=1, include_congenital=False, start=D(2010, 1, 1))
    limited = {r.pnr: r for r in chronic.chronic_results(df, config, births).collect()}
    assert limited["1"].scd_categories == [3]
    assert limited["3"].has_scd
    own = chronic.ChronicConfig(severity="row")
    assert chronic.chronic_results(df.withColumn("severity", F.lit(1)), own).filter("pnr = '1'").first().max_severity == 1


def test_severity_scores(spark):
    assert [one(spark, chronic.category_severity(F.lit(n))) for n in (1, 2, 3)] == [1, 2, 3]
    assert [one(spark, chronic.category_severity_coarse(F.lit(n))) for n in (1, 2)] == [1, 3]
    assert [one(spark, chronic.hospitalization_severity(F.lit(n))) for n in (1, 2, 4, 5)] == [1, 2, 2, 3]
    assert [one(spark, chronic.onset_severity(F.lit(n).cast("int"))) for n in (0, 1, 2, 9, 10, None)] == [3, 3, 2, 2, 1, None]
    assert one(spark, chronic.combined_severity(F.lit(1), F.lit(None).cast("int"), F.lit(2))) == 2


def test_code_helpers(spark):
    assert one(spark, icd.clean_code(F.lit(" e 10 "))) == "E10"
    assert [one(spark, icd.is_valid_code(F.lit(c).cast("string"))) for c in ("E10", "E1", "110", None)] == [True, False, False, False]
    assert one(spark, icd.chapters(F.lit("H10"))) == ["VII", "VIII"]
    assert one(spark, icd.chapters(F.lit("D1"))) == []
    assert [one(spark, icd.chapter_category(F.lit(c))) for c in ("C1", "D48", "D49", "D50", "D89", "D90", "M350", "M30", "M31", "Z00", "D")] == [
        1, 1, 0, 2, 2, 0, 2, 2, 8, 0, 0,
    ]
    assert one(spark, icd.has_any_prefix(F.lit("e10.1"), ["E 10", "J"])) is True


def test_residency(spark):
    people_rows = [("1", None), ("2", None), ("3", D(2000, 1, 1)), ("4", None), ("5", None)]
    persons = spark.createDataFrame(people_rows, "pnr string, death_date date")
    events = spark.createDataFrame(
        [("1", D(2001, 1, 1), True), ("2", D(2001, 1, 1), True), ("2", D(2002, 1, 1), False),
         ("4", D(2001, 1, 1), False), ("4", D(2001, 1, 1), True), ("5", D(2009, 1, 1), True)],
        "pnr string, event_date date, is_emigration boolean",
    )
    found = {r.pnr: r.resident for r in people.with_residency(persons, events, D(2005, 1, 1)).collect()}
    assert found == {"1": False, "2": True, "3": False, "4": False, "5": True}


def test_merge_keeps_first_known(spark, rows):
    data = [("1234", 2020, "M", None), ("1234", 2021, "M", "G"), ("5678", 2021, "F", None)]
    df = spark.createDataFrame(data, "pnr string, y int, gender string, marital_status string")
    df = df.withColumn("period", periods.year_period(F.col("y"))).drop("y")
    assert rows(longitudinal.merge_periods(df), "pnr", "gender", "marital_status") == [("1234", "M", "G"), ("5678", "F", None)]


def test_merge_orders_periods_by_date_not_kind(spark, rows):
    data = [("1", "202005", "may"), ("1", "2021", "later"), ("1", "2020Q1", "first")]
    df = spark.createDataFrame(data, "pnr string, t string, v string").withColumn("period", periods.lenient_period(F.col("t"))).drop("t")
    assert rows(longitudinal.merge_periods(df), "v") == [("first",)]
    assert rows(longitudinal.merge_periods(df, prefer="latest"), "v") == [("later",)]


def test_register_priority(spark, rows):
    a = spark.createDataFrame([("1", None, "x")], "pnr string, u string, v string")
    b = spark.createDataFrame([("1", "b", "y"), ("2", "c", None)], "pnr string, u string, v string")
    assert rows(longitudinal.merge_registers({"akm": b, "bef": a}), "pnr", "u", "v") == [("1", "b", "x"), ("2", "c", None)]


def test_contact_delivered_twice(spark, rows):
    contacts = spark.createDataFrame([("1", "k", D(2020, 1, 1)), ("1", "k", D(2020, 2, 1))], "CPR string, DW_EK_KONTAKT string, dato_start date")
    diag = spark.createDataFrame([("k", "E10", "A"), ("z", "E11", "A")], "DW_EK_KONTAKT string, diagnosekode string, diagnosetype string")
    assert rows(diagnoses.from_contacts(contacts, diag)) == [("1", "E10", "Primary", D(2020, 2, 1))]
    aliased = contacts.withColumnsRenamed({"CPR": "cpr", "DW_EK_KONTAKT": "kontakt_id", "dato_start": "starttidspunkt"})
    assert rows(diagnoses.from_contacts(aliased, diag)) == [("1", "E10", "Primary", D(2020, 2, 1))]


def test_undated_admissions_pass_the_range(spark, rows):
    adm = spark.createDataFrame([("1", "r", "E10", None), ("2", None, None, D(2020, 1, 1)), (None, "q", "J45", None)],
                                "PNR string, RECNUM string, C_ADIAG string, D_INDDTO date")
    diag = spark.createDataFrame([("r", "E10", "A"), ("r", "J45", "B"), (None, "C50", "A")], "RECNUM string, C_DIAG string, C_DIAGTYPE string")
    config = diagnoses.HospitalConfig(start=D(2021, 1, 1))
    assert rows(diagnoses.from_admissions(adm, diag, config)) == [("1", "E10", "Primary", None), ("1", "J45", "Secondary", None)]
    with pytest.raises(ValueError, match="no hospital generation"):
        diagnoses.hospital_diagnoses(adm, diag, config=diagnoses.HospitalConfig.lpr3_only())


def test_family_rules(spark, rows):
    data = [
        ("m", "F", D(1970, 1, 1), None, None, "f1"), ("c1", "M", D(2000, 5, 1), "m", None, "f1"), ("c2", "M", None, "m", None, "f1"),
        ("c3", "F", D(2000, 5, 1), "m", "ghost", "f1"), ("x", "M", D(1980, 1, 1), None, None, None),
    ]
    persons = spark.createDataFrame(data, "pnr string, gender string, birth_date date, mother_pnr string, father_pnr string, family_id string")
    persons = persons.withColumn("death_date", F.lit(None).cast("date"))
    members = families.family_members(persons)
    assert rows(members, "family_id", "role", "pnr") == [("f1", "child", "c1"), ("f1", "child", "c2"), ("f1", "child", "c3"), ("f1", "mother", "m")]
    assert families.build_families(members, two_parent_only=True).count() == 0
    snap = families.snapshot(members, D(2005, 1, 1)).first()
    assert (snap.family_type, snap.children) == ("SingleMother", 2)
    order = rows(families.siblings(members.filter("role = 'child'")), "pnr", "birth_order", "years_since_previous")
    by_child = {p: (o, g) for p, o, g in order}
    assert by_child["c2"] == (1, None)
    assert sorted(by_child[c] for c in ("c1", "c3")) == [(2, None), (3, 0.0)] if by_child["c1"][1] is None or by_child["c3"][1] is None else False
    kept = families.study_persons(persons, D(2005, 1, 1), resident_only=False, max_age=10)
    assert {r.pnr for r in kept.collect()} == {"c1", "c2", "c3"}


def test_snapshot_validity_and_comorbidity(spark):
    members = spark.createDataFrame(
        [("f", "mother", "m", D(1970, 1, 1), None), ("f", "child", "c", D(2000, 1, 1), None), ("g", "child", "d", D(2000, 1, 1), None)],
        "family_id string, role string, pnr string, birth_date date, death_date date",
    )
    health = spark.createDataFrame([("m", None, D(2005, 1, 1)), ("c", D(2005, 1, 1), D(2005, 1, 1))],
                                   "pnr string, first_scd_date date, first_diagnosis_date date")
    known = spark.createDataFrame([("f", D(2000, 1, 1), None), ("g", D(2006, 1, 1), None)], "family_id string, valid_from date, valid_to date")
    on_day = families.snapshot(members, D(2005, 1, 1), health=health, families=known).collect()
    assert [(r.family_id, r.has_scd_child, r.has_parental_comorbidity) for r in on_day] == [("f", True, False)]
    after = families.snapshot(members, D(2005, 1, 2), health=health, families=known).first()
    assert after.has_parental_comorbidity


def test_income_rules(spark, rows):
    data = [("1", 2000, "t", 10.0), ("1", 2003, "t", 40.0), ("2", 2000, "t", 5.0), ("2", 2000, "t", 7.0)]
    incomes = income.series(spark.createDataFrame(data, "pnr string, year int, income_type string, amount double"))
    filled = rows(income.interpolate(incomes).filter("pnr = '1'"), "year", "amount", "interpolated")
    assert [(y, round(a, 6), i) for y, a, i in filled] == [(2000, 10.0, False), (2001, 20.0, True), (2002, 30.0, True), (2003, 40.0, False)]
    found = {r.pnr: r for r in income.trajectories(incomes).collect()}
    assert found["1"].trend == pytest.approx(10.0)
    assert (found["2"].trend, found["2"].mean_income) == (None, 7.0)
    assert rows(income.pre_post_difference(incomes, 2003, 3, 0), "pnr", "difference") == [("1", 30.0), ("2", None)]
    parents = spark.createDataFrame([("f", "1", "2"), ("g", None, "9")], "family_id string, mother_pnr string, father_pnr string")
    family = income.family_series(parents, incomes, "t")
    assert rows(family, "family_id", "year", "combined_amount") == [("f", 2000, 17.0), ("f", 2001, 0.0), ("f", 2002, 0.0), ("f", 2003, 40.0)]
    assert rows(income.income_gap(family), "year", "gap") == [(2000, -3.0)]
    assert rows(income.income_gap_trend(family), "gap_trend") == [(None,)]
    shares = {r.year: r.primary_share for r in income.primary_earner_share(family).collect()}
    assert shares[2000] == pytest.approx(10 / 17) and shares[2001] is None and shares[2003] == 1.0


def test_balance_rules(spark):
    cases = spark.createDataFrame([("1", 5, 1.0, "b")] * 5, "pnr string, same int, few double, tie string")
    controls = spark.createDataFrame(
        [("2", 5, float("nan"), "a")] * 5 + [("3", 5, None, None)], "pnr string, same int, few double, tie string"
    )
    found = {r.name: r for r in balance.balance(cases, controls).collect()}
    assert set(found) == {"same", "tie_a"}
    assert found["same"].smd == 0.0
    assert (found["tie_a"].case_mean, found["tie_a"].control_mean, found["tie_a"].smd) == (0.0, 1.0, 0.0)
    with pytest.raises(ValueError, match="no cases"):
        balance.balance(cases.limit(0), controls)


def test_links(spark, rows):
    links = spark.createDataFrame([("a", "x"), ("b", "x")], "l string, r string")
    more = cohort.add_links(links, spark.createDataFrame([("a", "x"), ("a", "y")], "l string, r string"))
    assert rows(more) == [("a", "x"), ("a", "y"), ("b", "x")]
    assert rows(cohort.remove_links(more, links)) == [("a", "y")]


def test_unreachable_register(spark):
    diag = spark.createDataFrame([("r", "E10")], "RECNUM string, C_DIAG string")
    with pytest.raises(ValueError, match="lpr_adm"):
        cohort.restrict_registers({"lpr_diag": diag}, spark.createDataFrame([("1",)], "pnr string"))


def test_one_family_id_holding_everybody(spark):
    """A placeholder family id with very many children is numbered like any other."""
    n = 2000
    children = spark.range(n).select(
        F.lit("0").alias("family_id"), F.format_string("%05d", "id").alias("pnr"),
        F.when(F.col("id") % 3 == 0, F.lit(D(2000, 1, 1))).otherwise(F.date_add(F.lit(D(2000, 1, 1)), (F.col("id") % 900).cast("int"))).alias("birth_date"),
        (F.col("id") == 77).alias("has_scd"),
    )
    found = families.siblings(children).collect()
    assert sorted(r.birth_order for r in found) == list(range(1, n + 1))
    assert {r.siblings for r in found} == {n} and {r.has_sibling_with_scd for r in found} == {True}
    ordered = sorted(found, key=lambda r: r.birth_order)
    for before, after in zip(ordered, ordered[1:]):
        assert before.birth_date <= after.birth_date
        assert after.years_since_previous == pytest.approx((after.birth_date - before.birth_date).days / 365.25)


def test_position_in_group(spark):
    from lifeframe.operators.ranking import position_in_group, spread

    df = spark.range(500).select((F.col("id") % 3).alias("k"), F.col("id").cast("string").alias("v"))
    found = position_in_group(df, ["k"], [spread(F.col("v"), 1)], [F.col("v")]).collect()
    for key in range(3):
        positions = sorted(r.position for r in found if r.k == key)
        assert positions == list(range(1, len(positions) + 1))


def test_study(spark):
    from lifeframe.operators.matching import MatchingConfig
    from lifeframe.plans import study

    bef = spark.range(400).select(
        F.format_string("%04d", "id").alias("PNR"), F.when(F.col("id") % 2 == 0, "1").otherwise("2").alias("KOEN"),
        F.date_add(F.lit(D(2000, 1, 1)), (F.col("id") % 20).cast("int")).alias("FOED_DAG"), F.lit(None).cast("string").alias("MOR_ID"),
        F.lit(None).cast("string").alias("FAR_ID"), F.lit("f").alias("FAMILIE_ID"), F.lit(1).alias("ANTAL_BOERN"), F.lit("101").alias("KOM"),
    )
    adm = spark.range(40).select(
        F.format_string("%04d", F.col("id") * 10).alias("PNR"), F.col("id").cast("string").alias("RECNUM"), F.lit("E10").alias("C_ADIAG"),
        F.lit(D(2004, 1, 1)).alias("D_INDDTO"),
    )
    diag = spark.createDataFrame([], "RECNUM string, C_DIAG string, C_DIAGTYPE string")
    built = study.population({"bef": bef, "lpr_adm": adm, "lpr_diag": diag}, D(2005, 1, 1))
    cases = built.chronic.filter("has_scd").select("pnr")
    done = study.matched_study(built.persons, cases, D(2005, 1, 1), MatchingConfig(ratio=3, seed=1))
    assert done.pairs.count() == 120
    assert done.cases.count() == 40 and done.controls.count() == 120
    assert {r.name for r in done.balance.collect()} >= {"gender_1", "age", "children_count", "municipality_code_101"}
    assert done.summary.first().total_covariates == done.balance.count()
