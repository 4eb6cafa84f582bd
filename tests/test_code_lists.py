"""Codes joined with a list by prefix, against a loop."""

import pytest

from lifeframe.operators import code_lists

CODES = ["J45", "j451", " J 4519", "E10", "Q900", "C50", None, "", "J4", "X" * 12]
LIST = [("J45", "asthma"), ("J4519", "severe"), ("J", "lungs"), ("j45", "again"), ("Q9", "chromosomes"), ("", "empty"), (None, "null"), ("X" * 12, "long"), ("Y1", "none")]


def clean(code):
    return None if code is None else "".join(code.split()).upper()


@pytest.mark.parametrize("match", ["longest", "all"])
def test_against_a_loop(spark, rows, match):
    df = spark.createDataFrame([(i, c) for i, c in enumerate(CODES * 2)], "n int, diagnosis_code string").repartition(3)
    listed = spark.createDataFrame(LIST, "prefix string, name string")
    expected = []
    for i, code in enumerate(CODES * 2):
        hits = [(p, n) for p, n in LIST if clean(p) and clean(code) and clean(code).startswith(clean(p))]
        if match == "longest" and hits:
            most = max(len(clean(p)) for p, _ in hits)
            hits = [min(h for h in hits if len(clean(h[0])) == most)]
        expected += [(i, n) for _, n in hits]
    assert sorted(rows(code_lists.with_code_list(df, listed, match=match), "n", "name")) == sorted(expected)
    assert code_lists.with_code_list(df, listed.limit(0), match=match).count() == 0


def test_plan_does_not_grow_with_the_list(spark):
    df = spark.createDataFrame([("J45",)], "diagnosis_code string")
    plans = [
        code_lists.with_code_list(df, spark.range(n).selectExpr("'A' || id % 10 as prefix", "id"))._jdf.queryExecution().optimizedPlan().toString().count("\n")
        for n in (10, 5000)
    ]
    assert plans[0] == plans[1]
    with pytest.raises(ValueError, match="unknown"):
        code_lists.with_code_list(df, df, match="some")
