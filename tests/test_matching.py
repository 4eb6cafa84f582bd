"""The parallel matching against the sequential greedy rule, replayed in plain Python."""

import datetime as dt
import hashlib
import random

import pytest

from lifeframe.operators import matching as M

START = dt.date(2000, 1, 1)
SCHEMA = "pnr string, birth_date date, gender string, children_count int"


def people(rng, prefix, n, days):
    return [
        (f"{prefix}{i:05d}", START + dt.timedelta(rng.randrange(days)), rng.choice(["M", "F", None]), rng.choice([1, 2, 3, None]))
        for i in range(n)
    ]


def eligible(case, control, c):
    if case[0] == control[0] or abs((case[1] - control[1]).days) > c.birth_window_days:
        return False
    if c.same_gender and case[2] is not None and case[2] != control[2]:
        return False
    if c.match_family_size and case[3] is not None and (control[3] is None or abs(case[3] - control[3]) > c.family_size_tolerance):
        return False
    return True


def replay(cases, controls, pairs, config):
    """In case order every case must hold min(ratio, eligible controls not taken by earlier cases) of exactly those."""
    held = {}
    for case, control in pairs:
        held.setdefault(case, set()).add(control)
    taken = set()
    for case in sorted(cases):
        open_ = {k[0] for k in controls if eligible(case, k, config.criteria)} - taken
        got = held.get(case[0], set())
        assert got <= open_, case
        assert len(got) == min(config.ratio, len(open_)), case
        taken |= got
    assert sum(len(v) for v in held.values()) == len(pairs) == len(taken)


@pytest.mark.parametrize(
    ("n_cases", "n_controls", "days", "ratio", "seed"),
    [(40, 300, 400, 2, 1), (120, 60, 40, 1, 2), (80, 150, 90, 3, 3)],
)
def test_equals_a_sequential_run(spark, n_cases, n_controls, days, ratio, seed):
    rng = random.Random(seed)
    cases, controls = people(rng, "a", n_cases, days), people(rng, "k", n_controls, days)
    controls += cases[:5]  # persons on both sides never match themselves
    config = M.MatchingConfig(ratio=ratio, seed=seed)
    result = M.match(spark.createDataFrame(cases, SCHEMA), spark.createDataFrame(controls, SCHEMA), config)
    pairs = [(r.case_pnr, r.control_pnr) for r in result.pairs.collect()]
    assert result.rounds < 20
    replay(cases, controls, pairs, config)
    assert {r.pnr for r in result.matched_controls.collect()} == {k for _, k in pairs}
    assert {r.pnr for r in result.matched_cases.collect()} == {c for c, _ in pairs}


def test_result_does_not_depend_on_partitioning(spark):
    rng = random.Random(5)
    cases, controls = people(rng, "a", 30, 60), people(rng, "k", 60, 60)
    config = M.MatchingConfig(ratio=2, seed=9)

    def run(n):
        result = M.match(
            spark.createDataFrame(cases, SCHEMA).repartition(n), spark.createDataFrame(controls[::-1], SCHEMA).repartition(n + 1), config
        )
        return sorted((r.case_pnr, r.control_pnr) for r in result.pairs.collect())

    assert run(1) == run(5)


def test_one_hot_cell(spark):
    """Everybody shares all attributes: one cell holds all rows, and early cases win."""
    cases = [(f"a{i:04d}", START, "M", 1) for i in range(60)]
    controls = [(f"k{i:04d}", START, "M", 1) for i in range(50)]
    config = M.MatchingConfig(ratio=1, seed=4)
    result = M.match(spark.createDataFrame(cases, SCHEMA), spark.createDataFrame(controls, SCHEMA), config)
    matched = sorted(r.case_pnr for r in result.pairs.collect())
    assert matched == [c[0] for c in cases[:50]]


def test_errors(spark):
    cases = spark.createDataFrame([("a", START, "M", 1)], SCHEMA)
    far = spark.createDataFrame([("k", START + dt.timedelta(31), "M", 1)], SCHEMA)
    with pytest.raises(ValueError, match="no case"):
        M.match(cases, far)
    with pytest.raises(ValueError, match="gender"):
        M.match(cases.drop("gender"), far)


def test_switched_on_criteria(spark):
    schema = SCHEMA + ", municipality_code string, mother_birth_date date, father_birth_date date, mother_pnr string, father_pnr string"
    old, older = dt.date(1970, 1, 1), dt.date(1971, 6, 1)
    cases = spark.createDataFrame([("a", START, "M", 1, "101", old, None, "m", "f")], schema)
    controls = spark.createDataFrame(
        [
            ("k1", START, "M", 1, "102", old, None, "m1", "f1"), ("k2", START, "M", 1, "101", older, None, "m2", "f2"),
            ("k3", START, "M", 1, "101", old, old, "m3", None), ("k4", START, "M", 1, "101", old, old, "m4", "f4"),
        ],
        schema,
    )
    criteria = M.MatchingCriteria(match_geography=True, match_parent_age=True, require_both_parents=True)
    result = M.match(cases, controls, M.MatchingConfig(criteria, ratio=5))
    assert [r.control_pnr for r in result.pairs.collect()] == ["k4"]
    counted = M.eligible_counts(cases, controls, criteria).collect()
    assert [(r.pnr, r.eligible) for r in counted] == [("a", 1)]


def test_draws_are_spread(spark):
    """Over many seeds each of six equal controls is drawn about equally often."""
    cases = spark.createDataFrame([(f"a{i:03d}", START + dt.timedelta(100 * i), "M", 1) for i in range(150)], SCHEMA)
    controls = spark.createDataFrame(
        [(f"k{i:03d}-{j}", START + dt.timedelta(100 * i), "M", 1) for i in range(150) for j in range(6)], SCHEMA
    )
    drawn = [r.control_pnr[-1] for r in M.match(cases, controls, M.MatchingConfig(seed=11)).pairs.collect()]
    counts = [drawn.count(str(j)) for j in range(6)]
    assert sum(counts) == 150 and min(counts) >= 10 and max(counts) <= 42


@pytest.mark.parametrize("seed", range(4))
@pytest.mark.parametrize("sized", [True, False])
def test_counts_equal_all_pairs(spark, seed, sized):
    """Running sums along the days of birth against a loop over all pairs, unknown values and zero windows included."""
    rng = random.Random(seed)
    cases, controls = people(rng, "a", 60, 50), people(rng, "k", 150, 70)
    controls += cases[:7]
    criteria = M.MatchingCriteria(birth_window_days=[0, 3, 30, 400][seed], match_family_size=sized, family_size_tolerance=seed % 3, same_gender=seed != 1)
    got = M.eligible_counts(spark.createDataFrame(cases, SCHEMA), spark.createDataFrame(controls, SCHEMA), criteria).collect()
    assert {(r.pnr, r.eligible) for r in got} == {(c[0], sum(eligible(c, k, criteria) for k in controls)) for c in cases}
    assert len(got) == len(cases)


def test_counting_joins_no_pairs_of_cells(spark):
    """All in one group and every day of birth taken: the rows of each step stay those of the cells."""
    df = spark.range(4000).selectExpr(
        "concat('p', id) as pnr", "date_add(date '1990-01-01', cast(id as int)) as birth_date", "'M' as gender", "1 as children_count"
    )
    criteria = M.MatchingCriteria(birth_window_days=2000)
    cells = M.cells(df, criteria)
    asked = M.cell_totals(cells, cells, criteria)
    assert max(r["_total"] for r in asked.collect()) == 4000
    plan = asked._jdf.queryExecution().executedPlan()
    waiting, most = [plan], 0
    while waiting:
        node = waiting.pop()
        while (kind := node.getClass().getSimpleName()) == "AdaptiveSparkPlanExec" or kind.endswith("QueryStageExec"):
            node = node.executedPlan() if kind == "AdaptiveSparkPlanExec" else node.plan()
        if node.metrics().contains("numOutputRows"):
            most = max(most, node.metrics().apply("numOutputRows").value())
        children = node.children()
        waiting += [children.apply(i) for i in range(children.size())]
    assert 4000 <= most <= 4000 * 6


def test_leading_window_is_the_most_selective(spark):
    schema = SCHEMA + ", mother_birth_date date, father_birth_date date"
    rng = random.Random(1)
    rows = [(f"p{i}", START + dt.timedelta(rng.randrange(10)), "M", 1, START - dt.timedelta(rng.randrange(20_000)), None) for i in range(200)]
    criteria = M.MatchingCriteria(match_parent_age=True, parent_birth_window_days=30, match_family_size=False)
    cells = M.cells(spark.createDataFrame(rows, schema), criteria)
    assert M.leading_window(cells, cells, criteria) == "mother_birth_date"


def _watched(monkeypatch):
    """All frames that a match writes, by name."""
    written, real = [], M.materialize

    def watch(df, name):
        out = real(df, name)
        written.append((name, df, out))
        return out

    monkeypatch.setattr(M, "materialize", watch)
    return written


def test_wanting_all_costs_a_look_per_control(spark, monkeypatch):
    """A case that takes all that is left ends the search in its cells, except for itself."""
    rng = random.Random(8)
    cases, controls = people(rng, "a", 150, 40), people(rng, "k", 300, 40)
    controls += cases[:40]
    written = _watched(monkeypatch)
    config = M.MatchingConfig(ratio=1_000_000, seed=3)
    result = M.match(spark.createDataFrame(cases, SCHEMA), spark.createDataFrame(controls, SCHEMA), config)
    replay(cases, controls, [(r.case_pnr, r.control_pnr) for r in result.pairs.collect()], config)
    assert sum(out.count() for name, _, out in written if name == "match-draws") < 10 * len(controls)
    assert max(out.count() for name, _, out in written if name == "match-edges") < 10 * len(controls)


@pytest.mark.parametrize("few", [0, 1000])
def test_cases_in_order_with_any_ratio(spark, monkeypatch, few):
    """Some cases take all that they can get, others don't; persons on both sides."""
    monkeypatch.setattr(M, "_FEW", few)
    rng = random.Random(12)
    cases, controls = people(rng, "a", 60, 200), people(rng, "k", 90, 200)
    controls += cases[:30]
    config = M.MatchingConfig(ratio=4, seed=2)
    result = M.match(spark.createDataFrame(cases, SCHEMA), spark.createDataFrame(controls, SCHEMA), config)
    replay(cases, controls, [(r.case_pnr, r.control_pnr) for r in result.pairs.collect()], config)


def test_nothing_is_broadcast(spark, monkeypatch):
    monkeypatch.setattr(M, "_FEW", -1, raising=False)
    rng = random.Random(4)
    cases, controls = people(rng, "a", 40, 60), people(rng, "k", 120, 60)
    written = _watched(monkeypatch)
    result = M.match(spark.createDataFrame(cases, SCHEMA), spark.createDataFrame(controls, SCHEMA), M.MatchingConfig(ratio=2, seed=1))
    frames = [df for _, df, _ in written] + [result.pairs, result.matched_cases, result.matched_controls]
    assert [df.columns for df in frames if "BroadcastExchange" in df._jdf.queryExecution().executedPlan().toString()] == []


def draws_one_by_one(cases, controls, config):
    """Case by case, the first eligible controls clockwise from the case's point that no earlier case took."""
    def point(pnr):
        return int(hashlib.md5(f"{config.seed}:{pnr}".encode()).hexdigest()[:8], 16)

    taken, pairs = set(), []
    for case in sorted(cases):
        fit = [k[0] for k in controls if k[0] not in taken and eligible(case, k, config.criteria)]
        drawn = sorted(fit, key=lambda k: ((point(k) - point(case[0])) % 2**32, k))[: config.ratio]
        taken.update(drawn)
        pairs += [(case[0], k) for k in drawn]
    return sorted(pairs)


@pytest.mark.parametrize(
    ("unit", "edges", "days", "n_controls", "ratio"),
    [(200_000, 1_600_000, 300, 120, 2), (60, 1_600_000, 900, 150, 2), (40, 1_600_000, 900, 400, 3), (15, 1_600_000, 40, 90, 2), (60, 300, 300, 120, 2), (30, 200, 500, 150, 1000)],
)
def test_draws_do_not_depend_on_the_units(spark, monkeypatch, unit, edges, days, n_controls, ratio):
    """One unit or many, blocks that share controls, sectors, more wanted than there is: the draws of a loop over the cases."""
    for name, value in (("_UNIT", unit), ("_EDGES", edges), ("_HALO", 1)):
        monkeypatch.setattr(M, name, value, raising=False)
    rng = random.Random(unit + days)
    cases, controls = people(rng, "a", 100, days), people(rng, "k", n_controls, days)
    controls += cases[:20]
    config = M.MatchingConfig(ratio=ratio, seed=6)
    result = M.match(spark.createDataFrame(cases, SCHEMA).repartition(3), spark.createDataFrame(controls, SCHEMA).repartition(5), config)
    assert sorted((r.case_pnr, r.control_pnr) for r in result.pairs.collect()) == draws_one_by_one(cases, controls, config)


def test_too_few_controls_cost_no_rounds(spark, monkeypatch):
    """Where nearly all controls are taken and most cases get none, the cases of a unit are settled in one round."""
    rng = random.Random(21)
    cases, controls = people(rng, "a", 400, 60), people(rng, "k", 150, 60)
    written = _watched(monkeypatch)
    config = M.MatchingConfig(ratio=2, seed=5)
    result = M.match(spark.createDataFrame(cases, SCHEMA), spark.createDataFrame(controls, SCHEMA), config)
    assert sorted((r.case_pnr, r.control_pnr) for r in result.pairs.collect()) == draws_one_by_one(cases, controls, config)
    assert result.rounds == 1
    assert sum(out.count() for name, _, out in written if name == "match-draws") <= len(cases) + len(controls)


def test_nobody_fits_in_many_units(spark, monkeypatch):
    monkeypatch.setattr(M, "_UNIT", 2, raising=False)
    cases = spark.createDataFrame([(f"a{i}", START, "M", 1) for i in range(5)], SCHEMA)
    with pytest.raises(ValueError, match="no case"):
        M.match(cases, spark.createDataFrame([(f"k{i}", START, "F", 1) for i in range(5)], SCHEMA))
