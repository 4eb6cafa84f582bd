"""As-of and interval joins against loops over all pairs."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from lifeframe.operators import asof, intervals

D = dt.date
DAY = dt.timedelta(days=1)


def as_of(rows, events, forward, strict):
    out = []
    for key, date, n in rows:
        fits = [(e, v) for k, e, v in events if k is not None and k == key and e is not None and date is not None and (
            (e > date if strict else e >= date) if forward else (e < date if strict else e <= date)
        )]
        day = (min if forward else max)((e for e, _ in fits), default=None)
        out.append((key, date, n, max((f for f in fits if f[0] == day), default=None)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("forward", [False, True])
@pytest.mark.parametrize("strict", [False, True])
def test_as_of(spark, forward, strict):
    source = random.Random(5)
    day = lambda: D(1990, 1, 1) + source.randrange(4000) * DAY
    keys = ["hot"] * 30 + [str(i) for i in range(20)] + [None]
    events = [(source.choice(keys), day(), source.randrange(50)) for _ in range(600)] + [("hot", None, 1), ("0", D(1995, 1, 1), 3), ("0", D(1995, 1, 1), 7)]
    rows = [(source.choice(keys), day(), i) for i in range(400)] + [("hot", None, -1), ("0", D(1995, 1, 1), -2), ("0", D(1995, 1, 1), -2), ("none", day(), 3)]
    left = spark.createDataFrame(rows, "pnr string, at date, n int").repartition(4)
    right = spark.createDataFrame(events, "pnr string, event_date date, v int").repartition(3)
    got = asof.as_of(left, right, "pnr", "at", "event_date", ["v"], forward=forward, strict=strict).collect()
    assert sorted(((r.pnr, r.at, r.n, tuple(r.event) if r.event else None) for r in got), key=repr) == as_of(rows, events, forward, strict)
    assert asof.as_of(left.limit(0), right, "pnr", "at", "event_date", ["v"]).count() == 0
    assert asof.as_of(left, right.limit(0), "pnr", "at", "event_date", ["v"]).filter("event is not null").count() == 0


def test_a_person_with_most_events_is_a_row_a_day(spark):
    """What is run along the days of a person does not grow with its events."""
    events = spark.range(200_000).selectExpr("if(id % 3 > 0, 'hot', cast(id as string)) as pnr", "date_add(date '1990-01-01', cast(id % 2000 as int)) as event_date", "id % 7 as v")
    rows = spark.range(50_000).selectExpr("if(id % 3 > 0, 'hot', cast(id as string)) as pnr", "date_add(date '1990-01-02', cast(id % 1500 as int)) as at")
    found = asof.as_of(rows, events, "pnr", "at", "event_date", ["v"])
    assert found.count() == 50_000 and found.filter("pnr = 'hot' and event.event_date <> at").count() == 0


@pytest.mark.parametrize("keyed", [False, True])
def test_overlaps_and_days(spark, keyed):
    source = random.Random(9)

    def interval(i):
        start = D(1900, 1, 1) + source.randrange(60_000) * DAY
        end = start + source.choice([0, 1, 30, 364, 5000, 40_000]) * DAY
        return (f"i{i}", "k%d" % (i % 3), source.choice([start, start, start, None]), source.choice([end, end, end, None]))

    a, b = [interval(i) for i in range(70)], [interval(i) for i in range(60)]
    a += [("all", "k0", None, None), ("century", "k1", D(1900, 1, 1), D(1999, 12, 31)), ("none", "k1", D(2000, 1, 2), D(2000, 1, 1)), ("early", "k2", D(1, 1, 1), D(1200, 1, 1))]
    b += [("all", "k0", None, None), ("day", "k2", D(2000, 1, 1), D(2000, 1, 1))]
    low, high = (lambda x: x or D.min), (lambda x: x or D.max)
    shares = {
        (x[0], y[0]) for x in a for y in b if (not keyed or x[1] == y[1]) and low(x[2]) <= high(x[3]) and low(y[2]) <= high(y[3]) and low(x[2]) <= high(y[3]) and low(y[2]) <= high(x[3])
    }
    left = spark.createDataFrame(a, f"a string, {'k' if keyed else 'ka'} string, s date, e date").repartition(3)
    right = spark.createDataFrame(b, f"b string, {'k' if keyed else 'kb'} string, from date, to date").repartition(2)
    got = [(r.a, r.b) for r in intervals.overlapping(left, right, ("s", "e"), ("from", "to"), ["k"] if keyed else []).collect()]
    assert len(got) == len(set(got)) and set(got) == shares
    days = [(f"d{i}", "k%d" % (i % 3), D(1900, 1, 1) + source.randrange(60_000) * DAY) for i in range(80)] + [("null", "k0", None)]
    inside = {(x[0], y[0]) for x in days for y in b if x[2] and (not keyed or x[1] == y[1]) and low(y[2]) <= x[2] <= high(y[3])}
    at = spark.createDataFrame(days, f"d string, {'k' if keyed else 'kd'} string, at date")
    held = [(r.d, r.b) for r in intervals.containing(at, right, "at", "from", "to", ["k"] if keyed else []).collect()]
    assert len(held) == len(set(held)) and set(held) == inside


def test_long_intervals_are_few_nodes(spark):
    df = spark.sql("select date '1900-01-02' as s, date '1999-12-30' as e union all select null, null union all select date '2000-02-29', date '2000-02-29'")
    n = [r[0] for r in df.select(F.size(intervals.nodes_of_interval(F.col("s"), F.col("e"))).alias("n")).collect()]
    assert max(n) <= 2 * intervals.LEVELS and n[1:] == [1, 1]
    assert df.select(F.size(intervals.nodes_of_day(F.col("s")))).first()[0] == intervals.LEVELS + 1


def test_joins_are_equi_joins(spark):
    left = spark.range(1000).selectExpr("id as a", "date_add(date '1990-01-01', cast(id as int)) as s", "date_add(date '1991-01-01', cast(id as int)) as e")
    right = left.selectExpr("a as b", "s as f", "e as t")
    plan = intervals.overlapping(left, right, ("s", "e"), ("f", "t"))._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


@pytest.mark.parametrize("few", ["left", "right", None])
def test_joins_by_size(spark, monkeypatch, few):
    """The same pairs whichever side is broadcast, or none."""
    monkeypatch.setattr(intervals, "FEW", 5 if few else 0)
    many = spark.range(40).selectExpr("id as a", "date_add(date '1990-01-01', cast(id * 50 as int)) as s", "if(id % 4 = 0, null, date_add(date '1990-02-01', cast(id * 50 as int))) as e")
    some = spark.range(5).selectExpr("id as b", "if(id = 0, null, date_add(date '1991-01-01', cast(id * 200 as int))) as f", "date_add(date '1991-03-01', cast(id * 200 as int)) as t")
    shares = {(r.a, r.b) for r in many.crossJoin(some).filter("(e is null or f is null or f <= e) and s <= t").collect()}
    sides = ((some, many, ("f", "t"), ("s", "e")) if few == "left" else (many, some, ("s", "e"), ("f", "t")))
    got = [(r.a, r.b) for r in intervals.overlapping(*sides).collect()]
    assert len(got) == len(set(got)) and set(got) == shares
    days = [(r.a, r.b) for r in intervals.containing(many.drop("e"), some, "s", "f", "t").collect()]
    assert sorted(days) == sorted((r.a, r.b) for r in many.crossJoin(some).filter("s <= t and (f is null or f <= s)").collect())


def test_nodes_of_many_rows_are_not_broadcast(spark, tmp_path):
    """Estimates know nothing of a row's nodes, so a small file may stand for a large table of them."""
    path = str(tmp_path / "stays")
    rows = spark.range(3000).selectExpr("cast(id % 900 as string) as pnr", "date_add(date '1990-01-01', cast(id as int)) as s", "date_add(date '1990-01-09', cast(id as int)) as e")
    rows.write.parquet(path)
    stays = spark.read.parquet(path)
    days = stays.selectExpr("pnr", "s as day")
    joins = [intervals.containing(days, stays, "day", "s", "e", ["pnr"]), intervals.overlapping(stays, stays.selectExpr("pnr", "s as f", "e as t"), ("s", "e"), ("f", "t"), ["pnr"])]
    for join in joins:
        assert join.count() >= 3000
        assert "BroadcastExchange" not in join._jdf.queryExecution().executedPlan().toString()
