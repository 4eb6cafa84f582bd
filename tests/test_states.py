"""Stored tables and states: only touched buckets change, and any order of folds gives the merge of all."""

import datetime as dt
import itertools
import os

import pytest
from pyspark.sql import functions as F

from lifeframe.functions import periods as P
from lifeframe.operators import longitudinal as L
from lifeframe.operators.states import LongitudinalState, PresenceState
from lifeframe.sources import sinks
from lifeframe.sources.buckets import BucketedTable

FIELDS = {"a": "string", "b": "int"}


def files_of(table):
    """(name, size, time) of each bucket's files."""
    found = {}
    for bucket, folder in table.manifest().items():
        place = folder.removeprefix("file:")
        found[bucket] = sorted((n, os.path.getsize(f"{place}/{n}"), os.path.getmtime(f"{place}/{n}")) for n in os.listdir(place))
    return found


def test_upserts_touch_their_buckets_only(spark, tmp_path, rows):
    table = BucketedTable(spark, str(tmp_path / "t"), "pnr string, v int", buckets=16)
    assert table.read().count() == 0 and table.manifest() == {}
    first = spark.range(200).selectExpr("cast(id as string) as pnr", "1 as v")
    assert len(sinks.upsert_stored(table, first)) == 16
    before = files_of(table)
    second = spark.createDataFrame([("3", 2), ("new", 3), ("3", 5)], "pnr string, v int")
    touched = sinks.upsert_stored(table, second, F.col("v"))
    after = files_of(table)
    assert 1 <= len(touched) <= 2 and {b for b in after if after[b] != before[b]} == touched
    assert rows(table.read().filter("v <> 1"), "pnr", "v") == [("3", 5), ("new", 3)] and table.read().count() == 201
    assert sinks.upsert_stored(table, second.limit(0)) == set() and files_of(table) == after
    table.clean()
    assert files_of(table) == after and table.read().count() == 201


def test_a_broken_change_leaves_the_table_as_it_was(spark, tmp_path, rows):
    table = BucketedTable(spark, str(tmp_path / "t"), "pnr string, v int", buckets=4)
    sinks.upsert_stored(table, spark.createDataFrame([("1", 1)], "pnr string, v int"))
    bad = spark.createDataFrame([("1", "x")], "pnr string, v string")
    with pytest.raises(Exception, match="CAST_INVALID_INPUT|malformed"):
        table.change(bad, lambda current, incoming: incoming)
    assert rows(table.read(), "pnr", "v") == [("1", 1)]


def deliveries(spark):
    def make(registry, year, *people):
        df = spark.createDataFrame(list(people), "pnr string, a string, b int")
        return registry, str(year), df.withColumn("period", P.year_period(F.lit(year)))

    return [
        make("bef", 2001, ("1", "x", None), ("2", None, 5), (None, "lost", 1)), make("bef", 2000, ("1", None, None), ("2", "y", 7), ("2", "z", 6)),
        make("ind", 1999, ("1", "older", 9), ("3", "only", None)), make("ind", 2003, ("2", "late", 1), ("4", None, None)),
    ]


def merged(parts, prefer):
    by = {}
    for registry, _, df in parts:
        by[registry] = by[registry].unionByName(df) if registry in by else df
    return L.longitudinal(by, prefer=prefer)


@pytest.mark.parametrize("prefer", ["earliest", "latest"])
def test_folds_in_any_order(spark, tmp_path, rows, prefer):
    parts = deliveries(spark)
    expected = rows(merged(parts, prefer), "pnr", "a", "b")
    for n, order in enumerate(list(itertools.permutations(parts))[::5]):
        state = LongitudinalState(spark, str(tmp_path / f"{n}"), FIELDS, prefer, buckets=3)
        for registry, label, df in order:
            state.fold(df, registry, label)
        assert state.fold(order[0][2], *order[0][:2]) == set()
        assert rows(state.records(), "pnr", "a", "b") == expected


@pytest.mark.parametrize("out", range(4))
def test_withdrawn_delivery(spark, tmp_path, rows, out):
    parts = deliveries(spark)
    state = LongitudinalState(spark, str(tmp_path / "s"), FIELDS, buckets=8)
    for registry, label, df in parts:
        state.fold(df, registry, label)
    before = files_of(state.table)
    registry, label, gone = parts.pop(out)
    left = {}
    for name, _, df in parts:
        left[name] = left[name].unionByName(df) if name in left else df
    touched = state.withdraw(gone, registry, label, left)
    after = files_of(state.table)
    assert {b for b in before if after.get(b) != before[b]} <= touched
    assert rows(state.records(), "pnr", "a", "b") == rows(merged(parts, "earliest"), "pnr", "a", "b")
    assert f"{registry}/{label}" not in state.folded() and len(state.folded()) == 3
    assert state.withdraw(gone, registry, label, left) == set()


def test_presence(spark, tmp_path, rows):
    parts = deliveries(spark)
    state = PresenceState(spark, str(tmp_path / "s"), buckets=4)
    for registry, label, df in reversed(parts):
        state.fold(df, registry, label)
    by = {"bef": parts[0][2].unionByName(parts[1][2]), "ind": parts[2][2].unionByName(parts[3][2])}
    columns = ["pnr", "registry", "label", "period_start", "period_end", "source"]
    assert rows(state.records(), *columns) == rows(L.presence(by), *columns)
    state.withdraw(parts[0][2], "bef", "2001", {"bef": parts[1][2], "ind": by["ind"]})
    assert rows(state.records(), *columns) == rows(L.presence(by | {"bef": parts[1][2]}), *columns)
    assert state.records().agg(F.min("period_start")).first()[0] == dt.date(1999, 1, 1)


def test_registers_need_a_rank(spark, tmp_path):
    state = LongitudinalState(spark, str(tmp_path / "s"), FIELDS, priority=["bef"], buckets=2)
    with pytest.raises(ValueError, match="rank"):
        state.fold(deliveries(spark)[2][2], "ind", "1999")
