"""Joins of day intervals with days and with each other, as equi-joins.

The days of a calendar of ``2**LEVELS`` days are halved again and again; a node is a level and a number within it. An interval is the
disjoint union of at most two nodes per level, whatever its length, and a day lies in one node per level. So a day lies in an interval exactly if one of
the interval's nodes is one of the day's, and then in exactly one: an equi-join with no false and no double matches. Two intervals
share a day exactly if the start of one lies in the other, so their join is two of these.

Spark's estimates take a row and its nodes, up to forty, for a row. So no table of nodes is broadcast by estimate: a side of at most ``FEW`` rows is
broadcast, all others are shuffled and sorted.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LEVELS = 20  # 2 871 years
FIRST = -(1 << 19)  # day number of the calendar's first day, in the year 534
LAST = FIRST + (1 << LEVELS) - 1
FEW = 1000


def _place(day: Column, missing: int) -> Column:
    """A date's place in the calendar; a null one stands for an open end."""
    number = F.coalesce(F.unix_date(day.cast("date")), F.lit(missing))
    return F.greatest(F.lit(0), F.least(F.lit(LAST - FIRST), number - F.lit(FIRST)))


def nodes_of_day(day: Column, missing: int = FIRST) -> Column:
    """The node of each level that holds a day."""
    place = _place(day, missing)
    return F.transform(F.sequence(F.lit(0), F.lit(LEVELS)), lambda level: _node(level, F.call_function("shiftright", place, level)))


def _node(level: Column, number: Column) -> Column:
    return level.cast("long") * (1 << (LEVELS + 1)) + number


def nodes_of_interval(start: Column, end: Column) -> Column:
    """The nodes that an interval is made of; none if it ends before it starts. A null bound is open."""
    low, high = _place(start, FIRST), _place(end, LAST) + 1

    def of_level(level: Column) -> Column:
        # Whole nodes of this level: from the first that starts in the interval to the last that ends there.
        size = F.call_function("shiftleft", F.lit(1), level)
        first = F.call_function("shiftright", low + size - 1, level)
        after = F.call_function("shiftright", high, level)
        # A node goes up into its pair unless the interval lacks the other half.
        left = F.when((first < after) & (first % 2 == 1), _node(level, first))
        right = F.when((first < after) & (after % 2 == 1), _node(level, after - 1))
        return F.array_compact(F.array(left, right))

    return F.flatten(F.transform(F.sequence(F.lit(0), F.lit(LEVELS)), of_level))


def _is_small(df: DataFrame) -> bool:
    return df.limit(FEW + 1).count() <= FEW


def _meeting(days: DataFrame, intervals: DataFrame, on: Sequence[str], few: str | None) -> DataFrame:
    """Rows that agree in node and ``on``; ``few`` says which side is small, if one is."""
    if few == "days":
        days = days.hint("broadcast")
    else:
        intervals = intervals.hint("broadcast" if few else "merge")
    return days.join(intervals, ["_node", *on])


def containing(days: DataFrame, intervals: DataFrame, day: str, start: str, end: str, on: Sequence[str] = ()) -> DataFrame:
    """All pairs of a day's row and an interval that holds the day, and that agree in ``on``. Other column names must not be shared."""
    few = "intervals" if _is_small(intervals) else None
    left = days.filter(F.col(day).isNotNull()).withColumn("_node", F.explode(nodes_of_day(F.col(day))))
    right = intervals.withColumn("_node", F.explode(nodes_of_interval(F.col(start), F.col(end))))
    return _meeting(left, right, on, few).drop("_node")


def overlapping(left: DataFrame, right: DataFrame, left_bounds: tuple[str, str], right_bounds: tuple[str, str], on: Sequence[str] = ()) -> DataFrame:
    """All pairs of intervals that share a day and agree in ``on``; bounds are inclusive and a null one is open.

    Intervals that end before they start share no day. Other column names must not be shared.
    """
    def real(df: DataFrame, bounds: tuple[str, str]) -> DataFrame:
        start, end = (F.col(b) for b in bounds)
        return df.filter(F.coalesce(start <= end, F.lit(True)))

    left, right = real(left, left_bounds), real(right, right_bounds)
    few = "right" if _is_small(right) else "left" if _is_small(left) else None
    columns = [*on, *(c for c in left.columns if c not in on), *(c for c in right.columns if c not in on)]
    (l_start, l_end), (r_start, r_end) = left_bounds, right_bounds
    day_left = left.withColumn("_node", F.explode(nodes_of_day(F.col(l_start))))
    node_right = right.withColumn("_node", F.explode(nodes_of_interval(F.col(r_start), F.col(r_end))))
    starts_inside = _meeting(day_left, node_right, on, {"left": "days", "right": "intervals"}.get(few)).select(*columns)
    day_right = right.withColumn("_node", F.explode(nodes_of_day(F.col(r_start))))
    node_left = left.withColumn("_node", F.explode(nodes_of_interval(F.col(l_start), F.col(l_end))))
    # Equal starts are in the first part.
    later = _place(F.col(r_start), FIRST) > _place(F.col(l_start), FIRST)
    starts_later = _meeting(day_right, node_left, on, {"left": "intervals", "right": "days"}.get(few)).filter(later)
    return starts_inside.unionByName(starts_later.select(*columns))
