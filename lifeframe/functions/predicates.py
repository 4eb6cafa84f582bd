"""Row predicates.

Null logic is SQL's by default. ``strict_nulls=True`` selects the stricter rules some registers are
filtered with: a null side makes AND and OR null, and membership and text tests on null are false
(so that their negation keeps null rows).
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Iterable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RowPredicate = Callable[[DataFrame], Column]


def is_in(value: Column, values: Iterable[object], strict_nulls: bool = False) -> Column:
    """Membership in a short list; use a semi-join for cohorts."""
    hit = value.isin(list(values))
    return F.coalesce(hit, F.lit(False)) if strict_nulls else hit


def not_in(value: Column, values: Iterable[object], strict_nulls: bool = False) -> Column:
    return ~is_in(value, values, strict_nulls)


def contains(value: Column, text: str, strict_nulls: bool = False) -> Column:
    hit = value.contains(text)
    return F.coalesce(hit, F.lit(False)) if strict_nulls else hit


def starts_with(value: Column, text: str, strict_nulls: bool = False) -> Column:
    hit = value.startswith(text)
    return F.coalesce(hit, F.lit(False)) if strict_nulls else hit


def ends_with(value: Column, text: str, strict_nulls: bool = False) -> Column:
    hit = value.endswith(text)
    return F.coalesce(hit, F.lit(False)) if strict_nulls else hit


def _null_if_any_null(result: Column, parts: list[Column]) -> Column:
    known = reduce(lambda a, b: a & b, [p.isNotNull() for p in parts])
    return F.when(known, result)


def all_of(*parts: Column, strict_nulls: bool = False) -> Column:
    """Conjunction; true when there are no parts."""
    if not parts:
        return F.lit(True)
    result = reduce(lambda a, b: a & b, parts)
    return _null_if_any_null(result, list(parts)) if strict_nulls else result


def any_of(*parts: Column, strict_nulls: bool = False) -> Column:
    """Disjunction; false when there are no parts."""
    if not parts:
        return F.lit(False)
    result = reduce(lambda a, b: a | b, parts)
    return _null_if_any_null(result, list(parts)) if strict_nulls else result


def negate(part: Column) -> Column:
    return ~part


def always_true() -> Column:
    return F.lit(True)


def always_false() -> Column:
    return F.lit(False)


def date_in_range(value: Column, start: dt.date | None = None, end: dt.date | None = None) -> Column:
    """Inclusive range, each side optional; without bounds nothing is dropped, else null dates are."""
    if start is None and end is None:
        return F.lit(True)
    parts = [value.isNotNull()]
    if start is not None:
        parts.append(value >= F.lit(start))
    if end is not None:
        parts.append(value <= F.lit(end))
    return all_of(*parts)


def in_year(value: Column, year: int) -> Column:
    """Calendar year as a range, so that file statistics can prune."""
    return date_in_range(value, dt.date(year, 1, 1), dt.date(year, 12, 31))


def valid_at(valid_from: Column, valid_to: Column, date: Column) -> Column:
    """Interval contains the date; a null end is open."""
    return F.coalesce(valid_from <= date, F.lit(False)) & (valid_to.isNull() | (valid_to >= date))


def valid_during(valid_from: Column, valid_to: Column, start: Column, end: Column) -> Column:
    """Interval shares a day with the range; a null end is open."""
    return F.coalesce(valid_from <= end, F.lit(False)) & (valid_to.isNull() | (valid_to >= start))


@dataclass(frozen=True)
class Predicate:
    """A reusable predicate over frames, composable with ``&``, ``|`` and ``~``."""

    test: RowPredicate

    def __call__(self, df: DataFrame) -> Column:
        return self.test(df)

    def __and__(self, other: RowPredicate) -> Predicate:
        return Predicate(lambda df: self.test(df) & other(df))

    def __or__(self, other: RowPredicate) -> Predicate:
        return Predicate(lambda df: self.test(df) | other(df))

    def __invert__(self) -> Predicate:
        return Predicate(lambda df: ~self.test(df))

    def apply(self, df: DataFrame) -> DataFrame:
        return df.filter(self.test(df))


def apply_all(df: DataFrame, predicates: Iterable[RowPredicate]) -> DataFrame:
    """Keep the rows every predicate accepts."""
    return df.filter(all_of(*(p(df) for p in predicates)))


def drop_missing(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    """Drop rows with a null in any of the columns; an unknown column is an error."""
    wanted = list(columns)
    unknown = [c for c in wanted if c not in df.columns]
    if unknown:
        raise ValueError(f"unknown columns: {unknown}")
    return df.dropna(subset=wanted) if wanted else df
