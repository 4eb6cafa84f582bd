"""Delivery periods: year, month, quarter or day, as a struct column.

A period is ``struct<kind, year, sub, start, end>``: ``sub`` is the month or quarter number, or
month*100+day for a day, and ``start``/``end`` are its inclusive bounds.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

YEAR, MONTH, QUARTER, DAY = "year", "month", "quarter", "day"
PERIOD_TYPE = "struct<kind:string,year:int,sub:int,start:date,end:date>"


def _build(kind: str, year: Column, sub: Column, start: Column, end: Column) -> Column:
    return F.struct(
        F.lit(kind).alias("kind"),
        year.cast("int").alias("year"),
        sub.cast("int").alias("sub"),
        start.alias("start"),
        end.alias("end"),
    )


def year_period(year: Column) -> Column:
    start = F.make_date(year, F.lit(1), F.lit(1))
    end = F.make_date(year, F.lit(12), F.lit(31))
    return F.when(year.isNotNull(), _build(YEAR, year, F.lit(None), start, end))


def month_period(year: Column, month: Column) -> Column:
    valid = year.isNotNull() & month.between(1, 12)
    start = F.make_date(year, F.when(valid, month).otherwise(1), F.lit(1))
    return F.when(valid, _build(MONTH, year, month, start, F.last_day(start)))


def quarter_period(year: Column, quarter: Column) -> Column:
    valid = year.isNotNull() & quarter.between(1, 4)
    start = F.make_date(year, F.when(valid, quarter * 3 - 2).otherwise(1), F.lit(1))
    return F.when(valid, _build(QUARTER, year, quarter, start, F.last_day(F.add_months(start, 2))))


def day_period(date: Column) -> Column:
    sub = F.month(date) * 100 + F.dayofmonth(date)
    return F.when(date.isNotNull(), _build(DAY, F.year(date), sub, date, date))


def period_from_date(date: Column, kind: str) -> Column:
    """The year, month, quarter or day period a date falls in."""
    if kind == YEAR:
        return year_period(F.year(date))
    if kind == MONTH:
        return month_period(F.year(date), F.month(date))
    if kind == QUARTER:
        return quarter_period(F.year(date), F.quarter(date))
    if kind == DAY:
        return day_period(date)
    raise ValueError(f"unknown period kind {kind!r}")


_SPARK_PART = r"^part-\d{5}-[0-9a-f]{8}-"  # a piece that Spark wrote; its digits are no date


def _token(component: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(component, r"^[A-Za-z_]+=", ""), r"\.parquet$", "")


def in_period_folder(path: Column) -> Column:
    """Whether a ``part-`` file takes its period from the folder it lies in."""
    last, parent = F.regexp_extract(path, r"([^/]+)$", 1), F.regexp_extract(path, r"([^/]+)/[^/]+$", 1)
    code = _bind(_token(parent), lambda t: F.coalesce(_strict_code(t), _lenient_code(t)))
    return last.startswith("part-") & (code.isNotNull() | last.rlike(_SPARK_PART))


def period_token(path: Column) -> Column:
    """The part of a path that names the period, without its extension.

    ``bef/2020.parquet``, a directory ``bef/2020.parquet/part-0001...`` that Spark wrote, and
    ``bef/period=2020/part-0001...`` all give ``2020``. A delivery that is itself called ``part-2020.parquet``, in a
    folder without a period, is dated by its own name.
    """
    last, parent = F.regexp_extract(path, r"([^/]+)$", 1), F.regexp_extract(path, r"([^/]+)/[^/]+$", 1)
    return _token(F.when(in_period_folder(path), parent).otherwise(last))


# The period spellings accepted as a whole name, and those searched inside a name.
_YEAR = r"^\d{4}$"
_MONTH = r"^\d{4}-?(0[1-9]|1[0-2])$"
_QUARTER = r"^\d{4}-?Q[1-4]$"
_DAY = r"^\d{8}$"
_INNER_MONTH = r"(\d{4})[_-]?(\d{2})"
_INNER_QUARTER = r"(\d{4})[_-]?Q(\d)"
_INNER_YEAR = r"(?:^|[_-])(\d{4})(?:[_-]|$)"


def _bind(value: Column, function: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and hand it to an expression that uses it many times."""
    return F.element_at(F.transform(F.array(value), function), 1)


def _strict_code(token: Column) -> Column:
    """Period as one of ``Y2020``, ``M202003``, ``Q20201``, ``D20200301``: the whole name, no dashes."""
    plain = ~token.contains("-")
    return (
        F.when(token.rlike(_YEAR), F.concat(F.lit("Y"), token))
        .when(plain & token.rlike(_MONTH), F.concat(F.lit("M"), token))
        .when(plain & token.rlike(_QUARTER), F.concat(F.lit("Q"), F.replace(token, F.lit("Q"), F.lit(""))))
        .when(token.rlike(_DAY) & F.try_to_date(token, "yyyyMMdd").isNotNull(), F.concat(F.lit("D"), token))
    )


def _lenient_code(token: Column) -> Column:
    """Also with a dash, then a month, a quarter or a year anywhere in the name."""
    def inner(kind: str, pattern: str, valid: str) -> Column:
        groups = F.concat(F.regexp_extract(token, pattern, 1), F.regexp_extract(token, pattern, 2))
        return F.when(groups.rlike(valid), F.concat(F.lit(kind), groups))

    year = F.regexp_extract(token, _INNER_YEAR, 1)
    return F.coalesce(
        F.when(token.rlike(_YEAR), F.concat(F.lit("Y"), token)),
        F.when(token.rlike(_MONTH), F.concat(F.lit("M"), F.replace(token, F.lit("-"), F.lit("")))),
        F.when(token.rlike(_QUARTER), F.concat(F.lit("Q"), F.regexp_replace(token, "[-Q]", ""))),
        inner("M", _INNER_MONTH, _MONTH),
        inner("Q", _INNER_QUARTER, r"^\d{4}[1-4]$"),
        F.when(year != "", F.concat(F.lit("Y"), year)),
    )


def _decode(code: Column) -> Column:
    """Period struct of a period code."""
    kind, year = F.substring(code, 1, 1), F.substring(code, 2, 4).try_cast("int")
    sub = F.substring(code, 6, 4).try_cast("int")
    first_month = F.when(kind == "M", sub).when(kind == "Q", sub * 3 - 2).when(kind == "D", F.floor(sub / 100)).otherwise(1)
    start = F.make_date(year, first_month.cast("int"), F.when(kind == "D", sub % 100).otherwise(1))
    months = F.when(kind == "M", 0).when(kind == "Q", 2).otherwise(11)
    name = F.when(kind == "Y", YEAR).when(kind == "M", MONTH).when(kind == "Q", QUARTER).otherwise(DAY)
    return F.when(
        code.isNotNull(),
        F.struct(
            name.alias("kind"), year.alias("year"), sub.alias("sub"), start.alias("start"),
            F.when(kind == "D", start).otherwise(F.last_day(F.add_months(start, months))).alias("end"),
        ),
    )


def strict_period(token: Column) -> Column:
    """``YYYY``, ``YYYYMM``, ``YYYYQn`` or ``YYYYMMDD`` and nothing else; null otherwise."""
    return _bind(_bind(token, _strict_code), _decode)


def lenient_period(token: Column) -> Column:
    """Also dashes, prefixes and suffixes: whole name first, then month, quarter and year inside it."""
    return _bind(_bind(token, _lenient_code), _decode)


def period_of_path(path: Column) -> Column:
    """Strict reading first, lenient as fallback."""
    def code(token: Column) -> Column:
        return F.coalesce(_strict_code(token), _lenient_code(token))

    return _bind(_bind(period_token(path), code), _decode)


def registry_of_path(path: Column) -> Column:
    """The upper-cased directory that holds the period file."""
    above = F.regexp_extract(path, r"([^/]+)/[^/]+/[^/]+$", 1)
    return F.upper(F.when(in_period_folder(path), above).otherwise(F.regexp_extract(path, r"([^/]+)/[^/]+$", 1)))


def year_of_file(path: Column) -> Column:
    """Year of a yearly hospital file: the whole stem, or what follows its last underscore."""
    return F.regexp_extract(period_token(path), r"(?:^|_)(\d+)$", 1).try_cast("int")


def period_contains(period: Column, date: Column) -> Column:
    return date.between(period["start"], period["end"])


def period_overlaps(period: Column, start: Column | None, end: Column | None) -> Column:
    """True when the period shares a day with the range; an open side never excludes."""
    hit = period.isNotNull()
    if start is not None:
        hit = hit & (period["end"] >= start)
    if end is not None:
        hit = hit & (period["start"] <= end)
    return hit


def _digits(number: Column, width: int) -> Column:
    return F.lpad(number.cast("string"), width, "0")


def period_label(period: Column) -> Column:
    """``2018``, ``201803``, ``2018Q1`` or ``20180301``."""
    year, kind, sub = _digits(period["year"], 4), period["kind"], period["sub"]
    return (
        F.when(kind == YEAR, year)
        .when(kind == MONTH, F.concat(year, _digits(sub, 2)))
        .when(kind == QUARTER, F.concat(year, F.lit("Q"), sub.cast("string")))
        .when(kind == DAY, F.concat(year, _digits(sub, 4)))
    )


def period_display(period: Column) -> Column:
    """``2018``, ``2018-03``, ``2018-Q1`` or ``2018-03-01``."""
    year, kind, sub = _digits(period["year"], 4), period["kind"], period["sub"]
    return (
        F.when(kind == YEAR, year)
        .when(kind == MONTH, F.concat(year, F.lit("-"), _digits(sub, 2)))
        .when(kind == QUARTER, F.concat(year, F.lit("-Q"), sub.cast("string")))
        .when(kind == DAY, F.date_format(period["start"], "yyyy-MM-dd"))
    )
