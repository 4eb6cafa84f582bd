"""Date parsing, formatting and conversion."""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

# The formats tried for delivered date strings, in this order.
DATE_FORMATS = (
    "yyyy-M-d",
    "d-M-yyyy",
    "M/d/yyyy",
    "d/M/yyyy",
    "d.M.yyyy",
    "yyyyMMdd",
    "d MMM yyyy",
    "d MMMM yyyy",
)
# Fixed value: the one format pattern detection adds to the list above.
DETECTED_FORMATS = ("yyyy/M/d",)
# Formats of register extracts and of matching input.
REGISTER_FORMATS = ("yyyy-MM-dd", "dd/MM/yyyy", "yyyyMMdd", "ddMMMyyyy")
MATCHING_FORMATS = ("yyyy-M-d", "d-M-yyyy", "yyyy/M/d", "d/M/yyyy")


# Texts each format letter group can read.
_SHAPES = {
    "yyyy": r"\d{4}", "MMMM": "[A-Za-z]+", "MMM": "[A-Za-z]{3}", "MM": r"\d{2}", "M": r"\d{1,2}",
    "dd": r"\d{2}", "d": r"\d{1,2}",
}


def _shape(pattern: str) -> str | None:
    """Regular expression of the texts a date format can read; none for formats with other letters."""
    parts = re.split("(y+|M+|d+)", pattern)
    if any(part not in _SHAPES and re.search("[A-Za-z]", part) for part in parts):
        return None
    return "^" + "".join(_SHAPES.get(part, re.escape(part)) for part in parts) + "$"


def _first_parse(text: Column, formats: Iterable[str]) -> Column:
    """Only formats whose shape fits are tried: a failed parse costs far more than a failed match."""
    def parsed(pattern: str) -> Column:
        shape, date = _shape(pattern), F.try_to_date(text, pattern)
        return date if shape is None else F.when(text.rlike(shape), date)

    return F.coalesce(*(parsed(pattern) for pattern in formats))


def parse_date(text: Column, formats: Iterable[str] = DATE_FORMATS, detect: bool = True) -> Column:
    """String to date: the first format that fits wins, null when none does.

    ``01/02/2023`` is read month-first because that format comes earlier; pass ``formats`` to change it.
    """
    tried = tuple(formats) + (DETECTED_FORMATS if detect else ())
    cleaned = F.when(text.rlike("[A-Za-z]"), F.initcap(text)).otherwise(text)
    return _first_parse(cleaned, tried)


def parse_register_date(text: Column) -> Column:
    """Dates as register extracts write them, including ``01jan2020`` in any letter case."""
    cleaned = F.when(
        text.rlike("^[0-9]{2}[A-Za-z]{3}[0-9]{4}$"),
        F.concat(F.substring(text, 1, 2), F.initcap(F.substring(text, 3, 3)), F.substring(text, 6, 4)),
    ).otherwise(text)
    return _first_parse(cleaned, REGISTER_FORMATS)


def parse_matching_date(text: Column) -> Column:
    """The shorter list accepted for matching input."""
    return _first_parse(text, MATCHING_FORMATS)


def parse_timestamp(text: Column, formats: Iterable[str] = DATE_FORMATS) -> Column:
    """String to zone-less timestamp at midnight of the parsed date."""
    return parse_date(text, formats).cast("timestamp_ntz")


def format_date(value: Column, pattern: str = "yyyy-MM-dd") -> Column:
    """Date or timestamp to string."""
    return F.date_format(value, pattern)


def date_to_millis(value: Column) -> Column:
    """Days since 1970 to milliseconds since 1970."""
    return F.unix_date(value).cast("long") * F.lit(86_400_000)


def millis_to_date(value: Column) -> Column:
    """Milliseconds since 1970 to the day they fall on."""
    return F.date_from_unix_date(F.floor(value / F.lit(86_400_000)).cast("int"))


def day_number(value: Column) -> Column:
    """Days since 1970, the number integer filters on date columns compare with."""
    return F.unix_date(value)
