"""ICD-10 codes: cleaning, patterns, chapters and the simple chronic-disease rules."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

# First letters of each ICD-10 chapter. D and H belong to two chapters.
CHAPTER_LETTERS = {
    "I": "AB", "II": "CD", "III": "D", "IV": "E", "V": "F", "VI": "G", "VII": "H", "VIII": "H", "IX": "I",
    "X": "J", "XI": "K", "XII": "L", "XIII": "M", "XIV": "N", "XV": "O", "XVI": "P", "XVII": "Q",
    "XVIII": "R", "XIX": "ST", "XX": "VWXY", "XXI": "Z", "XXII": "U",
}

# Fixed values of the simple chronic-disease rule set.
SIMPLE_EXACT = ("E10", "G40", "Q90", "C50")
SIMPLE_PREFIXES = ("C", "D80", "G71", "Q")
SIMPLE_SEVERITY = (("E10", 2), ("G40", 2), ("C", 3), ("Q90", 3))
SIMPLE_DEFAULT_SEVERITY = 2


def clean_code(code: Column) -> Column:
    """Trimmed, upper case, without inner spaces."""
    return F.upper(F.replace(F.trim(code), F.lit(" "), F.lit("")))


def is_valid_code(code: Column) -> Column:
    """Starts with a letter and has at least three characters."""
    cleaned = clean_code(code)
    return F.coalesce(cleaned.rlike("^[A-Z]") & (F.length(cleaned) >= 3), F.lit(False))


def matches_pattern(code: Column, pattern: str) -> Column:
    """``E10*`` matches a prefix, anything else matches exactly."""
    if pattern.endswith("*"):
        return code.startswith(pattern.rstrip("*"))
    return code == F.lit(pattern)


def has_any_prefix(code: Column, prefixes: Iterable[str]) -> Column:
    """The cleaned code starts with one of the cleaned prefixes; grouped by length so it stays a hash test."""
    by_length: dict[int, list[str]] = {}
    for prefix in prefixes:
        cleaned = prefix.strip().upper().replace(" ", "")
        by_length.setdefault(len(cleaned), []).append(cleaned)
    cleaned_code = clean_code(code)
    hit = F.lit(False)
    for length, group in sorted(by_length.items()):
        hit = hit | F.substring(cleaned_code, 1, length).isin(group)
    return hit


def in_chapter(code: Column, chapter: str) -> Column:
    """First letter belongs to the chapter; codes under three characters belong to none."""
    letters = CHAPTER_LETTERS.get(chapter.upper(), "")
    if not letters:
        return F.lit(False)
    return (F.length(code) >= 3) & F.substring(code, 1, 1).isin(list(letters))


def chapters(code: Column) -> Column:
    """All chapters of a code as an array, in chapter order."""
    hits = [F.when(in_chapter(code, name), F.lit(name)) for name in CHAPTER_LETTERS]
    return F.array_compact(F.array(*hits))


def simple_is_scd(code: Column) -> Column:
    hit = code.isin(list(SIMPLE_EXACT))
    for prefix in SIMPLE_PREFIXES:
        hit = hit | code.startswith(prefix)
    return F.coalesce(hit, F.lit(False))


def simple_severity(code: Column) -> Column:
    """1..3; codes without an own entry get the default."""
    severity = F.lit(SIMPLE_DEFAULT_SEVERITY)
    for prefix, value in SIMPLE_SEVERITY:
        severity = F.when(code.startswith(prefix), F.lit(value)).otherwise(severity)
    return severity


def simple_is_congenital(code: Column) -> Column:
    return F.coalesce(code.startswith("Q"), F.lit(False))


# Category of each remaining chapter letter in the chapter-style classification.
_LETTER_CATEGORY = {"E": 3, "G": 4, "I": 5, "J": 6, "K": 7, "M": 8, "N": 9, "Q": 10}


def chapter_category(code: Column) -> Column:
    """0..10: C and D00-48 are 1, D50-89 with M30 and M35 are 2, then one category per letter."""
    letter = F.substring(code, 1, 1)
    digits = F.when(F.length(code) >= 3, F.substring(code, 2, 2))
    category = (
        F.when((letter == "C") | ((letter == "D") & (digits <= "48")), F.lit(1))
        .when((letter == "D") & digits.between("50", "89"), F.lit(2))
        .when(F.substring(code, 1, 3).isin("M30", "M35"), F.lit(2))
    )
    for first, value in _LETTER_CATEGORY.items():
        category = category.when(letter == first, F.lit(value))
    return category.otherwise(F.lit(0))
