"""Code tables of the registers and the Columns that decode them."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

# Register codes (lower-cased) and their categories.
GENDER = {"m": "Male", "male": "Male", "1": "Male", "f": "Female", "female": "Female", "2": "Female"}
ORIGIN = {
    "danish": "Danish", "danmark": "Danish", "dk": "Danish", "1": "Danish",
    "western": "Western", "west": "Western", "2": "Western",
    "non-western": "NonWestern", "nonwestern": "NonWestern", "3": "NonWestern",
}
EDUCATION = {"low": "Low", "1": "Low", "medium": "Medium", "2": "Medium", "high": "High", "3": "High"}
DIAGNOSIS_TYPE = {
    "primary": "Primary", "main": "Primary", "a": "Primary", "1": "Primary",
    "secondary": "Secondary", "b": "Secondary", "2": "Secondary",
}
SEVERITY = {"1": "Mild", "2": "Moderate", "3": "Severe"}
DISEASE_ORIGIN = {"1": "Congenital", "2": "Acquired"}
JOB_SITUATION = {
    "1": "EmployedFullTime", "2": "EmployedPartTime", "3": "SelfEmployed", "4": "Unemployed",
    "5": "Student", "6": "Retired", "7": "OnLeave",
}
FAMILY_TYPE = {"1": "TwoParent", "2": "SingleMother", "3": "SingleFather", "4": "NoParent"}
MARITAL_STATUS = {
    "u": "Unmarried", "1": "Unmarried", "g": "Married", "2": "Married", "f": "Divorced", "3": "Divorced",
    "e": "Widowed", "4": "Widowed", "p": "RegisteredPartnership", "5": "RegisteredPartnership",
    "o": "DissolvedPartnership", "6": "DissolvedPartnership",
    "l": "LongestLivingPartner", "7": "LongestLivingPartner",
}
CITIZENSHIP = {
    "1": "Danish", "2": "EuropeanUnion", "3": "NonEUWithResidence", "4": "TemporaryPermit", "5": "Stateless",
}
HOUSING = {
    "1": "SingleFamilyHouse", "2": "Apartment", "3": "TerracedHouse", "4": "Dormitory", "5": "Institution",
    "6": "Other",
}
SOCIOECONOMIC = {
    "1": "SelfEmployedWithEmployees", "2": "SelfEmployedWithoutEmployees", "3": "TopLevelEmployee",
    "4": "MediumLevelEmployee", "5": "BasicLevelEmployee", "6": "OtherEmployee", "7": "Unemployed",
    "8": "Student", "9": "Pensioner", "10": "OtherInactive",
}
SCD_CATEGORY = {
    "1": "Blood Disorder", "2": "Immune System Disorder", "3": "Endocrine Disorder",
    "4": "Neurological Disorder", "5": "Cardiovascular Disorder", "6": "Respiratory Disorder",
    "7": "Gastrointestinal Disorder", "8": "Musculoskeletal Disorder", "9": "Renal Disorder",
    "10": "Other Congenital Disorder",
}

# Each table with the value an unlisted or null code gets.
CODE_TABLES: dict[str, tuple[Mapping[str, str], str]] = {
    "gender": (GENDER, "Unknown"),
    "origin": (ORIGIN, "Unknown"),
    "education": (EDUCATION, "Unknown"),
    "diagnosis_type": (DIAGNOSIS_TYPE, "Other"),
    "severity": (SEVERITY, "None"),
    "disease_origin": (DISEASE_ORIGIN, "None"),
    "job_situation": (JOB_SITUATION, "Other"),
    "family_type": (FAMILY_TYPE, "Unknown"),
    "marital_status": (MARITAL_STATUS, "Unknown"),
    "citizenship": (CITIZENSHIP, "Unknown"),
    "housing": (HOUSING, "Unknown"),
    "socioeconomic": (SOCIOECONOMIC, "Unknown"),
    "scd_category": (SCD_CATEGORY, "No SCD Category"),
}

# Thousands digit of a postal code and its region; 1 and 2 share one.
POSTAL_REGIONS = {
    1: "Hovedstaden", 2: "Hovedstaden", 3: "Nordsjælland", 4: "Sjælland", 5: "Fyn", 6: "Sydjylland",
    7: "Midtjylland", 8: "Østjylland", 9: "Nordjylland",
}


def map_values(value: Column, mapping: Mapping[object, object]) -> Column:
    """Replace each value by its entry in ``mapping``; values without an entry become null."""
    pairs = [F.lit(part) for entry in mapping.items() for part in entry]
    return F.create_map(*pairs)[value]


def decode(value: Column, table: str) -> Column:
    """Category of a register code, total: unlisted and null codes get the table's default."""
    mapping, default = CODE_TABLES[table]
    return F.coalesce(map_values(F.lower(F.trim(value.cast("string"))), mapping), F.lit(default))


def postal_region(code: Column) -> Column:
    """Region of a four-digit postal code, ``Unknown`` outside the ranges, null for a null code."""
    thousands = F.floor(code.try_cast("int") / 1000).cast("int")
    region = F.coalesce(map_values(thousands, POSTAL_REGIONS), F.lit("Unknown"))
    return F.when(code.isNotNull(), region)


def zero_padded(value: Column, width: int) -> Column:
    """Small integer code to a string of fixed width."""
    return F.lpad(value.cast("string"), width, "0")
