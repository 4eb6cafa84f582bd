"""Severe chronic disease: rule table, per-person result, severity scores."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lifeframe.functions import codes

# Category, congenital (y/n), severity, then code prefixes; ranges are inclusive.
# Four-character prefixes are tried before three-character ones.
RULES = """
1  n 2 D610 D613 D618 D619 D762
4  n 2 G310 G318 G319 G702 G811 G821 G824 G941
4  n 3 G710 G711 G712 G713 G736
6  n 3 J448
4  y 2 P910 P911 P912 P941-P949
6  y 2 Q790
7  y 2 Q792 Q793
10 y 2 Q860
2  n 2 D80-D84 D86 D89
1  n 2 D55 D56 D58-D61 D64-D73 D76
1  n 3 D57
3  n 2 E10 E22-E27 E31 E34 E70-E72 E74-E80 E83 E85 E88
3  n 3 E84
4  n 2 F84
4  n 2 G11 G13 G23-G25 G31 G37 G40 G41 G60 G70 G72 G80-G82 G91
4  n 3 G12 G71
5  n 2 I12 I27 I30-I49 I51 I52 I81-I83
5  n 3 I50
6  n 1 J45
6  n 2 J41-J43 J47 J60-J70 J84
6  n 3 J44 J96
7  n 1 K21
7  n 2 K50 K51 K70-K73 K75-K77 K86 K87 K90
7  n 3 K74
8  n 2 M05-M09 M30 M31 M33 M35 M40-M43 M45 M46
8  n 3 M32 M34
9  n 2 N01-N08 N11-N16 N18-N29
6  y 2 P27
4  y 2 P57 P91 P94
4  y 3 Q01-Q07
5  y 3 Q20-Q28
6  y 2 Q30-Q37
7  y 2 Q38-Q45
9  y 2 Q60-Q64
8  y 2 Q77-Q79
10 y 2 Q80-Q89
10 y 3 Q90-Q99
"""
# Kidney disease is severe from stage 4 on; any code of letter C is category 1, severe.
STAGED_PREFIXES, SEVERE_STAGE = ("N18", "N19"), 4
CANCER_LETTER, CANCER_CATEGORY, CANCER_SEVERITY = "C", 1, 3

CATEGORIES = tuple(range(1, 11))


def rule_rows() -> list[tuple[str, int, bool, int]]:
    """``(prefix, category, congenital, severity)``, ranges expanded."""
    rows = []
    for line in RULES.strip().splitlines():
        category, congenital, severity, *prefixes = line.split()
        for item in prefixes:
            first, _, last = item.partition("-")
            letter, width = first[0], len(first) - 1
            for number in range(int(first[1:]), int((last or first)[1:]) + 1):
                rows.append((f"{letter}{number:0{width}d}", int(category), congenital == "y", int(severity)))
    return rows


def rule_table(spark: SparkSession) -> DataFrame:
    """The rules as a literal relation of the plan."""
    values = ", ".join(f"('{p}', {c}, {str(g).lower()}, {s})" for p, c, g, s in rule_rows())
    return spark.sql(f"select * from values {values} as rules(prefix, category, congenital, severity)")


def categorize(df: DataFrame, code: str = "diagnosis_code") -> DataFrame:
    """Adds ``category``, ``congenital`` and ``severity``; all null for codes that are not chronic.

    The rules are a fixed table of 270 rows, broadcast twice: once for each prefix length.
    """
    rules = rule_table(df.sparkSession)
    cleaned = F.upper(F.trim(F.col(code)))

    def keyed(length: int) -> DataFrame:
        return F.broadcast(
            rules.filter(F.length("prefix") == length).select(
                F.col("prefix").alias(f"_p{length}"), F.struct("category", "congenital", "severity").alias(f"_r{length}")
            )
        )

    joined = (
        df.withColumn("_code", cleaned)
        .join(keyed(4), F.substring("_code", 1, 4) == F.col("_p4"), "left")
        .join(keyed(3), F.substring("_code", 1, 3) == F.col("_p3"), "left")
    )
    cancer = F.when(
        F.col("_code").startswith(CANCER_LETTER),
        F.struct(
            F.lit(CANCER_CATEGORY).alias("category"),
            F.lit(False).alias("congenital"),
            F.lit(CANCER_SEVERITY).alias("severity"),
        ),
    )
    rule = F.coalesce("_r4", "_r3", cancer)
    stage = F.substring("_code", 4, 1)
    staged = F.substring("_code", 1, 3).isin(list(STAGED_PREFIXES)) & stage.between(str(SEVERE_STAGE), "9")
    return joined.withColumns(
        {
            "category": rule["category"],
            "congenital": rule["congenital"],
            "severity": F.when(staged, F.lit(3)).otherwise(rule["severity"]),
        }
    ).drop("_code", "_p4", "_r4", "_p3", "_r3")


@dataclass(frozen=True)
class ChronicConfig:
    """Study window, age range in days/365 at diagnosis, congenital diseases in or out.

    ``severity="rule"`` takes the severity of the rule table, ``"row"`` the row's own ``severity`` column.
    """

    start: dt.date | None = None
    end: dt.date | None = None
    min_age: int | None = None
    max_age: int | None = None
    include_congenital: bool = True
    severity: str = "rule"


def category_list(mask: Column) -> Column:
    """The categories whose bit is set, ascending."""
    return F.filter(F.array(*(F.lit(c) for c in CATEGORIES)), lambda c: F.getbit(mask, c) == 1)


def chronic_results(
    diagnoses: DataFrame, config: ChronicConfig | None = None, births: DataFrame | None = None
) -> DataFrame:
    """One row per person with a diagnosis: flag, first date, categories, worst severity, congenital, diagnosis count,
    and the first date of any diagnosis.

    A diagnosis counts when it is chronic and inside the window and age range; an unknown date or birth
    skips that test. Every diagnosis counts for ``hospitalization_count``.

    Everything is one partially aggregated pass with fixed-width buffers (categories travel as a bit mask),
    so a person with very many rows costs no more than others. Only an age range needs birth dates; rows are
    then first reduced to distinct (person, code, date), which keeps such a person small in that join.
    """
    config = config or ChronicConfig()
    own = config.severity == "row"
    needs_age = births is not None and (config.min_age is not None or config.max_age is not None)
    rows = diagnoses.filter(F.col("pnr").isNotNull()).withColumn("_n", F.lit(1).cast("long"))
    if own:
        rows = rows.withColumn("_own", F.col("severity"))
    if needs_age:
        carried = [F.max("_own").alias("_own")] if own else []
        rows = rows.groupBy("pnr", "diagnosis_code", "diagnosis_date").agg(F.sum("_n").alias("_n"), *carried)
    rows = categorize(rows)
    date = F.col("diagnosis_date")
    tests = [F.col("category").isNotNull()]
    if config.start is not None:
        tests.append(F.coalesce(date >= F.lit(config.start), F.lit(True)))
    if config.end is not None:
        tests.append(F.coalesce(date <= F.lit(config.end), F.lit(True)))
    if needs_age:
        one = births.groupBy("pnr").agg(F.min("birth_date").alias("_birth"))
        rows = rows.join(one, "pnr", "left")
        age = (F.datediff("diagnosis_date", "_birth") / 365).cast("int")
        if config.min_age is not None:
            tests.append(F.coalesce(age >= config.min_age, F.lit(True)))
        if config.max_age is not None:
            tests.append(F.coalesce(age <= config.max_age, F.lit(True)))
    if not config.include_congenital:
        tests.append(~F.col("congenital"))
    counts = reduce(lambda a, b: a & b, tests)
    severity = F.col("_own") if own else F.col("severity")
    result = rows.groupBy("pnr").agg(
        F.bool_or(counts).alias("has_scd"),
        F.min(F.when(counts, date)).alias("first_scd_date"),
        F.coalesce(F.bit_or(F.when(counts, F.call_function("shiftleft", F.lit(1), F.col("category")))), F.lit(0)).alias("category_mask"),
        F.coalesce(F.max(F.when(counts, severity)), F.lit(0)).alias("max_severity"),
        F.bool_or(counts & F.coalesce("congenital", F.lit(False))).alias("has_congenital"),
        F.sum("_n").alias("hospitalization_count"),
        F.min("diagnosis_date").alias("first_diagnosis_date"),
    )
    return result.withColumns(
        {"scd_categories": category_list(F.col("category_mask")), "category_count": F.bit_count("category_mask")}
    )


def hospitalization_severity(count: Column) -> Column:
    return F.when(count >= 5, F.lit(3)).when(count >= 2, F.lit(2)).otherwise(F.lit(1))


def category_severity(count: Column) -> Column:
    """Two affected categories are moderate, more are severe."""
    return F.when(count > 2, F.lit(3)).when(count == 2, F.lit(2)).otherwise(F.lit(1))


def category_severity_coarse(count: Column) -> Column:
    """The per-person variant: more than one category is severe."""
    return F.when(count > 1, F.lit(3)).otherwise(F.lit(1))


def onset_severity(age: Column) -> Column:
    """Null for an unknown age."""
    return F.when(age < 2, F.lit(3)).when(age < 10, F.lit(2)).when(age.isNotNull(), F.lit(1))


def combined_severity(*scores: Column) -> Column:
    """The worst of the known scores."""
    return F.greatest(*scores)


def with_severity_scores(results: DataFrame, onset_age: Column | None = None, coarse: bool = False) -> DataFrame:
    by_category = category_severity_coarse if coarse else category_severity
    scores = {
        "hospitalization_severity": hospitalization_severity(F.col("hospitalization_count")),
        "category_severity": by_category(F.col("category_count")),
    }
    if onset_age is not None:
        scores["onset_severity"] = onset_severity(onset_age)
    scored = results.withColumns(scores)
    return scored.withColumn("combined_severity", combined_severity(F.col("max_severity"), *(F.col(s) for s in scores)))


def affected(results: DataFrame) -> DataFrame:
    return results.filter("has_scd")


def unaffected(results: DataFrame) -> DataFrame:
    return results.filter(~F.col("has_scd"))


def in_category(results: DataFrame, category: int) -> DataFrame:
    return results.filter(F.getbit("category_mask", F.lit(category)) == 1)


def at_least(results: DataFrame, severity: int) -> DataFrame:
    return results.filter(F.col("has_scd") & (F.col("max_severity") >= severity))


def severity_counts(scored: DataFrame) -> DataFrame:
    """Affected persons by combined severity."""
    return affected(scored).groupBy("combined_severity").agg(F.count(F.lit(1)).alias("persons"))


def with_category_names(df: DataFrame) -> DataFrame:
    return df.withColumn("category_name", codes.decode(F.col("category"), "scd_category"))
