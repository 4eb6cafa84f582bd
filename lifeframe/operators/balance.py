"""Covariate balance between cases and controls."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lifeframe.session import materialize

MIN_OBSERVATIONS = 5
IMBALANCE_THRESHOLD = 0.1


def standardized_difference(mean1: Column, mean0: Column, sd1: Column, sd0: Column) -> Column:
    """Difference of means over the root of the mean variance; 0 when neither side varies."""
    pooled = F.sqrt((sd1 * sd1 + sd0 * sd0) / 2)
    return F.when(pooled > 0, (mean1 - mean0) / pooled).otherwise(F.lit(0.0))


_NUMBER, _TEXT, _FLAG, _ROWS = "number", "text", "flag", "rows"
_KINDS = ((_NUMBER, T.NumericType), (_TEXT, T.StringType), (_FLAG, T.BooleanType))
Sides = Mapping[str, tuple[Column, Column]]


def _kinds_of(schema: T.StructType, exclude: Iterable[str]) -> dict[str, str]:
    """How each column is compared; dates and nested columns are not supported and left out."""
    left_out = set(exclude)
    found = {f.name: next((k for k, t in _KINDS if isinstance(f.dataType, t)), None) for f in schema.fields if f.name not in left_out}
    return {name: kind for name, kind in found.items() if kind}


def count_values(rows: DataFrame, sides: Sides, kinds: Mapping[str, str]) -> DataFrame:
    """Everything that balance needs, from one pass: a row per column, and per value of a text column, with ``n1, m1, s1, n0, m0, s0`` of each comparison.

    ``sides`` names comparisons and says of a row whether it is a case and whether it is a control in it; a row may be both, or in several.
    Counts, means and deviations are merged from partial results of each task, so the shuffle has a row per task, column and text value.
    """
    def entry(name: str, kind: str) -> Column:
        number = text = F.lit(None)
        if kind == _NUMBER:
            value = F.col(name).cast("double")
            number = F.when(~F.isnan(value) & (F.abs(value) < F.lit(float("inf"))), value)
        elif kind == _FLAG:
            number = F.col(name).cast("double")
        elif kind == _TEXT:
            text = F.col(name)
        else:
            number = F.lit(1.0)
        return F.struct(F.lit(name).alias("column"), F.lit(kind).alias("kind"), number.cast("double").alias("number"), text.cast("string").alias("text"))

    entries = [entry("", _ROWS), *(entry(name, kind) for name, kind in kinds.items())]
    flags = {f"_{i}_{side}": F.coalesce(hit, F.lit(False)) for i, pair in enumerate(sides.values()) for side, hit in zip((1, 0), pair)}
    long = rows.select(*(c.alias(n) for n, c in flags.items()), F.explode(F.array(*entries)).alias("_e")).select(*flags, "_e.*")
    known = F.col("number").isNotNull() | F.col("text").isNotNull()
    aggregates = []
    for flag in flags:
        number = F.when(F.col(flag), F.col("number"))
        aggregates += [
            F.count_if(F.col(flag) & known).alias(f"n{flag}"), F.avg(number).alias(f"m{flag}"), F.coalesce(F.stddev_samp(number), F.lit(0.0)).alias(f"s{flag}")
        ]
    # A row for each column of each comparison; what has no value on either side falls out by its counts.
    counted = long.groupBy("column", "kind", "text").agg(*aggregates)
    parts = [
        F.struct(F.lit(name).alias("comparison"), *(F.col(f"{v}_{i}_{side}").alias(f"{v}{side}") for side in (1, 0) for v in ("n", "m", "s")))
        for i, name in enumerate(sides)
    ]
    return counted.select("column", "kind", "text", F.explode(F.array(*parts)).alias("_p")).select("column", "kind", "text", "_p.*")


def _metrics(counted: DataFrame, minimum: int) -> DataFrame:
    """``comparison`` and metrics of each column; columns with too few values are left out.

    Of a text column the category counts that is most common over both sides; of equal ones the first by name.
    """
    texts = counted.filter((F.col("kind") == _TEXT) & F.col("text").isNotNull())
    top = texts.groupBy("comparison", "column").agg(
        F.sum("n1").alias("n1"), F.sum("n0").alias("n0"),
        F.min(F.struct((-(F.col("n1") + F.col("n0"))).alias("order"), F.col("text"), F.col("n1").alias("k1"), F.col("n0").alias("k0"))).alias("top"),
    )
    categories = top.select(
        "comparison", F.concat_ws("_", "column", "top.text").alias("name"), F.lit(True).alias("categorical"), "n1", "n0",
        F.try_divide("top.k1", "n1").alias("m1"), F.try_divide("top.k0", "n0").alias("m0"),
    )
    flags = counted.filter(F.col("kind") == _FLAG).select(
        "comparison", F.concat_ws("_", "column", F.lit("TRUE")).alias("name"), F.lit(True).alias("categorical"), "n1", "n0", "m1", "m0"
    )
    shares = categories.unionByName(flags).withColumns({f"s{k}": F.sqrt(F.col(f"m{k}") * (1 - F.col(f"m{k}"))) for k in (1, 0)})
    numbers = counted.filter(F.col("kind") == _NUMBER).select(
        "comparison", F.col("column").alias("name"), F.lit(False).alias("categorical"), "n1", "n0", "m1", "m0", "s1", "s0"
    )
    enough = (F.col("n1") >= minimum) & (F.col("n0") >= minimum)
    return numbers.unionByName(shares.select(*numbers.columns)).filter(enough).select(
        "comparison", "name", "categorical", F.col("m1").alias("case_mean"), F.col("m0").alias("control_mean"),
        F.col("s1").alias("case_sd"), F.col("s0").alias("control_sd"),
        standardized_difference(F.col("m1"), F.col("m0"), F.col("s1"), F.col("s0")).alias("smd"),
    )


def balance_of(rows: DataFrame, sides: Sides, exclude: Iterable[str] = ("pnr",), minimum: int = MIN_OBSERVATIONS) -> DataFrame:
    """Balance of all columns in several comparisons, each with its ``comparison`` name, from one pass over ``rows``.

    A comparison without cases or without controls is an error. What is stored in between has a row per column and text value.
    """
    kinds = _kinds_of(rows.schema, exclude)
    if not kinds:
        raise ValueError("no column both sides have can be compared")
    counted = materialize(count_values(rows, sides, kinds), "balance")
    empty = {r.comparison for r in counted.filter((F.col("kind") == _ROWS) & (F.col("n1") > 0) & (F.col("n0") > 0)).collect()} ^ set(sides)
    if empty:
        raise ValueError("no cases or no controls" + "".join(f" in {name}" for name in sorted(empty) if name))
    return _metrics(counted, minimum)


def _both(cases: DataFrame, controls: DataFrame, columns: Iterable[str]) -> tuple[DataFrame, Sides]:
    wanted = list(columns)
    rows = cases.select(*wanted, F.lit(True).alias("_case")).unionByName(controls.select(*wanted, F.lit(False).alias("_case")))
    return rows, {"": (F.col("_case"), ~F.col("_case"))}


def _of_kind(cases: DataFrame, controls: DataFrame, columns: Iterable[str], kind: str, minimum: int) -> DataFrame:
    wanted = list(columns)
    rows, sides = _both(cases, controls, wanted)
    return _metrics(count_values(rows, sides, {c: kind for c in wanted}), minimum).drop("comparison")


def numeric_balance(cases: DataFrame, controls: DataFrame, columns: Iterable[str], minimum: int = MIN_OBSERVATIONS) -> DataFrame:
    """Means and sample deviations of finite values."""
    return _of_kind(cases, controls, columns, _NUMBER, minimum)


def categorical_balance(cases: DataFrame, controls: DataFrame, columns: Iterable[str], minimum: int = MIN_OBSERVATIONS) -> DataFrame:
    """Share of the category that is most common over both groups; of equal ones the first by name."""
    return _of_kind(cases, controls, columns, _TEXT, minimum)


def boolean_balance(cases: DataFrame, controls: DataFrame, columns: Iterable[str], minimum: int = MIN_OBSERVATIONS) -> DataFrame:
    """Share of true values."""
    return _of_kind(cases, controls, columns, _FLAG, minimum)


def balance(
    cases: DataFrame, controls: DataFrame, exclude: Iterable[str] = ("pnr",), minimum: int = MIN_OBSERVATIONS
) -> DataFrame:
    """Balance of every column both sides have; dates and nested columns are not supported and left out."""
    shared = [f.name for f in cases.schema.fields if f.name in controls.columns]
    rows, sides = _both(cases, controls, shared)
    return balance_of(rows, sides, (*exclude, "_case"), minimum).drop("comparison")


def balance_summary(metrics: DataFrame, threshold: float = IMBALANCE_THRESHOLD) -> DataFrame:
    """One row: covariates, imbalanced ones, largest and mean absolute difference."""
    size = F.abs("smd")
    return metrics.agg(
        F.count(F.lit(1)).alias("total_covariates"),
        F.count_if(size > threshold).alias("imbalanced_covariates"),
        F.coalesce(F.max(size), F.lit(0.0)).alias("max_smd"),
        F.coalesce(F.avg(size), F.lit(0.0)).alias("mean_abs_smd"),
    )
