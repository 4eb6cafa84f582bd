"""Writers: balance report as CSV, deliveries by period, upsert of entities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lifeframe.functions import periods as P
from lifeframe.operators.balance import IMBALANCE_THRESHOLD, balance_summary
from lifeframe.sources.buckets import BucketedTable


def balance_report(metrics: DataFrame, threshold: float = IMBALANCE_THRESHOLD) -> DataFrame:
    """Report lines: metrics by falling absolute difference, then the summary, all in one shape."""
    def fixed(c: str):
        return F.format_string("%.6f", F.col(c))

    lines = metrics.select(
        F.lit(0).alias("_part"), (-F.abs("smd")).alias("_order"),
        F.col("name").alias("Covariate"),
        F.when(F.col("categorical"), "Categorical").otherwise("Continuous").alias("Type"),
        fixed("case_mean").alias("Case Mean"), fixed("control_mean").alias("Control Mean"),
        fixed("case_sd").alias("Case SD"), fixed("control_sd").alias("Control SD"), fixed("smd").alias("Std Diff"),
    )
    labels = (
        ("Total covariates", F.col("total_covariates").cast("string")),
        (f"Imbalanced covariates (std diff > {threshold})", F.col("imbalanced_covariates").cast("string")),
        ("Maximum standardized difference", fixed("max_smd")),
        ("Mean absolute standardized difference", fixed("mean_abs_smd")),
    )
    stacked = [part for i, (label, value) in enumerate(labels) for part in (F.lit(float(i)), F.lit(label), value)]
    summary = balance_summary(metrics, threshold).select(
        F.lit(1).alias("_part"), F.stack(F.lit(len(labels)), *stacked).alias("_order", "Covariate", "Type")
    )
    return lines.unionByName(summary, allowMissingColumns=True)


def write_balance_csv(metrics: DataFrame, path: str, threshold: float = IMBALANCE_THRESHOLD) -> None:
    """One CSV file with header. A report has a few lines per covariate, so a single partition is right."""
    report = balance_report(metrics, threshold).coalesce(1).sortWithinPartitions("_part", "_order", "Covariate")
    report.drop("_part", "_order").write.option("header", "true").mode("errorifexists").csv(path)


def write_periods(rows: DataFrame, path: str, period: str = "period") -> None:
    """Write rows into one directory per period, named by its label; readers prune on it."""
    rows.withColumn("_label", P.period_label(F.col(period))).drop(period).withColumnRenamed("_label", "delivery").write.partitionBy(
        "delivery"
    ).parquet(path)


def upsert(current: DataFrame, incoming: DataFrame, key: str = "pnr", order: Column | None = None) -> DataFrame:
    """Rows of ``incoming`` replace those of ``current`` with the same id; new ids are added.

    An id that comes in several times is stored once: the last by ``order``, of equal ones the largest row.
    """
    kept = current.join(incoming.select(key), key, "left_anti")
    others = [c for c in current.columns if c != key]
    last = F.max_by(F.struct(*others), F.struct(*([order] if order is not None else []), *others))
    one = incoming.groupBy(key).agg(last.alias("_row")).select(key, *(F.col("_row")[c].alias(c) for c in others))
    return kept.unionByName(one.select(*current.columns))


def upsert_stored(table: BucketedTable, incoming: DataFrame, order: Column | None = None) -> set[int]:
    """``upsert`` into a stored table: only buckets with incoming ids are read and rewritten; gives these buckets."""
    return table.change(incoming, lambda current, rows: upsert(current, rows, table.key, order))


def from_batch(df: DataFrame, columns: list[str], key: str = "pnr") -> DataFrame:
    """Entity rows from a frame: the entity's columns, rows without an id dropped."""
    return df.select(*columns).filter(F.col(key).isNotNull())
