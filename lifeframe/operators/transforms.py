"""Column transforms and user functions over frames."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lifeframe.functions import codes


def add_year(df: DataFrame, date_column: str, name: str = "year") -> DataFrame:
    return df.withColumn(name, F.year(date_column))


def map_categories(df: DataFrame, column: str, mapping: Mapping[object, object]) -> DataFrame:
    """Replace values by their entry; values without an entry become null."""
    return df.withColumn(column, codes.map_values(F.col(column), mapping))


def scale(df: DataFrame, column: str, factor: float) -> DataFrame:
    return df.withColumn(column, F.col(column).cast("double") * F.lit(float(factor)))


def add_postal_region(df: DataFrame, column: str, name: str = "region") -> DataFrame:
    return df.withColumn(name, codes.postal_region(F.col(column)))


def transform_batches(
    df: DataFrame, function: Callable[[pd.DataFrame], pd.DataFrame], schema: T.StructType | str
) -> DataFrame:
    """Apply a user function to each batch of rows; empty results are dropped."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            result = function(batch)
            if len(result):
                yield result

    return df.mapInPandas(run, schema)


def filter_with(df: DataFrame, predicate: Callable[[pd.DataFrame], pd.Series], columns: list[str]) -> DataFrame:
    """Keep rows an opaque Python predicate accepts; only ``columns`` travel to Python."""
    @F.pandas_udf("boolean")
    def accept(batch: pd.DataFrame) -> pd.Series:
        return predicate(batch).fillna(False).astype(bool)

    return df.filter(accept(F.struct(*columns)))


def derive(df: DataFrame, column: str, function: Callable[[pd.Series], pd.Series], data_type: str, name: str) -> DataFrame:
    """A new column from a user value function; prefer a Column expression where one exists."""
    return df.withColumn(name, F.pandas_udf(function, data_type)(F.col(column)))


def pipeline(df: DataFrame, *steps: Callable[[DataFrame], DataFrame]) -> DataFrame:
    for step in steps:
        df = df.transform(step)
    return df


def where(df: DataFrame, predicate: Callable[[DataFrame], Column]) -> DataFrame:
    """Row predicate closure: a function from the frame to a boolean Column."""
    return df.filter(predicate(df))
