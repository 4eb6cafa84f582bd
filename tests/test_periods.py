import datetime as dt

import pytest
from pyspark.sql import functions as F

from lifeframe.functions import periods as P
from lifeframe.sources import deliveries

D = dt.date


def labels(spark, texts, function):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [r[0] for r in df.orderBy("i").select(P.period_label(function(F.col("t")))).collect()]


def test_whole_names(spark):
    texts = ["2020", "202001", "2020-01", "2020Q1", "2020-Q2", "202013", "2020Q5", "x"]
    assert labels(spark, texts, P.lenient_period) == ["2020", "202001", "202001", "2020Q1", "2020Q2", None, None, None]


def test_file_names(spark):
    texts = ["d/2020.parquet", "d/bef_2020.parquet", "d/202001.parquet", "d/bef_202001.parquet", "d/2020-Q1.parquet"]
    assert labels(spark, texts, P.period_of_path) == ["2020", "2020", "202001", "202001", "2020Q1"]


def test_paths_spark_wrote(spark):
    texts = ["file:/d/bef/2020.parquet/part-0001-a.snappy.parquet", "file:/d/bef/delivery=2020Q3/part-0001-a.parquet"]
    assert labels(spark, texts, P.period_of_path) == ["2020", "2020Q3"]


def test_strict_first_then_lenient(spark):
    texts = ["d/20200101.parquet", "d/20201301.parquet"]
    assert labels(spark, texts, P.period_of_path) == ["20200101", None]
    assert labels(spark, ["20200101"], P.lenient_period) == ["202001"]
    assert labels(spark, ["2020-01", "bef_2020"], P.strict_period) == [None, None]


@pytest.mark.parametrize(
    ("token", "start", "end"),
    [
        ("2020", D(2020, 1, 1), D(2020, 12, 31)), ("202002", D(2020, 2, 1), D(2020, 2, 29)),
        ("2021-02", D(2021, 2, 1), D(2021, 2, 28)), ("2020Q1", D(2020, 1, 1), D(2020, 3, 31)),
        ("2020Q4", D(2020, 10, 1), D(2020, 12, 31)),
    ],
)
def test_bounds(spark, token, start, end):
    row = spark.range(1).select(P.lenient_period(F.lit(token)).alias("p")).first().p
    assert (row.start, row.end) == (start, end)


def test_contains(spark):
    days = [D(2020, 1, 1), D(2020, 6, 15), D(2020, 12, 31), D(2019, 12, 31), D(2021, 1, 1)]
    df = spark.createDataFrame([(i, d) for i, d in enumerate(days)], "i int, d date")
    period = P.lenient_period(F.lit("2020"))
    assert [r[0] for r in df.orderBy("i").select(P.period_contains(period, F.col("d"))).collect()] == [True, True, True, False, False]


def test_display(spark):
    df = spark.createDataFrame([("2018",), ("201803",), ("2018Q1",), ("20180301",)], "t string")
    shown = [r[0] for r in df.select(P.period_display(P.strict_period(F.col("t")))).collect()]
    assert shown == ["2018", "2018-03", "2018-Q1", "2018-03-01"]


def test_year_of_hospital_file(spark):
    df = spark.createDataFrame([("a/2005.parquet",), ("a/lpr_adm_2006.parquet",), ("a/lpr2007.parquet",)], "path string")
    assert [r[0] for r in df.select(P.year_of_file(F.col("path"))).collect()] == [2005, 2006, None]


def test_latest_and_range(spark, rows):
    files = spark.createDataFrame([("r/bef/2019.parquet",), ("r/bef/202003.parquet",), ("r/bef/notes.parquet",)], "path string")
    assert rows(deliveries.latest_period(files).select("registry", P.period_label(F.col("period")))) == [("BEF", "202003")]
    kept = deliveries.files_in_range(files, D(2019, 12, 31), D(2020, 2, 1))
    assert rows(kept, "path") == [("r/bef/2019.parquet",)]


def test_no_hospital_files_is_an_error(spark):
    files = spark.createDataFrame([("r/bef/2019.parquet",)], "path string")
    with pytest.raises(ValueError, match="no hospital"):
        deliveries.hospital_availability(files)
    files = spark.createDataFrame([("r/lpr_adm/2019.parquet",), ("r/lpr_diag/2019.parquet",)], "path string")
    assert deliveries.hospital_availability(files) == {"lpr2": True, "lpr3": False}
