import datetime as dt
import glob
import os
import time

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lifeframe.functions import dates
from lifeframe.operators import mapping
from lifeframe.sources import adapt, files, scan, schemas, sinks, specs
from lifeframe.sources.catalog import RegisterCatalog

D = dt.date


def one(spark, column):
    return spark.range(1).select(column).first()[0]


@pytest.mark.parametrize(
    ("text", "day"),
    [
        ("2023-01-15", D(2023, 1, 15)), ("15-01-2023", D(2023, 1, 15)), ("01/15/2023", D(2023, 1, 15)),
        ("15/01/2023", D(2023, 1, 15)), ("01/02/2023", D(2023, 1, 2)), ("15.01.2023", D(2023, 1, 15)),
        ("20230115", D(2023, 1, 15)), ("15 Jan 2023", D(2023, 1, 15)), ("15 january 2023", D(2023, 1, 15)),
        ("2023/01/15", D(2023, 1, 15)), ("junk", None), ("2023-02-30", None), (None, None),
    ],
)
def test_date_formats(spark, text, day):
    assert one(spark, dates.parse_date(F.lit(text).cast("string"))) == day


def test_day_first_when_configured(spark):
    assert one(spark, dates.parse_date(F.lit("01/02/2023"), ("d/M/yyyy", "M/d/yyyy"))) == D(2023, 2, 1)


def test_formats_with_other_letters(spark):
    assert one(spark, dates.parse_date(F.lit("15-01-23"), ("dd-MM-yy",))) == D(2023, 1, 15)


@pytest.mark.parametrize("text", ["01JAN2020", "01jan2020", "01Jan2020", "01/01/2020", "20200101", "2020-01-01"])
def test_register_dates(spark, text):
    assert one(spark, dates.parse_register_date(F.lit(text))) == D(2020, 1, 1)


def test_compatibility():
    check = adapt.compatibility
    assert check(T.IntegerType(), T.IntegerType()) == "exact"
    assert check(T.IntegerType(), T.LongType()) == "compatible"
    assert check(T.LongType(), T.IntegerType()) == "incompatible"
    assert check(T.LongType(), T.DoubleType()) == "compatible"
    assert check(T.LongType(), T.FloatType()) == "incompatible"
    assert check(T.StringType(), T.DateType()) == "compatible"
    assert check(T.BooleanType(), T.StringType()) == "compatible"
    assert check(T.StringType(), T.IntegerType()) == "incompatible"
    assert adapt.strategy(T.StringType(), T.DateType()) == "date_parsing"
    assert adapt.strategy(T.DateType(), T.StringType()) == "date_formatting"
    assert adapt.strategy(T.BooleanType(), T.IntegerType()) == "boolean_conversion"


def test_adapt(spark, rows):
    df = spark.createDataFrame([("1", "2020-05-01", 3)], "a string, d string, n int")
    target = T.StructType([T.StructField("d", T.DateType()), T.StructField("n", T.LongType()), T.StructField("x", T.StringType())])
    assert rows(adapt.adapt(df, target)) == [(D(2020, 5, 1), 3, None)]
    with pytest.raises(ValueError, match="incompatible"):
        adapt.adapt(df, T.StructType([T.StructField("a", T.IntegerType())]))
    report = adapt.adaptation_report(spark, df.schema, target)
    assert rows(report, "field", "status", "strategy") == [
        ("d", "compatible", "date_parsing"), ("n", "compatible", "numeric_conversion"), ("x", "missing", None),
    ]


def test_required_column(spark):
    df = spark.createDataFrame([(1,)], "a int")
    with pytest.raises(ValueError, match="required"):
        adapt.fetch(df, ["PNR"], T.StringType(), required=True)


def test_register_recognition():
    assert specs.register_from_path("/data/lpr3_diagnoser").name == "lpr3_diagnoser"
    assert specs.register_from_path("/data/dodsaarsag/").name == "dodsaarsag"
    assert specs.register_from_path("/data/DOD").name == "dod"
    with pytest.raises(ValueError):
        specs.register_from_path("/data/other")
    assert specs.register_from_columns(["PNR", "PERINDKIALT_13"]).name == "ind"
    assert specs.register_from_columns(["PNR", "RECNUM"]).name == "lpr_adm"
    assert specs.register_from_columns(["PNR"]).name == "bef"
    assert specs.register("BEF").schema["FOED_DAG"].dataType == T.DateType()


def test_rows_without_id_are_dropped_and_aliases_read(spark, rows):
    df = spark.createDataFrame([("1", 2, D(2000, 1, 1)), (None, 1, None), (" ", 1, None)], "PNR string, HAEND_KODE int, HAEND_DATO date")
    assert rows(mapping.map_register(df, specs.register("vnds"))) == [("1", "2", D(2000, 1, 1))]
    renamed = df.withColumnsRenamed({"HAEND_KODE": "INDUD_KODE"})
    assert rows(mapping.map_register(renamed, specs.register("vnds"))) == [("1", "2", D(2000, 1, 1))]


def test_unreadable_numbers_become_null(spark, rows):
    df = spark.createDataFrame([("1", "12", "x")], "PNR string, HF_KILDE string, HFAUDD string")
    mapped = mapping.map_register(df, specs.register("uddf"))
    assert rows(mapped, "education_source", "education_code") == [(12, None)]


def test_user_declared_register(spark, tmp_path, rows):
    path = str(tmp_path / "own")
    spark.createDataFrame([("7", "3")], "ID string, V string").write.parquet(path)
    spec = specs.RegisterSpec(
        "own", "ID",
        (specs.RegisterField("ID", "pnr"), specs.RegisterField("V", "value", "int", expression=F.col("V").cast("int") * 2)),
    )
    assert rows(mapping.map_register(scan.read_parquet(spark, path), spec)) == [("7", 6)]


def write_years(spark, path):
    rows_ = [("1", 2019, 10.0), ("2", 2019, 20.0), ("1", 2020, 30.0)]
    df = spark.createDataFrame(rows_, "PNR string, YEAR int, PERINDKIALT_13 double")
    for year in (2019, 2020):
        df.filter(F.col("YEAR") == year).write.parquet(f"{path}/ind/{year}.parquet")
    return f"{path}/ind"


def files_read(df):
    """How many files the scans of a frame opened."""
    df.collect()
    plan, found = df._jdf.queryExecution().executedPlan(), 0
    waiting = [plan]
    while waiting:
        node = waiting.pop()
        while (kind := node.getClass().getSimpleName()) == "AdaptiveSparkPlanExec" or kind.endswith("QueryStageExec"):
            node = node.executedPlan() if kind == "AdaptiveSparkPlanExec" else node.plan()
        if node.getClass().getSimpleName() == "FileSourceScanExec":
            found += node.metrics().apply("numFiles").value()
        children = node.children()
        waiting += [children.apply(i) for i in range(children.size())]
    return found


def test_period_scan(spark, tmp_path, rows):
    path = write_years(spark, str(tmp_path))
    everything = scan.read_periods(spark, path, "ind", with_source=True)
    assert rows(everything, "PNR", "period.year", "source") == [
        ("1", 2019, "ind_2019_2"), ("1", 2020, "ind_2020_1"), ("2", 2019, "ind_2019_2"),
    ]
    only = scan.read_periods(spark, path, "ind", D(2020, 3, 1), D(2021, 1, 1))
    assert rows(only, "PNR", "YEAR") == [("1", 2020)]
    assert files_read(only) == len(glob.glob(f"{path}/2020.parquet/*.parquet"))
    assert scan.read_periods(spark, path, "ind", period_label="1999").count() == 0
    cohort = spark.createDataFrame([("2",)], "pnr string")
    assert rows(scan.read_periods(spark, path, "ind", cohort=cohort), "PNR", "YEAR") == [("2", 2019)]


def test_scan_pushes_filter_and_columns(spark, tmp_path):
    path = write_years(spark, str(tmp_path))
    df = scan.read_parquet(spark, path, predicate=F.col("YEAR") == 2020, columns=["PNR", "YEAR"], recursive=True)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(YEAR,2020)" in plan
    assert "PERINDKIALT_13" not in plan


def test_catalog(spark, tmp_path, rows):
    path = write_years(spark, str(tmp_path))
    catalog = RegisterCatalog(spark)
    assert catalog.register_auto("income", path).name == "ind"
    cohort = spark.createDataFrame([("2",)], "pnr string")
    assert rows(catalog.load("income", cohort), "PNR") == [("2",)]
    assert catalog.names() == ["income"]


def test_catalog_reaches_persons_through_parent(spark, tmp_path, rows):
    adm = spark.createDataFrame([("1", "r1"), ("2", "r2")], "PNR string, RECNUM string")
    diag = spark.createDataFrame([("r1", "C50"), ("r2", "E10"), ("r3", "J45")], "RECNUM string, C_DIAG string")
    adm.write.parquet(f"{tmp_path}/lpr_adm")
    diag.write.parquet(f"{tmp_path}/lpr_diag")
    catalog = RegisterCatalog(spark)
    for name in ("lpr_adm", "lpr_diag"):
        catalog.register_auto(name, f"{tmp_path}/{name}")
    cohort = spark.createDataFrame([("2",)], "pnr string")
    assert rows(catalog.load("lpr_diag", cohort), "RECNUM", "C_DIAG") == [("r2", "E10")]


def test_schema_report_and_compatible_read(spark, tmp_path, rows):
    path = write_years(spark, str(tmp_path))
    spark.createDataFrame([("1", "x")], "PNR string, YEAR string").write.parquet(f"{tmp_path}/odd/2021.parquet")
    assert schemas.read_compatible(spark, [f"{path}/2019.parquet", f"{path}/2020.parquet"]).count() == 3
    with pytest.raises(ValueError, match="differs"):
        schemas.read_compatible(spark, [f"{path}/2019.parquet", f"{tmp_path}/odd/2021.parquet"])
    from lifeframe.sources.deliveries import list_files

    files = list_files(spark, str(tmp_path))
    footers = schemas.footers(files)
    reference = files.filter(F.col("path").contains("2019")).first().path
    issues = {r.issue for r in schemas.compare_footers(footers, reference).collect()}
    assert issues == {"field count: 2 instead of 3", "field 1 YEAR: string instead of int32"}


def test_upsert(spark, rows):
    old = spark.createDataFrame([("1", "a"), ("2", "b")], "pnr string, v string")
    new = spark.createDataFrame([("2", "c"), ("3", "d")], "pnr string, v string")
    assert rows(sinks.upsert(old, new)) == [("1", "a"), ("2", "c"), ("3", "d")]


@pytest.mark.parametrize("unit", ["s", "us"])
def test_times_of_day_become_seconds(spark, tmp_path, rows, unit):
    import pyarrow as pa
    import pyarrow.parquet as pq

    kind = pa.time32("s") if unit == "s" else pa.time64("us")
    table = pa.table({"CPR": ["1"], "DW_EK_KONTAKT": ["k"], "tidspunkt_start": pa.array([dt.time(10, 0, 1)], kind)})
    folder = tmp_path / "lpr3_kontakter"
    folder.mkdir()
    pq.write_table(table, folder / "2019.parquet")
    loaded = scan.read_register(spark, "lpr3_kontakter", str(folder))
    assert rows(loaded, "CPR", "tidspunkt_start") == [("1", 36001)]
    dated = scan.read_periods(spark, str(folder), "lpr3_kontakter")
    assert rows(dated, "CPR", "tidspunkt_start", "period.year") == [("1", 36001, 2019)]


def test_scratch_folder_must_be_shared_on_a_cluster():
    from lifeframe.session import choose_root

    assert choose_root("hdfs://store/scratch/", "yarn", "a") == "hdfs://store/scratch"
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        choose_root(None, "local-cluster[3,2,3000]", "a")
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        choose_root(None, "yarn", "a")
    assert choose_root(None, "local[2]", "a") == choose_root(None, "local[2]", "a")


def test_discard_deletes_only_scratch(spark, tmp_path):
    from lifeframe.session import discard, materialize

    kept = str(tmp_path / "kept")
    spark.range(3).write.parquet(kept)
    discard(spark.read.parquet(kept))
    assert spark.read.parquet(kept).count() == 3
    held = materialize(spark.range(3).toDF("a"), "gone")
    folder = held.inputFiles()[0].rsplit("/", 1)[0].removeprefix("file://")
    discard(held)
    assert not os.path.exists(folder)


def test_drifting_types_between_deliveries(spark, tmp_path, rows):
    """One scan per stored schema, each adapted: int to text, int to double, missing columns."""
    path = str(tmp_path / "akm")
    spark.createDataFrame([("1", 3)], "PNR string, SOCIO13 int").coalesce(1).write.parquet(f"{path}/2018.parquet")
    spark.createDataFrame([("2", "4")], "PNR string, SOCIO13 string").coalesce(1).write.parquet(f"{path}/2019.parquet")
    spark.createDataFrame([("3", 5)], "PNR string, SOCIO13 bigint").coalesce(1).write.parquet(f"{path}/2020.parquet")
    spark.createDataFrame([("4",)], "PNR string").coalesce(1).write.parquet(f"{path}/2021.parquet")
    df = scan.read_register(spark, "akm", path)
    kind = df.schema["SOCIO13"].dataType
    assert rows(df.select("PNR", F.col("SOCIO13").cast("string"))) == [("1", "3"), ("2", "4"), ("3", "5"), ("4", None)]
    dated = scan.read_periods(spark, path, "akm")
    assert dated.schema["SOCIO13"].dataType == kind
    assert rows(dated.select("PNR", "period.year")) == [("1", 2018), ("2", 2019), ("3", 2020), ("4", 2021)]
    plain = scan.read_parquet(spark, path, recursive=True)
    assert plain.schema["SOCIO13"].dataType == T.StringType() and plain.count() == 4


def test_unusual_stored_types(spark, tmp_path, rows):
    import decimal

    import pyarrow as pa
    import pyarrow.parquet as pq

    os.makedirs(tmp_path / "lpr3_kontakter")
    table = pa.table(
        {
            "CPR": pa.array(["1"]).dictionary_encode(), "DW_EK_KONTAKT": pa.array(["k1"]).dictionary_encode(),
            "prioritet": pa.array([decimal.Decimal("2.00")]), "tidspunkt_start": pa.array([3_723_000], pa.time32("ms")),
            "odd": pa.array([{"a": 1}]),
        }
    )
    pq.write_table(table, tmp_path / "lpr3_kontakter" / "2020.parquet")
    df = scan.read_register(spark, "lpr3_kontakter", str(tmp_path / "lpr3_kontakter"))
    got = df.first()
    assert (got["CPR"], got["DW_EK_KONTAKT"]) == ("1", "k1") and got["prioritet"] is not None
    bad = pa.table({"CPR": pa.array([{"a": 1}])})
    os.makedirs(tmp_path / "bad")
    pq.write_table(bad, tmp_path / "bad" / "2020.parquet")
    with pytest.raises(ValueError, match="CPR"):
        scan.read_register(spark, "lpr3_kontakter", str(tmp_path / "bad"))


def test_many_daily_files_plan_as_one_scan(spark, tmp_path):
    import time

    import pyarrow as pa
    import pyarrow.parquet as pq

    folder = tmp_path / "akm"
    os.makedirs(folder)
    for day in range(120):
        date = D(2020, 1, 1) + dt.timedelta(days=day)
        pq.write_table(pa.table({"PNR": [str(day)], "SOCIO13": ["1"]}), folder / f"{date:%Y%m%d}.parquet")
    started = time.perf_counter()
    df = scan.read_periods(spark, str(folder), "akm", D(2020, 1, 1), D(2020, 3, 31))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert time.perf_counter() - started < 10
    assert plan.count("FileScan parquet") == 1
    assert df.count() == 91
    assert df.filter("period.start = date'2020-02-29'").select("PNR").first()[0] == "59"


def test_delivery_called_part(spark, tmp_path):
    from lifeframe.sources import deliveries

    names = ["bef/part-2020.parquet", "bef/2019.parquet/part-00000-abcdefab-1.parquet", "bef/part-00001-12345678-2.parquet", "bef/notes.parquet"]
    files = spark.createDataFrame([(f"/data/{n}",) for n in names], "path string")
    dated = {r["path"][6:]: (r["registry"], r["period"]["year"]) for r in deliveries.with_period(files).collect()}
    assert dated == {names[0]: ("BEF", 2020), names[1]: ("BEF", 2019)}
    assert {r["path"][6:] for r in deliveries.undated(files).collect()} == {names[2], names[3]}


def test_register_from_last_folder():
    for path, name in (
        ("/srv/indata/uddf", "uddf"), ("/data/finder/vnds/", "vnds"), ("/dodsfald/akm", "akm"), ("/work/befolkning/ind", "ind"),
        ("/x/Foedselsregister", "mfr"), ("/x/uddannelse", "uddf"), ("/x/migration_2020", "vnds"),
    ):
        assert specs.register_from_path(path).name == name


def test_read_compatible_checks_every_file(spark, tmp_path):
    folder = str(tmp_path / "mixed")
    spark.createDataFrame([("1", 1)], "PNR string, A int").coalesce(1).write.parquet(folder)
    assert schemas.read_compatible(spark, [folder]).count() == 1
    spark.createDataFrame([("1", 1)], "PNR string, B int").coalesce(1).write.mode("append").parquet(folder)
    with pytest.raises(ValueError, match="differs"):
        schemas.read_compatible(spark, [folder])


def test_deliveries_named_and_computed_agree(spark, tmp_path, rows):
    """Folders and single files, up to the bound of names and beyond it; undated files and other periods are not opened."""
    path = str(tmp_path / "ind")
    df = spark.createDataFrame([(str(i), 2015 + i % 4, float(i)) for i in range(40)], "PNR string, YEAR int, PERINDKIALT_13 double").repartition(3)
    for year in (2015, 2016, 2017):
        df.filter(F.col("YEAR") == year).write.parquet(f"{path}/delivery={year}")
    df.filter("YEAR = 2018").toPandas().to_parquet(f"{path}/x+y z_2018.parquet")
    df.limit(1).selectExpr("PNR", "'odd' as YEAR", "PERINDKIALT_13").toPandas().to_parquet(f"{path}/notes.parquet")
    for options in ({}, {"start": D(2016, 5, 1)}, {"start": D(2016, 5, 1), "end": D(2017, 2, 2)}, {"period_label": "2018"}):
        few = scan.read_periods(spark, path, "ind", with_source=True, **options)
        many = scan.read_periods(spark, path, "ind", with_source=True, units=0, **options)
        got = rows(few, "PNR", "YEAR", "period", "source")
        assert got and got == rows(many, "PNR", "YEAR", "period", "source")
        assert all(r[1] == r[2].year and r[3] == f"ind_{r[1]}_10" for r in got)
        opened = len({r[1] for r in got if r[1] < 2018}) * 3 + any(r[1] == 2018 for r in got)
        assert [files_read(scan.read_periods(spark, path, "ind", units=n, **options)) for n in (files.UNITS, 0)] == [opened, opened]


def test_catalogue_reads_footers_of_new_files_only(spark, tmp_path, rows):
    path, stored = str(tmp_path / "ind"), files.FileCatalog(spark, str(tmp_path / "stored"))
    df = spark.createDataFrame([("1", 2019, 1.0), ("2", 2020, 2.0)], "PNR string, YEAR int, PERINDKIALT_13 double").coalesce(1)
    with pytest.raises(ValueError, match="refresh"):
        stored.files()
    df.write.parquet(f"{path}/2019")
    assert stored.refresh(path) == 1 and stored.refresh(path) == 0
    df.selectExpr("PNR", "YEAR", "cast(PERINDKIALT_13 as string) as PERINDKIALT_13").write.parquet(f"{path}/2020")
    assert stored.refresh(path) == 1
    assert rows(stored.files(), "rows") == [(2,), (2,)]
    known = scan.read_periods(spark, path, "ind", catalogue=stored)
    assert rows(known, "PNR", "period.year", "PERINDKIALT_13") == [("1", 2019, 1.0), ("1", 2020, 1.0), ("2", 2019, 2.0), ("2", 2020, 2.0)]
    assert scan.read_register(spark, "ind", path, catalogue=stored).count() == 4
    assert scan.read_register(spark, "ind", f"{path}/2020", catalogue=stored).count() == 2
    df.write.mode("overwrite").parquet(f"{path}/2020")
    assert stored.refresh(path) == 1
    assert len(files.stored_schemas(stored.files())) == 1


def test_hundred_thousand_names_plan_in_seconds(spark):
    """Names of the exceptions only, whatever the number of files of the commonest schema."""
    listed = spark.range(100_000).selectExpr(
        "concat('file:///d/ind/delivery=', 1990 + id % 30, '/part-', id, '.parquet') as uri", "1L as rows",
        "if(id % 30 = 7, array(named_struct('name', 'A', 'type', 'int32')), array(named_struct('name', 'A', 'type', if(id = 5, 'double', 'string')))) as columns",
    )
    began = time.monotonic()
    found = files.stored_schemas(listed)
    assert time.monotonic() - began < 20
    assert [g.columns for g in found] == [{"A": "string"}, {"A": "int32"}, {"A": "double"}]
    assert "delivery=1997'" in str(found[1].where) and "part-5.parquet" in str(found[2].where)


def test_footers_through_another_file_system(spark, tmp_path, rows):
    """A store that only Spark's readers know, by settings of the session."""
    spark.createDataFrame([("1", 2019)], "PNR string, YEAR int").coalesce(1).write.parquet(f"{tmp_path}/ind/2019")
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    conf.set("fs.viewfs.mounttable.table.link./data", f"file://{tmp_path}")
    for catalogue in (None, files.FileCatalog(spark, str(tmp_path / "stored"))):
        if catalogue:
            catalogue.refresh("viewfs://table/data/ind")
        df = scan.read_periods(spark, "viewfs://table/data/ind", "ind", catalogue=catalogue)
        assert rows(df, "PNR", "period.year") == [("1", 2019)]


def test_settings_of_the_session_reach_the_store(spark):
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    conf.set("fs.s3a.endpoint", "http://store:9000")
    conf.set("fs.s3a.access.key", "who")
    try:
        assert files.store_settings(spark) == {"endpoint_override": "http://store:9000", "access_key": "who"}
    finally:
        conf.unset("fs.s3a.endpoint")
        conf.unset("fs.s3a.access.key")
