"""Scans, sources and sinks (SC)."""

from __future__ import annotations

import datetime as dt
import uuid

from pyspark.sql import functions as F
from pyspark.sql import types as T

from conformance.registry import query
from conformance.views import table, view
from lifeframe.functions import periods as P
from lifeframe.session import scratch_path
from lifeframe.sources import scan, schemas, sinks
from lifeframe.sources.buckets import BucketedTable
from lifeframe.sources.catalog import RegisterCatalog
from lifeframe.sources.files import FileCatalog
from lifeframe.sources.specs import register, register_from_path

ORDER_SCHEMA = T.StructType(
    [
        T.StructField("o_orderkey", T.LongType()),
        T.StructField("o_custkey", T.LongType()),
        T.StructField("o_orderdate", T.StringType()),
        T.StructField("o_totalprice", T.DoubleType()),
        T.StructField("o_clerk", T.StringType()),
    ]
)
COHORT = "select c_custkey from customer where c_mktsegment = 'BUILDING'"


def _cohort(spark, d):
    return table(spark, d, "customer").filter("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("pnr"))


@query(
    "sc01_read_parquet",
    f"""select o_orderkey, o_custkey, strftime(o_orderdate, '%Y-%m-%d') as o_orderdate, o_totalprice, cast(null as varchar) as o_clerk
from orders where o_custkey in ({COHORT})""",
)
def _(spark, d):
    return scan.read_parquet(
        spark, f"{d}/orders.parquet", schema=ORDER_SCHEMA, cohort=_cohort(spark, d), id_column="o_custkey"
    )


def _written(spark, d, name, frame):
    """Deliver a derived register as a directory of files, one directory per year."""
    path = f"{scratch_path(spark, name)}/{name}"
    frame.write.partitionBy("delivery").parquet(path)
    return path


def _ind_delivery(spark, d):
    ind = view(spark, d, "ind")
    return _written(spark, d, "ind", ind.withColumn("delivery", F.col("YEAR").cast("string")))


@query("sc02_read_directory", "select PNR, YEAR, round(PERINDKIALT_13, 2) as PERINDKIALT_13 from v_ind")
def _(spark, d):
    path = _ind_delivery(spark, d)
    return scan.read_parquet(spark, path).select("PNR", "YEAR", F.round("PERINDKIALT_13", 2).alias("PERINDKIALT_13"))


def _drifting(spark, d):
    """Yearly deliveries whose columns change type: text ids of people throughout, amounts as int, text and double, years as bigint."""
    ind = view(spark, d, "ind").withColumn("delivery", F.col("YEAR").cast("string"))
    path = f"{scratch_path(spark, 'drift')}/ind"
    for years, amount, year in (("1995, 1996", "int", "int"), ("1997", "string", "bigint"), ("1998, 1999, 2000, 2001", "double", "int")):
        part = ind.filter(f"YEAR in ({years})").withColumns(
            {"PERINDKIALT_13": F.floor("PERINDKIALT_13").cast(amount), "YEAR": F.col("YEAR").cast(year)}
        )
        (part.drop("LOENMV_13") if amount == "int" else part).write.mode("append").partitionBy("delivery").parquet(path)
    return path


_DRIFT_SQL = "cast(floor(PERINDKIALT_13) as double)"


@query("sc02_read_drifting_types", f"select PNR, YEAR, {_DRIFT_SQL} as PERINDKIALT_13, case when YEAR >= 1997 then round(LOENMV_13, 2) end as LOENMV_13 from v_ind")
def _(spark, d):
    df = scan.read_register(spark, "ind", _drifting(spark, d))
    return df.select("PNR", "YEAR", "PERINDKIALT_13", F.round("LOENMV_13", 2).alias("LOENMV_13"))


@query(
    "tp15_load_drifting_periods",
    f"select PNR, YEAR, {_DRIFT_SQL} as amount, make_date(YEAR, 12, 31) as period_end from v_ind where YEAR between 1996 and 1998",
)
def _(spark, d):
    df = scan.read_periods(spark, _drifting(spark, d), "ind", dt.date(1996, 5, 1), dt.date(1998, 1, 1))
    return df.select("PNR", "YEAR", F.col("PERINDKIALT_13").alias("amount"), F.col("period.end").alias("period_end"))


@query(
    "tp15_load_daily_periods",
    """select P.PNR, P.SOCIO13, P.day as period_start from (
  select lpad(cast(o_custkey as varchar(12)), 10, '0') as PNR, cast(1 + o_orderkey % 9 as int) as SOCIO13, cast(o_orderdate as date) as day from orders) P
where P.day between date '1999-01-01' and date '1999-12-31'""",
)
def _(spark, d):
    """One delivery a day in 1999, yearly ones before and after: all days are one scan."""
    rows = table(spark, d, "orders").select(
        F.lpad(F.col("o_custkey").cast("string"), 10, "0").alias("PNR"), (1 + F.col("o_orderkey") % 9).cast("string").alias("SOCIO13"),
        F.when(F.year("o_orderdate") == 1999, F.date_format("o_orderdate", "yyyyMMdd")).otherwise(F.date_format("o_orderdate", "yyyy")).alias("delivery"),
    )
    path = f"{scratch_path(spark, 'daily')}/akm"
    rows.repartition("delivery").write.partitionBy("delivery").parquet(path)
    df = scan.read_periods(spark, path, "akm", dt.date(1999, 1, 1), dt.date(1999, 12, 31))
    return df.select("PNR", F.col("SOCIO13").cast("int").alias("SOCIO13"), F.col("period.start").alias("period_start"))


@query(
    "sc07_load_register_with_times",
    """select lpad(cast(o_custkey as varchar(12)), 10, '0') as CPR, cast(o_orderkey as varchar(12)) as DW_EK_KONTAKT, o_orderpriority as kontakttype,
  cast(o_orderkey % 86400 as int) as tidspunkt_start from orders""",
)
def _(spark, d):
    """Dictionary-encoded text and times of day, which Spark itself cannot write: each task writes one file of its rows."""
    path = f"{scratch_path(spark, 'times')}/lpr3_kontakter"
    rows = table(spark, d, "orders").select(
        F.lpad(F.col("o_custkey").cast("string"), 10, "0").alias("CPR"), F.col("o_orderkey").cast("string").alias("DW_EK_KONTAKT"),
        F.col("o_orderpriority").alias("kontakttype"), (F.col("o_orderkey") % 86400).cast("int").alias("seconds"),
    )

    def write(batches):
        import pyarrow as pa
        import pyarrow.compute as pc
        import pyarrow.fs as pafs
        import pyarrow.parquet as pq

        filesystem, root = pafs.FileSystem.from_uri(path if "://" in path else "file://" + path.removeprefix("file:"))
        filesystem.create_dir(root, recursive=True)
        for number, batch in enumerate(batches):
            table_ = pa.table(
                {
                    "CPR": batch.column(0), "DW_EK_KONTAKT": batch.column(1).dictionary_encode(), "kontakttype": batch.column(2).dictionary_encode(),
                    "tidspunkt_start": pc.multiply(batch.column(3), pa.scalar(1000, pa.int32())).cast(pa.time32("ms")),
                }
            )
            name = f"{root}/{uuid.uuid4().hex}-{number}.parquet"
            with filesystem.open_output_stream(name) as out:
                pq.write_table(table_, out)
            yield pa.RecordBatch.from_arrays([pa.array([name])], ["file"])

    rows.mapInArrow(write, "file string").count()
    return scan.read_register(spark, "lpr3_kontakter", path).select("CPR", "DW_EK_KONTAKT", "kontakttype", "tidspunkt_start")


@query(
    "sc08_register_from_path",
    """select case when path like '/data/bef/%' then 'bef' when path like '/data/akm/%' then 'akm' when path like '/data/lpr_adm/%' then 'lpr_adm'
    when path like '/data/lpr_diag/%' then 'lpr_diag' else 'lpr3_kontakter' end as register, count(*) as files
from (select * from v_files union all select * from v_hospital_files) group by 1""",
)
def _(spark, d):
    files = view(spark, d, "files").unionByName(view(spark, d, "hospital_files"))
    folders = files.select(F.regexp_extract("path", "^(.*)/[^/]+$", 1).alias("folder"))
    counted = folders.groupBy("folder").agg(F.count(F.lit(1)).alias("files")).collect()  # a row per folder
    named = [(register_from_path(r.folder).name, r.files) for r in counted]
    return spark.createDataFrame(named, "register string, files bigint")


@query("sc03_read_with_filter", "select o_orderkey, o_totalprice from orders where o_totalprice > 200000 and o_orderstatus = 'F'")
def _(spark, d):
    return scan.read_parquet(
        spark, f"{d}/orders.parquet", predicate=(F.col("o_totalprice") > 200000) & (F.col("o_orderstatus") == "F"),
        columns=["o_orderkey", "o_totalprice"],
    )


@query("sc04_read_directory_with_filter", "select PNR, YEAR from v_ind where PERINDKIALT_13 > 300000")
def _(spark, d):
    return scan.read_parquet(spark, _ind_delivery(spark, d), predicate=F.col("PERINDKIALT_13") > 300000, columns=["PNR", "YEAR"])


@query("sc05_read_directory_for_cohort", "select i.PNR, i.YEAR from v_ind i where i.PNR in (select PNR from v_akm where SOCIO13 = '3')")
def _(spark, d):
    cohort = view(spark, d, "akm").filter("SOCIO13 = '3'").select("PNR")
    return scan.read_parquet(spark, _ind_delivery(spark, d), cohort=cohort, columns=["PNR", "YEAR"])


@query("sc06_read_recursive", "select PNR, YEAR from v_ind")
def _(spark, d):
    return scan.read_parquet(spark, _ind_delivery(spark, d), recursive=True, columns=["PNR", "YEAR"])


@query(
    "sc07_load_register",
    """select PNR, KOEN, FOED_DAG, MOR_ID, FAR_ID, FAMILIE_ID, KOM, ANTAL_BOERN, cast(null as int) as ALDER
from v_bef where PNR in (select PNR from v_akm)""",
)
def _(spark, d):
    path = _written(spark, d, "bef", view(spark, d, "bef").withColumn("delivery", F.lit("200012")))
    df = scan.read_register(spark, "bef", path, cohort=view(spark, d, "akm").select("PNR"))
    return df.select("PNR", "KOEN", "FOED_DAG", "MOR_ID", "FAR_ID", "FAMILIE_ID", "KOM", "ANTAL_BOERN", "ALDER")


@query(
    "sc10_load_several_registers",
    """select 'akm' as registry, PNR as pnr, cast(SOCIO13 as int) as socioeconomic_status, cast(null as int) as education_code from v_akm
union all select 'uddf', PNR, null, HFAUDD from v_uddf""",
)
def _(spark, d):
    frames = {n: view(spark, d, n) for n in ("akm", "uddf")}
    return scan.stack_registers(frames).select("registry", "pnr", "socioeconomic_status", "education_code")


@query(
    "sc11_catalog",
    "select PNR, cast(SOCIO13 as int) as SOCIO13 from v_akm where PNR in (select PNR from v_uddf)",
)
def _(spark, d):
    catalog = RegisterCatalog(spark)
    catalog.register("labour", _written(spark, d, "akm", view(spark, d, "akm").withColumn("delivery", F.lit("2000"))), "akm")
    return catalog.load("labour", cohort=view(spark, d, "uddf").select("PNR"))


@query(
    "sc12_schema_report",
    """select 'orders' as file, 'customer' as reference, 'field count: 6 instead of 5' as issue
union all select 'orders', 'customer', 'field 0: o_orderkey instead of c_custkey'
union all select 'orders', 'customer', 'field 1: o_custkey instead of c_name'
union all select 'orders', 'customer', 'field 1 o_custkey: int64 instead of string'
union all select 'orders', 'customer', 'field 2: o_orderstatus instead of c_nationkey'
union all select 'orders', 'customer', 'field 2 o_orderstatus: string instead of int32'
union all select 'orders', 'customer', 'field 3: o_totalprice instead of c_acctbal'
union all select 'orders', 'customer', 'field 4: o_orderdate instead of c_mktsegment'
union all select 'orders', 'customer', 'field 4 o_orderdate: timestamp[us] instead of string'""",
)
def _(spark, d):
    report = schemas.schema_report(spark, [f"{d}/customer.parquet", f"{d}/orders.parquet"])
    return report.select(
        F.regexp_extract("file", r"([^/]+)\.parquet$", 1).alias("file"),
        F.regexp_extract("reference", r"([^/]+)\.parquet$", 1).alias("reference"), "issue",
    )


@query("sc13_read_compatible_files", "select PNR, YEAR from v_ind")
def _(spark, d):
    path = _ind_delivery(spark, d)
    years = [r.YEAR for r in view(spark, d, "ind").select("YEAR").distinct().collect()]  # a few calendar years
    return schemas.read_compatible(spark, [f"{path}/delivery={y}" for y in sorted(years)]).select("PNR", "YEAR")


@query(
    "sc15_upsert",
    """select PNR as pnr, 'old' as origin, SOCIO13 as value from v_akm where PNR not in (select PNR from v_uddf)
union all select PNR, 'new', HF_KILDE from v_uddf""",
)
def _(spark, d):
    current = view(spark, d, "akm").select(F.col("PNR").alias("pnr"), F.lit("old").alias("origin"), F.col("SOCIO13").alias("value"))
    incoming = view(spark, d, "uddf").select(F.col("PNR").alias("pnr"), F.lit("new").alias("origin"), F.col("HF_KILDE").alias("value"))
    return sinks.upsert(current, incoming)


@query(
    "tp13_load_one_period",
    "select PNR as pnr, YEAR as income_year, round(PERINDKIALT_13, 2) as annual_income from v_ind where YEAR = 1998",
)
def _(spark, d):
    df = scan.read_periods(spark, _ind_delivery(spark, d), "ind", period_label="1998")
    return df.select(F.col("PNR").alias("pnr"), F.col("YEAR").alias("income_year"), F.round("PERINDKIALT_13", 2).alias("annual_income"))


@query(
    "tp14_load_with_source",
    """select PNR as pnr, cast(YEAR as varchar) as label,
  'ind_' || cast(YEAR as varchar) || '_' || cast(count(*) over (partition by YEAR) as varchar) as source from v_ind""",
)
def _(spark, d):
    df = scan.read_periods(spark, _ind_delivery(spark, d), "ind", with_source=True)
    return df.select(F.col("PNR").alias("pnr"), P.period_label(F.col("period")).alias("label"), "source")


@query(
    "tp15_load_periods_in_range",
    """select PNR as pnr, make_date(YEAR,1,1) as period_start, make_date(YEAR,12,31) as period_end from v_ind
where YEAR between 1997 and 1999 and PNR in (select PNR from v_akm)""",
)
def _(spark, d):
    df = scan.read_periods(
        spark, _ind_delivery(spark, d), register("ind"), dt.date(1997, 6, 1), dt.date(1999, 2, 1),
        cohort=view(spark, d, "akm").select("PNR"),
    )
    return df.select(F.col("PNR").alias("pnr"), F.col("period.start").alias("period_start"), F.col("period.end").alias("period_end"))


@query(
    "tp15_load_with_catalogue",
    """select PNR as pnr, YEAR as income_year, make_date(YEAR, 12, 31) as period_end from v_ind where YEAR between 1995 and 1997
union all select PNR, YEAR, make_date(YEAR, 12, 31) from v_ind where YEAR = 1997""",
)
def _(spark, d):
    """Deliveries up to 1996 are catalogued, then later ones arrive and 1997 comes twice."""
    path, stored = f"{scratch_path(spark, 'catalogued')}/ind", FileCatalog(spark, scratch_path(spark, "catalogue"))
    ind = view(spark, d, "ind").withColumn("delivery", F.col("YEAR").cast("string"))
    ind.filter("YEAR <= 1996").write.partitionBy("delivery").parquet(path)
    stored.refresh(path)
    for _ in range(2):
        ind.filter("YEAR = 1997").write.mode("append").partitionBy("delivery").parquet(path)
    ind.filter("YEAR > 1997").withColumn("YEAR", F.col("YEAR").cast("string")).write.mode("append").partitionBy("delivery").parquet(path)
    stored.refresh(path)
    df = scan.read_periods(spark, path, "ind", dt.date(1995, 6, 1), dt.date(1997, 2, 1), catalogue=stored)
    return df.select(F.col("PNR").alias("pnr"), F.col("YEAR").alias("income_year"), F.col("period.end").alias("period_end"))


@query(
    "sc11_file_catalogue",
    "select cast(YEAR as varchar) as delivery, 'int32' as year_type, count(*) as row_count from v_ind group by YEAR",
)
def _(spark, d):
    """Rows and stored types of each delivery, from footers alone."""
    stored = FileCatalog(spark, scratch_path(spark, "catalogue"))
    stored.refresh(_ind_delivery(spark, d))
    year = F.filter("columns", lambda c: c["name"] == "YEAR")[0]["type"]
    files = stored.files().withColumns({"delivery": F.regexp_extract("path", r"delivery=(\d+)/", 1), "year_type": year})
    return files.groupBy("delivery", "year_type").agg(F.sum("rows").alias("row_count"))


@query(
    "sc15_two_upserts",
    """select PNR as pnr, origin, value from (
  select *, row_number() over (partition by PNR order by step desc, value desc) as k from (
    select PNR, 0 as step, 'old' as origin, SOCIO13 as value from v_akm
    union all select PNR, 1, 'first', HF_KILDE from v_uddf
    union all select P.PNR, 2, 'second', P.value from (select PNR, KOM as value from v_bef where ANTAL_BOERN = 2) P))
where k = 1""",
)
def _(spark, d):
    """Two upserts in a row into a stored table of 16 buckets."""
    table_ = BucketedTable(spark, scratch_path(spark, "entities"), "pnr string, origin string, value string", buckets=16)
    akm, uddf, bef = view(spark, d, "akm"), view(spark, d, "uddf"), view(spark, d, "bef").filter("ANTAL_BOERN = 2")
    for origin, frame, value in (("old", akm, "SOCIO13"), ("first", uddf, "HF_KILDE"), ("second", bef, "KOM")):
        sinks.upsert_stored(table_, frame.select(F.col("PNR").alias("pnr"), F.lit(origin).alias("origin"), F.col(value).alias("value")))
    return table_.read()
