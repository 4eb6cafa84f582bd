"""Session settings and the one place where intermediate results are written.

Intermediate results go to the shared folder named by ``spark.checkpoint.dir`` (or by
``SparkContext.setCheckpointDir``). A machine-local temporary folder is used in local mode only, where driver
and executors are one process; on a cluster a missing setting is an error, because executors would write to
their own disks and the driver would read an incomplete result.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_unset_scratch: dict[str, str] = {}


def build_session(app_name: str = "lifeframe", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators are written for.

    On a cluster leave ``master`` unset and let the submit command and its defaults decide sizes.
    """
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        **{key.replace("__", "."): value for key, value in conf.items()},
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def choose_root(configured: str | None, master: str, app: str) -> str:
    """The scratch folder for these settings; see the module text."""
    if configured:
        return configured.rstrip("/")
    if not master.startswith("local[") and master != "local":
        raise ValueError(
            "spark.checkpoint.dir is unset: intermediate results need a folder that the driver and all executors share"
        )
    if app not in _unset_scratch:
        _unset_scratch[app] = tempfile.mkdtemp(prefix="lifeframe-")
    return _unset_scratch[app]


def scratch_root(spark: SparkSession) -> str:
    """The shared folder for intermediate results."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        configured = held.get() if held.isDefined() else None
    return choose_root(configured, spark.sparkContext.master, spark.sparkContext.applicationId)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the scratch root."""
    return f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    This cuts the lineage, survives the loss of any executor, and gives the next plan true sizes
    to choose join strategies from.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete the files of a materialized frame that nothing reads any more."""
    spark = df.sparkSession
    root = scratch_root(spark)
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for folder in {name.rsplit("/", 1)[0] for name in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        if jvm.org.apache.hadoop.fs.Path(root).toUri().getPath() == path.getParent().toUri().getPath():
            path.getFileSystem(conf).delete(path, True)
