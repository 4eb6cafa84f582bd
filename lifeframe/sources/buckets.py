"""A stored table that is changed bucket by bucket.

Rows are dealt over a fixed number of buckets by a hash of their key. A change reads and rewrites the buckets that hold a changed key,
whatever else the table holds; the other buckets' files stay as they are. A version of the table is a manifest, one row per
bucket with the folder of its files, and counts once it is complete; so a change takes effect at once or not at all,
and a job that dies leaves files that no manifest names.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lifeframe.sources.versions import Versions

BUCKETS = 256
_MANIFEST = "bucket int, folder string, note string"


class BucketedTable:
    """Rows of ``schema`` under ``path``, bucketed by ``key``.

    The manifest has at most ``buckets`` rows and is what the driver sees. ``buckets`` is fixed when the table is first written: choose it so that a
    bucket is some hundred MB at the size the table may grow to.
    """

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType | str, key: str = "pnr", buckets: int = BUCKETS) -> None:
        self.spark, self.path, self.key, self.buckets = spark, path.rstrip("/"), key, buckets
        self.schema = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
        self._versions = Versions(spark, f"{self.path}/manifests")

    def bucket_of(self, key: Column | None = None) -> Column:
        return F.pmod(F.xxhash64(F.col(self.key) if key is None else key), F.lit(self.buckets)).cast("int")

    def manifest(self) -> dict[int, str]:
        """The folder of each bucket that has rows."""
        found = self._versions.read()
        return {r.bucket: r.folder for r in found.collect() if r.bucket is not None} if found is not None else {}

    def notes(self) -> set[str]:
        """What the changes up to now have been marked with."""
        found = self._versions.read()
        return {r.note for r in found.collect() if r.note is not None} if found is not None else set()

    def read(self, buckets: set[int] | None = None) -> DataFrame:
        """All rows, or those of some buckets."""
        folders = [folder for bucket, folder in sorted(self.manifest().items()) if buckets is None or bucket in buckets]
        return self.spark.read.schema(self.schema).parquet(*folders) if folders else self.spark.createDataFrame([], self.schema)

    def touched(self, rows: DataFrame) -> set[int]:
        """The buckets that hold keys of ``rows``."""
        return {r.bucket for r in rows.select(self.bucket_of().alias("bucket")).distinct().collect()}

    def change(
        self, incoming: DataFrame, combine: Callable[[DataFrame, DataFrame], DataFrame], add_note: str | None = None, drop_note: str | None = None
    ) -> set[int]:
        """Replace the rows of the buckets that ``incoming`` has keys in by ``combine(their rows, incoming)``; gives those buckets.

        ``combine`` must keep rows under their keys. The notes are kept with the manifest, so they take effect together with the rows.
        """
        buckets, manifest, notes = self.touched(incoming), self.manifest(), self.notes()
        after = combine(self.read(buckets), incoming).select(*(F.col(f.name).cast(f.dataType) for f in self.schema))
        folder = f"{self.path}/data/{uuid.uuid4().hex}"
        if buckets:
            # One task per touched bucket writes its file.
            after.withColumn("bucket", self.bucket_of()).repartition(len(buckets), "bucket").write.partitionBy("bucket").parquet(folder)
        written = self._buckets_in(folder) if buckets else set()
        manifest = {b: f for b, f in manifest.items() if b not in buckets} | {b: f"{folder}/bucket={b}" for b in written}
        notes = (notes | ({add_note} if add_note else set())) - ({drop_note} if drop_note else set())
        rows = [(b, f, None) for b, f in sorted(manifest.items())] + [(None, None, n) for n in sorted(notes)]
        self._versions.write(self.spark.createDataFrame(rows, _MANIFEST).coalesce(1))
        return buckets

    def _buckets_in(self, folder: str) -> set[int]:
        """Buckets that rows were written to; one whose rows are all gone has no folder."""
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/bucket=*")
        found = path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).globStatus(path)
        return {int(f.getPath().getName().split("=")[1]) for f in found or []}

    def clean(self, keep: int = 1) -> None:
        """Delete older manifests and the data that none of the kept ones names. Readers of older versions must have ended."""
        numbers = self._versions.numbers()[-keep:]
        named = {
            r.folder.rsplit("/bucket=", 1)[0] for n in numbers
            for r in self.spark.read.parquet(self._versions.folder(n)).filter("folder is not null").collect()
        }
        root = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/data/*")
        system = root.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        for found in system.globStatus(root) or []:
            if found.getPath().getName() not in {f.rsplit("/", 1)[1] for f in named}:
                system.delete(found.getPath(), True)
        self._versions.drop_older(keep)
