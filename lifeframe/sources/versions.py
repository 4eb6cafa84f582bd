"""Numbered versions of a stored table: readers see the newest complete one, writers add the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


class Versions:
    """Versions below a shared folder, one folder each.

    A version counts once its write is complete, which Spark marks by a file of its own, so a reader sees the old or the new one and
    never a half-written one. Two writers of the same number: one of them fails, because the folder exists.
    """

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")

    def _hadoop_path(self, name: str):
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)

    def _file_system(self):
        return self._hadoop_path(self.path).getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def numbers(self) -> list[int]:
        """Complete versions, oldest first."""
        found = self._file_system().globStatus(self._hadoop_path(f"{self.path}/version=*/_SUCCESS"))
        return sorted(int(f.getPath().getParent().getName().split("=")[1]) for f in found or [])

    def folder(self, number: int) -> str:
        return f"{self.path}/version={number}"

    def read(self) -> DataFrame | None:
        """The newest version, nothing if there is none."""
        numbers = self.numbers()
        return self.spark.read.parquet(self.folder(numbers[-1])) if numbers else None

    def next(self) -> int:
        numbers = self.numbers()
        return numbers[-1] + 1 if numbers else 1

    def write(self, df: DataFrame, number: int | None = None) -> int:
        number = self.next() if number is None else number
        df.write.parquet(self.folder(number))
        return number

    def drop_older(self, keep: int = 2) -> None:
        """Delete all but the newest versions. Readers of an older one must have ended."""
        for number in self.numbers()[:-keep]:
            self._file_system().delete(self._hadoop_path(self.folder(number)), True)
