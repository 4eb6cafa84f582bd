"""Named register sources."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession

from lifeframe.operators import cohort as C
from lifeframe.sources import scan, specs
from lifeframe.sources.specs import RegisterSpec


class RegisterCatalog:
    """Register sources by name. Nothing is read before ``load``; reuse a loaded frame with ``cache``."""

    def __init__(self, spark: SparkSession) -> None:
        self._spark = spark
        self._sources: dict[str, tuple[str, RegisterSpec]] = {}

    def register(self, name: str, path: str, spec: RegisterSpec | str) -> None:
        self._sources[name] = (path, specs.register(spec) if isinstance(spec, str) else spec)

    def register_auto(self, name: str, path: str) -> RegisterSpec:
        """Recognise the register from the path, else from the columns found there."""
        try:
            spec = specs.register_from_path(path)
        except ValueError:
            columns = self._spark.read.option("recursiveFileLookup", "true").parquet(path).columns
            spec = specs.register_from_columns(columns)
        self._sources[name] = (path, spec)
        return spec

    def names(self) -> list[str]:
        return sorted(self._sources)

    def load(self, name: str, cohort: DataFrame | None = None) -> DataFrame:
        path, spec = self._sources[name]
        if cohort is not None and spec.parent is not None:
            return self.load_many([name], cohort)[name]
        return scan.read_register(self._spark, spec, path, cohort)

    def load_many(self, names: Iterable[str], cohort: DataFrame | None = None) -> dict[str, DataFrame]:
        """Several sources. Registers without a person id are restricted through their catalogued parent."""
        wanted = list(names)
        frames = {n: scan.read_register(self._spark, self._sources[n][1], self._sources[n][0]) for n in wanted}
        if cohort is None:
            return frames
        result = {}
        for name, df in frames.items():
            spec = self._sources[name][1]
            if spec.parent is None:
                result[name] = C.restrict(df, cohort, spec.id_column)
                continue
            parent = next((n for n, (_, s) in self._sources.items() if s.name == spec.parent), None)
            if parent is None:
                raise ValueError(f"{name} reaches persons through {spec.parent}, which is not in the catalogue")
            result[name] = C.restrict_through(df, spec.parent_key, self.load(parent), cohort)
        return result

    def as_views(self, prefix: str = "") -> None:
        """Make every source queryable by SQL as a temporary view."""
        for name in self._sources:
            self.load(name).createOrReplaceTempView(f"{prefix}{name}")
