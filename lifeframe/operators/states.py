"""Longitudinal results that are kept as stored states, so that deliveries can be folded in and taken back.

A state is a bucketed table. Of every person and field it holds the value that wins so far together with what it is ordered by, so folding
is a minimum: associative, commutative and idempotent. Deliveries may therefore come in any order and any number at
a time, and the state equals the merge of all of them. Each delivery is noted with its label in the same step that changes the
rows, so a delivery that comes again is passed over.

A minimum cannot be undone, so a withdrawn delivery recomputes the buckets of its persons from the deliveries that remain; all
other buckets stay as they are.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lifeframe.functions import periods as P
from lifeframe.operators.longitudinal import REGISTER_PRIORITY
from lifeframe.sources.buckets import BUCKETS, BucketedTable


class _State:
    table: BucketedTable

    def partial(self, rows: DataFrame, registry: str) -> DataFrame:
        """The state of one delivery alone."""
        raise NotImplementedError

    def merge(self, states: DataFrame) -> DataFrame:
        """One state of the rows of several."""
        raise NotImplementedError

    def folded(self) -> set[str]:
        """The deliveries that the state is made of."""
        return self.table.notes()

    def fold(self, rows: DataFrame, registry: str, label: str) -> set[int]:
        """Add a delivery; gives the buckets that were rewritten."""
        note = f"{registry}/{label}"
        if note in self.folded():
            return set()
        known = rows.filter(F.col(self.table.key).isNotNull())
        return self.table.change(self.partial(known, registry), lambda a, b: self.merge(a.unionByName(b)), add_note=note)

    def withdraw(self, rows: DataFrame, registry: str, label: str, remaining: Mapping[str, DataFrame]) -> set[int]:
        """Take a delivery back. ``remaining`` has the rows of all other folded deliveries per register, of which those in the touched buckets are read."""
        note = f"{registry}/{label}"
        if note not in self.folded():
            return set()
        key = self.table.key
        gone = rows.filter(F.col(key).isNotNull()).select(key).distinct()
        buckets = self.table.touched(gone)
        if not buckets:
            return self.table.change(gone, lambda current, _: current, drop_note=note)
        left = [self.partial(df.filter(F.col(key).isNotNull() & self.table.bucket_of().isin(*buckets)), name) for name, df in remaining.items()]

        def recomputed(current: DataFrame, _: DataFrame) -> DataFrame:
            return self.merge(reduce(lambda a, b: a.unionByName(b), left)) if left else current.limit(0)

        return self.table.change(gone, recomputed, drop_note=note)


class LongitudinalState(_State):
    """The state of ``longitudinal``: each field's first known value by register, then by period.

    ``fields`` gives name and type of the person fields; a delivery may lack some. With ``prefer="latest"`` the last period's value wins within a register.
    """

    def __init__(
        self, spark: SparkSession, path: str, fields: Mapping[str, str], prefer: str = "earliest", priority: Sequence[str] = REGISTER_PRIORITY,
        key: str = "pnr", buckets: int = BUCKETS,
    ) -> None:
        self.fields, self.latest = dict(fields), prefer == "latest"
        self.rank = {name: i for i, name in enumerate(priority)}
        won = {f: f"struct<rank:int,start:int,end:int,value:{kind}>" for f, kind in self.fields.items()}
        columns = ", ".join([f"{key} string", *(f"`{f}` {kind}" for f, kind in won.items())])
        self.table = BucketedTable(spark, path, columns, key, buckets)

    def _won(self, value: Column, registry: str) -> Column:
        if registry not in self.rank:
            raise ValueError(f"register {registry} has no rank in the priority of this state")
        return F.struct(
            F.lit(self.rank[registry]).alias("rank"), F.unix_date("period.start").alias("start"), F.unix_date("period.end").alias("end"), value.alias("value")
        )

    def _best(self, field: str) -> Column:
        if not self.latest:
            return F.min(field).alias(field)
        won = F.col(field)
        last = F.struct((-won["rank"]).alias("rank"), won["start"], won["end"], won["value"])
        return F.max_by(won, F.when(won.isNotNull(), last)).alias(field)

    def partial(self, rows: DataFrame, registry: str) -> DataFrame:
        present = {c.lower() for c in rows.columns}
        columns = []
        for field, kind in self.fields.items():
            value = F.col(field).cast(kind) if field.lower() in present else F.lit(None).cast(kind)
            columns.append(F.when(value.isNotNull(), self._won(value, registry)).alias(field))
        return self.merge(rows.select(F.col(self.table.key).cast("string").alias(self.table.key), *columns))

    def merge(self, states: DataFrame) -> DataFrame:
        return states.groupBy(self.table.key).agg(*(self._best(f) for f in self.fields))

    def records(self) -> DataFrame:
        """One row per person with the winning values."""
        return self.table.read().select(self.table.key, *(F.col(f"{f}.value").alias(f) for f in self.fields))


class PresenceState(_State):
    """The state of ``presence``: who was seen in which register and period, and the smallest source of each."""

    _columns = "registry string, label string, period_kind string, period_start date, period_end date, source string"

    def __init__(self, spark: SparkSession, path: str, key: str = "pnr", buckets: int = BUCKETS) -> None:
        self.table = BucketedTable(spark, path, f"{key} string, {self._columns}", key, buckets)

    def partial(self, rows: DataFrame, registry: str) -> DataFrame:
        period = F.col("period")
        label = P.period_label(period)
        once = rows.groupBy(self.table.key, "period").agg(F.min("source").alias("source")) if "source" in rows.columns else rows.select(
            self.table.key, "period"
        ).distinct().withColumn("source", F.lit(None).cast("string"))
        return once.select(
            F.col(self.table.key).cast("string").alias(self.table.key), F.lit(registry).alias("registry"), label.alias("label"), period["kind"].alias("period_kind"),
            period["start"].alias("period_start"), period["end"].alias("period_end"), F.coalesce("source", F.concat_ws("_", F.lit(registry), label)).alias("source"),
        )

    def merge(self, states: DataFrame) -> DataFrame:
        where = [self.table.key, "registry", "label", "period_kind", "period_start", "period_end"]
        return states.groupBy(*where).agg(F.min("source").alias("source"))

    def records(self) -> DataFrame:
        return self.table.read()
