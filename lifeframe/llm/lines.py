"""Line dedup that can be undone.

A line's key is the line without white space at either end, A-Z in lower case; keys of ``min_chars`` or more code
points count. Held in the shared folder are

* ``postings`` (shard, key, doc): which document holds which key, one row each. It grows by insertions and shrinks
  by deletions, so every decision can be taken back.
* ``references`` (shard, key, n, last): the exact reference counts, and the largest document of each key.
* ``filters`` (shard, part, bits): one cuckoo filter per shard of the keys held by ``min_docs`` or more documents.

A line goes unless its document is the largest that holds its key. Tasks first ask the filters, which answer for most
lines that they surely stay; only what passes is shuffled and joined with the exact counts, so a filter's false
positives cost time and never change a result. Filters are broadcast while all of them together are at most
``FILTER_BYTES``; beyond it, every line is joined with the exact counts instead.

Keys are 128-bit digests. A key that a third of all documents hold is summed per task before it is shuffled, and joins
against ``references`` (one row per key) can be split.

Defined cases: a null or empty text is one empty line and stays as it is; a null id is smaller than any other;
repeated rows of a document are one document and lose the same lines; an empty table gives an empty result. Extra
columns are kept by ``apply`` and are otherwise passed over.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lifeframe.llm import spans
from lifeframe.session import discard, materialize

MIN_CHARS, MIN_DOCS = 20, 3
SHARD_KEYS = 200_000  # keys that one shard's filter is sized for
FILTER_BYTES = 64 << 20
SLOTS = 4
KICKS = 500
_UPPER = bytes(range(ord("A"), ord("Z") + 1))


def key_of(line: bytes, min_chars: int = MIN_CHARS) -> bytes | None:
    """The digest of a line's key, or nothing if the key is too short."""
    if len(line) < min_chars:
        return None
    key = line.strip(spans.SPACES).lower()  # bytes: A-Z only
    if len(key) < min_chars or len(key) < 4 * min_chars and len(key.decode("utf-8", "replace")) < min_chars:
        return None
    return xxhash.xxh3_128_digest(key)


class Cuckoo:
    """A set of 64-bit halves of digests: two buckets of four 16-bit fingerprints each, and an exact overflow list."""

    def __init__(self, buckets: np.ndarray, overflow: np.ndarray):
        self.buckets, self.overflow = buckets, overflow

    @staticmethod
    def places(halves: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Fingerprint and the two buckets; either bucket follows from the other and the fingerprint."""
        mask = np.uint64(count - 1)
        mixed = spans.mix(halves)
        print_ = ((mixed >> np.uint64(48)) | np.uint64(1)).astype(np.uint16)
        one = mixed & mask
        return print_, one.astype(np.int64), ((one ^ spans.mix(print_.astype(np.uint64))) & mask).astype(np.int64)

    @classmethod
    def build(cls, halves: np.ndarray) -> Cuckoo:
        """Insert all; who finds both buckets full moves another on, as often as ``KICKS`` rounds allow."""
        halves = np.unique(halves.astype(np.uint64))
        count = 1 << max(1, int(np.ceil(len(halves) / (SLOTS * 0.8))).bit_length())
        table = np.zeros((count, SLOTS), np.uint16)
        prints, at, _ = cls.places(halves, count)
        mask = np.uint64(count - 1)
        owners = np.full((count, SLOTS), -1, np.int64)  # whose fingerprint sits there, while building
        waiting = np.arange(len(halves))
        for turn in range(KICKS):
            if not len(waiting):
                break
            # One newcomer per bucket and turn takes a free slot, or else the turn's slot; who sat there waits.
            _, first = np.unique(at[waiting], return_index=True)
            chosen = waiting[first]
            bucket = at[chosen]
            free = table[bucket] == 0
            slot = np.where(free.any(axis=1), free.argmax(axis=1), turn % SLOTS)
            moved = owners[bucket, slot]
            table[bucket, slot], owners[bucket, slot] = prints[chosen], chosen
            moved = moved[moved >= 0]
            rest = np.ones(len(waiting), bool)
            rest[first] = False
            again = waiting[rest]
            for group in (moved, again):
                at[group] = ((at[group].astype(np.uint64) ^ spans.mix(prints[group].astype(np.uint64))) & mask).astype(np.int64)
            waiting = np.concatenate([again, moved])
        return cls(table, np.sort(halves[waiting]))

    def holds(self, halves: np.ndarray) -> np.ndarray:
        """False: surely not inserted."""
        prints, one, two = self.places(halves, len(self.buckets))
        found = (self.buckets[one] == prints[:, None]).any(axis=1) | (self.buckets[two] == prints[:, None]).any(axis=1)
        return found | np.isin(halves, self.overflow) if len(self.overflow) else found

    def delete(self, half: int) -> bool:
        """Take one inserted key out again; no other key is lost by it."""
        halves = np.array([half], np.uint64)
        gone = self.overflow == halves[0]
        if gone.any():
            self.overflow = self.overflow[~gone]
            return True
        prints, one, two = self.places(halves, len(self.buckets))
        for bucket in (one[0], two[0]):
            slot = np.flatnonzero(self.buckets[bucket] == prints[0])
            if len(slot):
                self.buckets[bucket, slot[0]] = 0
                return True
        return False

    def dump(self) -> bytes:
        return np.int64(len(self.buckets)).tobytes() + self.buckets.tobytes() + self.overflow.tobytes()

    @classmethod
    def load(cls, data: bytes) -> Cuckoo:
        count = int(np.frombuffer(data, np.int64, 1)[0])
        end = 8 + 2 * SLOTS * count
        return cls(np.frombuffer(data[8:end], np.uint16).reshape(count, SLOTS).copy(), np.frombuffer(data[end:], np.uint64).copy())


def halves_of(keys: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(keys), np.uint64)[::2]


def shards_of(halves: np.ndarray, shards: int) -> np.ndarray:
    return ((halves >> np.uint64(20)) % np.uint64(shards)).astype(np.int64)


def postings(docs: DataFrame, id_col: str = "doc_id", text: str = "text", min_chars: int = MIN_CHARS) -> DataFrame:
    """(doc, key), one row for each key of a row's lines."""
    source = docs.select(F.col(id_col).alias("doc"), F.col(text).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, end, data, offsets in spans.slices(batch.column(1)):
                rows, keys = [], []
                whole = data.tobytes()
                for i in range(end - first):
                    own = {key_of(x, min_chars) for x in whole[offsets[i] : offsets[i + 1]].split(b"\n")} - {None}
                    keys.extend(own)
                    rows.append(len(own))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(np.repeat(np.arange(first, end), rows))), pa.array(keys, pa.binary())], ["doc", "key"]
                )

    return source.mapInArrow(run, source.select("doc").schema.add("key", "binary"))


class LineIndex:
    """The state of incremental line dedup; each change writes new tables and deletes those it replaces."""

    def __init__(self, spark: SparkSession, id_col: str = "doc_id", text: str = "text", min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS):
        self.spark, self.id_col, self.text = spark, id_col, text
        self.min_chars, self.min_docs = min_chars, min_docs
        self.postings: DataFrame | None = None
        self.references: DataFrame | None = None
        self.filters: DataFrame | None = None
        self.shards = 1

    def insert(self, docs: DataFrame) -> None:
        """Add documents. A document that is there already keeps its old keys and gets the new ones too."""
        new = postings(docs, self.id_col, self.text, self.min_chars)
        self._replace(new if self.postings is None else self.postings.unionByName(new))

    def delete(self, ids: DataFrame) -> None:
        """Forget the documents whose ids stand in the first column of ``ids``."""
        if self.postings is not None:
            gone = ids.select(F.col(ids.columns[0]).alias("_gone")).distinct()
            self._replace(self.postings.join(gone, F.col("doc").eqNullSafe(F.col("_gone")), "left_anti"))

    def _replace(self, held: DataFrame) -> None:
        old = [self.postings, self.references, self.filters]
        # A key's documents are counted once each even where rows repeat; both steps add up per task first.
        self.postings = materialize(held.distinct(), "line-postings")
        counted = self.postings.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.max("doc").alias("last"))
        self.references = materialize(counted.filter(f"n >= {self.min_docs}"), "line-references")
        total = self.references.count()
        self.shards = max(1, -(-total // SHARD_KEYS))
        shards = self.shards

        def build(pdf: pd.DataFrame) -> pd.DataFrame:
            halves = halves_of(list(pdf["key"]))
            return pd.DataFrame({"shard": [int(shards_of(halves[:1], shards)[0])], "bits": [Cuckoo.build(halves).dump()]})

        def place(keys: pd.Series) -> pd.Series:
            return pd.Series(shards_of(halves_of(list(keys)), shards))

        shard = F.pandas_udf(place, "long")
        self.filters = materialize(
            self.references.select("key").withColumn("shard", shard("key")).groupBy("shard").applyInPandas(build, "shard long, bits binary"),
            "line-filters",
        )
        for df in old:
            if df is not None:
                discard(df)

    def candidates(self, docs: DataFrame, exact_only: bool = False) -> DataFrame:
        """(doc, key) of the lines that may have to go: those that the filters don't rule out, or all."""
        found = postings(docs, self.id_col, self.text, self.min_chars)
        size = self.filters.select(F.coalesce(F.sum(F.length("bits")), F.lit(0))).first()[0]
        if exact_only or size > FILTER_BYTES:
            return found
        parts = {r["shard"]: bytes(r["bits"]) for r in self.filters.collect()}  # at most FILTER_BYTES
        held, shards = self.spark.sparkContext.broadcast(parts), self.shards

        def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            filters = {s: Cuckoo.load(b) for s, b in held.value.items()}
            for batch in batches:
                if not batch.num_rows:
                    continue
                halves = halves_of(batch.column(1).to_pylist())
                at, passed = shards_of(halves, shards), np.zeros(len(halves), bool)
                for s, f in filters.items():
                    own = np.flatnonzero(at == s)
                    passed[own] = f.holds(halves[own])
                yield batch.filter(pa.array(passed))

        return found.mapInArrow(ask, found.schema)

    def drops(self, docs: DataFrame, exact_only: bool = False) -> DataFrame:
        """(doc, keys): the keys whose lines each document loses."""
        asked = self.candidates(docs, exact_only).distinct()
        late = F.col("doc").isNull() & F.col("last").isNotNull() | (F.col("doc") < F.col("last"))
        return asked.join(self.references, "key").filter(late).groupBy("doc").agg(F.collect_list("key").alias("keys"))

    def apply(self, docs: DataFrame, exact_only: bool = False, n_lines: str | None = None, n_dropped: str | None = None) -> DataFrame:
        """``docs`` without the lines that go; where named, columns of line counts are added."""
        names = docs.columns
        key, keys = spans.free_name(names, "_doc"), spans.free_name(names, "_keys")
        going = self.drops(docs, exact_only).select(F.col("doc").alias(key), F.col("keys").alias(keys))
        joined = docs.join(going, F.col(self.id_col).eqNullSafe(F.col(key)), "left").drop(key)
        at, min_chars = names.index(self.text), self.min_chars
        added = [c for c in (n_lines, n_dropped) if c]
        schema = docs.schema
        for c in added:
            schema = schema.add(c, "long")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                texts, sizes, lost = batch.column(at).to_pylist(), [], []
                for i, going in enumerate(batch.column(len(names)).to_pylist()):
                    lines = (texts[i] or "").encode().split(b"\n")
                    kept = lines
                    if going and texts[i]:
                        own = set(going)
                        kept = [x for x in lines if key_of(x, min_chars) not in own]
                        texts[i] = b"\n".join(kept).decode()
                    sizes.append(len(lines))
                    lost.append(len(lines) - len(kept))
                columns = batch.columns[: len(names)]
                columns[at] = pa.array(texts, batch.schema.field(at).type)
                counts = {n_lines: sizes, n_dropped: lost}
                yield pa.RecordBatch.from_arrays([*columns, *(pa.array(counts[c], pa.int64()) for c in added)], [*names, *added])

        return joined.mapInArrow(run, schema)


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text: str = "text", min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, **columns: str) -> DataFrame:
    """All documents in one go: insert them into an empty index and apply it to them."""
    index = LineIndex(docs.sparkSession, id_col, text, min_chars, min_docs)
    index.insert(docs)
    return index.apply(docs, **columns)
