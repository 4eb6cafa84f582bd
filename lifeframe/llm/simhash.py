"""Near-duplicate documents by SimHash, found through deletion-variant signatures.

Two fingerprints of 64 bits within ``distance`` bits: cut into so few segments that one segment differs by at most one
bit: two of 32 bits, for up to three. A segment is indexed as it is, and once for each of its bits with
that bit left out. Segments that are equal meet on the first key; segments that differ in one bit meet on the key that
leaves it out, one side having 0 and the other 1 there, so a pair meets at most once per segment. Pairs that meet are
verified on all 64 bits.

Only distinct fingerprints are indexed, so copies cost one row. A key that over ``HOT`` fingerprints share is divided
again by the same rule applied to the 32 bits that it leaves open; what then still shares a key differs in at most
1 + 1 + 16 bits. Such a last group has a bounded number of distinct fingerprints whatever the number
of documents, and yields a spanning forest of its links, not all pairs. No link between components is lost by that.

Defined cases: a null or empty text has fingerprint zero and links as any other; ids may be null or repeat, the
component id is the smallest id that is not null (null if there is none); an empty table gives an empty result. Extra
columns are passed over.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lifeframe.llm import spans
from lifeframe.llm.components import components, sized
from lifeframe.session import discard, materialize

SEED = 42
HOT = 64  # fingerprints that one key may have before it is divided
LANES = 5  # of 64 bits, of a wide fingerprint
SEGMENT = 28
WIDE_HOT = 16  # wide fingerprints that one key may have before spanning forests replace pairs
GROUP = 512  # of them in a part, on average
TASK_PRINTS = 4096  # wide fingerprints whose keys one task counts
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32


def majority(hashes: np.ndarray, rows: np.ndarray, count: int) -> np.ndarray:
    """Per row the 64 bits that are set in over half of its hashes. Rows are ascending."""
    total = np.bincount(rows, minlength=count)
    ends = np.cumsum(total)
    out = np.zeros(count, np.uint64)
    running = np.zeros(len(hashes) + 1, np.int64)
    for bit in range(64):
        np.cumsum((hashes >> np.uint64(bit)) & np.uint64(1), out=running[1:])
        set_ = running[ends] - running[ends - total]
        out |= (2 * set_ > total).astype(np.uint64) << np.uint64(bit)
    return out


def shingle_hashes(data: np.ndarray, offsets: np.ndarray, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, row) of all shingles of the rows of one slice of texts, rows ascending."""
    data = _LOWER[data]
    starts, ends, row = spans.words(data, offsets)
    # Words joined by single blanks, so that every shingle is one piece of the joined text.
    lengths = ends - starts
    at = np.zeros(len(starts) + 1, np.int64)
    np.cumsum(lengths + 1, out=at[1:])
    joined = np.full(at[-1], 32, np.uint8)
    take = np.ones(at[-1], bool)
    take[at[1:] - 1] = False
    inside = np.zeros(len(data) + 1, np.int64)
    np.add.at(inside, starts, 1)
    np.add.at(inside, ends, -1)
    joined[take] = data[np.cumsum(inside[:-1]) > 0]
    text = joined.tobytes()

    counts = np.bincount(row, minlength=len(offsets) - 1)
    last = np.cumsum(counts)  # word after the row's last
    first = np.flatnonzero(np.arange(len(row)) + shingle <= last[row])
    short = np.flatnonzero((counts > 0) & (counts < shingle))
    begin = np.concatenate([at[first], at[last[short] - counts[short]]])
    end = np.concatenate([at[first + shingle] - 1, at[last[short]] - 1])
    of = np.concatenate([row[first], short])
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(text[a:b], SEED) for a, b in zip(begin.tolist(), end.tolist())), np.uint64, len(begin))
    order = np.argsort(of, kind="stable")
    return hashes[order], of[order]


def fingerprint_slice(data: np.ndarray, offsets: np.ndarray, shingle: int) -> np.ndarray:
    """64-bit fingerprints of the rows of one slice of texts."""
    return majority(*shingle_hashes(data, offsets, shingle), len(offsets) - 1)


def wide_slice(data: np.ndarray, offsets: np.ndarray, shingle: int) -> np.ndarray:
    """rows x ``LANES`` fingerprints; the further lanes scramble the same hashes."""
    hashes, row = shingle_hashes(data, offsets, shingle)
    scrambled = (spans.mix(hashes + np.uint64(lane)) if lane else hashes for lane in range(LANES))
    return np.stack([majority(h, row, len(offsets) - 1) for h in scrambled], axis=1)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text: str = "text", shingle: int = 3) -> DataFrame:
    """(id, print): the fingerprint as a signed 64-bit integer."""
    source = docs.select(F.col(id_col).alias("id"), F.col(text).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [fingerprint_slice(d, o, shingle) for _, _, d, o in spans.slices(batch.column(1))]
            prints = np.concatenate(found) if found else np.zeros(0, np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints.view(np.int64))], ["id", "print"])

    return source.mapInArrow(run, source.select("id").schema.add("print", "long"))


def apart(a: str = "a", b: str = "b") -> Column:
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b)))


def variants(df: DataFrame, columns: list[str], value: str, low: str, segments: int, width: int) -> DataFrame:
    """``columns`` with (slot, rest, bit) for the keys of all segments of ``width`` bits.

    ``value`` and ``low`` say in SQL, in terms of ``segment``, which number a segment is taken from and its lowest bit. Each
    segment has a key as it is (bit -1), and one for each of its bits left out (bit 0 or 1 as it is in the number).
    """
    keys = f"explode(sequence(0, {segments * (width + 1) - 1})) as slot"
    numbered = df.selectExpr(*columns, *(c for c in df.columns if c not in columns), keys).selectExpr(
        "*", f"slot div {width + 1} as segment", f"slot % {width + 1} - 1 as place"
    )
    cut = numbered.selectExpr(*columns, "slot", "place", f"shiftrightunsigned({value}, cast({low} as int)) & {(1 << width) - 1}L as cut")
    return cut.selectExpr(
        *columns, "slot", "if(place < 0, cut, cut & ~shiftleft(1L, place)) as rest",
        "if(place < 0, -1, cast(shiftright(cut, place) & 1 as int)) as bit",
    )


def keyed_by(found: DataFrame, columns: list[str]) -> DataFrame:
    """``variants`` with slot and rest in one key."""
    return found.selectExpr(*columns, "shiftleft(cast(slot as bigint), 48) ^ rest as key", "bit")


def index(prints: DataFrame, segments: int) -> DataFrame:
    """(print, key, bit): every distinct fingerprint under the keys of all segments."""
    width = 64 // segments
    return keyed_by(variants(prints.select("print"), ["print"], "print", f"segment * {width}", segments, width), ["print"])


def _forest(distance: int):
    """Spanning links of one last group: each fingerprint is compared with one of each part found so far, block by block."""
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        values = np.unique(pdf["print"].to_numpy()).view(np.uint64)
        left, links = np.arange(len(values)), []
        while len(left):
            ring, left = left[:1], left[1:]
            while len(ring) and len(left):
                # All that lie within the distance of the ring join it; each gives one link.
                reached = np.zeros(len(left), bool)
                through = np.zeros(len(left), np.int64)
                for block in range(0, len(ring), 64):
                    part = ring[block : block + 64]
                    rest = np.flatnonzero(~reached)
                    near = np.bitwise_count(values[left[rest]][:, None] ^ values[part][None, :]) <= distance
                    hit = near.any(axis=1)
                    reached[rest[hit]] = True
                    through[rest[hit]] = part[near[hit].argmax(axis=1)]
                links.append(np.stack([values[left[reached]], values[through[reached]]]))
                ring, left = left[reached], left[~reached]
        both = np.concatenate(links, axis=1) if links else np.zeros((2, 0), np.uint64)
        return pd.DataFrame({"a": both[0].view(np.int64), "b": both[1].view(np.int64)})

    return run


def links(prints: DataFrame, distance: int = 3) -> DataFrame:
    """(a, b): links between distinct fingerprints that connect all that lie within ``distance`` of each other."""
    if not 0 <= distance <= 3:
        raise ValueError("signatures with one bit left out are built for up to 3 differing bits")
    segments = 2  # so few that one has at most one differing bit
    width = 64 // segments
    keyed = index(prints, segments)
    # Which keys are shared by many: one row per key, combined per task, and few remain.
    hot = materialize(keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter(f"n > {HOT}").select("key"), "simhash-hot")
    hot = sized(hot, hot.count())
    cold = keyed.join(hot, "key", "left_anti")
    left = cold.selectExpr("key", "print as a", "bit as bit_a")
    right = cold.selectExpr("key", "print as b", "bit as bit_b")
    meet = (F.col("bit_a") == -1) & (F.col("bit_b") == -1) & (F.col("a") < F.col("b")) | (F.col("bit_a") == 0) & (F.col("bit_b") == 1)
    # Spark takes the exploded keys for little more than the files of their fingerprints.
    near = left.join(right.hint("merge"), (left["key"] == right["key"]) & meet & (apart() <= distance)).select("a", "b")

    # Divided keys: what the key leaves open is cut by the same rule.
    again = keyed.join(hot, "key", "left_semi")
    low = f"cast(shiftright(key, 48) div {width + 1} * {width} as int)"
    above = f"shiftleft(shiftrightunsigned(shiftrightunsigned(print, {low}), {width}), {low})"
    open_bits = again.selectExpr("print", "key", f"({above} | (print & (shiftleft(1L, {low}) - 1))) as left_open")
    part = (64 - width) // segments
    last = variants(open_bits, ["print", "key"], "left_open", f"segment * {part}", segments, part)
    far = last.groupBy("key", "slot", "rest").applyInPandas(_forest(distance), "a long, b long")
    return near.unionByName(far).distinct()


def linked(docs: DataFrame, id_col: str = "doc_id", text: str = "text", shingle: int = 3, distance: int = 3) -> DataFrame:
    """(id, print, component): each document's fingerprint and the smallest id among all it is linked with."""
    marked = materialize(fingerprints(docs, id_col, text, shingle), "simhash-prints")
    distinct = materialize(marked.groupBy("print").agg(F.min("id").alias("least")), "simhash-distinct")
    return _with_components(marked, distinct, links(distinct.select("print"), distance))


def _with_components(marked: DataFrame, distinct: DataFrame, found: DataFrame) -> DataFrame:
    prints, rows = distinct.count(), marked.count()
    rooted = distinct.join(sized(components(found, "simhash-links").withColumnRenamed("node", "print"), prints), "print", "left")
    rooted = materialize(rooted.select("print", "least", F.coalesce("root", "print").alias("root")), "simhash-roots")
    smallest = rooted.groupBy("root").agg(F.min("least").alias("component"))
    return marked.join(sized(rooted.select("print", "root").join(sized(smallest, prints), "root").drop("root"), rows), "print")


def _wide_prints(docs: DataFrame, id_col: str, text: str, shingle: int) -> DataFrame:
    """(id, print, lanes): ``print`` is a hash of all lanes."""
    source = docs.select(F.col(id_col).alias("id"), F.col(text).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [wide_slice(d, o, shingle) for _, _, d, o in spans.slices(batch.column(1))]
            lanes = (np.concatenate(found) if found else np.zeros((0, LANES), np.uint64)).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.ListArray.from_arrays(pa.array(np.arange(len(lanes) + 1, dtype=np.int32) * LANES), pa.array(lanes.ravel()))], ["id", "lanes"]
            )
        spans.release()

    schema = source.select("id").schema.add("lanes", T.ArrayType(T.LongType()))
    return source.mapInArrow(run, schema).withColumn("print", F.xxhash64("lanes"))


def wide_distance(similarity: float) -> int:
    """Bits of ``64 * LANES`` by which texts of that Jaccard similarity are expected to differ.

    For sets of like sizes the cosine is 2s / (1 + s), and a bit differs with the angle's share of a half turn.
    """
    return int(64 * LANES * math.acos(2 * similarity / (1 + similarity)) / math.pi)


def _differing(a: str, b: str) -> Column:
    return sum(F.bit_count(F.col(a)[k].bitwiseXOR(F.col(b)[k])) for k in range(LANES))


def wide_links(distinct: DataFrame, distance: int) -> DataFrame:
    """(a, b): links that connect all wide fingerprints that meet under a deletion variant and lie within ``distance``.

    ``LANES`` x 2 segments of ``SEGMENT`` bits are indexed, each whole and with one bit left out. A key of up to ``WIDE_HOT``
    fingerprints gives its pairs, any other one a set of links that connects the same.
    """
    # So few fingerprints a task that its keys are counted in memory; nearly all keys are held by one fingerprint.
    spread = distinct.repartition(max(1, distinct.count() // TASK_PRINTS), "print")
    keyed = keyed_by(variants(spread, ["print"], "lanes[cast(segment div 2 as int)]", f"segment % 2 * {SEGMENT}", 2 * LANES, SEGMENT), ["print"])
    shared = materialize(keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "simhash-shared")
    # Shared keys grow with the input; a merge join at every size, whose hot keys Spark can divide.
    met = materialize(keyed.join(shared.hint("merge"), "key"), "simhash-met")
    discard(shared)
    cold, hot = met.filter(f"n <= {WIDE_HOT}").drop("n"), met.filter(f"n > {WIDE_HOT}").drop("n")
    left, right = cold.selectExpr("key", "print as a", "bit as bit_a"), cold.selectExpr("key", "print as b", "bit as bit_b")
    meet = (F.col("bit_a") == -1) & (F.col("bit_b") == -1) & (F.col("a") < F.col("b")) | (F.col("bit_a") == 0) & (F.col("bit_b") == 1)
    pairs = left.join(right, (left["key"] == right["key"]) & meet).select("a", "b").distinct()
    lanes_a, lanes_b = distinct.selectExpr("print as a", "lanes as la"), distinct.selectExpr("print as b", "lanes as lb")
    near = pairs.join(lanes_a, "a").join(lanes_b, "b").filter(_differing("la", "lb") <= distance).select("a", "b")
    found = materialize(near.unionByName(_hot_links(hot, distinct, distance)).distinct(), "simhash-found")
    discard(met)
    return found


def _hot_links(keyed: DataFrame, distinct: DataFrame, distance: int) -> DataFrame:
    """(a, b): links that connect what meets under the hot keys of ``keyed`` and lies within ``distance``. No pair is left out.

    Under a key with a bit left out only 0 and 1 meet, as like bits share the whole segment, which is a key as well. What lies
    within the distance of a key's pivot is linked to that, and needs no comparison among itself. The others lie in rings around
    the pivot, wider than the distance by one bit, so pairs within the distance lie in one ring or in neighbouring ones. Rings are dealt by hash
    over parts of about ``GROUP``, and every pair of parts that may hold such a pair is a block, compared in full.
    """
    hot = keyed.groupBy("key").agg(F.min("print").alias("pivot"), F.min("bit").alias("least"), F.max("bit").alias("most"))
    # A key with one side only has nothing that meets.
    pivots = hot.filter("least = -1 or least < most").select("key", "pivot").join(distinct.selectExpr("print as pivot", "lanes as at"), "pivot")
    around = keyed.join(pivots, "key").join(distinct.select("print", "lanes"), "print").withColumn("away", _differing("lanes", "at"))
    held = materialize(around.selectExpr("key", "print", "bit", "pivot", f"cast(away div {distance + 1} as int) as ring"), "simhash-held")
    stars = held.filter("ring = 0 and print <> pivot").selectExpr("print as a", "pivot as b")

    every = held.groupBy("key", "ring", "bit").agg(F.ceil(F.count(F.lit(1)) / GROUP).cast("int").alias("parts"))
    every = materialize(every, "simhash-rings")
    rings = every.join(every.filter("ring > 0").select("key").distinct(), "key", "left_semi")
    left = rings.selectExpr("key", "ring as ring_a", "bit as bit_a", "parts as parts_a")
    right = rings.selectExpr("key", "ring as ring_b", "bit as bit_b", "parts as parts_b")
    meet = F.expr("bit_a = -1 and bit_b = -1 and ring_b between ring_a and ring_a + 1 or bit_a = 0 and bit_b = 1 and abs(ring_a - ring_b) <= 1")
    blocks = (
        left.join(right, "key").filter(meet & F.expr("ring_a + ring_b > 0"))
        .selectExpr("*", "explode(sequence(0, parts_a - 1)) as part_a")
        .selectExpr("*", "explode(sequence(0, parts_b - 1)) as part_b")
        .filter("bit_a <> bit_b or ring_a <> ring_b or part_a <= part_b")
    )
    block = ["key", "ring_a", "ring_b", "part_a", "part_b"]
    alone = "bit_a = bit_b and ring_a = ring_b and part_a = part_b"
    a, b = (f"named_struct('ring', ring_{x}, 'bit', bit_{x}, 'part', part_{x}, 'in_a', {y}, 'in_b', {z})" for x, y, z in (("a", "true", alone), ("b", "false", "true")))
    needed = blocks.selectExpr(*block, f"inline(if({alone}, array({a}), array({a}, {b})))")
    part = F.pmod(F.xxhash64("print", "key"), F.col("parts")).cast("int")
    dealt = held.join(rings, ["key", "ring", "bit"]).withColumn("part", part).select("key", "ring", "bit", "part", "print")
    sent = dealt.join(needed, ["key", "ring", "bit", "part"]).select(*block, "in_a", "in_b", "print").join(distinct.select("print", "lanes"), "print")
    return stars.unionByName(sent.groupBy(*block).applyInPandas(_block_forest(distance), "a long, b long"))


def _block_forest(distance: int):
    """Spanning links between the two parts of a block; a part may be compared with itself."""
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        names, lanes = pdf["print"].to_numpy(), np.array(pdf["lanes"].tolist(), np.int64).view(np.uint64)
        a, b = np.flatnonzero(pdf["in_a"].to_numpy()), np.flatnonzero(pdf["in_b"].to_numpy())
        near = np.zeros((len(a), len(b)), bool)
        for block in range(0, len(a), 64):
            part = lanes[a[block : block + 64]]
            near[block : block + 64] = sum(np.bitwise_count(part[:, k, None] ^ lanes[b, k]).astype(np.int16) for k in range(LANES)) <= distance
        new_a, new_b = near.any(axis=1), near.any(axis=0)
        links = []
        while new_a.any():
            ring = np.flatnonzero(new_a)[:1]
            new_a[ring] = False
            while len(ring):
                # What the ring reaches on the other side joins, and what that reaches on this side is the next ring.
                over = np.flatnonzero(new_b & near[ring].any(axis=0))
                new_b[over] = False
                links.append((names[b[over]], names[a[ring[near[np.ix_(ring, over)].argmax(axis=0)]]]))
                back = np.flatnonzero(new_a & near[:, over].any(axis=1))
                new_a[back] = False
                links.append((names[a[back]], names[b[over[near[np.ix_(back, over)].argmax(axis=1)]]] if len(back) else names[:0]))
                ring = back
        found = [np.concatenate(x) if x else np.zeros(0, np.int64) for x in (zip(*links) if links else ((), ()))]
        out = pd.DataFrame({"a": found[0], "b": found[1]})
        return out[out["a"] != out["b"]]

    return run


def wide_linked(docs: DataFrame, id_col: str = "doc_id", text: str = "text", shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """(id, print, component) for links of about ``similarity`` or more between the texts' sets of shingles.

    64 bits and 3 differences reach only texts that are all but equal. Here a fingerprint has ``64 * LANES`` bits, and pairs
    that share one of its segments but for one bit are verified on all bits. A pair of similarity 0.95 is met with probability
    over 0.98, one of 0.9 with 0.88, one of 0.8 with about a half; links of a group add up.
    """
    marked = materialize(_wide_prints(docs, id_col, text, shingle), "simhash-wide")
    distinct = materialize(marked.groupBy("print").agg(F.min("id").alias("least"), F.first("lanes").alias("lanes")), "simhash-distinct")
    found = wide_links(distinct.select("print", "lanes"), wide_distance(similarity))
    return _with_components(marked.drop("lanes"), distinct.drop("lanes"), found)


def keep_one(docs: DataFrame, id_col: str = "doc_id", text: str = "text", shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """The documents that are the smallest of their component, with all their columns.

    Rows that share an id stay or go together; rows without an id stay.
    """
    going = wide_linked(docs, id_col, text, shingle, similarity).filter("id <> component").select(F.col("id").alias("_id")).distinct()
    gone = spans.free_name(docs.columns, "_id")
    return docs.join(going.select(F.col("_id").alias(gone)), F.col(id_col) == F.col(gone), "left_anti")
