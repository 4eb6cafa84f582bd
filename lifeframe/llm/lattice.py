"""Near-duplicate vectors by lattice hashing: random projections decoded to points of the E8 lattice, in several tables.

A table projects a unit vector to ``BLOCKS`` x 8 random directions, scaled so that a lattice step is ``CELL`` of the unit
sphere's radius, and takes the nearest lattice point of each 8 coordinates; the points together are its cell. A vector
is entered under its own cell and under the ``PROBES`` neighbouring cells that it lies closest to (one of the 240 shortest lattice
vectors added to one point), so vectors on both sides of a border meet. Two vectors meet if any cell of any of the ``TABLES``
agrees, and are then verified by the cosine of the whole vectors. At a cosine of exactly 0.98 two random vectors of 64 dimensions
meet with a probability over 0.98; two unrelated ones in less than one of a million cases.

Equal vectors of a label are one class, with one row per class in everything that follows. What meets under a cell is
compared with the cell's pivot (the smallest class there); the few that are not near to it are compared with all others of
the cell, in blocks of ``part`` rows. So a cell of any size gives a star and some blocks, not all its pairs. Links make components,
and links are then counted within components: vectors of a component lie in rings around its smallest class, as wide as
two linked vectors can be apart, so only pairs within a ring or of neighbouring rings are compared, again in blocks. Counting inside
components also finds links whose two vectors met in no cell. A component whose vectors are all different and near each other has a number of links that
is quadratic, and that many cosines are computed; they are counted where they are computed, and never rows.

Defined cases: vectors that are null, empty or zero, or hold a null or a number that is not finite, and rows without a label link with
nothing: no links, their own component, kept. Vectors of different lengths never link. Ids may be null or
repeat: every row is a vector, a component's id is its smallest id that is not null, and a row is kept if that is its own (both null
included). An empty table gives an empty result. Extra columns are passed over.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lifeframe.llm import spans
from lifeframe.llm.components import components
from lifeframe.session import discard, materialize

TABLES, BLOCKS, PROBES = 6, 2, 2
CELL = 0.5
PART = 256  # rows on one side of a block
BUCKET_ROWS = 8192  # rows of blocks that one call takes
SEED = 8
_CHUNK = 1 << 18  # numbers of a batch that are worked on at once


@lru_cache(maxsize=1)
def shortest() -> np.ndarray:
    """The 240 shortest vectors of E8: two coordinates of size one, or eight of one half with an even number of minus signs."""
    unit = np.eye(8)
    pairs = [s * unit[i] + t * unit[j] for i, j in itertools.combinations(range(8), 2) for s in (1, -1) for t in (1, -1)]
    halves = [np.array(s) for s in itertools.product((0.5, -0.5), repeat=8) if sum(x < 0 for x in s) % 2 == 0]
    return np.array(pairs + halves)


def _even(x: np.ndarray) -> np.ndarray:
    """The nearest points with whole coordinates of an even sum: round, and where the sum is odd round the worst coordinate the other way."""
    near = np.rint(x)
    off = x - near
    odd = np.flatnonzero(near.sum(axis=1) % 2)
    worst = np.abs(off[odd]).argmax(axis=1)
    near[odd, worst] += np.where(off[odd, worst] >= 0, 1.0, -1.0)
    return near


def decode(x: np.ndarray) -> np.ndarray:
    """The nearest E8 points: of the even whole points and the same shifted by one half, the nearer."""
    whole, half = _even(x), _even(x - 0.5) + 0.5
    nearer = ((x - half) ** 2).sum(axis=1) < ((x - whole) ** 2).sum(axis=1)
    return np.where(nearer[:, None], half, whole)


@lru_cache(maxsize=4)
def _directions(dim: int, tables: int, blocks: int) -> np.ndarray:
    """(table, dim, blocks * 8) orthonormal directions, as far as there are so many."""
    source = np.random.default_rng([SEED, dim])
    drawn = source.normal(size=(tables, dim, 8 * blocks))
    if dim >= 8 * blocks:
        return np.linalg.qr(drawn)[0]
    return drawn / np.linalg.norm(drawn, axis=1, keepdims=True)


@lru_cache(maxsize=4)
def _multipliers(tables: int, blocks: int) -> np.ndarray:
    source = np.random.default_rng([SEED, 0, 1])
    return source.integers(1, 1 << 63, size=(tables, 8 * blocks), dtype=np.int64).view(np.uint64) | np.uint64(1)


def cell_keys(unit: np.ndarray, salt: np.ndarray, tables: int = TABLES, blocks: int = BLOCKS, probes: int = PROBES, cell: float = CELL) -> np.ndarray:
    """rows x (tables * (1 + probes)) 64-bit keys of the cells of unit vectors, the own one of each table first.

    A key is a random linear hash of the doubled lattice coordinates, so that a neighbour's key is one addition away.
    """
    dim = unit.shape[1]
    out = np.empty((len(unit), tables, 1 + probes), np.uint64)
    neighbours = shortest()
    steps = (2 * neighbours).astype(np.int64).view(np.uint64)
    for t, (directions, multipliers) in enumerate(zip(_directions(dim, tables, blocks), _multipliers(tables, blocks))):
        at = unit @ directions * (math.sqrt(dim / 8) / cell)
        points = [decode(at[:, 8 * b : 8 * b + 8]) for b in range(blocks)]
        whole = (2 * np.concatenate(points, axis=1)).astype(np.int64).view(np.uint64)
        own = (whole * multipliers).sum(axis=1) + salt + np.uint64(t)
        out[:, t, 0] = own
        if probes:
            gain = np.concatenate([(at[:, 8 * b : 8 * b + 8] - points[b]) @ neighbours.T for b in range(blocks)], axis=1)
            best = np.argpartition(-gain, probes - 1, axis=1)[:, :probes]
            moves = np.concatenate([(steps * multipliers[8 * b : 8 * b + 8]).sum(axis=1) for b in range(blocks)])
            out[:, t, 1:] = own[:, None] + moves[best]
    return spans.mix(out.reshape(len(unit), -1))


def vectors(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, matrix) of the vectors of equal length that can link, in chunks of bounded size; each is scaled to a largest component of one."""
    lengths = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    numbers = np.asarray(column.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False), np.float64)
    starts = np.cumsum(lengths) - lengths
    for length in np.unique(lengths[lengths > 0]).tolist():
        rows = np.flatnonzero(lengths == length)
        step = max(1, _CHUNK // length)
        for first in range(0, len(rows), step):
            some = rows[first : first + step]
            matrix = numbers[starts[some][:, None] + np.arange(length)]
            largest = np.abs(matrix).max(axis=1)  # not a number if any is none
            good = np.isfinite(largest) & (largest > 0)
            yield some[good], matrix[good] / largest[good][:, None]


def classes(df: DataFrame, id_col: str, vector: str, label: str) -> DataFrame:
    """(id, cls, label, vector): ``cls`` is a digest of label and vector, null where a vector links with nothing."""
    source = df.select(F.col(id_col).alias("id"), F.col(label).cast("string").alias("label"), F.col(vector).cast("array<double>").alias("vector"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.column(1).to_pylist()
            cls: list[bytes | None] = [None] * len(batch)
            for rows, matrix in vectors(batch.column(2)):
                for row, numbers in zip(rows.tolist(), matrix + 0.0):  # one zero for both signs
                    if names[row] is not None:
                        cls[row] = xxhash.xxh3_128_digest(numbers.tobytes() + names[row].encode())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(cls, pa.binary()), batch.column(1), batch.column(2)], ["id", "cls", "label", "vector"])

    return source.mapInArrow(run, source.select("id").schema.add("cls", "binary").add(source.schema["label"]).add(source.schema["vector"]))


def keyed(distinct: DataFrame) -> DataFrame:
    """(key, cls) for all cells of every class (cls, label, vector)."""
    source = distinct.select("cls", "label", "vector")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, matrix in vectors(batch.column(2)):
                salt = [xxhash.xxh64_intdigest(f"{matrix.shape[1]}:{batch.column(1)[r]}") for r in rows.tolist()]
                keys = cell_keys(matrix / np.linalg.norm(matrix, axis=1, keepdims=True), np.array(salt, np.uint64))
                cls = batch.column(0).take(pa.array(np.repeat(rows, keys.shape[1])))
                yield pa.RecordBatch.from_arrays([pa.array(keys.ravel().view(np.int64)), cls], ["key", "cls"])

    return source.mapInArrow(run, "key long, cls binary")


def _matrix(column: pd.Series) -> np.ndarray:
    matrix = np.stack([np.asarray(v, np.float64) for v in column])
    return matrix / np.abs(matrix).max(axis=1, keepdims=True)


def _cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return a @ b.T / (np.linalg.norm(a, axis=1)[:, None] * np.linalg.norm(b, axis=1)[None, :])


def _near_to(pairs: DataFrame, vectors_: DataFrame, name: str) -> DataFrame:
    """``pairs`` (a, b) with their cosine as ``name``."""
    one, two = vectors_.select(F.col("cls").alias("a"), F.col("vector").alias("va")), vectors_.select(F.col("cls").alias("b"), F.col("vector").alias("vb"))
    both = pairs.join(one, "a").join(two, "b").select("a", "b", "va", "vb")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if not len(pdf):
                continue
            cosine = np.full(len(pdf), -1.0)
            # A cell's key may agree by chance for vectors of different lengths.
            lengths = pdf["va"].map(len).to_numpy()
            for length in np.unique(lengths):
                rows = np.flatnonzero((lengths == length) & (pdf["vb"].map(len).to_numpy() == length))
                if len(rows):
                    a, b = _matrix(pdf["va"].iloc[rows]), _matrix(pdf["vb"].iloc[rows])
                    cosine[rows] = (a * b).sum(axis=1) / (np.linalg.norm(a, axis=1) * np.linalg.norm(b, axis=1))
            yield pd.DataFrame({"a": pdf["a"], "b": pdf["b"], name: cosine})

    return both.mapInPandas(run, f"a binary, b binary, {name} double")


def _bucketed(rows: DataFrame, block: list[str]):
    """Rows of blocks, grouped by buckets of about ``BUCKET_ROWS``; a block is never divided."""
    buckets = max(1, rows.count() // BUCKET_ROWS)
    return rows.withColumn("bucket", F.pmod(F.xxhash64(*block), F.lit(buckets))).groupBy("bucket")


def _blocks_of(pdf: pd.DataFrame, block: list[str]) -> Iterator[tuple[pd.DataFrame, pd.DataFrame]]:
    for _, rows in pdf.groupby(block, sort=False):
        a, b = rows[rows["in_a"]], rows[rows["in_b"]]
        if len(a) and len(b):
            yield a, b


def _first_links(cosine: float):
    """Links that connect what is near across a block: each row of side a to those of side b that it reaches."""
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        a_out, b_out = [], []
        for a, b in _blocks_of(pdf, ["key", "i", "j"]):
            for length in {len(v) for v in a["vector"]}:
                of_a, of_b = a[a["vector"].map(len) == length], b[b["vector"].map(len) == length]
                if not len(of_b):
                    continue
                near = _cosines(_matrix(of_a["vector"]), _matrix(of_b["vector"])) >= cosine
                same = of_a["cls"].to_numpy()[:, None] == of_b["cls"].to_numpy()[None, :]
                near &= ~same
                # A row of b needs one link to each set of rows of a that it joins; rows of a seen together once are joined already.
                group = np.arange(len(of_a))
                for column in np.flatnonzero(near.any(axis=0)):
                    hit = np.flatnonzero(near[:, column])
                    _, firsts = np.unique(group[hit], return_index=True)
                    for row in hit[firsts]:
                        a_out.append(of_a["cls"].iloc[row])
                        b_out.append(of_b["cls"].iloc[column])
                    group[np.isin(group, group[hit])] = group[hit].min()
        return pd.DataFrame({"a": a_out, "b": b_out})

    return run


def links(entries: DataFrame, vectors_: DataFrame, shared: DataFrame, cosine: float, part: int = PART) -> DataFrame:
    """(a, b): links of at least ``cosine`` that connect all classes which meet in a cell and are as near.

    ``entries`` are (key, cls, pivot) of the cells in ``shared`` (key, n, pivot), ``vectors_`` has (cls, vector) of all classes in them.
    """
    apart = entries.filter("cls <> pivot")
    judged = materialize(_near_to(apart.selectExpr("cls as a", "pivot as b").distinct(), vectors_, "cosine"), "lattice-judged")
    stars = judged.filter(F.col("cosine") >= cosine).select("a", "b")
    # What is not near to its pivot may be near to others of the cell.
    far = judged.filter(F.col("cosine") < cosine).selectExpr("a as cls", "b as pivot")
    others = apart.join(shared.filter("n > 2").select("key"), "key", "left_semi").join(far, ["cls", "pivot"], "left_semi").select("key", "cls")
    others = materialize(others, "lattice-others")
    count = others.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / part).cast("int").alias("rows_a"))
    parts = materialize(shared.join(count, "key").selectExpr("key", "rows_a", f"cast(ceil((n - 1) / {part}) as int) as rows_b"), "lattice-parts")
    mine, theirs = (f"cast(pmod(xxhash64(cls, {salt}), {n}) as int)" for salt, n in ((1, "rows_a"), (2, "rows_b")))
    side_a = others.join(parts, "key").selectExpr("key", "cls", f"{mine} as i", "explode(sequence(0, rows_b - 1)) as j", "true as in_a", "false as in_b")
    side_b = apart.join(parts, "key").selectExpr("key", "cls", "explode(sequence(0, rows_a - 1)) as i", f"{theirs} as j", "false as in_a", "true as in_b")
    sent = materialize(side_a.unionByName(side_b).join(vectors_, "cls"), "lattice-blocks")
    inner = _bucketed(sent, ["key", "i", "j"]).applyInPandas(_first_links(cosine), "a binary, b binary")
    return stars.unionByName(inner).distinct()


def _count_links(cosine: float):
    """Per row the rows that stand for as many vectors as ``copies`` says and are as near."""
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        found: dict[bytes, int] = {}
        for a, b in _blocks_of(pdf, ["root", "ring_a", "ring_b", "i", "j"]):
            near = _cosines(_matrix(a["vector"]), _matrix(b["vector"])) >= cosine
            itself = a["cls"].to_numpy()[:, None] == b["cls"].to_numpy()[None, :]
            near &= ~itself
            ways = [(a, near @ b["copies"].to_numpy())]
            if not itself.any():  # otherwise the block is one part with itself, and each pair is in it twice
                ways.append((b, a["copies"].to_numpy() @ near))
            for rows, n in ways:
                for cls, k in zip(rows["cls"], n.tolist()):
                    found[cls] = found.get(cls, 0) + k
        return pd.DataFrame({"cls": pd.Series(list(found), dtype=object), "n": pd.Series(list(found.values()), dtype="int64")})

    return run


def count_links(members: DataFrame, cosine: float, part: int = PART) -> DataFrame:
    """(cls, n): how many vectors of the same component are as near. ``members`` are (root, cls, vector, copies), root being the smallest cls."""
    pairs = members.selectExpr("root as b", "cls as a").distinct()
    away = _near_to(pairs, members.select("cls", "vector"), "away").selectExpr("a as cls", "b as root", "away")
    width = math.acos(cosine) * (1 + 1e-9) + 1e-9
    ring = F.floor(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), "away"))) / width).cast("int")
    held = materialize(members.join(away, ["root", "cls"]).select("root", "cls", "vector", "copies", ring.alias("ring")), "lattice-held")
    parts = materialize(held.groupBy("root", "ring").agg(F.ceil(F.count(F.lit(1)) / part).cast("int").alias("parts")), "lattice-rings")
    left, right = parts.selectExpr("root", "ring as ring_a", "parts as parts_a"), parts.selectExpr("root", "ring as ring_b", "parts as parts_b")
    blocks = (
        left.join(right, "root").filter("ring_b between ring_a and ring_a + 1")
        .selectExpr("*", "explode(sequence(0, parts_a - 1)) as i").selectExpr("*", "explode(sequence(0, parts_b - 1)) as j")
        .filter("ring_a <> ring_b or i <= j")
    )
    alone = "ring_a = ring_b and i = j"
    a = f"named_struct('ring', ring_a, 'mine', i, 'in_a', true, 'in_b', {alone})"
    b = "named_struct('ring', ring_b, 'mine', j, 'in_a', false, 'in_b', true)"
    needed = blocks.selectExpr("root", "ring_a", "ring_b", "i", "j", f"inline(if({alone}, array({a}), array({a}, {b})))")
    dealt = held.join(parts, ["root", "ring"]).withColumn("mine", F.pmod(F.xxhash64("cls"), F.col("parts")).cast("int"))
    sent = dealt.join(needed, ["root", "ring", "mine"]).select("root", "ring_a", "ring_b", "i", "j", "in_a", "in_b", "cls", "vector", "copies")
    sent = materialize(sent, "lattice-blocks")
    counted = _bucketed(sent, ["root", "ring_a", "ring_b", "i", "j"]).applyInPandas(_count_links(cosine), "cls binary, n long")
    return counted.groupBy("cls").agg(F.sum("n").alias("n"))


def near_vectors(df: DataFrame, id_col: str = "vec_id", vector: str = "embedding", label: str = "label", cosine: float = 0.98, part: int = PART) -> DataFrame:
    """(id, n_links, component, kept) of every row."""
    hashed = classes(df, id_col, vector, label)
    marked = materialize(hashed.select("id", "cls"), "lattice-ids")
    sizes = materialize(marked.filter("cls is not null").groupBy("cls").agg(F.count(F.lit(1)).alias("copies"), F.min("id").alias("least")), "lattice-classes")
    distinct = hashed.filter("cls is not null").groupBy("cls").agg(F.first("label").alias("label"), F.first("vector").alias("vector"))
    entries = materialize(keyed(distinct), "lattice-keys")
    shared = entries.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("cls").alias("pivot")).filter("n > 1")
    shared = materialize(shared, "lattice-shared")
    met = materialize(entries.join(shared.select("key", "pivot"), "key"), "lattice-met")
    discard(entries)
    wanted = met.select("cls").distinct()
    seen = materialize(hashed.join(wanted, "cls", "left_semi").groupBy("cls").agg(F.first("vector").alias("vector")), "lattice-vectors")

    stars = materialize(components(links(met, seen, shared, cosine, part), "lattice-links"), "lattice-components")
    members = seen.join(stars.selectExpr("node as cls", "root"), "cls").join(sizes.select("cls", "copies"), "cls")
    counted = materialize(count_links(materialize(members, "lattice-members"), cosine, part), "lattice-counts")
    least = stars.join(sizes, stars["node"] == sizes["cls"]).groupBy("root").agg(F.min("least").alias("component"))
    placed = stars.join(least, "root").selectExpr("node as cls", "component", "true as placed")
    known = sizes.join(placed, "cls", "left").join(counted, "cls", "left").selectExpr(
        "cls as _cls", "copies - 1 + coalesce(n, 0L) as n_links", "if(coalesce(placed, false), component, least) as component"
    )
    found = marked.join(known, F.col("cls") == F.col("_cls"), "left")
    component = F.when(F.col("_cls").isNull(), F.col("id")).otherwise(F.col("component"))
    return found.select("id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component")).withColumn(
        "kept", F.col("id").eqNullSafe(F.col("component"))
    )
