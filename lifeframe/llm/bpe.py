"""Byte-level BPE encoding and decoding by recursive queries.

The texts are cut by the vocabulary's pattern. Each task gathers the distinct pieces of some MB of text and hands them
to an in-memory DuckDB: one row per token position, beginning with single bytes. A recursive query joins neighbouring
rows with the merge table (every pair of tokens whose bytes together are a token, with that token's rank) and contracts
each piece's leftmost pair of least rank, until no pair of any piece is in the table. The rows left, in order, are the
piece's ids. A piece that is a token as a whole is that token. A text's ids are those of its pieces in order. They are decoded, here and by
``decode`` for given ids, by a join of the id rows with the vocabulary and ordered aggregation, ``DECODE_ROWS`` ids at a time.

A recursion keeps the rows of all its rounds, up to half the square of a piece's bytes for each piece, so pieces go through it by that
measure: at most ``SQUARES`` together, and ``PIECES`` of them. Pieces longer than ``LONG`` bytes, for
which the recursion would need as many rounds as they have bytes, are contracted by the same rule with a heap.

Defined cases: a null text encodes as an empty one, to no tokens; ids of the table may be null or repeat; an empty table
gives an empty result. Extra columns are passed over.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import re
from collections.abc import Iterator
from functools import lru_cache

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lifeframe.llm import spans

CHUNK_BYTES = 3 << 20  # of text, whose distinct pieces are encoded together
PIECES = 30_000  # in one recursive query
SQUARES = 8_000_000  # of the bytes of its pieces, summed
DECODE_ROWS = 1_000_000
LONG = 200  # bytes; a piece's positions must fit into 8 bits
KNOWN = 300_000  # pieces after which a task forgets those that it has not met again since the last time


# Texts of these characters only are split by the standard library, which has no Unicode classes but is faster. On them,
# its classes and those of the pattern agree.
_LETTERS = "A-Za-zÀ-ÖØ-öø-ÿ"
PLAIN = re.compile(r"[\x00-\x1b\x20-\x7fÀ-ÿ]*")


def plain_pattern(pattern: str) -> re.Pattern | None:
    """``pattern`` for ``PLAIN`` texts, if it names letters and numbers only in ways known here."""
    ours = pattern.replace(r"[^\s\p{L}\p{N}]", rf"[^\s{_LETTERS}0-9]").replace(r"\p{L}", f"[{_LETTERS}]").replace(r"\p{N}", "[0-9]")
    return None if r"\p" in ours.lower() else re.compile(ours)


@lru_cache(maxsize=2)
def vocabulary(path: str) -> dict[bytes, int]:
    """Ranks by token, from a file of base64 tokens and ranks."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


def merge_rows(ranks: dict[bytes, int]) -> tuple[list[int], list[int], list[int]]:
    """Left token, right token and the rank of both together, for all splits of all tokens into two tokens."""
    left, right, joined = [], [], []
    for token, rank in ranks.items():
        for at in range(1, len(token)):
            a, b = ranks.get(token[:at]), ranks.get(token[at:])
            if a is not None and b is not None:
                left.append(a)
                right.append(b)
                joined.append(rank)
    return left, right, joined


# A row's place is piece * 256 + position. All rows are in order of place, so one sort serves all pieces.
MERGE = """
with recursive states(place, id, step) as (
    select place, id, 0 from start
    union all
    (with pairs as (
        select place, id, step, lead(place) over w as next_place, lead(id) over w as next_id, lag(place) over w as prev_place
        from states window w as (order by place)
    ), ranked as (
        select p.place, p.id, p.step, p.prev_place, m.joined, m.joined::bigint * 256 + (p.place & 255) as cost
        from pairs p left join merges m on p.id = m.a and p.next_id = m.b and p.place >> 8 = p.next_place >> 8
    ), best as (
        select place >> 8 as piece, min(cost) as cost from ranked where cost is not null group by 1
    )
    select r.place, case when r.cost = b.cost then r.joined else r.id end, r.step + 1
    from ranked r join best b on r.place >> 8 = b.piece
    where r.prev_place is null or r.prev_place <> (b.piece << 8) + (b.cost & 255))
), final as (
    select place >> 8 as piece, max(step) as step from states group by 1
)
select s.place, s.id from states s join final f on s.place >> 8 = f.piece and s.step = f.step
order by s.place
"""
DECODE = """
select d.n, list(v.token order by d.i) as tokens from held d join vocabulary v on d.id = v.id group by d.n
"""


def contract(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The same contraction of one long piece, with a heap of pairs."""
    end = len(piece)
    following, before = list(range(1, end + 1)), list(range(-1, end - 1))
    stop = list(range(1, end + 1))  # token at i is piece[i:stop[i]]; 0 once it is merged away

    def rank(i: int) -> int | None:
        j = following[i]
        return ranks.get(piece[i : stop[j]]) if j < end else None

    heap = [(r, i, 2) for i in range(end - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, size = heapq.heappop(heap)
        j = following[i]
        if not stop[i] or j >= end or stop[j] - i != size:
            continue
        stop[i], following[i] = stop[j], following[j]
        stop[j] = 0
        if following[i] < end:
            before[following[i]] = i
        for k in (before[i], i):
            if k >= 0 and (r := rank(k)) is not None:
                heapq.heappush(heap, (r, k, stop[following[k]] - k))
    out, i = [], 0
    while i < end:
        out.append(ranks[piece[i : stop[i]]])
        i = following[i]
    return out


class Encoder:
    """The vocabulary, a DuckDB with its merge table, and the pieces that a task has met. Freed at the task's end."""

    def __init__(self, path: str, pattern: str):
        self.ranks = vocabulary(path)
        self.pattern = regex.compile(pattern)
        self.plain = plain_pattern(pattern)
        # Ids as little-endian 32-bit integers: of the pieces met lately, and of those before.
        self.known: dict[str, bytes] = {}
        self.before: dict[str, bytes] = {}
        self.con = duckdb.connect(config={"threads": 1, "memory_limit": "400MB", "temp_directory": ""})
        left, right, joined = merge_rows(self.ranks)
        self.fill("merges", {"a": pa.array(left, pa.int32()), "b": pa.array(right, pa.int32()), "joined": pa.array(joined, pa.int32())})
        self.fill("vocabulary", {"id": pa.array(self.ranks.values(), pa.int32()), "token": pa.array(self.ranks, pa.binary())})
        self.bytes = np.array([self.ranks[bytes([b])] for b in range(256)], np.int32)

    def fill(self, name: str, columns: dict[str, pa.Array]) -> None:
        self.con.register("given", pa.table(columns))
        self.con.execute(f"create table {name} as select * from given")
        self.con.unregister("given")

    def over(self, sql: str, name: str, columns: dict[str, pa.Array]) -> pa.Table:
        self.con.register(name, pa.table(columns))
        try:
            return self.con.execute(sql).to_arrow_table()
        finally:
            self.con.unregister(name)

    def split(self, text: str) -> list[str]:
        return self.plain.findall(text) if self.plain and PLAIN.fullmatch(text) else self.pattern.findall(text)

    def encode_pieces(self, pieces: set[str]) -> None:
        """See to it that these pieces are ``known``."""
        if len(self.known) > KNOWN:
            self.before, self.known = self.known, {}
        met = pieces - self.known.keys()
        for piece in met & self.before.keys():
            self.known[piece] = self.before[piece]
        open_ = []
        for piece in pieces - self.known.keys():
            raw = piece.encode()
            whole = self.ranks.get(raw)
            if whole is not None:
                self.know([piece], np.array([whole], "<u4"), [1])
            elif len(raw) > LONG:
                ids = contract(raw, self.ranks)
                self.know([piece], np.array(ids, "<u4"), [len(ids)])
            else:
                open_.append((piece, raw))
        open_.sort(key=lambda x: len(x[1]))
        first, squares = 0, 0
        for end, (_, raw) in enumerate(open_):
            squares += len(raw) ** 2
            if end > first and (end - first == PIECES or squares > SQUARES):
                self.know([piece for piece, _ in open_[first:end]], *self.recurse([raw for _, raw in open_[first:end]]))
                first, squares = end, len(raw) ** 2
        if open_:
            self.know([piece for piece, _ in open_[first:]], *self.recurse([raw for _, raw in open_[first:]]))

    def know(self, pieces: list[str], ids: np.ndarray, ends: list[int]) -> None:
        """``ids`` of all pieces in a row, and where each piece's end."""
        packed, start = ids.tobytes(), 0
        for piece, end in zip(pieces, ends):
            self.known[piece] = packed[4 * start : 4 * end]
            start = end

    def recurse(self, raws: list[bytes]) -> tuple[np.ndarray, list[int]]:
        """(the ids of all pieces in a row, where each piece's end)."""
        sizes = np.array([len(raw) for raw in raws], np.int64)
        numbers = np.repeat(np.arange(len(raws)), sizes)
        places = numbers * 256 + np.arange(len(numbers)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        ids = self.bytes[np.frombuffer(b"".join(raws), np.uint8)]
        found = self.over(MERGE, "start", {"place": pa.array(places), "id": pa.array(ids)})
        ends = np.cumsum(np.bincount(found["place"].to_numpy() >> 8, minlength=len(raws)))
        return found["id"].to_numpy().astype("<u4"), ends.tolist()

    def decode(self, ids: np.ndarray, counts: list[int]) -> list[bytes]:
        """The bytes of some texts from the ids of all of them in a row, and how many each has."""
        numbers = np.repeat(np.arange(len(counts)), counts)
        parts: list[list[bytes]] = [[] for _ in counts]
        for first in range(0, len(ids), DECODE_ROWS):
            some = slice(first, first + DECODE_ROWS)
            held = {"n": pa.array(numbers[some]), "i": pa.array(np.arange(len(ids[some]))), "id": pa.array(ids[some])}
            n, tokens = (c.combine_chunks() for c in self.over(DECODE, "held", held).columns)
            # The tokens of a list lie one behind the other.
            values = tokens.flatten().cast(pa.large_binary())
            offsets = np.frombuffer(values.buffers()[1], np.int64)[values.offset : values.offset + len(values) + 1] if len(values) else np.zeros(1, np.int64)
            data = memoryview(values.buffers()[2] or b"")
            ends = np.cumsum([0, *tokens.value_lengths().to_pylist()])
            for k, start, end in zip(n.to_pylist(), offsets[ends[:-1]].tolist(), offsets[ends[1:]].tolist()):
                parts[k].append(bytes(data[start:end]))
        return [b"".join(p) for p in parts]


@lru_cache(maxsize=2)
def encoder_for(path: str, pattern: str) -> Encoder:
    return Encoder(path, pattern)


def decode(tokens: DataFrame, path: str, pattern: str, ids: str = "ids", to: str = "decoded") -> DataFrame:
    """``tokens`` with the bytes of the ids (null: none) as ``to``, which must be a new name."""
    names = tokens.columns
    at = names.index(ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_for(path, pattern)
        for batch in batches:
            lists = pc.fill_null(pc.list_value_length(batch.column(at)), 0).to_pylist()
            back = encoder.decode(batch.column(at).flatten().to_numpy(zero_copy_only=False).astype(np.int32), lists)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(back, pa.binary())], [*names, to])

    return tokens.mapInArrow(run, T.StructType([*tokens.schema.fields, T.StructField(to, T.BinaryType())]))


def encode(docs: DataFrame, path: str, pattern: str, text: str = "text", keep: list[str] | None = None, digests: bool = False) -> DataFrame:
    """``keep`` columns (all if not given) with ``ids`` (array of int) and ``decoded`` (binary).

    With ``digests``, ``n_tokens``, ``ids_sha256`` and ``decoded_sha256`` instead. A column of ``docs`` that has one of
    these names gets underscores put behind it.
    """
    names = docs.columns if keep is None else keep
    new = ["n_tokens", "ids_sha256", "decoded_sha256"] if digests else ["ids", "decoded"]
    kept = []
    for c in names:
        while c.lower() in new + [k.lower() for k in kept]:
            c += "_"
        kept.append(c)
    source = docs.select(*(F.col(c).alias(k) for c, k in zip(names, kept)), F.col(text).cast("string").alias("\u0000text"))
    kinds = [T.LongType(), T.StringType(), T.StringType()] if digests else [T.ArrayType(T.IntegerType()), T.BinaryType()]
    schema = T.StructType([*source.schema.fields[:-1], *(T.StructField(n, k) for n, k in zip(new, kinds))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_for(path, pattern)
        for batch in batches:
            column, first = batch.column(len(kept)), 0
            sizes = pc.fill_null(pc.binary_length(column), 0).to_pylist()
            while first < batch.num_rows:
                end, total = first, 0
                while end < batch.num_rows and (end == first or total + sizes[end] <= CHUNK_BYTES):
                    total += sizes[end]
                    end += 1
                cut = [encoder.split(t) if t else [] for t in column.slice(first, end - first).to_pylist()]
                encoder.encode_pieces(set().union(*cut))
                ids = [b"".join(map(encoder.known.__getitem__, pieces)) for pieces in cut]
                counts = [len(x) // 4 for x in ids]
                flat = np.frombuffer(b"".join(ids), "<i4")
                back = encoder.decode(flat, counts)
                if digests:
                    added = [
                        pa.array(counts, pa.int64()),
                        pa.array([hashlib.sha256(x).hexdigest() for x in ids]), pa.array([hashlib.sha256(x).hexdigest() for x in back]),
                    ]
                else:
                    ends = np.cumsum([0, *counts], dtype=np.int32)
                    added = [pa.ListArray.from_arrays(pa.array(ends), pa.array(flat)), pa.array(back, pa.binary())]
                rest = [c.slice(first, end - first) for c in batch.columns[: len(kept)]]
                yield pa.RecordBatch.from_arrays([*rest, *added], [*kept, *new])
                first = end
        del encoder
        encoder_for.cache_clear()
        vocabulary.cache_clear()
        spans.release()

    return source.mapInArrow(run, schema)
