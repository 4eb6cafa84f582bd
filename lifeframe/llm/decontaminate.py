"""Benchmark decontamination under edits.

A text and an item are sequences of words (runs of letters, digits and non-ASCII characters, A-Z in lower case). A
document holds an item if some run of its words turns into the item's words by at most (1 - ``similarity``) * n single
word edits, n being the item's number of words.

Candidates come from the CGK embedding: a walk over a window copies the word at its pointer to the output and then, by
a random bit of (step, word), moves on or stays, so sequences a few edits apart fall into step again and their outputs
differ in few places. Bit-sampling LSH keys are hashes of ``PLACES`` random places of the output; ``WALKS`` walks with
``SAMPLES`` keys each reach the target recall. Windows are item-sized: 32, 16 or 8 words, the largest that fits into
an item at some offsets. Items are indexed at every offset, so texts need windows at every ``STRIDE``-th word only, and one walk serves
windows of all sizes. Each candidate is verified by the exact edit distance of the whole item to the best run of words.

Items of 5 to 10 words are too short for a window. Cut into one part more than they may have edits, one part stands as it is, so they are
found by hashes of their parts, and verified like the others; no such match is missed. Items of fewer than 5 words say
nothing about a text and match none (``MIN_WORDS``).

The item index is broadcast in blocks of at most ``BLOCK_WORDS`` item words; a larger benchmark takes one pass over
the documents per block.

Defined cases: null and empty texts or items match nothing; ids may be null or repeat, repeated rows give one match per
(document id, item id); an empty table gives an empty result. Extra columns are passed over.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.core.broadcast import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from lifeframe.llm import spans
from lifeframe.session import materialize

SIMILARITY = 0.8
MIN_WORDS = 5
SIZES = (32, 16, 8)
STRIDE = 4
WALKS, SAMPLES, PLACES = 4, 8, 5
BLOCK_WORDS = 100_000
WINDOWS = 8192  # walked at a time
SEED = 11
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
_WORD = np.zeros(256, bool)
_WORD[ord("0") : ord("9") + 1] = _WORD[ord("a") : ord("z") + 1] = _WORD[128:] = True


class Words:
    """The words of some texts as hashes, with a stop after each text that no walk leaves."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        data = _LOWER[data]
        starts, ends, row = spans.spans_of(_WORD[data], offsets)
        self.count = np.bincount(row, minlength=len(offsets) - 1)
        self.first = np.cumsum(self.count) - self.count + np.arange(len(self.count))  # of each text, stops counted
        self.hashes = np.zeros(len(row) + len(self.count), np.uint64)
        self.hashes[np.arange(len(row)) + row] = spans.hash_spans(data, starts, ends) | np.uint64(1)

    def windows(self, stride: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, text, offset in the text) of every ``stride``-th word."""
        each = -(-self.count // stride)
        text = np.repeat(np.arange(len(each)), each)
        offset = (np.arange(len(text)) - np.repeat(np.cumsum(each) - each, each)) * stride
        return self.first[text] + offset, text, offset


def _steps(size: int) -> int:
    """Steps after which a walk over a window has hardly ever passed its end."""
    return size + size // 2


def sample_places() -> dict[tuple[int, int], np.ndarray]:
    """Places of the embedding for each (size, walk): samples x places."""
    rng = np.random.default_rng(SEED)
    return {
        (size, w): np.stack([np.sort(rng.choice(_steps(size), PLACES, replace=False)) for _ in range(SAMPLES)])
        for size in SIZES
        for w in range(WALKS)
    }


def embed_keys(words: Words, starts: np.ndarray) -> Iterator[tuple[int, int, int, np.ndarray]]:
    """(size, table, first window, keys of up to ``WINDOWS`` windows from that one) for every LSH table, window by window block.

    A key is the sum of the words at its places, each times a factor of its walk and place. Blocks are small enough to stay in a processor's cache.
    """
    places = sample_places()
    needed = {w: sorted({int(p) for size in SIZES for p in places[size, w].ravel()}) for w in range(WALKS)}
    symbols = words.hashes ^ (words.hashes >> np.uint64(29))
    for w in range(WALKS):
        bits = spans.mix(words.hashes ^ np.uint64(0xA0761D6478BD642F * (w + 1) % 2**64))
        bits[words.hashes == 0] = 0
        factors = spans.mix(np.arange(needed[w][-1] + 1, dtype=np.uint64) + np.uint64((w + 1) << 32)) | np.uint64(1)
        wanted = set(needed[w])
        for first in range(0, len(starts), WINDOWS):
            at, out = starts[first : first + WINDOWS].copy(), {}
            for step in range(needed[w][-1] + 1):
                if step in wanted:
                    out[step] = symbols.take(at)
                    out[step] *= factors[step]
                move = bits.take(at)
                move >>= np.uint64(step)
                move &= np.uint64(1)
                at += move.view(np.int64)
            for size in SIZES:
                for t, sample in enumerate(places[size, w]):
                    key = out[int(sample[0])] + out[int(sample[1])]
                    for p in sample[2:]:
                        key += out[int(p)]
                    yield size, w * SAMPLES + t, first, key


class Table:
    """Keys of one LSH table: a bit map to pass by what is surely absent, and the entries by key."""

    def __init__(self, keys: np.ndarray, entries: np.ndarray):
        order = np.argsort(keys, kind="stable")
        self.keys, self.entries = keys[order], entries[order]
        width = max(10, int(16 * max(1, len(keys))).bit_length())
        self.shift = np.uint64(64 - width)
        self.present = np.zeros(1 << width, bool)
        self.present[(keys >> self.shift).view(np.int64)] = True

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(which key, entry) for all equal keys."""
        maybe = np.flatnonzero(self.present.take((keys >> self.shift).view(np.int64)))
        low, high = (np.searchsorted(self.keys, keys[maybe], side) for side in ("left", "right"))
        n = high - low
        which = np.repeat(maybe, n)
        return which, self.entries[np.repeat(low, n) + np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n)]


class ItemIndex:
    """Items of one block, ready to be looked up."""

    def __init__(self, ids: list[int], texts: list[str | None], similarity: float = SIMILARITY):
        column = pa.array(texts, pa.string())
        parts = [Words(data, offsets) for _, _, data, offsets in spans.slices(column, 1 << 40)]
        self.ids = ids
        words = parts[0] if parts else Words(np.zeros(0, np.uint8), np.zeros(1, np.int64))
        self.items = [words.hashes[f : f + n].tolist() for f, n in zip(words.first, words.count)]
        self.masks: list[dict[int, int]] = [{} for _ in self.items]
        for item, masks in zip(self.items, self.masks):
            for k, h in enumerate(item):
                masks[h] = masks.get(h, 0) | 1 << k
        # A text meets about every STRIDE-th window of an item, so a size needs some offsets to spare.
        fits = np.array([next((s for s in SIZES if n >= s + 2 * STRIDE), SIZES[-1] if n >= SIZES[-1] + STRIDE - 1 else 0) for n in words.count], np.int64)
        starts, text, offset = words.windows(1)
        inside = offset + fits[text] <= words.count[text]
        self.tables: dict[tuple[int, int], Table] = {}
        held: dict[tuple[int, int], list[tuple[np.ndarray, np.ndarray]]] = {}
        for size, t, first, keys in embed_keys(words, starts):
            block = slice(first, first + len(keys))
            own = np.flatnonzero((fits[text[block]] == size) & inside[block])
            if len(own):
                held.setdefault((size, t), []).append((keys[own], own + first))
        for table, found in held.items():
            keys, own = (np.concatenate(part) for part in zip(*found))
            self.tables[table] = Table(keys, np.stack([text[own], offset[own]], axis=1))
        self.parts: dict[int, dict[int, list[tuple[int, int]]]] = {}  # length, hash of the part, (item, offset of the part)
        for i in np.flatnonzero((fits == 0) & (words.count >= MIN_WORDS)).tolist():
            n = int(words.count[i])
            cuts = np.linspace(0, n, allowed_edits(n, similarity) + 2).astype(int).tolist()
            for at, end in zip(cuts, cuts[1:]):
                run = words.hashes[words.first[i] + at : words.first[i] + end]
                whole, _ = spans.hash_windows(run, np.zeros(len(run), np.int64), len(run))
                self.parts.setdefault(len(run), {}).setdefault(int(whole[0]), []).append((i, at))

    def candidates(self, words: Words) -> set[tuple[int, int, int]]:
        """{(text, item, about where the item begins)}"""
        starts, text, offset = words.windows(STRIDE)
        near: set[tuple[int, int, int]] = set()
        if self.tables and len(starts):
            for size, t, first, keys in embed_keys(words, starts):
                held = self.tables.get((size, t))
                if held is not None:
                    which, entries = held.find(keys)
                    if len(which):
                        which += first
                        near.update(zip(text[which].tolist(), entries[:, 0].tolist(), (offset[which] - entries[:, 1]).tolist()))
        row = np.repeat(np.arange(len(words.count)), words.count + 1) if self.parts else None
        for n, items in self.parts.items():
            hashes, first = spans.hash_windows(words.hashes, row, n)
            for k in np.flatnonzero(np.isin(hashes, np.fromiter(items, np.uint64, len(items)))).tolist():
                place = int(first[k])
                here = int(row[place])
                near.update((here, i, place - int(words.first[here]) - at) for i, at in items[int(hashes[k])])
        return near


def allowed_edits(n: int, similarity: float) -> int:
    """Word edits that an item of ``n`` words may have."""
    return int(round((1 - similarity) * n, 9))


def best_run(masks: dict[int, int], n: int, text: list[int]) -> tuple[int, int]:
    """(fewest edits of an item of ``n`` words to any run of ``text``, end of that run), bit-parallel over the item."""
    full, top = (1 << n) - 1, 1 << (n - 1)
    up, down, edits, best, end = full, 0, n, n, 0
    for k, word in enumerate(text, 1):
        eq = masks.get(word, 0)
        cross = (((eq & up) + up) ^ up) | eq | down
        right, left = down | (full & ~(cross | up)), up & cross
        if right & top:
            edits += 1
        elif left & top:
            edits -= 1
        right, left = (right << 1) & full, (left << 1) & full
        eq |= down
        up, down = left | (full & ~(eq | right)), right & eq
        if edits < best:
            best, end = edits, k
    return best, end


def may_hold(masks: dict[int, int], n: int, text: list[int], allowed: int) -> bool:
    """Whether enough words of an item of ``n`` words are in ``text``, in any order: each that has no partner there is an edit."""
    held = [word for word in text if word in masks]
    if len(held) < n - allowed:
        return False
    return sum(min(masks[word].bit_count(), k) for word, k in Counter(held).items()) >= n - allowed


def matches(words: Words, index: ItemIndex, similarity: float) -> dict[tuple[int, int], tuple[int, int]]:
    """{(text, item): (edits, word before which the best run ends)} of what passes verification."""
    found: dict[tuple[int, int], tuple[int, int]] = {}
    regions: dict[tuple[int, int], list[int]] = {}
    for text, i, at in index.candidates(words):
        regions.setdefault((text, i), []).append(at)
    for (text, i), places in regions.items():
        n = len(index.items[i])
        allowed = allowed_edits(n, similarity)
        first, count = int(words.first[text]), int(words.count[text])
        places.sort()
        low = high = None
        spans_: list[tuple[int, int]] = []
        for at in places:  # overlapping regions are searched once
            a, b = max(0, at - 2 * allowed), min(count, at + n + 2 * allowed)
            if low is not None and a <= high:
                high = max(high, b)
            else:
                if low is not None:
                    spans_.append((low, high))
                low, high = a, b
        spans_.append((low, high))
        for a, b in spans_:
            run = words.hashes[first + a : first + b].tolist()
            if not may_hold(index.masks[i], n, run, allowed):
                continue
            edits, end = best_run(index.masks[i], n, run)
            if edits <= allowed:
                found[text, i] = min(found.get((text, i), (n, 0)), (edits, a + end))
    return found


def _blocks(benchmark: DataFrame, item_col: str, item_text: str) -> list[Broadcast]:
    """The items as broadcast (ids, texts), each of about ``BLOCK_WORDS`` words at most, dealt by a hash."""
    items = benchmark.select(F.col(item_col).alias("item"), F.col(item_text).cast("string").alias("text")).distinct()
    size = F.greatest(F.length(F.coalesce("text", F.lit(""))) / 4, F.lit(1))
    total = items.select(F.sum(size)).first()[0] or 0
    blocks = max(1, int(-(-total * 1.5 // BLOCK_WORDS)))
    dealt = materialize(items.withColumn("block", F.pmod(F.xxhash64("item", "text"), F.lit(blocks))), "benchmark-blocks")
    context, out = benchmark.sparkSession.sparkContext, []
    for block in range(blocks):
        rows = dealt.filter(F.col("block") == block).collect()
        out.append(context.broadcast(([r["item"] for r in rows], [r["text"] for r in rows])))
    return out


def contaminated(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text: str = "text", item_col: str = "item_id", item_text: str = "text",
    similarity: float = SIMILARITY,
) -> DataFrame:
    """(doc, item, edits, end): every document and item that it holds, with the fewest edits and the word it ends before."""
    source = docs.select(F.col(id_col).alias("doc"), F.col(text).cast("string").alias("text"))
    kind = benchmark.schema[item_col].dataType
    arrow = to_arrow_type(kind)
    schema = source.select("doc").schema.add("item", kind).add("edits", "integer").add("end", "integer")
    parts = []
    for block in _blocks(benchmark, item_col, item_text):

        def run(batches: Iterator[pa.RecordBatch], block: Broadcast = block) -> Iterator[pa.RecordBatch]:
            index = ItemIndex(*block.value, similarity)
            names = pa.array(index.ids, arrow)
            for batch in batches:
                for first, _, data, offsets in spans.slices(batch.column(1)):
                    found = matches(Words(data, offsets), index, similarity)
                    texts, items = ([k[i] for k in found] for i in (0, 1))
                    edits, ends = ([v[i] for v in found.values()] for i in (0, 1))
                    yield pa.RecordBatch.from_arrays(
                        [
                            batch.column(0).take(pa.array([first + t for t in texts], pa.int64())), names.take(pa.array(items, pa.int64())),
                            pa.array(edits, pa.int32()), pa.array(ends, pa.int32()),
                        ],
                        ["doc", "item", "edits", "end"],
                    )

        parts.append(source.mapInArrow(run, schema))
    found = reduce(DataFrame.unionByName, parts)
    best = F.min(F.struct("edits", "end"))
    return found.groupBy("doc", "item").agg(best.alias("b")).select("doc", "item", "b.edits", "b.end")


def keep_clean(
    docs: DataFrame, benchmark: DataFrame, text: str = "text", item_col: str = "item_id", item_text: str = "text", similarity: float = SIMILARITY
) -> DataFrame:
    """The documents that hold no item, with all their columns. Each task judges its own rows; nothing is shuffled."""
    names = docs.columns
    string = spans.free_name(names, "_text")
    for block in _blocks(benchmark, item_col, item_text):

        def run(batches: Iterator[pa.RecordBatch], block: Broadcast = block) -> Iterator[pa.RecordBatch]:
            index = ItemIndex(*block.value, similarity)
            for batch in batches:
                clean = np.ones(batch.num_rows, bool)
                for first, _, data, offsets in spans.slices(batch.column(len(names))):
                    clean[[first + t for t, _ in matches(Words(data, offsets), index, similarity)]] = False
                yield pa.RecordBatch.from_arrays(batch.columns[: len(names)], names).filter(pa.array(clean))
            spans.release()

        docs = docs.withColumn(string, F.col(text).cast("string")).mapInArrow(run, docs.schema)
    return docs
