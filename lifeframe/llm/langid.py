"""Language identification by segmentation-marginalised unigrams.

Every language has a probability for each piece of a fixed public vocabulary of byte strings. A word's probability is the
sum over all its segmentations into pieces, found by a forward pass; a text's is the product over its words; the language
with the largest wins, and ``score`` is its share among the languages (equal priors).

Words are runs of ASCII letters and bytes outside ASCII, in lower case, with one blank in front, of any length: scripts without
blanks are sums over all segmentations too. Forward passes run over the distinct words of a slice
of texts side by side. A word of over ``RUN`` bytes is taken in parts of ``RUN`` bytes: a pass finds, for all parts side by side, how the sums at the last
``PIECE`` places before a part turn into those at its end, and these matrices are multiplied in order, rescaled at each step, so
no probability underflows and work is linear in a text's length. Pieces have up to ``PIECE`` bytes.

Probabilities are fitted by expectation maximisation: expected counts of pieces over all segmentations (forward and backward)
of the words (of long ones, of their parts, cut between characters) of about ``SAMPLE`` training documents per language, which is the documented bound of the sample. Documents
are drawn by a hash of their text, and a text that repeats within a language counts once. What the driver receives is one number
per language and piece of the vocabulary.

Defined cases: a null text, or one without a letter, is ``und`` with score 0, and so is every text when there is nothing to learn
from; of languages with equal probability the first by name wins; an empty table gives an empty result. Extra columns are passed over.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lifeframe.llm import spans
from lifeframe.session import materialize

SAMPLE = 1000  # training documents per language, about
ROUNDS = 3
RUN = 31  # bytes of a word in one pass
LONG_PARTS = 500  # parts of a long word that are worked on at once
PIECE = 12  # longest piece, bytes
SMOOTH = 0.02
BLOCK = 20_000  # words in one forward pass
SLICE = 4 << 20  # bytes of text whose distinct words are scored together
UNKNOWN = "und"
_LETTER = np.zeros(256, bool)
_LETTER[ord("a") : ord("z") + 1] = _LETTER[ord("A") : ord("Z") + 1] = _LETTER[128:] = True
_STEP = np.uint64(0xD1342543DE82EF95)


@lru_cache(maxsize=2)
def pieces(path: str) -> PieceTable:
    with open(path, "rb") as lines:
        tokens = [base64.b64decode(line.split()[0]) for line in lines if line.strip()]
    useful = [t for t in tokens if len(t) <= PIECE and (len(t) == 1 or all(_LETTER[b] for b in t.removeprefix(b" ")) and t != b" ")]
    return PieceTable(sorted({t.lower() for t in useful} | {bytes([b]) for b in range(256)}))


class PieceTable:
    """Pieces by number, found by the hash of their bytes in an open table."""

    def __init__(self, tokens: list[bytes]):
        self.tokens = tokens
        hashes = np.array([self.hash_of(t) for t in tokens], np.uint64)
        self.bits = np.uint64(64 - 19)
        self.keys = np.zeros(1 << 19, np.uint64)
        self.numbers = np.full(1 << 19, len(tokens), np.int32)  # the number behind the last means: no piece
        self.probes = 1
        for n, h in enumerate(hashes):
            at, tries = int(spans.mix(h.reshape(1))[0] >> self.bits), 1
            while self.keys[at]:
                at, tries = (at + 1) % len(self.keys), tries + 1
            self.keys[at], self.numbers[at] = h, n
            self.probes = max(self.probes, tries)

    @staticmethod
    def hash_of(token: bytes) -> int:
        h = 0
        for b in token:
            h = (h * int(_STEP) + b + 1) % 2**64
        return h

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """Numbers of the pieces with these hashes."""
        at = (spans.mix(hashes) >> self.bits).astype(np.int64)
        out = np.where(self.keys[at] == hashes, self.numbers[at], len(self.tokens))
        missing = np.flatnonzero((self.keys[at] != hashes) & (self.keys[at] != 0))
        for _ in range(self.probes - 1):
            if not len(missing):
                break
            at[missing] = (at[missing] + 1) % len(self.keys)
            hit = self.keys[at[missing]] == hashes[missing]
            out[missing[hit]] = self.numbers[at[missing[hit]]]
            missing = missing[~hit & (self.keys[at[missing]] != 0)]
        return out


def lattice(table: PieceTable, words: np.ndarray, size: int) -> Iterator[tuple[int, int, np.ndarray]]:
    """(begin, end, piece numbers) of all spans of words of one size (rows of bytes)."""
    ahead = np.zeros((size + 1, len(words)), np.uint64)
    for k in range(size):
        ahead[k + 1] = ahead[k] * _STEP + words[:, k] + np.uint64(1)
    powers = np.array([pow(int(_STEP), k, 1 << 64) for k in range(size + 1)], np.uint64)
    for end in range(1, size + 1):
        for begin in range(max(0, end - PIECE), end):
            yield begin, end, table.find(ahead[end] - ahead[begin] * powers[end - begin])


def by_size(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(size with the blank, which words, their bytes with the blank) in blocks."""
    for size in np.unique(sizes):
        of = np.flatnonzero(sizes == size)
        for first in range(0, len(of), BLOCK):
            part = of[first : first + BLOCK]
            rows = np.full((len(part), size + 1), 32, np.uint64)
            rows[:, 1:] = data[starts[part][:, None] + np.arange(size)]
            yield int(size) + 1, part, rows


def log_probabilities(table: PieceTable, chances: np.ndarray, data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """words x languages: log of the sum over all segmentations. ``chances`` is pieces x languages, its last row 0."""
    out = np.zeros((len(starts), chances.shape[1]))
    short = np.flatnonzero(sizes <= RUN)
    for size, part, rows in by_size(data, starts[short], sizes[short]):
        forward = np.zeros((size + 1, len(part), chances.shape[1]))
        forward[0] = 1.0
        for begin, end, numbers in lattice(table, rows, size):
            some = np.flatnonzero(numbers < len(table.tokens))
            forward[end, some] += forward[begin, some] * chances[numbers[some]]
        out[short[part]] = np.log(forward[size])
    for word in np.flatnonzero(sizes > RUN).tolist():
        out[word] = long_word(table, chances, data[starts[word] : starts[word] + sizes[word]])
    return out


def long_word(table: PieceTable, chances: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Per language the log of the sum over all segmentations of one word of any length."""
    ahead = PIECE - 1  # bytes before a part that pieces may begin at
    padded = np.concatenate([np.zeros(ahead, np.uint8), [32], word]).astype(np.uint64)
    ends = [*range(RUN, len(word) + 1, RUN), len(word) + 1]
    # The sums at the last PIECE places, nearest first; in the beginning only the empty segmentation.
    state, log = np.zeros((chances.shape[1], PIECE, 1)), np.zeros(chances.shape[1])
    state[:, 0] = 1.0
    for first in range(0, len(ends), LONG_PARTS):
        some = ends[first : first + LONG_PARTS]
        begin = 0 if first == 0 else ends[first - 1]
        sizes = np.diff([begin, *some])
        at = np.cumsum([begin, *sizes[:-1]])
        found = np.zeros((len(some), chances.shape[1], PIECE, PIECE))
        for size in np.unique(sizes).tolist():
            of = np.flatnonzero(sizes == size)
            found[of] = transfers(table, chances, padded[at[of][:, None] + np.arange(ahead + size)])
        for matrix in found:
            state = matrix @ state
            most = state.max(axis=1, keepdims=True)
            log += np.log(most[:, 0, 0])
            state /= most
    return log + np.log(state[:, 0, 0])


def transfers(table: PieceTable, chances: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """parts x languages x PIECE x PIECE: the sums at the last places of each part, from those before it. Rows begin with ``PIECE`` - 1 bytes before the part."""
    size = rows.shape[1]
    forward = np.zeros((size + 1, len(rows), chances.shape[1], PIECE))
    for j in range(PIECE):
        forward[PIECE - 1 - j, :, :, j] = 1.0
    for begin, end, numbers in lattice(table, rows, size):
        if end >= PIECE:
            some = np.flatnonzero(numbers < len(table.tokens))
            forward[end, some] += forward[begin, some] * chances[numbers[some]][:, :, None]
    return np.stack([forward[size - i] for i in range(PIECE)], axis=2)


def expected_counts(table: PieceTable, chances: np.ndarray, data: np.ndarray, starts: np.ndarray, sizes: np.ndarray, language: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """pieces x languages: expected counts over all segmentations of words, each in its language."""
    counts = np.zeros((len(table.tokens) + 1) * chances.shape[1])
    wide = chances.shape[1]
    for size, part, rows in by_size(data, starts, sizes):
        edges = list(lattice(table, rows, size))
        own = language[part]
        chance = [chances[numbers, own] for _, _, numbers in edges]
        forward, backward = np.zeros((size + 1, len(part))), np.zeros((size + 1, len(part)))
        forward[0] = backward[size] = 1.0
        for (begin, end, _), p in zip(edges, chance):
            forward[end] += forward[begin] * p
        for (begin, end, _), p in sorted(zip(edges, chance), key=lambda e: -e[0][1]):
            backward[begin] += backward[end] * p
        scale = weight[part] / forward[size]
        for (begin, end, numbers), p in zip(edges, chance):
            counts += np.bincount(numbers.astype(np.int64) * wide + own, forward[begin] * p * backward[end] * scale, len(counts))
    return counts.reshape(-1, wide)[:-1]


def word_runs(data: np.ndarray, offsets: np.ndarray, cut: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, row) of words; if wanted, long ones cut between characters into parts of up to ``RUN`` bytes."""
    starts, ends, row = spans.spans_of(_LETTER[data], offsets)
    if not cut or not len(starts) or (ends - starts).max() <= RUN:
        return starts, ends, row
    parts: list[tuple[int, int, int]] = []
    for start, end, of in zip(starts.tolist(), ends.tolist(), row.tolist()):
        while end - start > RUN:
            stop = start + RUN
            while stop > start + RUN - 4 and data[stop] & 0xC0 == 0x80:  # inside a character
                stop -= 1
            parts.append((start, stop, of))
            start = stop
        parts.append((start, end, of))
    out = np.array(parts, np.int64).reshape(-1, 3)
    return out[:, 0], out[:, 1], out[:, 2]


def distinct_words(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first place of each distinct word, number of the distinct word of each word)."""
    _, first, which = np.unique(spans.hash_spans(data, starts, ends), return_index=True, return_inverse=True)
    return first, which


def _words_of_language(rows: DataFrame, languages: list[str]) -> DataFrame:
    """(language, word, n) over ``rows`` (language, text), added up."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            language = batch.column(0).to_numpy(zero_copy_only=False)
            for first, _, data, offsets in spans.slices(batch.column(1)):
                starts, ends, row = word_runs(data, offsets, cut=True)
                at, which = distinct_words(data, starts, ends)
                keys, n = np.unique(which * len(languages) + language[first + row].astype(np.int64), return_counts=True)
                word = at[keys // len(languages)]
                raw = data.tobytes()
                texts = [raw[a:b] for a, b in zip(starts[word].tolist(), ends[word].tolist())]
                yield pa.RecordBatch.from_arrays(
                    [pa.array((keys % len(languages)).astype(np.int32)), pa.array(texts, pa.binary()), pa.array(n.astype(np.int64))], ["language", "word", "n"]
                )

    return rows.mapInArrow(run, "language int, word binary, n bigint").groupBy("language", "word").agg(F.sum("n").alias("n"))


class Model:
    """Languages in order of name, and pieces x languages probabilities."""

    def __init__(self, path: str, languages: list[str], chances: np.ndarray):
        self.path, self.languages, self.chances = path, languages, chances


def _smoothed(counts: np.ndarray) -> np.ndarray:
    """Probabilities, with a last row of zeros for what is no piece."""
    raised = counts + SMOOTH
    return np.vstack([raised / raised.sum(axis=0), np.zeros((1, counts.shape[1]))])


def fit(train: DataFrame, path: str, text: str = "text", lang: str = "lang", sample: int = SAMPLE, rounds: int = ROUNDS) -> Model:
    """Fit on the rows whose ``lang`` is not null, about ``sample`` of each language."""
    rows = train.select(F.col(lang).cast("string").alias("lang"), F.lower(F.col(text).cast("string")).alias("text")).filter("lang is not null and text is not null")
    sizes = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    languages = sorted(sizes)
    table = pieces(path)
    counts = np.ones((len(table.tokens), len(languages)))
    if not languages:
        return Model(path, [], counts)
    shares = F.create_map(*(x for k in languages for x in (F.lit(k), F.lit(min(1.0, sample / sizes[k])))))
    numbers = F.create_map(*(x for i, k in enumerate(languages) for x in (F.lit(k), F.lit(i))))
    draw = F.pmod(F.xxhash64("text"), F.lit(1_000_000)) / 1_000_000
    taken = rows.filter(draw < shares[F.col("lang")]).select(numbers[F.col("lang")].alias("language"), "text").distinct()
    words = materialize(_words_of_language(taken, languages), "langid-words")
    context = train.sparkSession.sparkContext
    for _ in range(rounds):
        held = context.broadcast(_smoothed(counts))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            table, chances = pieces(path), held.value
            total = np.zeros((len(table.tokens), chances.shape[1]))
            for batch in batches:
                if not batch.num_rows:
                    continue
                _, _, data, offsets = next(spans.slices(batch.column(1), 1 << 40))
                language, n = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 2))
                total += expected_counts(table, chances, data, offsets[:-1], np.diff(offsets), language, n.astype(np.float64))
            piece, language = np.nonzero(total)
            yield pa.RecordBatch.from_arrays(
                [pa.array(piece.astype(np.int32)), pa.array(language.astype(np.int32)), pa.array(total[piece, language])], ["piece", "language", "n"]
            )

        found = words.mapInArrow(run, "piece int, language int, n double").groupBy("piece", "language").agg(F.sum("n").alias("n")).toArrow()
        counts = np.zeros_like(counts)
        piece, language, n = (found.column(c).to_numpy() for c in ("piece", "language", "n"))
        counts[piece, language] = n
        held.destroy()
    return Model(path, languages, _smoothed(counts))


def has_letter(text: str | None) -> bool:
    return bool(text) and any(c.isalpha() for c in text)


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text: str = "text", extra: dict[str, Column] | None = None) -> DataFrame:
    """(id, extra columns, lang_pred, score)."""
    carried = {"id": F.col(id_col), **(extra or {})}
    source = docs.select(*(c.alias(n) for n, c in carried.items()), F.lower(F.col(text).cast("string")).alias("text"))
    names = list(carried)
    held = docs.sparkSession.sparkContext.broadcast((model.path, model.languages, model.chances))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path, languages, chances = held.value
        table = pieces(path)
        for batch in batches:
            guesses, scores = [], []
            for first, end, data, offsets in spans.slices(batch.column(len(names)), SLICE):
                starts, ends, row = word_runs(data, offsets)
                total = np.zeros((end - first, max(1, len(languages))))
                if len(starts) and languages:
                    at, which = distinct_words(data, starts, ends)
                    logs = log_probabilities(table, chances, data, starts[at], (ends - starts)[at])
                    for k in range(len(languages)):
                        total[:, k] = np.bincount(row, logs[which, k], end - first)
                best = total.argmax(axis=1)
                share = 1.0 / np.exp(total - total.max(axis=1, keepdims=True)).sum(axis=1)
                letters = spans.per_row(_LETTER[data] & (data < 128), offsets) > 0
                for i in np.flatnonzero(~letters).tolist():
                    letters[i] = has_letter(bytes(data[offsets[i] : offsets[i + 1]]).decode("utf-8", "replace"))
                known = letters & bool(languages)
                guesses += [languages[b] if ok else UNKNOWN for b, ok in zip(best.tolist(), known.tolist())]
                scores += np.where(known, share, 0.0).tolist()
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[: len(names)], pa.array(guesses, pa.string()), pa.array(scores, pa.float64())], [*names, "lang_pred", "score"]
            )

    return source.mapInArrow(run, source.select(*names).schema.add("lang_pred", "string").add("score", "double"))
