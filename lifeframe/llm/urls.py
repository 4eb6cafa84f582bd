"""URL filters with a bit-parallel wildcard automaton.

Rules are globs over ``.host/path`` of a URL, host in lower case, without query and fragment: ``*`` stands for any
characters but ``/``, ``**`` for any characters, ``?`` for one character but ``/``. All globs are packed into the words of
one Shift-And automaton, one bit for each glob and number of its characters matched. For every byte of the URLs the
whole set moves on at once: shift left with a carry from word to word, keep the bits whose next character is that
byte, and keep those that wait at a wildcard. A batch of URLs is run side by side.

``HostRule`` (a host and all its subdomains, a path beginning) becomes the glob ``*.host/path**``, which cannot match inside a path
because ``*`` does not cross ``/``. Of the host rules that fit, the longest decides; else the globs do: block if one fits.

Defined cases: a null URL or one without ``://`` has an empty host and path, and no rule fits it; of equally long rules the
first given decides; an empty table gives an empty result. Extra columns are passed over.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lifeframe.llm import spans

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

# Blocked where no host rule fits: link farms by host name, and paths that are no documents.
DEFAULT_GLOBS = (
    "*.spam*/**",
    "*.spam*",
    "*casino*/**",
    "*.ads.*/**",
    "*.doubleclick.*/**",
    "**/wp-login.php",
    "**/cgi-bin/**",
    "**/login/**",
    "**.exe",
    "**.zip",
)


class HostRule(NamedTuple):
    verdict: str
    host: str
    path: str

    @property
    def glob(self) -> str:
        return f"*.{self.host}{self.path}**"


def tokens(glob: str) -> list[int | str]:
    """Byte values, and ``*``, ``**`` and ``?``."""
    out: list[int | str] = []
    rest = glob
    while rest:
        wild = next((w for w in ("**", "*", "?") if rest.startswith(w)), None)
        if wild:
            out.append(wild)
            rest = rest[len(wild) :]
        else:
            out.extend(rest[0].encode())
            rest = rest[1:]
    return out


class Automaton:
    """All globs in one bit vector of as many 64-bit words as needed."""

    def __init__(self, globs: Sequence[str]):
        steps: list[np.ndarray] = []  # bytes on which the bit is reached from the one before
        waits: list[np.ndarray] = []  # bytes on which the bit stays
        begin, end = [], []
        any_, same_part = np.ones(256, bool), np.ones(256, bool)
        same_part[ord("/")] = False
        none = np.zeros(256, bool)
        for glob in globs:
            begin.append(len(steps))
            steps.append(none)
            waits.append(none)
            for t in tokens(glob):
                if t in ("*", "**"):
                    waits[-1] = waits[-1] | (any_ if t == "**" else same_part)
                else:
                    accepted = none.copy()
                    accepted[same_part if t == "?" else t] = True
                    steps.append(accepted)
                    waits.append(none)
            end.append(len(steps) - 1)
        self.words = max(1, -(-len(steps) // 64))
        self.step, self.wait = self._packed(steps), self._packed(waits)
        self.begin = self._bits(begin)
        self.end = [(k // 64, np.uint64(k % 64)) for k in end]

    def _packed(self, rows: list[np.ndarray]) -> np.ndarray:
        """words x 256 masks from one row of 256 flags per bit."""
        out = np.zeros((self.words, 256), np.uint64)
        for k, row in enumerate(rows):
            out[k // 64] |= row.astype(np.uint64) << np.uint64(k % 64)
        return out

    def _bits(self, places: list[int]) -> np.ndarray:
        out = np.zeros(self.words, np.uint64)
        for k in places:
            out[k // 64] |= np.uint64(1) << np.uint64(k % 64)
        return out

    def run(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """texts x globs: which globs match the whole text."""
        sizes = np.diff(offsets)
        order = np.argsort(-sizes, kind="stable")
        start, sizes_down = offsets[:-1][order], sizes[order]
        state = [np.full(len(order), b, np.uint64) for b in self.begin]
        one, high = np.uint64(1), np.uint64(63)
        live = len(order)
        for k in range(int(sizes_down[0]) if len(order) else 0):
            while sizes_down[live - 1] <= k:
                live -= 1
            byte = data[start[:live] + k]
            carry = None
            for w in range(self.words):
                old = state[w][:live]
                moved = old << one
                if carry is not None:
                    moved |= carry
                carry = old >> high
                state[w][:live] = moved & self.step[w][byte] | old & self.wait[w][byte]
        out = np.zeros((len(order), len(self.end)), bool)
        for g, (w, bit) in enumerate(self.end):
            out[order, g] = (state[w] >> bit) & one == one
        return out


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z in lower case; empty without ``://``."""
    return F.translate(F.regexp_extract(_rest(url), r"^[^/?#]*", 0), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """What follows the host, up to ``?``, ``#`` or the end."""
    return F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1)


def _rest(url: Column) -> Column:
    at = F.locate("://", url)
    return F.when(at > 0, F.substr(url, at + 3, F.length(url))).otherwise("")


def judge(pages: DataFrame, rules: Sequence[HostRule], globs: Sequence[str] = DEFAULT_GLOBS, id_col: str = "page_id", url: str = "url") -> DataFrame:
    """(id, host, path, rule, verdict, globs): the host rule that decides, and the globs that match."""
    source = pages.select(F.col(id_col).alias("id"), F.coalesce(F.col(url).cast("string"), F.lit("")).alias("url"))
    canonical = source.select("id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path")).withColumn(
        "subject", F.concat(F.lit("."), "host", "path")
    )
    longest_first = sorted(rules, key=lambda r: -len(r.host + r.path))
    names = [r.host + r.path for r in longest_first]
    every = [*(r.glob for r in longest_first), *globs]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = Automaton(every)
        for batch in batches:
            for first, end, data, offsets in spans.slices(batch.column(3)):
                hits = automaton.run(data, offsets)
                base, more = hits[:, : len(names)], hits[:, len(names) :]
                decided = np.where(base.any(axis=1), base.argmax(axis=1) if names else -1, -1).tolist()
                blocked = more.any(axis=1)
                verdicts = [longest_first[d].verdict if d >= 0 else "block" if b else "allow" for d, b in zip(decided, blocked)]
                matched = [[globs[g] for g in np.flatnonzero(row)] if b else [] for row, b in zip(more, blocked)]
                rest = [c.slice(first, end - first) for c in batch.columns[:3]]
                yield pa.RecordBatch.from_arrays(
                    [*rest, pa.array([names[d] if d >= 0 else None for d in decided], pa.string()), pa.array(verdicts, pa.string()), pa.array(matched, pa.list_(pa.string()))],
                    ["id", "host", "path", "rule", "verdict", "globs"],
                )

    schema = canonical.drop("subject").schema.add("rule", "string").add("verdict", "string").add("globs", T.ArrayType(T.StringType()))
    return canonical.mapInArrow(run, schema)
