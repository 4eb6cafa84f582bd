"""Secret scans: patterns, and what a guesser would need for values in credential contexts.

Base kinds are found by pattern: ``assign`` (a key word, a sign, a value of 12 or more characters), ``access`` (cloud
access keys) and ``hex`` (runs of 16 or more digits). The method adds kind ``guess``: the value behind a credential word and
``:``, ``=`` or ``=>`` if guessing it is expensive. Its cost is that of its cheapest segmentation, found by dynamic
programming over its positions, into

* words of a public vocabulary, by rank, with capitals, common substitutions and reversal at a factor,
* dates and years,
* repeats of a unit of up to ``UNIT`` characters,
* keyboard walks and runs of the alphabet or the digits,
* brute-force spans, by the size of each character's class,

each segment at an extra ``SEGMENT`` for the guess of where it begins. Values of ``GUESSES`` (log 10) or more count, unless one
base span covers them whole. Every segment of every kind is considered, of any length and count, so the cost is the least there is; the
time is linear in the value's length.

Spans are code points, end exclusive. Defined cases: a null text is an empty one and has none; ids may be null or repeat;
an empty table gives an empty result. Extra columns are passed over.
"""

from __future__ import annotations

import base64
import hashlib
import math
import re
import string
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

KINDS = ("assign", "access", "hex", "guess")
# The base patterns and lengths.
ASSIGN = re.compile(r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
LONG_HEX = re.compile(r"[0-9a-f]{16,}")  # the same runs without the short ones: a run is taken whole
ASSIGN_MIN, ACCESS_MIN, HEX_MIN = 12, 18, 16

CONTEXT = re.compile(
    r"""(?i:pass(?:word|wd|phrase|code)?|pwd|secret|token|api[_-]?key|access[_-]?key|private[_-]?key|credentials?|auth)"""
    r"""["']?[ \t]*(?::|=>|=)[ \t]*(?:"([^"\r\n]{6,}?)"|'([^'\r\n]{6,}?)'|([^\s"'<>]{6,}))""",
    re.A,
)
# One of these is in every text with a match of ASSIGN or CONTEXT, in lower case.
HINTS = ("pass", "pwd", "secret", "token", "key", "credential", "auth")

GUESSES = 10.0
SEGMENT = math.log10(4)
UNIT = 8
YEARS = math.log10(120)
DAYS = math.log10(365 * 40)
DATE = re.compile(r"(?:19|20)\d\d([-/._]?)(?:0?[1-9]|1[0-2])\1(?:0?[1-9]|[12]\d|3[01])|(?:0?[1-9]|[12]\d|3[01])([-/._]?)(?:0?[1-9]|1[0-2])\2(?:19|20)?\d\d")
YEAR = re.compile(r"19\d\d|20\d\d")
# Rows of a keyboard, and substitutions for letters.
ROWS = ("`1234567890-=", " qwertyuiop[]\\", " asdfghjkl;'", " zxcvbnm,./")
SHIFTED = str.maketrans('~!@#$%^&*()_+{}|:"<>?', "`1234567890-=[]\\;',./")
LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)
LEET = str.maketrans("@4301!5$7+", "aaeoiisstt")


@lru_cache(maxsize=2)
def word_ranks(path: str) -> dict[str, float]:
    """log10 of the rank of each word of three letters or more in a vocabulary ordered by frequency."""
    out: dict[str, float] = {}
    with open(path, "rb") as lines:
        for line in lines:
            token = base64.b64decode(line.split()[0]) if line.strip() else b""
            word = token.strip().decode("ascii", "replace").lower()
            if len(word) >= 3 and word.isascii() and word.isalpha() and word not in out:
                out[word] = math.log10(len(out) + 1)
    return out


@lru_cache(maxsize=1)
def _neighbours() -> frozenset[tuple[str, str]]:
    at = {c: (r, k) for r, row in enumerate(ROWS) for k, c in enumerate(row) if c != " "}
    return frozenset(
        (a, b) for a, (r, k) in at.items() for b, (s, m) in at.items() if (r == s and abs(k - m) == 1) or (s - r == 1 and m - k in (0, -1)) or (r - s == 1 and k - m in (0, -1))
    )


def _brute(c: str) -> float:
    return math.log10(10 if c.isdigit() else 26 if c.isascii() and c.isalpha() else 33 if c.isascii() else 100)


def _steps(value: str) -> tuple[list[bool], list[int]]:
    """For each character, whether the next one lies beside it on the keyboard, and whether it is one up or one down (1, -1, else 0)."""
    keys = value.translate(LOWER).translate(SHIFTED)
    near = _neighbours()
    beside = [pair in near for pair in zip(keys, keys[1:])]
    steps = [ord(b) - ord(a) if a.isalnum() and b.isalnum() else 0 for a, b in zip(value, value[1:])]
    return beside, [d if d in (1, -1) else 0 for d in steps]


def _capitals(part: str) -> float:
    """Factor for the capitals of a word."""
    upper = sum(c.isupper() for c in part)
    if not upper:
        return 0.0
    if upper == len(part) or part[0].isupper() and upper == 1:
        return math.log10(2)
    return math.log10(sum(math.comb(len(part), k) for k in range(1, upper + 1)))


def guess_cost(value: str, ranks: dict[str, float], repeats: bool = True) -> float:
    """log10 of the guesses of the cheapest segmentation into all segments there are.

    Brute force and walks cost so much per character, so the cheapest one that ends at a position is carried along. A repeat of a unit is kept as an
    open candidate until its run ends, unless an earlier one of the same run stays cheaper for good; a run has a few candidates whatever its length.
    """
    n = len(value)
    lower = value.translate(LOWER)
    plain = lower.translate(LEET)
    backward = plain[::-1]
    longest = max(map(len, ranks), default=0)
    beside, steps = _steps(value)
    step = math.log10(2)
    again = {u: [0] * (n + 1) for u in range(1, UNIT + 1)} if repeats else {}
    for u, same in again.items():
        for i in range(n - u - 1, -1, -1):
            same[i] = same[i + 1] + 1 if value[i] == value[i + u] else 0
    units: dict[str, float] = {}
    open_: dict[tuple[int, int], list[tuple[int, float, int]]] = {}  # (unit, residue): start, cost, last end
    best = [math.inf] * (n + 1)
    best[0] = 0.0
    brute = math.inf  # cheapest with a brute-force span that ends here
    walk = {"keys": (math.inf, math.inf), "order": (math.inf, math.inf)}  # with one step, with more, that end at this character
    for i in range(n + 1):
        for u in again:
            held = open_.get((u, i % u))
            if held:
                held[:] = [c for c in held if c[2] >= i]
                for start, cost, _ in held:
                    if i - start >= max(2 * u, 3):
                        best[i] = min(best[i], cost + math.log10((i - start) // u))
        if i == n:
            break
        here = best[i] + SEGMENT
        # Brute force goes on at no extra, or begins here.
        brute = min(brute, here) + _brute(value[i])
        best[i + 1] = min(best[i + 1], brute)
        for end in range(i + 3, min(n, i + longest) + 1):
            for text, extra in ((lower[i:end], 0.0), (plain[i:end], math.log10(4)), (backward[n - end : n - i], math.log10(8))):
                rank = ranks.get(text)
                if rank is not None:
                    best[end] = min(best[end], here + rank + extra + _capitals(value[i:end]))
        if value[i].isdigit():
            for end in range(i + 4, min(n, i + 10) + 1):
                if DATE.fullmatch(value, i, end):
                    best[end] = min(best[end], here + DAYS)
            if YEAR.match(value, i):
                best[i + 4] = min(best[i + 4], here + YEARS)
        if i + 1 < n:
            begun = here + math.log10(47) + step
            for kind, going, on in (
                ("keys", beside[i], i > 0 and beside[i - 1]), ("order", steps[i] != 0, i > 0 and steps[i] == steps[i - 1]),
            ):
                more = min(walk[kind]) + step if going and on else math.inf
                walk[kind] = (begun, more) if going else (math.inf, math.inf)
                best[i + 2] = min(best[i + 2], more)
        for u, same in again.items():
            if same[i] < u or (same[i] // u + 1) * u < 3:
                continue
            part = value[i : i + u]
            if part not in units:
                units[part] = guess_cost(part, ranks, repeats=False)
            cost, last = here + units[part], i + (same[i] // u + 1) * u
            held = open_.setdefault((u, i % u), [])
            if not any(c[2] == last and cost >= c[1] + math.log10(((i - c[0]) // u + 2) / 2) for c in held):
                held[:] = [c for c in held if c[2] != last or c[1] < cost]
                held.append((i, cost, last))
    return best[n]


def base_spans(text: str, hinted: bool) -> list[tuple[int, str, int]]:
    """(start, kind, end) of the base kinds, leftmost and without overlap within a kind."""
    found = []
    if hinted:
        found += [(m.start(), "assign", m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_MIN]
    if "AKIA" in text:
        found += [(m.start(), "access", m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= ACCESS_MIN]
    found += [(m.start(), "hex", m.end()) for m in LONG_HEX.finditer(text)]
    return found


def guessed_spans(text: str, base: list[tuple[int, str, int]], ranks: dict[str, float], guesses: float) -> list[tuple[int, str, int]]:
    """Values in credential contexts that no base span covers whole and that cost enough."""
    out = []
    for m in CONTEXT.finditer(text):
        start, end = next(m.span(k) for k in (1, 2, 3) if m[k] is not None)
        value = text[start:end].rstrip(".,;:!?)")
        end = start + len(value)
        if len(value) >= 6 and not any(a <= start and end <= b for a, _, b in base) and guess_cost(value, ranks) >= guesses:
            out.append((start, "guess", end))
    return out


def joined(found: list[tuple[int, str, int]]) -> str:
    ordered = sorted(found, key=lambda s: (s[0], KINDS.index(s[1]), s[2]))
    return ",".join(f"{kind}:{start}:{end}" for start, kind, end in ordered)


def scan(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text: str = "text", guesses: float = GUESSES) -> DataFrame:
    """(id, base, spans): the base spans and all spans as text (kind:start:end by start, comma-joined), and counts by kind."""
    source = docs.select(F.col(id_col).alias("id"), F.col(text).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks = word_ranks(vocabulary)
        for batch in batches:
            counts, bases, alls = {k: [] for k in KINDS}, [], []
            for scalar in batch.column(1):
                value = scalar.as_py() or ""
                low = value.lower()
                hinted = any(h in low for h in HINTS)
                base = base_spans(value, hinted)
                more = guessed_spans(value, base, ranks, guesses) if hinted else []
                for k in KINDS:
                    counts[k].append(sum(s[1] == k for s in base) + sum(s[1] == k for s in more))
                bases.append(joined(base))
                alls.append(joined(base + more))
            digests = [hashlib.sha256(b.encode()).hexdigest() for b in bases]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(counts[k], pa.int64()) for k in KINDS), pa.array(bases, pa.string()), pa.array(digests, pa.string()), pa.array(alls, pa.string())],
                ["id", *(f"n_{k}" for k in KINDS), "base", "base_sha256", "spans"],
            )

    added = [*(T.StructField(f"n_{k}", T.LongType()) for k in KINDS), *(T.StructField(c, T.StringType()) for c in ("base", "base_sha256", "spans"))]
    return source.mapInArrow(run, T.StructType([*source.select("id").schema.fields, *added]))
