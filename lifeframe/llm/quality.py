"""Quality rules whose cutoffs carry a guarantee.

Counts of a text become ratios, larger being worse. For every stratum (``lang``) one sequence of cutoff vectors, a cutoff
for each rule, is laid out on a part of the good labelled documents (one in ``SPLIT``, by a hash of the id): from far above all of their
ratios down to them, and then into them until each rule alone would take ``alpha``. The other good documents certify: going
from the loosest vector to stricter ones, a vector is taken while the exact binomial test rejects "more than ``alpha`` of
the good documents fall to any of its rules" at level ``delta`` / strata. The sequence does not depend on the documents
that it is tested on and stops at the first failure, which is fixed-sequence testing, so no correction over vectors or rules
is due; the division by strata is Bonferroni's. With probability 1 - ``delta`` all strata at once lose at most ``alpha`` of
their good documents to the rules together. A stratum with too few labels certifies nothing and loses nothing: without
losses ln(``delta`` / strata) / ln(1 - ``alpha``) certifying documents are needed, 217 for 4 strata.

Defined cases: a null or empty text has no words and fails the base rule; a null stratum is a stratum of its own; a
stratum without good labels has no cutoffs; a document with several labels is good only if all of its non-null
qualities are 1; repeated rows are judged alike; an empty table gives an empty result. Extra columns are passed over.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lifeframe.llm import spans
from lifeframe.session import materialize

WINDOW = 5
BINS = 50
SPLIT = 4  # one of so many good documents lays out the cutoffs, the others certify
STEPS = 50  # of the cutoffs among the ratios of good documents
_SYMBOLS = spans.members(b"#*$%&|<>")
_UPPER = spans.members(bytes(range(ord("A"), ord("Z") + 1)))
_DIGITS = spans.members(b"0123456789")
_MARKS = spans.members(b"!?;:\"'()[]{}=_~^@\\/`+")

COUNTS = (
    "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_digits", "n_marks",
    "n_distinct",
)
# Rule: a ratio of counts, larger being worse.
RULES = {
    "symbols": lambda c: c["n_symbols"] / c["word_chars"],
    "upper": lambda c: c["n_upper"] / c["word_chars"],
    "digits": lambda c: c["n_digits"] / c["word_chars"],
    "marks": lambda c: c["n_marks"] / c["word_chars"],
    "repeated_lines": lambda c: c["n_dup_lines"] / c["n_lines"],
    "repeated_words": lambda c: c["n_repeat_words"] / c["n_words"],
    "few_words": lambda c: 10 / c["n_words"],
    "long_words": lambda c: c["word_chars"] / (40 * c["n_words"]),
    "few_distinct_words": lambda c: 1 - c["n_distinct"] / c["n_words"],
}


def count_text(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """The counts of each row of a slice."""
    n = len(offsets) - 1
    starts, ends, row = spans.words(data, offsets)
    solid = np.zeros(len(data) + 1, np.int64)
    np.cumsum(~spans._SPACE[data], out=solid[1:])
    hashes = spans.hash_spans(data, starts, ends)
    out = {"n_words": np.bincount(row, minlength=n)}
    out["word_chars"] = spans.per_row(~spans._SPACE[data] & ((data & 0xC0) != 0x80), offsets)
    for name, table in (("n_symbols", _SYMBOLS), ("n_upper", _UPPER), ("n_digits", _DIGITS), ("n_marks", _MARKS)):
        out[name] = spans.per_row(table[data], offsets)

    line_starts, line_ends, line_row = spans.spans_of(data != 10, offsets)
    full = solid[line_ends] > solid[line_starts]
    line_starts, line_ends, line_row = line_starts[full], line_ends[full], line_row[full]
    _, later = spans.repeated(spans.hash_spans(data, line_starts, line_ends), line_row)
    out["n_lines"] = np.bincount(line_row, minlength=n)
    out["n_dup_lines"] = np.bincount(line_row[later], minlength=n)

    windows, first = spans.hash_windows(hashes, row, WINDOW)
    twice, _ = spans.repeated(windows, row[first])
    covered = np.zeros(len(row) + 1, np.int64)
    np.add.at(covered, first[twice], 1)
    np.add.at(covered, first[twice] + WINDOW, -1)
    out["n_repeat_words"] = np.bincount(row[np.cumsum(covered[:-1]) > 0], minlength=n)
    _, later = spans.repeated(hashes, row)
    out["n_distinct"] = out["n_words"] - np.bincount(row[later], minlength=n)
    return out


def _column_counts(column: pa.Array) -> dict[str, np.ndarray]:
    parts = [count_text(data, offsets) for _, _, data, offsets in spans.slices(column)]
    return {c: np.concatenate([p[c] for p in parts]).astype(np.int64) if parts else np.zeros(0, np.int64) for c in COUNTS}


def rule_bins(found: dict[str, np.ndarray]) -> np.ndarray:
    """rows x rules: the ratios as positions on a square-root scale of ``BINS`` steps; 0/0 is 0."""
    numbers = {c: v.astype(np.float64) for c, v in found.items()}
    with np.errstate(all="ignore"):
        ratios = np.stack([rule(numbers) for rule in RULES.values()], axis=1)
    return np.floor(BINS * np.sqrt(np.clip(np.nan_to_num(ratios, nan=0.0, posinf=0.0), 0, 1))).astype(np.int32)


def counts(docs: DataFrame, carried: list[str], text: str = "text") -> DataFrame:
    """``carried`` columns, the counts of ``text`` and the ``bins`` of its rules; the text itself is dropped."""
    source = docs.select(*carried, F.col(text).cast("string").alias(spans.free_name(carried, "text")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = _column_counts(batch.column(len(carried)))
            bins = rule_bins(found)
            ends = np.arange(len(bins) + 1, dtype=np.int32) * len(RULES)
            yield pa.RecordBatch.from_arrays(
                [
                    *batch.columns[: len(carried)], *(pa.array(found[c]) for c in COUNTS),
                    pa.ListArray.from_arrays(pa.array(ends), pa.array(bins.ravel())),
                ],
                [*carried, *COUNTS, "bins"],
            )

    schema = source.select(*carried).schema
    for c in COUNTS:
        schema = schema.add(c, "long")
    return source.mapInArrow(run, schema.add("bins", T.ArrayType(T.IntegerType())))


def base_failed() -> Column:
    """Too short, or too much of it repeats."""
    return F.expr("n_words < 10 or 100 * n_repeat_words > 20 * n_words")


def binomial_cdf(k: int, n: int, p: float) -> float:
    """P(X <= k) for X binomial(n, p), by the continued fraction of the incomplete beta function."""
    if k >= n:
        return 1.0
    a, b, x = n - k, k + 1, 1.0 - p
    log_front = math.lgamma(n + 1) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)
    if x < (a + 1) / (a + b + 2):
        return math.exp(log_front) * _fraction(a, b, x) / a
    return 1.0 - math.exp(log_front) * _fraction(b, a, 1.0 - x) / b


def _fraction(a: float, b: float, x: float) -> float:
    tiny = 1e-300
    c, d = 1.0, 1.0 - (a + b) * x / (a + 1)
    d = 1.0 / (d if abs(d) > tiny else tiny)
    total = d
    for m in range(1, 1_000_000):
        for step in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d, c = 1.0 + step * d, 1.0 + step / c
            d = 1.0 / (d if abs(d) > tiny else tiny)
            c = c if abs(c) > tiny else tiny
            total *= d * c
        if abs(d * c - 1.0) < 1e-14:
            break
    return total


def certified(held: np.ndarray, alpha: float, delta: float) -> int:
    """The strictest certified cutoff; ``held[b]`` good documents have bin ``b``, and a bin at or over the cutoff fails."""
    n, cut = int(held.sum()), len(held)
    lost = 0
    for b in range(len(held) - 1, 0, -1):
        lost += int(held[b])
        if not n or binomial_cdf(lost, n, alpha) > delta:
            break
        cut = b
    return cut


def sequence(held: np.ndarray, alpha: float) -> np.ndarray:
    """vectors x rules: cutoffs, strictest vector first; ``held[r, b]`` good documents have bin ``b`` of rule ``r``."""
    over = np.zeros((len(held), BINS + 2), np.int64)  # documents at or over a bin
    over[:, :-1] = held[:, ::-1].cumsum(axis=1)[:, ::-1]
    first = lambda lost: 1 + (over[:, 1:] <= lost).argmax(axis=1)
    inside = [first(alpha * held[0].sum() * step / STEPS) for step in range(STEPS, 0, -1)]
    above = [np.minimum(first(0) + margin, BINS + 1) for margin in range(BINS + 1)]
    return np.array(inside + above)


def cutoffs(
    counted: DataFrame, labels: DataFrame, id_col: str = "doc_id", stratum: str = "lang", alpha: float = 0.02, delta: float = 0.05
) -> DataFrame:
    """One row per stratum with ``cuts``: the first failing bin of each rule.

    What is aggregated is one row per stratum, rule and bin, and one per stratum and vector, whatever the number of documents.
    """
    key = F.col(id_col).alias("_id")
    good = labels.groupBy(key).agg(F.min("quality").alias("_quality")).filter("_quality = 1").select("_id")
    held = counted.filter(~base_failed()).select(key, F.coalesce(F.col(stratum).cast("string"), F.lit("")).alias("stratum"), "bins")
    lays = (F.pmod(F.xxhash64(F.lit("cutoffs"), "_id"), F.lit(SPLIT)) == 0).alias("lays")
    known = materialize(held.join(good, "_id", "left_semi").select("stratum", lays, "bins"), "quality-good")
    level = delta / max(1, known.select("stratum").distinct().count())
    table = known.filter("lays").select("stratum", F.posexplode("bins").alias("rule", "bin")).groupBy("stratum", "rule", "bin").count()

    def lay(pdf: pd.DataFrame) -> pd.DataFrame:
        held = np.zeros((len(RULES), BINS + 1), np.int64)
        held[pdf["rule"], pdf["bin"]] = pdf["count"]
        vectors = sequence(held, alpha)
        # Of each rule and bin, the loosest vector that it falls to, from 1; 0 for none.
        falls = [[int((vectors[:, r] <= b).sum()) for b in range(BINS + 1)] for r in range(len(RULES))]
        return pd.DataFrame({"stratum": [pdf["stratum"].iloc[0]], "vectors": [vectors.tolist()], "falls": [falls]})

    laid = materialize(table.groupBy("stratum").applyInPandas(lay, "stratum string, vectors array<array<int>>, falls array<array<int>>"), "quality-vectors")
    falls = F.array_max(F.transform("bins", lambda b, r: F.get(F.get("falls", r), b)))
    lost = known.filter("not lays").join(laid.select("stratum", "falls"), "stratum").select("stratum", falls.alias("vector")).groupBy("stratum", "vector").count()

    def choose(pdf: pd.DataFrame) -> pd.DataFrame:
        held = np.zeros(STEPS + BINS + 2, np.int64)
        held[pdf["vector"]] = pdf["count"]
        return pd.DataFrame({"stratum": [pdf["stratum"].iloc[0]], "vector": [certified(held, alpha, level)]})

    chosen = lost.groupBy("stratum").applyInPandas(choose, "stratum string, vector int").join(laid, "stratum")
    none = F.array_repeat(F.lit(BINS + 1), len(RULES))
    return materialize(chosen.select("stratum", F.coalesce(F.get("vectors", F.col("vector") - 1), none).alias("cuts")), "quality-cutoffs")


def judge(counted: DataFrame, chosen: DataFrame, stratum: str = "lang") -> DataFrame:
    """``counted`` with ``base_failed`` and ``kept``."""
    keyed = counted.withColumn("_stratum", F.coalesce(F.col(stratum).cast("string"), F.lit("")))
    joined = keyed.join(chosen.withColumnRenamed("stratum", "_stratum"), "_stratum", "left")
    over = F.exists(F.arrays_zip(F.col("bins").alias("b"), F.col("cuts").alias("c")), lambda x: x["b"] >= x["c"])
    failed = F.coalesce(base_failed(), F.lit(True))
    return (
        joined.withColumn("base_failed", failed)
        .withColumn("kept", ~failed & ~F.coalesce(over, F.lit(False)))
        .drop("_stratum", "cuts", "bins")
    )


def quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text", stratum: str = "lang", **risk: float) -> DataFrame:
    """Per document: id, the counts, ``base_failed`` and ``kept``."""
    counted = materialize(counts(docs, [id_col, stratum], text), "quality-counts")
    return judge(counted, cutoffs(counted, labels, id_col, stratum, **risk), stratum).drop(stratum)


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text", stratum: str = "lang", **risk: float) -> DataFrame:
    """The documents that pass, with all their columns.

    The cutoffs (one short row per stratum) are joined to the documents, and each task counts and filters its own
    rows; the texts are not shuffled.
    """
    chosen = cutoffs(counts(docs, [id_col, stratum], text), labels, id_col, stratum, **risk)
    names = docs.columns
    key, cuts, verdict = (spans.free_name(names, n) for n in ("_stratum", "_cuts", "_text"))
    joined = (
        docs.withColumns({key: F.coalesce(F.col(stratum).cast("string"), F.lit("")), verdict: F.col(text).cast("string")})
        .join(chosen.select(F.col("stratum").alias(key), F.col("cuts").alias(cuts)), key, "left")
        .select(*names, verdict, cuts)
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = _column_counts(batch.column(len(names)))
            passed = (found["n_words"] >= 10) & (100 * found["n_repeat_words"] <= 20 * found["n_words"])
            limits = [x if x is not None else [BINS + 1] * len(RULES) for x in batch.column(len(names) + 1).to_pylist()]
            passed &= (rule_bins(found) < np.array(limits, np.int32).reshape(-1, len(RULES))).all(axis=1)
            yield pa.RecordBatch.from_arrays(batch.columns[: len(names)], names).filter(pa.array(passed))
        spans.release()

    return joined.mapInArrow(run, docs.schema)
