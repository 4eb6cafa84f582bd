"""Counts against a plain count, bounds against the binomial sum, the guarantee on a planted table."""

import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from lifeframe.llm import quality


def plain(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    grams = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    covered = {i + k for i in range(len(words) - 4) if grams[tuple(words[i : i + 5])] > 1 for k in range(5)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(covered)


def test_counts(spark, documents, awkward, rows):
    rng = random.Random(3)
    more = [(100 + i, "".join(rng.choice("ab#\n é") for _ in range(rng.randrange(400)))) for i in range(60)]
    found = quality.counts(documents(awkward + more, extra=("n_words", "bins_")), ["doc_id"])
    got = rows(found, "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    assert Counter(got) == Counter((i, *plain(t)) for i, t in awkward + more)


@pytest.mark.parametrize(("k", "n", "p"), [(0, 10, 0.1), (3, 40, 0.05), (7, 1000, 0.004), (250, 500, 0.5), (10, 10, 0.3), (90, 100, 0.8)])
def test_binomial(k, n, p):
    exact = sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1))
    assert quality.binomial_cdf(k, n, p) == pytest.approx(exact, rel=1e-9)


def test_certified_is_the_strictest_in_sequence():
    held = [0] * (quality.BINS + 1)
    held[0], held[10], held[30] = 5000, 40, 2
    import numpy as np

    cut = quality.certified(np.array(held), 0.004, 0.01)
    assert cut == 11  # 2 of 5042 may go, 42 may not
    assert quality.certified(np.array([3] + [0] * quality.BINS), 0.004, 0.01) == quality.BINS + 1
    assert quality.certified(np.zeros(quality.BINS + 1, int), 0.004, 0.01) == quality.BINS + 1


def _planted():
    rng = random.Random(7)
    vocabulary = ["".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 8))) for _ in range(3000)]
    good = [(i, " ".join(rng.choice(vocabulary) for _ in range(60))) for i in range(4000)]
    bad = [(10_000 + i, " ".join(rng.choice(vocabulary) + "###" for _ in range(60))) for i in range(300)]
    return good, bad


def test_guarantee_and_effect(spark, documents, rows):
    good, bad = _planted()
    docs = documents(good + bad + [(1, good[1][1])]).withColumn("_cuts", F.lit(1)).withColumn("kept", F.lit("mine"))
    labels = spark.createDataFrame([(i, 1, 0) for i, _ in good] + [(i, 0, 0) for i, _ in bad] + [(None, None, None), (5, None, 1)], "doc_id long, quality int, toxic int")
    kept = quality.keep_good(docs, labels)
    assert kept.columns == docs.columns
    ids = [r[0] for r in kept.select("doc_id").collect()]
    assert not [i for i in ids if i >= 10_000]
    assert len(ids) >= 0.98 * 4001
    judged = quality.quality(docs.drop("kept"), labels)
    assert Counter(ids) == Counter(r[0] for r in judged.filter("kept").collect())


def test_some_hundred_labels_certify(spark, documents):
    """320 good labels in each of 4 strata give cutoffs that junk falls to; 100 give none."""
    good, bad = _planted()
    docs = None
    for k, lang in enumerate(["en", "de", "fr", None, "rare"]):
        n = 100 if lang == "rare" else 320
        part = documents([(i + 50_000 * k, t) for i, t in good[400 * k : 400 * k + n] + bad[:20]], lang=lang)
        docs = part if docs is None else docs.unionByName(part)
    labels = docs.selectExpr("doc_id", "if(doc_id % 50000 < 10000, 1, 0) as quality", "0 as toxic")
    cuts = {r["stratum"]: r["cuts"] for r in quality.cutoffs(quality.counts(docs, ["doc_id", "lang"]), labels).collect()}
    assert set(cuts) == {"en", "de", "fr", "", "rare"}
    assert all((min(c) <= quality.BINS) == (s != "rare") for s, c in cuts.items())
    kept = quality.keep_good(docs, labels).collect()
    assert {r["lang"] for r in kept if r["doc_id"] % 50_000 >= 10_000} == {"rare"}
    assert sum(r["doc_id"] % 50_000 < 10_000 for r in kept) >= 0.98 * 1380


def test_certified_loss_holds():
    """Over drawn tables with laying and certifying documents apart, the true loss exceeds alpha in at most delta of them."""
    import numpy as np

    rng = np.random.default_rng(2)
    rules, alpha, delta = len(quality.RULES), 0.02, 0.05
    draw = lambda n: np.minimum(rng.geometric(0.25, (n, rules)) + np.arange(rules), quality.BINS)
    every = draw(100_000)
    over = certified = 0
    for _ in range(200):
        vectors = quality.sequence(np.stack([np.bincount(c, minlength=quality.BINS + 1) for c in draw(100).T]), alpha)
        assert (np.diff(vectors, axis=0) >= 0).all() and vectors.min() >= 1
        falls = (vectors[None] <= draw(300)[:, None]).any(axis=2).sum(axis=1)
        k = quality.certified(np.bincount(falls, minlength=len(vectors) + 1), alpha, delta)
        if k <= len(vectors):
            certified += 1
            over += (every >= vectors[k - 1]).any(axis=1).mean() > alpha
    assert certified > 150 and over <= 0.09 * 200


def test_awkward_and_empty(spark, documents, awkward):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    judged = quality.quality(documents(awkward), labels)
    assert judged.count() == len(awkward)
    assert judged.filter("kept is null or base_failed is null").count() == 0
    assert quality.quality(documents([]), labels).count() == 0
    assert quality.keep_good(documents([]), labels).count() == 0
    kept = quality.keep_good(documents(awkward), labels)
    assert {r["doc_id"] for r in kept.collect()} == {r["doc_id"] for r in judged.filter("kept").collect()}
