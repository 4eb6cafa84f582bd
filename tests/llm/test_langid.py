"""Forward passes against a sum over all segmentations; accuracy on held-out texts; defined cases."""

import math
import random
import time
from fractions import Fraction

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import functions as F

from lifeframe.llm import langid, spans

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def segmentations(word, table):
    if not word:
        yield []
    for n in range(1, min(langid.PIECE, len(word)) + 1):
        if word[:n] in table:
            for rest in segmentations(word[n:], table):
                yield [word[:n], *rest]


def test_forward_and_counts_are_sums_over_segmentations():
    table = langid.pieces(PATH)
    number = {t: i for i, t in enumerate(table.tokens)}
    rng = np.random.default_rng(3)
    chances = langid._smoothed(rng.random((len(table.tokens), 2)) ** 8)
    words = [b"the", b"a", "été".encode(), b"thing", b"zzqx", b"station"]
    data = np.frombuffer(b"".join(words), np.uint8)
    sizes = np.array([len(w) for w in words])
    starts = np.cumsum(sizes) - sizes
    logs = langid.log_probabilities(table, chances, data, starts, sizes)
    language, weight = np.array([0, 1, 0, 1, 0, 1]), np.array([1.0, 2, 3, 4, 5, 6])
    counts = langid.expected_counts(table, chances, data, starts, sizes, language, weight)
    expected = np.zeros_like(counts)
    for w, (word, k, n) in enumerate(zip(words, language, weight)):
        ways = [[number[p] for p in s] for s in segmentations(b" " + word, number)]
        assert len(ways) > 1
        totals = np.array([np.prod(chances[way], axis=0) for way in ways])
        assert np.allclose(logs[w], np.log(totals.sum(axis=0)))
        for way, chance in zip(ways, totals[:, k] / totals[:, k].sum()):
            for p in way:
                expected[p, k] += n * chance
    assert np.allclose(counts, expected)


def test_long_words_are_cut_for_fitting_only():
    _, _, data, offsets = next(spans.slices(pa.array(["a" * 100, "é1b", "", "x" * 31, "東" * 12])))
    starts, ends, row = langid.word_runs(data, offsets, cut=True)
    assert (ends - starts).tolist() == [31, 31, 31, 7, 2, 1, 31, 30, 6] and row.tolist() == [0, 0, 0, 0, 1, 1, 3, 4, 4]
    starts, ends, row = langid.word_runs(data, offsets)
    assert (ends - starts).tolist() == [100, 2, 1, 31, 36] and row.tolist() == [0, 1, 1, 3, 4]


def test_words_of_any_length_are_summed_over_all_segmentations(monkeypatch):
    """Across the borders of parts, against a pass over one word with exact fractions of any size."""
    table = langid.pieces(PATH)
    number = {t: i for i, t in enumerate(table.tokens)}
    chances = langid._smoothed(np.random.default_rng(4).random((len(table.tokens), 2)) ** 6)
    monkeypatch.setattr(langid, "LONG_PARTS", 3)
    rng = random.Random(8)
    words = ["東京都庁舎前広場東京都庁", "internationalisation" * 5, "x" * 400, "".join(rng.choice(["the", "ing", "é", "ß", "京", "sch"]) for _ in range(150))]
    words += ["".join(rng.choice("etaoin") for _ in range(n)) for n in (31, 32, 61, 62, 63, 92, 93, 94, 95)]
    raw = [w.encode() for w in words]
    data = np.frombuffer(b"".join(raw), np.uint8)
    sizes = np.array([len(w) for w in raw])
    logs = langid.log_probabilities(table, chances, data, np.cumsum(sizes) - sizes, sizes)
    for w, word in enumerate(raw):
        whole = b" " + word
        for k in range(2):
            sums = [Fraction(1)]
            for end in range(1, len(whole) + 1):
                pieces = ((begin, whole[begin:end]) for begin in range(max(0, end - langid.PIECE), end))
                sums.append(sum((sums[b] * Fraction(chances[number[p], k]) for b, p in pieces if p in number), Fraction(0)))
            exact = math.log(sums[-1].numerator) - math.log(sums[-1].denominator)
            assert math.isclose(logs[w, k], exact, rel_tol=1e-9), (word, k)


def test_long_words_take_linear_time():
    table = langid.pieces(PATH)
    chances = langid._smoothed(np.ones((len(table.tokens), 4)))
    data = np.frombuffer("東京都庁舎".encode() * 20_000, np.uint8)
    began = time.monotonic()
    assert np.isfinite(langid.log_probabilities(table, chances, data, np.array([0]), np.array([len(data)]))).all()
    assert time.monotonic() - began < 60


def texts(rng, syllables, n):
    return [" ".join("".join(rng.choice(syllables) for _ in range(rng.randrange(1, 4))) for _ in range(rng.randrange(4, 40))) for _ in range(n)]


def test_held_out_accuracy_and_cases(spark, documents, awkward):
    rng = random.Random(12)
    kinds = {"en": ["the", "ing", "er", "wh"], "fr": ["eau", "oi", "é", "que"], "de": ["sch", "ung", "ß", "ei"]}
    rows = [(lang, t) for lang, syllables in kinds.items() for t in texts(rng, syllables, 120)]
    train = spark.createDataFrame([(t, lang) for lang, t in rows[::2]] + [(None, "en"), ("the", None), ("", "fr")], "text string, lang string")
    model = langid.fit(train, PATH)
    assert model.languages == ["de", "en", "fr"]
    test = spark.createDataFrame([(i, t, lang) for i, (lang, t) in enumerate(rows[1::2])], "doc_id long, text string, score string")
    got = langid.predict(test, model, extra={"truth": F.col("score")}).collect()
    assert sum(r["lang_pred"] == r["truth"] for r in got) >= 0.98 * len(got)
    assert all(0 < r["score"] <= 1 for r in got)
    odd = langid.predict(documents([*awkward, (70, "123 --- !!"), (71, "—"), (72, "é"), (73, "東京")]), model).collect()
    assert len(odd) == len(awkward) + 4
    by = {r["id"]: r for r in odd}
    for i in (1, 2, 3, 70, 71):
        assert (by[i]["lang_pred"], by[i]["score"]) == ("und", 0.0)
    assert by[72]["lang_pred"] == "fr" and by[73]["lang_pred"] != "und"
    assert langid.predict(documents([]), model).count() == 0
    nothing = langid.fit(train.filter("false"), PATH)
    assert {r["lang_pred"] for r in langid.predict(documents(awkward), nothing).collect()} == {"und"}
