"""Matches against brute force over all runs; recall on edited passages; clean documents stay."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest

from lifeframe.llm import decontaminate, spans


def plain_words(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[a-z0-9\u0080-\U0010ffff]+", lowered)


def plain_edits(item, text):
    """Fewest edits of ``item`` to any run of ``text``."""
    row = [0] * (len(text) + 1)
    for i, a in enumerate(item, 1):
        new = [i]
        for j, b in enumerate(text, 1):
            new.append(min(row[j - 1] + (a != b), row[j] + 1, new[-1] + 1))
        row = new
    return min(row)


def edited(rng, words, share):
    out = list(words)
    for _ in range(int(share * len(words))):
        k = rng.randrange(len(out))
        out[k : k + rng.randrange(2)] = [] if rng.random() < 0.3 else [f"new{rng.randrange(999)}"]
    return out


@pytest.fixture(scope="module")
def planted():
    rng = random.Random(1)
    vocabulary = ["".join(rng.choice("aeioustrnl") for _ in range(rng.randrange(2, 8))) for _ in range(300)]

    def sentence(n):
        return [rng.choice(vocabulary) for _ in range(n)]

    items = [(i, sentence(rng.choice([3, 5, 7, 10, 11, 14, 20, 34, 36, 60]))) for i in range(60)]
    docs, truth = [], set()
    for d in range(400):
        words = sentence(rng.randrange(0, 200))
        if d % 2:
            i, item = rng.choice(items)
            share = rng.choice([0, 0, 0.05, 0.1, 0.15])
            at = rng.randrange(len(words) + 1)
            words[at:at] = edited(rng, item, share)
        docs.append((d, words))
    for d, words in docs:
        for i, item in items:
            if len(item) < 5:
                continue
            allowed = int(round(0.2 * len(item), 9))
            if len(set(item) & set(words)) >= 0.6 * len(set(item)) and plain_edits(item, words) <= allowed:
                truth.add((d, i))
    return items, docs, truth


def test_against_brute_force(spark, documents, planted):
    items, docs, truth = planted
    text = {d: "  ".join(w.title() + (", " if k % 7 == 0 else "") for k, w in enumerate(words)) for d, words in docs}
    table = documents(list(text.items()), extra=("doc", "item", "edits"))
    benchmark = spark.createDataFrame([(i, " ".join(w), "x") for i, w in items] + [(77, None, "x"), (78, "", None)], "item_id long, text string, block string")
    got = decontaminate.contaminated(table, benchmark).collect()
    pairs = {(r["doc"], r["item"]) for r in got}
    assert pairs <= truth
    assert len(pairs) >= 0.97 * len(truth) and len(truth) > 120
    for r in got:
        assert r["edits"] == plain_edits(items[r["item"]][1], dict(docs)[r["doc"]])
    kept = decontaminate.keep_clean(table, benchmark)
    assert kept.columns == table.columns
    assert {r["doc_id"] for r in kept.collect()} == set(text) - {d for d, _ in pairs}


def test_blocks_give_the_same(spark, documents, planted, monkeypatch):
    items, docs, _ = planted
    table = documents([(d, " ".join(w)) for d, w in docs[:120]])
    benchmark = spark.createDataFrame([(i, " ".join(w)) for i, w in items], "item_id long, text string")
    whole = sorted(map(tuple, decontaminate.contaminated(table, benchmark).collect()))
    monkeypatch.setattr(decontaminate, "BLOCK_WORDS", 900)
    assert sorted(map(tuple, decontaminate.contaminated(table, benchmark).collect())) == whole
    assert len(decontaminate.keep_clean(table, benchmark).collect()) == 120 - len({d for d, *_ in whole})


def test_best_run():
    rng = random.Random(4)
    for _ in range(200):
        item = [rng.randrange(1, 5) for _ in range(rng.randrange(1, 70))]
        text = [rng.randrange(1, 5) for _ in range(rng.randrange(0, 90))]
        masks = {}
        for k, h in enumerate(item):
            masks[h] = masks.get(h, 0) | 1 << k
        assert decontaminate.best_run(masks, len(item), text)[0] == plain_edits(item, text)


@pytest.mark.parametrize(("words", "least"), [(5, 1.0), (8, 1.0), (10, 1.0), (11, 0.95), (15, 0.95), (19, 0.95), (24, 0.95), (35, 0.95), (36, 0.95), (37, 0.95), (40, 0.95), (60, 0.95)])
def test_recall_at_the_threshold(words, least):
    """Items with as many edits as they may have."""
    rng = random.Random(9)
    vocabulary = [f"w{i}" for i in range(400)]
    items = [[rng.choice(vocabulary) for _ in range(words)] for _ in range(300)]
    index = decontaminate.ItemIndex(list(range(300)), [" ".join(i) for i in items])
    texts = [" ".join([rng.choice(vocabulary) for _ in range(rng.randrange(50))] + edited(rng, i, 0.2) + [rng.choice(vocabulary) for _ in range(30)]) for i in items]
    near = set()
    for first, _, data, offsets in spans.slices(pa.array(texts)):
        near |= {first + t for t, i in decontaminate.matches(decontaminate.Words(data, offsets), index, 0.8) if first + t == i}
    truth = [t for t in range(300) if plain_edits(items[t], texts[t].split()) <= decontaminate.allowed_edits(words, 0.8)]
    assert len(truth) >= 200 and np.mean([t in near for t in truth]) >= least


def test_awkward(spark, documents, awkward):
    benchmark = spark.createDataFrame([(1, "a b a b a b"), (1, "a b a b a b"), (None, "no id at all still a text")], "item_id long, text string")
    got = sorted(map(str, map(tuple, decontaminate.contaminated(documents(awkward), benchmark).collect())))
    assert got == sorted(["(6, 1, 0, 6)", "(None, None, 0, 7)"])
    assert decontaminate.contaminated(documents([]), benchmark).count() == 0
    empty = benchmark.filter("item_id > 5")
    assert decontaminate.contaminated(documents(awkward), empty).count() == 0
    assert decontaminate.keep_clean(documents(awkward), empty).count() == len(awkward)


def test_only_runs_with_enough_common_words_are_compared(monkeypatch):
    """The count of common words passes every run that holds the item and spares nearly all others."""
    import random

    rng = random.Random(6)
    for _ in range(400):
        item = [rng.randrange(1, 12) for _ in range(rng.randrange(5, 20))]
        run = [rng.randrange(1, 12) for _ in range(rng.randrange(0, 40))]
        masks = {}
        for k, word in enumerate(item):
            masks[word] = masks.get(word, 0) | 1 << k
        edits, _ = decontaminate.best_run(masks, len(item), run)
        assert all(decontaminate.may_hold(masks, len(item), run, allowed) for allowed in range(edits, len(item) + 1))
    compared = []
    real = decontaminate.best_run
    monkeypatch.setattr(decontaminate, "best_run", lambda *args: compared.append(1) or real(*args))
    common = [f"w{i}" for i in range(40)]
    items = [" ".join(rng.choices(common, k=12) + [f"own{i}x{j}" for j in range(12)]) for i in range(20)]
    texts = [" ".join(item.split()[:12] + rng.choices(common, k=300)) for item in items] + [items[3] + " end"]
    column = pa.array(texts, pa.string())
    index = decontaminate.ItemIndex(list(range(20)), items)
    found = [m for _, _, data, offsets in spans.slices(column) for m in decontaminate.matches(decontaminate.Words(data, offsets), index, 0.8)]
    assert found == [(20, 3)] and len(compared) == 1
