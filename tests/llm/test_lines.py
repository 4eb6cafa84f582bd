"""Cuckoo filters, reversible line dedup, and the plain rule by brute force."""

import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from lifeframe.llm import lines


def plain(rows, lost=None):
    """Texts after dedup, by the rule as it is stated; ``lost`` gets the number of lines that go, by id."""
    holders = defaultdict(set)

    def key(line):
        k = line.strip(" \t\n\x0b\x0c\r")
        return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in k)

    for i, text in rows:
        for line in (text or "").split("\n"):
            holders[key(line)].add(-1 if i is None else i)
    out = []
    for i, text in rows:
        kept = [
            x for x in (text or "").split("\n")
            if not (len(key(x)) >= 20 and len(holders[key(x)]) >= 3 and (-1 if i is None else i) < max(holders[key(x)]))
        ]
        if lost is not None:
            lost[i] = len((text or "").split("\n")) - len(kept)
        out.append((i, "\n".join(kept) if text is not None else None))
    return out


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(4)
    pool = [f"Line number {k} that several documents SHARE é" for k in range(25)] + ["short", "", "  ", "x" * 19, "é" * 19, "é" * 20, " \t" + "y" * 20 + "\r"]
    return [(i, "\n".join(rng.choice(pool + [f"unique line {i} {rng.random()}"]) for _ in range(rng.randrange(12)))) for i in range(80)]


def shown(df):
    return sorted(map(str, ((r["doc_id"], r["text"]) for r in df.collect())))


def test_cuckoo():
    rng = np.random.default_rng(1)
    halves = rng.integers(0, 2**63, 50_000).astype(np.uint64)
    found = lines.Cuckoo.load(lines.Cuckoo.build(halves).dump())
    assert found.holds(halves).all()
    others = rng.integers(0, 2**63, 50_000).astype(np.uint64)
    assert found.holds(others).mean() < 0.01
    for h in halves[:500].tolist():
        assert found.delete(h)
    assert found.holds(halves[500:]).all()
    assert found.holds(halves[:500]).mean() < 0.05
    for few in (0, 1, 3):
        small = lines.Cuckoo.build(halves[:few])
        assert small.holds(halves[:few]).all()
    same = np.full(100, 7, np.uint64)
    assert lines.Cuckoo.build(same).holds(same).all()


def test_overflow_is_exact():
    full = lines.Cuckoo(np.full((2, 4), 9, np.uint16), np.array([3, 5], np.uint64))
    assert full.holds(np.array([3, 5], np.uint64)).all() and full.delete(5)
    assert full.overflow.tolist() == [3]


@pytest.mark.parametrize("exact_only", [False, True])
def test_against_brute_force(spark, documents, corpus, awkward, exact_only):
    rows = corpus + awkward + [(500, corpus[3][1]), (None, corpus[3][1])]
    docs = documents(rows, extra=("_doc", "_keys", "key"))
    index = lines.LineIndex(spark)
    index.insert(docs)
    kept = index.apply(docs, exact_only=exact_only)
    assert kept.columns == docs.columns
    assert shown(kept) == sorted(map(str, plain(rows)))


def test_deletion_undoes_insertion(spark, documents, corpus):
    docs, extra = documents(corpus[:40]), documents(corpus[40:])
    index = lines.LineIndex(spark)
    index.insert(docs)
    before = shown(index.apply(docs))
    assert before == sorted(map(str, plain(corpus[:40])))
    index.insert(extra)
    together = {i: t for i, t in plain(corpus)}
    assert shown(index.apply(docs)) == sorted(str((i, together[i])) for i, _ in corpus[:40])
    index.delete(extra.select("doc_id"))
    assert shown(index.apply(docs)) == before


def test_shards_and_empty(spark, documents, corpus, monkeypatch):
    monkeypatch.setattr(lines, "SHARD_KEYS", 4)
    docs = documents(corpus)
    index = lines.LineIndex(spark)
    index.insert(docs)
    assert index.shards > 2
    assert shown(index.apply(docs)) == sorted(map(str, plain(corpus)))
    counted = lines.dedup_lines(docs, n_lines="n", n_dropped="gone").collect()
    assert Counter({r["doc_id"]: r["n"] for r in counted}) == Counter({i: len(t.split("\n")) for i, t in corpus})
    lost = {}
    plain(corpus, lost)
    assert {r["doc_id"]: r["gone"] for r in counted} == lost
    assert lines.dedup_lines(documents([])).count() == 0
