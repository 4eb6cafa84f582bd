"""Fingerprints against a plain computation, components against brute force over all pairs, hot keys included."""

import random
import re

import numpy as np
import pytest
import xxhash

from lifeframe.llm import components, simhash


def plain_print(text, k):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lowered)
    shingles = [" ".join(words[i : i + k]) for i in range(len(words) - k + 1)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute(values, distance):
    """Component number by value, over all pairs."""
    values = sorted(set(values))
    root = {v: v for v in values}

    def find(v):
        while root[v] != v:
            root[v] = root[root[v]]
            v = root[v]
        return v

    array = np.array(values, np.uint64)
    for v in values:
        for w in array[np.bitwise_count(array ^ np.uint64(v)) <= distance].tolist():
            a, b = find(v), find(w)
            root[max(a, b)] = min(a, b)
    return {v: find(v) for v in values}


@pytest.mark.parametrize("k", [3, 5])
def test_fingerprints(spark, documents, awkward, k):
    rng = random.Random(5)
    more = [(100 + i, " \n".join(rng.choice(["A", "bé", "C,", "d"]) for _ in range(rng.randrange(12)))) for i in range(80)]
    got = simhash.fingerprints(documents(awkward + more), shingle=k).collect()
    assert sorted((str(r[0]), r[1] % 2**64) for r in got) == sorted((str(i), plain_print(t, k)) for i, t in awkward + more)


@pytest.mark.parametrize("hot", [2])
def test_links_connect_what_brute_force_connects(spark, monkeypatch, hot):
    monkeypatch.setattr(simhash, "HOT", hot)
    rng = random.Random(hot)
    values = {rng.getrandbits(64) for _ in range(200)} | {0, 2**64 - 1, 7, 2**63}
    for centre in [rng.getrandbits(64) for _ in range(12)]:
        for _ in range(60):
            v = centre
            for _ in range(rng.randrange(5)):
                v ^= 1 << rng.randrange(64)
            values.add(v)
    signed = [v - 2**64 if v >= 2**63 else v for v in values]
    prints = spark.createDataFrame([(v,) for v in signed], "print long")
    found = {r["node"] % 2**64: r["root"] % 2**64 for r in components.components(simhash.links(prints)).collect()}
    expected = brute(values, 3)
    groups = {}
    for v in values:
        groups.setdefault(expected[v], set()).add(v)
    got = {}
    for v in values:
        got.setdefault(found.get(v, v), set()).add(v)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, got.values()))


def test_query_columns(spark, documents, awkward):
    docs = documents(awkward + [(20, "Same TEXT here again")], extra=("print", "component", "root"))
    got = simhash.linked(docs).collect()
    assert len(got) == len(awkward) + 1
    by = {r["id"]: r["component"] for r in got}
    assert by[8] == by[9] == by[20] == 8
    assert by[1] == by[2] == by[3] == 1
    assert simhash.linked(documents([])).count() == 0
    only_null = simhash.linked(documents([(None, "a b c d"), (None, "a b c d")])).collect()
    assert [r["component"] for r in only_null] == [None, None]


def test_keep_one(spark, documents):
    base = " ".join(f"w{i * 37 % 101}" for i in range(300))
    docs = documents([(5, base), (3, base), (9, base), (4, "something else entirely is in this one here"), (None, base)], extra=("id", "_id"))
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == ["3", "4", "None"]


def jaccard(a, b):
    x, y = ({tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (a.split(), b.split()))
    return len(x & y) / len(x | y)


@pytest.mark.parametrize("hot", [4])
def test_near_copies(spark, documents, monkeypatch, hot):
    monkeypatch.setattr(simhash, "WIDE_HOT", hot)
    rng = random.Random(hot)
    texts = {}
    for group in range(25):
        base = [f"w{rng.randrange(500)}" for _ in range(rng.randrange(80, 400))]
        texts[100 * group] = " ".join(base)
        for copy in range(1, 7):
            words = list(base)
            for _ in range(max(1, len(words) // 150)):
                words[rng.randrange(len(words))] = f"new{rng.randrange(10**6)}"
            texts[100 * group + copy] = " ".join(words)
    found = {r["id"]: r["component"] for r in simhash.wide_linked(documents(list(texts.items()))).collect()}
    assert all(found[i] // 100 == i // 100 for i in texts)  # nothing else is linked
    close = [(i, j) for i in texts for j in texts if i < j and i // 100 == j // 100 and jaccard(texts[i], texts[j]) >= 0.9]
    assert len(close) > 200
    assert np.mean([found[i] == found[j] for i, j in close]) >= 0.95


@pytest.mark.parametrize("far", [False, True])
def test_wide_links_of_hot_keys_connect_what_brute_force_connects(spark, monkeypatch, far):
    """Whole and wildcard keys of far over GROUP fingerprints; ``far`` puts the pivot away from the others."""
    monkeypatch.setattr(simhash, "WIDE_HOT", 4)
    monkeypatch.setattr(simhash, "GROUP", 4)
    distance, rng = 48, np.random.default_rng(8)
    lanes = rng.integers(0, 2**64, (150, simhash.LANES), np.uint64)

    def flipped(row, bits):
        row = row.copy()
        for bit in rng.integers(0, 64 * simhash.LANES, bits):
            row[bit // 64] ^= np.uint64(1) << np.uint64(bit % 64)
        return row

    # Chains whose neighbours are within the distance, some of them just so, and a group around one centre.
    for k in range(0, 60, 6):
        for j in range(1, 6):
            lanes[k + j] = flipped(lanes[k + j - 1], int(rng.integers(38, 52)))
    for k in range(61, 100):
        lanes[k] = flipped(lanes[60], int(rng.integers(1, 30)))
    # One segment in common, in some with one bit changed: most pairs meet on a single key.
    segment = np.uint64((1 << simhash.SEGMENT) - 1)
    lanes[:, 0] = lanes[:, 0] & ~segment | lanes[0, 0] & segment
    lanes[::3, 0] ^= np.uint64(1) << rng.integers(0, 3, len(lanes[::3])).astype(np.uint64)
    names = list(range(150))
    if far:
        names[149] = -1
    # Meeting: a segment differs by one bit at most.
    apart = lanes[:, None] ^ lanes[None, :]
    low, high = (np.bitwise_count(apart >> np.uint64(s) & segment) for s in (0, simhash.SEGMENT))
    linked = (np.minimum(low, high).min(axis=2) <= 1) & (np.bitwise_count(apart).sum(axis=2, dtype=int) <= distance)
    root = list(range(150))
    for _ in range(150):
        root = [min(root[j] for j in np.flatnonzero(linked[i])) for i in range(150)]
    table = spark.createDataFrame([(n, x) for n, x in zip(names, lanes.view(np.int64).tolist())], "print long, lanes array<long>")
    links = [(names.index(a), names.index(b)) for a, b in simhash.wide_links(table, distance).collect()]
    assert all(linked[a, b] for a, b in links)
    got = list(range(150))
    for _ in range(150):
        for a, b in links:
            got[a] = got[b] = min(got[a], got[b])
    assert got == root and 20 < len(set(root)) < 100


def test_long_chain(spark):
    pairs = spark.createDataFrame([(i, i + 1) for i in range(30)] + [(200, 300), (300, 200), (7, 7)], "a long, b long")
    found = {r["node"]: r["root"] for r in components.components(pairs).collect()}
    assert all(found[i] == 0 for i in range(31)) and found[300] == 200 and found[200] == 200
    assert components.components(pairs.filter("a < 0")).count() == 0


@pytest.mark.parametrize("few", [-1, 100_000])
def test_exploded_keys_are_not_broadcast(spark, documents, monkeypatch, few):
    """Files of fingerprints are small, their keys are not: no join takes the keys to the driver, beyond few rows none takes anything."""
    written, real = [], simhash.materialize

    def watch(df, name):
        written.append(df)
        return real(df, name)

    for module in (simhash, components):
        monkeypatch.setattr(module, "materialize", watch)
    monkeypatch.setattr(components, "FEW", few, raising=False)
    rng = random.Random(3)
    texts = [(i, " ".join(f"w{rng.randrange(90)}" for _ in range(12))) for i in range(300)]
    found = simhash.linked(documents(texts + [(300 + i, t) for i, t in texts[:40]]))
    assert {r["component"] for r in found.collect() if r["id"] >= 300} == set(range(40))
    plans = [df._jdf.queryExecution().executedPlan().toString() for df in [*written, found]]
    keyed = [p for p in plans if "Generate explode" in p and "Join" in p]
    # Few hot keys may be broadcast, in each of their three uses.
    assert keyed and all("SortMergeJoin" in p and p.count("BroadcastExchange") <= (3 if few > 0 else 0) for p in keyed)
    assert few > 0 or not any("BroadcastExchange" in p for p in plans)
