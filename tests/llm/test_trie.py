"""The trie against one built in memory, turn by turn."""

import hashlib
import zlib
from collections import Counter, defaultdict

import pytest

from lifeframe.llm import trie

SCHEMA = "conv_id long, turn long, role string, text string"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def brute(rows):
    convs = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            convs[conv].append((turn is not None, turn or 0, sha(f"{len(role.encode())}:{role}{text}"), role, text))
    own = {c: [t[3:] for t in sorted(ts)] for c, ts in convs.items()}
    members, ends = defaultdict(list), defaultdict(list)
    for c, mine in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        base = c - (c % 5 if c >= 0 else -(-c % 5))
        whole = tuple(own.get(base, [])[:h] + mine[h:])
        # A sequence is named by the hashes of its prefixes, so that long ones are no quadratic keys.
        name = ""
        members[0, ""].append((c, None, 0))
        for d, turn in enumerate(whole, 1):
            before, name = name, sha(name + repr(turn))
            members[d, name].append((c, before, len(turn[1].encode())))
        ends[len(whole), name].append(c)
    kids = defaultdict(list)
    for d, name in members:
        if d:
            kids[d - 1, members[d, name][0][1]].append((d, name))
    leaves, saved, out = {}, {}, Counter()
    for node in sorted(members, reverse=True):
        held = members[node]
        leaves[node] = sum(leaves[k] for k in kids[node]) or 1
        saved[node] = sum(saved[k] for k in kids[node]) + (len(held) - 1) * held[0][2]
        parent = min(c for c, *_ in members[node[0] - 1, held[0][1]]) if node[0] else None
        text = ",".join(map(str, sorted(ends[node])))
        out[min(c for c, *_ in held), node[0], parent, len(held), len(kids[node]), leaves[node], saved[node], sha(text)] += 1
    return out


def found(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    return Counter(tuple(r) for r in trie.trie(*trie.rebuild(trie.turns(df))).collect())


def check(spark, rows):
    assert found(spark, rows) == brute(rows)


def test_shared_beginnings_and_ends(spark):
    """Many conversations that are all alike, so that one node holds more ids than a piece, and some that branch off."""
    rows = [(c, t, "user", f"turn {t}") for c in range(4300) for t in range(2)]
    rows += [(5000 + c, t, "user" if t % 2 else "assistant", f"turn {t if t < c % 7 else (c, t)}") for c in range(60) for t in range(c % 9)]
    check(spark, rows)


@pytest.mark.parametrize("deep", [40, 2500])
def test_long_conversation(spark, deep):
    """A chain as deep as the conversation, longer than a slice of the running sums, with branches on its way."""
    rows = [(0, t, "user", f"turn {t}") for t in range(deep)]
    rows += [(9, t, "user", "other" if t > 12 else f"turn {t}") for t in range(25)] + [(3, 0, "a", "b")]
    check(spark, rows)


def test_rounds_grow_with_the_logarithm_of_the_depth(spark, monkeypatch):
    """A chain of 1000 nodes with a leaf at each: a few writes a round, and about ten rounds."""
    names, write = [], trie.materialize
    monkeypatch.setattr(trie, "materialize", lambda df, name: names.append(name) or write(df, name))
    spine = [(f"s{i}", f"s{i - 1}" if i else None, i, 2 if i < 999 else 1, 0, 1) for i in range(1000)]
    rows = spine + [(f"x{i}", f"s{i}", i + 1, 0, 1, 10) for i in range(1000)]
    nodes = spark.createDataFrame(rows, "node string, parent string, depth long, kids long, a long, b long").selectExpr("cast(node as binary) node", "cast(parent as binary) parent", "depth", "kids", "a", "b")
    got = {bytes(r["node"]).decode(): (r["a"], r["b"]) for r in trie.subtree_totals(nodes, ["a", "b"]).collect()}
    assert got == {f"s{i}": (1000 - i, 11 * (1000 - i)) for i in range(1000)} | {f"x{i}": (1, 10) for i in range(1000)}
    assert names.count("trie-live") <= 14


def test_awkward(spark):
    rows = [
        (1, None, None, None), (1, 0, "user", ""), (1, 0, "user", ""), (1, 0, "", "user"), (1, -3, "ü", "é" * 50), (None, 0, "user", "lost"), (2, 5, "user", "x" * 100_000),
        (5, 1, "user", "x"), (6, 1, "user", "x"), (7, 1, "user", "x"), (-7, 0, "a", "b"), (-5, 0, "a", "b"), (-5, 1, "a", "c"), (1 << 60, 0, "a", "b"), (8, 3, "a,b", "c"), (8, 3, "a", "b,c"),
    ]
    rows += [(11, 2, "same", "row")] * 2100
    check(spark, rows)
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 as conv", "2 as pos", "3 as copies", "'x' as node", "4 as depth")
    assert Counter(tuple(r) for r in trie.trie(*trie.rebuild(trie.turns(df))).collect()) == brute(rows)
    assert found(spark, []) == Counter()
