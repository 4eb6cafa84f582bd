"""The manifest against a tree built on one list, and proofs folded by hand."""

import os
import zlib
from collections import Counter, defaultdict
from hashlib import sha256

import pytest
from pyspark.sql import functions as F

from lifeframe.llm import merkle


def h(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def leaf(*values):
    return h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def tree(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([h(*levels[-1][i : i + 8]) for i in range(0, len(levels[-1]), 8)])
    return levels


def proof(levels, i):
    """(before, after) on the way up."""
    out = []
    for level in levels[:-1]:
        first = i // 8 * 8
        out.append(("".join(level[first:i]), "".join(level[i + 1 : first + 8])))
        i //= 8
    return out


def brute(rows):
    """Rows are (doc_id, source, lang, n_chars, text)."""
    groups = defaultdict(list)
    for r in rows:
        groups[r[2]].append(r)
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees, order = {}, {}
    for g in names:
        order[g] = sorted(groups[g], key=lambda r: (r[0] is not None, r[0] or 0, leaf(*r)))
        trees[g] = tree([leaf(*r) for r in order[g]])
    top = tree([trees[g][-1][0] for g in names])
    out = []
    for k, g in enumerate(names):
        for i, r in enumerate(order[g]):
            path = proof(trees[g], i) + proof(top, k)
            later = leaf(*r)
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0 and r[4] is not None:
                later = leaf(*r[:4], "".join(c.lower() if "A" <= c <= "Z" else c for c in r[4]))
            for before, after in path:
                later = h(before, later, after)
            root = top[-1][0]
            out.append((r[0], leaf(*r), trees[g][-1][0], root, h(*(b + a for b, a in path)), later, later == root))
    return out


def found(docs):
    where = F.crc32(F.col("doc_id").cast("string")) % 3 == 0
    rows = merkle.manifest(docs, tampered={"text": merkle.lowered(F.col("text"))}, where=where).collect()
    return Counter(tuple(r) for r in rows)


def check(spark, rows, extra=()):
    docs = spark.createDataFrame(
        [(*r, *("x" for _ in extra)) for r in rows],
        "doc_id long, source string, lang string, n_chars long, text string" + "".join(f", `{c}` string" for c in extra),
    ).repartition(5)
    got = found(docs)
    assert got == Counter(brute(rows))
    return got


@pytest.mark.parametrize("n", [1, 2, 8, 9, 64, 65, 512, 513])
def test_sizes_around_the_steps_of_the_tree(spark, n):
    check(spark, [(i, "s", "en", i, f"Text {i}") for i in range(n)])


def test_large_group_beside_small_ones(spark):
    """More than one superblock in a group, and one group with two thirds of the rows."""
    rows = [(i, "s", "en" if i % 3 else f"l{i % 7}", i, f"Some Text {i}") for i in range(1400)]
    got = check(spark, rows + [(-5, None, None, None, None)])
    assert {r[-1] for r in got} == {True, False}


def test_more_groups_than_a_superblock(spark):
    check(spark, [(i, "s", f"l{i}", i, "Text") for i in range(530)])


def test_awkward(spark, awkward):
    rows = [(i, None if k % 2 else "source", "en" if k % 3 else None, k, t) for k, (i, t) in enumerate(awkward)]
    rows += [(9, None, "en", 0, "same"), (9, None, "en", 0, "same"), (1 << 60, "é", "é", -3, "İSTANBUL Z")]
    check(spark, rows, extra=("tree", "pos", "node", "_id", "_group", "block", "leaf"))


def test_untampered_rows_verify_and_empty_tables_stay_empty(spark, documents):
    rows = merkle.manifest(documents([(i, f"T{i}") for i in range(20)])).collect()
    assert len(rows) == 20 and all(r["verified"] for r in rows)
    assert merkle.manifest(documents([])).count() == 0


def test_workers_load_no_pandas():
    """Every worker of an executor would hold its own copy."""
    import subprocess
    import sys

    code = "import sys; from lifeframe.llm import merkle; sys.exit('pandas' in sys.modules)"
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    assert subprocess.run([sys.executable, "-c", code], cwd=root).returncode == 0
