"""Lattice points against all lattice points nearby, and links and components against all pairs."""

import itertools
from collections import Counter

import numpy as np
import pytest

from lifeframe.llm import lattice

SCHEMA = "vec_id long, embedding array<float>, label int"


def near(source, base, cosine):
    """A random vector at this cosine to each row."""
    base = base / np.linalg.norm(base, axis=1, keepdims=True)
    side = source.normal(size=base.shape)
    side -= (side * base).sum(axis=1, keepdims=True) * base
    side /= np.linalg.norm(side, axis=1, keepdims=True)
    return cosine * base + np.sqrt(1 - cosine**2) * side


def brute(rows, cosine=0.98):
    """(id, n_links, component, kept) of every row, from all pairs."""
    n = len(rows)
    unit = [None] * n
    for i, (_, v, label) in enumerate(rows):
        if v and label is not None and all(x is not None and np.isfinite(x) for x in v) and any(v):
            x = np.array(v, np.float32).astype(float)
            unit[i] = x / np.abs(x).max()
    root = list(range(n))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    count = [0] * n
    for i, j in itertools.combinations(range(n), 2):
        a, b = unit[i], unit[j]
        if a is None or b is None or len(a) != len(b) or rows[i][2] != rows[j][2]:
            continue
        if a @ b / (np.linalg.norm(a) * np.linalg.norm(b)) >= cosine:
            count[i] += 1
            count[j] += 1
            root[find(i)] = find(j)
    least = {}
    for i in range(n):
        if rows[i][0] is not None:
            least[find(i)] = min(rows[i][0], least.get(find(i), rows[i][0]))
    return Counter((rows[i][0], count[i], least.get(find(i)), rows[i][0] == least.get(find(i))) for i in range(n))


def found(spark, rows, **options):
    return Counter(tuple(r) for r in lattice.near_vectors(spark.createDataFrame(rows, SCHEMA).repartition(4), **options).collect())


def test_shortest_vectors():
    v = lattice.shortest()
    assert len(v) == len({tuple(x) for x in v}) == 240
    assert np.allclose((v**2).sum(axis=1), 2)
    assert np.allclose(v @ v.T, np.rint(v @ v.T))  # inner products within the lattice are whole


def test_decoded_points_are_the_nearest():
    """No lattice vector of the first two shells brings a decoded point nearer, which in E8 means that none does."""
    x = np.random.default_rng(3).normal(size=(500, 8)) * 2
    point = lattice.decode(x)
    doubled = np.rint(2 * point).astype(int)
    assert ((doubled % 2 == doubled[:, :1] % 2).all(axis=1) & (doubled.sum(axis=1) % 4 == 0)).all()
    v = lattice.shortest()
    fours = {tuple(a + b) for a in v for b in v if round(((a + b) ** 2).sum()) == 4}
    for shell in (v, np.array(sorted(fours))):
        assert (((x - point)[:, None, :] - shell[None]) ** 2).sum(axis=2).min(axis=1).min() >= 0
        assert ((((x - point)[:, None, :] - shell[None]) ** 2).sum(axis=2).min(axis=1) >= ((x - point) ** 2).sum(axis=1) - 1e-9).all()


@pytest.mark.parametrize("dim", [16, 64, 384])
@pytest.mark.parametrize("cosine", [0.98, 0.985, 0.99])
def test_recall_of_single_pairs(dim, cosine):
    """Pairs at exactly that cosine that meet in a cell; the contract asks for 0.9."""
    source = np.random.default_rng(dim)
    a = source.normal(size=(2000, dim))
    b = near(source, a, cosine)
    salt = np.zeros(len(a), np.uint64)
    keys_a = lattice.cell_keys(a / np.linalg.norm(a, axis=1, keepdims=True), salt)
    keys_b = lattice.cell_keys(b, salt)
    met = (keys_a[:, :, None] == keys_b[:, None, :]).any(axis=(1, 2))
    assert met.mean() >= 0.97
    strangers = (keys_a[:, :, None] == np.roll(keys_b, 1, axis=0)[:, None, :]).any(axis=(1, 2))
    assert strangers.mean() < 0.01


@pytest.mark.parametrize("part", [256, 6])
def test_clusters_against_all_pairs(spark, part):
    """Copies, scaled copies, near copies around the threshold, chains, and equal vectors under other labels."""
    source = np.random.default_rng(11)
    base = source.normal(size=(40, 32))
    rows = [base]
    for cosine in (0.985, 0.992, 0.996):
        rows += [near(source, base[:12], cosine) for _ in range(3)]
    chain = base[20:21]
    for _ in range(12):
        chain = near(source, chain, 0.984)
        rows.append(chain)
    vectors = np.concatenate(rows)
    table = [(i, v.tolist(), i % 40 % 3 if i < 40 * 3 else 1) for i, v in enumerate(vectors)]
    table = [(i, v, None if i == 39 else k % 2) for k, (i, v, _) in enumerate(table)]
    table += [(1000 + i, base[0].tolist(), 0) for i in range(30)] + [(1100, (base[0] * 7).tolist(), 0), (1101, base[0].tolist(), 1)]
    expected, got = brute(table), found(spark, table, part=part)
    links = lambda c: sum(r[1] * n for r, n in c.items())
    assert links(expected) * 0.99 <= links(got) <= links(expected)
    assert sum((expected & got).values()) >= 0.99 * len(table)


@pytest.mark.parametrize("part", [256, 16])
def test_large_group_of_near_copies(spark, part):
    source = np.random.default_rng(5)
    cluster = near(source, np.repeat(source.normal(size=(1, 48)), 150, axis=0), 0.99)
    table = [(i, v.tolist(), 0) for i, v in enumerate(np.concatenate([cluster, source.normal(size=(60, 48))]))]
    expected = brute(table)
    assert 0 < sum(r[1] for r in expected) < 150 * 149
    assert found(spark, table, part=part) == expected


def test_awkward(spark):
    v = [1.0, 2.0, 3.0, 4.0]
    rows = [
        (1, None, 0), (2, [], 0), (3, [0.0] * 4, 0), (4, [1.0, None, 3.0, 4.0], 0), (5, [float("nan"), 1.0, 2.0, 3.0], 0), (6, [float("inf"), 1.0, 2.0, 3.0], 0),
        (7, v, None), (8, v, 0), (9, v, 0), (9, v, 0), (None, v, 0), (10, [*v, 5.0], 0), (None, [-1.0, 1.0, 1.0, 1.0], 0), (None, None, None),
        (11, [1e38, 2e38, 3e38, 4e38 / 2], 0), (12, [0.0, -0.0, 1.0, 0.0], 0), (13, [0.0, 0.0, 1.0, -0.0], 0), (14, [5.0], 0), (15, [2.0], 0), (16, [-2.0], 0),
        (17, [1e-40, 2e-40, 3e-40, 4e-40], 0), (-4, v, 1), (None, v, 1),
    ]
    assert found(spark, rows) == brute(rows)
    named = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "'x' as cls", "1 as key", "2 as copies", "3 as component", "4 as id")
    assert Counter(tuple(r) for r in lattice.near_vectors(named).collect()) == brute(rows)
    assert lattice.near_vectors(spark.createDataFrame([], SCHEMA)).count() == 0
