from __future__ import annotations

from fractions import Fraction
from math import floor, isfinite

import numpy as np
import pytest

from faultline.llm import cover_tree as C
from faultline.llm import vectors


def brute(rows, k=10, every=100, factor=1024):
    fine = [(i, [floor(Fraction(x) * factor) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and isfinite(x) for x in v)]
    out = []
    for n, (i, v) in enumerate(fine):
        if i % every == 0:
            scored = [(max(-(1 << 63), min((1 << 63) - 1, sum(a * b for a, b in zip(v, w)))), j) for m, (j, w) in enumerate(fine) if m != n]
            scored.sort(key=lambda x: (-x[0], x[1]))
            out += [(i, rank, j, score) for rank, (score, j) in enumerate(scored[:k], 1)]
    return sorted(out)


def answers(df):
    return sorted(tuple(r) for r in df.collect())


def search(df, k=10):
    return C.search(df, lambda i: i % 100 == 0, k)


def test_odd_rows_ties_and_repeats(spark):
    rng = np.random.default_rng(3)
    rows = [(n, [float(x) for x in rng.normal(size=5)]) for n in range(220)]
    rows += [(n, rows[5][1]) for n in range(220, 260)]  # ties
    rows += [rows[7], rows[7], rows[100], (100, [1.0, 2.0])]  # repeated rows and ids
    rows += [(300, None), (400, []), (500, [1.0, None]), (600, [float("nan")]), (None, [1.0] * 5), (700, [float("inf")]), (800, [0.0] * 5)]
    df = spark.createDataFrame([(i, v, 1, 2.0, 3) for i, v in rows], "vec_id bigint, embedding array<double>, rid int, leaf double, score int")
    assert answers(search(df)) == brute(rows)
    assert answers(search(df.limit(0))) == []
    assert answers(search(df.where("vec_id = 800"))) == []


def test_large_components_stay_exact(spark):
    rows = [(0, [3.0e5, -7.0, 1.0e4]), (1, [2.9e5, 8.5, -3.0e6]), (2, [1.0e30, 1.0, 1.0]), (100, [-1.0e300, 2.0, 5.0]), (3, [1.0e-8, -1.0e-8, 0.5])]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    assert answers(search(df)) == brute(rows)


def test_floors_are_those_of_doubles(spark):
    values = [0.5 / 1024, -0.5 / 1024, 1 / 1024, -1 / 1024, 2.5 / 1024, 1e30, -0.0, 1e-320, -1e-320, 4503599627370497.0 / 1024]
    df = spark.createDataFrame([(1, values)], "vec_id bigint, embedding array<double>")
    assert vectors.whole_numbers(df, 1024, "vec_id", "embedding").first()["v"] == [float(np.floor(1024 * x)) for x in values]


@pytest.mark.parametrize("noise", [0.05, 3.0])
def test_many_leaves_blocks_and_a_hot_vector(spark, monkeypatch, noise):
    monkeypatch.setattr(C, "ROWS_PER_LEAF", 20)
    monkeypatch.setattr(vectors, "QUERY_BLOCK", 3)
    monkeypatch.setattr(vectors, "BLOCK_ROWS", 150)
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(12, 8))
    rows = [(n, [float(x) for x in centres[n * n % 12] + rng.normal(size=8) * noise]) for n in range(1500)]
    rows += [(n, rows[7][1]) for n in range(1500, 2200)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>").repartition(7)
    assert answers(search(df)) == brute(rows)


def built(rows, leaves):
    tree = C.cover_tree(rows, leaves)
    leaf, far = tree.descend(rows)
    reach = {int(n): far[leaf == n].max() for n in np.unique(leaf)}
    sizes = {int(n): int((leaf == n).sum()) for n in np.unique(leaf)}
    return C.Index(tree, tree.radii(reach), tree.radii(reach), sizes), leaf


def test_radii_cover_and_pairs_are_pruned():
    rng = np.random.default_rng(2)
    rows = np.repeat(rng.normal(size=(30, 6)) * 1000, 20, axis=0) + rng.normal(size=(600, 6))
    index, leaf = built(rows, 60)
    tree = index.tree
    for n, row in enumerate(rows):
        node = leaf[n]
        while node >= 0:
            assert np.linalg.norm(row - tree.centres[node]) <= index.rows[node] * (1 + 1e-9) + 1e-6
            node = tree.parent[node]
    scores = rows @ rows.T
    np.fill_diagonal(scores, -np.inf)
    kth = np.sort(scores, axis=1)[:, -10]
    kept = dict(index.survivors({int(n): float(kth[leaf == n].min()) for n in np.unique(leaf)}))
    for q in range(len(rows)):
        assert {int(leaf[n]) for n in np.flatnonzero(scores[q] >= kth[q])} <= set(kept[int(leaf[q])])
    assert sum(map(len, kept.values())) < 0.3 * len(index.sizes) ** 2


def test_children_are_separated():
    rng = np.random.default_rng(4)
    tree = C.cover_tree(rng.normal(size=(300, 3)), 50)
    for node, below in enumerate(tree.children):
        if below:
            assert np.array_equal(tree.centres[below[0]], tree.centres[node])
            apart = C.distances(tree.centres[below], tree.centres[below])
            assert apart[~np.eye(len(below), dtype=bool)].min() > 0
