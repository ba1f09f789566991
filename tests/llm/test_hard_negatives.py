from __future__ import annotations

from math import floor, isfinite

import numpy as np
import pytest

from faultline.llm import hard_negatives as H
from faultline.llm import vectors


def brute(rows, every=50, factor=256):
    fine = []
    for i, v, label in rows:
        if i is not None and label is not None and v is not None and all(x is not None and isfinite(x) for x in v):
            fine.append((i, [floor(x * factor) for x in v], (label + 1) % 10 if i % 7 == 0 else label))
    out = []
    for n, (i, v, label) in enumerate(fine):
        if i % every == 0:
            scored = [(-sum(a * b for a, b in zip(v, w)), j, other == label) for m, (j, w, other) in enumerate(fine) if m != n]
            scored.sort()
            for p, j, _ in [x for x in scored if x[2]][:5]:
                inside = [x for x in scored if not x[2] and -50 * p <= -100 * x[0] <= -95 * p][:3]
                out += [(i, j, rank, k, -p, -s) for rank, (s, k, _) in enumerate(inside, 1)]
    return sorted(out)


def answers(df):
    return sorted(tuple(r) for r in df.collect())


def mine(df):
    return H.mine(df, lambda i: i % 50 == 0)


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, 2, "x") for r in rows], "vec_id bigint, embedding array<double>, label int, rid int, leaf int, norm string")


def test_odd_rows_ties_and_repeats(spark):
    rng = np.random.default_rng(3)
    rows = [(n, [float(x) for x in rng.normal(size=4)], n % 3) for n in range(300)]
    rows += [(n, rows[60][1], n % 2) for n in range(300, 340)]
    rows += [rows[50], rows[50], (100, [0.5, 0.5], 1), rows[9], rows[9]]
    rows += [(350, None, 1), (400, [], 1), (450, [1.0, None], 2), (500, [float("nan")], 2), (None, [1.0] * 4, 1), (550, [1.0] * 4, None), (600, [0.0] * 4, 1), (650, [0.001] * 4, 9)]
    df = frame(spark, rows)
    assert answers(mine(df)) == brute(rows)
    assert answers(mine(df.limit(0))) == []
    assert answers(mine(df.where("vec_id = 600"))) == []


@pytest.mark.parametrize("noise", [0.03, 1.0])
def test_blocks_and_a_hot_label(spark, monkeypatch, noise):
    monkeypatch.setattr(vectors, "BLOCK_ROWS", 120)
    monkeypatch.setattr(vectors, "QUERY_BLOCK", 4)
    rng = np.random.default_rng(7)
    centres = rng.normal(size=(6, 5))
    rows = [(n, [float(x) for x in (centres[n % 6] + rng.normal(size=5) * noise) * (1 + n % 5)], 1 if n % 2 else n % 40) for n in range(1200)]
    rows += [(n, rows[50][1], 1) for n in range(1200, 1500)]
    assert answers(mine(frame(spark, rows).repartition(5))) == brute(rows)


def test_bounds_hold_and_thin_out():
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(5, 6)) * 500
    rows = np.floor(centres[rng.integers(0, 5, 800)] * rng.uniform(0.5, 2, (800, 1)) + rng.normal(size=(800, 6)) * 20)
    rows[::97] = 0
    directions = H.references(rows, 8)
    angles, norms = H.angles_to(rows, directions)
    scored = 0
    for n in range(0, 800, 40):
        scores = rows @ rows[n]
        low, high = H.score_bounds(angles[n], norms[n], angles, norms)
        assert (low <= scores).all() and (scores <= high).all()
        for a, b in ((0.5, 0.95), (0.9, 2.0), (-1.0, -0.2)):
            top = norms[n] ** 2
            window = (a * top, b * top)
            close, far = H.reach(*window, norms[n], norms.min(), norms.max())
            for reference in range(len(directions)):
                first, last = H.stretch(angles[n, reference], close, far)
                inside = (scores >= window[0]) & (scores <= window[1])
                assert ((angles[inside, reference] >= first) & (angles[inside, reference] <= last)).all()
            scored += ((low <= window[1]) & (high >= window[0])).sum()
    assert scored < 0.6 * 20 * 3 * 800
