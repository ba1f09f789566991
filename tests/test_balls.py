"""Vector search over balls against all cosines, and which blocks it skips."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest

from faultline.operators import balls, retrieval


def brute(rows, queries, k):
    fine = sorted((i, np.asarray(v, float)) for i, v in rows if v is not None)
    out = {}
    for q, v in queries:
        if v is not None:
            v = np.asarray(v, float)
            scored = [(round(float(v @ w / max(np.linalg.norm(v) * np.linalg.norm(w), 1e-300)), 6), i) for i, w in fine]
            out[q] = [(i, s) for s, i in sorted(scored, key=lambda x: (-x[0], x[1]))[:k]]
    return out


def answers(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r["query_id"], r["rank"])):
        out.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    return out


def clustered(noise, seed=4):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(15, 8))
    rows = [(n, [float(x) for x in (centres[n % 15] + rng.normal(size=8) * noise) * rng.uniform(0.1, 9)]) for n in range(1500)]
    rows += [(1500 + n, rows[3][1]) for n in range(200)]  # copies: ties
    rows += [(1700, [0.0] * 8), (1701, None)]
    queries = [(n, rows[n * 31][1]) for n in range(40)] + [(50, [0.0] * 8), (51, None), (52, [float(x) for x in rng.normal(size=8)])]
    return rows, queries


@pytest.mark.parametrize("noise, k", [(0.05, 3), (2.0, 3), (0.05, 300)])
def test_same_as_all_cosines(spark, monkeypatch, noise, k):
    monkeypatch.setattr(balls, "BLOCK_ROWS", 60)
    monkeypatch.setattr(balls, "QUERY_BLOCK", 16)
    rows, queries = clustered(noise)
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>").repartition(5)
    asked = spark.createDataFrame(queries, "query_id bigint, embedding array<double>")
    got, want = answers(retrieval.vector_topk(df, asked, k)), brute(rows, queries, k)
    assert set(got) == set(want)
    for q in want:
        assert [s for _, s in got[q]] == pytest.approx([s for _, s in want[q]], abs=2e-6)
        assert [i for i, _ in got[q]] == [i for i, _ in want[q]] or k == 300
    assert retrieval.vector_topk(df.limit(0), asked, k).count() == 0


def test_most_blocks_are_skipped(spark, monkeypatch):
    monkeypatch.setattr(balls, "BLOCK_ROWS", 60)
    rows, queries = clustered(0.05)
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    asked = spark.createDataFrame([q for q in queries if q[0] < 40], "query_id bigint, embedding array<double>")
    index = balls.build_balls(df)
    bins = len(set(index.bins(60)[0]))
    assert bins > 15 and balls.visited(index, asked, 3).count() < 0.25 * bins * 40


def test_bounds_hold():
    rng = np.random.default_rng(2)
    rows = balls.unit(pd.Series(list(rng.normal(size=(500, 5)))))
    pivots = balls.pivots_of(rows, 12)
    at = balls.angles(rows, pivots)
    ring = at.argmin(1) * balls.RINGS
    names = np.unique(ring)
    own = at.min(1)
    index = balls.BallIndex(None, pivots, names, np.asarray([(ring == n).sum() for n in names]), np.asarray([own[ring == n].min() for n in names]), np.asarray([own[ring == n].max() for n in names]))
    low, high = index.bounds(rows[:50])
    for n, name in enumerate(names):
        scores = rows[:50] @ rows[ring == name].T
        assert (scores >= low[:, [n]] - 1e-9).all() and (scores <= high[:, [n]] + 1e-9).all()
