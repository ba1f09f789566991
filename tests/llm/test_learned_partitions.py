from __future__ import annotations

import numpy as np

from faultline.llm import learned_partitions as L


def brute(rows, k=20):
    fine = {i: np.asarray(v, float) for i, v in rows if i is not None and v and None not in v and np.isfinite(v).all() and any(v)}
    ids = np.asarray(sorted(fine))
    matrix = np.stack([fine[i] for i in ids])
    out = {}
    for q in ids[ids % 20 == 0]:
        score = (matrix * fine[q]).sum(1)
        order = [n for n in np.lexsort((ids, -score)) if ids[n] != q][:k]
        out[int(q)] = [(int(ids[n]), score[n]) for n in order]
    return out


def answers(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r.rank)):
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r.rank == len(out[r.query_id])
    return out


def test_one_part_is_exact_with_ties_and_odd_rows(spark):
    rng = np.random.default_rng(3)
    rows = [(n, [float(x) for x in rng.normal(size=4)]) for n in range(60)]
    rows += [(n, rows[5][1]) for n in range(60, 100)]  # ties
    rows += [(200, None), (220, [0.0] * 4), (240, [1.0, None, 0.0, 0.0]), (260, [float("nan")] * 4), (None, [1.0] * 4), (280, [])]
    rows += [(300, [float("inf"), 0.0, 0.0, 0.0])]
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id bigint, embedding array<double>, part int")
    got, want = answers(L.search(df, lambda i: i % 20 == 0)), brute(rows)
    assert {q: [i for i, _ in a] for q, a in got.items()} == {q: [i for i, _ in a] for q, a in want.items()}
    assert all(np.allclose([s for _, s in got[q]], [s for _, s in want[q]], rtol=1e-12) for q in want)
    assert L.search(df.limit(0), lambda i: i % 20 == 0).count() == 0


def test_repeated_rows_are_candidates_each(spark):
    rows = [(0, [1.0, 0.0]), (1, [0.5, 0.5]), (1, [0.5, 0.5]), (2, [0.25, 0.0]), (20, [0.0, 1.0]), (20, [0.0, 1.0])]
    got = sorted(map(tuple, L.search(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>"), lambda i: i % 20 == 0).collect()))
    of_0 = [(0, 1, 1, 0.5), (0, 2, 1, 0.5), (0, 3, 2, 0.25), (0, 4, 20, 0.0), (0, 5, 20, 0.0)]
    of_20 = [(20, 1, 20, 1.0), (20, 2, 1, 0.5), (20, 3, 1, 0.5), (20, 4, 0, 0.0), (20, 5, 2, 0.0)]
    assert got == sorted(of_0 + 2 * of_20)


def test_many_parts_reach_the_recall(spark, monkeypatch):
    monkeypatch.setattr(L, "ROWS_PER_PART", 100)
    monkeypatch.setattr(L, "INDEX_BLOCK", 70)
    monkeypatch.setattr(L, "QUERY_BLOCK", 9)
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(12, 16))
    rows = [(n, [float(x) for x in centres[n * n % 12] + rng.normal(size=16) * 0.5]) for n in range(1500)]
    rows += [(n, rows[7][1]) for n in range(1500, 2000)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")
    got, want = answers(L.search(df, lambda i: i % 20 == 0)), brute([(i, np.float32(v).tolist()) for i, v in rows])
    assert set(got) == set(want) and all(len(got[q]) == 20 for q in got)
    hits = sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want)
    assert hits >= 0.9 * 20 * len(want)


def test_parts_are_balanced():
    rng = np.random.default_rng(1)
    vectors = rng.normal(size=(400, 8))
    part = L.balanced_parts(vectors, L.neighbours(vectors, 8), 8)
    assert np.bincount(part, minlength=8).max() <= np.ceil(50 * 1.15)


def test_query_recall(spark, sf_dir):
    from faultline.llm.queries import QUERIES

    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()]
    got, want = answers(QUERIES["op6_learned_partitions"](spark, sf_dir)), brute(rows)
    hits = sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want)
    assert hits >= 0.9 * sum(map(len, want.values()))
