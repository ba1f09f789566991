from __future__ import annotations

import sys
from collections import Counter
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))

import corpus_pipeline as pipeline
from faultline.llm.registry import table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def staged(spark, sf_dir):
    from faultline.llm.tables import written

    out = [table(spark, sf_dir, "documents")]
    for name, stage in pipeline.STAGES:
        out.append(written(stage(spark, out[-1], sf_dir), "stage"))
    return out


def rows(df):
    return [(r.doc_id, r.text) for r in df.collect()]


def test_each_stage_on_its_own_input(spark, staged):
    import re

    from test_jaccard_join import brute

    first, clean, single, apart, mix, coded = staged
    assert all(df.columns == COLUMNS for df in staged[:-1])
    before, after = rows(clean), rows(single)
    kept = {}
    for id_, text in sorted(before):
        kept.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", text or ""), (id_, text))
    assert sorted(after) == sorted(kept.values())
    want = sorted(int(i) for i, _, c in brute(after) if i == c)
    assert sorted(i for i, _ in rows(apart)) == want
    copies = Counter(rows(mix))
    assert set(copies) <= set(rows(apart)) and max(copies.values()) <= 3
    assert coded.count() == mix.count()


def test_toxic_documents_go_and_clean_ones_stay(spark, sf_dir, staged):
    labels = {r.doc_id: r.toxic for r in table(spark, sf_dir, "labels").collect()}
    left = {i for i, _ in rows(staged[1])}
    known = [(i, labels[i]) for i, _ in rows(staged[0]) if i in labels]
    right = sum((i not in left) == bool(y) for i, y in known)
    assert right >= 0.9 * len(known)


def test_odd_rows_pass(spark, sf_dir):
    odd = [
        (None, None, None, None, None, "a"),
        (1, None, "en", None, 0, "b"),
        (1, "", "en", "s", 0, "c"),
        (2, "word " * 50_000, "en", "s", None, None),
        (3, "fine words here and there", None, "t", 1, "d"),
        (3, "fine words here and there", None, "t", 1, "d"),
    ]
    names = "doc_id bigint, text string, lang string, source string, n_chars bigint, score string, `a.b` string"
    docs = spark.createDataFrame([(*row, "dotted") for row in odd], names)
    for table_ in (docs, docs.limit(0)):
        for name, stage in pipeline.STAGES:
            out = stage(spark, table_, sf_dir)
            if name != "tokenise":
                assert out.columns == docs.columns
            out.collect()


def test_loosely_tied_documents_need_no_pivots(spark, sf_dir, monkeypatch):
    """Before, the third stage joined documents that a few common runs tied together block by block."""
    from test_jaccard_join import brute, loosely_tied

    def cut(large):
        raise AssertionError("the island was not made again by the exact order of its runs")

    rows = loosely_tied()
    join = pipeline.jaccard_join
    monkeypatch.setattr(join, "_cut", cut)
    monkeypatch.setattr(join.join, "__defaults__", ("doc_id", "text", join.ISLAND_RUNS, 6, join.ROUNDS))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    left = pipeline.without_near_copies(spark, docs, sf_dir).collect()
    assert sorted(r.doc_id for r in left) == sorted(int(i) for i, _, c in brute(rows) if i == c)
