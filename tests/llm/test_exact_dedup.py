"""Exact dedup against grouping in plain Python."""

from __future__ import annotations

import hashlib
import re

from faultline.llm import exact_dedup as X
from faultline.llm import tables


def normal(text):
    return re.sub(r"[\x20\x09-\x0D]+", " ", text or "")


ROWS = [
    (7, "a  b\tc"), (3, "a b c"), (9, "a\r\n b c"), (4, " a b c"), (5, "a b c "), (6, "a b c"), (None, "a b c"),
    (10, None), (11, ""), (12, " "), (13, "\n\t"), (20, "x" * 300_000), (21, "x" * 300_000), (22, "x" * 299_999 + "y"),
    (30, "same row"), (30, "same row"), (31, "alone"), (None, "nobody"), (None, "nobody"),
]
LAST = float("inf")


def order(id_):
    return LAST if id_ is None else id_


def frame(spark):
    names = "doc_id bigint, text string, digest string, again string, KEEP_ORDER int, block0 int, text_digest string, `a.b` int"
    return spark.createDataFrame([(i, t, "d", "a", 1, 2, "t", n) for n, (i, t) in enumerate(ROWS)], names)


def test_every_row_comes_back_with_its_group(spark):
    groups = {}
    for id_, text in ROWS:
        groups.setdefault(normal(text), []).append(id_)
    got = X.copies(frame(spark)).collect()
    sha = {hashlib.sha256(key.encode()).hexdigest(): ids for key, ids in groups.items()}
    assert sorted((order(r.doc_id), r.text_sha256) for r in got) == sorted(
        (order(i), hashlib.sha256(normal(t).encode()).hexdigest()) for i, t in ROWS
    )
    kept = {}
    for r in got:
        ids = sha[r.text_sha256]
        assert r.group_size == len(ids)
        assert order(r.keep_id) == min(map(order, ids))
        if r.kept:
            assert r.text_sha256 not in kept and r.doc_id == r.keep_id
            kept[r.text_sha256] = r.doc_id
    assert set(kept) == set(sha)


def test_documents_that_stay_keep_their_columns(spark):
    docs = frame(spark)
    got = X.without_copies(docs)
    assert got.columns == docs.columns and got.schema == docs.schema
    want = {}
    for id_, text in ROWS:
        want[normal(text)] = min(want.get(normal(text), LAST), order(id_))
    assert sorted((normal(r.text), order(r.doc_id)) for r in got.collect()) == sorted(want.items())


def test_empty_table(spark):
    docs = frame(spark).limit(0)
    assert X.copies(docs).count() == 0 and X.without_copies(docs).count() == 0


def test_a_full_filter_changes_nothing(spark, monkeypatch):
    docs = spark.range(60_000).selectExpr("id AS doc_id", "concat('text ', id % 50000) AS text")
    monkeypatch.setattr(tables, "filter_bits", lambda rows: tables.BLOCK_BITS)
    monkeypatch.setattr(X, "filter_bits", lambda rows: tables.BLOCK_BITS)
    got = X.copies(docs)
    assert got.count() == 60_000 and got.where("kept").count() == 50_000
    assert got.where("group_size = 2").count() == 20_000


def test_only_possible_repeats_meet(spark):
    slim = spark.range(5_000).selectExpr("CAST(CAST(id % 4990 AS STRING) AS BINARY) AS digest")
    bits = tables.filter_bits(5_000)
    marked = tables.probe(slim, "digest", tables.repeated_filter(slim, "digest", bits), bits, "again")
    assert 20 <= marked.where("again").count() < 200
