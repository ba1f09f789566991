"""The audit against comparing every record."""

from __future__ import annotations

import random

import pytest

from faultline.llm import merkle as M
from faultline.llm.tables import written

SCHEMA = "file string, offset bigint, payload string, hash string"


def differences(ours, theirs):
    """Addresses whose payloads differ, by sorted lists of payloads."""
    sides = []
    for rows in (ours, theirs):
        at = {}
        for file, offset, payload, _ in rows:
            at.setdefault((file or "", -1 if offset is None else offset), []).append(payload or "")
        sides.append({key: sorted(found) for key, found in at.items()})
    a, b = sides
    kinds = {key: "missing" if key not in b else "extra" if key not in a else "changed" for key in a.keys() | b.keys() if a.get(key) != b.get(key)}
    return sorted((*key, kind) for key, kind in kinds.items())


def audited(spark, ours, theirs):
    trees = [written(M.tree(M.leaves(spark.createDataFrame(rows, SCHEMA))), "t") for rows in (ours, theirs)]
    return sorted(tuple(r) for r in M.audit(*trees).collect())


@pytest.fixture(scope="module")
def archive():
    rnd = random.Random(4)
    rows = [(f"f{n % 3}", rnd.randrange(1 << 35), f"payload {n}", "x") for n in range(400)]
    return [*rows, ("f0", 5, None, "x"), ("f0", 6, "", "x"), (None, 7, "no file", "x"), ("f1", None, "no offset", "x"), ("f2", 9, "z" * 200_000, "x")]


def test_equal_replicas_stop_at_the_roots(spark, archive):
    assert audited(spark, archive, archive[::-1]) == []


def test_what_differs_is_found(spark, archive):
    theirs = [row for n, row in enumerate(archive) if n % 97]  # lost
    theirs = [(f, o, "damaged" if n % 53 == 0 else p, h) for n, (f, o, p, h) in enumerate(theirs)]
    theirs += [("f9", 1, "a new file", "x"), ("f0", 123_456, "a new record", "x"), theirs[30]]  # one record twice
    want = differences(archive, theirs)
    assert {kind for *_, kind in want} == {"missing", "changed", "extra"}
    assert audited(spark, archive, theirs) == want


def test_records_at_one_address(spark):
    many = [("f", 1, f"p{n % 5}", "x") for n in range(50)]
    assert audited(spark, many, many) == []
    assert audited(spark, many, many[1:]) == [("f", 1, "changed")]


def test_empty_replicas(spark, archive):
    assert audited(spark, [], []) == []
    assert audited(spark, archive[:3], []) == differences(archive[:3], [])


def test_packed_offsets_follow_the_keys(spark):
    records = spark.range(200).selectExpr("sha2(CAST(id AS STRING), 256) AS key", "id + 1 AS length", "id AS file_no")
    rows = M.packed(records, "key", "length", 3).collect()
    for file in {r.file for r in rows}:
        at = 0
        for r in sorted((r for r in rows if r.file == file), key=lambda r: r.key):
            assert r.offset == at
            at += r.length
