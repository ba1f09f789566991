"""Queries that SQL can express, against DuckDB on the supplied tables."""

from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from check import compare, duck
from faultline.llm.queries import CHECKS, QUERIES


@pytest.mark.parametrize("name", sorted(CHECKS))
def test_query(spark, sf_dir, name):
    assert compare(spark, duck(sf_dir), QUERIES[name], CHECKS[name], sf_dir) is None


def test_all_are_there():
    assert sorted(int(name[2:].split("_")[0]) for name in QUERIES) == list(range(1, 14))
