"""Every registered query against its DuckDB statement on the smallest supplied tables."""

from __future__ import annotations

import os
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import __spark_entry__ as entry
from check import compare, duck
from suite import load

SF_DIR = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no supplied tables")


@pytest.fixture(scope="module")
def con():
    return duck(SF_DIR)


@pytest.mark.parametrize("name", sorted(load().QUERIES))
def test_query(spark, con, name):
    message = compare(spark, con, load().QUERIES[name], load().CHECKS[name], SF_DIR)
    assert message is None, message


def test_entry(spark):
    assert entry.entry(spark).columns == ["cause_service", "effect_service", "lag_seconds"]


def test_every_query_has_a_check():
    assert set(load().CHECKS) == set(load().QUERIES)
    assert set(load().QUERIES) <= set(entry.queries())
