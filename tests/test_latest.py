"""The last of several events of a type, by hash aggregates that read the log twice at most."""

from __future__ import annotations

from datetime import datetime, timedelta, timezone

import pytest

from faultline.functions import vocab
from faultline.operators import eventlog, lifecycle, timeline

START = datetime(2024, 1, 1, tzinfo=timezone.utc)
EVENTS = [
    # incident, minute, seq, type, payload: same times, later ones that say nothing, broken ones
    ("a", 1, 1, vocab.OWNERSHIP_SUGGESTED, '{"suggested_owner":"x","citation":"c1","latency_ms":5}'),
    ("a", 1, 2, vocab.OWNERSHIP_SUGGESTED, '{"suggested_owner":"y","citation":"c2","latency_ms":null}'),
    ("a", 0, 9, vocab.OWNERSHIP_SUGGESTED, '{"suggested_owner":"z"}'),
    ("a", 3, 3, vocab.OWNER_CONFIRMED, '{"owner":"x","confirmed_by":"p"}'),
    ("a", 4, 4, vocab.OWNER_CONFIRMED, '{"owner":null,"confirmed_by":"q"}'),
    ("a", 5, 5, vocab.EXTRACTION_COMPLETED, '{"latency_ms":1,"affected_services":["s1"]}'),
    ("a", 6, 6, vocab.EXTRACTION_COMPLETED, '{"latency_ms":2,"affected_services":["s2","s3"]}'),
    ("a", 7, 7, vocab.REPORT_COMPLETE, '{"elapsed_ms":10,"model":"m1"}'),
    ("a", 8, 8, vocab.REPORT_COMPLETE, '{"elapsed_ms":20,"model":"m2"}'),
    ("b", 1, 11, vocab.OWNERSHIP_SUGGESTED, "{broken"),
    ("b", 2, 12, vocab.SKIPPED, f'{{"step":"{vocab.CONTEXT_STEP}","blocker":"B1"}}'),
    ("b", 3, 13, vocab.SKIPPED, f'{{"step":"{vocab.CONTEXT_STEP}"}}'),
    ("b", 4, 14, vocab.REPORT_ERROR, '{"error":"e1"}'),
    ("b", 5, 15, vocab.REPORT_ERROR, '{"error":"e2"}'),
    ("c", 1, 21, vocab.STATE_TRANSITION, '{"to":"MITIGATING"}'),
    ("c", 2, 22, vocab.STATE_TRANSITION, '{"to":"RESOLVED"}'),
    ("c", 3, 23, vocab.STATE_TRANSITION, '{"to":"BOGUS"}'),
]


@pytest.fixture(scope="module")
def log(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("latest") / "log")
    rows = [(START + timedelta(minutes=minute), incident, seq, kind, payload) for incident, minute, seq, kind, payload in EVENTS]
    spark.createDataFrame(rows, "ts timestamp, incident_id string, seq bigint, event_type string, payload string").write.parquet(path)
    return spark.read.parquet(path)


def rows(df, *names):
    return {row["incident_id"]: tuple(row[name] for name in names) for row in df.collect()}


def cheap(df, scans=2):
    plan = df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1]
    assert "SortAggregate" not in plan and plan.count("FileScan") <= scans, plan


def test_latest(log):
    found = eventlog.latest_by_type(log, vocab.EXTRACTION_COMPLETED)
    cheap(found)
    assert '"s2"' in rows(found, "payload")["a"][0]
    services = eventlog.affected_services(log).collect()
    assert sorted((r["ord"], r["service"]) for r in services) == [(0, "s2"), (1, "s3")]


def test_owner(log):
    found = lifecycle.owner_status(log)
    cheap(found)
    assert rows(found, "suggested_owner", "citation", "confirmed_owner", "confirmed_by", "status") == {
        "a": ("y", "c2", None, "q", "confirmed"),
        "b": (None, None, None, None, "suggested"),
        "c": (None, None, None, None, "awaiting"),
    }


def test_outcome(log):
    found = lifecycle.report_outcome(log)
    cheap(found)
    assert rows(found, "outcome", "error", "elapsed_ms", "model", "waiting") == {
        "a": ("complete", None, 20.0, "m2", False),
        "b": ("failed", "e2", None, None, False),
        "c": ("none", None, None, None, True),
    }


def test_badges(log):
    found = timeline.latency_badges(log)
    cheap(found)
    got = {(r["incident_id"], r["badge"]): (r["latency_ms"], r["note"]) for r in found.collect()}
    assert got["a", "extraction"] == (2.0, None) and got["a", "retrieval"] == (5.0, None)
    assert got["b", "context"] == (None, "skipped — not configured (blocked)") and len(got) == 9
