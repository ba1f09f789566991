"""Event-log reads on hand-made logs."""

from __future__ import annotations

import json
import random
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from faultline.functions import vocab
from faultline.operators import causal, eventlog, lifecycle, sinks, timeline
from faultline.plans.firsts import flag_first, position

START = datetime(2024, 1, 1, tzinfo=timezone.utc)
SCHEMA = "ts timestamp, incident_id string, seq bigint, event_type string, payload string"


def log(spark, *events, incident="i"):
    rows = []
    for seq, (kind, payload) in enumerate(events):
        body = payload if payload is None or isinstance(payload, str) else json.dumps(payload)
        rows.append((START + timedelta(seconds=seq), incident, seq, kind, body))
    return spark.createDataFrame(rows, SCHEMA)


def move(source, target):
    return (vocab.STATE_TRANSITION, {"from": source, "to": target})


def test_payloads_are_never_lost(spark):
    rows = log(spark, ("a", None), ("b", ""), ("c", "{broken"), ("d", {"z": 1, "a": {"y": 2, "b": "é"}}))
    lines = [row["line"] for row in eventlog.log_lines(rows).orderBy("seq").collect()]
    assert [json.loads(line)["payload"] for line in lines] == [{}, {}, {"raw": "{broken"}, {"a": {"b": "é", "y": 2}, "z": 1}]
    assert '"payload":{"a":{"b":"é","y":2},"z":1}' in lines[3]
    assert lines[0] == '{"event_type":"a","payload":{},"ts":"2024-01-01T00:00:00.000000+00:00"}'


def test_log_block_in_parts(spark):
    rows = log(spark, *[("a", {"n": n}) for n in range(25)])
    parts = eventlog.log_block(rows, part_rows=10, slice_rows=5).orderBy("part").collect()
    assert [row["n_rows"] for row in parts] == [10, 10, 5]
    text = "\n".join(row["text"] for row in parts).split("\n")
    assert text[0] == vocab.LOG_BEGIN and text[-1] == vocab.LOG_END and len(text) == 27
    assert [json.loads(line)["payload"]["n"] for line in text[1:-1]] == list(range(25))


def test_refused(spark):
    wanted = spark.createDataFrame([("i",), ("none",)], "incident_id string")
    assert [row[0] for row in eventlog.refused_incidents(wanted, log(spark, ("a", {}))).collect()] == ["none"]


@pytest.mark.parametrize(
    ("events", "state"),
    [
        ([], None),
        ([("other", {})], None),
        ([(vocab.ALERT_RECEIVED, {})], "INVESTIGATING"),
        ([move("INVESTIGATING", "MITIGATING"), (vocab.ALERT_RECEIVED, {})], "MITIGATING"),
        ([(vocab.INCIDENT_OPENED, {}), move("INVESTIGATING", "NOWHERE")], "INVESTIGATING"),
        ([move("A", "RESOLVED"), (vocab.STATE_TRANSITION, {"to": 7}), (vocab.STATE_TRANSITION, "{bad")], "RESOLVED"),
    ],
)
def test_state(spark, events, state):
    got = lifecycle.incident_state(log(spark, *events)).collect()
    assert [row["state"] for row in got] == ([state] if events else [])


def test_all_nine_moves(spark):
    for source in vocab.STATES:
        for target in vocab.STATES:
            legal = (source, target) in vocab.LEGAL_MOVES
            rows = [move(vocab.INVESTIGATING, vocab.MITIGATING)] if source == vocab.MITIGATING else []
            if source == vocab.RESOLVED:
                rows = [move(vocab.INVESTIGATING, vocab.MITIGATING), move(vocab.MITIGATING, vocab.RESOLVED)]
            bad = lifecycle.illegal_transitions(log(spark, *rows, move(source, target))).collect()
            assert [row["reason"] for row in bad] == ([] if legal else ["move"]), (source, target)


def test_broken_continuity(spark):
    rows = log(spark, move(vocab.MITIGATING, vocab.RESOLVED))
    assert [row["reason"] for row in lifecycle.illegal_transitions(rows).collect()] == ["break"]


def test_current_incident(spark):
    rows = log(spark, (vocab.INCIDENT_OPENED, {}), incident="old").unionByName(
        log(spark, ("x", {}), ("y", {}), ("z", {}), incident="new")
    )
    assert lifecycle.current_incident(rows).first()[0] == "old"
    assert lifecycle.current_incident(rows.where("incident_id = 'new'")).first()[0] == "new"


def test_edges_and_nodes(spark):
    good = {"cause_service": "a", "effect_service": "b", "lag_seconds": 250}
    bad = [{"cause_service": "", "effect_service": "b", "lag_seconds": 1}, {"cause_service": "a", "lag_seconds": 1}, 5, None]
    bad.append({"cause_service": "a", "effect_service": "b", "lag_seconds": "7"})
    second = {"cause_service": "b", "effect_service": "c", "lag_seconds": 1.5}
    rows = log(
        spark,
        (vocab.CHAINS_DETECTED, {"edges": [good]}),
        (vocab.CHAINS_DETECTED, {"edges": [*bad, good, second]}),
        (vocab.EXTRACTION_COMPLETED, {"affected_services": ["z", 3, "a"]}),
    )
    edges = eventlog.latest_edges(rows)
    assert [(r["ord"], r["cause_service"], r["lag_seconds"]) for r in edges.orderBy("ord").collect()] == [(5, "a", 250.0), (6, "b", 1.5)]
    nodes = causal.graph_nodes(edges, eventlog.affected_services(rows)).orderBy("position").collect()
    assert [(r["service"], r["role"]) for r in nodes] == [("a", "cause"), ("b", "effect"), ("c", "effect"), ("z", "other")]
    assert eventlog.payload_edges(log(spark, (vocab.CHAINS_DETECTED, {"edges": "no list"}))).count() == 0


def test_tokens_out_of_order(spark):
    tokens = [{"token": "c", "index": 2}, {"token": "a", "index": 0}, {"token": "b", "index": 1}, {"token": "d"}]
    rows = log(spark, *[(vocab.REPORT_TOKEN, token) for token in tokens])
    assert eventlog.report_text(rows).first()["text"] == "abcd"
    parts = eventlog.report_text(rows, part_rows=3, slice_rows=2).orderBy("part").collect()
    assert [row["text"] for row in parts] == ["abc", "d"]


@pytest.mark.parametrize(
    ("events", "outcome", "waiting"),
    [
        ([(vocab.REPORT_COMPLETE, {"elapsed_ms": 5})], "complete", False),
        ([(vocab.BLOCKED, {"step": "postmortem"}), (vocab.REPORT_COMPLETE, {})], "blocked", False),
        ([(vocab.BLOCKED, {"step": "other"})], "none", False),
        ([(vocab.SKIPPED, {"step": vocab.REPORT_SKIP_STEP, "error": "e"})], "skipped", False),
        ([(vocab.REPORT_ERROR, {"error": "e"})], "failed", False),
        ([(vocab.REPORT_TOKEN, {"token": "x"})], "streaming", False),
        ([move("M", "RESOLVED")], "none", True),
    ],
)
def test_report_outcome(spark, events, outcome, waiting):
    row = lifecycle.report_outcome(log(spark, *events)).first()
    assert (row["outcome"], row["waiting"]) == (outcome, waiting)


def test_owner_status(spark):
    offer = (vocab.OWNERSHIP_SUGGESTED, {"suggested_owner": "dana", "citation": "map"})
    assert lifecycle.owner_status(log(spark, ("x", {}))).first()["status"] == "awaiting"
    assert lifecycle.owner_status(log(spark, offer)).first()["status"] == "suggested"
    both = lifecycle.owner_status(log(spark, offer, (vocab.OWNER_CONFIRMED, {"owner": "kim"}))).first()
    assert (both["status"], both["suggested_owner"], both["confirmed_owner"]) == ("confirmed", "dana", "kim")


def test_sequence_contract(spark):
    opened, read = (vocab.INCIDENT_OPENED, {}), (vocab.EXTRACTION_COMPLETED, {})
    assert eventlog.sequence_contract(log(spark, (vocab.ALERT_RECEIVED, {}), opened, read)).first()["ok"]
    assert not eventlog.sequence_contract(log(spark, read, opened)).first()["ok"]
    assert not eventlog.sequence_contract(log(spark, opened, ("llm.call", {}), read)).first()["ok"]


def test_badges(spark):
    rows = log(
        spark,
        (vocab.EXTRACTION_COMPLETED, {"latency_ms": 12.5}),
        (vocab.EXTRACTION_COMPLETED, {"latency_ms": None}),
        (vocab.SKIPPED, {"step": vocab.CONTEXT_STEP}),
        (vocab.OWNERSHIP_SUGGESTED, {"latency_ms": 3}),
        (vocab.RUNBOOK_RETRIEVED, {"latency_ms": "fast"}),
    )
    got = {row["badge"]: (row["latency_ms"], row["note"]) for row in timeline.latency_badges(rows).collect()}
    assert got == {"extraction": (12.5, None), "context": (None, "skipped — not configured (blocked)"), "retrieval": (3.0, None)}


def test_timeline_and_search(spark):
    rows = timeline.timeline(
        log(
            spark,
            (vocab.REPORT_TOKEN, {"token": "x"}),
            (vocab.EXTRACTION_COMPLETED, {"severity": "P1", "alert": {"service": "Pay"}}),
            (vocab.DEGRADED, {"service": "search", "error": "Timeout"}),
        )
    )
    shown = {row["event_type"]: row for row in rows.collect()}
    assert set(shown) == {vocab.EXTRACTION_COMPLETED, vocab.DEGRADED}
    assert shown[vocab.EXTRACTION_COMPLETED]["service"] == "Pay"
    assert (shown[vocab.DEGRADED]["tone"], shown[vocab.DEGRADED]["summary"]) == ("degraded", "Timeout")
    assert timeline.timeline_search(rows, text="TIMEOUT").count() == 1
    assert timeline.timeline_search(rows, severity="P1").count() == 1
    assert timeline.timeline_search(rows, severity="P1", text="timeout").count() == 0
    assert timeline.timeline_search(rows, text="  ").count() == 2


def test_sinks(spark):
    sent = log(spark, ("both", {}), ("first", {}), ("second", {}), ("none", {}))
    first, second = sent.where("event_type in ('both', 'first')"), sent.where("event_type in ('both', 'second')")
    missing = {row["event_type"]: row["missing_in"] for row in sinks.sink_reconcile(first, second).collect()}
    assert missing == {"first": "second", "second": "first"}
    lost = sorted((r["during_event_type"], r["service"], r["fatal"]) for r in sinks.sink_degradation(sent, first, second).collect())
    assert lost == [("first", "second", False), ("none", "first", True), ("none", "second", True), ("second", "first", False)]


def test_clock(spark):
    rows = spark.createDataFrame([("2024-01-01T10:20:30Z",), ("2024-01-01T10:20:30+02:00",), ("soon",)], "t string")
    assert [r["clock"] for r in eventlog.clock_text(rows, "t").collect()] == ["10:20:30", "08:20:30", "soon"]


def test_gap_totals(spark):
    rows = log(spark, (vocab.DEGRADED, {"service": "a"}), (vocab.DEGRADED, {"step": "b"}), (vocab.AGENT_ERROR, {}))
    got = {(r["event_type"], r["subject"]): r["n_events"] for r in timeline.gap_totals(rows).collect()}
    assert got[("all", "all")] == 3 and got[(vocab.DEGRADED, "all")] == 2 and got[(vocab.AGENT_ERROR, "unknown")] == 1


def test_no_driver_collect_of_rows(spark):
    """Plans of the wide reads have no single-partition exchange of log rows."""
    rows = log(spark, *[("a", {"n": n}) for n in range(5)])
    plan = eventlog.log_lines(rows).where(F.col("seq") > 1)._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan


def test_state_of_a_log_with_ties_and_nulls(spark):
    rnd = random.Random(6)
    kinds = [vocab.STATE_TRANSITION] * 4 + [vocab.ALERT_RECEIVED, "other"]
    targets = [*vocab.STATES, "unknown", None]
    rows = []
    for n in range(400):
        ts = None if rnd.random() < 0.1 else START + timedelta(seconds=rnd.randrange(40))
        payload = rnd.choice([json.dumps({"to": rnd.choice(targets)}), "no json", None])
        rows.append((ts, f"i{n % 23}", None if n % 31 == 0 else rnd.choice([n, -n]), rnd.choice(kinds), payload))
    want = {}
    low = datetime(1, 1, 1, tzinfo=timezone.utc)
    for ts, incident, seq, kind, payload in sorted(rows, key=lambda r: (r[0] or low, -(10**9) if r[2] is None else r[2])):
        state, begun = want.get(incident, (None, False))
        if kind == vocab.STATE_TRANSITION and payload and payload.startswith("{"):
            to = json.loads(payload)["to"]
            state = to if to in vocab.STATES else state
        want[incident] = (state, begun or kind == vocab.ALERT_RECEIVED)
    got = lifecycle.incident_state(spark.createDataFrame(rows, SCHEMA))
    assert {r["incident_id"]: r["state"] for r in got.collect()} == {
        i: s or (vocab.INVESTIGATING if b else None) for i, (s, b) in want.items()
    }


def test_state_and_first_rows_hash(spark, tmp_path):
    """One scan and no sort for the state; no sort-based aggregate for first rows."""
    log(spark, *[("a", {"n": n}) for n in range(5)]).write.parquet(f"{tmp_path}/log")
    df = spark.read.parquet(f"{tmp_path}/log")
    plan = lifecycle.incident_state(df)._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan and plan.count("FileScan") == 1
    first = flag_first(df, ["incident_id"], "seq", ["ts"], "first")
    assert "SortAggregate" not in first._jdf.queryExecution().executedPlan().toString()
    assert [r["seq"] for r in first.where("first").collect()] == [0]


def test_positions_order_as_structs_do(spark):
    times = [None, datetime(1900, 1, 1), datetime(2024, 1, 1), datetime(2024, 1, 1, 0, 0, 0, 1), datetime(9999, 12, 31)]
    numbers = [None, -(1 << 62), -1, 0, 1, (1 << 63) - 1]
    rows = spark.createDataFrame([(t, n) for t in times for n in numbers], "ts timestamp_ntz, seq bigint")
    by_place = [tuple(r) for r in rows.orderBy(position(F.col("ts"), F.col("seq"))).collect()]
    assert by_place == [(t, n) for t in times for n in numbers]
