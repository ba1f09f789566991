"""Alerts, verdicts, dispatch, retrieval, history, reports, sources on hand-made rows."""

from __future__ import annotations

import json
from datetime import datetime, timedelta, timezone

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from faultline.functions import vocab
from faultline.functions.text import html_escape, slug
from faultline.operators import alerts, dispatch, history, report, retrieval, verdicts
from faultline.session import prepare, scratch_path
from faultline.sources import events, logs, metrics, tables

START = datetime(2024, 1, 1, tzinfo=timezone.utc)
GOOD = {"service": "pay", "metric": "p99", "value": 2466.1, "timestamp": "2026-06-12T14:15:00Z"}


def deliveries(spark, *bodies, key=None):
    rows = [
        (i, START + timedelta(seconds=i), key, body if isinstance(body, str) else json.dumps(body))
        for i, body in enumerate(bodies)
    ]
    return spark.createDataFrame(rows, "delivery_id bigint, received_at timestamp, idempotency_key string, body string")


@pytest.mark.parametrize(
    ("change", "reason"),
    [
        ({}, None),
        ({"service": ""}, "service"),
        ({"service": None}, "service"),
        ({"metric": 5}, "metric"),
        ({"value": "n/a"}, "value"),
        ({"value": "12.5"}, None),
        ({"timestamp": "soon"}, "timestamp"),
        ({"timestamp": 1718201700}, None),
        ({"incident_id": 7}, "incident_id"),
        ({"incident_id": None}, None),
    ],
)
def test_alert_validation(spark, change, reason):
    got = alerts.parse_alerts(deliveries(spark, {**GOOD, **change})).first()
    assert got["reason"] == reason


def test_alert_bodies_that_are_no_objects(spark):
    got = alerts.alert_rejects(deliveries(spark, "{", "[]", "3", "")).collect()
    assert [row["reason"] for row in got] == ["body"] * 4


def test_same_body_is_a_duplicate_and_ids_follow_the_key(spark):
    rows = alerts.scan_alerts(deliveries(spark, GOOD, GOOD, {**GOOD, "value": 1}))
    flags = {row["delivery_id"]: row["duplicate"] for row in alerts.alert_dedupe(rows).collect()}
    assert flags == {0: False, 1: True, 2: False}
    for row in alerts.alert_incident_ids(rows).collect():
        assert row["incident_id"] == "inc-" + row["alert_key"][:12]
    keyed = alerts.alert_dedupe(alerts.scan_alerts(deliveries(spark, GOOD, {**GOOD, "value": 1}, key="k")))
    assert sorted(row["duplicate"] for row in keyed.collect()) == [False, True]


def test_incident_starts(spark):
    rows = alerts.scan_alerts(deliveries(spark, *[{**GOOD, "value": v, "incident_id": "inc-1"} for v in (1, 2, 3)]))
    assert sorted((r["delivery_id"], r["starts"]) for r in alerts.incident_starts(rows).collect()) == [(0, True), (1, False), (2, False)]


def test_sentences(spark):
    got = alerts.alert_sentence(deliveries(spark, {**GOOD, "incident_id": "inc-1"}, {"b": 1, "a": "x"})).orderBy("delivery_id").collect()
    assert got[0]["sentence"] == (
        "Alert inc-1: service pay metric p99 breached with value 2466.1 at 2026-06-12T14:15:00Z."
    )
    assert got[1]["sentence"] == "Incident alert with a x, b 1."


def responses(spark, *bodies):
    rows = [(i, 9.5, body if isinstance(body, str) else json.dumps(body)) for i, body in enumerate(bodies)]
    return spark.createDataFrame(rows, "response_id bigint, wall_ms double, body string")


def wrapped(data, **extra):
    return {"result": {"data": data}, **extra}


def test_extraction(spark):
    span = {"text": "pay", "confidence": 0.9, "start": 0, "end": 3}
    named = {"affected_service": [span, "db"]}
    got = verdicts.parse_extraction(
        responses(
            spark,
            wrapped({"severity": {"label": "P1", "confidence": 0.7}, "entities": named}, latency_ms=42),
            wrapped({"severity": "P0", "entities": {"affected_service": None}}),
            wrapped({"severity": {"label": "P9"}, "entities": named}),
            wrapped({"severity": None, "entities": named}),
            wrapped({"entities": named}),
            wrapped({"severity": "P1", "entities": {}}),
            wrapped({"severity": "P1", "entities": {"affected_service": [{"confidence": 1}]}}),
            {"result": None},
            "[1]",
            "oops",
            wrapped({"severity": {"label": "P1", "confidence": "0.9"}, "entities": {"affected_service": ""}}),
            wrapped({"severity": {"label": "P1", "confidence": None}, "entities": {"affected_service": {}}}),
        )
    ).orderBy("response_id").collect()
    assert [row["error"] for row in got] == [
        None, None, "label", "label", "severity", "entities", "span", "severity", "shape", "shape", None, "confidence"
    ]
    assert (got[10]["affected_services"], got[10]["confidence"]) == ([], 0.9)
    assert (got[0]["severity"], got[0]["affected_services"], got[0]["confidence"], got[0]["latency_ms"]) == ("P1", ["pay", "db"], 0.7, 42.0)
    assert (got[1]["affected_services"], got[1]["confidence"], got[1]["latency_ms"]) == ([], 0.0, 9.5)


def test_hostile_alerts_are_rejected_or_kept_apart(spark):
    base = {"service": "s", "metric": "m", "value": 1.5, "timestamp": "2024-01-02T03:04:05Z"}
    cases = [
        ({"value": 1e40}, None),
        ({"value": "1d"}, "value"),
        ({"timestamp": 1e30}, "timestamp"),
        ({"timestamp": "10:30"}, "timestamp"),
        ({"timestamp": "2024-01"}, "timestamp"),
        ({"timestamp": "2024"}, None),
        ({"timestamp": "1704067200"}, None),
        ({"service": "a|b", "metric": "c"}, None),
        ({"service": "a", "metric": "b|c"}, None),
        ({"value": 1e-7}, None),
        ({"value": 4e-7}, None),
        ({"value": "NaN"}, None),
        ({"value": "inf"}, None),
        ({"incident_id": "~"}, None),
        ({}, None),
    ]
    rows = [(n, None, json.dumps(base | change)) for n, (change, _) in enumerate(cases)]
    deliveries = spark.createDataFrame(rows, "delivery_id bigint, idempotency_key string, body string")
    deliveries = deliveries.withColumn("received_at", F.lit("2024-01-01").cast("timestamp"))
    parsed = alerts.parse_alerts(deliveries).orderBy("delivery_id").collect()
    assert [row["reason"] for row in parsed] == [reason for _, reason in cases]
    keys = [row["alert_key"] for row in alerts.alert_keys(alerts.scan_alerts(deliveries)).collect()]
    assert len(set(keys)) == len(keys) == sum(reason is None for _, reason in cases)


def test_screen_is_never_an_implicit_pass(spark):
    got = verdicts.parse_screen(
        responses(
            spark,
            wrapped({"prompt_safety": {"label": "safe", "confidence": 0.8}}),
            wrapped({"prompt_safety": "unsafe"}),
            wrapped({"prompt_safety": {"label": "maybe"}}),
            wrapped({"other": 1}),
            "3",
        )
    ).orderBy("response_id").collect()
    assert [row["error"] for row in got] == [None, None, "label", "task", "shape"]
    assert [row["allowed"] for row in got] == [True, False, None, None, None]
    assert got[1]["categories"] == ["prompt_safety"]
    drafts = spark.createDataFrame([(i,) for i in range(6)], "draft_id bigint")
    gate = dispatch.screen_gate(drafts, spark.createDataFrame([(0, True), (1, False), (2, None)], "draft_id bigint, allowed boolean"))
    assert [r["gate"] for r in gate.orderBy("draft_id").collect()] == ["send", "blocked", "bypass", "bypass", "bypass", "bypass"]


def test_dispatch_once(spark):
    sent = json.dumps({"idempotency_scope": "i:R", "action": "A"})
    log = spark.createDataFrame(
        [(START, "i", 1, vocab.ACTION_EXECUTED, sent), (START, "i", 2, vocab.BLOCKED, sent.replace("i:R", "i:M"))],
        "ts timestamp, incident_id string, seq bigint, event_type string, payload string",
    )
    drafts = spark.createDataFrame([(1, "i:R", "A"), (2, "i:M", "A"), (3, "i:M", "A"), (4, "i:R", "B")], "draft_id bigint, scope string, action string")
    got = {row["draft_id"]: row["status"] for row in dispatch.dispatch_once(drafts, log).collect()}
    assert got == {1: "duplicate", 2: "sent", 3: "duplicate", 4: "sent"}


def test_action_arguments_and_wording(spark):
    text = "x" * 300 + "\nbody"
    drafts = spark.createDataFrame([(vocab.CHAT_ACTION, text), (vocab.TICKET_ACTION, text), ("FAX", text)], "action string, text string")
    chat, ticket, fax = dispatch.action_args(drafts).collect()
    assert json.loads(chat["arguments"]) == {"channel": "#incidents", "markdown_text": text}
    assert json.loads(ticket["arguments"])["summary"] == "x" * 255
    assert fax["arguments"] is None and fax["error"] == "unknown action FAX"
    incident = spark.createDataFrame([("i", "MITIGATING", "a → b (5s)", "dana")], "incident_id string, state string, causal_summary string, suggested_owner string")
    made = dispatch.action_text(incident).first()
    rows = [("u", vocab.CHAT_ACTION, made["update_text"]), ("f", vocab.TICKET_ACTION, made["followup_text"])]
    rows += [("bad", vocab.CHAT_ACTION, vocab.SUGGESTION + " assigned to dana"), ("none", vocab.TICKET_ACTION, "hello")]
    got = dispatch.wording_check(spark.createDataFrame(rows, "text_id string, action string, text string")).collect()
    assert {row["text_id"]: row["problem"] for row in got} == {"bad": "speaks of assigning", "none": "no suggestion"}


def test_citations(spark):
    hit = {"title": " Book ", "content_id": "c1", "chunk_text": "chunk"}

    def body(answer, results, total=1):
        return {"answer": answer, "results": results, "total_results": total}

    bodies = [
        body("text", [hit]), body("text", [{"title": "Book"}]), body("text", [{"content_id": "c1"}]), body(" ", [hit]),
        body(None, [{"title": "t"}]), body("text", [{"title": " "}]), body("text", []), body(vocab.NO_MATCH_ANSWER, [hit]),
        body("text", [hit], 0), body("text", ["x"]), {"results": [hit]}, {"answer": "x", "results": None}, "[]",
    ]
    rows = responses(spark, *bodies).withColumnRenamed("response_id", "query_id")
    got = retrieval.cited_documents(rows).orderBy("query_id").collect()
    assert [row["status"] for row in got] == ["ok"] * 4 + ["shape", "uncited"] + ["no_document"] * 3 + ["shape"] * 4
    assert [row["citation"] for row in got[:4]] == ["Book (c1)", "Book", "senso:c1", "Book (c1)"]
    assert got[3]["content"] == "chunk" and got[1]["source_id"] == "citation:Book"


def test_steps_and_owners(spark):
    text = "intro\n## Steps\n 1.  Check the pool.  \n2. Raise it\n## a+b (x)\n- Primary owner: kim\n## c\n- Primary owner: dana-chen\n"
    rows = spark.createDataFrame([(text, "c"), (text, "a+b (x)"), (text, "missing"), ("no owner", "c")], "text string, service string")
    got = rows.select(
        retrieval.first_step(F.col("text")).alias("step"),
        retrieval.primary_owner(F.col("text"), F.col("service")).alias("owner"),
    ).collect()
    assert [row["step"] for row in got] == ["Check the pool."] * 3 + [None]
    # a missing section falls back to the whole text
    assert [row["owner"] for row in got] == ["dana-chen", "kim", "kim", None]


def test_vector_search_in_blocks_equals_brute_force(spark):
    rng = np.random.default_rng(1)
    vectors = rng.normal(size=(200, 8))
    vectors[50] = vectors[51]
    queries = rng.normal(size=(9, 8))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "vec_id bigint, embedding array<double>").repartition(4)
    qdf = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(queries)], "query_id bigint, embedding array<double>")
    got = retrieval.vector_topk(df, qdf, k=5).collect()
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    scores = np.round((queries / np.linalg.norm(queries, axis=1, keepdims=True)) @ unit.T, 6)
    want = {(q, r + 1, int(i)) for q in range(9) for r, i in enumerate(sorted(range(200), key=lambda i: (-scores[q, i], i))[:5])}
    assert {(row["query_id"], row["rank"], row["vec_id"]) for row in got} == want


def test_chunks_cover_the_text(spark):
    text = "first\n \nsecond " + "x" * 25 + "\n\n\nthird"
    got = retrieval.kb_chunks(spark.createDataFrame([(1, "t", text)], "content_id bigint, title string, text string"), 10)
    parts = [row["chunk_text"] for row in got.orderBy("chunk_index").collect()]
    assert "".join(parts) == "firstsecond " + "x" * 25 + "third" and max(map(len, parts)) <= 10


def test_search_prefers_rare_words(spark):
    docs = spark.createDataFrame(
        [(1, 0, "pool pool exhausted", "a"), (2, 0, "latency pool", "b"), (3, 0, "latency latency", "c")],
        "content_id bigint, chunk_index bigint, chunk_text string, title string",
    )
    asked = spark.createDataFrame([(7, "Pool EXHAUSTED!"), (8, "unknown")], "query_id bigint, query string")
    got = retrieval.search_topk(docs, asked, 2)
    assert [(r["query_id"], r["rank"], r["content_id"]) for r in got.orderBy("rank").collect()] == [(7, 1, 1), (7, 2, 2)]
    checked = {r["query_id"]: (r["n_results"], r["grounded"]) for r in retrieval.grounding_check(asked, got).collect()}
    assert checked == {7: (2, True), 8: (0, False)}


def test_tickets(spark):
    text = "Severity: P1. Date: 2026-05-22. Services: pay, db.\n\nSymptom.\n\nResolved by: dana-chen (platform). Duration: 19 minutes."
    rows = spark.createDataFrame([(1, text), (2, "nothing")], "external_id bigint, description string")
    full, empty = history.ticket_fields(rows).orderBy("external_id").collect()
    assert (full["severity"], str(full["date"]), full["services"], full["resolver"], full["minutes"]) == ("P1", "2026-05-22", ["pay", "db"], "dana-chen", 19)
    assert empty["severity"] is None and empty["services"] is None and empty["minutes"] is None


def test_ownership_nine_of_twelve(spark):
    rows = [("pay", START + timedelta(days=i), i, "dana" if i % 4 else "miguel") for i in range(12)]
    rows += [("pay", START - timedelta(days=9), 99, "old")] * 5
    got = history.ownership_baseline(spark.createDataFrame(rows, "service string, ts timestamp, external_id bigint, author string")).first()
    assert got["basis"] == "9 of the last 12 incidents on pay resolved by dana"


def test_messages(spark):
    planned = spark.createDataFrame([("c", "hello\nmore"), ("c", "new"), ("d", "hello")], "channel string, text string")
    posted = spark.createDataFrame([("c", " hello \nother", None), ("c", "new", "channel_join")], "channel string, text string, subtype string")
    assert sorted(map(tuple, history.new_messages(planned, posted).collect())) == [("c", "new"), ("d", "hello")]


def test_release(spark):
    incidents = spark.createDataFrame([(c,) for c in "abcde"], "incident_id string")
    rows = [("a", True, True, 1.0), ("b", True, False, 2.0), ("c", True, None, 3.0), ("d", False, None, None)]
    found = report.report_release(incidents, spark.createDataFrame(rows, "incident_id string, available boolean, allowed boolean, latency_ms double"))
    got = {row["incident_id"]: row["decision"] for row in found.collect()}
    assert got == {"a": "release", "b": "blocked", "c": "bypass", "d": "unscreened", "e": "unscreened"}
    chunks = spark.createDataFrame([(i, n, "xy", d) for i in "ab" for n, d in enumerate((0.0, 3.0, 0.05))], "incident_id string, idx bigint, token string, delay double")
    timed = report.release_schedule(chunks).where("incident_id = 'a'").orderBy("idx").collect()
    assert [round(row["release_at"], 6) for row in timed] == [0.0, 0.1, 0.15]
    metric = report.report_metrics(chunks, found).collect()
    assert [(r["incident_id"], r["token_count"], r["char_count"], r["screened"]) for r in metric] == [("a", 3, 6, True)]


def test_text_functions(spark):
    rows = spark.createDataFrame([("Runbook: pay p99!", "<a & 'b' \"c\">")], "t string, h string")
    got = rows.select(slug(F.col("t")).alias("s"), html_escape(F.col("h")).alias("e"), slug(F.lit("!!")).alias("d")).first()
    assert tuple(got) == ("runbook-pay-p99", "&lt;a &amp; &#x27;b&#x27; &quot;c&quot;&gt;", "document")


def test_model_hook_keeps_every_row(spark):
    rows = spark.range(1000).withColumn("text", F.repeat(F.lit("x"), F.col("id").cast("int") % 7))
    scored = verdicts.score_text(rows, lambda f: pd.DataFrame({"id": f["id"], "n": f["text"].str.len()}), "id bigint, n bigint")
    assert scored.count() == 1000 and scored.where("id = 13").first()["n"] == 6


def test_csv_and_tables(spark):
    prepare(spark)
    path = scratch_path(spark, "csv")
    rows = [("2024-01-01T00:00:05Z", "b", "m", 2.0), ("2024-01-01T00:00:00Z", "a", "m", 1.0)]
    spark.createDataFrame(rows, "ts string, service string, metric_name string, value double").write.option("header", True).csv(path)
    got = metrics.scan_metrics_csv(spark, path).collect()
    assert [(r["service"], r["ts"].second) for r in got] == [("a", 0), ("b", 5)]
    empty = scratch_path(spark, "csv")
    spark.createDataFrame([], "ts string, service string, metric_name string, value double").write.option("header", True).csv(empty)
    with pytest.raises(ValueError):
        metrics.scan_metrics_csv(spark, empty)
    names = tables.create_tables(spark, "t_")
    assert tables.create_tables(spark, "t_") == names
    assert spark.table("t_events").columns == ["ts", "incident_id", "seq", "event_type", "payload"]


def test_audit_and_logs(spark):
    path = scratch_path(spark, "audit")
    rows = [(START + timedelta(seconds=i), f"i{i % 2}", i, "t", '{"n": 1}' if i else "{bad") for i in range(10)]
    df = spark.createDataFrame(rows, "ts timestamp, incident_id string, seq bigint, event_type string, payload string")
    events.append_audit(df, path)
    got = events.read_audit(spark, path, "i0", 3).collect()
    assert [row["seq"] for row in got] == [0, 2, 4]
    assert json.loads(got[0]["body"])["content"]["payload"] == {"raw": "{bad"}
    place = scratch_path(spark, "logs")
    records = spark.createDataFrame([(START, "INFO", "l", "m", '{"x":{"y":1}}'), (START, "WARN", "l", "n", None)], "timestamp timestamp, level string, logger string, msg string, extra string")
    logs.write_json_logs(records, place)
    back = {r["msg"]: r for r in logs.scan_json_logs(spark, place).withColumn("e", F.to_json("extra")).collect()}
    assert back["m"]["e"] == '{"x":{"y":1}}' and back["n"]["e"] == "{}" and back["m"]["level"] == "INFO"
