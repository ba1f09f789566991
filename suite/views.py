"""Reference-shaped inputs derived from the supplied tables.

Each view is one SQL text that Spark and DuckDB both run. `@name@` stands for a supplied table.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from faultline.plans.slices import settled
from faultline.session import prepare

_TABLE = re.compile(r"@(\w+)@")

# Given schemas spare a footer-reading job per table.
SCHEMAS = {
    "events": "event_id BIGINT, ts TIMESTAMP_NTZ, user_id BIGINT, event_type STRING, value DOUBLE, props STRING",
    "orders": "o_orderkey BIGINT, o_custkey BIGINT, o_orderstatus STRING, o_totalprice DOUBLE, "
    "o_orderdate TIMESTAMP_NTZ, o_orderpriority STRING",
    "documents": "doc_id BIGINT, text STRING, lang STRING, source STRING, n_chars BIGINT",
    "labels": "doc_id BIGINT, quality INT, toxic INT",
    "embeddings": "vec_id BIGINT, embedding ARRAY<FLOAT>, label INT",
    "benchmark": "item_id BIGINT, text STRING",
    "conversations": "conv_id BIGINT, turn BIGINT, role STRING, text STRING",
}

METRICS = """
SELECT CAST(ts AS TIMESTAMP) AS ts, event_type AS service,
       CASE WHEN user_id % 4 = 3 THEN 'limit' ELSE 'm' || CAST(user_id % 4 AS STRING) END AS metric,
       CASE WHEN user_id % 4 = 3 THEN CAST(100.0 AS DOUBLE) ELSE value END AS value
FROM @events@
"""

# Sixteen consecutive events make one incident; the place inside it decides the type.
LOG = """
SELECT ts, 'inc-' || nt AS incident_id, seq, event_type, CASE
    WHEN seq % 53 = 0 THEN '{"broken": ' || kt
    WHEN seq % 59 = 0 THEN ''
    WHEN event_type = 'alert.received' THEN '{"incident_id":"inc-' || nt || '","metric":"m1","service":"' || svc || '","value":' || kt || '}'
    WHEN event_type = 'incident.opened' THEN '{"state":"INVESTIGATING","alert":{"service":"' || svc || '","metric":"m1"}}'
    WHEN event_type = 'extraction.completed' THEN '{"affected_services":["' || svc || '","svc-' || CAST(u % 3 AS STRING) || '"],"latency_ms":' || lat || ',"model":"m","severity":"P' || CAST(u % 4 AS STRING) || '"}'
    WHEN event_type = 'causal.chains_detected' THEN '{"edges":[{"cause_service":"gateway","effect_service":"' || svc || '","lag_seconds":' || kt || '},{"cause_service":"","effect_service":"x","lag_seconds":5},{"cause_service":"' || svc || '","effect_service":"down","lag_seconds":"7"},17,{"cause_service":"' || svc || '","effect_service":"svc-2","lag_seconds":' || CAST(k + 60 AS STRING) || '}],"sql":"SELECT 1"}'
    WHEN event_type = 'runbook.retrieved' THEN '{"citation":"Runbook ' || CAST(u AS STRING) || '","latency_ms":' || lat || ',"source_id":"doc-' || CAST(u AS STRING) || '"}'
    WHEN event_type = 'ownership.suggested' THEN '{"citation":"Owners ' || CAST(u AS STRING) || '","latency_ms":' || lat || ',"note":"Suggested owner — awaiting confirmation","service":"' || svc || '","suggested_owner":' || CASE WHEN u % 9 = 0 THEN 'null' ELSE '"eng-' || CAST(u % 7 AS STRING) || '"' END || '}'
    WHEN event_type = 'SKIPPED_NOT_CONFIGURED' AND s = 6 THEN CASE WHEN u % 3 = 0 THEN '{"error":"not configured","step":"airbyte_context_lookup"}' ELSE '{"blocker":"B' || CAST(u % 5 AS STRING) || '","error":"not configured","step":"airbyte_context_lookup"}' END
    WHEN event_type = 'SKIPPED_NOT_CONFIGURED' THEN '{"error":"no key","step":"postmortem_generation"}'
    WHEN event_type = 'context.related_items' THEN '{"latency_ms":' || lat || ',"result":[]}'
    WHEN event_type = 'runbook.step_selected' THEN CASE WHEN u % 4 = 0 THEN '{"note":"manual selection","step":null}' ELSE '{"note":"parsed","step":"Check pool ' || kt || '"}' END
    WHEN event_type = 'state.transition' THEN '{"to":"' || CASE WHEN s = 10 THEN 'RESOLVED' WHEN s = 15 THEN 'INVESTIGATING' WHEN n % 7 = 0 THEN 'RESOLVED' WHEN n % 13 = 0 THEN 'BOGUS' ELSE 'MITIGATING' END
        || '","from":"' || CASE WHEN s = 10 THEN 'MITIGATING' WHEN s = 15 THEN 'RESOLVED' ELSE 'INVESTIGATING' END || '"}'
    WHEN event_type = 'owner_confirmed' THEN '{"confirmed_by":"eng-' || CAST(u % 4 AS STRING) || '","owner":"eng-' || CAST(u % 7 AS STRING) || '"}'
    WHEN event_type = 'DEGRADED' THEN '{"during_event_type":"runbook.retrieved","error":"timeout","service":"search-' || CAST(u % 3 AS STRING) || '"}'
    WHEN event_type IN ('agent.error', 'postmortem_error') THEN '{"error":"boom ' || kt || '"}'
    WHEN event_type = 'postmortem_token' THEN CASE WHEN u % 10 = 9 THEN '{"token":"w' || kt || ' "}' ELSE '{"index":' || CAST(13 - s AS STRING) || ',"token":"w' || kt || ' "}' END
    WHEN event_type = 'postmortem_complete' THEN '{"elapsed_ms":' || kt || ',"model":"text-model","token_count":3}'
    WHEN event_type = 'BLOCKED_BY_GUARDRAIL' THEN '{"categories":["prompt_safety"],"screen_latency_ms":' || kt || ',"step":"postmortem"}'
    ELSE '{"action":"SLACK_SEND_MESSAGE","idempotency_scope":"inc-' || nt || ':RESOLVED","screen_latency_ms":' || kt || '}'
  END AS payload
FROM @v_log_base@
"""

LOG_BASE = """
  SELECT *, CAST(n AS STRING) AS nt, CAST(k AS STRING) AS kt, CASE WHEN u % 10 = 0 THEN 'null' ELSE CAST(k AS STRING) END AS lat,
    CASE WHEN s = 0 THEN 'alert.received'
         WHEN s = 1 THEN CASE WHEN n % 11 = 0 THEN 'extraction.completed' ELSE 'incident.opened' END
         WHEN s = 2 THEN CASE WHEN n % 11 = 0 THEN 'incident.opened' ELSE 'extraction.completed' END
         WHEN s = 3 THEN 'causal.chains_detected'
         WHEN s = 4 THEN 'runbook.retrieved'
         WHEN s = 5 THEN 'ownership.suggested'
         WHEN s = 6 THEN CASE WHEN n % 2 = 0 THEN 'SKIPPED_NOT_CONFIGURED' ELSE 'context.related_items' END
         WHEN s = 7 THEN 'runbook.step_selected'
         WHEN s = 8 THEN 'state.transition'
         WHEN s = 9 THEN CASE WHEN n % 3 = 0 THEN 'owner_confirmed' ELSE 'DEGRADED' END
         WHEN s = 10 THEN CASE WHEN n % 4 = 0 THEN 'agent.error' ELSE 'state.transition' END
         WHEN s < 14 THEN CASE WHEN n % 9 = 0 THEN 'DEGRADED' ELSE 'postmortem_token' END
         WHEN s = 14 THEN CASE n % 5 WHEN 0 THEN 'postmortem_complete' WHEN 1 THEN 'BLOCKED_BY_GUARDRAIL'
                          WHEN 2 THEN 'SKIPPED_NOT_CONFIGURED' WHEN 3 THEN 'postmortem_error' ELSE 'action.executed' END
         ELSE CASE WHEN n % 6 = 0 THEN 'state.transition' ELSE 'action.executed' END
    END AS event_type
  FROM (
    SELECT CAST(ts AS TIMESTAMP) AS ts, event_id AS seq, CAST(floor(event_id / 16) AS BIGINT) AS n, event_id % 16 AS s,
           CAST(floor(value * 10) AS BIGINT) AS k, user_id AS u, event_type AS svc
    FROM @events@
  )
"""

# What each of two sinks kept of the log.
SINK_A = "SELECT * FROM @v_log@ WHERE seq % 97 <> 0 AND seq % 193 <> 5"
SINK_B = "SELECT * FROM @v_log@ WHERE seq % 89 <> 0 AND seq % 193 <> 5"

# Every event as an alert delivery; large values are delivered twice, small ones are broken.
ALERTS = """
SELECT event_id * 2 AS delivery_id, received_at, idempotency_key, body FROM @v_alert_base@
UNION ALL
SELECT event_id * 2 + 1 AS delivery_id, received_at, idempotency_key, body FROM @v_alert_base@ WHERE value >= 60
"""
ALERT_BASE = """
SELECT event_id, value, CAST(ts AS TIMESTAMP) AS received_at,
  CASE WHEN user_id % 3 = 0 THEN 'key-' || CAST(CAST(floor(event_id / 4) AS BIGINT) AS STRING) END AS idempotency_key,
  CASE WHEN value < 2 THEN '{"service":"' || event_type
       WHEN value < 4 THEN '{"service":"","metric":"m1","value":1.5,"timestamp":"2024-01-02T03:04:05Z"}'
       WHEN value < 6 THEN '{"service":"' || event_type || '","metric":"m1","value":"n/a","timestamp":"2024-01-02T03:04:05Z"}'
       WHEN value < 8 THEN '{"service":"' || event_type || '","metric":"m1","value":1.5,"timestamp":"soon"}'
       WHEN value < 10 THEN '{"service":"' || event_type || '","value":1.5,"timestamp":"2024-01-02T03:04:05Z"}'
       WHEN value < 12 THEN '{"service":"' || event_type || '","metric":"m1","value":1.5,"timestamp":"2024-01-02T03:04:05Z","incident_id":7}'
       WHEN value < 14 THEN '{"service":"' || event_type || '","metric":"m1","value":"12.5","timestamp":"2024-01-02T03:04:05Z"}'
       WHEN value < 14.5 THEN '{"service":"s","metric":"m","value":1e40,"timestamp":"2024-01-02T03:04:05Z"}'
       WHEN value < 15 THEN '{"service":"s","metric":"m","value":"NaN","timestamp":"2024-01-02T03:04:05Z"}'
       WHEN value < 15.5 THEN '{"service":"s","metric":"m","value":"Infinity","timestamp":"2024-01-02T03:04:05Z"}'
       WHEN value < 16 THEN '{"service":"s","metric":"m","value":"1d","timestamp":"2024-01-02T03:04:05Z"}'
       WHEN value < 16.5 THEN '{"service":"s","metric":"m","value":1.5,"timestamp":1e30}'
       WHEN value < 17 THEN '{"service":"s","metric":"m","value":1.5,"timestamp":"10:30"}'
       WHEN value < 17.5 THEN '{"service":"s","metric":"m","value":1.5,"timestamp":"2024"}'
       WHEN value < 18 THEN '{"service":"s","metric":"m","value":1.5,"timestamp":"2024-01"}'
       WHEN value < 18.5 THEN '{"service":"s","metric":"m","value":1.5,"timestamp":"1704067200"}'
       WHEN value < 19 THEN '{"service":"a|b","metric":"c","value":1.5,"timestamp":"2024-01-02"}'
       WHEN value < 19.5 THEN '{"service":"a","metric":"b|c","value":1.5,"timestamp":"2024-01-02"}'
       WHEN value < 20 THEN '{"service":"s","metric":"m","value":1.0000001,"timestamp":"2024-01-02T03:04:05Z"}'
       WHEN value < 20.5 THEN '{"service":"s","metric":"m","value":1.0000004,"timestamp":"2024-01-02T03:04:05Z"}'
       WHEN value < 21 THEN '{"service":"s","metric":"m","value":1.0000004,"timestamp":"2024-01-02T03:04:05Z","incident_id":"~"}'
       ELSE '{"service":"' || event_type || '","metric":"m' || CAST(user_id % 4 AS STRING) || '","value":' || CAST(value AS STRING)
         || ',"timestamp":"2024-01-' || lpad(CAST(1 + user_id % 28 AS STRING), 2, '0') || 'T00:00:' || lpad(CAST(event_id % 60 AS STRING), 2, '0') || 'Z"'
         || CASE WHEN user_id % 2 = 0 THEN ',"incident_id":"inc-' || CAST(user_id AS STRING) || '"' ELSE '' END || '}'
  END AS body
FROM @events@
"""
REQUESTS = "SELECT CAST(user_id AS STRING) AS client, event_id AS request_id, CAST(ts AS TIMESTAMP) AS ts FROM @events@"

# Model responses for every labelled document, some of them malformed.
EXTRACTIONS = """
SELECT doc_id AS response_id, CAST(doc_id AS DOUBLE) AS wall_ms,
  CASE WHEN doc_id % 23 = 0 THEN '[1]'
       WHEN doc_id % 19 = 0 THEN '{"result":{"data":{"entities":{}}}}'
       WHEN doc_id % 17 = 0 THEN '{"result":{"data":{"severity":{"label":"maybe"},"entities":{"affected_service":[]}}}}'
       WHEN doc_id % 13 = 0 THEN '{"result":{"data":{"severity":{"label":"P1","confidence":0.5},"entities":{}}}}'
       WHEN doc_id % 11 = 0 THEN '{"result":{"data":{"severity":{"label":"P1"},"entities":{"affected_service":[{"confidence":0.5}]}}}}'
       WHEN doc_id % 7 = 0 THEN '{"result":{"data":{"severity":"P' || CAST(quality * 2 + toxic AS STRING) || '","entities":{"affected_service":["svc-' || CAST(doc_id % 5 AS STRING) || '"]}}}}'
       ELSE '{"latency_ms":' || CAST(doc_id % 200 AS STRING) || '.5,"result":{"data":{"severity":{"label":"P' || CAST(quality * 2 + toxic AS STRING)
         || '","confidence":0.' || CAST(1 + doc_id % 9 AS STRING) || '},"entities":{"affected_service":[{"text":"svc-' || CAST(doc_id % 5 AS STRING)
         || '","confidence":0.9,"start":0,"end":5},{"text":"db","confidence":0.8,"start":9,"end":11}]}}}}'
  END AS body
FROM @labels@
"""
SCREENS = """
SELECT doc_id AS response_id, CAST(doc_id AS DOUBLE) AS wall_ms,
  CASE WHEN doc_id % 23 = 0 THEN 'not json'
       WHEN doc_id % 19 = 0 THEN '{"result":{"data":{"other":1}}}'
       WHEN doc_id % 17 = 0 THEN '{"result":{"data":{"prompt_safety":{"label":"maybe","confidence":0.5}}}}'
       WHEN doc_id % 7 = 0 THEN '{"result":{"data":{"prompt_safety":"' || CASE WHEN toxic = 1 THEN 'unsafe' ELSE 'safe' END || '"}}}'
       ELSE '{"latency_ms":' || CAST(doc_id % 300 AS STRING) || ',"result":{"data":{"prompt_safety":{"label":"'
         || CASE WHEN toxic = 1 THEN 'unsafe' ELSE 'safe' END || '","confidence":0.' || CAST(1 + doc_id % 9 AS STRING) || '}}}}'
  END AS body
FROM @labels@
"""
# A chat and a ticket draft per document; several drafts share an incident.
DRAFTS = """
SELECT doc_id * 3 AS draft_id, doc_id AS response_id, 'inc-' || CAST(doc_id % 100 AS STRING) || ':RESOLVED' AS scope,
       'SLACK_SEND_MESSAGE' AS action, text FROM @documents@
UNION ALL
SELECT doc_id * 3 + 1, doc_id, 'inc-' || CAST(doc_id % 150 AS STRING) || ':MITIGATING', 'JIRA_CREATE_ISSUE', text FROM @documents@
UNION ALL
SELECT doc_id * 3 + 2, doc_id, 'inc-' || CAST(doc_id AS STRING) || ':RESOLVED', 'FAX_' || upper(lang), text FROM @documents@
"""

# Documents as knowledge entries, runbooks and ownership maps.
DOCS = "SELECT doc_id AS content_id, source || ' ' || lang || ' ' || CAST(n_chars AS STRING) AS title, text FROM @documents@"
RUNBOOKS = """
SELECT doc_id AS content_id, source || '-' || CAST(doc_id % 700 AS STRING) AS title, lang AS service,
  '## Symptom pattern' || chr(10) || text || chr(10) || chr(10)
  || CASE WHEN doc_id % 5 = 0 THEN '' ELSE '## Steps' || chr(10) || '  1. Check ' || source || ' pool.  ' || chr(10) || '2. Raise it.' || chr(10) END
  || CASE WHEN doc_id % 3 = 0 THEN '' ELSE '## Last applied' || chr(10) || 'INC-' || CAST(doc_id AS STRING) || chr(10) END
  || '## ' || CASE WHEN doc_id % 4 = 0 THEN 'other' ELSE lang END || chr(10) || '- team: x' || chr(10)
  || CASE WHEN doc_id % 6 = 0 THEN '' ELSE '- Primary owner: eng-' || CAST(doc_id % 11 AS STRING) || chr(10) END
  || '## zz' || chr(10) || '- Primary owner: eng-last' || chr(10)
  || '## Resolution time' || chr(10) || CAST(n_chars AS STRING) || ' minutes' AS text
FROM @documents@
"""
RESPONSES = """
SELECT doc_id AS query_id,
  CASE WHEN doc_id % 31 = 0 THEN '["list"]'
       WHEN doc_id % 29 = 0 THEN '{"answer":"x"}'
       WHEN doc_id % 23 = 0 THEN '{"results":[{"title":"t"}]}'
       WHEN doc_id % 19 = 0 THEN '{"answer":"a","results":[],"total_results":0}'
       WHEN doc_id % 17 = 0 THEN '{"answer":"No results found for your query.","results":[{"title":"t"}],"total_results":1}'
       WHEN doc_id % 13 = 0 THEN '{"answer":"a","results":["t"],"total_results":1}'
       WHEN doc_id % 11 = 0 THEN '{"answer":" ","results":[{"title":"' || source || '","chunk_text":"' || lang || '"}],"total_results":1}'
       WHEN doc_id % 7 = 0 THEN '{"answer":null,"results":[{"title":"' || source || '","content_id":"c' || CAST(doc_id AS STRING) || '"}],"total_results":1}'
       WHEN doc_id % 5 = 0 THEN '{"answer":"' || lang || '","results":[{"title":" ","chunk_text":"x"}],"total_results":1}'
       WHEN doc_id % 3 = 0 THEN '{"answer":"' || lang || '","results":[{"content_id":' || CAST(doc_id AS STRING) || '}],"total_results":1}'
       ELSE '{"answer":"' || source || ' says","results":[{"title":" ' || source || '","content_id":"c' || CAST(doc_id AS STRING) || '"}],"total_results":3}'
  END AS body
FROM @documents@
"""
# Orders as tickets: open ones lack a resolution.
TICKETS = """
SELECT o_orderkey AS external_id, CAST(o_orderdate AS TIMESTAMP) AS ts, o_orderpriority AS service, 'eng-' || CAST(o_custkey % 7 AS STRING) AS author,
  'P' || CAST(o_custkey % 4 AS STRING) || ' ' || o_orderpriority || ' case ' || CAST(o_custkey AS STRING) AS summary,
  'Severity: P' || CAST(o_custkey % 4 AS STRING) || '. Date: ' || CAST(CAST(o_orderdate AS DATE) AS STRING) || '. Services: ' || o_orderpriority
    || CASE WHEN o_custkey % 3 = 0 THEN ', db-primary' ELSE '' END || '.' || chr(10) || chr(10) || 'Symptom: x.'
    || CASE WHEN o_orderstatus = 'O' THEN '' ELSE chr(10) || chr(10) || 'Resolved by: eng-' || CAST(o_custkey % 7 AS STRING)
       || ' (platform). Duration: ' || CAST(CAST(floor(o_totalprice / 1000) AS BIGINT) AS STRING) || ' minutes.' END AS description,
  CASE WHEN o_custkey % 10 = 0 THEN 'follow-up,' ELSE 'incident,' END || o_orderpriority AS label_text,
  CASE WHEN o_orderstatus = 'O' THEN 'To Do' ELSE 'Done' END AS status
FROM @orders@
"""
MESSAGES = """
SELECT conv_id, turn, 'c' || CAST(conv_id % 5 AS STRING) AS channel, text, CASE WHEN turn % 4 = 0 THEN 'channel_join' END AS subtype, role FROM @conversations@
"""

# Report tokens with their arrival delay, and a screening verdict for most incidents.
CHUNKS = """
SELECT 'inc-' || nt AS incident_id, 13 - s AS idx, 'w' || kt || ' ' AS token, (k - 100) / 5000.0E0 AS delay
FROM @v_log_base@ WHERE event_type = 'postmortem_token'
"""
REPORT_VERDICTS = """
SELECT 'inc-' || nt AS incident_id, u % 5 <> 0 AS available, CASE WHEN u % 7 = 0 THEN NULL ELSE u % 3 <> 0 END AS allowed,
       CAST(k AS DOUBLE) AS latency_ms
FROM @v_log_base@ WHERE event_type = 'alert.received' AND svc <> 'signup'
"""
SPANS = """
SELECT event_type AS name, CASE WHEN value >= 100 THEN 'ERROR' ELSE 'DEFAULT' END AS level, value AS duration_ms FROM @events@
"""
CALLS = "SELECT event_type AS service, event_id AS call_id, CAST(ts AS TIMESTAMP) AS ts, value < 50 AS ok FROM @events@"
ATTEMPTS = """
SELECT CAST(floor(event_id / 3) AS BIGINT) AS call_id, event_id % 3 + 1 AS attempt,
  CASE WHEN value < 30 THEN 'ok' WHEN value >= 200 THEN 'not_configured' ELSE 'error' END AS outcome,
  CASE WHEN value < 30 OR value >= 200 THEN NULL WHEN event_type = 'click' THEN 503 WHEN event_type = 'view' THEN 404
       WHEN event_type = 'error' THEN 429 WHEN event_type = 'signup' THEN NULL ELSE 500 END AS status
FROM @events@
"""

VIEWS: dict[str, str] = {
    "v_chunks": CHUNKS,
    "v_report_verdicts": REPORT_VERDICTS,
    "v_spans": SPANS,
    "v_calls": CALLS,
    "v_attempts": ATTEMPTS,
    "v_docs": DOCS,
    "v_runbooks": RUNBOOKS,
    "v_responses": RESPONSES,
    "v_tickets": TICKETS,
    "v_messages": MESSAGES,
    "v_metrics": METRICS,
    "v_log": LOG,
    "v_log_base": LOG_BASE,
    "v_sink_a": SINK_A,
    "v_sink_b": SINK_B,
    "v_alerts": ALERTS,
    "v_alert_base": ALERT_BASE,
    "v_requests": REQUESTS,
    "v_extractions": EXTRACTIONS,
    "v_screens": SCREENS,
    "v_drafts": DRAFTS,
}

STORED = {"v_log_base", "v_alert_base", "v_extractions", "v_screens", "v_runbooks", "v_responses", "v_tickets"}

# Views whose rows cost much CPU to make or to read.
HEAVY = STORED | {"v_docs", "v_drafts"}


def spread(df: DataFrame) -> DataFrame:
    """Rows handed round to all cores where a table comes in fewer splits than there are cores.

    The supplied tables are single files with one row group. A table of many splits is left as
    it is, without a shuffle.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if len(df.inputFiles()) == 1 and df.rdd.getNumPartitions() < cores else df


def derive(spark: SparkSession, sf_dir: str, name: str, source=None) -> DataFrame:
    """The view as a DataFrame; `source` reads a supplied table (a stream of it, say)."""
    prepare(spark)
    text = VIEWS[name]
    for table in set(_TABLE.findall(text)):
        if table in VIEWS:
            inner = derive(spark, sf_dir, table, source)
        elif source is not None:
            inner = source(spark, sf_dir, table)
        else:
            inner = read(spark, sf_dir, table)
            inner = spread(inner) if name in HEAVY else inner
        inner.createOrReplaceTempView(f"suite_{table}")
    view = spark.sql(_TABLE.sub(lambda match: f"suite_{match.group(1)}", text))
    # long generated texts stand for stored columns: keep them out of the operators' expressions
    return settled(view) if name in STORED else view


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A supplied table."""
    prepare(spark)
    return spark.read.schema(SCHEMAS[name]).parquet(f"{sf_dir}/{name}.parquet")


def stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A supplied table as a stream of its files, a bounded number per micro-batch."""
    prepare(spark)
    reader = spark.readStream.schema(SCHEMAS[name]).option("pathGlobFilter", f"{name}.parquet")
    return reader.option("maxFilesPerTrigger", 64).parquet(sf_dir)


def with_views(sql: str, *names: str) -> str:
    """A DuckDB statement with the named views, and those they use, in front of it."""
    parts: list[str] = []
    done: set[str] = set()

    def add(name: str) -> None:
        if name in done:
            return
        done.add(name)
        for inner in _TABLE.findall(VIEWS[name]):
            if inner in VIEWS:
                add(inner)
        body = _TABLE.sub(lambda match: match.group(1), VIEWS[name])
        parts.append(f"{name} AS MATERIALIZED ({body})")

    for name in names:
        add(name)
    head = "WITH RECURSIVE " + ",\n".join(parts)
    body = sql.strip()
    if body.upper().startswith("WITH RECURSIVE "):
        return head + ",\n" + body[len("WITH RECURSIVE "):]
    if body.upper().startswith("WITH "):
        return head + ",\n" + body[len("WITH "):]
    return head + "\n" + body
