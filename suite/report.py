"""Report assembly and call telemetry."""

from __future__ import annotations

from pyspark.sql import functions as F

from faultline.functions import vocab
from faultline.operators import eventlog, lifecycle, report, telemetry
from suite.duck import OPEN_LOG, text
from suite.eventlog import AFFECTED, ALL_EDGES, GAPS, LINES, TIMELINE
from suite.registry import CHECKS, query
from suite.views import derive, read

EDGE_TEXT = """
et AS (SELECT incident_id, ord, '- ' || cause_service || ' precedes ' || effect_service || ' by ' || CAST(CAST(lag_seconds AS BIGINT) AS VARCHAR)
       || ' seconds, measured between onsets' AS line FROM edges),
ids AS (SELECT DISTINCT incident_id FROM v_log)
"""
CITED = f"pr AS (SELECT incident_id, {text('citation')} AS citation, {text('source_id')} AS content FROM lg WHERE event_type = 'runbook.retrieved')"


def precedents(log):
    p = F.col("p")
    found = eventlog.opened(log, vocab.RUNBOOK_RETRIEVED).select(
        "incident_id",
        F.lit(1).cast("bigint").alias("rank"),
        eventlog.jsonval.text(p, "$.citation").alias("citation"),
        eventlog.jsonval.text(p, "$.source_id").alias("content"),
    )
    return found.dropna(subset=["citation"])


@query(
    "report_prompts",
    f"""WITH {OPEN_LOG}, {LINES}, {ALL_EDGES}, {EDGE_TEXT}, {CITED},
    e AS (SELECT incident_id, string_agg(line, chr(10) ORDER BY ord) AS text FROM et GROUP BY incident_id),
    c AS (SELECT incident_id, '[citation: ' || citation || ']' || chr(10) || content AS text FROM pr WHERE citation IS NOT NULL)
    SELECT incident_id, CAST(0 AS BIGINT) AS ord, CAST(0 AS BIGINT) AS part, 'Incident ' || incident_id || chr(10) || '{report.RULES}' || chr(10)
      || '## Timeline' || chr(10) || '## Root Cause' || chr(10) || '## Impact' || chr(10) || '## Action Items' AS text FROM ids
    UNION ALL SELECT ids.incident_id, 1, 0, coalesce(e.text, '{report.NO_EDGE}') FROM ids LEFT JOIN e USING (incident_id)
    UNION ALL SELECT ids.incident_id, 2, 0, coalesce(c.text, '{report.NO_PRECEDENT}') FROM ids LEFT JOIN c USING (incident_id)
    UNION ALL SELECT incident_id, 3, 0, '{vocab.LOG_BEGIN}' || chr(10) || string_agg(line, chr(10) ORDER BY ts, seq) || chr(10) || '{vocab.LOG_END}'
      FROM lines GROUP BY incident_id""",
    ("v_log",),
)
def report_prompts(spark, sf_dir):
    log = derive(spark, sf_dir, "v_log")
    return report.report_prompts(log, eventlog.latest_edges(log), precedents(log))


@query(
    "report_sections",
    f"""WITH {OPEN_LOG}, {TIMELINE}, {ALL_EDGES}, {AFFECTED}, {GAPS}, {EDGE_TEXT},
    sev AS (SELECT incident_id, arg_max(severity, seq) AS severity FROM tl WHERE severity IS NOT NULL GROUP BY incident_id),
    ow AS (SELECT incident_id, arg_max({text('suggested_owner')}, seq) FILTER (WHERE event_type = 'ownership.suggested') AS owner,
             bool_or(event_type = 'owner_confirmed') AS confirmed FROM lg GROUP BY incident_id)
    SELECT incident_id, 'Timeline' AS section, row_number() OVER (PARTITION BY incident_id ORDER BY ts, seq) AS ord,
      '- ' || strftime(ts, '%H:%M:%S') || ' ' || event_type || coalesce(': ' || summary, '') AS line FROM tl
    UNION ALL SELECT ids.incident_id, 'Root Cause', coalesce(ord, 0), coalesce(line, '{report.NO_EDGE}') FROM ids LEFT JOIN et USING (incident_id)
    UNION ALL SELECT ids.incident_id, 'Impact', 0, '- severity: ' || coalesce(severity, 'not in the log') FROM ids LEFT JOIN sev USING (incident_id)
    UNION ALL SELECT incident_id, 'Impact', ord + 1, '- affected service: ' || service FROM aff
    UNION ALL SELECT incident_id, 'Action Items', 1, '- follow up ' || event_type || ' of ' || subject || ' (×' || CAST(n_events AS VARCHAR) || ')' FROM gp
    UNION ALL SELECT incident_id, 'Action Items', 0, '- confirm owner: ' || coalesce(owner, 'none suggested') FROM ow WHERE NOT confirmed""",
    ("v_log",),
)
def report_sections(spark, sf_dir):
    log = derive(spark, sf_dir, "v_log")
    return report.report_sections(
        log, eventlog.latest_edges(log), eventlog.affected_services(log), lifecycle.owner_status(log)
    )


WAIT = "CASE WHEN delay > 0 THEN least(delay, 0.1::DOUBLE) ELSE 0.0::DOUBLE END"


@query(
    "release_schedule",
    f"""SELECT incident_id, idx, token, round(delay, 9) AS delay, round({WAIT}, 9) AS wait,
    round(sum({WAIT}) OVER (PARTITION BY incident_id ORDER BY idx), 9) AS release_at FROM v_chunks""",
    ("v_chunks",),
)
def release_schedule(spark, sf_dir):
    return report.release_schedule(derive(spark, sf_dir, "v_chunks"))


DECISIONS = """
ids AS (SELECT DISTINCT incident_id FROM v_chunks),
dc AS (SELECT incident_id, CASE WHEN NOT coalesce(available, false) THEN 'unscreened' WHEN allowed IS NULL THEN 'bypass'
    WHEN allowed THEN 'release' ELSE 'blocked' END AS decision,
    CASE WHEN available AND allowed IS NOT NULL THEN latency_ms END AS screen_latency_ms FROM ids LEFT JOIN v_report_verdicts USING (incident_id))
"""


def decisions(spark, sf_dir):
    chunks = derive(spark, sf_dir, "v_chunks")
    return chunks, report.report_release(chunks.select("incident_id").distinct(), derive(spark, sf_dir, "v_report_verdicts"))


@query("report_release", f"WITH {DECISIONS} SELECT * FROM dc", ("v_chunks", "v_report_verdicts"))
def report_release(spark, sf_dir):
    return decisions(spark, sf_dir)[1]


@query(
    "released_chunks",
    f"WITH {DECISIONS} SELECT incident_id, idx, token FROM v_chunks JOIN dc USING (incident_id) WHERE decision IN ('release', 'unscreened')",
    ("v_chunks", "v_report_verdicts"),
)
def released_chunks(spark, sf_dir):
    return report.released_chunks(*decisions(spark, sf_dir)).select("incident_id", "idx", "token")


@query(
    "report_metrics",
    f"""WITH {DECISIONS} SELECT incident_id, count(*) AS token_count, CAST(sum(length(token)) AS BIGINT) AS char_count,
    round(sum({WAIT}), 9) AS release_seconds, decision = 'release' AS screened, screen_latency_ms
    FROM v_chunks JOIN dc USING (incident_id) WHERE decision IN ('release', 'unscreened') GROUP BY incident_id, decision, screen_latency_ms""",
    ("v_chunks", "v_report_verdicts"),
)
def report_metrics(spark, sf_dir):
    return report.report_metrics(*decisions(spark, sf_dir))


ESCAPED = """replace(replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#x27;')"""


@query(
    "report_html",
    f"""SELECT 'doc-' || CAST(doc_id AS VARCHAR) AS incident_id,
    CASE WHEN trim(text) <> '' THEN '<!doctype html>' || chr(10) || '<html lang="en"><head><meta charset="utf-8"><title>Incident report — doc-'
      || CAST(doc_id AS VARCHAR) || '</title></head><body><pre>' || {ESCAPED} || '</pre></body></html>' || chr(10) END AS html,
    CASE WHEN trim(text) = '' THEN 'blank text' END AS refused FROM documents""",
)
def report_html(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    return report.report_html(docs.select(F.concat(F.lit("doc-"), F.col("doc_id").cast("string")).alias("incident_id"), "text"))


@query(
    "span_rollup",
    """SELECT name, count(*) AS calls, count(*) FILTER (WHERE level = 'ERROR') AS errors,
    round(quantile_cont(duration_ms, 0.5), 9) AS p50_ms, round(quantile_cont(duration_ms, 0.95), 9) AS p95_ms FROM v_spans GROUP BY name""",
    ("v_spans",),
)
def span_rollup(spark, sf_dir):
    return telemetry.span_rollup(derive(spark, sf_dir, "v_spans"))


FAILS, COOLDOWN = 3, 3600.0


@query(
    "breaker_states",
    f"""WITH RECURSIVE r AS (SELECT service, call_id, epoch_us(ts) / 1e6 AS t, ok, row_number() OVER (PARTITION BY service ORDER BY ts, call_id) AS rn FROM v_calls),
    f AS (
      SELECT service, call_id, rn, 'closed' AS state, true AS runs, CASE WHEN ok THEN 0 ELSE 1 END AS n, CAST(NULL AS DOUBLE) AS opened FROM r WHERE rn = 1
      UNION ALL
      SELECT service, call_id, rn, state, state <> 'open', CASE WHEN state = 'open' THEN n WHEN ok THEN 0 ELSE n + 1 END,
        CASE WHEN state = 'open' THEN opened WHEN ok THEN NULL WHEN n + 1 >= {FAILS} THEN t ELSE opened END
      FROM (SELECT r.service, r.call_id, r.rn, r.t, r.ok, f.n, f.opened,
              CASE WHEN f.opened IS NULL THEN 'closed' WHEN r.t - f.opened >= {COOLDOWN} THEN 'half_open' ELSE 'open' END AS state
            FROM f JOIN r ON r.service = f.service AND r.rn = f.rn + 1))
    SELECT service, call_id, state, runs, CASE WHEN opened IS NULL THEN 'closed' ELSE 'open' END AS state_after FROM f""",
    ("v_calls",),
)
def breaker_states(spark, sf_dir):
    return telemetry.breaker_states(derive(spark, sf_dir, "v_calls"), FAILS, COOLDOWN)


# one service takes a third of all calls
CHECKS["breaker_states_busy"] = (
    CHECKS["breaker_states"]
    .replace("SELECT service, call_id, epoch_us(ts)", "SELECT CASE WHEN call_id % 3 = 0 THEN 'busy' ELSE service END AS service, call_id, epoch_us(ts)")
    .replace("PARTITION BY service ORDER", "PARTITION BY CASE WHEN call_id % 3 = 0 THEN 'busy' ELSE service END ORDER")
)


@query("breaker_states_busy")
def breaker_states_busy(spark, sf_dir):
    busy = F.when(F.col("call_id") % 3 == 0, "busy").otherwise(F.col("service"))
    return telemetry.breaker_states(derive(spark, sf_dir, "v_calls").withColumn("service", busy), FAILS, COOLDOWN, 1_000)


@query(
    "retry_outcomes",
    """WITH a AS (SELECT *, outcome = 'error' AND (status IS NULL OR status IN (408, 425, 429, 500, 502, 503, 504)) AND attempt < 3 AS again FROM v_attempts),
    e AS (SELECT call_id, min(attempt) FILTER (WHERE NOT again) AS stop, max(attempt) AS seen FROM a GROUP BY call_id)
    SELECT e.call_id, CASE WHEN stop IS NULL THEN 'pending' WHEN a.outcome = 'error' THEN 'degraded' ELSE a.outcome END AS result,
      coalesce(stop, seen) AS attempts, coalesce(CAST(a.status AS BIGINT), 0) AS status, 0.5::DOUBLE * (pow(2, coalesce(stop, seen) - 1) - 1) AS wait_seconds
    FROM e LEFT JOIN a ON a.call_id = e.call_id AND a.attempt = stop""",
    ("v_attempts",),
)
def retry_outcomes(spark, sf_dir):
    return telemetry.retry_outcomes(derive(spark, sf_dir, "v_attempts")).fillna({"status": 0})
