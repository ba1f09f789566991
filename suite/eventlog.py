"""Event-log reads, lifecycle, timeline and sink comparison."""

from __future__ import annotations

from pyspark.sql import functions as F

from faultline.functions import vocab
from faultline.operators import causal, eventlog, lifecycle, sinks, timeline
from faultline.plans.slices import find_hot
from suite.duck import OPEN_LOG, number, text, types
from suite.registry import query, stamp
from suite.views import derive, read

V = ("v_log",)
ISO = f"{stamp('ts')} || '+00:00'"
# payload text with sorted keys; only two event types are written unsorted
CANON = f"""CASE WHEN json_type(j, '$.raw') IS NOT NULL THEN CAST(j AS VARCHAR)
  WHEN event_type = 'state.transition' AND json_type(j, '$.to') IS NOT NULL
    THEN '{{"from":"' || json_extract_string(j, '$.from') || '","to":"' || json_extract_string(j, '$.to') || '"}}'
  WHEN event_type = 'incident.opened' AND json_type(j, '$.state') IS NOT NULL
    THEN '{{"alert":{{"metric":"m1","service":"' || json_extract_string(j, '$.alert.service') || '"}},"state":"INVESTIGATING"}}'
  ELSE CAST(j AS VARCHAR) END"""
LINES = f"""lines AS (SELECT incident_id, seq, ts,
  '{{"event_type":"' || event_type || '","payload":' || {CANON} || ',"ts":"' || {ISO} || '"}}' AS line FROM lg)"""


def _log(spark, sf_dir):
    return derive(spark, sf_dir, "v_log")


@query(
    "incident_log",
    f"WITH {OPEN_LOG} SELECT incident_id, seq, {ISO} AS ts, event_type, {CANON} AS payload FROM lg",
    V,
)
def incident_log(spark, sf_dir):
    return eventlog.incident_log(_log(spark, sf_dir)).withColumn("payload", F.to_json("payload"))


@query("log_lines", f"WITH {OPEN_LOG}, {LINES} SELECT incident_id, seq, {stamp('ts')} AS ts, line FROM lines", V)
def log_lines(spark, sf_dir):
    return eventlog.log_lines(_log(spark, sf_dir))


@query(
    "log_block",
    f"""WITH {OPEN_LOG}, {LINES} SELECT incident_id, CAST(0 AS BIGINT) AS part, count(*) AS n_rows,
    '{vocab.LOG_BEGIN}' || chr(10) || string_agg(line, chr(10) ORDER BY ts, seq) || chr(10) || '{vocab.LOG_END}' AS text
    FROM lines GROUP BY incident_id""",
    V,
)
def log_block(spark, sf_dir):
    return eventlog.log_block(_log(spark, sf_dir))


@query(
    "refused_incidents",
    """WITH w AS (SELECT DISTINCT 'inc-' || CAST(event_id AS VARCHAR) AS incident_id FROM events)
    SELECT incident_id FROM w WHERE incident_id NOT IN (SELECT incident_id FROM v_log)""",
    V,
)
def refused_incidents(spark, sf_dir):
    log = _log(spark, sf_dir)
    events = read(spark, sf_dir, "events")
    wanted = events.select(F.concat(F.lit("inc-"), F.col("event_id").cast("string")).alias("incident_id"))
    return eventlog.refused_incidents(wanted, log)


@query(
    "event_sequence",
    """SELECT incident_id, row_number() OVER (PARTITION BY incident_id ORDER BY ts, seq) AS position, event_type
    FROM v_log""",
    V,
)
def event_sequence(spark, sf_dir):
    return eventlog.event_sequence(_log(spark, sf_dir))


@query(
    "sequence_contract",
    """WITH o AS (SELECT *, row_number() OVER (PARTITION BY incident_id ORDER BY ts, seq) AS pos
                  FROM v_log WHERE event_type <> 'alert.received'),
    a AS (SELECT incident_id, max(event_type) FILTER (WHERE pos = 1) AS first_type,
                 max(event_type) FILTER (WHERE pos = 2) AS second_type,
                 min(pos) FILTER (WHERE event_type = 'extraction.completed') AS extraction_at,
                 min(pos) FILTER (WHERE event_type LIKE 'llm.%' OR event_type LIKE 'postmortem%') AS report_at,
                 count(*) AS n_events FROM o GROUP BY incident_id)
    SELECT * REPLACE (CAST(extraction_at AS DOUBLE) AS extraction_at, CAST(report_at AS DOUBLE) AS report_at), coalesce(first_type = 'incident.opened' AND second_type = 'extraction.completed'
                       AND (report_at IS NULL OR report_at > extraction_at), false) AS ok FROM a""",
    V,
)
def sequence_contract(spark, sf_dir):
    found = eventlog.sequence_contract(_log(spark, sf_dir))
    places = ("extraction_at", "report_at")
    return found.withColumns({name: F.col(name).cast("double") for name in places})


@query(
    "latest_by_type",
    f"""SELECT incident_id, {stamp('ts')} AS ts, payload FROM v_log WHERE event_type = 'extraction.completed'
    QUALIFY row_number() OVER (PARTITION BY incident_id ORDER BY ts DESC, seq DESC) = 1""",
    V,
)
def latest_by_type(spark, sf_dir):
    return eventlog.latest_by_type(_log(spark, sf_dir), vocab.EXTRACTION_COMPLETED)


AFFECTED = f"""
ex AS (SELECT incident_id, j FROM lg WHERE event_type = 'extraction.completed'
       QUALIFY row_number() OVER (PARTITION BY incident_id ORDER BY ts DESC, seq DESC) = 1),
aff AS (SELECT incident_id, CAST(e.key AS BIGINT) AS ord, json_extract_string(e.value, '$') AS service
        FROM ex, json_each(ex.j, '$.affected_services') e WHERE json_type(e.value) = 'VARCHAR')
"""


@query("affected_services", f"WITH {OPEN_LOG}, {AFFECTED} SELECT * FROM aff", V)
def affected_services(spark, sf_dir):
    return eventlog.affected_services(_log(spark, sf_dir))


ALL_EDGES = f"""
el AS (SELECT incident_id, seq, ts, CAST(e.key AS BIGINT) AS ord, e.value AS e
       FROM lg, json_each(lg.j, '$.edges') e WHERE event_type = 'causal.chains_detected'),
ed AS (SELECT incident_id, seq, ts, ord, {text('cause_service', 'e')} AS cause_service,
              {text('effect_service', 'e')} AS effect_service, {number('lag_seconds', 'e')} AS lag_seconds FROM el),
edges AS (SELECT * FROM ed WHERE cause_service IS NOT NULL AND effect_service IS NOT NULL AND lag_seconds IS NOT NULL)
"""


@query(
    "payload_edges",
    f"WITH {OPEN_LOG}, {ALL_EDGES} SELECT * REPLACE ({stamp('ts')} AS ts) FROM edges",
    V,
)
def payload_edges(spark, sf_dir):
    log = _log(spark, sf_dir)
    return eventlog.payload_edges(log.where(eventlog.of_type(vocab.CHAINS_DETECTED)))


@query(
    "graph_nodes",
    f"""WITH {OPEN_LOG}, {ALL_EDGES}, {AFFECTED},
    ends AS (SELECT incident_id, cause_service AS service, 0 AS b, ord AS o, 0 AS e FROM edges
             UNION ALL SELECT incident_id, effect_service, 0, ord, 1 FROM edges
             UNION ALL SELECT incident_id, service, 1, ord, 0 FROM aff),
    g AS (SELECT incident_id, service, min(b * 1000000 + o * 10 + e) AS first_at, bool_or(b = 0 AND e = 0) AS c, bool_or(b = 0 AND e = 1) AS f
          FROM ends GROUP BY ALL)
    SELECT incident_id, row_number() OVER (PARTITION BY incident_id ORDER BY first_at, service) AS position, service,
           CASE WHEN f THEN 'effect' WHEN c THEN 'cause' ELSE 'other' END AS role FROM g""",
    V,
)
def graph_nodes(spark, sf_dir):
    log = _log(spark, sf_dir)
    calm = not find_hot(log, ["incident_id"], "ts")
    return causal.graph_nodes(
        eventlog.latest_edges(log), eventlog.affected_services(log), hot=[] if calm else None
    )


TOKENS = f"""
tk AS (SELECT incident_id, row_number() OVER (PARTITION BY incident_id ORDER BY ts, seq) AS arrival,
              coalesce({text('token')}, '') AS token, {number('index')} AS given
       FROM lg WHERE event_type = 'postmortem_token')
"""


@query(
    "report_text",
    f"""WITH {OPEN_LOG}, {TOKENS} SELECT incident_id, CAST(0 AS BIGINT) AS part, count(*) AS n_tokens,
    string_agg(token, '' ORDER BY coalesce(given, arrival - 1), arrival) AS text FROM tk GROUP BY incident_id""",
    V,
)
def report_text(spark, sf_dir):
    return eventlog.report_text(_log(spark, sf_dir))


@query(
    "clock_text",
    f"""SELECT seq, txt, CASE WHEN seq % 5 = 0 THEN txt ELSE strftime(ts, '%H:%M:%S') END AS clock
    FROM (SELECT seq, ts, CASE WHEN seq % 5 = 0 THEN event_type ELSE {ISO} END AS txt FROM v_log)""",
    V,
)
def clock_text(spark, sf_dir):
    log = _log(spark, sf_dir)
    shown = F.when(F.col("seq") % 5 == 0, F.col("event_type")).otherwise(eventlog.iso_stamp(F.col("ts")))
    return eventlog.clock_text(log.select("seq", shown.alias("txt")), "txt")


MOVES = f"""
mv AS (SELECT incident_id, ts, seq, {text('from')} AS from_state, {text('to')} AS to_state
       FROM lg WHERE event_type = 'state.transition')
"""
VALID = "('INVESTIGATING', 'MITIGATING', 'RESOLVED')"
STATE = f"""
st AS (SELECT incident_id, coalesce(
    arg_max(CASE WHEN event_type = 'state.transition' THEN {text('to')} END, seq)
        FILTER (WHERE event_type = 'state.transition' AND {text('to')} IN {VALID}),
    CASE WHEN bool_or({types('incident.opened', 'alert.received')}) THEN 'INVESTIGATING' END) AS state
  FROM lg GROUP BY incident_id)
"""


@query("incident_state", f"WITH {OPEN_LOG}, {STATE} SELECT * FROM st", V)
def incident_state(spark, sf_dir):
    return lifecycle.incident_state(_log(spark, sf_dir))


@query(
    "illegal_transitions",
    f"""WITH {OPEN_LOG}, {MOVES},
    p AS (SELECT *, coalesce(lag(to_state) OVER (PARTITION BY incident_id ORDER BY ts, seq), 'INVESTIGATING') AS was FROM mv),
    r AS (SELECT *, CASE WHEN coalesce((from_state || '>' || to_state), '') NOT IN ('INVESTIGATING>MITIGATING', 'MITIGATING>RESOLVED')
               THEN 'move' WHEN from_state <> was THEN 'break' END AS reason FROM p)
    SELECT incident_id, {stamp('ts')} AS ts, seq, from_state, to_state, reason FROM r WHERE reason IS NOT NULL""",
    V,
)
def illegal_transitions(spark, sf_dir):
    return lifecycle.illegal_transitions(_log(spark, sf_dir))


@query(
    "transition_path",
    f"""WITH {OPEN_LOG}, {MOVES} SELECT incident_id,
    row_number() OVER (PARTITION BY incident_id ORDER BY ts, seq) AS step, from_state, to_state FROM mv""",
    V,
)
def transition_path(spark, sf_dir):
    return lifecycle.transition_path(_log(spark, sf_dir))


@query(
    "current_incident",
    f"""SELECT coalesce(arg_max(incident_id, seq) FILTER (WHERE {types('incident.opened', 'alert.received')}),
    arg_max(incident_id, seq)) AS incident_id FROM v_log""",
    V,
)
def current_incident(spark, sf_dir):
    return lifecycle.current_incident(_log(spark, sf_dir))


@query(
    "owner_status",
    f"""WITH {OPEN_LOG},
    s AS (SELECT incident_id, {text('suggested_owner')} AS o, {text('citation')} AS c FROM lg WHERE event_type = 'ownership.suggested'
          QUALIFY row_number() OVER (PARTITION BY incident_id ORDER BY ts DESC, seq DESC) = 1),
    c AS (SELECT incident_id, {text('owner')} AS o, {text('confirmed_by')} AS b FROM lg WHERE event_type = 'owner_confirmed'
          QUALIFY row_number() OVER (PARTITION BY incident_id ORDER BY ts DESC, seq DESC) = 1)
    SELECT i.incident_id, s.o AS suggested_owner, s.c AS citation, c.o AS confirmed_owner, c.b AS confirmed_by,
      CASE WHEN c.incident_id IS NOT NULL THEN 'confirmed' WHEN s.incident_id IS NOT NULL THEN 'suggested' ELSE 'awaiting' END AS status
    FROM (SELECT DISTINCT incident_id FROM v_log) i LEFT JOIN s USING (incident_id) LEFT JOIN c USING (incident_id)""",
    V,
)
def owner_status(spark, sf_dir):
    return lifecycle.owner_status(_log(spark, sf_dir))


OUTCOME = f"""
oc AS (SELECT incident_id,
    bool_or(event_type = 'BLOCKED_BY_GUARDRAIL' AND coalesce({text('step')}, '') = 'postmortem') AS blocked,
    arg_max({text('error')}, seq) FILTER (WHERE event_type = 'SKIPPED_NOT_CONFIGURED' AND {text('step')} = 'postmortem_generation') AS skip,
    arg_max({text('error')}, seq) FILTER (WHERE event_type = 'postmortem_error') AS fail,
    bool_or(event_type = 'postmortem_complete') AS done,
    arg_max({number('elapsed_ms')}, seq) FILTER (WHERE event_type = 'postmortem_complete') AS elapsed_ms,
    arg_max({text('model')}, seq) FILTER (WHERE event_type = 'postmortem_complete') AS model,
    bool_or(event_type = 'postmortem_token' AND {text('token')} IS NOT NULL) AS has_text
  FROM lg GROUP BY incident_id)
"""


@query(
    "report_outcome",
    f"""WITH {OPEN_LOG}, {OUTCOME}, {STATE}
    SELECT incident_id, CASE WHEN blocked THEN 'blocked' WHEN skip IS NOT NULL THEN 'skipped' WHEN fail IS NOT NULL THEN 'failed'
        WHEN done THEN 'complete' WHEN has_text THEN 'streaming' ELSE 'none' END AS outcome,
      coalesce(skip, fail) AS error, elapsed_ms, model,
      coalesce(state = 'RESOLVED', false) AND NOT has_text AND NOT blocked AND skip IS NULL AND fail IS NULL AS waiting
    FROM oc JOIN st USING (incident_id)""",
    V,
)
def report_outcome(spark, sf_dir):
    return lifecycle.report_outcome(_log(spark, sf_dir))


TIMELINE = f"""
tl AS (SELECT incident_id, seq, ts, event_type,
    CASE event_type WHEN 'SKIPPED_NOT_CONFIGURED' THEN 'skipped' WHEN 'DEGRADED' THEN 'degraded' WHEN 'BLOCKED_BY_GUARDRAIL' THEN 'blocked'
      WHEN 'agent.error' THEN 'error' WHEN 'postmortem_error' THEN 'error' WHEN 'state.transition' THEN 'milestone'
      WHEN 'postmortem_complete' THEN 'milestone' ELSE 'normal' END AS tone,
    CASE event_type WHEN 'SKIPPED_NOT_CONFIGURED' THEN 'SKIPPED — NOT CONFIGURED' WHEN 'DEGRADED' THEN 'DEGRADED'
      WHEN 'BLOCKED_BY_GUARDRAIL' THEN 'BLOCKED BY GUARDRAIL' WHEN 'agent.error' THEN 'ERROR' WHEN 'postmortem_error' THEN 'ERROR' END AS tone_label,
    coalesce({text('service')}, {text('alert.service')}) AS service, {text('severity')} AS severity,
    CASE event_type
      WHEN 'extraction.completed' THEN 'extraction — severity ' || coalesce({text('severity')}, '?')
      WHEN 'causal.chains_detected' THEN 'causal query complete'
      WHEN 'runbook.retrieved' THEN 'runbook (cited): ' || coalesce({text('citation')}, '')
      WHEN 'ownership.suggested' THEN coalesce({text('note')}, 'Suggested owner') || ': ' || coalesce({text('suggested_owner')}, '(see cited doc)')
      WHEN 'owner_confirmed' THEN 'Owner confirmed by ' || coalesce({text('confirmed_by')}, 'human') || ': ' || coalesce({text('owner')}, '')
      WHEN 'runbook.step_selected' THEN coalesce({text('step')}, {text('note')})
      WHEN 'state.transition' THEN coalesce({text('from')}, '?') || ' → ' || coalesce({text('to')}, '?')
      WHEN 'SKIPPED_NOT_CONFIGURED' THEN {text('error')} WHEN 'DEGRADED' THEN {text('error')}
      WHEN 'agent.error' THEN {text('error')} WHEN 'postmortem_error' THEN {text('error')} END AS summary
  FROM lg WHERE event_type <> 'postmortem_token')
"""
HIT = """(lower(event_type) LIKE '%check%' OR lower(coalesce(service, '')) LIKE '%check%' OR lower(coalesce(summary, '')) LIKE '%check%')"""


@query("timeline", f"WITH {OPEN_LOG}, {TIMELINE} SELECT * REPLACE ({stamp('ts')} AS ts) FROM tl", V)
def timeline_rows(spark, sf_dir):
    return timeline.timeline(_log(spark, sf_dir))


@query(
    "timeline_search",
    f"""WITH {OPEN_LOG}, {TIMELINE} SELECT * REPLACE ({stamp('ts')} AS ts) FROM tl
    WHERE severity = 'P1' AND (lower(event_type) LIKE '%severity p1%' OR lower(coalesce(summary, '')) LIKE '%severity p1%')""",
    V,
)
def timeline_search(spark, sf_dir):
    return timeline.timeline_search(timeline.timeline(_log(spark, sf_dir)), "P1", "Severity P1")


@query(
    "search_counts",
    f"""WITH {OPEN_LOG}, {TIMELINE} SELECT incident_id, count(*) FILTER (WHERE {HIT}) AS shown, count(*) AS total
    FROM tl GROUP BY incident_id""",
    V,
)
def search_counts(spark, sf_dir):
    return timeline.search_counts(timeline.timeline(_log(spark, sf_dir)), None, "CHECK")


@query(
    "latency_badges",
    f"""WITH {OPEN_LOG},
    f AS (SELECT incident_id,
      arg_max({number('latency_ms')}, seq) FILTER (WHERE event_type = 'extraction.completed' AND {number('latency_ms')} IS NOT NULL) AS a,
      arg_max({number('latency_ms')}, seq) FILTER (WHERE event_type = 'context.related_items' AND {number('latency_ms')} IS NOT NULL) AS b,
      arg_max({number('latency_ms')}, seq) FILTER (WHERE {types('runbook.retrieved', 'ownership.suggested')} AND {number('latency_ms')} IS NOT NULL) AS c,
      arg_max(coalesce({text('blocker')}, 'blocked'), seq) FILTER (WHERE event_type = 'SKIPPED_NOT_CONFIGURED' AND {text('step')} = 'airbyte_context_lookup') AS k
      FROM lg GROUP BY incident_id)
    SELECT incident_id, 'extraction' AS badge, a AS latency_ms, CAST(NULL AS VARCHAR) AS note FROM f
    UNION ALL SELECT incident_id, 'context', b, 'skipped — not configured (' || k || ')' FROM f
    UNION ALL SELECT incident_id, 'retrieval', c, NULL FROM f""",
    V,
)
def latency_badges(spark, sf_dir):
    return timeline.latency_badges(_log(spark, sf_dir))


GAPS = f"""
gp AS (SELECT incident_id, event_type, coalesce({text('service')}, {text('step')}, 'unknown') AS subject, count(*) AS n_events
  FROM lg WHERE {types('DEGRADED', 'SKIPPED_NOT_CONFIGURED', 'BLOCKED_BY_GUARDRAIL', 'agent.error', 'postmortem_error')} GROUP BY ALL)
"""


@query("gap_report", f"WITH {OPEN_LOG}, {GAPS} SELECT * FROM gp", V)
def gap_report(spark, sf_dir):
    return timeline.gap_report(_log(spark, sf_dir))


@query(
    "gap_totals",
    f"""WITH {OPEN_LOG}, {GAPS} SELECT coalesce(event_type, 'all') AS event_type, coalesce(subject, 'all') AS subject,
    CAST(sum(n_events) AS BIGINT) AS n_events FROM gp GROUP BY ROLLUP (event_type, subject)""",
    V,
)
def gap_totals(spark, sf_dir):
    return timeline.gap_totals(_log(spark, sf_dir))


@query(
    "sink_reconcile",
    f"""WITH a AS (SELECT incident_id, ts, event_type, md5(payload) AS digest, count(*) AS n FROM v_sink_a GROUP BY ALL),
    b AS (SELECT incident_id, ts, event_type, md5(payload) AS digest, count(*) AS n FROM v_sink_b GROUP BY ALL)
    SELECT incident_id, {stamp('ts')} AS ts, event_type, digest, coalesce(a.n, 0) AS in_first, coalesce(b.n, 0) AS in_second,
      CASE WHEN coalesce(a.n, 0) < coalesce(b.n, 0) THEN 'first' ELSE 'second' END AS missing_in
    FROM a FULL JOIN b USING (incident_id, ts, event_type, digest) WHERE coalesce(a.n, 0) <> coalesce(b.n, 0)""",
    ("v_sink_a", "v_sink_b"),
)
def sink_reconcile(spark, sf_dir):
    return sinks.sink_reconcile(derive(spark, sf_dir, "v_sink_a"), derive(spark, sf_dir, "v_sink_b"))


@query(
    "sink_degradation",
    f"""WITH x AS (SELECT incident_id, ts, event_type, md5(payload) AS digest,
        seq NOT IN (SELECT seq FROM v_sink_a) AS la, seq NOT IN (SELECT seq FROM v_sink_b) AS lb FROM v_log)
    SELECT incident_id, {stamp('ts')} AS ts, event_type AS during_event_type, digest, la AND lb AS fatal, 'first' AS service FROM x WHERE la
    UNION ALL SELECT incident_id, {stamp('ts')}, event_type, digest, la AND lb, 'second' FROM x WHERE lb""",
    ("v_sink_a", "v_sink_b"),
)
def sink_degradation(spark, sf_dir):
    return sinks.sink_degradation(
        _log(spark, sf_dir), derive(spark, sf_dir, "v_sink_a"), derive(spark, sf_dir, "v_sink_b")
    )
