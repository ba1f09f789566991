"""Extraction and screening responses, dispatch of outbound messages."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from faultline.functions import vocab
from faultline.operators import dispatch, eventlog, lifecycle, verdicts
from suite.duck import OPEN_LOG, text
from suite.eventlog import ALL_EDGES, STATE
from suite.registry import query
from suite.views import derive, read

EX = """
x AS (SELECT response_id, wall_ms, TRY_CAST(body AS JSON) AS j FROM v_extractions),
y AS (SELECT *, json_type(j, '$.result.data.severity') AS st, json_type(j, '$.result.data.entities.affected_service') AS et,
   CASE WHEN json_type(j, '$.result.data.severity') = 'OBJECT' THEN json_extract_string(j, '$.result.data.severity.label')
        ELSE json_extract_string(j, '$.result.data.severity') END AS lab,
   CAST(coalesce(json_extract_string(j, '$.result.data.severity.confidence'), '0') AS DOUBLE) AS conf,
   coalesce(CAST(json_extract_string(j, '$.latency_ms') AS DOUBLE), wall_ms) AS lat FROM x),
s AS (SELECT y.response_id, string_agg(CASE WHEN json_type(e.value) = 'OBJECT' THEN json_extract_string(e.value, '$.text')
        ELSE json_extract_string(e.value, '$') END, ',' ORDER BY CAST(e.key AS BIGINT)) AS names,
        bool_or(json_type(e.value) = 'OBJECT' AND json_extract_string(e.value, '$.text') IS NULL) AS bad
      FROM y, json_each(y.j, '$.result.data.entities.affected_service') e GROUP BY y.response_id),
z AS (SELECT y.*, coalesce(names, '') AS names, CASE WHEN j IS NULL OR json_type(j) <> 'OBJECT' THEN 'shape' WHEN st IS NULL THEN 'severity'
        WHEN lab IS NULL OR lab NOT IN ('P0', 'P1', 'P2', 'P3') THEN 'label' WHEN et IS NULL THEN 'entities' WHEN bad THEN 'span' END AS error
      FROM y LEFT JOIN s USING (response_id))
"""
SC = """
x AS (SELECT response_id, wall_ms, TRY_CAST(body AS JSON) AS j FROM v_screens),
y AS (SELECT *, json_type(j, '$.result.data.prompt_safety') AS st,
   CASE WHEN json_type(j, '$.result.data.prompt_safety') = 'OBJECT' THEN json_extract_string(j, '$.result.data.prompt_safety.label')
        ELSE json_extract_string(j, '$.result.data.prompt_safety') END AS lab,
   CAST(coalesce(json_extract_string(j, '$.result.data.prompt_safety.confidence'), '0') AS DOUBLE) AS conf,
   coalesce(CAST(json_extract_string(j, '$.latency_ms') AS DOUBLE), wall_ms) AS lat FROM x),
z AS (SELECT *, CASE WHEN j IS NULL OR json_type(j) <> 'OBJECT' THEN 'shape' WHEN st IS NULL THEN 'task'
        WHEN lab IS NULL OR lab NOT IN ('safe', 'unsafe') THEN 'label' END AS error FROM y)
"""
# verdicts of the chat drafts' documents; tickets and faxes go by the same document
GATE = f"""{SC},
gate AS (SELECT d.*, CASE WHEN z.response_id IS NULL OR z.error IS NOT NULL THEN 'bypass' WHEN z.lab = 'safe' THEN 'send' ELSE 'blocked' END AS gate
  FROM v_drafts d LEFT JOIN z USING (response_id))
"""


@query(
    "parse_extraction",
    f"""WITH {EX} SELECT response_id, CASE WHEN error IS NULL THEN lab END AS severity,
    CASE WHEN error IS NULL THEN names END AS affected_services, CASE WHEN error IS NULL THEN conf END AS confidence,
    CASE WHEN error IS NULL THEN lat END AS latency_ms, error FROM z""",
    ("v_extractions",),
)
def parse_extraction(spark, sf_dir):
    parsed = verdicts.parse_extraction(derive(spark, sf_dir, "v_extractions"))
    return parsed.withColumn("affected_services", F.array_join("affected_services", ","))


@query(
    "parse_screen",
    f"""WITH {SC} SELECT response_id, CASE WHEN error IS NULL THEN CASE WHEN lab = 'safe' THEN 'true' ELSE 'false' END END AS allowed,
    CASE WHEN error IS NULL THEN CASE WHEN lab = 'safe' THEN '' ELSE 'prompt_safety' END END AS categories,
    CASE WHEN error IS NULL THEN conf END AS confidence, CASE WHEN error IS NULL THEN lat END AS latency_ms, error FROM z""",
    ("v_screens",),
)
def parse_screen(spark, sf_dir):
    parsed = verdicts.parse_screen(derive(spark, sf_dir, "v_screens"))
    return parsed.withColumns(
        {"categories": F.array_join("categories", ","), "allowed": F.col("allowed").cast("string")}
    )


@query(
    "latency_pref",
    """SELECT response_id, coalesce(CAST(json_extract_string(TRY_CAST(body AS JSON), '$.latency_ms') AS DOUBLE), wall_ms) AS latency_ms
    FROM v_screens""",
    ("v_screens",),
)
def latency_pref(spark, sf_dir):
    rows = derive(spark, sf_dir, "v_screens").withColumn("p", F.try_parse_json("body"))
    return rows.select("response_id", verdicts.latency_pref(F.col("p"), F.col("wall_ms")).alias("latency_ms"))


def gated(spark, sf_dir):
    drafts = derive(spark, sf_dir, "v_drafts")
    verdict = verdicts.parse_screen(derive(spark, sf_dir, "v_screens")).select("response_id", "allowed")
    by_draft = drafts.select("draft_id", "response_id").join(verdict, "response_id").select("draft_id", "allowed")
    return dispatch.screen_gate(drafts, by_draft)


@query("screen_gate", f"WITH {GATE} SELECT draft_id, action, gate FROM gate", ("v_drafts", "v_screens"))
def screen_gate(spark, sf_dir):
    return gated(spark, sf_dir).select("draft_id", "action", "gate")


@query(
    "dispatch_once",
    f"""WITH {OPEN_LOG}, {GATE},
    prior AS (SELECT DISTINCT {text('idempotency_scope')} AS scope, {text('action')} AS action FROM lg WHERE event_type = 'action.executed'),
    n AS (SELECT draft_id, scope, action, row_number() OVER (PARTITION BY scope, action ORDER BY draft_id) AS rn FROM gate WHERE gate = 'send')
    SELECT draft_id, scope, action,
      CASE WHEN rn > 1 OR EXISTS (SELECT 1 FROM prior p WHERE p.scope = n.scope AND p.action = n.action) THEN 'duplicate' ELSE 'sent' END AS status
    FROM n""",
    ("v_drafts", "v_screens", "v_log"),
)
def dispatch_once(spark, sf_dir):
    ready = gated(spark, sf_dir).where(F.col("gate") == "send").select("draft_id", "scope", "action")
    return dispatch.dispatch_once(ready, derive(spark, sf_dir, "v_log"))


@query(
    "action_args",
    """SELECT draft_id, CASE action
      WHEN 'SLACK_SEND_MESSAGE' THEN '{"channel":"#incidents","markdown_text":' || CAST(to_json(text) AS VARCHAR) || '}'
      WHEN 'JIRA_CREATE_ISSUE' THEN '{"project_key":"INC","issue_type":"Task","summary":'
        || CAST(to_json(left(string_split_regex(text, '\\r\\n|\\n|\\r')[1], 255)) AS VARCHAR) || ',"description":' || CAST(to_json(text) AS VARCHAR) || '}'
      END AS arguments,
      CASE WHEN action NOT IN ('SLACK_SEND_MESSAGE', 'JIRA_CREATE_ISSUE') THEN 'unknown action ' || action END AS error
    FROM v_drafts""",
    ("v_drafts",),
)
def action_args(spark, sf_dir):
    return dispatch.action_args(derive(spark, sf_dir, "v_drafts")).select("draft_id", "arguments", "error")


TEXTS = f"""{OPEN_LOG}, {STATE}, {ALL_EDGES},
cs AS (SELECT incident_id, string_agg(cause_service || ' → ' || effect_service || ' (' || CAST(CAST(lag_seconds AS BIGINT) AS VARCHAR) || 's)', ', ' ORDER BY ord) AS causal_summary
       FROM edges GROUP BY incident_id),
ow AS (SELECT incident_id, {text('suggested_owner')} AS suggested_owner FROM lg WHERE event_type = 'ownership.suggested'),
tx AS (SELECT incident_id,
  '[incident] ' || incident_id || ' is now ' || state || chr(10) || 'What led to what: ' || causal_summary || chr(10)
    || 'Suggested owner — awaiting confirmation: ' || suggested_owner AS update_text,
  'Open work from ' || incident_id || ', which is ' || state || '.' || chr(10) || chr(10)
    || 'Suggested owner — awaiting confirmation: ' || suggested_owner || chr(10) || 'A human must confirm who takes this; nobody is assigned before.' AS followup_text
  FROM st JOIN cs USING (incident_id) JOIN ow USING (incident_id) WHERE state IS NOT NULL AND suggested_owner IS NOT NULL)
"""


def texts(spark, sf_dir):
    log = derive(spark, sf_dir, "v_log")
    owners = lifecycle.owner_status(log).select("incident_id", "suggested_owner")
    incidents = (
        lifecycle.incident_state(log)
        .join(dispatch.causal_summary(eventlog.latest_edges(log)), "incident_id")
        .join(owners, "incident_id")
        .dropna(subset=["state", "suggested_owner"])
    )
    return dispatch.action_text(incidents)


@query("action_text", f"WITH {TEXTS} SELECT * FROM tx", ("v_log",))
def action_text(spark, sf_dir):
    return texts(spark, sf_dir)


@query(
    "wording_check",
    f"""WITH {TEXTS},
    t AS (SELECT incident_id AS text_id, 'SLACK_SEND_MESSAGE' AS action, update_text AS text FROM tx
          UNION ALL SELECT incident_id, 'JIRA_CREATE_ISSUE', followup_text FROM tx
          UNION ALL SELECT CAST(draft_id AS VARCHAR), action, text FROM v_drafts)
    SELECT * FROM (SELECT text_id, action, CASE WHEN NOT contains(text, 'Suggested owner — awaiting confirmation') THEN 'no suggestion'
      WHEN action = 'SLACK_SEND_MESSAGE' AND contains(lower(text), 'assign') THEN 'speaks of assigning'
      WHEN action <> 'SLACK_SEND_MESSAGE' AND NOT contains(text, 'A human must confirm') THEN 'no human confirmation' END AS problem FROM t)
    WHERE problem IS NOT NULL""",
    ("v_log", "v_drafts"),
)
def wording_check(spark, sf_dir):
    written = texts(spark, sf_dir)
    rows = (
        written.select(F.col("incident_id").alias("text_id"), F.lit(vocab.CHAT_ACTION).alias("action"), F.col("update_text").alias("text"))
        .unionAll(written.select("incident_id", F.lit(vocab.TICKET_ACTION), "followup_text"))
        .unionAll(derive(spark, sf_dir, "v_drafts").select(F.col("draft_id").cast("string"), "action", "text"))
    )
    return dispatch.wording_check(rows)


def full_stops(frame: pd.DataFrame) -> pd.DataFrame:
    """Stands in for a caller's model: share of full stops in the text."""
    size = frame["text"].str.len()
    return pd.DataFrame({"doc_id": frame["doc_id"], "score": frame["text"].str.count(r"\.") / size.where(size > 0)})


@query(
    "score_text",
    "SELECT doc_id, round((length(text) - length(replace(text, '.', ''))) / nullif(length(text), 0), 9) AS score FROM documents",
)
def score_text(spark, sf_dir):
    rows = read(spark, sf_dir, "documents").select("doc_id", "text")
    return verdicts.score_text(rows, full_stops, "doc_id bigint, score double")
