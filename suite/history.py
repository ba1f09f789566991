"""Tickets, ownership and messages."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from faultline.operators import history
from suite.registry import query, stamp
from suite.views import derive

V = ("v_tickets",)
FIELDS = r"""
tf AS (SELECT external_id, service, nullif(regexp_extract(description, 'Severity: (P[0-3])\.', 1), '') AS severity,
    nullif(regexp_extract(description, 'Date: (\d{4}-\d{2}-\d{2})\.', 1), '') AS date,
    regexp_replace(nullif(regexp_extract(description, 'Services: ([^.\n]+)\.', 1), ''), ',\s*', '|', 'g') AS services,
    nullif(regexp_extract(description, 'Resolved by: ([\w.@-]+)', 1), '') AS resolver,
    TRY_CAST(nullif(regexp_extract(description, 'Duration: (\d+) minutes', 1), '') AS BIGINT) AS minutes FROM v_tickets)
"""


def tickets(spark, sf_dir):
    return derive(spark, sf_dir, "v_tickets").withColumn("labels", F.split("label_text", ","))


@query("ticket_fields", f"WITH {FIELDS} SELECT external_id, severity, date, services, resolver, CAST(minutes AS DOUBLE) AS minutes FROM tf", V)
def ticket_fields(spark, sf_dir):
    found = history.ticket_fields(tickets(spark, sf_dir))
    return found.withColumns(
        {
            "services": F.array_join("services", "|"),
            "date": F.col("date").cast("string"),
            "minutes": F.col("minutes").cast("double"),
        }
    )


@query(
    "ownership_baseline",
    """WITH r AS (SELECT service, author FROM v_tickets QUALIFY row_number() OVER (PARTITION BY service ORDER BY ts DESC, external_id DESC) <= 12),
    c AS (SELECT service, author, count(*) AS n FROM r GROUP BY ALL),
    t AS (SELECT service, author, n AS n_resolved, CAST(sum(n) OVER (PARTITION BY service) AS BIGINT) AS n_incidents,
          row_number() OVER (PARTITION BY service ORDER BY n DESC, author) AS rn FROM c)
    SELECT service, author, n_resolved, n_incidents,
      CAST(n_resolved AS VARCHAR) || ' of the last ' || CAST(n_incidents AS VARCHAR) || ' incidents on ' || service || ' resolved by ' || author AS basis
    FROM t WHERE rn = 1""",
    V,
)
def ownership_baseline(spark, sf_dir):
    return history.ownership_baseline(tickets(spark, sf_dir))


@query(
    "history_consistency",
    """SELECT count(*) FILTER (WHERE contains(description, 'Resolved by: eng-3')) AS n_resolved,
    count(*) FILTER (WHERE list_contains(string_split(label_text, ','), '5-LOW')) AS n_service, count(*) AS n_tickets,
    count(*) FILTER (WHERE contains(description, 'Resolved by: eng-3')) = 9 AND count(*) FILTER (WHERE list_contains(string_split(label_text, ','), '5-LOW')) = 12 AS consistent
    FROM v_tickets""",
    V,
)
def history_consistency(spark, sf_dir):
    return history.history_consistency(tickets(spark, sf_dir), "eng-3", "5-LOW", 9, 12)


@query(
    "history_window",
    f"""SELECT external_id, {stamp('ts')} AS ts, service, author FROM v_tickets
    WHERE ts >= TIMESTAMP '2000-06-30' - INTERVAL 90 DAY AND ts <= TIMESTAMP '2000-06-30'""",
    V,
)
def history_window(spark, sf_dir):
    rows = tickets(spark, sf_dir).select("external_id", "ts", "service", "author")
    return history.history_window(rows, datetime(2000, 6, 30))


@query(
    "new_tickets",
    """WITH e AS (SELECT summary, min(external_id) AS existing_key FROM v_tickets WHERE status = 'Done' GROUP BY summary)
    SELECT t.external_id, t.summary, CAST(existing_key AS VARCHAR) AS existing_key, CASE WHEN existing_key IS NULL THEN 'new' ELSE 'exists' END AS action
    FROM v_tickets t LEFT JOIN e USING (summary) WHERE t.status = 'To Do'""",
    V,
)
def new_tickets(spark, sf_dir):
    rows = tickets(spark, sf_dir)
    specs = rows.where(F.col("status") == history.OPEN).select("external_id", "summary")
    found = history.new_tickets(specs, history.done_targets(rows))
    return found.withColumn("existing_key", F.col("existing_key").cast("string"))


@query(
    "new_messages",
    """WITH l AS (SELECT *, trim(string_split_regex(text, '\\r\\n|\\n|\\r')[1]) AS line FROM v_messages),
    seen AS (SELECT channel, line FROM l WHERE role = 'assistant' AND subtype IS NULL AND text <> '')
    SELECT conv_id, turn, channel, text FROM l WHERE (channel, line) NOT IN (SELECT channel, line FROM seen)""",
    ("v_messages",),
)
def new_messages(spark, sf_dir):
    rows = derive(spark, sf_dir, "v_messages")
    posted = rows.where(F.col("role") == "assistant")
    return history.new_messages(rows.select("conv_id", "turn", "channel", "text"), posted)


@query("done_targets", "SELECT external_id, summary FROM v_tickets WHERE status = 'Done'", V)
def done_targets(spark, sf_dir):
    return history.done_targets(tickets(spark, sf_dir)).select("external_id", "summary")


@query(
    "open_followups",
    "SELECT external_id, summary FROM v_tickets WHERE status = 'To Do' AND label_text LIKE 'follow-up,%'",
    V,
)
def open_followups(spark, sf_dir):
    return history.open_followups(tickets(spark, sf_dir)).select("external_id", "summary")


@query(
    "resolution_times",
    f"WITH {FIELDS} SELECT service, quantile_cont(minutes, 0.5) AS median_minutes FROM tf WHERE minutes IS NOT NULL GROUP BY service",
    V,
)
def resolution_times(spark, sf_dir):
    rows = tickets(spark, sf_dir)
    minutes = history.ticket_fields(rows).select("external_id", "minutes")
    return history.resolution_times(rows.select("external_id", "service").join(minutes, "external_id"))
