"""Alert intake and rate limiting."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from faultline.operators import alerts
from suite.registry import CHECKS, query, stamp
from suite.views import derive

V = ("v_alerts",)
LIMIT, WINDOW = 3, 129_600.0

PARSED = """
jp AS (SELECT *, TRY_CAST(body AS JSON) AS j FROM v_alerts),
f AS (SELECT delivery_id, received_at, idempotency_key, body, j,
    nullif(CASE WHEN json_type(j, '$.service') = 'VARCHAR' THEN json_extract_string(j, '$.service') END, '') AS service,
    nullif(CASE WHEN json_type(j, '$.metric') = 'VARCHAR' THEN json_extract_string(j, '$.metric') END, '') AS metric,
    TRY_CAST(json_extract_string(j, '$.value') AS DOUBLE) + 0.0 AS value,
    CASE WHEN regexp_full_match(json_extract_string(j, '$.timestamp'), '[0-9]{4}-[0-9]{2}-[0-9]{2}([T ].*)?')
           THEN TRY_CAST(json_extract_string(j, '$.timestamp') AS TIMESTAMP)
         WHEN abs(TRY_CAST(json_extract_string(j, '$.timestamp') AS DOUBLE)) <= 2e10
           THEN make_timestamp(CAST(TRY_CAST(json_extract_string(j, '$.timestamp') AS DOUBLE) * 1e6 AS BIGINT)) END AS timestamp,
    CASE WHEN json_type(j, '$.incident_id') = 'VARCHAR' THEN json_extract_string(j, '$.incident_id') END AS incident_id,
    coalesce(json_type(j, '$.incident_id'), 'NULL') IN ('VARCHAR', 'NULL') AS id_ok FROM jp),
parsed AS (SELECT *, CASE WHEN j IS NULL THEN 'body' WHEN service IS NULL THEN 'service' WHEN metric IS NULL THEN 'metric'
    WHEN value IS NULL THEN 'value' WHEN timestamp IS NULL THEN 'timestamp' WHEN NOT id_ok THEN 'incident_id' END AS reason FROM f)
"""
# the digest itself is opaque: what counts is which deliveries share it
KEYED = f"""{PARSED},
keyed AS (SELECT delivery_id, received_at, service, metric, value, timestamp, incident_id, nullif(idempotency_key, '') AS given,
    coalesce('given ' || nullif(idempotency_key, ''),
             CAST(json_array(service, metric, CAST(value AS VARCHAR), CAST(timestamp AS VARCHAR), incident_id) AS VARCHAR)) AS alert_key
    FROM parsed WHERE reason IS NULL),
dd AS (SELECT *, row_number() OVER (PARTITION BY alert_key ORDER BY received_at, delivery_id) > 1 AS duplicate,
       min(delivery_id) OVER (PARTITION BY alert_key) AS same_as FROM keyed),
named AS (SELECT * REPLACE (coalesce(nullif(incident_id, ''), 'like ' || same_as) AS incident_id) FROM dd)
"""


def same_as(key):
    """Which rows share a key, without showing it."""
    return F.min("delivery_id").over(Window.partitionBy(key))


def shown_ids():
    """Incident ids; made ones as the least delivery of their key."""
    made = F.col("incident_id") == F.concat(F.lit("inc-"), F.left("alert_key", F.lit(12)))
    return F.when(made, F.concat(F.lit("like "), F.col("same_as").cast("string"))).otherwise(F.col("incident_id"))


def _alerts(spark, sf_dir):
    return alerts.scan_alerts(derive(spark, sf_dir, "v_alerts"))


@query(
    "scan_alerts",
    f"""WITH {PARSED} SELECT delivery_id, {stamp('received_at')} AS received_at, idempotency_key, service, metric, value,
    {stamp('timestamp')} AS timestamp, incident_id FROM parsed WHERE reason IS NULL""",
    V,
)
def scan_alerts(spark, sf_dir):
    return _alerts(spark, sf_dir)


@query("alert_rejects", f"WITH {PARSED} SELECT delivery_id, reason, body FROM parsed WHERE reason IS NOT NULL", V)
def alert_rejects(spark, sf_dir):
    return alerts.alert_rejects(derive(spark, sf_dir, "v_alerts"))


@query("alert_keys", f"WITH {KEYED} SELECT delivery_id, given, same_as FROM dd", V)
def alert_keys(spark, sf_dir):
    keyed = alerts.alert_keys(_alerts(spark, sf_dir))
    given = F.nullif("idempotency_key", F.lit("")).alias("given")
    return keyed.select("delivery_id", given, same_as("alert_key").alias("same_as"))


@query("alert_dedupe", f"WITH {KEYED} SELECT delivery_id, duplicate FROM dd", V)
def alert_dedupe(spark, sf_dir):
    return alerts.alert_dedupe(_alerts(spark, sf_dir)).select("delivery_id", "duplicate")


@query("alert_incident_ids", f"WITH {KEYED} SELECT delivery_id, incident_id FROM named", V)
def alert_incident_ids(spark, sf_dir):
    named = alerts.alert_incident_ids(_alerts(spark, sf_dir))
    named = named.withColumn("same_as", same_as("alert_key"))
    return named.select("delivery_id", shown_ids().alias("incident_id"))


@query(
    "incident_starts",
    f"""WITH {KEYED} SELECT delivery_id, incident_id,
    row_number() OVER (PARTITION BY incident_id ORDER BY received_at, delivery_id) = 1 AS starts FROM named WHERE NOT duplicate""",
    V,
)
def incident_starts(spark, sf_dir):
    started = alerts.incident_starts(_alerts(spark, sf_dir))
    keys = alerts.alert_keys(_alerts(spark, sf_dir))
    keys = keys.select("alert_key", "delivery_id").groupBy("alert_key").agg(F.min("delivery_id").alias("same_as"))
    named = started.join(keys, "alert_key")
    return named.select("delivery_id", shown_ids().alias("incident_id"), "starts")


@query(
    "alert_sentence",
    r"""WITH jp AS (SELECT delivery_id, TRY_CAST(body AS JSON) AS j FROM v_alerts),
    f AS (SELECT *, nullif(json_extract_string(j, '$.service'), '') AS s, nullif(json_extract_string(j, '$.metric'), '') AS m,
                 regexp_replace(json_extract_string(j, '$.value'), '^([0-9])e[+]?', '\1.0E') AS v,
                 regexp_replace(json_extract_string(j, '$.timestamp'), '^([0-9])e[+]?', '\1.0E') AS t, json_extract_string(j, '$.incident_id') AS i FROM jp),
    l AS (SELECT f.delivery_id, string_agg(e.key || ' ' || json_extract_string(e.value, '$'), ', ' ORDER BY e.key) AS listed
          FROM f, json_each(f.j) e GROUP BY f.delivery_id)
    SELECT delivery_id, coalesce('Alert ' || coalesce(i, '') || ': service ' || s || ' metric ' || m || ' breached with value ' || v
       || coalesce(' at ' || t, '') || '.', 'Incident alert with ' || listed || '.') AS sentence
    FROM f LEFT JOIN l USING (delivery_id)""",
    V,
)
def alert_sentence(spark, sf_dir):
    return alerts.alert_sentence(derive(spark, sf_dir, "v_alerts")).select("delivery_id", "sentence")


@query(
    "token_bucket",
    f"""WITH RECURSIVE r AS (SELECT client, request_id, epoch_us(ts) / 1e6 AS t,
        row_number() OVER (PARTITION BY client ORDER BY ts, request_id) AS rn FROM v_requests),
    fold AS (
      SELECT client, request_id, rn, t, {LIMIT}.0::DOUBLE AS had FROM r WHERE rn = 1
      UNION ALL
      SELECT r.client, r.request_id, r.rn, r.t,
             least({LIMIT}.0::DOUBLE, CASE WHEN f.had >= 1.0 THEN f.had - 1.0 ELSE f.had END
                   + (r.t - f.t) * ({LIMIT} / {WINDOW}::DOUBLE))
      FROM fold f JOIN r ON r.client = f.client AND r.rn = f.rn + 1)
    SELECT client, request_id, had >= 1.0 AS allowed,
      round(CASE WHEN had < 1.0 THEN (1.0 - had) / ({LIMIT} / {WINDOW}::DOUBLE) END, 6) AS retry_after,
      CAST(CASE WHEN had < 1.0 THEN greatest(1, ceil((1.0 - had) / ({LIMIT} / {WINDOW}::DOUBLE))) ELSE 0 END AS BIGINT) AS retry_after_seconds
    FROM fold""",
    ("v_requests",),
)
def token_bucket(spark, sf_dir):
    decided = alerts.token_bucket(derive(spark, sf_dir, "v_requests"), LIMIT, WINDOW)
    return decided.withColumn("retry_after", F.round("retry_after", 6)).fillna({"retry_after_seconds": 0})


# one client sends a third of everything and hardly pauses; about as much as its bucket gains
BUSY_SLICE = 500
BUSY_WINDOW = 10_800.0
CHECKS["token_bucket_busy"] = (
    CHECKS["token_bucket"]
    .replace(f"{LIMIT} / {WINDOW}", f"{LIMIT} / {BUSY_WINDOW}")
    .replace("SELECT client, request_id, epoch_us(ts)", "SELECT CASE WHEN request_id % 3 = 0 THEN 'busy' ELSE client END AS client, request_id, epoch_us(ts)")
    .replace("PARTITION BY client ORDER", "PARTITION BY CASE WHEN request_id % 3 = 0 THEN 'busy' ELSE client END ORDER")
)


@query("token_bucket_busy")
def token_bucket_busy(spark, sf_dir):
    requests = derive(spark, sf_dir, "v_requests")
    busy = F.when(F.col("request_id") % 3 == 0, "busy").otherwise(F.col("client"))
    decided = alerts.token_bucket(requests.withColumn("client", busy), LIMIT, BUSY_WINDOW, BUSY_SLICE)
    return decided.withColumn("retry_after", F.round("retry_after", 6)).fillna({"retry_after_seconds": 0})
