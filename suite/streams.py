"""Streaming queries: each runs over all rows that are there and reads back what it wrote.

Keyed state is fed by several files whose rows overlap in time.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from faultline.operators import alerts
from faultline.session import scratch_path
from faultline.streaming import live, stateful
from suite.alerts import KEYED, LIMIT, WINDOW
from suite.duck import OPEN_LOG
from suite.registry import CHECKS, query, stamp
from suite.report import COOLDOWN, FAILS
from suite.timeseries import FIRST, HITS
from suite.views import SCHEMAS, derive, read, stream


def settle_stream(spark, df, name):
    """Run a stream to the end of its input and return the table it wrote."""
    root = scratch_path(spark, name)
    live.run_to_table(df, f"{root}/rows", f"{root}/checkpoint")
    return spark.read.schema(df.schema).parquet(f"{root}/rows")


FILES = 5
# rows of a file may be this much older or younger than its own stretch of time
JITTER, DELAY, STRETCH = 86_400, "2 days", 432_000.0


def dealt(spark, sf_dir, name):
    """The events as a stream of files that overlap in time, rows in no order, one file a micro-batch.

    The last file has one event far ahead, whose key is its own: it moves the watermark past all others.
    """
    events = read(spark, sf_dir, name)
    if name != "events":
        return events
    path = scratch_path(spark, "dealt")
    at = F.unix_timestamp(F.col("ts").cast("timestamp"))
    low, high, most = events.agg(F.min(at), F.max(at), F.max("event_id")).first()
    width = (high - low + JITTER) / FILES + 1
    placed = events.withColumn("file", F.floor((at - low + F.col("event_id") * 7919 % JITTER) / width))
    # all cores deal and mix the rows once; then a file is one task's copy of its own rows
    mixed = placed.repartition(F.xxhash64("event_id")).sortWithinPartitions("file", F.xxhash64("event_id"))
    mixed.write.partitionBy("file").parquet(f"{path}-mixed")
    schema = f"{SCHEMAS['events']}, file BIGINT"
    for file in range(FILES):
        own = spark.read.schema(schema).parquet(f"{path}-mixed").where(F.col("file") == file).drop("file")
        own.coalesce(1).write.mode("append").parquet(path)
    far = [(F.col("ts") + F.expr("INTERVAL 400 DAYS")).alias("ts"), F.lit((most // 16 + 2) * 16).alias("event_id"), F.lit(-1).cast("bigint").alias("user_id"), F.lit("~end").alias("event_type")]
    events.limit(1).select(*far, "value", "props").select(*events.columns).coalesce(1).write.mode("append").parquet(path)
    # a file may be one split: its rows are handed round before anything is made of them
    rows = live.replay_stream(spark, path, SCHEMAS["events"])
    return rows.repartition(spark.sparkContext.defaultParallelism, F.xxhash64("event_id"))


@query("stream_onsets", f"WITH {HITS}, {FIRST} SELECT service, {stamp('onset_ts')} AS onset_ts FROM firsts", ("v_metrics",))
def stream_onsets(spark, sf_dir):
    metrics = derive(spark, sf_dir, "v_metrics", dealt)
    found = settle_stream(spark, stateful.stream_onsets(metrics, DELAY, stretch=STRETCH), "onsets").where(F.col("onset").isNotNull())
    first = found.groupBy("service").agg(F.min("onset").alias("onset"))
    return first.select("service", F.timestamp_micros(F.round(F.col("onset") * 1e6).cast("bigint")).alias("onset_ts"))


@query(
    "stream_states",
    f"""WITH RECURSIVE {OPEN_LOG},
    r AS (SELECT incident_id, seq, event_type, CASE WHEN json_type(j, '$.to') = 'VARCHAR' THEN json_extract_string(j, '$.to') END AS to_state,
            row_number() OVER (PARTITION BY incident_id ORDER BY ts, seq) AS rn
          FROM lg WHERE event_type IN ('alert.received', 'incident.opened', 'state.transition')),
    f AS (
      SELECT incident_id, seq, event_type, to_state, rn,
        CASE WHEN event_type <> 'state.transition' THEN 'INVESTIGATING' END AS state, event_type <> 'state.transition' AS accepted FROM r WHERE rn = 1
      UNION ALL
      SELECT r.incident_id, r.seq, r.event_type, r.to_state, r.rn,
        CASE WHEN r.event_type <> 'state.transition' THEN coalesce(f.state, 'INVESTIGATING')
             WHEN coalesce(f.state || '>' || r.to_state, '') IN ('INVESTIGATING>MITIGATING', 'MITIGATING>RESOLVED') THEN r.to_state ELSE f.state END,
        r.event_type <> 'state.transition' OR coalesce(f.state || '>' || r.to_state, '') IN ('INVESTIGATING>MITIGATING', 'MITIGATING>RESOLVED')
      FROM f JOIN r ON r.incident_id = f.incident_id AND r.rn = f.rn + 1)
    SELECT incident_id, seq, event_type, to_state, state, accepted, false AS late FROM f""",
    ("v_log",),
)
def stream_states(spark, sf_dir):
    return settle_stream(spark, live.stream_states(derive(spark, sf_dir, "v_log", dealt), DELAY, STRETCH), "states")


@query(
    "stream_alert_dedupe",
    f"""WITH {KEYED} SELECT DISTINCT given, CASE WHEN given IS NULL THEN service END AS service, CASE WHEN given IS NULL THEN metric END AS metric,
    CASE WHEN given IS NULL THEN value END AS value, CASE WHEN given IS NULL THEN {stamp('timestamp')} END AS timestamp,
    CASE WHEN given IS NULL THEN incident_id END AS incident_id FROM keyed""",
    ("v_alerts",),
)
def stream_alert_dedupe(spark, sf_dir):
    accepted = alerts.scan_alerts(derive(spark, sf_dir, "v_alerts", stream))
    given = F.nullif("idempotency_key", F.lit(""))
    own = [F.when(given.isNull(), F.col(name)).alias(name) for name in ("service", "metric", "value", "timestamp", "incident_id")]
    fresh = live.stream_alert_dedupe(accepted, "60 days").select(given.alias("given"), *own)
    return settle_stream(spark, fresh, "alerts")


@query(
    "live_event_feed",
    f"SELECT {stamp('ts')} AS ts, incident_id, seq, event_type, payload FROM v_log",
    ("v_log",),
)
def live_event_feed(spark, sf_dir):
    """The log goes to a folder, and a feed follows that folder."""
    root = scratch_path(spark, "feed")
    derive(spark, sf_dir, "v_log").write.parquet(f"{root}/log")
    schema = "ts TIMESTAMP, incident_id STRING, seq BIGINT, event_type STRING, payload STRING"
    return settle_stream(spark, live.live_event_feed(spark, f"{root}/log", schema), "feed")


@query("stream_token_bucket")
def stream_token_bucket(spark, sf_dir):
    limited = live.stream_token_bucket(derive(spark, sf_dir, "v_requests", dealt), LIMIT, WINDOW, DELAY, STRETCH)
    rows = settle_stream(spark, limited, "limits")
    return rows.withColumn("retry_after", F.round("retry_after", 6)).select("client", "request_id", "allowed", "retry_after")


@query("stream_breaker_states")
def stream_breaker_states(spark, sf_dir):
    followed = live.stream_breaker_states(derive(spark, sf_dir, "v_calls", dealt), FAILS, COOLDOWN, DELAY, STRETCH)
    return settle_stream(spark, followed, "breakers").drop("late")


# the batch twins have the same rows
CHECKS["stream_token_bucket"] = f"SELECT * EXCLUDE (retry_after_seconds) FROM ({CHECKS['token_bucket']})"
CHECKS["stream_breaker_states"] = CHECKS["breaker_states"]
