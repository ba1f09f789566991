"""Sources and sinks: each query writes the whole table in the form at hand and reads it back."""

from __future__ import annotations

from pyspark.sql import functions as F

from faultline.functions.text import iso_stamp
from faultline.operators import report
from faultline.plans.slices import kept
from faultline.session import scratch_path
from faultline.sources import events, knowledge, logs, metrics, tables
from faultline.streaming import ticks
from suite.registry import query, stamp
from suite.report import ESCAPED
from suite.views import derive, read

METRIC_ROWS = f"SELECT {stamp('ts')} AS ts, service, metric, value FROM v_metrics"


@query("scan_metrics_csv", METRIC_ROWS, ("v_metrics",))
def scan_metrics_csv(spark, sf_dir):
    path = scratch_path(spark, "csv")
    rows = derive(spark, sf_dir, "v_metrics")
    recorded = rows.select(iso_stamp(F.col("ts")).alias("ts"), "service", F.col("metric").alias("metric_name"), "value")
    recorded.write.option("header", True).csv(path)
    return metrics.scan_metrics_csv(spark, path)


@query("append_metrics", f"{METRIC_ROWS} UNION ALL {METRIC_ROWS}", ("v_metrics",))
def append_metrics(spark, sf_dir):
    path = scratch_path(spark, "metrics")
    rows = derive(spark, sf_dir, "v_metrics")
    metrics.append_metrics(rows, path)
    metrics.append_metrics(rows, path)
    return spark.read.parquet(path)


@query("reload_metrics", METRIC_ROWS, ("v_metrics",))
def reload_metrics(spark, sf_dir):
    path = scratch_path(spark, "metrics")
    rows = derive(spark, sf_dir, "v_metrics")
    metrics.append_metrics(rows, path)
    metrics.reload_metrics(rows, path)
    return spark.read.parquet(path)


@query(
    "append_event",
    f"""SELECT {stamp('received_at')} AS ts, 'inc-' || CAST(event_id AS VARCHAR) AS incident_id, event_id AS seq, 'alert.received' AS event_type,
    '{{"event_id":' || CAST(event_id AS VARCHAR) || ',"idempotency_key":' || coalesce('"' || idempotency_key || '"', 'null') || '}}' AS payload FROM v_alert_base""",
    ("v_alert_base",),
)
def append_event(spark, sf_dir):
    path = scratch_path(spark, "events")
    rows = derive(spark, sf_dir, "v_alert_base").select(
        F.col("received_at").alias("ts"),
        F.concat(F.lit("inc-"), F.col("event_id").cast("string")).alias("incident_id"),
        F.col("event_id").alias("seq"),
        "event_id",
        "idempotency_key",
    )
    events.append_events(events.event_rows(rows, F.lit("alert.received"), ["event_id", "idempotency_key"]), path)
    return events.read_events(spark, path)


def audited(spark, sf_dir, limit):
    path = scratch_path(spark, "audit")
    events.append_audit(derive(spark, sf_dir, "v_log"), path)
    kind = F.get_json_object("body", "$.content.event_type")
    return events.read_audit(spark, path, limit=limit).select("incident_id", "seq", kind.alias("event_type"))


@query("audit_sink", "SELECT incident_id, seq, event_type FROM v_log", ("v_log",))
def audit_sink(spark, sf_dir):
    return audited(spark, sf_dir, None)


@query(
    "read_audit",
    """SELECT incident_id, seq, event_type FROM v_log
    QUALIFY row_number() OVER (PARTITION BY incident_id ORDER BY ts, seq) <= 10""",
    ("v_log",),
)
def read_audit(spark, sf_dir):
    """The first ten documents of every incident."""
    return audited(spark, sf_dir, 10)


def log_records(spark, sf_dir):
    return derive(spark, sf_dir, "v_alert_base").select(
        F.col("received_at").alias("timestamp"),
        F.lit("INFO").alias("level"),
        F.lit("intake").alias("logger"),
        F.col("body").alias("msg"),
        F.to_json(F.struct("event_id", F.col("idempotency_key").alias("key"))).alias("extra"),
    )


@query(
    "write_json_logs",
    f"""SELECT '{{"timestamp":"' || {stamp('received_at')} || '+00:00","level":"INFO","logger":"intake","msg":' || CAST(to_json(body) AS VARCHAR)
    || ',"event_id":' || CAST(event_id AS VARCHAR) || coalesce(',"key":"' || idempotency_key || '"', '') || '}}' AS value FROM v_alert_base""",
    ("v_alert_base",),
)
def write_json_logs(spark, sf_dir):
    path = scratch_path(spark, "logs")
    logs.write_json_logs(log_records(spark, sf_dir), path)
    return spark.read.text(path)


@query(
    "scan_json_logs",
    f"""SELECT {stamp('received_at')} AS timestamp, 'INFO' AS level, 'intake' AS logger, body AS msg, event_id, idempotency_key AS "key" FROM v_alert_base""",
    ("v_alert_base",),
)
def scan_json_logs(spark, sf_dir):
    path = scratch_path(spark, "logs")
    logs.write_json_logs(log_records(spark, sf_dir), path)
    back = logs.scan_json_logs(spark, path)
    return back.select(
        "timestamp",
        "level",
        "logger",
        "msg",
        F.try_variant_get(F.try_element_at("extra", F.lit("event_id")), "$", "bigint").alias("event_id"),
        F.try_variant_get(F.try_element_at("extra", F.lit("key")), "$", "string").alias("key"),
    )


LOG_ROWS = f"SELECT 'events' AS \"table\", {stamp('ts')} AS ts, incident_id AS k1, CAST(seq AS VARCHAR) AS k2, event_type AS what, payload AS body FROM v_log"
HISTORY_ROWS = f"""SELECT 'history' AS "table", {stamp('ts')} AS ts, 'tickets' AS k1, service AS k2, CAST(external_id AS VARCHAR) || '|' || author AS what, summary AS body FROM v_tickets"""


@query(
    "create_tables",
    f"""{LOG_ROWS} UNION ALL SELECT 'metrics', {stamp('ts')}, service, metric, CAST(CAST(round(value * 1000) AS BIGINT) AS VARCHAR), NULL FROM v_metrics
    UNION ALL {HISTORY_ROWS}""",
    ("v_log", "v_metrics", "v_tickets"),
)
def create_tables(spark, sf_dir):
    """The tables are made twice, filled, read, and dropped from the catalog; their files stay."""
    place = scratch_path(spark, "tables")
    prefix = "faultline_" + place[-8:] + "_"
    names = tables.create_tables(spark, prefix, place, 8)
    tables.create_tables(spark, prefix, place, 8)
    tickets = derive(spark, sf_dir, "v_tickets").select(
        "ts", F.lit("tickets").alias("source"), F.col("service").alias("record_type"), F.col("external_id").cast("string").alias("external_id"),
        "author", F.col("summary").alias("title"), F.col("description").alias("payload"),
    )
    for rows, table in ((derive(spark, sf_dir, "v_log"), "events"), (derive(spark, sf_dir, "v_metrics"), "metrics"), (tickets, "history")):
        tables.fill_table(rows, table, prefix, 8)
    log, samples, history = (spark.table(f"{prefix}{table}") for table in ("events", "metrics", "history"))
    milli = F.round(F.col("value") * 1000).cast("bigint").cast("string")
    parts = (
        log.select(F.lit("events").alias("table"), "ts", F.col("incident_id").alias("k1"), F.col("seq").cast("string").alias("k2"), F.col("event_type").alias("what"), F.col("payload").alias("body")),
        samples.select(F.lit("metrics"), "ts", "service", "metric", milli, F.lit(None).cast("string")),
        history.select(F.lit("history"), "ts", "source", "record_type", F.concat_ws("|", "external_id", "author"), "title"),
    )
    rows = kept(parts[0].union(parts[1]).union(parts[2]))
    for name in names:
        spark.sql(f"DROP TABLE {name}")
    return rows


@query(
    "write_report_html",
    f"""SELECT 'doc-' || CAST(doc_id AS VARCHAR) AS incident_id, length(text) AS n_chars, {ESCAPED} AS page
    FROM documents WHERE trim(text, chr(32) || chr(9) || chr(10) || chr(13)) <> ''""",
)
def write_report_html(spark, sf_dir):
    path = scratch_path(spark, "pages")
    docs = read(spark, sf_dir, "documents")
    rows = docs.select(F.concat(F.lit("doc-"), F.col("doc_id").cast("string")).alias("incident_id"), "text")
    knowledge.write_report_pages(report.report_html(rows), path)
    back = spark.read.parquet(path).withColumn(
        "page", F.regexp_extract("html", r"(?s)<pre>(.*)</pre></body></html>\n$", 1)
    )
    sizes = rows.select("incident_id", F.char_length("text").cast("bigint").alias("n_chars"))
    return back.join(sizes, "incident_id").select("incident_id", "n_chars", "page")


@query(
    "kb_manifest",
    r"""WITH b AS (SELECT content_id, title, '# ' || title || chr(10) || chr(10) || '> ' || CAST(length(text) AS VARCHAR) || ' characters' || chr(10) || chr(10) || text AS body FROM v_docs)
    SELECT content_id, coalesce(nullif(left(trim(lower(regexp_replace(title, '[^\p{L}\p{N}]+', '-', 'g')), '-'), 80), ''), 'document') || '.md' AS filename,
      octet_length(encode(body)) AS size_bytes, md5(body) AS md5, body FROM b""",
    ("v_docs",),
)
def kb_manifest(spark, sf_dir):
    docs = derive(spark, sf_dir, "v_docs")
    summary = F.concat(F.char_length("text").cast("string"), F.lit(" characters"))
    return knowledge.kb_manifest(docs.withColumn("summary", summary))


DAYS = "SELECT date_trunc('day', ts) AS ts, service, metric, value FROM v_metrics"


@query(
    "replay_stream",
    f"SELECT {stamp('ts')} AS ts, service, metric, value, dense_rank() OVER (ORDER BY ts) - 1 AS batch FROM ({DAYS})",
    ("v_metrics",),
)
def replay_stream(spark, sf_dir):
    """A recording with one tick a day, replayed one micro-batch per tick; halfway the query restarts."""
    path = scratch_path(spark, "ticks")
    daily = derive(spark, sf_dir, "v_metrics").withColumn("ts", F.date_trunc("day", "ts"))
    count = ticks.record_ticks(daily, f"{path}/recording", per_folder=10)
    schema = "ts TIMESTAMP, service STRING, metric STRING, value DOUBLE"
    for batches in (count // 2, None):
        stream = ticks.tick_stream(spark, f"{path}/recording", schema, count, per_folder=10)
        ticks.replay_to_table(stream, f"{path}/out", f"{path}/checkpoint", batches)
    return spark.read.schema(schema + ", batch BIGINT").parquet(f"{path}/out/batch-*")
