"""Event sinks: the event log and the second, audit copy of it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

EVENT_SCHEMA = "ts TIMESTAMP, incident_id STRING, seq BIGINT, event_type STRING, payload STRING"


def event_rows(rows: DataFrame, event_type: Column, payload: list[str]) -> DataFrame:
    """Rows (ts, incident_id, seq, ...) as typed events; the named columns become the JSON payload."""
    body = F.to_json(F.struct(*payload), {"ignoreNullFields": "false"})
    return rows.select("ts", "incident_id", "seq", event_type.alias("event_type"), body.alias("payload"))


def append_events(events: DataFrame, path: str) -> None:
    """Append to the log in (incident, time) order; ranges include the time, so no incident is one task."""
    ordered = events.repartitionByRange("incident_id", "ts").sortWithinPartitions("incident_id", "ts", "seq")
    ordered.write.mode("append").parquet(path)


def read_events(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(EVENT_SCHEMA).parquet(path)


def audit_rows(events: DataFrame) -> DataFrame:
    """Each event wrapped as the JSON document the audit sink keeps."""
    content = F.struct(
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX").alias("ts"),
        "incident_id",
        "event_type",
        F.coalesce(F.try_parse_json("payload"), F.parse_json(F.to_json(F.struct(F.col("payload").alias("raw"))))).alias("payload"),
    )
    body = F.to_json(F.struct(content.alias("content"), F.lit("json").alias("mode")))
    return events.select("incident_id", "ts", "seq", body.alias("body"))


def append_audit(events: DataFrame, path: str) -> None:
    append = audit_rows(events).repartitionByRange("incident_id", "ts").sortWithinPartitions("incident_id", "ts", "seq")
    append.write.mode("append").parquet(path)


def read_audit(
    spark: SparkSession, path: str, incident_id: str | None = None, limit: int | None = None
) -> DataFrame:
    """All audit documents of one incident, or of every incident.

    With a limit, the first so many of each in time order.
    """
    rows = spark.read.schema("incident_id STRING, ts TIMESTAMP, seq BIGINT, body STRING").parquet(path)
    if incident_id is not None:
        own = rows.where(F.col("incident_id") == incident_id).orderBy("ts", "seq")
        return own if limit is None else own.limit(limit)
    if limit is None:
        return rows
    # the rank limit is applied before the shuffle, so a long incident costs no more than a short one
    first = Window.partitionBy("incident_id").orderBy("ts", "seq")
    return rows.withColumn("__rank", F.row_number().over(first)).where(F.col("__rank") <= limit).drop("__rank")
