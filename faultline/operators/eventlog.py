"""Reads of the append-only event log (ts, incident_id, seq, event_type, payload).

`seq` breaks ties between events with the same time. Payloads are JSON text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultline.functions import jsonval, vocab
from faultline.functions.text import clock, iso_stamp
from faultline.plans.firsts import position
from faultline.plans.slices import SLICE_ROWS, find_hot, numbered, text_parts

INCIDENT = ["incident_id"]
ORDER = ("ts", "seq")


def at() -> Column:
    """Position of an event in time order."""
    return F.struct(*ORDER)


def of_type(*types: str) -> Column:
    return F.col("event_type").isin(*types)


def opened(df: DataFrame, *types: str) -> DataFrame:
    """Add the payload as VARIANT `p`; with `types`, keep and parse only those events."""
    rows = df.where(of_type(*types)) if types else df
    return rows.withColumn("p", jsonval.open_payload(F.col("payload")))


def incident_log(log: DataFrame, incident_id: str | None = None) -> DataFrame:
    """Events in time order with the payload parsed; one incident, or all of them."""
    rows = log if incident_id is None else log.where(F.col("incident_id") == incident_id)
    return opened(rows).orderBy("incident_id", *ORDER).select(
        "incident_id", "seq", iso_stamp(F.col("ts")).alias("ts"), "event_type", F.col("p").alias("payload")
    )


def log_lines(log: DataFrame) -> DataFrame:
    """One JSON line per event with sorted keys at every level."""
    line = F.to_json(
        F.struct(F.col("event_type"), F.col("p").alias("payload"), iso_stamp(F.col("ts")).alias("ts"))
    )
    return opened(log).select("incident_id", "seq", "ts", line.alias("line"))


def log_block(log: DataFrame, part_rows: int = 10_000, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """The whole log of each incident between its begin and end marker, in ordered parts.

    Joining the parts of an incident with newlines gives the block.
    """
    hot = find_hot(log, INCIDENT, "ts", slice_rows)
    parts = text_parts(log_lines(log), INCIDENT, "ts", "line", "\n", ("seq",), part_rows, slice_rows, hot)
    last = log.groupBy("incident_id").agg(
        F.floor((F.count(F.lit(1)) - 1) / part_rows).cast("bigint").alias("__last")
    )
    begin = F.when(F.col("part") == 0, F.lit(vocab.LOG_BEGIN + "\n")).otherwise(F.lit(""))
    end = F.when(F.col("part") == F.col("__last"), F.lit("\n" + vocab.LOG_END)).otherwise(F.lit(""))
    return parts.join(last, "incident_id").select(
        "incident_id", "part", "n_rows", F.concat(begin, F.col("text"), end).alias("text")
    )


def refused_incidents(wanted: DataFrame, log: DataFrame) -> DataFrame:
    """Requested incidents without a single event; nothing may be written about them."""
    return wanted.select("incident_id").distinct().join(log, "incident_id", "left_anti")


def event_sequence(log: DataFrame, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """Event types of each incident numbered in time order."""
    return numbered(log, INCIDENT, "ts", "position", ("seq",), slice_rows).select(
        "incident_id", "position", "event_type"
    )


def sequence_contract(log: DataFrame, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """Per incident: opened first, extraction second, no model or report event before it.

    Receipt of the alert happens outside the incident's own sequence and is not counted.
    """
    own = log.where(~of_type(vocab.ALERT_RECEIVED))
    late = F.col("event_type").startswith("llm.") | F.col("event_type").startswith("postmortem")
    kinds = numbered(own, INCIDENT, "ts", "position", ("seq",), slice_rows).groupBy("incident_id").agg(
        F.max(F.when(F.col("position") == 1, F.col("event_type"))).alias("first_type"),
        F.max(F.when(F.col("position") == 2, F.col("event_type"))).alias("second_type"),
        F.min(F.when(of_type(vocab.EXTRACTION_COMPLETED), F.col("position"))).alias("extraction_at"),
        F.min(F.when(late, F.col("position"))).alias("report_at"),
        F.count(F.lit(1)).alias("n_events"),
    )
    in_order = (
        (F.col("first_type") == vocab.INCIDENT_OPENED)
        & (F.col("second_type") == vocab.EXTRACTION_COMPLETED)
        & (F.col("report_at").isNull() | (F.col("report_at") > F.col("extraction_at")))
    )
    return kinds.withColumn("ok", F.coalesce(in_order, F.lit(False)))


def place() -> Column:
    """Position of an event in time order as one number, which hash aggregates can hold."""
    return position(F.col("ts"), F.col("seq"))


def at_places(log: DataFrame, places: DataFrame, names: list[str], *types: str) -> DataFrame:
    """`places`, one row per incident, with `place`, `event_type` and opened payload `p` of each event
    of these types at any of its places `names`; one row without them where there is none."""
    won = places.withColumn("place", F.explode_outer(F.array_distinct(F.array_compact(F.array(*names)))))
    rows = opened(log, *types).select(F.col("incident_id").alias("__incident"), place().alias("__place"), "event_type", "p")
    same = (F.col("incident_id") == F.col("__incident")) & (F.col("place") == F.col("__place"))
    return won.join(rows, same, "left").drop("__incident", "__place")


def latest_by_type(log: DataFrame, event_type: str) -> DataFrame:
    """Time and payload of the latest event of a type per incident: one hash aggregate, one look-up."""
    rows = log.where(of_type(event_type)).select("incident_id", "ts", "payload", place().alias("place"))
    last = rows.groupBy("incident_id").agg(F.max("place").alias("place"))
    return rows.join(last, ["incident_id", "place"]).select("incident_id", "ts", "payload")


def affected_services(log: DataFrame) -> DataFrame:
    """Services named by the latest extraction of each incident, in payload order."""
    latest = latest_by_type(log, vocab.EXTRACTION_COMPLETED)
    named = F.try_variant_get(jsonval.open_payload(F.col("payload")), "$.affected_services", "array<variant>")
    return (
        latest.select("incident_id", F.posexplode(named).alias("ord", "item"))
        .withColumn("service", jsonval.raw_text(F.col("item"), "$"))
        .where(F.col("service").isNotNull())
        .select("incident_id", "ord", "service")
    )


def payload_edges(events: DataFrame) -> DataFrame:
    """Well-formed edges of `edges` payload arrays; entries with a bad field are left out."""
    array = F.try_variant_get(jsonval.open_payload(F.col("payload")), "$.edges", "array<variant>")
    rows = events.select(
        *[name for name in ("incident_id", "seq", "ts") if name in events.columns],
        F.posexplode(array).alias("ord", "e"),
    )
    return (
        rows.withColumns(
            {
                "cause_service": jsonval.text(F.col("e"), "$.cause_service"),
                "effect_service": jsonval.text(F.col("e"), "$.effect_service"),
                "lag_seconds": jsonval.number(F.col("e"), "$.lag_seconds"),
            }
        )
        .drop("e")
        .dropna(subset=["cause_service", "effect_service", "lag_seconds"])
    )


def latest_edges(log: DataFrame) -> DataFrame:
    """Edges of the latest causal result of each incident."""
    return payload_edges(latest_by_type(log, vocab.CHAINS_DETECTED)).drop("ts")


def report_tokens(
    log: DataFrame, slice_rows: int = SLICE_ROWS, hot: DataFrame | list | None = None
) -> DataFrame:
    """Streamed report tokens with their index; without one, the arrival position counts."""
    tokens = opened(log, vocab.REPORT_TOKEN)
    rows = numbered(tokens, INCIDENT, "ts", "arrival", ("seq",), slice_rows, hot)
    given = jsonval.number(F.col("p"), "$.index")
    return rows.select(
        "incident_id",
        F.coalesce(given, (F.col("arrival") - 1).cast("double")).alias("token_index"),
        "arrival",
        F.coalesce(jsonval.text(F.col("p"), "$.token"), F.lit("")).alias("token"),
    )


def report_text(log: DataFrame, part_rows: int = 10_000, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """Report text put together from its tokens by index, in ordered parts."""
    hot = find_hot(log.where(of_type(vocab.REPORT_TOKEN)), INCIDENT, "ts", slice_rows)
    tokens = report_tokens(log, slice_rows, hot)
    # the tokens of a key that is not hot by time are not hot by index either
    return text_parts(
        tokens, INCIDENT, "token_index", "token", "", ("arrival",), part_rows, slice_rows, None if hot else hot
    ).withColumnRenamed("n_rows", "n_tokens")


def clock_text(rows: DataFrame, column: str) -> DataFrame:
    return rows.withColumn("clock", clock(F.col(column)))
