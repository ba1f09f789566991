"""Ticket and message history: fields from text, ownership, consistency, what is still to do."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from faultline.functions.text import first_line, strip
from faultline.plans.quantiles import exact_quantiles

DONE, OPEN = "Done", "To Do"


def ticket_fields(tickets: DataFrame) -> DataFrame:
    """Severity, date, services, resolver and minutes out of ticket descriptions."""

    def found(pattern: str):
        return F.nullif(F.regexp_extract("description", pattern, 1), F.lit(""))

    return tickets.select(
        "external_id",
        found(r"Severity: (P[0-3])\.").alias("severity"),
        found(r"Date: (\d{4}-\d{2}-\d{2})\.").try_cast("date").alias("date"),
        F.split(found(r"Services: ([^.\n]+)\."), r",\s*").alias("services"),
        found(r"Resolved by: ([\w.@-]+)").alias("resolver"),
        found(r"Duration: (\d+) minutes").try_cast("bigint").alias("minutes"),
    )


def ownership_baseline(history: DataFrame, last: int = 12) -> DataFrame:
    """Who resolved most of the last `last` incidents of each service (service, ts, external_id, author)."""
    recent = Window.partitionBy("service").orderBy(F.desc("ts"), F.desc("external_id"))
    latest = history.withColumn("rn", F.row_number().over(recent)).where(F.col("rn") <= last)
    by_author = latest.groupBy("service", "author").agg(F.count(F.lit(1)).alias("n"))
    top = by_author.groupBy("service").agg(
        F.min(F.struct((-F.col("n")).alias("minus"), "author")).alias("t"), F.sum("n").alias("n_incidents")
    )
    n = -F.col("t.minus")
    text = F.concat(
        n.cast("string"), F.lit(" of the last "), F.col("n_incidents").cast("string"),
        F.lit(" incidents on "), "service", F.lit(" resolved by "), F.col("t.author"),
    )
    return top.select(
        "service", F.col("t.author").alias("author"), n.alias("n_resolved"), "n_incidents", text.alias("basis")
    )


def history_consistency(
    tickets: DataFrame, resolver: str, service: str, expected_resolved: int, expected_service: int
) -> DataFrame:
    """One row: counts behind a documented claim, and whether they agree with it."""
    counts = tickets.agg(
        F.count_if(F.col("description").contains(f"Resolved by: {resolver}")).alias("n_resolved"),
        F.count_if(F.array_contains("labels", service)).alias("n_service"),
        F.count(F.lit(1)).alias("n_tickets"),
    )
    ok = (F.col("n_resolved") == expected_resolved) & (F.col("n_service") == expected_service)
    return counts.withColumn("consistent", ok)


def history_window(history: DataFrame, as_of: datetime, days: int = 90) -> DataFrame:
    """Rows of the last `days` days before `as_of`."""
    end = F.lit(as_of)
    return history.where((F.col("ts") >= end - F.make_dt_interval(F.lit(days))) & (F.col("ts") <= end))


def new_tickets(specs: DataFrame, existing: DataFrame) -> DataFrame:
    """Specs (summary, ...) with the key of an existing ticket of that summary, or `new`."""
    keys = existing.groupBy("summary").agg(F.min("external_id").alias("existing_key"))
    action = F.when(F.col("existing_key").isNull(), "new").otherwise("exists")
    return specs.join(keys, "summary", "left").withColumn("action", action)


def new_messages(planned: DataFrame, posted: DataFrame) -> DataFrame:
    """Planned messages (channel, text) whose first line is not in the channel yet.

    Posted messages with a subtype are system messages and do not count.
    """
    seen = posted.where(F.col("subtype").isNull() & (F.col("text") != "")).select(
        "channel", strip(first_line(F.col("text"))).alias("__line")
    )
    return (
        planned.withColumn("__line", strip(first_line(F.col("text"))))
        .join(seen.distinct(), ["channel", "__line"], "left_anti")
        .drop("__line")
    )


def done_targets(tickets: DataFrame) -> DataFrame:
    return tickets.where(F.col("status") == DONE)


def open_followups(tickets: DataFrame, label: str = "follow-up") -> DataFrame:
    return tickets.where(F.array_contains("labels", label) & (F.col("status") == OPEN))


def resolution_times(tickets: DataFrame, keys: Sequence[str] = ("service",)) -> DataFrame:
    """Median minutes to resolve per service, from (service, minutes)."""
    return exact_quantiles(tickets, keys, "minutes", {"median_minutes": 0.5})
