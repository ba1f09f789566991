"""Report assembly for all incidents at once: prompts, sections, release timing and decision.

Long texts come as ordered parts (incident_id, ord, part, text), never as one unbounded row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultline.functions import vocab
from faultline.functions.text import html_escape, strip
from faultline.operators.eventlog import INCIDENT, log_block
from faultline.operators.timeline import gap_report, timeline
from faultline.plans.slices import SLICE_ROWS, numbered, running, text_parts

RULES = (
    "Write the report of this incident from the event log below and from nothing else. "
    "State only times, names, numbers and actions that the log holds. Name a precedent only with "
    "its citation, as past context. Where a step was skipped or degraded, say so. Be brief."
)
NO_EDGE = "- none: no onset led to another within the bound"
NO_PRECEDENT = "None on record; mention that only where a reader would expect one."


def edge_lines(edges: DataFrame) -> DataFrame:
    """Edges (incident_id, ord, cause_service, effect_service, lag_seconds) as list lines."""
    line = F.concat(
        F.lit("- "), "cause_service", F.lit(" precedes "), "effect_service", F.lit(" by "),
        F.col("lag_seconds").cast("bigint").cast("string"), F.lit(" seconds, measured between onsets"),
    )
    return edges.select("incident_id", "ord", line.alias("line"))


def report_prompts(
    log: DataFrame,
    edges: DataFrame,
    precedents: DataFrame,
    part_rows: int = 10_000,
    slice_rows: int = SLICE_ROWS,
) -> DataFrame:
    """Rules, sections, edges, cited precedents and log block of every incident in the log.

    `precedents` has (incident_id, rank, citation, content).
    """
    incidents = log.select("incident_id").distinct()
    heads = "\n".join(f"## {name}" for name in vocab.SECTIONS)
    zero = F.lit(0).cast("bigint")
    intro = incidents.select(
        "incident_id",
        F.lit(0).alias("ord"),
        zero.alias("part"),
        F.concat(F.lit("Incident "), "incident_id", F.lit(f"\n{RULES}\n{heads}")).alias("text"),
    )
    cited = precedents.select(
        "incident_id",
        "rank",
        F.concat(F.lit("[citation: "), "citation", F.lit("]\n"), "content").alias("line"),
    )
    # one payload's edges and at most k precedents per incident: never hot
    blocks = (
        (1, text_parts(edge_lines(edges), INCIDENT, "ord", "line", "\n", ("line",), part_rows, hot=[]), NO_EDGE),
        (2, text_parts(cited, INCIDENT, "rank", "line", "\n\n", ("line",), part_rows, hot=[]), NO_PRECEDENT),
    )
    whole = intro
    for number, parts, absent in blocks:
        block = incidents.join(parts, "incident_id", "left").select(
            "incident_id",
            F.lit(number).alias("ord"),
            F.coalesce("part", zero).alias("part"),
            F.coalesce("text", F.lit(absent)).alias("text"),
        )
        whole = whole.unionByName(block)
    lines = log_block(log, part_rows, slice_rows).select("incident_id", F.lit(3).alias("ord"), "part", "text")
    return whole.unionByName(lines)


def report_sections(
    log: DataFrame,
    edges: DataFrame,
    affected: DataFrame,
    owners: DataFrame,
    slice_rows: int = SLICE_ROWS,
) -> DataFrame:
    """Report lines (incident_id, section, ord, line) taken from log rows only.

    `affected` has (incident_id, ord, service); `owners` is the owner status per incident.
    """
    rows = timeline(log)
    incidents = log.select("incident_id").distinct()
    told = F.concat(
        F.lit("- "), F.date_format("ts", "HH:mm:ss"), F.lit(" "), "event_type",
        F.coalesce(F.concat(F.lit(": "), "summary"), F.lit("")),
    )
    times = numbered(rows, INCIDENT, "ts", "ord", ("seq",), slice_rows).select(
        "incident_id", F.lit(vocab.SECTIONS[0]).alias("section"), "ord", told.alias("line")
    )
    causes = incidents.join(edge_lines(edges), "incident_id", "left").select(
        "incident_id",
        F.lit(vocab.SECTIONS[1]).alias("section"),
        F.coalesce(F.col("ord").cast("bigint"), F.lit(0)).alias("ord"),
        F.coalesce("line", F.lit(NO_EDGE)).alias("line"),
    )
    severity = rows.where(F.col("severity").isNotNull()).groupBy("incident_id").agg(
        F.max_by("severity", F.struct("ts", "seq")).alias("severity")
    )
    rated = incidents.join(severity, "incident_id", "left").select(
        "incident_id",
        F.lit(vocab.SECTIONS[2]).alias("section"),
        F.lit(0).cast("bigint").alias("ord"),
        F.concat(F.lit("- severity: "), F.coalesce("severity", F.lit("not in the log"))).alias("line"),
    )
    hit = affected.select(
        "incident_id",
        F.lit(vocab.SECTIONS[2]).alias("section"),
        (F.col("ord") + 1).cast("bigint").alias("ord"),
        F.concat(F.lit("- affected service: "), "service").alias("line"),
    )
    gaps = gap_report(log).select(
        "incident_id",
        F.lit(vocab.SECTIONS[3]).alias("section"),
        F.lit(1).cast("bigint").alias("ord"),
        F.concat(
            F.lit("- follow up "), "event_type", F.lit(" of "), "subject", F.lit(" (×"), F.col("n_events").cast("string"), F.lit(")")
        ).alias("line"),
    )
    unconfirmed = owners.where(F.col("status") != "confirmed").select(
        "incident_id",
        F.lit(vocab.SECTIONS[3]).alias("section"),
        F.lit(0).cast("bigint").alias("ord"),
        F.concat(
            F.lit("- confirm owner: "), F.coalesce("suggested_owner", F.lit("none suggested"))
        ).alias("line"),
    )
    out = times
    for block in (causes, rated, hit, gaps, unconfirmed):
        out = out.unionByName(block)
    return out


def release_wait():
    return F.when(F.col("delay") > 0, F.least(F.col("delay"), F.lit(vocab.MAX_TOKEN_DELAY))).otherwise(0.0)


def release_schedule(chunks: DataFrame, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """Wait before each chunk (incident_id, idx, token, delay) and its release time from the start."""
    timed = chunks.withColumn("wait", release_wait())
    return running(timed, INCIDENT, "idx", {"release_at": ("sum", F.col("wait"))}, (), slice_rows)


def report_release(incidents: DataFrame, verdicts: DataFrame) -> DataFrame:
    """What may happen to each report: release, blocked, unscreened or bypass.

    `verdicts` has (incident_id, available, allowed, latency_ms). A screener that was down lets
    the internal report out, marked unscreened; an answer that is no verdict never does.
    """
    decision = (
        F.when(~F.coalesce(F.col("available"), F.lit(False)), "unscreened")
        .when(F.col("allowed").isNull(), "bypass")
        .when(F.col("allowed"), "release")
        .otherwise("blocked")
    )
    return incidents.select("incident_id").join(verdicts, "incident_id", "left").select(
        "incident_id",
        decision.alias("decision"),
        F.when(decision.isin("release", "blocked"), F.col("latency_ms")).alias("screen_latency_ms"),
    )


def released_chunks(chunks: DataFrame, decisions: DataFrame) -> DataFrame:
    """Chunks of reports that may go out."""
    out = decisions.where(F.col("decision").isin("release", "unscreened")).select("incident_id")
    return chunks.join(out, "incident_id", "left_semi")


def report_metrics(chunks: DataFrame, decisions: DataFrame) -> DataFrame:
    """Token and character counts, release seconds and screening of each released report."""
    sizes = released_chunks(chunks, decisions).groupBy("incident_id").agg(
        F.count(F.lit(1)).alias("token_count"),
        F.sum(F.char_length("token")).alias("char_count"),
        F.sum(release_wait()).alias("release_seconds"),
    )
    return sizes.join(decisions, "incident_id").select(
        "incident_id",
        "token_count",
        "char_count",
        "release_seconds",
        (F.col("decision") == "release").alias("screened"),
        "screen_latency_ms",
    )


def report_html(reports: DataFrame) -> DataFrame:
    """Reports (incident_id, text) as HTML pages; blank ones are refused."""
    title = html_escape(F.col("incident_id"))
    page = F.concat(
        F.lit('<!doctype html>\n<html lang="en"><head><meta charset="utf-8"><title>Incident report — '), title,
        F.lit("</title></head><body><pre>"), html_escape(F.col("text")), F.lit("</pre></body></html>\n"),
    )
    blank = strip(F.coalesce(F.col("text"), F.lit(""))) == ""
    return reports.select(
        "incident_id",
        F.when(~blank, page).alias("html"),
        F.when(blank, F.lit("blank text")).alias("refused"),
    )
