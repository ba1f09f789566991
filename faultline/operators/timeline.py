"""Timeline rows, search over them, latency badges, and reports on gaps in the log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultline.functions import jsonval, vocab
from faultline.operators.eventlog import at_places, of_type, opened, place
from faultline.plans.slices import settled


def _tone() -> Column:
    return (
        F.when(of_type(vocab.SKIPPED), "skipped")
        .when(of_type(vocab.DEGRADED), "degraded")
        .when(of_type(vocab.BLOCKED), "blocked")
        .when(of_type(vocab.AGENT_ERROR, vocab.REPORT_ERROR), "error")
        .when(of_type(vocab.STATE_TRANSITION, vocab.REPORT_COMPLETE), "milestone")
        .otherwise("normal")
    )


def _service(p: Column) -> Column:
    return F.coalesce(jsonval.text(p, "$.service"), jsonval.text(p, "$.alert.service"))


def _summary(p: Column, words: dict[str, str]) -> Column:
    def field(name: str, default: str) -> Column:
        return F.coalesce(jsonval.text(p, f"$.{name}"), F.lit(default))

    error = jsonval.text(p, "$.error")
    return (
        F.when(of_type(vocab.EXTRACTION_COMPLETED), F.concat(F.lit(words[vocab.EXTRACTION_COMPLETED]), field("severity", "?")))
        .when(of_type(vocab.CHAINS_DETECTED), F.lit(words[vocab.CHAINS_DETECTED]))
        .when(of_type(vocab.RUNBOOK_RETRIEVED), F.concat(F.lit(words[vocab.RUNBOOK_RETRIEVED]), field("citation", "")))
        .when(
            of_type(vocab.OWNERSHIP_SUGGESTED),
            F.concat(field("note", "Suggested owner"), F.lit(": "), field("suggested_owner", "(see cited doc)")),
        )
        .when(
            of_type(vocab.OWNER_CONFIRMED),
            F.concat(F.lit("Owner confirmed by "), field("confirmed_by", "human"), F.lit(": "), field("owner", "")),
        )
        .when(of_type(vocab.STEP_SELECTED), F.coalesce(jsonval.text(p, "$.step"), jsonval.text(p, "$.note")))
        .when(of_type(vocab.STATE_TRANSITION), F.concat(field("from", "?"), F.lit(" → "), field("to", "?")))
        .when(of_type(vocab.SKIPPED, vocab.DEGRADED, vocab.AGENT_ERROR, vocab.REPORT_ERROR), error)
    )


def timeline(log: DataFrame, words: dict[str, str] | None = None) -> DataFrame:
    """Display rows of the log: tone and its label, service, severity, summary. No tokens.

    `words` replaces the opening words of summaries by event type.
    """
    words = {**vocab.SUMMARY_WORDS, **(words or {})}
    p = F.col("p")
    tone = F.col("tone")
    labels = F.create_map(*[F.lit(text) for pair in vocab.TONE_LABELS.items() for text in pair])
    return opened(log.where(~of_type(vocab.REPORT_TOKEN))).withColumn("tone", _tone()).select(
        "incident_id",
        "seq",
        "ts",
        "event_type",
        "tone",
        F.try_element_at(labels, tone).alias("tone_label"),
        _service(p).alias("service"),
        jsonval.text(p, "$.severity").alias("severity"),
        _summary(p, words).alias("summary"),
    )


def _matches(severity: str | None, text: str | None) -> Column:
    keep = F.lit(True)
    if severity is not None:
        keep = keep & (F.coalesce(F.col("severity"), F.lit("")) == severity)
    if text is not None and text.strip():
        wanted = F.lit(text.lower())
        hit = F.lit(False)
        for name in ("event_type", "service", "summary"):
            hit = hit | F.lower(F.coalesce(F.col(name), F.lit(""))).contains(wanted)
        keep = keep & hit
    return keep


def timeline_search(rows: DataFrame, severity: str | None = None, text: str | None = None) -> DataFrame:
    """Timeline rows of one severity whose type, service or summary contains the text."""
    return settled(rows).where(_matches(severity, text))


def search_counts(rows: DataFrame, severity: str | None = None, text: str | None = None) -> DataFrame:
    """Rows shown by a search against all rows, per incident."""
    return rows.groupBy("incident_id").agg(
        F.count_if(_matches(severity, text)).alias("shown"), F.count(F.lit(1)).alias("total")
    )


def latency_badges(log: DataFrame) -> DataFrame:
    """Last measured latency of extraction, context lookup and retrieval per incident.

    A context lookup that was skipped carries what blocked it. One hash aggregate over the log; only
    the blocking events are looked up.
    """
    retrieval = (vocab.RUNBOOK_RETRIEVED, vocab.OWNERSHIP_SUGGESTED)
    types = (vocab.EXTRACTION_COMPLETED, vocab.RELATED_ITEMS, *retrieval, vocab.SKIPPED)
    p = F.col("p")
    read = settled(
        log.withColumn("p", F.when(of_type(*types), jsonval.open_payload(F.col("payload")))).select(
            "incident_id",
            "event_type",
            place().alias("place"),
            jsonval.number(p, "$.latency_ms").alias("latency"),
            (of_type(vocab.SKIPPED) & (jsonval.text(p, "$.step") == vocab.CONTEXT_STEP)).alias("skipped"),
        )
    )

    def last(*types: str) -> Column:
        return F.max_by("latency", F.when(of_type(*types) & F.col("latency").isNotNull(), F.col("place")))

    places = read.groupBy("incident_id").agg(
        last(vocab.EXTRACTION_COMPLETED).alias("extraction"),
        last(vocab.RELATED_ITEMS).alias("context"),
        last(*retrieval).alias("retrieval"),
        F.max(F.when(F.col("skipped"), F.col("place"))).alias("stopped"),
    )
    blocker = F.when(F.col("event_type").isNotNull(), F.coalesce(jsonval.text(p, "$.blocker"), F.lit("blocked")))
    note = F.concat(F.lit("skipped — not configured ("), F.col("blocker"), F.lit(")"))
    return (
        at_places(log, places, ["stopped"], vocab.SKIPPED)
        .withColumn("blocker", blocker)
        .unpivot(["incident_id", "blocker"], ["extraction", "context", "retrieval"], "badge", "latency_ms")
        .select("incident_id", "badge", "latency_ms", F.when(F.col("badge") == "context", note).alias("note"))
    )


def gap_report(log: DataFrame) -> DataFrame:
    """Counts of degraded, skipped, blocked and failed events by what they concern."""
    rows = opened(
        log, vocab.DEGRADED, vocab.SKIPPED, vocab.BLOCKED, vocab.AGENT_ERROR, vocab.REPORT_ERROR
    )
    subject = F.coalesce(
        jsonval.text(F.col("p"), "$.service"), jsonval.text(F.col("p"), "$.step"), F.lit("unknown")
    )
    return rows.groupBy("incident_id", "event_type", subject.alias("subject")).agg(
        F.count(F.lit(1)).alias("n_events")
    )


def gap_totals(log: DataFrame) -> DataFrame:
    """Gap counts by type and subject with subtotals; a subtotal has `all` in its place."""
    gaps = gap_report(log)
    return gaps.rollup("event_type", "subject").agg(F.sum("n_events").alias("n_events")).select(
        F.coalesce("event_type", F.lit("all")).alias("event_type"),
        F.coalesce("subject", F.lit("all")).alias("subject"),
        "n_events",
    )
