"""Incident state, its transitions, ownership and report outcome, derived from the event log."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultline.functions import jsonval, vocab
from faultline.operators.eventlog import INCIDENT, at, at_places, of_type, opened, place
from faultline.plans.firsts import position
from faultline.plans.slices import SLICE_ROWS, numbered, previous, settled


def legal_move(source: Column, target: Column) -> Column:
    moves = [(source == a) & (target == b) for a, b in vocab.LEGAL_MOVES]
    return F.coalesce(reduce(lambda left, right: left | right, moves), F.lit(False))


def incident_state(log: DataFrame) -> DataFrame:
    """Last valid target state; INVESTIGATING once opened or alerted; else null.

    One hash aggregate over the log: a state is its number in the list of states, a place in the
    order a decimal. Payloads of transitions alone are parsed.
    """
    moved = F.when(of_type(vocab.STATE_TRANSITION), jsonval.open_payload(F.col("payload")))
    target = F.nullif(F.array_position(F.array(*[F.lit(state) for state in vocab.STATES]), jsonval.text(moved, "$.to")), F.lit(0))
    read = log.select(
        "incident_id",
        of_type(vocab.INCIDENT_OPENED, vocab.ALERT_RECEIVED).alias("begun"),
        target.cast("bigint").alias("target"),
        position(F.col("ts"), F.col("seq")).alias("place"),
    )
    last = read.groupBy("incident_id").agg(
        F.max_by("target", F.when(F.col("target").isNotNull(), F.col("place"))).alias("target"),
        F.bool_or("begun").alias("begun"),
    )
    names = F.array(*[F.lit(state) for state in vocab.STATES])
    return last.select(
        "incident_id",
        F.coalesce(F.get(names, F.col("target") - 1), F.when(F.col("begun"), F.lit(vocab.INVESTIGATING))).alias("state"),
    )


def transitions(log: DataFrame) -> DataFrame:
    rows = opened(log, vocab.STATE_TRANSITION)
    moves = rows.select(
        "incident_id",
        "ts",
        "seq",
        jsonval.text(F.col("p"), "$.from").alias("from_state"),
        jsonval.text(F.col("p"), "$.to").alias("to_state"),
    )
    return settled(moves)


def illegal_transitions(log: DataFrame, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """Moves that are not allowed (`move`) or do not start where the last one ended (`break`)."""
    chained = previous(transitions(log), INCIDENT, "ts", {"__was": "to_state"}, ("seq",), slice_rows)
    was = F.coalesce(F.col("__was"), F.lit(vocab.INVESTIGATING))
    reason = F.when(~legal_move(F.col("from_state"), F.col("to_state")), "move").when(
        F.col("from_state") != was, "break"
    )
    return chained.withColumn("reason", reason).where(F.col("reason").isNotNull()).drop("__was")


def transition_path(log: DataFrame, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """Moves of each incident numbered in order."""
    return numbered(transitions(log), INCIDENT, "ts", "step", ("seq",), slice_rows).select(
        "incident_id", "step", "from_state", "to_state"
    )


def current_incident(log: DataFrame) -> DataFrame:
    """Most recently opened or alerted incident, else that of the last event; one row."""
    begun = of_type(vocab.INCIDENT_OPENED, vocab.ALERT_RECEIVED)
    return log.agg(
        F.coalesce(
            F.max_by("incident_id", F.when(begun, at())), F.max_by("incident_id", at())
        ).alias("incident_id")
    )


def owner_status(log: DataFrame) -> DataFrame:
    """Latest suggested and confirmed owner of each incident, and where that stands.

    One hash aggregate finds the two events of each incident, which are then looked up.
    """
    kinds = (vocab.OWNERSHIP_SUGGESTED, vocab.OWNER_CONFIRMED)
    places = log.groupBy("incident_id").agg(*[F.max(F.when(of_type(kind), place())).alias(name) for kind, name in zip(kinds, ("s", "c"))])
    p = F.col("p")
    offer = F.when(of_type(kinds[0]), F.struct(jsonval.text(p, "$.suggested_owner").alias("owner"), jsonval.text(p, "$.citation").alias("citation")))
    answer = F.when(of_type(kinds[1]), F.struct(jsonval.text(p, "$.owner").alias("owner"), jsonval.text(p, "$.confirmed_by").alias("by")))
    found = at_places(log, places, ["s", "c"], *kinds).groupBy("incident_id", "s", "c").agg(
        F.collect_list(offer).alias("offers"), F.collect_list(answer).alias("answers")
    )
    offer, answer = F.get("offers", F.lit(0)), F.get("answers", F.lit(0))
    status = F.when(F.col("c").isNotNull(), "confirmed").when(F.col("s").isNotNull(), "suggested")
    return found.select(
        "incident_id",
        offer["owner"].alias("suggested_owner"),
        offer["citation"].alias("citation"),
        answer["owner"].alias("confirmed_owner"),
        answer["by"].alias("confirmed_by"),
        F.coalesce(status, F.lit("awaiting")).alias("status"),
    )


def report_outcome(log: DataFrame) -> DataFrame:
    """What became of each incident's report.

    A refusal outranks a skip, a skip a failure, a failure a completion. An incident that is
    resolved, with neither text nor a refusal, skip or failure, is `waiting`.
    """
    types = (
        vocab.REPORT_TOKEN,
        vocab.REPORT_COMPLETE,
        vocab.BLOCKED,
        vocab.SKIPPED,
        vocab.REPORT_ERROR,
        vocab.STATE_TRANSITION,
    )
    p = F.col("p")
    # fixed-width marks of every event, parsed once
    state = F.nullif(F.array_position(F.array(*[F.lit(name) for name in vocab.STATES]), jsonval.text(p, "$.to")), F.lit(0))
    read = settled(
        log.withColumn("p", F.when(of_type(*types), jsonval.open_payload(F.col("payload")))).select(
            "incident_id",
            place().alias("place"),
            (of_type(vocab.BLOCKED) & (jsonval.text(p, "$.step") == vocab.REPORT_STEP)).alias("blocks"),
            (of_type(vocab.SKIPPED) & (jsonval.text(p, "$.step") == vocab.REPORT_SKIP_STEP)).alias("skips"),
            of_type(vocab.REPORT_ERROR).alias("fails"),
            of_type(vocab.REPORT_COMPLETE).alias("ends"),
            (of_type(vocab.REPORT_TOKEN) & jsonval.text(p, "$.token").isNotNull()).alias("tells"),
            F.when(of_type(vocab.STATE_TRANSITION), state).alias("moves"),
        )
    )
    places = read.groupBy("incident_id").agg(
        F.coalesce(F.bool_or("blocks"), F.lit(False)).alias("blocked"),
        F.coalesce(F.bool_or("tells"), F.lit(False)).alias("has_text"),
        F.max_by("moves", F.when(F.col("moves").isNotNull(), F.col("place"))).alias("state"),
        *[F.max(F.when(F.col(mark), F.col("place"))).alias(name) for mark, name in (("skips", "skip"), ("fails", "fail"), ("ends", "done"))],
    )
    said = F.struct(
        "place", jsonval.text(p, "$.error").alias("e"), jsonval.number(p, "$.elapsed_ms").alias("elapsed_ms"), jsonval.text(p, "$.model").alias("model")
    )
    found = at_places(log, places, ["skip", "fail", "done"], vocab.SKIPPED, vocab.REPORT_ERROR, vocab.REPORT_COMPLETE)
    found = found.groupBy(*places.columns).agg(F.collect_list(F.when(F.col("event_type").isNotNull(), said)).alias("said"))

    def of(name: str) -> Column:
        return F.get(F.filter("said", lambda x: x["place"] == F.col(name)), F.lit(0))

    skip, fail, done = of("skip")["e"], of("fail")["e"], of("done")
    return found.select(
        "incident_id",
        F.when(F.col("blocked"), "blocked")
        .when(skip.isNotNull(), "skipped")
        .when(fail.isNotNull(), "failed")
        .when(F.col("done").isNotNull(), "complete")
        .when(F.col("has_text"), "streaming")
        .otherwise("none")
        .alias("outcome"),
        F.coalesce(skip, fail).alias("error"),
        done["elapsed_ms"].alias("elapsed_ms"),
        done["model"].alias("model"),
        F.coalesce(
            (F.col("state") == vocab.STATES.index(vocab.RESOLVED) + 1) & ~F.col("has_text") & ~F.col("blocked") & skip.isNull() & fail.isNull(),
            F.lit(False),
        ).alias("waiting"),
    )
