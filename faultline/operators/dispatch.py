"""Outbound messages: screening gate, once-only sending, arguments, texts and wording."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultline.functions import jsonval, vocab
from faultline.functions.text import first_line
from faultline.operators.eventlog import opened
from faultline.plans.firsts import flag_first
from faultline.plans.slices import settled


def screen_gate(drafts: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Drafts (draft_id, ...) with `gate`: send, blocked, or bypass when no verdict exists."""
    known = verdicts.select("draft_id", "allowed")
    gate = F.when(F.col("allowed").isNull(), "bypass").when(F.col("allowed"), "send").otherwise("blocked")
    return drafts.join(known, "draft_id", "left").withColumn("gate", gate).drop("allowed")


def executed_actions(log: DataFrame) -> DataFrame:
    """Distinct (scope, action) already sent according to the log."""
    rows = opened(log, vocab.ACTION_EXECUTED)
    sends = rows.select(
        jsonval.text(F.col("p"), "$.idempotency_scope").alias("scope"),
        jsonval.text(F.col("p"), "$.action").alias("action"),
    )
    return settled(sends).distinct()


def dispatch_once(ready: DataFrame, log: DataFrame) -> DataFrame:
    """Drafts (draft_id, scope, action, ...) with `status`: sent, or duplicate.

    One draft per (scope, action) is sent unless the log already holds a successful send.
    """
    flagged = flag_first(ready, ["scope", "action"], "draft_id", [], "__first")
    done = executed_actions(log).withColumn("__done", F.lit(True))
    # only the first draft of a key looks it up, so no key is hot in this join
    fresh = (
        flagged.where(F.col("__first"))
        .join(done, ["scope", "action"], "left")
        .withColumn("status", F.when(F.col("__done"), "duplicate").otherwise("sent"))
        .drop("__done", "__first")
    )
    repeated = flagged.where(~F.col("__first")).withColumn("status", F.lit("duplicate")).drop("__first")
    return fresh.unionByName(repeated)


def action_args(
    drafts: DataFrame, channel: str = vocab.CHAT_CHANNEL, project_key: str = vocab.PROJECT_KEY
) -> DataFrame:
    """Add the JSON arguments of each draft's action, or `error` for an unknown one."""
    chat = F.to_json(F.struct(F.lit(channel).alias("channel"), F.col("text").alias("markdown_text")))
    ticket = F.to_json(
        F.struct(
            F.lit(project_key).alias("project_key"),
            F.lit("Task").alias("issue_type"),
            F.left(first_line(F.col("text")), F.lit(255)).alias("summary"),
            F.col("text").alias("description"),
        )
    )
    args = F.when(F.col("action") == vocab.CHAT_ACTION, chat).when(F.col("action") == vocab.TICKET_ACTION, ticket)
    return drafts.withColumn("arguments", args).withColumn(
        "error", F.when(args.isNull(), F.concat(F.lit("unknown action "), F.col("action")))
    )


def causal_summary(edges: DataFrame) -> DataFrame:
    """One line per incident over its edges (incident_id, ord, cause_service, effect_service, lag_seconds)."""
    lag = F.col("lag_seconds").cast("bigint").cast("string")
    text = F.concat("cause_service", F.lit(" → "), "effect_service", F.lit(" ("), lag, F.lit("s)"))
    parts = F.array_sort(F.collect_list(F.struct("ord", text.alias("text"))))
    # the edges of one incident come from one payload
    return edges.groupBy("incident_id").agg(
        F.array_join(F.transform(parts, lambda part: part["text"]), ", ").alias("causal_summary")
    )


def action_text(incidents: DataFrame) -> DataFrame:
    """Chat update and ticket text of (incident_id, state, causal_summary, suggested_owner)."""
    owner: Column = F.concat(F.lit(vocab.SUGGESTION + ": "), F.col("suggested_owner"))
    update = F.concat(
        F.lit("[incident] "), "incident_id", F.lit(" is now "), "state",
        F.lit("\nWhat led to what: "), "causal_summary", F.lit("\n"), owner,
    )
    followup = F.concat(
        F.lit("Open work from "), "incident_id", F.lit(", which is "), "state", F.lit(".\n\n"), owner,
        F.lit(f"\n{vocab.HUMAN_CONFIRMS} who takes this; nobody is assigned before."),
    )
    return incidents.select("incident_id", update.alias("update_text"), followup.alias("followup_text"))


def wording_check(texts: DataFrame) -> DataFrame:
    """Outbound texts (text_id, action, text) that break the wording rules.

    Every text must offer a suggestion; a chat update never speaks of assigning, and a ticket
    says that a human confirms.
    """
    chat = F.col("action") == vocab.CHAT_ACTION
    problem = (
        F.when(~F.col("text").contains(vocab.SUGGESTION), "no suggestion")
        .when(chat & F.lower("text").contains("assign"), "speaks of assigning")
        .when(~chat & ~F.col("text").contains(vocab.HUMAN_CONFIRMS), "no human confirmation")
    )
    return texts.select("text_id", "action", problem.alias("problem")).where(F.col("problem").isNotNull())
