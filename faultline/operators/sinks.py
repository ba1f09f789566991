"""Comparison of the two event sinks with each other and with what was emitted."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KEY = ("incident_id", "ts", "event_type", "digest")


def _tagged(events: DataFrame, **counts: int) -> DataFrame:
    return events.select(
        "incident_id",
        "ts",
        "event_type",
        F.md5(F.col("payload")).alias("digest"),
        *[F.lit(value).cast("bigint").alias(name) for name, value in counts.items()],
    )


def sink_reconcile(first: DataFrame, second: DataFrame) -> DataFrame:
    """Events whose number differs between two sinks, with the side that lacks them."""
    both = _tagged(first, in_first=1, in_second=0).unionByName(_tagged(second, in_first=0, in_second=1))
    counts = both.groupBy(*KEY).agg(F.sum("in_first").alias("in_first"), F.sum("in_second").alias("in_second"))
    return counts.where(F.col("in_first") != F.col("in_second")).withColumn(
        "missing_in", F.when(F.col("in_first") < F.col("in_second"), "first").otherwise("second")
    )


def sink_degradation(emitted: DataFrame, first: DataFrame, second: DataFrame) -> DataFrame:
    """One row per emitted event and sink that lost it; `fatal` when both did."""
    rows = (
        _tagged(emitted, sent=1, first=0, second=0)
        .unionByName(_tagged(first, sent=0, first=1, second=0))
        .unionByName(_tagged(second, sent=0, first=0, second=1))
    )
    counts = rows.groupBy(*KEY).agg(F.sum("sent").alias("sent"), F.sum("first").alias("first"), F.sum("second").alias("second"))
    lost = F.array_compact(
        F.array(
            F.when(F.col("first") < F.col("sent"), F.lit("first")),
            F.when(F.col("second") < F.col("sent"), F.lit("second")),
        )
    )
    return counts.select(
        "incident_id",
        "ts",
        F.col("event_type").alias("during_event_type"),
        "digest",
        (F.size(lost) == 2).alias("fatal"),
        F.explode(lost).alias("service"),
    )
