"""Cause -> effect edges from onset order, and the graph drawn from them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from faultline.functions import vocab
from faultline.functions.text import lag_label
from faultline.operators.timeseries import onsets
from faultline.plans.slices import numbered


def chain_pairs(onset_rows: DataFrame) -> DataFrame:
    """Pair each onset with the one right before it.

    The input has one row per service, so ordering it in one task is its natural size.
    """
    order = Window.orderBy("onset_ts", "service")
    return onset_rows.select(
        F.lag("service").over(order).alias("cause_service"),
        F.lag("onset_ts").over(order).alias("cause_onset_ts"),
        F.col("service").alias("effect_service"),
        F.col("onset_ts").alias("effect_onset_ts"),
    )


def lag_bounded_edges(pairs: DataFrame, window_minutes: int = vocab.WINDOW_MINUTES) -> DataFrame:
    """Keep pairs 1 second to `window_minutes` apart. A dropped pair is not bridged.

    The lag counts second boundaries, not elapsed time.
    """
    lag = F.unix_timestamp("effect_onset_ts") - F.unix_timestamp("cause_onset_ts")
    named = F.coalesce(F.col("cause_service"), F.lit("")) != ""
    return (
        pairs.withColumn("lag_seconds", lag)
        .where(named & F.col("lag_seconds").between(1, int(window_minutes) * 60))
        .orderBy("effect_onset_ts", "effect_service")
        .select("cause_service", "effect_service", "lag_seconds")
    )


def causal_chains(
    metrics: DataFrame, window_minutes: int = vocab.WINDOW_MINUTES, **limits
) -> DataFrame:
    """Edges (cause_service, effect_service, lag_seconds) between successive onsets."""
    return lag_bounded_edges(chain_pairs(onsets(metrics, **limits)), window_minutes)


def edge_labels(edges: DataFrame) -> DataFrame:
    return edges.withColumn("label", F.concat(F.lit("precedes by "), lag_label(F.col("lag_seconds"))))


def graph_nodes(edges: DataFrame, mentioned: DataFrame, hot: DataFrame | list | None = None) -> DataFrame:
    """Services of each incident's graph in order of first appearance, with their role.

    `edges` has (incident_id, ord, cause_service, effect_service); `mentioned` has
    (incident_id, ord, service) and comes after all edges. Being an effect outranks being a
    cause. `hot` may pass on an empty finding about the incidents' events.
    """
    ends = edges.select(
        "incident_id",
        "ord",
        F.posexplode(F.array("cause_service", "effect_service")).alias("end", "service"),
    ).select(
        "incident_id",
        "service",
        F.struct(F.lit(0).alias("block"), F.col("ord").cast("bigint").alias("ord"), "end").alias("at"),
        (F.col("end") == 0).alias("is_cause"),
        (F.col("end") == 1).alias("is_effect"),
    )
    others = mentioned.select(
        "incident_id",
        "service",
        F.struct(F.lit(1).alias("block"), F.col("ord").cast("bigint").alias("ord"), F.lit(0).alias("end")).alias("at"),
        F.lit(False).alias("is_cause"),
        F.lit(False).alias("is_effect"),
    )
    nodes = ends.unionByName(others).groupBy("incident_id", "service").agg(
        F.min("at").alias("at"),
        F.when(F.bool_or("is_effect"), "effect")
        .when(F.bool_or("is_cause"), "cause")
        .otherwise("other")
        .alias("role"),
    )
    flat = nodes.select(
        "incident_id", "service", "role", F.col("at.block").alias("b"), F.col("at.ord").alias("o"), F.col("at.end").alias("e")
    )
    return numbered(flat, ["incident_id"], "b", "position", ("o", "e", "service"), hot=hot).select(
        "incident_id", "position", "service", "role"
    )
