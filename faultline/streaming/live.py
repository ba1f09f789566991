"""Streaming twins of batch operators: replay, event feed, states, deduplication, limits, breakers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from faultline.functions import jsonval, vocab
from faultline.operators.alerts import alert_keys, bucket_step
from faultline.operators.eventlog import opened
from faultline.operators.telemetry import breaker_step
from faultline.streaming.stateful import STRETCH, fold_stream, seconds

STATE_PARTITIONS = 32

def replay_stream(spark: SparkSession, path: str, schema: str, files_per_batch: int = 1) -> DataFrame:
    """Recorded files as a stream, oldest first, so many files per micro-batch."""
    return (
        spark.readStream.schema(schema)
        .option("maxFilesPerTrigger", files_per_batch)
        .option("recursiveFileLookup", "true")
        .parquet(path)
    )


def live_event_feed(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """New events of the log folder; every reader runs its own query with its own checkpoint."""
    return spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(path)


def state_partitions(spark: SparkSession) -> int:
    """Partitions of a stream's state: two a core, STATE_PARTITIONS at least, no more than the session's shuffles have.

    Each is opened and committed in every micro-batch, whatever it holds, so their number follows
    the cores; what grows with the input is on disk.
    """
    most = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return min(most, max(STATE_PARTITIONS, 2 * spark.sparkContext.defaultParallelism))


def run_to_table(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Process what is there now and append it to `path`; restartable from the checkpoint.

    A checkpoint keeps the number of partitions that it began with.
    """
    spark = stream.sparkSession
    own = spark.conf.get("spark.sql.shuffle.partitions")
    writer = (
        stream.writeStream.format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
    )
    spark.conf.set("spark.sql.shuffle.partitions", state_partitions(spark))
    try:
        query = writer.start()  # a query has a copy of the settings it starts with
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", own)
    query.awaitTermination()


def state_step(state, value):
    """One event of an incident: state is (current,), output (applied state, accepted)."""
    event_type, target = value
    current = state[0] if state else None
    if event_type != vocab.STATE_TRANSITION:
        current = current or vocab.INVESTIGATING
        return (current,), (current, True)
    if (current, target) in vocab.LEGAL_MOVES:
        return (target,), (target, True)
    return (current,), (current, False)


def stream_states(log: DataFrame, delay: str = "0 seconds", stretch: float = STRETCH) -> DataFrame:
    """Live incident state per opening, alert or transition; illegal moves come out as not accepted.

    Here and below, rows may come in any order within `delay`, and come out once that has passed.
    """
    rows = opened(log.withWatermark("ts", delay), vocab.ALERT_RECEIVED, vocab.INCIDENT_OPENED, vocab.STATE_TRANSITION).select(
        "incident_id",
        "seq",
        seconds("ts").alias("t"),
        "event_type",
        jsonval.text(F.col("p"), "$.to").alias("to_state"),
    )
    return fold_stream(
        rows,
        ["incident_id"],
        state_step,
        "t",
        ["event_type", "to_state"],
        ["state", "accepted"],
        ["incident_id", "seq", "event_type", "to_state"],
        "incident_id string, seq bigint, event_type string, to_state string, state string, accepted boolean, late boolean",
        ["seq"],
        stretch,
    )


def stream_alert_dedupe(alerts: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """First delivery of each alert key; repeats up to `delay` later are dropped, then forgotten."""
    return (
        alert_keys(alerts)
        .withWatermark("received_at", delay)
        .dropDuplicatesWithinWatermark(["alert_key"])
    )


def stream_token_bucket(
    requests: DataFrame, limit: int, window_seconds: float = 60.0, delay: str = "0 seconds", stretch: float = STRETCH
) -> DataFrame:
    """Live rate limit of requests (client, request_id, ts)."""
    micros = F.unix_micros(F.col("ts").cast("timestamp")).alias("micros")
    return fold_stream(
        requests.withWatermark("ts", delay).select("client", "request_id", micros, seconds("ts").alias("t")),
        ["client"],
        bucket_step(limit, window_seconds),
        "t",
        ["micros"],
        ["allowed", "retry_after"],
        ["client", "request_id"],
        "client string, request_id bigint, allowed boolean, retry_after double, late boolean",
        ["request_id"],
        stretch,
    )


def stream_breaker_states(
    calls: DataFrame,
    failures_to_open: int = vocab.BREAKER_FAILURES,
    cooldown: float = vocab.BREAKER_COOLDOWN,
    delay: str = "0 seconds",
    stretch: float = STRETCH,
) -> DataFrame:
    """Live breaker states of calls (service, call_id, ts, ok)."""
    return fold_stream(
        calls.withWatermark("ts", delay).select("service", "call_id", seconds("ts").alias("t"), "ok"),
        ["service"],
        breaker_step(failures_to_open, cooldown),
        "t",
        ["t", "ok"],
        ["state", "runs", "state_after"],
        ["service", "call_id"],
        "service string, call_id bigint, state string, runs boolean, state_after string, late boolean",
        ["call_id"],
        stretch,
    )
