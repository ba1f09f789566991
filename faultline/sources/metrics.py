"""Metric recordings and the metrics table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CSV_SCHEMA = "ts STRING, service STRING, metric_name STRING, value DOUBLE"
COLUMNS = ("ts", "service", "metric", "value")


def scan_metrics_csv(spark: SparkSession, path: str) -> DataFrame:
    """A recorded CSV with ISO times, sorted by (ts, service, metric); no rows is an error."""
    raw = spark.read.schema(CSV_SCHEMA).option("header", True).option("mode", "FAILFAST").csv(path)
    if raw.isEmpty():
        raise ValueError(f"no rows in {path}")
    return raw.select(
        F.to_timestamp("ts").alias("ts"), "service", F.col("metric_name").alias("metric"), "value"
    ).orderBy("ts", "service", "metric")


def clustered(metrics: DataFrame) -> DataFrame:
    """Rows in storage order. Ranges include `ts`, so one large series fills many files."""
    return (
        metrics.select(*COLUMNS)
        .repartitionByRange("service", "metric", "ts")
        .sortWithinPartitions("service", "metric", "ts")
    )


def append_metrics(metrics: DataFrame, path: str) -> None:
    clustered(metrics).write.mode("append").parquet(path)


def reload_metrics(metrics: DataFrame, path: str) -> None:
    """Replace the table's rows. The rows must not be read from `path` itself."""
    clustered(metrics).write.mode("overwrite").parquet(path)
