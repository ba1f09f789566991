"""Rolling baselines and anomaly onsets of long-format metrics (ts, service, metric, value)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultline.functions import vocab
from faultline.plans.slices import SLICE_ROWS, bounded_frame

SERIES = ("service", "metric")


def check_frame(baseline_rows: int, min_rows: int) -> None:
    if baseline_rows < 2 or min_rows < 2 or min_rows > baseline_rows:
        raise ValueError(f"baseline of {baseline_rows} rows with at least {min_rows} is not usable")


def rolling_baseline(
    metrics: DataFrame,
    baseline_rows: int = vocab.BASELINE_ROWS,
    slice_rows: int = SLICE_ROWS,
) -> DataFrame:
    """Mean, population deviation and count of up to `baseline_rows` samples before each one."""

    def columns(window) -> dict[str, Column]:
        frame = window.rowsBetween(-baseline_rows, -1)
        return {
            "baseline_mean": F.avg("value").over(frame),
            "baseline_std": F.stddev_pop("value").over(frame),
            "baseline_n": F.count("value").over(frame),
        }

    return bounded_frame(metrics, SERIES, "ts", baseline_rows, columns, ("value",), slice_rows)


def zscore(
    metrics: DataFrame,
    baseline_rows: int = vocab.BASELINE_ROWS,
    slice_rows: int = SLICE_ROWS,
) -> DataFrame:
    """Distance of each sample from its own baseline in deviations; null where that is zero."""
    spread = F.col("baseline_std")
    score = F.when(spread > 0, (F.col("value") - F.col("baseline_mean")) / spread)
    return rolling_baseline(metrics, baseline_rows, slice_rows).withColumn("z", score)


def anomalies(
    metrics: DataFrame,
    threshold_z: float = vocab.THRESHOLD_Z,
    baseline_rows: int = vocab.BASELINE_ROWS,
    min_rows: int = vocab.MIN_BASELINE_ROWS,
    slice_rows: int = SLICE_ROWS,
) -> DataFrame:
    """Samples above their baseline by more than the threshold; drops never count."""
    check_frame(baseline_rows, min_rows)
    scored = zscore(metrics, baseline_rows, slice_rows)
    return scored.where((F.col("baseline_n") >= min_rows) & (F.col("z") > threshold_z))


def onsets(metrics: DataFrame, **limits) -> DataFrame:
    """First anomalous time of each service, over all of its metrics."""
    return anomalies(metrics, **limits).groupBy("service").agg(F.min("ts").alias("onset_ts"))


def series_onsets(metrics: DataFrame, **limits) -> DataFrame:
    """First anomalous time of each (service, metric)."""
    return anomalies(metrics, **limits).groupBy(*SERIES).agg(F.min("ts").alias("onset_ts"))


def onset_index(metrics: DataFrame, **limits) -> DataFrame:
    """0-based row index of the first anomaly of every series; null when it has none."""
    first = anomalies(metrics, **limits).groupBy(*SERIES).agg(F.min(F.struct("ts", "value")).alias("__at"))
    here = F.struct("ts", "value")
    return (
        metrics.join(first, list(SERIES), "left")
        .groupBy(*SERIES)
        .agg(
            F.when(F.max(F.col("__at").isNotNull()), F.count_if(here < F.col("__at"))).alias("onset_index")
        )
    )


def first_breach(metrics: DataFrame, thresholds: DataFrame) -> DataFrame:
    """First sample per series at or above its threshold (service, metric, threshold)."""
    over = metrics.join(thresholds, list(SERIES)).where(F.col("value") >= F.col("threshold"))
    first = F.min(F.struct("ts", "value"))
    return over.groupBy(*SERIES).agg(first.alias("b")).select(
        *SERIES, F.col("b.ts").alias("breach_ts"), F.col("b.value").alias("breach_value")
    )


def breach_lead(
    metrics: DataFrame, thresholds: DataFrame, pairs: DataFrame, **limits
) -> DataFrame:
    """Seconds from the onset of one series to the breach of another.

    `pairs` names them: cause_service, cause_metric, effect_service, effect_metric.
    """
    starts = series_onsets(metrics, **limits).select(
        F.col("service").alias("cause_service"), F.col("metric").alias("cause_metric"), "onset_ts"
    )
    breaches = first_breach(metrics, thresholds).select(
        F.col("service").alias("effect_service"), F.col("metric").alias("effect_metric"), "breach_ts"
    )
    lead = F.unix_micros("breach_ts") - F.unix_micros("onset_ts")
    return (
        pairs.join(starts, ["cause_service", "cause_metric"])
        .join(breaches, ["effect_service", "effect_metric"])
        .withColumn("lead_seconds", lead / 1e6)
    )


def constant_series(metrics: DataFrame) -> DataFrame:
    """Series without any spread; these can never have an onset."""
    return (
        metrics.groupBy(*SERIES)
        .agg(F.min("value").alias("value"), F.max("value").alias("__hi"), F.count("value").alias("n_rows"))
        .where(F.col("value") == F.col("__hi"))
        .drop("__hi")
    )
