"""Checks and reshaping of recorded metrics: ticks, replay timing, grids, coverage, shape."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultline.operators.timeseries import SERIES
from faultline.plans.slices import SLICE_ROWS, bounded_frame, find_hot, previous


def tick_batches(metrics: DataFrame) -> DataFrame:
    """Every row with the size of its tick's batch; all rows of one `ts` form one batch."""
    sizes = metrics.groupBy("ts").agg(F.count(F.lit(1)).alias("batch_rows"))
    return metrics.join(sizes, "ts")


def replay_schedule(metrics: DataFrame, speed: float, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """One row per tick: rows, wait before the next tick, and offset from the first one.

    Waits are recorded gaps divided by `speed`; the last tick has none.
    """
    if speed <= 0:
        raise ValueError(f"speed must be positive, got {speed}")
    ticks = metrics.groupBy("ts").agg(F.count(F.lit(1)).alias("n_rows"))
    # descending time turns "next tick" into a look-back of one row
    ticks = ticks.withColumn("__back", -F.unix_micros(F.col("ts").cast("timestamp")))
    placed = previous(ticks, [], "__back", {"__next": "__back"}, (), slice_rows)
    start = metrics.agg(F.min(F.unix_micros(F.col("ts").cast("timestamp"))).alias("lo")).scalar()
    wait = F.greatest(F.lit(0.0), (F.col("__back") - F.col("__next")) / 1e6 / speed)
    return placed.select(
        "ts",
        "n_rows",
        F.coalesce(wait, F.lit(0.0)).alias("wait_seconds"),
        ((-F.col("__back") - start) / 1e6 / speed).alias("offset_seconds"),
    )


def replay_summary(metrics: DataFrame, speed: float) -> DataFrame:
    """Rows, ticks, recorded window and estimated wall clock of a replay."""
    if speed <= 0:
        raise ValueError(f"speed must be positive, got {speed}")
    ticks = metrics.groupBy("ts").agg(F.count(F.lit(1)).alias("n"))
    window = (F.unix_micros(F.max("ts").cast("timestamp")) - F.unix_micros(F.min("ts").cast("timestamp"))) / 1e6
    return ticks.agg(
        F.sum("n").alias("n_rows"),
        F.count(F.lit(1)).alias("n_ticks"),
        window.alias("window_seconds"),
        (window / speed).alias("wall_seconds"),
    )


def grid_check(metrics: DataFrame, step_seconds: float, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """Samples of a series whose distance to the one before is not the grid step."""
    paced = previous(metrics, SERIES, "ts", {"previous_ts": "ts"}, ("value",), slice_rows)
    gap = (F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(F.col("previous_ts").cast("timestamp"))) / 1e6
    return (
        paced.withColumn("gap_seconds", gap)
        .where(F.col("gap_seconds") != step_seconds)
        .select(*SERIES, "ts", "previous_ts", "gap_seconds")
    )


def series_coverage(metrics: DataFrame) -> DataFrame:
    """Rows of each series against the number of ticks in the recording."""
    ticks = metrics.select("ts").distinct().agg(F.count(F.lit(1))).scalar()
    return (
        metrics.groupBy(*SERIES)
        .agg(F.count(F.lit(1)).alias("n_rows"))
        .withColumn("n_ticks", ticks)
        .withColumn("complete", F.col("n_rows") == F.col("n_ticks"))
    )


def baseline_bands(metrics: DataFrame, series_onset: DataFrame) -> DataFrame:
    """Range and mean of each series before its onset (service, metric, onset_ts)."""
    before = metrics.join(series_onset, list(SERIES)).where(F.col("ts") < F.col("onset_ts"))
    return before.groupBy(*SERIES).agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.min("value").alias("low"),
        F.max("value").alias("high"),
        F.avg("value").alias("mean"),
        (F.max("value") - F.min("value")).alias("spread"),
    )


def saturation(metrics: DataFrame, limits: DataFrame) -> DataFrame:
    """First time a series reaches its limit (service, metric, limit) and whether it stays there."""
    at_limit = F.col("value") == F.col("limit")
    return (
        metrics.join(limits, list(SERIES))
        .groupBy(*SERIES)
        .agg(
            F.min(F.when(at_limit, F.col("ts"))).alias("full_ts"),
            F.max(F.when(~at_limit, F.col("ts"))).alias("__last_below"),
        )
        .where(F.col("full_ts").isNotNull())
        .select(
            *SERIES,
            "full_ts",
            F.coalesce(F.col("__last_below") < F.col("full_ts"), F.lit(True)).alias("pinned"),
        )
    )


def step_profile(metrics: DataFrame, intervals: DataFrame, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """Largest rise and number of rising steps inside [start_ts, end_ts) of each series."""
    inside = (
        metrics.join(intervals, list(SERIES))
        .where((F.col("ts") >= F.col("start_ts")) & (F.col("ts") < F.col("end_ts")))
        .select(*SERIES, "ts", "value")
    )
    steps = bounded_frame(
        inside,
        SERIES,
        "ts",
        1,
        lambda window: {"rise": F.col("value") - F.lag("value").over(window)},
        ("value",),
        slice_rows,
        find_hot(metrics, SERIES, "ts", slice_rows),
    )
    return steps.groupBy(*SERIES).agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.max("rise").alias("largest_rise"),
        F.count_if(F.col("rise") > 0).alias("rising_steps"),
    )


def climb_shape(
    metrics: DataFrame, series_onset: DataFrame, bound: float, settle_seconds: int = 60
) -> DataFrame:
    """Whether a series stays below `bound` before its onset and above its old maximum after."""
    at = F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(F.col("onset_ts").cast("timestamp"))
    return (
        metrics.join(series_onset, list(SERIES))
        .groupBy(*SERIES)
        .agg(
            F.max(F.when(at < 0, F.col("value"))).alias("max_before"),
            F.min(F.when(at >= settle_seconds * 1_000_000, F.col("value"))).alias("min_after"),
        )
        .withColumn(
            "ok",
            F.coalesce(
                (F.col("max_before") < bound) & (F.col("min_after") > F.col("max_before")), F.lit(False)
            ),
        )
    )


def metric_diff(recorded: DataFrame, expected: DataFrame) -> DataFrame:
    """Rows on one side only, duplicates counted: one union and one aggregate, each side read once."""
    columns = recorded.columns
    both = recorded.withColumn("__more", F.lit(1)).unionByName(expected.select(columns).withColumn("__more", F.lit(-1)))
    counts = both.groupBy(*columns).agg(F.sum("__more").alias("__more")).where("__more <> 0")
    side = F.when(F.col("__more") > 0, "unexpected").otherwise("missing").alias("side")
    # a row surplus many times comes out as often
    times = F.explode(F.sequence(F.lit(1).cast("bigint"), F.abs("__more")))
    return counts.select(*columns, side, times.alias("__copy")).drop("__copy")


def spread_samples(metrics: DataFrame, samples: int, step_seconds: float) -> DataFrame:
    """Each row as `samples` rows spaced evenly over the step that starts at its `ts`."""
    if samples < 1:
        raise ValueError(f"samples must be at least 1, got {samples}")
    spacing = int(round(step_seconds * 1_000_000 / samples))
    shifted = F.timestamp_micros(F.unix_micros(F.col("ts").cast("timestamp")) + F.col("sample") * spacing)
    return metrics.select(
        "*", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(samples - 1).cast("bigint"))).alias("sample")
    ).withColumn("ts", shifted)
