"""Onset detection, causal chains and recording checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from faultline.operators import causal, recording, timeseries
from suite.registry import query, stamp
from suite.views import derive

WIDE = 100_000  # minutes; onsets of the supplied events lie up to days apart

SCORED = """
SELECT ts, service, metric, value,
       avg(value) OVER w AS m, stddev_pop(value) OVER w AS s, count(value) OVER w AS n
FROM v_metrics
WINDOW w AS (PARTITION BY service, metric ORDER BY ts, value ROWS BETWEEN 60 PRECEDING AND 1 PRECEDING)
"""
HITS = f"hits AS (SELECT * FROM ({SCORED}) WHERE n >= 12 AND s > 0 AND (value - m) / s > 3.0)"
FIRST = "firsts AS (SELECT service, min(ts) AS onset_ts FROM hits GROUP BY service)"
SERIES_FIRST = "sfirst AS (SELECT service, metric, min(ts) AS onset_ts FROM hits GROUP BY service, metric)"
PAIRED = """
paired AS (SELECT lag(service) OVER (ORDER BY onset_ts, service) AS cause_service,
                  lag(onset_ts) OVER (ORDER BY onset_ts, service) AS cause_onset_ts,
                  service AS effect_service, onset_ts AS effect_onset_ts FROM firsts)
"""
EDGES = f"""
edges AS (SELECT cause_service, effect_service,
                 date_diff('second', cause_onset_ts, effect_onset_ts) AS lag_seconds
          FROM paired WHERE cause_service IS NOT NULL
            AND date_diff('second', cause_onset_ts, effect_onset_ts) BETWEEN 1 AND {WIDE} * 60)
"""
V = ("v_metrics",)


def _metrics(spark, sf_dir):
    return derive(spark, sf_dir, "v_metrics")


def _thresholds(metrics):
    return metrics.groupBy("service", "metric").agg((F.max("value") * 0.5).alias("threshold"))


@query(
    "rolling_baseline",
    f"""SELECT {stamp('ts')} AS ts, service, metric, value, round(m, 9) AS baseline_mean,
               round(s, 9) AS baseline_std, n AS baseline_n FROM ({SCORED})""",
    V,
)
def rolling_baseline(spark, sf_dir):
    return timeseries.rolling_baseline(_metrics(spark, sf_dir))


@query(
    "zscore",
    f"""SELECT {stamp('ts')} AS ts, service, metric, value,
               round(CASE WHEN s > 0 THEN (value - m) / s END, 9) AS z FROM ({SCORED})""",
    V,
)
def zscore(spark, sf_dir):
    return timeseries.zscore(_metrics(spark, sf_dir)).select("ts", "service", "metric", "value", "z")


@query("onsets", f"WITH {HITS}, {FIRST} SELECT service, {stamp('onset_ts')} AS onset_ts FROM firsts", V)
def onsets(spark, sf_dir):
    return timeseries.onsets(_metrics(spark, sf_dir))


@query(
    "onset_index",
    f"""WITH {HITS},
    placed AS (SELECT service, metric, ts, row_number() OVER (PARTITION BY service, metric ORDER BY ts, value) - 1 AS idx
               FROM v_metrics)
    SELECT p.service, p.metric, coalesce(CAST(min(CASE WHEN h.ts IS NOT NULL THEN p.idx END) AS VARCHAR), 'none') AS onset_index
    FROM placed p LEFT JOIN hits h ON p.service = h.service AND p.metric = h.metric AND p.ts = h.ts
    GROUP BY p.service, p.metric""",
    V,
)
def onset_index(spark, sf_dir):
    found = timeseries.onset_index(_metrics(spark, sf_dir))
    return found.withColumn("onset_index", F.coalesce(F.col("onset_index").cast("string"), F.lit("none")))


@query(
    "chain_pairs",
    f"""WITH {HITS}, {FIRST}, {PAIRED}
    SELECT cause_service, {stamp('cause_onset_ts')} AS cause_onset_ts, effect_service,
           {stamp('effect_onset_ts')} AS effect_onset_ts FROM paired""",
    V,
)
def chain_pairs(spark, sf_dir):
    return causal.chain_pairs(timeseries.onsets(_metrics(spark, sf_dir)))


@query(
    "lag_bounded_edges",
    f"WITH {HITS}, {FIRST}, {PAIRED}, {EDGES} SELECT * FROM edges WHERE lag_seconds <= 86400",
    V,
)
def lag_bounded_edges(spark, sf_dir):
    return causal.lag_bounded_edges(causal.chain_pairs(timeseries.onsets(_metrics(spark, sf_dir))), 1440)


@query("causal_chains", f"WITH {HITS}, {FIRST}, {PAIRED}, {EDGES} SELECT * FROM edges", V)
def causal_chains(spark, sf_dir):
    return causal.causal_chains(_metrics(spark, sf_dir), window_minutes=WIDE)


@query(
    "edge_labels",
    f"""WITH {HITS}, {FIRST}, {PAIRED}, {EDGES}
    SELECT *, 'precedes by ' || CASE WHEN lag_seconds >= 60
        THEN CAST(lag_seconds // 60 AS VARCHAR) || 'm ' || CAST(lag_seconds % 60 AS VARCHAR) || 's'
        ELSE CAST(lag_seconds AS VARCHAR) || 's' END AS label FROM edges""",
    V,
)
def edge_labels(spark, sf_dir):
    return causal.edge_labels(causal.causal_chains(_metrics(spark, sf_dir), window_minutes=WIDE))


@query(
    "first_breach",
    f"""WITH lim AS (SELECT service, metric, max(value) * 0.5 AS threshold FROM v_metrics GROUP BY ALL)
    SELECT service, metric, {stamp('min(ts)')} AS breach_ts, arg_min(value, ts) AS breach_value
    FROM v_metrics JOIN lim USING (service, metric) WHERE value >= threshold GROUP BY service, metric""",
    V,
)
def first_breach(spark, sf_dir):
    metrics = _metrics(spark, sf_dir)
    return timeseries.first_breach(metrics, _thresholds(metrics))


@query(
    "breach_lead",
    f"""WITH {HITS}, {FIRST}, {PAIRED}, {EDGES}, {SERIES_FIRST},
    lim AS (SELECT service, metric, max(value) * 0.5 AS threshold FROM v_metrics GROUP BY ALL),
    br AS (SELECT service, metric, min(ts) AS breach_ts FROM v_metrics JOIN lim USING (service, metric)
           WHERE value >= threshold GROUP BY ALL)
    SELECT cause_service, 'm0' AS cause_metric, effect_service, 'm1' AS effect_metric,
           {stamp('onset_ts')} AS onset_ts, {stamp('breach_ts')} AS breach_ts,
           round((epoch_us(breach_ts) - epoch_us(onset_ts)) / 1e6, 9) AS lead_seconds
    FROM edges JOIN sfirst f ON f.service = cause_service AND f.metric = 'm0'
    JOIN br ON br.service = effect_service AND br.metric = 'm1'""",
    V,
)
def breach_lead(spark, sf_dir):
    metrics = _metrics(spark, sf_dir)
    pairs = causal.causal_chains(metrics, window_minutes=WIDE).select(
        "cause_service", F.lit("m0").alias("cause_metric"), "effect_service", F.lit("m1").alias("effect_metric")
    )
    return timeseries.breach_lead(metrics, _thresholds(metrics), pairs)


@query(
    "constant_series",
    """SELECT service, metric, min(value) AS value, count(*) AS n_rows FROM v_metrics
    GROUP BY service, metric HAVING stddev_pop(value) = 0""",
    V,
)
def constant_series(spark, sf_dir):
    return timeseries.constant_series(_metrics(spark, sf_dir))


@query(
    "tick_batches",
    f"""SELECT {stamp('ts')} AS ts, service, metric, value, count(*) OVER (PARTITION BY ts) AS batch_rows
    FROM v_metrics""",
    V,
)
def tick_batches(spark, sf_dir):
    return recording.tick_batches(_metrics(spark, sf_dir))


@query(
    "replay_schedule",
    f"""WITH t AS (SELECT ts, count(*) AS n_rows FROM v_metrics GROUP BY ts)
    SELECT {stamp('ts')} AS ts, n_rows,
      round(coalesce((epoch_us(lead(ts) OVER (ORDER BY ts)) - epoch_us(ts)) / 1e6 / 100, 0), 9) AS wait_seconds,
      round((epoch_us(ts) - epoch_us(min(ts) OVER ())) / 1e6 / 100, 9) AS offset_seconds FROM t""",
    V,
)
def replay_schedule(spark, sf_dir):
    return recording.replay_schedule(_metrics(spark, sf_dir), 100.0)


@query(
    "replay_summary",
    """SELECT count(*) AS n_rows, count(DISTINCT ts) AS n_ticks,
      round((epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6, 9) AS window_seconds,
      round((epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6 / 100, 9) AS wall_seconds FROM v_metrics""",
    V,
)
def replay_summary(spark, sf_dir):
    return recording.replay_summary(_metrics(spark, sf_dir), 100.0)


@query(
    "grid_check",
    f"""WITH g AS (SELECT service, metric, ts, lag(ts) OVER (PARTITION BY service, metric ORDER BY ts) AS p FROM v_metrics)
    SELECT service, metric, {stamp('ts')} AS ts, {stamp('p')} AS previous_ts,
           round((epoch_us(ts) - epoch_us(p)) / 1e6, 9) AS gap_seconds
    FROM g WHERE (epoch_us(ts) - epoch_us(p)) / 1e6 <> 5.0""",
    V,
)
def grid_check(spark, sf_dir):
    return recording.grid_check(_metrics(spark, sf_dir), 5.0)


@query(
    "series_coverage",
    """SELECT service, metric, count(*) AS n_rows, (SELECT count(DISTINCT ts) FROM v_metrics) AS n_ticks,
      count(*) = (SELECT count(DISTINCT ts) FROM v_metrics) AS complete FROM v_metrics GROUP BY service, metric""",
    V,
)
def series_coverage(spark, sf_dir):
    return recording.series_coverage(_metrics(spark, sf_dir))


@query(
    "baseline_bands",
    f"""WITH {HITS}, {SERIES_FIRST}
    SELECT service, metric, count(*) AS n_rows, min(value) AS low, max(value) AS high,
           round(avg(value), 9) AS mean, round(max(value) - min(value), 9) AS spread
    FROM v_metrics JOIN sfirst USING (service, metric) WHERE ts < onset_ts GROUP BY service, metric""",
    V,
)
def baseline_bands(spark, sf_dir):
    metrics = _metrics(spark, sf_dir)
    return recording.baseline_bands(metrics, timeseries.series_onsets(metrics))


@query(
    "saturation",
    f"""WITH lim AS (SELECT service, metric, max(value) AS top FROM v_metrics GROUP BY ALL),
    f AS (SELECT service, metric, top, min(ts) AS full_ts FROM v_metrics JOIN lim USING (service, metric)
          WHERE value = top GROUP BY ALL)
    SELECT f.service, f.metric, {stamp('f.full_ts')} AS full_ts,
           bool_and(m.value = f.top) AS pinned
    FROM f JOIN v_metrics m ON m.service = f.service AND m.metric = f.metric AND m.ts >= f.full_ts
    GROUP BY f.service, f.metric, f.full_ts""",
    V,
)
def saturation(spark, sf_dir):
    metrics = _metrics(spark, sf_dir)
    limits = metrics.groupBy("service", "metric").agg(F.max("value").alias("limit"))
    return recording.saturation(metrics, limits)


@query(
    "step_profile",
    f"""WITH {HITS}, {SERIES_FIRST},
    d AS (SELECT m.service, m.metric, m.value - lag(m.value) OVER (PARTITION BY m.service, m.metric ORDER BY m.ts) AS rise
          FROM v_metrics m JOIN sfirst f ON m.service = f.service AND m.metric = f.metric AND m.ts < f.onset_ts)
    SELECT service, metric, count(*) AS n_rows, round(max(rise), 9) AS largest_rise,
           count(*) FILTER (WHERE rise > 0) AS rising_steps FROM d GROUP BY service, metric""",
    V,
)
def step_profile(spark, sf_dir):
    metrics = _metrics(spark, sf_dir)
    intervals = timeseries.series_onsets(metrics).select(
        "service", "metric", F.timestamp_seconds(F.lit(0)).alias("start_ts"), F.col("onset_ts").alias("end_ts")
    )
    return recording.step_profile(metrics, intervals)


@query(
    "climb_shape",
    f"""WITH {HITS}, {SERIES_FIRST},
    a AS (SELECT service, metric, max(CASE WHEN ts < onset_ts THEN value END) AS max_before,
                 min(CASE WHEN ts >= onset_ts + INTERVAL 60 SECOND THEN value END) AS min_after
          FROM v_metrics JOIN sfirst USING (service, metric) GROUP BY service, metric)
    SELECT *, coalesce(max_before < 60 AND min_after > max_before, false) AS ok FROM a""",
    V,
)
def climb_shape(spark, sf_dir):
    metrics = _metrics(spark, sf_dir)
    return recording.climb_shape(metrics, timeseries.series_onsets(metrics), 60.0)


@query(
    "metric_diff",
    f"""WITH e AS (SELECT ts, service, metric, CASE WHEN value > 200 THEN round(value + 1, 2) ELSE value END AS value FROM v_metrics)
    SELECT {stamp('ts')} AS ts, service, metric, value, 'unexpected' AS side FROM (FROM v_metrics EXCEPT ALL FROM e)
    UNION ALL
    SELECT {stamp('ts')} AS ts, service, metric, value, 'missing' AS side FROM (FROM e EXCEPT ALL FROM v_metrics)""",
    V,
)
def metric_diff(spark, sf_dir):
    metrics = _metrics(spark, sf_dir)
    drifted = F.when(F.col("value") > 200, F.round(F.col("value") + 1, 2)).otherwise(F.col("value"))
    return recording.metric_diff(metrics, metrics.withColumn("value", drifted))


@query(
    "spread_samples",
    f"""SELECT {stamp('ts + INTERVAL 1 SECOND * sample')} AS ts, service, metric, value, sample
    FROM v_metrics, (SELECT unnest(range(5)) AS sample)""",
    V,
)
def spread_samples(spark, sf_dir):
    return recording.spread_samples(_metrics(spark, sf_dir), 5, 5.0)
