"""Onsets against an independent Python rule, and edge cases of chains and recordings."""

from __future__ import annotations

import math
import random
from datetime import datetime, timedelta, timezone

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from faultline.operators import causal, recording, timeseries
from faultline.streaming.stateful import first_anomaly

START = datetime(2024, 1, 1, tzinfo=timezone.utc)
SCHEMA = "ts timestamp, service string, metric string, value double"


def series(service, metric, values, step=5.0, start=0.0):
    return [(START + timedelta(seconds=start + i * step), service, metric, float(v)) for i, v in enumerate(values)]


def frame(spark, *parts):
    return spark.createDataFrame([row for part in parts for row in part], SCHEMA)


def onset_of(values, threshold=3.0, rows=60, least=12):
    """Independent of both implementations: plain two-pass statistics per sample."""
    for at, value in enumerate(values):
        past = values[max(0, at - rows) : at]
        if len(past) < least or max(past) == min(past):
            continue
        mean = math.fsum(past) / len(past)
        spread = math.sqrt(math.fsum((v - mean) ** 2 for v in past) / len(past))
        if (value - mean) / spread > threshold:
            return at
    return None


def noise(seed, n, base=100.0, width=5.0):
    rnd = random.Random(seed)
    return [round(base + rnd.uniform(-width, width), 2) for _ in range(n)]


def test_onset_index_matches_rule_on_many_series(spark):
    rnd = random.Random(1)
    data, want = [], {}
    for number in range(40):
        values = noise(number, rnd.choice([5, 12, 13, 80, 200]))
        if number % 3 == 0 and len(values) > 40:
            values[35:] = [v + 40 for v in values[35:]]
        if number % 7 == 0:
            values = [50.0] * len(values)
        data.append(series(f"s{number}", "m", values))
        want[f"s{number}"] = onset_of(values)
    got = timeseries.onset_index(frame(spark, *data), slice_rows=30).collect()
    assert {row["service"]: row["onset_index"] for row in got} == want


@given(st.lists(st.integers(0, 400), min_size=0, max_size=120), st.integers(0, 100))
@settings(max_examples=200, deadline=None, suppress_health_check=[HealthCheck.too_slow])
def test_stream_step_matches_rule(values, split):
    import numpy as np

    values = [float(v) for v in values]
    split = min(split, len(values))
    first = first_anomaly(np.array([]), np.array(values[:split]), 3.0, 60, 12)
    if first is None and split < len(values):
        rest = first_anomaly(np.array(values[:split][-60:]), np.array(values[split:]), 3.0, 60, 12)
        first = None if rest is None else split + rest
    assert first == onset_of(values)


def test_twelve_rows_are_needed(spark):
    before = noise(3, 12)
    assert onset_of(before + [500.0]) == 12
    got = timeseries.onset_index(frame(spark, series("a", "m", before + [500.0]), series("b", "m", before[:11] + [500.0])))
    assert {row["service"]: row["onset_index"] for row in got.collect()} == {"a": 12, "b": None}


def test_drops_and_constants_never_fire(spark):
    low = noise(4, 40) + [0.0] * 20
    rows = frame(spark, series("drop", "m", low), series("flat", "m", [100.0] * 60 + [100.0]))
    assert timeseries.onsets(rows).where("service = 'flat'").count() == 0
    assert timeseries.onset_index(rows).where("service = 'drop'").first()["onset_index"] == onset_of(low)
    flat = timeseries.constant_series(rows).collect()
    assert [(row["service"], row["value"], row["n_rows"]) for row in flat] == [("flat", 100.0, 61)]


def test_service_onset_is_the_earliest_of_its_metrics(spark):
    late, early = noise(5, 60) + [500.0], noise(6, 30) + [500.0]
    rows = frame(spark, series("a", "late", late), series("a", "early", early))
    assert timeseries.onsets(rows).first()["onset_ts"] == START.replace(tzinfo=None) + timedelta(seconds=150)


def test_bad_parameters(spark):
    rows = frame(spark, series("a", "m", [1.0]))
    for rows_back, least in ((1, 2), (10, 1), (10, 11)):
        with pytest.raises(ValueError):
            causal.causal_chains(rows, baseline_rows=rows_back, min_rows=least)
    with pytest.raises(ValueError):
        recording.replay_schedule(rows, 0)
    with pytest.raises(ValueError):
        recording.spread_samples(rows, 0, 5.0)


def edges(spark, *onsets, minutes=15):
    rows = [(name, START + timedelta(seconds=at)) for name, at in onsets]
    found = causal.lag_bounded_edges(causal.chain_pairs(spark.createDataFrame(rows, "service string, onset_ts timestamp")), minutes)
    return [tuple(row) for row in found.collect()]


def test_chain_bounds(spark):
    assert edges(spark, ("a", 0), ("b", 60), minutes=1) == [("a", "b", 60)]
    assert edges(spark, ("a", 0), ("b", 61), minutes=1) == []
    # equal onsets have no lag, and the dropped pair is not bridged
    assert edges(spark, ("a", 0), ("b", 0), ("c", 30)) == [("b", "c", 30)]
    # boundaries of seconds count, not elapsed time
    assert edges(spark, ("a", 0.9), ("b", 2.1)) == [("a", "b", 2)]
    assert edges(spark, ("only", 5)) == []


def test_empty_metrics(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert causal.causal_chains(empty).collect() == []
    assert recording.replay_summary(empty, 1.0).first()["n_ticks"] == 0


def test_incident_recording(spark):
    """240 ticks, four series: the pool climbs, then latency, then the service downstream."""
    rnd = random.Random(42)
    pool = [40 + rnd.uniform(-5, 5) + max(0, min(60, (i - 130) * 1.5)) for i in range(240)]
    pool = [min(99.0, round(v, 1)) if i < 175 else 100.0 for i, v in enumerate(pool)]
    pay = [round(180 + rnd.uniform(-20, 20) + max(0, i - 160) * 60, 1) for i in range(240)]
    shop = [round(150 + rnd.uniform(-15, 15) + max(0, i - 170) * 25, 1) for i in range(240)]
    rows = frame(
        spark,
        series("db", "pool_used", pool),
        series("db", "pool_max", [100.0] * 240),
        series("pay", "p99", pay),
        series("shop", "p99", shop),
    )
    chain = [(row["cause_service"], row["effect_service"]) for row in causal.causal_chains(rows, 20).collect()]
    assert chain == [("db", "pay"), ("pay", "shop")]
    assert recording.grid_check(rows, 5.0).count() == 0
    assert {row["complete"] for row in recording.series_coverage(rows).collect()} == {True}
    limit = spark.createDataFrame([("db", "pool_used", 100.0)], "service string, metric string, limit double")
    full = recording.saturation(rows, limit).first()
    assert full["pinned"] and full["full_ts"] <= START.replace(tzinfo=None) + timedelta(seconds=900)
    assert [row["service"] for row in timeseries.constant_series(rows).collect()] == ["db"]
    summary = recording.replay_summary(rows, 100.0).first()
    assert (summary["n_rows"], summary["n_ticks"], summary["window_seconds"]) == (960, 240, 1195.0)
    assert recording.metric_diff(rows, rows.withColumn("value", F.col("value"))).count() == 0


def test_spread_and_schedule(spark):
    rows = frame(spark, series("a", "m", [1.0, 2.0, 3.0], step=10.0))
    spread = recording.spread_samples(rows, 4, 10.0).orderBy("ts").collect()
    assert [row["ts"].second + row["ts"].microsecond / 1e6 for row in spread][:5] == [0.0, 2.5, 5.0, 7.5, 10.0]
    ticks = recording.replay_schedule(rows, 2.0, slice_rows=2).orderBy("ts").collect()
    assert [(row["wait_seconds"], row["offset_seconds"]) for row in ticks] == [(5.0, 0.0), (5.0, 5.0), (0.0, 10.0)]


def test_labels(spark):
    rows = spark.createDataFrame([(250,), (55,), (60,)], "lag_seconds bigint")
    assert [row["label"] for row in causal.edge_labels(rows).collect()] == [
        "precedes by 4m 10s",
        "precedes by 55s",
        "precedes by 1m 0s",
    ]
