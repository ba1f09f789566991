"""Rate limit, breaker and retries against plain Python, with hot keys cut into runs."""

from __future__ import annotations

import random
from datetime import datetime, timedelta, timezone

import pytest

from faultline.operators import alerts, telemetry

START = datetime(2024, 1, 1, tzinfo=timezone.utc)


def requests(spark, seed, gaps):
    """One client sends a third of everything."""
    rnd = random.Random(seed)
    rows, clocks = [], {}
    for number in range(600):
        client = "hot" if number % 3 == 0 else f"c{rnd.randrange(20)}"
        gap = rnd.choice(gaps)
        clocks[client] = clocks.get(client, 0) + gap
        rows.append((client, number, START + timedelta(seconds=clocks[client])))
    return spark.createDataFrame(rows, "client string, request_id bigint, ts timestamp"), rows


PAUSES = [0, 1, 1, 2, 5, 90]
NO_PAUSE = [0, 1, 2, 15]


@pytest.mark.parametrize("slice_rows, limit, gaps", [(10, 1, PAUSES), (10, 7, PAUSES), (50, 7, NO_PAUSE), (1_000_000, 7, PAUSES)])
def test_token_bucket(spark, slice_rows, limit, gaps):
    df, rows = requests(spark, limit, gaps)
    want, state = {}, {}
    for client, number, ts in sorted(rows, key=lambda row: (row[2], row[1])):
        now = ts.timestamp()
        tokens, last = state.get(client, (float(limit), now))
        tokens = min(float(limit), tokens + (now - last) * limit / 60.0)
        want[number] = tokens >= 1.0
        state[client] = (tokens - 1.0 if tokens >= 1.0 else tokens, now)
    got = alerts.token_bucket(df, limit, slice_rows=slice_rows).collect()
    assert {row["request_id"]: row["allowed"] for row in got} == want
    for row in got:
        assert (row["retry_after"] is None) == row["allowed"]
        assert row["allowed"] or row["retry_after_seconds"] >= 1
    assert not all(want.values()) and any(want.values())


@pytest.mark.parametrize("slice_rows, gaps", [(20, [1, 1, 3, 10, 40]), (40, [0, 1, 2]), (1_000_000, [1, 1, 3, 10, 40])])
def test_breaker(spark, slice_rows, gaps):
    rnd = random.Random(8)
    rows, clocks = [], {}
    for number in range(900):
        service = "hot" if number % 3 == 0 else f"s{rnd.randrange(6)}"
        clocks[service] = clocks.get(service, 0) + rnd.choice(gaps)
        rows.append((service, number, START + timedelta(seconds=clocks[service]), rnd.random() < 0.45))
    df = spark.createDataFrame(rows, "service string, call_id bigint, ts timestamp, ok boolean")
    want, fails, opened = {}, {}, {}
    for service, number, ts, ok in sorted(rows, key=lambda row: (row[2], row[1])):
        now, since = ts.timestamp(), opened.get(service)
        state = "closed" if since is None else ("half_open" if now - since >= 30 else "open")
        if state != "open":
            if ok:
                fails[service], opened[service] = 0, None
            else:
                fails[service] = fails.get(service, 0) + 1
                if fails[service] >= 5:
                    opened[service] = now
        want[number] = (state, state != "open", "closed" if opened.get(service) is None else "open")
    got = telemetry.breaker_states(df, slice_rows=slice_rows).collect()
    assert {row["call_id"]: (row["state"], row["runs"], row["state_after"]) for row in got} == want
    assert {state for state, _, _ in want.values()} == {"closed", "open", "half_open"}


@pytest.mark.parametrize("seed", range(40))
def test_outlined_runs_end_as_folded_ones(seed):
    rnd = random.Random(seed)
    failures, cooldown = rnd.randrange(1, 6), rnd.choice([0.0, 2.0, 30.0])
    step, outline, enter = telemetry.breaker_step(failures, cooldown), telemetry.breaker_outline(failures, cooldown), telemetry.breaker_enter(cooldown)
    now, calls = 100.0, []
    for _ in range(rnd.randrange(1, 60)):
        now += rnd.choice([0, 0.5, 1, 7, 40])
        calls.append((now, rnd.random() < rnd.choice([0.1, 0.5])))
    made = outline(calls)
    for state in [None, *[(n, None) for n in range(failures)], *[(failures, 100.0 - x) for x in (0, 0.1, 1.5, 12, 29.5, 30, 200)]]:
        want = state
        for call in calls:
            want, _ = step(want, call)
        assert enter(state, made)[1] == want[1] and (want[1] is not None or enter(state, made) == want)

    limit, window = rnd.choice([1, 3, 8]), rnd.choice([0.00001, 60.0])
    step, outline, enter = alerts.bucket_step(limit, window), alerts.bucket_outline(limit, window), alerts.bucket_enter(limit, window)
    unit = round(window * 1e6 / limit)
    now, requests = 1000 * unit, []
    for _ in range(rnd.randrange(1, 60)):
        now += rnd.choice([0, 1, unit // 3, unit, 2 * unit + 1, (limit + 1) * unit][: rnd.choice([3, 6])])
        requests.append((now,))
    made, (full, token) = outline(requests), alerts.bucket_sizes(limit, window)
    assert len(made["pieces"]) <= 6 * (limit + 1)
    for left in {0, 1, token - 1, token, token + 1, full - 1, full, *[rnd.randrange(full + 1) for _ in range(30)]}:
        for state in (None, (left, requests[0][0]), (left, requests[0][0] - unit // 2)):
            want = state
            for request in requests:
                want, _ = step(want, request)
            assert enter(state, made) == want


def test_a_throttled_client_takes_one_round(spark, monkeypatch):
    """Its bucket never forgets where it began; still no slice is folded again."""
    from faultline.plans import folds

    written = []
    monkeypatch.setattr(folds, "kept", lambda df, kept=folds.kept: written.append(1) or kept(df))
    rows = [("hot", n, START + timedelta(seconds=n * 0.7)) for n in range(4_000)]
    df = spark.createDataFrame(rows, "client string, request_id bigint, ts timestamp")
    whole = alerts.token_bucket(df, 7).collect()
    cut = alerts.token_bucket(df, 7, slice_rows=50).collect()
    assert sorted(map(tuple, cut), key=str) == sorted(map(tuple, whole), key=str)
    assert len(written) == 2 and 0.05 < sum(row["allowed"] for row in whole) / 4_000 < 0.2


def test_retries(spark):
    rows = [
        (1, 1, "error", 503), (1, 2, "error", None), (1, 3, "ok", None),
        (2, 1, "error", 404), (2, 2, "ok", None),
        (3, 1, "error", 500), (3, 2, "error", 500), (3, 3, "error", 500),
        (4, 1, "not_configured", None),
        (5, 1, "error", 429),
    ]
    df = spark.createDataFrame(rows, "call_id bigint, attempt int, outcome string, status int")
    got = {row["call_id"]: (row["result"], row["attempts"], row["wait_seconds"]) for row in telemetry.retry_outcomes(df).collect()}
    assert got == {
        1: ("ok", 3, 1.5),
        2: ("degraded", 1, 0.0),
        3: ("degraded", 3, 1.5),
        4: ("not_configured", 1, 0.0),
        5: ("pending", 1, 0.0),
    }


def test_spans(spark):
    rows = [("a", "ERROR" if i % 4 == 0 else "DEFAULT", float(i)) for i in range(100)]
    got = telemetry.span_rollup(spark.createDataFrame(rows, "name string, level string, duration_ms double"), 10).first()
    assert (got["calls"], got["errors"], got["p50_ms"]) == (100, 25, 49.5)
    assert got["p95_ms"] == pytest.approx(94.05)
