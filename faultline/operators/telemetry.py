"""Call telemetry: span statistics, circuit-breaker states, retry outcomes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultline.functions import vocab
from faultline.plans.folds import fold_slices
from faultline.plans.quantiles import exact_quantiles
from faultline.plans.slices import SLICE_ROWS


def span_rollup(spans: DataFrame, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """Calls, errors and exact latency quantiles per span name (name, level, duration_ms)."""
    counts = spans.groupBy("name").agg(
        F.count(F.lit(1)).alias("calls"), F.count_if(F.col("level") == "ERROR").alias("errors")
    )
    marks = exact_quantiles(spans, ["name"], "duration_ms", {"p50_ms": 0.5, "p95_ms": 0.95}, slice_rows)
    return counts.join(marks, "name", "left")


def breaker_step(failures_to_open: int, cooldown: float):
    """One call against a breaker: state is (failures in a row, opened at)."""

    def step(state, value):
        now, ok = value
        failures, opened = state or (0, None)
        if opened is None:
            seen = "closed"
        else:
            seen = "half_open" if now - opened >= cooldown else "open"
        if seen == "open":
            return (failures, opened), (seen, False, "open")
        if ok:
            return (0, None), (seen, True, "closed")
        failures += 1
        opened = now if failures >= failures_to_open else opened
        return (failures, opened), (seen, True, "closed" if opened is None else "open")

    return step


def breaker_outline(failures_to_open: int, cooldown: float):
    """What a run of calls does to any breaker state.

    A closed breaker has one of `failures_to_open` counts, so it ends in one of as many states. One
    that was opened before the run ends as if its probe were the first call late enough: the run
    gives the last time of every stretch of calls that, as probes, lead to one end.
    """

    def outline(calls: list[tuple[float, bool]]) -> dict:
        n = len(calls)
        probe, at = [n] * n, 0  # the first call that may try again after each
        for j, (opened, _) in enumerate(calls):
            at = max(at, j + 1)
            while at < n and not calls[at][0] - opened >= cooldown:
                at += 1
            probe[j] = at
        closed = [(count, None) for count in range(failures_to_open)]
        ends: list[tuple | None] = [None] * n
        for j in range(n - 1, -1, -1):
            now, ok = calls[j]
            if ok:
                ends[j] = closed[0]
                closed = [closed[0]] * failures_to_open
            else:
                ends[j] = ends[probe[j]] if probe[j] < n else (failures_to_open, now)
                closed = [*closed[1:], ends[j]]
        times, then = [], []
        for j, (now, _) in enumerate(calls):
            if then and then[-1] == ends[j]:
                times[-1] = now
            else:
                times.append(now)
                then.append(ends[j])
            if now - calls[0][0] >= cooldown:  # no breaker that was opened before waits longer
                break
        return {"closed": closed, "times": times, "then": then}

    return outline


def breaker_enter(cooldown: float):
    """The state that an outlined run leaves after a given one."""

    def enter(state: tuple | None, outlined: dict) -> tuple:
        failures, opened = state or (0, None)
        if opened is None:
            return tuple(outlined["closed"][failures])
        for now, end in zip(outlined["times"], outlined["then"]):
            if now - opened >= cooldown:
                return tuple(end)
        return failures, opened

    return enter


def breaker_states(
    calls: DataFrame,
    failures_to_open: int = vocab.BREAKER_FAILURES,
    cooldown: float = vocab.BREAKER_COOLDOWN,
    slice_rows: int = SLICE_ROWS,
) -> DataFrame:
    """Breaker state each call (service, call_id, ts, ok) meets, whether it runs, and what it leaves.

    A service that holds most calls is folded in slices; what each does to any state is found first.
    """
    if failures_to_open < 1:
        raise ValueError(f"failures_to_open must be at least 1, got {failures_to_open}")
    at = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    return fold_slices(
        calls.select("service", "call_id", "ts", "ok", at.alias("t")),
        ["service"],
        "ts",
        ["call_id"],
        breaker_step(failures_to_open, cooldown),
        breaker_outline(failures_to_open, cooldown),
        breaker_enter(cooldown),
        ["t", "ok"],
        ["state", "runs", "state_after"],
        "service string, call_id bigint, state string, runs boolean, state_after string",
        ["service", "call_id"],
        slice_rows,
    )


def retry_outcomes(
    attempts: DataFrame,
    max_attempts: int = vocab.RETRY_ATTEMPTS,
    backoff_base: float = vocab.BACKOFF_BASE,
) -> DataFrame:
    """How each call ended, from its attempts (call_id, attempt, outcome, status).

    `outcome` is ok, error or not_configured. An error with a transient status, or with none
    (transport), is tried again; any other ends the call. Waits double from `backoff_base`.
    """
    if max_attempts < 1:
        raise ValueError(f"max_attempts must be at least 1, got {max_attempts}")
    transient = (F.col("outcome") == "error") & (
        F.col("status").isNull() | F.col("status").isin(*vocab.TRANSIENT_STATUS)
    )
    ends = ~transient | (F.col("attempt") >= max_attempts)
    end = F.struct("attempt", "outcome", "status")
    last = attempts.groupBy("call_id").agg(
        F.min(F.when(ends, end)).alias("e"), F.max("attempt").alias("seen")
    )
    used = F.coalesce(F.col("e.attempt"), F.col("seen"))
    result = (
        F.when(F.col("e").isNull(), "pending")
        .when(F.col("e.outcome") == "error", "degraded")
        .otherwise(F.col("e.outcome"))
    )
    return last.select(
        "call_id",
        result.alias("result"),
        used.cast("bigint").alias("attempts"),
        F.col("e.status").cast("bigint").alias("status"),
        (F.lit(backoff_base) * (F.pow(F.lit(2.0), used - 1) - 1)).alias("wait_seconds"),
    )
