"""Keyed state for streams: sequential folds and rolling baselines.

Rows of a key are put in time order across micro-batches: they wait until the watermark has passed
them. A row older than what its key has already released is late: it changes no state and comes
out marked. Folds handle many keys in one lane, and keep the states of some keys in one block, for a
call per key and micro-batch, or per key's state, costs far more than its rows.
"""

from __future__ import annotations

import json
import math
import zlib
from collections.abc import Callable, Iterable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from faultline.functions import vocab


STRETCH = 60.0  # seconds of a key's rows that are released together
OUT_ROWS = 10_000
LANES = 1_024  # keys of a fold share so many groups; a checkpoint holds for this number
BLOCK_KEYS = 64  # keys whose states are read and written at once, on average
LANE, KEY = "lane_of_keys", "key_text"


def seconds(column: str) -> Column:
    return F.unix_micros(F.col(column).cast("timestamp")) / 1e6


def _filled(value):
    return None if value is None or (isinstance(value, float) and np.isnan(value)) else value


class Ordered(StatefulProcessor):
    """Holds a group's rows until the watermark has passed their stretch of time, then hands them on in order.

    Rows arrive in Arrow batches and are put away one batch at a time, by stretch. A timer at the end
    of the oldest stretch releases all that are over, one after the other, so the rows of one stretch
    are the most that is in memory. Rows older than what was released are late.
    """

    def __init__(self, time: str, tie: Sequence[str], others: Sequence[str], stretch: float) -> None:
        self.order, self.columns, self.stretch = 1 + len(tie), list(dict.fromkeys([time, *tie, *others])), stretch

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.parts = handle.getMapState("parts", "stretch bigint, part bigint", "rows string")
        self.held = handle.getValueState("held", "parts string, released double, timer bigint")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        parts, released, timer = self.load()
        for frame in rows:
            late = self.is_late(frame, released)
            if late.any():
                yield from self.late(key, frame[late])
            fresh = frame[~late]
            place = np.floor(fresh[self.columns[0]].to_numpy(dtype="float64") / self.stretch).astype("int64")
            for stretch in np.unique(place):
                own = fresh[place == stretch]
                packed = json.dumps(list(zip(*[own[name].tolist() for name in self.columns])))
                self.parts.updateValue((int(stretch), parts.get(int(stretch), 0)), (packed,))
                parts[int(stretch)] = parts.get(int(stretch), 0) + 1
        self.store(parts, released, timer)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        parts, released, _ = self.load()
        passed = timerValues.getCurrentWatermarkInMs() / 1000
        for stretch in sorted(parts):
            if (stretch + 1) * self.stretch > passed:
                break
            rows = []
            for part in range(parts.pop(stretch)):
                rows += json.loads(self.parts.getValue((stretch, part))[0])
                self.parts.removeKey((stretch, part))
            end = (stretch + 1) * self.stretch
            yield from self.advance(key, rows, end)
            released = max(released, end)
        self.store(parts, released, None)

    def load(self) -> tuple[dict[int, int], float, int | None]:
        if not self.held.exists():
            return {}, -np.inf, None
        parts, released, timer = self.held.get()
        return {int(n): count for n, count in json.loads(parts).items()}, released, _filled(timer)

    def store(self, parts: dict[int, int], released: float, timer: int | None) -> None:
        wanted = math.ceil((min(parts) + 1) * self.stretch * 1000) if parts else None
        if wanted != timer:
            if timer is not None:
                self.handle.deleteTimer(int(timer))
            if wanted is not None:
                self.handle.registerTimer(wanted)
        self.held.update((json.dumps(parts), released, wanted))

    def is_late(self, frame: pd.DataFrame, released: float) -> np.ndarray:
        return (frame[self.columns[0]] < released).to_numpy()

    def in_order(self, rows: list) -> list:
        return sorted(rows, key=lambda row: row[: self.order])

    def late(self, key, frame: pd.DataFrame) -> Iterator[pd.DataFrame]:
        raise NotImplementedError

    def advance(self, key, rows: list, end: float) -> Iterator[pd.DataFrame]:
        raise NotImplementedError

    def close(self) -> None:
        pass


class Fold(Ordered):
    """Runs `step(state, inputs) -> (state, outputs)` over the rows of a key in order.

    A group is a lane of keys. Its rows are put away together; each key has its own state, and
    its own time up to which rows were released. States lie in blocks of keys, by the last bits of a
    hash; as keys get more, every block is dealt over two or more.
    """

    def __init__(
        self,
        step: Callable,
        time: str,
        inputs: Sequence[str],
        outputs: Sequence[str],
        keep: Sequence[str],
        tie: Sequence[str],
        stretch: float,
    ) -> None:
        super().__init__(time, tie, [*inputs, *keep, KEY], stretch)
        self.step, self.outputs, self.keep = step, list(outputs), list(keep)
        self.inputs, self.kept = [self.columns.index(name) for name in inputs], [self.columns.index(name) for name in keep]
        self.key = self.columns.index(KEY)

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.states = handle.getMapState("states", "block bigint", "keys string")  # key -> (released, *state)
        self.size = handle.getValueState("size", "keys bigint, blocks bigint")

    def block(self, block: int) -> dict[str, list]:
        found = self.states.getValue((block,))
        return json.loads(found[0]) if found else {}

    def put(self, block: int, states: dict[str, list]) -> None:
        self.states.updateValue((block,), (json.dumps(states),))

    def sizes(self) -> tuple[int, int]:
        return self.size.get() if self.size.exists() else (0, 1)

    def by_block(self, keys: Iterable[str], blocks: int) -> dict[int, list[str]]:
        out = {}
        for key in keys:
            out.setdefault(zlib.crc32(key.encode()) % blocks, []).append(key)
        return out

    def resize(self, keys: int, blocks: int) -> None:
        """Store both numbers, and deal every block over as many as keep the mean at BLOCK_KEYS."""
        more = blocks
        while keys > BLOCK_KEYS * more:
            more *= 2
        for block in range(blocks if more > blocks else 0):
            states = self.block(block)
            self.states.removeKey((block,))
            for place, names in self.by_block(states, more).items():
                self.put(place, {name: states[name] for name in names})
        self.size.update((keys, more))

    def is_late(self, frame: pd.DataFrame, released: float) -> np.ndarray:
        late = super().is_late(frame, released)
        if late.any():  # older than what the lane has released: the key's own time decides
            old, own = frame[late], {}
            for block, names in self.by_block(old[KEY].unique(), self.sizes()[1]).items():
                states = self.block(block)
                own.update((name, states.get(name, (-np.inf,))[0]) for name in names)
            late[late] = (old[self.columns[0]] < old[KEY].map(own)).to_numpy()
        return late

    def late(self, key, frame: pd.DataFrame) -> Iterator[pd.DataFrame]:
        yield frame[self.keep].assign(**dict.fromkeys(self.outputs), late=True)

    def advance(self, key, rows: list, end: float) -> Iterator[pd.DataFrame]:
        keys, made = {}, []
        for row in rows:
            keys.setdefault(row[self.key], []).append(row)
        known, blocks = self.sizes()
        for block, names in self.by_block(keys, blocks).items():
            states = self.block(block)
            for name in names:
                known += name not in states
                released, *state = states.get(name, (-np.inf, None))
                state = None if released == -np.inf else tuple(_filled(part) for part in state)
                for row in self.in_order(keys[name]):
                    state, out = self.step(state, tuple(_filled(row[n]) for n in self.inputs))
                    made.append((*[row[n] for n in self.kept], *out, False))
                    if len(made) == OUT_ROWS:
                        yield self.made(made)
                        made = []
                states[name] = (max(released, end), *state)
            self.put(block, states)
        self.resize(known, blocks)
        if made:
            yield self.made(made)

    def made(self, rows: list) -> pd.DataFrame:
        return pd.DataFrame(rows, columns=[*self.keep, *self.outputs, "late"])


def fold_stream(
    stream: DataFrame,
    keys: Sequence[str],
    step: Callable,
    time: str,
    inputs: Sequence[str],
    outputs: Sequence[str],
    keep: Sequence[str],
    schema: str,
    tie: Sequence[str] = (),
    stretch: float = STRETCH,
) -> DataFrame:
    """A fold over a stream that has a watermark; `time` holds epoch seconds. Rows come out once the
    watermark has passed their stretch."""
    lane = F.pmod(F.xxhash64(*keys), F.lit(LANES)).alias(LANE)
    return stream.select("*", F.to_json(F.struct(*keys)).alias(KEY), lane).groupBy(LANE).transformWithStateInPandas(
        statefulProcessor=Fold(step, time, inputs, outputs, keep, tie, stretch),
        outputStructType=schema,
        outputMode="Append",
        timeMode="EventTime",
    )


def first_anomaly(
    past: np.ndarray, values: np.ndarray, threshold_z: float, baseline_rows: int, min_rows: int
) -> int | None:
    """Index in `values` of the first one above its baseline, which reaches back into `past`."""
    series = np.concatenate([past, values])
    padded = np.concatenate([np.full(baseline_rows, np.nan), series])
    frames = np.lib.stride_tricks.sliding_window_view(padded, baseline_rows)[len(past) : len(series)]
    known = ~np.isnan(frames)
    n = known.sum(axis=1)
    filled = np.where(known, frames, 0.0)
    size = np.maximum(n, 1)
    mean = filled.sum(axis=1) / size
    spread = np.where(known, frames - mean[:, None], 0.0)
    std = np.sqrt((spread**2).sum(axis=1) / size)
    # rounding must not turn a constant baseline into a spread
    low = np.where(known, frames, np.inf).min(axis=1)
    high = np.where(known, frames, -np.inf).max(axis=1)
    usable = (n >= min_rows) & (high > low) & (std > 0)
    z = (values - mean) / np.where(usable, std, 1.0)
    hits = np.flatnonzero(usable & (z > threshold_z))
    return int(hits[0]) if len(hits) else None


class Onset(Ordered):
    """Emits the first anomaly of a series, keeping the last `baseline_rows` values as state."""

    def __init__(self, threshold_z: float, baseline_rows: int, min_rows: int, stretch: float) -> None:
        super().__init__("t", ["value"], [], stretch)
        self.threshold_z, self.baseline_rows, self.min_rows = threshold_z, baseline_rows, min_rows

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.ring = handle.getListState("ring", "v double")
        self.found = handle.getValueState("found", "found boolean")

    def late(self, key, frame: pd.DataFrame) -> Iterator[pd.DataFrame]:
        yield self.row(key, None, len(frame))

    def row(self, key, onset: float | None, late: int) -> pd.DataFrame:
        return pd.DataFrame({"service": [key[0]], "metric": [key[1]], "onset": [onset], "late_rows": [late]}).astype({"onset": "float64"})

    def advance(self, key, rows: list, end: float) -> Iterator[pd.DataFrame]:
        if self.found.exists():
            return
        rows = self.in_order(rows)
        past = np.array([row[0] for row in self.ring.get()] if self.ring.exists() else [], dtype="float64")
        values = np.array([row[1] for row in rows], dtype="float64")
        index = first_anomaly(past, values, self.threshold_z, self.baseline_rows, self.min_rows)
        if index is not None:
            self.found.update((True,))
            self.ring.clear()
            yield self.row(key, rows[index][0], 0)
            return
        self.ring.put([(float(value),) for value in np.concatenate([past, values])[-self.baseline_rows :]])


def stream_onsets(
    metrics: DataFrame,
    delay: str = "0 seconds",
    threshold_z: float = vocab.THRESHOLD_Z,
    baseline_rows: int = vocab.BASELINE_ROWS,
    min_rows: int = vocab.MIN_BASELINE_ROWS,
    stretch: float = STRETCH,
) -> DataFrame:
    """Onsets of a metrics stream, one row per series (onset in epoch seconds), plus late counts.

    `metrics` has (service, metric, ts, value). Rows may come in any order within `delay`.
    """
    return (
        metrics.withWatermark("ts", delay)
        .select("service", "metric", seconds("ts").alias("t"), "value")
        .groupBy("service", "metric")
        .transformWithStateInPandas(
            statefulProcessor=Onset(threshold_z, baseline_rows, min_rows, stretch),
            outputStructType="service string, metric string, onset double, late_rows bigint",
            outputMode="Append",
            timeMode="EventTime",
        )
    )
