"""Streams fed in several micro-batches end where the batch operators end."""

from __future__ import annotations

import random
from datetime import datetime, timedelta, timezone

from pyspark.sql import functions as F

from faultline.operators import alerts, telemetry, timeseries
from faultline.session import prepare, scratch_path
from faultline.streaming import live, stateful
from suite.streams import settle_stream

START = datetime(2024, 1, 1, tzinfo=timezone.utc)


def feed(spark, df, cuts, order="ts"):
    """A stream that delivers `df` in time-ordered files, one per micro-batch."""
    prepare(spark)
    path = scratch_path(spark, "feed")
    for low, high in zip(cuts, cuts[1:]):
        df.where((F.col(order) >= low) & (F.col(order) < high)).coalesce(1).write.mode("append").parquet(path)
    schema = ", ".join(f"{field.name} {field.dataType.simpleString()}" for field in df.schema)
    return live.replay_stream(spark, path, schema)


def closed(df, minutes=10_000, **key):
    """With a last row, of a key of its own, that moves the watermark past all others."""
    last = df.limit(1).withColumns({"ts": F.lit(START + timedelta(minutes=minutes)), **{name: F.lit(value) for name, value in key.items()}})
    return df.unionByName(last)


def times(*minutes):
    return [F.lit(START + timedelta(minutes=m)) for m in minutes]


def test_onsets(spark):
    rnd = random.Random(3)
    rows = []
    for number in range(6):
        for i in range(150):
            lift = 80 if i >= 60 + 10 * number else 0
            rows.append((START + timedelta(seconds=i * 60 + number), f"s{number // 2}", f"m{number}", rnd.uniform(90, 110) + lift))
    df = spark.createDataFrame(rows, "ts timestamp, service string, metric string, value double")
    stream = feed(spark, closed(df, service="end"), times(0, 40, 70, 1000, 20_000))
    got = settle_stream(spark, stateful.stream_onsets(stream), "onsets").collect()
    want = timeseries.series_onsets(df).select("service", "metric", live.seconds("onset_ts").alias("t")).collect()
    assert sorted((r["service"], r["metric"], r["onset"]) for r in got) == sorted((r["service"], r["metric"], r["t"]) for r in want)
    assert len(got) == 6 and not any(row["late_rows"] for row in got)


def test_late_rows_are_counted_and_change_nothing(spark):
    rows = [(START + timedelta(seconds=i), "s", "m", 100.0 + i % 3) for i in range(60)]
    df = spark.createDataFrame(rows, "ts timestamp, service string, metric string, value double")
    prepare(spark)
    path = scratch_path(spark, "late")
    later, earlier = df.where(F.second("ts") >= 30), df.where(F.second("ts") < 30)
    end = closed(df, service="end").where("service = 'end'")
    # the watermark of a file counts from the next one on
    for part in (later, end, end, earlier.withColumn("value", F.lit(9_000.0)), end.withColumn("ts", F.lit(START + timedelta(days=30)))):
        part.coalesce(1).write.mode("append").parquet(path)
    stream = live.replay_stream(spark, path, "ts timestamp, service string, metric string, value double")
    got = settle_stream(spark, stateful.stream_onsets(stream), "onsets").collect()
    assert [(row["onset"], row["late_rows"]) for row in got] == [(None, 30)]


def test_states(spark):
    log = [
        ("a", 1, "alert.received", "{}"),
        ("a", 2, "state.transition", '{"from":"INVESTIGATING","to":"RESOLVED"}'),
        ("a", 3, "state.transition", '{"from":"INVESTIGATING","to":"MITIGATING"}'),
        ("a", 4, "state.transition", '{"from":"MITIGATING","to":"MITIGATING"}'),
        ("a", 5, "state.transition", '{"from":"MITIGATING","to":"RESOLVED"}'),
        ("a", 6, "incident.opened", "{}"),
        ("b", 7, "state.transition", '{"to":"MITIGATING"}'),
    ]
    rows = [(START + timedelta(minutes=seq), incident, seq, kind, payload) for incident, seq, kind, payload in log]
    df = spark.createDataFrame(rows, "ts timestamp, incident_id string, seq bigint, event_type string, payload string")
    stream = feed(spark, closed(df, incident_id="end"), times(0, 3, 5, 100, 20_000))
    got = {row["seq"]: (row["state"], row["accepted"]) for row in settle_stream(spark, live.stream_states(stream), "states").collect()}
    assert got == {
        1: ("INVESTIGATING", True),
        2: ("INVESTIGATING", False),
        3: ("MITIGATING", True),
        4: ("MITIGATING", False),
        5: ("RESOLVED", True),
        6: ("RESOLVED", True),
        7: (None, False),
    }


def test_limits_and_breakers(spark):
    rnd = random.Random(4)
    rows = [(START + timedelta(seconds=i * 9), f"c{rnd.randrange(3)}", i, rnd.random() < 0.4) for i in range(300)]
    df = spark.createDataFrame(rows, "ts timestamp, client string, request_id bigint, ok boolean")
    stream = feed(spark, closed(df, client="end"), times(0, 10, 25, 100, 20_000))
    got = settle_stream(spark, live.stream_token_bucket(stream, 1), "limits")
    want = alerts.token_bucket(df, 1)
    shown = ["client", "request_id", "allowed"]
    assert sorted(map(tuple, got.select(shown).collect())) == sorted(map(tuple, want.select(shown).collect()))
    calls = df.select("ts", F.col("client").alias("service"), F.col("request_id").alias("call_id"), "ok")
    got = settle_stream(spark, live.stream_breaker_states(feed(spark, closed(calls, service="end"), times(0, 10, 25, 100, 20_000)), 2), "breakers")
    want = telemetry.breaker_states(calls, 2)
    assert sorted(map(tuple, got.drop("late").collect())) == sorted(map(tuple, want.collect()))


def test_dedupe_across_batches(spark):
    rows = [(i, START + timedelta(minutes=i), f"k{i % 4}", "s", "m", 1.0, START, None) for i in range(12)]
    df = spark.createDataFrame(
        rows,
        "delivery_id bigint, received_at timestamp, idempotency_key string, service string, metric string, value double, timestamp timestamp, incident_id string",
    )
    stream = feed(spark, df, times(0, 3, 6, 100), "received_at")
    got = settle_stream(spark, live.stream_alert_dedupe(stream, "1 hour"), "dedupe").collect()
    assert sorted(row["alert_key"] for row in got) == ["k0", "k1", "k2", "k3"]


def test_rows_out_of_order_within_the_watermark(spark):
    """Five files whose rows overlap by up to ten minutes give the batch results."""
    rnd = random.Random(6)
    rows = [(START + timedelta(seconds=i * 9), f"c{rnd.randrange(3)}", i, rnd.random() < 0.4, rnd.uniform(90, 110) + (80 if i > 300 else 0)) for i in range(500)]
    df = spark.createDataFrame(rows, "ts timestamp, client string, request_id bigint, ok boolean, value double")
    prepare(spark)
    path = scratch_path(spark, "mixed")
    names = "ts timestamp, client string, request_id bigint, ok boolean, value double"
    place = F.floor((F.unix_timestamp("ts") - int(START.timestamp()) + F.col("request_id") * 37 % 600) / 1200)
    files = closed(df, client="end").withColumn("place", place)
    for part in sorted(row["place"] for row in files.select("place").distinct().collect()):
        files.where(F.col("place") == part).drop("place").orderBy(F.rand(3)).coalesce(1).write.mode("append").parquet(path)
    read = lambda: live.replay_stream(spark, path, names)
    got = settle_stream(spark, live.stream_token_bucket(read(), 1, delay="10 minutes", stretch=100.0), "limits")
    want = alerts.token_bucket(df, 1)
    shown = ["client", "request_id", "allowed", "retry_after"]
    assert sorted(map(tuple, got.select(shown).collect())) == sorted(map(tuple, want.select(shown).collect()))
    assert got.where("late").isEmpty()
    series = read().select("ts", F.col("client").alias("service"), F.lit("m").alias("metric"), "value")
    got = settle_stream(spark, stateful.stream_onsets(series, "10 minutes", stretch=100.0), "onsets").collect()
    want = timeseries.series_onsets(df.select("ts", F.col("client").alias("service"), F.lit("m").alias("metric"), "value")).collect()
    assert sorted((r["service"], r["onset"]) for r in got) == sorted((r["service"], r["onset_ts"].replace(tzinfo=timezone.utc).timestamp()) for r in want) and len(got) == 3


def test_one_key_with_many_rows_in_a_batch(spark):
    """A million rows of one key in one file; no more than a stretch of them is in memory."""
    micros = int(START.timestamp() * 1e6)
    df = spark.range(1_000_000).select(
        F.timestamp_micros(F.lit(micros) + F.col("id") * 10_000).alias("ts"), F.lit("hot").alias("service"),
        F.col("id").alias("call_id"), (F.col("id") % 11 < 4).alias("ok"),
    )
    prepare(spark)
    path = scratch_path(spark, "many")
    for part in (df, closed(df.limit(1), service="end").where("service = 'end'")):
        part.coalesce(1).write.mode("append").parquet(path)
    stream = live.replay_stream(spark, path, "ts timestamp, service string, call_id bigint, ok boolean")
    got = settle_stream(spark, live.stream_breaker_states(stream, stretch=500.0), "breakers")
    want = telemetry.breaker_states(df)
    digest = [F.count(F.lit(1)), F.sum(F.xxhash64("call_id", "state", "runs", "state_after").cast("decimal(38,0)"))]
    assert tuple(got.agg(*digest).first()) == tuple(want.agg(*digest).first())


def test_keys_of_one_lane_keep_their_own_state(spark, monkeypatch):
    """A fold groups by lane, not by key, and every key gives what it gives alone."""
    monkeypatch.setattr(stateful, "LANES", 2)
    rnd = random.Random(8)
    rows = [(START + timedelta(seconds=i * 9), f"c{rnd.randrange(40)}" if i % 20 else None, i) for i in range(600)]
    df = spark.createDataFrame(rows, "ts timestamp, client string, request_id bigint")
    limited = live.stream_token_bucket(feed(spark, closed(df, client="end"), times(0, 10, 25, 60, 100, 20_000)), 1, 600.0)
    got = settle_stream(spark, limited, "lanes")
    want = alerts.token_bucket(df.withColumn("client", F.coalesce("client", F.lit("none"))), 1, 600.0)
    shown = [F.coalesce("client", F.lit("none")), "request_id", "allowed", "retry_after"]
    assert sorted(map(tuple, got.select(shown).collect())) == sorted(map(tuple, want.select(shown).collect()))
    assert got.where("late").isEmpty()


def test_late_is_what_is_older_than_the_keys_own_release(spark, monkeypatch):
    monkeypatch.setattr(stateful, "LANES", 1)
    prepare(spark)
    path = scratch_path(spark, "own")
    names = "ts timestamp, client string, request_id bigint"
    files = [
        [(40, "a", 1), (41, "a", 2)],
        [(9_000, "end", 3)],
        [(9_001, "end", 4)],
        [(10, "a", 5), (10, "new", 6)],  # the lane has released the time of both, but only one key has
        [(20_000, "end", 7)],
    ]
    for part in files:
        rows = [(START + timedelta(minutes=m), client, n) for m, client, n in part]
        spark.createDataFrame(rows, names).coalesce(1).write.mode("append").parquet(path)
    got = settle_stream(spark, live.stream_token_bucket(live.replay_stream(spark, path, names), 1), "own")
    assert {r["request_id"]: r["late"] for r in got.collect()} == {1: False, 2: False, 3: False, 4: False, 5: True, 6: False}


def test_incidents_of_one_lane_have_their_own_states(spark, monkeypatch):
    monkeypatch.setattr(stateful, "LANES", 1)
    kinds = [("incident.opened", "{}"), ("state.transition", '{"to":"MITIGATING"}'), ("state.transition", '{"to":"RESOLVED"}')]
    # incident n has its first n % 4 events, all incidents in turn
    rows = [(START + timedelta(minutes=step, seconds=n), f"i{n}", step * 60 + n, *kinds[step]) for step in range(3) for n in range(60) if step < n % 4]
    df = spark.createDataFrame(rows, "ts timestamp, incident_id string, seq bigint, event_type string, payload string")
    stream = feed(spark, closed(df, incident_id="end"), times(0, 1, 2, 100, 20_000))
    got = settle_stream(spark, live.stream_states(stream), "lanes").where("incident_id <> 'end'").collect()
    want = ["INVESTIGATING", "MITIGATING", "RESOLVED"]
    assert sorted((r["seq"], r["state"], r["accepted"], r["late"]) for r in got) == [(seq, want[seq // 60], True, False) for _, _, seq, _, _ in rows]


class Kept:
    """A map or value state that counts the calls it gets."""

    def __init__(self, *_):
        self.rows, self.calls = {}, 0

    def called(self, found):
        self.calls += 1
        return found

    def getValue(self, key):
        return self.called(self.rows.get(key))

    def updateValue(self, key, value):
        self.called(self.rows.update({key: value}))

    def removeKey(self, key):
        self.called(self.rows.pop(key, None))

    def exists(self):
        return self.called(() in self.rows)

    def get(self):
        return self.getValue(())

    def update(self, value):
        self.updateValue((), value)


class Handle:
    getMapState = getValueState = Kept


def test_states_of_many_keys_take_few_calls():
    """Before, every key's state was read and written by a call of its own."""
    fold = stateful.Fold(lambda state, value: ((state[0] + value[0] if state else value[0],), (0,)), "t", ["n"], ["out"], ["n"], [], 60.0)
    fold.init(Handle())
    place = {name: fold.columns.index(name) for name in ("t", "n", stateful.KEY)}
    keys = 20 * stateful.BLOCK_KEYS

    def rows(turn):
        made = [[None] * len(place) for _ in range(keys)]
        for n, row in enumerate(made):
            row[place["t"]], row[place["n"]], row[place[stateful.KEY]] = float(turn), n, f"k{n}"
        return made

    for turn in range(4):
        out = [n for frame in fold.advance((0,), rows(turn), 60.0 * (turn + 1)) for n in frame["n"]]
        assert sorted(out) == list(range(keys))
    calls = fold.states.calls + fold.size.calls
    assert calls < 4 * keys / 4  # 8 a key before
    known, blocks = fold.sizes()
    assert known == keys and keys <= stateful.BLOCK_KEYS * blocks < 2 * keys
    states = {}
    for block in range(blocks):
        states.update(fold.block(block))
    assert states == {f"k{n}": [240.0, 4 * n] for n in range(keys)}


def test_state_partitions_follow_the_cores(spark, monkeypatch):
    cores = spark.sparkContext.defaultParallelism
    own = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "4000")
    try:
        assert live.state_partitions(spark) == max(live.STATE_PARTITIONS, 2 * cores)
        seen = []
        monkeypatch.setattr(live, "state_partitions", lambda spark: seen.append(spark) or 3)
        rows = [(START + timedelta(minutes=n), "a", n) for n in range(5)]
        df = spark.createDataFrame(rows, "ts timestamp, client string, request_id bigint")
        limited = live.stream_token_bucket(feed(spark, closed(df, client="end"), times(0, 3, 20_000)), 100)
        assert settle_stream(spark, limited, "few").count() == 5
        assert seen and spark.conf.get("spark.sql.shuffle.partitions") == "4000"
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", own)
