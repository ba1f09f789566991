"""Clustered tables spare their readers the shuffle; a recording replays one tick per micro-batch."""

from __future__ import annotations

from datetime import datetime, timedelta, timezone

from pyspark.sql import functions as F

from faultline.operators import eventlog, timeseries
from faultline.session import prepare
from faultline.sources import tables
from faultline.streaming import ticks

START = datetime(2024, 1, 1, tzinfo=timezone.utc)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_readers_of_clustered_tables_do_not_shuffle(spark, tmp_path):
    prepare(spark)
    tables.create_tables(spark, "cl_", str(tmp_path), 4)
    rows = spark.range(3_000).select(
        F.timestamp_seconds(F.lit(1_700_000_000) + F.col("id") * 5).alias("ts"), F.concat(F.lit("s"), F.col("id") % 7).alias("service"),
        F.concat(F.lit("m"), F.col("id") % 3).alias("metric"), (F.col("id") % 50).cast("double").alias("value"),
    )
    tables.fill_table(rows, "metrics", "cl_", 4)
    log = spark.range(500).select(
        F.timestamp_seconds(F.lit(1_700_000_000)).alias("ts"), F.concat(F.lit("inc-"), F.col("id") % 9).alias("incident_id"),
        F.col("id").alias("seq"), F.lit("agent.error").alias("event_type"), F.lit('{"error":"x"}').alias("payload"),
    )
    tables.fill_table(log, "events", "cl_", 4)
    baseline = timeseries.rolling_baseline(spark.table("cl_metrics"))
    assert "Exchange" in plan(timeseries.rolling_baseline(rows)) and "Exchange" not in plan(baseline)
    assert sorted(map(tuple, baseline.collect())) == sorted(map(tuple, timeseries.rolling_baseline(rows).collect()))
    block, want = eventlog.log_block(spark.table("cl_events")), eventlog.log_block(log)
    assert plan(block).count("Exchange") < plan(want).count("Exchange")
    # equal times: seq decides
    assert sorted(map(tuple, block.collect())) == sorted(map(tuple, want.collect()))
    for name in ("events", "metrics", "history"):
        spark.sql(f"DROP TABLE cl_{name}")


def test_a_hot_key_is_written_by_several_tasks(spark, tmp_path):
    prepare(spark)
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "64k")
    try:
        tables.create_tables(spark, "hk_", str(tmp_path), 4)
        rows = spark.range(0, 40_000, 1, 8).select(
            F.timestamp_seconds(F.lit(1_700_000_000) + F.col("id")).alias("ts"), F.lit("tickets").alias("source"), F.lit("hot").alias("record_type"),
            F.col("id").cast("string").alias("external_id"), F.lit("a").alias("author"), F.sha2(F.col("id").cast("string"), 256).alias("title"), F.lit("{}").alias("payload"),
        )
        tables.fill_table(rows, "history", "hk_", 4)
        back = spark.table("hk_history")
        # one key, so one bucket: no task wrote all of it, and its readers still need no exchange
        assert back.select(F.input_file_name()).distinct().count() > 3
        counted = back.groupBy("source", "record_type").count()
        assert "Exchange" not in plan(counted) and counted.first()["count"] == 40_000
        assert back.exceptAll(rows.select(*back.columns)).isEmpty()
    finally:
        spark.conf.unset("spark.sql.adaptive.advisoryPartitionSizeInBytes")
        for name in ("events", "metrics", "history"):
            spark.sql(f"DROP TABLE IF EXISTS hk_{name}")


def test_a_tick_per_batch_through_a_restart(spark, tmp_path):
    prepare(spark)
    # stored in no order; the fourth tick holds most rows
    rows = [(START + timedelta(seconds=7 * (n % 12)), n, "x" if n % 2 else None) for n in range(60)]
    rows += [(START + timedelta(seconds=21), 100 + n, "hot") for n in range(500)]
    names = "ts timestamp, n bigint, s string"
    df = spark.createDataFrame(rows, names).orderBy(F.rand(1))
    count = ticks.record_ticks(df, str(tmp_path / "rec"), per_folder=5)
    assert count == 12
    for batches in (1, 4, None):
        stream = ticks.tick_stream(spark, str(tmp_path / "rec"), names, count, per_folder=5)
        ticks.replay_to_table(stream, str(tmp_path / "out"), str(tmp_path / "check"), batches)
    got = spark.read.parquet(str(tmp_path / "out" / "batch-*"))
    want = sorted({ts for ts, _, _ in rows})
    read = [(r["ts"].replace(tzinfo=timezone.utc), r["n"], r["s"], r["batch"]) for r in got.withColumn("ts", F.col("ts")).collect()]
    assert sorted(read, key=lambda r: r[1]) == sorted([(ts, n, s, want.index(ts)) for ts, n, s in rows], key=lambda r: r[1])
    two = ticks.tick_stream(spark, str(tmp_path / "rec"), names, count, per_batch=5, per_folder=5)
    ticks.replay_to_table(two, str(tmp_path / "out2"), str(tmp_path / "check2"))
    assert spark.read.parquet(str(tmp_path / "out2" / "batch-*")).select("batch").distinct().count() == 3
