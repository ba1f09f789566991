"""Sliced windows give the rows of plain windows, whatever the skew."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from faultline.plans import slices
from faultline.plans.firsts import flag_first
from faultline.plans.quantiles import exact_quantiles


def skewed(spark, seed: int, bursts: bool):
    """A third of the rows in one key, some keys tiny, optional bursts and equal times."""
    rnd = random.Random(seed)
    rows = []
    for i in range(1500):
        key = "hot" if i % 3 == 0 else f"k{rnd.randrange(40)}"
        t = rnd.choice([10, 11, 12, 5000]) * 1000 + rnd.randrange(50) if bursts else rnd.randrange(100_000)
        rows.append((key, t, i, float(rnd.randrange(1000)) / 8))
    return spark.createDataFrame(rows, "k string, t bigint, id bigint, v double")


def rows_of(df):
    return sorted(tuple(row) for row in df.collect())


@pytest.mark.parametrize("bursts", [False, True])
@pytest.mark.parametrize("slice_rows", [7, 60, 400])
def test_bounded_frame_equals_plain_window(spark, bursts, slice_rows):
    df = skewed(spark, slice_rows, bursts)

    def columns(window):
        frame = window.rowsBetween(-20, -1)
        return {"s": F.sum("v").over(frame), "n": F.count("v").over(frame), "p": F.lag("id", 3).over(window)}

    plain = df.withColumns(columns(Window.partitionBy("k").orderBy("t", "id")))
    cut = slices.bounded_frame(df, ["k"], "t", 20, columns, ("id",), slice_rows)
    assert rows_of(cut.select(plain.columns)) == rows_of(plain)


@pytest.mark.parametrize("keys", [["k"], []])
@pytest.mark.parametrize("bursts", [False, True])
def test_running_equals_plain_window(spark, keys, bursts):
    df = skewed(spark, 5, bursts).withColumn("mark", F.when(F.col("id") % 7 == 0, F.col("id")))
    wanted = {"s": ("sum", F.col("v")), "m": ("max", F.col("v")), "l": ("last", F.col("mark"))}
    upto = Window.partitionBy(*keys).orderBy("t", "id").rowsBetween(Window.unboundedPreceding, 0)
    plain = df.withColumns(
        {"s": F.sum("v").over(upto), "m": F.max("v").over(upto), "l": F.last("mark", ignorenulls=True).over(upto)}
    )
    cut = slices.running(df, keys, "t", wanted, ("id",), slice_rows=50)
    assert rows_of(cut.select(plain.columns)) == rows_of(plain)


@pytest.mark.parametrize("keys", [["k"], []])
def test_numbers_and_previous(spark, keys):
    df = skewed(spark, 9, False)
    order = Window.partitionBy(*keys).orderBy("t", "id")
    plain = df.withColumns({"n": F.row_number().over(order).cast("bigint"), "b": F.lag("id").over(order)})
    cut = slices.numbered(df, keys, "t", "n", ("id",), slice_rows=40)
    cut = slices.previous(cut, keys, "t", {"b": "id"}, ("id",), slice_rows=40)
    assert rows_of(cut.select(plain.columns)) == rows_of(plain)


def test_slices_bound_what_one_task_holds(spark):
    df = skewed(spark, 1, False)
    hot = slices.find_hot(df, ["k"], "t", 50)
    assert [row["k"] for row in hot.collect()] == ["hot"]
    sizes = slices.with_slices(df, ["k"], "t", hot, 50).groupBy("k", slices.SLICE).count()
    assert sizes.agg(F.max("count")).first()[0] < 120


def test_a_burst_is_cut_again(spark):
    rows = [("hot", 1_000_000 + i % 500 if i < 900 else i * 50_000, i) for i in range(1000)]
    df = spark.createDataFrame(rows, "k string, t bigint, id bigint")
    hot = slices.find_hot(df, ["k"], "t", 20)
    once = slices._cut(df, ["k"], F.col("t").cast("double"), hot, slices.SLICE, slices.HOT).groupBy(slices.SLICE).count().agg(F.max("count")).first()[0]
    cut = slices.with_slices(df, ["k"], "t", hot, 20)
    twice = cut.groupBy(slices.SLICE).count().agg(F.max("count")).first()[0]
    assert once >= 900 and twice <= 60
    ordered = [(row["t"], row[slices.SLICE]) for row in cut.orderBy("t").collect()]
    assert all(a[1] <= b[1] for a, b in zip(ordered, ordered[1:]))
    numbers = slices.numbered(df, ["k"], "t", "n", ("id",), 20).orderBy("t", "id").collect()
    assert [row["n"] for row in numbers] == list(range(1, 1001))


def test_nulls_ties_and_nested_bursts(spark):
    """Nulls come first, rows of one time are cut by the tie column, and bursts inside bursts are cut."""
    times = [None] * 40 + [7] * 300 + [10**9 + i % 3 for i in range(300)] + [10**6 * i for i in range(100)]
    df = spark.createDataFrame([("hot", t, i) for i, t in enumerate(times)], "k string, t bigint, id bigint")
    hot = slices.find_hot(df, ["k"], "t", 20)
    cut = slices.with_slices(df, ["k"], "t", hot, 20, ("id",))
    assert cut.groupBy(slices.SLICE).count().agg(F.max("count")).first()[0] <= 80
    plain = df.withColumn("n", F.row_number().over(Window.partitionBy("k").orderBy("t", "id")).cast("bigint"))
    assert rows_of(slices.numbered(df, ["k"], "t", "n", ("id",), 20).fillna(-1)) == rows_of(plain.fillna(-1))
    back = df.withColumn("b", F.lag("id").over(Window.partitionBy("k").orderBy("t", "id")))
    assert rows_of(slices.previous(df, ["k"], "t", {"b": "id"}, ("id",), 20).fillna(-1)) == rows_of(back.fillna(-1))


def test_text_parts_join_to_the_whole_text(spark):
    df = skewed(spark, 2, False).withColumn("w", F.col("id").cast("string"))
    parts = slices.text_parts(df, ["k"], "t", "w", ",", ("id",), part_rows=30, slice_rows=40)
    whole = {}
    for row in sorted(parts.collect(), key=lambda row: (row["k"], row["part"])):
        assert row["n_rows"] <= 30
        whole[row["k"]] = whole[row["k"]] + "," + row["text"] if row["k"] in whole else row["text"]
    expected = {}
    for row in sorted(df.collect(), key=lambda row: (row["t"], row["id"])):
        expected.setdefault(row["k"], []).append(row["w"])
    assert whole == {key: ",".join(words) for key, words in expected.items()}


def test_exact_quantiles(spark):
    df = skewed(spark, 3, False)
    got = exact_quantiles(df, ["k"], "v", {"p50": 0.5, "p95": 0.95}, slice_rows=40).collect()
    values = {}
    for row in df.collect():
        values.setdefault(row["k"], []).append(row["v"])
    assert len(got) == len(values)
    for row in got:
        assert row["p50"] == pytest.approx(np.quantile(values[row["k"]], 0.5))
        assert row["p95"] == pytest.approx(np.quantile(values[row["k"]], 0.95))


def test_flag_first(spark):
    df = skewed(spark, 4, True)
    first = flag_first(df, ["k"], "id", ["t"], "first").where("first")
    seen = {}
    for row in df.collect():
        seen[row["k"]] = min(seen.get(row["k"], (1e18, 0)), (row["t"], row["id"]))
    assert {row["k"]: (row["t"], row["id"]) for row in first.collect()} == seen


def test_plain_plan_without_hot_keys(spark):
    df = skewed(spark, 6, False)
    cut = slices.numbered(df, ["k"], "t", "n", ("id",))
    plan = cut._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "Union" not in plan
