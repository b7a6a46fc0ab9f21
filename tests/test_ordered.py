"""Sliced scans of hot groups give what a plain window gives."""

import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import ordered

SCAN = dict(lags={"prev": "v"}, number="n")


def carry():
    return {"last": F.when(F.col("v") % 3 == 0, F.col("v"))}


def both(df, **options):
    plain = ordered.ordered_scan(df, ["k"], "t", "u", carries=carry(), **SCAN)
    sliced = ordered.ordered_scan(df, ["k"], "t", "u", carries=carry(), **SCAN, small_bytes=0, min_rows=10, **options)
    order = sorted(plain.columns)
    return sorted(plain.select(order).collect(), key=repr), sorted(sliced.select(order).collect(), key=repr)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_hot_groups_ties_and_null_keys(spark, seed):
    rnd = random.Random(seed)
    rows = []
    for i in range(3000):
        key = rnd.choice([None, "hot", "hot", "hot", "warm"]) if i % 3 else f"k{i % 150}"
        t = 7 if rnd.random() < 0.4 else rnd.randrange(1000)
        rows.append((key, t, i, rnd.randrange(100) if rnd.random() < 0.9 else None))
    df = spark.createDataFrame(rows, "k string, t long, u long, v int")
    plain, sliced = both(df, rows_per_slice=40)
    assert plain == sliced


def test_timestamps_as_order(spark):
    df = spark.range(2000).select(
        F.lit("one").alias("k"), F.expr("timestamp_ntz'2024-01-01' + make_dt_interval(0, 0, id % 500)").alias("t"),
        F.col("id").alias("u"), (F.col("id") % 17).cast("int").alias("v"),
    )
    plain, sliced = both(df, rows_per_slice=100)
    assert plain == sliced


def test_orders_too_close_for_a_double_stay_in_order(spark):
    df = spark.range(2000).select(
        F.lit("one").alias("k"), (F.lit(1 << 60) + F.col("id") % 5).alias("t"), ((F.col("id") * 7919) % 2000).alias("u"),
        (F.col("id") % 17).cast("int").alias("v"),
    )
    plain, sliced = both(df, rows_per_slice=100)
    assert plain == sliced


def test_a_hot_group_is_spread_over_slices(spark):
    df = spark.range(10_000).select(F.lit(5).alias("t"), F.col("id").alias("u"))
    sizes = ordered.add_slices(df, "t", "u", 20).groupBy("_slice", "_sub").count().collect()
    assert len(sizes) >= 15 and max(r["count"] for r in sizes) < 2000


def test_only_large_groups_are_hot(spark):
    df = spark.range(1000).select(F.when(F.col("id") < 400, -1).otherwise(F.col("id")).alias("k"))
    assert [r["k"] for r in ordered.hot_groups(df, ["k"], min_rows=50)] == [-1]
    assert ordered.hot_groups(df, ["k"], min_rows=500) == []
    assert len(ordered.hot_groups(df, ["k"], min_rows=0)) == df.select("k").distinct().count()


def test_small_inputs_start_no_job(spark):
    df = spark.range(100).select(F.lit(1).alias("k"), F.col("id").alias("t"), F.col("id").alias("u"), F.col("id").alias("v"))
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("scan", "scan")
    ordered.ordered_scan(df, ["k"], "t", "u", **SCAN)
    assert not tracker.getJobIdsForGroup("scan")
    spark.sparkContext.setJobGroup("rest", "rest")
