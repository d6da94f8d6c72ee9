"""Two-level windows against plain loops, on a series with most of the rows."""

import random
from datetime import datetime, timedelta
from statistics import median

import pytest
from pyspark.sql import functions as F
from spanwise.operators import hot, intervals as iv

T = datetime(2026, 1, 1)
SAMPLE = "series long, ts timestamp, seq long, value double"


def samples(seed, n=900):
    rng = random.Random(seed)
    out = []
    for k in range(n):
        series = 0 if rng.random() < 0.7 else rng.randrange(1, 9)
        out.append((series, T + timedelta(minutes=rng.randrange(0, 9_000) if series else rng.randrange(0, 14_000)), k, None if rng.random() < 0.1 else float(rng.randrange(9))))
    rng.shuffle(out)
    return out


@pytest.mark.parametrize("seed", [0, 1])
def test_segments(spark, seed):
    rows, want = samples(seed), set()
    for series in range(9):
        last = {}
        for s, ts, seq, v in sorted(rows, key=lambda r: r[2]):
            if s == series and v is not None:
                last[ts] = v
        times = sorted(last)
        gaps = [(b - a).total_seconds() for a, b in zip(times, times[1:])]
        cap = max(60.0, 2.5 * median(gaps)) if gaps else 0
        want |= {(series, a, b, last[a], g) for a, b, g in zip(times, times[1:], gaps) if g <= cap}
    df = spark.createDataFrame(rows, SAMPLE)
    assert {tuple(r) for r in hot.segments(df, "series", "ts", "value", "seq").collect()} == want


@pytest.mark.parametrize(("strict", "ttl"), [(False, None), (True, 7200.0)])
def test_as_of(spark, strict, ttl):
    left, right = samples(2, 400), samples(3, 500)
    want = []
    for s, ts, seq, _ in left:
        known = [(t, q, v) for r, t, q, v in right if r == s and (t < ts if strict else t <= ts)]
        t, _, v = max(known, key=lambda x: x[:2]) if known else (None, None, None)
        if t is not None and ttl is not None and (ts - t).total_seconds() > ttl:
            t = v = None
        want.append((s, ts, seq, v, t))
    df = spark.createDataFrame(left, SAMPLE).drop("value")
    got = hot.as_of(df, spark.createDataFrame(right, SAMPLE), "series", "ts", "value", "seq", strict, ttl)
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)


@pytest.mark.parametrize("tolerance", [0.0, 600.0])
def test_merge_equals_the_plain_one(spark, tolerance):
    rng = random.Random(5)
    rows = [(s, ts, ts + timedelta(minutes=rng.choice([1, 5, 30, 4000 if k % 97 == 0 else 2]))) for k, (s, ts, _, _) in enumerate(samples(6, 500))]
    df = spark.createDataFrame(rows, "series long, start timestamp, end timestamp")
    assert sorted(hot.merge(df, "series", tolerance).collect()) == sorted(iv.merge(df, "series", tolerance).select("series", "start", "end").collect())


def test_hot_series_is_spread(spark):
    """Rows of the one series stay in many tasks up to the last step."""
    df = spark.range(20_000).select(F.lit(1).cast("long").alias("series"), F.timestamp_seconds(F.lit(1767225600) + F.col("id") * 60).alias("ts"), F.col("id").alias("seq"), F.col("id").cast("double").alias("value"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        found = hot.following(df, "series", ["ts", "seq"], F.struct("seq"), "next")
        tasks = found.groupBy(F.spark_partition_id().alias("p")).count().collect()
        assert len(tasks) == 4 and max(r["count"] for r in tasks) < 12_000  # all four shuffle partitions of the tests
        assert found.where("next.seq = seq + 1").count() == 19_999
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_empty(spark):
    none = spark.createDataFrame([], SAMPLE)
    assert hot.segments(none, "series", "ts", "value", "seq").collect() == [] and hot.as_of(none.drop("value"), none, "series", "ts", "value", "seq").collect() == []
