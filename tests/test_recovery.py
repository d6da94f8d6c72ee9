"""Recoveries by a machine over all intervals, and a closed form."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F
from spanwise.operators import recovery

T = datetime(2026, 1, 1)
SCHEMA = "series long, start timestamp, end timestamp, opens boolean, steady boolean, measured boolean"


def machine(rows):
    out, opened, count, last = {}, False, 0, None
    for start, end, opens, steady, measured in rows:
        if opens:
            opened, count = True, 0
        now = opened
        if opened:
            if opens or not steady or last != start:
                count = 0
            if steady and measured and not opens:
                count += 1
            if count >= 3:
                opened, count = False, 0
        out[start], last = now, end
    return out


@pytest.mark.parametrize("seed", range(4))
def test_days_in_parallel_equal_one_machine(spark, seed):
    rng = random.Random(seed)
    rows, want = [], {}
    for series in range(12):
        ts, some = T + timedelta(hours=rng.randrange(24)), []
        for _ in range(rng.randrange(1, 90)):
            end = ts + timedelta(minutes=rng.choice([30, 60, 240, 600]))
            some.append((ts, end, rng.random() < 0.08, rng.random() < 0.8, rng.random() < 0.8))
            ts = end + timedelta(minutes=rng.choice([0, 0, 0, 0, 5, 2000]))
        rows += [(series, *r) for r in some]
        want |= {(series, s): v for s, v in machine(some).items()}
    rng.shuffle(rows)
    got = {(r["series"], r["start"]): r["recovering"] for r in recovery.recovering(spark.createDataFrame(rows, SCHEMA), "series").collect()}
    assert got == want and any(want.values()) and not all(want.values())


def test_closed_form(spark):
    """A disturbance from 30 to 60 minutes; steady 5-minute intervals after it: recovered
    at 75 minutes, 45 of 120 minutes left out. It is the same across midnight."""
    for begin in (T, T - timedelta(minutes=65), T - timedelta(minutes=33)):
        rows = [(1, begin + timedelta(minutes=m), begin + timedelta(minutes=m + 5), 30 <= m < 60, True, True) for m in range(0, 120, 5)]
        found = recovery.recovering(spark.createDataFrame(rows, SCHEMA), "series")
        times = sorted((r["start"] - begin).total_seconds() / 60 for r in found.where("recovering").collect())
        assert times[0] == 30 and times[-1] == 70 and recovery.windows(found, "series").agg(F.sum("recovering_s")).first()[0] == 45 * 60


def test_steady_and_empty(spark):
    rows = [(T, T + timedelta(hours=1), 20.0, 20.25, 20.15, False), (T, T + timedelta(hours=1), 20.0, 20.31, 20.2, False), (T, T + timedelta(hours=1), 20.0, 20.1, 20.31, False), (T, T + timedelta(hours=1), 20.0, 20.0, 20.0, True), (T, T + timedelta(hours=1), None, 20.0, 20.0, False)]
    df = spark.createDataFrame(rows, "start timestamp, end timestamp, a double, b double, t double, trigger boolean")
    got = [r[0] for r in df.select(recovery.steady(F.col("a"), F.col("b"), F.col("t"), F.col("trigger"))).collect()]
    assert got == [True, False, False, False, False]
    assert recovery.recovering(spark.createDataFrame([], SCHEMA), "series").collect() == []
