"""Closed forms of the rules, on small inputs."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F
from spanwise.operators import intervals, metrics, models

T = datetime(2026, 1, 1)
at = lambda minutes: T + timedelta(minutes=minutes)
lit = lambda t: F.lit(t).cast("timestamp")


def one(df):
    rows = df.collect()
    assert len(rows) == 1
    return rows[0].asDict()


def test_time_weighted_mean(spark):
    rows = spark.createDataFrame([(1, at(0), 20.0), (1, at(1), 30.0), (1, at(11), 30.0)], "key long, ts timestamp, value double")
    segments = intervals.segments(rows, "key", "ts", "value").withColumn("target", F.lit(None).cast("double"))
    assert one(metrics.comfort(segments, "key", "value", "target", 1.0))["mean"] == pytest.approx(320 / 11)


def test_degree_hours_are_against_the_exact_target(spark):
    rows = spark.createDataFrame([(1, 3600.0, 24.0, 21.0, False), (1, 3600.0, 20.0, 21.0, False), (1, 7200.0, 30.0, 21.0, True)], "key long, sec double, value double, target double, ignored boolean")
    got = one(metrics.comfort(rows, "key", "value", "target", 1.0))
    assert (got["degree_hours_above"], got["degree_hours_below"], got["mean_error_above"], got["mean_error_below"]) == (3, 1, 3, 1)
    assert (got["in_band_pct"], got["above_pct"], got["evaluation_pct"]) == (50, 50, 50)


def test_quality_of_two_samples(spark):
    """The last sample covers nothing: 600 s of 3,600 s."""
    rows = spark.createDataFrame([(1, at(0), 20.0), (1, at(10), 20.0), (2, at(5), 20.0)], "key long, ts timestamp, value double")
    got = {r["key"]: r for r in metrics.quality(rows, "key", "ts", "value", lit(T), lit(at(60))).collect()}
    assert got[1]["coverage"] == pytest.approx(1 / 6) and got[1]["stuck_pct"] == 100 and got[1]["flags"] == "low_coverage"
    assert got[2]["flags"] == "insufficient_samples" and got[2]["score"] == 0 and got[2]["max_gap_s"] == 3600


@pytest.mark.parametrize("y, want", [((-10.0, 2.0, 2.0), (0, 2)), ((1.0, 2.0, 3.0), None)])
def test_two_term_fit_is_the_non_negative_optimum(spark, y, want):
    a, b = (1.0, 0.0, 0.1), (0.0, 1.0, 1.0)
    got = one(models.fit_two(spark.createDataFrame([(1, *r) for r in zip(y, a, b)], "key long, y double, a double, b double"), ["key"], "y", "a", "b"))
    error = lambda u, v: sum((yy - u * aa - v * bb) ** 2 for yy, aa, bb in zip(y, a, b))
    best = min((error(u / 50, v / 50), u / 50, v / 50) for u in range(201) for v in range(201))
    assert error(got["u"], got["v"]) <= best[0] + 1e-9
    if want:
        assert got["u"] == 0 and got["v"] == pytest.approx(2, abs=0.02)
