"""Operational ratios at both sides of each gate, and chart points under a budget."""

import random
from datetime import datetime, timedelta
from statistics import median

import pytest
from pyspark.sql import functions as F
from spanwise.operators import operations as op, selection

T = datetime(2026, 1, 1)
at = lambda m: T + timedelta(minutes=m)
STATE = "series long, start timestamp, end timestamp, flame boolean, heating boolean, hot_water boolean"
SPAN = "series long, start timestamp, end timestamp, value double"
KINDS = {"f": (True, True, False), "r": (False, True, False), "o": (False, False, False), "w": (True, False, True), "b": (True, True, True)}


def ratios(spark, states, exclusions=(), minutes=100, modulation=None, flow=None):
    df = spark.createDataFrame([(s, at(a), at(b), *KINDS[k]) for s, a, b, k in states], STATE)
    out = spark.createDataFrame([(s, at(a), at(b)) for s, a, b in exclusions], "series long, start timestamp, end timestamp")
    spans = lambda rows: None if rows is None else spark.createDataFrame([(s, at(a), at(b), float(v)) for s, a, b, v in rows], SPAN)
    got = op.operational(df, out, "series", F.lit(T), F.lit(at(minutes)), spans(modulation), spans(flow))
    return {r["series"]: r for r in got.collect()}


def test_closed_forms(spark):
    states = [(1, 0, 10, "r"), (1, 10, 30, "f"), (1, 30, 40, "r"), (1, 40, 50, "f"), (1, 50, 60, "w"), (1, 60, 70, "r"), (1, 70, 80, "f"), (1, 80, 100, "o")]
    r = ratios(spark, states, modulation=[(1, 0, 25, 40), (1, 25, 100, 80)], flow=[(1, 0, 60, -2), (1, 60, 75, 5), (1, 75, 100, 1)])[1]
    assert r["reason"] is None and r["starts"] == 3 and r["request_s"] == 70 * 60 and r["observed_s"] == 6000
    assert r["starts_per_request_hour"] == pytest.approx(3 / (70 / 60)) and r["starts_per_observed_hour"] == pytest.approx(3 / (100 / 60))
    assert (r["cycle_median_s"], r["cycle_p90_s"], r["cycle_longest_s"]) == (900, 1140, 1200)  # the run that turns to hot water is no cycle
    assert r["runtime_ratio"] == pytest.approx(40 / 70) and r["without_flame_ratio"] == pytest.approx(30 / 70)
    assert r["modulation_mean"] == pytest.approx((15 * 40 + 25 * 80) / 40) and r["modulation_median"] == 80
    assert (r["flow_error_median"], r["flow_error_p90"], r["flow_overshoot"]) == (-2, 5, 5)


def test_gates(spark):
    full = [(1, 0, 50, "r"), (1, 50, 100, "f")]
    assert ratios(spark, [(1, 0, 70, "f")])[1]["reason"] is None and ratios(spark, [(1, 0, 69.9, "f")])[1]["reason"] == "insufficient_state_coverage"
    one, less = ratios(spark, [(1, 0, 99, "o"), (1, 99, 100, "r")])[1], ratios(spark, [(1, 0, 99.1, "o"), (1, 99.1, 100, "r")])[1]
    assert one["without_flame_ratio"] == 1 and less["without_flame_ratio"] is None and less["reason"] == "no_qualified_request" and less["starts_per_observed_hour"] == 0
    # excluded time is neither observed nor due
    r = ratios(spark, full, [(1, 40, 60), (1, 55, 80)])[1]
    assert r["observed_s"] == 3600 and r["coverage_pct"] == 100 and r["starts"] == 0 and r["request_s"] == 3600
    gone = ratios(spark, [(1, 0, 75, "f")], [(1, 0, 74)])[1]
    assert gone["reason"] == "no_qualified_observed_time" and gone["coverage_pct"] < 70 and gone["cycle_median_s"] is None
    assert ratios(spark, full, [(1, 0, 100)])[1]["observed_s"] == 0
    short, enough = ratios(spark, full, modulation=[(1, 50, 84, 10)])[1], ratios(spark, full, modulation=[(1, 50, 85, 10)])[1]
    assert short["modulation_mean"] is None and enough["modulation_mean"] == 10
    assert ratios(spark, full, flow=[(1, 0, 69, 1)])[1]["flow_overshoot"] is None and ratios(spark, full, flow=[(1, 0, 70, -1)])[1]["flow_overshoot"] == 0
    # a start needs an observed time without flame right before it
    assert ratios(spark, [(1, 0, 40, "r"), (1, 41, 100, "f")])[1]["starts"] == 0 and ratios(spark, full)[1]["starts"] == 1
    assert ratios(spark, []) == {}


def loops(points, limit, steps):
    """The rows that stay, index by index."""
    n = len(points)
    if n <= limit:
        return set(range(n))
    gaps = [b[0] - a[0] for a, b in zip(points, points[1:]) if b[0] > a[0]]
    most = 3 * median(gaps) if gaps else float("inf")
    must = {0, n - 1}
    for i in range(1, n):
        if (points[i][1] != points[i - 1][1]) if steps else (points[i][0] - points[i - 1][0] > most):
            must |= {i - 1, i}
    if len(must) >= limit:
        return must
    many = max(1, (limit - len(must)) // 2)
    for b in range(many):
        part = range(int(b * (n / many)), min(n, int((b + 1) * (n / many))))
        if part:
            must |= {min(part, key=lambda i: points[i][1]), max(part, key=lambda i: points[i][1])}
    return must


@pytest.mark.parametrize("steps", [False, True])
def test_downsampling_equals_loops(spark, steps):
    rng = random.Random(4)
    rows, want = [], set()
    for series, (n, limit_like) in enumerate([(0, 1), (1, 1), (30, 1), (31, 1), (200, 1), (333, 5), (97, 1)]):
        ts, points = 0, []
        for i in range(n):
            ts += rng.choice([60, 60, 60, 61, 900 if series > 3 else 60])
            points.append((ts, float(rng.randrange(limit_like * 4) if i % 7 else 3)))
        rows += [(series, T + timedelta(seconds=t), i, v) for i, (t, v) in enumerate(points)]
        want |= {(series, i) for i in loops(points, 30, steps)}
    df = spark.createDataFrame([*rows, (2, T, -1, None)], "series long, ts timestamp, seq long, value double")
    assert {(r["series"], r["seq"]) for r in selection.downsampled(df, "series", "ts", "value", "seq", 30, steps).collect()} == want


def test_budget_of_480(spark):
    df = spark.range(5000).selectExpr("1L as series", "timestamp_seconds(1767225600 + id * 60) as ts", "id as seq", "sin(id / 50.0) as value")
    assert 400 < selection.downsampled(df, "series", "ts", "value", "seq").count() <= 480
    broken = df.selectExpr("series", "timestamp_seconds(1767225600 + id * 60 + floor(id / 5) * 3600) as ts", "seq", "value") if "id" in df.columns else df.selectExpr("series", "timestamp_seconds(1767225600 + seq * 60 + floor(seq / 5) * 3600) as ts", "seq", "value")
    assert selection.downsampled(broken, "series", "ts", "value", "seq").count() == 2000  # two edges for each of 999 gaps and the ends: all stay
