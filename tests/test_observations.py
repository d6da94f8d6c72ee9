"""Closed forms of the rules on observations."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F
from spanwise.operators import decode, episodes

T = datetime(2026, 1, 1)
at = lambda minutes: T + timedelta(minutes=minutes)
lit = lambda t: F.lit(t).cast("timestamp")


def pulses(spark, states, flow):
    df = spark.createDataFrame([(1, at(m), k) for m, k in states], "key long, ts timestamp, kind string")
    values = spark.createDataFrame([(1, at(m), v) for m, v in flow], "key long, ts timestamp, value double")
    found = episodes.unconfirmed_pulses(df, "key", "ts", F.col("kind") != "off", "kind", values, "value", 120, 300, 0.5).collect()
    return [(r["start"], r["end"], r["purposes"], r["baseline"], r["peak"]) for r in found]


STATES = [(0, "off"), (10, "ch"), (11, "dhw"), (12, "off"), (40, "ch"), (43, "off"), (60, "ch")]


@pytest.mark.parametrize("flow, found", [
    ([(6, 40.0), (9, 41.0), (12, 41.4), (17, 41.2)], True),
    ([(9, 41.0), (12, 41.5), (17, 41.2)], False),  # the flow rose
    ([(9, 41.0), (12, 41.4), (16, 41.2), (18, 41.0)], False),  # nothing at the end of the response
    ([(4, 41.0), (12, 41.4), (17, 41.2)], False),  # the baseline is too old
    ([(10, 41.0), (12, 41.4), (17, 41.2)], False),  # a value at the start is no baseline
    ([], False),
])
def test_unconfirmed_pulses(spark, flow, found):
    assert pulses(spark, STATES, flow) == ([(at(10), at(12), "ch,dhw", 41.0, 41.4)] if found else [])


def test_an_observation_at_an_edge_is_not_inside(spark):
    lost = spark.createDataFrame([(1, at(0), at(10)), (1, at(20), at(30)), (2, at(0), at(10))], "key long, start timestamp, end timestamp")
    seen = spark.createDataFrame([(1, at(0)), (1, at(10)), (1, at(25)), (2, at(15)), (3, at(5))], "key long, ts timestamp")
    got = {(r["key"], r["start"]): r["seen"] for r in episodes.observed_within(lost, seen, "key", "ts").collect()}
    assert got == {(1, at(0)): False, (1, at(20)): True, (2, at(0)): False}


def test_settings_are_unknown_between_confirmation_and_change(spark):
    rows = [(1, 5, "a"), (1, 20, "a"), (1, 30, "b"), (1, 40, "b"), (1, 90, "c"), (2, 70, "a"), (3, -20, None), (3, -10, "a")]
    df = spark.createDataFrame([(k, at(m), v) for k, m, v in rows], "key long, ts timestamp, version string")
    found = episodes.settings_schedule(df, "key", "ts", "version", lit(at(0)), lit(at(60))).collect()
    got = sorted((r["key"], (r["start"] - T).seconds // 60, (r["end"] - T).seconds // 60, r["version"]) for r in found)
    assert got == [(1, 0, 5, None), (1, 5, 20, "a"), (1, 20, 30, None), (1, 30, 40, "b"), (1, 40, 60, None), (2, 0, 60, None), (3, 0, 60, "a")]
    assert episodes.settings_schedule(df.where("false"), "key", "ts", "version", lit(at(0)), lit(at(60))).count() == 0


def test_curves_are_not_extrapolated(spark):
    curve = F.array(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in ((10.0, 30.0), (-10.0, 50.0), (0.0, 45.0))])
    df = spark.createDataFrame([(x,) for x in (-10.0, -5.0, 0.0, 5.0, 10.0, 10.5, -11.0, None)], "x double")
    assert [r[0] for r in df.select(decode.on_curve(curve, F.col("x"))).collect()] == [50, 47.5, 45, 37.5, 30, None, None, None]
    one = F.array(F.struct(F.lit(1.0).alias("x"), F.lit(2.0).alias("y")))
    assert df.select(decode.on_curve(one, F.col("x")).alias("y")).where("y is not null").count() == 0


def test_modes_follow_the_state_machine(spark):
    rows = [(18.0, 20.0, False), (19.6, 20.0, False), (19.0, 22.0, False), (21.9, 22.0, False), (22.0, 22.0, False), (21.0, 22.0, False), (21.0, 22.0, True), (21.0, 22.0, False), (22.5, 22.0, True),
            (None, 22.0, False), (21.8, 22.0, False), (21.8, 23.0, True), (21.8, 23.0, True), (22.9, 23.0, False)]
    df = spark.createDataFrame([(1, at(i), *r) for i, r in enumerate(rows)], "key long, ts timestamp, room double, target double, off boolean")
    found = episodes.mode_kinds(df, "key", "ts", "room", "target", F.col("off"), F.lit(True), 0.5).orderBy("ts").collect()
    u, w, m, i = "unknown", "warmup", "maintenance", "inactive"
    assert [r["mode"] for r in found] == [u, m, w, w, m, m, i, w, i, u, m, w, i, m]
