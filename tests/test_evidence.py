"""Heating evidence and configuration snapshots by closed cases."""

import json
from datetime import datetime, timedelta

import pytest
from spanwise.operators import evidence, snapshots

T = datetime(2026, 1, 15)
FACT = "struct<mean: double, minimum: double, maximum: double, coverage: double>"
SCHEMA = f"scope string, id string, kind string, rank int, start timestamp, end timestamp, excluded array<string>, room {FACT}, target {FACT}, outdoor {FACT}, mode {FACT}, request {FACT}, error double"


def fact(mean, low=None, high=None, coverage=100.0):
    return None if mean is None else (float(mean), float(mean if low is None else low), float(mean if high is None else high), coverage)


def window(hour=0, **more):
    row = {"scope": "a", "id": f"w{hour}", "kind": None, "rank": 0, "start": T + timedelta(hours=hour), "end": T + timedelta(hours=hour + 1), "excluded": [], "room": fact(19), "target": fact(21), "outdoor": fact(-5), "mode": fact(2), "request": fact(100), "error": None}
    return tuple((row | more).values())


def parts(spark, rows, most=24):
    return evidence.evidence(spark.createDataFrame(rows, SCHEMA), "scope", most).collect()


@pytest.mark.parametrize(("change", "part"), [
    ({}, "active"), ({"mode": fact(0), "outdoor": fact(0)}, "active"), ({"request": fact(0)}, "inactive"), ({"request": None}, "unknown"), ({"request": fact(100, coverage=69.9)}, "unknown"), ({"excluded": ["dhw"]}, "unknown"),
    ({"excluded": None}, "active"), ({"target": fact(21, high=22)}, "unknown"), ({"mode": fact(2, high=3)}, "unknown"), ({"outdoor": fact(float("nan"))}, "unknown"), ({"room": None}, "unknown"), ({"room": fact(19, coverage=70.0)}, "active"), ({"request": fact(0), "excluded": ["x"]}, "inactive"),
])
def test_gates(spark, change, part):
    got = parts(spark, [window(**change)])
    assert [r["part"] for r in got] == [part] and (part != "active" or got[0]["error"] == -2)


def test_duplicates_count_once(spark):
    rows = [window(), window(kind="representative"), window(rank=2, id="old", error=9.0), window(1, rank=2, id="old2"), window(2, end=T)]
    got = parts(spark, rows)
    assert sorted((r["id"], r["error"]) for r in got) == [("old2", -2), ("w0", -2)]
    assert evidence.comparisons(evidence.evidence(spark.createDataFrame(rows[:3], SCHEMA), "scope"), "scope").collect() == []
    assert len(parts(spark, [window(), window(rank=1, id="old")], 1)) == 1 and parts(spark, []) == []


def test_balanced_cap_keeps_extremes(spark):
    rows = [window(k, outdoor=fact(k - 10), target=fact(21 if k % 2 else 22)) for k in range(20)] + [window(30 + k, request=fact(0)) for k in range(9)]
    got = parts(spark, rows, 8)
    active = [r["outdoor"]["mean"] for r in got if r["part"] == "active"]
    assert sorted(active) == sorted(float(round(i * 19 / 7) - 10) for i in range(8)) and {-10.0, 9.0} <= set(active)
    assert sorted(r["id"] for r in got if r["part"] == "inactive") == ["w35", "w36", "w37", "w38"]
    assert [r["id"] for r in parts(spark, rows, 1) if r["part"] == "active"] == ["w19"]
    pairs = evidence.comparisons(evidence.evidence(spark.createDataFrame(rows, SCHEMA), "scope", 8), "scope").collect()
    assert len(pairs) == 2 and sum(r["windows"] for r in pairs) == 8


def test_snapshots(spark):
    a = {"name": "x", "online": True, "capabilities": ["b", "a"], "z3k_config": {"online": 1, "list": [2, 1], "capabilities": ["z", "y"]}, "io": {"temp": 20, "z3k-state": {"7": {"hour": 6, "temp": 1}, "8": {"temp": 2}}}}
    same = {"io": {"z3k-state": {"7": {"temp": 9, "hour": 6}}, "temp": 4}, "z3k_config": {"capabilities": ["y", "z"], "list": [2, 1], "online": 1}, "capabilities": ["a", "b"], "name": "x", "online": False, "weather": {"t": 1}}
    other = [a | {"name": "y"}, a | {"z3k_config": {"online": 1, "list": [1, 2], "capabilities": ["z", "y"]}}, a | {"io": {"z3k-state": {"7": {"hour": 7}}}}, {"raw": a, "discovered_at": 1}, a | {"capabilities": [1, "a"]}]
    assert snapshots.project(a) == snapshots.project(same) and all(snapshots.project(o) != snapshots.project(a) for o in other)
    assert snapshots.project({"raw": a, "discovered_at": 1}) == snapshots.project({"raw": same, "discovered_at": 2, "online": True})
    b = a | {"name": "b"}
    docs = [a, same, b, b | {"online": None}, a]
    rows = [(1, k, json.dumps(d)) for k, d in enumerate(docs)] + [(1, 9, "no json"), (1, 10, None), (2, 0, json.dumps(a))]
    got = snapshots.snapshots(spark.createDataFrame(rows, "device long, at long, document string"), "device", ["at"], "document").collect()
    assert sorted((r["device"], r["at"]) for r in got) == [(1, 0), (1, 2), (1, 4), (2, 0)]  # A, B, A
    assert len({r["fingerprint"] for r in got}) == 2
