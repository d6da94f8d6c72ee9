"""Micro-batches that are merged into a table of days, and recomputed day facts."""

from datetime import date, datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F
from spanwise.operators.recompute import HELD, held_days, recompute
from spanwise.sources.daytable import DayTable
from spanwise.streaming.upsert import SAMPLE

T = datetime(2024, 1, 1)


def rows(rng, n, days=6):
    out = []
    for k in range(n):
        ts = T + timedelta(minutes=int(rng.integers(0, days * 144)) * 10)
        out.append((int(rng.integers(0, 4)), ts.date(), ts, k, None if rng.random() < 0.05 else float(rng.integers(0, 50))))
    return out


def table(spark, folder, name, keys=("series", "ts"), schema=SAMPLE):
    return DayTable(spark, f"{folder}/{name}", list(keys), schema)


def content(t):
    return sorted((tuple(r) for r in t.read().collect()), key=str)


@pytest.mark.parametrize("seed", [0, 1])
def test_any_cut_into_batches_gives_one_table(spark, tmp_path, seed):
    rng = np.random.default_rng(seed)
    all_rows = rows(rng, 200)
    want = {}
    for r in all_rows:
        if (r[0], r[2]) not in want or want[r[0], r[2]][3] < r[3]:
            want[r[0], r[2]] = r
    order = rng.permutation(len(all_rows))
    cuts = [0, *sorted(rng.integers(0, 200, 2).tolist()), 200]
    t = table(spark, tmp_path, "t")
    for k, (a, b) in enumerate(zip(cuts[:-1], cuts[1:])):
        t.upsert(spark.createDataFrame([all_rows[i] for i in order[a:b]], SAMPLE), k, "seq")
    assert content(t) == sorted(want.values(), key=str)
    before = t.manifest()
    assert t.upsert(spark.createDataFrame(all_rows[:50], SAMPLE), 2, "seq") == [] and t.manifest() == before  # replayed batch


def test_half_batch_is_not_seen(spark, tmp_path):
    rng = np.random.default_rng(7)
    first, second = rows(rng, 60), [(*r[:3], r[3] + 1000, r[4]) for r in rows(rng, 60)]
    whole, broken = table(spark, tmp_path, "whole"), table(spark, tmp_path, "broken")
    for t in (whole, broken):
        t.upsert(spark.createDataFrame(first, SAMPLE), 0, "seq")
    seen = content(broken)
    bad = spark.createDataFrame(second, SAMPLE).withColumn("value", F.when(F.col("series") == 3, F.raise_error(F.lit("lost")).cast("double")).otherwise(F.col("value")))
    with pytest.raises(Exception, match="lost"):
        broken.upsert(bad, 1, "seq")
    assert content(broken) == seen
    # data written, but no manifest: the folder is read by none
    spark.createDataFrame(second, SAMPLE).write.partitionBy("day").parquet(f"{tmp_path}/broken/data/orphan")
    assert content(broken) == seen
    for t in (whole, broken):
        t.upsert(spark.createDataFrame(second, SAMPLE), 1, "seq")
    assert content(whole) == content(broken)


def test_markers_name_changed_days_alone(spark, tmp_path):
    t = table(spark, tmp_path, "t")
    base = [(1, (T + timedelta(days=d)).date(), T + timedelta(days=d, hours=5), d, float(d)) for d in range(4)]
    assert len(t.upsert(spark.createDataFrame(base, SAMPLE), 0, "seq")) == 4
    again = [(*base[0][:3], 50, 0.0), (*base[2][:3], 51, 9.0)]  # the same value told again, and a new one
    assert t.upsert(spark.createDataFrame(again, SAMPLE), 1, "seq") == [base[2][1]]
    assert t.upsert(spark.createDataFrame([(*base[3][:3], -1, 7.0)], SAMPLE), 2, "seq") == []  # older than what is there
    assert {r[4] for r in content(t)} == {0.0, 1.0, 9.0, 3.0}
    assert t.read([base[1][1]]).count() == 1 and t.read([date(1999, 1, 1)]).count() == 0


def test_late_row_changes_its_days_alone(spark, tmp_path):
    samples, facts = table(spark, tmp_path, "s", ("series", "ts", "seq")), table(spark, tmp_path, "f", ("series",), HELD)
    day = lambda d: (T + timedelta(days=d)).date()
    base = [(1, day(d), T + timedelta(days=d, hours=6), d, float(d + 1)) for d in (0, 1, 4, 5)] + [(2, day(0), T, 9, 5.0)]
    recompute(samples, facts, samples.upsert(spark.createDataFrame(base, SAMPLE), 0, "seq"))
    held = facts.manifest()["days"]
    assert content(facts) and facts.days() == [day(d) for d in range(6)]
    late = [(1, day(1), T + timedelta(days=1, hours=12), 99, 40.0)]
    written = recompute(samples, facts, samples.upsert(spark.createDataFrame(late, SAMPLE), 1, "seq"))
    assert written == [day(1), day(2), day(3), day(4)]  # two days without rows pass it on; the one with rows stops it
    now = facts.manifest()["days"]
    assert {d for d in now if now[d] != held[d]} == {str(d) for d in written}
    got = {(r["series"], r["day"]): r for r in facts.read().collect()}
    assert got[1, day(1)]["integral"] == 1 * 6 * 3600 + 2 * 6 * 3600 + 40 * 12 * 3600 and got[1, day(2)]["integral"] == 40 * 86400
    assert got[1, day(4)]["integral"] == 40 * 6 * 3600 + 5 * 18 * 3600 and got[1, day(0)]["known_s"] == 18 * 3600
    same = [(1, day(0), T + timedelta(hours=3), 100, 7.0)]  # the day ends as before: no day after it is read or written
    assert recompute(samples, facts, samples.upsert(spark.createDataFrame(same, SAMPLE), 2, "seq")) == [day(0)]


def test_recomputed_equals_full_run(spark, tmp_path):
    rng = np.random.default_rng(3)
    every = rows(rng, 80, 8)
    samples, facts = table(spark, tmp_path, "s", ("series", "ts", "seq")), table(spark, tmp_path, "f", ("series",), HELD)
    for k, part in enumerate((every[:50], every[50:65], every[65:])):
        recompute(samples, facts, samples.upsert(spark.createDataFrame(part, SAMPLE), k, "seq"))
    once, full = table(spark, tmp_path, "s1", ("series", "ts", "seq")), table(spark, tmp_path, "f1", ("series",), HELD)
    recompute(once, full, once.upsert(spark.createDataFrame(every, SAMPLE), 0, "seq"))
    assert content(facts) == content(full)


def test_empty(spark, tmp_path):
    t = table(spark, tmp_path, "t")
    assert t.upsert(spark.createDataFrame([], SAMPLE), 0, "seq") == [] and content(t) == []
    assert held_days(t.read(), spark.createDataFrame([], "series long, day date, boundary double")).count() == 0
