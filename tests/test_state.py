"""Scalar rules by closed forms, and stateful streams whose state spans batches."""

import hashlib
import json
from datetime import date, datetime, timedelta
from decimal import Decimal

import pytest
from pyspark.sql import functions as F
from spanwise.operators import scalars as sc
from spanwise.streaming import state
from spanwise.streaming.telemetry import drain

T = datetime(2026, 1, 1)


@pytest.mark.parametrize("text, found", [
    ("1,50", "1.5"), (" 007.10 ", "7.1"), ("0,000", "0"), (".5", "0.5"), ("5.", "5"), ("+3", "3"), ("100", "100"), ("123456789012345678", "123456789012345678"),
    ("1.000001", "1.000001"), ("1.0000001", None), ("1234567890123.456789", None), ("1,5.0", None), ("-1", None), ("", None), (".", None), ("nan", None), (None, None),
])
def test_prices(spark, text, found):
    assert spark.createDataFrame([(text,)], "t string").select(sc.price_text(F.col("t"))).first()[0] == found
    if found:
        assert Decimal(found) == Decimal(text.strip().replace(",", "."))


def test_sunrise(spark):
    rows = [(date(2026, 6, 21), 55.75, 37.62), (date(2026, 12, 21), 78.0, 15.0), (date(2026, 3, 20), 0.0, 0.0), (date(2026, 3, 20), 95.0, 0.0), (None, 1.0, 1.0), (date(2026, 6, 21), -36.85, 174.76)]
    df = spark.createDataFrame(rows, "d date, lat double, lon double")
    place = (F.col("d"), F.col("lat"), F.col("lon"))
    summer, polar, equator, nowhere, unknown, east = [r[0] for r in df.select(sc.sunrise_minutes(*place)).collect()]
    assert abs(summer - 45) < 3 and abs(equator - (6 * 60 + 4)) < 3  # 03:44 in Moscow's zone; near six on the equator
    assert polar is None and nowhere is None and unknown is None and east < 0
    got = df.where("lon > 100").select(sc.sunrise(*place, "Pacific/Auckland").alias("at")).select(F.date_format(F.from_utc_timestamp("at", "Pacific/Auckland"), "yyyy-MM-dd HH").alias("local")).first()[0]
    assert got == "2026-06-21 07"


def test_fingerprints(spark):
    df = spark.createDataFrame([(1.0, 'say "hi"\\\n', None), (0.5, "", 2.0)], "a double, b string, c double")
    got = [r[0] for r in df.select(sc.fingerprint("v", b=sc.text_value(F.col("b")), a=sc.number_text(F.col("a")), c=sc.number_text(F.col("c")))).collect()]
    want = [{"a": 1, "b": 'say "hi"\\\n', "c": None}, {"a": 0.5, "b": "", "c": 2}]
    assert got == ["v:" + hashlib.sha256(json.dumps(w, sort_keys=True, separators=(",", ":")).encode()).hexdigest() for w in want]


def test_bounded_text(spark):
    def plain(text, most):
        raw = text.encode()
        return text if len(raw) <= most else raw[: max(0, most - 13)].decode(errors="ignore") + ":" + hashlib.sha256(raw).hexdigest()[:12]

    texts = ["", "short", "x" * 24, "x" * 25, "é" * 12, "é" * 13, "a" + "é" * 20, "ab" + "你" * 9, "abc" + "\U0001f600" * 8, "a\ufffd" * 12]
    for most in (24, 13, 5):
        got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(sc.bounded_text(F.col("t"), most)).collect()]
        assert got == [plain(t, most) for t in texts]


def stream(spark, folder, batches, schema):
    """A stream with a micro-batch for each list of rows."""
    import os

    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/b{i}")
        part = next(f for f in os.listdir(f"{folder}/b{i}") if f.startswith("part"))
        os.makedirs(f"{folder}/in", exist_ok=True)
        os.rename(f"{folder}/b{i}/{part}", f"{folder}/in/{i}.parquet")
        os.utime(f"{folder}/in/{i}.parquet", (1_700_000_000 + i, 1_700_000_000 + i))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")


def at(hours):
    return T + timedelta(hours=hours)


def hours(us):
    return None if us is None else (datetime(1970, 1, 1) + timedelta(microseconds=us) - T).total_seconds() / 3600


def outages_of(spark, folder, batches):
    rows = stream(spark, str(folder), batches, "series long, ts timestamp, kind string").withWatermark("ts", "60 minutes")
    return sorted((r["series"], hours(r["lost_us"]), r["state"], hours(r["at_us"])) for r in drain(state.outages(rows), "t-outages", "append").collect())


def changes_of(spark, folder, batches):
    rows = stream(spark, str(folder), batches, "series long, ts timestamp, version long").withWatermark("ts", "60 minutes")
    return sorted((r["series"], hours(r["us"]), r["version"], r["was"], hours(r["after_us"])) for r in drain(state.setting_changes(rows), "t-settings", "append").collect())


def test_outages_span_batches(spark, tmp_path):
    batches = [
        [(1, at(0), "loss"), (2, at(0), "loss"), (3, at(0), "loss"), (4, at(0), "restore")],
        [(1, at(1), "restore"), (2, at(3), "restore"), (4, at(3.5), "loss")],  # 1 is restored in time
        [(5, at(10), "restore"), (3, at(9), "loss")],  # 3 and 4 are open past their timers
        [(3, at(12), "restore"), (6, at(12), "loss")],  # 6 is open, but not for long
        [(7, at(16), "other"), (8, at(15), "loss")],  # a row of another kind moves the time past 6's timer
    ]
    assert outages_of(spark, tmp_path, batches) == sorted([(2, 0, "lost", 2), (2, 0, "restored", 3), (3, 0, "lost", 2), (3, 0, "restored", 12), (4, 3.5, "lost", 5.5), (6, 12, "lost", 14)])


def test_late_restore_within_the_watermark_counts(spark, tmp_path):
    """The restore of 1.5 h comes a batch after the loss of 2.4 h."""
    end = [(9, at(30), "other")]
    batches = [[(1, at(0), "loss")], [(1, at(2.4), "loss")], [(1, at(1.5), "restore")], end]
    want = [(1, 2.4, "lost", 4.4)]
    assert outages_of(spark, tmp_path / "cut", batches) == want
    assert outages_of(spark, tmp_path / "one", [sum(batches[:3], []), end]) == want


@pytest.mark.parametrize("seed", [0, 1])
def test_any_cut_into_batches_gives_one_result(spark, tmp_path, seed):
    """Rows come up to 55 minutes out of order, in batches cut anywhere."""
    import random

    rng = random.Random(seed)
    losses = [(rng.randrange(3), at(rng.randrange(0, 1200) / 60), rng.choice(["loss", "restore"])) for _ in range(40)]
    versions = [(s, t, rng.randrange(3)) for s, t, _ in losses]
    order = sorted(range(40), key=lambda k: (losses[k][1], k))
    order.sort(key=lambda k: losses[k][1] + timedelta(minutes=rng.randrange(56)))
    cut = sorted(rng.sample(range(1, 40), 3))
    parts = [order[a:b] for a, b in zip([0, *cut], [*cut, 40])]
    for name, run, rows, end in (("o", outages_of, losses, (9, at(60), "other")), ("s", changes_of, versions, (9, at(60), None))):
        whole = run(spark, tmp_path / f"{name}1", [rows, [end]])
        assert whole and run(spark, tmp_path / f"{name}2", [*[[rows[k] for k in p] for p in parts], [end]]) == whole


def test_setting_changes_span_batches(spark, tmp_path):
    """9 comes a batch late, but the watermark has not passed it; 8 comes after that."""
    batches = [[(1, at(0), 5), (1, at(1), 5), (2, at(0), None)], [(1, at(2), 5), (1, at(0.5), 9), (2, at(2), 1)], [(1, at(3), 6), (1, at(4), 5)], [(1, at(1.5), 8), (3, at(30), None)]]
    got = changes_of(spark, tmp_path, batches)
    assert got == [(1, 0, 5, None, None), (1, 0.5, 9, 5, 0), (1, 1, 5, 9, 0.5), (1, 3, 6, 5, 2), (1, 4, 5, 6, 3), (2, 2, 1, None, None)]


def test_series_without_output_make_no_frames(monkeypatch):
    """A frame for each series and batch costs more than its rows: none where there is nothing to say."""
    from unittest.mock import MagicMock

    import pandas as pd

    columns = MagicMock()
    columns.col.return_value.__eq__ = lambda *_: columns.col.return_value
    monkeypatch.setattr(state, "F", columns)
    rows = MagicMock()
    grouped = rows.where.return_value.select.return_value.groupBy.return_value
    for make in (state.outages, state.setting_changes):
        make(rows)
        step = grouped.applyInPandasWithState.call_args[0][0]
        kept = MagicMock(exists=False, hasTimedOut=False)
        kept.getCurrentWatermarkMs.return_value = 0
        assert list(step((1,), iter([pd.DataFrame({"us": [5], "kind": [1]})]), kept)) == []
