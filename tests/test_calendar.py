"""Scheduled periods against a loop over days."""

from datetime import date, timedelta

from pyspark.sql import functions as F

from spanwise.operators import calendar


def _after(day, months):
    m = day.year * 12 + day.month - 1 + months
    return date(m // 12, m % 12 + 1, 1)


def _loop(first, today, cut):
    out, day = set(), first
    while day < today:
        week, month = day - timedelta(day.weekday()), day.replace(day=1)
        season = _after(month, -(day.month % 3))
        out |= {("weekly", week, week + timedelta(7))} if week + timedelta(7) <= today else set()
        out |= {("monthly", month, _after(month, 1))} if _after(month, 1) <= today else set()
        end = _after(season, 3) if _after(season, 3) <= today else cut
        out |= {("seasonal", season, end)} if end > season else set()
        day += timedelta(1)
    return out


def _rows(spark):
    spans = [(date(2023, 11, 30), date(2024, 3, 1)), (date(2024, 2, 28), date(2024, 3, 4)), (date(2024, 1, 1), date(2024, 1, 8)), (date(2024, 5, 31), date(2024, 6, 1)), (date(2020, 12, 15), date(2024, 2, 29)), (date(2024, 3, 3), date(2024, 3, 3)), (date(2024, 3, 5), date(2024, 3, 3)), (None, date(2024, 3, 3))]
    rows = [(k, a, t, t - timedelta(t.weekday())) for k, (a, t) in enumerate(spans)]
    return rows, spark.createDataFrame(rows, "k long, a date, t date, cut date")


def test_all_periods(spark):
    rows, df = _rows(spark)
    got = sorted(map(tuple, calendar.scheduled(df, "a", "t", "cut", ["k"]).collect()))
    assert got == sorted((k, *p) for k, a, t, cut in rows if a for p in _loop(a, t, cut))


def test_latest(spark):
    rows, df = _rows(spark)
    got = sorted(map(tuple, calendar.scheduled(df, "a", "t", "cut", ["k"], latest=2).collect()))
    kept = lambda found: [p for kind in ("weekly", "monthly", "seasonal") for p in sorted((x for x in found if x[0] == kind), key=lambda x: x[1])[-2:]]
    assert got == sorted((k, *p) for k, a, t, cut in rows if a for p in kept(_loop(a, t, cut)))


def test_long_spans(spark):
    """3,000 rows of 2,000 years give their latest without a row for each day."""
    df = spark.range(3000).select("id", *[F.lit(date(y, 1, 1)).alias(c) for c, y in (("a", 1000), ("t", 3000), ("cut", 3000))])
    assert calendar.scheduled(df, "a", "t", "cut", ["id"], latest=1).count() == 9000
