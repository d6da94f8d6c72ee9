"""Calendar periods of local days: days, ISO weeks, months and seasons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: First month and day of each season; a winter is named for the year it ends in.
SEASONS = {"winter": "12-01", "spring": "03-01", "summer": "06-01", "autumn": "09-01"}


def period_of(kind: str, day: Column) -> tuple[Column, Column]:
    """First day of the period that holds a day, and of the one after."""
    if kind == "daily":
        return day, F.date_add(day, 1)
    first = F.trunc(day, "week" if kind == "weekly" else "month")
    return first, (F.date_add(first, 7) if kind == "weekly" else F.add_months(first, 1))


def season_of(day: Column) -> Column:
    """(season, year, first, after) of a day."""
    month = F.month(day)
    name = F.when(month.isin(12, 1, 2), "winter").when(month < 6, "spring").when(month < 9, "summer").otherwise("autumn")
    first = F.make_date(F.year(day) - F.when(month < 3, 1).otherwise(0), F.when(month.isin(12, 1, 2), 12).otherwise(F.floor(month / 3).cast("int") * 3), F.lit(1))
    return F.struct(name.alias("season"), (F.year(day) + F.when(month == 12, 1).otherwise(0)).alias("year"), first.alias("first"), F.add_months(first, 3).alias("after"))


def midnight(day: Column, zone: str) -> Column:
    """The instant a local day begins."""
    return F.to_utc_timestamp(day.cast("timestamp"), zone)


def scheduled(df: DataFrame, first: str, today: str, weekly_cutoff: str, keys: list[str], latest: int | None = None) -> DataFrame:
    """Completed weeks and months between two days of each row, and seasons up to
    the day they are observed to. latest: only so many of a kind from each row, the
    latest; a key's latest are among those of its rows. No row is made for a day."""
    a, t = F.col(first), F.col(today)
    starts = lambda low, high, step: F.when(low <= high, F.sequence(low, high, F.expr(f"interval {step}")))
    period = lambda kind, after: lambda f: F.struct(F.lit(kind).alias("kind"), f.alias("first"), after(f).alias("after"))
    observed = lambda f: F.when(F.add_months(f, 3) <= t, F.add_months(f, 3)).otherwise(F.col(weekly_cutoff))
    found = [
        F.transform(starts(F.trunc(a, "week"), F.date_sub(t, 7), "7 days"), period("weekly", lambda f: F.date_add(f, 7))),
        F.transform(starts(F.trunc(a, "month"), F.add_months(F.trunc(t, "month"), -1), "1 month"), period("monthly", lambda f: F.add_months(f, 1))),
        F.filter(F.transform(starts(season_of(a)["first"], season_of(F.date_sub(t, 1))["first"], "3 months"), period("seasonal", observed)), lambda p: p["after"] > p["first"]),
    ]
    kept = [F.coalesce(x if latest is None else F.slice(F.reverse(x), 1, latest), F.array()) for x in found]
    return df.where(a < t).select(*keys, F.explode(F.concat(*kept)).alias("__p")).select(*keys, "__p.*").distinct()
