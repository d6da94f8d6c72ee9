"""Day facts with a state that is carried from day to day, and their recomputation
where a late row changed a day.

A fold turns the rows of some days and the states they begin with into facts with the
state they end with (``boundary``). After a change the changed days are folded again;
where a boundary moves, the next day follows, until none moves. Days that are not
reached keep their files.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from datetime import date, timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from spanwise.session import materialize
from spanwise.sources.daytable import DayTable

DAY_S = 86_400.0
HELD = "series long, day date, samples long, known_s double, integral double, boundary double"


def held_days(rows: DataFrame, before: DataFrame) -> DataFrame:
    """The fold of a held value: rows (series, day, ts, seq, value), before (series,
    day, boundary). Each value holds until the next; of several at one time the last
    by seq counts. A day without rows passes its state on."""
    key = ["series", "day"]
    one = rows.where("value is not null").groupBy(*key, "ts").agg(F.max_by("value", "seq").alias("value"))
    own = Window.partitionBy(*key).orderBy("ts")
    at = (F.unix_micros("ts") - F.unix_micros(F.col("day").cast("timestamp"))) / 1e6
    spans = one.select(*key, "ts", "value", at.alias("at")).withColumn("sec", F.coalesce(F.lead("at").over(own), F.lit(DAY_S)) - F.col("at"))
    day = spans.groupBy(*key).agg(F.count("*").alias("samples"), F.min("at").alias("first"), F.sum(F.col("value") * F.col("sec")).alias("own"), F.max_by("value", "ts").alias("last"))
    both = day.join(before.withColumnRenamed("boundary", "carried"), key, "full")
    first, own_part = F.coalesce("first", F.lit(DAY_S)), F.coalesce("own", F.lit(0.0))
    known = F.when(F.col("carried").isNull(), DAY_S - first).otherwise(DAY_S)
    return both.select(*key, F.coalesce("samples", F.lit(0)).cast("long").alias("samples"), known.alias("known_s"),
                       (own_part + F.coalesce(F.col("carried") * first, F.lit(0.0))).alias("integral"), F.coalesce("last", "carried").alias("boundary"))


def recompute(samples: DayTable, facts: DayTable, days: Iterable[date], fold: Callable[[DataFrame, DataFrame], DataFrame] = held_days) -> list[date]:
    """Bring facts up to date after changes on ``days``; the days written."""
    known = samples.days()
    if not known:
        return []
    last, one, written = known[-1], timedelta(days=1), set()
    frontier = sorted(set(days))
    while frontier:
        before = facts.read([d - one for d in frontier]).where("boundary is not null").select("series", F.date_add("day", 1).alias("day"), "boundary")
        new = materialize(fold(samples.read(frontier), before), "day-facts")
        old = facts.read(frontier).select("series", "day", F.col("boundary").alias("was"))
        moved = new.select("series", "day", "boundary").join(old, ["series", "day"], "full").where(~F.col("boundary").eqNullSafe(F.col("was")))
        nexts = [r["day"] + one for r in moved.select("day").distinct().collect()]  # days, not rows
        facts.replace(new, frontier)
        written |= set(frontier)
        frontier = sorted(d for d in nexts if d <= last)
    return sorted(written)
