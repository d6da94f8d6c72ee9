"""When a disturbed room is steady again, day by day in parallel.

An interval opens a recovery (a trigger, or an unknown room or target), is steady, or
neither. Three steady intervals that touch and end at measurements, with nothing else
between, close it. What a day does to the state it starts with (open or not, how many
steady intervals in a row) is a small summary: days are summarised on their own, the
summaries are folded in order, one row a day, and each day then gets its state. No
series goes through one task with all its intervals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from spanwise.operators.intervals import seconds

BAND, SLOPE, NEEDED = 0.2, 0.3, 3
STATE = "struct<open: boolean, count: int, end: timestamp>"


def steady(room_left: Column, room_right: Column, target: Column, trigger: Column, band: float = BAND, slope: float = SLOPE) -> Column:
    """Within ``band`` of the target at its end, changing by ``slope`` an hour at most,
    and without a trigger; false where something is unknown."""
    rate = F.abs(room_right - room_left) * 3600 / seconds("start", "end")
    return F.coalesce((F.abs(room_right - target) <= band) & (rate <= slope) & ~trigger, F.lit(False))


def _marked(df: DataFrame, key: str) -> DataFrame:
    """Intervals (opens, steady, measured) with their place within the day."""
    own = Window.partitionBy(key, "day").orderBy("start", "end")
    rows = df.withColumn("day", F.to_date("start"))
    touch = F.coalesce(F.lag("end").over(own) == F.col("start"), F.lit(True))  # a day's first one is settled with what is carried in
    rows = rows.withColumn("__hit", F.col("steady") & F.col("measured") & ~F.col("opens"))
    rows = rows.withColumn("__reset", F.when(F.col("opens") | ~F.col("steady") | ~touch, 1).otherwise(0)).withColumn("__part", F.sum("__reset").over(own))
    within = Window.partitionBy(key, "day", "__part").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("__hits", F.count_if("__hit").over(within))
    closes = F.col("__hit") & (F.col("__hits") == NEEDED) & (F.col("__part") > 0)
    return rows.withColumn("__event", F.when(F.col("opens"), True).when(closes, False))


def day_summaries(marked: DataFrame, key: str) -> DataFrame:
    """What each day does to a state: the state it sets, if it does, and the steady
    intervals at its beginning and end."""
    last = F.max("__part").over(Window.partitionBy(key, "day"))
    rows = marked.withColumn("__last", last)
    place = F.struct("start", "end")
    return rows.groupBy(key, "day").agg(
        F.min("start").alias("first"), F.max_by("end", place).alias("until"), F.count_if(F.col("__hit") & (F.col("__part") == 0)).cast("int").alias("head"), (F.max("__part") > 0).alias("resets"),
        F.count_if(F.col("__hit") & (F.col("__part") == F.col("__last"))).cast("int").alias("tail"), F.max_by(F.col("__event"), F.when(F.col("__event").isNotNull(), place)).alias("event"))


def _after(state: Column, day: Column) -> Column:
    """The state a day ends with."""
    count = F.when(state["end"] == day["first"], state["count"]).otherwise(0)
    opened = F.coalesce(day["event"], state["open"] & (count + day["head"] < NEEDED))
    return F.struct(opened.alias("open"), F.least(F.lit(NEEDED), F.when(day["resets"], day["tail"]).otherwise(count + day["head"])).cast("int").alias("count"), day["until"].alias("end"))


def carried(summaries: DataFrame, key: str) -> DataFrame:
    """(key, day, state): what each day starts with, by a fold over its days."""
    days = F.array_sort(F.collect_list(F.struct("day", "first", "until", "head", "resets", "tail", "event")))
    none = F.lit(None).cast("timestamp")
    begin = F.struct(F.lit(False).alias("open"), F.lit(0).alias("count"), none.alias("end"))
    told = F.array(F.struct(F.lit(None).cast("date").alias("day"), begin.alias("state")))
    step = lambda acc, d: F.concat(acc, F.array(F.struct(d["day"].alias("day"), _after(F.element_at(acc, -1)["state"], d).alias("state"))))
    folded = summaries.groupBy(key).agg(days.alias("days")).withColumn("states", F.aggregate("days", told, step))
    # the state before a day is the one after the day before it
    pairs = F.zip_with("days", F.slice("states", 1, F.size("days")), lambda d, s: F.struct(d["day"].alias("day"), s["state"].alias("state")))
    return folded.select(key, F.explode(pairs).alias("p")).select(key, "p.day", "p.state")


def recovering(df: DataFrame, key: str) -> DataFrame:
    """df (key, start, end, opens, steady, measured, more) with day and recovering. The
    interval that closes a recovery still belongs to it."""
    marked = _marked(df, key)
    summaries = day_summaries(marked, key)
    states = carried(summaries, key).join(summaries.select(key, "day", "first", "head"), [key, "day"])
    count = F.when(F.col("state.end") == F.col("first"), F.col("state.count")).otherwise(0)
    rows = marked.join(states.select(key, "day", "head", F.col("state.open").alias("__open"), count.alias("__count")), [key, "day"])
    before = Window.partitionBy(key, "day").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    hits = F.when(F.col("__part") == 0, F.col("__hits") - F.col("__hit").cast("int")).otherwise(F.col("head"))
    now = F.coalesce(F.last("__event", ignorenulls=True).over(before), F.col("__open") & (F.col("__count") + hits < NEEDED))
    return rows.withColumn("recovering", F.col("opens") | now).select(*df.columns, "day", "recovering")


def windows(rows: DataFrame, key: str) -> DataFrame:
    """(key, day, recovering_s, intervals): seconds to leave out by day."""
    return rows.groupBy(key, "day").agg(F.sum(F.when(F.col("recovering"), seconds("start", "end")).otherwise(0.0)).alias("recovering_s"), F.count("*").alias("intervals"))
