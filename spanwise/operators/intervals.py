"""Samples to intervals, and the algebra of half-open intervals.

All operators take rows of many keys at once and keep to one exchange by key:
consecutive windows share partitioning and order. Seconds are doubles; a null
value is an explicit unknown and never counts as zero."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def seconds(a, b) -> Column:
    """Seconds from a to b."""
    a, b = (F.col(x) if isinstance(x, str) else x for x in (a, b))
    return (F.unix_micros(b) - F.unix_micros(a)) / F.lit(1e6)


def last_wins(df: DataFrame, key: str, ts: str, order: str) -> DataFrame:
    """One row for each key and time: the one with the greatest order."""
    rest = [c for c in df.columns if c not in (key, ts)]
    return df.groupBy(key, ts).agg(F.max_by(F.struct(*rest), order).alias("r")).select(key, ts, "r.*")


def unknown_on_conflict(df: DataFrame, key: str, ts: str, value: str) -> DataFrame:
    """One row for each key and time; null where values differ or are unknown."""
    known = F.count(value) == F.count(F.lit(1))
    return df.groupBy(key, ts).agg(F.when(known & (F.min(value) == F.max(value)), F.min(value)).alias(value))


def segments(df: DataFrame, key: str, ts: str, value: str, factor: float = 2.5, least: float = 60.0) -> DataFrame:
    """(key, start, end, value, sec): each sample until the next one, where the
    gap is at most ``factor`` medians of the key's gaps, and at least ``least``."""
    own = Window.partitionBy(key)
    rows = df.where(F.col(value).isNotNull()).select(key, F.col(ts).alias("start"), F.lead(ts).over(own.orderBy(ts)).alias("end"), value)
    rows = rows.withColumn("sec", F.when(F.col("end") > F.col("start"), seconds("start", "end")))
    rows = rows.withColumn("cap", F.greatest(F.lit(least), factor * F.median("sec").over(own)))
    return rows.where("sec <= cap").drop("cap")


def held_segments(df: DataFrame, key: str, ts: str, value: str, longest: float, until: Column) -> DataFrame:
    """(key, start, end, value): state intervals with a fixed greatest gap and an
    open tail to ``until``; longer gaps end at the sample's age limit."""
    nxt = F.coalesce(F.lead(ts).over(Window.partitionBy(key).orderBy(ts)), until)
    rows = df.select(key, F.col(ts).alias("start"), nxt.alias("end"), value)
    return rows.where((F.col("end") > F.col("start")) & (seconds("start", "end") <= longest))


def transitions(df: DataFrame, key: str, ts: str, value: str) -> DataFrame:
    """The first row of a key and the rows whose value differs from the one
    before; null is a value."""
    own = Window.partitionBy(key).orderBy(ts)
    rows = df.withColumn("__n", F.row_number().over(own)).withColumn("__was", F.lag(value).over(own))
    return rows.where((F.col("__n") == 1) | ~F.col(value).eqNullSafe(F.col("__was"))).drop("__n", "__was")


def merge(df: DataFrame, key: str, tolerance: float = 0.0) -> DataFrame:
    """(key, start, end): intervals that overlap, or are apart by at most
    ``tolerance`` seconds, as one."""
    order = Window.partitionBy(key).orderBy("start", "end")
    reach = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    new = F.when(reach.isNull() | (seconds(reach, F.col("start")) > tolerance), 1).otherwise(0)
    island = F.sum("__new").over(order.rowsBetween(Window.unboundedPreceding, 0))
    rows = df.select(key, "start", "end").withColumn("__new", new).withColumn("__island", island)
    return rows.groupBy(key, "__island").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("__island")


def subtract(included: DataFrame, excluded: DataFrame, key: str) -> DataFrame:
    """(key, start, end): what of the included intervals no excluded one covers,
    by a sweep over the edges of both."""
    def edges(df: DataFrame, a: int, b: int) -> DataFrame:
        both = F.array(F.struct(F.col("start").alias("at"), F.lit(a).alias("a"), F.lit(b).alias("b")), F.struct(F.col("end").alias("at"), F.lit(-a).alias("a"), F.lit(-b).alias("b")))
        return df.select(key, F.explode(both).alias("e")).select(key, "e.*")

    at = edges(included, 1, 0).union(edges(excluded, 0, 1)).groupBy(key, "at").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    own = Window.partitionBy(key).orderBy("at")
    rows = at.select(key, F.col("at").alias("start"), F.lead("at").over(own).alias("end"), F.sum("a").over(own).alias("a"), F.sum("b").over(own).alias("b"))
    return merge(rows.where("a > 0 and b = 0 and end is not null"), key)


def buckets(start: Column, end: Column, width: int) -> Column:
    """Numbers of the time buckets of ``width`` seconds that [start, end) meets."""
    first = F.floor(F.unix_seconds(start) / width)
    last = F.floor((F.unix_micros(end) - 1) / (1_000_000 * width))
    return F.sequence(first, F.greatest(first, last))


def overlaps(left: DataFrame, right: DataFrame, key: str, width: int = 86_400) -> DataFrame:
    """Pairs of intervals of a key that overlap (columns of right renamed r_*):
    an equi-join on key and time bucket, each pair kept in the bucket that holds
    its common start. Hot keys spread over their buckets."""
    a = left.withColumn("__b", F.explode(buckets(F.col("start"), F.col("end"), width)))
    b = right.select(*[F.col(c).alias(c if c == key else f"r_{c}") for c in right.columns])
    b = b.withColumn("__b", F.explode(buckets(F.col("r_start"), F.col("r_end"), width)))
    met = a.join(b, [key, "__b"]).where("start < r_end and end > r_start")
    return met.where(F.floor(F.unix_seconds(F.greatest("start", "r_start")) / width) == F.col("__b")).drop("__b")


def loss_restore(df: DataFrame, key: str, ts: str, kind: str, loss: str, restore: str, order: str) -> DataFrame:
    """(key, start, end): from the first loss to the next restore; end is null
    where it is still open."""
    own = Window.partitionBy(key).orderBy(ts, order)
    rows = transitions(df.where(F.col(kind).isin(loss, restore)), key, ts, kind)
    return rows.withColumn("end", F.lead(ts).over(own)).where(F.col(kind) == loss).select(key, F.col(ts).alias("start"), "end")


def gaps(df: DataFrame, key: str, ts: str, longest: float) -> DataFrame:
    """(key, start, end): times without a fresh sample, from its age limit on."""
    nxt = F.lead(ts).over(Window.partitionBy(key).orderBy(ts))
    rows = df.select(key, ts, nxt.alias("end")).where(seconds(F.col(ts), F.col("end")) > longest)
    return rows.select(key, F.timestamp_micros(F.unix_micros(ts) + F.lit(int(longest * 1e6))).alias("start"), "end")


def by_day(df: DataFrame, key: str) -> DataFrame:
    """Intervals cut at midnight (of the session's zone): day, start, end, sec."""
    day = F.explode(F.sequence(F.to_date("start"), F.to_date(F.timestamp_micros(F.unix_micros("end") - 1)), F.expr("interval 1 day")))
    rows = df.withColumn("day", day)
    rows = rows.withColumn("start", F.greatest("start", F.to_timestamp("day"))).withColumn("end", F.least("end", F.to_timestamp(F.date_add("day", 1))))
    return rows.withColumn("sec", seconds("start", "end")).where("sec > 0")


def overlapping(df: DataFrame, key: str) -> DataFrame:
    """Intervals with a mark: does the one before or after in order overlap?"""
    own = Window.partitionBy(key).orderBy("start", "end")
    before, after = F.lag("end").over(own), F.lead("start").over(own)
    return df.withColumn("overlaps", F.coalesce(before > F.col("start"), F.lit(False)) | F.coalesce(after < F.col("end"), F.lit(False)))
