"""Neighbours, last known values and running maxima of long series in two levels.

A window runs within a key's time buckets; what crosses a bucket's border comes from
one row a bucket, windowed by key and joined back. A series that holds a third of
all rows is spread over its buckets, and only its borders meet in one task. Rows of one
time are told apart by ``order``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

WIDTH = 86_400  #: seconds of a bucket


def bucketed(df: DataFrame, ts: str, width: int = WIDTH) -> DataFrame:
    return df.withColumn("__bucket", F.floor(F.unix_micros(ts) / (1_000_000 * width)))


def following(df: DataFrame, key: str, order: list[str], value: Column, name: str, width: int = WIDTH) -> DataFrame:
    """df with ``name``: value (a struct, of the row's own columns) of the next row of
    the key. order: the time, and what tells rows of one time apart."""
    rows = bucketed(df, order[0], width).withColumn("__value", value)
    within = Window.partitionBy(key, "__bucket").orderBy(*order)
    heads = rows.groupBy(key, "__bucket").agg(F.min_by("__value", F.struct(*order)).alias("__head"))
    heads = heads.select(key, "__bucket", F.lead("__head").over(Window.partitionBy(key).orderBy("__bucket")).alias("__then"))
    rows = rows.withColumn("__next", F.lead("__value").over(within)).join(heads, [key, "__bucket"])
    return rows.select(*df.columns, F.coalesce("__next", "__then").alias(name))


def last_known(df: DataFrame, key: str, order: list[str], value: Column, name: str, width: int = WIDTH) -> DataFrame:
    """df with ``name``: the last value (a struct; null rows have none) at or before
    each row."""
    rows = bucketed(df, order[0], width).withColumn("__value", value)
    within = Window.partitionBy(key, "__bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    tails = rows.groupBy(key, "__bucket").agg(F.max_by("__value", F.when(F.col("__value").isNotNull(), F.struct(*order))).alias("__tail"))
    back = Window.partitionBy(key).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    tails = tails.select(key, "__bucket", F.last("__tail", ignorenulls=True).over(back).alias("__carried"))
    rows = rows.withColumn("__now", F.last("__value", ignorenulls=True).over(within)).join(tails, [key, "__bucket"])
    return rows.select(*df.columns, F.coalesce("__now", "__carried").alias(name))


def greatest_before(df: DataFrame, key: str, order: list[str], value: str, name: str, width: int = WIDTH) -> DataFrame:
    """df with ``name``: the greatest value of the rows before each row."""
    rows = bucketed(df, order[0], width)
    within = Window.partitionBy(key, "__bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    tops = rows.groupBy(key, "__bucket").agg(F.max(value).alias("__top"))
    back = Window.partitionBy(key).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    tops = tops.select(key, "__bucket", F.max("__top").over(back).alias("__carried"))
    rows = rows.withColumn("__now", F.max(value).over(within)).join(tops, [key, "__bucket"])
    return rows.select(*df.columns, F.greatest("__now", "__carried").alias(name))


def running_count(df: DataFrame, key: str, order: list[str], marked: Column, name: str, width: int = WIDTH) -> DataFrame:
    """df with ``name``: the number of marked rows at or before each row."""
    rows = bucketed(df, order[0], width).withColumn("__one", F.when(marked, 1).otherwise(0))
    within = Window.partitionBy(key, "__bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    sums = rows.groupBy(key, "__bucket").agg(F.sum("__one").alias("__sum"))
    back = Window.partitionBy(key).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(key, "__bucket", F.coalesce(F.sum("__sum").over(back), F.lit(0)).alias("__before"))
    rows = rows.withColumn("__now", F.sum("__one").over(within)).join(sums, [key, "__bucket"])
    return rows.select(*df.columns, (F.col("__now") + F.col("__before")).alias(name))


def segments(df: DataFrame, key: str, ts: str, value: str, order: str, factor: float = 2.5, least: float = 60.0, width: int = WIDTH) -> DataFrame:
    """(key, start, end, value, sec) like ``intervals.segments``: each known sample until
    the next, the last by ``order`` of several at one time, where the gap is at most
    ``factor`` medians of the key's gaps, an aggregate joined back."""
    known = df.where(F.col(value).isNotNull()).groupBy(key, F.col(ts).alias("start")).agg(F.max_by(value, order).alias(value))
    rows = following(known, key, ["start"], F.struct("start"), "__then", width).withColumn("end", F.col("__then.start"))
    rows = rows.withColumn("sec", (F.unix_micros("end") - F.unix_micros("start")) / 1e6).drop("__then")
    caps = rows.groupBy(key).agg(F.greatest(F.lit(least), factor * F.median("sec")).alias("__cap"))
    return rows.join(caps, key).where("sec <= __cap").select(key, "start", "end", value, "sec")


def merge(df: DataFrame, key: str, tolerance: float = 0.0, width: int = WIDTH) -> DataFrame:
    """(key, start, end) like ``intervals.merge``."""
    rows = greatest_before(df.select(key, "start", "end"), key, ["start", "end"], "end", "__reach", width)
    new = F.col("__reach").isNull() | ((F.unix_micros("start") - F.unix_micros("__reach")) / 1e6 > tolerance)
    rows = running_count(rows.withColumn("__new", new), key, ["start", "end", "__reach"], F.col("__new"), "__island", width)
    return rows.groupBy(key, "__island").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("__island")


def as_of(left: DataFrame, right: DataFrame, key: str, ts: str, value: str, order: str, strict: bool = False, ttl: float | None = None, width: int = WIDTH) -> DataFrame:
    """left with ``value`` and ``value_ts`` like ``joins.as_of``; of right rows at one
    time the last by ``order`` counts, known or not."""
    side = 1 if strict else 0
    one = right.groupBy(key, ts).agg(F.max_by(F.struct(value), order).alias("__v"))
    found = F.struct(F.col(ts).alias("at"), F.col("__v")[value].alias("v"))
    rows = left.withColumn("__side", F.lit(1 - side)).withColumn("__row", F.xxhash64(*left.columns)).withColumn("__found", F.lit(None).cast(one.select(found.alias("x")).schema["x"].dataType))
    other = one.select(key, ts, F.lit(side).alias("__side"), F.lit(0).cast("long").alias("__row"), found.alias("__found"))
    both = rows.withColumn("__left", F.lit(True)).unionByName(other.withColumn("__left", F.lit(False)), allowMissingColumns=True)
    out = last_known(both, key, [ts, "__side", "__row"], F.col("__found"), "__last", width).where("__left")
    fresh = F.lit(True) if ttl is None else (F.unix_micros(ts) - F.unix_micros("__last.at")) / 1e6 <= ttl
    out = out.withColumn("value_ts", F.when(fresh, F.col("__last.at"))).withColumn(value, F.when(fresh, F.col("__last.v")))
    return out.select(*left.columns, *[c for c in (value, "value_ts") if c not in left.columns])
