"""As-of, hold and nearest joins.

As-of joins stack both sides and carry the last right row forward: one exchange
and one sort by key, whatever the number of matches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from spanwise.operators.intervals import seconds


def as_of(left: DataFrame, right: DataFrame, key: str, ts: str, value: str, strict: bool = False, ttl: float | None = None) -> DataFrame:
    """left with ``value`` and ``value_ts`` of the last right row at or before its
    time (strict: before), not older than ttl seconds. Right null rows are
    explicit unknowns and count as the last row."""
    side = 1 if strict else 0  # of rows at one time, the right one comes last if strict
    rows = left.select("*", F.lit(None).cast(right.schema[ts].dataType).alias("__rts"), F.lit(None).cast(right.schema[value].dataType).alias("__v"), F.lit(1 - side).alias("__side"))
    other = right.select(key, ts, F.col(ts).alias("__rts"), F.col(value).alias("__v"), F.lit(side).alias("__side"))
    both = rows.withColumn("__left", F.lit(True)).unionByName(other.withColumn("__left", F.lit(False)), allowMissingColumns=True)
    order = Window.partitionBy(key).orderBy(ts, "__side").rowsBetween(Window.unboundedPreceding, 0)
    found = F.last(F.when(~F.col("__left"), F.struct("__rts", "__v")), ignorenulls=True).over(order)
    out = both.withColumn("__f", found).where("__left")
    fresh = F.lit(True) if ttl is None else seconds(F.col("__f.__rts"), F.col(ts)) <= ttl
    out = out.withColumn("value_ts", F.when(fresh, F.col("__f.__rts"))).withColumn(value, F.when(fresh, F.col("__f.__v")))
    return out.select(*left.columns, *[c for c in (value, "value_ts") if c not in left.columns])


def hold(segments: DataFrame, targets: DataFrame, key: str, ts: str, target: str) -> DataFrame:
    """Segments (start, end, ...) cut at each change of a held target, with the
    target of each piece (null: none yet or unknown)."""
    names = [c for c in segments.columns if c not in (key, "start", "end")]
    inner = segments.select(key, F.col("start").alias("at"), F.struct("end", *names).alias("seg"), F.lit(1).alias("kind"))
    inner = inner.union(segments.select(key, F.col("end").alias("at"), F.lit(None).cast(inner.schema["seg"].dataType), F.lit(0)))
    change = targets.select(key, F.col(ts).alias("at"), F.struct(F.col(target).alias("v")).alias("t"), F.lit(2).alias("kind"))
    rows = inner.withColumn("t", F.lit(None).cast(change.schema["t"].dataType)).unionByName(change, allowMissingColumns=True)
    order = Window.partitionBy(key).orderBy("at", "kind")
    back = order.rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("now", F.last(F.when(F.col("kind") < 2, F.struct("seg")), ignorenulls=True).over(back)).withColumn("held", F.last("t", ignorenulls=True).over(back))
    rows = rows.withColumn("next", F.lead("at").over(order)).where(F.col("now.seg").isNotNull())
    rows = rows.withColumn("end", F.least("next", F.col("now.seg.end"))).where("end > at")
    return rows.select(key, F.col("at").alias("start"), "end", *[F.col(f"now.seg.{c}").alias(c) for c in names], F.col("held.v").alias(target))


def within(left: DataFrame, right: DataFrame, key: str, ts: str, before: float, after: float) -> DataFrame:
    """Pairs of left (l_*) and right (r_*) rows of a key whose right time lies in
    [left - before, left + after]: an equi-join on key and time bucket."""
    width = max(1.0, before + after)
    at = lambda c: F.unix_micros(c) / F.lit(1e6)
    a = left.select(key, *[F.col(c).alias(f"l_{c}") for c in left.columns if c != key])
    a = a.withColumn("__b", F.explode(F.sequence(F.floor((at(f"l_{ts}") - before) / width), F.floor((at(f"l_{ts}") + after) / width))))
    b = right.select(key, *[F.col(c).alias(f"r_{c}") for c in right.columns if c != key]).withColumn("__b", F.floor(at(f"r_{ts}") / width))
    gap = seconds(f"l_{ts}", f"r_{ts}")
    return a.join(b, [key, "__b"]).withColumn("gap_s", gap).where((gap >= -before) & (gap <= after)).drop("__b")


def nearest(left: DataFrame, right: DataFrame, key: str, ts: str, id_column: str, tolerance: float) -> DataFrame:
    """For each left row with a right one within the tolerance, the nearest (the
    earlier of ties)."""
    met = within(left, right, key, ts, tolerance, tolerance)
    return met.groupBy(key, f"l_{id_column}").agg(F.min_by(f"r_{id_column}", F.struct(F.abs("gap_s"), F.col(f"r_{ts}"), F.col(f"r_{id_column}"))).alias("nearest_id"), F.min(F.abs("gap_s")).alias("gap_s"))
