"""Signals as usable pieces: how long a sample holds, alignment of several
signals, and statistics of pieces. A measurement expires, a setpoint holds until
changed or unknown; a null value ends what came before it."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from spanwise.operators.intervals import seconds


def later(ts, by: Column) -> Column:
    """A time some seconds later."""
    return F.timestamp_micros(F.unix_micros(ts) + F.round(by * 1_000_000).cast("long"))


def median_gap(df: DataFrame, key: str, ts: str) -> DataFrame:
    """(key, median_gap) of the positive gaps of a key: an aggregate of one row a
    key, to be joined back."""
    own = Window.partitionBy(key).orderBy(ts)
    gap = F.nullif(seconds(ts, F.lead(ts).over(own)), F.lit(0.0))
    return df.select(key, gap.alias("__g")).groupBy(key).agg(F.median("__g").alias("median_gap"))


def capped_states(df: DataFrame, key: str, ts: str, start: Column, end: Column, least: float, most: float | None = None) -> DataFrame:
    """Each sample until the next, clipped to [start, end), where the unclipped gap
    is at most three median gaps, within ``least`` and ``most`` seconds."""
    cap = F.greatest(3 * F.col("median_gap"), F.lit(least))
    cap = F.least(cap, F.lit(most)) if most else cap
    rows = df.withColumn("__next", F.lead(ts).over(Window.partitionBy(key).orderBy(ts))).join(median_gap(df, key, ts), key)
    rows = rows.where(seconds(ts, F.col("__next")) <= cap)
    rows = rows.withColumn("start", F.greatest(ts, start)).withColumn("end", F.least("__next", end))
    return rows.where("start < end").drop("__next", "median_gap")


def pieces(df: DataFrame, key: str, ts: str, value: str, until: Column, ttl: bool = True, least: float = 60.0) -> DataFrame:
    """(key, start, end, value): how long each known value is usable: until the next
    row (known or not) and, with ``ttl``, three median gaps of the known rows."""
    rows = df.select(key, ts, value, F.coalesce(F.lead(ts).over(Window.partitionBy(key).orderBy(ts)), until).alias("end"))
    rows = rows.where(F.col(value).isNotNull())
    if ttl:
        cap = F.greatest(3 * F.col("median_gap"), F.lit(least))
        rows = rows.join(median_gap(rows, key, ts), key).withColumn("end", F.least("end", later(ts, F.coalesce(cap, F.lit(0.0)))))
    return rows.select(key, F.col(ts).alias("start"), "end", value).where("start < end")


def align(key: str, **signals: DataFrame) -> DataFrame:
    """(key, start, end, one column a signal): the times at which all signals have
    a usable piece (start, end, value), cut at every boundary of any of them."""
    def edges(name: str, df: DataFrame) -> DataFrame:
        value = next(c for c in df.columns if c not in (key, "start", "end"))
        state = lambda at, v, n: F.struct(F.col(at).alias("at"), F.lit(n).alias("n"), F.struct(v.alias("v")).alias(name))
        return df.select(key, F.explode(F.array(state("end", F.lit(None).cast("double"), 0), state("start", F.col(value).cast("double"), 1))).alias("e")).select(key, "e.*")

    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [edges(n, df) for n, df in signals.items()])
    own = Window.partitionBy(key).orderBy("at", "n")  # at one time, ends come before starts
    back = own.rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.select(key, F.col("at").alias("start"), F.lead("at").over(own).alias("end"), *[F.last(n, ignorenulls=True).over(back)["v"].alias(n) for n in signals])
    return rows.where(reduce(lambda a, b: a & b, [F.col(n).isNotNull() for n in signals], F.col("start") < F.col("end")))


def statistic(df: DataFrame, keys: list[str], value: str, whole: float) -> DataFrame:
    """Time-weighted facts of pieces (start, sec, value) by keys: mean, extremes,
    weighted median and p90, first, last, change, slope and coverage of a window of
    ``whole`` seconds."""
    own = Window.partitionBy(*keys)
    so_far = own.orderBy(value, "sec", "start").rowsBetween(Window.unboundedPreceding, 0)
    rows = df.withColumn("__c", F.sum("sec").over(so_far)).withColumn("__t", F.sum("sec").over(own))
    at = lambda q: F.min(F.when(F.col("__c") >= q * F.col("__t"), F.col(value)))
    g = rows.groupBy(*keys).agg(
        F.try_divide(F.sum(F.col(value) * F.col("sec")), F.sum("sec")).alias("mean"), F.min(value).alias("minimum"), F.max(value).alias("maximum"), at(0.5).alias("median"), at(0.9).alias("p90"),
        F.min_by(value, "start").alias("first"), F.max_by(value, "start").alias("last"), (100 * F.sum("sec") / whole).alias("coverage_pct"))
    return g.withColumn("change", F.col("last") - F.col("first")).withColumn("slope_per_hour", F.col("change") / (whole / 3600))


def positive_area(left: Column, right: Column, sec: Column) -> Column:
    """Area above zero of a line from left to right."""
    top = F.greatest(left, right)
    return F.when((left >= 0) & (right >= 0), (left + right) * sec / 2).when((left <= 0) & (right <= 0), 0.0).otherwise(top * sec * top / F.abs(right - left) / 2)


def span_sums(left: Column, right: Column, sec: Column) -> list[Column]:
    """Mergeable facts of linear spans."""
    return [F.sum(sec).alias("seconds"), F.sum((left + right) * sec / 2).alias("integral"), F.sum(positive_area(left, right, sec)).alias("positive_integral"),
            F.sum(positive_area(-left, -right, sec)).alias("negative_integral"), F.min(F.least(left, right)).alias("minimum"), F.max(F.greatest(left, right)).alias("maximum"),
            F.sum(F.abs(right - left)).alias("variation"), F.max(F.abs(right - left) * 3600 / sec).alias("max_rate_per_hour")]


def merged_runs(df: DataFrame, key: str, same: list[str], value: str) -> DataFrame:
    """Touching intervals of equal ``same`` as runs; a run's variation is the sum
    of the jumps of its held value at the joints."""
    own = Window.partitionBy(key).orderBy("start")
    joined = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.lag(c).over(own)) for c in same], F.col("start") == F.lag("end").over(own))
    rows = df.withColumn("__new", F.when(joined, 0).otherwise(1)).withColumn("__jump", F.when(F.col("__new") == 0, F.abs(F.col(value) - F.lag(value).over(own))))
    rows = rows.withColumn("__run", F.sum("__new").over(own))
    return rows.groupBy(key, "__run", *same).agg(F.min("start").alias("start"), F.max("end").alias("end"), F.coalesce(F.sum("__jump"), F.lit(0.0)).alias("variation"), F.count("*").alias("parts")).drop("__run")
