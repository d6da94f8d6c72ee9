"""Aggregates over intervals: each ratio with its own denominator."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from spanwise.operators.intervals import seconds


def share(part: Column, whole: Column) -> Column:
    """Percent, null without a denominator."""
    return F.try_divide(100.0 * part, whole)


def comfort(pieces: DataFrame, key: str, value: str, target: str, band: float) -> DataFrame:
    """Time-weighted facts of pieces (sec, value, held target): mean, range, time
    in, above and below the inclusive band, absolute error, and degree-hours and
    mean error while above and below the exact target. A piece whose ``ignored`` is
    true (if there is such a column) counts in the mean and in the denominator of
    evaluation_pct alone."""
    sec, error = F.col("sec"), F.col(value) - F.col(target)
    if "ignored" in pieces.columns:
        error = F.when(~F.coalesce("ignored", F.lit(False)), error)
    known = F.when(error.isNotNull(), sec)
    when = lambda ok, what=sec: F.coalesce(F.sum(F.when(ok, what)), F.lit(0.0))
    above, below = when(error > 0, error * sec), when(error < 0, -error * sec)
    return pieces.groupBy(key).agg(
        F.try_divide(F.sum(F.col(value) * sec), F.sum(sec)).alias("mean"), F.min(value).alias("low"), F.max(value).alias("high"),
        F.sum(sec).alias("observed_s"), F.coalesce(F.sum(known), F.lit(0.0)).alias("evaluated_s"),
        share(when(F.abs(error) <= band), F.sum(known)).alias("in_band_pct"), share(when(error > band), F.sum(known)).alias("above_pct"),
        share(when(error < -band), F.sum(known)).alias("below_pct"), F.try_divide(F.sum(F.abs(error) * known), F.sum(known)).alias("mean_abs_error"),
        (above / 3600).alias("degree_hours_above"), (below / 3600).alias("degree_hours_below"),
        F.try_divide(above, when(error > 0)).alias("mean_error_above"), F.try_divide(below, when(error < 0)).alias("mean_error_below"),
        share(F.coalesce(F.sum(known), F.lit(0.0)), F.sum(sec)).alias("evaluation_pct"),
    )


def cycles(df: DataFrame, key: str, start: str = "start", end: str = "end", on: str = "on") -> DataFrame:
    """(key, started_at, ended_at, sec): runs of touching on-intervals that an off
    interval closes; a gap drops an open run."""
    own = Window.partitionBy(key).orderBy(start)
    rows = df.withColumn("__new", F.when((F.col(on) == F.lag(on).over(own)) & (F.col(start) == F.lag(end).over(own)), 0).otherwise(1))
    rows = rows.withColumn("__run", F.sum("__new").over(own))
    runs = rows.groupBy(key, "__run", on).agg(F.min(start).alias("started_at"), F.max(end).alias("ended_at"))
    order = Window.partitionBy(key).orderBy("started_at")
    closed = (F.lead("started_at").over(order) == F.col("ended_at")) & ~F.lead(on).over(order)
    return runs.withColumn("__closed", closed).where(F.col(on) & F.col("__closed")).select(key, "started_at", "ended_at", seconds("started_at", "ended_at").alias("sec"))


def quality(df: DataFrame, key: str, ts: str, value: str, start: Column, end: Column, jump: float = 1.0, rate: float = 10.0, cadence: float | None = None, slowest: float = 600.0) -> DataFrame:
    """Quality of each key's samples in the closed window [start, end]: coverage,
    greatest gap, stuck share of observed seconds, jumps, score and flags.

    The cadence is the given heartbeat, or else the median gap (of fewer than ten
    gaps at most three times the least), ``slowest`` at most; a gap counts up to
    2.5 cadences, and the last sample of a key covers nothing. Fewer than two
    samples cover nothing."""
    own = Window.partitionBy(key).orderBy(ts)
    rows = df.where(F.col(value).isNotNull() & F.col(ts).between(start, end))
    rows = rows.withColumn("__gap", F.nullif(seconds(ts, F.lead(ts).over(own)), F.lit(0.0))).withColumn("__step", F.abs(F.lead(value).over(own) - F.col(value)))
    whole = F.greatest(seconds(start, end), F.lit(1.0))
    if cadence is None:
        g = rows.groupBy(key).agg(F.count("__gap").alias("__n"), F.median("__gap").alias("__mid"), F.min("__gap").alias("__least"))
        usual = F.when(F.col("__n") >= 10, F.col("__mid")).otherwise(F.least("__mid", 3 * F.col("__least")))
        g = g.select(key, F.greatest(2.5 * F.least(F.coalesce(usual, whole), F.lit(slowest)), F.lit(60.0)).alias("__cap"))
        rows = rows.join(g, key)  # an aggregate joined back; the window of the gaps has sent each series to one task by then
    else:
        rows = rows.withColumn("__cap", F.lit(max(2.5 * cadence, 60.0)))
    jumped = (F.col("__step") > jump) & (F.try_divide(F.col("__step") * 3600, F.col("__gap")) > rate)
    stuck = F.when((F.col("__step") == 0) & (F.col("__gap") <= F.col("__cap")), F.col("__gap"))
    out = rows.groupBy(key).agg(
        F.count("*").alias("samples"), F.max("__gap").alias("max_gap_s"), F.max("__cap").alias("__cap"),
        F.coalesce(F.sum(F.when(F.col("__gap").isNotNull(), F.least("__gap", "__cap"))), F.lit(0.0)).alias("covered_s"),
        F.coalesce(F.sum(stuck), F.lit(0.0)).alias("__stuck"), F.count_if(jumped).alias("jumps"),
    )
    few = F.col("samples") < 2
    coverage = F.least(F.lit(1.0), F.col("covered_s") / whole)
    gap = F.when(few, whole).otherwise(F.coalesce("max_gap_s", whole))
    flags = F.when(few, F.lit("insufficient_samples")).otherwise(F.concat_ws(",", F.when(coverage < 0.7, "low_coverage"), F.when(gap > F.col("__cap"), "large_gap"), F.when(F.col("jumps") > 0, "implausible_jumps")))
    return out.select(
        key, "samples", gap.alias("max_gap_s"), "covered_s", F.least(F.lit(100.0), 100 * F.col("__stuck") / F.greatest("covered_s", F.lit(1.0))).alias("stuck_pct"),
        "jumps", coverage.alias("coverage"), (coverage * (1 - 0.25 * F.least(F.lit(1.0), F.col("jumps") / 5.0))).alias("score"), flags.alias("flags"))


def weighted_quantile(df: DataFrame, key: str, value: str, weight: str, q: float) -> DataFrame:
    """Least value whose cumulative weight reaches q of the key's total."""
    order = Window.partitionBy(key).orderBy(value, weight).rowsBetween(Window.unboundedPreceding, 0)
    rows = df.withColumn("__c", F.sum(weight).over(order)).withColumn("__t", F.sum(weight).over(Window.partitionBy(key)))
    return rows.where(F.col("__c") >= q * F.col("__t")).groupBy(key).agg(F.min(value).alias("quantile"))


def exposure(df: DataFrame, keys: list[str], level: str, flame: str, purpose: str) -> DataFrame:
    """Additive seconds of flame by level bin and purpose; a null level is
    unknown, a null flame is not observed."""
    sec, v = F.col("sec"), F.col(level)
    total = lambda ok: F.coalesce(F.sum(F.when(F.col(flame) & ok, sec)), F.lit(0.0))
    bins = [total((v >= 25 * i) & (v < 25 * (i + 1)) if i < 3 else v >= 75).alias(f"bin_{i}_s") for i in range(4)]
    return df.groupBy(*keys).agg(
        *bins, total(v.isNull()).alias("bin_unknown_s"), F.coalesce(F.sum(F.when(F.col(flame).isNotNull(), sec)), F.lit(0.0)).alias("observed_s"),
        *[total(F.col(purpose) == p).alias(f"{p}_s") for p in ("heating", "dhw")],
    )


def meter_differences(df: DataFrame, keys: list[str], day: str, value: str) -> DataFrame:
    """Adjacent readings of a segment: start, end and volume; a fall breaks."""
    own = Window.partitionBy(*keys).orderBy(day)
    rows = df.select(*keys, F.lag(day).over(own).alias("start"), F.col(day).alias("end"), (F.col(value) - F.lag(value).over(own)).alias("volume"))
    return rows.where("start is not null and volume >= 0")
