"""Consumption facts: chains of readings, rates and two-term non-negative fits.

Fits need only sums of products, which partial aggregation makes before the
shuffle; the few active sets of two terms are compared in expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def chains(df: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, start, end, volume, readings): differences that adjoin as one."""
    own = Window.partitionBy(*keys).orderBy("start")
    rows = df.withColumn("__new", F.when(F.col("start") == F.lag("end").over(own), 0).otherwise(1)).withColumn("__chain", F.sum("__new").over(own))
    return rows.groupBy(*keys, "__chain").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.sum("volume").alias("volume"), F.count("*").alias("readings")).drop("__chain")


def mean_rate(df: DataFrame, keys: list[str], volume: str, hours: str, low: float, high: float, least: int) -> DataFrame:
    """Volume by hour within bounds, null with its reason where rows are too few."""
    out = df.groupBy(*keys).agg(F.sum(volume).alias("__v"), F.sum(hours).alias("__h"), F.count("*").alias("support"))
    few = F.col("support") < least
    rate = F.least(F.greatest(F.try_divide(F.col("__v"), F.col("__h")), F.lit(low)), F.lit(high))
    return out.select(*keys, "support", F.when(~few, rate).alias("rate"), F.when(few, "few readings").otherwise("usable").alias("reason"))


def fit_two(df: DataFrame, keys: list[str], y: str, a: str, b: str) -> DataFrame:
    """Least squares y = u * a + v * b with u, v >= 0."""
    s = {f"__{p}{q}": F.sum(F.col(x) * F.col(z)) for p, x, q, z in (("a", a, "a", a), ("a", a, "b", b), ("b", b, "b", b), ("a", a, "y", y), ("b", b, "y", y))}
    g = df.groupBy(*keys).agg(*[e.alias(n) for n, e in s.items()])
    aa, ab, bb, ay, by = (F.col(n) for n in s)
    det = aa * bb - ab * ab
    good = det > 1e-9 * aa * bb
    u, v = F.when(good, (bb * ay - ab * by) / det), F.when(good, (aa * by - ab * ay) / det)
    # one term alone takes off the square of its product with y, if that is positive
    gain = lambda top, low: F.coalesce(F.try_divide(F.greatest(top, F.lit(0.0)) ** 2, low), F.lit(0.0))
    first = gain(ay, aa) >= gain(by, bb)
    g = g.withColumn("__u", u).withColumn("__v", v).withColumn("__in", F.coalesce((F.col("__u") >= 0) & (F.col("__v") >= 0), F.lit(False)))
    alone = lambda use, top, low: F.when(use, F.greatest(F.try_divide(top, low), F.lit(0.0))).otherwise(0.0)
    return g.select(*keys, F.when(F.col("__in"), F.col("__u")).otherwise(alone(first, ay, aa)).alias("u"), F.when(F.col("__in"), F.col("__v")).otherwise(alone(~first, by, bb)).alias("v"))


def standardised(df: DataFrame, keys: list[str], stratum: str, side: str, sec: str, value: str) -> DataFrame:
    """After minus before over shared strata, each weighing its lesser seconds."""
    g = df.groupBy(*keys, stratum).agg(
        *[f.alias(n) for when in ("before", "after") for n, f in (
            (f"__{when}_s", F.sum(F.when(F.col(side) == when, F.col(sec)))), (f"__{when}_v", F.sum(F.when(F.col(side) == when, F.col(value) * F.col(sec)))))])
    g = g.where("__before_s > 0 and __after_s > 0").withColumn("__w", F.least("__before_s", "__after_s"))
    effect = F.col("__after_v") / F.col("__after_s") - F.col("__before_v") / F.col("__before_s")
    return g.groupBy(*keys).agg((F.sum(effect * F.col("__w")) / F.sum("__w")).alias("effect"), F.sum("__w").alias("weight_s"), F.count("*").alias("strata"))


def reconciled(df: DataFrame, keys: list[str], weight: str, total: str) -> DataFrame:
    """df with slice: weights scaled so that each key's slices add to its total."""
    own = Window.partitionBy(*keys)
    return df.withColumn("slice", F.try_divide(F.col(weight) * F.col(total), F.sum(weight).over(own)))
