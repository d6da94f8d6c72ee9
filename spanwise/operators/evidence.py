"""Heating windows as evidence: gates, one row a time span, and a balanced choice."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

COVERED, MOST = 70.0, 24


def _finite(c: Column) -> Column:
    return F.when(~F.isnan(c) & (F.abs(c) < float("inf")), c)


def classified(windows: DataFrame) -> DataFrame:
    """windows with activity, error, quality and eligible.

    windows: key columns, start, end, excluded (array of reasons), facts room, target,
    outdoor, mode and request as structs (mean, minimum, maximum, coverage; null:
    missing), and error (given, or null: room less target). A request of unknown share
    or little coverage is unknown; an active window is eligible if nothing is excluded,
    all five are covered, outdoor and error known, and target and mode constant."""
    mean = lambda c: _finite(F.col(f"{c}.mean"))
    cover = lambda c: F.coalesce(F.col(f"{c}.coverage"), F.lit(0.0))
    fixed = lambda c: F.coalesce(_finite(F.col(f"{c}.minimum")) == _finite(F.col(f"{c}.maximum")), F.lit(False))
    request = mean("request")
    activity = F.when((cover("request") < COVERED) | request.isNull() | (request < 0), "unknown").when(request > 0, "active").otherwise("inactive")
    rows = windows.where("end > start").withColumns({
        "error": F.coalesce(_finite(F.col("error")), mean("room") - mean("target")), "activity": activity,
        "quality": F.least(*[cover(c) for c in ("room", "target", "outdoor", "mode", "request")])})
    ok = (F.col("activity") == "active") & (F.size(F.coalesce("excluded", F.array().cast("array<string>"))) == 0) & (F.col("quality") >= COVERED)
    known = mean("mode").isNotNull() & mean("target").isNotNull() & mean("outdoor").isNotNull() & F.col("error").isNotNull()
    return rows.withColumn("eligible", ok & known & fixed("target") & fixed("mode"))


def evidence(windows: DataFrame, key: str, most: int = MOST) -> DataFrame:
    """The windows of each key that serve: ``part`` active (eligible), inactive or
    unknown. windows also have id, kind and rank (of the source, the least first).

    Representative windows are left out; of windows with the same start and end the
    first source's counts. Of the active ones at most ``most`` stay, evenly over the
    outdoor temperature (both extremes among them; if one, the latest); of the
    others the latest half as many, one at least."""
    rows = classified(windows.where("kind is null or kind <> 'representative'"))
    rest = [c for c in rows.columns if c not in (key, "start", "end")]
    one = rows.groupBy(key, "start", "end").agg(F.min_by(F.struct(*rest), F.struct("rank", "id")).alias("r")).select(key, "start", "end", "r.*")
    part = F.when(F.col("eligible"), "active").when(F.col("activity") == "inactive", "inactive").otherwise("unknown")
    one = one.withColumn("part", part)
    own = Window.partitionBy(key, "part")
    place = F.row_number().over(own.orderBy(F.col("outdoor.mean"), "start", "id")) - 1
    one = one.withColumn("__n", F.count("*").over(own)).withColumn("__i", place).withColumn("__late", F.row_number().over(own.orderBy(F.desc("start"), F.desc("id"))))
    wanted = F.lit(-1) if most == 1 else F.transform(F.sequence(F.lit(0), F.lit(most - 1)), lambda i: F.bround(i * (F.col("__n") - 1) / (most - 1)).cast("int"))
    chosen = F.col("__late") == 1 if most == 1 else F.array_contains(wanted, F.col("__i").cast("int"))
    kept = F.when(F.col("part") == "active", (F.col("__n") <= most) | chosen).otherwise(F.col("__late") <= max(1, most // 2))
    return one.where(kept).drop("__n", "__i", "__late")


def comparisons(found: DataFrame, key: str) -> DataFrame:
    """Active windows of one mode and target, two at least: errors under what weather."""
    rows = found.where("part = 'active'").groupBy(key, F.col("mode.mean").alias("mode"), F.col("target.mean").alias("target")).agg(
        F.count("*").alias("windows"), F.avg("error").alias("mean_error"), F.min("error").alias("least_error"), F.max("error").alias("greatest_error"), F.min("outdoor.mean").alias("coldest"), F.max("outdoor.mean").alias("warmest"))
    return rows.where("windows >= 2")
