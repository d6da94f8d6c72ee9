"""Support, bounds and estimates of metered consumption from additive minutes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

COVERED = 0.8


def _sum(columns: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, columns)


def support(df: DataFrame, key: str, bins: list[str], covered: float = COVERED) -> DataFrame:
    """Which meter intervals (volume, bins and flame in minutes, coverage) serve a
    fit, why others do not, and the minutes and intervals behind each bin."""
    ok = (F.col("coverage") >= covered) & (F.col("observed") > 0) & (F.col("flame") > 0)
    no_flame = (F.col("coverage") >= covered) & (F.col("flame") <= 0) & (F.col("volume") > 0)
    each = [x for i, b in enumerate(bins) for x in (F.coalesce(F.sum(F.when(ok, F.col(b))), F.lit(0.0)).alias(f"support_{i}"), F.count_if(ok & (F.col(b) > 0)).alias(f"count_{i}"))]
    of = lambda c, f: f(F.when(ok, F.col(c))).alias(c)
    return df.groupBy(key).agg(F.count_if(ok).alias("usable"), F.count_if(F.col("coverage") < covered).alias("gaps"), F.count_if(no_flame).alias("no_flame"), *each, of("volume", F.sum), of("flame", F.sum), of("coverage", F.avg))


def rate_bounds(df: DataFrame, bins: int, validation: float | None = None, boundary: float = 0.0) -> DataFrame:
    """Bounds of each bin's rate around the mean rate of usable intervals, wider
    without validation, by poor coverage, few intervals, and bins without support."""
    base = F.greatest(F.lit(0.08), F.lit(boundary), F.lit(0.30 if validation is None else validation), 0.75 * (1 - F.col("coverage")), 0.25 / F.sqrt("usable"))
    rows = df.where("usable > 0").withColumn("base", base).withColumn("rate", F.col("volume") / F.col("flame"))
    spread = lambda i: F.greatest("base", F.when(F.col(f"support_{i}") <= 0, 0.5).when(F.col(f"count_{i}") < 2, 0.3).otherwise(0.0))
    keys = df.columns[:1]
    return rows.select(*keys, "base", *[x for i in range(bins) for x in (F.greatest(F.lit(0.0), F.col("rate") * (1 - spread(i))).alias(f"low_{i}"), (F.col("rate") * (1 + spread(i))).alias(f"high_{i}"))])


def estimate(df: DataFrame, bins: list[str], rates: tuple[float, ...], least_coverage: float = COVERED, spread: float = 0.3) -> DataFrame:
    """Volume of an exposure at given rates: unknown where too little was seen;
    what was not seen is used like the rest, or, for the lower bound, not at all."""
    mean = sum(rates) / len(rates)
    part = _sum([F.col(b) for b in bins])
    rest = F.greatest(F.col("flame") - part, F.lit(0.0))  # minutes of flame at no known level
    seen = _sum([F.col(b) * r for b, r in zip(bins, rates)]) + rest * mean
    coverage = F.least(F.lit(1.0), F.col("coverage"))
    unknown = (coverage < least_coverage) | ((F.col("flame") <= 0) & (coverage < 0.95))
    known = lambda c: F.when(~unknown, c)
    volume = seen / coverage
    return df.withColumns({
        "status": F.when(unknown, "unknown").when(coverage < 1 - 1e-9, "extrapolated").otherwise("estimated"), "estimate": known(volume), "gap": known(volume - seen),
        "lower": known(F.greatest(F.lit(0.0), F.least(seen * (1 - spread), volume))), "upper": known(F.greatest(volume, seen * (1 + spread) / coverage * (1 + 0.5 * (1 - coverage)))),
    })


def savings(df: DataFrame, key: str) -> DataFrame:
    """What was used (now) against what the rate before (before / dh0) would have
    used under the weather after (dh1), with an empirical range of a tenth, a
    reliability capped by the data behind it, and a status."""
    rows = df.where("before is not null and now is not null and dh0 > 0 and dh1 > 0").withColumn("expected", F.col("before") / F.col("dh0") * F.col("dh1"))
    saved, error = F.col("expected") - F.col("now"), F.col("expected") * 0.1
    pct, beyond = 100 * saved / F.col("expected"), F.col("n1") > 2 * F.col("n0")
    status = F.when(beyond, "extrapolated").when(((saved - error <= 0) & (saved + error >= 0)) | (F.abs(pct) <= 2), "effect_indistinguishable").otherwise("estimated")
    caps = [F.when(beyond, 35).otherwise(100), F.when(F.col("n0") < 3, 35).when(F.col("n0") < 6, 50).when(F.col("n0") < 9, 65).otherwise(100)]
    index = F.least(*caps, F.round(100 * (0.25 + 0.75 * F.least(F.lit(1.0), F.col("n0") / 12)) * 0.9)).cast("int")
    return rows.select(key, "expected", saved.alias("saved"), pct.alias("saved_pct"), (saved - error).alias("lower"), (saved + error).alias("upper"), status.alias("status"), index.alias("reliability"))
