"""Fits of metered volumes that are chosen on held-out intervals.

``binned_fit``: rates of use by bins of load, as many as unseen intervals support.
``weather_baseline``: use by hours, degree-hours and, if that predicts newer intervals
better, hot water; ``compare`` sets a later interval against it. Fits of a scope work
on sums of products; the binned fit, whose targets depend on the training rows'
mean, takes a scope's intervals (meter readings) in one task, held-out rows in blocks."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

SWEEPS, BLOCK = 200, 256
COVERED, WEATHER_PCT, LEAST, LEAST_HOLDOUT, LEAST_DHW = 0.8, 70.0, 3, 5, 8


def _groups(bins: int, parameters: int) -> np.ndarray:
    """0/1 matrix (bins, parameters): contiguous groups of bins."""
    out = np.zeros((bins, parameters))
    out[np.arange(bins), np.arange(bins) * parameters // bins] = 1.0
    return out


def _rank(rows: np.ndarray) -> int:
    return int(np.linalg.matrix_rank(rows)) if rows.size else 0


def _bounded(gram: np.ndarray, product: np.ndarray, prior: np.ndarray, low: float, high: float) -> np.ndarray:
    """Ridge fits within bounds by coordinate sweeps, one for each leading index:
    gram (m, k, k), product (m, k), prior (m,)."""
    diagonal = np.einsum("mkk->mk", gram)
    ridge = np.maximum(1e-9, diagonal.mean(1) * 1e-5)
    rates = np.repeat(np.clip(prior, low, high)[:, None], gram.shape[1], axis=1)
    steps = [(k, gram[:, k], gram[:, k, k], ridge * prior + product[:, k], diagonal[:, k] + ridge) for k in range(gram.shape[1])]
    for _ in range(SWEEPS):
        was = rates.copy()
        for k, row, own, top, below in steps:
            others = np.einsum("mk,mk->m", row, rates) - own * rates[:, k]
            rates[:, k] = np.minimum(np.maximum((top - others) / below, low), high)
        if (rates == was).all():  # all further sweeps would give the same
            break
    return rates


def _fits(x: np.ndarray, volume: np.ndarray, rest: np.ndarray, flame: np.ndarray, groups: np.ndarray, out: np.ndarray | None, low: float, high: float) -> tuple[np.ndarray, np.ndarray] | None:
    """(rates by bin, mean rate) of fits that each leave the rows ``out`` out (None: one
    fit of all rows); None where one of them has no solution."""
    drop = np.zeros((1, len(x))) if out is None else np.eye(len(x))[out]
    burnt = flame.sum() - drop @ flame
    if (burnt <= 0).any():
        return None
    mean = np.clip((volume.sum() - drop @ volume) / burnt, low, high)
    parameters = groups.shape[1]
    if parameters == 1:
        return np.repeat(mean[:, None], len(groups), axis=1), mean
    grouped = x @ groups
    gone = np.zeros((1, parameters)) if out is None else grouped[out]
    gram = np.einsum("rk,rl->kl", grouped, grouped) - gone[:, :, None] * gone[:, None, :]
    spread = np.linalg.eigvalsh(gram)
    unsure = spread[:, 0] <= 1e-8 * spread[:, -1]  # others are of full rank far beyond rounding
    if any(_rank(grouped[d == 0]) < parameters for d in drop[unsure]):
        return None
    target = np.maximum(0.0, volume - rest * mean[:, None]) * (1 - drop)
    return _bounded(gram, target @ grouped, mean, low, high) @ groups.T, mean


def _left_out_error(x, volume, rest, flame, groups, low, high) -> float | None:
    if len(x) < max(2, groups.shape[1] + 2):
        return None
    total = 0.0
    for k in range(0, len(x), BLOCK):
        out = np.arange(k, min(k + BLOCK, len(x)))
        found = _fits(x, volume, rest, flame, groups, out, low, high)
        if found is None:
            return None
        total += np.abs(volume[out] - (x[out] * found[0]).sum(1) - rest[out] * found[1]).sum()
    return total / len(x)


def _fit_scope(frame: pd.DataFrame, bins: list[str], low: float, high: float) -> dict:
    frame = frame.sort_values("end", kind="stable")
    frame = frame[(frame["volume"] >= 0) & (frame[bins] >= 0).all(axis=1) & (frame["coverage"] >= COVERED) & (frame["observed"] > 0) & (frame["flame"] > 0)]
    n = len(frame)
    if not n:
        return {"usable": 0, "selected": 0, "heldout": 0, "rank": 0, "identifiable": False, "mean": None, "rates": None, "extrapolated": None, "loo_error": None, "validation_error": None, "validation_relative": None}
    x, volume, flame = frame[bins].to_numpy(float), frame["volume"].to_numpy(float), frame["flame"].to_numpy(float)
    rest = np.maximum(flame - x.sum(1), 0.0)
    if "unknown" in frame:
        rest = np.maximum(rest, frame["unknown"].to_numpy(float))
    held = max(1, -(-n // 5)) if n >= 3 else 0
    dev = slice(0, n - held)
    chosen = _groups(len(bins), 1)
    error = _left_out_error(x[dev], volume[dev], rest[dev], flame[dev], chosen, low, high)
    for parameters in range(2, len(bins) + 1):  # more only where unseen intervals say so
        groups = _groups(len(bins), parameters)
        new = _left_out_error(x[dev], volume[dev], rest[dev], flame[dev], groups, low, high)
        if new is not None and (error is None or new + 0.01 * max(1e-9, volume[dev].mean()) < 0.9 * error):
            chosen, error = groups, new
    checked = relative = None
    fitted = _fits(x[dev], volume[dev], rest[dev], flame[dev], chosen, None, low, high) if held else None
    if fitted is not None:
        wrong = np.abs(volume[-held:] - x[-held:] @ fitted[0][0] - rest[-held:] * fitted[1][0])
        checked, relative = float(wrong.mean()), float(wrong.sum() / volume[-held:].sum()) if volume[-held:].sum() > 0 else None
    rates, mean = _fits(x, volume, rest, flame, chosen, None, low, high)
    unseen, counts, rank = x.sum(0) <= 0, (x > 0).sum(0), _rank(x)
    parameters = chosen.shape[1]
    identifiable = parameters > 1 and rank >= parameters and n >= parameters + 2 and bool((counts[counts > 0] >= 2).all()) and not unseen.any()
    return {"usable": n, "selected": parameters, "heldout": held if checked is not None else 0, "rank": rank, "identifiable": bool(identifiable), "mean": float(mean[0]), "rates": np.where(unseen, mean[0], rates[0]).tolist(),
            "extrapolated": np.flatnonzero(unseen).tolist(), "loo_error": error, "validation_error": checked, "validation_relative": relative}


def binned_fit(df: DataFrame, key: str, bins: list[str], low: float | None = None, high: float | None = None) -> DataFrame:
    """Rates of each bin by scope. df: key, end, volume, bins and flame (minutes),
    observed, coverage and, if there, unknown (minutes of flame at no known load).

    One to all of ``bins`` in contiguous groups are tried; more groups are taken if
    leaving intervals out one by one errs by a tenth and a hundredth of the mean less.
    The newest fifth (one at least, of three or more) is held out and judges the form
    chosen. Bins without minutes take the mean. Nulls make an interval unusable."""
    kind = df.schema[key].dataType.simpleString()
    schema = f"`{key}` {kind}, usable long, selected long, heldout long, rank long, identifiable boolean, mean double, rates array<double>, extrapolated array<long>, loo_error double, validation_error double, validation_relative double"
    columns = [c.split()[0].strip("`") for c in schema.split(", ")]
    least, most = 0.0 if low is None else low, np.inf if high is None else high

    def fit(frame: pd.DataFrame) -> pd.DataFrame:
        row = {key: frame[key].iloc[0], **_fit_scope(frame.dropna(subset=["volume", "flame", "coverage", "observed", *bins]), bins, least, most)}
        return pd.DataFrame([[row[c] for c in columns]], columns=columns, dtype=object)

    used = [key, "end", "volume", "flame", "observed", "coverage", *bins, *(["unknown"] if "unknown" in df.columns else [])]
    return df.select(*used).groupBy(key).applyInPandas(fit, schema)


_TERMS = ("hours", "degree_hours", "dhw_hours")


def nonnegative(gram: np.ndarray, product: np.ndarray) -> np.ndarray | None:
    """Least squares with no coefficient below zero, by all sets of terms; None where
    the terms are not independent."""
    scale = np.sqrt(np.diag(gram))
    if not (scale > 0).all():
        return None
    g, b = gram / np.outer(scale, scale), product / scale
    if np.linalg.eigvalsh(g)[0] <= 1e-12:
        return None
    best, gain = np.zeros(len(b)), 0.0
    for size in range(1, len(b) + 1):
        for some in combinations(range(len(b)), size):
            part = np.array(some)
            found = np.linalg.solve(g[np.ix_(part, part)], b[part])
            if (found >= -1e-9).all() and found @ b[part] > gain:
                best, gain = np.zeros(len(b)), found @ b[part]
                best[part] = np.maximum(found, 0.0)
    return best / scale


def weather_baseline(df: DataFrame, key: str, until: Column | None = None) -> DataFrame:
    """A baseline by scope. df: key, start, end, volume, hours, degree_hours, dhw_hours
    (null: unknown), weather_pct and complete. until: only intervals that end by then.

    Intervals that are incomplete or with too little weather do not count. The newest
    fifth is held out from five intervals on. Hot water joins from eight on if known
    throughout, independent, and its error on held-out intervals is lower by a tenth
    and by a hundredth of their mean (0.01 at least). reason: why there is none."""
    ok = F.col("complete") & (F.col("weather_pct") >= WEATHER_PCT) & F.col("volume").isNotNull() & (F.col("hours") > 0) & F.col("degree_hours").isNotNull()
    rows = df.where(ok if until is None else ok & (F.col("end") <= until)).select(key, "start", "end", "volume", *_TERMS)
    own = Window.partitionBy(key)
    order = own.orderBy("start", "end")
    n = F.count("*").over(own)
    rows = rows.withColumn("__n", n).withColumn("__held", F.when(F.col("__n") >= LEAST_HOLDOUT, F.ceil(F.col("__n") / 5)).otherwise(0)).withColumn("__fit", F.row_number().over(order) <= F.col("__n") - F.col("__held"))
    rows = rows.withColumn("__over", F.coalesce(F.col("start") < F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(False)))
    fit = lambda c: F.when(F.col("__fit"), c)
    names = [*_TERMS, "volume"]
    products = [F.sum(fit(F.col(a) * F.col(b))).alias(f"{i}{j}") for i, a in enumerate(names) for j, b in enumerate(names) if i <= j]
    ranges = [f(fit(c)).alias(f"{a}_{side}") for a, c in (("degree", F.col("degree_hours")), ("hours", F.col("hours")), ("intensity", F.col("degree_hours") / F.col("hours")), ("dhw", F.col("dhw_hours"))) for side, f in (("low", F.min), ("high", F.max))]
    sums = rows.groupBy(key).agg(F.count("*").alias("n"), F.max("__held").alias("held"), F.max("__over").alias("over"), (F.count("dhw_hours") == F.count("*")).alias("known"), F.max("end").alias("trained_until"), *products, *ranges)
    kind = sums.schema[key].dataType.simpleString()

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for r in batch.to_dict("records"):
                get = lambda i, j: float(r[f"{min(i, j)}{max(i, j)}"])  # noqa: B023, E731
                base = three = None
                if not r["over"] and r["n"] - r["held"] >= LEAST:
                    base = nonnegative(np.array([[get(i, j) for j in (0, 1)] for i in (0, 1)]), np.array([get(0, 3), get(1, 3)]))
                    if r["n"] >= LEAST_DHW and r["known"]:
                        three = nonnegative(np.array([[get(i, j) for j in range(3)] for i in range(3)]), np.array([get(i, 3) for i in range(3)]))
                reason = "overlap" if r["over"] else "few_intervals" if r["n"] - r["held"] < LEAST else "no_diversity" if base is None else None
                out.append([r[key], None if base is None else base.tolist(), None if three is None else three.tolist(), reason])
            yield pd.DataFrame(out, columns=[key, "two", "three", "reason"])

    solved = sums.select(key, "n", "held", "over", "known", *[f"{i}{j}" for i in range(4) for j in range(i, 4)]).mapInPandas(solve, f"`{key}` {kind}, two array<double>, three array<double>, reason string")
    error = lambda c, terms: F.col("volume") - reduce(lambda a, b: a + b, [F.col(c)[i] * F.col(t) for i, t in enumerate(terms)])
    judged = rows.join(solved.where("two is not null"), key).withColumn("__two", error("two", _TERMS[:2])).withColumn("__three", error("three", _TERMS))
    held = lambda c: F.when(~F.col("__fit"), c)
    rmse = lambda side, c: F.sqrt(F.avg(side(F.col(c) * F.col(c))))
    errors = judged.groupBy(key).agg(rmse(held, "__two").alias("v2"), rmse(held, "__three").alias("v3"), F.max(held(F.abs("__two"))).alias("m2"), F.max(held(F.abs("__three"))).alias("m3"), rmse(fit, "__two").alias("t2"), rmse(fit, "__three").alias("t3"), F.avg(held(F.col("volume"))).alias("level"))
    joined = sums.join(solved, key).join(errors, key, "left")
    better = F.coalesce((F.col("v3") <= 0.9 * F.col("v2")) & (F.col("v2") - F.col("v3") >= F.greatest(F.lit(0.01), 0.01 * F.col("level"))), F.lit(False))
    pick = lambda a, b: F.when(F.col("uses_dhw"), b).otherwise(a)
    chosen = F.when(F.col("uses_dhw"), F.col("three")).otherwise(F.col("two"))
    out = joined.withColumn("uses_dhw", better)
    return out.select(
        key, "reason", "uses_dhw", chosen[0].alias("hour_rate"), chosen[1].alias("degree_rate"), F.when(F.col("uses_dhw"), F.col("three")[2]).when(F.col("two").isNotNull(), 0.0).alias("dhw_rate"), F.col("n").alias("intervals"), F.col("held").cast("long").alias("validation_intervals"),
        (F.col("n") - F.col("held")).cast("long").alias("model_intervals"), pick(F.col("t2"), F.col("t3")).alias("residual_rmse"), pick(F.col("v2"), F.col("v3")).alias("validation_rmse"), pick(F.col("m2"), F.col("m3")).alias("validation_max_error"), "trained_until",
        *[f"{a}_{side}" for a in ("degree", "hours", "intensity", "dhw") for side in ("low", "high")],
    )


def compare(baseline: DataFrame, pairs: DataFrame, key: str) -> DataFrame:
    """A later interval against what the baseline expects under its own weather.

    pairs: key and, prefixed before_ and after_, start, end, volume, hours,
    degree_hours, dhw_hours, schedule_hours, occupancy, weather_pct, complete,
    independent and uncertainty. Pairs without a baseline, incomplete, with little
    weather, out of order, or after intervals that reach into the training are left
    out. The range is the largest held-out error and both volumes' uncertainties."""
    c = F.col
    rows = pairs.join(baseline.where("reason is null"), key).where(
        c("before_complete") & c("after_complete") & (c("before_weather_pct") >= WEATHER_PCT) & (c("after_weather_pct") >= WEATHER_PCT)
        & (c("before_end") <= c("after_start")) & (c("after_start") >= c("trained_until")) & ~(c("uses_dhw") & c("after_dhw_hours").isNull()))
    expected = c("hour_rate") * c("after_hours") + c("degree_rate") * c("after_degree_hours") + F.when(c("uses_dhw"), c("dhw_rate") * c("after_dhw_hours")).otherwise(0.0)
    outside = lambda x, a: ~x.between(c(f"{a}_low"), c(f"{a}_high"))
    beyond = outside(c("after_degree_hours"), "degree") | outside(c("after_hours"), "hours") | outside(c("after_degree_hours") / c("after_hours"), "intensity") | F.coalesce(c("uses_dhw") & outside(c("after_dhw_hours"), "dhw"), F.lit(False))
    differ = lambda x: F.coalesce(F.abs(c(f"before_{x}") - c(f"after_{x}")) > 1e-9, F.lit(True))  # noqa: E731  unknown on a side counts as changed
    dhw, schedule, occupancy = ~c("uses_dhw") & differ("dhw_hours"), differ("schedule_hours"), c("before_occupancy").isNotNull() | c("after_occupancy").isNotNull()
    rows = rows.withColumns({"expected": expected, "extrapolated": beyond}).withColumns({"raw_savings": c("before_volume") - c("after_volume"), "savings": c("expected") - c("after_volume"), "confounded": dhw | schedule | occupancy})
    wrong = F.coalesce("validation_max_error", F.greatest(c("residual_rmse"), 0.1 * c("expected")))
    rows = rows.withColumn("__wrong", wrong).withColumn("uncertainty", c("__wrong") + c("before_uncertainty") + c("after_uncertainty")).withColumn("pct", F.try_divide(100 * c("savings"), c("expected")))
    quality = F.greatest(F.lit(0.0), 1 - c("__wrong") / F.greatest(c("expected"), F.lit(1.0)))
    whole = F.bround(100 * (0.25 + 0.75 * F.least(F.lit(1.0), c("model_intervals") / 12)) * quality)
    caps = [F.when(c("validation_intervals") == 0, 35).when(c("validation_intervals") == 1, 50).when(c("validation_intervals") == 2, 65), F.when(~c("after_independent"), 35), F.when(c("extrapolated"), 35), F.when(c("confounded"), 45)]
    index = F.greatest(F.lit(0), F.least(F.lit(100), whole, *[F.coalesce(x, F.lit(100)) for x in caps])).cast("long")
    low, high = c("savings") - c("uncertainty"), c("savings") + c("uncertainty")
    status = F.when(c("confounded"), "confounded").when(c("extrapolated"), "extrapolated").when(((low <= 0) & (high >= 0)) | F.coalesce(F.abs(c("pct")) <= 2, F.lit(False)), "effect_indistinguishable").otherwise("estimated")
    warmer = F.when((c("raw_savings") > 0) & (c("savings") <= 0), "explained_by_weather").when((c("raw_savings") > c("savings")) & (c("after_degree_hours") < c("before_degree_hours")), "partly_weather")
    return rows.select(*pairs.columns, "expected", "raw_savings", "savings", c("pct").alias("savings_pct"), "uncertainty", low.alias("lower"), high.alias("upper"), index.alias("reliability"), "extrapolated", "confounded", status.alias("status"), warmer.alias("weather_note"))
