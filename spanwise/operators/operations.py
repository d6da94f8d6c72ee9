"""Ratios of a burner's work over its requests, each with its own gate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from spanwise.operators import intervals as iv, signals as sg

COVERAGE_PCT, LEAST_S = 70.0, 60.0


def _within(spans: DataFrame, kept: DataFrame, key: str, width: int) -> DataFrame:
    """Spans cut to the intervals of kept, with their columns and seconds."""
    met = iv.overlaps(spans, kept, key, width)
    rest = [c for c in spans.columns if c not in (key, "start", "end")]
    cut = met.select(key, F.greatest("start", "r_start").alias("start"), F.least("end", "r_end").alias("end"), *rest)
    return cut.withColumn("sec", iv.seconds("start", "end"))


def burner_runs(states: DataFrame, key: str) -> DataFrame:
    """(key, start, end, started, closed): stretches of flame over touching states.
    started: it began under a heating request right after an observed time without
    flame; closed: it did, heated throughout, and ended in such a time."""
    own = Window.partitionBy(key).orderBy("start")
    touches = F.coalesce(F.col("start") == F.lag("end").over(own), F.lit(False))
    rows = states.withColumn("__touch", touches).withColumn("__next", F.coalesce(F.lead("start").over(own) == F.col("end"), F.lit(False)))
    rows = rows.withColumn("__new", F.when(F.col("__touch") & (F.col("flame") == F.lag("flame").over(own)), 0).otherwise(1))
    rows = rows.withColumn("__run", F.sum("__new").over(own))
    heats = F.col("heating") & ~F.col("hot_water")
    runs = rows.where("flame").groupBy(key, "__run").agg(
        F.min("start").alias("start"), F.max("end").alias("end"), F.min_by(heats & F.col("__touch"), "start").alias("started"), F.min(heats).alias("__all"), F.max_by("__next", "start").alias("__ended"))
    return runs.select(key, "start", "end", "started", (F.col("started") & F.col("__all") & F.col("__ended")).alias("closed"))


def operational(states: DataFrame, exclusions: DataFrame, key: str, start: Column, end: Column, modulation: DataFrame | None = None, flow_error: DataFrame | None = None, coverage_pct: float = COVERAGE_PCT, width: int = 86_400) -> DataFrame:
    """One row a key of states (key, start, end, flame, heating, hot_water; apart from
    each other) in the period [start, end).

    Times in exclusions count neither as observed nor as due. With too little of the
    period observed nothing is known (``reason``); ratios need a minute observed and
    enough of the time that is due, those over requests also a minute of request;
    cycles count if complete; modulation (spans with value) counts during flame under
    request, flow_error (spans with value) during request, each with enough coverage.
    What is not known is null, never zero."""
    period = states.select(key).distinct().select(key, start.alias("start"), end.alias("end"))
    clip = lambda df: df.withColumn("start", F.greatest("start", start)).withColumn("end", F.least("end", end)).where("start < end")
    states = clip(states.select(key, "start", "end", "flame", "heating", "hot_water"))
    kept = iv.subtract(period, clip(exclusions.select(key, "start", "end")), key)
    valid = _within(states, kept, key, width)
    request, flame = F.col("heating") & ~F.col("hot_water"), F.col("flame")
    total = lambda ok: F.coalesce(F.sum(F.when(ok, F.col("sec"))), F.lit(0.0))
    seen = states.groupBy(key).agg(F.sum(iv.seconds("start", "end")).alias("seen_s"))
    due = kept.groupBy(key).agg(F.sum(iv.seconds("start", "end")).alias("due_s"))
    sums = valid.groupBy(key).agg(F.sum("sec").alias("observed_s"), total(request).alias("request_s"), total(request & flame).alias("flame_s"))
    runs = burner_runs(valid, key)
    length = F.when(F.col("closed"), iv.seconds("start", "end"))
    cycles = runs.groupBy(key).agg(F.count_if("started").alias("starts"), F.median(length).alias("cycle_median_s"), F.percentile(length, 0.9).alias("cycle_p90_s"), F.max(length).alias("cycle_longest_s"))
    rows = period.select(key, iv.seconds("start", "end").alias("period_s")).join(seen, key, "left").join(due, key, "left").join(sums, key, "left").join(cycles, key, "left")
    rows = rows.fillna(0, ["seen_s", "due_s", "observed_s", "request_s", "flame_s", "starts"])
    for name, spans, during in (("modulation", modulation, request & flame), ("flow", flow_error, request)):
        if spans is None:
            facts = [F.lit(None).cast("double").alias(f"{name}_{c}") for c in ("mean", "median", "p90", "maximum", "s")]
            rows = rows.select("*", *facts)
        else:
            inside = _within(spans.select(key, "start", "end", "value"), valid.where(during).select(key, "start", "end"), key, width)
            found = sg.statistic(inside, [key], "value", 1.0)  # a coverage of one second: seconds in hundredths
            rows = rows.join(found.select(key, *[F.col(c).alias(f"{name}_{c}") for c in ("mean", "median", "p90", "maximum")], (F.col("coverage_pct") / 100).alias(f"{name}_s")), key, "left")
    c, share = F.col, lambda a, b: F.coalesce(F.try_divide(100.0 * F.col(a), F.col(b)), F.lit(0.0))
    rows = rows.withColumns({"state_coverage_pct": share("seen_s", "period_s"), "coverage_pct": share("observed_s", "due_s"), "modulation_coverage_pct": share("modulation_s", "flame_s"), "flow_coverage_pct": share("flow_s", "request_s")})
    known = c("state_coverage_pct") >= coverage_pct
    observed = known & (c("observed_s") >= LEAST_S) & (c("coverage_pct") >= coverage_pct)
    asked = observed & (c("request_s") >= LEAST_S)
    modulated, flowing = known & (c("modulation_coverage_pct") >= coverage_pct), asked & (c("flow_coverage_pct") >= coverage_pct)
    when = lambda ok, x, name: F.when(ok, x).alias(name)
    return rows.select(
        key, F.when(~known, "insufficient_state_coverage").when(~observed, "no_qualified_observed_time").when(~asked, "no_qualified_request").alias("reason"), "state_coverage_pct", "coverage_pct", "observed_s", "request_s", "starts",
        when(asked, c("starts") / (c("request_s") / 3600), "starts_per_request_hour"), when(observed, c("starts") / (c("observed_s") / 3600), "starts_per_observed_hour"),
        *[when(known, c(x), x) for x in ("cycle_median_s", "cycle_p90_s", "cycle_longest_s")],
        when(asked, c("flame_s") / c("request_s"), "runtime_ratio"), when(asked, (c("request_s") - c("flame_s")) / c("request_s"), "without_flame_ratio"),
        when(modulated, c("modulation_mean"), "modulation_mean"), when(modulated, c("modulation_median"), "modulation_median"),
        when(flowing, c("flow_median"), "flow_error_median"), when(flowing, c("flow_p90"), "flow_error_p90"), when(flowing, F.greatest(c("flow_maximum"), F.lit(0.0)), "flow_overshoot"),
    )
