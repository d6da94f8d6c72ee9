"""Episodes: stretches of a key that one state, trigger or pattern holds together.

Islands are running sums of break marks, so each operator takes one exchange by
key; no group is collected."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from spanwise.operators.intervals import seconds


def numbered(df: DataFrame, key: str, state: list[str], name: str = "run") -> DataFrame:
    """df with the number of the run that each interval is part of: adjoining
    intervals of equal state (null is a state)."""
    own = Window.partitionBy(key).orderBy("start")
    same = F.col("start") == F.lag("end").over(own)
    for c in state:
        same = same & F.col(c).eqNullSafe(F.lag(c).over(own))
    return df.withColumn("__new", F.when(same, 0).otherwise(1)).withColumn(name, F.sum("__new").over(own)).drop("__new")


def runs(df: DataFrame, key: str, state: list[str]) -> DataFrame:
    """(key, *state, start, end, sec): each run as one interval."""
    found = numbered(df, key, state).groupBy(key, "run", *state).agg(F.min("start").alias("start"), F.max("end").alias("end"))
    return found.withColumn("sec", seconds("start", "end")).drop("run")


def band_episodes(pieces: DataFrame, key: str, value: str, target: str, band: float) -> DataFrame:
    """Stretches above or below a held target by more than the band, with their
    peak error; a gap, another target or an unknown one ends them. A peak of
    over twice the band is a warning."""
    error = F.col(value) - F.col(target)
    side = F.when(error > band, "above").when(error < -band, "below")
    rows = numbered(pieces.withColumn("__error", error).withColumn("side", side), key, ["side", target])
    found = rows.where("side is not null").groupBy(key, "run", "side").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.max(F.abs("__error")).alias("peak"))
    return found.withColumn("warning", F.col("peak") > 2 * band).drop("run")


def strict_cycles(df: DataFrame, key: str, on: str) -> DataFrame:
    """(key, start, end, sec): on-runs between two observed off-runs."""
    own = Window.partitionBy(key).orderBy("start")
    rows = runs(df, key, [on])
    opened = (F.lag("end").over(own) == F.col("start")) & ~F.lag(on).over(own)
    closed = (F.lead("start").over(own) == F.col("end")) & ~F.lead(on).over(own)
    return rows.withColumn("__ok", opened & closed).where(F.col(on) & F.col("__ok")).select(key, "start", "end", "sec")


def request_cycles(df: DataFrame, key: str, on: str) -> DataFrame:
    """On, off, on, off without a gap: start of the first, its seconds, the pause
    and the seconds of the next run."""
    own = Window.partitionBy(key).orderBy("start")
    rows, whole = runs(df, key, [on]), F.col(on)
    for k in (1, 2, 3):
        whole = whole & (F.lead("start", k).over(own) == F.lead("end", k - 1).over(own) if k > 1 else F.lead("start").over(own) == F.col("end"))
    rows = rows.withColumn("pause_s", F.lead("sec").over(own)).withColumn("next_s", F.lead("sec", 2).over(own)).withColumn("__ok", whole)
    return rows.where("__ok").select(key, "start", F.col("sec").alias("on_s"), "pause_s", "next_s")


def incidents(df: DataFrame, key: str, ts: str, order: str, loss: Column, restore: Column, cause: Column, busy: Column, within_s: float) -> DataFrame:
    """Losses until their restore: power where a cause came at most within_s
    before, running where something was busy inside. Counts run along the key,
    so nothing is joined."""
    own = Window.partitionBy(key).orderBy(ts, order)
    back = own.rowsBetween(Window.unboundedPreceding, 0)
    rows = df.withColumn("__busy", F.sum(F.when(busy, 1).otherwise(0)).over(back)).withColumn("__cause", F.max(F.when(cause, F.col(ts))).over(back))
    rows = rows.withColumn("__lost", F.when(loss, True).when(restore, False)).where("__lost is not null").withColumn("__was", F.lag("__lost").over(own))
    rows = rows.where(~F.col("__lost").eqNullSafe(F.col("__was")))
    rows = rows.withColumn("end", F.lead(ts).over(own)).withColumn("__then", F.lead("__busy").over(own)).where("__lost")
    impact = F.when(F.col("end").isNull(), "open").when(F.col("__then") > F.col("__busy"), "running").otherwise("none")
    why = F.when(seconds(F.col("__cause"), F.col(ts)) <= within_s, "power").otherwise("unknown")
    return rows.select(key, F.col(ts).alias("start"), "end", why.alias("cause"), impact.alias("impact"))


def recovery(df: DataFrame, key: str, ts: str, value: str, trigger: Column, step: float, stable: int = 3) -> DataFrame:
    """df with recovering: true from a trigger until ``stable`` samples in a row
    changed by at most step without one."""
    own = Window.partitionBy(key).orderBy(ts)
    calm = F.coalesce(F.abs(F.col(value) - F.lag(value).over(own)) <= step, F.lit(False)) & ~trigger
    rows = df.withColumn("__calm", F.when(calm, 1).otherwise(0))
    closes = F.sum("__calm").over(own.rowsBetween(1 - stable, 0)) == stable
    rows = rows.withColumn("__mark", F.when(trigger, True).when(closes, False))
    return rows.withColumn("recovering", F.coalesce(F.last("__mark", ignorenulls=True).over(own.rowsBetween(Window.unboundedPreceding, 0)), F.lit(False))).drop("__calm", "__mark")


def crossings(df: DataFrame, key: str, ts: str, value: str, level: float) -> DataFrame:
    """(key, at_s): epoch seconds at which the line between two samples rises to
    the level."""
    own = Window.partitionBy(key).orderBy(ts)
    rows = df.select(key, F.unix_micros(ts).alias("t1"), F.col(value).alias("v1"), F.unix_micros(F.lag(ts).over(own)).alias("t0"), F.lag(value).over(own).alias("v0"))
    at = (F.col("t0") + (level - F.col("v0")) / (F.col("v1") - F.col("v0")) * (F.col("t1") - F.col("t0"))) / 1e6
    return rows.where((F.col("v0") < level) & (F.col("v1") >= level)).select(key, at.alias("at_s"))


def falls(df: DataFrame, key: str, ts: str, value: str, drop: float, rate: float) -> DataFrame:
    """(key, start, end): strictly falling triples with enough drop and rate an hour."""
    own = Window.partitionBy(key).orderBy(ts)
    rows = df.select(key, F.col(ts).alias("start"), F.lead(ts, 2).over(own).alias("end"), F.col(value).alias("a"), F.lead(value).over(own).alias("b"), F.lead(value, 2).over(own).alias("c"))
    rows = rows.where((F.col("a") > F.col("b")) & (F.col("b") > F.col("c")) & (F.col("a") - F.col("c") >= drop))
    return rows.where((F.col("a") - F.col("c")) * 3600 >= rate * seconds("start", "end")).select(key, "start", "end")


def unconfirmed_pulses(df: DataFrame, key: str, ts: str, on: Column, purpose: str, flow: DataFrame, value: str, longest: int, window: int, rise: float) -> DataFrame:
    """(key, start, end, purposes, baseline, peak): on-runs of at most ``longest``
    seconds without a response. It takes a value at most ``window`` seconds before
    the start and values until exactly ``window`` after the end; a pulse that lacks
    either stays confirmed, and one still on at the last sample is no pulse. Times
    must be distinct in a key. A short pulse meets few time buckets of its key's
    values, so a hot key spreads over its buckets."""
    own = Window.partitionBy(key).orderBy(ts)
    rows = df.withColumn("__on", on)
    rows = rows.withColumn("run", F.sum(F.when(F.col("__on") != F.coalesce(F.lag("__on").over(own), F.lit(False)), 1).otherwise(0)).over(own))
    rows = rows.groupBy(key, "run", "__on").agg(F.min(ts).alias("start"), F.array_join(F.array_sort(F.collect_set(purpose)), ",").alias("purposes"))
    rows = rows.withColumn("end", F.lead("start").over(Window.partitionBy(key).orderBy("run"))).where("__on")
    rows = rows.where((seconds("start", "end") > 0) & (seconds("start", "end") <= longest))
    width = longest + 2 * window
    bucket = lambda t: F.floor(F.unix_seconds(t) / width)
    reach = F.make_dt_interval(secs=F.lit(window))
    pulses = rows.select(key, "start", "end", "purposes", F.explode(F.sequence(bucket(F.col("start") - reach), bucket(F.col("end") + reach))).alias("__b"))
    at = F.col("__at")
    found = pulses.join(flow.select(key, F.col(ts).alias("__at"), F.col(value).alias("__v"), bucket(F.col(ts)).alias("__b")), [key, "__b"])
    before, after = (at < F.col("start")) & (at >= F.col("start") - reach), (at > F.col("start")) & (at <= F.col("end") + reach)
    found = found.groupBy(key, "start", "end", "purposes").agg(
        F.max(F.when(before, F.struct("__at", "__v"))).getField("__v").alias("baseline"), F.max(F.when(after, F.col("__v"))).alias("peak"), F.max(F.when(after, at)).alias("__last"))
    return found.where((F.col("__last") == F.col("end") + reach) & (F.col("peak") - F.col("baseline") < rise)).drop("__last")


def observed_within(df: DataFrame, observed: DataFrame, key: str, ts: str) -> DataFrame:
    """df (key, start, end) with seen: whether an observation lies strictly inside;
    running counts over the edges and observations of a key, without a join."""
    edge = F.explode(F.array(F.struct(F.col("start").alias("at"), F.lit(2).alias("side")), F.struct(F.col("end").alias("at"), F.lit(0).alias("side"))))
    rows = df.select(key, "start", "end", edge.alias("e")).select(key, "start", "end", "e.*")
    rows = rows.unionByName(observed.select(key, F.col(ts).alias("at"), F.lit(1).alias("side")), allowMissingColumns=True)
    order = Window.partitionBy(key).orderBy("at", "side").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("n", F.sum(F.when(F.col("side") == 1, 1).otherwise(0)).over(order)).where("side <> 1")
    return rows.groupBy(key, "start", "end").agg((F.max("n") > F.min("n")).alias("seen"))


def settings_schedule(df: DataFrame, key: str, ts: str, version: str, start: Column, end: Column) -> DataFrame:
    """(key, start, end, version): which settings held when in [start, end) by
    observations of them, later ones included. Between the last confirmation of the old and the first
    observation of the new version, and before the first observation, the version
    is null. Times must be distinct in a key."""
    own = Window.partitionBy(key).orderBy(ts)
    rows = df.select(key, F.col(ts).alias("at"), F.col(version).alias("v"), F.lag(version).over(own).alias("was"), F.lag(ts).over(own).alias("after"))
    known = F.struct(F.col("at"), F.lit(0).alias("side"), F.col("v"))
    lapse = F.when(F.col("v") != F.col("was"), F.struct(F.col("after").alias("at"), F.lit(1).alias("side"), F.lit(None).cast(df.schema[version].dataType).alias("v")))
    edges = rows.select(key, F.explode(F.array_compact(F.array(known, lapse))).alias("e"))
    edges = edges.union(df.select(key).distinct().select(key, F.struct(F.lit(0).cast("timestamp").alias("at"), F.lit(0).alias("side"), F.lit(None).cast(df.schema[version].dataType).alias("v"))))
    last = edges.where(F.col("e.at") < end).groupBy(key, F.greatest("e.at", start).alias("start")).agg(F.max(F.struct("e.at", "e.side", "e.v")).getField("v").alias("version"))
    at = Window.partitionBy(key).orderBy("start")
    return runs(last.withColumn("end", F.coalesce(F.lead("start").over(at), end)), key, ["version"])


def mode_kinds(df: DataFrame, key: str, ts: str, room: str, target: str, inactive: Column, adjoining: Column, band: float) -> DataFrame:
    """df with mode: inactive, warmup, maintenance or unknown after each row.

    A raised target begins a warmup, an inactive row ends any mode, and the first
    active row after it starts anew by its distance to the target. Those rows fix
    the mode whatever it was, so between two of them one first reach of the target
    (or, from unknown, of the band) decides: two windows over one exchange stand
    in for the state machine. Null room or target reach nothing."""
    own = Window.partitionBy(key).orderBy(ts)
    raised = F.coalesce(adjoining & (F.col(target) > F.lag(target).over(own)), F.lit(False))
    rows = df.withColumn("__up", raised).withColumn("__off", inactive & ~F.col("__up"))
    anew = F.when(F.col(room) < F.col(target) - band, "warmup").when(F.col(room).isNotNull() & F.col(target).isNotNull(), "maintenance").otherwise("unknown")
    rows = rows.withColumn("__fix", F.when(F.col("__up"), "warmup").when(F.col("__off"), "inactive").when(F.lag("__off").over(own), anew))
    rows = rows.withColumn("__part", F.count("__fix").over(own))
    part = Window.partitionBy(key, "__part").orderBy(ts)
    rows = rows.withColumn("__mode", F.coalesce(F.first("__fix").over(part), F.lit("unknown")))
    met = F.when(F.col("__mode") == "warmup", F.col(room) >= F.col(target)).when(F.col("__mode") == "unknown", F.abs(F.col(room) - F.col(target)) <= band)
    met = F.coalesce(F.max(F.col("__fix").isNull() & met).over(part), F.lit(False))
    return rows.withColumn("mode", F.when(met, "maintenance").otherwise(F.col("__mode"))).drop("__up", "__off", "__fix", "__part", "__mode")
