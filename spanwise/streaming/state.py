"""Stateful processors over the events: connections that are lost for long, and
settings that change.

Each keeps a few numbers for a series and the rows that the watermark has not
passed; results do not depend on how rows are cut into batches. A row older than the
watermark is a late correction and changes nothing here (ST4 recomputes for those)."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from spanwise.streaming.telemetry import E0, drain, events

TIMEOUT = 2 * 3_600_000_000  #: microseconds after which an open loss counts
DELAY_MIN = 60
OUTAGE = "series long, lost_us long, state string, at_us long"
SETTING = "series long, us long, version long, was long, after_us long"
#: What a series keeps: rows that the watermark has not passed, and the machine's own numbers.
KEPT = "us array<long>, kind array<long>, a long, b long"


def _in_order(step):
    """A processor of (us, kind) rows whose result does not depend on how they are cut
    into batches. Rows wait until the watermark has passed them and are then taken
    in order of time (of kind where times are equal); a timer wakes the series for
    them. step(numbers, rows, until): applies rows to the two numbers kept and gives
    (numbers, output rows, next time at which it has something to say)."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState):
        us, kind, a, b = state.get if state.exists else ([], [], None, None)
        mark = state.getCurrentWatermarkMs() * 1000
        held = list(zip(us, kind))
        if not state.hasTimedOut:
            for batch in batches:
                held += [x for x in zip(batch["us"].tolist(), batch["kind"].tolist()) if x[0] >= mark or not mark]
        held.sort()
        ready = [x for x in held if x[0] < mark]  # rows that may still come are later than the watermark
        held = held[len(ready) :]
        (a, b), out, due = step((a, b), ready, mark)
        state.update(([x[0] for x in held], [x[1] for x in held], a, b))
        times = [x for x in (held[0][0] + 1 if held else None, due) if x is not None]
        if times:  # timers are in milliseconds and must lie ahead of the watermark
            state.setTimeoutTimestamp(max(-(-min(times) // 1000), state.getCurrentWatermarkMs() + 1))
        return key[0], out

    return run


def outages(rows: DataFrame, timeout: int = TIMEOUT) -> DataFrame:
    """Rows (series, ts, kind loss or restore) to (series, lost_us, state, at_us): a
    loss still open after ``timeout`` is lost, at that time; a later restore ends it.
    A loss that is restored sooner gives nothing; of rows at one time the restore
    comes first. Needs a watermark on ts: rows apply once it has passed them, in order
    of time, so batches may be cut anywhere; older rows than that are dropped."""

    def machine(numbers, ready, mark):
        opened, said = numbers[0], bool(numbers[1])
        out = []

        def tell(until):
            nonlocal said
            if opened is not None and not said and until - opened >= timeout:
                out.append((opened, "lost", opened + timeout))
                said = True

        for us, loss in ready:
            tell(us)
            if loss and opened is None:
                opened, said = us, False
            elif not loss:
                if said:
                    out.append((opened, "restored", us))
                opened, said = None, False
        tell(mark)  # all up to the watermark is known
        return (opened, int(said)), out, None if opened is None or said else opened + timeout

    run = _in_order(machine)

    def step(key, batches, state):
        series, out = run(key, batches, state)
        if out:  # a frame for each series costs more than its rows
            yield pd.DataFrame([(series, *r) for r in out], columns=["series", "lost_us", "state", "at_us"])

    # it reads ts, so it stays above the watermark: rows of all kinds move the time
    ours = F.when(F.col("ts").isNotNull(), F.col("kind").isin("loss", "restore"))
    found = rows.where(ours).select("series", "ts", F.unix_micros("ts").alias("us"), (F.col("kind") == "loss").cast("long").alias("kind"))
    return found.groupBy("series").applyInPandasWithState(step, OUTAGE, KEPT, "append", GroupStateTimeout.EventTimeTimeout)


def setting_changes(rows: DataFrame) -> DataFrame:
    """Rows (series, ts, version) to those whose version is new (the first included):
    was is the version before and after_us the last time that one was confirmed.
    Needs a watermark on ts: rows apply once it has passed them, in order of (time,
    version), so batches may be cut anywhere; older rows than that are dropped."""

    def machine(numbers, ready, mark):
        (confirmed, version), out = numbers, []
        for us, new in ready:
            if new != version:
                out.append((us, new, version, confirmed))
            confirmed, version = us, new
        return (confirmed, version), out, None

    run = _in_order(machine)

    def step(key, batches, state):
        series, out = run(key, batches, state)
        if out:  # a frame for each series costs more than its rows
            yield pd.DataFrame([(series, *r) for r in out], columns=["series", "us", "version", "was", "after_us"], dtype=object)

    ours = F.when(F.col("ts").isNotNull(), F.col("version").isNotNull())
    found = rows.where(ours).select("series", "ts", F.unix_micros("ts").alias("us"), F.col("version").cast("long").alias("kind"))
    return found.groupBy("series").applyInPandasWithState(step, SETTING, KEPT, "append", GroupStateTimeout.EventTimeTimeout)


def st5(spark, sf_dir) -> DataFrame:
    """Outages of the events: a purchase is a loss, a signup a restore."""
    kind = F.when(F.col("kind") == "purchase", "loss").when(F.col("kind") == "signup", "restore")
    rows = events(spark, sf_dir).withWatermark("ts", f"{DELAY_MIN} minutes").withColumn("kind", kind)
    return drain(outages(rows), "outages", "append")


def st10(spark, sf_dir) -> DataFrame:
    """Versions (quarters of the signup values) as they are first seen."""
    version = F.when(F.col("kind") == "signup", F.floor(F.col("value") / 25))
    rows = events(spark, sf_dir).withWatermark("ts", f"{DELAY_MIN} minutes").withColumn("version", version)
    return drain(setting_changes(rows), "settings", "append")


PASSED = f"(SELECT max(epoch_us(ts)) // 1000 * 1000 - {DELAY_MIN * 60_000_000} FROM events)"
QUERIES = {
    "ST5_outages": (st5, f"""WITH x AS (SELECT series, epoch_us(ts) AS us, kind = 'purchase' AS loss FROM ({E0}) WHERE kind IN ('purchase', 'signup') AND epoch_us(ts) < {PASSED}),
y AS (SELECT *, lag(loss) OVER (PARTITION BY series ORDER BY us, loss) AS was FROM x), z AS (SELECT series, us, loss, lead(us) OVER (PARTITION BY series ORDER BY us, loss) AS nxt FROM y WHERE loss IS DISTINCT FROM was),
lost AS (SELECT z.* FROM z WHERE loss AND (nxt - us >= {TIMEOUT} OR (nxt IS NULL AND us + {TIMEOUT} <= {PASSED})))
SELECT series, us AS lost_us, 'lost' AS state, us + {TIMEOUT} AS at_us FROM lost UNION ALL SELECT series, us, 'restored', nxt FROM lost WHERE nxt IS NOT NULL"""),
    "ST10_setting_changes": (st10, f"""WITH x AS (SELECT series, epoch_us(ts) AS us, CAST(floor(value / 25) AS BIGINT) AS version FROM ({E0}) WHERE kind = 'signup' AND value IS NOT NULL AND epoch_us(ts) < {PASSED}),
y AS (SELECT *, lag(version) OVER w AS was, lag(us) OVER w AS after_us FROM x WINDOW w AS (PARTITION BY series ORDER BY us, version)) SELECT series, us, version, was, after_us FROM y WHERE version IS DISTINCT FROM was"""),
}
