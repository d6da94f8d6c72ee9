"""Queries on what observations prove: pulses without a response, outages that an
observation contradicts, and settings between their confirmations."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from spanwise.operators import decode, episodes as ep, intervals as iv
from spanwise.plans.telemetry import S, _rounded, _span, samples

GRID = 21_600
START, END = "2024-01-05", "2024-01-19"
_at = lambda day: F.lit(day).cast("timestamp")


def ev4(spark, sf):
    """Flame runs of at most two steps of six hours with too small a rise."""
    known = samples(spark, sf).where("kind <> 'error'").withColumn("ts", F.timestamp_seconds(F.floor(F.unix_seconds("ts") / GRID) * GRID))
    rows = known.groupBy("series", "ts").agg(F.max_by("kind", "seq").alias("kind"), F.max_by("raw", "seq").alias("raw"))
    return _span(ep.unconfirmed_pulses(rows, "series", "ts", F.col("kind").isin("click", "purchase"), "kind", rows, "raw", 2 * GRID, GRID, 30.0))


def ev18(spark, sf):
    """Losses inside the period: excluded, or a conflict if the series was seen."""
    rows = samples(spark, sf)
    lost = iv.loss_restore(rows.where(F.col("ts") < _at(END)), "series", "ts", "kind", "purchase", "signup", "seq").withColumn("end", F.coalesce("end", _at(END)))
    lost = ep.observed_within(lost.select("series", "start", "end").where(F.col("end") > _at(START)), rows.where("kind = 'click'"), "series", "ts")
    return _span(lost.select("series", F.greatest("start", _at(START)).alias("start"), "end", F.when(F.col("seen"), "conflict").otherwise("excluded").alias("status")))


def ev20(spark, sf):
    """Versions of the settings (quarters of the signup values) over the period."""
    rows = samples(spark, sf).where("kind = 'signup'").withColumn("version", F.floor(F.col("raw") / 25))
    return _rounded(_span(ep.settings_schedule(rows, "series", "ts", "version", _at(START), _at(END))), "sec")


def ev20_limits(spark, sf):
    """The curve's limit at each value of the second signal."""
    point = lambda x, y: F.struct(F.lit(float(x)).alias("x"), y.cast("double").alias("y"))
    curve = F.array(point(80, F.lit(25)), point(10, 60 - F.col("raw") / 10), point(40, F.lit(40)))
    return _rounded(samples(spark, sf).select("seq", decode.on_curve(curve, F.col("k")).alias("limit_c")), "limit_c")


def ev14(spark, sf):
    """Modes by the values (room) and steps of the second signal (target)."""
    before = F.lag("ts").over(Window.partitionBy("series").orderBy("ts"))
    rows = samples(spark, sf).withColumn("room", F.when(F.col("kind") != "signup", F.col("value"))).withColumn("target", F.floor(F.col("k") / 25) * 25)
    rows = rows.withColumn("near", F.coalesce(iv.seconds(before, "ts") <= 86_400, F.lit(False)))
    return ep.mode_kinds(rows, "series", "ts", "room", "target", F.col("kind") == "error", F.col("near"), 10.0).select("series", "seq", "mode")


_IN = "g.series = q.series AND g.t"
QUERIES = {
    "EV4_unconfirmed_pulses": (ev4, S + f""", g AS (SELECT series, epoch_us(ts) // {GRID}000000 * {GRID} AS t, max_by(kind, seq) AS kind, max_by(raw, seq) AS v FROM s WHERE kind <> 'error' GROUP BY 1, 2),
c AS (SELECT *, kind IN ('click', 'purchase') AS lit, coalesce(lag(kind IN ('click', 'purchase')) OVER (PARTITION BY series ORDER BY t), false) AS was FROM g), r AS (SELECT *, sum(CASE WHEN lit <> was THEN 1 ELSE 0 END) OVER (PARTITION BY series ORDER BY t ROWS UNBOUNDED PRECEDING) AS run FROM c),
p AS (SELECT series, run, lit, min(t) AS a, string_agg(DISTINCT kind, ',' ORDER BY kind) AS purposes FROM r GROUP BY 1, 2, 3), q AS (SELECT *, lead(a) OVER (PARTITION BY series ORDER BY run) AS b FROM p),
f AS (SELECT q.series, a, b, purposes, (SELECT max_by(v, t) FROM g WHERE {_IN} < q.a AND g.t >= q.a - {GRID}) AS baseline, (SELECT max(v) FROM g WHERE {_IN} > q.a AND g.t <= q.b + {GRID}) AS peak, (SELECT max(t) FROM g WHERE {_IN} > q.a AND g.t <= q.b + {GRID}) AS reach FROM q WHERE lit AND b - a <= {2 * GRID})
SELECT series, a * 1000000 AS "start", b * 1000000 AS "end", purposes, baseline, peak FROM f WHERE reach = b + {GRID} AND peak - baseline < 30"""),
    "EV18_reliability_exclusions": (ev18, S + f""", t AS (SELECT series, ts, kind, lag(kind) OVER (PARTITION BY series ORDER BY ts) AS was FROM s WHERE kind IN ('purchase', 'signup') AND ts < TIMESTAMP '{END}'),
ch AS (SELECT series, kind, ts AS a, coalesce(lead(ts) OVER (PARTITION BY series ORDER BY ts), TIMESTAMP '{END}') AS b FROM t WHERE kind IS DISTINCT FROM was)
SELECT series, epoch_us(greatest(a, TIMESTAMP '{START}')) AS "start", epoch_us(b) AS "end", CASE WHEN EXISTS (SELECT 1 FROM s WHERE s.series = ch.series AND s.kind = 'click' AND s.ts > ch.a AND s.ts < ch.b) THEN 'conflict' ELSE 'excluded' END AS status FROM ch WHERE kind = 'purchase' AND b > TIMESTAMP '{START}'"""),
    "EV20_settings_schedule": (ev20, S + f""", v AS (SELECT series, ts, CAST(floor(raw / 25) AS BIGINT) AS version FROM s WHERE kind = 'signup'), n AS (SELECT *, lead(version) OVER w AS nv, lead(ts) OVER w AS nt, row_number() OVER w AS i FROM v WINDOW w AS (PARTITION BY series ORDER BY ts)),
held AS (SELECT series, ts AS a, coalesce(nt, TIMESTAMP '{END}') AS b, CASE WHEN nv IS NULL OR nv = version THEN version END AS version FROM n UNION ALL SELECT series, TIMESTAMP '1970-01-01', ts, NULL FROM n WHERE i = 1),
cl AS (SELECT series, greatest(a, TIMESTAMP '{START}') AS a, least(b, TIMESTAMP '{END}') AS b, version FROM held WHERE a < TIMESTAMP '{END}' AND b > TIMESTAMP '{START}'),
m AS (SELECT *, CASE WHEN version IS NOT DISTINCT FROM lag(version) OVER w AND lag(a) OVER w IS NOT NULL THEN 0 ELSE 1 END AS nw FROM cl WINDOW w AS (PARTITION BY series ORDER BY a)), k AS (SELECT *, sum(nw) OVER (PARTITION BY series ORDER BY a ROWS UNBOUNDED PRECEDING) AS run FROM m)
SELECT series, version, epoch_us(min(a)) AS "start", epoch_us(max(b)) AS "end", round((epoch_us(max(b)) - epoch_us(min(a))) / 1e6, 6) AS sec FROM k GROUP BY series, run, version"""),
    "EV14_mode_kinds": (ev14, S.replace("WITH s", "WITH RECURSIVE s") + """, n AS (SELECT series, seq, CASE WHEN kind <> 'signup' THEN value END AS room, floor(k / 25) * 25 AS target, kind = 'error' AS off_, row_number() OVER w AS i, coalesce(epoch_us(ts) - epoch_us(lag(ts) OVER w) <= 86400000000, false) AS near FROM s WINDOW w AS (PARTITION BY series ORDER BY ts)),
step AS (SELECT series, i, seq, target, CASE WHEN off_ THEN 'inactive' WHEN abs(room - target) <= 10 THEN 'maintenance' ELSE 'unknown' END AS mode FROM n WHERE i = 1
UNION ALL SELECT n.series, n.i, n.seq, n.target, CASE WHEN n.near AND n.target > step.target THEN 'warmup' WHEN n.off_ THEN 'inactive'
WHEN step.mode = 'inactive' THEN CASE WHEN n.room < n.target - 10 THEN 'warmup' WHEN n.room IS NOT NULL AND n.target IS NOT NULL THEN 'maintenance' ELSE 'unknown' END
WHEN (step.mode = 'warmup' AND n.room >= n.target) OR (step.mode = 'unknown' AND abs(n.room - n.target) <= 10) THEN 'maintenance' ELSE step.mode END FROM step JOIN n ON n.series = step.series AND n.i = step.i + 1)
SELECT series, seq, mode FROM step"""),
    "EV20_curve_limits": (ev20_limits, S + """ SELECT seq, round(CASE WHEN k BETWEEN 10 AND 40 THEN 60 - raw / 10 + (k - 10) / 30 * (40 - (60 - raw / 10)) WHEN k > 40 AND k <= 80 THEN 40 - (k - 40) * 15 / 40 END, 6) AS limit_c FROM s"""),
}
