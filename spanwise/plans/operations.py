"""Operational ratios and chart points over the given tables, in the roles of
``telemetry``. The period is that of the events; times at k of 90 or more are excluded."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from spanwise.operators import intervals as iv, operations, recovery, selection
from spanwise.plans.facts import VAL, _pair
from spanwise.plans.telemetry import DAY, S, samples

LEAST_PCT = 60.0
_FACTS = ("state_coverage_pct", "coverage_pct", "observed_s", "request_s", "starts_per_request_hour", "starts_per_observed_hour", "cycle_median_s", "cycle_p90_s", "cycle_longest_s", "runtime_ratio", "without_flame_ratio",
          "modulation_mean", "modulation_median", "flow_error_median", "flow_error_p90", "flow_overshoot")


def ag8(spark, sf):
    rows = samples(spark, sf)
    lo, hi = rows.agg(F.date_trunc("day", F.min("ts")), F.date_trunc("day", F.max("ts")) + F.expr("interval 1 day")).first()  # one row
    held = iv.held_segments(rows.withColumn("s", F.struct("kind", "k")), "series", "ts", "s", DAY, F.lit(hi)).select("series", "start", "end", "s.kind", "s.k")
    states = held.where("kind <> 'error'").select("series", "start", "end", F.col("kind").isin("click", "purchase").alias("flame"), F.col("kind").isin("click", "view").alias("heating"), (F.col("kind") == "purchase").alias("hot_water"))
    found = operations.operational(states, held.where("k >= 90"), "series", F.lit(lo), F.lit(hi), held.select("series", "start", "end", F.col("k").alias("value")).where("value is not null"),
                                   _pair(spark, sf).select("series", "start", "end", (F.col("value") - F.col("target")).alias("value")), LEAST_PCT)
    return found.select("series", "reason", "starts", *[F.round(c, 4).alias(c) for c in _FACTS])


def sl5(spark, sf):
    """Forty points a series: ends, edges of gaps, and extrema of equal buckets."""
    return selection.downsampled(samples(spark, sf).select("series", "ts", "seq", "value"), "series", "ts", "value", "seq", 40).select("series", "seq")


def sl5_steps(spark, sf):
    """The same budget for a step series: both sides of each change stay."""
    step = F.floor(F.col("value") / 200)
    return selection.downsampled(samples(spark, sf).withColumn("value", step).select("series", "ts", "seq", "value"), "series", "ts", "value", "seq", 40, steps=True).select("series", "seq")


_stat = lambda source, name: f"""{name}q AS (SELECT *, sum(sec) OVER (PARTITION BY series ORDER BY value, sec, "start" ROWS UNBOUNDED PRECEDING) AS c, sum(sec) OVER (PARTITION BY series) AS t FROM {source}),
{name} AS (SELECT series, sum(value * sec) / sum(sec) AS mean, min(value) FILTER (c >= 0.5 * t) AS med, min(value) FILTER (c >= 0.9 * t) AS p90, max(value) AS top, sum(sec) AS s FROM {name}q GROUP BY 1)"""  # noqa: E731
_points_sql = lambda source, must: f"""WITH RECURSIVE v AS ({source}), r AS (SELECT *, row_number() OVER w - 1 AS i, count(*) OVER (PARTITION BY series) AS n, lag(value) OVER w AS was, lead(value) OVER w AS nxt, nullif((epoch_us(ts) - epoch_us(lag(ts) OVER w)) / 1e6, 0) AS gap FROM v WINDOW w AS (PARTITION BY series ORDER BY ts, seq)),
md AS (SELECT series, 3 * median(gap) AS most FROM r GROUP BY 1), e AS (SELECT r.*, coalesce(gap > most, false) AS edge FROM r JOIN md USING (series)), m AS (SELECT *, {must} OR i = 0 OR i = n - 1 AS must FROM e),
k AS (SELECT *, count(*) FILTER (must) OVER (PARTITION BY series) AS kept FROM m), b AS (SELECT series, greatest(1, (40 - kept) // 2) AS many, any_value(n) AS n FROM k GROUP BY ALL),
cut AS (SELECT series, CAST(floor(x.b * (n::DOUBLE / many)) AS BIGINT) AS lo, CAST(floor((x.b + 1) * (n::DOUBLE / many)) AS BIGINT) AS hi FROM b, generate_series(0, many - 1) AS x(b)),
part AS (SELECT k.series, k.seq, row_number() OVER (PARTITION BY k.series, lo ORDER BY value, i) AS a, row_number() OVER (PARTITION BY k.series, lo ORDER BY value DESC, i) AS z FROM k JOIN cut ON cut.series = k.series AND i >= lo AND i < hi WHERE kept < 40)
SELECT series, seq FROM k WHERE n <= 40 OR must UNION SELECT series, seq FROM part WHERE a = 1 OR z = 1"""  # noqa: E731
_V = S.removeprefix("WITH ").replace("s AS (", "SELECT series, ts, seq, value FROM (", 1)

QUERIES = {
    "SL5_budget": (sl5, _points_sql(_V + " WHERE value IS NOT NULL", "edge OR coalesce(lead(edge) OVER (PARTITION BY series ORDER BY i), false)")),
    "SL5_step_budget": (sl5_steps, _points_sql(_V.replace("seq, value FROM", "seq, floor(value / 200) AS value FROM", 1) + " WHERE value IS NOT NULL", "coalesce(value <> was, false) OR coalesce(value <> nxt, false)")),
    "AG8_operational": (ag8, VAL + f""", p AS (SELECT date_trunc('day', min(ts)) AS lo, date_trunc('day', max(ts)) + INTERVAL 1 DAY AS hi FROM s),
h AS (SELECT series, ts AS "start", coalesce(lead(ts) OVER (PARTITION BY series ORDER BY ts), hi) AS "end", kind, k FROM s, p), held AS (SELECT *, (epoch_us("end") - epoch_us("start")) / 1e6 AS sec FROM h WHERE "end" > "start" AND epoch_us("end") - epoch_us("start") <= {DAY}e6),
st AS (SELECT *, kind IN ('click', 'purchase') AS flame, kind IN ('click', 'view') AS heats FROM held WHERE kind <> 'error'), vd AS (SELECT * FROM st WHERE k IS NULL OR k < 90),
tot AS (SELECT series, sum(sec) AS seen FROM st GROUP BY 1), ex AS (SELECT series, sum(sec) AS gone FROM held WHERE k >= 90 GROUP BY 1),
sums AS (SELECT series, sum(sec) AS obs, coalesce(sum(sec) FILTER (heats), 0) AS req, coalesce(sum(sec) FILTER (heats AND flame), 0) AS fl FROM vd GROUP BY 1),
w1 AS (SELECT *, coalesce(lag("end") OVER w = "start", false) AS touch, coalesce(lead("start") OVER w = "end", false) AS goes, lag(flame) OVER w AS was FROM vd WINDOW w AS (PARTITION BY series ORDER BY "start")),
w2 AS (SELECT *, sum(CASE WHEN touch AND flame = was THEN 0 ELSE 1 END) OVER (PARTITION BY series ORDER BY "start") AS run FROM w1),
runs AS (SELECT series, min("start") AS a, max("end") AS z, arg_min(heats AND touch, "start") AS started, bool_and(heats) AS every_, arg_max(goes, "start") AS goes FROM w2 WHERE flame GROUP BY series, run),
cy AS (SELECT series, count(*) FILTER (started) AS starts, median(d) FILTER (d IS NOT NULL) AS md, quantile_cont(d, 0.9) AS p90, max(d) AS longest FROM (SELECT *, CASE WHEN started AND every_ AND goes THEN (epoch_us(z) - epoch_us(a)) / 1e6 END AS d FROM runs) GROUP BY 1),
mo AS (SELECT series, "start", sec, k AS value FROM vd WHERE heats AND flame AND k IS NOT NULL), {_stat('mo', 'mm')},
fe AS (SELECT b.series, greatest(b."start", v."start") AS "start", (least(epoch_us(b."end"), epoch_us(v."end")) - greatest(epoch_us(b."start"), epoch_us(v."start"))) / 1e6 AS sec, value - target AS value FROM both_ b JOIN vd v ON v.series = b.series AND v.heats AND b."start" < v."end" AND b."end" > v."start"), {_stat('fe', 'ff')},
j AS (SELECT tot.series, seen, (epoch_us(hi) - epoch_us(lo)) / 1e6 AS whole, coalesce(gone, 0) AS gone, coalesce(obs, 0) AS obs, coalesce(req, 0) AS req, coalesce(fl, 0) AS fl, coalesce(starts, 0) AS starts, cy.md, cy.p90, longest, mm.mean, mm.med, mm.s AS ms, ff.med AS fmed, ff.p90 AS fp90, ff.top, ff.s AS fs
FROM tot CROSS JOIN p LEFT JOIN ex USING (series) LEFT JOIN sums USING (series) LEFT JOIN cy USING (series) LEFT JOIN mm USING (series) LEFT JOIN ff USING (series)),
c AS (SELECT *, 100 * seen / whole AS sc, coalesce(100 * obs / nullif(whole - gone, 0), 0) AS oc FROM j), g AS (SELECT *, sc >= {LEAST_PCT} AS a, sc >= {LEAST_PCT} AND obs >= 60 AND oc >= {LEAST_PCT} AS o, sc >= {LEAST_PCT} AND obs >= 60 AND oc >= {LEAST_PCT} AND req >= 60 AS q FROM c),
z AS (SELECT *, a AND coalesce(100 * ms / nullif(fl, 0), 0) >= {LEAST_PCT} AS m, q AND coalesce(100 * fs / nullif(req, 0), 0) >= {LEAST_PCT} AS f FROM g)
SELECT series, CASE WHEN NOT a THEN 'insufficient_state_coverage' WHEN NOT o THEN 'no_qualified_observed_time' WHEN NOT q THEN 'no_qualified_request' END AS reason, starts, """ + ", ".join(f"round({e}, 4) AS {n}" for n, e in zip(_FACTS, (
        "sc", "oc", "obs", "req", "CASE WHEN q THEN starts / (req / 3600) END", "CASE WHEN o THEN starts / (obs / 3600) END", "CASE WHEN a THEN md END", "CASE WHEN a THEN p90 END", "CASE WHEN a THEN longest END", "CASE WHEN q THEN fl / req END", "CASE WHEN q THEN (req - fl) / req END",
        "CASE WHEN m THEN mean END", "CASE WHEN m THEN med END", "CASE WHEN f THEN fmed END", "CASE WHEN f THEN fp90 END", "CASE WHEN f THEN greatest(top, 0) END"))) + " FROM z"),
}


def _intervals(spark, sf):
    """From sample to sample: a purchase or an unknown value opens, 150 is the target."""
    own = Window.partitionBy("series").orderBy("ts", "seq")
    rows = samples(spark, sf).withColumns({"end": F.lead("ts").over(own), "then": F.lead("value").over(own)}).withColumnRenamed("ts", "start").where("end > start")
    unknown = F.col("value").isNull() | F.col("then").isNull()
    calm = recovery.steady(F.col("value"), F.col("then"), F.lit(150.0), F.col("kind") == "purchase", 100.0, 40.0)
    return rows.select("series", "seq", "start", "end", ((F.col("kind") == "purchase") | unknown).alias("opens"), calm.alias("steady"), F.coalesce(F.col("k") < 80, F.lit(False)).alias("measured"))


def ev13(spark, sf):
    return recovery.recovering(_intervals(spark, sf), "series").select("series", "seq", "recovering")


def ev13_days(spark, sf):
    found = recovery.windows(recovery.recovering(_intervals(spark, sf), "series"), "series")
    return found.select("series", F.date_format("day", "yyyy-MM-dd").alias("day"), F.round("recovering_s", 3).alias("recovering_s"), "intervals")


_RECOVERY = S + """, i0 AS (SELECT series, seq, ts AS "start", lead(ts) OVER w AS "end", kind, k, value, lead(value) OVER w AS thn FROM s WINDOW w AS (PARTITION BY series ORDER BY ts, seq)),
i1 AS (SELECT *, kind = 'purchase' OR value IS NULL OR thn IS NULL AS opens, coalesce(abs(thn - 150) <= 100 AND abs(thn - value) * 3600 / ((epoch_us("end") - epoch_us("start")) / 1e6) <= 40 AND kind <> 'purchase', false) AS calm FROM i0 WHERE "end" > "start"),
i2 AS (SELECT *, calm AND NOT opens AND coalesce(k < 80, false) AS hit, CASE WHEN opens OR NOT calm OR coalesce(lag("end") OVER w <> "start", true) THEN 1 ELSE 0 END AS r FROM i1 WINDOW w AS (PARTITION BY series ORDER BY "start", "end")),
i3 AS (SELECT *, sum(r) OVER (PARTITION BY series ORDER BY "start", "end" ROWS UNBOUNDED PRECEDING) AS part FROM i2), i4 AS (SELECT *, count(*) FILTER (hit) OVER (PARTITION BY series, part ORDER BY "start", "end" ROWS UNBOUNDED PRECEDING) AS hits FROM i3),
i5 AS (SELECT *, CASE WHEN opens THEN true WHEN hit AND hits = 3 THEN false END AS event FROM i4),
rec AS (SELECT *, opens OR coalesce(last_value(event IGNORE NULLS) OVER (PARTITION BY series ORDER BY "start", "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS recovering FROM i5)"""
QUERIES |= {
    "EV13_recovery_days": (ev13, _RECOVERY + " SELECT series, seq, recovering FROM rec"),
    "EV13_left_out": (ev13_days, _RECOVERY + """ SELECT series, strftime("start", '%Y-%m-%d') AS day, round(sum(CASE WHEN recovering THEN (epoch_us("end") - epoch_us("start")) / 1e6 ELSE 0 END), 3) AS recovering_s, count(*) AS intervals FROM rec GROUP BY 1, 2"""),
}
