"""Episode, consumption and comparison queries over the given tables, in the
roles of ``telemetry``."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from spanwise.operators import episodes as ep
from spanwise.operators import intervals as iv
from spanwise.operators import joins, metrics, models
from spanwise.plans.telemetry import DAY, DAYS, HELD, PIECES, US, S, _merge_sql, _rounded, _segments, _span, _states, samples
from spanwise.session import load

FLAME = "kind IN ('click', 'view')"


def _own():
    return Window.partitionBy("series").orderBy("ts")


def _runs_sql(source, *state):
    same = " AND ".join(f"{c} IS NOT DISTINCT FROM lag({c}) OVER w" for c in state)
    return f"""n0 AS (SELECT *, CASE WHEN "start" = lag("end") OVER w AND {same} THEN 0 ELSE 1 END AS nw FROM {source} WINDOW w AS (PARTITION BY series ORDER BY "start")),
n1 AS (SELECT *, sum(nw) OVER (PARTITION BY series ORDER BY "start" ROWS UNBOUNDED PRECEDING) AS run FROM n0),
rn AS (SELECT series, run, {', '.join(state)}, min("start") AS "start", max("end") AS "end", (epoch_us(max("end")) - epoch_us(min("start"))) / 1e6 AS sec FROM n1 GROUP BY series, run, {', '.join(state)})"""


def _pieces(spark, sf):
    targets = samples(spark, sf).where("kind = 'signup'").select("series", "ts", F.col("raw").alias("target"))
    return joins.hold(_segments(spark, sf), targets, "series", "ts", "target").withColumn("sec", iv.seconds("start", "end"))


def _flames(spark, sf):
    return _states(spark, sf).withColumn("on_", F.col("kind").isin("click", "view"))


def _cycles(spark, sf):
    return metrics.cycles(_flames(spark, sf), "series", on="on_")


CYC = HELD + f", fl AS (SELECT *, {FLAME} AS on_ FROM held), " + _runs_sql("fl", "on_") + """,
cyc AS (SELECT series, "start", "end", sec FROM (SELECT *, lead("start") OVER w AS na, lead(on_) OVER w AS no FROM rn WINDOW w AS (PARTITION BY series ORDER BY "start")) WHERE on_ AND na = "end" AND NOT no)"""


def ev1(spark, sf):
    return _rounded(_span(ep.band_episodes(_pieces(spark, sf), "series", "value", "target", 5.0)), "peak")


def ev2(spark, sf):
    changes = samples(spark, sf).where("kind = 'signup'").select("series", "ts", "raw")
    found = joins.as_of(_cycles(spark, sf).withColumnRenamed("started_at", "ts"), changes, "series", "ts", "raw", ttl=2.0 * DAY)
    kind = F.when(F.col("value_ts").isNotNull(), "after_control_change").when(F.col("sec") < DAY / 2, "short").otherwise("normal")
    return _rounded(found.select("series", F.unix_micros("ts").alias("start"), kind.alias("context"), "sec"), "sec")


def ev5(spark, sf):
    return _rounded(_span(ep.strict_cycles(_flames(spark, sf), "series", "on_")), "sec")


def ev6(spark, sf):
    hot = ep.numbered(_states(spark, sf).where("kind = 'purchase'"), "series", ["kind"])
    values = samples(spark, sf).select("series", F.col("ts").alias("start"), "raw")
    found = hot.join(values, ["series", "start"]).groupBy("series", "run").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.max("raw").alias("peak"), F.count("*").alias("parts"))
    kind = F.when(F.col("peak") >= 30, "probable service").when(F.col("parts") > 1, "repeated").otherwise("ordinary")
    return _span(found.select("series", "start", "end", "peak", "parts", kind.alias("class")))


def ev7(spark, sf):
    rows = samples(spark, sf).withColumn("drop", F.col("raw") - F.lead("raw").over(_own())).withColumn("gap", iv.seconds("ts", F.lead("ts").over(_own())))
    rows = rows.where(f"drop >= 5 and gap <= {DAY} and drop * 3600 >= 0.5 * gap and kind not in ('click', 'purchase')").withColumn("n", F.row_number().over(_own()))
    return _rounded(rows.where("n <= 5").select("series", "seq", "n", "drop"), "drop")


def ev8(spark, sf):
    is_ = lambda k: F.col("kind") == k
    return _span(ep.incidents(samples(spark, sf), "series", "ts", "seq", is_("purchase"), is_("signup"), is_("error"), is_("click"), 1.0 * DAY))


def ev9(spark, sf):
    last = lambda *k: F.max(F.when(F.col("kind").isin(*k), F.col("ts")))
    g = samples(spark, sf).groupBy("series").agg(last("purchase").alias("lost"), last("signup").alias("restored"), last("click", "view").alias("seen"))
    g = g.withColumn("open", F.col("lost").isNotNull() & (F.col("restored").isNull() | (F.col("restored") < F.col("lost"))))
    late = iv.seconds(F.col("lost"), F.lit("2024-01-31").cast("timestamp")) >= 7200
    state = F.when(F.col("open") & late, "lost").when(F.col("open"), "pending").when(F.col("restored").isNotNull() & (F.col("seen").isNull() | (F.col("seen") <= F.col("restored"))), "awaiting telemetry").otherwise("connected")
    return g.select("series", state.alias("state"))


def ev11(spark, sf):
    off = (F.col("kind") == "signup") | (F.col("k").cast("int").bitwiseAND(1) == 1)
    found = ep.runs(_states(spark, sf).withColumn("off", F.coalesce(off, F.lit(False))), "series", ["off"])
    return _rounded(found.groupBy("series").agg(F.count_if("off").alias("windows"), metrics.share(F.sum(F.when(F.col("off"), F.col("sec")).otherwise(0.0)), F.sum("sec")).alias("inactive_pct")), "inactive_pct")


def ev12(spark, sf):
    known = samples(spark, sf).where("value is not null")
    return _span(iv.merge(ep.falls(known, "series", "ts", "value", 5.0, 0.2), "series"))


def ev13(spark, sf):
    rows = ep.recovery(samples(spark, sf), "series", "ts", "raw", F.col("kind").isin("purchase", "error"), 10.0)
    return rows.select("series", "seq", "recovering")


def ev15(spark, sf):
    return _rounded(_span(ep.request_cycles(_flames(spark, sf), "series", "on_")), "on_s", "pause_s", "next_s")


def ev16(spark, sf):
    rows = samples(spark, sf).withColumn("on_", F.col("kind").isin("click", "view"))
    rows = rows.withColumn("was", F.lag("on_").over(_own())).withColumn("before", F.lag("ts").over(_own())).where("was <> on_")
    low, high = F.floor(F.unix_micros("before") / 60_000_000), F.ceil(F.unix_micros("ts") / 60_000_000)
    return rows.select("series", "seq", "on_", low.alias("after_minute"), high.alias("by_minute"))


def ev17(spark, sf):
    found = ep.crossings(samples(spark, sf).where("value is not null"), "series", "ts", "value", 20.0)
    return _rounded(found.groupBy("series").agg(F.min("at_s").alias("reached_s"), F.count("*").alias("crossings")).withColumn("reached_s", F.round("reached_s", 2)))


def ev22(spark, sf):
    above = _pieces(spark, sf).groupBy("series").agg(F.sum(F.when(F.col("value") - F.col("target") > 5, F.col("sec")).otherwise(0.0)).alias("above_s"))
    duty = _states(spark, sf).groupBy("series").agg(metrics.share(F.sum(F.when(F.col("kind").isin("click", "purchase"), F.col("sec")).otherwise(0.0)), F.sum("sec")).alias("duty_pct"))
    note = F.when((F.col("above_s") > 0) & (F.col("duty_pct") < 25), "not heating").when(F.col("above_s") > 0, "heating possible").otherwise("none")
    return _rounded(above.join(duty, "series").select("series", "above_s", "duty_pct", note.alias("attribution")), "above_s", "duty_pct")


def ev23(spark, sf):
    short = F.col("sec") < DAY / 2
    rows = _cycles(spark, sf).withColumn("n", F.row_number().over(Window.partitionBy("series", short).orderBy("started_at")))
    g = rows.groupBy("series").agg(
        metrics.share(F.count_if(short), F.count("*")).alias("short_pct"),
        F.array_join(F.array_sort(F.collect_list(F.when(short & (F.col("n") <= 10), F.unix_micros("started_at")))), ",").alias("evidence"))
    return _rounded(g.where("short_pct >= 30").withColumn("advice", F.lit("observe")), "short_pct")


def _readings(spark, sf):
    """Meter readings that turn over at 500: differences within one turn."""
    day = load(spark, sf, "lineitem").groupBy("l_suppkey", "l_returnflag", F.to_date("l_shipdate").alias("day")).agg(F.sum("l_quantity").cast("double").alias("q"))
    own = Window.partitionBy("l_suppkey", "l_returnflag").orderBy("day")
    return metrics.meter_differences(day.withColumn("reading", F.sum("q").over(own) % 500), ["l_suppkey", "l_returnflag"], "day", "reading")


READ = """WITH d AS (SELECT l_suppkey, l_returnflag, CAST(l_shipdate AS DATE) AS day, CAST(sum(l_quantity) AS DOUBLE) AS q FROM lineitem GROUP BY 1, 2, 3), r AS (SELECT *, sum(q) OVER (PARTITION BY l_suppkey, l_returnflag ORDER BY day) % 500 AS reading FROM d),
x AS (SELECT l_suppkey, l_returnflag, lag(day) OVER w AS st, day AS en, reading - lag(reading) OVER w AS volume FROM r WINDOW w AS (PARTITION BY l_suppkey, l_returnflag ORDER BY day)), diff AS (SELECT * FROM x WHERE st IS NOT NULL AND volume >= 0)"""


def _days(df):
    return df.withColumns({c: F.date_format(c, "yyyy-MM-dd") for c in ("start", "end")})


def gs4(spark, sf):
    rows = _readings(spark, sf).withColumn("hours", 24.0 * F.datediff("end", "start"))
    return _rounded(models.mean_rate(rows, ["l_suppkey"], "volume", "hours", 0.02, 0.5, 5), "rate")


def gs9(spark, sf):
    rows = load(spark, sf, "lineitem").groupBy("l_suppkey", "l_shipdate").agg(F.sum("l_extendedprice").cast("double").alias("y"), F.sum("l_quantity").cast("double").alias("a"), F.count("*").cast("double").alias("b"))
    return models.fit_two(rows, ["l_suppkey"], "y", "a", "b").withColumns({"u": F.round("u", 3), "v": F.round("v", 3)})


def gs13(spark, sf):
    rows = load(spark, sf, "lineitem").groupBy("l_suppkey", F.date_format("l_shipdate", "yyyy-MM").alias("month")).agg(F.sum("l_extendedprice").cast("double").alias("w"), F.sum("l_quantity").cast("double").alias("q"))
    rows = rows.withColumn("total", F.sum("q").over(Window.partitionBy("l_suppkey")))
    return _rounded(models.reconciled(rows, ["l_suppkey"], "w", "total").select("l_suppkey", "month", "slice"), "slice")


def gs15(spark, sf):
    return _rounded(_days(models.chains(_readings(spark, sf), ["l_suppkey", "l_returnflag"])), "volume")


def gs16(spark, sf):
    rows = _readings(spark, sf).withColumn("most", 3.0 * F.datediff("end", "start")).where("volume > most")
    return _rounded(_days(rows).drop("most"), "volume")


def gs17(spark, sf):
    rows = _readings(spark, sf).withColumn("high", F.col("volume") > 3.0 * F.datediff("end", "start"))
    return _rounded(rows.groupBy("l_returnflag").agg(F.sum("volume").alias("volume"), F.count_if("high").alias("flagged"), F.count("*").alias("parts")), "volume")


def cp4(spark, sf):
    day = iv.by_day(_states(spark, sf), "series").groupBy("series", "day", "kind").agg(F.sum("sec").alias("sec"))
    day = day.withColumn("part", F.col("sec") / F.sum("sec").over(Window.partitionBy("series", "day"))).where("part >= 0.3")
    profile = day.groupBy("series", "day").agg(F.array_join(F.sort_array(F.collect_set("kind")), "+").alias("profile"))
    return profile.groupBy("profile").agg(F.count("*").alias("days"))


def cp8(spark, sf):
    held = _states(spark, sf).withColumn("side", F.when(F.col("start") < "2024-01-15", "before").otherwise("after"))
    return _rounded(models.standardised(held, ["series"], "kind", "side", "sec", "k"), "effect", "weight_s")


def cp9(spark, sf):
    rows = samples(spark, sf).withColumn("half", F.ntile(2).over(_own())).withColumn("slope", F.lead("raw").over(Window.partitionBy("series", "half").orderBy("ts")) - F.col("raw"))
    g = rows.groupBy("series").agg(F.sum(F.when(F.col("half") == 1, F.col("slope"))).alias("a"), F.sum(F.when(F.col("half") == 2, F.col("slope"))).alias("b"))
    return g.where("abs(a) > 0.001 and abs(b) > 0.001").select("series", (F.signum("a") == F.signum("b")).alias("stable"))


def cp12(spark, sf):
    found = ep.runs(_states(spark, sf), "series", ["kind"])
    return _rounded(found.groupBy("series").agg(F.max("sec").alias("longest_s"), F.max_by("kind", F.struct("sec", "kind")).alias("longest_kind")), "longest_s")


def cp13(spark, sf):
    rows = samples(spark, sf).where("kind = 'signup'").withColumn("left", iv.seconds(F.lag("ts").over(_own()), "ts")).withColumn("right", iv.seconds("ts", F.lead("ts").over(_own())))
    window = F.least("left", "right", F.lit(3.0 * DAY)) - DAY  # the first day after a change is left out
    return _rounded(rows.withColumn("window_s", window).where("left is not null and right is not null and window_s >= 21600").select("series", "seq", "window_s"), "window_s")


def sl3(spark, sf):
    hot = _states(spark, sf).groupBy("series", "kind").agg(F.count("*").alias("n"), F.sum("sec").alias("total_s"), F.max("sec").alias("longest_s"))
    return _rounded(hot.withColumn("rank", F.row_number().over(Window.partitionBy("series").orderBy(F.desc("longest_s"), "kind"))).where("rank <= 2"), "total_s", "longest_s")


def sl5(spark, sf):
    rows = samples(spark, sf).where("value is not null").withColumn("day", F.to_date("ts"))
    g = rows.groupBy("series", "day").agg(F.min_by("seq", F.struct("value", "ts")).alias("a"), F.max_by("seq", F.struct("value", "ts")).alias("b"))
    ends = rows.groupBy("series").agg(F.min_by("seq", "ts").alias("a"), F.max_by("seq", "ts").alias("b"))
    return g.select("series", F.explode(F.array("a", "b")).alias("seq")).union(ends.select("series", F.explode(F.array("a", "b")))).distinct()


def wf2(spark, sf):
    back = _own().rowsBetween(Window.unboundedPreceding, 0)
    return samples(spark, sf).select("series", "seq", F.last("value", ignorenulls=True).over(back).alias("filled"))


def wf6(spark, sf):
    return samples(spark, sf).where("raw >= 15").groupBy("series").agg(F.unix_micros(F.min("ts")).alias("first_us"))


def so1(spark, sf):
    h = _states(spark, sf)
    return h.select("series", F.unix_micros("start").alias("us")).union(h.select("series", F.unix_micros("end"))).distinct().groupBy("series").agg(F.count("*").alias("edges"))


QUERIES = {
    "EV1_band_episodes": (ev1, PIECES + ", e0 AS (SELECT *, value - target AS err, CASE WHEN value - target > 5 THEN 'above' WHEN value - target < -5 THEN 'below' END AS side FROM pieces), " + _runs_sql("e0", "side", "target")
        + """ SELECT series, side, epoch_us(min("start")) AS "start", epoch_us(max("end")) AS "end", round(max(abs(err)), 6) AS peak, max(abs(err)) > 10 AS warning FROM n1 WHERE side IS NOT NULL GROUP BY series, run, side"""),
    "EV2_cycle_context": (ev2, CYC + """ SELECT c.series, epoch_us(c."start") AS "start", CASE WHEN epoch_us(c."start") - epoch_us(t.ts) <= 172800000000 THEN 'after_control_change' WHEN sec < 43200 THEN 'short' ELSE 'normal' END AS context, round(sec, 6) AS sec
FROM cyc c ASOF LEFT JOIN (SELECT * FROM s WHERE kind = 'signup') t ON c.series = t.series AND c."start" >= t.ts"""),
    "EV5_strict_cycles": (ev5, CYC + f""" SELECT series, {US('start', 'end')}, round(sec, 6) AS sec FROM (SELECT *, lag("end") OVER w AS pe, lag(on_) OVER w AS po, lead("start") OVER w AS na, lead(on_) OVER w AS no FROM rn WINDOW w AS (PARTITION BY series ORDER BY "start")) WHERE on_ AND pe = "start" AND NOT po AND na = "end" AND NOT no"""),
    "EV6_hot_water": (ev6, HELD + ", hot AS (SELECT h.*, s.raw FROM held h JOIN s ON s.series = h.series AND s.ts = h.\"start\" WHERE h.kind = 'purchase'), " + _runs_sql("hot", "kind")
        + """ SELECT series, epoch_us(min("start")) AS "start", epoch_us(max("end")) AS "end", max(raw) AS peak, count(*) AS parts, CASE WHEN max(raw) >= 30 THEN 'probable service' WHEN count(*) > 1 THEN 'repeated' ELSE 'ordinary' END AS "class" FROM n1 GROUP BY series, run"""),
    "EV7_passive_drops": (ev7, S + """, x AS (SELECT *, raw - lead(raw) OVER w AS drp, (epoch_us(lead(ts) OVER w) - epoch_us(ts)) / 1e6 AS gap FROM s WINDOW w AS (PARTITION BY series ORDER BY ts)),
y AS (SELECT *, row_number() OVER (PARTITION BY series ORDER BY ts) AS n FROM x WHERE drp >= 5 AND gap <= 86400 AND drp * 3600 >= 0.5 * gap AND kind NOT IN ('click', 'purchase')) SELECT series, seq, n, round(drp, 6) AS "drop" FROM y WHERE n <= 5"""),
    "EV8_incidents": (ev8, S + """, b AS (SELECT *, sum(CASE WHEN kind = 'click' THEN 1 ELSE 0 END) OVER w AS busy, max(CASE WHEN kind = 'error' THEN ts END) OVER w AS err FROM s WINDOW w AS (PARTITION BY series ORDER BY ts, seq ROWS UNBOUNDED PRECEDING)),
x AS (SELECT *, lag(kind) OVER (PARTITION BY series ORDER BY ts, seq) AS was FROM b WHERE kind IN ('purchase', 'signup')), y AS (SELECT *, lead(ts) OVER w AS nxt, lead(busy) OVER w AS nb FROM x WHERE was IS DISTINCT FROM kind WINDOW w AS (PARTITION BY series ORDER BY ts, seq))
SELECT series, epoch_us(ts) AS "start", epoch_us(nxt) AS "end", CASE WHEN epoch_us(ts) - epoch_us(err) <= 86400000000 THEN 'power' ELSE 'unknown' END AS cause, CASE WHEN nxt IS NULL THEN 'open' WHEN nb > busy THEN 'running' ELSE 'none' END AS impact FROM y WHERE kind = 'purchase'"""),
    "EV9_connection_state": (ev9, S + """, g AS (SELECT series, max(CASE WHEN kind = 'purchase' THEN ts END) AS l, max(CASE WHEN kind = 'signup' THEN ts END) AS r, max(CASE WHEN kind IN ('click', 'view') THEN ts END) AS seen FROM s GROUP BY series)
SELECT series, CASE WHEN l IS NOT NULL AND (r IS NULL OR r < l) THEN CASE WHEN l <= TIMESTAMP '2024-01-30 22:00:00' THEN 'lost' ELSE 'pending' END WHEN r IS NOT NULL AND (seen IS NULL OR seen <= r) THEN 'awaiting telemetry' ELSE 'connected' END AS state FROM g"""),
    "EV11_availability": (ev11, HELD + ", o AS (SELECT *, coalesce(kind = 'signup' OR (CAST(trunc(k) AS INT) & 1) = 1, false) AS off_ FROM held), " + _runs_sql("o", "off_") + " SELECT series, count(*) FILTER (off_) AS windows, round(100 * sum(CASE WHEN off_ THEN sec ELSE 0 END) / sum(sec), 6) AS inactive_pct FROM rn GROUP BY series"),
    "EV12_abrupt_falls": (ev12, S + """, x AS (SELECT series, ts AS "start", lead(ts, 2) OVER w AS "end", value AS a, lead(value) OVER w AS b, lead(value, 2) OVER w AS c FROM s WHERE value IS NOT NULL WINDOW w AS (PARTITION BY series ORDER BY ts)),
src AS (SELECT series, "start", "end" FROM x WHERE a > b AND b > c AND a - c >= 5 AND (a - c) * 3600 >= 0.2 * ((epoch_us("end") - epoch_us("start")) / 1e6)), """ + _merge_sql("src", 0)),
    "EV13_recovery_states": (ev13, S + """, x AS (SELECT *, kind IN ('purchase', 'error') AS trg, CASE WHEN kind NOT IN ('purchase', 'error') AND abs(raw - lag(raw) OVER w) <= 10 THEN 1 ELSE 0 END AS calm FROM s WINDOW w AS (PARTITION BY series ORDER BY ts)),
y AS (SELECT *, CASE WHEN trg THEN true WHEN sum(calm) OVER (PARTITION BY series ORDER BY ts ROWS 2 PRECEDING) = 3 THEN false END AS mark FROM x) SELECT series, seq, coalesce(last_value(mark IGNORE NULLS) OVER (PARTITION BY series ORDER BY ts ROWS UNBOUNDED PRECEDING), false) AS recovering FROM y"""),
    "EV15_request_cycles": (ev15, CYC + """ SELECT series, epoch_us("start") AS "start", round(sec, 6) AS on_s, round(s1, 6) AS pause_s, round(s2, 6) AS next_s FROM (SELECT *, lead(sec) OVER w AS s1, lead(sec, 2) OVER w AS s2, lead("start") OVER w AS a1, lead("end") OVER w AS b1, lead("start", 2) OVER w AS a2, lead("end", 2) OVER w AS b2, lead("start", 3) OVER w AS a3 FROM rn WINDOW w AS (PARTITION BY series ORDER BY "start")) WHERE on_ AND a1 = "end" AND a2 = b1 AND a3 = b2"""),
    "EV16_bounded_edges": (ev16, S + """ SELECT series, seq, on_, CAST(floor(epoch_us(before) / 60000000) AS BIGINT) AS after_minute, CAST(ceil(epoch_us(ts) / 60000000) AS BIGINT) AS by_minute FROM (SELECT *, kind IN ('click', 'view') AS on_, lag(kind IN ('click', 'view')) OVER w AS was, lag(ts) OVER w AS before FROM s WINDOW w AS (PARTITION BY series ORDER BY ts)) WHERE was <> on_"""),
    "EV17_reached": (ev17, S + """, x AS (SELECT series, epoch_us(ts) AS t1, value AS v1, epoch_us(lag(ts) OVER w) AS t0, lag(value) OVER w AS v0 FROM s WHERE value IS NOT NULL WINDOW w AS (PARTITION BY series ORDER BY ts)) SELECT series, round(min((t0 + (20.0 - v0) / (v1 - v0) * (t1 - t0)) / 1e6), 2) AS reached_s, count(*) AS crossings FROM x WHERE v0 < 20 AND v1 >= 20 GROUP BY series"""),
    "EV22_attribution": (ev22, PIECES + ", " + HELD[len(S) + 2:] + """, a AS (SELECT series, sum(CASE WHEN value - target > 5 THEN sec ELSE 0 END) AS above_s FROM pieces GROUP BY 1), d AS (SELECT series, 100 * sum(CASE WHEN kind IN ('click', 'purchase') THEN sec ELSE 0 END) / sum(sec) AS duty_pct FROM held GROUP BY 1)
SELECT series, round(above_s, 6) AS above_s, round(duty_pct, 6) AS duty_pct, CASE WHEN above_s > 0 AND duty_pct < 25 THEN 'not heating' WHEN above_s > 0 THEN 'heating possible' ELSE 'none' END AS attribution FROM a JOIN d USING (series)"""),
    "EV23_recommendations": (ev23, CYC + """, m AS (SELECT *, row_number() OVER (PARTITION BY series, sec < 43200 ORDER BY "start") AS n FROM cyc), g AS (SELECT series, 100.0 * count(*) FILTER (sec < 43200) / count(*) AS short_pct, string_agg(CAST(epoch_us("start") AS VARCHAR), ',' ORDER BY "start") FILTER (sec < 43200 AND n <= 10) AS evidence FROM m GROUP BY 1)
SELECT series, round(short_pct, 6) AS short_pct, evidence, 'observe' AS advice FROM g WHERE short_pct >= 30"""),
    "GS4_mean_rate": (gs4, READ + ", g AS (SELECT l_suppkey, sum(volume) AS v, sum(24.0 * (en - st)) AS h, count(*) AS support FROM diff GROUP BY 1) SELECT l_suppkey, support, CASE WHEN support >= 5 THEN round(least(greatest(v / h, 0.02), 0.5), 6) END AS rate, CASE WHEN support < 5 THEN 'few readings' ELSE 'usable' END AS reason FROM g"),
    "GS9_two_term_fit": (gs9, """WITH r AS (SELECT l_suppkey, l_shipdate, CAST(sum(l_extendedprice) AS DOUBLE) AS y, CAST(sum(l_quantity) AS DOUBLE) AS a, CAST(count(*) AS DOUBLE) AS b FROM lineitem GROUP BY 1, 2), g AS (SELECT l_suppkey, sum(a * a) AS aa, sum(a * b) AS ab, sum(b * b) AS bb, sum(a * y) AS ay, sum(b * y) AS yb FROM r GROUP BY 1),
f AS (SELECT *, aa * bb - ab * ab > 1e-9 * aa * bb AS ok, (bb * ay - ab * yb) / (aa * bb - ab * ab) AS u0, (aa * yb - ab * ay) / (aa * bb - ab * ab) AS v0 FROM g)
SELECT l_suppkey, round(CASE WHEN ok AND u0 >= 0 AND v0 >= 0 THEN u0 WHEN greatest(ay, 0) ** 2 / aa >= greatest(yb, 0) ** 2 / bb THEN greatest(ay / aa, 0) ELSE 0 END, 3) AS u, round(CASE WHEN ok AND u0 >= 0 AND v0 >= 0 THEN v0 WHEN greatest(ay, 0) ** 2 / aa >= greatest(yb, 0) ** 2 / bb THEN 0 ELSE greatest(yb / bb, 0) END, 3) AS v FROM f"""),
    "GS13_reconciled_months": (gs13, "WITH r AS (SELECT l_suppkey, strftime(l_shipdate, '%Y-%m') AS month, CAST(sum(l_extendedprice) AS DOUBLE) AS w, CAST(sum(l_quantity) AS DOUBLE) AS q FROM lineitem GROUP BY 1, 2) SELECT l_suppkey, month, round(w * sum(q) OVER (PARTITION BY l_suppkey) / sum(w) OVER (PARTITION BY l_suppkey), 6) AS slice FROM r"),
    "GS15_reading_chains": (gs15, READ + """, m AS (SELECT *, CASE WHEN st = lag(en) OVER w THEN 0 ELSE 1 END AS nw FROM diff WINDOW w AS (PARTITION BY l_suppkey, l_returnflag ORDER BY st)), n AS (SELECT *, sum(nw) OVER (PARTITION BY l_suppkey, l_returnflag ORDER BY st) AS c FROM m)
SELECT l_suppkey, l_returnflag, strftime(min(st), '%Y-%m-%d') AS "start", strftime(max(en), '%Y-%m-%d') AS "end", round(sum(volume), 6) AS volume, count(*) AS readings FROM n GROUP BY 1, 2, c"""),
    "GS16_implausible_readings": (gs16, READ + """ SELECT l_suppkey, l_returnflag, strftime(st, '%Y-%m-%d') AS "start", strftime(en, '%Y-%m-%d') AS "end", round(volume, 6) AS volume FROM diff WHERE volume > 3 * (en - st)"""),
    "GS17_summary": (gs17, READ + " SELECT l_returnflag, round(sum(volume), 6) AS volume, count(*) FILTER (volume > 3 * (en - st)) AS flagged, count(*) AS parts FROM diff GROUP BY 1"),
    "CP4_day_profiles": (cp4, DAYS + ", x AS (SELECT series, day, kind, sum(sec) AS sec FROM d WHERE sec > 0 GROUP BY 1, 2, 3), y AS (SELECT *, sec / sum(sec) OVER (PARTITION BY series, day) AS part FROM x), z AS (SELECT series, day, string_agg(kind, '+' ORDER BY kind) AS profile FROM y WHERE part >= 0.3 GROUP BY 1, 2) SELECT profile, count(*) AS days FROM z GROUP BY 1"),
    "CP8_standardised": (cp8, HELD + """, x AS (SELECT series, kind, sum(sec) FILTER ("start" < TIMESTAMP '2024-01-15') AS bs, sum(sec * k) FILTER ("start" < TIMESTAMP '2024-01-15') AS bv, sum(sec) FILTER ("start" >= TIMESTAMP '2024-01-15') AS xs, sum(sec * k) FILTER ("start" >= TIMESTAMP '2024-01-15') AS xv FROM held GROUP BY 1, 2)
SELECT series, round(sum((xv / xs - bv / bs) * least(bs, xs)) / sum(least(bs, xs)), 6) AS effect, round(sum(least(bs, xs)), 6) AS weight_s, count(*) AS strata FROM x WHERE bs > 0 AND xs > 0 GROUP BY 1"""),
    "CP9_split_half": (cp9, S + ", x AS (SELECT *, ntile(2) OVER (PARTITION BY series ORDER BY ts) AS half FROM s), y AS (SELECT series, half, arg_max(raw, ts) - arg_min(raw, ts) AS d FROM x GROUP BY 1, 2), z AS (SELECT series, max(d) FILTER (half = 1) AS a, max(d) FILTER (half = 2) AS b FROM y GROUP BY 1) SELECT series, sign(a) = sign(b) AS stable FROM z WHERE abs(a) > 0.001 AND abs(b) > 0.001"),
    "CP12_longest_run": (cp12, HELD + ", " + _runs_sql("held", "kind") + " SELECT series, round(max(sec), 6) AS longest_s, arg_max(kind, struct_pack(a := sec, b := kind)) AS longest_kind FROM rn GROUP BY series"),
    "CP13_change_windows": (cp13, S + ", x AS (SELECT *, (epoch_us(ts) - epoch_us(lag(ts) OVER w)) / 1e6 AS l, (epoch_us(lead(ts) OVER w) - epoch_us(ts)) / 1e6 AS r FROM s WHERE kind = 'signup' WINDOW w AS (PARTITION BY series ORDER BY ts)) SELECT series, seq, round(least(l, r, 259200.0) - 86400, 6) AS window_s FROM x WHERE l IS NOT NULL AND r IS NOT NULL AND least(l, r, 259200.0) - 86400 >= 21600"),
    "SL3_ranking": (sl3, HELD + ", g AS (SELECT series, kind, count(*) AS n, sum(sec) AS t, max(sec) AS m FROM held GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY series ORDER BY m DESC, kind) AS rank FROM g) SELECT series, kind, n, round(t, 6) AS total_s, round(m, 6) AS longest_s, rank FROM r WHERE rank <= 2"),
    "SL5_extrema": (sl5, S + ", v AS (SELECT * FROM s WHERE value IS NOT NULL), r AS (SELECT series, seq, row_number() OVER (PARTITION BY series, date_trunc('day', ts) ORDER BY value, ts) AS a, row_number() OVER (PARTITION BY series, date_trunc('day', ts) ORDER BY value DESC, ts DESC) AS b, row_number() OVER (PARTITION BY series ORDER BY ts) AS c, row_number() OVER (PARTITION BY series ORDER BY ts DESC) AS d FROM v) SELECT series, seq FROM r WHERE 1 IN (a, b, c, d)"),
    "WF2_forward_fill": (wf2, S + " SELECT series, seq, last_value(value IGNORE NULLS) OVER (PARTITION BY series ORDER BY ts ROWS UNBOUNDED PRECEDING) AS filled FROM s"),
    "WF6_first_reach": (wf6, S + " SELECT series, epoch_us(min(ts)) AS first_us FROM s WHERE raw >= 15 GROUP BY 1"),
    "SO1_edges": (so1, HELD + """ SELECT series, count(*) AS edges FROM (SELECT series, "start" AS e FROM held UNION SELECT series, "end" FROM held) GROUP BY 1"""),
}
