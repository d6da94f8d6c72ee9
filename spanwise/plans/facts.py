"""Interval, statistic, period and run queries over the given tables, in the roles
of ``telemetry``. Windows are days; caps are hours, as samples are."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from spanwise.operators import calendar, intervals as iv, joins, metrics, signals as sg
from spanwise.plans.ingest import CAT, catalogue
from spanwise.plans.telemetry import DAYS, HELD, PIECES, S, SEG, _rounded, _segments, _span, _states, samples
from spanwise.session import load

END = "2024-02-01"
_t = lambda text: F.lit(text).cast("timestamp")
_day = lambda c="day": F.date_format(c, "yyyy-MM-dd").alias("day")
_sec = lambda a='"start"', b='"end"': f"(epoch_us({b}) - epoch_us({a})) / 1e6"
_US = 'epoch_us("start") AS "start", epoch_us("end") AS "end"'
MED = S + ", nx AS (SELECT *, lead(ts) OVER (PARTITION BY series ORDER BY ts) AS nxt FROM s), md AS (SELECT series, median(nullif((epoch_us(nxt) - epoch_us(ts)) / 1e6, 0)) AS m FROM nx GROUP BY 1)"
VAL = S + f""", v0 AS (SELECT series, ts, value, coalesce(lead(ts) OVER (PARTITION BY series ORDER BY ts), TIMESTAMP '{END}') AS nxt FROM s), v1 AS (SELECT *, lead(ts) OVER (PARTITION BY series ORDER BY ts) AS nk FROM v0 WHERE value IS NOT NULL),
vm AS (SELECT series, greatest(60.0, 3 * median(nullif((epoch_us(nk) - epoch_us(ts)) / 1e6, 0))) AS cap FROM v1 GROUP BY 1),
val AS (SELECT series, ts AS "start", least(nxt, make_timestamp(epoch_us(ts) + CAST(round(coalesce(cap, 0) * 1000000) AS BIGINT))) AS "end", value FROM v1 JOIN vm USING (series)),
tgt AS (SELECT series, ts AS "start", coalesce(lead(ts) OVER (PARTITION BY series ORDER BY ts), TIMESTAMP '{END}') AS "end", raw AS target FROM s WHERE kind = 'signup'),
both_ AS (SELECT a.series, greatest(a."start", b."start") AS "start", least(a."end", b."end") AS "end", a.value, b.target FROM val a JOIN tgt b ON a.series = b.series AND a."start" < b."end" AND a."end" > b."start")"""
_cut = lambda source: f"""dd AS (SELECT * EXCLUDE ("start", "end", g), CAST(g AS DATE) AS day, greatest("start", g) AS "start", least("end", g + INTERVAL 1 DAY) AS "end", (epoch_us(least("end", g + INTERVAL 1 DAY)) - epoch_us(greatest("start", g))) / 1e6 AS sec
FROM {source}, unnest(generate_series(date_trunc('day', "start"), "end" - INTERVAL 1 MICROSECOND, INTERVAL 1 DAY)) AS u(g))"""  # noqa: E731
_stat_sql = lambda keys, v, whole: f"""q AS (SELECT *, sum(sec) OVER (PARTITION BY {keys} ORDER BY {v}, sec, "start" ROWS UNBOUNDED PRECEDING) AS c, sum(sec) OVER (PARTITION BY {keys}) AS t FROM dd),
st AS (SELECT {keys}, sum({v} * sec) / sum(sec) AS mean, min({v}) AS minimum, max({v}) AS maximum, min({v}) FILTER (c >= 0.5 * t) AS median, min({v}) FILTER (c >= 0.9 * t) AS p90, arg_min({v}, "start") AS first, arg_max({v}, "start") AS last, 100 * sum(sec) / {whole} AS coverage_pct FROM q GROUP BY ALL)"""  # noqa: E731
_STATS = ("mean", "minimum", "maximum", "median", "p90", "first", "last", "change", "slope_per_hour", "coverage_pct")
_stat_cols = ", ".join(f"round({c}, 4) AS {c}" for c in _STATS[:7]) + ", round(last - first, 4) AS change, round((last - first) / 24.0, 6) AS slope_per_hour, round(coverage_pct, 4) AS coverage_pct"


def _four(df):
    return df.withColumns({c: F.round(c, 6 if c == "slope_per_hour" else 4) for c in _STATS})


def _values(spark, sf):
    return sg.pieces(samples(spark, sf), "series", "ts", "value", _t(END))


def _targets(spark, sf):
    return sg.pieces(samples(spark, sf).where("kind = 'signup'").select("series", "ts", F.col("raw").alias("target")), "series", "ts", "target", _t(END), ttl=False)


def _pair(spark, sf):
    return sg.align("series", value=_values(spark, sf), target=_targets(spark, sf))


def iv2(spark, sf):
    return _span(sg.capped_states(samples(spark, sf), "series", "ts", _t("2024-01-05"), _t("2024-01-20"), 300.0).select("series", "start", "end", "kind"))


def iv3(spark, sf):
    return _span(sg.capped_states(samples(spark, sf), "series", "ts", _t("2024-01-05"), _t("2024-01-20"), 60.0, 30 * 3600.0).select("series", "start", "end", "kind"))


def iv5(spark, sf):
    own = Window.partitionBy("series").orderBy("ts")
    rows = samples(spark, sf).withColumn("next", F.lead("ts").over(own)).withColumn("then", F.lead("value").over(own)).withColumn("next_k", F.lead("k").over(own))
    fit = rows.where("value is not null and then is not null").where(iv.seconds("ts", "next") <= 43_200)
    span = lambda df, kind, a, b, left, right: df.select("series", F.lit(kind).alias("span"), F.col(a).alias("start") if isinstance(a, str) else a.alias("start"), F.col(b).alias("end"), left.alias("left"), right.alias("right"))
    linear = span(fit, "linear", "ts", "next", F.col("value"), F.col("then"))
    level = span(fit, "categorical", "ts", "next", F.col("value"), F.col("value"))
    t = _targets(spark, sf)
    held = span(t, "held", "start", "end", F.col("target"), F.col("target"))
    before = span(rows.where("k between 0 and 60"), "preceding", sg.later("ts", F.lit(-60.0)), "ts", F.col("k") / 60, F.col("k") / 60)
    return _rounded(_span(linear.unionByName(level).unionByName(held).unionByName(before)), "left", "right")


def _of(spark, sf, kind):
    return _states(spark, sf).where(F.col("kind") == kind).select("series", "start", "end")


def iv9(spark, sf):
    s = samples(spark, sf)
    down = iv.loss_restore(s, "series", "ts", "kind", "purchase", "signup", "seq").withColumn("end", F.coalesce("end", _t(END)))
    met = iv.overlaps(down, _of(spark, sf, "click"), "series")
    return met.groupBy("series").agg(F.round(F.sum(iv.seconds(F.greatest("start", "r_start"), F.least("end", "r_end"))), 6).alias("overlap_s"))


def iv11(spark, sf):
    bit = samples(spark, sf).withColumn("powered", F.col("k").cast("int").bitwiseAND(1) == 1)
    own = Window.partitionBy("series").orderBy("ts")
    off = iv.transitions(bit, "series", "ts", "powered").withColumn("end", F.coalesce(F.lead("ts").over(own), _t(END))).where("not powered").select("series", F.col("ts").alias("start"), "end")
    return _span(iv.merge(off.union(_of(spark, sf, "error")), "series", 120.0))


def iv13(spark, sf):
    own = Window.partitionBy("series").orderBy("ts")
    rows = samples(spark, sf).where("ts >= '2024-01-03'").select("series", "ts").distinct()
    rows = rows.withColumn("one", F.lead("ts").over(own)).withColumn("two", F.lead("ts", 2).over(own))
    return rows.where((iv.seconds("ts", "one") <= 21_600) & (iv.seconds("one", "two") <= 21_600)).groupBy("series").agg(F.unix_micros(F.min("ts")).alias("first_us"))


def iv14(spark, sf):
    """Holes in the coverage of January; those before the horizon are lost."""
    first, last, horizon = _t("2024-01-01"), _t(END), _t("2024-01-10")
    whole = samples(spark, sf).select("series").distinct().select("series", first.alias("start"), last.alias("end"))
    covered = _states(spark, sf).where("kind <> 'error'").select("series", "start", "end")
    holes = iv.subtract(whole, covered, "series")
    parts = F.explode(F.array(F.struct(F.col("start").alias("start"), F.least("end", horizon).alias("end"), F.lit("unavailable").alias("action")), F.struct(F.greatest("start", horizon).alias("start"), F.col("end").alias("end"), F.lit("fetch").alias("action"))))
    return _span(holes.select("series", parts.alias("p")).select("series", "p.*").where("start < end"))


def iv15(spark, sf):
    """Each heating interval without its excluded pieces, keeping its identity."""
    a = _states(spark, sf).where("kind in ('click', 'view')").select(F.concat_ws(":", "series", F.unix_micros("start").cast("string")).alias("id"), "series", "start", "end")
    cut = iv.overlaps(a, _day_windows(spark, sf), "series").select("id", F.greatest("start", "r_start").alias("start"), F.least("end", "r_end").alias("end"))
    return _span(iv.subtract(a.select("id", "start", "end"), cut, "id"))


def _day_windows(spark, sf):
    """Ignored windows: the noon hours of days with a purchase."""
    days = samples(spark, sf).where("kind = 'purchase'").select("series", F.date_trunc("day", "ts").alias("d")).distinct()
    return days.select("series", (F.col("d") + F.expr("interval 9 hours")).alias("start"), (F.col("d") + F.expr("interval 15 hours")).alias("end"))


WIN = ", win AS (SELECT DISTINCT series, date_trunc('day', ts) + INTERVAL 9 HOUR AS a, date_trunc('day', ts) + INTERVAL 15 HOUR AS b FROM s WHERE kind = 'purchase')"


def iv19(spark, sf):
    days = load(spark, sf, "orders").select(F.to_date("o_orderdate").alias("d")).distinct()
    week, month = calendar.period_of("weekly", F.col("d")), calendar.period_of("monthly", F.col("d"))
    s = calendar.season_of(F.col("d"))
    text = lambda c: F.date_format(c, "yyyy-MM-dd")
    return days.select(text("d").alias("day"), text(week[0]).alias("week"), text(month[1]).alias("next_month"), s["season"].alias("season"), s["year"].alias("year"), text(s["first"]).alias("season_first"), text(s["after"]).alias("season_after"))


def iv20(spark, sf):
    g = load(spark, sf, "orders").groupBy("o_custkey").agg(F.to_date(F.min("o_orderdate")).alias("first_day"), F.to_date(F.max("o_orderdate")).alias("today"))
    g = g.where("first_day < today").withColumn("cut", F.trunc("today", "week"))
    rows = calendar.scheduled(g, "first_day", "today", "cut", ["o_custkey"], latest=3)
    rank = F.row_number().over(Window.partitionBy("o_custkey", "kind").orderBy(F.desc("first")))
    return rows.withColumn("n", rank).where("n <= 3").select("o_custkey", "kind", "n", F.date_format("first", "yyyy-MM-dd").alias("first"), F.date_format("after", "yyyy-MM-dd").alias("after"))


def iv21(spark, sf):
    """Within 20 minutes of 08:00 or 22:00 on a weekday of the mask."""
    local = F.unix_seconds("ts") % 86_400
    bit = F.expr("shiftleft(1, weekday(ts))").bitwiseAND(31) > 0
    near = (F.abs(local - 8 * 3600) <= 1_200) | (F.abs(local - 22 * 3600) <= 1_200)
    return samples(spark, sf).where(bit & near).select("series", "seq")


def ag4(spark, sf):
    cut = iv.by_day(_values(spark, sf), "series")
    stat = _four(sg.statistic(cut, ["series", "day"], "value", 86_400.0))
    s = samples(spark, sf).where("value is not null")
    n = s.groupBy("series", F.to_date("ts").alias("day")).agg(F.count("*").alias("samples"), F.round((86_400e6 - F.unix_micros(F.max("ts")) % 86_400_000_000) / 1e6, 2).alias("stale_s"))
    return stat.join(n, ["series", "day"], "left").withColumn("samples", F.coalesce("samples", F.lit(0))).withColumn("day", F.date_format("day", "yyyy-MM-dd"))


def ag5(spark, sf):
    cut = iv.by_day(_pair(spark, sf).withColumn("error", F.col("value") - F.col("target")).drop("value", "target"), "series")
    return _four(sg.statistic(cut, ["series", "day"], "error", 86_400.0)).withColumn("day", F.date_format("day", "yyyy-MM-dd"))


def ag9(spark, sf):
    """Values while a click state holds."""
    met = iv.overlaps(_values(spark, sf), _of(spark, sf, "click"), "series")
    part = met.select("series", F.greatest("start", "r_start").alias("start"), F.least("end", "r_end").alias("end"), "value")
    return _four(sg.statistic(part.withColumn("sec", iv.seconds("start", "end")), ["series"], "value", 2_592_000.0)).drop("slope_per_hour")


def ag11(spark, sf):
    rows = _pair(spark, sf).withColumn("sec", iv.seconds("start", "end")).withColumn("deficit", F.col("target") - F.col("value"))
    below = F.col("deficit") > 2
    return rows.groupBy("series").agg(F.round(F.sum("sec"), 6).alias("evaluated_s"), F.round(F.sum(F.when(below, F.col("sec")).otherwise(0.0)), 6).alias("below_s"), F.round(F.sum(F.when(below, F.col("deficit") * F.col("sec")).otherwise(0.0)) / 3600, 6).alias("degree_hours"))


def ag16(spark, sf):
    rows = _states(spark, sf).where("kind <> 'error'")
    h = lambda ok: F.coalesce(F.sum(F.when(ok, F.col("sec"))), F.lit(0.0)) / 3600
    g = rows.groupBy("series").agg(h(F.col("kind").isin("click", "purchase")).alias("flame"), h(F.lit(True)).alias("observed"), h(F.col("kind") == "click").alias("heating"), h(F.col("kind") == "purchase").alias("dhw"))
    pct = lambda a, b: F.round(F.try_divide(100 * a, b), 6)
    return g.select("series", pct(F.col("flame"), F.lit(744.0)).alias("flame_pct"), F.round(F.greatest(F.lit(0.0), 744 - F.col("observed")), 6).alias("unobserved_hours"), pct(F.col("heating"), F.col("flame")).alias("heating_pct"), pct(F.col("dhw"), F.col("flame")).alias("dhw_pct"))


def ag17(spark, sf):
    own = Window.partitionBy("series").orderBy("ts")
    rows = samples(spark, sf).withColumn("right", F.lead("value").over(own) - 20).withColumn("sec", iv.seconds("ts", F.lead("ts").over(own))).withColumn("left", F.col("value") - 20)
    rows = rows.where("left is not null and right is not null and sec > 0 and sec <= 43200")
    out = rows.groupBy("series").agg(*sg.span_sums(F.col("left"), F.col("right"), F.col("sec")))
    return _rounded(out, *[c for c in out.columns if c != "series"]).withColumns({c: F.round(c, 2) for c in ("integral", "positive_integral", "negative_integral", "max_rate_per_hour")})


def ag18(spark, sf):
    rows = _states(spark, sf).withColumn("request", F.col("kind").isin("click", "view", "purchase"))
    return _rounded(_span(sg.merged_runs(rows, "series", ["request"], "k")), "variation")


def ag20(spark, sf):
    own = Window.partitionBy("series").orderBy("ts")
    rows = samples(spark, sf).where("ts >= '2024-01-05' and ts <= '2024-01-25'")
    known = rows.where("value is not null").withColumn("gap", iv.seconds("ts", F.lead("ts").over(own)))
    g = known.groupBy("series").agg(F.count("*").alias("n"), F.min("gap").alias("least_s"), F.max("gap").alias("most_s"), F.median("gap").alias("median_s"))
    unknown = rows.where("value is null").groupBy("series").agg(F.count("*").alias("unknown"))
    return _rounded(g.join(unknown, "series", "left").withColumn("unknown", F.coalesce("unknown", F.lit(0))), "least_s", "most_s", "median_s")


def _facts(spark, sf):
    """Day facts as they arrive: some twice alike, some twice and unlike."""
    d = samples(spark, sf).groupBy("series", F.to_date("ts").alias("day")).agg(F.count("value").alias("n"), F.min("value").alias("low"), F.max("value").alias("high"), F.sum("value").alias("total"))
    more = d.where("pmod(series + dayofmonth(day), 5) = 0").withColumn("n", F.col("n") + F.when(F.col("series") % 4 == 0, 1).otherwise(0))
    return d.union(more)


def ag21(spark, sf):
    g = _facts(spark, sf).groupBy("series", "day").agg(F.count_distinct("n", "low", "high").alias("forms"), F.max("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high"))
    out = g.groupBy("series").agg(F.count("*").alias("days"), F.count_if(F.col("forms") > 1).alias("conflicts"), F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high"), (F.datediff(F.max("day"), F.min("day")) + 1 > F.count("*")).alias("incomplete"))
    return out


def ag22(spark, sf):
    """Weeks from days: sums of counts, means weighted by coverage, daily median
    and extremes, worst severity, longest run of missing days."""
    s = samples(spark, sf).withColumn("severity", F.when(F.col("kind") == "error", 2).when(F.col("kind") == "purchase", 1).otherwise(0))
    d = s.groupBy("series", F.to_date("ts").alias("day")).agg(F.count("value").alias("n"), F.avg("value").alias("mean"), F.max("severity").alias("severity")).withColumn("week", F.trunc("day", "week"))
    own = Window.partitionBy("series", "week").orderBy("day")
    d = d.withColumn("hole", F.datediff("day", F.coalesce(F.lag("day").over(own), F.date_sub("week", 1))) - 1).withColumn("tail", F.datediff(F.date_add("week", 7), "day") - 1)
    g = d.groupBy("series", "week").agg(F.count("*").alias("days"), F.sum("n").alias("n"), F.round(F.try_divide(F.sum(F.col("mean") * F.col("n")), F.sum("n")), 6).alias("mean"), F.round(F.median("mean"), 6).alias("daily_median"),
        F.round(F.min("mean"), 6).alias("daily_low"), F.round(F.max("mean"), 6).alias("daily_high"), F.max("severity").alias("severity"), F.greatest(F.max("hole"), F.min("tail")).alias("longest_missing_days"))
    return g.withColumn("week", F.date_format("week", "yyyy-MM-dd"))


def ag25(spark, sf):
    g = samples(spark, sf).where("value is not null").groupBy("series", "kind").agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean"), F.round(F.median("value"), 6).alias("median"), F.min("value").alias("low"), F.max("value").alias("high"), F.round(F.max("value") - F.min("value"), 6).alias("range")).where("n >= 2")
    return g.withColumn("groups", F.count("*").over(Window.partitionBy("series"))).where("groups >= 2")


def ag29(spark, sf):
    """An order-free print of the rows of every 14-day window that begins on a
    Monday: each row is hashed once and added to the two windows that hold it."""
    row = F.md5(F.concat_ws("|", F.col("series").cast("string"), F.col("seq").cast("string"), F.unix_micros("ts").cast("string"), "kind"))
    h = F.conv(F.substring(row, 1, 8), 16, 10).cast("long")
    week = F.trunc("ts", "week")
    rows = samples(spark, sf).select("series", h.alias("h"), F.explode(F.array(week, F.date_sub(week, 7))).alias("day"))
    return rows.groupBy("series", "day").agg(F.count("*").alias("n"), F.sum("h").alias("print")).select("series", _day(), "n", "print")


def ag30(spark, sf):
    o = load(spark, sf, "orders")
    stale = (F.col("o_orderstatus") == "O") & (F.col("o_orderdate") <= F.lit("2000-01-01").cast("timestamp"))
    return o.groupBy("o_orderstatus").agg(F.count("*").alias("n"), F.count_if(stale).alias("stale"))


def ag31(spark, sf):
    calls = load(spark, sf, "events").where("event_type <> 'error' and ts >= '2024-01-05' and ts < '2024-01-20'")
    tokens = F.get_json_object("props", "$.k").cast("decimal(18,0)")
    return calls.groupBy("event_type").agg(F.sum(tokens).cast("long").alias("tokens"), F.sum(F.round(F.col("value").cast("decimal(18,6)") / 1000, 9)).cast("decimal(30,9)").cast("string").alias("cost"))


def ag32(spark, sf):
    rows = _pair(spark, sf).withColumn("sec", iv.seconds("start", "end"))
    return _rounded(rows.groupBy("series").agg((F.sum(F.col("value") * F.col("sec")) / F.sum("sec")).alias("room"), (F.sum(F.col("target") * F.col("sec")) / F.sum("sec")).alias("target"), (100 * F.sum("sec") / 2_678_400.0).alias("coverage_pct")), "room", "target", "coverage_pct")


def jn5(spark, sf):
    """The tariff in force at the start of each month's slice."""
    o = load(spark, sf, "orders").select("o_orderpriority", F.date_trunc("month", "o_orderdate").alias("ts"), "o_totalprice")
    tariffs = o.where("month(ts) % 3 = 1").groupBy("o_orderpriority", "ts").agg(F.round(F.avg("o_totalprice") / 1000, 4).alias("price"))
    slices = o.select("o_orderpriority", "ts").distinct()
    return joins.as_of(slices, tariffs, "o_orderpriority", "ts", "price").select("o_orderpriority", F.date_format("ts", "yyyy-MM").alias("month"), "price", F.date_format("value_ts", "yyyy-MM").alias("since"))


def jn9(spark, sf):
    return _span(_pair(spark, sf))


def jn10(spark, sf):
    three = sg.align("series", value=_values(spark, sf), target=_targets(spark, sf), level=_states(spark, sf).where("kind <> 'error'").select("series", "start", "end", "k"))
    return _span(three)


def jn11(spark, sf):
    sup = load(spark, sf, "supplier")
    links = sup.where("s_suppkey % 3 = 0").select(F.col("s_suppkey").alias("circuit"), F.col("s_suppkey").alias("sensor"), F.lit(1.0).alias("confidence")).union(sup.select("s_suppkey", F.col("s_nationkey").cast("long"), F.lit(0.9)))
    best = F.row_number().over(Window.partitionBy("circuit").orderBy(F.desc("confidence"), "sensor"))
    return links.withColumn("n", best).where("n = 1").drop("n")


def jn12(spark, sf):
    s = samples(spark, sf).select("series").distinct().join(catalogue(spark, sf), "series")
    return s.groupBy("device").agg(F.when(F.count("*") == 1, F.min("series")).alias("control"), F.count("*").alias("candidates"))


def jn14(spark, sf):
    """Changes of a target with exactly one click in (the row before, the change]."""
    own = Window.partitionBy("series").orderBy("ts")
    t = samples(spark, sf).where("kind = 'signup'").withColumn("after", F.lag("ts").over(own)).where("after is not null")
    step = lambda c: sg.later(c, F.lit(1e-6))
    change = t.select("series", "seq", step("after").alias("start"), step("ts").alias("end"))
    notes = samples(spark, sf).where("kind = 'click'").select("series", F.col("ts").alias("start"), step("ts").alias("end"), F.col("seq").alias("note"))
    met = iv.overlaps(change, notes, "series").groupBy("series", "seq").agg(F.count("*").alias("n"), F.min("r_note").alias("note"))
    return met.where("n = 1").drop("n")


def _weeks(spark, sf):
    return samples(spark, sf).groupBy("series", F.trunc("ts", "week").alias("week")).agg(F.avg("value").alias("mean"), F.avg("k").alias("load"), F.count("*").alias("n"))


def jn15(spark, sf):
    """The nearest earlier week of a series, at most four back, that compares."""
    w = _weeks(spark, sf)
    back = w.select("series", F.explode(F.transform(F.sequence(F.lit(1), F.lit(4)), lambda i: F.date_add(F.col("week"), (7 * i).cast("int")))).alias("week"), F.col("week").alias("base"), F.col("mean").alias("m"), F.col("load").alias("l"))
    met = w.join(back, ["series", "week"]).where("abs(mean - m) <= 2 and abs(load - l) <= 15")
    return met.groupBy("series", "week").agg(F.max("base").alias("base")).select("series", F.date_format("week", "yyyy-MM-dd").alias("week"), F.date_format("base", "yyyy-MM-dd").alias("base"))


def jn16(spark, sf):
    """Weeks whose days of dependence (two before, to the week's end) meet a change."""
    change = samples(spark, sf).where("kind = 'signup'").select("series", F.date_trunc("hour", "ts").alias("start"), (F.date_trunc("hour", "ts") + F.expr("interval 1 hour")).alias("end")).distinct()
    week = _weeks(spark, sf).select("series", "week", F.date_sub("week", 2).cast("timestamp").alias("start"), F.date_add("week", 7).cast("timestamp").alias("end"))
    return iv.overlaps(week, change, "series").select("series", F.date_format("week", "yyyy-MM-dd").alias("week")).distinct()


def _ignored(spark, sf, rows, at):
    """rows with ``ignored``: does the time lie in an ignored window?"""
    w = iv.merge(_day_windows(spark, sf), "series")
    found = joins.as_of(rows.withColumn("__t", F.col(at)), w.select("series", F.col("start").alias("__t"), F.col("end").alias("until")), "series", "__t", "until")
    return found.withColumn("ignored", F.coalesce(F.col("until") > F.col("__t"), F.lit(False))).drop("__t", "until", "value_ts")


def prj7(spark, sf):
    rows = _ignored(spark, sf, samples(spark, sf).where("kind <> 'error'"), "ts")
    return rows.select("series", "seq", F.when(F.col("ignored"), 0).otherwise((F.col("kind") == "click").cast("int")).alias("heating_flame"), F.when(F.col("ignored"), 0).otherwise((F.col("kind") == "purchase").cast("int")).alias("dhw_flame"))


def prj9(spark, sf):
    """Regulation of a register: low bits the mode, 64 off, 128 heat request only."""
    reg, curve = F.col("k").cast("int") + F.when(F.col("seq") % 2 == 0, 128).otherwise(0), F.when(F.col("seq") % 5 == 0, 255).otherwise(F.col("seq") % 3)
    low = F.col("register").bitwiseAND(3)
    mode = F.when(low == 0, "air").when(low == 1, "air_pid").when(low == 2, "water")
    has = ~F.col("curve").isin(0, 255)
    role = F.when(mode.isNull(), "unknown").when(~has, "off").when(mode == "air_pid", "upper_limit").when((mode == "water") & (F.col("register").bitwiseAND(128) > 0), "heat_request_only").otherwise("target")
    return samples(spark, sf).select("seq", reg.alias("register"), curve.alias("curve")).select("seq", mode.alias("mode"), role.alias("curve_role"), (F.col("register").bitwiseAND(64) == 0).alias("enabled"))


def prj10(spark, sf):
    """Curves in deci-kelvin of a day's readings: valid if 2 to 32 points, in range
    and strictly monotone."""
    pts = samples(spark, sf).groupBy("series", F.to_date("ts").alias("day")).agg(F.array_sort(F.collect_list(F.struct("ts", "seq", (2730 + F.floor(F.col("raw") * 10)).cast("int").alias("x"), (2730 + F.floor(F.col("k") * 10)).cast("int").alias("y")))).alias("p"))
    x, y, n = F.col("p.x"), F.col("p.y"), F.size("p")
    range_ = F.forall(x, lambda v: v.between(2130, 3330)) & F.forall(y, lambda v: v.between(2730, 4230))
    pairs = F.arrays_zip(F.slice(x, 1, F.greatest(n - 1, F.lit(1))).alias("a"), F.slice(x, 2, F.greatest(n - 1, F.lit(1))).alias("b"))
    monotone = F.forall(pairs, lambda q: q["a"] < q["b"]) | F.forall(pairs, lambda q: q["a"] > q["b"])
    ok = n.between(2, 32) & range_ & monotone
    return pts.select("series", _day(), F.coalesce(ok, F.lit(False)).alias("valid"), F.when(ok, F.round((F.array_min(x) - 2730) / 10, 1)).alias("low_c"), F.when(ok, F.round((F.array_max(y) - 2730) / 10, 1)).alias("flow_c"))


def prj12(spark, sf):
    name = F.lower("c_mktsegment")
    intent = F.when(F.col("c_acctbal") < 0, "heating_off").when(name.rlike("комфорт|comfort|household"), "comfort").when(name.rlike("эконом|eco|build"), "economy").when(name.rlike("дач|away|отъезд|отпуск"), "away").when(name.rlike("межсез|shoulder"), "shoulder_season").otherwise("custom_active")
    return load(spark, sf, "customer").groupBy(intent.alias("intent")).agg(F.count("*").alias("n"))


def prj13(spark, sf):
    return samples(spark, sf).where("ts >= '2024-01-05' and ts < '2024-01-06'").select("series", "seq")


def prj14(spark, sf):
    return _span(_ignored(spark, sf, _segments(spark, sf), "start").where("not ignored").select("series", "start", "end"))


def prj17(spark, sf):
    rows = _states(spark, sf)
    noise = ((F.col("kind") != "error") & (F.col("sec") < 3_600) & F.col("kind").isin("click", "view")) | ((F.col("kind") == "signup") & (F.col("k") < 50))
    return rows.groupBy("kind", noise.alias("noise")).agg(F.count("*").alias("n"))


def prj18(spark, sf):
    """A [longitude, latitude] pair is kept if both are in range; a model only if
    its device has exactly one adapter."""
    s = samples(spark, sf).groupBy("series").agg(F.max_by(F.array(F.col("raw") * 4 - 100, F.col("k") * 2 - 100), "seq").alias("at"), F.count_distinct(F.when(F.col("kind") == "purchase", F.col("k"))).alias("adapters"))
    lon, lat = F.col("at")[0], F.col("at")[1]
    ok = lon.between(-180, 180) & lat.between(-90, 90)
    return s.select("series", F.when(ok, F.round(lon, 6)).alias("longitude"), F.when(ok, F.round(lat, 6)).alias("latitude"), (F.col("adapters") == 1).alias("has_model"))


def prj19(spark, sf):
    """One offset for a home if all its devices agree on one in -12..14."""
    c = samples(spark, sf).select("series").distinct().join(catalogue(spark, sf), "series").withColumn("offset", F.when(F.col("unit").isNotNull(), F.col("device") % 17 - F.when(F.col("series") % 2 == 0, 0).otherwise(1)))
    g = c.groupBy("device").agg(F.count_distinct("offset").alias("n"), F.count("offset").alias("known"), F.count("*").alias("all"), F.min("offset").alias("offset"))
    reason = F.when(F.col("known") < F.col("all"), "unknown").when(F.col("n") > 1, "disagree").when(~F.col("offset").between(-12, 14), "out_of_range")
    return g.select("device", F.when(reason.isNull(), F.col("offset")).alias("offset"), reason.alias("reason"))


def st3(spark, sf):
    """Hours touched by late corrections, by kind: state and level rows calibrate."""
    late = samples(spark, sf).where("seq % 11 = 0")
    kind = F.when(F.col("kind").isin("click", "purchase"), "calibration").otherwise("telemetry")
    return late.select("series", kind.alias("change"), F.unix_seconds(F.date_trunc("hour", "ts")).alias("hour_s")).distinct()


def st9(spark, sf):
    return samples(spark, sf).groupBy("series", "kind").agg(F.unix_micros(F.min("ts")).alias("first_us"))


_d = lambda c: f"strftime({c}, '%Y-%m-%d')"
_capped = lambda most: MED + f""" SELECT series, epoch_us(greatest(ts, TIMESTAMP '2024-01-05')) AS "start", epoch_us(least(nxt, TIMESTAMP '2024-01-20')) AS "end", kind FROM nx JOIN md USING (series) WHERE {_sec('ts', 'nxt')} <= {most} AND greatest(ts, TIMESTAMP '2024-01-05') < least(nxt, TIMESTAMP '2024-01-20')"""
WEEKS = S + ", w AS (SELECT series, CAST(date_trunc('week', ts) AS DATE) AS week, avg(value) AS mean, avg(k) AS load FROM s GROUP BY 1, 2)"

QUERIES = {
    "IV2_state_intervals": (iv2, _capped("greatest(300.0, 3 * m)")),
    "IV3_state_intervals": (iv3, _capped("least(108000.0, greatest(60.0, 3 * m))")),
    "IV5_spans": (iv5, VAL + f""", n AS (SELECT *, lead(ts) OVER w AS nxt, lead(value) OVER w AS thn FROM s WINDOW w AS (PARTITION BY series ORDER BY ts)), f AS (SELECT * FROM n WHERE value IS NOT NULL AND thn IS NOT NULL AND {_sec('ts', 'nxt')} <= 43200)
SELECT series, 'linear' AS span, epoch_us(ts) AS "start", epoch_us(nxt) AS "end", round(value, 6) AS "left", round(thn, 6) AS "right" FROM f UNION ALL SELECT series, 'categorical', epoch_us(ts), epoch_us(nxt), round(value, 6), round(value, 6) FROM f
UNION ALL SELECT series, 'held', epoch_us("start"), epoch_us("end"), round(target, 6), round(target, 6) FROM tgt UNION ALL SELECT series, 'preceding', epoch_us(ts) - 60000000, epoch_us(ts), round(k / 60, 6), round(k / 60, 6) FROM s WHERE k BETWEEN 0 AND 60"""),
    "IV9_overlap_seconds": (iv9, HELD + f""", f AS (SELECT *, lag(kind) OVER (PARTITION BY series ORDER BY ts, seq) AS was FROM s WHERE kind IN ('purchase', 'signup')), c AS (SELECT * FROM f WHERE kind IS DISTINCT FROM was), d AS (SELECT series, kind, ts AS a, coalesce(lead(ts) OVER (PARTITION BY series ORDER BY ts, seq), TIMESTAMP '{END}') AS b FROM c)
SELECT series, round(sum((epoch_us(least(b, "end")) - epoch_us(greatest(a, "start"))) / 1e6), 6) AS overlap_s FROM d JOIN held USING (series) WHERE d.kind = 'purchase' AND held.kind = 'click' AND "start" < b AND "end" > a GROUP BY 1"""),
    "IV11_power_intervals": (iv11, HELD + f""", p AS (SELECT series, ts, CAST(k AS INT) & 1 = 1 AS pw FROM s), q AS (SELECT *, lag(pw) OVER (PARTITION BY series ORDER BY ts) AS was FROM p), r AS (SELECT series, pw, ts AS a, coalesce(lead(ts) OVER (PARTITION BY series ORDER BY ts), TIMESTAMP '{END}') AS b FROM q WHERE pw IS DISTINCT FROM was),
al AS (SELECT series, a, b FROM r WHERE NOT pw UNION SELECT series, "start", "end" FROM held WHERE kind = 'error'), m AS (SELECT *, max(b) OVER (PARTITION BY series ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM al),
n AS (SELECT *, sum(CASE WHEN reach IS NULL OR epoch_us(a) - epoch_us(reach) > 120000000 THEN 1 ELSE 0 END) OVER (PARTITION BY series ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS g FROM m) SELECT series, epoch_us(min(a)) AS "start", epoch_us(max(b)) AS "end" FROM n GROUP BY series, g"""),
    "IV13_first_sustained": (iv13, S + f", x AS (SELECT series, ts, lead(ts) OVER w AS one, lead(ts, 2) OVER w AS two FROM (SELECT DISTINCT series, ts FROM s WHERE ts >= '2024-01-03') WINDOW w AS (PARTITION BY series ORDER BY ts)) SELECT series, epoch_us(min(ts)) AS first_us FROM x WHERE {_sec('ts', 'one')} <= 21600 AND {_sec('one', 'two')} <= 21600 GROUP BY 1"),
    "IV14_missing_coverage": (iv14, HELD + f""", c AS (SELECT series, "start" AS a, "end" AS b FROM held WHERE kind <> 'error' UNION ALL SELECT DISTINCT series, TIMESTAMP '{END}', TIMESTAMP '{END}' FROM s), r AS (SELECT *, coalesce(max(b) OVER (PARTITION BY series ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), TIMESTAMP '2024-01-01') AS reach FROM c),
h AS (SELECT series, reach AS x, a AS y FROM r WHERE a > reach), p AS (SELECT series, x, least(y, TIMESTAMP '2024-01-10') AS y, 'unavailable' AS action FROM h UNION ALL SELECT series, greatest(x, TIMESTAMP '2024-01-10'), y, 'fetch' FROM h) SELECT series, epoch_us(x) AS "start", epoch_us(y) AS "end", action FROM p WHERE x < y"""),
    "IV15_split_by_exclusions": (iv15, HELD + WIN + """, a AS (SELECT series || ':' || epoch_us("start") AS id, series, "start" AS x, "end" AS y FROM held WHERE kind IN ('click', 'view')), e AS (SELECT id, x, y, w.a, w.b FROM a LEFT JOIN win w ON w.series = a.series AND w.a < y AND w.b > x),
f AS (SELECT id, any_value(x) AS x, any_value(y) AS y, list_sort(list(a) FILTER (a IS NOT NULL)) AS aa, list_sort(list(b) FILTER (b IS NOT NULL)) AS bb FROM e GROUP BY 1),
g AS (SELECT id, unnest(list_prepend(x, coalesce(bb, []))) AS p, unnest(list_append(coalesce(aa, []), y)) AS q FROM f) SELECT id, epoch_us(p) AS "start", epoch_us(q) AS "end" FROM g WHERE p < q"""),
    "IV19_calendar": (iv19, f"""WITH d AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS d FROM orders), x AS (SELECT d, month(d) AS m, CAST(date_trunc('month', d) - to_months(CAST(month(d) % 3 AS INT)) AS DATE) AS f FROM d)
SELECT {_d('d')} AS day, {_d("date_trunc('week', d)")} AS week, {_d("date_trunc('month', d) + INTERVAL 1 MONTH")} AS next_month, CASE WHEN m IN (12, 1, 2) THEN 'winter' WHEN m < 6 THEN 'spring' WHEN m < 9 THEN 'summer' ELSE 'autumn' END AS season, CAST(year(d) + (m = 12)::INT AS INT) AS year, {_d('f')} AS season_first, {_d('f + INTERVAL 3 MONTH')} AS season_after FROM x"""),
    "IV20_scheduled_periods": (iv20, f"""WITH g AS (SELECT o_custkey, CAST(min(o_orderdate) AS DATE) AS a, CAST(max(o_orderdate) AS DATE) AS t FROM orders GROUP BY 1 HAVING a < t), d AS (SELECT o_custkey, t, CAST(u.d AS DATE) AS d FROM g, unnest(generate_series(a, t - 1, INTERVAL 1 DAY)) AS u(d)),
p AS (SELECT o_custkey, t, 'weekly' AS kind, date_trunc('week', d) AS f, date_trunc('week', d) + INTERVAL 7 DAY AS z FROM d UNION SELECT o_custkey, t, 'monthly', date_trunc('month', d), date_trunc('month', d) + INTERVAL 1 MONTH FROM d),
e AS (SELECT o_custkey, t, date_trunc('month', d) - to_months(CAST(month(d) % 3 AS INT)) AS f FROM d), q AS (SELECT DISTINCT o_custkey, 'seasonal' AS kind, f, CASE WHEN f + INTERVAL 3 MONTH <= t THEN f + INTERVAL 3 MONTH ELSE date_trunc('week', t) END AS z FROM e),
al AS (SELECT o_custkey, kind, f, z FROM p WHERE z <= t UNION SELECT o_custkey, kind, f, z FROM q WHERE z > f), r AS (SELECT *, row_number() OVER (PARTITION BY o_custkey, kind ORDER BY f DESC) AS n FROM al) SELECT o_custkey, kind, n, {_d('f')} AS first, {_d('z')} AS after FROM r WHERE n <= 3"""),
    "IV21_near_schedule": (iv21, S + " SELECT series, seq FROM s WHERE isodow(ts) <= 5 AND least(abs(floor(epoch(ts)) % 86400 - 28800), abs(floor(epoch(ts)) % 86400 - 79200)) <= 1200"),
    "AG4_interval_statistic": (ag4, VAL + ", " + _cut("val") + ", " + _stat_sql("series, day", "value", 86400.0) + f""", n AS (SELECT series, CAST(ts AS DATE) AS day, count(*) AS samples, round((86400000000 - epoch_us(max(ts)) % 86400000000) / 1e6, 2) AS stale_s FROM s WHERE value IS NOT NULL GROUP BY 1, 2)
SELECT st.series, {_d('st.day')} AS day, {_stat_cols}, coalesce(samples, 0) AS samples, stale_s FROM st LEFT JOIN n ON n.series = st.series AND n.day = st.day"""),
    "AG5_pair_statistic": (ag5, VAL + ', pr AS (SELECT series, "start", "end", value - target AS error FROM both_), ' + _cut("pr") + ", " + _stat_sql("series, day", "error", 86400.0) + f" SELECT series, {_d('day')} AS day, {_stat_cols} FROM st"),
    "AG9_statistic_over_set": (ag9, VAL + HELD[len(S):] + """, dd AS (SELECT v.series, greatest(v."start", h."start") AS "start", v.value, (epoch_us(least(v."end", h."end")) - epoch_us(greatest(v."start", h."start"))) / 1e6 AS sec FROM val v JOIN held h ON h.series = v.series AND h.kind = 'click' AND v."start" < h."end" AND v."end" > h."start"), """ + _stat_sql("series", "value", 2592000.0) + " SELECT series, " + _stat_cols.replace(", round((last - first) / 24.0, 6) AS slope_per_hour", "") + " FROM st"),
    "AG11_below_target": (ag11, VAL + f', x AS (SELECT *, {_sec()} AS sec, target - value AS d FROM both_) SELECT series, round(sum(sec), 6) AS evaluated_s, round(coalesce(sum(sec) FILTER (d > 2), 0), 6) AS below_s, round(coalesce(sum(d * sec) FILTER (d > 2), 0) / 3600, 6) AS degree_hours FROM x GROUP BY 1'),
    "AG16_burner_usage": (ag16, HELD + """, g AS (SELECT series, coalesce(sum(sec) FILTER (kind IN ('click', 'purchase')), 0) / 3600 AS f, sum(sec) / 3600 AS o, coalesce(sum(sec) FILTER (kind = 'click'), 0) / 3600 AS h, coalesce(sum(sec) FILTER (kind = 'purchase'), 0) / 3600 AS d FROM held WHERE kind <> 'error' GROUP BY 1)
SELECT series, round(100 * f / 744, 6) AS flame_pct, round(greatest(0, 744 - o), 6) AS unobserved_hours, round(100 * h / nullif(f, 0), 6) AS heating_pct, round(100 * d / nullif(f, 0), 6) AS dhw_pct FROM g"""),
    "AG17_span_algebra": (ag17, S + f""", x AS (SELECT series, value - 20 AS l, lead(value) OVER w - 20 AS r, (epoch_us(lead(ts) OVER w) - epoch_us(ts)) / 1e6 AS sec FROM s WINDOW w AS (PARTITION BY series ORDER BY ts)), y AS (SELECT * FROM x WHERE l IS NOT NULL AND r IS NOT NULL AND sec > 0 AND sec <= 43200),
z AS (SELECT *, CASE WHEN l >= 0 AND r >= 0 THEN (l + r) / 2 * sec WHEN l <= 0 AND r <= 0 THEN 0 ELSE greatest(l, r) ** 2 / (2 * abs(r - l)) * sec END AS pos FROM y)
SELECT series, round(sum(sec), 6) AS seconds, round(sum((l + r) * sec / 2), 2) AS integral, round(sum(pos), 2) AS positive_integral, round(sum(pos - (l + r) / 2 * sec), 2) AS negative_integral, round(min(least(l, r)), 6) AS minimum, round(max(greatest(l, r)), 6) AS maximum, round(sum(abs(r - l)), 6) AS variation, round(max(abs(r - l) * 3600 / sec), 2) AS max_rate_per_hour FROM z GROUP BY 1"""),
    "AG18_merged_runs": (ag18, HELD + """, x AS (SELECT *, kind IN ('click', 'view', 'purchase') AS request FROM held), y AS (SELECT *, lag(request) OVER w IS NOT DISTINCT FROM request AND lag("end") OVER w = "start" AS jn, abs(k - lag(k) OVER w) AS jump FROM x WINDOW w AS (PARTITION BY series ORDER BY "start")),
z AS (SELECT *, sum(CASE WHEN coalesce(jn, false) THEN 0 ELSE 1 END) OVER (PARTITION BY series ORDER BY "start") AS g FROM y) SELECT series, request, epoch_us(min("start")) AS "start", epoch_us(max("end")) AS "end", round(coalesce(sum(jump) FILTER (jn), 0), 6) AS variation, count(*) AS parts FROM z GROUP BY series, request, g"""),
    "AG20_sampling_facts": (ag20, S + f", r AS (SELECT * FROM s WHERE ts BETWEEN '2024-01-05' AND '2024-01-25'), k AS (SELECT *, (epoch_us(lead(ts) OVER (PARTITION BY series ORDER BY ts)) - epoch_us(ts)) / 1e6 AS gap FROM r WHERE value IS NOT NULL), u AS (SELECT series, count(*) AS unknown FROM r WHERE value IS NULL GROUP BY 1) SELECT k.series, count(*) AS n, round(min(gap), 6) AS least_s, round(max(gap), 6) AS most_s, round(median(gap), 6) AS median_s, coalesce(any_value(unknown), 0) AS unknown FROM k LEFT JOIN u ON u.series = k.series GROUP BY 1"),
    "AG21_day_rollup": (ag21, S + """, d AS (SELECT series, CAST(ts AS DATE) AS day, count(value) AS n, min(value) AS low, max(value) AS high FROM s GROUP BY 1, 2), x AS (SELECT *, (series + day(day)) % 5 = 0 AND series % 4 = 0 AS bad FROM d)
SELECT series, count(*) AS days, count(*) FILTER (bad AND low IS NOT NULL) AS conflicts, CAST(sum(n + bad::INT) AS BIGINT) AS n, min(low) AS low, max(high) AS high, max(day) - min(day) + 1 > count(*) AS incomplete FROM x GROUP BY 1"""),
    "AG22_long_periods": (ag22, S + f""", d AS (SELECT series, CAST(ts AS DATE) AS day, CAST(date_trunc('week', ts) AS DATE) AS week, count(value) AS n, avg(value) AS mean, max(CASE kind WHEN 'error' THEN 2 WHEN 'purchase' THEN 1 ELSE 0 END) AS sv FROM s GROUP BY 1, 2, 3), wk AS (SELECT DISTINCT series, week FROM d),
m AS (SELECT wk.series, wk.week, CAST(u.g AS DATE) AS day FROM wk, unnest(generate_series(week, week + 6, INTERVAL 1 DAY)) AS u(g)), h AS (SELECT m.*, row_number() OVER (PARTITION BY m.series, m.week ORDER BY m.day) AS n FROM m LEFT JOIN d USING (series, week, day) WHERE d.n IS NULL), r AS (SELECT series, week, count(*) AS len FROM (SELECT series, week, day - CAST(n AS INT) AS g FROM h) GROUP BY series, week, g), l AS (SELECT series, week, max(len) AS len FROM r GROUP BY 1, 2)
SELECT d.series, {_d('d.week')} AS week, count(*) AS days, CAST(sum(n) AS BIGINT) AS n, round(sum(mean * n) / nullif(sum(n), 0), 6) AS mean, round(median(mean), 6) AS daily_median, round(min(mean), 6) AS daily_low, round(max(mean), 6) AS daily_high, max(sv) AS severity, CAST(coalesce(any_value(len), 0) AS INT) AS longest_missing_days FROM d LEFT JOIN l ON l.series = d.series AND l.week = d.week GROUP BY 1, 2"""),
    "AG25_grouped_stats": (ag25, S + ", g AS (SELECT series, kind, count(*) AS n, round(avg(value), 6) AS mean, round(median(value), 6) AS median, min(value) AS low, max(value) AS high, round(max(value) - min(value), 6) AS range FROM s WHERE value IS NOT NULL GROUP BY 1, 2 HAVING count(*) >= 2), h AS (SELECT *, count(*) OVER (PARTITION BY series) AS groups FROM g) SELECT * FROM h WHERE groups >= 2"),
    "AG29_period_print": (ag29, S + f""", r AS (SELECT series, ts, ('0x' || substr(md5(series || '|' || seq || '|' || epoch_us(ts) || '|' || kind), 1, 8))::BIGINT AS h FROM s), w AS (SELECT DISTINCT date_trunc('week', ts) AS a FROM s UNION SELECT date_trunc('week', ts) - INTERVAL 7 DAY FROM s)
SELECT series, {_d('a')} AS day, count(*) AS n, CAST(sum(h) AS BIGINT) AS print FROM r JOIN w ON ts >= a AND ts < a + INTERVAL 14 DAY GROUP BY 1, 2"""),
    "AG30_status_counts": (ag30, "SELECT o_orderstatus, count(*) AS n, count(*) FILTER (o_orderstatus = 'O' AND o_orderdate <= '2000-01-01') AS stale FROM orders GROUP BY 1"),
    "AG31_usage_totals": (ag31, "SELECT event_type, CAST(sum(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS BIGINT) AS tokens, CAST(CAST(sum(CAST(value AS DECIMAL(18,6)) * CAST(0.001 AS DECIMAL(4,3))) AS DECIMAL(30,9)) AS VARCHAR) AS cost FROM events WHERE event_type <> 'error' AND ts >= '2024-01-05' AND ts < '2024-01-20' GROUP BY 1"),
    "AG32_period_means": (ag32, VAL + f", x AS (SELECT *, {_sec()} AS sec FROM both_) SELECT series, round(sum(value * sec) / sum(sec), 6) AS room, round(sum(target * sec) / sum(sec), 6) AS target, round(100 * sum(sec) / 2678400, 6) AS coverage_pct FROM x GROUP BY 1"),
    "JN5_tariff_as_of": (jn5, """WITH o AS (SELECT o_orderpriority, date_trunc('month', o_orderdate) AS ts, o_totalprice FROM orders), t AS (SELECT o_orderpriority, ts, round(avg(o_totalprice) / 1000, 4) AS price FROM o WHERE month(ts) % 3 = 1 GROUP BY 1, 2), l AS (SELECT DISTINCT o_orderpriority, ts FROM o)
SELECT l.o_orderpriority, strftime(l.ts, '%Y-%m') AS month, price, strftime(t.ts, '%Y-%m') AS since FROM l ASOF LEFT JOIN t ON l.o_orderpriority = t.o_orderpriority AND l.ts >= t.ts"""),
    "JN9_two_signals": (jn9, VAL + f" SELECT series, {_US}, value, target FROM both_"),
    "JN10_three_signals": (jn10, VAL + HELD[len(S):] + """ SELECT b.series, epoch_us(greatest(b."start", h."start")) AS "start", epoch_us(least(b."end", h."end")) AS "end", b.value, b.target, h.k AS level FROM both_ b JOIN held h ON h.series = b.series AND h.kind <> 'error' AND b."start" < h."end" AND b."end" > h."start\""""),
    "JN11_linked_sensors": (jn11, "SELECT s_suppkey AS circuit, CASE WHEN s_suppkey % 3 = 0 THEN s_suppkey ELSE s_nationkey END AS sensor, CASE WHEN s_suppkey % 3 = 0 THEN 1.0::DOUBLE ELSE 0.9::DOUBLE END AS confidence FROM supplier"),
    "JN12_unique_or_null": (jn12, CAT + ", u AS (SELECT DISTINCT series FROM s) SELECT device, CASE WHEN count(*) = 1 THEN min(series) END AS control, count(*) AS candidates FROM u JOIN cat USING (series) GROUP BY 1"),
    "JN14_proof": (jn14, S + ", t AS (SELECT *, lag(ts) OVER (PARTITION BY series ORDER BY ts) AS a FROM s WHERE kind = 'signup') SELECT t.series, t.seq, min(c.seq) AS note FROM t JOIN s c ON c.series = t.series AND c.kind = 'click' AND c.ts > t.a AND c.ts <= t.ts GROUP BY 1, 2 HAVING count(*) = 1"),
    "JN15_baseline": (jn15, WEEKS + f" SELECT a.series, {_d('a.week')} AS week, {_d('max(b.week)')} AS base FROM w a JOIN w b ON a.series = b.series AND b.week < a.week AND b.week >= a.week - 28 AND abs(a.mean - b.mean) <= 2 AND abs(a.load - b.load) <= 15 GROUP BY a.series, a.week"),
    "JN16_affected_periods": (jn16, WEEKS + f" SELECT DISTINCT w.series, {_d('week')} AS week FROM w JOIN s ON s.series = w.series AND s.kind = 'signup' AND date_trunc('hour', ts) < week + INTERVAL 7 DAY AND date_trunc('hour', ts) + INTERVAL 1 HOUR > week - INTERVAL 2 DAY"),
    "PRJ7_purpose_flame": (prj7, S + WIN + " SELECT series, seq, (kind = 'click' AND NOT ig)::INT AS heating_flame, (kind = 'purchase' AND NOT ig)::INT AS dhw_flame FROM (SELECT s.*, EXISTS (SELECT 1 FROM win WHERE win.series = s.series AND ts >= a AND ts < b) AS ig FROM s) WHERE kind <> 'error'"),
    "PRJ9_regulation": (prj9, S + """, x AS (SELECT seq, CAST(k AS INT) + CASE WHEN seq % 2 = 0 THEN 128 ELSE 0 END AS r, CASE WHEN seq % 5 = 0 THEN 255 ELSE seq % 3 END AS c FROM s), y AS (SELECT *, ['air', 'air_pid', 'water', NULL][(r & 3) + 1] AS mode FROM x)
SELECT seq, mode, CASE WHEN mode IS NULL THEN 'unknown' WHEN c IN (0, 255) THEN 'off' WHEN mode = 'air_pid' THEN 'upper_limit' WHEN mode = 'water' AND r & 128 > 0 THEN 'heat_request_only' ELSE 'target' END AS curve_role, r & 64 = 0 AS enabled FROM y"""),
    "PRJ10_curves": (prj10, S + f""", x AS (SELECT series, CAST(ts AS DATE) AS day, 2730 + CAST(floor(raw * 10) AS INT) AS x, 2730 + CAST(floor(k * 10) AS INT) AS y, lag(2730 + CAST(floor(raw * 10) AS INT)) OVER (PARTITION BY series, CAST(ts AS DATE) ORDER BY ts, seq) AS p FROM s),
g AS (SELECT series, day, count(*) BETWEEN 2 AND 32 AND bool_and(x BETWEEN 2130 AND 3330 AND y BETWEEN 2730 AND 4230) AND (coalesce(bool_and(p < x), false) OR coalesce(bool_and(p > x), false)) AS ok, min(x) AS lo, max(y) AS hi FROM x GROUP BY 1, 2) SELECT series, {_d('day')} AS day, ok AS valid, CASE WHEN ok THEN round((lo - 2730) / 10.0, 1) END AS low_c, CASE WHEN ok THEN round((hi - 2730) / 10.0, 1) END AS flow_c FROM g"""),
    "PRJ12_mode_intent": (prj12, "SELECT CASE WHEN c_acctbal < 0 THEN 'heating_off' WHEN c_mktsegment = 'HOUSEHOLD' THEN 'comfort' WHEN c_mktsegment = 'BUILDING' THEN 'economy' ELSE 'custom_active' END AS intent, count(*) AS n FROM customer GROUP BY 1"),
    "PRJ13_half_open_slice": (prj13, S + " SELECT series, seq FROM s WHERE CAST(ts AS DATE) = '2024-01-05'"),
    "PRJ14_ignored_segments": (prj14, SEG + WIN + f" SELECT series, {_US} FROM seg WHERE NOT EXISTS (SELECT 1 FROM win WHERE win.series = seg.series AND \"start\" >= a AND \"start\" < b)"),
    "PRJ17_noise": (prj17, HELD + " SELECT kind, (sec < 3600 AND kind IN ('click', 'view')) OR (kind = 'signup' AND k < 50) AS noise, count(*) AS n FROM held GROUP BY 1, 2"),
    "PRJ18_location": (prj18, S + """, g AS (SELECT series, arg_max(raw, seq) * 4 - 100 AS lon, arg_max(k, seq) * 2 - 100 AS lat, count(DISTINCT k) FILTER (kind = 'purchase') AS n FROM s GROUP BY 1), h AS (SELECT *, abs(lon) <= 180 AND abs(lat) <= 90 AS ok FROM g)
SELECT series, CASE WHEN ok THEN round(lon, 6) END AS longitude, CASE WHEN ok THEN round(lat, 6) END AS latitude, n = 1 AS has_model FROM h"""),
    "PRJ19_home_offset": (prj19, CAT + """, c AS (SELECT DISTINCT device, series, CASE WHEN unit IS NOT NULL THEN device % 17 - series % 2 END AS o FROM s JOIN cat USING (series)), g AS (SELECT device, CASE WHEN count(o) < count(*) THEN 'unknown' WHEN min(o) <> max(o) THEN 'disagree' WHEN min(o) < -12 OR min(o) > 14 THEN 'out_of_range' END AS reason, min(o) AS o FROM c GROUP BY 1)
SELECT device, CASE WHEN reason IS NULL THEN o END AS "offset", reason FROM g"""),
    "ST3_changed_hours": (st3, S + " SELECT DISTINCT series, CASE WHEN kind IN ('click', 'purchase') THEN 'calibration' ELSE 'telemetry' END AS change, CAST(epoch(date_trunc('hour', ts)) AS BIGINT) AS hour_s FROM s WHERE seq % 11 = 0"),
    "ST9_first_arrivals": (st9, S + " SELECT series, kind, epoch_us(min(ts)) AS first_us FROM s GROUP BY 1, 2"),
}
