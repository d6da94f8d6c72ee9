"""Consumption, savings, comparison and reliability queries over the given tables,
in the roles of ``telemetry``: expressions over additive sums."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from spanwise.operators import estimates as es
from spanwise.operators import intervals as iv, metrics, signals as sg
from spanwise.plans.episodes import CYC, READ, _cycles, _readings
from spanwise.plans.facts import END, VAL, _pair, _t, _US
from spanwise.plans.ingest import CAT, catalogue
from spanwise.plans.telemetry import HELD, S, _rounded, _span, _states, samples
from spanwise.session import load

_d = lambda c: f"strftime({c}, '%Y-%m-%d')"
BINS = [(0, 25), (25, 50), (50, 75), (75, 1_000)]


def _intervals(spark, sf):
    """Meter intervals: from one signup of a series to the next."""
    own = Window.partitionBy("series").orderBy("ts")
    t = samples(spark, sf).where("kind = 'signup'").select("series", F.col("ts").alias("start"), F.lead("ts").over(own).alias("end"), (F.col("raw") / 10).alias("volume"))
    return t.where("end > start")


def _features(spark, sf):
    met = iv.overlaps(_intervals(spark, sf), _states(spark, sf).where("kind <> 'error'").drop("sec"), "series")
    sec = iv.seconds(F.greatest("start", "r_start"), F.least("end", "r_end"))
    lit = F.col("r_kind").isin("click", "purchase")
    minutes = lambda ok: F.coalesce(F.sum(F.when(ok, sec)), F.lit(0.0)) / 60
    g = met.groupBy("series", "start", "end", "volume").agg(*[minutes(lit & (F.col("r_k") >= a) & (F.col("r_k") < b)).alias(f"bin_{i}") for i, (a, b) in enumerate(BINS)], minutes(lit).alias("flame"), (F.sum(sec) / 60).alias("observed"), minutes(lit & (F.col("r_kind") == "purchase")).alias("dhw"))
    return g.withColumn("coverage", F.col("observed") * 60 / iv.seconds("start", "end"))


FEAT = HELD + f""", m AS (SELECT series, ts AS a, lead(ts) OVER (PARTITION BY series ORDER BY ts) AS b, raw / 10 AS volume FROM s WHERE kind = 'signup'), o AS (SELECT m.*, kind, k, (epoch_us(least(b, "end")) - epoch_us(greatest(a, "start"))) / 6e7 AS mi FROM m JOIN held USING (series) WHERE b > a AND kind <> 'error' AND "start" < b AND "end" > a),
ft AS (SELECT series, a, b, volume, {', '.join(f"coalesce(sum(mi) FILTER (kind IN ('click', 'purchase') AND k >= {x} AND k < {y}), 0) AS bin_{i}" for i, (x, y) in enumerate(BINS))}, coalesce(sum(mi) FILTER (kind IN ('click', 'purchase')), 0) AS flame, sum(mi) AS observed, coalesce(sum(mi) FILTER (kind = 'purchase'), 0) AS dhw, sum(mi) * 6e7 / (epoch_us(b) - epoch_us(a)) AS coverage FROM o GROUP BY 1, 2, 3, 4)"""
_BINS = [f"bin_{i}" for i in range(4)]


def gs2(spark, sf):
    return _span(_features(spark, sf)).withColumns({c: F.round(c, 4) for c in ("volume", *_BINS, "flame", "observed", "dhw", "coverage")})


def gs3(spark, sf):
    return _rounded(es.support(_features(spark, sf), "series", _BINS), *[f"support_{i}" for i in range(4)], "volume", "flame", "coverage")


def gs6(spark, sf):
    return _rounded(es.rate_bounds(es.support(_features(spark, sf), "series", _BINS), 4), "base", *[f"{side}_{i}" for i in range(4) for side in ("low", "high")])


RATES = (0.001, 0.002, 0.003, 0.004)
SUP = FEAT + f""", us AS (SELECT *, coverage >= 0.8 AND observed > 0 AND flame > 0 AS ok FROM ft), sp AS (SELECT series, count(*) FILTER (ok) AS usable, count(*) FILTER (coverage < 0.8) AS gaps, count(*) FILTER (coverage >= 0.8 AND flame <= 0 AND volume > 0) AS no_flame, {', '.join(f"coalesce(sum(bin_{i}) FILTER (ok), 0) AS support_{i}, count(*) FILTER (ok AND bin_{i} > 0) AS count_{i}" for i in range(4))},
sum(volume) FILTER (ok) AS vol, sum(flame) FILTER (ok) AS fl, avg(coverage) FILTER (ok) AS cov FROM us GROUP BY 1)"""


def gs7(spark, sf):
    g = es.estimate(_features(spark, sf), _BINS, RATES, least_coverage=0.3)
    return _rounded(_span(g.select("series", "start", "end", "status", "estimate", "lower", "upper", "gap")), "estimate", "lower", "upper", "gap")


_OBS = " + ".join(f"bin_{i} * {r}" for i, r in enumerate(RATES))
EST = FEAT + f""", c AS (SELECT *, least(1.0, coverage) AS cv, {_OBS} + greatest(flame - bin_0 - bin_1 - bin_2 - bin_3, 0) * 0.0025 AS ob FROM ft), e AS (SELECT *, cv < 0.3 OR (flame <= 0 AND cv < 0.95) AS unknown, ob / cv AS est,
{' + '.join(f'bin_{i} * {r} * 0.7' for i, r in enumerate(RATES))} + greatest(flame - bin_0 - bin_1 - bin_2 - bin_3, 0) * 0.0025 * 0.7 AS lo, {' + '.join(f'bin_{i} * {r} * 1.3' for i, r in enumerate(RATES))} + greatest(flame - bin_0 - bin_1 - bin_2 - bin_3, 0) * 0.0025 * 1.3 AS hi FROM c),
fin AS (SELECT *, CASE WHEN unknown THEN 'unknown' WHEN cv < 1 - 1e-9 THEN 'extrapolated' ELSE 'estimated' END AS status, CASE WHEN NOT unknown THEN est END AS estimate, CASE WHEN NOT unknown THEN greatest(0, least(lo, est)) END AS lower_, CASE WHEN NOT unknown THEN greatest(est, hi / cv * (1 + 0.5 * (1 - cv))) END AS upper_, CASE WHEN NOT unknown THEN est - ob END AS gap FROM e)"""


def gs8(spark, sf):
    g = es.estimate(_features(spark, sf), _BINS, RATES, least_coverage=0.3).where("estimate is not null")
    share = lambda part: F.coalesce(F.try_divide(part, F.col("flame")), F.lit(0.0)) * (F.col("estimate") - F.col("gap"))
    g = g.withColumn("dhw_part", share(F.col("dhw"))).withColumn("heating_part", share(F.col("flame") - F.col("dhw")))
    g = g.withColumn("unallocated", F.col("estimate") - F.col("dhw_part") - F.col("heating_part"))
    return _rounded(_span(g.select("series", "start", "dhw_part", "heating_part", "unallocated")), "dhw_part", "heating_part", "unallocated")


def _seasons(spark, sf):
    """Each supplier's volume and degree-hours before and after 1998."""
    rows = load(spark, sf, "lineitem").withColumn("after", F.year("l_shipdate") >= 1998)
    degree = F.greatest(F.lit(0.0), 18 - (F.col("l_discount") * 100 + F.month("l_shipdate"))) * 24
    g = lambda ok, v: F.sum(F.when(ok, v))
    a = F.col("after")
    return rows.groupBy("l_suppkey").agg(g(~a, F.col("l_quantity")).alias("before"), g(a, F.col("l_quantity")).alias("now"), g(~a, degree).alias("dh0"), g(a, degree).alias("dh1"), F.count_if(~a).alias("n0"), F.count_if(a).alias("n1"), F.max("l_tax").alias("worst"))


def gs10(spark, sf):
    return _rounded(es.savings(_seasons(spark, sf), "l_suppkey"), "expected", "saved", "saved_pct", "lower", "upper")


def gs14(spark, sf):
    """A volume valued by the tariff weights of the months that it was used in; a
    scope with more than one currency has no value."""
    rows = load(spark, sf, "lineitem").groupBy("l_suppkey", F.trunc("l_shipdate", "month").alias("month")).agg(F.sum(F.col("l_quantity").cast("decimal(18,2)")).alias("v"))
    rows = rows.withColumn("price", (F.lit(100) + F.month("month")).cast("decimal(18,2)")).withColumn("currency", F.when(F.year("month") + F.col("l_suppkey") % 40 > 1999, "EUR").otherwise("RUB"))
    g = rows.groupBy("l_suppkey").agg(F.count_distinct("currency").alias("n"), F.sum("v").alias("volume"), F.sum(F.col("v") * F.col("price")).alias("weighted"), F.min("currency").alias("currency"))
    amount = F.when(F.col("n") == 1, F.col("weighted").cast("double") * 10 / F.col("volume").cast("double"))
    return g.select("l_suppkey", F.when(F.col("n") == 1, F.col("currency")).alias("currency"), F.round(amount, 4).alias("amount"), F.when(F.col("n") == 1, "available").otherwise("unknown").alias("status"))


def ag12(spark, sf):
    return _rounded(_cycles(spark, sf).groupBy("series").agg(F.count("*").alias("episodes"), F.avg("sec").alias("mean_s"), F.max("sec").alias("longest_s"), metrics.share(F.count_if(F.col("sec") >= 43_200), F.count("*")).alias("long_pct")), "mean_s", "longest_s", "long_pct")


def ag19(spark, sf):
    """Error facts of aligned pieces by level band: signed, absolute, over, under."""
    rows = _pair(spark, sf).withColumn("sec", iv.seconds("start", "end")).withColumn("e", F.col("value") - F.col("target"))
    band = F.when(F.col("target") < 20, "low").when(F.col("target") < 60, "middle").otherwise("high")
    hours = lambda e: F.sum(F.greatest(F.lit(0.0), e) * F.col("sec")) / 3600
    g = rows.groupBy("series", band.alias("band")).agg((F.sum(F.col("e") * F.col("sec")) / F.sum("sec")).alias("signed"), (F.sum(F.abs("e") * F.col("sec")) / F.sum("sec")).alias("absolute"), hours(F.col("e")).alias("over"), hours(-F.col("e")).alias("under"), (F.max("value") - F.min("value")).alias("range"), (F.sum("sec") / 3600).alias("hours"))
    return _rounded(g, "signed", "absolute", "over", "under", "range", "hours")


def ag23(spark, sf):
    g = samples(spark, sf).where("value is not null").join(catalogue(spark, sf).select("series", "device"), "series").groupBy("device", "series").agg(F.median("value").alias("median"), F.min("value").alias("low"), F.max("value").alias("high"))
    return _rounded(g.withColumn("offset", F.col("median") - F.avg("median").over(Window.partitionBy("device"))), "median", "offset")


def ag26(spark, sf):
    """Operating seconds by confirmed failure, repair time of confirmed restores,
    and freshness at the end of January; no failure gives a lower bound."""
    s = samples(spark, sf)
    down = iv.loss_restore(s, "series", "ts", "kind", "purchase", "signup", "seq")
    g = down.groupBy("series").agg(F.count("*").alias("failures"), F.sum(iv.seconds("start", F.coalesce("end", _t(END)))).alias("down_s"), F.avg(iv.seconds("start", "end")).alias("mttr_s"))
    span = s.groupBy("series").agg(F.min("ts").alias("first"), F.max("ts").alias("latest"))
    out = span.join(g, "series", "left").withColumn("failures", F.coalesce("failures", F.lit(0)))
    up = iv.seconds(F.col("first"), _t(END)) - F.coalesce("down_s", F.lit(0.0))
    fresh = iv.seconds(F.col("latest"), _t("2024-01-31")) <= 43_200
    return _rounded(out.select("series", "failures", up.alias("operating_s"), F.when(fresh, up / F.greatest("failures", F.lit(1))).alias("mtbf_s"), (F.col("failures") == 0).alias("lower_bound"), "mttr_s", fresh.alias("fresh")), "operating_s", "mtbf_s", "mttr_s")


def ag27(spark, sf):
    """Days of the reading intervals: measured where one is that very day."""
    r = _readings(spark, sf).withColumn("n", F.datediff("end", "start"))
    days = r.select("l_suppkey", "l_returnflag", F.explode(F.sequence("start", F.date_sub("end", 1))).alias("day"), (F.col("volume") / F.col("n")).alias("volume"), (F.col("n") == 1).alias("measured"))
    return _rounded(days.withColumn("day", F.date_format("day", "yyyy-MM-dd")), "volume")


def ev3(spark, sf):
    return _cycles(spark, sf).select("series", F.unix_micros("started_at").alias("start"), F.unix_micros("ended_at").alias("end"))


def ev21(spark, sf):
    band = F.when(F.col("kind") == "click", "heating").when(F.col("kind") == "purchase", "dhw").otherwise("none")
    rows = sg.merged_runs(_states(spark, sf).withColumn("band", band), "series", ["band"], "k").where("band <> 'none'")
    return _span(rows.select("series", "band", "start", "end"))


def _week_facts(spark, sf):
    s = samples(spark, sf)
    return s.groupBy("series", F.trunc("ts", "week").alias("week")).agg(F.avg("k").alias("outdoor"), (100 * F.avg((F.col("kind") == "purchase").cast("int"))).alias("dhw"), F.min_by("kind", F.struct("ts", "seq")).alias("mode"), (100 * F.avg(F.col("value").isNotNull().cast("int"))).alias("coverage"))


WF = S + """, wf AS (SELECT series, CAST(date_trunc('week', ts) AS DATE) AS week, avg(k) AS outdoor, 100 * avg((kind = 'purchase')::INT) AS dhw, arg_min(kind, ts) AS mode, 100 * avg((value IS NOT NULL)::INT) AS coverage FROM s GROUP BY 1, 2)"""


def cp2(spark, sf):
    """May a week be compared with the one before? The flags that speak against."""
    w = _week_facts(spark, sf)
    before = w.select("series", F.date_add("week", 7).alias("week"), *[F.col(c).alias(f"b_{c}") for c in ("outdoor", "dhw", "mode", "coverage")])
    flags = F.concat_ws(",", F.when(F.abs(F.col("outdoor") - F.col("b_outdoor")) > 3, "weather_not_comparable"), F.when(F.abs(F.col("dhw") - F.col("b_dhw")) > 15, "dhw_influence_not_comparable"), F.when(F.col("mode") != F.col("b_mode"), "operating_mode_not_comparable"),
                        F.when(F.col("b_coverage") < 70, "before_low_coverage"), F.when(F.col("coverage") < 70, "after_low_coverage"))
    return w.join(before, ["series", "week"]).select("series", F.date_format("week", "yyyy-MM-dd").alias("week"), flags.alias("flags"), (flags == "").alias("comparable"))


def cp3(spark, sf):
    return _rounded(_week_facts(spark, sf).withColumn("week", F.date_format("week", "yyyy-MM-dd")), "outdoor", "dhw", "coverage")


def cp5(spark, sf):
    """Of each week the three earlier ones that match it best in weather."""
    w = _week_facts(spark, sf)
    back = w.select("series", F.explode(F.transform(F.sequence(F.lit(1), F.lit(4)), lambda i: F.date_add(F.col("week"), (7 * i).cast("int")))).alias("week"), F.col("week").alias("base"), F.col("outdoor").alias("o"))
    gap = F.round(F.abs(F.col("outdoor") - F.col("o")), 6)
    met = w.join(back, ["series", "week"]).withColumn("gap", gap).withColumn("n", F.row_number().over(Window.partitionBy("series", "week").orderBy("gap", F.desc("base"))))
    return met.where("n <= 3").select("series", F.date_format("week", "yyyy-MM-dd").alias("week"), F.date_format("base", "yyyy-MM-dd").alias("base"), "n")


def cp6(spark, sf):
    """Equal windows around a change: 24 hours skipped after it, three days at most,
    no further than the changes beside it, six hours at least."""
    own = Window.partitionBy("series").orderBy("ts")
    t = samples(spark, sf).where("kind = 'signup'").select("series", "seq", "ts", F.coalesce(F.lag("ts").over(own), _t("2024-01-01")).alias("was"), F.coalesce(F.lead("ts").over(own), _t(END)).alias("next"))
    size = F.least(F.lit(3 * 86_400.0), iv.seconds("was", "ts"), iv.seconds("ts", "next") - 86_400)
    return t.withColumn("size_s", F.round(size, 6)).where("size_s >= 21600").select("series", "seq", "size_s")


def cp7(spark, sf):
    """Hours by stratum (kind and two-degree bin) of linear spans that stay in one."""
    own = Window.partitionBy("series").orderBy("ts")
    rows = samples(spark, sf).withColumn("b", F.lead("value").over(own)).withColumn("sec", iv.seconds("ts", F.lead("ts").over(own))).where("value is not null and b is not null and sec <= 43200")
    low, high = F.floor(F.least("value", "b") / 20), F.floor(F.greatest("value", "b") / 20)
    return _rounded(rows.where(low == high).groupBy("kind", low.alias("bin")).agg(F.count("*").alias("n"), (F.sum("sec") / 3600).alias("hours")), "hours")


def cp10(spark, sf):
    """Stage of each change by the useful hours after it and what follows."""
    own = Window.partitionBy("series").orderBy("ts")
    t = samples(spark, sf).where("kind = 'signup'").select("series", "seq", "ts", F.lag("ts").over(own).alias("was"), F.lead("ts").over(own).alias("next"))
    useful = iv.seconds("ts", F.coalesce("next", _t(END))) / 3600 - 24
    stage = F.when(F.col("was").isNull(), "insufficient").when(useful >= 6, "available").when(F.col("next").isNotNull(), "superseded").otherwise("transition_or_collecting")
    return t.select("series", "seq", stage.alias("stage"))


def cp11(spark, sf):
    """Does a version come back that was seen before the previous one?"""
    own = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    rows = iv.transitions(load(spark, sf, "orders").withColumn("__at", F.struct("o_orderdate", "o_orderkey")), "o_custkey", "__at", "o_orderstatus")
    earlier = F.count("*").over(Window.partitionBy("o_custkey", "o_orderstatus").orderBy("o_orderdate", "o_orderkey").rowsBetween(Window.unboundedPreceding, -1))
    return rows.select("o_custkey", "o_orderkey", (earlier > 0).alias("rollback"))


def jn13(spark, sf):
    """Regions with their nations and how many suppliers each has."""
    n = load(spark, sf, "nation").join(load(spark, sf, "supplier").groupBy(F.col("s_nationkey").alias("n_nationkey")).agg(F.count("*").alias("n")), "n_nationkey", "left")
    zones = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n_nationkey", F.coalesce("n", F.lit(0)).alias("n")))), lambda z: F.concat_ws(":", z["n_nationkey"].cast("string"), z["n"].cast("string"))), ",")
    return n.groupBy(F.col("n_regionkey").alias("r_regionkey")).agg(zones.alias("zones"))


def sl6(spark, sf):
    """A held target's steps, with rows at the edges of the period."""
    t = samples(spark, sf).where("kind = 'signup'").select("series", "ts", F.col("raw").alias("target"))
    a, b = _t("2024-01-10"), _t("2024-01-20")
    inside = t.where((F.col("ts") > a) & (F.col("ts") < b))
    edge = lambda at, ok: t.where(ok).groupBy("series").agg(F.max_by("target", "ts").alias("target")).select("series", at.alias("ts"), "target")
    return inside.union(edge(a, F.col("ts") <= a)).union(edge(b, F.col("ts") < b)).select("series", F.unix_micros("ts").alias("us"), "target")


QUERIES = {
    "GS2_interval_features": (gs2, FEAT + ' SELECT series, epoch_us(a) AS "start", epoch_us(b) AS "end", ' + ", ".join(f"round({c}, 4) AS {c}" for c in ("volume", *_BINS, "flame", "observed", "dhw", "coverage")) + " FROM ft"),
    "GS3_support": (gs3, SUP + " SELECT series, usable, gaps, no_flame, " + ", ".join(f"round(support_{i}, 6) AS support_{i}, count_{i}" for i in range(4)) + ", round(vol, 6) AS volume, round(fl, 6) AS flame, round(cov, 6) AS coverage FROM sp"),
    "GS6_rate_bounds": (gs6, SUP + ", b AS (SELECT *, vol / fl AS rate, greatest(0.30, 0.08, 0.75 * (1 - cov), 0.25 / sqrt(usable)) AS base FROM sp WHERE usable > 0) SELECT series, round(base, 6) AS base, " + ", ".join(
        f"round(greatest(0, rate * (1 - greatest(base, CASE WHEN support_{i} <= 0 THEN 0.5 WHEN count_{i} < 2 THEN 0.3 ELSE 0 END))), 6) AS low_{i}, round(rate * (1 + greatest(base, CASE WHEN support_{i} <= 0 THEN 0.5 WHEN count_{i} < 2 THEN 0.3 ELSE 0 END)), 6) AS high_{i}" for i in range(4)) + " FROM b"),
    "GS7_exposure_estimate": (gs7, EST + ' SELECT series, epoch_us(a) AS "start", epoch_us(b) AS "end", status, round(estimate, 6) AS estimate, round(lower_, 6) AS lower, round(upper_, 6) AS upper, round(gap, 6) AS gap FROM fin'),
    "GS8_purpose_split": (gs8, EST + """, p AS (SELECT *, coalesce(dhw / nullif(flame, 0), 0) * ob AS d, coalesce((flame - dhw) / nullif(flame, 0), 0) * ob AS h FROM fin WHERE estimate IS NOT NULL) SELECT series, epoch_us(a) AS "start", round(d, 6) AS dhw_part, round(h, 6) AS heating_part, round(estimate - d - h, 6) AS unallocated FROM p"""),
    "GS10_savings": (gs10, """WITH r AS (SELECT l_suppkey, year(l_shipdate) >= 1998 AS af, l_quantity AS q, greatest(0, 18 - (l_discount * 100 + month(l_shipdate))) * 24 AS dh, l_tax FROM lineitem), g AS (SELECT l_suppkey, sum(q) FILTER (NOT af) AS before, sum(q) FILTER (af) AS now, sum(dh) FILTER (NOT af) AS dh0, sum(dh) FILTER (af) AS dh1, count(*) FILTER (NOT af) AS n0, count(*) FILTER (af) AS n1 FROM r GROUP BY 1),
e AS (SELECT *, before / dh0 * dh1 AS ex, before / dh0 * dh1 * 0.1 AS u FROM g WHERE before IS NOT NULL AND now IS NOT NULL AND dh0 > 0 AND dh1 > 0) SELECT l_suppkey, round(ex, 6) AS expected, round(ex - now, 6) AS saved, round(100 * (ex - now) / ex, 6) AS saved_pct, round(ex - now - u, 6) AS lower, round(ex - now + u, 6) AS upper,
CASE WHEN n1 > 2 * n0 THEN 'extrapolated' WHEN (ex - now - u <= 0 AND ex - now + u >= 0) OR abs(100 * (ex - now) / ex) <= 2 THEN 'effect_indistinguishable' ELSE 'estimated' END AS status, CAST(least(CASE WHEN n1 > 2 * n0 THEN 35 ELSE 100 END, CASE WHEN n0 < 3 THEN 35 WHEN n0 < 6 THEN 50 WHEN n0 < 9 THEN 65 ELSE 100 END, round(100 * (0.25 + 0.75 * least(1.0, n0 / 12.0)) * 0.9)) AS INT) AS reliability FROM e"""),
    "GS14_tariff_weights": (gs14, """WITH r AS (SELECT l_suppkey, date_trunc('month', l_shipdate) AS m, CAST(sum(l_quantity) AS DOUBLE) AS v FROM lineitem GROUP BY 1, 2), x AS (SELECT *, 100 + month(m) AS p, CASE WHEN year(m) + l_suppkey % 40 > 1999 THEN 'EUR' ELSE 'RUB' END AS c FROM r)
SELECT l_suppkey, CASE WHEN min(c) = max(c) THEN min(c) END AS currency, CASE WHEN min(c) = max(c) THEN round(10 * sum(v * p) / sum(v), 4) END AS amount, CASE WHEN min(c) = max(c) THEN 'available' ELSE 'unknown' END AS status FROM x GROUP BY 1"""),
    "AG12_episode_metrics": (ag12, CYC + " SELECT series, count(*) AS episodes, round(avg(sec), 6) AS mean_s, round(max(sec), 6) AS longest_s, round(100.0 * count(*) FILTER (sec >= 43200) / count(*), 6) AS long_pct FROM cyc GROUP BY 1"),
    "AG19_regulation_summary": (ag19, VAL + """, x AS (SELECT *, (epoch_us("end") - epoch_us("start")) / 1e6 AS sec, value - target AS e, CASE WHEN target < 20 THEN 'low' WHEN target < 60 THEN 'middle' ELSE 'high' END AS band FROM both_)
SELECT series, band, round(sum(e * sec) / sum(sec), 6) AS signed, round(sum(abs(e) * sec) / sum(sec), 6) AS absolute, round(coalesce(sum(e * sec) FILTER (e > 0), 0) / 3600, 6) AS over, round(coalesce(sum(-e * sec) FILTER (e < 0), 0) / 3600, 6) AS under, round(max(value) - min(value), 6) AS range, round(sum(sec) / 3600, 6) AS hours FROM x GROUP BY 1, 2"""),
    "AG23_house_context": (ag23, CAT + ", g AS (SELECT device, series, median(value) AS m, min(value) AS low, max(value) AS high FROM s JOIN cat USING (series) WHERE value IS NOT NULL GROUP BY 1, 2) SELECT device, series, round(m, 6) AS median, low, high, round(m - avg(m) OVER (PARTITION BY device), 6) AS \"offset\" FROM g"),
    "AG26_reliability": (ag26, S + f""", f AS (SELECT *, lag(kind) OVER (PARTITION BY series ORDER BY ts, seq) AS was FROM s WHERE kind IN ('purchase', 'signup')), c AS (SELECT series, kind, ts, lead(ts) OVER (PARTITION BY series ORDER BY ts, seq) AS nx FROM f WHERE kind IS DISTINCT FROM was),
d AS (SELECT series, count(*) AS n, sum((epoch_us(coalesce(nx, TIMESTAMP '{END}')) - epoch_us(ts)) / 1e6) AS dn, avg((epoch_us(nx) - epoch_us(ts)) / 1e6) AS rt FROM c WHERE kind = 'purchase' GROUP BY 1), p AS (SELECT series, min(ts) AS a, max(ts) AS b FROM s GROUP BY 1),
u AS (SELECT p.series, coalesce(n, 0) AS n, (epoch_us(TIMESTAMP '{END}') - epoch_us(a)) / 1e6 - coalesce(dn, 0) AS up, rt, epoch_us(TIMESTAMP '2024-01-31') - epoch_us(b) <= 43200e6 AS fresh FROM p LEFT JOIN d ON d.series = p.series)
SELECT series, n AS failures, round(up, 6) AS operating_s, CASE WHEN fresh THEN round(up / greatest(n, 1), 6) END AS mtbf_s, n = 0 AS lower_bound, round(rt, 6) AS mttr_s, fresh FROM u"""),
    "AG27_daily_volumes": (ag27, READ + f" SELECT l_suppkey, l_returnflag, {_d('u.g')} AS day, round(volume / (en - st), 6) AS volume, en - st = 1 AS measured FROM diff, unnest(generate_series(st, en - 1, INTERVAL 1 DAY)) AS u(g)"),
    "EV3_on_runs": (ev3, CYC + f" SELECT series, {_US} FROM cyc"),
    "EV21_state_bands": (ev21, HELD + """, x AS (SELECT *, CASE kind WHEN 'click' THEN 'heating' WHEN 'purchase' THEN 'dhw' ELSE 'none' END AS band FROM held), y AS (SELECT *, CASE WHEN band = lag(band) OVER w AND "start" = lag("end") OVER w THEN 0 ELSE 1 END AS nw FROM x WINDOW w AS (PARTITION BY series ORDER BY "start")), z AS (SELECT *, sum(nw) OVER (PARTITION BY series ORDER BY "start") AS g FROM y)
SELECT series, band, epoch_us(min("start")) AS "start", epoch_us(max("end")) AS "end" FROM z WHERE band <> 'none' GROUP BY series, band, g"""),
    "CP2_comparable": (cp2, WF + f""", j AS (SELECT a.series, a.week, concat_ws(',', CASE WHEN abs(a.outdoor - b.outdoor) > 3 THEN 'weather_not_comparable' END, CASE WHEN abs(a.dhw - b.dhw) > 15 THEN 'dhw_influence_not_comparable' END, CASE WHEN a.mode <> b.mode THEN 'operating_mode_not_comparable' END, CASE WHEN b.coverage < 70 THEN 'before_low_coverage' END, CASE WHEN a.coverage < 70 THEN 'after_low_coverage' END) AS flags FROM wf a JOIN wf b ON a.series = b.series AND b.week = a.week - 7)
SELECT series, {_d('week')} AS week, flags, flags = '' AS comparable FROM j"""),
    "CP3_window_context": (cp3, WF + f" SELECT series, {_d('week')} AS week, round(outdoor, 6) AS outdoor, round(dhw, 6) AS dhw, mode, round(coverage, 6) AS coverage FROM wf"),
    "CP5_matched_pairs": (cp5, WF + f", j AS (SELECT a.series, a.week, b.week AS base, row_number() OVER (PARTITION BY a.series, a.week ORDER BY round(abs(a.outdoor - b.outdoor), 6), b.week DESC) AS n FROM wf a JOIN wf b ON a.series = b.series AND b.week < a.week AND b.week >= a.week - 28) SELECT series, {_d('week')} AS week, {_d('base')} AS base, n FROM j WHERE n <= 3"),
    "CP6_equal_windows": (cp6, S + f", t AS (SELECT series, seq, epoch_us(ts) AS t, epoch_us(coalesce(lag(ts) OVER w, TIMESTAMP '2024-01-01')) AS a, epoch_us(coalesce(lead(ts) OVER w, TIMESTAMP '{END}')) AS b FROM s WHERE kind = 'signup' WINDOW w AS (PARTITION BY series ORDER BY ts)), u AS (SELECT series, seq, round(least(259200.0, (t - a) / 1e6, (b - t) / 1e6 - 86400), 6) AS size_s FROM t) SELECT * FROM u WHERE size_s >= 21600"),
    "CP7_strata": (cp7, S + ", x AS (SELECT kind, value AS v, lead(value) OVER w AS b, (epoch_us(lead(ts) OVER w) - epoch_us(ts)) / 1e6 AS sec FROM s WINDOW w AS (PARTITION BY series ORDER BY ts)) SELECT kind, CAST(floor(least(v, b) / 20) AS BIGINT) AS bin, count(*) AS n, round(sum(sec) / 3600, 6) AS hours FROM x WHERE v IS NOT NULL AND b IS NOT NULL AND sec <= 43200 AND floor(v / 20) = floor(b / 20) GROUP BY 1, 2"),
    "CP10_stage": (cp10, S + f", t AS (SELECT series, seq, lag(ts) OVER w AS a, lead(ts) OVER w AS b, (epoch_us(coalesce(lead(ts) OVER w, TIMESTAMP '{END}')) - epoch_us(ts)) / 3.6e9 - 24 AS u FROM s WHERE kind = 'signup' WINDOW w AS (PARTITION BY series ORDER BY ts)) SELECT series, seq, CASE WHEN a IS NULL THEN 'insufficient' WHEN u >= 6 THEN 'available' WHEN b IS NOT NULL THEN 'superseded' ELSE 'transition_or_collecting' END AS stage FROM t"),
    "CP11_rollback": (cp11, "WITH x AS (SELECT *, lag(o_orderstatus) OVER w AS was, row_number() OVER w AS n FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)), y AS (SELECT * FROM x WHERE n = 1 OR was <> o_orderstatus) SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey, o_orderstatus ORDER BY o_orderdate, o_orderkey) > 1 AS rollback FROM y"),
    "JN13_catalogue": (jn13, "WITH c AS (SELECT n_regionkey, n_nationkey, count(s_suppkey) AS n FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey GROUP BY 1, 2) SELECT n_regionkey AS r_regionkey, string_agg(n_nationkey || ':' || n, ',' ORDER BY n_nationkey) AS zones FROM c GROUP BY 1"),
    "SL6_held_steps": (sl6, S + """, t AS (SELECT series, ts, raw FROM s WHERE kind = 'signup') SELECT series, epoch_us(ts) AS us, raw AS target FROM t WHERE ts > '2024-01-10' AND ts < '2024-01-20' UNION ALL SELECT series, epoch_us(TIMESTAMP '2024-01-10'), arg_max(raw, ts) FROM t WHERE ts <= '2024-01-10' GROUP BY 1 UNION ALL SELECT series, epoch_us(TIMESTAMP '2024-01-20'), arg_max(raw, ts) FROM t WHERE ts < '2024-01-20' GROUP BY 1"""),
}
