"""Interval queries over the given tables.

Roles: users of ``events`` are series; an ``error`` row is an explicit unknown;
click and view are heating states (with and without flame), purchase hot water,
signup off; signup values are held targets; purchase and signup are a loss and a
restore; ``props.k`` is a second signal. Thresholds are hours, as samples are."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from spanwise.operators import intervals as iv
from spanwise.operators import joins, metrics
from spanwise.session import load

DAY = 86_400
S = """WITH s AS (SELECT user_id AS series, ts, event_id AS seq, event_type AS kind, value AS raw,
  CASE WHEN event_type = 'error' THEN NULL ELSE value END AS value, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k FROM events)"""
SEG = S + """, g AS (SELECT series, ts AS "start", lead(ts) OVER (PARTITION BY series ORDER BY ts) AS "end", value FROM s WHERE value IS NOT NULL),
c AS (SELECT *, (epoch_us("end") - epoch_us("start")) / 1e6 AS sec FROM g),
seg AS (SELECT * EXCLUDE (cap) FROM (SELECT *, greatest(60.0, 2.5 * median(CASE WHEN sec > 0 THEN sec END) OVER (PARTITION BY series)) AS cap FROM c) WHERE sec > 0 AND sec <= cap)"""
HELD = S + """, h0 AS (SELECT series, ts AS "start", coalesce(lead(ts) OVER (PARTITION BY series ORDER BY ts), TIMESTAMP '2024-02-01') AS "end", kind, k FROM s),
held AS (SELECT *, (epoch_us("end") - epoch_us("start")) / 1e6 AS sec FROM h0 WHERE "end" > "start" AND epoch_us("end") - epoch_us("start") <= 86400e6)"""


def samples(spark, sf):
    return load(spark, sf, "events").select(
        F.col("user_id").alias("series"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").alias("seq"), F.col("event_type").alias("kind"),
        F.col("value").alias("raw"), F.when(F.col("event_type") != "error", F.col("value")).alias("value"), F.get_json_object("props", "$.k").cast("double").alias("k"),
    )


def _rounded(df, *names):
    return df.withColumns({c: F.round(c, 6) for c in names})


def _span(df):
    """start and end as microseconds, which both engines write alike."""
    return df.withColumns({c: F.unix_micros(c) for c in ("start", "end") if c in df.columns})


def _segments(spark, sf):
    return iv.segments(samples(spark, sf), "series", "ts", "value")


def _states(spark, sf):
    held = iv.held_segments(samples(spark, sf).withColumn("s", F.struct("kind", "k")), "series", "ts", "s", DAY, F.lit("2024-02-01").cast("timestamp"))
    return held.select("series", "start", "end", "s.kind", "s.k").withColumn("sec", iv.seconds("start", "end"))


def _of(spark, sf, kind):
    return _states(spark, sf).where(F.col("kind") == kind).select("series", "start", "end")


RANGE = "ts >= '2024-01-05' and ts < '2024-01-12'"


def src1(spark, sf):
    return samples(spark, sf).where(f"value is not null and {RANGE}").select("series", F.unix_micros("ts").alias("us"), "value")


def src2(spark, sf):
    s = samples(spark, sf)
    last = s.where("ts < '2024-01-05'").groupBy("series").agg(F.max_by(F.struct("ts", "value"), "ts").alias("r")).select("series", "r.*")
    return s.where(RANGE).select("series", "ts", "value").union(last).select("series", F.unix_micros("ts").alias("us"), "value")



def src6(spark, sf):
    s = samples(spark, sf).select("series", "kind", "ts", "seq")
    last = s.where("ts < '2024-01-05'").groupBy("series", "kind").agg(F.max_by("seq", "ts").alias("seq")).select("series", "kind", "seq")
    return s.where(RANGE).select("series", "kind", "seq").union(last)


def src13(spark, sf):
    have = samples(spark, sf).select("series", "ts", "seq", "value")
    come = have.where("seq % 3 = 0").withColumn("value", F.when(F.col("seq") % 6 == 0, F.col("value") + 1).otherwise(F.col("value")))
    old = have.select("series", "ts", F.col("value").alias("old"), F.lit(True).alias("known"))
    return come.join(old, ["series", "ts"], "left").where("known is null or not (value <=> old)").select("series", "seq", F.round("value", 6).alias("value"))



def prj6(spark, sf):
    flags = F.when(F.col("kind") == "click", "['CH','fl']").when(F.col("kind") == "view", "['ch']").when(F.col("kind") == "purchase", "['dhw','fl']").when(F.col("kind") == "error", "junk").otherwise("[]")
    inner = F.regexp_extract(flags, r"^\[(.*)\]$", 1)
    parsed = F.array_distinct(F.filter(F.transform(F.split(inner, ","), lambda x: F.lower(F.trim(F.regexp_replace(x, "'", "")))), lambda x: x != ""))
    ch, dhw = F.array_contains("flags", "ch"), F.array_contains("flags", "dhw")
    purpose = F.when(ch & dhw, "ambiguous").when(ch, "heating").when(dhw, "dhw").otherwise("idle")
    rows = samples(spark, sf).withColumn("flags", parsed).withColumn("purpose", purpose)
    return rows.groupBy("purpose", F.array_contains("flags", "fl").alias("flame")).agg(F.count("*").alias("n"))


def prj8(spark, sf):
    k = F.col("k").cast("int")
    return samples(spark, sf).select("seq", k.bitwiseAND(1).alias("mains"), F.shiftright(k, 6).bitwiseAND(1).alias("summer"), k.bitwiseAND(3).alias("register"))


def prj11(spark, sf):
    v = F.col("raw")
    return samples(spark, sf).select(F.when(v < 5, "cold").when(v < 15, "mild").otherwise("warm").alias("band"), F.floor(v / 2).alias("bin")).groupBy("band", "bin").agg(F.count("*").alias("n"))


def prj15(spark, sf):
    hourly = samples(spark, sf).withColumn("ts", F.date_trunc("day", "ts"))
    return iv.unknown_on_conflict(hourly, "series", "ts", "value").select("series", F.unix_micros("ts").alias("us"), "value")


def prj16(spark, sf):
    hourly = samples(spark, sf).withColumn("ts", F.date_trunc("day", "ts"))
    return iv.last_wins(hourly.select("series", "ts", "seq", "value"), "series", "ts", "seq").select("series", F.unix_micros("ts").alias("us"), "value")


def jn1(spark, sf):
    s = samples(spark, sf)
    right = s.where("kind = 'signup'").select("series", "ts", F.col("raw").alias("target"))
    return joins.as_of(s.where("kind <> 'signup'").select("series", "ts", "seq"), right, "series", "ts", "target").select("series", "seq", "target")


def jn2(spark, sf):
    s = samples(spark, sf)
    right = s.select("series", "ts", F.col("raw").alias("base"))
    return joins.as_of(s.where("kind = 'purchase'").select("series", "ts", "seq"), right, "series", "ts", "base", strict=True, ttl=6 * 3600.0).select("series", "seq", "base")


def jn3(spark, sf):
    s = samples(spark, sf)
    left = s.where("kind = 'view'").select("series", "ts", "seq")
    one = joins.as_of(left, s.where("kind = 'click'").select("series", "ts", F.col("raw").alias("a")), "series", "ts", "a", ttl=12 * 3600.0).drop("value_ts")
    two = joins.as_of(one, s.where("kind = 'purchase'").select("series", "ts", F.col("k").alias("b")), "series", "ts", "b", ttl=12 * 3600.0)
    return two.select("series", "seq", "a", "b")


def _held(spark, sf):
    return joins.hold(_segments(spark, sf), samples(spark, sf).where("kind = 'signup'").select("series", "ts", F.col("raw").alias("target")), "series", "ts", "target").withColumn("sec", iv.seconds("start", "end"))


def jn4(spark, sf):
    return _span(_held(spark, sf).select("series", "start", "end", "value", "target"))


def jn6(spark, sf):
    a, b = _of(spark, sf, "click"), _segments(spark, sf).where("value > 20").select("series", "start", "end", "value")
    met = iv.overlaps(a, b, "series", 3_600 * 6)
    sec = iv.seconds(F.greatest("start", "r_start"), F.least("end", "r_end"))
    return met.groupBy("series").agg(F.count("*").alias("pairs"), F.round(F.sum(sec), 6).alias("overlap_s"))


def jn7(spark, sf):
    s = samples(spark, sf).select("series", "ts", "seq", "raw", "kind")
    met = joins.within(s.where("kind = 'purchase'"), s.where("kind <> 'purchase'"), "series", "ts", 0, 6 * 3600.0)
    return met.groupBy("series", F.col("l_seq").alias("seq")).agg(F.count("*").alias("n"), F.max("r_raw").alias("peak"))


def jn8(spark, sf):
    s = samples(spark, sf).select("series", "ts", "seq", "kind")
    return _rounded(joins.nearest(s.where("kind = 'purchase'"), s.where("kind = 'signup'"), "series", "ts", "seq", 8 * 3600.0).select("series", F.col("l_seq").alias("seq"), "nearest_id", "gap_s"), "gap_s")


def jn17(spark, sf):
    s = samples(spark, sf).select("series", F.to_date("ts").alias("day"))
    spine = s.select("series").distinct().withColumn("day", F.explode(F.sequence(F.lit("2024-01-01").cast("date"), F.lit("2024-01-30").cast("date"))))
    return spine.join(s.distinct(), ["series", "day"], "left_anti").groupBy("series").agg(F.count("*").alias("missing_days"))


def iv1(spark, sf):
    return _rounded(_span(_segments(spark, sf)), "sec")


def iv4(spark, sf):
    return _rounded(_span(_states(spark, sf)).drop("k"), "sec")


def iv6(spark, sf):
    return iv.transitions(samples(spark, sf), "series", "ts", "kind").select("series", "seq", "kind")


def iv7(spark, sf):
    return _span(iv.merge(_states(spark, sf).where("kind in ('click', 'view')"), "series", 3_600.0))


def iv8(spark, sf):
    return _span(iv.subtract(_segments(spark, sf).select("series", "start", "end"), _of(spark, sf, "error"), "series"))


def iv10(spark, sf):
    return _span(iv.loss_restore(samples(spark, sf), "series", "ts", "kind", "purchase", "signup", "seq"))


def iv12(spark, sf):
    return _span(iv.gaps(samples(spark, sf), "series", "ts", 12 * 3600.0))


def iv16(spark, sf):
    shifted = samples(spark, sf).select("series", F.col("ts").alias("start"), F.timestamp_micros(F.unix_micros("ts") + (F.col("k") * 600_000_000).cast("long")).alias("end"))
    return iv.overlapping(shifted, "series").groupBy("series", "overlaps").agg(F.count("*").alias("n"))


def iv17(spark, sf):
    own = Window.partitionBy("series").orderBy("ts")
    rows = samples(spark, sf).withColumn("gap", iv.seconds("ts", F.lead("ts").over(own)))
    return rows.groupBy("series").agg((F.coalesce(F.max("gap"), F.lit(1e18)) <= 2 * DAY).alias("continuous"))


def iv18(spark, sf):
    days = iv.by_day(_states(spark, sf), "series").groupBy("series", "day").agg(F.round(F.sum("sec"), 6).alias("sec"))
    return days.withColumn("day", F.date_format("day", "yyyy-MM-dd"))


def ag1(spark, sf):
    out = metrics.comfort(_held(spark, sf), "series", "value", "target", 5.0)
    return _rounded(out, *[c for c in out.columns if c != "series"])


def ag2(spark, sf):
    runs = metrics.cycles(_states(spark, sf).withColumn("on", F.col("kind").isin("click", "view")), "series")
    return runs.groupBy("series").agg(F.count("*").alias("starts"), F.round(F.median("sec"), 6).alias("median_s"), F.round(F.sum("sec"), 6).alias("on_s"))


def ag3(spark, sf):
    out = metrics.quality(samples(spark, sf), "series", "ts", "value", F.lit("2024-01-01").cast("timestamp"), F.lit("2024-01-31").cast("timestamp"), 5.0, 2.0, slowest=6 * 3600.0)
    return _rounded(out, "max_gap_s", "covered_s", "stuck_pct", "coverage", "score")


def ag6(spark, sf):
    own = Window.partitionBy("series").orderBy("ts")
    rows = samples(spark, sf).where("value is not null").withColumn("gap", iv.seconds(F.lag("ts").over(own), "ts")).withColumn("step", F.abs(F.col("value") - F.lag("value").over(own)))
    agg = {"mean_gap": F.avg("gap"), "min_gap": F.min("gap"), "max_gap": F.max("gap"), "median_gap": F.median("gap"), "p90_gap": F.expr("percentile(gap, 0.9)"), "net_change": F.max_by("value", "ts") - F.min_by("value", "ts")}
    return rows.groupBy("series").agg(*[F.round(v, 6).alias(k) for k, v in agg.items()], F.sum(F.when(F.col("step") > 5, 1).otherwise(0)).alias("jumps"))


def ag7(spark, sf):
    part = lambda *kinds: F.round(metrics.share(F.coalesce(F.sum(F.when(F.col("kind").isin(*kinds), F.col("sec"))), F.lit(0.0)), F.sum("sec")), 6)
    return _states(spark, sf).where("kind <> 'error'").groupBy("series").agg(part("click", "view").alias("heating_pct"), part("purchase").alias("dhw_pct"), part("click", "purchase").alias("flame_pct"))


def ag10(spark, sf):
    return metrics.weighted_quantile(_segments(spark, sf), "series", "value", "sec", 0.9)


def ag13(spark, sf):
    return _segments(spark, sf).groupBy("series").agg(F.round(F.sum(F.greatest(F.lit(0.0), 18 - F.col("value")) * F.col("sec")) / 3600, 6).alias("degree_hours"))


def _exposure(spark, sf, cut):
    flame = F.when(F.col("kind") != "error", F.col("kind").isin("click", "purchase"))
    rows = iv.by_day(_states(spark, sf), "series").withColumn("flame", flame).withColumn("purpose", F.when(F.col("kind") == "purchase", "dhw").otherwise("heating"))
    rows = rows.withColumn("level", F.when(F.col("k") < 90, F.col("k"))).withColumn("period", F.date_format(cut, "yyyy-MM-dd"))
    out = metrics.exposure(rows, ["series", "period"], "level", "flame", "purpose")
    return _rounded(out, *[c for c in out.columns if c.endswith("_s")])


def ag14(spark, sf):
    return _exposure(spark, sf, F.col("day"))


def ag15(spark, sf):
    return _exposure(spark, sf, F.trunc("day", "week"))


def ag28(spark, sf):
    return samples(spark, sf).groupBy("series").agg(F.unix_micros(F.min("ts")).alias("first_us"), F.unix_micros(F.max("ts")).alias("last_us"), F.count("*").alias("n"))


def ev10(spark, sf):
    t = samples(spark, sf).where("kind = 'signup'").select("series", "ts", "seq", F.col("raw").alias("target"))
    rows = t.withColumn("was", F.lag("target").over(Window.partitionBy("series").orderBy("ts")))
    return rows.where("abs(target - was) > 0.01").select("series", "seq", F.round(F.col("target") - F.col("was"), 6).alias("delta"))


def ev19(spark, sf):
    o = load(spark, sf, "orders").select(F.col("o_custkey").alias("device"), "o_orderkey", "o_orderdate", "o_orderstatus")
    own = Window.partitionBy("device").orderBy("o_orderdate", "o_orderkey")
    rows = o.withColumn("before", F.lag("o_orderstatus").over(own)).withColumn("after_key", F.lag("o_orderkey").over(own))
    rows = rows.where("before is not null and before <> o_orderstatus")
    return rows.select("device", "after_key", F.col("o_orderkey").alias("no_later_key"), "before", F.col("o_orderstatus").alias("now"), F.row_number().over(own).alias("version"))


def gs1(spark, sf):
    d = load(spark, sf, "lineitem").groupBy("l_suppkey", "l_returnflag", F.to_date("l_shipdate").alias("day")).agg(F.sum("l_quantity").alias("q"))
    d = d.withColumn("reading", F.sum("q").over(Window.partitionBy("l_suppkey", "l_returnflag").orderBy("day")))
    out = metrics.meter_differences(d, ["l_suppkey", "l_returnflag"], "day", "reading")
    return out.select("l_suppkey", "l_returnflag", *[F.date_format(c, "yyyy-MM-dd").alias(f"{c}_day") for c in ("start", "end")], F.round("volume", 6).alias("volume"))


def gs12(spark, sf):
    month = lambda c: F.date_format(c, "yyyy-MM")
    use = load(spark, sf, "lineitem").groupBy(month("l_shipdate").alias("month")).agg(F.sum(F.col("l_quantity").cast("decimal(18,6)")).alias("volume"))
    tariff = load(spark, sf, "orders").groupBy(month("o_orderdate").alias("month"), F.quarter("o_orderdate").alias("q")).agg(F.round(F.avg("o_totalprice") / 1000, 4).cast("decimal(18,6)").alias("price"))
    tariff = tariff.withColumn("currency", F.when(F.col("q") % 2 == 1, "EUR").otherwise("USD"))
    out = use.join(tariff, "month", "left").withColumn("status", F.when(F.col("price").isNull(), "unknown").otherwise("available"))
    return out.groupBy("currency", "status").agg(F.count("*").alias("months"), F.round(F.sum(F.col("volume") * F.col("price")), 2).cast("double").alias("cost"))


def cp1(spark, sf):
    week = lambda a, b, n: samples(spark, sf).where(f"ts >= '{a}' and ts < '{b}'").groupBy("kind").agg(F.avg("raw").alias(n))
    both = week("2024-01-01", "2024-01-08", "before").join(week("2024-01-08", "2024-01-15", "after"), "kind", "full_outer")
    return both.select("kind", F.round(F.col("after") - F.col("before"), 6).alias("delta"), F.round(100 * F.try_divide(F.col("after") - F.col("before"), F.col("before")), 6).alias("relative_pct"))


def cp14(spark, sf):
    latest = Window.partitionBy("series", "kind").orderBy(F.desc("ts"), F.desc("seq"))
    return samples(spark, sf).where("ts < '2024-01-20'").withColumn("n", F.row_number().over(latest)).where("n = 1").select("series", "kind", "seq")


def sl1(spark, sf):
    rank = Window.partitionBy("series").orderBy(F.desc("ts"), F.desc("seq"))
    return samples(spark, sf).withColumn("n", F.row_number().over(rank)).where("n <= 3").select("series", "seq", "n")


def wf5(spark, sf):
    own = Window.partitionBy("series").orderBy(F.unix_seconds("ts")).rangeBetween(-DAY, 0)
    return samples(spark, sf).select("seq", F.round(F.max("raw").over(own), 6).alias("trailing_max"), F.count("*").over(own).alias("trailing_n"))


US = lambda *cs: ", ".join(f'epoch_us("{c}") AS "{c}"' for c in cs)
_TARGETS = ", t AS (SELECT series, ts, raw AS target FROM s WHERE kind = 'signup')"
PIECES = SEG + _TARGETS + """, cuts AS (SELECT series, "start" AS seg, "start" AS at FROM seg UNION SELECT seg.series, seg."start", t.ts FROM seg JOIN t ON t.series = seg.series AND t.ts > seg."start" AND t.ts < seg."end"),
p0 AS (SELECT c.series, c.at AS "start", least(seg."end", coalesce(lead(c.at) OVER (PARTITION BY c.series, c.seg ORDER BY c.at), seg."end")) AS "end", seg.value FROM cuts c JOIN seg ON seg.series = c.series AND seg."start" = c.seg),
pieces AS (SELECT p.*, t.target, (epoch_us(p."end") - epoch_us(p."start")) / 1e6 AS sec FROM p0 p ASOF LEFT JOIN t ON p.series = t.series AND p."start" >= t.ts)"""
DAYS = HELD + """, d AS (SELECT series, CAST(u.day AS DATE) AS day, kind, k, (epoch_us(least("end", u.day + INTERVAL 1 DAY)) - epoch_us(greatest("start", u.day))) / 1e6 AS sec
  FROM held, unnest(generate_series(date_trunc('day', "start"), "end" - INTERVAL 1 MICROSECOND, INTERVAL 1 DAY)) AS u(day))"""


def _exposure_sql(period):
    f = "kind IN ('click', 'purchase')"
    b = [f"k >= {25 * i} AND k < {25 * (i + 1)} AND k < 90" if i < 3 else "k >= 75 AND k < 90" for i in range(4)]
    total = lambda c, n: f"round(coalesce(sum(CASE WHEN {f} AND {c} THEN sec END), 0), 6) AS {n}"
    bins = ", ".join(total(c, f"bin_{i}_s") for i, c in enumerate(b))
    return DAYS + f"""SELECT series, strftime({period}, '%Y-%m-%d') AS period, {bins}, {total("k >= 90", "bin_unknown_s")},
    round(coalesce(sum(CASE WHEN kind <> 'error' THEN sec END), 0), 6) AS observed_s, {total("kind = 'click'", "heating_s")}, {total("kind = 'purchase'", "dhw_s")} FROM d GROUP BY 1, 2"""


def _merge_sql(source, tolerance):
    return f"""m0 AS (SELECT *, max("end") OVER (PARTITION BY series ORDER BY "start", "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM {source}),
m1 AS (SELECT *, sum(CASE WHEN reach IS NULL OR epoch_us("start") - epoch_us(reach) > {tolerance}e6 THEN 1 ELSE 0 END) OVER (PARTITION BY series ORDER BY "start", "end" ROWS UNBOUNDED PRECEDING) AS isl FROM m0)
SELECT series, epoch_us(min("start")) AS "start", epoch_us(max("end")) AS "end" FROM m1 GROUP BY series, isl"""


WHEN = lambda c, v="sec": f"coalesce(sum(CASE WHEN {c} THEN {v} END), 0)"

QUERIES = {
    "SRC1_range_read": (src1, S + f"SELECT series, epoch_us(ts) AS us, value FROM s WHERE value IS NOT NULL AND {RANGE}"),
    "SRC2_with_predecessor": (src2, S + f"SELECT series, epoch_us(ts) AS us, value FROM s WHERE {RANGE} UNION ALL SELECT series, epoch_us(max(ts)), arg_max(struct_pack(v := value), ts).v FROM s WHERE ts < '2024-01-05' GROUP BY series"),
    "SRC6_events_with_predecessors": (src6, S + f"SELECT series, kind, seq FROM s WHERE {RANGE} UNION ALL SELECT series, kind, arg_max(seq, ts) FROM s WHERE ts < '2024-01-05' GROUP BY series, kind"),
    "SRC13_changed_rows": (src13, S + ", i AS (SELECT *, CASE WHEN seq % 6 = 0 THEN value + 1 ELSE value END AS v2 FROM s WHERE seq % 3 = 0) SELECT i.series, i.seq, round(v2, 6) AS value FROM i LEFT JOIN s USING (series, ts) WHERE s.seq IS NULL OR v2 IS DISTINCT FROM s.value"),
    "PRJ6_purpose": (prj6, S + "SELECT CASE WHEN kind IN ('click', 'view') THEN 'heating' WHEN kind = 'purchase' THEN 'dhw' ELSE 'idle' END AS purpose, kind IN ('click', 'purchase') AS flame, count(*) AS n FROM s GROUP BY 1, 2"),
    "PRJ8_bit_flags": (prj8, S + "SELECT seq, CAST(k AS INT) & 1 AS mains, (CAST(k AS INT) >> 6) & 1 AS summer, CAST(k AS INT) & 3 AS register FROM s"),
    "PRJ11_bands": (prj11, S + "SELECT CASE WHEN raw < 5 THEN 'cold' WHEN raw < 15 THEN 'mild' ELSE 'warm' END AS band, CAST(floor(raw / 2) AS BIGINT) AS bin, count(*) AS n FROM s GROUP BY 1, 2"),
    "PRJ15_conflicts_unknown": (prj15, S + "SELECT series, epoch_us(date_trunc('day', ts)) AS us, CASE WHEN count(value) = count(*) AND min(value) = max(value) THEN min(value) END AS value FROM s GROUP BY 1, 2"),
    "PRJ16_last_wins": (prj16, S + "SELECT series, epoch_us(date_trunc('day', ts)) AS us, arg_max(struct_pack(v := value), seq).v AS value FROM s GROUP BY 1, 2"),
    "JN1_as_of": (jn1, S + _TARGETS + " SELECT a.series, a.seq, t.target FROM (SELECT * FROM s WHERE kind <> 'signup') a ASOF LEFT JOIN t ON a.series = t.series AND a.ts >= t.ts"),
    "JN2_as_of_strict": (jn2, S + " SELECT a.series, a.seq, CASE WHEN epoch_us(a.ts) - epoch_us(b.ts) <= 21600e6 THEN b.raw END AS base FROM (SELECT * FROM s WHERE kind = 'purchase') a ASOF LEFT JOIN s b ON a.series = b.series AND a.ts > b.ts"),
    "JN3_as_of_ttl": (jn3, S + """ SELECT a.series, a.seq, CASE WHEN epoch_us(a.ts) - epoch_us(b.ts) <= 43200e6 THEN b.raw END AS a, CASE WHEN epoch_us(a.ts) - epoch_us(c.ts) <= 43200e6 THEN c.k END AS b
FROM (SELECT * FROM s WHERE kind = 'view') a ASOF LEFT JOIN (SELECT * FROM s WHERE kind = 'click') b ON a.series = b.series AND a.ts >= b.ts ASOF LEFT JOIN (SELECT * FROM s WHERE kind = 'purchase') c ON a.series = c.series AND a.ts >= c.ts"""),
    "JN4_setpoint_hold": (jn4, PIECES + f"SELECT series, {US('start', 'end')}, value, target FROM pieces"),
    "JN6_overlap_join": (jn6, HELD + SEG[len(S):] + """ SELECT a.series, count(*) AS pairs, round(sum((epoch_us(least(a."end", b."end")) - epoch_us(greatest(a."start", b."start"))) / 1e6), 6) AS overlap_s FROM held a JOIN seg b ON a.series = b.series AND a."start" < b."end" AND a."end" > b."start" WHERE a.kind = 'click' AND b.value > 20 GROUP BY a.series"""),
    "JN7_range_join": (jn7, S + " SELECT a.series, a.seq, count(*) AS n, max(b.raw) AS peak FROM s a JOIN s b ON a.series = b.series AND epoch_us(b.ts) - epoch_us(a.ts) BETWEEN 0 AND 21600000000 WHERE a.kind = 'purchase' AND b.kind <> 'purchase' GROUP BY 1, 2"),
    "JN8_nearest": (jn8, S + " SELECT series, seq, nearest_id, round(g, 6) AS gap_s FROM (SELECT a.series, a.seq, b.seq AS nearest_id, abs(epoch_us(b.ts) - epoch_us(a.ts)) / 1e6 AS g, row_number() OVER (PARTITION BY a.series, a.seq ORDER BY abs(epoch_us(b.ts) - epoch_us(a.ts)), b.ts, b.seq) AS n FROM s a JOIN s b ON a.series = b.series AND abs(epoch_us(b.ts) - epoch_us(a.ts)) <= 28800000000 WHERE a.kind = 'purchase' AND b.kind = 'signup') WHERE n = 1"),
    "JN17_missing_days": (jn17, S + " SELECT x.series, count(*) AS missing_days FROM (SELECT DISTINCT series FROM s) x, generate_series(TIMESTAMP '2024-01-01', TIMESTAMP '2024-01-30', INTERVAL 1 DAY) g(d) WHERE NOT EXISTS (SELECT 1 FROM s WHERE s.series = x.series AND date_trunc('day', s.ts) = g.d) GROUP BY 1"),
    "IV1_segments": (iv1, SEG + f"SELECT series, {US('start', 'end')}, value, round(sec, 6) AS sec FROM seg"),
    "IV4_held_states": (iv4, HELD + f"SELECT series, {US('start', 'end')}, kind, round(sec, 6) AS sec FROM held"),
    "IV6_transitions": (iv6, S + "SELECT series, seq, kind FROM (SELECT *, row_number() OVER w AS n, lag(kind) OVER w AS was FROM s WINDOW w AS (PARTITION BY series ORDER BY ts)) WHERE n = 1 OR kind IS DISTINCT FROM was"),
    "IV7_merge": (iv7, HELD + ", src AS (SELECT * FROM held WHERE kind IN ('click', 'view')), " + _merge_sql("src", 3600)),
    "IV8_subtract": (iv8, HELD + SEG[len(S):] + """, e AS (SELECT series, "start" AS tm, 1 AS a, 0 AS b FROM seg UNION ALL SELECT series, "end", -1, 0 FROM seg UNION ALL SELECT series, "start", 0, 1 FROM held WHERE kind = 'error' UNION ALL SELECT series, "end", 0, -1 FROM held WHERE kind = 'error'),
e2 AS (SELECT series, tm, sum(a) AS a, sum(b) AS b FROM e GROUP BY 1, 2), e3 AS (SELECT series, tm AS "start", lead(tm) OVER w AS "end", sum(a) OVER w AS a, sum(b) OVER w AS b FROM e2 WINDOW w AS (PARTITION BY series ORDER BY tm)),
src AS (SELECT * FROM e3 WHERE a > 0 AND b = 0 AND "end" IS NOT NULL), """ + _merge_sql("src", 0)),
    "IV10_loss_restore": (iv10, S + """, x AS (SELECT *, lag(kind) OVER w AS was FROM s WHERE kind IN ('purchase', 'signup') WINDOW w AS (PARTITION BY series ORDER BY ts)), y AS (SELECT *, lead(ts) OVER (PARTITION BY series ORDER BY ts, seq) AS nxt FROM x WHERE was IS DISTINCT FROM kind)
SELECT series, epoch_us(ts) AS "start", epoch_us(nxt) AS "end" FROM y WHERE kind = 'purchase'"""),
    "IV12_gaps": (iv12, S + """ SELECT series, epoch_us(ts) + 43200000000 AS "start", epoch_us(nxt) AS "end" FROM (SELECT *, lead(ts) OVER (PARTITION BY series ORDER BY ts) AS nxt FROM s) WHERE epoch_us(nxt) - epoch_us(ts) > 43200000000"""),
    "IV16_overlapping": (iv16, S + """ SELECT series, coalesce(b > st, false) OR coalesce(a < en, false) AS overlaps, count(*) AS n FROM (SELECT *, lag(en) OVER w AS b, lead(st) OVER w AS a FROM (SELECT series, epoch_us(ts) AS st, epoch_us(ts) + CAST(k * 600000000 AS BIGINT) AS en FROM s) WINDOW w AS (PARTITION BY series ORDER BY st, en)) GROUP BY 1, 2"""),
    "IV17_continuity": (iv17, S + " SELECT series, coalesce(max(gap), 1e18) <= 172800 AS continuous FROM (SELECT series, (epoch_us(lead(ts) OVER (PARTITION BY series ORDER BY ts)) - epoch_us(ts)) / 1e6 AS gap FROM s) GROUP BY 1"),
    "IV18_day_slices": (iv18, DAYS + "SELECT series, strftime(day, '%Y-%m-%d') AS day, round(sum(sec), 6) AS sec FROM d WHERE sec > 0 GROUP BY 1, 2"),
    "AG1_comfort": (ag1, PIECES + f"""SELECT series, round(sum(value * sec) / sum(sec), 6) AS mean, min(value) AS low, max(value) AS high, round(sum(sec), 6) AS observed_s, round({WHEN('target IS NOT NULL')}, 6) AS evaluated_s,
round(100 * {WHEN('abs(value - target) <= 5')} / nullif(sum(CASE WHEN target IS NOT NULL THEN sec END), 0), 6) AS in_band_pct, round(100 * {WHEN('value - target > 5')} / nullif(sum(CASE WHEN target IS NOT NULL THEN sec END), 0), 6) AS above_pct,
round(100 * {WHEN('value - target < -5')} / nullif(sum(CASE WHEN target IS NOT NULL THEN sec END), 0), 6) AS below_pct, round(sum(abs(value - target) * sec) / nullif(sum(CASE WHEN target IS NOT NULL THEN sec END), 0), 6) AS mean_abs_error,
round({WHEN('value > target', '(value - target) * sec')} / 3600, 6) AS degree_hours_above, round({WHEN('value < target', '(target - value) * sec')} / 3600, 6) AS degree_hours_below,
round(sum((value - target) * sec) FILTER (value > target) / sum(sec) FILTER (value > target), 6) AS mean_error_above, round(sum((target - value) * sec) FILTER (value < target) / sum(sec) FILTER (value < target), 6) AS mean_error_below,
round(100 * {WHEN('target IS NOT NULL')} / sum(sec), 6) AS evaluation_pct FROM pieces GROUP BY series"""),
    "AG2_cycles": (ag2, HELD + """, x AS (SELECT *, kind IN ('click', 'view') AS on_ FROM held), y AS (SELECT *, CASE WHEN on_ = lag(on_) OVER w AND "start" = lag("end") OVER w THEN 0 ELSE 1 END AS nw FROM x WINDOW w AS (PARTITION BY series ORDER BY "start")),
z AS (SELECT *, sum(nw) OVER (PARTITION BY series ORDER BY "start") AS run FROM y), r AS (SELECT series, run, on_, min("start") AS a, max("end") AS b FROM z GROUP BY 1, 2, 3),
q AS (SELECT *, lead(a) OVER w AS na, lead(on_) OVER w AS no FROM r WINDOW w AS (PARTITION BY series ORDER BY a))
SELECT series, count(*) AS starts, round(median((epoch_us(b) - epoch_us(a)) / 1e6), 6) AS median_s, round(sum((epoch_us(b) - epoch_us(a)) / 1e6), 6) AS on_s FROM q WHERE on_ AND na = b AND NOT no GROUP BY series"""),
    "AG3_quality": (ag3, S + """, x AS (SELECT *, nullif((epoch_us(lead(ts) OVER w) - epoch_us(ts)) / 1e6, 0) AS gap, lead(value) OVER w AS after FROM s WHERE value IS NOT NULL AND ts BETWEEN '2024-01-01' AND '2024-01-31' WINDOW w AS (PARTITION BY series ORDER BY ts)),
c AS (SELECT series, greatest(60.0, 2.5 * least(21600.0, coalesce(CASE WHEN count(gap) >= 10 THEN median(gap) ELSE least(median(gap), 3 * min(gap)) END, 2592000.0))) AS cap FROM x GROUP BY 1),
y AS (SELECT series, count(*) AS samples, max(gap) AS worst, any_value(cap) AS cap, coalesce(sum(least(gap, cap)) FILTER (gap IS NOT NULL), 0) AS covered_s, coalesce(sum(gap) FILTER (after = value AND gap <= cap), 0) AS stuck, count(*) FILTER (abs(after - value) > 5 AND abs(after - value) / gap * 3600 > 2) AS jumps FROM x JOIN c USING (series) GROUP BY 1),
z AS (SELECT *, least(1.0, covered_s / 2592000.0) AS cover, CASE WHEN samples < 2 THEN 2592000.0 ELSE coalesce(worst, 2592000.0) END AS gap FROM y)
SELECT series, samples, round(gap, 6) AS max_gap_s, round(covered_s, 6) AS covered_s, round(least(100.0, 100 * stuck / greatest(covered_s, 1)), 6) AS stuck_pct, jumps, round(cover, 6) AS coverage, round(cover * (1 - 0.25 * least(1.0, jumps / 5.0)), 6) AS score,
CASE WHEN samples < 2 THEN 'insufficient_samples' ELSE concat_ws(',', CASE WHEN cover < 0.7 THEN 'low_coverage' END, CASE WHEN gap > cap THEN 'large_gap' END, CASE WHEN jumps > 0 THEN 'implausible_jumps' END) END AS flags FROM z"""),
    "AG6_cadence": (ag6, S + """, x AS (SELECT *, (epoch_us(ts) - epoch_us(lag(ts) OVER w)) / 1e6 AS gap, abs(value - lag(value) OVER w) AS step FROM s WHERE value IS NOT NULL WINDOW w AS (PARTITION BY series ORDER BY ts))
SELECT series, round(avg(gap), 6) AS mean_gap, round(min(gap), 6) AS min_gap, round(max(gap), 6) AS max_gap, round(median(gap), 6) AS median_gap, round(quantile_cont(gap, 0.9), 6) AS p90_gap, round(arg_max(value, ts) - arg_min(value, ts), 6) AS net_change, CAST(sum(CASE WHEN step > 5 THEN 1 ELSE 0 END) AS BIGINT) AS jumps FROM x GROUP BY series"""),
    "AG7_state_shares": (ag7, HELD + f"""SELECT series, round(100 * {WHEN("kind IN ('click', 'view')")} / sum(sec), 6) AS heating_pct, round(100 * {WHEN("kind = 'purchase'")} / sum(sec), 6) AS dhw_pct, round(100 * {WHEN("kind IN ('click', 'purchase')")} / sum(sec), 6) AS flame_pct FROM held WHERE kind <> 'error' GROUP BY series"""),
    "AG10_weighted_quantile": (ag10, SEG + """, x AS (SELECT *, sum(sec) OVER (PARTITION BY series ORDER BY value, sec ROWS UNBOUNDED PRECEDING) AS c, sum(sec) OVER (PARTITION BY series) AS t FROM seg) SELECT series, min(value) AS quantile FROM x WHERE c >= 0.9 * t GROUP BY series"""),
    "AG13_degree_hours": (ag13, SEG + "SELECT series, round(sum(greatest(0, 18 - value) * sec) / 3600, 6) AS degree_hours FROM seg GROUP BY series"),
    "AG14_exposure_days": (ag14, _exposure_sql("day")),
    "AG15_exposure_weeks": (ag15, _exposure_sql("date_trunc('week', day)")),
    "AG28_sample_bounds": (ag28, S + "SELECT series, epoch_us(min(ts)) AS first_us, epoch_us(max(ts)) AS last_us, count(*) AS n FROM s GROUP BY series"),
    "EV10_control_changes": (ev10, S + "SELECT series, seq, round(raw - was, 6) AS delta FROM (SELECT *, lag(raw) OVER (PARTITION BY series ORDER BY ts) AS was FROM s WHERE kind = 'signup') WHERE abs(raw - was) > 0.01"),
    "EV19_settings_versions": (ev19, """SELECT device, after_key, o_orderkey AS no_later_key, before, o_orderstatus AS now, row_number() OVER (PARTITION BY device ORDER BY o_orderdate, o_orderkey) AS version
FROM (SELECT *, o_custkey AS device, lag(o_orderstatus) OVER w AS before, lag(o_orderkey) OVER w AS after_key FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)) WHERE before <> o_orderstatus"""),
    "GS1_meter_differences": (gs1, """WITH d AS (SELECT l_suppkey, l_returnflag, CAST(l_shipdate AS DATE) AS day, sum(l_quantity) AS q FROM lineitem GROUP BY 1, 2, 3), r AS (SELECT *, sum(q) OVER (PARTITION BY l_suppkey, l_returnflag ORDER BY day) AS reading FROM d),
x AS (SELECT *, lag(day) OVER w AS p, reading - lag(reading) OVER w AS volume FROM r WINDOW w AS (PARTITION BY l_suppkey, l_returnflag ORDER BY day))
SELECT l_suppkey, l_returnflag, strftime(p, '%Y-%m-%d') AS start_day, strftime(day, '%Y-%m-%d') AS end_day, round(volume, 6) AS volume FROM x WHERE p IS NOT NULL AND volume >= 0"""),
    "GS12_month_cost": (gs12, """WITH u AS (SELECT strftime(l_shipdate, '%Y-%m') AS month, sum(CAST(l_quantity AS DECIMAL(18,6))) AS volume FROM lineitem GROUP BY 1),
t AS (SELECT strftime(o_orderdate, '%Y-%m') AS month, CASE WHEN quarter(o_orderdate) % 2 = 1 THEN 'EUR' ELSE 'USD' END AS currency, round(avg(o_totalprice) / 1000, 4) AS price FROM orders GROUP BY 1, 2)
SELECT currency, CASE WHEN price IS NULL THEN 'unknown' ELSE 'available' END AS status, count(*) AS months, round(sum(CAST(volume AS DOUBLE) * price), 2) AS cost FROM u LEFT JOIN t USING (month) GROUP BY 1, 2"""),
    "CP1_metric_delta": (cp1, S + """, a AS (SELECT kind, avg(raw) AS v FROM s WHERE ts >= '2024-01-01' AND ts < '2024-01-08' GROUP BY 1), b AS (SELECT kind, avg(raw) AS v FROM s WHERE ts >= '2024-01-08' AND ts < '2024-01-15' GROUP BY 1)
SELECT kind, round(b.v - a.v, 6) AS delta, round(100 * (b.v - a.v) / nullif(a.v, 0), 6) AS relative_pct FROM a FULL JOIN b USING (kind)"""),
    "CP14_latest_action": (cp14, S + "SELECT series, kind, seq FROM (SELECT *, row_number() OVER (PARTITION BY series, kind ORDER BY ts DESC, seq DESC) AS n FROM s WHERE ts < '2024-01-20') WHERE n = 1"),
    "SL1_latest": (sl1, S + "SELECT series, seq, n FROM (SELECT *, row_number() OVER (PARTITION BY series ORDER BY ts DESC, seq DESC) AS n FROM s) WHERE n <= 3"),
    "WF5_trailing": (wf5, S + "SELECT seq, round(max(raw) OVER w, 6) AS trailing_max, count(*) OVER w AS trailing_n FROM s WINDOW w AS (PARTITION BY series ORDER BY epoch_us(ts) // 1000000 RANGE BETWEEN 86400 PRECEDING AND CURRENT ROW)"),
}
QUERIES = {k: (q, sql.replace(")SELECT", ") SELECT") if sql else sql) for k, (q, sql) in QUERIES.items()}
