"""Ingest, naming and selection queries over the given tables, in the roles of
``telemetry``; customers are the series catalogue (nation: device, segment: unit)."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from spanwise.operators import decode, intervals as iv, naming
from spanwise.plans.telemetry import RANGE, S, samples
from spanwise.session import load, new_path

CAT = S + ", cat AS (SELECT c_custkey AS series, c_nationkey AS device, nullif(c_mktsegment, 'MACHINERY') AS unit FROM customer)"
DAY = CAT + ", day AS (SELECT series, CAST(ts AS DATE) AS day, count(*) AS n, round(avg(value), 6) AS mean FROM s GROUP BY 1, 2)"


def catalogue(spark, sf):
    return load(spark, sf, "customer").select(F.col("c_custkey").alias("series"), F.col("c_nationkey").alias("device"), F.nullif("c_mktsegment", F.lit("MACHINERY")).alias("unit"))


def day_facts(spark, sf):
    return samples(spark, sf).groupBy("series", F.to_date("ts").alias("day")).agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean"))


def _text(df):
    return df.withColumn("day", F.date_format("day", "yyyy-MM-dd"))


def src3(spark, sf):
    return samples(spark, sf).where(f"kind <> 'error' and {RANGE}").select("series", F.unix_micros("ts").alias("us"), "kind")


def src4(spark, sf):
    rows = samples(spark, sf).where("value is not null").select("series", "ts")
    return rows.join(catalogue(spark, sf).select("series", "device"), "series").select("device", F.unix_micros("ts").alias("us")).distinct()


def src5(spark, sf):
    s = samples(spark, sf).where(RANGE).join(catalogue(spark, sf).select("series", "device"), "series")
    event = F.col("kind").isin("purchase", "signup")
    return s.select("device", "series", F.unix_micros("ts").alias("us"), F.when(event, F.lit("event")).otherwise("sample").alias("what"), F.when(~event, F.col("value")).alias("value"))


def src7(spark, sf):
    return _text(day_facts(spark, sf).where("day >= '2024-01-10' and day < '2024-01-20' and series < 50"))


def src8(spark, sf):
    return _text(decode.spread(day_facts(spark, sf), "series", "day", 5).select("series", "day"))


def _encoded(spark, sf):
    """Times of a series' days as marker arrays: absolute first, then forward
    deltas below zero; every seventh series lacks the absolute marker."""
    own = Window.partitionBy("series", "day").orderBy("s", "seq")
    rows = samples(spark, sf).select("series", "seq", F.to_date("ts").alias("day"), F.unix_seconds("ts").alias("s"))
    rows = rows.withColumn("was", F.lag("s").over(own)).withColumn("pos", F.row_number().over(own))
    absolute = F.col("was").isNull() | (F.col("was") == F.col("s")) | (F.col("pos") % 3 == 0)
    marker = F.when((F.col("series") % 7 == 3) & F.col("was").isNull(), F.lit(-1)).when(absolute, F.col("s")).otherwise(F.col("was") - F.col("s"))
    return rows.groupBy("series", "day").agg(F.array_sort(F.collect_list(F.struct("pos", marker.alias("m"), "seq"))).alias("a"))


def src9(spark, sf):
    a = _encoded(spark, sf).select("series", "day", F.transform("a", lambda x: F.struct(x["m"].alias("marker"), x["seq"].alias("value"))).alias("points"))
    return decode.delta_times(a, ["series", "day"], "points").select("series", F.col("value").alias("seq"), "at_s")


def src10(spark, sf):
    flags = F.when(F.col("kind") == "click", F.lit("ch,fl")).when(F.col("kind") == "purchase", "dhw,fl").when(F.col("kind") == "view", "ch").when(F.col("kind") == "signup", "")
    return decode.with_derived_flame(samples(spark, sf).select("series", "seq", "kind", F.col("value").alias("num"), flags.alias("flags")), ["series", "seq"], "kind", "num", "flags")


def src11(spark, sf):
    rows = samples(spark, sf).where(F.col("kind").isin("purchase", "signup"))
    body = F.concat_ws("|", "kind", F.col("series").cast("string"), F.unix_micros("ts").cast("string"), F.col("k").cast("int").cast("string"))
    return rows.select("seq", F.sha2(body, 256).alias("id"), F.when(F.col("kind") == "purchase", "loss").otherwise("restore").alias("family"))


def src12(spark, sf):
    rows = samples(spark, sf).withColumn("details", F.create_map(F.lit("k"), F.col("k").cast("int").cast("string"), F.lit("auth.token"), F.col("seq").cast("string"), F.lit("Owner_Phone"), F.col("series").cast("string")))
    masked = decode.redacted("details")
    return rows.select("seq", *[masked[c].alias(n) for c, n in (("k", "k"), ("auth.token", "token"), ("Owner_Phone", "phone"))])


def src14(spark, sf):
    have = samples(spark, sf).select("seq", "ts")
    come = have.where("seq % 5 = 0").withColumn("ts", F.when(F.col("seq") % 10 == 0, F.col("ts") + F.expr("interval 1 hour")).otherwise(F.col("ts")))
    return decode.moved(have, come, "seq", "ts").select("seq", F.unix_micros("ts").alias("us"))


def src15(spark, sf):
    rows = samples(spark, sf).select("series", "ts", F.when(F.col("seq") % 3 == 0, F.col("kind")).alias("unit"))
    return rows.groupBy("series").agg(F.unix_micros(F.min("ts")).alias("first_us"), F.min_by("unit", F.when(F.col("unit").isNotNull(), F.col("ts"))).alias("unit"))


def src16(spark, sf):
    """Only the projection without runtime fields and with sorted capabilities counts."""
    o = load(spark, sf, "orders").select(F.col("o_custkey").alias("device"), F.col("o_orderkey").alias("id"), F.struct("o_orderdate", "o_orderkey").alias("at"),
        F.sha2(F.concat_ws("|", "o_orderstatus", F.array_join(F.array_sort(F.array(F.lit("heat"), F.col("o_orderpriority"))), ",")), 256).alias("fingerprint"))
    return iv.transitions(o, "device", "at", "fingerprint").select("device", "id", "fingerprint")


def src17(spark, sf):
    rank = F.when(F.col("kind") == "purchase", 3).when(F.col("kind") == "signup", 2).when(F.col("kind") == "error", 0).otherwise(1)
    g = samples(spark, sf).groupBy("series", F.to_date("ts").alias("day")).agg(F.max(rank).alias("rank"))
    state = F.element_at(F.array(*map(F.lit, ("failed", "unavailable", "empty", "complete"))), F.col("rank") + 1)
    cursor = F.max(F.when(F.col("rank") >= 2, F.date_add("day", 1))).over(Window.partitionBy("series"))
    return _text(g.select("series", "day", state.alias("state"), F.date_format(cursor, "yyyy-MM-dd").alias("cursor")))


def src18(spark, sf):
    """Facts by day; a second run replaces the days it computed and no other."""
    path = new_path(spark, "day-facts")
    day_facts(spark, sf).withColumn("version", F.lit(1)).write.partitionBy("day").parquet(path)
    again = day_facts(spark, sf).where("day >= '2024-01-20'").withColumn("version", F.lit(2))
    again.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(path)
    return _text(spark.read.parquet(path).select("series", F.col("day").cast("date").alias("day"), "n", "mean", "version"))


_SOURCES = ("z3k_radio_sensor", "z3k_boiler_adapter", "z3k_heating_circuit", "z3k_temperature")
_METRICS = ("temperature", "humidity", "battery", "dbm", "flags", "ot", "bt", "rwt", "dt", "cs", "rml", "wp", "fr", "target_temp", "worktime", "mode_id", "status", "burner_state", "duty_percent", "runtime_s", "note", "setpoint_temp")
_NAMES = ("Hot water", "Room", "Outdoor", "Boiler room", "Kitchen", "ГВС", "Отопление", "Обратка", "Спальня")


def _entities(spark, sf):
    pick = lambda names, n: F.element_at(F.array(*map(F.lit, names)), (n % len(names)).cast("int") + 1)
    return samples(spark, sf).select("seq", pick(_SOURCES, F.col("seq")).alias("source"), F.col("series").alias("entity"), pick(_METRICS, F.col("k")).alias("metric"), pick(_NAMES, F.col("series")).alias("name"))


_pick_sql = lambda names, n: f"[{', '.join(repr(x) for x in names)}][CAST({n} % {len(names)} AS INT) + 1]"
ENT = S + f", e AS (SELECT seq, {_pick_sql(_SOURCES, 'seq')} AS source, series AS entity, {_pick_sql(_METRICS, 'k')} AS metric, {_pick_sql(_NAMES, 'series')} AS name FROM s)"


def prj1(spark, sf):
    return naming.units(_entities(spark, sf)).select("seq", "unit")


def prj2(spark, sf):
    return naming.roles(_entities(spark, sf)).select("seq", "role", "confidence")


def prj3(spark, sf):
    linked = F.when(F.col("seq") % 4 == 1, F.lit("room_temperature"))
    override = F.when(F.col("seq") % 6 == 1, F.lit("outdoor_temperature"))
    return naming.roles(_entities(spark, sf)).select("seq", naming.resolved(linked, override, F.col("metric").contains("temp")).alias("x")).select("seq", "x.*")


def prj4(spark, sf):
    return naming.setpoints(_entities(spark, sf)).where("setpoint").groupBy("source", "metric").agg(F.count("*").alias("n"))


def prj5(spark, sf):
    text = F.when(F.col("kind") == "click", "['CH', 'fl','ch']").when(F.col("kind") == "view", "[]").when(F.col("kind") == "purchase", "['dhw' ,'FL']").when(F.col("kind") == "error", "junk")
    return samples(spark, sf).withColumn("flags", F.array_join(decode.flags(text), "+")).groupBy("kind", "flags").agg(F.count("*").alias("n"))


def jn18(spark, sf):
    have = samples(spark, sf).select("series", "seq", "value")
    come = have.withColumn("value", F.when(F.col("seq") % 4 == 0, F.col("value") + 1).when(F.col("seq") % 9 == 0, F.lit(None)).otherwise(F.col("value")))
    same = (F.col("a.series") == F.col("b.series")) & (F.col("a.seq") == F.col("b.seq")) & F.col("a.value").eqNullSafe(F.col("b.value"))
    return come.alias("a").join(have.alias("b"), same, "left_anti").select("series", "seq", F.round("value", 6).alias("value"))


def jn19(spark, sf):
    """Manual values over automatic ones; a reset falls back to the latest automatic."""
    rows = samples(spark, sf).withColumn("src", F.when(F.col("kind") == "signup", "manual").when(F.col("kind") == "error", "reset").otherwise("auto"))
    own = Window.partitionBy("series").orderBy("ts", "seq").rowsBetween(Window.unboundedPreceding, 0)
    manual = F.last(F.when(F.col("src") != "auto", F.struct(F.when(F.col("src") == "manual", F.col("raw")).alias("v"))), ignorenulls=True).over(own)
    auto = F.last(F.when(F.col("src") == "auto", F.col("raw")), ignorenulls=True).over(own)
    return rows.select("series", "seq", F.coalesce(manual["v"], auto).alias("value"))


def jn20(spark, sf):
    """Cited references against those known: of one device, by kinds of its days."""
    s = samples(spark, sf).join(catalogue(spark, sf).select("series", "device"), "series")
    g = s.groupBy("device").agg(F.array_sort(F.collect_set(F.when(F.col("ts") < "2024-01-03", F.concat_ws(":", "kind", (F.col("k") % 4).cast("int").cast("string"))))).alias("cited"),
                                F.array_sort(F.collect_set(F.when(F.col("ts") >= "2024-01-29", F.concat_ws(":", "kind", (F.col("k") % 4).cast("int").cast("string"))))).alias("known"))
    return g.select("device", F.array_join(F.array_except("cited", "known"), ",").alias("unknown"), F.array_join(F.array_except("known", "cited"), ",").alias("missing"), F.size(F.array_intersect("cited", "known")).alias("valid"))


def sl2(spark, sf):
    s = samples(spark, sf).where("value is not null")
    return s.groupBy("series").agg(F.max_by("seq", F.struct("value", -F.col("seq"))).alias("warmest"), F.min_by("seq", F.struct("value", "seq")).alias("coldest"))


def sl4(spark, sf):
    """At most six days of a series, spread evenly over the order of their means."""
    d = day_facts(spark, sf).where("mean is not null").withColumn("order", F.struct("mean", "day"))
    return _text(decode.spread(d, "series", "order", 6).select("series", "day"))


def so2(spark, sf):
    s = samples(spark, sf).select("series", (F.col("k") / 10).cast("int").alias("stratum"), (F.col("ts") < "2024-01-16").alias("early"))
    return s.where("early").select("series", "stratum").intersect(s.where("not early").select("series", "stratum"))


def so3(spark, sf):
    days = samples(spark, sf).select("series", F.to_date("ts").alias("day")).distinct()
    span = days.groupBy("series").agg(F.explode(F.sequence(F.min("day"), F.max("day"))).alias("day"))
    return _text(span.exceptAll(days))


def so4(spark, sf):
    """One row a key; keys whose rows differ are conflicts, not silently one of them."""
    g = samples(spark, sf).groupBy("series", F.to_date("ts").alias("day")).agg(F.count_distinct("kind").alias("kinds"), F.min("kind").alias("kind"))
    return _text(g.select("series", "day", F.when(F.col("kinds") == 1, F.col("kind")).alias("kind"), (F.col("kinds") > 1).alias("conflict")))


def wf1(spark, sf):
    w = Window.partitionBy("series").orderBy("ts", "seq")
    rows = samples(spark, sf).select("series", "seq", "kind", *[F.lead("kind", i).over(w).alias(f"k{i}") for i in (1, 2, 3)])
    return rows.where("kind = k2 and k1 = k3 and kind <> k1").select("series", "seq")


def wf3(spark, sf):
    w = Window.partitionBy("series").orderBy("ts", "seq")
    rows = samples(spark, sf).withColumn("new", F.when(F.col("kind").eqNullSafe(F.lag("kind").over(w)), 0).otherwise(1)).withColumn("island", F.sum("new").over(w))
    return rows.groupBy("series", "island").agg(F.min("kind").alias("kind"), F.count("*").alias("n"), F.max("raw").alias("top"))


def wf4(spark, sf):
    w = Window.partitionBy("series").orderBy("raw", "seq").rowsBetween(Window.unboundedPreceding, 0)
    return samples(spark, sf).select("series", "seq", F.round(F.sum("k").over(w), 6).alias("weight"))


_day_sql = "strftime(day, '%Y-%m-%d') AS day"
_spread_sql = lambda source, order, n: f"""x AS (SELECT *, row_number() OVER (PARTITION BY series ORDER BY {order}) - 1 AS i, count(*) OVER (PARTITION BY series) AS many FROM {source}),
pick AS (SELECT DISTINCT series, CAST(round_even(g.n * (many - 1) / {n - 1}.0, 0) AS BIGINT) AS i FROM x, generate_series(0, {n - 1}) AS g(n) WHERE many > {n})
SELECT series, strftime(day, '%Y-%m-%d') AS day FROM x WHERE many <= {n} OR (series, i) IN (SELECT series, i FROM pick)"""  # noqa: E731
def _rules_sql(gives, text):
    """The first fitting rule by a search for each distinct key, from the same rows."""
    row = lambda k, r: "(" + ", ".join([str(k), *(f"'{r[c]}'" for c in ("source", "metric", "words", "also", "value")), r["confidence"] or "NULL"]) + ")"
    rows = ", ".join(row(k, r) for k, r in enumerate(naming.rule_rows()) if r["gives"] == gives)
    return f""", rule AS (SELECT * FROM (VALUES {rows}) AS v(place, source, metric, words, also, found, confidence)), told AS (SELECT e.*, rule.found, rule.confidence AS sure, row_number() OVER (PARTITION BY seq ORDER BY place) AS first_fit
FROM e JOIN rule ON rule.source IN (e.source, '*') AND rule.metric IN (e.metric, '*') AND (words = '' OR regexp_matches(lower({text}), words)) AND (also = '' OR regexp_matches(lower({text}), also)))"""


_ROLES = ENT + _rules_sql("role", "concat_ws(' ', e.source, e.entity, e.metric, e.name)") + ", r AS (SELECT seq, metric, found AS role, CAST(sure AS DOUBLE) AS confidence FROM told WHERE first_fit = 1)"

QUERIES = {
    "SRC3_state_read": (src3, S + f"SELECT series, epoch_us(ts) AS us, kind FROM s WHERE kind <> 'error' AND {RANGE}"),
    "SRC4_device_times": (src4, CAT + " SELECT DISTINCT device, epoch_us(ts) AS us FROM s JOIN cat USING (series) WHERE value IS NOT NULL"),
    "SRC5_period_snapshot": (src5, CAT + f" SELECT device, series, epoch_us(ts) AS us, CASE WHEN kind IN ('purchase', 'signup') THEN 'event' ELSE 'sample' END AS what, CASE WHEN kind NOT IN ('purchase', 'signup') THEN value END AS value FROM s JOIN cat USING (series) WHERE {RANGE}"),
    "SRC7_day_facts": (src7, DAY + f" SELECT series, {_day_sql}, n, mean FROM day WHERE day >= '2024-01-10' AND day < '2024-01-20' AND series < 50"),
    "SRC8_spread_days": (src8, DAY + ", " + _spread_sql("day", "day", 5)),
    "SRC9_delta_times": (src9, S + " SELECT series, seq, CAST(floor(epoch(ts)) AS BIGINT) AS at_s FROM s WHERE series % 7 <> 3"),
    "SRC10_normalised_history": (src10, S + """ SELECT series, seq, kind AS metric, value AS num, CASE kind WHEN 'click' THEN 'ch,fl' WHEN 'purchase' THEN 'dhw,fl' WHEN 'view' THEN 'ch' WHEN 'signup' THEN '' END AS flags, CASE WHEN value IS NULL THEN 'invalid' ELSE 'valid' END AS quality FROM s
UNION ALL SELECT series, seq, 'flame', CASE WHEN kind IN ('click', 'purchase') THEN 1.0 ELSE 0.0 END, NULL, 'valid' FROM s WHERE kind <> 'error'"""),
    "SRC11_raw_events": (src11, S + " SELECT seq, sha256(kind || '|' || series || '|' || epoch_us(ts) || '|' || CAST(k AS INT)) AS id, CASE WHEN kind = 'purchase' THEN 'loss' ELSE 'restore' END AS family FROM s WHERE kind IN ('purchase', 'signup')"),
    "SRC12_redaction": (src12, S + " SELECT seq, CAST(CAST(k AS INT) AS VARCHAR) AS k, '***' AS token, '***' AS phone FROM s"),
    "SRC14_moved_events": (src14, S + " SELECT seq, epoch_us(ts) AS us FROM s WHERE seq % 10 = 0 UNION SELECT seq, epoch_us(ts) + 3600000000 FROM s WHERE seq % 10 = 0"),
    "SRC15_catalogue": (src15, S + ", u AS (SELECT series, arg_min(kind, ts) AS unit FROM s WHERE seq % 3 = 0 GROUP BY 1) SELECT series, epoch_us(min(ts)) AS first_us, any_value(unit) AS unit FROM s LEFT JOIN u USING (series) GROUP BY series"),
    "SRC16_projected_snapshots": (src16, """WITH o AS (SELECT o_custkey AS device, o_orderkey AS id, o_orderdate AS d, sha256(o_orderstatus || '|' || array_to_string(list_sort(['heat', o_orderpriority]), ',')) AS fingerprint FROM orders),
x AS (SELECT *, lag(fingerprint) OVER w AS was, row_number() OVER w AS n FROM o WINDOW w AS (PARTITION BY device ORDER BY d, id)) SELECT device, id, fingerprint FROM x WHERE n = 1 OR fingerprint IS DISTINCT FROM was"""),
    "SRC17_coverage_ledger": (src17, S + f""", g AS (SELECT series, CAST(ts AS DATE) AS day, max(CASE kind WHEN 'purchase' THEN 3 WHEN 'signup' THEN 2 WHEN 'error' THEN 0 ELSE 1 END) AS r FROM s GROUP BY 1, 2), c AS (SELECT series, strftime(max(day) + 1, '%Y-%m-%d') AS "cursor" FROM g WHERE r >= 2 GROUP BY 1)
SELECT g.series, {_day_sql}, ['failed', 'unavailable', 'empty', 'complete'][r + 1] AS state, "cursor" FROM g LEFT JOIN c ON c.series = g.series"""),
    "SRC18_replaced_days": (src18, DAY + f" SELECT series, {_day_sql}, n, mean, CASE WHEN day >= '2024-01-20' THEN 2 ELSE 1 END AS version FROM day"),
    "PRJ1_unit": (prj1, ENT + _rules_sql("unit", "e.source || '.' || e.metric") + " SELECT e.seq, found AS unit FROM e LEFT JOIN told ON told.seq = e.seq AND first_fit = 1"),
    "PRJ2_role": (prj2, _ROLES + " SELECT seq, role, confidence FROM r"),
    "PRJ3_resolved_role": (prj3, _ROLES + """ SELECT seq, CASE WHEN seq % 6 = 1 AND metric LIKE '%temp%' THEN 'outdoor_temperature' WHEN seq % 4 = 1 THEN 'room_temperature' ELSE role END AS role,
CASE WHEN (seq % 6 = 1 AND metric LIKE '%temp%') OR seq % 4 = 1 THEN 1.0 ELSE confidence END AS confidence, CASE WHEN seq % 6 = 1 AND metric LIKE '%temp%' THEN 'config' WHEN seq % 4 = 1 THEN 'link' ELSE 'heuristic' END AS provenance FROM r"""),
    "PRJ4_setpoints": (prj4, ENT + " SELECT source, metric, count(*) AS n FROM e WHERE (source, metric) IN (('z3k_heating_circuit', 'target_temp'), ('z3k_heating_circuit', 'setpoint_temp'), ('z3k_boiler_adapter', 'cs')) GROUP BY 1, 2"),
    "PRJ5_flags": (prj5, S + " SELECT kind, CASE kind WHEN 'click' THEN 'ch+fl' WHEN 'purchase' THEN 'dhw+fl' ELSE '' END AS flags, count(*) AS n FROM s GROUP BY 1, 2"),
    "JN18_changed_rows": (jn18, S + " SELECT series, seq, round(CASE WHEN seq % 4 = 0 THEN value + 1 END, 6) AS value FROM s WHERE value IS NOT NULL AND (seq % 4 = 0 OR seq % 9 = 0)"),
    "JN19_profile": (jn19, S + """, x AS (SELECT *, max(CASE WHEN kind IN ('signup', 'error') THEN seq END) OVER w AS m, max(CASE WHEN kind NOT IN ('signup', 'error') THEN seq END) OVER w AS a FROM s WINDOW w AS (PARTITION BY series ORDER BY ts, seq))
SELECT x.series, x.seq, coalesce(CASE WHEN m.kind = 'signup' THEN m.raw END, a.raw) AS value FROM x LEFT JOIN s m ON m.seq = x.m LEFT JOIN s a ON a.seq = x.a"""),
    "JN20_citations": (jn20, CAT + """, c AS (SELECT DISTINCT device, kind || ':' || CAST(k % 4 AS INT) AS ref FROM s JOIN cat USING (series) WHERE ts < '2024-01-03'), n AS (SELECT DISTINCT device, kind || ':' || CAST(k % 4 AS INT) AS ref FROM s JOIN cat USING (series) WHERE ts >= '2024-01-29'),
j AS (SELECT coalesce(c.device, n.device) AS device, c.ref AS c, n.ref AS n FROM c FULL JOIN n ON c.device = n.device AND c.ref = n.ref), d AS (SELECT DISTINCT device FROM s JOIN cat USING (series))
SELECT d.device, coalesce(string_agg(c, ',' ORDER BY c) FILTER (n IS NULL), '') AS unknown, coalesce(string_agg(n, ',' ORDER BY n) FILTER (c IS NULL), '') AS missing, CAST(count(*) FILTER (c = n) AS INT) AS valid FROM d LEFT JOIN j ON j.device = d.device GROUP BY 1"""),
    "SL2_extreme_rows": (sl2, S + " SELECT a.series, a.seq AS warmest, b.seq AS coldest FROM (SELECT *, row_number() OVER (PARTITION BY series ORDER BY value DESC, seq) AS n FROM s WHERE value IS NOT NULL) a JOIN (SELECT *, row_number() OVER (PARTITION BY series ORDER BY value, seq DESC) AS n FROM s WHERE value IS NOT NULL) b USING (series) WHERE a.n = 1 AND b.n = 1".replace("value, seq DESC", "value, seq")),
    "SL4_balanced_days": (sl4, DAY + ", known AS (SELECT * FROM day WHERE mean IS NOT NULL), " + _spread_sql("known", "mean, day", 6)),
    "SO2_shared_strata": (so2, S + " SELECT series, CAST(floor(k / 10) AS INT) AS stratum FROM s WHERE ts < '2024-01-16' INTERSECT SELECT series, CAST(floor(k / 10) AS INT) FROM s WHERE ts >= '2024-01-16'"),
    "SO3_missing_days": (so3, S + ", d AS (SELECT DISTINCT series, CAST(ts AS DATE) AS day FROM s), r AS (SELECT series, min(day) AS a, max(day) AS b FROM d GROUP BY 1) SELECT series, strftime(g, '%Y-%m-%d') AS day FROM r, unnest(generate_series(a, b, INTERVAL 1 DAY)) AS u(g) WHERE (series, CAST(g AS DATE)) NOT IN (SELECT series, day FROM d)"),
    "SO4_conflicting_keys": (so4, S + " SELECT series, strftime(CAST(ts AS DATE), '%Y-%m-%d') AS day, CASE WHEN count(DISTINCT kind) = 1 THEN min(kind) END AS kind, count(DISTINCT kind) > 1 AS conflict FROM s GROUP BY 1, 2"),
    "WF1_neighbours": (wf1, S + " SELECT series, seq FROM (SELECT *, lead(kind, 1) OVER w AS k1, lead(kind, 2) OVER w AS k2, lead(kind, 3) OVER w AS k3 FROM s WINDOW w AS (PARTITION BY series ORDER BY ts, seq)) WHERE kind = k2 AND k1 = k3 AND kind <> k1"),
    "WF3_islands": (wf3, S + ", x AS (SELECT *, row_number() OVER (PARTITION BY series ORDER BY ts, seq) - row_number() OVER (PARTITION BY series, kind ORDER BY ts, seq) AS d FROM s), g AS (SELECT series, kind, d, count(*) AS n, max(raw) AS top, min(ts) AS t FROM x GROUP BY 1, 2, 3) SELECT series, row_number() OVER (PARTITION BY series ORDER BY t) AS island, kind, n, top FROM g"),
    "WF4_cumulative_weight": (wf4, S + " SELECT series, seq, round(sum(k) OVER (PARTITION BY series ORDER BY raw, seq ROWS UNBOUNDED PRECEDING), 6) AS weight FROM s"),
}
