"""Heating evidence and configuration snapshots over the given tables: a day of a series
is a window, an order an observed device."""

from __future__ import annotations

from pyspark.sql import functions as F

from spanwise.operators import evidence, snapshots
from spanwise.plans.telemetry import S, samples
from spanwise.session import load

MOST = 5


def _windows(spark, sf):
    """Signups are targets, k the weather, clicks and views requests, errors exclusions."""
    fact = lambda mean, low, high, cover: F.when(mean.isNotNull(), F.struct(mean.alias("mean"), low.alias("minimum"), high.alias("maximum"), cover.alias("coverage")))
    rows = samples(spark, sf).withColumn("day", F.to_date("ts")).withColumn("target", F.when(F.col("kind") == "signup", F.floor(F.col("raw") / 100).cast("double")))
    whole, share = F.lit(100.0), 100.0 * F.count_if(F.col("kind").isin("click", "view")) / F.count("*")
    mode = F.count_if(F.col("kind") == "click").cast("double")
    g = rows.groupBy("series", "day").agg(
        fact(F.avg("value"), F.min("value"), F.max("value"), F.least(whole, 40.0 * F.count("value"))).alias("room"), fact(F.avg("target"), F.min("target"), F.max("target"), whole).alias("target"),
        fact(F.avg("k"), F.min("k"), F.max("k"), whole).alias("outdoor"), fact(mode, mode, mode, whole).alias("mode"), fact(share, share, share, F.least(whole, 50.0 * F.count("*"))).alias("request"),
        F.when(F.count_if(F.col("kind") == "error") > 1, F.array(F.lit("power"))).otherwise(F.array().cast("array<string>")).alias("excluded"))
    return g.select("series", F.date_format("day", "yyyy-MM-dd").alias("id"), F.lit(None).cast("string").alias("kind"), F.lit(0).alias("rank"), F.col("day").cast("timestamp").alias("start"), F.date_add("day", 1).cast("timestamp").alias("end"),
                    "excluded", "room", "target", "outdoor", "mode", "request", F.lit(None).cast("double").alias("error"))


def ag24(spark, sf):
    return evidence.evidence(_windows(spark, sf), "series", MOST).select("series", F.col("id").alias("day"), "part", F.round("error", 6).alias("error"), F.round("quality", 4).alias("quality"))


def src16(spark, sf):
    """Orders as observations of a customer's device: what moves, keys and the order of
    capabilities do not make a new snapshot; status, capabilities and the hour do."""
    caps = F.when(F.col("o_orderkey") % 2 == 0, F.array(F.lit("heat"), F.col("o_orderpriority"))).otherwise(F.array(F.col("o_orderpriority"), F.lit("heat")))
    state = F.struct((F.month("o_orderdate") % 3).alias("hour"), F.col("o_totalprice").cast("double").alias("temp"))
    raw = F.struct(F.col("o_orderdate").cast("string").alias("last_seen"), F.col("o_orderstatus").alias("name"), F.struct(caps.alias("capabilities")).alias("z3k_config"), F.struct(F.struct(state.alias("7")).alias("z3k-state")).alias("io"))
    rows = load(spark, sf, "orders").select(F.col("o_custkey").alias("device"), F.col("o_orderdate").alias("at"), F.col("o_orderkey").alias("id"), F.to_json(F.struct(F.col("o_orderkey").alias("discovered_at"), raw.alias("raw"))).alias("document"))
    return snapshots.snapshots(rows, "device", ["at", "id"], "document").select("device", "id")


QUERIES = {
    "AG24_heating_evidence": (ag24, S + f""", g AS (SELECT series, CAST(ts AS DATE) AS day, avg(value) AS room, least(100.0, 40.0 * count(value)) AS rc, avg(floor(raw / 100)) FILTER (kind = 'signup') AS target, min(floor(raw / 100)) FILTER (kind = 'signup') AS tlo, max(floor(raw / 100)) FILTER (kind = 'signup') AS thi,
avg(k) AS outdoor, 100.0 * count(*) FILTER (kind IN ('click', 'view')) / count(*) AS request, least(100.0, 50.0 * count(*)) AS qc, count(*) FILTER (kind = 'error') > 1 AS gone FROM s GROUP BY 1, 2),
q AS (SELECT *, least(CASE WHEN room IS NULL THEN 0 ELSE rc END, CASE WHEN target IS NULL THEN 0 ELSE 100 END, CASE WHEN outdoor IS NULL THEN 0 ELSE 100 END, qc) AS quality, CASE WHEN qc < 70 THEN 'unknown' WHEN request > 0 THEN 'active' ELSE 'inactive' END AS activity FROM g),
p AS (SELECT *, CASE WHEN activity = 'active' AND NOT gone AND quality >= 70 AND tlo = thi THEN 'active' WHEN activity = 'inactive' THEN 'inactive' ELSE 'unknown' END AS part FROM q),
o AS (SELECT *, row_number() OVER (PARTITION BY series, part ORDER BY outdoor, day) - 1 AS i, count(*) OVER (PARTITION BY series, part) AS n, row_number() OVER (PARTITION BY series, part ORDER BY day DESC) AS late FROM p)
SELECT series, strftime(day, '%Y-%m-%d') AS day, part, round(room - target, 6) AS error, CAST(round(quality, 4) AS DOUBLE) AS quality FROM o
WHERE CASE WHEN part = 'active' THEN n <= {MOST} OR i IN ({', '.join(f"CAST(round_even({j} * (n - 1) / {MOST - 1}.0, 0) AS BIGINT)" for j in range(MOST))}) ELSE late <= {MOST // 2} END"""),
    "SRC16_nested_snapshots": (src16, """WITH o AS (SELECT o_custkey AS device, o_orderkey AS id, o_orderdate AS seen, row(o_orderstatus, o_orderpriority, month(o_orderdate) % 3) AS c FROM orders)
SELECT device, id FROM (SELECT *, lag(c) OVER (PARTITION BY device ORDER BY seen, id) AS was FROM o) WHERE c IS DISTINCT FROM was"""),
}
