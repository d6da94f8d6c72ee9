"""Queries of the scalar rules over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from spanwise.operators import scalars as sc
from spanwise.plans.telemetry import S, samples
from spanwise.session import load


def sunrise(spark, sf):
    """Sunrise of each sample's day, its place made from the second signal and the series."""
    day, lat, lon = F.to_date("ts"), F.col("k") - 20, (F.col("series") % 360 - 180).cast("double")
    return samples(spark, sf).select("seq", F.round(sc.sunrise_minutes(day, lat, lon), 6).alias("minutes"))


def prices(spark, sf):
    """Order keys and customers as prices of many spellings, some of them not one."""
    key = F.col("o_orderkey")
    part = F.concat(F.lpad((F.col("o_custkey") * 10 % 1_000_000).cast("string"), 6, "0"), F.when(key % 5 == 0, "1").otherwise(""))
    text = F.concat(F.when(key % 7 == 0, "1,").otherwise(" 0"), key.cast("string"), F.when((key % 2 == 0) | (key % 7 == 0), ".").otherwise(","), part)
    return load(spark, sf, "orders").select("o_orderkey", sc.price_text(text).alias("price"))


def prints(spark, sf):
    """Fingerprints of each order's settings."""
    half = F.floor(F.col("o_totalprice") * 2) / 2
    print_ = sc.fingerprint("v1", total=sc.number_text(half), status=sc.text_value(F.col("o_orderstatus")), limit=sc.number_text(F.when(F.col("o_custkey") % 3 == 0, half)))
    return load(spark, sf, "orders").select("o_orderkey", print_.alias("fingerprint"))


def bounded(spark, sf):
    """Names of customers and segments in at most 24 characters."""
    return load(spark, sf, "customer").select("c_custkey", sc.bounded_text(F.concat("c_name", F.lit("/"), "c_mktsegment"), 24).alias("name"))


_X = "(2 * pi() * (dayofyear(ts) - 1) / (CASE WHEN year(ts) % 4 = 0 AND (year(ts) % 100 <> 0 OR year(ts) % 400 = 0) THEN 366 ELSE 365 END))"
_HALF = "CASE WHEN floor(o_totalprice * 2) % 2 = 0 THEN CAST(CAST(floor(o_totalprice * 2) / 2 AS BIGINT) AS VARCHAR) ELSE CAST(CAST(floor(o_totalprice) AS BIGINT) AS VARCHAR) || '.5' END"
QUERIES = {
    "SC_sunrise": (sunrise, S + f""", a AS (SELECT seq, radians(k - 20) AS lat, series % 360 - 180 AS lon, {_X} AS x FROM s),
b AS (SELECT *, 0.006918 - 0.399912 * cos(x) + 0.070257 * sin(x) - 0.006758 * cos(2 * x) + 0.000907 * sin(2 * x) - 0.002697 * cos(3 * x) + 0.00148 * sin(3 * x) AS d,
229.18 * (0.000075 + 0.001868 * cos(x) - 0.032077 * sin(x) - 0.014615 * cos(2 * x) - 0.040849 * sin(2 * x)) AS eq FROM a), c AS (SELECT *, cos(radians(90.833)) / (cos(lat) * cos(d)) - tan(lat) * tan(d) AS h FROM b)
SELECT seq, round(CASE WHEN h BETWEEN -1 AND 1 THEN 720 - 4 * (lon + degrees(acos(CASE WHEN h BETWEEN -1 AND 1 THEN h ELSE 0 END))) - eq END, 6) AS minutes FROM c"""),
    "SC_price_text": (prices, """SELECT o_orderkey, CASE WHEN o_orderkey % 7 <> 0 AND o_orderkey % 5 <> 0 THEN rtrim(rtrim(CAST(o_orderkey + CAST(o_custkey * 10 % 1000000 AS DECIMAL(18,6)) / 1000000::DECIMAL(18,6) AS DECIMAL(18,6))::VARCHAR, '0'), '.') END AS price FROM orders"""),
    "SC_fingerprint": (prints, f"""SELECT o_orderkey, 'v1:' || sha256('{{"limit":' || CASE WHEN o_custkey % 3 = 0 THEN {_HALF} ELSE 'null' END || ',"status":"' || o_orderstatus || '","total":' || {_HALF} || '}}') AS fingerprint FROM orders"""),
    "SC_bounded_text": (bounded, """SELECT c_custkey, CASE WHEN length(n) <= 24 THEN n ELSE n[1:11] || ':' || sha256(n)[1:12] END AS name FROM (SELECT c_custkey, c_name || '/' || c_mktsegment AS n FROM customer)"""),
}
