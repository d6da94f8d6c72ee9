"""Flagship queries over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from spanwise.session import load


def time_weighted(spark, sf_dir):
    """Samples to segments with the median gap cap, then the time-weighted mean
    and the covered share of each series."""
    key = Window.partitionBy("user_id")
    samples = load(spark, sf_dir, "events").select("user_id", F.col("ts").cast("timestamp").alias("ts"), "value", "event_id")
    one = samples.groupBy("user_id", "ts").agg(F.max_by("value", "event_id").alias("value"))
    gap = (F.unix_micros(F.lead("ts").over(key.orderBy("ts"))) - F.unix_micros("ts")) / 1e6
    segments = one.withColumn("sec", gap).withColumn("cap", F.greatest(2.5 * F.median("sec").over(key), F.lit(60.0)))
    kept = segments.where("sec > 0 and sec <= cap")
    return kept.groupBy("user_id").agg(
        F.round(F.sum(F.col("value") * F.col("sec")) / F.sum("sec"), 6).alias("mean"),
        F.round(F.sum("sec"), 3).alias("observed_s"),
        F.count("*").alias("segments"),
    )


SQL = """
WITH one AS (SELECT user_id, ts, max_by(value, event_id) AS value FROM events GROUP BY user_id, ts),
g AS (SELECT *, (epoch_us(lead(ts) OVER (PARTITION BY user_id ORDER BY ts)) - epoch_us(ts)) / 1e6 AS sec FROM one),
c AS (SELECT *, greatest(2.5 * median(sec) OVER (PARTITION BY user_id), 60.0) AS cap FROM g)
SELECT user_id, round(sum(value * sec) / sum(sec), 6) AS mean, round(sum(sec), 3) AS observed_s, count(*) AS segments
FROM c WHERE sec > 0 AND sec <= cap GROUP BY user_id
"""

QUERIES = {"AG1_time_weighted": (time_weighted, SQL)}
