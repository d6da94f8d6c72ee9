"""Structured Streaming over the events table: overlap replay, freshness, daily
sums and sessions.

A call drains what is there (available now) and returns the table the stream
wrote; kept running on the same checkpoint, it adds what arrives."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanwise.session import load, new_path


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = load(spark, sf_dir, "events")
    rows = spark.readStream.schema(table.schema).parquet(f"{sf_dir}/event[s].parquet")  # a pattern, since the stream takes a plain path for a folder
    return rows.select(F.col("user_id").alias("series"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("kind"), "value")


def drain(stream: DataFrame, label: str, mode: str) -> DataFrame:
    """Run a stream to its end. Append writes new rows; complete replaces the
    table in each batch, for aggregates as small as their keys."""
    spark, path, state = stream.sparkSession, new_path(stream.sparkSession, label), new_path(stream.sparkSession, f"{label}-state")
    writer = stream.writeStream.option("checkpointLocation", state).trigger(availableNow=True).outputMode(mode)
    if mode == "append":
        writer.format("parquet").option("path", path).start().awaitTermination()
    else:
        writer.foreachBatch(lambda batch, _: batch.write.mode("overwrite").parquet(path)).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)


def ingest(spark, sf_dir) -> DataFrame:
    """Rows once each, though a source replays up to two hours of them: the stream
    reads the table twice and drops what it knows within the watermark."""
    both = events(spark, sf_dir).union(events(spark, sf_dir)).withWatermark("ts", "120 minutes")
    return drain(both.dropDuplicatesWithinWatermark(["series", "ts", "kind", "value"]), "ingest", "append").select("series", F.unix_micros("ts").alias("us"), "kind", "value")


def freshness(spark, sf_dir) -> DataFrame:
    """Time of the first and latest sample of each series."""
    found = events(spark, sf_dir).groupBy("series").agg(F.max("ts").alias("latest"), F.min("ts").alias("first"), F.count("*").alias("samples"))
    return drain(found, "freshness", "complete").select("series", F.unix_micros("latest").alias("latest_us"), F.unix_micros("first").alias("first_us"), "samples")


def daily(spark, sf_dir) -> DataFrame:
    """Additive sums of each series and day."""
    found = events(spark, sf_dir).groupBy("series", F.window("ts", "1 day").alias("w")).agg(F.count("*").alias("samples"), F.sum("value").alias("total"))
    return drain(found, "daily", "complete").select("series", F.unix_micros("w.start").alias("day_us"), "samples", F.round("total", 6).alias("total"))


def sessions(spark, sf_dir) -> DataFrame:
    """Stretches of samples of a series that no gap of over six hours breaks."""
    found = events(spark, sf_dir).withWatermark("ts", "30 days").groupBy("series", F.session_window("ts", "6 hours").alias("w")).agg(F.count("*").alias("samples"), F.max("ts").alias("latest"))
    return drain(found, "sessions", "complete").select("series", F.unix_micros("w.start").alias("start"), F.unix_micros("latest").alias("end"), "samples")


E0 = "SELECT user_id AS series, ts, event_type AS kind, value FROM events"
QUERIES = {
    "ST1_overlap_replay": (ingest, f"SELECT DISTINCT series, epoch_us(ts) AS us, kind, value FROM ({E0})"),
    "ST6_freshness": (freshness, f"SELECT series, epoch_us(max(ts)) AS latest_us, epoch_us(min(ts)) AS first_us, count(*) AS samples FROM ({E0}) GROUP BY 1"),
    "ST7_daily_sums": (daily, f"SELECT series, epoch_us(date_trunc('day', ts)) AS day_us, count(*) AS samples, round(sum(value), 6) AS total FROM ({E0}) GROUP BY 1, 2"),
    "ST8_sessions": (sessions, f"""WITH x AS (SELECT *, CASE WHEN epoch_us(ts) - epoch_us(lag(ts) OVER w) <= 21600000000 THEN 0 ELSE 1 END AS nw FROM ({E0}) WINDOW w AS (PARTITION BY series ORDER BY ts)),
y AS (SELECT *, sum(nw) OVER (PARTITION BY series ORDER BY ts ROWS UNBOUNDED PRECEDING) AS n FROM x) SELECT series, epoch_us(min(ts)) AS "start", epoch_us(max(ts)) AS "end", count(*) AS samples FROM y GROUP BY series, n"""),
}
