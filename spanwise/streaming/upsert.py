"""A stream that merges its micro-batches into a table of days, and facts that are
recomputed where it changed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanwise.operators.recompute import HELD, recompute
from spanwise.session import load, new_path
from spanwise.sources.daytable import DayTable

SAMPLE = "series long, day date, ts timestamp, seq long, value double"


def into(stream: DataFrame, table: DayTable, order: str, checkpoint: str, changed=None) -> None:
    """Merge what is there into the table, a commit a batch; changed(days, batch)
    is called with the days that each batch changed."""

    def merge(batch: DataFrame, number: int) -> None:
        days = table.upsert(batch, number, order)
        if changed is not None and days:
            changed(days, number)

    stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def _arrivals(spark, sf_dir, late, hourly: bool) -> DataFrame:
    """The events as files of arrival: those that come on time, and late ones. The
    stream takes a file a batch."""
    ts = F.col("ts").cast("timestamp")
    rows = load(spark, sf_dir, "events").select(F.col("user_id").alias("series"), (F.date_trunc("hour", ts) if hourly else ts).alias("ts"), F.col("event_id").alias("seq"), "value", late.alias("late"))
    rows = rows.where("ts is not null").select("series", F.to_date("ts").alias("day"), "ts", "seq", "value", "late")
    path = new_path(spark, "arrivals")
    for turn in (False, True):
        rows.where(F.col("late") == turn).drop("late").coalesce(1).write.mode("append").parquet(path)
    schema = spark.read.parquet(path).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)


def st2(spark, sf_dir) -> DataFrame:
    """The latest report of each series and hour, whatever order reports come in."""
    table = DayTable(spark, new_path(spark, "hourly"), ["series", "ts"], SAMPLE)
    into(_arrivals(spark, sf_dir, F.coalesce(F.col("event_type") == "view", F.lit(False)), True), table, "seq", new_path(spark, "hourly-state"))
    return table.read().select("series", F.unix_micros("ts").alias("us"), "seq", "value")


def st4(spark, sf_dir) -> DataFrame:
    """Held value of each series and day; late rows recompute the days they reach."""
    late = F.coalesce((F.col("event_type") == "error") & (F.col("value") > 200), F.lit(False))
    samples = DayTable(spark, new_path(spark, "samples"), ["series", "ts", "seq"], SAMPLE)
    facts = DayTable(spark, new_path(spark, "facts"), ["series"], HELD)
    into(_arrivals(spark, sf_dir, late, False), samples, "seq", new_path(spark, "samples-state"), lambda days, _: recompute(samples, facts, days))
    return facts.read().select("series", F.date_format("day", "yyyy-MM-dd").alias("day"), "samples", F.round("known_s", 3).alias("known_s"), F.round(F.col("integral") / 86400, 6).alias("integral"), F.round("boundary", 6).alias("boundary"))


QUERIES = {
    "ST2_upsert": (st2, """SELECT user_id AS series, epoch_us(date_trunc('hour', ts)) AS us, max(event_id) AS seq, arg_max(struct_pack(v := value), event_id).v AS value FROM events WHERE ts IS NOT NULL GROUP BY 1, 2"""),
    "ST4_selective_recompute": (st4, """WITH x AS (SELECT user_id AS series, ts, arg_max(value, event_id) AS value FROM events WHERE value IS NOT NULL AND ts IS NOT NULL GROUP BY 1, 2),
span AS (SELECT max(ts)::DATE AS hi FROM events), born AS (SELECT series, min(ts)::DATE AS lo FROM x GROUP BY 1),
grid AS (SELECT series, unnest(generate_series(lo::TIMESTAMP, hi::TIMESTAMP, INTERVAL 1 DAY))::DATE AS day FROM born, span),
n AS (SELECT *, coalesce(lead(ts) OVER (PARTITION BY series ORDER BY ts), (SELECT hi + INTERVAL 1 DAY FROM span)) AS until FROM x),
cut AS (SELECT g.series, g.day, value, epoch_us(least(until, g.day + INTERVAL 1 DAY)) - epoch_us(greatest(n.ts, g.day)) AS us, n.ts >= g.day AS own, n.ts FROM grid g JOIN n ON n.series = g.series AND n.ts < g.day + INTERVAL 1 DAY AND n.until > g.day)
SELECT series, strftime(day, '%Y-%m-%d') AS day, count(*) FILTER (own) AS samples, round(sum(us) / 1e6, 3) AS known_s, round(sum(value * us / 1e6) / 86400, 6) AS integral, round(arg_max(value, ts), 6) AS boundary FROM cut GROUP BY 1, 2"""),
}
