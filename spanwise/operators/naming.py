"""Units, roles and commanded series by a table of rules.

A rule names series by exact source and metric (or any) and by words of a text. It
is a row; the series meet their rules by equi-joins with the table, which is broadcast
(it has to fit in a task), and of those that fit the one of least rank stays. ``rules()`` gives the rows of
``naming_rules.csv``; callers may pass others."""

from __future__ import annotations

import csv
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ANY = "*"


def rule_rows() -> list[dict[str, str]]:
    with open(Path(__file__).with_name("naming_rules.csv"), encoding="utf-8", newline="") as f:
        return list(csv.DictReader(line for line in f if not line.startswith("#")))


def rules(spark: SparkSession) -> DataFrame:
    """(rank, gives, source, metric, words, also, value, confidence)."""
    rows = [(k, r["gives"], r["source"], r["metric"], r["words"], r["also"], r["value"], float(r["confidence"]) if r["confidence"] else None) for k, r in enumerate(rule_rows())]
    return spark.createDataFrame(rows, "rank int, gives string, source string, metric string, words string, also string, value string, confidence double")


def _holds(text: str, words: Column) -> Column:
    return (F.size(words) == 0) | F.exists(words, lambda w: F.col(text).contains(w))


def named(series: DataFrame, table: DataFrame, gives: str, text: Column) -> DataFrame:
    """series with value and confidence of the first rule that fits (null: none).
    series has source and metric; text is what words are looked for in, in lower case.
    Only the rules, grouped by source and metric, are sent around: rows stay where they are."""
    some = lambda c: F.when(F.col(c) != "", F.split(c, r"\|")).otherwise(F.array())
    rule = F.struct("rank", some("words").alias("words"), some("also").alias("also"), "value", "confidence")
    grouped = table.where(F.col("gives") == gives).groupBy("source", "metric").agg(F.collect_list(rule).alias("rules"))
    rows = series.withColumns({"__s": F.coalesce("source", F.lit("")), "__m": F.coalesce("metric", F.lit("")), "__t": F.lower(text)})
    every, found = F.lit(ANY), []
    for k, (s, m) in enumerate(((F.col("__s"), F.col("__m")), (F.col("__s"), every), (every, F.col("__m")), (every, every))):
        own = F.broadcast(grouped.select(F.col("source").alias(f"__s{k}"), F.col("metric").alias(f"__m{k}"), F.col("rules").alias(f"__r{k}")))
        rows = rows.withColumns({f"__a{k}": s, f"__b{k}": m}).join(own, (F.col(f"__a{k}") == F.col(f"__s{k}")) & (F.col(f"__b{k}") == F.col(f"__m{k}")), "left")
        found.append(F.filter(F.coalesce(f"__r{k}", F.array()), lambda r: _holds("__t", r["words"]) & _holds("__t", r["also"])))
    return rows.withColumn("__first", F.array_min(F.concat(*found))).select(*series.columns, F.col("__first.value").alias("value"), F.col("__first.confidence").alias("confidence"))


def units(series: DataFrame, table: DataFrame | None = None) -> DataFrame:
    """series (source, metric and, if there, path) with unit."""
    path = F.col("path") if "path" in series.columns else F.col("metric")
    found = named(series, rules(series.sparkSession) if table is None else table, "unit", F.concat_ws(".", "source", path))
    return found.withColumnRenamed("value", "unit").drop("confidence")


def roles(series: DataFrame, table: DataFrame | None = None) -> DataFrame:
    """series (source, entity, metric, name) with role and confidence."""
    found = named(series, rules(series.sparkSession) if table is None else table, "role", F.concat_ws(" ", "source", F.col("entity").cast("string"), "metric", "name"))
    return found.withColumnRenamed("value", "role")


def setpoints(series: DataFrame, table: DataFrame | None = None) -> DataFrame:
    """series with setpoint: whether it is commanded rather than measured."""
    found = named(series, rules(series.sparkSession) if table is None else table, "setpoint", F.lit(""))
    return found.withColumn("setpoint", F.col("value").isNotNull()).drop("value", "confidence")


def resolved(linked: Column, override: Column, is_temperature: Column) -> Column:
    """(role, confidence, provenance) of a row with role and confidence: a configured
    role, which may name temperatures alone, beats a linked one, and that the guess."""
    made = lambda r, c, p: F.struct(r.alias("role"), c.alias("confidence"), F.lit(p).alias("provenance"))
    guess = made(F.col("role"), F.col("confidence"), "heuristic")
    return F.when(override.isNotNull() & is_temperature, made(override, F.lit(1.0), "config")).when(linked.isNotNull(), made(linked, F.lit(1.0), "link")).otherwise(guess)
