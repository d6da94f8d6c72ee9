"""From source records to typed rows: markers, flags, redaction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

SECRET = "token|password|secret|auth|cookie|phone|email|serial|login"


def spread(df: DataFrame, key: str, order: str, n: int) -> DataFrame:
    """At most n rows of a key, evenly over its order: places round(i (N-1) / (n-1)),
    halves to even."""
    own = Window.partitionBy(key)
    rows = df.withColumn("__i", F.row_number().over(own.orderBy(order)) - 1).withColumn("__n", F.count("*").over(own))
    wanted = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.bround(i * (F.col("__n") - 1) / (n - 1)).cast("long"))
    return rows.where((F.col("__n") <= n) | F.array_contains(wanted, F.col("__i").cast("long"))).drop("__i", "__n")


def delta_times(df: DataFrame, keys: list[str], points: str) -> DataFrame:
    """(keys, at_s, value): arrays of (marker, value) as rows. A marker of zero or
    more is a time, one below zero a step forward from the time before; an array
    that begins with a step has no time and gives no rows."""
    rows = df.where(F.col(points)[0]["marker"] >= 0).select(*keys, F.posexplode(points).alias("pos", "p"))
    own = Window.partitionBy(*keys).orderBy("pos")
    rows = rows.withColumn("__g", F.count_if(F.col("p.marker") >= 0).over(own))
    run = Window.partitionBy(*keys, "__g").orderBy("pos")
    at = F.sum(F.abs("p.marker")).over(run)  # the first of a run is its absolute time
    return rows.select(*keys, at.alias("at_s"), "p.value")


def with_derived_flame(df: DataFrame, keys: list[str], metric: str, value: str, flags: str) -> DataFrame:
    """Each reading and, where it has a list of flags, a derived flame of 0 or 1."""
    lit = F.array_contains(F.split(flags, ","), "fl").cast("double")
    base = F.struct(F.col(metric).alias("metric"), F.col(value).alias("num"), F.col(flags).alias("flags"), F.when(F.col(value).isNull() | F.isnan(value), "invalid").otherwise("valid").alias("quality"))
    derived = F.struct(F.lit("flame").alias("metric"), lit.alias("num"), F.lit(None).cast("string").alias("flags"), F.lit("valid").alias("quality"))
    both = F.when(F.col(flags).isNull(), F.array(base)).otherwise(F.array(base, derived))
    return df.select(*keys, F.explode(both).alias("r")).select(*keys, "r.*")


def redacted(details: str) -> Column:
    """A map of key paths with the values of sensitive ones masked."""
    return F.transform_values(details, lambda k, v: F.when(F.lower(k).rlike(SECRET), F.lit("***")).otherwise(v))


def moved(have: DataFrame, come: DataFrame, key: str, ts: str) -> DataFrame:
    """Old and new times of rows whose time a correction changes, and new rows."""
    both = come.select(key, F.col(ts).alias("__new")).join(have.select(key, F.col(ts).alias("__old")), key, "left").where(~F.col("__new").eqNullSafe(F.col("__old")))
    return both.select(key, F.explode(F.array_compact(F.array("__old", "__new"))).alias(ts)).distinct()


def flags(text: Column) -> Column:
    """A list literal as a set of lower-case flags; anything else is empty."""
    inner = F.regexp_extract(F.coalesce(text, F.lit("")), r"^\s*\[(.*)\]\s*$", 1)
    return F.array_distinct(F.filter(F.transform(F.split(inner, ","), lambda x: F.lower(F.trim(F.regexp_replace(x, "['\"]", "")))), lambda x: x != ""))


def on_curve(points: Column, x: Column) -> Column:
    """The value at x of the line through points (array of structs x, y), null
    outside of them: nothing is clamped or extrapolated."""
    ordered = F.array_sort(points)
    pairs = F.zip_with(F.slice(ordered, 1, F.greatest(F.size(ordered) - 1, F.lit(0))), F.slice(ordered, 2, F.size(ordered)), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    first = F.get(F.filter(pairs, lambda p: (p["a"]["x"] <= x) & (x <= p["b"]["x"])), F.lit(0))
    a, b = first["a"], first["b"]
    return a["y"] + F.coalesce(F.try_divide(x - a["x"], b["x"] - a["x"]), F.lit(0.0)) * (b["y"] - a["y"])
