"""Rows that stand for a series in a chart of few points."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from spanwise.operators.intervals import seconds

POINTS = 480


def downsampled(df: DataFrame, key: str, ts: str, value: str, order: str, points: int = POINTS, steps: bool = False, factor: float = 3.0) -> DataFrame:
    """At most ``points`` rows of a key. Ends and both sides of gaps (over ``factor``
    median gaps) stay; of a step series both sides of each change instead. The rest of
    the budget goes, two a bucket, to the first least and first greatest value of
    equal buckets [floor(b * width), floor((b + 1) * width)). Rows that must stay do
    so though they alone exceed the budget. Null values are left out; of equal times
    ``order`` decides."""
    own = Window.partitionBy(key)
    by = own.orderBy(ts, order)
    rows = df.where(F.col(value).isNotNull()).withColumn("__i", F.row_number().over(by) - 1).withColumn("__n", F.count("*").over(own))
    if steps:
        edge = lambda other: F.coalesce(F.col(value) != other, F.lit(False))
        must = edge(F.lag(value).over(by)) | edge(F.lead(value).over(by))
    else:
        gap = F.nullif(seconds(F.lag(ts).over(by), F.col(ts)), F.lit(0.0))
        rows = rows.withColumn("__gap", gap)
        most = rows.groupBy(key).agg((factor * F.median("__gap")).alias("__most"))
        rows = rows.join(most, key).withColumn("__edge", F.coalesce(F.col("__gap") > F.col("__most"), F.lit(False)))
        must = F.col("__edge") | F.coalesce(F.lead("__edge").over(by), F.lit(False))
    rows = rows.withColumn("__must", must | (F.col("__i") == 0) | (F.col("__i") == F.col("__n") - 1))
    rows = rows.withColumn("__kept", F.count_if("__must").over(own))
    rows = rows.withColumn("__width", F.col("__n") / F.greatest(F.lit(1), F.floor((points - F.col("__kept")) / 2)))
    near = F.floor(F.col("__i") / F.col("__width"))  # its bucket, up to rounding
    rows = rows.withColumn("__b", near - F.when(F.floor(near * F.col("__width")) > F.col("__i"), 1).otherwise(0) + F.when(F.floor((near + 1) * F.col("__width")) <= F.col("__i"), 1).otherwise(0))
    bucket = Window.partitionBy(key, "__b")
    low = F.row_number().over(bucket.orderBy(F.asc(value), F.asc("__i"))) == 1
    high = F.row_number().over(bucket.orderBy(F.desc(value), F.asc("__i"))) == 1
    extreme = (F.col("__kept") < points) & (F.col("__low") | F.col("__high"))
    rows = rows.withColumn("__low", low).withColumn("__high", high).where((F.col("__n") <= points) | F.col("__must") | extreme)
    return rows.select(*df.columns)
