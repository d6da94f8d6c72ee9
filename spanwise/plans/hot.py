"""The two-level windows over the given tables, beside the plain ones and with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from spanwise.operators import hot
from spanwise.plans import telemetry as t


def iv1(spark, sf):
    return t._rounded(t._span(hot.segments(t.samples(spark, sf), "series", "ts", "value", "seq")), "sec")


def iv7(spark, sf):
    return t._span(hot.merge(t._states(spark, sf).where("kind in ('click', 'view')"), "series", 3_600.0))


def jn1(spark, sf):
    s = t.samples(spark, sf)
    right = s.where("kind = 'signup'").select("series", "ts", "seq", F.col("raw").alias("target"))
    return hot.as_of(s.where("kind <> 'signup'").select("series", "ts", "seq"), right, "series", "ts", "target", "seq").select("series", "seq", "target")


_sql = lambda name: next(sql for key, (_, sql) in t.QUERIES.items() if key.startswith(name + "_"))
QUERIES = {"IV1_hot_segments": (iv1, _sql("IV1")), "IV7_hot_merge": (iv7, _sql("IV7")), "JN1_hot_as_of": (jn1, _sql("JN1"))}
