"""Rows by key in a table of days that micro-batches and recomputations change.

A commit writes the days it touches to a folder of its own and then a manifest, the
folder of each day. Readers follow the newest manifest, so a batch is there wholly or
not at all; what a failed batch left behind is read by none. Manifests are as long as
the table has days. One writer at a time, as a stream's sink is.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterable
from datetime import date
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanwise.session import materialize


class DayTable:
    """keys: what identifies a row; schema: DDL of its columns, a date ``day`` among
    them; spread: files a day, by hash of the keys."""

    def __init__(self, spark: SparkSession, path: str, keys: list[str], schema: str, spread: int = 4) -> None:
        self.spark, self.path, self.keys, self.spread = spark, path, keys, spread
        self.schema = spark.createDataFrame([], schema).schema

    def _fs(self, path: str):
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()), at

    def _versions(self) -> list[str]:
        fs, at = self._fs(f"{self.path}/manifests")
        return sorted(x.getPath().getName() for x in fs.listStatus(at) if x.getPath().getName().endswith(".json")) if fs.exists(at) else []

    def manifest(self) -> dict:
        """batch: number of the last batch; days: folder by day."""
        found = self._versions()
        if not found:
            return {"batch": -1, "days": {}}
        return json.loads(self.spark.read.text(f"{self.path}/manifests/{found[-1]}", wholetext=True).first()[0])

    def days(self) -> list[date]:
        return sorted(map(date.fromisoformat, self.manifest()["days"]))

    def read(self, days: Iterable[date] | None = None) -> DataFrame:
        """The rows, or those of some days: other days' files are not touched."""
        held = self.manifest()["days"]
        wanted = held if days is None else {str(d): held[str(d)] for d in set(days) if str(d) in held}
        if not wanted:
            return self.spark.createDataFrame([], self.schema)
        by_folder: dict[str, list[str]] = {}
        for day, folder in sorted(wanted.items()):
            by_folder.setdefault(folder, []).append(day)
        parts = []
        for folder, some in by_folder.items():  # a folder of a commit: its days that no later one replaced
            base = f"{self.path}/data/{folder}"
            rows = self.spark.read.schema(self.schema).option("basePath", base).parquet(*[f"{base}/day={d}" for d in some])
            parts.append(rows.select(*self.schema.names))
        return reduce(DataFrame.unionByName, parts)

    def replace(self, rows: DataFrame, days: Iterable[date], batch: int | None = None) -> None:
        """These days become the rows (those of other days are left out)."""
        days, now = sorted(set(days)), self.manifest()
        folder = uuid.uuid4().hex
        if days:
            kept = rows.where(F.col("day").isin(days)).select(*self.schema.names)
            kept.repartition(F.col("day"), F.pmod(F.xxhash64(*self.keys), F.lit(self.spread))).write.partitionBy("day").parquet(f"{self.path}/data/{folder}")
        fs, _ = self._fs(self.path)
        made = {d for d in days if fs.exists(self._fs(f"{self.path}/data/{folder}/day={d}")[1])}
        held = {k: v for k, v in now["days"].items() if date.fromisoformat(k) not in set(days)} | {str(d): folder for d in made}
        text = json.dumps({"batch": now["batch"] if batch is None else batch, "days": held})
        name = f"{self.path}/manifests/{len(self._versions()):012d}.json"
        out = fs.create(self._fs(f"{name}.part")[1], True)
        out.write(bytearray(text.encode()))
        out.close()
        fs.rename(self._fs(f"{name}.part")[1], self._fs(name)[1])

    def upsert(self, rows: DataFrame, batch: int, order: str) -> list[date]:
        """Merge a batch: of rows with equal keys the one with the greatest ``order``
        stays, here, in the table and among repeats in the batch alike, so the table
        does not depend on how rows were cut into batches. A batch that has been
        committed changes nothing. Returns the days on which a value changed."""
        if batch <= self.manifest()["batch"]:
            return []
        values = [c for c in self.schema.names if c not in (*self.keys, "day", order)]
        rows = materialize(rows.select(*self.schema.names), "upsert")
        days = [r["day"] for r in rows.select("day").distinct().collect()]  # as many as the batch has days
        both = self.read(days).withColumn("__old", F.lit(True)).unionByName(rows.withColumn("__old", F.lit(False)))
        whole = F.struct(*dict.fromkeys([order, *values]))
        merged = both.groupBy(*self.keys, "day").agg(F.max(whole).alias("top"), F.max(F.when(F.col("__old"), whole)).alias("was"))
        owned = [F.col(f"top.{c}") for c in self.schema.names if c not in (*self.keys, "day")]
        told = lambda s: F.struct(*[F.col(f"{s}.{c}") for c in values]) if values else F.lit(True)
        merged = merged.select(*self.keys, "day", *owned, (~F.col("top").eqNullSafe(F.col("was"))).alias("__moved"),
                               (F.col("was").isNull() | ~told("top").eqNullSafe(told("was"))).alias("__changed"))
        merged = materialize(merged, "upsert")
        state = merged.groupBy("day").agg(F.max("__moved").alias("moved"), F.max("__changed").alias("changed")).collect()
        self.replace(merged, [r["day"] for r in state if r["moved"]], batch)
        return sorted(r["day"] for r in state if r["changed"])
