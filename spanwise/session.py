"""Session helpers: table loading and tables in the folder all executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_local: dict[str, str] = {}
#: Spark's own setting: shuffle files of a query go when it ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Environment of Python workers that give freed arrays and batches back to the system
#: instead of keeping them for the next task (fixed thresholds of the C library).
LEAN = {"MALLOC_MMAP_THRESHOLD_": str(1 << 20), "MALLOC_TRIM_THRESHOLD_": str(4 << 20), "MALLOC_ARENA_MAX": "2", "ARROW_DEFAULT_MEMORY_POOL": "system"}


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Where that is unset (local tests) a
    temporary folder takes its place; on a cluster that is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if "dir" not in _local:
        _local["dir"] = tempfile.mkdtemp(prefix="spanwise-", dir="/tmp")
    return _local["dir"]


def new_path(spark: SparkSession, label: str) -> str:
    """A new folder below the shared one, removed when the driver ends."""
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    atexit.register(_remove, spark, path)
    return path


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # the session has ended already: nothing left to ask
        return


def materialize(df: DataFrame, label: str, **options: str) -> DataFrame:
    """Write a table to the shared folder and read it back: its lineage ends
    there, so a lost executor costs no more than the tasks that ran on it, and the
    shuffles of the write go with it instead of at some collection of the driver's
    garbage. options: of the writer."""
    spark = df.sparkSession
    path = new_path(spark, label)
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.options(**options).parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def lean_workers(spark: SparkSession) -> None:
    """Python workers of functions made from now on hold little between their tasks."""
    spark.sparkContext.environment.update(LEAN)


@contextmanager
def few_rows(spark: SparkSession) -> Iterator[None]:
    """Arrow batches of 1,000 rows for the jobs within: whole texts go in and come out,
    so the usual 10,000 would fill a worker's and the writer's memory several times."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    was = spark.conf.get(name)
    spark.conf.set(name, "1000")
    try:
        yield
    finally:
        spark.conf.set(name, was)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
