"""From raw documents to packed training sequences.

Quality rules drop what they reject; of each group of near-duplicates one document
stays; passages that repeat are cut out; sources are mixed to target weights; and
the mix is packed. Each stage takes the table that the stage before it wrote.

Cases: null and empty texts fail the quality rules; a document of which substring
dedup leaves nothing is dropped; empty tables give empty ones; rows may repeat,
and the mix repeats documents on purpose.

Workers stay from stage to stage, so each stage runs its Python work itself, in small
batches and in workers that give freed memory back; what it returns is read or joined.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanwise.llm import jaccard_join, mixing, packing, quality_rules, substring_dedup
from spanwise.session import few_rows, lean_workers, load, materialize

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Expectation-maximisation, similarity joins and random draws are not SQL.
ORACLE_SQL = None
#: Executors hold what five stages leave behind, so the encoder keeps few words.
CACHE_ENTRIES = 100_000


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the quality rules keep."""
    lean_workers(spark)
    with few_rows(spark):
        counted = materialize(quality_rules.with_counts(docs.select(*COLUMNS)), "quality-counts")  # read twice: for the votes and for the verdicts
    return quality_rules.judged(counted).where("kept").select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked rows the one with the least doc_id, and of several
    such the one with the least hash; ids may repeat or be null."""
    key = F.xxhash64(F.col("doc_id").cast("long"), "text").alias("__key")
    lean_workers(spark)
    with few_rows(spark):
        keep = jaccard_join.representatives(docs).select(F.col("key").alias("__key"))
    rows = docs.select(key, *COLUMNS).join(keep, "__key", "left_semi")
    return rows.groupBy("__key").agg(F.min(F.struct("doc_id", "text", "lang", "source", "n_chars")).alias("row")).select("row.*").select(*COLUMNS)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without their repeated passages; those left empty go. A text that
    loses words is its kept words with one space between."""
    lean_workers(spark)
    with few_rows(spark):
        cut = materialize(substring_dedup.dedup_documents(docs).select("__key", "kept_text").dropDuplicates(["__key"]), "cut-documents")
    keyed = docs.select(*COLUMNS).withColumn("__key", F.xxhash64("doc_id", "text")).join(cut, "__key", "left")
    text = F.coalesce("kept_text", "text")
    return keyed.where(text != "").select("doc_id", text.alias("text"), "lang", "source", F.length(text).cast("long").alias("n_chars"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The sources in their target weights, documents repeated as often as taken."""
    lean_workers(spark)
    return mixing.mixed(docs.select(*COLUMNS)).withColumn("n_chars", F.length("text").cast("long"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the mix with their places in training sequences."""
    lean_workers(spark)
    with few_rows(spark):
        return materialize(packing.packed(docs, entries=CACHE_ENTRIES, special=True), "packed")


STAGES = [
    ("quality rules", quality),
    ("n-gram Jaccard join", near_duplicates),
    ("substring dedup", repeated_passages),
    ("mixing sources", mix),
    ("packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = materialize(docs, f"pipeline-{k}")
    return docs
