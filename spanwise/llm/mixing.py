"""Mixing sources to target weights, with a multivariate hypergeometric tree.

Sizes are numbers of words. Sources share the total by weight; no target exceeds
``MAX_EPOCHS`` times its source's size, and the excess is shared again by weight.
The mix takes each source ``target // size`` times whole and ``target % size``
words once more, so it hits its target to a word; the document on that edge is
cut after as many words as are left.

A source's documents are put in a random order by a keyed hash and cut into
blocks of about ``BLOCK_WORDS`` words. The blocks that the target needs are the
source's exact quota. The quotas of all sources are split among output shards by
a binary tree: each node deals its quotas to its halves by a multivariate
hypergeometric draw seeded by the node, so every shard gets a random mix with no
block lost or dealt twice, and any task can walk from the root to its own leaf.
A shard's share of a source is a range of that source's permuted blocks; shards
are shuffled locally by a keyed hash.

Rows of a source are spread over its blocks, so a source with a third of all
words is a third of the blocks. Only totals of sources reach the driver: at most
``MAX_SOURCES`` rows, above which the operator fails rather than drop any (the
tree's quotas are one number a source in every task). Their table is broadcast
up to ``BROADCAST_SOURCES`` rows and joined by shuffle beyond.

Cases: null sources are a source of their own, the last. Null and empty texts
have size 0 and are never taken. Repeated rows count each. Ties in the hash order
break by id, size and text hash. Equal input gives equal output on every run,
whatever its partitions. Extra columns are kept; the names ``size``,
``source_size``, ``target``, ``taken`` and ``takes`` are replaced; names that begin
with two underscores are the operator's own.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import gcd

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from spanwise.session import load, materialize

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (1, 2, 3)
MAX_EPOCHS = 3
MAX_SOURCES = 1_000_000
BROADCAST_SOURCES = 10_000
BLOCK_WORDS = 65_536
SHARD_WORDS = 1_000_000
SEED = 17


def word_count(text="text"):
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: list[int], weights: list[float], most: int = MAX_EPOCHS) -> list[float]:
    """Shares of the total by weight, none above ``most`` times its size."""
    total, out, free = float(sum(sizes)), [0.0] * len(sizes), set(range(len(sizes)))
    while free:
        weight = sum(weights[i] for i in free)
        share = {i: total * weights[i] / weight for i in free}
        over = [i for i in sorted(free) if share[i] > most * sizes[i]]
        for i in over or free:
            out[i] = float(most * sizes[i]) if over else share[i]
        if not over:
            break
        total -= sum(out[i] for i in over)
        free -= set(over)
    return out


def leaf(quota: np.ndarray, shards: int, shard: int, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    """Blocks of each source that a shard gets, and how many go to shards before it."""
    lo, hi, node, before = 0, shards, 1, np.zeros(len(quota), np.int64)
    while hi - lo > 1:
        mid, total = (lo + hi) // 2, int(quota.sum())
        rng = np.random.default_rng([seed, node])
        left = rng.multivariate_hypergeometric(quota, total * (mid - lo) // (hi - lo), method="marginals")
        if shard < mid:
            quota, hi, node = left, mid, 2 * node
        else:
            quota, before, lo, node = quota - left, before + left, mid, 2 * node + 1
    return quota, before


def _step(n: int) -> int:
    """A multiplier near the golden section that permutes 0..n-1."""
    step = max(1, int(n * 0.6180339887))
    while gcd(step, n) != 1:
        step += 1
    return step


def assignments(docs: DataFrame, weights: tuple = WEIGHTS, seed: int = SEED) -> DataFrame:
    """docs with size, source_size, target, taken and takes: an array of (epoch,
    shard, words) of the places where the mix holds the document."""
    spark = docs.sparkSession
    tie = [F.col("doc_id"), F.col("size"), F.xxhash64("text")]
    sized = docs.drop("source_size", "target", "taken", "takes").withColumn("size", word_count())
    totals = sized.groupBy("source").agg(F.sum("size").alias("total")).limit(MAX_SOURCES + 1).collect()
    if len(totals) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    totals = sorted(((r["source"], int(r["total"])) for r in totals), key=lambda r: (r[0] is None, (r[0] or "").encode()))
    sizes = [n for _, n in totals]
    wanted = targets(sizes, [weights[i % len(weights)] for i in range(len(sizes))])
    plan = [(source, i, n, t, *(divmod(round(t), n) if n else (0, 0)), max(1, -(-n // BLOCK_WORDS))) for i, ((source, n), t) in enumerate(zip(totals, wanted))]
    table = spark.createDataFrame(plan, "__source string, __s int, source_size long, target double, __epochs long, __rest long, __blocks long")
    table = F.broadcast(table) if len(plan) <= BROADCAST_SOURCES else materialize(table, "mix-sources")
    keyed = sized.join(table, F.col("source").eqNullSafe(F.col("__source"))).drop("__source")
    keyed = keyed.withColumn("__h", F.xxhash64(F.lit(seed), "doc_id", F.xxhash64("text")))
    keyed = keyed.withColumn("__b", F.shiftright(F.shiftrightunsigned("__h", 33) * F.col("__blocks"), 31))

    # where each block starts in its source's order: sums by 1024 blocks, then by block
    block = materialize(keyed.groupBy("__s", "__b", "__rest").agg(F.sum("size").alias("words")), "mix-blocks").withColumn("__upper", F.shiftright("__b", 10))
    upper = block.groupBy("__s", "__upper").agg(F.sum("words").alias("__up"))
    upper = upper.withColumn("__up_start", F.sum("__up").over(Window.partitionBy("__s").orderBy("__upper")) - F.col("__up"))
    block = block.join(upper.drop("__up"), ["__s", "__upper"]).withColumn(
        "__block_start", F.col("__up_start") + F.sum("words").over(Window.partitionBy("__s", "__upper").orderBy("__b")) - F.col("words")
    )
    block = materialize(block.select("__s", "__b", "__rest", "__block_start"), "mix-starts")
    edge = {r["__s"]: r["edge"] for r in block.where("__block_start < __rest").groupBy("__s").agg(F.max("__b").alias("edge")).collect()}
    quota = np.array([p[4] * p[6] + (edge.get(p[1], -1) + 1) for p in plan], dtype=np.int64)
    blocks = [p[6] for p in plan]
    shards = max(1, sum(round(t) for t in wanted) // SHARD_WORDS)
    steps = [_step(int(q)) if q else 1 for q in quota]

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for shard in batch["id"].tolist():
                share, before = leaf(quota, shards, shard, seed)
                for s in np.flatnonzero(share).tolist():
                    unit = (np.arange(before[s], before[s] + share[s]) * steps[s] + seed) % quota[s]
                    yield pd.DataFrame({"__s": s, "__b": unit % blocks[s], "epoch": unit // blocks[s], "shard": shard})

    dealt = spark.range(shards).mapInPandas(deal, "__s int, __b long, epoch long, shard long")
    dealt = dealt.groupBy("__s", "__b").agg(F.sort_array(F.collect_list(F.struct("epoch", "shard"))).alias("__places"))
    place = block.join(dealt, ["__s", "__b"], "left").select("__s", "__b", "__block_start", "__places")

    order = Window.partitionBy("__s", "__b").orderBy("__h", *tie).rowsBetween(Window.unboundedPreceding, -1)
    whole = keyed.withColumn("__before", F.coalesce(F.sum("size").over(order), F.lit(0))).join(place, ["__s", "__b"])
    left = F.col("__rest") - F.col("__block_start") - F.col("__before")
    words = lambda p: F.when(p["epoch"] < F.col("__epochs"), F.col("size")).otherwise(F.greatest(F.lit(0), F.least(F.col("size"), left)))
    takes = F.transform(F.coalesce("__places", F.array()), lambda p: F.struct(p["epoch"].alias("epoch"), p["shard"].alias("shard"), words(p).alias("words")))
    whole = whole.withColumn("takes", F.filter(takes, lambda t: t["words"] > 0))
    whole = whole.withColumn("taken", F.aggregate("takes", F.lit(0).cast("long"), lambda x, t: x + t["words"]))
    return whole.drop("__s", "__b", "__epochs", "__rest", "__blocks", "__h", "__before", "__block_start", "__places")


def mixed(docs: DataFrame, weights: tuple = WEIGHTS, seed: int = SEED) -> DataFrame:
    """The rows of the mix in shuffled shards, in the columns of docs: a document
    once for each time it is taken, cut where the mix takes a part of it."""
    columns = docs.columns
    rows = assignments(docs, weights, seed).withColumn("__take", F.explode("takes"))
    part = F.array_join(F.slice(F.regexp_extract_all("text", F.lit(WORD), 0), F.lit(1), F.col("__take.words").cast("int")), " ")
    rows = rows.withColumn("text", F.when(F.col("__take.words") < F.col("size"), part).otherwise(F.col("text")))
    rows = rows.withColumn("__at", F.xxhash64(F.lit(seed), "__take", "doc_id", F.xxhash64("text")))
    return rows.repartition("__take.shard").sortWithinPartitions("__take.shard", "__at").select(*columns)


def query(spark, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents").select("doc_id", "source", "text")
    narrow = assignments(docs)
    shard = F.col("takes.shard")
    return narrow.select("doc_id", "size", "source_size", "target", "taken", F.size("takes").alias("n_takes"), F.array_min(shard).alias("first_shard"), F.array_max(shard).alias("last_shard"))
