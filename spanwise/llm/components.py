"""Connected components of a link table, by union-find in tasks and, between
tasks, alternating large and small stars.

Links are dealt to tasks of ``LINKS`` links at most; each merges its own with a
union-find and keeps one link a node. If there was one such task, that is the
result. Otherwise a round replaces the links of a node by links to the least node
around it, a grouped minimum (combined map-side) and an equi-join, and the rounds
end when one changes nothing, after a number that grows with the logarithm of the
longest chain. Every step is written to the shared folder."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanwise.session import materialize


#: Links that one task merges: it bounds the task's table of nodes.
LINKS = 500_000


def _merge_local(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        root = x
        while parent.setdefault(root, root) != root:
            root = parent[root]
        while parent[x] != root:
            parent[x], x = root, parent[x]
        return root

    for batch in batches:
        for a, b in zip(batch["a"].tolist(), batch["b"].tolist()):
            x, y = find(a), find(b)
            if x != y:
                parent[max(x, y)] = min(x, y)
    rows = [(x, find(x)) for x in list(parent)]
    yield pd.DataFrame([r for r in rows if r[0] != r[1]], columns=["a", "b"], dtype="int64")


def _star(links: DataFrame, large: bool) -> DataFrame:
    both = links.union(links.select("b", "a")) if large else links
    least = both.groupBy("a").agg(F.min("b").alias("least"))
    joined = both.join(least.select("a", F.least("a", "least").alias("m")), "a")
    kept = joined.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")) if large else joined.select(
        F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct(F.col("a"), F.col("m").alias("b")))).alias("x")
    ).select("x.a", "x.b")
    return kept.where("a <> b").distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, root): root is the least node of the component. Only linked nodes
    appear. links: a and b (long); order, repeats and loops do not matter."""
    seen, now = None, materialize(links.select("a", "b").where("a <> b"), "links")
    many = now.count()
    while True:
        parts = -(-many // LINKS)
        # dealt out by count, not by key: no node's links gather in one task
        now = materialize(now.repartition(max(parts, 1)).mapInPandas(_merge_local, "a long, b long"), "links")
        if parts <= 1:  # one task has seen every link
            return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
        star = _star(now.distinct(), True)  # every row: a larger node and a smaller one
        now = materialize(_star(star.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")), False), "links")
        state = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if tuple(state) == seen:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
        seen, many = tuple(state), state["n"]
