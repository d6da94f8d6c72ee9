import re
from collections import defaultdict

import numpy as np
from pyspark.sql import functions as F
from spanwise.llm import mixing
from spanwise.session import load

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def check(spark, docs):
    rows = [r.asDict() for r in mixing.assignments(docs).collect()]
    given = docs.select("doc_id", "source", "text").collect()
    assert len(rows) == len(given)
    size, taken, target = defaultdict(int), defaultdict(int), {}
    for r in given:
        size[r["source"]] += len(WORD.findall(r["text"] or ""))
    for r in rows:
        assert r["size"] == len(WORD.findall(r["text"] or "")) and r["source_size"] == size[r["source"]]
        assert r["taken"] <= 3 * r["size"] and r["taken"] == sum(t["words"] for t in r["takes"])
        assert len({t["epoch"] for t in r["takes"]}) == len(r["takes"])
        taken[r["source"]] += r["taken"]
        target[r["source"]] = r["target"]
    order = sorted(size, key=lambda s: (s is None, s or ""))
    want = mixing.targets([size[s] for s in order], [1 + i % 3 for i in range(len(order))])
    for s, t in zip(order, want):
        assert target[s] == t and abs(taken[s] - t) <= 1 and t <= 3 * size[s] + 1e-6
    if order:
        assert abs(sum(want) - sum(size.values())) < 1e-6 * max(1, sum(want))
    return rows


def test_targets():
    assert mixing.targets([100, 100, 100], [1, 2, 3]) == [50, 100, 150]
    assert mixing.targets([10, 290, 0], [3, 1, 2]) == [30, 270, 0]
    assert mixing.targets([], []) == [] and mixing.targets([0], [1]) == [0]


def test_leaves_partition_the_quota():
    quota = np.array([50, 0, 7, 300])
    parts = [mixing.leaf(quota, 7, i) for i in range(7)]
    assert (sum(p[0] for p in parts) == quota).all()
    done = np.zeros(4, int)
    for share, before in parts:
        assert (before == done).all() and 50 <= share.sum() <= 52
        done += share


def test_cases(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCK_WORDS", 50)
    monkeypatch.setattr(mixing, "SHARD_WORDS", 100)
    rows = [(i, ["b", "a", None, "é", "z"][i % 5 if i % 7 else 0], "w " * (i % 23) if i % 11 else None, i) for i in range(300)]
    rows += [(1, "a", "same text", 1)] * 3 + [(None, "tiny", "x", 0), (900, "a", "long " * 5000, 2), (901, "none", "", 3)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string, size long")
    first = check(spark, docs)
    again = mixing.assignments(docs.repartition(7)).collect()
    key = lambda r: (str(r["doc_id"]), r["text"] or "", r["taken"], str(r["takes"]))
    assert sorted(map(key, first)) == sorted(map(key, again))
    out = mixing.mixed(docs)
    assert out.columns == docs.columns
    n = out.select(F.sum(mixing.word_count())).first()[0]
    assert n == sum(r["taken"] for r in first)
    check(spark, docs.limit(0))


def test_given_documents(spark, sf_dir):
    check(spark, load(spark, sf_dir, "documents"))


def test_clashing_columns(spark):
    docs = spark.createDataFrame([(i, "ab"[i % 2], "one two three") for i in range(20)], "doc_id long, source string, text string")
    names = ["s", "rest", "blocks", "epochs", "places", "h", "b", "before", "words", "take", "takes", "target"]
    more = docs.select("*", *[F.lit(7).alias(n) for n in names])
    got = mixing.assignments(more)
    assert all(r[n] == 7 for r in got.collect() for n in names[:10])
    plain = {(r["doc_id"], r["taken"], r["target"]) for r in mixing.assignments(docs).collect()}
    assert {(r["doc_id"], r["taken"], r["target"]) for r in got.collect()} == plain
    assert mixing.mixed(more).columns == more.columns and mixing.mixed(more).count() == mixing.mixed(docs).count()
