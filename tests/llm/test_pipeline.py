from collections import Counter

import corpus_pipeline as p
from spanwise.llm import mixing, quality_rules
from spanwise.session import load
from tests.llm.test_jaccard_join import brute as components
from tests.llm.test_substring_dedup import WORD


def test_stages(spark, sf_dir):
    docs = load(spark, sf_dir, "documents")
    docs = docs.unionByName(docs.limit(3)).cache()
    kept = p.quality(spark, docs, sf_dir).cache()
    verdict = {r["doc_id"]: r["kept"] for r in quality_rules.judged(quality_rules.with_counts(docs).drop("text")).collect()}
    assert {r["doc_id"] for r in kept.collect()} == {d for d, k in verdict.items() if k} and kept.columns == p.COLUMNS

    single = p.near_duplicates(spark, kept, sf_dir).cache()
    want = {d for d, _, c in components([(r["doc_id"], r["text"]) for r in kept.collect()]) if d == c}
    assert sorted(r["doc_id"] for r in single.collect()) == sorted(want)

    cut = p.repeated_passages(spark, single, sf_dir).cache()
    rows = {r["doc_id"]: r["text"] for r in single.collect()}
    words = {d: WORD.findall(t) for d, t in rows.items()}
    count = Counter(tuple(w[i : i + 35]) for w in words.values() for i in range(len(w) - 34))
    got = {r["doc_id"]: r["text"] for r in cut.collect()}
    for d, w in words.items():
        gone = {j for i in range(len(w) - 34) if count[tuple(w[i : i + 35])] > 1 for j in range(i, i + 35)}
        left = " ".join(x for i, x in enumerate(w) if i not in gone)
        assert got.get(d) == (rows[d] if not gone else left or None)

    mixed = p.mix(spark, cut, sf_dir).cache()
    n = cut.select(mixing.word_count().alias("n")).groupBy().sum("n").first()[0]
    assert abs(mixed.select(mixing.word_count().alias("n")).groupBy().sum("n").first()[0] - n) < 30 and mixed.columns == p.COLUMNS

    packed = p.pack(spark, mixed, sf_dir).collect()
    assert {r["doc_id"] for r in packed} == {r["doc_id"] for r in mixed.collect()}


def test_near_duplicates_by_row(spark, sf_dir):
    """Ids may repeat or be null: one row of each group of linked texts stays."""
    text = lambda c: " ".join(f"{c}{i}" for i in range(60))
    a, b, c, d = map(text, "abcd")
    near = lambda t: t + " end"
    rows = [(1, a), (1, b), (2, near(b)), (2, near(a)), (3, b), (None, c), (None, c), (None, near(c)), (None, d), (4, d), (4, d)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = [(r["doc_id"], r["text"]) for r in p.near_duplicates(spark, docs, sf_dir).collect()]
    assert len(got) == 4 and {(1, a), (1, b), (4, d)} < set(got) and {x for x in got if x[0] is None} < {(None, c), (None, near(c))}


def test_empty(spark, sf_dir):
    docs = load(spark, sf_dir, "documents").limit(0)
    for _, stage in p.STAGES:
        docs = stage(spark, docs, sf_dir)
    assert docs.collect() == []


def test_stages_hold_little_memory(spark, sf_dir, monkeypatch):
    """Stages run their Python work in small batches, in workers that give freed memory back."""
    docs = load(spark, sf_dir, "documents").select(*p.COLUMNS).limit(30)
    name, seen = "spark.sql.execution.arrow.maxRecordsPerBatch", []
    was = spark.conf.get(name)

    def spied(module, call):
        real = getattr(module, call)
        monkeypatch.setattr(module, call, lambda *a, **b: (seen.append((call, spark.conf.get(name))), real(*a, **b))[1])

    for module, call in ((p.quality_rules, "with_counts"), (p.jaccard_join, "representatives"), (p.substring_dedup, "dedup_documents"), (p.packing, "packed")):
        spied(module, call)
    for stage in (p.quality, p.near_duplicates, p.repeated_passages, p.pack):
        left = stage(spark, docs, sf_dir)
        assert "Pandas" not in left._jdf.queryExecution().executedPlan().toString() and spark.conf.get(name) == was
    assert len(seen) == 4 and {rows for _, rows in seen} == {"1000"}

    def told(batches):
        import os

        import pandas as pd
        import pyarrow as pa

        for _ in batches:
            yield pd.DataFrame({"threshold": [os.environ.get("MALLOC_TRIM_THRESHOLD_")], "pool": [pa.default_memory_pool().backend_name]})

    assert {tuple(r) for r in spark.range(4).mapInPandas(told, "threshold string, pool string").collect()} == {(str(4 << 20), "system")}
