import re
from itertools import combinations

import numpy as np
import pytest
from spanwise.llm import components as components_module
from spanwise.llm import jaccard_join
from spanwise.llm.components import components
from spanwise.session import load

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def brute(rows):
    sets = []
    for _, text in rows:
        w = WORD.findall((text or "").translate(LOWER))
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, j in combinations(range(len(rows)), 2):
        if sets[i] and sets[j] and min(len(sets[i]), len(sets[j])) * 100 >= 80 * max(len(sets[i]), len(sets[j])):
            both = len(sets[i] & sets[j])
            if 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                parent[find(i)] = find(j)
    out = []
    for i, (doc_id, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if find(j) == find(i) and rows[j][0] is not None]
        out.append((doc_id, len(sets[i]), min(ids) if ids else None))
    return sorted(out, key=str)


def check(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((tuple(r) for r in jaccard_join.similar_components(docs).collect()), key=str)
    assert got == brute(rows)


def test_cases(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "PAIRWISE", 8)  # so that the ways for large groups are taken
    monkeypatch.setattr(jaccard_join, "LEADERS", 2)
    rng = np.random.default_rng(5)
    word = lambda n, k=3000: [f"w{x}" for x in rng.integers(0, k, n)]
    base, passage = word(120), word(30)
    rows = [(1, None), (2, ""), (3, " \n"), (4, "One two"), (5, "one TWO"), (6, "one two three four"), (7, "É a b c d"), (8, "é a b c d"), (None, "x y z"), (None, "x y z"), (9, "x y z")]
    for i in range(60):  # near copies that are similar to some of the others only
        near = list(base)
        for k in rng.integers(0, 120, int(rng.integers(0, 4))):
            near[k] = f"v{rng.integers(0, 10**6)}"
        rows.append((100 + i, " ".join(near)))
    rows += [(300 + i, " ".join(word(40) + passage + word(40))) for i in range(40)]
    rows += [(400 + i % 3, " ".join(base[:100]) + " tail" * i) for i in range(4)]
    check(spark, rows)


def test_given_documents(spark, sf_dir):
    check(spark, [tuple(r) for r in load(spark, sf_dir, "documents").select("doc_id", "text").collect()])


def test_few_nodes_under_a_frequent_token(spark, monkeypatch):
    """A passage of many rows that makes up the texts of few: its tokens are split
    into parts by the rows, and the few nodes still meet."""
    monkeypatch.setattr(jaccard_join, "SALT_ABOVE", 4)
    monkeypatch.setattr(jaccard_join, "LEADERS", 1)
    rng = np.random.default_rng(8)
    word = lambda n: [f"w{x}" for x in rng.integers(0, 10**6, n)]
    passage = word(100)
    rows = [(i, " ".join(passage + word(5))) for i in range(6)]
    rows += [(1000 + i, " ".join(word(300) + passage + word(300))) for i in range(400)]
    check(spark, rows)


def test_percent_and_link_counts(spark, monkeypatch):
    """At 50 percent, prefixes and sizes let more through than at 80; links inside
    the component of a large group are all counted."""
    monkeypatch.setattr(jaccard_join, "PAIRWISE", 8)
    monkeypatch.setattr(jaccard_join, "LEADERS", 2)
    monkeypatch.setattr(jaccard_join, "BLOCK", 16)
    rng = np.random.default_rng(11)
    word = lambda n: [f"w{x}" for x in rng.integers(0, 10**6, n)]
    rows = [(1, None), (2, "x y"), (3, "x y"), (None, "x y")]
    for i in range(10):  # one is 0.55 of the other and inside it
        base = word(100)
        rows += [(100 + 2 * i, " ".join(base)), (101 + 2 * i, " ".join(base[:57]))]
    base = word(120)
    for i in range(60):
        near = list(base)
        for k in rng.integers(0, 120, int(rng.integers(0, 9))):
            near[k] = f"v{rng.integers(0, 10**6)}"
        rows.append((200 + i, " ".join(near)))
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w := (t or "").split()) >= 5 else {tuple(w)} if w else set() for _, t in rows]
    like = [[j for j, y in enumerate(sets) if j != i and x and y and 2 * len(x & y) >= len(x | y)] for i, x in enumerate(sets)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((tuple(r) for r in jaccard_join.link_counts(docs, 50).collect()), key=str)
    assert got == sorted(((d, len(x), len(n)) for (d, _), x, n in zip(rows, sets, like)), key=str)
    component = {r["doc_id"]: r["component_id"] for r in jaccard_join.similar_components(docs, 50).collect()}
    assert all(component[101 + 2 * i] == 100 + 2 * i for i in range(10))


def _shuffled(spark):
    """Bytes that the session has written to shuffles."""
    sc, jvm = spark.sparkContext, spark.sparkContext._jvm
    sc._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    stages = sc._jsc.sc().statusStore().stageList(jvm.java.util.ArrayList(), False, False, sc._gateway.new_array(jvm.double, 0), jvm.java.util.ArrayList())
    return {(s.stageId(), s.attemptId()): s.shuffleWriteBytes() for s in (stages.apply(k) for k in range(stages.size()))}


def test_only_texts_of_pairs_move(spark):
    """Of texts that meet no other none is shuffled."""
    rng = np.random.default_rng(3)
    word = lambda n: [f"w{x:x}" for x in rng.integers(0, 2**62, n)]
    rows = [(i, " ".join(word(1_000))) for i in range(400)]
    rows += [(1_000, rows[7][1] + " tail"), (1_001, rows[7][1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    nodes = jaccard_join._nodes(docs)
    needed = nodes.where("doc_id in (7, 1000)").select("node").distinct()
    docs.cache().count()
    before = _shuffled(spark)
    found = jaccard_join._sets(docs, nodes, needed, (np.zeros(0, np.uint64), np.zeros(0, np.int64)), 80)
    assert sum(n for s, n in _shuffled(spark).items() if s not in before) < sum(len(t) for _, t in rows) // 20
    assert found.count() == 2 and found.distinct().count() == 2


def test_empty(spark):
    assert jaccard_join.similar_components(spark.createDataFrame([], "doc_id long, text string")).collect() == []


@pytest.mark.parametrize("n, held", [(1, 1_000), (5, 2), (60, 20), (60, 1_000)])
def test_components(spark, monkeypatch, n, held):
    """With links dealt to one task and to several."""
    monkeypatch.setattr(components_module, "LINKS", held)
    chain = [(i, i + 1) for i in range(n)] + [(1000, 1001), (1001, 1000), (7, 7)]
    got = {(r["node"], r["root"]) for r in components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {(i, 0) for i in range(1, n + 1)} | {(1001, 1000)}
