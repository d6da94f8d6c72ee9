from itertools import combinations

import numpy as np
from spanwise.llm import toxicity as tx
from spanwise.session import load


def brute(s, t, n=tx.ORDER, decay=tx.DECAY):
    total = 0.0
    for i in combinations(range(len(s)), n):
        for j in combinations(range(len(t)), n):
            if all(s[a] == t[b] for a, b in zip(i, j)):
                total += decay ** (i[-1] - i[0] + 1 + j[-1] - j[0] + 1)
    return total


def test_kernel_equals_its_definition():
    rng = np.random.default_rng(2)
    words = ["".join(rng.choice(list("abcé"), int(rng.integers(1, 9)))) for _ in range(60)]
    left, right = words[:30], words[30:]
    assert np.allclose(tx.subsequence_kernel(left, right), [brute(a, b) for a, b in zip(left, right)])


def test_gaps_and_inserted_letters():
    marks = tx.Landmarks(["idiot", "worthless"])
    value = marks.kernel(["idiot", "idxiot", "iddiot", "worthleess", "table", "id"])
    assert np.allclose(value[0], [1, 0]) and value[1, 0] > 0.5 and value[2, 0] > 0.7 and value[3, 1] > 0.8 and not value[4:].any()


def test_held_out(spark):
    sf = "/root/testdata/sf0.1"
    rows = tx.query(spark, sf).join(load(spark, sf, "labels"), "doc_id").where("held_out").collect()
    y, p = np.array([r["toxic"] for r in rows]), np.array([r["predicted"] for r in rows])
    print(len(rows), p[y == 1].mean(), p[y == 0].mean())
    assert len(rows) > 500 and p[y == 1].mean() > 0.7 and p[y == 0].mean() < 0.05
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_cases(spark):
    clean = "the house on the hill stands near a lake. "
    rows = [(i, clean * (1 + i % 3) + ("you utter numbskull blockhead. " if i % 4 == 0 else "")) for i in range(120)]
    more = [(500, None), (501, ""), (502, "you n.u.m.b.s.k.u.l.l"), (503, "what a n u m b s k u l l he is"), (504, clean * 3000), (505, "z" * 5000), (505, "z" * 5000), (None, "numbskull")]
    docs = spark.createDataFrame(rows + more, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(120)] + [(None, 1), (1, None)], "doc_id long, toxic int")
    model = tx.train(docs, labels)
    got = {(r["doc_id"], r["text"]): r["predicted"] for r in tx.score(docs, model).collect()}
    assert [got[k] for k in more] == [0, 0, 1, 1, 0, 0, 0, 1]
    assert all(got[i, t] == (i % 4 == 0) for i, t in rows)
    assert {r["score"] for r in tx.score(docs, tx.train(docs, labels.limit(0))).collect()} == {0.0}
    assert tx.score(docs.limit(0), model).collect() == []


def test_texts_above_the_budget_leave_only_themselves_out(spark, monkeypatch):
    """One labelled text longer than all room for training, wherever its hash puts it."""
    monkeypatch.setattr(tx, "TRAIN_CHARS", 20_000)
    clean = "the house on the hill stands near a lake. "
    rows = [(i, clean + ("you utter numbskull blockhead. " if i % 4 == 0 else "")) for i in range(120)]
    for giant, label in ((7, 0), (8, 1)):
        docs = spark.createDataFrame([(i, clean * 2_000 + t if i == giant else t) for i, t in rows], "doc_id long, text string")
        model = tx.train(docs, spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(120)], "doc_id long, toxic int"))
        got = {r["doc_id"]: r["predicted"] for r in tx.score(docs, model).collect()}
        assert all(got[i] == (i % 4 == 0) for i, _ in rows)
    some = [{"toxic": 0, "chars": 90, "row": 1}, {"toxic": 1, "chars": 5, "row": 2}, {"toxic": 1, "chars": 70, "row": 3}, {"toxic": 1, "chars": 4, "row": 4}]
    assert tx._fitting(some, 100) == [1, 4, 2]
