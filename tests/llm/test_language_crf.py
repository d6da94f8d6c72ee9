from itertools import product

import numpy as np
from pyspark.sql import functions as F
from spanwise.llm import language_crf as crf
from spanwise.session import load


def test_forward_backward_equals_enumeration():
    rng = np.random.default_rng(1)
    emission, transition = rng.normal(size=(2, 4, 3)), rng.normal(size=(3, 3))
    real = np.array([[True] * 4, [True, True, False, False]])
    posterior, moves = crf.forward_backward(emission, transition, real)
    want_moves = np.zeros((3, 3))
    for c, n in ((0, 4), (1, 2)):
        total, mass, pair = 0.0, np.zeros((n, 3)), np.zeros((3, 3))
        for path in product(range(3), repeat=n):
            p = np.exp(sum(emission[c, t, y] for t, y in enumerate(path)) + sum(transition[a, b] for a, b in zip(path, path[1:])))
            total += p
            for t, y in enumerate(path):
                mass[t, y] += p
            for a, b in zip(path, path[1:]):
                pair[a, b] += p
        assert np.allclose(posterior[c, :n], mass / total)
        want_moves += pair / total
    assert np.allclose(moves, want_moves)


def test_features_do_not_depend_on_neighbours():
    one, start = crf.features(["haus", "a", "été"], {"a": 1})
    for i, w in enumerate(["haus", "a", "été"]):
        alone, _ = crf.features([w], {"a": 1})
        assert sorted(alone) == sorted(one[start[i] : [*start, len(one)][i + 1]])


def test_held_out_accuracy_and_code_switching(spark):
    sf = "/root/testdata/sf0.01"
    rows = crf.query(spark, sf).join(load(spark, sf, "documents").select("doc_id", "lang", "text"), "doc_id").where("held_out and lang is not null and text is not null").collect()
    right = np.mean([r["lang"] == r["lang_pred"] for r in rows])
    assert len(rows) > 200 and right > 0.95, right
    assert all(0 <= r["score"] <= 1 for r in rows)
    docs = load(spark, sf, "documents").where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 != 2)
    model = crf.train(docs)
    pick = lambda lang: next(r["text"] for r in rows if r["lang"] == lang == r["lang_pred"] and len(r["text"].split()) > 60)
    a, b = pick("en").split()[10:40], pick("de").split()[10:40]
    (places, posterior), = crf.label_words(model, [" ".join(a + b)])
    got = [model.labels[i] for i in posterior.argmax(1)]
    assert np.mean([x == ("en" if p < 30 else "de") for x, p in zip(got, places)]) > 0.9


def test_cases(spark):
    rows = [(1, None, "xx"), (2, "", None), (3, "123 -- !", None), (4, "the cat is on the mat", "en"), (5, "der hund ist in dem haus", "de"), (6, "der hund " * 3000, None), (6, "der hund " * 3000, None), (None, "the mat", "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {(r["doc_id"], r["text"]): (r["lang_pred"], r["score"]) for r in crf.predict(docs, crf.train(docs)).collect()}
    assert got[1, None] == got[2, ""] == got[3, "123 -- !"] == ("und", 0.0)
    assert got[6, "der hund " * 3000][0] == "de" and got[None, "the mat"][0] == "en"
    none = docs.where("lang is null")
    assert {r["lang_pred"] for r in crf.predict(none, crf.train(none)).collect()} == {"und"}
    assert crf.predict(docs.limit(0), crf.train(docs.limit(0))).collect() == []
