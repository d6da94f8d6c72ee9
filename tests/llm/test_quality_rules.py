import re
from collections import Counter

import numpy as np
from spanwise.llm import quality_rules as q
from spanwise.session import load

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def base(text):
    text = text or ""
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    count = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    hit = {j for i in range(len(words) - 7) if count[tuple(words[i : i + 8])] > 1 for j in range(i, i + 8)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), sum(x in lines[:i] for i, x in enumerate(lines)), len(hit)


def test_counts(spark, sf_dir):
    rows = [(r["doc_id"], r["text"]) for r in load(spark, sf_dir, "documents").collect()]
    rows += [(None, None), (-1, ""), (-2, " \n\t"), (-3, "a b\n\x85 é\n a b\na b\na b"), (-4, "x y z w v u t s r " * 30), (-5, "same " * 9), (-6, "<|>" * 3), (-6, "<|>" * 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = q.judged(q.with_counts(docs).drop("text")).collect()
    key = lambda r: tuple(map(str, r))
    assert sorted(((r["doc_id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) for r in got), key=key) == sorted(((d, *base(t)) for d, t in rows), key=key)
    for r in got:
        assert r["base_failed"] == (r["n_words"] < 20 or 100 * r["n_repeat_words"] > 30 * r["n_words"])
        assert not (r["base_failed"] and r["kept"]) and 0 <= r["quality"] <= 1


def test_verdicts_follow_labels(spark):
    docs = load(spark, "/root/testdata/sf0.01", "documents").join(load(spark, "/root/testdata/sf0.01", "labels"), "doc_id")
    rows = [(r["quality_label"], r["kept"]) for r in q.judged(q.with_counts(docs.withColumnRenamed("quality", "quality_label")).drop("text")).collect()]
    good, bad = [k for y, k in rows if y == 1], [k for y, k in rows if y == 0]
    print(np.mean(good), np.mean(bad))
    assert np.mean(good) > 0.97 and np.mean(bad) < 0.5


def test_empty(spark):
    assert q.judged(q.with_counts(spark.createDataFrame([], "doc_id long, text string"))).collect() == []


def test_clashing_columns(spark):
    docs = spark.createDataFrame([(1, "a b c", 5.0, "x"), (2, None, 6.0, "y")], "doc_id long, text string, quality double, kept string")
    rows = q.judged(q.with_counts(docs)).collect()
    assert [r["kept"] for r in rows] == [False, False] and all(0 <= r["quality"] <= 1 for r in rows)


def test_rates_are_rates():
    rng = np.random.default_rng(3)
    rate = q._better_than_chance(rng.integers(1, 50, (2, 40, 3)).astype(float))
    assert np.allclose(rate.sum(2), 1) and (rate > 0).all()


def test_posteriors_against_plain_loops():
    """The expectation-maximisation, written without arrays."""
    rng = np.random.default_rng(4)
    votes = np.unique(rng.integers(0, 3, (30, 4)), axis=0)
    count = rng.integers(1, 90, len(votes)).astype(float)
    good = [1 / (1 + np.exp(-(list(v).count(2) - 2.0 * list(v).count(0)))) for v in votes]
    for _ in range(200):
        was = list(good)
        prior = min(0.99, max(0.01, sum(c * g for c, g in zip(count, good)) / count.sum()))
        ratio = [np.log(prior / (1 - prior))] * len(votes)
        for r in range(votes.shape[1]):
            n = [[1.0 + sum(c * (g if k else 1 - g) for v, c, g in zip(votes, count, good) if v[r] == x) for x in range(3)] for k in (0, 1)]
            rate = [[x / sum(row) for x in row] for row in n]
            for vote, ahead in ((0, 0), (2, 1)):
                if rate[ahead][vote] < rate[1 - ahead][vote]:
                    shared = (n[0][vote] + n[1][vote]) / (sum(n[0]) + sum(n[1]))
                    rate = [[shared if x == vote else row[x] * (1 - shared) / (1 - row[vote]) for x in range(3)] for row in rate]
            ratio = [t + np.log(rate[1][v[r]]) - np.log(rate[0][v[r]]) for t, v in zip(ratio, votes)]
        good = [1 / (1 + np.exp(-min(60, max(-60, t)))) for t in ratio]
        if max(abs(a - b) for a, b in zip(good, was)) < 1e-9:
            break
    assert np.allclose(q.posteriors(votes, count), good, atol=1e-6)
