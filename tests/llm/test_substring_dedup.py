import hashlib
import re
from collections import Counter

import numpy as np
from spanwise.llm.substring_dedup import removed_words
from spanwise.session import load

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows, width=35):
    words = [WORD.findall(t or "") for _, t in rows]
    count = Counter(tuple(w[i : i + width]) for w in words for i in range(len(w) - width + 1))
    out = []
    for (doc_id, _), w in zip(rows, words):
        gone = set()
        for i in range(len(w) - width + 1):
            if count[tuple(w[i : i + width])] > 1:
                gone.update(range(i, i + width))
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((doc_id, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


def check(spark, rows, width=35):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((tuple(r) for r in removed_words(docs, width).collect()), key=str)
    assert got == brute(rows, width)
    return got


def test_cases(spark):
    rng = np.random.default_rng(3)
    word = lambda n, k=4000: " ".join(f"w{x}" for x in rng.integers(0, k, n))
    passage, long_one = word(60), word(36)
    rows = [
        (1, None), (2, ""), (3, " \t\n"), (4, "one"), (5, word(34)), (6, word(35)),
        (7, f"{word(10)} {passage} {word(10)}"), (8, f"{word(3)}\n{passage}"), (9, passage + " é\x85ü"), (9, passage + " é\x85ü"),
        (None, f"{word(5)} {long_one}"), (None, f"{long_one} {word(9)}"), (10, "a " * 200), (11, f"{word(40)} {word(20, 3)}"),
        (12, word(20000)), (13, "b " * 36 + word(5)), (14, f"{passage[:150]} {word(30)}"),
    ] + [(100 + i, f"{word(int(rng.integers(0, 30)))} {passage} {word(int(rng.integers(0, 30)))}") for i in range(12)]
    got = check(spark, rows)
    assert sum(r[2] > 0 for r in got) >= 18
    check(spark, [(i, " ".join(map(str, rng.integers(0, 2, 60)))) for i in range(40)], width=9)
    assert check(spark, []) == []


def test_given_documents(spark, sf_dir):
    rows = [tuple(r) for r in load(spark, sf_dir, "documents").select("doc_id", "text").collect()]
    assert sum(r[2] > 0 for r in check(spark, rows)) > 5


def test_repeated_rows_stay_linear(spark):
    """Equal rows hold each candidate range once."""
    text = " ".join(f"w{i % 90}" for i in range(400))
    docs = spark.createDataFrame([(1, text)] * 300 + [(2, "other words")], "doc_id long, text string")
    rows = removed_words(docs).collect()
    assert len(rows) == 301 and {(r["doc_id"], r["n_removed"]) for r in rows} == {(1, 400), (2, 0)}
