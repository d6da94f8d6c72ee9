import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from spanwise.llm import collocations
from spanwise.session import load

_AZ = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def brute(rows, least, top, longest=5):
    count = defaultdict(Counter)
    for lang, text in rows:
        for piece in re.split("[.,;:!?\n-\r]", (text or "").translate(_AZ)):
            words = re.findall("[^ \t]+", piece)
            for n in range(1, longest + 1):
                for i in range(len(words) - n + 1):
                    count[lang or "und"][tuple(words[i : i + n])] += 1
    out = []
    for lang, f in count.items():
        n, found = sum(v for w, v in f.items() if len(w) == 1), []
        held = {w: v for w, v in f.items() if len(w) > 1 and v >= least}
        gone = set()
        for w, v in held.items():
            for size in range(2, len(w)):
                for i in range(len(w) - size + 1):
                    if 100 * v >= 100 * f[w[i : i + size]]:
                        gone.add(w[i : i + size])
        for w, a in held.items():
            if w not in gone:
                score, k = min((1000 * a * n // (f[w[:k]] * f[w[k:]]), k) for k in range(1, len(w)))
                found.append((-score, -a, " ".join(w).encode(), f[w[:k]], f[w[k:]]))
        out += [(lang, i + 1, p.decode(), -a, x, y, n, -s) for i, (s, a, p, x, y) in enumerate(sorted(found)[:top])]
    return sorted(out)


def run(spark, rows, least, top, **more):
    docs = spark.createDataFrame([(*r, 7, "x") for r in rows], "lang string, text string, f long, w string")
    return sorted(tuple(r) for r in collocations.collocations(docs, least, top=top, **more).collect())


def corpus(seed, n=150):
    rng = np.random.default_rng(seed)
    words = ["The", "the", "cat", "of", "é", "new", "York", "city", "a-b", "\x85", "don't", "x"]
    marks = [" "] * 12 + ["\t", ". ", ", ", "\n", "! ", "  ", "\r\n"]
    rows = []
    for _ in range(n):
        size = int(rng.integers(0, 60))
        parts = [words[min(int(rng.geometric(0.2)) - 1, 11)] + marks[int(rng.integers(0, len(marks)))] for _ in range(size)]
        rows.append((["en", "de", None, "und"][int(rng.integers(0, 4))], "".join(parts) + "new york city new york city hall " * int(rng.integers(0, 3))))
    return rows + [("en", None), (None, ""), ("fr", " .\n"), ("en", "long words " * 3000), ("en", "long words " * 3000)]


@pytest.mark.parametrize(("least", "top"), [(2, 2000), (5, 7), (100, 2000)])
def test_against_counters(spark, least, top):
    rows = corpus(least)
    assert run(spark, rows, least, top) == brute(rows, least, top)


def test_empty(spark):
    assert run(spark, [], 2, 10) == [] and run(spark, [("en", None)], 2, 10) == []


def test_small_tables_change_nothing(spark):
    """Bits that let much through, and tasks that flush early."""
    rows = corpus(4, 60)
    assert run(spark, rows, 3, 50, bits=4, limit=50) == brute(rows, 3, 50)


def test_equal_hashes_are_told_apart():
    a, b = np.array([1, 1, 2, 1], np.uint64), np.array([5, 6, 7, 5], np.uint64)
    key, columns, count = collocations._added(np.zeros(4, np.uint64), [a, b], np.ones(4, np.int64))
    assert sorted(zip(columns[0].tolist(), columns[1].tolist(), count.tolist())) == [(1, 5, 2), (1, 6, 1), (2, 7, 1)]


def test_given_documents_and_sql(spark, sf_dir):
    docs = load(spark, sf_dir, "documents")
    got = sorted(tuple(r) for r in collocations.collocations(docs).collect())
    duckdb.sql(f"create or replace view documents as select * from '{sf_dir}/documents.parquet'")
    assert got == sorted(duckdb.sql(collocations.ORACLE_SQL).fetchall()) and got
    assert got == brute([(r["lang"], r["text"]) for r in docs.collect()], 100, 2000)
