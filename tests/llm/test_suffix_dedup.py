import hashlib
from collections import Counter

import numpy as np
import pytest
from spanwise.llm import suffix_dedup
from spanwise.session import load


def brute(rows, width=400):
    raw = [(t or "").encode() for _, t in rows]
    count = Counter(r[i : i + width] for r in raw for i in range(len(r) - width + 1))
    out = []
    for (doc_id, _), r in zip(rows, raw):
        gone, spans = bytearray(len(r)), 0
        for i in range(len(r) - width + 1):
            if count[r[i : i + width]] > 1:
                gone[i : i + width] = b"\1" * width
        for i in range(len(r)):
            spans += gone[i] and not (i and gone[i - 1])
        kept = bytes(b for b, g in zip(r, gone) if not g)
        out.append((doc_id, len(r), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def check(spark, rows, width=400):
    docs = spark.createDataFrame([(*r, 1, "x", 2) for r in rows], "doc_id long, text string, j int, past string, key long")
    got = sorted((tuple(r) for r in suffix_dedup.removed_bytes(docs, width).collect()), key=str)
    assert got == brute(rows, width)
    return got


def prose(rng, n, k=3000):
    return " ".join(f"w{x}" for x in rng.integers(0, k, n))


def test_cases(spark):
    rng = np.random.default_rng(5)
    passage, brief = prose(rng, 140), prose(rng, 200)[:405]
    tail = prose(rng, 90)
    rows = [
        (1, None), (2, ""), (3, "x"), (4, passage[:399]), (5, passage[:400]), (6, f"{prose(rng, 60)} {passage} {prose(rng, 60)}"),
        (7, f"{prose(rng, 3)}\n{passage}"), (8, passage + " é\x85ü"), (8, passage + " é\x85ü"), (None, f"ab{brief}cd"), (None, f"xy{brief}zz {prose(rng, 50)}"),
        (9, "a" * 3000), (10, "ab" * 900 + prose(rng, 100)), (11, "héß" * 300), (12, prose(rng, 20000)), (13, prose(rng, 100) + tail), (14, prose(rng, 70) + tail), (15, tail),
    ] + [(100 + i, f"{prose(rng, int(rng.integers(0, 40)))}{passage[int(rng.integers(0, 300)):]}{prose(rng, int(rng.integers(0, 40)))}") for i in range(12)]
    got = check(spark, rows)
    assert sum(r[2] > 0 for r in got) >= 18
    assert check(spark, []) == [] and check(spark, [(1, None), (2, "")])


@pytest.mark.parametrize(("seed", "width"), [(0, 16), (1, 24), (2, 40), (3, 64), (4, 100)])
def test_edited_copies(spark, seed, width):
    """Copies with edits at random places, few letters and runs: windows that begin
    or end inside phrases, with different partners on each side."""
    rng = np.random.default_rng(seed)
    base = ["".join(rng.choice(list("abcd"), int(rng.integers(1, 600)))) for _ in range(12)] + ["ab" * 150, "a" * 300]
    rows = []
    for i in range(120):
        text = list(base[int(rng.integers(0, len(base)))])
        for _ in range(int(rng.integers(0, 6))):
            text[int(rng.integers(0, len(text)))] = rng.choice(list("abcdé"))
        lo = int(rng.integers(0, len(text)))
        rows.append((i, "".join(text[lo:] if i % 3 else text) + base[int(rng.integers(0, len(base)))][: int(rng.integers(0, 200))]))
    check(spark, rows, width)


def test_classes_over_ranges(spark):
    """A class that fills several ranges keeps one rank and one leader."""
    rows = [(0, 1, 7, 7, k, 0, 3) for k in range(500)] + [(0, 1, 8, k, k, 1, 3) for k in range(50)] + [(1, 1, 7, 7, 9, 9, 3), (0, 1, 9, 9, 1, 4, 3), (0, 1, 9, 9, 2, 4, 3)]
    df = spark.createDataFrame(rows, "past int, apart int, x long, y long, key long, j int, c int").selectExpr("past", "apart", "x", "y", "key", "j", "j as at", "c")
    found = suffix_dedup.rerank(df).collect()
    big, small = [r for r in found if r["j"] == 0], [r for r in found if r["j"] == 4]
    assert len(found) == 502 and len(big) == 500 and len(small) == 2
    assert len({r["rank"] for r in big}) == 1 and sum(r["lead"] for r in big) == 1 and sum(r["lead"] for r in small) == 1


def test_windows_of_documents_together():
    """Windows of documents in one batch are those of each alone, none crosses a seam."""
    rng = np.random.default_rng(8)
    raw = [bytes(rng.choice(list(b"abcd"), int(n)).tolist()) for n in rng.integers(40, 900, 30)]
    marks = []
    for r in raw:
        n = len(suffix_dedup.Samples([r], 40).at)
        marks.append(([k for k in range(n) if k % 25 != 3], None if n % 3 == 0 else [2 * k + k % 4 // 2 for k in range(0, n, 6)]))
    *masks, found = suffix_dedup._states(raw, [m[0] for m in marks], [m[1] for m in marks], 40)
    whole = [suffix_dedup._split(suffix_dedup._ranges(m), found.limits) for m in masks]
    assert all(m.any() for m in masks)
    for k, r in enumerate(raw):
        *one, alone = suffix_dedup._states([r], [marks[k][0]], [marks[k][1]], 40)
        assert [w[k] for w in whole] == [suffix_dedup._ranges(m).astype("<i4").tobytes() for m in one]
        assert (found.h[found.first[k] : found.first[k + 1]] == alone.h).all() and not one[1][len(r) - 39 :].any()


def test_given_documents(spark, sf_dir):
    rows = [tuple(r) for r in load(spark, sf_dir, "documents").select("doc_id", "text").collect()]
    assert sum(r[2] > 0 for r in check(spark, rows)) > 5


def test_ranks_move_as_blobs(spark):
    """A round's ranks are a row a pair of buckets, and a class that all documents share is
    sent once by each bucket of documents."""
    rng = np.random.default_rng(9)
    passage = prose(rng, 400)
    docs = spark.createDataFrame([(k, f"{prose(rng, 9)} {passage}") for k in range(60)], "doc_id long, text string")
    ranks = suffix_dedup.contexts(docs, 40).cache()
    samples = sum(len(r["data"]) for r in ranks.collect()) // suffix_dedup._RANK.itemsize
    assert samples > 60 * 60 and ranks.count() <= 12 * 4
    met = suffix_dedup.pairs(ranks, 1).collect()
    sent = np.concatenate([np.frombuffer(r["data"], suffix_dedup._PAIR) for r in met])
    _, times = np.unique(sent["rank"][sent["weight"] != suffix_dedup._DONE], return_counts=True)
    assert len(met) <= 4 * 4 and len(sent) > 60 * 30 and times.max() <= 4


def test_samples_of_short_documents():
    """Documents with no window, or one, between others have the samples that they have alone."""
    rng = np.random.default_rng(10)
    raw = [bytes(rng.choice(list(b"ab"), n).tolist()) for n in (3, 40, 0, 300, 41, 12)]
    found = suffix_dedup.Samples(raw, 40)
    for k, r in enumerate(raw):
        own = slice(*found.first[k : k + 2])
        assert (found.at[own] - found.limits[k]).tolist() == suffix_dedup.Samples([r], 40).at.tolist() if len(r) >= 40 else not len(found.at[own])
