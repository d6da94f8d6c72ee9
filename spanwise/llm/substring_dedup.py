"""Substring deduplication by level-wise doubling.

A window is ``width`` consecutive words of one document. Every word covered by
a window whose word sequence also starts anywhere else is removed.

Levels (for width 35: 9, 18 and 35 words), each over the windows that the level
before left alone as repeated:

1. 9 words. Each 35-word window picks its least 9-word window by hash (the
   leftmost on ties). Equal 35-word windows pick equal 9-word windows at equal
   places, so only picked ones (about one in 14) are compared; where the picked
   one occurs once, no window that picked it repeats.
2. 18 words. A surviving place is extended to both sides; a 35-word window holds
   the 18 words from the place on, or the 18 words around it, or both. It stays
   a candidate only if one that it holds is repeated.
3. 35 words. Only the starts that are left are hashed in full, with 96 bits.

No level can lose a repeated window, and the last one decides on the whole
window. Counting works on packed hashes in buckets. A map task sends a key that
it has seen twice as one witness and settles its own copies itself, so a passage
held by a third of all documents costs a bucket one record a task.

Cases: null and empty texts have no words and nothing is removed; the hash of no
words is that of the empty string. Documents shorter than the window keep all.
Repeated rows count as separate documents, so each removes the other's windows.
Null or repeated doc_ids are fine: rows are told apart by id and text. Extra
columns of docs, whatever their names, are not read and not returned.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanwise.llm import blobs
from spanwise.llm.words import inside, mix64, split_words, window_hash
from spanwise.session import load, materialize

WIDTH = 35
_ANCHOR = {"h": "u8", "f": "u4", "b": "u4", "key": "i8", "lo": "i4", "hi": "i4", "at": "i4", "weight": "u1"}
_WINDOW = {"h": "u8", "tag": "u4", "key": "i8", "at": "i4", "weight": "u1"}


def levels(width: int) -> tuple[int, int]:
    """Widths of the first two levels; the third is the window itself."""
    half = (width + 1) // 2
    return (half + 1) // 2, half


def _least(keys: np.ndarray, span: int) -> np.ndarray:
    """Place of the least key among each ``span`` keys in a row, leftmost on ties."""
    value, place, have = keys, np.arange(len(keys)), 1
    while have < span:
        step = min(have, span - have)
        right = value[step:] < value[: len(value) - step]
        place = np.where(right, place[step:], place[: len(place) - step])
        value = np.where(right, value[step:], value[: len(value) - step])
        have += step
    return place


def anchors(hashes: np.ndarray, first: np.ndarray, width: int) -> dict[str, np.ndarray]:
    """Runs of window starts that pick the same first-level window: its hash h
    and place at, the starts lo to hi, and the second-level hashes f (from the
    place on) and b (around it), 0 where no window of the run holds them."""
    small, half = levels(width)
    starts = inside(first, width, len(hashes))
    if not len(starts):
        return {c: np.zeros(0, _ANCHOR[c]) for c in ("h", "f", "b", "lo", "hi", "at")}
    level1 = window_hash(hashes, small, 1)
    level2 = window_hash(hashes, half, 2)
    picked = _least(level1, width - small + 1)[starts]
    new = np.flatnonzero((np.diff(picked, prepend=-1) != 0) | (np.diff(starts, prepend=-9) != 1))
    at, lo, hi = picked[new], starts[new], starts[np.append(new[1:], len(starts)) - 1]
    forward, back = hi >= at + half - width, lo <= at + small - half
    f = np.where(forward, level2[np.minimum(at, len(level2) - 1)] | np.uint64(1), 0).astype(np.uint32)
    b = np.where(back, level2[np.maximum(at + small - half, 0)] | np.uint64(1), 0).astype(np.uint32)
    return {"h": level1[at], "f": f, "b": b, "lo": lo.astype(np.int32), "hi": hi.astype(np.int32), "at": at.astype(np.int32)}


def _counts(*keys: np.ndarray, weight: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """For each record: the weight of all records with its keys, and whether it
    is the first of them."""
    order = np.lexsort(keys)
    new = np.zeros(len(order), bool)
    new[:1] = True
    for k in keys:
        new[1:] |= k[order][1:] != k[order][:-1]
    group = np.cumsum(new) - 1
    total = np.bincount(group, weights=None if weight is None else weight[order])
    count, lead = np.empty(len(order), np.int64), np.empty(len(order), bool)
    count[order], lead[order] = total[group], new
    return count, lead


def _settle(data: dict[str, np.ndarray], keys: list[str], key_hash: str, buckets: int) -> pd.DataFrame:
    """Map-side combine: of records with equal keys one goes on as a witness of
    weight 2, and each also goes, as settled (weight 3), to its document's bucket."""
    count, lead = _counts(*[data[k] for k in keys])
    again = count > 1
    sent = ~again | lead
    out = {c: np.concatenate([v[sent], v[again]]) for c, v in data.items()}
    out["weight"] = np.concatenate([np.where(again[sent], 2, 1), np.full(again.sum(), 3)]).astype(np.uint8)
    bucket = blobs.bucket_of(out[key_hash], buckets)
    settled = out["weight"] == 3
    bucket[settled] = blobs.bucket_of(mix64(out["key"][settled].view(np.uint64)), buckets)
    return blobs.pack(bucket, out)


def _keyed(docs: DataFrame) -> DataFrame:
    """Key of a row: its id and whole text."""
    return docs.withColumn("__key", F.xxhash64(F.col("doc_id"), F.col("text")))


def candidate_ranges(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """(key, lo, hi): window starts that the first two levels leave."""
    spark = docs.sparkSession
    buckets = blobs.bucket_count(spark)
    names = ["h", "f", "b", "lo", "hi", "at", "key"]

    def emit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = blobs.Buffer(names)
        for whole in batches:
            for batch in blobs.slices(whole, "text"):
                words = split_words(batch["text"])
                found = anchors(words.hash, words.first, width)
                text = np.searchsorted(words.first, found["lo"], side="right") - 1
                base = words.first[text].astype(np.int32)
                key = batch["__key"].to_numpy(np.int64)[text]
                if held.add(found["h"], found["f"], found["b"], found["lo"] - base, found["hi"] - base, found["at"] - base, key):
                    yield _settle(held.take(), ["h", "f", "b"], "h", buckets)
        if (rest := held.take()) is not None:
            yield _settle(rest, ["h", "f", "b"], "h", buckets)

    def reduce(frame: pd.DataFrame) -> pd.DataFrame:
        return _ranges_of(frame, width)

    rows = _keyed(docs).select("__key", "text").mapInPandas(emit, blobs.schema(_ANCHOR))
    return rows.groupBy("bucket").applyInPandas(reduce, "key long, lo int, hi int")


def _ranges_of(frame: pd.DataFrame, width: int) -> pd.DataFrame:
    small, half = levels(width)
    d = blobs.unpack(frame, _ANCHOR)
    settled = d["weight"] == 3
    rows = [(d["key"][settled], d["lo"][settled], d["hi"][settled])]
    d = {c: v[~settled] for c, v in d.items()}
    count, _ = _counts(d["h"], weight=d["weight"])
    d = {c: v[count > 1] for c, v in d.items()}  # repeated at the first length
    if len(d["h"]):
        single = d["weight"] == 1
        f = single & (d["f"] > 0) & (_counts(d["h"], d["f"], weight=d["weight"])[0] > 1)
        b = single & (d["b"] > 0) & (_counts(d["h"], d["b"], weight=d["weight"])[0] > 1)
        rows.append((d["key"][f], np.maximum(d["lo"], d["at"] + half - width)[f], d["hi"][f]))
        rows.append((d["key"][b], d["lo"][b], np.minimum(d["hi"], d["at"] + small - half)[b]))
    key, lo, hi = (np.concatenate(x) for x in zip(*rows))
    return pd.DataFrame({"key": key, "lo": lo, "hi": hi})


def _spread(lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """The sorted distinct numbers in the closed ranges."""
    if not len(lo):
        return np.zeros(0, np.int64)
    edge = np.zeros(int(hi.max()) + 2, np.int64)
    np.add.at(edge, lo, 1)
    np.add.at(edge, hi + 1, -1)
    return np.flatnonzero(np.cumsum(edge) > 0)


def repeated_ranges(candidates: DataFrame, width: int = WIDTH) -> DataFrame:
    """(key, starts binary): int32 starts of the repeated windows of each document.
    candidates: key, text and the ranges left (array of lo and hi)."""
    buckets = blobs.bucket_count(candidates.sparkSession)

    def emit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = blobs.Buffer(["h", "tag", "key", "at"])
        for whole in batches:
            for batch in blobs.slices(whole, "text"):
                words = split_words(batch["text"])
                h, tag = window_hash(words.hash, width, 3), window_hash(words.hash, width, 4)
                starts, text = [], []
                for i, (lo, hi) in enumerate(zip(batch["los"], batch["his"])):
                    found = _spread(np.asarray(lo), np.asarray(hi))
                    starts.append(found)
                    text.append(np.full(len(found), i))
                at, text = np.concatenate(starts), np.concatenate(text)
                where = at + words.first[text]
                key = batch["__key"].to_numpy(np.int64)[text]
                if held.add(h[where], tag[where].astype(np.uint32), key, at.astype(np.int32)):
                    yield _settle(held.take(), ["h", "tag"], "h", buckets)
        if (rest := held.take()) is not None:
            yield _settle(rest, ["h", "tag"], "h", buckets)

    def decide(frame: pd.DataFrame) -> pd.DataFrame:
        d = blobs.unpack(frame, _WINDOW)
        settled = d["weight"] == 3
        count, _ = _counts(d["h"], d["tag"], weight=np.where(settled, 0, d["weight"]))
        hit = settled | ((count > 1) & (d["weight"] == 1))
        key, at = d["key"][hit], d["at"][hit]
        return blobs.pack(blobs.bucket_of(mix64(key.view(np.uint64)), buckets // 3), {"key": key, "at": at})

    def collect(frame: pd.DataFrame) -> pd.DataFrame:
        d = blobs.unpack(frame, {"key": "i8", "at": "i4"})
        order = np.lexsort((d["at"], d["key"]))
        key, at = d["key"][order], d["at"][order]
        cut = np.flatnonzero(np.diff(key, prepend=key[:1] - 1)) if len(key) else np.zeros(0, int)
        ends = np.append(cut[1:], len(key))
        return pd.DataFrame({"__key": key[cut], "starts": [at[a:b].tobytes() for a, b in zip(cut, ends)]})

    rows = candidates.mapInPandas(emit, blobs.schema(_WINDOW))
    hits = rows.groupBy("bucket").applyInPandas(decide, "bucket int, key binary, at binary")
    return hits.groupBy("bucket").applyInPandas(collect, "__key long, starts binary")


def dedup_documents(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """(key, n_words, n_removed, kept_text) of the documents that lose words.
    The key is xxhash64(doc_id, text)."""
    # repeated rows find the same ranges: each is held once a key
    ranges = candidate_ranges(docs, width).groupBy("key").agg(F.sort_array(F.collect_set(F.struct("lo", "hi"))).alias("found"))
    ranges = ranges.select("key", F.col("found.lo").alias("los"), F.col("found.hi").alias("his"))
    left = _keyed(docs).select("__key", "text").join(ranges.withColumnRenamed("key", "__key"), "__key")
    candidates = materialize(left, "substring-candidates")
    starts = repeated_ranges(candidates, width)

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for whole in batches:
            for batch in blobs.slices(whole, "text"):
                words = split_words(batch["text"], hashes=False)
                rows = []
                for i, (key, blob) in enumerate(zip(batch["__key"], batch["starts"])):
                    n = int(words.first[i + 1] - words.first[i])
                    at = np.frombuffer(blob, dtype=np.int32)
                    edge = np.zeros(n + 1, np.int64)
                    np.add.at(edge, at, 1)
                    np.add.at(edge, at + width, -1)
                    keep = np.cumsum(edge[:-1]) == 0
                    rows.append((key, n, int(n - keep.sum()), words.kept(i, keep).decode("utf-8", "surrogatepass")))
                yield pd.DataFrame(rows, columns=["__key", "n_words", "n_removed", "kept_text"])

    return (
        candidates.select("__key", "text")
        .join(starts, "__key")
        .mapInPandas(cut, "__key long, n_words long, n_removed long, kept_text string")
    )


def removed_words(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """doc_id, n_words, n_removed and kept_sha256 of every document."""
    cut = dedup_documents(docs, width).select("__key", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("sha")).dropDuplicates(["__key"])

    @F.pandas_udf("n_words long, sha string")
    def whole(text: pd.Series) -> pd.DataFrame:
        found = [(t or "").encode("utf-8", "surrogatepass").split() for t in text]
        return pd.DataFrame({"n_words": [len(w) for w in found], "sha": [hashlib.sha256(b" ".join(w)).hexdigest() for w in found]})

    every = _keyed(docs).select("doc_id", "__key", whole("text").alias("all")).select("doc_id", "__key", "all.n_words", F.col("all.sha").alias("whole_sha"))
    return every.join(cut, "__key", "left").select(
        "doc_id", "n_words", F.coalesce("n_removed", F.lit(0)).cast("long").alias("n_removed"), F.coalesce("sha", "whole_sha").alias("kept_sha256")
    )


def query(spark, sf_dir: str) -> DataFrame:
    return removed_words(load(spark, sf_dir, "documents"))
