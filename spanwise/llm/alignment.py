"""Alignment of two tokenizers' tokens of the same texts.

A text is encoded by a byte-level BPE (A, of a space and the text) and by a
sentencepiece BPE with byte fallback (B, of the text; it puts the space itself).
Both give the same bytes, so tokens are byte ranges over one line of offsets.

1. A task takes its texts in slices. Two ``merge_asof`` calls a slice, keyed by
   document, give each A start its covering B token and each B start its covering
   A token. Their union is the overlap links; the second leaves out the starts
   that the first has. Ends of both sides that are equal cut the tokens into
   groups. The links are kept as the ids and two bits a link (which side moves
   on), and the slices' id pairs are counted in the task.
2. Pair counts are added up in buckets of pairs; of each B id's pairs the highest
   count is kept, one row a vocabulary entry.
3. The stored links get their counts: the most frequent pairs, at most
   ``KNOWN``, are sent to all tasks; a document's other pairs go to the bucket of
   the pair and come back as sums, so no table of pairs has to fit anywhere.

Cases: null and empty texts, and texts whose joined tokens differ from a space
and the text (say, U+2581 in it), have no tokens: zeros and ''. Literals of special
tokens are plain text. Repeated rows count each; doc_id may be null or repeat. Extra
columns of docs are not read. An empty table gives no rows. A text is one task's at a time.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanwise.llm import blobs
from spanwise.llm.tokens import PATTERN, _byte_letters, encoder
from spanwise.llm.words import mix64
from spanwise.session import load, materialize

#: Pairs whose counts every task gets; all others are resolved by a shuffle.
KNOWN = 2_000_000
#: Words that the library's own encoder of A keeps, where it is used.
ENTRIES = 200_000
#: Pairs that a task counts at a time.
PAIRS = 1_000_000
#: Row groups of 16 MB, as two writers share an executor with the tokenizers.
_SMALL = {"compression": "zstd", "parquet.block.size": str(16 << 20)}
_COLUMNS = ["n_a", "n_b", "n_groups", "n_links"]
_SPACE = "▁"


def piece_bytes(model) -> list[bytes]:
    """Bytes of each entry of a sentencepiece vocabulary."""
    pieces = [model.id_to_piece(i) for i in range(model.get_piece_size())]
    return [bytes([int(p[3:5], 16)]) if model.is_byte(i) else p.replace(_SPACE, " ").encode() for i, p in enumerate(pieces)]


def byte_encoder(path: str):
    """encode(text) -> ids of a byte-level BPE as little-endian u32 bytes.

    If ids ascend in the order of the merges and each entry encodes to itself, then
    merging the pair whose joined entry has the least id is the same as merging by the
    list: what lies within an entry's bytes is merged as it is alone, so a pair of
    another split of it never stands side by side. Such a file goes through ranks, which
    is twice as fast; any other through the library's own encoder."""
    import tiktoken

    made = encoder(path, ENTRIES)
    with open(path, encoding="utf-8") as f:
        told = json.load(f)
    entries, vocabulary = _letters_bytes(path), told["model"].get("vocab", {})
    merged = [vocabulary["".join(m if isinstance(m, list) else m.split(" "))] for m in told["model"].get("merges", [])] if made.cut else []
    if not merged or sorted(merged) != merged or any(len(made.model.tokenize(token)) != 1 for token in vocabulary if token not in _added_tokens(told)):
        return made.encode
    ranks = {entries[i]: i for token, i in vocabulary.items() if token not in _added_tokens(told)}
    encode = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
    return lambda text: np.array(encode(text), "<u4").tobytes()


def _added_tokens(told: dict) -> set[str]:
    return {t["content"] for t in told.get("added_tokens") or []}


def _letters_bytes(path: str) -> list[bytes]:
    """Bytes of each entry of a byte-level vocabulary."""
    from tokenizers import Tokenizer

    known = Tokenizer.from_file(path)
    back = {c: b for b, c in _byte_letters().items()}
    out = []
    for i in range(known.get_vocab_size()):
        token = known.id_to_token(i) or ""
        out.append(bytes(back[c] for c in token) if all(c in back for c in token) else token.encode())
    return out


class _Side:
    """Byte strings and decimal names of a vocabulary, as flat tables."""

    def __init__(self, entries: list[bytes]) -> None:
        self.size = len(entries)
        self.length = np.array([len(e) for e in entries], np.int64)
        self.offset = np.cumsum(self.length) - self.length
        self.flat = np.frombuffer(b"".join(entries) or b"\0", np.uint8)
        self.digits = len(str(max(self.size - 1, 0))) + 1
        rows = [str(i).encode() + mark for mark in (b",", b"|", b";", b"") for i in range(self.size)]
        self.names = np.frombuffer(b"".join(r.ljust(self.digits, b"\0") for r in rows), np.uint8).reshape(-1, self.digits)
        self.name_length = np.array([len(r) for r in rows], np.int64)

    def decoded(self, ids: np.ndarray, end: np.ndarray) -> np.ndarray:
        """All bytes of the tokens; end: their ends in it."""
        if not len(ids):
            return np.zeros(0, np.uint8)
        length = self.length[ids]
        return self.flat[np.repeat(self.offset[ids] - (end - length), length) + np.arange(int(end[-1]))]


class _Pair:
    def __init__(self, path_a: str, path_b: str) -> None:
        from sentencepiece import SentencePieceProcessor

        self.encode_a = byte_encoder(path_a)
        self.model = SentencePieceProcessor(model_file=path_b)
        self.a, self.b = _Side(_letters_bytes(path_a)), _Side(piece_bytes(self.model))


@lru_cache(maxsize=1)
def _pair(path_a: str, path_b: str) -> _Pair:
    return _Pair(path_a, path_b)


def default_paths() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def _whole(parts: list[bytes], counts: np.ndarray, side: _Side, data: np.ndarray, limits: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ids, ends, good): good marks the texts whose tokens give their bytes."""
    ids = np.frombuffer(b"".join(parts), "<u4").astype(np.int64)
    end = np.cumsum(side.length[ids])
    first = np.concatenate([[0], np.cumsum(counts)])
    edge = np.concatenate([[0], end])[first]
    good = np.diff(edge) == np.diff(limits)
    if good.all():
        wrong = np.flatnonzero(side.decoded(ids, end) != data)
        good[np.searchsorted(limits, wrong, side="right") - 1] = False
    else:  # lengths differ: text by text
        for k in np.flatnonzero(good):
            some = ids[first[k] : first[k + 1]]
            good[k] = np.array_equal(side.decoded(some, np.cumsum(side.length[some])), data[limits[k] : limits[k + 1]])
    return ids, end, good


def _tokens(pair: _Pair, texts: list[str]) -> tuple[np.ndarray, ...]:
    """doc, id and end of the tokens of both sides, for the texts that align."""
    raw = [b" " + t.encode("utf-8", "surrogatepass") if t else b"" for t in texts]
    a, b = [pair.encode_a(" " + t) if t else b"" for t in texts], [np.array(pair.model.encode(t), "<u4").tobytes() if t else b"" for t in texts]
    while True:
        limits = np.concatenate([[0], np.cumsum([len(r) for r in raw])]).astype(np.int64)
        data = np.frombuffer(b"".join(raw), np.uint8)
        n_a, n_b = np.array([len(x) // 4 for x in a], np.int64), np.array([len(x) // 4 for x in b], np.int64)
        ids_a, end_a, good_a = _whole(a, n_a, pair.a, data, limits)
        ids_b, end_b, good_b = _whole(b, n_b, pair.b, data, limits)
        if (good := good_a & good_b).all():
            where = np.arange(len(texts))
            return np.repeat(where, n_a), ids_a, end_a, np.repeat(where, n_b), ids_b, end_b
        for k in np.flatnonzero(~good):
            raw[k] = a[k] = b[k] = b""


def overlaps(doc_a: np.ndarray, start_a: np.ndarray, doc_b: np.ndarray, start_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indices (i, j) of all overlapping A and B tokens, in order of the bytes."""
    left = pd.DataFrame({"doc": doc_a, "at": start_a, "i": np.arange(len(start_a))})
    right = pd.DataFrame({"doc": doc_b, "at": start_b, "j": np.arange(len(start_b))})
    covered_a = pd.merge_asof(left, right, on="at", by="doc")
    covered_b = pd.merge_asof(right, left, on="at", by="doc")
    own = start_a[covered_b["i"].to_numpy(np.int64)] != start_b  # starts of both sides are in the first already
    at = np.concatenate([start_a, start_b[own]])
    i = np.concatenate([covered_a["i"].to_numpy(np.int64), covered_b["i"].to_numpy(np.int64)[own]])
    j = np.concatenate([covered_a["j"].to_numpy(np.int64), covered_b["j"].to_numpy(np.int64)[own]])
    order = np.argsort(at, kind="stable")
    return i[order], j[order]


def _group_text(pair: _Pair, doc_a, ids_a, end_a, doc_b, ids_b, end_b, many: int) -> tuple[np.ndarray, list[str]]:
    """Number of groups and digest of each document's groups."""
    common = np.intersect1d(end_a, end_b, assume_unique=True)
    group_a, group_b = np.searchsorted(common, end_a), np.searchsorted(common, end_b)
    size_a, size_b = np.bincount(group_a, minlength=len(common)), np.bincount(group_b, minlength=len(common))
    before_a, before_b = np.cumsum(size_a), np.cumsum(size_b) - size_b
    out_doc = doc_a[np.cumsum(size_a) - 1] if len(common) else np.zeros(0, np.int64)
    groups = np.bincount(out_doc, minlength=many)
    final = np.zeros(len(common), bool)  # the last group of a document has no mark behind it
    final[np.cumsum(groups)[groups > 0] - 1] = True
    mark_a = np.where(end_a == common[group_a], 1, 0) if len(common) else np.zeros(0, int)
    mark_b = np.where(end_b == common[group_b], np.where(final[group_b], 3, 2), 0) if len(common) else np.zeros(0, int)
    place_a = np.arange(len(ids_a)) + before_b[group_a]
    place_b = np.arange(len(ids_b)) + before_a[group_b]
    width = max(pair.a.digits, pair.b.digits)
    text, length = np.zeros((len(ids_a) + len(ids_b), width), np.uint8), np.zeros(len(ids_a) + len(ids_b), np.int64)
    for side, ids, mark, place in ((pair.a, ids_a, mark_a, place_a), (pair.b, ids_b, mark_b, place_b)):
        row = mark * side.size + ids
        text[place, : side.digits] = side.names[row]
        length[place] = side.name_length[row]
    flat = text.ravel()
    flat = memoryview(flat[flat != 0].tobytes())
    tokens = np.concatenate([[0], np.cumsum(np.bincount(doc_a, minlength=many) + np.bincount(doc_b, minlength=many))])
    edge = np.concatenate([[0], np.cumsum(length)])[tokens].tolist()
    return groups, [hashlib.sha256(flat[x:y]).hexdigest() if y > x else "" for x, y in zip(edge[:-1], edge[1:])]


def _store(ids_a: np.ndarray, ids_b: np.ndarray, steps: np.ndarray) -> bytes:
    """A document's links: numbers of tokens, ids and two bits a link."""
    return np.array([len(ids_a), len(ids_b), len(steps)], "<u4").tobytes() + ids_a.tobytes() + ids_b.tobytes() + np.packbits(steps).tobytes()


def _fetch(blob: bytes, kind_a: str, kind_b: str) -> tuple[np.ndarray, np.ndarray]:
    """A and B id of each link of a stored document."""
    n_a, n_b, n = np.frombuffer(blob, "<u4", 3).tolist()
    at = 12 + n_a * np.dtype(kind_a).itemsize
    a, b = np.frombuffer(blob, kind_a, n_a, 12), np.frombuffer(blob, kind_b, n_b, at)
    steps = np.unpackbits(np.frombuffer(blob, np.uint8, offset=at + n_b * np.dtype(kind_b).itemsize), count=2 * n).reshape(n, 2)
    i, j = np.cumsum(steps, axis=0).T.astype(np.int64) - 1
    return a[i].astype(np.int64), b[j].astype(np.int64)


def _kind(size: int) -> str:
    return "<u2" if size <= 1 << 16 else "<u4"


def _summed(key: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, ascending, and the sums of their counts."""
    order = np.argsort(key, kind="stable")
    key, count = key[order], count[order]
    new = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, int)
    return key[new], np.add.reduceat(count, new) if len(new) else count


def _bucket(key: np.ndarray, buckets: int) -> np.ndarray:
    return blobs.bucket_of(mix64(key.astype(np.uint64)), buckets)


class _Counter:
    """Counts pair keys slice by slice; flushes distinct ones into buckets."""

    def __init__(self, buckets: int) -> None:
        self.buckets, self.keys, self.counts, self.size = buckets, [], [], 0

    def add(self, keys: np.ndarray) -> pd.DataFrame | None:
        small = keys.astype(np.uint32) if not len(keys) or keys.max() < 1 << 32 else keys
        found, count = np.unique(small, return_counts=True)
        self.keys.append(found.astype(np.uint64))
        self.counts.append(count.astype(np.int64))
        self.size += len(found)
        return self.flush() if self.size >= PAIRS else None

    def flush(self) -> pd.DataFrame | None:
        if not self.size:
            return None
        key, count = _summed(np.concatenate(self.keys), np.concatenate(self.counts))
        self.keys, self.counts, self.size = [], [], 0
        return blobs.pack(_bucket(key, self.buckets), {"pairs": key, "counts": count})


_ROW = "row string, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, links binary, bucket int, pairs binary, counts binary"


def aligned(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """The rows of documents (bucket null), with their links, and of pair counts
    (row null), in one table that is written once."""
    buckets = blobs.bucket_count(docs.sparkSession)
    names = [c.split()[0] for c in _ROW.split(", ")]

    def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pair, counter = _pair(path_a, path_b), _Counter(buckets)
        kind_a, kind_b = _kind(pair.a.size), _kind(pair.b.size)
        for whole in batches:
            for batch in blobs.slices(whole, "text", 400_000):
                texts = [t if isinstance(t, str) else "" for t in batch["text"]]
                doc_a, ids_a, end_a, doc_b, ids_b, end_b = _tokens(pair, texts)
                i, j = overlaps(doc_a, end_a - pair.a.length[ids_a], doc_b, end_b - pair.b.length[ids_b])
                groups, digest = _group_text(pair, doc_a, ids_a, end_a, doc_b, ids_b, end_b, len(texts))
                steps = np.stack([np.diff(i, prepend=-1) > 0, np.diff(j, prepend=-1) > 0], axis=1)
                n_a, n_b, n = (np.bincount(x, minlength=len(texts)) for x in (doc_a, doc_b, doc_a[i]))
                at_a, at_b, at = (np.concatenate([[0], np.cumsum(x)]) for x in (n_a, n_b, n))
                short_a, short_b = ids_a.astype(kind_a), ids_b.astype(kind_b)
                stored = [_store(short_a[at_a[k] : at_a[k + 1]], short_b[at_b[k] : at_b[k + 1]], steps[at[k] : at[k + 1]]) for k in range(len(texts))]
                base = uuid.uuid4().hex
                yield _filled({
                    "row": [f"{base}-{k}" for k in range(len(texts))], "doc_id": batch["doc_id"].array, "n_a": n_a, "n_b": n_b, "n_groups": groups,
                    "n_links": n, "groups_sha256": digest, "links": stored,
                }, names)
                if (full := counter.add(ids_a[i] * pair.b.size + ids_b[j])) is not None:
                    yield _filled(full, names)
        if (rest := counter.flush()) is not None:
            yield _filled(rest, names)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInPandas(_typed(task), _ROW)


def _filled(columns, names: list[str]) -> pd.DataFrame:
    """A frame with all columns of a schema; those not given are null."""
    n = len(next(iter(columns.values()))) if isinstance(columns, dict) else len(columns)
    return pd.DataFrame({c: columns[c] if c in columns else np.full(n, None, object) for c in names})


def _typed(task):
    """Batches with nullable integers, so that nulls keep their columns' types."""

    def typed(batches):
        for batch in batches:
            batch["doc_id"] = batch["doc_id"].astype("Int64")
            yield batch

    return lambda batches: task(typed(batches))


def pair_counts(rows: DataFrame) -> DataFrame:
    """(bucket, pairs, counts): each bucket's distinct pairs, ascending, with
    their counts over all documents."""

    def add(frame: pd.DataFrame) -> pd.DataFrame:
        d = blobs.unpack(frame, {"pairs": "u8", "counts": "i8"})
        key, count = _summed(d["pairs"], d["counts"])
        return pd.DataFrame({"bucket": [frame["bucket"].iloc[0]], "pairs": [key.tobytes()], "counts": [count.tobytes()]})

    return rows.where("bucket is not null").select("bucket", "pairs", "counts").groupBy("bucket").applyInPandas(add, "bucket int, pairs binary, counts binary")


def _best(counts: DataFrame, size_b: int) -> np.ndarray:
    """Highest pair count of each B id; the table has one entry a vocabulary entry."""

    def most(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for keys, values in zip(batch["pairs"], batch["counts"]):
                b, value = np.frombuffer(keys, "u8") % size_b, np.frombuffer(values, "i8")
                top = np.zeros(size_b, np.int64)
                np.maximum.at(top, b.astype(np.int64), value)
                held = np.flatnonzero(top)
                yield pd.DataFrame({"b": held, "top": top[held]})

    out = np.zeros(size_b, np.int64)
    for r in counts.mapInPandas(most, "b long, top long").groupBy("b").agg(F.max("top").alias("top")).collect():
        out[r["b"]] = r["top"]
    return out


def _known(counts: DataFrame, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The pairs above a count that at most ``most`` pairs reach."""

    def levels(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for values in batch["counts"]:
                level, n = np.unique(_level(np.frombuffer(values, "i8")), return_counts=True)
                yield pd.DataFrame({"level": level, "n": n})

    seen, least = 0, None
    for r in sorted(counts.mapInPandas(levels, "level long, n long").groupBy("level").agg(F.sum("n").alias("n")).collect(), key=lambda r: -r["level"]):
        if seen + r["n"] > most:
            break
        seen, least = seen + r["n"], r["level"]
    if least is None:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)

    def above(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for keys, values in zip(batch["pairs"], batch["counts"]):
                value = np.frombuffer(values, "i8")
                held = _level(value) >= least
                yield pd.DataFrame({"pairs": [np.frombuffer(keys, "u8")[held].tobytes()], "counts": [value[held].tobytes()]})

    found = counts.mapInPandas(above, "pairs binary, counts binary").collect()  # at most 16 bytes times ``most``
    key, value = np.frombuffer(b"".join(r["pairs"] for r in found), "u8"), np.frombuffer(b"".join(r["counts"] for r in found), "i8")
    order = np.argsort(key)
    return key[order], value[order]


def _level(count: np.ndarray) -> np.ndarray:
    """Counts on a scale of eighths of a power of two (whole numbers below 16)."""
    return np.where(count < 16, count, np.floor(8 * np.log2(np.maximum(count, 1))).astype(np.int64) - 16)


def scored(rows: DataFrame, counts: DataFrame, size_a: int, size_b: int, known: int = KNOWN) -> DataFrame:
    """Documents with n_best and count_sum of their links."""
    spark = rows.sparkSession
    keys, values = _known(counts, known)
    best = _best(counts, size_b)
    table = spark.sparkContext.broadcast((keys, values, best))
    kind_a, kind_b, buckets = _kind(size_a), _kind(size_b), blobs.bucket_count(spark)
    kept = ["row", "doc_id", *_COLUMNS, "groups_sha256"]
    schema = "row string, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, n_best long, count_sum long, bucket int, pairs binary, counts binary"
    names = [c.split()[0] for c in schema.split(", ")]

    def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key_of, value_of, top = table.value
        for batch in batches:
            found = [_fetch(x, kind_a, kind_b) for x in batch["links"]]
            n = np.array([len(a) for a, _ in found], np.int64)
            pair = np.concatenate([a * size_b + b for a, b in found]).astype(np.uint64) if len(found) else np.zeros(0, np.uint64)
            doc = np.repeat(np.arange(len(found)), n)
            distinct, back = np.unique(pair, return_inverse=True)
            at = np.minimum(np.searchsorted(key_of, distinct), max(len(key_of) - 1, 0))
            hit = key_of[at] == distinct if len(key_of) else np.zeros(len(distinct), bool)
            value = np.where(hit, value_of[at], 0) if len(key_of) else np.zeros(len(distinct), np.int64)
            is_best = hit & (value == top[(distinct % np.uint64(size_b)).astype(np.int64)])
            sums = np.concatenate([[0], np.cumsum(value[back])])
            bests = np.concatenate([[0], np.cumsum(is_best[back])])
            edge = np.concatenate([[0], np.cumsum(n)])
            yield _filled({**{c: batch[c].array if c == "doc_id" else batch[c].to_numpy(object) for c in kept}, "n_best": np.diff(bests[edge]), "count_sum": np.diff(sums[edge])}, names)
            if not hit.all():  # rare pairs go to their buckets, with the row that asks
                rest = np.flatnonzero(~hit[back])
                asked, many = np.unique(np.stack([doc[rest], back[rest]]), axis=1, return_counts=True)
                yield _filled({"row": batch["row"].to_numpy()[asked[0]], "bucket": _bucket(distinct[asked[1]], buckets), "pairs": [x.tobytes() for x in distinct[asked[1]]],
                               "counts": [x.tobytes() for x in many.astype(np.int64)]}, names)

    def rare(ask: pd.DataFrame, have: pd.DataFrame) -> pd.DataFrame:
        if not len(ask) or not len(have):
            return pd.DataFrame({"row": np.zeros(0, object), "more_best": np.zeros(0, np.int64), "more_sum": np.zeros(0, np.int64)})
        d, h = blobs.unpack(ask, {"pairs": "u8", "counts": "i8"}), blobs.unpack(have, {"pairs": "u8", "counts": "i8"})
        value = h["counts"][np.searchsorted(h["pairs"], d["pairs"])]
        is_best = value == table.value[2][(d["pairs"] % np.uint64(size_b)).astype(np.int64)]
        return pd.DataFrame({"row": ask["row"].to_numpy(object), "more_best": is_best * d["counts"], "more_sum": value * d["counts"]})

    every = materialize(rows.where("bucket is null").select(*kept, "links").mapInPandas(_typed(task), schema), "alignment-scored")
    asked = every.where("bucket is not null").select("row", "bucket", "pairs", "counts")
    more = asked.groupBy("bucket").cogroup(counts.groupBy("bucket")).applyInPandas(rare, "row string, more_best long, more_sum long")
    more = more.groupBy("row").agg(F.sum("more_best").alias("more_best"), F.sum("more_sum").alias("more_sum"))
    plus = lambda a, b: (F.col(a) + F.coalesce(F.col(b), F.lit(0))).alias(a)
    done = every.where("bucket is null").join(more, "row", "left")
    return done.select("doc_id", *_COLUMNS, plus("n_best", "more_best"), plus("count_sum", "more_sum"), "groups_sha256")


def align(docs: DataFrame, path_a: str | None = None, path_b: str | None = None, known: int = KNOWN) -> DataFrame:
    """One row a document: doc_id, n_a, n_b, n_groups, n_links, n_best,
    count_sum and groups_sha256."""
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    default = default_paths()
    path_a, path_b = path_a or default[0], path_b or default[1]
    size_a, size_b = Tokenizer.from_file(path_a).get_vocab_size(), SentencePieceProcessor(model_file=path_b).get_piece_size()
    rows = materialize(aligned(docs, path_a, path_b), "alignment", **_SMALL)
    counts = materialize(pair_counts(rows), "alignment-counts", **_SMALL)
    return scored(rows, counts, size_a, size_b, known)


def links(docs: DataFrame, path_a: str | None = None, path_b: str | None = None) -> DataFrame:
    """The links themselves: doc_id, links array of (a, b) ids in byte order."""
    default = default_paths()
    path_a, path_b = path_a or default[0], path_b or default[1]

    def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pair = _pair(path_a, path_b)
        for batch in batches:
            found = [_fetch(x, _kind(pair.a.size), _kind(pair.b.size)) for x in batch["links"]]
            yield pd.DataFrame({"doc_id": batch["doc_id"], "links": [[{"a": x, "b": y} for x, y in zip(a.tolist(), b.tolist())] for a, b in found]})

    kept = aligned(docs, path_a, path_b).where("bucket is null").select("doc_id", "links")
    return kept.mapInPandas(_typed(task), "doc_id long, links array<struct<a: long, b: long>>")


def query(spark, sf_dir: str) -> DataFrame:
    return align(load(spark, sf_dir, "documents"))
