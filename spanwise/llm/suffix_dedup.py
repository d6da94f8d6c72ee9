"""Removal of byte strings that repeat, by distributed prefix doubling.

Each byte covered by a string of ``width`` bytes that also starts anywhere else goes.
A suffix array over all bytes would sort every byte several times. The array is kept
over sampled positions instead (about one in 60), and bytes between them are
looked at only where a repeated stretch begins or ends.

1. Samples: in each run of ``reach`` neighbours the place with the least hash of
   ``seed`` bytes, leftmost on ties. Whether a place is sampled depends on the bytes
   around it alone, its context (270 of a window's 400 bytes), and the middle of each
   window holds a sample whose context lies in the window.
2. Doubling: a sample's rank is the class of its context, then of the contexts of 2, 4,
   8 ... samples: Spark brings equal pairs (rank, rank at the offset, bytes between) together
   by a hash of 96 bits, they get one rank, pairs that are alone are dropped. A sample is past the threshold
   when its contexts hold all windows that start with its own; the last offset is cut
   to just that, and if the class has more members all those windows repeat.
3. Ends: a window not settled so, whose middle samples all repeat, is compared by a
   hash of its ``width`` bytes (96 bits) with others of its kind and with settled windows:
   those of one member of each class, where a window to be compared has the same first
   context (a table of 2**``BITS`` bits; what it lets through by chance is compared in vain).

Contexts, pairs and windows that a task meets twice go on as one witness, so a class that a
third of all rows share sends a record or so a task to its bucket. Ranks move as blobs of
records, a row a bucket of documents.

Cases: null and empty texts have no bytes. Texts shorter than the width keep all.
Repeated rows count as documents of their own. Null or repeated doc_ids are fine: rows
are told apart by id and text. Extra columns are not read. A cut may split a character,
so kept bytes are binary. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanwise.llm import blobs
from spanwise.llm.collocations import _bits, _listed, _slot
from spanwise.llm.substring_dedup import _counts, _keyed
from spanwise.llm.words import _BASE, _TABLE, mix64, powers
from spanwise.session import few_rows, lean_workers, load, materialize, partitions

WIDTH = 400
#: The table of contexts of windows to be compared has 2**BITS bits, whatever the corpus.
BITS = 26
_OTHER = np.random.default_rng(20250611).integers(1, 2**63, size=256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE2 = 0xC2B2AE3D27D4EB4F | 1
_CONTEXT = {"h": "u8", "key": "i8", "j": "u4", "at": "u4", "c": "u2", "weight": "u1"}
_WINDOW = {"h": "u8", "tag": "u4", "key": "i8", "at": "u4", "weight": "u1"}
#: Weights of a record: one, more than one, repeated already, and a settled window that needs no answer.
_ONE, _MORE, _DONE, _TOLD = 1, 2, 3, 4
_SMALL = {"parquet.block.size": str(16 << 20)}
#: A sample with its rank, and one with a pair of ranks: names of 64 and 32 bits.
_RANK = np.dtype([("key", "<i8"), ("j", "<u4"), ("at", "<u4"), ("c", "<u2"), ("lead", "?"), ("rank", "<u8")])
_PAIR = np.dtype([*_RANK.descr, ("tag", "<u4"), ("past", "?"), ("weight", "u1")])
_RANKS = "past boolean, most int, bucket int, data binary"


def sizes(width: int) -> tuple[int, int, int, int]:
    """(seed, reach, before, behind): a context is ``before`` bytes, the place and on to
    ``behind`` bytes from it."""
    if width < 16:
        raise ValueError("windows of 16 bytes at least")
    seed = max(1, min(16, width // 8))
    reach = (width - seed + 3) // 3
    return seed, reach, reach - 1, reach - 1 + seed


_POWERS: dict[int, np.ndarray] = {}
#: Powers that a worker keeps of each base; longer tables are made anew.
_KEPT = 1 << 20


def _powers(base: int, n: int) -> np.ndarray:
    """The first n powers, from a table that doubles as longer ones are asked for."""
    if n > _KEPT:
        return powers(base, n)
    if len(_POWERS.get(base, ())) < n:
        _POWERS[base] = powers(base, max(4_096, 1 << (n - 1).bit_length()))
    return _POWERS[base][:n]


def _sums(data: np.ndarray, table: np.ndarray, base: int) -> tuple[np.ndarray, np.ndarray]:
    """Running sums of a polynomial hash and the powers that take a place out of one."""
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(table[data] * _powers(base, len(data)), out=total[1:])
    return total, _powers(pow(base, -1, 2**64), len(data) + 1)


class Samples:
    """Samples of a batch of documents of ``width`` bytes or more.

    at: places in data; first: index of each document's first sample; h: hash of the
    context; lo and hi: the windows (places of their starts) that belong to a sample;
    c: number of samples from it on whose contexts hold them (0: there are none)."""

    def __init__(self, raw: list[bytes], width: int) -> None:
        seed, reach, before, behind = sizes(width)
        data = np.frombuffer(b"".join(raw), np.uint8)
        limits = self.limits = np.concatenate([[0], np.cumsum([len(r) for r in raw])]).astype(np.int64)
        mers = _TABLE[data]
        have = 1
        while have < seed:  # a hash of ``seed`` bytes from hashes of fewer, mixed once at the end
            step = min(have, seed - have)
            mers = mers[: len(mers) - step] * np.uint64(pow(_BASE, step, 2**64)) + mers[step:]
            have += step
        low = np.uint64(2**32 - 1)
        least, have = mix64(mers) & ~low | np.arange(len(mers), dtype=np.uint64), 1  # leftmost on ties
        while have < reach:
            step = min(have, reach - have)
            least = np.minimum(least[: len(least) - step], least[step:])
            have += step
        ends = np.maximum(limits[1:] - (reach + seed - 2), limits[:-1])
        picked = np.concatenate([least[a:b] for a, b in zip(limits[:-1].tolist(), ends.tolist())])
        new = np.ones(len(picked), bool)
        new[1:] = picked[1:] != picked[:-1]
        at = self.at = (picked[new] & low).astype(np.int64)  # windows go on, so their places never go back
        self.first = np.searchsorted(at, limits)
        doc = self.doc = np.repeat(np.arange(len(raw)), np.diff(self.first))
        start, stop = limits[doc], limits[doc + 1]
        left, right = np.maximum(at - before, start), np.minimum(at + behind, stop)
        total, back = _sums(data, _TABLE, _BASE)
        self.h = mix64(mix64((total[right] - total[left]) * back[left]) + ((at - left) * 65_536 + right - at).astype(np.uint64))
        nxt = np.append(at[1:], len(data))
        last = np.zeros(len(at), bool)
        last[self.first[1:] - 1] = True
        self.lo = left
        self.hi = np.minimum(np.where(last, stop, nxt - before), stop - width + 1)
        enough = np.minimum(np.where(last, stop, nxt - before - 1 + width), stop)
        self.c = np.where(self.lo < self.hi, np.searchsorted(right, enough) - np.arange(len(at)) + 1, 0)


def _raw(texts) -> list[bytes]:
    return [t.encode("utf-8", "surrogatepass") if isinstance(t, str) else b"" for t in texts]


def _combine(data: dict[str, np.ndarray], keys: list[str], buckets: int) -> pd.DataFrame:
    """Map-side combine: of equal records one goes on as more than one, and each
    that needs an answer goes, as done, to its document's bucket."""
    told = data["weight"] == _TOLD
    count, lead = _counts(*[data[k] for k in keys])
    again = count > 1
    sent, done = ~again | lead, again & ~told
    out = {c: np.concatenate([v[sent], v[done]]) for c, v in data.items()}
    out["weight"] = np.concatenate([np.where(again[sent], _MORE, data["weight"][sent]), np.full(done.sum(), _DONE)]).astype(np.uint8)
    bucket = blobs.bucket_of(out["h"], buckets)
    at = out["weight"] == _DONE
    bucket[at] = blobs.bucket_of(mix64(out["key"][at].view(np.uint64)), buckets)
    return blobs.pack(bucket, out)


def _answers(d: dict[str, np.ndarray], keys: list[str]) -> np.ndarray:
    """Records of a bucket that are repeated and need an answer."""
    done = d["weight"] == _DONE
    worth = np.array([0, 1, 2, 0, 1])[d["weight"]]
    count, _ = _counts(*[d[k] for k in keys], weight=worth)
    return done | ((count > 1) & (d["weight"] == _ONE))


def _ranked(d: np.ndarray | dict[str, np.ndarray], past: np.ndarray, buckets: int) -> pd.DataFrame:
    """Ranks as blobs, a row a bucket of documents, those past the threshold apart; most: of c."""
    found = np.zeros(len(past), _RANK)
    for name in _RANK.names:
        found[name] = d[name]
    bucket = blobs.bucket_of(mix64(found["key"].astype(np.uint64)), buckets)
    out = blobs.pack(2 * bucket + past, {"data": found})
    most = [int(np.frombuffer(b, _RANK)["c"].max()) for b in out["data"]]
    return pd.DataFrame({"past": out["bucket"] % 2 == 1, "most": np.array(most, np.int32), "bucket": out["bucket"] // 2, "data": out["data"]})


def contexts(docs: DataFrame, width: int) -> DataFrame:
    """Ranks of the samples whose context repeats."""
    buckets, documents = blobs.bucket_count(docs.sparkSession), partitions(docs.sparkSession)
    names = list(_CONTEXT)

    def emit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = blobs.Buffer(names)
        for whole in batches:
            for batch in blobs.slices(whole, "text", 400_000):
                raw = _raw(batch["text"])
                long = [k for k, r in enumerate(raw) if len(r) >= width]
                if not long:
                    continue
                found = Samples([raw[k] for k in long], width)
                key = batch["__key"].to_numpy(np.int64)[long][found.doc]
                j = np.arange(len(found.at)) - found.first[found.doc]
                at = (found.at - found.limits[found.doc]).astype(np.uint32)
                if held.add(found.h, key, j.astype(np.uint32), at, found.c.astype(np.uint16), np.full(len(j), _ONE, np.uint8)):
                    yield _combine(held.take(), ["h"], buckets)
        if (rest := held.take()) is not None:
            yield _combine(rest, ["h"], buckets)

    def decide(frame: pd.DataFrame) -> pd.DataFrame:
        d = blobs.unpack(frame, _CONTEXT)
        hit = _answers(d, ["h"])
        found = {x: d[x][hit] for x in ("key", "j", "at", "c")} | {"rank": d["h"][hit], "lead": False}
        return _ranked(found, np.zeros(hit.sum(), bool), documents)

    rows = _keyed(docs).select("__key", "text").mapInPandas(emit, blobs.schema(_CONTEXT))
    return rows.groupBy("bucket").applyInPandas(decide, _RANKS)


def _paired(past: np.ndarray | bool, apart: np.ndarray, x: np.ndarray, y: np.ndarray, d: np.ndarray | dict) -> np.ndarray:
    """Records of pairs of ranks; d: the samples that they begin with."""
    out, between = np.zeros(len(x), _PAIR), apart.astype(np.uint64)
    for name in ("key", "j", "at", "c"):
        out[name] = d[name]
    out["past"] = past
    out["rank"] = mix64(mix64(x + np.uint64(_BASE)) + y * np.uint64(_BASE2) + between)
    out["tag"] = mix64(mix64(y + np.uint64(_BASE2)) + x * np.uint64(_BASE) + between) >> np.uint64(32)
    return out


def _pairs(d: np.ndarray, h: int) -> np.ndarray:
    """Pairs of ranks of h samples: offset h for the next rank, where a sample with more
    than 2 h to go needs it, and offset c - h for those past the threshold. apart: bytes
    between the two samples. d: all ranks of some documents."""
    d = d[np.lexsort((d["j"], d["key"]))]
    key, rank = np.ascontiguousarray(d["key"]), np.ascontiguousarray(d["rank"])
    j, at, c = (d[x].astype(np.int64) for x in ("j", "at", "c"))
    new = np.concatenate([[0], np.flatnonzero(key[1:] != key[:-1]) + 1]) if len(key) else np.zeros(0, int)
    place = np.repeat(np.arange(len(new)), np.diff(np.append(new, len(key)))).astype(np.int64) << 32 | j
    wanted = np.maximum.accumulate(np.where(c > 2 * h, place + c, -1)) > place
    found = []
    for past, mine in ((True, (c > h) & (c <= 2 * h)), (False, wanted)):  # repeated rows share a key; each of their samples pairs up
        i = np.flatnonzero(mine)
        goal = place[i] + (c[i] - h if past else h)
        to = np.minimum(np.searchsorted(place, goal), max(len(place) - 1, 0))
        i, to = i[place[to] == goal], to[place[to] == goal]
        found.append(_paired(past, at[to] - at[i], rank[i], rank[to], d[i]))
    return np.concatenate(found)


def _met(d: np.ndarray, buckets: int) -> pd.DataFrame:
    """Map-side combine: of equal pairs one goes on as their witness, the others, as
    done, to their documents' buckets."""
    count, first = _counts(d["rank"], d["tag"], d["past"])
    d["weight"] = np.where(first, np.where(count > 1, _MORE, _ONE), _DONE)
    return blobs.pack(blobs.bucket_of(np.where(first, d["rank"], mix64(d["key"].astype(np.uint64))), buckets), {"data": d})


def pairs(ranks: DataFrame, h: int) -> DataFrame:
    """(bucket, data) of the pairs of ranks of h samples."""
    buckets = partitions(ranks.sparkSession)

    def task(frame: pd.DataFrame) -> pd.DataFrame:
        return _met(_pairs(blobs.unpack(frame, {"data": _RANK})["data"], h), buckets)

    return ranks.select("bucket", "data").groupBy("bucket").applyInPandas(task, "bucket int, data binary")


def classes(met: DataFrame) -> DataFrame:
    """Ranks of the pairs that are not alone: equal pairs have one, a 64-bit name of the
    pair, and one of them leads."""
    documents = partitions(met.sparkSession)

    def decide(frame: pd.DataFrame) -> pd.DataFrame:
        d = blobs.unpack(frame, {"data": _PAIR})["data"]
        done = d["weight"] == _DONE
        seen = d[~done]
        seen = seen[np.lexsort((seen["j"], seen["key"]))]  # which one leads does not hang on the order of arrival
        count, seen["lead"] = _counts(seen["rank"], seen["tag"], seen["past"], weight=seen["weight"])
        found = np.concatenate([seen[count > 1], d[done]])
        return _ranked(found, found["past"], documents)

    return met.groupBy("bucket").applyInPandas(decide, _RANKS)


def rerank(found: DataFrame) -> DataFrame:
    """classes() of a table of pairs (past, apart, x, y, key, j, at, c), as a table: (past,
    key, j, at, c, rank, lead)."""
    buckets, names = partitions(found.sparkSession), ["key", "j", "at", "c", "rank", "lead"]

    def emit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            apart, x, y = (rows[c].to_numpy(np.int64).view(np.uint64) for c in ("apart", "x", "y"))
            yield _met(_paired(rows["past"] == 1, apart, x, y, rows), buckets)

    def open_up(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            for past, data in zip(rows["past"], rows["data"]):
                d = np.frombuffer(data, _RANK)
                yield pd.DataFrame({"past": np.int32(past)} | {x: d[x].astype(np.int64) if x == "rank" else d[x] for x in names})

    schema = "past int, key long, j int, at int, c int, rank long, lead boolean"
    return classes(found.mapInPandas(emit, "bucket int, data binary")).select("past", "data").mapInPandas(open_up, schema)


def doubled(ranks: DataFrame) -> DataFrame:
    """Ranks of the samples whose windows are settled."""
    h, found = 1, []
    most = ranks.agg(F.max("most")).first()[0] or 0
    while h < most or not found:
        done = materialize(classes(pairs(ranks, h)), "suffix-ranks", **_SMALL)
        found.append(done.where("past"))
        ranks = done.where("not past")
        h *= 2
    every = found[0]
    for p in found[1:]:
        every = every.unionByName(p)
    return every


def _marks(ranks: DataFrame, past: DataFrame) -> DataFrame:
    """(__key, ones, past) of the documents: j of the samples whose context repeats, and
    2 j + lead of the settled ones, both in order."""

    def collect(frame: pd.DataFrame) -> pd.DataFrame:
        found = []
        for settled, name in ((False, "ones"), (True, "past")):
            d = blobs.unpack(frame[frame["past"] == settled], {"data": _RANK})["data"]
            key, mark = np.ascontiguousarray(d["key"]), d["j"].astype("<i4") * (1 + settled) + (d["lead"] & settled)
            order = np.lexsort((mark, key))
            key, mark = key[order], mark[order].astype("<i4")
            new = np.ones(len(key), bool)  # repeated rows share a key
            new[1:] = (key[1:] != key[:-1]) | (mark[1:] != mark[:-1])
            key, mark = key[new], mark[new]
            cut = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, int)
            ends = np.append(cut[1:], len(key))
            found.append(pd.Series([mark[a:b].tobytes() for a, b in zip(cut, ends)], index=key[cut], name=name, dtype=object))
        out = pd.concat(found, axis=1).rename_axis("__key").reset_index()
        return out.where(out.notna(), None)

    rows = ranks.select("bucket", "past", "data").unionByName(past.select("bucket", "past", "data"))
    return rows.groupBy("bucket").applyInPandas(collect, "__key long, ones binary, past binary")


def _windows(data: np.ndarray, at: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes of the ``width`` bytes from each place on."""
    found = []
    for table, base in ((_TABLE, _BASE), (_OTHER, _BASE2)):
        total, back = _sums(data, table, base)
        found.append(mix64((total[at + width] - total[at]) * back[at]))
    return found[0], found[1].astype(np.uint32)


def _states(raw: list[bytes], ones: list, past: list, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, Samples]:
    """(settled, open, told) windows of documents one after another: repeated for sure,
    to be compared, and settled ones that stand for their class; and the samples. ones:
    samples of each document whose context repeats; past: 2 j + lead of the settled ones."""
    _, _, before, behind = sizes(width)
    found = Samples(raw, width)
    first, stops, many = found.first.tolist(), found.limits[1:] - width + 1, int(found.limits[-1])

    def every(lists: list, times: int) -> np.ndarray:
        return np.concatenate([np.zeros(0, np.int64), *(np.asarray(x, np.int64) + times * k for k, x in zip(first, lists) if x is not None)])

    told = every(past, 2)
    j, lead = told >> 1, (told & 1) == 1

    def over(lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        held = lo < hi
        edge = np.bincount(lo[held], minlength=many + 1) - np.bincount(hi[held], minlength=many + 1)
        return np.cumsum(edge[:-1]) > 0

    settled, leads = over(found.lo[j], found.hi[j]), over(found.lo[j[lead]], found.hi[j[lead]])
    alone = np.ones(len(found.at), bool)
    alone[every(ones, 1)] = False
    at, start, stop = found.at[alone], found.limits[found.doc[alone]], stops[found.doc[alone]]
    never = over(np.maximum(at - width + behind, start), np.minimum(at - before + 1, stop))  # windows with this sample in the middle
    return settled, over(found.limits[:-1], stops) & ~settled & ~never, leads, found


def _split(spans: np.ndarray, limits: np.ndarray) -> list[bytes]:
    """Ranges of documents one after another, as those of each."""
    cut = np.searchsorted(spans[:, 0], limits)
    own = (spans - np.repeat(limits[:-1], np.diff(cut))[:, None]).astype("<i4")
    return [own[a:b].tobytes() for a, b in zip(cut[:-1].tolist(), cut[1:].tolist())]


def candidates(docs: DataFrame, ranks: DataFrame, past: DataFrame, width: int) -> DataFrame:
    """Documents with a repeated context: __key, text, the settled, open and told windows
    (ranges), and the samples (at, h)."""
    def marks(column) -> list:
        return [None if x is None else np.frombuffer(x, "<i4") for x in column]

    def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for part in blobs.slices(batch, "text", 400_000):
                *windows, found = _states(_raw(part["text"]), marks(part["ones"]), marks(part["past"]), width)
                at = (found.at - found.limits[found.doc]).astype("<i4")
                ends = list(zip(found.first[:-1].tolist(), found.first[1:].tolist()))
                told = {name: _split(_ranges(w), found.limits) for name, w in zip(("settled", "open", "told"), windows)}
                yield pd.DataFrame({"__key": part["__key"], "text": part["text"]} | told | {"at": [at[x:y].tobytes() for x, y in ends], "h": [found.h[x:y].tobytes() for x, y in ends]})

    joined = _keyed(docs).select("__key", "text").join(_marks(ranks, past), "__key")
    with few_rows(docs.sparkSession):
        return materialize(joined.mapInPandas(task, "__key long, text string, settled binary, open binary, told binary, at binary, h binary"), "suffix-candidates", **_SMALL)


def _spans(blob: bytes) -> np.ndarray:
    return np.frombuffer(blob, "<i4").reshape(-1, 2).astype(np.int64)


def _each(spans: np.ndarray) -> np.ndarray:
    """All places in the ranges."""
    size = spans[:, 1] - spans[:, 0]
    return np.repeat(spans[:, 0] - (np.cumsum(size) - size), size) + np.arange(size.sum())


def _ranges(mask: np.ndarray) -> np.ndarray:
    edge = np.diff(mask.astype(np.int8), prepend=0, append=0)
    return np.stack([np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)], axis=1)


def _asked(found: DataFrame, width: int, bits: int) -> DataFrame:
    """(slot): of the first contexts of windows to be compared. The first context of a
    window is that of the first sample in its middle."""
    before = sizes(width)[2]

    def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            slots = [np.zeros(0, np.int64)]
            for unclear, at, h in zip(batch["open"], batch["at"], batch["h"]):
                at, spans = np.frombuffer(at, "<i4"), _spans(unclear)
                used = np.stack([np.searchsorted(at, spans[:, 0] + before), np.searchsorted(at, spans[:, 1] - 1 + before) + 1], axis=1)
                slots.append(np.unique(_slot(np.frombuffer(h, "<u8")[_each(used)], bits)))
            yield pd.DataFrame({"slot": np.unique(np.concatenate(slots))})

    return found.select("open", "at", "h").mapInPandas(task, "slot long")


def open_windows(found: DataFrame, width: int, bits: int = BITS) -> DataFrame:
    """(key, starts binary): starts of the repeated windows among those to be compared."""
    buckets, before = blobs.bucket_count(found.sparkSession), sizes(width)[2]
    table = found.sparkSession.sparkContext.broadcast(_bits(_asked(found, width, bits), bits))

    def emit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = blobs.Buffer(list(_WINDOW))
        for batch in batches:
            for key, text, unclear, told, at, h in zip(batch["__key"].tolist(), batch["text"], batch["open"], batch["told"], batch["at"], batch["h"]):
                wanted = _listed(table.value, np.frombuffer(h, "<u8")) == 1
                unclear, told = _each(_spans(unclear)), _each(_spans(told))
                told = told[wanted[np.searchsorted(np.frombuffer(at, "<i4"), told + before)]]
                places = np.concatenate([unclear, told])
                if not len(places):
                    continue
                weight = np.repeat(np.array([_ONE, _TOLD], np.uint8), [len(unclear), len(told)])
                h, tag = _windows(np.frombuffer(_raw([text])[0], np.uint8), places, width)
                if held.add(h, tag, np.full(len(places), key, np.int64), places.astype(np.uint32), weight):
                    yield _combine(held.take(), ["h", "tag"], buckets)
        if (rest := held.take()) is not None:
            yield _combine(rest, ["h", "tag"], buckets)

    def decide(frame: pd.DataFrame) -> pd.DataFrame:
        d = blobs.unpack(frame, _WINDOW)
        hit = _answers(d, ["h", "tag"])
        key, at = d["key"][hit], d["at"][hit]
        return blobs.pack(blobs.bucket_of(mix64(key.view(np.uint64)), max(1, buckets // 3)), {"key": key, "at": at})

    def collect(frame: pd.DataFrame) -> pd.DataFrame:
        d = blobs.unpack(frame, {"key": "i8", "at": "u4"})
        order = np.lexsort((d["at"], d["key"]))
        key, at = d["key"][order], d["at"][order]
        cut = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, int)
        ends = np.append(cut[1:], len(key))
        return pd.DataFrame({"__key": key[cut], "starts": [at[a:b].tobytes() for a, b in zip(cut, ends)]})

    rows = found.select("__key", "text", "open", "told", "at", "h").mapInPandas(emit, blobs.schema(_WINDOW))
    hits = rows.groupBy("bucket").applyInPandas(decide, "bucket int, key binary, at binary")
    return hits.groupBy("bucket").applyInPandas(collect, "__key long, starts binary")


def removed_spans(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """(__key, spans array of (start, stop) bytes, kept binary) of the documents that
    lose bytes. The key is xxhash64(doc_id, text); equal rows give equal rows."""
    lean_workers(docs.sparkSession)
    with few_rows(docs.sparkSession):
        ranks = materialize(contexts(docs, width), "suffix-contexts", **_SMALL)
    found = candidates(docs, ranks, doubled(ranks), width)
    starts = open_windows(found, width)

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in (part for whole in batches for part in blobs.slices(whole, "text")):
            rows = []
            for key, text, settled, blob in zip(batch["__key"].tolist(), batch["text"], batch["settled"], batch["starts"]):
                raw, spans = _raw([text])[0], _spans(settled)
                edge = np.zeros(len(raw) + 1, np.int64)
                if blob is not None:
                    at = np.frombuffer(blob, "<u4").astype(np.int64)
                    spans = np.concatenate([spans, np.stack([at, at + 1], axis=1)])
                if not len(spans):
                    continue
                np.add.at(edge, spans[:, 0], 1)
                np.add.at(edge, spans[:, 1] - 1 + width, -1)
                gone = np.cumsum(edge[:-1]) > 0
                kept = np.frombuffer(raw, np.uint8)[~gone].tobytes()
                rows.append((key, [{"start": int(a), "stop": int(b)} for a, b in _ranges(gone)], kept))
            yield pd.DataFrame(rows, columns=["__key", "spans", "kept"])

    return found.select("__key", "text", "settled").join(starts, "__key", "left").mapInPandas(cut, "__key long, spans array<struct<start: int, stop: int>>, kept binary")


def removed_bytes(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of every document."""
    spark = docs.sparkSession
    lost = F.aggregate("spans", F.lit(0).cast("long"), lambda total, x: total + x["stop"] - x["start"])
    cut = removed_spans(docs, width).select("__key", lost.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("sha"))
    with few_rows(spark):
        cut = materialize(cut, "suffix-removed").dropDuplicates(["__key"])
    whole = F.coalesce("text", F.lit("")).cast("binary")
    every = _keyed(docs).select("doc_id", "__key", F.octet_length(whole).cast("long").alias("n_bytes"), F.sha2(whole, 256).alias("whole"))
    none = F.lit(0).cast("long")
    return every.join(cut, "__key", "left").select(
        "doc_id", "n_bytes", F.coalesce("n_removed", none).alias("n_removed"), F.coalesce("n_spans", none).alias("n_spans"), F.coalesce("sha", "whole").alias("kept_sha256")
    )


def query(spark, sf_dir: str) -> DataFrame:
    return removed_bytes(load(spark, sf_dir, "documents"))
