"""Phrases of two to five words by the strength of their weakest cut.

Texts are lower-cased (A-Z), cut into pieces at marks and line breaks and those
into words; everything is counted by language. A phrase that occurs ``least``
times or more is a candidate; its score is the lowest, over its cuts, of
floor(1000 * a * n / (l * r)).

Counting goes length by length. A word's id is a 64-bit hash of language and word;
the first pass carries a second hash and finds any two words that share an id, in
which case all is done again with another seed, so phrases are counted exactly, as
rows of ids. A phrase of n words can only be frequent if both its parts of n - 1
words are: they are looked up in a table of 2**``BITS`` bits (a fixed size; what it
lets through by chance is merely counted). Tasks add up equal phrases before the
shuffle, so a frequent one costs a record a task.

The counts above the bound are then held as two streams: one ordered by words from
the front, one from the back. Sort-merge joins of a stream with itself give, in
lockstep, the count of each front part (prefix order) and back part (suffix order),
and mark parts whose extension by one word is as frequent; longer extensions
need no look, as any phrase between is then as frequent as well.

Cases: null texts are empty; a null lang is ``und`` (and joins a lang of that name).
Repeated rows count each. Extra columns are not read. An empty table gives no rows.
"""

from __future__ import annotations

import json
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from spanwise.llm import blobs
from spanwise.llm.words import _BASE, _LOWER, _TABLE, mix64, powers
from spanwise.session import load, materialize

LEAST, LONGEST, TOP = 100, 5, 2_000
#: The table that prunes the next length has 2**BITS bits, whatever the corpus.
BITS = 26
#: Records that a task gathers before it adds them up; as many sums go out.
HELD = 1_200_000
_BREAK = np.zeros(256, bool)
_BREAK[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
_APART = _BREAK.copy()
_APART[[0x20, 0x09]] = True
_STEP = np.uint64(0xA24BAED4963EE407)


def _seeded(lang: str, seed: int) -> np.uint64:
    value = 0
    for b in f"{seed}:{lang}".encode("utf-8", "surrogatepass"):
        value = (value * 0x100000001B3 + b + 1) % 2**64
    return mix64(np.array([value], np.uint64))[0]


class Pieces:
    """Words of a batch: start and end in data, piece (a number that differs
    between pieces), id and tag (two hashes of language and word), doc."""

    def __init__(self, texts: list[str | None], langs: list[str | None], seed: int) -> None:
        raw = [t.encode("utf-8", "surrogatepass") if isinstance(t, str) else b"" for t in texts]
        data = self.data = _LOWER[np.frombuffer(b"\n".join(raw) + b"\n", np.uint8)]
        apart = _APART[data]
        edge = np.diff(apart.view(np.int8), prepend=np.int8(1))
        self.start, self.end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
        self.piece = np.cumsum(_BREAK[data])[self.start]  # the line break between texts ends a piece too
        self.langs = [x if isinstance(x, str) else "und" for x in langs]
        limits = np.cumsum([len(r) + 1 for r in raw], dtype=np.int64)
        self.doc = np.searchsorted(limits, self.start, side="right")
        self.id = self.tag = np.zeros(0, np.uint64)
        if len(self.start):
            length = self.end - self.start
            body = data[~apart]
            offset = np.concatenate([[0], np.cumsum(length)[:-1]])
            place = np.arange(len(body)) - np.repeat(offset, length)
            bytes_, power = _TABLE[body], powers(_BASE, int(length.max()))
            found = np.add.reduceat(bytes_ * power[place], offset) + length.astype(np.uint64)
            other = np.add.reduceat(mix64(bytes_ + np.uint64(seed)) * power[place], offset)
            known = {x: _seeded(x, seed) for x in set(self.langs)}
            of = np.array([known[x] for x in self.langs], np.uint64)[self.doc]
            self.id = mix64(mix64(found ^ mix64(other)) + of)
            self.tag = mix64(mix64(other) + found * _STEP + of)

    def keys(self, n: int) -> np.ndarray:
        """A hash of each run of n words, wherever it may cross pieces."""
        out = self.id
        for j in range(1, n):
            out = mix64(out[: len(self.id) - j] * _STEP + self.id[j:])
        return out


def _key(columns: list[np.ndarray]) -> np.ndarray:
    out = columns[0]
    for c in columns[1:]:
        out = mix64(out * _STEP + c)
    return out


def _added(key: np.ndarray, columns: list[np.ndarray], count: np.ndarray) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
    """Distinct rows and the sums of their counts. key: a hash of the row."""
    order = np.argsort(key, kind="stable")
    k = key[order]
    same = k[1:] == k[:-1]
    differ = np.zeros(len(same), bool)
    for c in columns:
        differ |= c[order][1:] != c[order][:-1]
    if (same & differ).any():  # rows that share a hash: sort by the rows themselves
        order = np.lexsort([*columns, key])
        differ = np.zeros(len(same), bool)
        for c in columns:
            differ |= c[order][1:] != c[order][:-1]
        same = np.zeros(len(same), bool)
    new = np.flatnonzero(np.concatenate([[True], differ | ~(same | ~differ)])) if len(order) else np.zeros(0, np.int64)
    return key[order][new], [c[order][new] for c in columns], np.add.reduceat(count[order], new) if len(new) else count


class _Counts:
    """Rows with counts, added up in the task; what grows too large goes out."""

    def __init__(self, names: list[str], buckets: int, limit: int) -> None:
        self.names, self.buckets, self.limit = names, buckets, limit
        self.parts: list[tuple] = []
        self.raw = 0

    def add(self, key: np.ndarray, columns: list[np.ndarray]) -> pd.DataFrame | None:
        self.parts.append((key, columns, np.ones(len(key), np.int64)))
        self.raw += len(key)
        if self.raw < self.limit:
            return None
        found = self._settle()
        return self._out(*found) if len(found[0]) >= self.limit else None

    def _settle(self) -> tuple:
        keys, columns, counts = zip(*self.parts)
        found = _added(np.concatenate(keys), [np.concatenate(c) for c in zip(*columns)], np.concatenate(counts))
        self.parts, self.raw = [found], 0
        return found

    def _out(self, key, columns, count) -> pd.DataFrame:
        self.parts, self.raw = [], 0
        return blobs.pack(blobs.bucket_of(key, self.buckets), {**dict(zip(self.names, columns)), "count": count})

    def rest(self) -> pd.DataFrame | None:
        return self._out(*self._settle()) if self.parts else None


def _slot(key: np.ndarray, bits: int) -> np.ndarray:
    return (key >> np.uint64(64 - bits)).astype(np.int64)


def _listed(table: np.ndarray, key: np.ndarray) -> np.ndarray:
    """1 where the key's bit is set (the table has a power of two of bits)."""
    slot = _slot(key, int(len(table)).bit_length() + 2)
    return (table[slot >> 3] >> (slot & 7).astype(np.uint8)) & 1


def frequent(docs: DataFrame, n: int, table, least: int, seed: int, bits: int = BITS, limit: int = HELD) -> DataFrame:
    """(w array of ids, f, slot, clash) of the phrases of n words found ``least``
    times. table: broadcast bits of the frequent phrases of n - 1 words. For
    n = 1 also the words that share an id (clash true)."""
    buckets = blobs.bucket_count(docs.sparkSession)
    names = ["w0", "tag"] if n == 1 else [f"w{k}" for k in range(n)]

    def emit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts = _Counts(names, buckets, limit)
        for whole in batches:
            for batch in blobs.slices(whole, "text"):
                words = Pieces(list(batch["text"]), list(batch["lang"]), seed)
                if n == 1:
                    out = counts.add(words.id, [words.id, words.tag])
                elif len(words.id) < n:
                    continue
                else:
                    held = _listed(table.value, words.keys(n - 1))
                    last = len(words.id) - n + 1
                    at = np.flatnonzero((held[:last] & held[1 : last + 1]) * (words.piece[:last] == words.piece[n - 1 :]))
                    columns = [words.id[at + k] for k in range(n)]
                    out = counts.add(_key(columns), columns)
                if out is not None:
                    yield out
        if (out := counts.rest()) is not None:
            yield out

    def add(frame: pd.DataFrame) -> pd.DataFrame:
        d = blobs.unpack(frame, {**{c: "u8" for c in names}, "count": "i8"})
        columns = [d[c] for c in names]
        key = columns[0] if n == 1 else _key(columns)
        key, columns, count = _added(key, columns, d["count"])
        clash = np.zeros(len(key), bool)
        if n == 1 and len(key):
            again = key[1:] == key[:-1]
            clash[1:] |= again
            clash[:-1] |= again
            columns = columns[:1]
        held = (count >= least) | clash
        words = np.stack([c[held].view(np.int64) for c in columns], axis=1) if len(key) else np.zeros((0, n), np.int64)
        listed = np.empty(len(words), object)
        listed[:] = list(words)
        return pd.DataFrame({"w": listed, "f": count[held], "slot": _slot(key[held], bits), "clash": clash[held]})

    schema = blobs.schema({**{c: "u8" for c in names}, "count": "i8"})
    rows = docs.select("text", "lang").mapInPandas(emit, schema)
    return rows.groupBy("bucket").applyInPandas(add, "w array<long>, f long, slot long, clash boolean")


def _bits(counts: DataFrame, bits: int = BITS) -> np.ndarray:
    """The slots of the rows as a table of bits: blocks of 64 KB that are merged
    before the driver gets them, 2**(BITS - 3) bytes at most."""
    block = min(19, bits)

    def set_bits(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            slot = batch["slot"].to_numpy(np.int64)
            for b in np.unique(slot >> block):
                held = np.unique(slot[slot >> block == b] & ((1 << block) - 1)).astype("<u4")
                yield pd.DataFrame({"block": [b], "slots": [held.tobytes()]})

    def merge(frame: pd.DataFrame) -> pd.DataFrame:
        held = np.zeros(1 << block, np.uint8)
        for s in frame["slots"]:
            held[np.frombuffer(s, "<u4")] = 1
        return pd.DataFrame({"block": frame["block"].iloc[:1], "bits": [np.packbits(held, bitorder="little").tobytes()]})

    found = counts.select("slot").mapInPandas(set_bits, "block long, slots binary").groupBy("block").applyInPandas(merge, "block long, bits binary")
    out = np.zeros(1 << (bits - 3), np.uint8)
    for r in found.toLocalIterator():
        at = r["block"] << (block - 3)
        out[at : at + (1 << (block - 3))] = np.frombuffer(r["bits"], np.uint8)
    return out


def vocabulary(docs: DataFrame, table, seed: int, limit: int = HELD) -> tuple[DataFrame, DataFrame]:
    """(id, lang, word) of the frequent words (and of some others that the bits let
    through), and (lang, n) with the number of all word occurrences. A task packs the
    words that it meets, each once, by buckets of ids."""
    buckets = blobs.bucket_count(docs.sparkSession)
    names = ["bucket", "ids", "words", "langs", "lang", "n"]

    def packed(found: dict[int, tuple[bytes, str]]) -> pd.DataFrame:
        ids = np.fromiter(found, np.uint64, len(found))
        bucket = blobs.bucket_of(ids, buckets)
        order = np.argsort(bucket, kind="stable")
        told = list(found.values())
        rows = []
        for part in np.split(order, np.flatnonzero(np.diff(bucket[order])) + 1):
            # words hold no line break
            rows.append((int(bucket[part[0]]), ids[part].tobytes(), b"\n".join(told[k][0] for k in part), json.dumps([told[k][1] for k in part]).encode(), None, None))
        return pd.DataFrame(rows, columns=names)

    def emit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found: dict[int, tuple[bytes, str]] = {}
        seen, totals = np.zeros(0, np.uint64), Counter()
        for whole in batches:
            for batch in blobs.slices(whole, "text"):
                words = Pieces(list(batch["text"]), list(batch["lang"]), seed)
                for lang, n in zip(words.langs, np.bincount(words.doc, minlength=len(batch)).tolist()):
                    totals[lang] += n
                at = np.flatnonzero(_listed(table.value, words.id))
                ids, index = np.unique(words.id[at], return_index=True)
                new = ~np.isin(ids, seen, assume_unique=True)
                at, raw = at[index[new]], words.data
                for key, i in zip(words.id[at].tolist(), at.tolist()):
                    found[key] = (raw[words.start[i] : words.end[i]].tobytes(), words.langs[words.doc[i]])
                seen = np.concatenate([seen, ids[new]])
                if len(found) >= limit:  # words met later than that are told again, which changes nothing
                    yield packed(found)
                    found, seen = {}, seen[:0]
        if found:
            yield packed(found)
        if totals:
            yield pd.DataFrame([(None, None, None, None, lang, n) for lang, n in totals.items()], columns=names)

    def distinct(frame: pd.DataFrame) -> pd.DataFrame:
        ids = np.concatenate([np.frombuffer(x, "u8") for x in frame["ids"]])
        words, langs = [w for x in frame["words"] for w in x.split(b"\n")], [v for x in frame["langs"] for v in json.loads(x)]
        _, index = np.unique(ids, return_index=True)
        return pd.DataFrame({"id": ids[index].view(np.int64), "lang": np.array([langs[k] for k in index] + [None], object)[:-1], "word": np.array([words[k].decode("utf-8", "surrogatepass") for k in index] + [None], object)[:-1]})

    rows = docs.select("text", "lang").mapInPandas(emit, "bucket int, ids binary, words binary, langs binary, lang string, n long")
    rows = materialize(rows, "phrase-words")
    words = rows.where("bucket is not null").select("bucket", "ids", "words", "langs").groupBy("bucket").applyInPandas(distinct, "id long, lang string, word string")
    return materialize(words, "phrase-vocabulary"), rows.where("bucket is null").groupBy("lang").agg(F.sum("n").alias("n"))


def counted(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, bits: int = BITS, limit: int = HELD) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(counts, words, totals): w and f of all frequent phrases of one word to
    ``longest``; id, lang and word; lang and n."""
    context, seed = docs.sparkSession.sparkContext, 0
    while True:
        levels = [materialize(frequent(docs, 1, None, least, seed, bits, limit), "phrases-1")]
        if not levels[0].where("clash").limit(1).count():
            break
        seed += 1
    table = context.broadcast(_bits(levels[0], bits))
    words, totals = vocabulary(docs, table, seed, limit)
    for n in range(2, longest + 1):
        levels.append(materialize(frequent(docs, n, table, least, seed, bits, limit), f"phrases-{n}"))
        table.unpersist()
        if n < longest:
            table = context.broadcast(_bits(levels[-1], bits))
    every = levels[0].select("w", "f")
    for level in levels[1:]:
        every = every.unionByName(level.select("w", "f"))
    return every, words, totals


def _parts(counts: DataFrame, front: bool) -> DataFrame:
    """(w, f, k, part): count of the first k words of each phrase, or of those
    after them. Both sides of the merge run in the order of the part's words, from
    the front or from the back."""
    whole = F.col("w") if front else F.reverse("w")
    cut = counts.where("size(w) > 1").select("w", "f", F.explode(F.sequence(F.lit(1), F.size("w") - 1)).alias("k"))
    size = F.col("k") if front else F.size("w") - F.col("k")
    stream = cut.select("w", "f", "k", F.slice(whole, F.lit(1), size).alias("order"))
    return stream.join(counts.select(whole.alias("order"), F.col("f").alias("part")).hint("merge"), "order")


def collocations(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, top: int = TOP, bits: int = BITS, limit: int = HELD) -> DataFrame:
    """lang, rank, phrase, a, l, r, n and score of each language's first phrases."""
    counts, words, totals = counted(docs, least, longest, bits, limit)
    counts = materialize(counts, "phrase-counts")
    parts = [materialize(_parts(counts, front), "phrase-parts") for front in (True, False)]
    covered = [p.where((F.col("part") == F.col("f")) & (F.col("k") == (F.size("w") - 1 if front else 1))) for p, front in zip(parts, (True, False))]
    inside = covered[0].select(F.expr("slice(w, 1, size(w) - 1)").alias("w")).union(covered[1].select(F.expr("slice(w, 2, size(w) - 1)").alias("w")))
    left, right = parts[0].withColumnRenamed("part", "l"), parts[1].select("w", "k", F.col("part").alias("r"))
    cuts = left.join(right.hint("merge"), ["w", "k"]).join(inside.distinct().hint("merge"), "w", "left_anti")
    owned = cuts.withColumn("id", F.element_at("w", 1)).join(words.select("id", "lang"), "id").join(totals, "lang")
    wide = lambda c: F.col(c).cast("decimal(18,0)")
    owned = owned.withColumn("up", (wide("f") * wide("n")).cast("decimal(35,0)") * F.lit(1000).cast("decimal(4,0)")).withColumn("down", wide("l") * wide("r"))
    scored = owned.withColumn("score", F.expr("up div down").cast("long"))
    lowest = scored.groupBy("lang", "w", F.col("f").alias("a"), "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut")).select("lang", "w", "a", "n", "cut.score", "cut.l", "cut.r")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"))
    first = lowest.withColumn("place", F.rank().over(order)).where(F.col("place") <= top).drop("place")  # ties at the end stay
    spelled = first.select("*", F.posexplode("w").alias("at", "id")).join(words.select("id", "word"), "id")
    spelled = spelled.groupBy("lang", "w", "a", "l", "r", "n", "score").agg(F.sort_array(F.collect_list(F.struct("at", "word"))).alias("told"))
    spelled = spelled.withColumn("phrase", F.concat_ws(" ", F.col("told.word")))
    ranked = spelled.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")).cast("long"))
    return ranked.where(F.col("rank") <= top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def query(spark, sf_dir: str) -> DataFrame:
    return collocations(load(spark, sf_dir, "documents"))


ORACLE_SQL = r"""
with pieces as (
  select coalesce(lang, 'und') as lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) as piece
  from documents
), listed as (
  select lang, regexp_extract_all(piece, '[^\x20\x09]+') as ws from pieces
), grams as (
  select lang, k, list_slice(ws, i, i + k - 1) as w
  from (select lang, ws, k, unnest(range(1, len(ws) - k + 2)) as i from listed, range(1, 6) t(k) where len(ws) >= k)
), counts as (
  select lang, k, w, count(*) as f from grams group by all
), totals as (
  select lang, sum(f)::hugeint as n from counts where k = 1 group by lang
), candidates as (
  select * from counts where k >= 2 and f >= 100
), covered as (
  select lang, list_slice(w, 1, k - 1) as w, f from candidates union select lang, list_slice(w, 2, k) as w, f from candidates
), free as (
  select * from candidates c where not exists (select 1 from covered x where x.lang = c.lang and x.w = c.w and x.f = c.f)
), cuts as (
  select c.lang, c.w, c.f as a, t.n, j, l.f as l, r.f as r, (1000::hugeint * c.f * t.n) // (l.f::hugeint * r.f) as score
  from free c join range(1, 5) g(j) on g.j < c.k join totals t on t.lang = c.lang
  join counts l on l.lang = c.lang and l.w = list_slice(c.w, 1, j) join counts r on r.lang = c.lang and r.w = list_slice(c.w, j + 1, c.k)
), lowest as (
  select *, row_number() over (partition by lang, w order by score, j) as first_cut from cuts
), ranked as (
  select *, row_number() over (partition by lang order by score desc, a desc, array_to_string(w, ' ')) as rank from lowest where first_cut = 1
)
select lang, rank, array_to_string(w, ' ') as phrase, a, l, r, n::bigint as n, score::bigint as score from ranked where rank <= 2000
"""
