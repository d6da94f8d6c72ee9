"""Exact Jaccard self-join on word shingles with several global token orders.

Documents are sets of 64-bit shingle hashes; equal sets are one node, so exact
copies never meet as pairs. Two sets with Jaccard similarity t or more share at
least ceil(t * size) tokens of either, so under ANY global order of tokens they
share one among their first ``size - ceil(t * size) + 1``. The join uses three
orders and asks for a shared prefix token under each:

1. Candidates: prefixes under the first order meet in buckets of tokens.
2. Filters: a pair goes on if a parity sketch of its sets (about a bit or two a
   shingle, so it moves first) does not rule the overlap out, and its prefixes
   under the second and third order meet too (compared as 16-bit tokens, which
   can only let more through).
3. Verification: the shingle sets themselves are intersected. Only texts of pairs
   that passed the sketch are fetched: a table of bits tells them where they lie, so
   the others are not shuffled.

The orders put frequent tokens last, so a passage that many documents share does
not bring them together unless they consist of such passages. Frequencies come
from one in 32 occurrences over all documents; they shape the order (and the
speed) alone, as every order gives the same links. The list of frequent tokens
has at most ``FREQUENT`` entries; it and the table of bits (2**``BITS``) are all that is broadcast.

Large groups of near copies: in a group of more than ``PAIRWISE`` nodes each is
compared with 16 leaders (least node hashes). Frequent tokens are salted by their
frequency over all rows, which says nothing of how many nodes post them; leaders
are then those under a hash threshold, each part of the group gets them, and a
part counts as one of a large group however few nodes it has. After the links found so far are joined into components, nodes outside a
group's largest component are compared with all nodes of other components, in
blocks: so no link that would join two components is missed, and pairs within a
component, which change nothing, are made for ``link_counts`` alone.

Cases: words lower-case A-Z only; fewer than five words are one shingle, no words
(or null) an empty set without links. Null doc_ids take part; a component whose
ids are all null has a null id. Repeated rows are copies of each other.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanwise.llm import blobs
from spanwise.llm.collocations import _bits, _listed
from spanwise.llm.components import components
from spanwise.llm.words import Words, mix64, split_words, window_hash
from spanwise.session import load, materialize

SHINGLE = 5
PERCENT = 80
FREQUENT = 262_144
SAMPLE = 32
PAIRWISE = 64
LEADERS = 16
SALT_ABOVE = 2_048
BLOCK = 1_024
SPREAD = 16
#: The table of keys whose texts are fetched has 2**BITS bits, whatever the corpus.
BITS = 26
ORDERS = np.array([0x243F6A8885A308D3, 0x13198A2E03707344, 0xA4093822299F31D0], dtype=np.uint64)


def shingle_sets(words: Words, width: int = SHINGLE) -> list[np.ndarray]:
    """The sorted distinct shingles of each text."""
    hashes, sets = window_hash(words.hash, width), []
    for a, b in zip(words.first[:-1].tolist(), words.first[1:].tolist()):
        if b - a >= width:
            sets.append(np.unique(hashes[a : b - width + 1]))
        else:
            sets.append(window_hash(words.hash[a:b], b - a, 100 + b - a) if b > a else hashes[:0])
    return sets


def signature(tokens: np.ndarray) -> int:
    """A set's 64-bit node, as a signed number."""
    total = mix64(mix64(tokens + np.uint64(0x51ED270B)).sum(dtype=np.uint64, keepdims=True) + np.uint64(len(tokens)))
    return int(total.view(np.int64)[0])


def prefix_length(n: int, percent: int = PERCENT) -> int:
    return n - (percent * n + 99) // 100 + 1 if n else 0


def prefix(tokens: np.ndarray, order: int, frequent: tuple[np.ndarray, np.ndarray], percent: int = PERCENT) -> np.ndarray:
    """The first tokens of a set under a global order: rare ones by hash, then
    frequent ones by count."""
    known, count = frequent
    rank = np.zeros(len(tokens), np.int64)
    if len(known):
        at = np.minimum(np.searchsorted(known, tokens), len(known) - 1)
        rank = np.where(known[at] == tokens, count[at], 0)
    return tokens[np.lexsort((mix64(tokens ^ ORDERS[order]), rank))[: prefix_length(len(tokens), percent)]]


def _nodes(docs: DataFrame) -> DataFrame:
    """docs with node (null for an empty set), n_shingles and sampled tokens."""

    @F.pandas_udf("node long, n long, sample binary, parity binary")
    def describe(text: pd.Series) -> pd.DataFrame:
        rows = []
        for part in blobs.slices(pd.DataFrame({"text": text}), "text"):
            for tokens in shingle_sets(split_words(part["text"], lower=True)):
                node = signature(tokens)
                pick = mix64(tokens ^ np.uint64(node % 2**64)) % np.uint64(SAMPLE) == 0
                rows.append((node if len(tokens) else None, len(tokens), tokens[pick].tobytes(), _parity(tokens)))
        return pd.DataFrame({"node": pd.array([r[0] for r in rows], dtype="Int64")} | {c: [r[k] for r in rows] for k, c in ((1, "n"), (2, "sample"), (3, "parity"))})

    return docs.withColumn("__d", describe("text")).select("doc_id", F.xxhash64("doc_id", "text").alias("key"), "__d.*")


def frequent_tokens(nodes: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The most frequent tokens (sorted) with their estimated document counts."""
    buckets = blobs.bucket_count(nodes.sparkSession)

    def emit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = blobs.Buffer(["token"], 2_000_000)

        def flush() -> pd.DataFrame:
            token, n = np.unique(held.take()["token"], return_counts=True)
            return blobs.pack(blobs.bucket_of(token, buckets), {"token": token, "n": n})

        for batch in batches:
            if held.add(np.frombuffer(b"".join(batch["sample"]), dtype=np.uint64)):
                yield flush()
        if held.size:
            yield flush()

    def count(frame: pd.DataFrame) -> pd.DataFrame:
        d = blobs.unpack(frame, {"token": "u8", "n": "i8"})
        token, inverse = np.unique(d["token"], return_inverse=True)
        n = np.bincount(inverse, weights=d["n"]).astype(np.int64)
        return pd.DataFrame({"token": token[n >= 3].view(np.int64), "n": n[n >= 3] * SAMPLE})

    rows = nodes.select("sample").mapInPandas(emit, "bucket int, token binary, n binary").groupBy("bucket").applyInPandas(count, "token long, n long")
    top = rows.orderBy(F.desc("n"), "token").limit(FREQUENT).toPandas()
    token = top["token"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(token)
    return token[order], top["n"].to_numpy(np.int64)[order]


def _level_bound(percent: int) -> int:
    """The most that the levels of two sets with similarity ``percent`` differ by."""
    return int(np.log(100 / percent) * 16) + 1


def _level(n: np.ndarray) -> np.ndarray:
    """Sizes on a log scale."""
    return np.floor(np.log(np.maximum(n, 1)) * 16).astype(np.uint8)


def _node_hash(node: np.ndarray) -> np.ndarray:
    return mix64(node.view(np.uint64) ^ np.uint64(0xC0AC29B7C97C50DD))


_POSTING = {"group": "u8", "node": "i8", "level": "u1"}


def _postings(docs: DataFrame, frequent, buckets: int, percent: int) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(frequent)

    def emit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known, count = shared.value
        held, seen = blobs.Buffer(list(_POSTING)), set()

        def flush() -> pd.DataFrame:
            d = held.take()
            return blobs.pack(blobs.bucket_of(mix64(d["group"]), buckets), d)

        for whole in batches:
            for batch in blobs.slices(whole, "text"):
                for tokens in shingle_sets(split_words(batch["text"], lower=True)):
                    node = signature(tokens)
                    if not len(tokens) or node in seen:
                        continue
                    seen.add(node)
                    first = prefix(tokens, 0, (known, count), percent)
                    group = mix64(first) & ~np.uint64(0xFFFF)
                    if len(known):
                        at = np.minimum(np.searchsorted(known, first), len(known) - 1)
                        parts = np.where(known[at] == first, np.minimum(count[at] // SALT_ABOVE, 65_534), 0)
                        if parts.any():
                            h = int(_node_hash(np.array([node]))[0])
                            wide = parts > 0
                            salted = []
                            for g, p, c in zip(group[wide].tolist(), parts[wide].tolist(), count[at][wide].tolist()):
                                leads = h < 2**64 * 4 * LEADERS // c
                                salted += [g | (s + 1) for s in (range(p + 1) if leads else (h % (p + 1),))]
                            group = np.concatenate([group[~wide], np.array(salted, dtype=np.uint64)])
                    level = _level(np.array([len(tokens)]))
                    if held.add(group, np.full(len(group), node), np.repeat(level, len(group))):
                        yield flush()
        if held.size:
            yield flush()

    return docs.select("text").mapInPandas(emit, blobs.schema(_POSTING))


def _pairs_of_bucket(buckets: int, percent: int):
    bound = _level_bound(percent)

    def pair(frame: pd.DataFrame) -> pd.DataFrame:
        d = blobs.unpack(frame, _POSTING)
        order = np.lexsort((d["node"], d["group"]))
        group, node, level = (d[c][order] for c in _POSTING)
        new = np.ones(len(group), bool)
        new[1:] = (group[1:] != group[:-1]) | (node[1:] != node[:-1])
        group, node, level = group[new], node[new], level[new].astype(np.int16)
        cut = np.append(np.flatnonzero(np.diff(group, prepend=group[:1] + np.uint64(1))), len(group))
        size = np.diff(cut)
        left, right, large = [], [], []
        for n in np.unique(size[(size > 1) & (size <= PAIRWISE)]):  # groups of one size together
            at = cut[:-1][size == n]
            i, j = np.triu_indices(n, 1)
            left.append((at[:, None] + i).ravel())
            right.append((at[:, None] + j).ravel())
        for k in np.flatnonzero(size > PAIRWISE):
            members = np.arange(cut[k], cut[k + 1])
            leaders = members[np.argsort(_node_hash(node[members]), kind="stable")[:LEADERS]]
            left.append(np.repeat(leaders, len(members)))
            right.append(np.tile(members, len(leaders)))
        salted = (group[cut[:-1]] & np.uint64(0xFFFF)) > 0  # parts meet in _across alone
        for k in np.flatnonzero((size > PAIRWISE) | salted):
            members = np.arange(cut[k], cut[k + 1])
            large += [(int(group[cut[k]] >> np.uint64(16)), node[members[s : s + BLOCK]].tobytes()) for s in range(0, len(members), BLOCK)]
        a, b = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (left, right))
        ok = (np.abs(level[a] - level[b]) <= bound) & (node[a] != node[b])
        a, b = node[a[ok]], node[b[ok]]
        out = _pair_blobs(a, b, buckets // 3)
        return pd.concat([out, pd.DataFrame(large, columns=["class", "nodes"])]).reset_index(drop=True)

    return pair


def _pair_blobs(a: np.ndarray, b: np.ndarray, buckets: int) -> pd.DataFrame:
    pairs = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], axis=1), axis=0) if len(a) else np.zeros((0, 2), np.int64)
    a, b = np.ascontiguousarray(pairs[:, 0]), np.ascontiguousarray(pairs[:, 1])
    return blobs.pack(blobs.bucket_of(mix64(a.view(np.uint64) + mix64(b.view(np.uint64))), buckets), {"a": a, "b": b})


def _distinct_pairs(packed: DataFrame) -> DataFrame:
    def unique(frame: pd.DataFrame) -> pd.DataFrame:
        d = blobs.unpack(frame, {"a": "i8", "b": "i8"})
        pairs = np.unique(np.stack([d["a"], d["b"]], axis=1), axis=0)
        return pd.DataFrame({"a": pairs[:, 0], "b": pairs[:, 1]})

    return packed.groupBy("bucket").applyInPandas(unique, "a long, b long")


def _parity(tokens: np.ndarray) -> bytes:
    """Parity of the number of tokens in each of 2n or more cells."""
    cells = 1 << max(3, int(2 * len(tokens) - 1).bit_length())
    return np.packbits(np.bincount((mix64(tokens) % np.uint64(cells)).astype(np.int64), minlength=cells).astype(np.uint8) & 1, bitorder="little").tobytes()


def _apart(x: bytes, y: bytes) -> int:
    """A lower bound of the number of tokens in one set alone."""
    x, y = (np.frombuffer(v, np.uint8) for v in (x, y))
    n = min(len(x), len(y))
    fold = [np.bitwise_xor.reduce(v.reshape(-1, n), axis=0) for v in (x, y)]
    return int(np.bitwise_count(fold[0] ^ fold[1]).sum())


def _listed_rows(rows: DataFrame, keys: DataFrame, bits: int = BITS) -> DataFrame:
    """The rows with one of the keys, and few others: a table of 2**bits bits is sent to
    the rows, which stay where they are. What it lets through by chance the caller sorts out."""
    table = rows.sparkSession.sparkContext.broadcast(_bits(keys.select(F.shiftrightunsigned("key", 64 - bits).alias("slot")), bits))

    @F.pandas_udf("boolean")
    def listed(key: pd.Series) -> pd.Series:
        return pd.Series(_listed(table.value, key.to_numpy(np.int64).view(np.uint64)) == 1)

    return rows.where(listed("key"))


def _sets(docs: DataFrame, nodes: DataFrame, needed: DataFrame, frequent, percent: int) -> DataFrame:
    """node, its prefixes under the second and third order and the whole set, of
    each needed node. Only texts with a needed key move, to the side of one key a node."""
    shared = docs.sparkSession.sparkContext.broadcast(frequent)
    keys = nodes.where("node is not null").groupBy("node").agg(F.min("key").alias("key")).join(needed, "node").select("key").distinct()
    keys = materialize(keys, "needed-keys")

    def describe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for whole in batches:
            for batch in blobs.slices(whole, "text"):
                rows = []
                for tokens in shingle_sets(split_words(batch["text"], lower=True)):
                    more = [prefix(tokens, o, shared.value, percent).astype(np.uint16).tobytes() for o in (1, 2)]
                    rows.append((signature(tokens), *more, tokens.tobytes()))
                yield pd.DataFrame(rows, columns=["node", "second", "third", "tokens"])

    texts = _listed_rows(docs.select(F.xxhash64("doc_id", "text").alias("key"), "text"), keys).join(keys.hint("shuffle_hash"), "key", "left_semi").dropDuplicates(["key"]).select("text")
    found = texts.mapInPandas(describe, "node long, second binary, third binary, tokens binary")
    return materialize(found, "shingle-sets")


def _sides(pairs: DataFrame, table: DataFrame, columns: list[str]) -> DataFrame:
    """The pairs with columns of both nodes."""
    side = lambda s: table.select(F.col("node").alias(s), *[F.col(c).alias(f"{c}_{s}") for c in columns])
    return pairs.join(side("a"), "a").join(side("b"), "b")


def _sketched(pairs: DataFrame, sketches: DataFrame, percent: int) -> DataFrame:
    """The pairs that their sizes and parity sketches let through."""

    @F.pandas_udf("boolean")
    def may_link(n_a: pd.Series, n_b: pd.Series, p_a: pd.Series, p_b: pd.Series) -> pd.Series:
        # J >= t means that at most (1 - t) / (1 + t) of n + m tokens are in one set alone
        return pd.Series([100 * min(n, m) >= percent * max(n, m) and _apart(p, q) * (100 + percent) <= (100 - percent) * (n + m) for n, m, p, q in zip(n_a, n_b, p_a, p_b)], dtype=bool)

    both = _sides(pairs, sketches, ["n", "parity"])
    return materialize(both.where(may_link("n_a", "n_b", "parity_a", "parity_b")).select("a", "b"), "sketched-pairs")


def _links(sets: DataFrame, pairs: DataFrame, percent: int) -> DataFrame:
    """The pairs that link: those whose prefixes under the other orders meet go on
    to the comparison of whole sets."""

    @F.pandas_udf("boolean")
    def meet(x: pd.Series, y: pd.Series, z: pd.Series, w: pd.Series) -> pd.Series:
        common = lambda a, b: bool(np.isin(np.frombuffer(a, np.uint16), np.frombuffer(b, np.uint16)).any())
        return pd.Series([common(a, b) and common(c, d) for a, b, c, d in zip(x, y, z, w)], dtype=bool)

    @F.pandas_udf("boolean")
    def links(x: pd.Series, y: pd.Series) -> pd.Series:
        out = []
        for a, b in zip(x, y):
            a, b = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
            both = len(np.intersect1d(a, b, assume_unique=True))
            out.append(100 * both >= percent * (len(a) + len(b) - both))
        return pd.Series(out, dtype=bool)

    left = _sides(pairs, sets, ["second", "third"]).where(meet("second_a", "second_b", "third_a", "third_b")).select("a", "b")
    left = materialize(left, "filtered-pairs")  # one Python worker a task, not two
    return materialize(_sides(left, sets, ["tokens"]).where(links("tokens_a", "tokens_b")).select("a", "b"), "similar-pairs")


def _members(large: DataFrame) -> DataFrame:
    """(class, node) of the large groups."""

    def spread(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for c, blob in zip(batch["class"], batch["nodes"]):
                yield pd.DataFrame({"class": c, "node": np.frombuffer(blob, np.int64)})

    return materialize(large.mapInPandas(spread, "class long, node long").distinct(), "large-groups")


def _plausible(rest: list, every: list, percent: int, within: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Places of the pairs of two blocks that lie in different components (or,
    with ``within``, in one) and that sizes and parity sketches let through."""
    n, m = (np.array([x["n"] for x in side]) for side in (rest, every))
    r, s = (np.array([x["root"] for x in side], np.int64) for side in (rest, every))
    ok = ((r[:, None] == s) if within else (r[:, None] != s)) & (100 * np.minimum(n[:, None], m) >= percent * np.maximum(n[:, None], m))
    size = np.array([len(x["parity"]) for x in every])
    for i, x in enumerate(rest):
        for cells in np.unique(size[ok[i]]):
            at = np.flatnonzero(ok[i] & (size == cells))
            least = min(len(x["parity"]), int(cells))
            fold = lambda v: np.bitwise_xor.reduce(v.reshape(len(v), -1, least), axis=1)
            own = fold(np.frombuffer(x["parity"], np.uint8)[None])
            others = fold(np.frombuffer(b"".join([every[j]["parity"] for j in at]), np.uint8).reshape(len(at), -1))
            apart = np.bitwise_count(own ^ others).sum(1, dtype=np.int64)
            ok[i, at] = apart * (100 + percent) <= (100 - percent) * (n[i] + m[at])
    return np.nonzero(ok)


def _within(member: DataFrame, sketches: DataFrame, roots: DataFrame, buckets: int, percent: int) -> DataFrame:
    """Pairs of a large group inside its components, two blocks at a time."""
    member = member.join(roots, "node", "left").select("class", "node", F.coalesce("root", "node").alias("root"))
    member = member.join(sketches, "node")
    many = member.groupBy("class", "root").agg(F.count("*").alias("many")).where("many > 1")
    block = F.pmod(F.xxhash64("node"), F.ceil(F.col("many") / BLOCK)).alias("block")
    packed = member.join(many, ["class", "root"]).groupBy("class", "root", block).agg(F.collect_list(F.struct("node", "root", "n", "parity")).alias("rest"))
    packed = materialize(packed, "large-blocks")
    other = packed.select("class", "root", F.col("block").alias("other"), F.col("rest").alias("every"))

    def pair(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for rest, every in zip(batch["rest"], batch["every"]):
                i, j = _plausible(rest, every, percent, within=True)
                a, b = (np.array([x["node"] for x in side], np.int64) for side in (rest, every))
                a, b = a[i], b[j]
                yield _pair_blobs(a[a != b], b[a != b], buckets // 3)

    blocks = packed.join(other, ["class", "root"]).where("block <= other").select("rest", "every")
    return _distinct_pairs(blocks.mapInPandas(pair, "bucket int, a binary, b binary"))


def _across(member: DataFrame, sketches: DataFrame, roots: DataFrame, buckets: int, percent: int) -> DataFrame:
    """Pairs of a large group between nodes outside its largest component and
    nodes of other components, a block of each at a time. A group with many nodes
    is dealt over ``SPREAD`` keys in both joins."""
    member = member.join(roots, "node", "left").select("class", "node", F.coalesce("root", "node").alias("root"))
    most = member.groupBy("class", "root").count().groupBy("class").agg(F.max_by("root", F.struct("count", "root")).alias("most"), F.sum("count").alias("many"), F.count("*").alias("parts"))
    most = most.where("parts > 1").select("*", F.explode(F.sequence(F.lit(0), F.lit(SPREAD - 1))).alias("spread"))
    member = member.withColumn("spread", F.pmod(F.xxhash64("node"), F.lit(SPREAD)).cast("int"))
    member = materialize(member.join(most, ["class", "spread"]).join(sketches, "node"), "large-members")
    many = F.ceil(F.col("many") / BLOCK)
    block, ways = F.pmod(F.xxhash64("node"), many).alias("block"), F.least(F.lit(SPREAD), many).alias("ways")
    packed = lambda rows, name: rows.groupBy("class", block, ways).agg(F.collect_list(F.struct("node", "root", "n", "parity")).alias(name))
    rest = packed(member.where("root <> most"), "rest").select("class", "rest", F.explode(F.sequence(F.lit(0), F.col("ways") - 1)).alias("way"))
    blocks = rest.join(packed(member, "every").select("class", "every", F.pmod("block", "ways").alias("way")), ["class", "way"])

    def pair(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for rest, every in zip(batch["rest"], batch["every"]):
                i, j = _plausible(rest, every, percent)
                a, b = (np.array([x["node"] for x in side], np.int64) for side in (rest, every))
                yield _pair_blobs(a[i], b[j], buckets // 3)

    return _distinct_pairs(blocks.select("rest", "every").mapInPandas(pair, "bucket int, a binary, b binary"))


def _joined(docs: DataFrame, percent: int, every_link: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The rows of docs with their nodes, the links of nodes (those that make the
    components, or all) and the roots of linked nodes."""
    spark, buckets = docs.sparkSession, blobs.bucket_count(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    nodes = materialize(_nodes(docs), "shingle-nodes")
    frequent = frequent_tokens(nodes)
    met = _postings(docs, frequent, buckets, percent).groupBy("bucket").applyInPandas(_pairs_of_bucket(buckets, percent), "bucket int, a binary, b binary, class long, nodes binary")
    met = materialize(met, "met")
    pairs = materialize(_distinct_pairs(met.where("bucket is not null").select("bucket", "a", "b")), "candidate-pairs")
    member = _members(met.where("class is not null").select("class", "nodes"))
    sketches = materialize(nodes.where("node is not null").groupBy("node").agg(F.first("n").alias("n"), F.first("parity").alias("parity")), "sketches")
    tried = _sketched(pairs, sketches, percent)
    ends = lambda pairs: pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
    sets = _sets(docs, nodes, ends(tried), frequent, percent)
    links = _links(sets, tried, percent)
    roots = components(links)
    if not member.isEmpty():
        more = materialize(_across(member, sketches, roots, buckets, percent).join(pairs, ["a", "b"], "left_anti"), "more-pairs")
        if every_link:
            inside = _within(member, sketches, roots, buckets, percent).join(pairs, ["a", "b"], "left_anti")
            more = materialize(more.union(inside).distinct(), "every-pair")
        if not more.isEmpty():
            lacking = materialize(ends(more).join(sets.select("node"), "node", "left_anti"), "lacking")
            if not lacking.isEmpty():
                sets = sets.union(_sets(docs, nodes, lacking, frequent, percent))
            links = links.union(_links(sets, more, percent))
            roots = components(links)
    return nodes, links, roots


def similar_components(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles and component_id of every row of docs (doc_id, text)."""
    nodes, _, roots = _joined(docs, percent)
    rooted = nodes.join(roots, "node", "left").select("doc_id", "n", "node", F.coalesce("root", "node").alias("root"))
    linked = rooted.where("n > 0")
    # a table of its own, so that the join below can split the rows of a large component
    least = materialize(linked.groupBy("root").agg(F.min("doc_id").alias("component_id")), "least-ids")
    own = rooted.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return linked.join(least, "root").select("doc_id", F.col("n").alias("n_shingles"), "component_id").union(own)


def representatives(docs: DataFrame) -> DataFrame:
    """key (xxhash64 of doc_id and text) of one row of each component, that with
    the least doc_id (null last) and key; a row without words is linked with rows
    of its own id and text alone."""
    nodes, _, roots = _joined(docs, PERCENT)
    rooted = nodes.join(roots, "node", "left").select("doc_id", "key", F.coalesce("root", "node").alias("root"))
    rooted = rooted.withColumn("own", F.when(F.col("root").isNull(), F.col("key")))
    return rooted.groupBy("root", "own").agg(F.min(F.struct(F.col("doc_id").isNull().alias("unknown"), "doc_id", "key")).alias("least")).select("least.key").distinct()


def link_counts(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles and n_links of every row of docs (doc_id, text): the
    number of other rows that it links with, copies included. All pairs of a
    large group are compared, so it costs more than the components."""
    nodes, links, _ = _joined(docs, percent, every_link=True)
    copies = materialize(nodes.where("node is not null").groupBy("node").agg(F.count("*").alias("copies")), "copies")
    sides = links.union(links.select("b", "a")).toDF("node", "other")
    other = sides.join(copies.select(F.col("node").alias("other"), F.col("copies").alias("linked")), "other").groupBy("node").agg(F.sum("linked").alias("linked"))
    n = F.coalesce(F.col("copies") - 1 + F.coalesce("linked", F.lit(0)), F.lit(0)).alias("n_links")
    return nodes.join(copies.join(other, "node", "left"), "node", "left").select("doc_id", F.col("n").alias("n_shingles"), n)


def query(spark, sf_dir: str) -> DataFrame:
    return similar_components(load(spark, sf_dir, "documents"))
