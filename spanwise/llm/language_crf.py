"""Language of each word with a linear-chain conditional random field.

Words are labelled jointly: a word's emission sums the weights of its character
n-grams (1 to 3, with word edges), its affixes (2 to 4), the word itself and the
lexicons it is in; learned transitions tie neighbours. Forward-backward gives each
word's posterior, so code-switched text is labelled word by word; a document's
language is the one with the greatest posterior mass, its score that share.

Training: from a bounded sample (about ``TRAIN_DOCS`` documents a language by a
hash of the text, and ``TRAIN_CHARS`` of each from a hashed place) sequences are
joined from pieces of several documents, so transitions between languages are
seen. Lexicons are the words that the sample holds in one language alone.
Weights of hashed features are fitted by Adagrad on the chain's likelihood.

Prediction reads whole texts, in chains of ``CHAIN`` words. An emission depends on
the word alone, so each worker keeps a bounded cache of them; chains of a batch
run through forward-backward together.

Cases: text that is null or has no letter is ``und`` with score 0; without any
labelled document everything is ``und``. Ties go to the least label. Repeated rows
get equal results. Extra columns are not kept.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanwise.llm import blobs
from spanwise.llm.words import mix64
from spanwise.session import load

TRAIN_DOCS = 400
TRAIN_CHARS = 3_000
CHAIN = 64
CELLS = 1 << 17
CACHE_ENTRIES = 400_000
LEXICON_MIN = 3
SEED = 5


def stem(token: str) -> str:
    """Letters of a token, lower case."""
    return token.lower() if token.isalpha() else "".join(c for c in token.lower() if c.isalpha())


def features(words: list[str], lexicon: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed features of all words in a row, and where each word's begin."""
    codes = np.frombuffer("".join(f"^{w}$" for w in words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    length = np.fromiter((len(w) + 2 for w in words), np.int64, len(words))
    end = np.cumsum(length)
    start, owner = end - length, np.repeat(np.arange(len(words)), length)
    parts, owners = [], []
    for n in (1, 2, 3, 4):
        at = np.arange(len(codes))
        gram = np.zeros(len(codes), np.uint64)  # of the n characters up to each place
        for k in range(n):
            shifted = np.concatenate([np.zeros(n - 1 - k, np.uint64), codes])[: len(codes)]
            gram = gram * np.uint64(0x100000001B3) + shifted
        inside = at - start[owner] >= n - 1
        if n <= 3:
            parts.append(mix64(gram[inside] + np.uint64(n)))
            owners.append(owner[inside])
        if n >= 2:  # affixes: with the edge marks these are n - 1 letters
            for tag, place in ((64, start + n - 1), (128, end - 1)):
                ok = length >= n
                parts.append(mix64(gram[place[ok]] + np.uint64(tag + n)))
                owners.append(np.flatnonzero(ok))
    power = np.uint64(0x9E3779B97F4A7C15)
    whole = np.add.reduceat(mix64(codes + (np.arange(len(codes)) - start[owner]).astype(np.uint64) * power), start) if len(words) else np.zeros(0, np.uint64)
    parts.append(mix64(whole))
    owners.append(np.arange(len(words)))
    known = np.fromiter((lexicon.get(w, -1) for w in words), np.int64, len(words))
    parts.append(mix64((known[known >= 0] + 1_000).astype(np.uint64)))
    owners.append(np.flatnonzero(known >= 0))
    owner = np.concatenate(owners)
    order = np.argsort(owner, kind="stable")
    cell = (np.concatenate(parts)[order] % np.uint64(CELLS)).astype(np.int64)
    return cell, np.searchsorted(owner[order], np.arange(len(words)))


def posteriors(emission: np.ndarray, transition: np.ndarray, real: np.ndarray) -> tuple[np.ndarray, ...]:
    """Posteriors of chains (places, chains, labels), with the local weights and
    the messages. emission and transition are log weights; real marks places that
    hold a word (a chain's words come first)."""
    local = np.exp(emission - emission.max(2, keepdims=True))
    local[~real] = 1.0
    move = np.exp(transition - transition.max())
    forward, backward = np.empty_like(local), np.ones_like(local)
    ones = np.ones((local.shape[2], local.shape[2]), local.dtype)  # sums by a product: rows are short
    forward[0] = local[0] / (local[0] @ ones)
    for t in range(1, len(local)):
        x = forward[t - 1] @ move * local[t]
        forward[t] = np.where(real[t, :, None], x / (x @ ones), forward[t - 1])
    for t in range(len(local) - 2, -1, -1):
        x = (backward[t + 1] * local[t + 1]) @ move.T
        backward[t] = np.where(real[t + 1, :, None], x / (x @ ones), 1.0)
    posterior = forward * backward
    posterior /= posterior @ ones
    return posterior, local, forward, backward


def forward_backward(emission: np.ndarray, transition: np.ndarray, real: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Posteriors of chains (chains, places, labels) and expected transitions."""
    posterior, local, forward, backward = (x.swapaxes(0, 1) for x in posteriors(emission.swapaxes(0, 1), transition, real.T))
    move = np.exp(transition - transition.max())
    pair = np.einsum("nti,ntj->ntij", forward[:, :-1], local[:, 1:] * backward[:, 1:]) * move
    pair /= pair.sum((2, 3), keepdims=True)
    return posterior, (pair * real[:, 1:, None, None]).sum((0, 1))


@dataclass
class Model:
    labels: list[str]
    weight: np.ndarray  #: CELLS by labels
    transition: np.ndarray
    lexicon: dict[str, int]
    name: str = ""

    def emissions(self, words: list[str]) -> np.ndarray:
        if not words:
            return np.zeros((0, len(self.labels)), np.float32)
        cell, start = features(words, self.lexicon)
        return np.add.reduceat(self.weight[cell], start)


def fit(texts: list[str], langs: list[str], rounds: int = 5, chains: int = 1_500) -> Model:
    """A model of labelled texts."""
    labels = sorted(set(langs))
    index, rng = {x: i for i, x in enumerate(labels)}, np.random.default_rng(SEED)
    docs = [([w for w in map(stem, t.split()) if w], index[x]) for t, x in zip(texts, langs)]
    docs = [d for d in docs if d[0]]
    seen: dict[str, np.ndarray] = {}
    for words, y in docs:
        for w in set(words):
            seen.setdefault(w, np.zeros(len(labels), np.int32))[y] += 1
    lexicon = {w: int(n.argmax()) for w, n in seen.items() if n.sum() >= LEXICON_MIN and n.max() >= 0.95 * n.sum()}
    model = Model(labels, np.zeros((CELLS, len(labels)), np.float32), np.zeros((len(labels),) * 2, np.float32), lexicon, uuid.uuid4().hex)
    by_label = [[d for d in docs if d[1] == y] for y in range(len(labels))]
    by_label = [d for d in by_label if d]
    if len(labels) < 2 or not by_label:
        return model
    words, gold = [], []
    for _ in range(chains):  # joined from pieces of documents of several languages
        chain, y = [], []
        while len(chain) < CHAIN:
            own = by_label[rng.integers(len(by_label))]
            some, label = own[rng.integers(len(own))]
            n = int(rng.integers(4, 33))
            at = int(rng.integers(0, max(1, len(some) - n + 1)))
            chain += some[at : at + n]
            y += [label] * len(some[at : at + n])
        words.append(chain[:CHAIN])
        gold.append(y[:CHAIN])
    gold = np.array(gold)
    seen_w, seen_t = np.full_like(model.weight, 1e-2), np.full_like(model.transition, 1e-2)
    size = 50
    prepared = [features([w for chain in words[k : k + size] for w in chain], lexicon) for k in range(0, chains, size)]
    for _ in range(rounds):
        for b in rng.permutation(len(prepared)):
            cell, start = prepared[b]
            y = gold[b * size : (b + 1) * size]
            shape = (*y.shape, len(labels))
            emission = np.add.reduceat(model.weight[cell], start).reshape(shape)
            posterior, moves = forward_backward(emission, model.transition, np.ones(y.shape, bool))
            truth = np.eye(len(labels))[y]
            slope = (posterior - truth).reshape(-1, len(labels)) / len(y)
            place, inverse = np.unique(cell, return_inverse=True)
            owner = np.repeat(np.arange(len(start)), np.diff(np.append(start, len(cell))))
            total = np.stack([np.bincount(inverse, weights=slope[owner, j], minlength=len(place)) for j in range(len(labels))], 1)
            total = total + 1e-5 * model.weight[place]
            seen_w[place] += total**2
            model.weight[place] -= (0.2 * total / np.sqrt(seen_w[place])).astype(np.float32)
            actual = np.einsum("nti,ntj->ij", truth[:, :-1], truth[:, 1:])
            step = (moves - actual) / len(y)
            seen_t += step**2
            model.transition -= (0.2 * step / np.sqrt(seen_t)).astype(np.float32)
    return model


@dataclass
class _Table:
    """A worker's emissions: row of each token and of each stem; row 0 is for
    tokens without a letter."""

    tokens: dict[str, int]
    stems: dict[str, int]
    rows: np.ndarray


_cache: dict[str, _Table] = {}


def _emission_index(model: Model, tokens: list[str]) -> np.ndarray:
    """Row of each token in the worker's table."""
    have = _cache.get(model.name)
    if have is None or len(have.tokens) > CACHE_ENTRIES:
        _cache.clear()
        have = _cache[model.name] = _Table({}, {"": 0}, np.zeros((1, len(model.labels)), np.float32))
    new = set(tokens).difference(have.tokens)
    if new:
        stemmed = {t: stem(t) for t in new}
        fresh = sorted(set(stemmed.values()).difference(have.stems))
        at = len(have.rows)
        have.rows = np.concatenate([have.rows, model.emissions(fresh)])
        have.stems.update(zip(fresh, range(at, at + len(fresh))))
        have.tokens.update((t, have.stems[s]) for t, s in stemmed.items())
    return np.fromiter(map(have.tokens.__getitem__, tokens), np.int64, len(tokens))


def label_words(model: Model, texts: list[str | None]) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each text: the places of words with a letter (by white space), and
    their posteriors (words by labels)."""
    tokens = [(t or "").split() for t in texts]
    count = np.array([len(t) for t in tokens], np.int64)
    at = _emission_index(model, [w for t in tokens for w in t])
    table = _cache[model.name].rows
    first = np.concatenate([[0], np.cumsum(count)])
    worded = at > 0
    per = np.diff(np.concatenate([[0], np.cumsum(worded)])[first])  # words with a letter by text
    chains = -(-per // CHAIN)
    base = np.concatenate([[0], np.cumsum(chains)])
    begin = np.concatenate([[0], np.cumsum(per)])
    within = np.arange(int(per.sum())) - np.repeat(begin[:-1], per)
    slot = np.repeat(base[:-1], per) * CHAIN + within
    grid = np.zeros(int(base[-1]) * CHAIN, np.int64)
    grid[slot] = at[worded]
    grid = grid.reshape(-1, CHAIN)
    posterior = np.zeros((*grid.shape, len(model.labels)), np.float32)
    for k in range(0, len(grid), 1_024):
        part = np.ascontiguousarray(grid[k : k + 1_024].T)
        posterior[k : k + 1_024] = posteriors(table[part], model.transition, part > 0)[0].swapaxes(0, 1)
    flat = posterior.reshape(-1, len(model.labels))[slot]
    places = np.flatnonzero(worded) - np.repeat(first[:-1], per)
    return [(places[begin[i] : begin[i + 1]], flat[begin[i] : begin[i + 1]]) for i in range(len(texts))]


def train(docs: DataFrame) -> Model:
    """A model of a bounded sample of docs (text, lang)."""
    known = docs.where("lang is not null and text is not null").select("lang", "text", F.shiftrightunsigned(F.xxhash64(F.lit(SEED), "text"), 1).alias("h"))
    counts = {r["lang"]: r["count"] for r in known.groupBy("lang").count().collect()}
    rate = F.create_map(*[x for lang, n in counts.items() for x in (F.lit(lang), F.lit(float(2**63) * min(1.0, TRAIN_DOCS / n)))]) if counts else None
    if rate is None:
        return Model([], np.zeros((CELLS, 0), np.float32), np.zeros((0, 0), np.float32), {}, uuid.uuid4().hex)
    place = F.lit(1) + F.pmod("h", F.greatest(F.lit(1), F.length("text") - TRAIN_CHARS)).cast("int")
    sample = known.where(F.col("h") <= F.element_at(rate, F.col("lang"))).select("lang", F.substring("text", place, F.lit(TRAIN_CHARS)).alias("text"))
    rows = sample.distinct().orderBy("lang", "text").collect()  # copies of a text count once
    return fit([r["text"] for r in rows], [r["lang"] for r in rows])


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """docs with lang_pred, score and n_switches (neighbouring words whose
    likeliest languages differ)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("lang_pred string, score double, n_switches long")
    def guess(text: pd.Series) -> pd.DataFrame:
        model, rows = shared.value, []
        if not model.labels:
            return pd.DataFrame({"lang_pred": ["und"] * len(text), "score": 0.0, "n_switches": 0})
        for part in blobs.slices(pd.DataFrame({"text": text}), "text", 2_000_000):
            for _, posterior in label_words(model, part["text"].tolist()):
                if not len(posterior):
                    rows.append(("und", 0.0, 0))
                    continue
                mass = posterior.mean(0, dtype=np.float64)
                best = int(mass.argmax())
                rows.append((model.labels[best], float(min(1.0, mass[best])), int((np.diff(posterior.argmax(1)) != 0).sum())))
        return pd.DataFrame(rows, columns=["lang_pred", "score", "n_switches"])

    return docs.drop("lang_pred", "score", "n_switches").withColumn("__g", guess("text")).select("*", "__g.*").drop("__g")


def query(spark, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents").select("doc_id", "text", "lang").withColumn("held_out", F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False)))
    model = train(docs.where(~F.col("held_out")))
    return predict(docs.select("doc_id", "held_out", "text"), model).select("doc_id", "held_out", "lang_pred", "score", "n_switches")
