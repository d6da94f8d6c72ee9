"""Toxicity with a subsequence string-kernel SVM and Nystroem landmarks.

The kernel of two words counts their common subsequences of ``ORDER`` characters,
each gap and inserted character costing a factor ``DECAY`` (normalised, so a word
with itself gives 1). Landmarks are words of the training sample: those most bound
to the label, none nearly equal to another. A word's kernel values with them,
above ``FLOOR``, are kept, mapped by the inverse root of the landmarks' kernel
matrix (Nystroem), and a linear SVM on that map gives its margin. A sentence, and
so a document, is as toxic as its worst word. Labels belong to whole texts, so a
toxic one gives its words as near as ``CLOSE`` to a landmark, and a clean one, in
rounds, its word of the greatest margin. A logistic curve fitted to the sample
turns the margin into the score.

Words are the letters of tokens, lower case, so ``i.d.i.o.t`` is one word; runs of
three or more single letters are joined. A word that has under ``SHARED`` of a
landmark's letter pairs (neighbours, or with one letter between) has the kernel
value 0 with it.

Training uses a bounded sample of labelled documents: about ``TRAIN_TOXIC`` toxic and
``TRAIN_CLEAN`` others by a hash of the text. Scoring reads whole texts; few words
come near a landmark, and each worker keeps a bounded cache of words.

Cases: null, empty and clean texts score as a sentence without such words; without
labels of both kinds every score is 0. Documents labelled twice count as toxic if
one label says so. Repeated rows get equal scores. Extra columns are not kept.
"""

from __future__ import annotations

import uuid
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanwise.llm import blobs
from spanwise.session import load, materialize

ORDER = 3
DECAY = 0.7
LANDMARKS = 64
FLOOR = 0.3
SHARED = 0.5
LONGEST = 24
TRAIN_TOXIC, TRAIN_CLEAN = 1_500, 3_000
TRAIN_CHARS = 64_000_000
EXCESS, TIMES = 5.0, 8.0
CLOSE = 0.85
CACHE_ENTRIES = 400_000
SEED = 11


def letters(token: str) -> str:
    return token.lower() if token.isalpha() else "".join(c for c in token.lower() if c.isalpha())


def _codes(words: list[str], empty: int) -> np.ndarray:
    """Characters as a matrix; places after a word hold ``empty``."""
    width = max(map(len, words))
    out = np.full((len(words), width), empty, np.int32)
    length = np.fromiter(map(len, words), np.int64, len(words))
    out[np.arange(width) < length[:, None]] = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.int32)
    return out


def subsequence_kernel(left: list[str], right: list[str], order: int = ORDER, decay: float = DECAY) -> np.ndarray:
    """Unnormalised kernel of each left word with the right word at its place."""
    if not left:
        return np.zeros(0)
    s, t = _codes(left, -1), _codes(right, -2)
    square, total = decay * decay, np.zeros(len(left))
    inner = [np.ones((len(left), t.shape[1] + 1))] + [np.zeros((len(left), t.shape[1] + 1)) for _ in range(order - 1)]
    for a in range(s.shape[1]):
        same = s[:, a, None] == t
        total += square * (same * inner[order - 1][:, :-1]).sum(1)
        for i in range(order - 1, 0, -1):  # higher orders first: they use the lower ones without this character
            step = np.zeros(len(left))
            for j in range(t.shape[1]):
                step = decay * step + square * same[:, j] * inner[i - 1][:, j]
                inner[i][:, j + 1] = decay * inner[i][:, j + 1] + step
        # places after a word match nothing; decay there does not reach the total
    return total


def _masks(words: list[str]) -> np.ndarray:
    """Two 64-bit masks of the letter pairs of each word, next to each other or
    with one letter between."""
    code = _codes(words, -1).astype(np.int64)
    out = np.zeros((len(words), 2), np.uint64)
    for gap in (1, 2):
        first, second = code[:, :-gap], code[:, gap:]
        cell = (((first * 8_191 + second) * 2_654_435_761) >> 9) & 127
        bit = np.where(second >= 0, np.uint64(1) << (cell & 63).astype(np.uint64), np.uint64(0))
        for half in (0, 1):
            if bit.shape[1]:
                out[:, half] |= np.bitwise_or.reduce(np.where(cell >> 6 == half, bit, np.uint64(0)), axis=1)
    return out


@dataclass
class Landmarks:
    words: list[str]
    own: np.ndarray = field(init=False)
    masks: np.ndarray = field(init=False)
    need: np.ndarray = field(init=False)

    def __post_init__(self) -> None:
        self.own = np.sqrt(subsequence_kernel(self.words, self.words))
        self.masks = _masks(self.words)
        self.need = np.ceil(np.bitwise_count(self.masks).sum(1) * SHARED)

    def kernel(self, words: list[str]) -> np.ndarray:
        """Normalised kernel values (words by landmarks), 0 below FLOOR."""
        out = np.zeros((len(words), len(self.words)), np.float32)
        long = np.array([k for k, w in enumerate(words) if len(w) >= ORDER], np.int64)
        long = long[np.argsort([len(words[k]) for k in long], kind="stable")]  # words of like length together
        for k in range(0, len(long), 4_096):
            index = long[k : k + 4_096]
            some = [words[x] for x in index]
            masks = _masks(some)
            shared = sum(np.bitwise_count(masks[:, None, h] & self.masks[None, :, h]) for h in (0, 1))
            i, j = np.nonzero(shared >= self.need)
            if not len(i):
                continue
            used, back = np.unique(i, return_inverse=True)
            near = [some[x] for x in used]
            self_k = np.sqrt(subsequence_kernel(near, near))[back]
            value = subsequence_kernel([near[x] for x in back], [self.words[x] for x in j]) / (self_k * self.own[j])
            out[index[i], j] = np.where(value >= FLOOR, value, 0.0)
        return out


def pieces(word: str) -> list[str]:
    """A word, or the overlapping parts of a very long one."""
    return [word] if len(word) <= LONGEST else [word[k : k + LONGEST] for k in range(0, len(word), LONGEST // 2)]


@dataclass
class Model:
    landmarks: Landmarks
    root: np.ndarray
    weight: np.ndarray
    bias: float
    curve: tuple[float, float]  #: slope and offset of the logistic curve
    name: str


class Reader:
    """Kernel values of the words of texts, with a bounded cache."""

    def __init__(self, landmarks: Landmarks) -> None:
        self.landmarks = landmarks
        self._clear()

    def _clear(self) -> None:
        # token -> 2 * row of its values (0: none) + 1 if a single letter
        self.known: dict[str, int] = {}
        self.stems: dict[str, int] = {"": 0}
        self.rows = np.zeros((1, len(self.landmarks.words)), np.float32)

    def _learn(self, new: set[str]) -> None:
        stemmed = {t: letters(t) for t in new}
        fresh = [s for s in set(stemmed.values()).difference(self.stems)]
        parts = [p for s in fresh for p in pieces(s)]
        values = self.landmarks.kernel(parts)
        start = np.cumsum([0] + [len(pieces(s)) for s in fresh])[:-1]
        if len(fresh):
            values = np.maximum.reduceat(values, start)
        near = np.flatnonzero(values.any(1)) if len(fresh) else np.zeros(0, int)
        at = len(self.rows)
        self.stems.update((s, 0) for s in fresh)
        self.stems.update((fresh[k], at + n) for n, k in enumerate(near.tolist()))
        if len(near):
            self.rows = np.concatenate([self.rows, values[near]])
        self.known.update((t, 2 * self.stems[s] + (len(s) == 1)) for t, s in stemmed.items())

    def near(self, texts: list[str | None]) -> list[np.ndarray]:
        """For each text the values (words by landmarks) of the distinct words of
        its sentences that come near a landmark."""
        if len(self.known) > CACHE_ENTRIES:
            self._clear()
        tokens = [(t or "").split() for t in texts]
        flat = [w for t in tokens for w in t]
        new = set(flat).difference(self.known)
        if new:
            self._learn(new)
        code = np.fromiter(map(self.known.__getitem__, flat), np.int64, len(flat))
        single = (code & 1) > 0
        extra: list[tuple[int, int]] = []
        if single.any():  # runs of single letters are read as a word
            run = np.flatnonzero(np.diff(single.astype(np.int8), prepend=0, append=0))
            bounds = np.cumsum([len(t) for t in tokens])
            for a, b in zip(run[::2].tolist(), run[1::2].tolist()):
                if b - a >= 3:
                    word = "".join(letters(x) for x in flat[a : min(b, int(bounds[np.searchsorted(bounds, a, side="right")]))])
                    if word not in self.stems:
                        self._learn({word})
                    if self.stems[word]:
                        extra.append((a, self.stems[word]))
        row = code >> 1
        hits = np.flatnonzero(row)
        place = np.concatenate([hits, np.array([e[0] for e in extra], np.int64)])
        row = np.concatenate([row[hits], np.array([e[1] for e in extra], np.int64)])
        order = np.argsort(place, kind="stable")
        cut = np.searchsorted(place[order], np.concatenate([[0], np.cumsum([len(t) for t in tokens])]))
        row = row[order]
        return [self.rows[np.unique(row[a:b])] for a, b in zip(cut[:-1].tolist(), cut[1:].tolist())]


def _choose(texts: list[str], toxic: np.ndarray) -> list[str]:
    """Landmarks: words most bound to toxic documents, unlike each other."""
    inside, outside = Counter(), Counter()
    for text, y in zip(texts, toxic):
        (inside if y else outside).update({p for t in text.split() if len(s := letters(t)) >= ORDER for p in pieces(s)})
    n1, n0 = max(1, int(toxic.sum())), max(1, int((~toxic).sum()))
    excess = {w: (n - outside[w] * n1 / n0) / np.sqrt(outside[w] * n1 / n0 + 1) for w, n in inside.items()}  # over chance, in deviations
    ranked = sorted((w for w, z in excess.items() if z >= EXCESS and inside[w] / n1 >= TIMES * outside[w] / n0), key=lambda w: (-excess[w], w))
    chosen: list[str] = []
    for w in ranked[: 20 * LANDMARKS]:
        if len(chosen) == LANDMARKS:
            break
        if not chosen or Landmarks(chosen).kernel([w]).max() < 0.9:
            chosen.append(w)
    return chosen


def _svm(x: np.ndarray, y: np.ndarray, strength: float = 3.0, rounds: int = 30) -> tuple[np.ndarray, float]:
    """Linear SVM (hinge loss) by dual coordinate ascent."""
    x = np.concatenate([x, np.ones((len(x), 1))], 1)
    norm, alpha, w = (x * x).sum(1), np.zeros(len(x)), np.zeros(x.shape[1])
    rng = np.random.default_rng(SEED)
    for _ in range(rounds):
        for i in rng.permutation(len(x)):
            was = alpha[i]
            alpha[i] = min(max(was - (y[i] * (x[i] @ w) - 1) / norm[i], 0.0), strength)
            if alpha[i] != was:
                w += (alpha[i] - was) * y[i] * x[i]
    return w[:-1], float(w[-1])


def fit(texts: list[str], labels: list[int]) -> Model | None:
    """A model of labelled documents; None without both labels."""
    toxic = np.array(labels, bool)
    if toxic.all() or not toxic.any():
        return None
    chosen = _choose(texts, toxic)
    if not chosen:
        return None
    marks = Landmarks(chosen)
    own = marks.kernel(marks.words).astype(np.float64)
    value, vector = np.linalg.eigh((own + own.T) / 2)
    root = vector @ np.diag(1 / np.sqrt(np.maximum(value, 0.05))) @ vector.T
    raw = [s.astype(np.float64) if len(s) else np.zeros((1, len(root))) for s in Reader(marks).near(texts)]
    found = [s @ root for s in raw]
    worst = np.concatenate([f[s.max(1) >= CLOSE] for s, f, y in zip(raw, found, toxic) if y])
    if not len(worst):
        return None
    worst = worst[np.random.default_rng(SEED).permutation(len(worst))[: 2 * TRAIN_TOXIC]]
    weight, bias = root @ np.ones(len(root)), -0.5
    clean = np.zeros((0, len(root)))
    for _ in range(4):  # adds the clean documents' worst words under the model so far
        more = [f[(f @ weight).argmax()] for f, y in zip(found, toxic) if not y]
        clean = np.unique(np.concatenate([clean, more]), axis=0)
        weight, bias = _svm(np.concatenate([worst, clean]), np.repeat([1.0, -1.0], [len(worst), len(clean)]))
    margin = np.array([(s @ weight).max() for s in found]) + bias
    a, b = 1.0, 0.0
    for _ in range(200):  # logistic curve by damped Newton steps
        p = 1 / (1 + np.exp(-np.clip(a * margin + b, -30, 30)))
        g = np.array([((p - toxic) * margin).sum(), (p - toxic).sum()]) + np.array([1e-3 * a, 0])
        r = np.maximum(p * (1 - p), 1e-6)
        h = np.array([[(r * margin**2).sum() + 1e-3, (r * margin).sum()], [(r * margin).sum(), r.sum()]]) + 1e-6 * np.eye(2)
        step = np.linalg.solve(h, g)
        a, b = a - 0.5 * step[0], b - 0.5 * step[1]
        if np.abs(step).max() < 1e-9:
            break
    return Model(marks, root, weight, bias, (max(a, 1e-3), b), uuid.uuid4().hex)


def _fitting(rows: list, budget: int | None = None) -> list[int]:
    """Of each label the shortest texts that fit its half of the characters, one at
    least: a text beyond that leaves itself out and no other."""
    out = []
    for label in sorted({r["toxic"] for r in rows}):
        some = sorted((r["chars"], r["row"]) for r in rows if r["toxic"] == label)
        fits = int(np.searchsorted(np.cumsum([n for n, _ in some]), (TRAIN_CHARS if budget is None else budget) // 2, side="right"))
        out += [row for _, row in some[: max(fits, 1)]]
    return out


def train(docs: DataFrame, labels: DataFrame) -> Model | None:
    """A model of a bounded sample of docs (doc_id, text) labelled in labels. Of each
    label the shortest texts that fit half of ``TRAIN_CHARS`` characters serve."""
    marked = labels.where("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    marked = marked.withColumn("h", F.shiftrightunsigned(F.xxhash64(F.lit(SEED), "doc_id"), 1) / float(2**63))
    counts = {r["toxic"]: r["count"] for r in marked.groupBy("toxic").count().collect()}
    rate = F.when(F.col("toxic") == 1, TRAIN_TOXIC / max(1, counts.get(1, 1))).otherwise(TRAIN_CLEAN / max(1, counts.get(0, 1)))
    sample = marked.where(F.col("h") < rate).select("doc_id", "toxic", "h").orderBy("h", "doc_id").limit(2 * (TRAIN_TOXIC + TRAIN_CLEAN))
    found = docs.where("text is not null").select("doc_id", "text").join(F.broadcast(sample), "doc_id").select("doc_id", "text", "toxic", "h").distinct()
    # repeated ids bring more texts: the rows and characters on the driver are bounded all the same
    found = materialize(found.orderBy("h", "doc_id", "text").limit(2 * (TRAIN_TOXIC + TRAIN_CLEAN)), "toxicity-sample").select("*", F.length("text").alias("chars"), F.xxhash64("doc_id", "text").alias("row"))
    kept = docs.sparkSession.createDataFrame([(r,) for r in _fitting(found.select("toxic", "chars", "row").collect())], "row long")
    rows = found.join(F.broadcast(kept), "row", "left_semi").select("text", "toxic").orderBy("text", "toxic").collect()
    return fit([r["text"] for r in rows], [r["toxic"] for r in rows])


_readers: dict[str, Reader] = {}


def score(docs: DataFrame, model: Model | None) -> DataFrame:
    """docs with score and predicted."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def worst(text: pd.Series) -> pd.Series:
        model, out = shared.value, []
        if model is None:
            return pd.Series(np.zeros(len(text)))
        if model.name not in _readers:
            _readers.clear()
            _readers[model.name] = Reader(model.landmarks)
        weight, (a, b) = model.root @ model.weight, model.curve
        for part in blobs.slices(pd.DataFrame({"text": text}), "text", 2_000_000):
            for values in _readers[model.name].near(part["text"].tolist()):
                # a text without such words has the zero vector
                margin = max(float((values @ weight).max()), 0.0) if len(values) else 0.0
                out.append(1 / (1 + np.exp(-np.clip(a * (margin + model.bias) + b, -30, 30))))
        return pd.Series(out, dtype=float)

    return docs.drop("score", "predicted").withColumn("score", worst("text")).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def query(spark, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))
    model = train(docs.where(~held), load(spark, sf_dir, "labels").where(~held))
    return score(docs.withColumn("held_out", held), model).select("doc_id", "held_out", "score", "predicted")
