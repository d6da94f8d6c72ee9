"""Quality rules combined by weak supervision.

Each rule looks at one property of a text and votes good, bad or abstains.
Expectation-maximisation over the votes of all documents estimates the share of
good documents and how often each rule votes which way on good and on bad ones
(Dawid-Skene with abstentions); a document's verdict is its posterior
probability of being good. Votes are independent given quality, no label is used.

A document is its vote pattern: patterns are counted by Spark over all documents
(at most 3 ** 8 of them, whatever the input), the expectation-maximisation runs
on the counts, and the posteriors come back as a table of patterns.

Base counts, kept beside the verdict: words ``[^\\x20\\x09-\\x0D]+``, code points in
them, symbols ``#*$%&|<>``, lines with a word that equal an earlier line, and
words in 8-word windows that the text holds twice or more. A text of fewer than
20 words, or with over 30 % of its words in such windows, fails outright.

Cases: null and empty texts have zero counts and fail; repeated rows get equal
verdicts; an empty table gives an empty one; extra columns are kept, those with
an output's name are replaced.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanwise.llm import blobs
from spanwise.llm.words import WHITE, split_words, window_hash
from spanwise.session import load, materialize

MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
REPEAT_WINDOW = 8
_BASE = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"
_MORE = "n_lines long, n_letters long, n_upper long, n_bare long, n_loud long"
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True


def _repeats(hashes: np.ndarray, width: int = REPEAT_WINDOW) -> int:
    """Words in windows that occur twice or more."""
    h = window_hash(hashes, width)
    if len(h) < 2:
        return 0
    s = np.sort(h)
    twice = s[1:][s[1:] == s[:-1]]
    if not len(twice):
        return 0
    edge = np.zeros(len(hashes) + 1, np.int64)
    at = np.flatnonzero(np.isin(h, twice))
    np.add.at(edge, at, 1)
    np.add.at(edge, at + width, -1)
    return int((np.cumsum(edge) > 0).sum())


def describe(texts: pd.Series) -> pd.DataFrame:
    """The counts of each text."""
    out = []
    for part in blobs.slices(pd.DataFrame({"text": texts}), "text"):
        words = split_words(part["text"])
        data = words.data
        heads = (data & 0xC0) != 0x80  # first bytes of code points
        length = np.array([len(t.encode("utf-8", "surrogatepass")) if t else 0 for t in part["text"]]) + 1
        begin = np.concatenate([[0], np.cumsum(length)[:-1]]).astype(np.int64)
        total = lambda mask: np.add.reduceat(mask.astype(np.int64), begin)
        upper = (data >= 0x41) & (data <= 0x5A)
        letter = upper | ((data >= 0x61) & (data <= 0x7A)) | ((data >= 0xC3) & heads)
        seen = np.concatenate([[0], np.cumsum(letter)])
        bare = seen[words.end] == seen[words.start]  # words without a letter
        loud = data[words.end - 1] == 0x21
        per_text = lambda mask: np.diff(np.concatenate([[0], np.cumsum(mask)])[words.first])
        dup, lines = [], []
        for t in part["text"]:
            found = [x for x in (t or "").split("\n") if x.strip(" \t\n\r\x0b\x0c")]
            dup.append(len(found) - len(set(found)))
            lines.append(len(found))
        out.append(pd.DataFrame({
            "n_words": words.counts, "word_chars": total(heads & ~WHITE[data]), "n_symbols": total(_SYMBOL[data]), "n_dup_lines": dup,
            "n_repeat_words": [_repeats(words.hash[a:b]) for a, b in zip(words.first[:-1], words.first[1:])],
            "n_lines": lines, "n_letters": total(letter), "n_upper": total(upper), "n_bare": per_text(bare), "n_loud": per_text(loud),
        }))
    return pd.concat(out, ignore_index=True) if out else pd.DataFrame(columns=[x.split()[0] for x in f"{_BASE}, {_MORE}".split(", ")])


def _share(part: str, whole: str) -> Column:
    return F.coalesce(F.try_divide(F.col(part), F.col(whole)), F.lit(0.0))


def _vote(value: Column, good: Column, bad: Column) -> Column:
    """2 good, 0 bad, 1 abstains."""
    return F.when(bad, 0).when(good, 2).otherwise(1)


def rules() -> dict[str, Column]:
    """The votes. Thresholds are parameters of the rules, not fitted."""
    def limits(value: Column, good: float, bad: float) -> Column:
        return _vote(value, value <= good, value > bad)

    mean = _share("word_chars", "n_words")
    n = F.col("n_words")
    return {
        "length": _vote(n, n >= 40, n < 20),
        "symbols": limits(_share("n_symbols", "n_words"), 0.05, 0.2),
        "dup_lines": limits(_share("n_dup_lines", "n_lines"), 0.1, 0.3),
        "repeats": limits(_share("n_repeat_words", "n_words"), 0.1, 0.3),
        "word_length": _vote(mean, mean.between(3, 9), (mean < 2.5) | (mean > 12)),
        "upper": limits(_share("n_upper", "n_letters"), 0.2, 0.5),
        "bare": limits(_share("n_bare", "n_words"), 0.05, 0.2),
        "loud": limits(_share("n_loud", "n_words"), 0.05, 0.2),
    }


def _better_than_chance(n: np.ndarray) -> np.ndarray:
    """Rates of the votes (class, rule, vote) from their counts. On bad texts a rule
    votes bad at least as often as on good ones, and good at most as often: where
    the counts say otherwise the classes share one rate for that vote (the
    likeliest under the bound), and the other votes divide what is left."""
    rate = n / n.sum(2, keepdims=True)
    for vote, ahead in ((0, 0), (2, 1)):
        tied = rate[ahead, :, vote] < rate[1 - ahead, :, vote]
        shared = n[:, :, vote].sum(0) / n.sum((0, 2))
        left = np.where(tied, (1 - shared) / (1 - rate[:, :, vote]), 1.0)
        others = [v for v in range(3) if v != vote]
        rate[:, :, others] *= left[:, :, None]
        rate[:, :, vote] = np.where(tied, shared, rate[:, :, vote])
    return rate


def posteriors(votes: np.ndarray, count: np.ndarray, rounds: int = 200) -> np.ndarray:
    """Probability of good for each pattern; votes: patterns by rules, 0 1 2."""
    if not len(votes):
        return np.zeros(0)
    hot = votes[:, :, None] == np.arange(3)
    weight = count / count.sum()
    balance = (votes == 2).sum(1) - 2.0 * (votes == 0).sum(1)
    good = 1 / (1 + np.exp(-balance))  # starts from the votes, a bad one counting double
    for _ in range(rounds):
        was = good
        prior = float(np.clip((weight * good).sum(), 0.01, 0.99))
        n = np.stack([np.einsum("p,prv->rv", count * p, hot) + 1.0 for p in (1 - good, good)])
        bad_rate, good_rate = _better_than_chance(n)
        ratio = np.einsum("prv,rv->p", hot, np.log(good_rate) - np.log(bad_rate)) + np.log(prior / (1 - prior))
        good = 1 / (1 + np.exp(-np.clip(ratio, -60, 60)))
        if np.abs(good - was).max() < 1e-9:
            break
    return good


def judged(described: DataFrame) -> DataFrame:
    """Adds base_failed, quality and kept to rows with the counts."""
    spark, votes, described = described.sparkSession, rules(), described.drop("base_failed", "quality", "kept")
    code = sum((v * 3**i for i, v in enumerate(votes.values())), F.lit(0)).cast("int")
    coded = described.withColumn("__pattern", code)
    found = coded.groupBy("__pattern").count().toPandas()  # at most 3 ** 8 rows
    pattern = found["__pattern"].to_numpy(np.int64)
    digits = (pattern[:, None] // 3 ** np.arange(len(votes))) % 3
    good = posteriors(digits, found["count"].to_numpy(float))
    table = spark.createDataFrame(list(zip(pattern.tolist(), good.tolist())), "__pattern int, quality double")
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    out = coded.join(F.broadcast(table), "__pattern").withColumn("base_failed", failed)
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("quality") >= 0.5)).drop("__pattern")


def with_counts(docs: DataFrame) -> DataFrame:
    udf = F.pandas_udf(describe, f"{_BASE}, {_MORE}")
    names = [x.split()[0] for x in f"{_BASE}, {_MORE}".split(", ")]
    return docs.drop(*names).withColumn("__c", udf("text")).select(*[c for c in docs.columns if c not in names], "__c.*")


def query(spark, sf_dir: str) -> DataFrame:
    described = materialize(with_counts(load(spark, sf_dir, "documents").select("doc_id", "text")).drop("text"), "quality-counts")
    return judged(described).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "quality")
