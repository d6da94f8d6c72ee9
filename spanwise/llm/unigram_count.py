"""Token counts of a unigram tokenizer without making its tokens.

An Aho-Corasick automaton finds every vocabulary piece that ends at each place of
a word; dynamic programming carries the best score and its number of pieces. The
tie rules are the tokenizers library's: of equal scores the piece that starts
first wins; a character that is no piece itself is unknown, scores 10 below the
least piece, and runs of unknown characters are one token. Scores are added in
the same order in double precision, so counts equal the library's.

Words (runs without white space) are taken with the word mark before each, and
counts are cached by word in each worker, in a cache of bounded size.

The vocabulary is that of a SentencePiece file whose path is a parameter; as the
installed files hold merge ranks and not log-probabilities, a piece of rank r
scores as Zipf's law has it, ``-log(r + 2.7)``.

Cases: null and empty texts have 0 tokens; repeated rows count alike; very long
words are handled whole; extra columns are not kept.
"""

from __future__ import annotations

import math
import re
from functools import lru_cache

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanwise.session import load

MARK = "▁"
UNKNOWN = "<unk>"
PENALTY = 10.0
CACHE_ENTRIES = 500_000
_SEPARATORS = re.compile("[\x1c-\x1f]")
_WHITE = re.compile("[^\\S\x1c-\x1f]+")


@lru_cache(maxsize=4)
def vocabulary(path: str) -> tuple[tuple[str, float], ...]:
    """Pieces and scores; the unknown piece is the first."""
    from sentencepiece import SentencePieceProcessor

    model = SentencePieceProcessor(model_file=path)
    pieces = [model.id_to_piece(i) for i in range(model.vocab_size()) if not (model.is_unknown(i) or model.is_control(i) or model.is_byte(i) or model.is_unused(i))]
    return ((UNKNOWN, 0.0), *((p, -math.log(r + 2.7)) for r, p in enumerate(pieces)))


class Counter:
    """count(word) -> number of tokens of one word with its mark."""

    def __init__(self, pieces: tuple[tuple[str, float], ...]) -> None:
        self.automaton = ahocorasick.Automaton()
        for piece, score in pieces:
            self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.unknown = min(score for _, score in pieces) - PENALTY
        self.cache: dict[str, int] = {}

    def word(self, text: str) -> int:
        n = len(text)
        best, count, strange = [0.0] * (n + 1), [0] * (n + 1), [False] * (n + 1)
        done = 0  # places up to here have their best path

        def close(end: int, found: list[tuple[int, float]]) -> None:
            """Best path to ``end`` from the pieces (length, score) that end there."""
            top, at, unknown, single = None, 0, False, False
            for length, score in sorted(found, reverse=True):  # by start, ascending
                single = single or length == 1
                if top is None or best[end - length] + score > top:
                    top, at = best[end - length] + score, end - length
            if not single and (top is None or best[end - 1] + self.unknown > top):
                top, at, unknown = best[end - 1] + self.unknown, end - 1, True
            best[end], strange[end] = top, unknown
            count[end] = count[at] + (not (unknown and strange[at]))

        found: list[tuple[int, float]] = []
        for last, value in self.automaton.iter(text):
            while done < last:
                close(done + 1, found)
                done, found = done + 1, []
            found.append(value)
        while done < n:
            close(done + 1, found)
            done, found = done + 1, []
        return count[n]

    def text(self, text: str | None) -> int:
        total, cache = 0, self.cache
        words = (text or "").split() if not text or not _SEPARATORS.search(text) else [w for w in _WHITE.split(text) if w]
        for w in words:
            n = cache.get(w)
            if n is None:
                if len(cache) >= CACHE_ENTRIES:
                    cache.clear()
                n = cache[w] = self.word(MARK + w)
            total += n
        return total


@lru_cache(maxsize=4)
def counter(path: str) -> Counter:
    return Counter(vocabulary(path))


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def token_counts(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_chars and n_tokens of every row of docs (doc_id, text)."""
    path = path or default_path()

    @F.pandas_udf("long")
    def count(text: pd.Series) -> pd.Series:
        return text.map(counter(path).text).astype("int64")

    return docs.select("doc_id", F.coalesce(F.length("text"), F.lit(0)).cast("long").alias("n_chars"), F.coalesce(count(F.coalesce("text", F.lit(""))), F.lit(0)).alias("n_tokens"))


def query(spark, sf_dir: str) -> DataFrame:
    return token_counts(load(spark, sf_dir, "documents"))
