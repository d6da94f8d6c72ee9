"""Vectorised word splitting and hashing shared by the text operators.

A word is a maximal run of bytes outside ``\\x20`` and ``\\x09-\\x0D`` (the
pattern ``[^\\x20\\x09-\\x0D]+``). A batch of texts is handled as one byte buffer
with numpy, so the cost of a word is a few array passes and no Python loop.
Hashes are 64 bit and depend on the bytes alone: equal words hash alike in
every task, and a retried task repeats itself.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np

WHITE = np.zeros(256, dtype=bool)
WHITE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20
_TABLE = np.random.default_rng(20240117).integers(1, 2**63, size=256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15 | 1


def mix64(x: np.ndarray) -> np.ndarray:
    """The 64-bit finaliser of splitmix64: a bijection that spreads all bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    out = np.ones(max(n, 1), dtype=np.uint64)
    have = 1
    while have < n:
        step = np.uint64(pow(base, have, 2**64))
        more = min(have, n - have)
        out[have : have + more] = out[:more] * step
        have += more
    return out


@dataclass
class Words:
    """Words of a batch of texts.

    data: the bytes, texts apart by a line break; start, end: byte range of each
    word; first: index of each text's first word, with the total at the end;
    hash: a 64-bit hash of each word.
    """

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray
    hash: np.ndarray

    def __len__(self) -> int:
        return len(self.first) - 1

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def owner(self) -> np.ndarray:
        """Index of the text of each word."""
        return np.repeat(np.arange(len(self)), self.counts)

    def kept(self, text: int, keep: np.ndarray | None = None) -> bytes:
        """The words of a text (those in the mask), joined by one space."""
        lo, hi = int(self.first[text]), int(self.first[text + 1])
        raw = self.data
        index = range(lo, hi) if keep is None else (lo + np.flatnonzero(keep)).tolist()
        start, end = self.start, self.end
        return b" ".join([raw[start[i] : end[i]].tobytes() for i in index])


def split_words(texts: Iterable[str | None], lower: bool = False, hashes: bool = True) -> Words:
    """Words of the texts; null counts as empty. lower: A-Z become a-z first."""
    raw = [t.encode("utf-8", "surrogatepass") if t else b"" for t in texts]
    data = np.frombuffer(b"\n".join(raw) + b"\n", dtype=np.uint8)
    if lower:
        data = _LOWER[data]
    white = WHITE[data]
    edge = np.diff(white.view(np.int8), prepend=np.int8(1))
    start, end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    limits = np.cumsum([len(r) + 1 for r in raw], dtype=np.int64) if raw else np.zeros(0, np.int64)
    first = np.concatenate([[0], np.searchsorted(start, limits)]).astype(np.int64)
    found = np.zeros(0, np.uint64)
    if hashes and len(start):
        length = end - start
        body = data[~white]
        offset = np.concatenate([[0], np.cumsum(length)[:-1]])
        place = np.arange(len(body)) - np.repeat(offset, length)
        value = _TABLE[body] * powers(_BASE, int(length.max()))[place]
        found = mix64(np.add.reduceat(value, offset) + length.astype(np.uint64))
    return Words(data, start, end, first, found)


def window_hash(words: np.ndarray, width: int, seed: int = 0) -> np.ndarray:
    """Hash of each run of ``width`` consecutive word hashes (over the whole
    batch: the caller masks runs that cross texts)."""
    n = len(words) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    base = (0xD6E8FEB86659FD93 + 2 * seed) | 1
    out = np.zeros(n, np.uint64)
    for j in range(width):  # Horner's rule over the window
        out = out * np.uint64(base) + words[j : j + n]
    return mix64(out + np.uint64((seed * 0x9E3779B97F4A7C15) % 2**64))


def inside(first: np.ndarray, width: int, total: int) -> np.ndarray:
    """Starts of the windows of ``width`` words that lie in one text."""
    ok = np.zeros(max(total, 0) + 1, dtype=np.int64)
    lo, hi = first[:-1], np.maximum(first[:-1], first[1:] - width + 1)
    np.add.at(ok, lo, 1)
    np.add.at(ok, hi, -1)
    return np.flatnonzero(np.cumsum(ok[:-1]) > 0)
