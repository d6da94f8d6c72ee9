"""Fast exact encoding with a byte-level BPE of the tokenizers library.

The tokenizer's first step cuts texts where a space or line break stands between
other characters, and no merge crosses such a cut. Texts are therefore cut there
with ``str.split`` and each piece is looked up in a cache of encoded pieces;
pieces that are new go through the library's pre-tokenizer pattern and its BPE
model. Texts with runs of white space or other white characters are encoded
whole. With ``special``, the literal of a special token becomes its id, as in a plain
call of the library, and texts that hold one are encoded whole; without it such a
literal is ordinary text. Caches belong to a Python worker, are kept between its tasks and hold a
bounded number of entries; they never change a result.
"""

from __future__ import annotations

import json
import re
import struct
from functools import lru_cache

import numpy as np

ENTRIES = 600_000  #: a worker keeps twice as many pieces, three quarters of them such as follow a space
_ODD = re.compile("[\t\r\x0b\x0c\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
#: The pre-tokenizer pattern of the byte-level BPE family (fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def _byte_letters() -> dict[int, str]:
    """The printable stand-in of each byte: itself where it is printable, else
    the next free code point from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(other)}


class _Pieces(dict):
    """Encoded pieces (uint32 bytes) by text; a missing one is made."""

    def __init__(self, make, entries: int) -> None:
        super().__init__()
        self.make, self.entries = make, entries

    def __missing__(self, piece: str) -> bytes:
        found = self.make(piece)
        if len(self) < self.entries:  # frequent pieces come early, so a full cache keeps what it has
            self[piece] = found
        return found


class _Following(dict):
    """Encoded pieces after a space. Words of letters alone, each one word of the pattern,
    may fill it; others, made from those, have the first half."""

    def __init__(self, encoder: Encoder, entries: int) -> None:
        super().__init__()
        self.encoder, self.entries = encoder, entries

    def __missing__(self, piece: str) -> bytes:
        made, room = self.encoder, self.entries
        if piece.isalpha():
            found = made._word(" " + piece)
        elif piece[-1:] in made.marks and piece[:-1].isalpha():  # a word and a mark, the commonest other kind
            found, room = self[piece[:-1]] + made.words[piece[-1]], room // 2
        else:
            found, room = made._piece(" " + piece), room // 2
        if len(self) < room:
            self[piece] = found
        return found


class Encoder:
    """encode(text) -> ids as little-endian unsigned 32-bit bytes."""

    def __init__(self, path: str, entries: int = ENTRIES, special: bool = False) -> None:
        import regex
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = not special
        with open(path, encoding="utf-8") as f:
            told = json.load(f)
        first = told.get("pre_tokenizer") or {}
        self.cut = first.get("type") == "ByteLevel" and first.get("use_regex") and not first.get("add_prefix_space") and not told.get("normalizer")
        self.literals = [t["content"] for t in told.get("added_tokens") or []] if special else []
        self.size = self.tokenizer.get_vocab_size()
        self.find, self.model, self.letters = regex.compile(PATTERN).findall, self.tokenizer.model, _byte_letters()
        self.space = self.letters[0x20]
        self.words, self.first = _Pieces(self._word, entries // 4), _Pieces(self._piece, entries // 4)
        self.next = _Following(self, 3 * entries // 2)
        self.four = [struct.pack("<I", k) for k in range(1 + max(self.tokenizer.get_vocab().values(), default=0))] if self.cut else []
        self.marks = frozenset(",.")
        self.newline = self._word("\n") if self.cut else b""

    def _word(self, word: str) -> bytes:
        if word.isascii() and word[1:].isalpha() and word[0] == " ":  # letters stand for themselves
            shown = self.space + word[1:]
        else:
            shown = word.encode("utf-8").decode("latin-1").translate(self.letters)
        four = self.four
        return b"".join([four[t.id] for t in self.model.tokenize(shown)])

    def _piece(self, piece: str) -> bytes:
        body, words = piece[:-1], self.words
        if piece[-1:] in self.marks and body.lstrip(" ").isalpha():  # a word and a mark, the commonest kind
            return words[body] + words[piece[-1]]
        return b"".join([words[w] for w in self.find(piece)])

    def encode(self, text: str | None) -> bytes:
        if not text:
            return b""
        if not self.cut or len(text.split()) != 1 + text.count(" ") + text.count("\n") or _ODD.search(text) or any(x in text for x in self.literals):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()
        lines, first, following = [], self.first, self.next.__getitem__
        for line in text.split("\n"):
            head, *rest = line.split(" ")
            lines.append(first[head] + b"".join(map(following, rest)))
        return self.newline.join(lines)


@lru_cache(maxsize=1)
def encoder(path: str, entries: int = ENTRIES, special: bool = False) -> Encoder:
    """The worker's encoder for a tokenizer file."""
    return Encoder(path, entries, special)


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")
