"""Whole texts to token ids, with one lookup for each word seen before."""

from __future__ import annotations

import os
import re
from array import array
from functools import lru_cache

import numpy as np

#: White space on which Python and the tokenizers may differ; texts with any of
#: it go to the library whole.
_ODD = re.compile("[\x1c-\x1f\x85\u180e]")
#: A run of Latin letters is cut off where ASCII that is no letter, digit or
#: underscore follows: both tokenizers split there, and nothing composes across.
_LETTERS = r"[A-Za-zÀ-ÖØ-öø-ÿ]++(?=[\x00-\x2f\x3a-\x40\x5b-\x5e\x60\x7b-\x7f]|\Z)"
_WITH_SPACE = re.compile(rf" ?{_LETTERS}| ?\S+|\s+(?!\S)|\s+")
_WITHOUT_SPACE = re.compile(rf"{_LETTERS}|\S+")
_WORD = re.compile(rf" ?{_LETTERS}")


def _byte_letters() -> dict[int, str]:
    """Byte-level vocabularies write printable Latin bytes as themselves and the
    others, in order, as the characters from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = (b for b in range(256) if b not in plain)
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(others)}


class WordTokenizer:
    """Ids of a public tokenizer file, as the library gives for the whole text.

    Neither tokenizer ever joins characters across the places where a text is
    cut here (at white space, before a single space, after a run of letters), so
    the ids of a text are those of its cuts in order. Each cut is encoded by the
    library once and kept; beyond ``capacity`` the long ones are let go, and
    cuts longer than 64 are never kept. Strings of special tokens in a text are
    ordinary text.
    """

    def __init__(self, path: str, capacity: int = 800_000) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.lib = Tokenizer.from_file(path)
        self.lib.encode_special_tokens = True
        self.lower = self.lib.normalizer is not None
        self.cut = (_WITHOUT_SPACE if self.lower else _WITH_SPACE).findall
        self.capacity, self.kept = capacity, {}
        self.letters = _byte_letters()

    def _library(self, texts: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self.lib.encode_batch_fast(texts, add_special_tokens=False)]

    def _word(self, word: str) -> bytes:
        """Ids of a run of letters, which is one piece to the library's model."""
        piece = (word.lower() if self.lower else word).encode().decode("latin-1").translate(self.letters)
        return array("I", [t.id for t in self.lib.model.tokenize(piece)]).tobytes()

    def encode_bytes(self, text: str | None) -> bytes:
        """Little-endian unsigned 32-bit ids; of a null text: none."""
        if not text:
            return b""
        if _ODD.search(text):
            return self._library([text])[0]
        cuts, kept = self.cut(text), self.kept
        new = set(cuts).difference(kept)
        if len(kept) + len(new) > self.capacity:
            kept = self.kept = {k: v for k, v in kept.items() if len(k) <= 8} if len(kept) <= self.capacity else {}
            if len(kept) > self.capacity // 2:
                kept.clear()
            new = set(cuts).difference(kept)
        other = []
        for x in new:
            if _WORD.fullmatch(x):
                kept[x] = self._word(x)
            else:
                other.append(x)
        if other:
            kept.update(zip(other, self._library(other), strict=True))
        ids = b"".join(map(kept.__getitem__, cuts))
        for x in new:
            if len(x) > 64:
                del kept[x]
        return ids

    def encode(self, text: str | None) -> np.ndarray:
        return np.frombuffer(self.encode_bytes(text), dtype="<u4")


@lru_cache(maxsize=4)
def tokenizer(path: str) -> WordTokenizer:
    """One for each Python worker, which keeps it from task to task."""
    return WordTokenizer(path)


@lru_cache(maxsize=4)
def sentence_tables(path: str) -> tuple[np.ndarray, np.ndarray]:
    """For each id: whether its text ends a sentence; whether it starts a word.

    An id ends a sentence if its text ends in ``.``, ``!`` or ``?`` or holds a
    line break; it starts a word if its text starts with white space.
    """
    lib = tokenizer(path).lib
    n = lib.get_vocab_size()
    ends, starts = np.zeros(n, dtype=bool), np.zeros(n, dtype=bool)
    for text, i in lib.get_vocab().items():
        ends[i] = text.endswith((".", "!", "?")) or "Ċ" in text
        starts[i] = text[:1] in ("Ġ", "Ċ", "č")
    return ends, starts


def public_path(name: str) -> str:
    """The place of a public tokenizer's file on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)
