"""Byte-pair encoding and decoding by contiguous rank arrays.

A word is a row of parts, at first its bytes. The row holds where each part
begins, its id, and the rank of the merge of each two neighbours. The least
rank is searched by a scan, the boundary between its two parts is deleted, what
follows moves up by one, and the ranks on both sides of the new part are looked
up again, until no two neighbours merge. Rows are so short that the scan beats
any queue; words of one batch are rows of one matrix, which numpy scans at once.
Words above ``SHORT`` bytes keep their boundaries in linked lists and their ranks
in a heap, so that a word of a megabyte takes no quadratic time; the merges and
their order (least rank, then leftmost) are the same.

Of the tokenizers library only the file's normaliser and the cut into words are
used, for words that are not plain Latin letters. Merges and decoding are here.

Scale: texts are encoded where they are read, without a shuffle. A Python worker
keeps the ids of words that it has seen, up to a number.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import os
import re
from array import array
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from .common import map_batches, read, rows
from .tokens import _LETTERS, _ODD, _WITH_SPACE, _WITHOUT_SPACE, _byte_letters, public_path

#: Words up to so many bytes are rows of a matrix.
SHORT = 64
_NONE = np.int32(2**31 - 1)
is_plain = re.compile(rf" ?{_LETTERS}").fullmatch


class RankCodec:
    """Ids of a tokenizers file (byte-level BPE, with or without a suffix at word ends) and back.

    Encodes as the library's ``encode(text, add_special_tokens=False)``: strings of
    special tokens in a text are these tokens. A null text has no ids.
    """

    def __init__(self, path: str, capacity: int = 400_000) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, self.byte_decoder = spec["model"], (spec.get("decoder") or {}).get("type") == "ByteLevel"
        if model["type"] != "BPE" or model.get("continuing_subword_prefix") or model.get("ignore_merges"):
            raise ValueError("not a byte-level BPE file")
        lib = Tokenizer.from_file(path)
        self.normalizer, self.cutter = lib.normalizer, lib.pre_tokenizer
        vocab, suffix, letters = model["vocab"], model.get("end_of_word_suffix") or "", _byte_letters()
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens") or []}
        self.split_special = re.compile("(" + "|".join(map(re.escape, self.special)) + ")").split if self.special else None
        self.cut = (_WITH_SPACE if self.normalizer is None else _WITHOUT_SPACE).findall
        self.letter_bytes = {ord(c): b for b, c in letters.items()}
        self.inner = np.array([vocab[letters[b]] for b in range(256)], dtype=np.int32)
        self.last = np.array([vocab[letters[b] + suffix] for b in range(256)], dtype=np.int32)
        text = {i: t for t, i in vocab.items()} | {i: t for t, i in self.special.items()}
        self.pad = max(text) + 1  # merges with nothing
        self.text = [text.get(i) for i in range(self.pad)]
        if self.byte_decoder:
            self.bytes = [None if t is None else t.encode() if t in self.special else bytes(self.letter_bytes[ord(c)] for c in t) for t in self.text]
        else:
            self.bytes = [None if t is None else t.encode() for t in self.text]
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        keys = np.array([vocab[a] * (self.pad + 1) + vocab[b] for a, b in pairs], dtype=np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks = keys[order], order.astype(np.int32)
        self.made = np.array([vocab[a + b] for a, b in pairs] + [0], dtype=np.int32)
        self.capacity, self.kept = capacity, {}

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of the merge of neighbours ``a`` and ``b``."""
        keys = a.astype(np.int64) * (self.pad + 1) + b
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, self.ranks[at], _NONE)

    def _short(self, words: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids and first bytes of the parts of all words (of at most ``width`` bytes) in order, and the parts of each."""
        n = np.array([len(w) for w in words])
        cols, size = np.arange(width), n.copy()
        raw = np.frombuffer(b"".join(w.ljust(width, b"\0") for w in words), dtype=np.uint8).reshape(-1, width)
        parts = np.where(cols < n[:, None], self.inner[raw], self.pad).astype(np.int32)
        every = np.arange(len(words))
        parts[every, n - 1] = self.last[raw[every, n - 1]]
        starts = np.broadcast_to(cols.astype(np.int32), parts.shape).copy()
        ends, begins, live = parts.copy(), starts.copy(), every
        ranks = np.concatenate([self.rank(parts[:, :-1], parts[:, 1:]), np.full((len(words), 1), _NONE)], axis=1)
        while True:
            at = ranks.argmin(axis=1)
            row = np.arange(len(at))
            best = ranks[row, at]
            done = best == _NONE
            if done.any():
                ends[live[done]], begins[live[done]] = parts[done], starts[done]
                keep = ~done
                live, parts, starts, ranks, at, best = (x[keep] for x in (live, parts, starts, ranks, at, best))
                row = np.arange(len(at))
            if not len(at):
                break
            parts[row, at] = self.made[best]
            # the boundary after ``at`` goes, what follows moves up
            source = np.minimum(cols + (cols > at[:, None]), width - 1)
            parts, starts, ranks = (np.take_along_axis(x, source, axis=1) for x in (parts, starts, ranks))
            parts[:, -1], ranks[:, -1] = self.pad, _NONE
            size[live] -= 1
            here = parts[row, at]
            after = parts[row, np.minimum(at + 1, width - 1)]
            ranks[row, at] = np.where(at + 1 < width, self.rank(here, after), _NONE)
            left = at > 0
            ranks[row[left], at[left] - 1] = self.rank(parts[row[left], at[left] - 1], here[left])
        used = cols < size[:, None]
        return ends[used], begins[used], size

    def _long(self, word: bytes) -> tuple[np.ndarray, np.ndarray, list[int]]:
        raw = np.frombuffer(word, dtype=np.uint8)
        first = self.inner[raw]
        first[-1] = self.last[raw[-1]]
        n, ids = len(raw), first.tolist()
        table = self.pair_table
        after, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), bytearray(b"\1" * n)
        heap = [(rank, k, ids[k], ids[k + 1]) for k, rank in enumerate(self.rank(first[:-1], first[1:]).tolist()) if rank != _NONE]
        heapq.heapify(heap)
        while heap:
            rank, k, a, b = heapq.heappop(heap)
            m = after[k]
            if not alive[k] or ids[k] != a or m == n or ids[m] != b:
                continue  # one of the two has merged since
            ids[k], alive[m], after[k] = int(self.made[rank]), 0, after[m]
            if after[m] < n:
                before[after[m]] = k
            for left in (before[k], k):
                if left >= 0 and after[left] < n and (found := table.get((ids[left], ids[after[left]]))) is not None:
                    heapq.heappush(heap, (found, left, ids[left], ids[after[left]]))
        left = [k for k in range(n) if alive[k]]
        return np.array([ids[k] for k in left], dtype=np.int32), np.array(left, dtype=np.int32), [len(left)]

    @property
    def pair_table(self) -> dict[tuple[int, int], int]:
        if not hasattr(self, "_pairs"):
            a, b = np.divmod(self.keys, self.pad + 1)
            self._pairs = dict(zip(zip(a.tolist(), b.tolist(), strict=True), self.ranks.tolist(), strict=True))
        return self._pairs

    def merge(self, words: list[bytes], spans: bool = False) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each word (its bytes, not empty), or with ``spans`` where its parts begin."""
        out = [b""] * len(words)
        classes: dict[int, list[int]] = {}
        for k, w in enumerate(words):
            classes.setdefault(0 if len(w) > SHORT else max(2, 1 << (len(w) - 1).bit_length()), []).append(k)
        for width, which in classes.items():
            step = 16_384 if width else 1
            for k in range(0, len(which), step):
                some = which[k : k + step]
                ids, starts, size = self._short([words[i] for i in some], width) if width else self._long(words[some[0]])
                flat = (starts if spans else ids).astype("<u4").tobytes()
                at = 0
                for i, end in zip(some, (4 * np.cumsum(size)).tolist(), strict=True):
                    out[i] = flat[at:end]
                    at = end
        return out

    def _words(self, cut: str) -> list[bytes]:
        """The words of a cut, as the file's normaliser and pattern make them."""
        plain = cut if self.normalizer is None else self.normalizer.normalize_str(cut)
        return [bytes(map(self.letter_bytes.__getitem__, map(ord, piece))) for piece, _ in self.cutter.pre_tokenize_str(plain)]

    def _cuts(self, text: str | None) -> list[str | int]:
        """Cuts of a text across which nothing merges or composes; special tokens as ids."""
        if not text:
            return []
        if self.split_special is None or "<" not in text:
            return [text] if _ODD.search(text) else self.cut(text)
        out: list[str | int] = []
        for k, part in enumerate(self.split_special(text)):
            if k % 2:
                out.append(self.special[part])
            elif part:
                out += [part] if _ODD.search(part) else self.cut(part)
        return out

    def encode_batch(self, texts: Iterable[str | None]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        cuts = [self._cuts(t) for t in texts]
        wanted: set[str | int] = set().union(*cuts)
        kept = self.kept
        new = wanted.difference(kept)
        if len(kept) + len(new) > self.capacity:
            kept, new = {}, wanted
            self.kept = kept
        plain, other = [], []
        for c in new:
            if isinstance(c, int):
                kept[c] = array("I", [c]).tobytes()
            else:
                (plain if is_plain(c) else other).append(c)
        if plain:  # runs of letters are words as they are
            joined = "\n".join(plain)
            kept.update(zip(plain, self.merge((joined if self.normalizer is None else joined.lower()).encode().split(b"\n")), strict=True))
        words = [self._words(c) for c in other]
        distinct = list(set().union(*words))
        ids = dict(zip(distinct, self.merge(distinct), strict=True))
        for c, parts in zip(other, words, strict=True):
            kept[c] = b"".join(map(ids.__getitem__, parts))
        out = [b"".join(map(kept.__getitem__, c)) for c in cuts]
        for c in new:
            if not isinstance(c, int) and len(c) > SHORT:
                del kept[c]
        if len(kept) > self.capacity:
            self.kept = {}
        return out

    def encode(self, text: str | None) -> list[int]:
        return np.frombuffer(self.encode_batch([text])[0], dtype="<u4").tolist()

    def decode_bytes(self, ids: Iterable[int], skip_special_tokens: bool = False) -> bytes:
        """The text of ``ids`` in UTF-8. Ids out of the vocabulary give nothing."""
        known, skip = self.bytes, set(self.special.values()) if skip_special_tokens else ()
        try:
            parts = list(map(known.__getitem__, ids)) if not skip else [known[i] for i in ids if i not in skip]
        except IndexError:
            parts = [known[i] for i in ids if i < self.pad and i not in skip]
        if None in parts:
            parts = [p for p in parts if p is not None]
        return b"".join(parts).decode("utf-8", "replace").encode() if self.byte_decoder else b" ".join(parts)

    def decode(self, ids: Iterable[int], skip_special_tokens: bool = False) -> str:
        return self.decode_bytes(ids, skip_special_tokens).decode()


@lru_cache(maxsize=2)
def codec(path: str) -> RankCodec:
    """One for each Python worker, which keeps it from task to task."""
    return RankCodec(path)


def encode(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, ids (array<int>) of every row of ``docs`` (doc_id, text).

    A null or empty text has no ids. Repeated and null doc_ids are rows of their
    own; other columns are left out.
    """

    def run(batches: Iterator) -> Iterator[dict]:
        tok = codec(path)
        for batch in rows(batches, 256):
            yield {"doc_id": batch["doc_id"], "ids": [np.frombuffer(x, dtype="<u4") for x in tok.encode_batch(batch["text"].to_pylist())]}

    return map_batches(docs.select("doc_id", "text"), run, f"doc_id {dict(docs.dtypes)['doc_id']}, ids array<int>")


def decode(encoded: DataFrame, path: str, skip_special_tokens: bool = False) -> DataFrame:
    """doc_id, text of every row of ``encoded`` (doc_id, ids); null ids give an empty text."""

    def run(batches: Iterator) -> Iterator[dict]:
        tok = codec(path)
        for batch in rows(batches, 256):
            yield {"doc_id": batch["doc_id"], "text": [tok.decode(x or (), skip_special_tokens) for x in batch["ids"].to_pylist()]}

    return map_batches(encoded.select("doc_id", "ids"), run, f"doc_id {dict(encoded.dtypes)['doc_id']}, text string")


def digests(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: each text encoded, and its ids decoded, in one pass.

    The first digest is of the decimal ids joined by a space, the second of the
    decoded text in UTF-8, both in lowercase hex. Rows as in ``encode``.
    """

    def run(batches: Iterator) -> Iterator[dict]:
        tok = codec(path)
        decimal = [b"%d" % i for i in range(tok.pad)]
        sha = lambda x: hashlib.sha256(x).hexdigest()
        for batch in rows(batches, 256):
            found = [array("I", x) for x in tok.encode_batch(batch["text"].to_pylist())]
            yield {
                "doc_id": batch["doc_id"],
                "n_tokens": [len(x) for x in found],
                "ids_sha256": [sha(b" ".join(map(decimal.__getitem__, x))) for x in found],
                "decoded_sha256": [sha(tok.decode_bytes(x)) for x in found],
            }

    return map_batches(docs.select("doc_id", "text"), run, f"doc_id {dict(docs.dtypes)['doc_id']}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op13_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's ids and their text again, as digests."""
    return digests(read(spark, sf_dir, "documents"), public_path("word_bpe_49k.json"))
