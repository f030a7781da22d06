"""Language-model scoring by online logistic context mixing.

A text is its words (A-Z lower-cased, runs without ASCII white space) and one
end. A token is coded by binary decisions all the way:

* match: is it the word that followed the previous word's last occurrence here?
* seen: did it occur in this text before? Then it is chosen by its
  count so far and, as ``PRIOR`` tokens would, by its training frequency.
* told: is it the new word that most often follows the previous two in the corpus?
* rare: is it outside the frequent training words? Then it is chosen by its
  add-one frequency among rare words.
* else the first ``PATH - 2`` bits of its code, a Huffman code over the frequent
  words; what words share them is chosen by frequency.

Each bit is predicted in several hashed contexts: ``told`` by the counts that
follow the previous two words, ``seen``, ``rare`` and the code's bits by the
counts that follow the previous word (or, where that is rare, the last of the
``COMMON`` most frequent words), code bits also by the prefix alone and by the
text's own words under it, decisions by the text's own history. Predictions
are mixed in the logistic domain by weights that a gate selects; the weights
are refined by a gradient step after a text's first 32, 64, 128 and 256 bits and
after every ``BLOCK`` bits (``block_end``), and a
decision's mixed prediction by how often such predictions held so far. Branches of a bit
sum to 1 and choices to at most 1, so the score is a log probability.

Corpus counts come from the training texts. A training text's own tokens would
predict themselves, so each token is left out of the counts it is scored with.

Scale: word counts are partial sums over all training tokens. Frequent words
are those above a count that a histogram gives, ``vocabulary`` at most; they are
the only thing sent to every task. Everything else grows with the corpus: texts
are dealt into batches, a batch sums its rare words and contexts (a hot one is
there once a batch), these are dealt by key into buckets whose number grows with
the tokens, summed there over all batches, and what a batch asked for goes back
to it. A batch sends one row to each bucket while there are 2 ** ``ONE_HOP`` at
most. With more, rows would shrink to a few keys each; then a batch sends one row
to each group of buckets (about the square root of their number), and a block of
batches sends what they have for a bucket as one row, both ways. Rare words have 64-bit names (a billion of them share one in 0.03 pairs).
Contexts are hashed to 26 bits and the bucket's, 44 at most: under 1 % share a
slot, which blurs a prediction and harms nothing else. Words after two others are told
apart by 38 bits.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bucketed, forget, id_text, map_batches, materialize, read, rows

END = b"\n"  # no word holds white space
BATCH = 1 << 18  # tokens of a batch; more if one text has more
BUCKET = 1 << 21  # tokens for each bucket of contexts
ONE_HOP = 12  # up to 2 ** this many buckets, batches send to them directly
TASK = 1 << 24  # tokens that a scoring task takes, about
COMMON = 64
PRIOR = 300.0
PATH = 10  # decisions and code bits that the previous word's counts cover
CODED = PATH - 2
OWN = 5  # code bits for which the text's own words are counted
INNER, NAME = 26, 38  # bits of a context in its bucket, and of a word after two others
INPUTS, GATES, KINDS, BINS = 3, 24, 4, 16  # kinds of decisions; code bits are one more
FIRST, BLOCK, RATE, HOLD = 32, 512, 0.02, 24.0
#: Weights at the start of a text: decisions; code bits (prefix, then what contexts add to it).
START, START_CODE = (0.4, 0.4, 0.4), (1.0, 0.8, 0.3)
DECISIONS, FIRST_CODE = 12, 12  # gates of decisions come first


def tokens_of(text: str | None) -> list[bytes]:
    words = (text or "").encode("utf-8", "replace").lower().split()
    words.append(END)
    return words


def code_sizes(weights: list[float]) -> list[int]:
    """Lengths of a Huffman code; a single word has the empty code."""
    heap = [(w, k) for k, w in enumerate(weights)]
    heapq.heapify(heap)
    up, n = {}, len(weights)
    while len(heap) > 1:
        (a, i), (b, j) = heapq.heappop(heap), heapq.heappop(heap)
        up[i] = up[j] = n
        heapq.heappush(heap, (a + b, n))
        n += 1
    depth = {n - 1: 0}
    for node in range(n - 2, -1, -1):
        depth[node] = depth[up[node]] + 1
    return [depth[k] for k in range(len(weights))]


class Lexicon:
    """The frequent words, most frequent first, with counts, codes and names."""

    def __init__(self, words: list[bytes], counts: np.ndarray, floor: float) -> None:
        self.index = {w: k for k, w in enumerate(words)}
        self.names = np.fromiter(map(xxhash.xxh3_64_intdigest, words), dtype=np.uint64, count=len(words))
        self.chance = (counts + 1.0) / floor  # add-one probability
        self.size = np.array(code_sizes(self.chance.tolist()), dtype=np.int64) if words else np.zeros(0, dtype=np.int64)
        self.most = int(self.size.max(initial=0))
        order, code, last = np.argsort(self.size, kind="stable"), 0, 0
        self.code = np.zeros(len(words), dtype=np.int64)  # left-aligned in ``most`` bits
        for k in order.tolist():
            code <<= int(self.size[k]) - last
            last = int(self.size[k])
            self.code[k] = code << (self.most - last)
            code += 1
        # probability of each node on the word's path
        self.mass = np.empty((self.most + 1, len(words)))
        for d in range(self.most + 1):
            _, node = np.unique(self.code >> (self.most - d), return_inverse=True)
            self.mass[d] = np.bincount(node, self.chance)[node] if len(words) else 0.0

    def path(self, word: np.ndarray) -> np.ndarray:
        """Not seen, not rare and the first bits of the code, left-aligned in PATH bits."""
        keep = PATH - 2
        return self.code[word] >> (self.most - keep) if self.most >= keep else self.code[word] << (keep - self.most)


def _scatter(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _in_order(*parts: tuple[np.ndarray, int]) -> np.ndarray:
    """Order by several numbers (each with a bound), ties by place."""
    key = np.zeros(len(parts[0][0]), dtype=np.int64)
    for x, bound in parts:
        key = key * bound + x
    most, at = math.prod(b for _, b in parts), len(key).bit_length()
    if most <= 1 << 16:
        return np.argsort(key.astype(np.uint16), kind="stable")
    if most.bit_length() + at > 63:
        return np.argsort(key, kind="stable")
    return np.sort((key << at) | np.arange(len(key))) & ((1 << at) - 1)


def _before(order: np.ndarray, new: np.ndarray, value: np.ndarray) -> np.ndarray:
    """Sum of ``value`` over earlier members of each group; ``order`` lines groups up, ``new`` marks where they begin."""
    v = value[order]
    total = np.cumsum(v) - v
    first = np.maximum.accumulate(np.where(new, np.arange(len(v)), 0))
    out = np.empty(len(v))
    out[order] = total - total[first]
    return out


class Batch:
    """Tokens of a batch of texts, what is decided at each, and its keys."""

    def __init__(self, sizes: np.ndarray, word: np.ndarray, names: np.ndarray, lexicon: Lexicon, bits: int) -> None:
        """``word`` numbers frequent words as the lexicon does, rare ones after them; ``names`` are the rare words' own."""
        self.lexicon = lexicon
        n, rare = len(word), len(lexicon.index)
        self.n, self.sizes = n, sizes
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.text = np.repeat(np.arange(len(sizes)), self.sizes)
        self.place = np.arange(n) - self.starts[self.text]
        self.word = word
        self.names = np.concatenate([lexicon.names, names, np.zeros(1, dtype=np.uint64)])  # the last stands for no word
        self.is_rare = word >= rare

        width = max(int(word.max(initial=0)).bit_length(), 1)
        at = n.bit_length()
        if len(sizes).bit_length() + width + at <= 63:
            key = np.sort((((self.text << width) | word) << at) | np.arange(n))
            order, group = key & ((1 << at) - 1), key >> at
        else:
            order = np.lexsort((word, self.text))
            group = (self.text[order] << width) | word[order]
        same = np.zeros(n, dtype=bool)
        same[1:] = group[1:] == group[:-1]
        run = np.arange(n)
        self.earlier, last = np.empty(n, dtype=np.int64), np.full(n, -1)
        self.earlier[order] = run - np.maximum.accumulate(np.where(same, 0, run))
        last[order[1:][same[1:]]] = order[:-1][same[1:]]
        self.seen = self.earlier > 0

        before = self.back(last, 1, -1)
        guess = np.where(before >= 0, word[np.minimum(before + 1, n - 1)], -1)
        self.guess, self.met = guess, np.where(before >= 0, self.back(self.earlier, 1), 0)
        self.has_match = guess >= 0
        self.match = self.has_match & (guess == word)
        self.open = np.flatnonzero(~self.match)  # tokens that are decided further

        one = self.back(word, 1, -1)[self.open]
        fresh = ~self.seen[self.open]
        self.new = self.open[fresh]  # words that the text has not had
        common = np.maximum.accumulate(np.where((word < COMMON) & (word < rare), run, -1))
        common = self.back(common, 1, -1)[self.open]
        near = np.where((one >= 0) & (one < rare), one, np.where(common >= self.starts[self.text[self.open]], rare + word[np.maximum(common, 0)], -1))
        shift = np.uint64(64 - bits)
        # the words after two others
        two_words = _scatter(self.names[one[fresh]] + _scatter(self.names[self.back(word, 2, -1)[self.new]] + np.uint64(1))) >> shift
        pair = (two_words << np.uint64(width)) | word[self.new].astype(np.uint64)
        self.pair_key, self.pair = np.unique(pair, return_inverse=True)
        context = self.pair_key >> np.uint64(width)
        self.pair_context = context
        new = np.ones(len(context), dtype=bool)
        new[1:] = context[1:] != context[:-1]
        self.pair_new = new
        self.pair_word = (self.pair_key & np.uint64((1 << width) - 1)).astype(np.int64)
        # the path of each token after the previous word
        word_ = word[self.open]
        step = np.full(len(word_), 1 << (PATH - 1))
        step[fresh & self.is_rare[self.open]] = 1 << (PATH - 2)
        frequent = fresh & ~self.is_rare[self.open]
        step[frequent] = lexicon.path(word_[frequent])
        one_word = _scatter((near + 2).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> shift
        self.path_key, self.path = np.unique((one_word << np.uint64(PATH)) | step.astype(np.uint64), return_inverse=True)

    @staticmethod
    def of(row: dict, lexicon: Lexicon, bits: int) -> Batch:
        """From a row of ``dealt``."""
        word = np.frombuffer(row["words"], "<u2").astype(np.int64)
        word[word == len(lexicon.index)] += np.frombuffer(row["odd"], "<u4")
        return Batch(np.array(row["sizes"], dtype=np.int64), word, np.frombuffer(row["names"], "<u8"), lexicon, bits)

    def back(self, x: np.ndarray, k: int, fill: int = 0) -> np.ndarray:
        out = np.full(self.n, fill, dtype=np.int64)
        if self.n > k:
            out[k:] = x[:-k]
        out[self.place < k] = fill
        return out


def packed(counts: np.ndarray) -> bytes:
    """Bytes of counts: one each, and after them eight for each count of 255 or more."""
    return np.minimum(counts, 255).astype("u1").tobytes() + counts[counts >= 255].astype("<i8").tobytes()


def unpacked(raw: bytes, n: int) -> np.ndarray:
    counts = np.frombuffer(raw, "u1", n).astype(np.int64)
    counts[counts == 255] = np.frombuffer(raw, "<i8", offset=n)
    return counts


#: Counts that only predict are sent in a byte: exact to 127, then in steps of a twelfth of an octave, to 200,000, as more predicts no better.
LEVELS = np.concatenate([np.arange(128), 128 * 2 ** (np.arange(1, 129) / 12)])


def levels(counts: np.ndarray) -> np.ndarray:
    return (np.searchsorted(LEVELS, counts, side="right") - 1).astype("u1")


def _bytes_of(x: np.ndarray, n: int) -> np.ndarray:
    return np.ascontiguousarray(x.astype("<u8").view("u1").reshape(-1, 8)[:, :n])


def _planes(table: np.ndarray) -> bytes:
    """Rows of bytes, column by column, compressed."""
    return zstandard.ZstdCompressor(1).compress(np.ascontiguousarray(table.T).tobytes())


def _table(raw: bytes, width: int) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), "u1").reshape(width, -1).T


def _cuts(bucket: np.ndarray, buckets: int) -> list[int]:
    return np.searchsorted(bucket, np.arange(buckets + 1)).tolist()


class Asked:
    """A batch's keys by bucket: rare words (the rest of the name), words after two others (8 bytes: context, and
    a frequent word's number or a rare one's name), paths after the previous word (5 bytes: context, path).

    A row goes to each of 2 ** ``first`` groups of buckets; where that is not a row for each of the 2 ** ``power``
    buckets, two bytes more say which of its group's buckets a key is for (its distance from the key before).
    """

    def __init__(self, b: Batch, power: int, bits: int, first: int | None = None) -> None:
        first = power if first is None else first
        inner = np.uint64(bits - power)
        names = b.names[len(b.lexicon.index) : -1]
        self.word_order = np.argsort(names)
        names = names[self.word_order]
        rest = np.uint64((1 << (64 - power)) - 1)
        low = np.uint64((1 << int(inner)) - 1)
        context, path = b.pair_context, b.path_key >> np.uint64(PATH)
        frequent = b.pair_word < len(b.lexicon.index)
        called = np.where(frequent, b.pair_word.astype(np.uint64), (b.names[b.pair_word] & np.uint64((1 << NAME) - 1)) | np.uint64(1 << NAME - 1))
        pair = ((context & low) << np.uint64(NAME)) | called
        step = ((path & low) << np.uint64(PATH)) | (b.path_key & np.uint64((1 << PATH) - 1))
        self.keys = [_bytes_of(names & rest, 7), _bytes_of(pair, 8), _bytes_of(step, 5)]
        buckets = [names >> np.uint64(64 - power), context >> inner, path >> inner]
        second = power - first
        self.cuts = [_cuts(x >> np.uint64(second), 1 << first) for x in buckets]
        self.to = [x & np.uint64((1 << second) - 1) for x in buckets] if second else None

    def columns(self, b: Batch, learn: np.ndarray) -> dict[str, list]:
        """The keys with how often the batch's training texts have them."""
        learned = learn[b.text]
        odd = b.word[learned & b.is_rare] - len(b.lexicon.index)
        open_ = learned[b.open]
        counts = [np.bincount(odd, minlength=len(self.word_order))[self.word_order], np.bincount(b.pair[learned[b.new]], minlength=len(b.pair_key)), np.bincount(b.path[open_], minlength=len(b.path_key))]
        used = [k for k in range(len(self.cuts[0]) - 1) if any(c[k] < c[k + 1] for c in self.cuts)]
        out: dict[str, list] = {"bucket": used}
        for kind, (name, keys, cut, n) in enumerate(zip(WIDTHS, self.keys, self.cuts, counts, strict=True)):
            parts = [keys[cut[k] : cut[k + 1]] for k in used]
            if self.to:
                steps = [np.diff(self.to[kind][cut[k] : cut[k + 1]], prepend=np.uint64(0)) for k in used]
                parts = [np.hstack([x, _bytes_of(step, 2)]) for x, step in zip(parts, steps, strict=True)]
            out[name] = [_planes(x) for x in parts]
            out[name + "_n"] = [zstandard.compress(packed(n[cut[k] : cut[k + 1]]), 1) for k in used]
        return out


#: Bytes of a key of each kind.
WIDTHS = {"words": 7, "pairs": 8, "paths": 5}


def _squeezed(counts: np.ndarray) -> bytes:
    return zstandard.compress(packed(counts), 1)


def _loose(raw: bytes, n: int) -> np.ndarray:
    return unpacked(zstandard.decompress(raw), n)


def bundled(table: pa.Table, second: int) -> pa.Table:
    """What a block of batches has for a group of buckets, as a row for each bucket.

    Keys stand batch by batch; ``words_k`` and so on say how many each batch has.
    The row of the group's first bucket is always there and names the batches.
    """
    table = table.sort_by("batch")
    group, m = table["bucket"][0].as_py(), table.num_rows
    columns: dict[str, list] = {}
    used = np.zeros(1 << second, dtype=bool)
    used[0] = True
    kinds = []
    for name, width in WIDTHS.items():
        raw = [_table(x, width + 2) for x in table[name].to_pylist()]
        sizes = np.array([len(x) for x in raw])
        counts = np.concatenate([_loose(c, n) for c, n in zip(table[name + "_n"].to_pylist(), sizes.tolist(), strict=True)])
        keys = np.concatenate(raw)
        to = np.concatenate([np.cumsum(np.ascontiguousarray(x[:, width:]).view("<u2").ravel(), dtype=np.int64) for x in raw])
        order = np.argsort(to, kind="stable")  # by bucket, then batch
        to = to[order]
        used[to] = True
        kinds.append((name, keys[order, :width], counts[order], np.repeat(np.arange(m), sizes)[order], to))
    at = np.flatnonzero(used)
    for name, keys, counts, member, to in kinds:
        spans = list(zip(np.searchsorted(to, at).tolist(), np.searchsorted(to, at, side="right").tolist(), strict=True))
        columns[name] = [_planes(keys[i:j]) for i, j in spans]
        columns[name + "_n"] = [_squeezed(counts[i:j]) for i, j in spans]
        columns[name + "_k"] = [_squeezed(np.bincount(member[i:j], minlength=m)) for i, j in spans]
    columns["members"] = [table["batch"].to_numpy().astype("<i8").tobytes()] + [b""] * (len(at) - 1)
    columns |= {"block": [table["block"][0].as_py()] * len(at), "n_members": [m] * len(at), "bucket": ((group << second) | at).tolist()}
    return _as(columns, BUNDLE)


def unbundled(table: pa.Table, second: int) -> pa.Table:
    """A block's answers from a group of buckets as a row for each of its batches, keys in the order of ``Asked``."""
    table = table.sort_by("bucket")
    members = np.frombuffer(table["members"][0].as_py(), "<i8")
    m = len(members)
    out: dict[str, list] = {"batch": members.tolist(), "bucket": [table["bucket"][0].as_py() >> second] * m}
    for name, sizes_of, width in (("words", "words_k", 0), ("told", "told_k", TOLD.itemsize), ("steps", "paths_k", PATH + 1)):
        sizes = [_loose(x, m) for x in table[sizes_of].to_pylist()]
        each = np.concatenate([np.repeat(np.arange(m), x) for x in sizes])
        order = np.argsort(each, kind="stable")  # by batch, then bucket
        raw = table[name].to_pylist()
        values = np.concatenate([_table(x, width) if width else unpacked(x, int(n.sum())) for x, n in zip(raw, sizes, strict=True)])[order]
        parts = np.split(values, np.cumsum(np.bincount(each, minlength=m))[:-1])
        out[name] = [_planes(x) if width else packed(x) for x in parts]
    return _as(out, BACK)


def _joined(table: pa.Table, name: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys and counts of a bucket's rows, and how many each batch has."""
    width = WIDTHS[name]
    raw = [_table(x, width) for x in table[name].to_pylist()]
    sizes = np.array([len(x) for x in raw])
    counts = [_loose(c, n) for c, n in zip(table[name + "_n"].to_pylist(), sizes.tolist(), strict=True)]
    if name + "_k" in table.column_names:  # rows of several batches
        sizes = np.concatenate([_loose(x, m) for x, m in zip(table[name + "_k"].to_pylist(), table["n_members"].to_pylist(), strict=True)])
    key = np.zeros((sum(map(len, raw)), 8), dtype="u1")
    key[:, :width] = np.concatenate(raw)
    return key.view("<u8").ravel(), np.concatenate(counts), sizes


def _parts(rows_: np.ndarray, sizes: np.ndarray) -> list[np.ndarray]:
    """``rows_`` cut into parts of these sizes."""
    return np.split(rows_, np.cumsum(sizes)[:-1])


TOLD = np.dtype([(name, "u1") for name in ("first", "second", "n1", "n2", "more", "ahead")])


def _told(key: np.ndarray, counts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each batch's contexts the two words that most often follow, and how many contexts each batch has.

    A word is given as its number among those the batch asked for (255: none of
    them, or beyond); ``ahead`` says that the first would come before the second
    if they had equal counts.
    """
    distinct, number = np.unique(key, return_inverse=True)
    sums = np.bincount(number, counts, len(distinct)).astype(np.int64)
    context = distinct >> np.uint64(NAME)
    begin = np.flatnonzero(np.append(True, context[1:] != context[:-1])) if len(context) else np.zeros(0, dtype=np.int64)
    group = np.repeat(np.arange(len(begin)), np.diff(np.append(begin, len(context))))
    total = np.add.reduceat(sums, begin) if len(begin) else sums
    rank, left = [], sums.copy()
    for _ in range(2):  # most first, then the least name
        most = np.maximum.reduceat(left, begin) if len(begin) else left
        hit = np.flatnonzero(left == most[group])
        best = hit[np.append(True, group[hit][1:] != group[hit][:-1])] if len(hit) else hit
        rank.append((best, np.maximum(most, 0)))
        left[best] = -1
    # contexts of each batch, in its order
    batch = np.repeat(np.arange(len(sizes)), sizes)
    own = key >> np.uint64(NAME)
    new = np.append(True, (own[1:] != own[:-1]) | (batch[1:] != batch[:-1])) if len(own) else np.zeros(0, dtype=bool)
    at = np.cumsum(new) - 1
    first = np.flatnonzero(new)
    of = group[number[first]] if len(first) else first
    out = np.zeros((len(first), TOLD.itemsize), dtype="u1")
    told = out.view(TOLD).ravel()
    for name, n, (best, most) in (("first", "n1", rank[0]), ("second", "n2", rank[1])):
        told[name] = 255
        mine = np.flatnonzero(number == best[group[number]]) if len(number) else number
        told[name][at[mine]] = np.minimum(mine - first[at[mine]], 255)
        told[n] = levels(most)[of]
    told["more"] = levels(total - rank[0][1] - rank[1][1])[of]
    told["ahead"] = (rank[0][0] < rank[1][0])[of]
    out[told["n1"] == 0] = 0
    return out, np.bincount(batch[first], minlength=len(sizes))


def _steps(key: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """For each key of each batch: counts that leave its path at each bit, and its own."""
    distinct, number = np.unique(key, return_inverse=True)
    sums = np.bincount(number, counts, len(distinct))
    total = np.append(0.0, np.cumsum(sums))
    out = np.empty((len(distinct), PATH + 1), dtype="u1")
    under = None
    for d in range(PATH + 1):
        node = distinct >> np.uint64(PATH - d)
        begin = np.flatnonzero(np.append(True, node[1:] != node[:-1])) if len(node) else np.zeros(0, dtype=np.int64)
        ends = np.append(begin[1:], len(node))
        n = np.repeat(total[ends] - total[begin], ends - begin)
        if d:
            out[:, d - 1] = levels(under - n)
        under = n
    out[:, PATH] = levels(under) if len(distinct) else 0
    return out[number]


FORWARD = "batch long, bucket long, words binary, words_n binary, pairs binary, pairs_n binary, paths binary, paths_n binary"
BACK = "batch long, bucket long, words binary, told binary, steps binary"
#: The same between blocks of batches and buckets.
BUNDLE = "block long, n_members long, members binary, bucket long, words binary, words_n binary, words_k binary, pairs binary, pairs_n binary, pairs_k binary, paths binary, paths_n binary, paths_k binary"
BUNDLE_BACK = "block long, members binary, bucket long, words binary, words_k binary, told binary, told_k binary, steps binary, paths_k binary"


def _as(columns: dict[str, list], schema: str) -> pa.Table:
    fields = [f.split() for f in schema.split(", ")]
    return pa.table({name: pa.array(columns[name], pa.int64() if kind == "long" else pa.binary()) for name, kind in fields})


def answered(table: pa.Table) -> pa.Table:
    """A bucket's rows of ``FORWARD`` as rows of ``BACK``, or of ``BUNDLE`` as of ``BUNDLE_BACK``: sums over all batches."""
    together = "n_members" in table.column_names
    ends = np.cumsum(table["n_members"].to_numpy() if together else np.ones(table.num_rows, dtype=np.int64))

    def of_rows(sizes: np.ndarray) -> np.ndarray:
        """Sums of batches' sizes for each row."""
        return np.diff(np.append(0, np.append(0, np.cumsum(sizes))[ends]))

    key, counts, sizes = _joined(table, "words")
    distinct, number = np.unique(key, return_inverse=True)
    sums = np.bincount(number, counts, len(distinct)).astype(np.int64)[number]
    found = {"bucket": table["bucket"].to_pylist(), "words": [packed(x) for x in _parts(sums, of_rows(sizes))]}
    told, contexts = _told(*_joined(table, "pairs"))
    found["told"] = [_planes(x) for x in _parts(told, of_rows(contexts))]
    key, counts, sizes = _joined(table, "paths")
    found["steps"] = [_planes(x) for x in _parts(_steps(key, counts), of_rows(sizes))]
    if not together:
        return _as(found | {"batch": table["batch"].to_pylist()}, BACK)
    found |= {k: table[k].to_pylist() for k in ("block", "members", "words_k", "paths_k")}
    found["told_k"] = [_squeezed(x) for x in np.split(contexts, ends[:-1])]
    return _as(found, BUNDLE_BACK)


def hops(power: int) -> int:
    """Bits of a batch's rows to buckets: all, or half where that would be too many rows."""
    return power if power <= ONE_HOP else -(-power // 2)


def corpus_counts(batches: DataFrame, lexicon: Lexicon, power: int, bits: int, first: int) -> DataFrame:
    """batch and found: what all training texts say to each batch's keys, by bucket.

    Keys are dealt into 2 ** ``power`` buckets, in rows for 2 ** ``first`` groups
    of them. Counts go back in the order of
    the keys (``Asked``): rare words' counts, the words told after two others
    (``TOLD``), and the counts along paths (``_steps``).
    """
    second = power - first

    def ask(given: Iterator) -> Iterator[dict]:
        for one in rows(given, 1):
            row = one.to_pylist()[0]
            b = Batch.of(row, lexicon, bits)
            out = Asked(b, power, bits, first).columns(b, np.array(row["learn"], dtype=bool))
            yield {"batch": [row["batch"]] * len(out["bucket"])} | out

    each = map_batches(batches.select("batch", "learn", "sizes", "words", "odd", "names"), ask, FORWARD)
    if not second:
        back = each.groupBy("bucket").applyInArrow(answered, BACK)
    else:
        blocks = -(-batches.count() >> first) or 1  # a block and a group have about what a batch has
        sent = each.withColumn("block", F.pmod(F.xxhash64("batch"), F.lit(blocks)))
        sent = sent.groupBy("block", "bucket").applyInArrow(lambda t: bundled(t, second), BUNDLE)
        known = sent.groupBy("bucket").applyInArrow(answered, BUNDLE_BACK)
        back = known.groupBy("block", F.shiftright("bucket", second)).applyInArrow(lambda t: unbundled(t, second), BACK)
    return materialize(back, "contexts").groupBy("batch").agg(F.collect_list(F.struct("bucket", "words", "told", "steps")).alias("found"))


@dataclass
class Found:
    """What came back to a batch, in the order of its keys."""

    words: np.ndarray  # count of each rare word
    told: np.ndarray  # a TOLD row for each context of two words
    steps: np.ndarray  # a row for each path

    @staticmethod
    def of(b: Batch, asked: Asked, found: list[dict]) -> Found:
        found = sorted(found, key=lambda x: x["bucket"])
        cut = asked.cuts[0]
        words = np.empty(len(asked.word_order), dtype=np.int64)
        parts = [unpacked(x["words"], cut[x["bucket"] + 1] - cut[x["bucket"]]) for x in found]
        words[asked.word_order] = np.concatenate(parts) if parts else 0

        def whole(name: str, width: int) -> np.ndarray:
            parts = [_table(x[name], width) for x in found]
            return np.ascontiguousarray(np.concatenate(parts)) if parts else np.zeros((0, width), dtype="u1")

        return Found(words, whole("told", TOLD.itemsize).view(TOLD).ravel(), whole("steps", PATH + 1))


def _stretch(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-5, 1 - 1e-5)
    return np.log(p / (1 - p))


class Bits:
    """A batch's bits in the order of coding, each as its predictions of what came."""

    def __init__(self, b: Batch, found: Found, learn: np.ndarray) -> None:
        lex, n = b.lexicon, b.n
        learned = learn[b.text].astype(np.int64)
        opened = np.full(n, -1)
        opened[b.open] = np.arange(len(b.open))
        # told: the candidate of the previous two words, the token itself left out
        context = np.cumsum(b.pair_new) - 1
        begin = np.flatnonzero(b.pair_new)
        mine = np.minimum(b.pair - begin[context[b.pair]], 255) if len(begin) else b.pair
        t = found.told[context[b.pair]] if len(begin) else found.told
        n1, n2, more = (LEVELS[t[k]] for k in ("n1", "n2", "more"))
        own = learned[b.new]
        n1 = n1 - own * (t["first"] == mine) * (n1 > 0)
        n2 = n2 - own * (t["second"] == mine) * (n2 > 0)
        more = np.maximum(more - own * (t["first"] != mine) * (t["second"] != mine) * (t["n1"] > 0), 0)
        other = (n2 > n1) | ((n2 == n1) & (t["ahead"] == 0) & (n2 > 0))
        best, rest = np.where(other, n2, n1), np.where(other, n1, n2) + more
        hit = (np.where(other, t["second"], t["first"]) == mine) & (mine < 255)
        has_told = best > 0
        self.told = np.zeros(n, dtype=bool)
        self.told[b.new] = has_told & hit
        told_at = b.new[has_told]
        best, rest, hit = best[has_told], rest[has_told], hit[has_told]
        # decisions of a token, then its code bits
        seen_at, rare_at = b.open, b.new[~self.told[b.new]]
        code_at = rare_at[~b.is_rare[rare_at]]
        word = b.word[code_at]
        sizes = np.minimum(lex.size[word], CODED)
        present = np.zeros(n, dtype=np.int64)
        slot = []
        for at in (np.flatnonzero(b.has_match), seen_at, told_at, rare_at):
            slot.append((at, present[at]))
            present[at] += 1
        code_slot = present[code_at]
        present[code_at] += sizes
        offset = np.cumsum(present) - present
        total = int(present.sum())
        self.starts = offset[b.starts]
        self.sizes = np.diff(np.append(self.starts, total))
        self.x = np.zeros((INPUTS, total), dtype=np.float32)
        self.gate, self.kind = np.zeros(total, dtype=np.uint8), np.zeros(total, dtype=np.uint8)

        steps = LEVELS.astype(np.float32)[found.steps]  # a count for each bit of the path, and the leaf
        below = [steps[:, d:].sum(axis=1) for d in range(3)]
        of_path = b.path[opened[seen_at]]

        def after(depth: int, at: np.ndarray, path: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            """Counts along the path from ``depth`` on: of the branch taken, and all."""
            taken = np.maximum(below[depth + 1][path] - learned[at], 0)
            return taken, taken + below[depth][path] - below[depth + 1][path]

        def put(k: int, at: np.ndarray, slots: np.ndarray, bit: np.ndarray, small: np.ndarray | None, bound: int, given: np.ndarray | None, gates: np.ndarray) -> None:
            pos = offset[at] + slots
            text = b.text[at]
            self.x[0, pos] = self._own(text, self._past(text, bit), 16, bit)
            if small is not None:
                self.x[1, pos] = self._own(text, small, bound, bit)
            if given is not None:
                self.x[2, pos] = given
            self.kind[pos] = k
            self.gate[pos] = gates

        at, slots = slot[0]
        met = np.minimum(b.met[at], 3)
        put(0, at, slots, b.match[at], met, 4, None, (met > 1).astype(np.int64))
        at, slots = slot[1]
        age = np.minimum(np.log2(b.place[at] + 1).astype(np.int64), 15)
        taken, all_ = after(0, at, of_path)
        put(1, at, slots, b.seen[at], None, 0, _stretch((taken + 0.4) / (all_ + 0.8)), 2 + (age >= 6))
        at, slots = slot[2]
        strong = np.minimum(best, 3).astype(np.int64) - 1
        mixed = np.minimum(rest, 3).astype(np.int64)
        p = (best + 0.4) / (best + rest + 0.8)
        put(2, at, slots, hit, strong * 4 + mixed, 12, np.where(hit, 1, -1) * _stretch(p), 4 + strong * 2 + (mixed > 0))
        at, slots = slot[3]
        age = np.minimum(np.log2(b.place[at] + 1).astype(np.int64), 15)
        taken, all_ = after(1, at, b.path[opened[rare_at]])
        put(3, at, slots, b.is_rare[at], None, 0, _stretch((taken + 0.4) / (all_ + 0.8)), 10 + (age >= 6))

        # code bits: of the frequent words that the text has not had yet, by the prefix alone, the previous word and the text's own words
        by_size = np.argsort((CODED - sizes).astype(np.uint8), kind="stable")  # words with a bit j come first
        code_at, sizes, word = code_at[by_size], sizes[by_size], word[by_size]
        fresh = ~b.seen & ~b.is_rare
        met_at = np.flatnonzero(fresh)  # what the text's own counts hold
        met_word, met_text = b.word[met_at], b.text[met_at]
        met_code, met_chance, ones = lex.code[met_word], lex.chance[met_word], np.ones(len(met_at))
        among = (np.cumsum(fresh) - 1)[code_at]
        of_code = b.path[opened[code_at]]
        run, used = (np.zeros((CODED + 1, len(code_at)), dtype=np.float32) for _ in range(2))
        for d in range(min(CODED, lex.most) + 1):
            node = met_code >> (lex.most - d)
            order = _in_order((met_text, len(b.sizes)), (node, 1 << d))
            group = (met_text[order] << d) | node[order]
            new = np.append(True, group[1:] != group[:-1]) if len(group) else np.zeros(0, dtype=bool)
            used[d] = _before(order, new, met_chance)[among]
            if d <= OWN:
                run[d] = _before(order, new, ones)[among]
        own_steps = np.ascontiguousarray(steps[of_code].T)
        counts = np.empty((PATH + 1, len(code_at)), dtype=np.float32)
        counts[PATH] = np.maximum(own_steps[PATH] - learned[code_at], 0)
        for d in range(PATH - 1, -1, -1):
            counts[d] = counts[d + 1] + own_steps[d]
        base = offset[code_at] + code_slot[by_size]
        mass = lex.mass[: CODED + 1].astype(np.float32)[:, word]
        for j in range(min(CODED, lex.most)):
            m = int(np.searchsorted(-sizes, -j, side="left"))  # words with a bit j
            pos = base[:m] + j
            all_, one = mass[j, :m], mass[j + 1, :m]
            all_, one = all_ - used[j, :m], one - used[j + 1, :m]
            p = np.clip(one / np.maximum(all_, np.float32(1e-30)), np.float32(1e-5), np.float32(1 - 1e-5))
            other = 1 - p
            x = np.log(p / other)
            self.x[0, pos] = x
            if j < OWN:
                all_, one = run[j, :m], run[j + 1, :m]
                self.x[2, pos] = np.log((one + 30 * p) / (all_ - one + 30 * other)) - x
            all_, one = counts[j + 2, :m], counts[j + 3, :m]
            self.x[1, pos] = np.log((one + 3 * p) / (all_ - one + 3 * other)) - x
            gate = FIRST_CODE + 3 * (0 if j < 2 else 1 if j < 4 else 2 if j < 6 else 3) + (all_ > 0).astype(np.uint8) + (all_ > 20)
            self.kind[pos] = KINDS
            self.gate[pos] = gate
        self.code_at, self.rare_at = code_at, rare_at[b.is_rare[rare_at]]
        # what is left of a code: the word among those that share its coded bits and are new, by frequency
        left = lex.mass[np.minimum(lex.size[word], CODED), word] - used[sizes, np.arange(len(word))]
        self.code_rest = np.log(lex.chance[word] / np.maximum(left, lex.chance[word]))
        self.again_at = seen_at[b.seen[seen_at]]

    @staticmethod
    def _past(text: np.ndarray, bit: np.ndarray) -> np.ndarray:
        """The text's last four bits of this kind."""
        out = np.zeros(len(bit), dtype=np.int64)
        for k in range(1, 5):
            out[k:] += (bit[:-k] & (text[k:] == text[:-k])) << (4 - k)
        return out

    @staticmethod
    def _own(text: np.ndarray, context: np.ndarray, bound: int, bit: np.ndarray) -> np.ndarray:
        """Stretched prediction of what came by the text's own bits in the context so far."""
        if not len(bit):
            return np.zeros(0)
        order = _in_order((text, int(text[-1]) + 1), (context, bound))
        group = text[order] * bound + context[order]
        new = np.append(True, group[1:] != group[:-1])
        ones, all_ = _before(order, new, bit.astype(float)), _before(order, new, np.ones(len(bit)))
        x = np.log((ones + 0.4) / (all_ - ones + 0.4))
        return np.where(bit, x, -x)


def block_end(k: int) -> int:
    """Bits of a text up to the end of its block ``k``: 32, 64, 128, 256, 512, 1024, 1536 and so on."""
    ends = (BLOCK // FIRST).bit_length()
    return FIRST << k if k < ends else BLOCK * (k - ends + 2)


def mixed(bits: Bits) -> np.ndarray:
    """Natural log probability of each text's bits."""
    texts, total = len(bits.sizes), bits.x.shape[1]
    start = np.repeat(np.array([START, START_CODE], dtype=np.float32), [DECISIONS, GATES - DECISIONS], axis=0)
    weights = np.repeat(start.T[:, None, :], texts, axis=1)  # input x text x gate
    held = np.zeros((texts, KINDS * BINS, 2), dtype=np.float32)
    logs = np.zeros(texts)
    order = np.argsort(-bits.sizes, kind="stable")
    falling, longest = -bits.sizes[order], int(bits.sizes.max(initial=0))
    one, half = np.float32(1), np.float32(0.5)
    k = end = 0
    while end < longest:
        begin, end, k = end, block_end(k), k + 1
        own = order[: int(np.searchsorted(falling, -begin, side="left"))]  # texts with more bits than ``begin``
        if len(own) == 1:  # a slice
            i = int(bits.starts[own[0]])
            at = np.arange(i + begin, i + min(int(bits.sizes[own[0]]), end))
            row = np.zeros(len(at), dtype=np.int64)
        else:
            lanes = np.arange(begin, end)
            ok = lanes < bits.sizes[own][:, None]
            at = (bits.starts[own][:, None] + lanes)[ok]
            row = np.repeat(np.arange(len(own)), ok.sum(axis=1))
        cell = row * GATES + bits.gate[at]
        x = bits.x[:, at]
        w = weights[:, own].reshape(INPUTS, -1)
        z = x[0] * w[0][cell]
        for i in range(1, INPUTS):
            z += x[i] * w[i][cell]
        np.clip(z, -13, 13, out=z)
        p = one / (one + np.exp(-z))
        err = np.float32(RATE) * (one - p)
        for i in range(INPUTS):
            weights[i, own] += np.bincount(cell, err * x[i], len(own) * GATES).reshape(len(own), GATES)
        # how often a decision's prediction as sure as this one held so far
        kind = bits.kind[at]
        of = np.flatnonzero(kind < KINDS)
        likely, right = p[of], z[of] >= 0
        sure = np.minimum(np.abs(z[of]) * 2, BINS - 1).astype(np.int64)
        spot = row[of] * (KINDS * BINS) + kind[of] * BINS + sure
        so_far = held[own].reshape(-1, 2)[spot]
        likely = np.maximum(likely, one - likely)
        refined = (so_far[:, 1] + HOLD * likely) / (so_far.sum(axis=1) + HOLD)
        p[of] = half * (p[of] + np.where(right, refined, one - refined))
        logs[own] += np.bincount(row, np.log(p), len(own))
        held[own] += np.bincount(2 * spot + right, minlength=2 * len(own) * KINDS * BINS).reshape(len(own), -1, 2)
    return logs


def score_batch(b: Batch, found: Found, learn: np.ndarray, floor: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each text: natural log of its score, log10 of its base score, known tokens."""
    bits, lex = Bits(b, found, learn), b.lexicon
    token = np.zeros(b.n)
    chance = np.concatenate([lex.chance, (found.words + 1.0) / floor])
    frequent = float(lex.chance.sum())
    # a token seen before: by its count, and by its frequency among the frequent words seen so far
    fresh = np.where(b.seen | b.is_rare, 0.0, chance[b.word])
    used = np.cumsum(fresh)
    used = used - (used - fresh)[b.starts][b.text] - fresh
    at = bits.again_at
    prior = PRIOR * np.where(b.is_rare[at], 0.0, chance[b.word[at]]) / np.maximum(used[at], 1e-300)
    token[at] = np.log((b.earlier[at] + prior) / (b.place[at] + PRIOR))
    token[bits.code_at] = bits.code_rest
    token[bits.rare_at] = np.log(chance[b.word[bits.rare_at]] / max(1.0 - frequent, 1e-300))
    score = np.bincount(b.text, token, len(b.sizes)) + mixed(bits)
    known = np.concatenate([np.ones(len(lex.chance), dtype=bool), found.words > 0])[b.word]
    return score, np.bincount(b.text, np.log10(chance[b.word]), len(b.sizes)), np.bincount(b.text, known, len(b.sizes)).astype(np.int64)


def held_out_fold(folds: int, rest: int):
    return F.crc32(id_text().cast("binary")) % folds == rest


def count_words(docs: DataFrame) -> DataFrame:
    """word (binary), c: occurrences in ``docs``, ends included."""

    def run(batches: Iterator) -> Iterator[dict]:
        seen: Counter = Counter()
        for batch in rows(batches):
            for text in batch["text"].to_pylist():
                seen.update(tokens_of(text))
            if len(seen) > 300_000:
                yield {"word": list(seen), "c": list(seen.values())}
                seen = Counter()
        if seen:
            yield {"word": list(seen), "c": list(seen.values())}

    return map_batches(docs.select("text"), run, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))


def frequent_words(counts: DataFrame, most: int) -> DataFrame:
    """Rows of ``counts`` above the least count that leaves ``most`` words at most, by a histogram of counts."""
    step = F.floor(F.log2("c") * 16)  # some 1,000 steps at most, whatever the counts
    bars = sorted(counts.groupBy(step.alias("step")).agg(F.count(F.lit(1)).alias("n")).collect(), reverse=True)
    least, n = None, 0
    for bar in bars:
        n += bar.n
        if n > most:
            break
        least = bar.step
    return counts.where(step >= least if least is not None else F.lit(False))


DEALT = "batch long, tokens long, doc_id array<long>, learn array<boolean>, n_bytes array<long>, sizes array<long>, words binary, odd binary, names binary"


def dealt(docs: DataFrame, lexicon: Lexicon, folds: int, rest: int) -> DataFrame:
    """Batches of texts as numbers of their words: batch (its number), tokens, and of its rows
    doc_id, learn (in training or not), n_bytes and sizes; the lexicon's numbers of its words, those of its
    rare words among themselves (odd) and their names."""
    index, rare = lexicon.index, len(lexicon.index)

    def run(batches: Iterator) -> Iterator[dict]:
        number = TaskContext.get().partitionId() << 33
        local: dict[bytes, int] = {}
        out: dict[str, list] = {"doc_id": [], "learn": [], "n_bytes": [], "sizes": []}
        words: list[np.ndarray] = []
        odds: list[int] = []

        def made() -> dict:
            names = np.fromiter(map(xxhash.xxh3_64_intdigest, local), dtype="<u8", count=len(local))
            size = sum(out["sizes"])
            return {"batch": [number], "tokens": [size], "words": [np.concatenate(words).tobytes()], "odd": [np.array(odds, dtype="<u4").tobytes()], "names": [names.tobytes()]} | {k: [v] for k, v in out.items()}

        for batch in rows(batches):
            for name, text, learn in zip(*(batch[k].to_pylist() for k in ("doc_id", "text", "learn")), strict=True):
                tokens = tokens_of(text)
                if words and sum(out["sizes"]) + len(tokens) > BATCH:
                    yield made()
                    out, words, odds, number = {k: [] for k in out}, [], [], number + 1
                    local.clear()
                word = np.fromiter(map(index.get, tokens, repeat(rare)), dtype="<u2", count=len(tokens))
                odds += [local.setdefault(tokens[k], len(local)) for k in np.flatnonzero(word == rare).tolist()]
                words.append(word)
                for k, v in zip(out, (name, learn, len((text or "").encode("utf-8", "replace")), len(tokens)), strict=True):
                    out[k].append(v)
        if words:
            yield made()

    learn = (~held_out_fold(folds, rest)).alias("learn")
    return map_batches(docs.select("doc_id", "text", learn), run, DEALT)


def score_texts(docs: DataFrame, folds: int = 7, rest: int = 2, vocabulary: int = 1 << 15) -> DataFrame:
    """Score every row of ``docs`` (doc_id long, text string).

    Learns from rows whose crc32 of the id as text, modulo ``folds``, is not
    ``rest``. Returns doc_id, held_out, n_tokens, n_known, train_tokens,
    base_score (add-one unigrams), score and bits_per_byte (of the score, over
    the text's bytes and 1 for its end).

    Null and empty texts are one end. A null doc_id counts as the empty text for
    folds; repeated rows are scored, and learned from, each. Without training
    rows every token is unknown and counts as rare. No rows give no rows.
    """
    if not 0 < vocabulary < 1 << 16:
        raise ValueError("vocabulary must be under 65,536")
    docs = docs.select("doc_id", "text")
    counts = materialize(count_words(docs.where(~held_out_fold(folds, rest))), "words")
    n_train, n_words = (int(x or 0) for x in counts.agg(F.sum("c"), F.count(F.lit(1))).first())
    top = sorted((-r["c"], bytes(r["word"])) for r in frequent_words(counts, vocabulary).collect())  # ``vocabulary`` rows at most
    floor = float(n_train + n_words + 1)
    forget(counts)
    lexicon = Lexicon([w for _, w in top], np.array([-c for c, _ in top], dtype=float), floor)
    tasks = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(100_000, n_train // TASK))
    # bucketed, so that what goes back to a batch comes to it
    with bucketed(dealt(docs, lexicon, folds, rest), tasks, "batch", "batches") as batches:
        tokens = int(batches.agg(F.sum("tokens")).first()[0] or 0)
        power = max(8, math.ceil(math.log2(tokens / BUCKET + 1)))
        bits, first = max(power, min(44, power + INNER)), hops(power)

        def run(given: Iterator) -> Iterator[dict]:
            for one in rows(given, 1):
                row = one.to_pylist()[0]
                b, learn = Batch.of(row, lexicon, bits), np.array(row["learn"], dtype=bool)
                score, base, known = score_batch(b, Found.of(b, Asked(b, power, bits, first), row["found"]), learn, floor)
                score = score / math.log(10)
                yield {"doc_id": row["doc_id"], "held_out": ~learn, "n_tokens": b.sizes, "n_known": known, "train_tokens": np.full(len(learn), n_train), "base_score": base, "score": score, "bits_per_byte": -score / math.log10(2) / (np.array(row["n_bytes"]) + 1)}

        predicted = batches.join(corpus_counts(batches, lexicon, power, bits, first), "batch")
        return materialize(map_batches(predicted, run, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, bits_per_byte double"), "scores")


def op10_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents."""
    return score_texts(read(spark, sf_dir, "documents"))
