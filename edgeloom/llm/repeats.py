"""Removal of repeated byte strings with merged Burrows-Wheeler transforms.

A byte is removed if a string of ``length`` bytes covers it that also starts
earlier (smaller doc_id, or the same document further left).

1. Stretches. In each string of ``length`` bytes the gram of least hash is its
   anchor; neighbouring strings with one anchor form a stretch. Equal strings
   have equal anchors, so each anchor's stretches can be judged alone. Anchors
   that occur once are out at once, and equal stretches are one kind.
2. Of equal stretches, all but the earliest go whole.
3. Anchors with several kinds, of which some strings may still be equal: their
   kinds are dealt by anchor into groups and within a group into shards. One
   stage builds each shard's transform, and the next merges a group's
   transforms by refining their interleave: pass h orders all suffixes by h
   symbols from the order by h - 1, with no suffix sorted again (Holt, McMillan
   2014). That holds for the first ``slow`` (8) passes. After them most blocks are
   single; the suffixes in others are sorted again by the order of their places
   h further on, so that a pass takes as many symbols as are settled. Where
   neighbours part gives common prefixes; runs of ``length`` or more are the
   repeated intervals. ``slow=length`` refines all the way, at some six times the time.

Scale: what is shuffled are anchors and digests (about 3 for each 100 bytes);
of step 3, kinds and their transforms alone. A group holds about ``merge_bytes``.
Kinds of an anchor with more than ``most_bytes`` are split by their strings' next
least gram, and again until they fit: equal strings have equal grams, so this
is exact at every size.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import forget, map_batches, materialize, read, rows, semi_join, with_sub

_TABLE = np.array([int.from_bytes(hashlib.sha256(b"gram" + bytes([k])).digest()[:8], "little") for k in range(256)], dtype=np.uint64)
_LOW = np.uint64((1 << 24) - 1)
SEGMENT = 1 << 23  # places judged at a time; longer texts are taken in segments


def _gram_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    """A 64-bit hash of the ``gram`` bytes (a power of two) from each place."""
    h, step = _TABLE[data], 1
    while step < gram:
        h = (h[:-step] * np.uint64(0x9E3779B97F4A7C15 + 2 * step)) + h[step:]
        h ^= h >> np.uint64(29)
        step *= 2
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def _least(keys: np.ndarray, width: int) -> np.ndarray:
    """Least key of each ``width`` in a row."""
    m, step = keys, 1
    while 2 * step <= width:
        m = np.minimum(m[:-step], m[step:])
        step *= 2
    return np.minimum(m[: len(keys) - width + 1], m[width - step :][: len(keys) - width + 1])


def stretches(raw: bytes, length: int, gram: int) -> Iterator[tuple[int, int, int]]:
    """(anchor, start, strings) of a text's stretches, which tile its strings."""
    for low in range(0, len(raw) - length + 1, SEGMENT):
        part = np.frombuffer(raw, dtype=np.uint8, count=min(SEGMENT + length - 1, len(raw) - low), offset=low)
        hashes = _gram_hashes(part, gram)
        keys = (hashes & ~_LOW) | np.arange(len(hashes), dtype=np.uint64)
        at = (_least(keys, length - gram + 1) & _LOW).astype(np.int64)
        edges = np.flatnonzero(at[1:] != at[:-1]) + 1
        start = np.concatenate([[0], edges])
        n = np.diff(np.append(start, len(at)))
        yield from zip(hashes[at[start]].view(np.int64).tolist(), (start + low).tolist(), n.tolist(), strict=True)


def _bytes(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "replace")


PLACE = ("doc_id", "sub", "start")


def _digest(raw: bytes) -> int:
    return xxhash.xxh3_64_intdigest(raw) - (1 << 63)


def _all_stretches(docs: DataFrame, length: int, gram: int) -> DataFrame:
    def run(batches: Iterator) -> Iterator[dict]:
        for batch in rows(batches, 256):
            out: dict[str, list] = {k: [] for k in ("anchor", "digest", "n", *PLACE)}
            for name, sub, text in zip(*(batch[k].to_pylist() for k in ("doc_id", "sub", "text")), strict=True):
                raw, before = _bytes(text), len(out["n"])
                for anchor, start, n in stretches(raw, length, gram):
                    out["anchor"].append(anchor)
                    out["digest"].append(_digest(raw[start : start + n + length - 1]))
                    out["n"].append(n)
                    out["start"].append(start)
                out["doc_id"] += [name] * (len(out["n"]) - before)
                out["sub"] += [sub] * (len(out["n"]) - before)
            yield out

    return map_batches(docs, run, "anchor long, digest long, n int, doc_id long, sub long, start long")


def next_stretches(piece: bytes, length: int, gram: int, level: int) -> Iterator[tuple[int, int, int]]:
    """(hash, start, strings): the strings of a piece by their least grams up to the one after ``level``."""
    hashes = _gram_hashes(np.frombuffer(piece, dtype=np.uint8), gram)
    keys = (hashes & ~_LOW) | np.arange(len(hashes), dtype=np.uint64)
    of_string = np.sort(np.lib.stride_tricks.sliding_window_view(keys, length - gram + 1), axis=1)
    at = (of_string[:, : level + 1] & _LOW).astype(np.int64)
    edges = np.flatnonzero((at[1:] != at[:-1]).any(axis=1)) + 1
    start = np.concatenate([[0], edges])
    n = np.diff(np.append(start, len(at)))
    yield from zip(hashes[at[start, level]].view(np.int64).tolist(), start.tolist(), n.tolist(), strict=True)


def suffix_order(pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes of a shard in order (places in the joined pieces, each with one
    end after it) and the symbols before them: its transform. Symbols are bytes
    + 1; 0 is a piece's end, and ends differ, in the order of pieces."""
    sizes = np.array([len(p) + 1 for p in pieces])
    ends = np.cumsum(sizes) - 1
    n = int(sizes.sum())
    text = np.zeros(n, dtype=np.int64)
    inner = np.ones(n, dtype=bool)
    inner[ends] = False
    text[inner] = np.frombuffer(b"".join(pieces), dtype=np.uint8).astype(np.int64) + 1
    left = np.repeat(ends, sizes) - np.arange(n)  # symbols before the end
    # by seven symbols at first, none of them beyond the end; equal ones that end are in the order of pieces
    step, key = 7, np.zeros(n, dtype=np.int64)
    for k in range(min(step, n)):
        key[: n - k] |= np.where(left[: n - k] > k, text[k:], 0) << (9 * (step - 1 - k))
    order = np.argsort(key, kind="stable")
    new = np.empty(n, dtype=np.int64)
    new[order] = np.cumsum(np.append(False, (np.diff(key[order]) != 0) | (left[order[1:]] < step)))
    open_ = order
    while True:  # doubling, of suffixes that are not alone yet
        single = np.append(np.bincount(new, minlength=n), 0)
        open_ = open_[single[new[open_]] > 1]
        if not len(open_):
            break
        # ranks leave room for the members of each block
        first = np.cumsum(np.append(0, np.bincount(new, minlength=n)))
        rank = first[new]
        key = rank[open_] * (n + 1) + rank[np.minimum(open_ + step, n - 1)]
        by = np.argsort(key)
        key, open_ = key[by], open_[by]
        head = np.append(True, key[1:] // (n + 1) != key[:-1] // (n + 1))
        part = np.append(True, key[1:] != key[:-1])
        run = np.arange(len(key))
        begin = np.maximum.accumulate(np.where(head, run, 0))
        new = rank
        new[open_] = key // (n + 1) + np.maximum.accumulate(np.where(part, run, 0)) - begin
        step *= 2
    order = np.empty(n, dtype=np.int64)
    order[new] = np.arange(n)
    before = np.where(order == 0, ends[-1], order - 1)
    return order, text[before].astype(np.uint16)


def transform_of(symbols: np.ndarray) -> tuple[bytes, bytes]:
    """A transform as bytes: its symbols, and the rows that hold an end."""
    return (np.maximum(symbols, 1) - 1).astype("u1").tobytes(), np.flatnonzero(symbols == 0).astype("<i4").tobytes()


def symbols_of(raw: bytes, ends: bytes) -> np.ndarray:
    symbols = np.frombuffer(raw, "u1").astype(np.uint16) + 1
    symbols[np.frombuffer(ends, "<i4")] = 0
    return symbols


def merge_transforms(shards: list[tuple[np.ndarray, np.ndarray]], depth: int, slow: int = 8) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes of all shards in order by ``depth`` symbols, and common prefixes.

    ``shards`` are (symbols, lengths of the pieces). Returns places (in the
    shards' joined pieces, each with one end after it) in order, and for each the
    length of the prefix that it shares with the one before: exact below
    ``slow``, then the last of ``slow``, 2 ``slow``, 4 ``slow``, ... and ``depth`` that
    it reaches.
    """
    sizes = [len(s) for s, _ in shards]
    base = np.cumsum(sizes) - sizes
    symbols = np.concatenate([s for s, _ in shards])
    total = len(symbols)
    used = np.unique(symbols)
    if len(used) <= 256:  # narrow symbols are dealt in one pass
        symbols = np.searchsorted(used, symbols).astype(np.uint8)
    # each shard's reading order: the row of the suffix that is one symbol longer; and the place of each row
    longer, place = (np.empty(total, dtype=np.int32) for _ in range(2))
    ends, at_end = [], 0
    for (s, lengths), b in zip(shards, base, strict=True):
        longer[b + np.argsort(s, kind="stable")] = b + np.arange(len(s))
        row, left = b + np.arange(len(lengths)), np.array(lengths)
        ends.append(row)
        stop = at_end + np.cumsum(left + 1) - 1
        at_end += int(left.sum()) + len(left)
        while len(row):
            place[row] = stop
            more = left > 0
            row, stop, left = row[more], stop[more] - 1, left[more] - 1
            row = longer[row]
    ends = np.concatenate(ends).astype(np.int32)
    m = len(ends)
    # the interleave: at each place of the order, the row of the shard that stands there
    at, block = np.arange(total, dtype=np.int32), np.zeros(total, dtype=np.int32)
    fresh = np.ones(total, dtype=bool)
    common = np.full(total, -1, dtype=np.int32)
    common[0] = 0
    for h in range(min(slow, depth)):
        ahead = symbols[at]
        order = np.argsort(ahead, kind="stable")[m:]
        was, sym = block[order], ahead[order]
        fresh[m + 1 :] = (sym[1:] != sym[:-1]) | (was[1:] != was[:-1])
        common[fresh & (common < 0)] = h
        at = np.concatenate([ends, longer[at[order]]])
        block = np.cumsum(fresh, dtype=np.int32)
    place_at = place[at]  # from here on by place: blocks are named by where they begin
    begin = np.maximum.accumulate(np.where(fresh, np.arange(total), 0))
    of_place = np.empty(total, dtype=np.int64)
    of_place[place_at] = begin
    h = slow
    while h < depth:
        single = fresh & np.append(fresh[1:], True)
        spots = np.flatnonzero(~single)
        if not len(spots):
            break
        step = min(h, depth - h)
        p = place_at[spots].astype(np.int64)
        key = begin[spots] * total + of_place[p + step]
        by = np.argsort(key)
        key, p = key[by], p[by]
        place_at[spots] = p
        part = np.append(True, key[1:] != key[:-1])
        part &= ~fresh[spots]
        fresh[spots[part]] = True
        common[spots[part]] = h
        begin = np.maximum.accumulate(np.where(fresh, np.arange(total), 0))
        of_place[p] = begin[spots]
        h += step
    common[common < 0] = depth
    return place_at, common


def repeated_strings(pieces: tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray], shards: list[np.ndarray], length: int) -> dict[str, list]:
    """Spans of the strings of ``length`` bytes that an earlier place also has.

    ``pieces`` are the doc_id, sub, start and bytes of each piece, in the order of the
    shards, whose symbols are ``shards``.
    """
    doc, sub, first, size = pieces
    cuts = np.cumsum([int((s == 0).sum()) for s in shards])[:-1]
    places, common = merge_transforms(list(zip(shards, np.split(size, cuts), strict=True)), length)
    again = np.flatnonzero(common >= length)
    chosen = np.union1d(again - 1, again)
    group = np.cumsum(common < length)[chosen]
    begin = np.cumsum(size + 1) - (size + 1)
    piece = np.searchsorted(begin, places[chosen], side="right") - 1
    doc, sub, start = doc[piece], sub[piece], first[piece] + places[chosen] - begin[piece]
    order = np.lexsort((start, sub, doc, group))
    group, doc, sub, start = group[order], doc[order], sub[order], start[order]
    head = np.append(True, group[1:] != group[:-1]) if len(group) else np.zeros(0, dtype=bool)
    at = np.maximum.accumulate(np.where(head, np.arange(len(group)), 0))
    # the same place may stand in two pieces; it is no repeat of itself
    later = (doc != doc[at]) | (sub != sub[at]) | (start != start[at])
    doc, sub, start = doc[later], sub[later], start[later]
    order = np.lexsort((start, sub, doc))
    doc, sub, start = doc[order], sub[order], start[order]
    new = np.append(True, (doc[1:] != doc[:-1]) | (sub[1:] != sub[:-1]) | (start[1:] > start[:-1] + length)) if len(doc) else np.zeros(0, dtype=bool)
    a = np.flatnonzero(new)
    b = np.append(a[1:], len(doc)) - 1 if len(a) else a
    return {"doc_id": doc[a], "sub": sub[a], "a": start[a], "b": start[b] + length}


SPANS = "doc_id long, sub long, a long, b long"
PIECES = "key long, digest long, doc_id long, sub long, start long, piece binary"
SHARD = "grp long, shard int, doc_id binary, sub binary, start binary, size binary, symbols binary, ends binary"


def _place() -> Column:
    return F.struct(*PLACE)


def _wanted_pieces(texts: DataFrame, wanted: DataFrame, length: int, gram: int) -> DataFrame:
    """Bytes of the wanted stretches (anchor, n, hot and place); those of hot anchors cut by their next gram."""
    lists = wanted.groupBy("doc_id", "sub").agg(F.collect_list(F.struct("anchor", "start", "n", "hot")).alias("wanted"))  # at most a text's stretches
    both = semi_join(texts, wanted, ["doc_id"]).dropDuplicates(["doc_id", "sub"]).join(lists.hint("shuffle_hash"), ["doc_id", "sub"])

    def run(batches: Iterator) -> Iterator[dict]:
        for batch in rows(batches, 128):
            out: dict[str, list] = {k: [] for k in ("key", "digest", *PLACE, "piece", "hot")}
            for name, sub, text, own in zip(*(batch[k].to_pylist() for k in ("doc_id", "sub", "text", "wanted")), strict=True):
                raw = _bytes(text)
                for w in own:
                    piece = raw[w["start"] : w["start"] + w["n"] + length - 1]
                    cuts = next_stretches(piece, length, gram, 1) if w["hot"] else [(0, 0, w["n"])]
                    for grams, at, n in cuts:
                        part = piece[at : at + n + length - 1]
                        out["key"].append(_next_key(w["anchor"], grams) if w["hot"] else w["anchor"])
                        out["digest"].append(_digest(part))
                        out["doc_id"].append(name)
                        out["sub"].append(sub)
                        out["start"].append(w["start"] + at)
                        out["piece"].append(part)
                        out["hot"].append(w["hot"])
            yield out

    return map_batches(both, run, PIECES + ", hot boolean")


def _next_key(key: int, gram: int) -> int:
    return _digest(key.to_bytes(8, "little", signed=True) + gram.to_bytes(8, "little", signed=True))


def _split(pieces: DataFrame, length: int, gram: int, level: int) -> DataFrame:
    def run(batches: Iterator) -> Iterator[dict]:
        for batch in rows(batches, 2048):
            out: dict[str, list] = {k: [] for k in ("key", "digest", *PLACE, "piece")}
            for key, name, sub, start, piece in zip(*(batch[k].to_pylist() for k in ("key", *PLACE, "piece")), strict=True):
                for grams, at, n in next_stretches(piece, length, gram, level):
                    part = piece[at : at + n + length - 1]
                    for k, v in (("key", _next_key(key, grams)), ("digest", _digest(part)), ("doc_id", name), ("sub", sub), ("start", start + at), ("piece", part)):
                        out[k].append(v)
            yield out

    return map_batches(pieces.select("key", *PLACE, "piece"), run, PIECES)


def _judge(pieces: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Spans of pieces that an earlier one equals, and the kinds of keys with several, with their key's bytes."""
    firsts = materialize(pieces.groupBy("key", "digest").agg(F.min(_place()).alias("first"), F.count(F.lit(1)).alias("size"), F.first(F.length("piece")).alias("bytes")), "firsts")
    copies = pieces.join(firsts.where("size > 1").select("key", "digest", "first"), ["key", "digest"]).where(_place() != F.col("first"))
    spans = copies.select("doc_id", "sub", F.col("start").alias("a"), (F.col("start") + F.length("piece")).alias("b"))
    keys = firsts.groupBy("key").agg(F.count(F.lit(1)).alias("kinds"), F.sum("bytes").alias("bytes")).where("kinds > 1")
    kinds = firsts.select("key", "first.*").join(keys.select("key", "bytes"), "key")
    return spans, pieces.join(kinds, ["key", *PLACE]).dropDuplicates(["key", *PLACE])


def _transforms(pieces: DataFrame, groups: int, shards: int) -> DataFrame:
    """The transform of each shard: a row, with the places and lengths of its pieces."""
    dealt = pieces.select(F.pmod("key", F.lit(groups)).alias("grp"), F.pmod(F.xxhash64("doc_id", "start"), F.lit(shards)).cast("int").alias("shard"), *PLACE, "piece")

    def run(batches: Iterator) -> Iterator[dict]:
        held: list[tuple] = []

        def made() -> dict:
            symbols, ends = transform_of(suffix_order([x[5] for x in held])[1])
            ints = [np.array([x[k] for x in held], dtype="<i8").tobytes() for k in (2, 3, 4)]
            sizes = np.array([len(x[5]) for x in held], dtype="<i8").tobytes()
            return {k: [v] for k, v in zip(("grp", "shard", *PLACE, "size", "symbols", "ends"), (held[0][0], held[0][1], *ints, sizes, symbols, ends), strict=True)}

        for batch in rows(batches, 2048):
            for row in zip(*(batch[k].to_pylist() for k in ("grp", "shard", *PLACE, "piece")), strict=True):
                if held and row[:2] != held[0][:2]:
                    yield made()
                    held = []
                held.append(row)
        if held:
            yield made()

    return map_batches(dealt.repartition("grp", "shard").sortWithinPartitions("grp", "shard"), run, SHARD)


def _merged(transforms: DataFrame, length: int) -> DataFrame:
    """Spans of strings that the merged transforms of a group repeat."""

    def run(batches: Iterator) -> Iterator[dict]:
        held: list[dict] = []

        def made() -> dict:
            pieces = tuple(np.concatenate([np.frombuffer(x[k], "<i8") for x in held]) for k in (*PLACE, "size"))
            return repeated_strings(pieces, [symbols_of(x["symbols"], x["ends"]) for x in held], length)

        for batch in rows(batches, 16):
            for row in batch.to_pylist():
                if held and row["grp"] != held[0]["grp"]:
                    yield made()
                    held = []
                held.append(row)
        if held:
            yield made()

    return map_batches(transforms.repartition("grp").sortWithinPartitions("grp", "shard"), run, SPANS)


def repeated_spans(docs: DataFrame, length: int = 100, gram: int = 32, merge_bytes: int = 1 << 20, most_bytes: int = 1 << 21, shards: int = 8) -> DataFrame:
    """doc_id, sub, a, b: byte spans [a, b) that strings cover which also start earlier.

    ``docs`` is (doc_id, sub, text), sub as of ``with_sub``. Spans may overlap. Null
    texts are empty; rows that repeat a (doc_id, sub) are one document.
    """
    if gram & (gram - 1) or not 1 <= gram <= length:
        raise ValueError("gram must be a power of two, at most length")
    everything = materialize(_all_stretches(docs, length, gram), "stretches")
    common = materialize(everything.groupBy("anchor").agg(F.count(F.lit(1)).alias("size")).where("size > 1").select("anchor"), "anchors")
    shared = materialize(everything.join(common.hint("shuffle_hash"), "anchor", "left_semi"), "shared")
    forget(everything, common)
    same = ["anchor", "digest", "n"]
    kinds = materialize(shared.groupBy(*same).agg(F.min(_place()).alias("first"), F.count(F.lit(1)).alias("size")), "kinds")
    copies = shared.join(kinds.where("size > 1").select(*same, "first"), same).where(_place() != F.col("first"))
    whole = copies.select("doc_id", "sub", F.col("start").alias("a"), (F.col("start") + F.col("n") + length - 1).alias("b"))

    anchors = kinds.groupBy("anchor").agg(F.count(F.lit(1)).alias("kinds"), F.sum(F.col("n") + length - 1).alias("bytes")).where("kinds > 1")
    wanted = materialize(kinds.select("anchor", "n", "first.*").join(anchors.select("anchor", "bytes"), "anchor").withColumn("hot", F.col("bytes") > most_bytes), "mixed")
    hot, size = wanted.agg(F.count(F.when(F.col("hot"), 1)), F.sum(F.col("n") + length - 1)).first()
    pieces = _wanted_pieces(docs, wanted, length, gram)
    spans = [whole]
    if hot:
        pieces = materialize(pieces, "pieces")
        ready, todo = pieces.where("not hot").drop("hot"), pieces.where("hot").drop("hot")
        for level in range(2, length - gram + 2):
            gone, found = _judge(todo)
            spans.append(materialize(gone, "copies"))
            found = materialize(found.withColumn("more", (F.col("bytes") > most_bytes) & F.lit(level <= length - gram)), "parts")
            ready, todo = ready.unionByName(found.where("not more").drop("bytes", "more")), found.where("more").drop("bytes", "more")
            if todo.isEmpty():
                break
            todo = materialize(_split(todo, length, gram, level), "split")
    else:
        ready = pieces.drop("hot")
    groups = max(1, int(size or 0) // merge_bytes)
    spans.append(_merged(_transforms(ready, groups, shards), length))
    every = spans[0]
    for x in spans[1:]:
        every = every.union(x)
    return materialize(every, "spans")


def remove_repeats(docs: DataFrame, length: int = 100, gram: int = 32, merge_bytes: int = 1 << 20, most_bytes: int = 1 << 21, shards: int = 8) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept (binary) for every row of ``docs``.

    Null and empty texts have 0 bytes; texts under ``length`` bytes lose none;
    rows with a null doc_id come back whole. Rows that repeat a doc_id with the
    same text are one document; with different texts, each is one of its own, in
    the order of the texts' digests. No rows give no rows.
    """
    every = with_sub(docs.select("doc_id", "text")).withColumnRenamed("_sub", "sub")
    named = every.where("doc_id is not null")
    spans = repeated_spans(named, length, gram, merge_bytes, most_bytes, shards)
    gone = spans.groupBy("doc_id", "sub").agg(F.collect_list(F.struct("a", "b")).alias("spans"))  # at most a text's places
    joined = every.join(gone.hint("shuffle_hash"), ["doc_id", "sub"], "left")

    def run(batches: Iterator) -> Iterator[dict]:
        for batch in rows(batches, 256):
            out: dict[str, list] = {k: [] for k in ("doc_id", "n_bytes", "n_removed", "n_spans", "kept")}
            for name, text, own in zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist(), batch["spans"].to_pylist(), strict=True):
                raw, kept, at, n = _bytes(text), [], 0, 0
                end = -1
                for a, b in sorted((s["a"], s["b"]) for s in own or ()):
                    if a > end:
                        n += 1
                        kept.append(raw[at:a])
                    end = at = max(end, b)
                kept.append(raw[at:])
                left = b"".join(kept)
                for k, v in (("doc_id", name), ("n_bytes", len(raw)), ("n_removed", len(raw) - len(left)), ("n_spans", n), ("kept", left)):
                    out[k].append(v)
            yield out

    return map_batches(joined, run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")


def op6_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without strings of 100 bytes that also start earlier."""
    return remove_repeats(read(spark, sf_dir, "documents")).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


ORACLE = """
WITH h AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
p AS (SELECT doc_id, x, unnest(range(CAST(length(x) AS BIGINT) // 2)) AS i FROM h),
s AS (SELECT doc_id, i, substr(x, 2 * i + 1, 2) AS c, CASE WHEN 2 * i + 200 <= length(x) THEN md5(substr(x, 2 * i + 1, 200)) END AS s FROM p),
f AS (SELECT *, s IS NOT NULL AND row_number() OVER (PARTITION BY s ORDER BY doc_id, i) > 1 AS again FROM s),
r AS (SELECT doc_id, i, c, coalesce(bool_or(again) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 99 PRECEDING AND CURRENT ROW), FALSE) AS gone FROM f),
e AS (SELECT *, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY i), FALSE) AS opens FROM r),
g AS (SELECT doc_id, count(*) AS n, count(*) FILTER (gone) AS n_removed, count(*) FILTER (opens) AS n_spans, coalesce(string_agg(c, '' ORDER BY i) FILTER (NOT gone), '') AS kept FROM e GROUP BY 1)
SELECT h.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans, sha256(unhex(coalesce(kept, ''))) AS kept_sha256
FROM h LEFT JOIN g USING (doc_id)
"""
