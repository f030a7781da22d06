"""Packing token sequences by order-preserving dynamic programming.

Documents keep their order (by id, then text). Windows of at most
``max_tokens`` are cut from the stream of ids at document ends, sentence ends
or, where neither is near, at plain places. The cuts minimise

    padding of all windows + penalties of cuts inside documents.

With ``f(j)`` the least cost of a prefix that ends at candidate place ``p_j``::

    f(j) = penalty(j) + min over p_j - p_i <= L of f(i) + L - (p_j - p_i)

The term under the minimum is ``f(i) + p_i`` plus what depends on ``j`` alone,
so a monotone queue of ``f(i) + p_i`` gives each minimum in constant amortised
time.

Scale: one range shuffle of the texts by id; each task streams through its
range in stretches of ``lookahead`` ids, solves a stretch exactly, and carries
the last window over to the next, so memory is bounded whatever a range or a
document holds. Only the last window of a task may be short.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from .common import map_batches, read, rows
from .tokens import public_path, sentence_tables, tokenizer

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary"


def best_cuts(pos: np.ndarray, penalty: np.ndarray, max_tokens: int) -> list[int]:
    """Indices into ``pos`` (rising, from 0) of the cheapest cuts, first and last included."""
    places, costs = pos.tolist(), penalty.tolist()
    m = len(places)
    back, queue, values = [0] * m, [0], [0]  # values: f + p of what queue holds
    head = 0
    for j in range(1, m):
        p = places[j]
        low = p - max_tokens
        while places[queue[head]] < low:
            head += 1
        back[j] = queue[head]
        value = values[head] + max_tokens + costs[j]  # f(j) + p(j)
        while len(values) > head and values[-1] >= value:
            values.pop()
            queue.pop()
        values.append(value)
        queue.append(j)
    cuts, j = [m - 1], m - 1
    while j:
        j = back[j]
        cuts.append(j)
    return cuts[::-1]


def candidates(ids: np.ndarray, doc_ends: np.ndarray, ends: np.ndarray, starts: np.ndarray, max_tokens: int, sentence: int, plain: int, every: int) -> tuple[np.ndarray, np.ndarray]:
    """Places to cut a stretch of ids, and their penalties: none at document ends."""
    n = len(ids)
    inside = np.flatnonzero(ends[ids[:-1]] & starts[ids[1:]]) + 1 if n > 1 else np.zeros(0, dtype=np.int64)
    pos = np.unique(np.concatenate([[0], inside, doc_ends, [n]]))
    gaps = np.diff(pos)
    wide = np.flatnonzero(gaps > 2 * every)
    if len(wide):
        extra = np.concatenate([np.arange(pos[k] + every, pos[k + 1], every) for k in wide])
        pos = np.union1d(pos, extra)
    penalty = np.full(len(pos), plain, dtype=np.int64)
    penalty[np.searchsorted(pos, inside)] = sentence
    penalty[np.searchsorted(pos, doc_ends)] = 0
    penalty[0] = 0
    return pos, penalty


def pack(docs: DataFrame, path: str, end_id: int = 0, max_tokens: int = 1024, sentence_penalty: int = 8, plain_penalty: int = 24, every: int = 32, lookahead: int = 1 << 19) -> DataFrame:
    """Pack the texts of ``docs`` (doc_id long, text string) into sequences.

    Returns one row for each piece: doc_id, start and length in its document's
    ids (``end_id`` included), ids_crc32, doc_tokens, sequence_id, offset there,
    and the ids themselves (little-endian unsigned 32-bit).

    Null and empty texts give a document of ``end_id`` alone. A null doc_id is
    kept and comes first; rows that repeat an id are documents of their own,
    ordered by text. No rows give no pieces. Documents longer than a sequence
    are cut at sentence ends where that pays. sequence_id is unique and rises
    with the documents; it is not dense.
    """
    if lookahead < 4 * max_tokens or not 0 < 2 * every <= max_tokens:
        raise ValueError("lookahead must be 4 * max_tokens at least, every max_tokens / 2 at most")

    def run(batches: Iterator) -> Iterator[dict]:
        tok = tokenizer(path)
        ends, starts = sentence_tables(path)
        sequence = TaskContext.get().partitionId() << 33
        end = np.array([end_id], dtype="<u4").tobytes()
        waiting: list[tuple] = []  # doc_id, ids left, start, doc_tokens
        held = 0

        def solve(last: bool) -> dict:
            nonlocal waiting, held, sequence
            ids = np.concatenate([x[1] for x in waiting])
            sizes = np.array([len(x[1]) for x in waiting])
            doc_ends = np.cumsum(sizes)
            pos, penalty = candidates(ids, doc_ends, ends, starts, max_tokens, sentence_penalty, plain_penalty, every)
            cuts = pos[best_cuts(pos, penalty, max_tokens)]
            if not last:
                cuts = cuts[:-1]
            done = cuts[-1]
            edges = np.unique(np.concatenate([cuts, doc_ends[doc_ends <= done], [0]]))
            begin, length = edges[:-1], np.diff(edges)
            doc = np.searchsorted(doc_ends, begin, side="right")
            window = np.searchsorted(cuts, begin, side="right") - 1
            in_doc = begin - (doc_ends - sizes)[doc] + np.array([x[2] for x in waiting])[doc]
            view = memoryview(ids.astype("<u4").tobytes())
            parts = [view[4 * a : 4 * (a + n)] for a, n in zip(begin.tolist(), length.tolist(), strict=True)]
            out = {
                "doc_id": [waiting[k][0] for k in doc],
                "start": in_doc,
                "length": length,
                "ids_crc32": [zlib.crc32(x) for x in parts],
                "doc_tokens": [waiting[k][3] for k in doc],
                "sequence_id": sequence + window,
                "offset": begin - cuts[window],
                "ids": [bytes(x) for x in parts],
            }
            sequence += len(cuts) - 1
            keep = int(np.searchsorted(doc_ends, done, side="right"))
            rest = waiting[keep:]
            if rest:
                gone = int(done - (doc_ends[keep] - sizes[keep]))
                name, left, start, total = rest[0]
                rest[0] = (name, left[gone:], start + gone, total)
            waiting, held = rest, sum(len(x[1]) for x in rest)
            return out

        for batch in rows(batches):
            for name, text in zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist(), strict=True):
                ids = np.frombuffer(tok.encode_bytes(text) + end, dtype="<u4")
                waiting.append((name, ids, 0, len(ids)))
                held += len(ids)
                if held >= lookahead:
                    yield solve(False)
        if held:
            yield solve(True)

    ordered = docs.select("doc_id", "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    return map_batches(ordered, run, SCHEMA)


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document of the corpus, packed into sequences of at most 1024 ids."""
    return pack(read(spark, sf_dir, "documents"), public_path("byte_bpe_50k.json")).drop("ids")
