"""Token ids in files of directly addressable codes.

An id is split into chunks of ``width`` bits, lowest first. Level 0 holds the
first chunk of every id, level 1 the second of those ids that have one, and so
on. A bitmap beside each level says which of its chunks go on, and a rank
directory holds the number of set bits before each 512 of them. So the id at
any place is read by one chunk, one bit and one rank a level, with no block to
decode.

A file is one block of documents (about ``block_tokens`` ids) and stands in a
row of the store beside the index of its documents.

Scale: one range shuffle of the texts by id, blocks are written as they fill,
and global offsets come from the blocks' lengths alone.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import map_batches, materialize, read, rows
from .tokens import public_path, tokenizer

MAGIC = b"DAC1"
_HEAD = struct.Struct("<4sQBB")
_LEVEL = struct.Struct("<QQQ")
_RANK_BYTES = 64  # a rank for each 512 bits
STORE = "part int, block int, n_ids long, file binary, doc_ids array<long>, lengths array<long>"


def encode_block(ids: np.ndarray, width: int = 8) -> bytes:
    """A block of unsigned 32-bit ids as one file; ``width`` is 8 or 16 bits."""
    kind = {8: "u1", 16: "<u2"}[width]
    left, levels = ids.astype(np.uint32), []
    while True:
        rest = left >> np.uint32(width)
        more = rest > 0
        bits = np.packbits(more, bitorder="little")
        bits = np.concatenate([bits, np.zeros(-len(bits) % _RANK_BYTES, dtype=np.uint8)])
        ones = np.bitwise_count(bits).reshape(-1, _RANK_BYTES).sum(axis=1, dtype=np.uint64)
        ranks = np.concatenate([[0], np.cumsum(ones)[:-1]]).astype("<u4") if len(ones) else np.zeros(0, dtype="<u4")
        chunks = (left & np.uint32((1 << width) - 1)).astype(kind)
        levels.append((len(left), chunks.tobytes(), bits.tobytes(), ranks.tobytes()))
        if not more.any():
            break
        left = rest[more]
    head = [_HEAD.pack(MAGIC, len(ids), width, len(levels))]
    for n, chunks, bits, ranks in levels:
        head += [_LEVEL.pack(n, len(bits), len(ranks)), chunks, bits, ranks]
    return b"".join(head)


class Block:
    """A file of ``encode_block``, opened without decoding it."""

    def __init__(self, file: bytes) -> None:
        magic, self.n, self.width, depth = _HEAD.unpack_from(file)
        if magic != MAGIC:
            raise ValueError("not a file of directly addressable codes")
        kind, at, self.levels = {8: "u1", 16: "<u2"}[self.width], _HEAD.size, []
        for _ in range(depth):
            n, n_bits, n_ranks = _LEVEL.unpack_from(file, at)
            at += _LEVEL.size
            chunks = np.frombuffer(file, dtype=kind, count=n, offset=at)
            at += n * self.width // 8
            bits = np.frombuffer(file, dtype=np.uint8, count=n_bits, offset=at)
            ranks = np.frombuffer(file, dtype="<u4", count=n_ranks // 4, offset=at + n_bits)
            at += n_bits + n_ranks
            self.levels.append((chunks, bits, ranks))

    def __len__(self) -> int:
        return self.n

    def __getitem__(self, i: int) -> int:
        """The id at place ``i``: one chunk, one bit and one rank for each level."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        value = shift = 0
        for chunks, bits, ranks in self.levels:
            value |= int(chunks[i]) << shift
            shift += self.width
            byte, bit = divmod(i, 8)
            if not bits[byte] >> bit & 1:
                break
            first = byte // _RANK_BYTES
            before = int(np.bitwise_count(bits[first * _RANK_BYTES : byte]).sum())
            i = int(ranks[first]) + before + int(bits[byte] & ((1 << bit) - 1)).bit_count()
        return value

    def all(self) -> np.ndarray:
        """Every id, in order."""
        deeper = np.zeros(0, dtype=np.uint32)
        for chunks, bits, _ in reversed(self.levels):
            value = chunks.astype(np.uint32)
            if len(deeper):
                more = np.unpackbits(bits, count=len(chunks), bitorder="little").astype(bool)
                value[more] |= deeper << np.uint32(self.width)
            deeper = value
        return deeper


def write_store(docs: DataFrame, path: str, end_id: int = 2, width: int = 8, block_tokens: int = 1 << 20) -> DataFrame:
    """Encode the texts of ``docs`` (doc_id long, text string) and write the files.

    Returns the written store: part and block (their order is that of the
    documents by id, then text), n_ids, file, doc_ids and lengths.

    Null and empty texts hold ``end_id`` alone. A null doc_id comes first; rows
    that repeat an id are documents of their own. No rows give no files. A text
    of any length stays in one block.
    """

    def run(batches: Iterator) -> Iterator[dict]:
        tok, part, block = tokenizer(path), TaskContext.get().partitionId(), 0
        end = np.array([end_id], dtype="<u4").tobytes()
        names, parts, held = [], [], 0

        def made() -> dict:
            ids = np.frombuffer(b"".join(parts), dtype="<u4")
            return {"part": [part], "block": [block], "n_ids": [len(ids)], "file": [encode_block(ids, width)], "doc_ids": [list(names)], "lengths": [[len(x) // 4 for x in parts]]}

        for batch in rows(batches):
            for name, text in zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist(), strict=True):
                names.append(name)
                parts.append(tok.encode_bytes(text) + end)
                held += len(parts[-1]) // 4
                if held >= block_tokens:
                    yield made()
                    block += 1
                    names, parts, held = [], [], 0
        if names:
            yield made()

    ordered = docs.select("doc_id", "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    return materialize(map_batches(ordered, run, STORE), "tokens", "none")


def block_starts(store: DataFrame) -> DataFrame:
    """part, block, first: ids before each block. Only lengths are read.

    The one window without a partition runs over a row for each part, and the
    number of parts is that of the tasks that wrote the store.
    """
    sizes = store.select("part", "block", "n_ids")
    parts = sizes.groupBy("part").agg(F.sum("n_ids").alias("n"))
    before = parts.select("part", (F.sum("n").over(W.orderBy("part")) - F.col("n")).alias("part_first"))
    inside = F.sum("n_ids").over(W.partitionBy("part").orderBy("block")) - F.col("n_ids")
    return sizes.withColumn("inside", inside).join(before, "part").select("part", "block", (F.col("part_first") + F.col("inside")).alias("first"))


def read_documents(store: DataFrame) -> DataFrame:
    """Read the files back: doc_id, start, n_tokens, ids_crc32 of each document."""

    def run(batches: Iterator) -> Iterator[dict]:
        for batch in rows(batches, 1):
            for row in batch.to_pylist():
                raw = memoryview(Block(row["file"]).all().astype("<u4").tobytes())
                n = np.array(row["lengths"], dtype=np.int64)
                at = np.cumsum(n) - n
                yield {
                    "part": np.full(len(n), row["part"]),
                    "block": np.full(len(n), row["block"]),
                    "doc_id": row["doc_ids"],
                    "inside": at,
                    "n_tokens": n,
                    "ids_crc32": [zlib.crc32(raw[4 * a : 4 * (a + k)]) for a, k in zip(at.tolist(), n.tolist(), strict=True)],
                }

    found = map_batches(store, run, "part int, block int, doc_id long, inside long, n_tokens long, ids_crc32 long")
    return found.join(block_starts(store), ["part", "block"]).select("doc_id", (F.col("first") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32")


def document_index(store: DataFrame) -> DataFrame:
    """doc_id, part, block, at (its first place in the block) and n_tokens of every document. No file is read."""

    def run(batches: Iterator) -> Iterator[dict]:
        for batch in rows(batches, 16):
            for row in batch.to_pylist():
                n = np.array(row["lengths"], dtype=np.int64)
                yield {"doc_id": row["doc_ids"], "part": np.full(len(n), row["part"]), "block": np.full(len(n), row["block"]), "at": np.cumsum(n) - n, "n_tokens": n}

    return map_batches(store.select("part", "block", "doc_ids", "lengths"), run, "doc_id long, part int, block int, at long, n_tokens long")


def token_at(store: DataFrame, places: DataFrame) -> DataFrame:
    """doc_id, place, id: the token at each of ``places`` (doc_id, place from 0) by random access.

    Places beyond a document's end and unknown or null doc_ids give no row;
    repeated places give one. Where documents share a doc_id, each gives a row.
    Blocks that nothing is asked of are not read; of the others one chunk, one bit
    and one rank a level are, for each place.
    """
    asked = places.select("doc_id", "place").distinct().join(document_index(store), "doc_id").where("place >= 0 and place < n_tokens")
    # distinct places of a block, so no more than it has tokens
    lists = asked.groupBy("part", "block").agg(F.collect_list(F.struct("doc_id", "place", (F.col("at") + F.col("place")).alias("at"))).alias("asked"))

    def run(batches: Iterator) -> Iterator[dict]:
        for batch in rows(batches, 1):
            block, asked = Block(batch["file"][0].as_py()), batch["asked"][0].as_py()
            yield {"doc_id": [x["doc_id"] for x in asked], "place": [x["place"] for x in asked], "id": [block[x["at"]] for x in asked]}

    return map_batches(store.select("part", "block", "file").join(lists, ["part", "block"]).select("file", "asked"), run, "doc_id long, place long, id long")


def op8_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's ids, written to files and read back."""
    return read_documents(write_store(read(spark, sf_dir, "documents"), public_path("word_bpe_49k.json")))
