"""Media columns in a store of content-defined chunks.

A text's bytes become a grey image of 8-bit samples, 64 wide: a PGM header and
the bytes, padded with 0 to whole rows. A rolling gear hash over 32 bytes cuts
the file wherever its top bits are zero, so equal stretches give equal chunks
wherever they stand. Chunks are stored once by digest; an ordered chunk list
(the recipe) rebuilds each file, and each rebuilt file is checked against its
digest.

Scale: recipes hold digests only. Chunk bytes move once to meet their copies
(an aggregate by digest, which each task begins before it sends them) and once
to be rebuilt; the store is bucketed by digest, so the join that reads it back
does not move it: the store's chunks, one of each, are what a task holds, and
their uses stream past. A file that many rows share is rebuilt once. Rebuilding
streams chunk by chunk.
"""

from __future__ import annotations

import bz2
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import delete, map_batches, materialize, new_path, read, rows, without_shuffle_files

WIDTH = 64
#: A pseudo-random number for each byte value, by rule.
GEAR = np.array([int.from_bytes(hashlib.sha256(bytes([k])).digest()[:4], "little") for k in range(256)], dtype=np.uint32)
RECIPE = "doc_id long, n_bytes long, media_bytes long, media binary, chunks array<struct<digest: binary, n: int>>"


def to_media(text: str | None) -> tuple[int, bytes]:
    """Bytes of the text, and the file that holds them. Null is as empty."""
    raw = (text or "").encode("utf-8", "replace")
    rows_ = max(1, -(-len(raw) // WIDTH))
    return len(raw), b"P5\n%d %d\n255\n" % (WIDTH, rows_) + raw + bytes(rows_ * WIDTH - len(raw))


def cuts(data: bytes, bits: int = 12, least: int = 1024, most: int = 16384) -> list[int]:
    """Ends of the chunks of ``data``: about 2**bits bytes each, least to most."""
    h = GEAR[np.frombuffer(data, dtype=np.uint8)]
    for step in (1, 2, 4, 8, 16):  # after each, h covers twice as many bytes
        older = h[:-step] << np.uint32(step)
        h = h.copy()
        h[step:] += older
    places = (np.flatnonzero(h >> np.uint32(32 - bits) == 0) + 1).tolist()
    out, last, n = [], 0, len(data)
    for p in [*places, n]:
        while p - last > most:
            last += most
            out.append(last)
        if p - last >= least or (p == n and p > last):
            out.append(p)
            last = p
    return out


def chunks_of(data: bytes) -> Iterator[tuple[bytes, bytes]]:
    start = 0
    for end in cuts(data):
        part = data[start:end]
        yield hashlib.sha256(part).digest(), part
        start = end


def recipes(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, media_bytes, media (digest of the file) and its ordered chunk list."""

    def run(batches: Iterator) -> Iterator[dict]:
        for batch in rows(batches):
            made = [to_media(t) for t in batch["text"].to_pylist()]
            yield {
                "doc_id": batch["doc_id"],
                "n_bytes": [n for n, _ in made],
                "media_bytes": [len(x) for _, x in made],
                "media": [hashlib.sha256(x).digest() for _, x in made],
                "chunks": [[{"digest": d, "n": len(p)} for d, p in chunks_of(x)] for _, x in made],
            }

    return materialize(map_batches(docs.select("doc_id", "text"), run, RECIPE), "recipes")


def write_chunks(docs: DataFrame, known: DataFrame | None = None, name: str | None = None, path: str | None = None) -> DataFrame:
    """Store each chunk of ``docs`` once; returns the store (digest, packed), a table bucketed by digest.

    ``known`` may be an earlier store; chunks that it has are not stored again.
    The table is called ``name`` (by default a new one); its files are at ``path`` (by
    default in the shared folder). It stays until it is dropped and its files are deleted.
    """
    spark = docs.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def cut(batches: Iterator) -> Iterator[dict]:
        for batch in rows(batches):
            new = {}
            for t in batch["text"].to_pylist():
                new.update(chunks_of(to_media(t)[1]))
            yield {"digest": list(new), "packed": [bz2.compress(x) for x in new.values()]}

    sent = map_batches(docs.select("text"), cut, "digest binary, packed binary")
    once = sent.groupBy("digest").agg(F.first("packed").alias("packed"))
    if known is not None:
        once = once.join(known.select("digest"), "digest", "left_anti")
    name = name or f"chunks_{uuid.uuid4().hex}"
    with without_shuffle_files(spark):
        once.write.bucketBy(n, "digest").option("compression", "none").option("path", path or new_path(spark, "chunks")).saveAsTable(name)
    return spark.table(name)


def rebuild(recipe: DataFrame, store: DataFrame) -> DataFrame:
    """Read files back: media, payload_bytes, payload_sha256, tail_crc32, media_sha256, feature.

    One row for each distinct file. A missing chunk or a digest that differs
    raises: nothing unverified is returned.
    """
    lists = recipe.groupBy("media").agg(F.any_value("chunks").alias("chunks"), F.any_value("media_bytes").alias("media_bytes"))
    wanted = lists.select("media", "media_bytes", F.posexplode("chunks").alias("seq", "c")).select("media", "media_bytes", "seq", F.col("c.digest").alias("digest"))
    parts = wanted.join(store.hint("shuffle_hash"), "digest", "left").select("media", "media_bytes", "seq", "packed")

    def run(batches: Iterator) -> Iterator[dict]:
        now, state = None, None

        def begin(media: bytes, size: int) -> dict:
            return {"media": media, "left": size, "file": hashlib.sha256(), "payload": hashlib.sha256(), "head": b"", "rows": None, "n": 0, "tail": b"", "sum": 0, "squares": 0, "bins": np.zeros(16, dtype=np.int64)}

        def feed(s: dict, part: bytes) -> None:
            s["file"].update(part)
            s["left"] -= len(part)
            if s["rows"] is None:  # the header is three lines
                s["head"] += part
                if s["head"].count(b"\n") < 3:
                    return
                a, b, c, part = s["head"].split(b"\n", 3)
                s["rows"] = int(b.split()[1])
                if (a, b.split()[0], c) != (b"P5", b"%d" % WIDTH, b"255"):
                    raise ValueError("not a file of this store")
            s["payload"].update(part)
            s["n"] += len(part)
            s["tail"] = (s["tail"] + part)[-64:]
            counts = np.bincount(np.frombuffer(part, dtype=np.uint8), minlength=256)
            values = np.arange(256)
            s["sum"] += int(counts @ values)
            s["squares"] += int(counts @ (values * values))
            s["bins"] += counts.reshape(16, 16).sum(axis=1)

        def end(s: dict) -> tuple:
            if s["left"] or s["file"].digest() != s["media"] or s["n"] != s["rows"] * WIDTH:
                raise ValueError("a rebuilt file differs from its digest")
            mean = s["sum"] / s["n"]
            spread = max(0.0, s["squares"] / s["n"] - mean * mean) ** 0.5
            feature = f"{s['rows']}x{WIDTH};{mean:.4f};{spread:.4f};" + ",".join(map(str, s["bins"].tolist()))
            return s["media"], s["n"], s["payload"].hexdigest(), zlib.crc32(s["tail"]), s["file"].hexdigest(), feature

        names = ("media", "payload_bytes", "payload_sha256", "tail_crc32", "media_sha256", "feature")
        for batch in rows(batches):
            out = []
            for media, size, packed in zip(batch["media"].to_pylist(), batch["media_bytes"].to_pylist(), batch["packed"].to_pylist(), strict=True):
                if media != now:
                    if state:
                        out.append(end(state))
                    now, state = media, begin(media, size)
                if packed is None:
                    raise ValueError("a chunk is missing from the store")
                feed(state, bz2.decompress(packed))
            if out:
                yield dict(zip(names, zip(*out, strict=True), strict=True))
        if state:
            yield dict(zip(names, zip(*[end(state)], strict=True), strict=True))

    ordered = parts.repartition("media").sortWithinPartitions("media", "seq")
    return map_batches(ordered, run, "media binary, payload_bytes long, payload_sha256 string, tail_crc32 long, media_sha256 string, feature string")


def store_and_read(docs: DataFrame) -> DataFrame:
    """Store the texts of ``docs`` (doc_id long, text string) as media and read them back.

    Returns doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32,
    media_bytes, media_sha256 and feature, one row for each row of ``docs``;
    equal texts give equal values. Null and empty texts are a payload of 64
    bytes 0; a null doc_id is kept; no rows give no rows.
    """
    spark = docs.sparkSession
    recipe, name, path = recipes(docs), f"chunks_{uuid.uuid4().hex}", new_path(spark, "chunks")
    try:
        back = materialize(rebuild(recipe, write_chunks(docs, name=name, path=path)), "media")
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {name}")
        delete(spark, path)
    return recipe.select("doc_id", "n_bytes", "media_bytes", "media").join(back, "media").select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")


def op5_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, stored as chunked media and read back."""
    return store_and_read(read(spark, sf_dir, "documents"))
