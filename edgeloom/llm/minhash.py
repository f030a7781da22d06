"""MinHash near-deduplication by fast similarity sketching.

A document is the set of its distinct word shingles. The sketch has one
coordinate for each of t bins. In round i < t every element goes to one hashed
bin with value i + fraction, in round t + i every element goes to bin i; a bin
keeps its least value, and rounds stop once all bins are filled. So every
coordinate is filled, after about t ln t / n rounds for n elements, and the
share of equal coordinates is concentrated around the Jaccard similarity as
for t independent hashes (Dahlgaard, Knudsen, Thorup, FOCS 2017).

Bands of ``per_band`` coordinates deal documents into buckets. Candidates are
verified on the full shingle sets before they link.

Scale: documents with equal sets are one row from the start. Within a bucket
not all pairs are made: rounds compare everyone with the least member (a
partial sum and a join that Spark can split), link what passes, and drop a
bucket once its members are one component. What is open after a few rounds is
joined exactly, whatever its size, by the rarest shingles of each set: sets that
reach the similarity share one of them (prefix and position filters; Bayardo et
al. 2007, Xiao et al. 2008). Pages of one template that stay below the similarity
make no pairs if the words of their own are rare. They do make pairs, up to all
within a bucket, if all their shingles come from one common pool (texts put together
from the same 60 sentences): then no shingle is rare, and each pair is verified on
both full sets. Shingle sets are kept only for documents that share a bucket.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import forget, map_batches, materialize, read, rows, semi_join
from .components import connected_components

_M = [np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9), np.uint64(0xD6E8FEB86659FD93)]


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that scatters every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: str | None, words: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles of a whole text.

    A-Z are lower-cased and words are runs without ASCII white space. A text of
    fewer than ``words`` words is one shingle; one without words has none.
    """
    parts = (text or "").encode("utf-8", "replace").lower().split()
    n = len(parts)
    if not n:
        return np.zeros(0, dtype=np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, parts), dtype=np.uint64, count=n)
    k = min(words, n)
    total = np.full(n - k + 1, np.uint64(k))
    for j in range(k):
        total = _mix(total + h[j : n - k + 1 + j] * _M[j % 4])
    return np.unique(total)


def sketch(elements: np.ndarray, t: int) -> np.ndarray:
    """t coordinates of 64 bits, all filled; ``elements`` is not empty."""
    out = np.full(t, np.iinfo(np.uint64).max, dtype=np.uint64)
    n, done = len(elements), 0
    while done < 2 * t:
        several = min(max(1, int(t * (np.log(t) + 1) / n)), max(t - done, 1), 64)
        i = np.arange(done, done + several, dtype=np.uint64)[:, None]
        h = _mix(elements[None, :] ^ _mix(i + _M[0]))
        if done < t:
            bins = (h % np.uint64(t)).ravel()
        else:  # round t + k fills bin k
            bins = np.repeat(np.arange(done - t, done - t + several), n)
        value = ((i << np.uint64(48)) | (_mix(h) >> np.uint64(16))).ravel()
        np.minimum.at(out, bins.astype(np.int64), value)
        done += several
        if int(out.max()) >> 48 < done:  # what later rounds could place is larger
            break
    return out


def signatures(docs: DataFrame, words: int, bands: int, per_band: int) -> DataFrame:
    """doc_id, text_key, n_shingles, set_id (from a digest of the set), band_keys."""
    salt = np.arange(bands, dtype=np.uint64)

    def run(batches: Iterator) -> Iterator[dict]:
        for batch in rows(batches):
            n, key, keys = [], [], []
            for text in batch["text"].to_pylist():
                s = shingles(text, words)
                n.append(len(s))
                key.append(_set_id(_set_key(s)))
                if len(s):
                    c = sketch(s, bands * per_band).reshape(bands, per_band)
                    k = _mix(salt + _M[1])
                    for j in range(per_band):
                        k = _mix(k ^ (c[:, j] * _M[j % 4]))
                    keys.append(k.view(np.int64).tolist())
                else:
                    keys.append([])
            yield {"doc_id": batch["doc_id"], "text_key": batch["text_key"], "n_shingles": n, "set_id": key, "band_keys": keys}

    named = docs.select("doc_id", "text", text_key().alias("text_key"))
    return map_batches(named, run, "doc_id long, text_key long, n_shingles long, set_id long, band_keys array<long>")


def _sets(docs: DataFrame, words: int) -> DataFrame:
    def run(batches: Iterator) -> Iterator[dict]:
        for batch in rows(batches):
            sets = [shingles(t, words) for t in batch["text"].to_pylist()]
            yield {"id": [_set_id(_set_key(s)) for s in sets], "s": [s.view(np.int64) for s in sets]}

    return map_batches(docs.select("text"), run, "id long, s array<long>")


def _set_key(s: np.ndarray) -> bytes | None:
    return xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None


def _set_id(key: bytes | None) -> int | None:
    return None if key is None else int.from_bytes(key[:8], "little", signed=True)


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """ca and cb of the pairs (a, b, ca, cb) whose full sets reach the similarity."""
    one, two = sets.select(F.col("id").alias("a"), F.col("s").alias("s1")), sets.select(F.col("id").alias("b"), F.col("s").alias("s2"))
    both = pairs.join(two, "b").join(one, "a").withColumn("common", F.size(F.array_intersect("s1", "s2")))
    return both.where(100 * F.col("common") >= percent * (F.size("s1") + F.size("s2") - F.col("common"))).select("ca", "cb").distinct()


def rare_pairs(sets: DataFrame, percent: int) -> DataFrame:
    """a, b, ca, cb, with every pair of ``sets`` (id, s, component) of two components that may reach the similarity.

    Elements are in the order of how many sets have them, rarest first. Sets of
    n <= m elements that reach t share c >= t / (1 + t) * (n + m) of them, so the
    first they share is among the first n - c + 1 of one and m - c + 1 of the
    other, where c is at least 2 t / (1 + t) * n and at least t * m.
    """
    flat = materialize(sets.select("id", "component", F.size("s").alias("n"), F.explode("s").alias("x")), "elements")
    often = flat.groupBy("x").agg(F.count(F.lit(1)).alias("often")).where("often > 1")
    # what one set alone has comes first and joins nothing: only its number matters
    shared = flat.join(often, "x")
    at = F.row_number().over(W.partitionBy("id").orderBy("often", "x"))
    own = F.count(F.lit(1)).over(W.partitionBy("id"))
    placed = shared.withColumns({"at": at, "own": own}).withColumn("at", F.col("at") + F.col("n") - F.col("own"))
    t = F.lit(percent)
    n = F.col("n")
    small = n - F.ceil(2 * t * n / (100 + t)) + 1
    large = n - F.ceil(t * n / 100) + 1
    placed = materialize(placed.select("x", "id", "n", "at", "component", (F.col("at") <= small).alias("small")).where(F.col("at") <= large), "rarest")
    one = placed.where("small").select("x", F.col("id").alias("a"), "n", F.col("at").alias("i"), F.col("component").alias("ca"))
    two = placed.select("x", F.col("id").alias("b"), F.col("n").alias("m"), F.col("at").alias("j"), F.col("component").alias("cb"))
    order = (F.col("n") < F.col("m")) | ((F.col("n") == F.col("m")) & (F.col("a") < F.col("b")))
    reach = 1 + F.least(F.col("n") - F.col("i"), F.col("m") - F.col("j"))
    may = (100 * F.col("n") >= t * F.col("m")) & ((100 + t) * reach >= t * (F.col("n") + F.col("m")))
    forget(flat)
    return one.join(two, "x").where(order & (F.col("ca") != F.col("cb")) & may).select("a", "b", "ca", "cb").distinct()


def link_sets(docs: DataFrame, members: DataFrame, words: int, percent: int, star_rounds: int = 2) -> DataFrame:
    """id, component of every set in ``members`` (bucket, id, n); ids are those of ``_set_id``.

    Every two sets that share a bucket end in one component if they reach the
    similarity, and no others do unless through such links. ``star_rounds``
    changes the way, not the result. What a round links are components of the
    rounds before, so each search for components is among fewer nodes.
    """
    members = materialize(members, "members")
    state = materialize(members.select("id", F.col("id").alias("component")).distinct(), "ids")
    own = docs.select("text", "set_id").withColumnRenamed("set_id", "id")
    sets = materialize(_sets(semi_join(own, state, ["id"]).dropDuplicates(["id"]), words), "sets")
    left = members.withColumn("component", F.col("id"))
    near = 100 * F.least("n", "m") >= percent * F.greatest("n", "m")
    for turn in range(star_rounds + 1):
        stats = left.groupBy("bucket").agg(F.min(F.struct("id", "n", "component")).alias("first"), F.min("component").alias("lo"), F.max("component").alias("hi"))
        open_ = stats.where("lo <> hi").select("bucket", F.col("first.id").alias("a"), F.col("first.n").alias("m"), F.col("first.component").alias("ca"))
        left = materialize(left.join(open_, "bucket"), "open")
        if left.isEmpty():
            break
        if turn == star_rounds:
            open_ids = materialize(left.select("id", "component").distinct(), "open")
            pairs = rare_pairs(sets.join(open_ids, "id"), percent)
        else:
            pairs = left.where("id <> a").select("a", F.col("id").alias("b"), "ca", F.col("component").alias("cb"), "n", "m").where((F.col("ca") != F.col("cb")) & near).select("a", "b", "ca", "cb").distinct()
        new = materialize(_verified(pairs, sets, percent), "verified")
        if not new.isEmpty():
            merged = connected_components(new.select(F.col("ca").alias("a"), F.col("cb").alias("b")))
            state = state.join(merged.select(F.col("node").alias("component"), F.col("component").alias("into")), "component", "left")
            state = materialize(state.select("id", F.coalesce("into", "component").alias("component")), "labels")
        rest = left.where("id <> a").select("bucket", "id", "n")  # the first has met everyone
        left = rest.join(state, "id").select("bucket", "id", "n", "component")
    forget(sets)
    return state


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80, bands: int = 48, per_band: int = 6) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of ``docs`` (doc_id long, text string).

    Documents link if ``100 * intersection >= percent * union`` of their
    shingle sets; at 80 percent a linking pair is missed with a probability of
    under 1e-6. component_id is the least doc_id that links reach.

    Texts without words, null texts included, have an empty set and link with
    nothing. A null doc_id links with nothing: its component_id is null and it
    is kept. Rows that repeat a doc_id are judged each by its own set. No rows
    give no rows.
    """
    return _judged(docs, words, percent, bands, per_band).drop("text_key")


def _judged(docs: DataFrame, words: int, percent: int, bands: int, per_band: int) -> DataFrame:
    docs = docs.select("doc_id", "text")
    signed = materialize(signatures(docs, words, bands, per_band), "signatures")
    full = signed.where("set_id is not null and doc_id is not null")
    reps = materialize(full.groupBy("set_id").agg(F.min("doc_id").alias("first"), F.any_value("n_shingles").alias("n"), F.any_value("band_keys").alias("band_keys")), "sets")
    flat = reps.select(F.explode("band_keys").alias("bucket"), F.col("set_id").alias("id"), "n")
    shared = flat.groupBy("bucket").agg(F.count(F.lit(1)).alias("size")).where("size > 1").select("bucket")
    members = materialize(flat.join(shared, "bucket"), "members")
    # a text for each set that shares a bucket: one of its first document's
    wanted = materialize(members.select(F.col("id").alias("set_id")).distinct(), "wanted")
    firsts = signed.join(reps.select("set_id", F.col("first").alias("doc_id")), ["set_id", "doc_id"], "left_semi").select("set_id", "doc_id", "text_key")
    firsts = materialize(firsts.join(wanted, "set_id", "left_semi").dropDuplicates(["set_id"]), "firsts")
    known = semi_join(docs, firsts, ["doc_id"]).withColumn("text_key", text_key()).join(firsts, ["doc_id", "text_key"]).select("text", "set_id")
    labels = link_sets(known, members, words, percent)
    named = reps.select("set_id", "first").join(labels.withColumnRenamed("id", "set_id"), "set_id", "left").withColumn("component", F.coalesce("component", "set_id"))
    least = named.groupBy("component").agg(F.min("first").alias("component_id"))
    names = named.join(least, "component").select("set_id", "component_id")
    out = signed.select("doc_id", "n_shingles", "text_key", F.when(F.col("doc_id").isNotNull(), F.col("set_id")).alias("set_id")).join(names, "set_id", "left")
    component = F.coalesce("component_id", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"), "text_key")


def text_key() -> Column:
    return F.xxhash64(F.coalesce("text", F.lit("")))


def one_of_each(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """Rows of ``docs`` but for near-duplicates of a document with a smaller id.

    Rows that repeat a document, text and all, are judged alike: they go or stay together.
    """
    gone = _judged(docs, words, percent, 48, 6).where("not kept").select("doc_id", F.col("text_key").alias("_text_key"))
    gone = materialize(gone.distinct(), "gone")
    return semi_join(docs.withColumn("_text_key", text_key()), gone, ["doc_id", "_text_key"], how="left_anti").select(*docs.columns)


def op3_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents by four-word shingles at a similarity of 0.8 or more."""
    return near_duplicates(read(spark, sf_dir, "documents"), words=4)


ORACLE = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, CAST(len(w) AS BIGINT) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) END) AS s FROM w),
e AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS c FROM e a JOIN e b ON a.x = b.x AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p WHERE 100 * c >= 80 * (na + nb - c)),
r AS (SELECT doc_id AS a, doc_id AS b FROM w UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
m AS (SELECT a AS doc_id, min(b) AS component_id FROM r GROUP BY 1)
SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, component_id, doc_id = component_id AS kept FROM s JOIN m USING (doc_id)
"""
