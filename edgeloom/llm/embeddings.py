"""Embedding near-duplicates by random-hyperplane sign hashing.

Each vector gets the signs of its products with random hyperplanes. Several
tables of ``bits`` signs each deal vectors into buckets; two vectors that meet
in a bucket are compared by an independent sketch of 256 signs, and what may
still reach the threshold is checked by its exact cosine. Links go through
distributed connected components.

Equal vectors are one row until the end. ``bits`` follows the logarithm of the
number of vectors, and the number of tables follows from the bits so that a
pair at the threshold is missed with a probability of at most ``miss``.

Scale: buckets hold ids alone; a bucket join is on (table, bucket), which
Spark splits when hot. With as many buckets in a table as vectors, chance
meetings grow with the number of tables, as n ** 1.2; sketches and vectors move for
the pairs that are left. Pairs of different vectors that are true links are all counted, so their
number bounds the work from below.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_batches, materialize, read, rows
from .components import connected_components

SKETCH = 256


@lru_cache(maxsize=8)
def _planes(dim: int, n: int, seed: int) -> np.ndarray:
    return np.random.default_rng([seed, dim]).standard_normal((dim, n))


def tables_for(cosine: float, bits: int, miss: float) -> int:
    """Tables so that a pair at ``cosine`` meets in none with at most ``miss``."""
    agree = (1 - math.acos(cosine) / math.pi) ** bits
    return max(1, math.ceil(math.log(miss) / math.log1p(-agree)))


def sketch_limit(cosine: float, deviations: float = 6.5) -> int:
    """Most differing sketch signs that a pair at ``cosine`` may show."""
    p = math.acos(cosine) / math.pi
    return math.ceil(SKETCH * p + deviations * math.sqrt(SKETCH * p * (1 - p)))


def near_duplicates(vectors: DataFrame, cosine: float = 0.9, miss: float = 1e-5, seed: int = 11) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row of ``vectors``.

    ``vectors`` has vec_id long and embedding array<float or double>. Cosines
    are taken in double precision; vectors whose largest component is beyond
    1e100 or under 1e-100 are divided by it first, so that no square overflows
    or vanishes. Vectors that are null, empty or zero, or hold
    null or non-finite components, link with nothing: n_links 0, a component of
    their own. Vectors of different lengths never link. A null vec_id links with
    nothing either; its component_id is null and it is kept. A vec_id that
    repeats is one vector to the components, and each row counts as a link of
    its equals. No rows give no rows.
    """
    base = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    sound = F.coalesce(F.exists("v", lambda x: x != 0) & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))
    largest = F.array_max(F.transform("v", F.abs))
    extreme = (largest > 1e100) | (largest < 1e-100)
    plain = F.when(extreme, F.transform("v", lambda x: x / largest + F.lit(0.0))).otherwise(F.transform("v", lambda x: x + F.lit(0.0)))  # -0.0 is 0.0
    good = base.where(sound & F.col("vec_id").isNotNull()).select("vec_id", plain.alias("v")).withColumn("key", F.sha2(F.array_join(F.transform("v", lambda x: x.cast("string")), ",").cast("binary"), 256))
    good = materialize(good, "vectors")
    classes = materialize(good.groupBy("key").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("copies"), F.any_value("v").alias("v")), "classes")
    n = classes.count()
    bits = max(8, math.ceil(math.log2(n + 1)))
    tables = tables_for(cosine, bits, miss)

    def hashed(batches: Iterator) -> Iterator[dict]:
        for batch in rows(batches, 1024):
            by_size: dict[int, list[int]] = {}
            for k, v in enumerate(vs := batch["v"].to_pylist()):
                by_size.setdefault(len(v), []).append(k)
            for dim, own in by_size.items():
                x = np.array([vs[k] for k in own])
                x = x / np.abs(x).max(axis=1, keepdims=True)
                signs = x @ _planes(dim, SKETCH + bits * tables, seed) > 0
                sketch = np.packbits(signs[:, :SKETCH], axis=1).view(">i8")
                weights = 1 << np.arange(bits, dtype=np.int64)
                bucket = signs[:, SKETCH:].reshape(len(own), tables, bits) @ weights
                # a table's number and the vector's length are part of its bucket
                bucket = (bucket * tables + np.arange(tables)) * 65_536 + dim % 65_536
                rep = batch["rep"].to_numpy(zero_copy_only=False)[own]
                yield {"rep": rep, "s": sketch.tolist(), "buckets": bucket.tolist()}

    sketched = materialize(map_batches(classes.select("rep", "v"), hashed, "rep long, s array<long>, buckets array<long>"), "sketches")
    flat = sketched.select("rep", F.explode("buckets").alias("bucket"))
    met = flat.join(flat.select("bucket", F.col("rep").alias("rep2")), "bucket").where("rep < rep2").select("rep", "rep2").distinct()
    left = sketched.select("rep", *[F.col("s")[k].alias(f"s{k}") for k in range(4)])
    right = sketched.select(F.col("rep").alias("rep2"), *[F.col("s")[k].alias(f"t{k}") for k in range(4)])
    apart = sum((F.bit_count(F.col(f"s{k}").bitwiseXOR(F.col(f"t{k}"))) for k in range(1, 4)), F.bit_count(F.col("s0").bitwiseXOR(F.col("t0"))))
    pairs = materialize(met.join(left, "rep").join(right, "rep2").where(apart <= sketch_limit(cosine)).select("rep", "rep2"), "met")

    one, two = classes.select("rep", "v", F.col("copies").alias("c1")), classes.select(F.col("rep").alias("rep2"), F.col("v").alias("v2"), F.col("copies").alias("c2"))

    def product(a: str, b: str):
        return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)

    exact = product("v", "v2") / (F.sqrt(product("v", "v")) * F.sqrt(product("v2", "v2")))
    links = pairs.join(one, "rep").join(two, "rep2").where((F.size("v") == F.size("v2")) & (exact >= cosine)).select(F.col("rep").alias("a"), F.col("rep2").alias("b"), "c1", "c2")
    links = materialize(links, "cosines")
    found = connected_components(links.select("a", "b")).withColumnRenamed("node", "rep")
    others = links.select(F.col("a").alias("rep"), F.col("c2").alias("n")).union(links.select("b", "c1")).groupBy("rep").agg(F.sum("n").alias("n"))
    of_class = classes.select("key", "rep", "copies").join(others, "rep", "left").join(found, "rep", "left")
    of_class = of_class.select("key", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    linked = good.select("vec_id", "key").join(of_class, "key").select("vec_id", "n_links", "component_id")
    alone = base.where(~sound | F.col("vec_id").isNull()).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.union(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


def op9_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All vectors with their links at a cosine of 0.9 or more."""
    return near_duplicates(read(spark, sf_dir, "embeddings"))


ORACLE = """
WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
ok AS (SELECT * FROM v WHERE len(list_filter(e, lambda x: x <> 0)) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.9),
reach AS (SELECT vec_id AS a, vec_id AS b FROM v UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
comp AS (SELECT a AS vec_id, min(b) AS component_id FROM reach GROUP BY 1),
n AS (SELECT a AS vec_id, count(*) AS n FROM links GROUP BY 1)
SELECT v.vec_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_links, component_id, v.vec_id = component_id AS kept
FROM v JOIN comp USING (vec_id) LEFT JOIN n USING (vec_id)
"""
