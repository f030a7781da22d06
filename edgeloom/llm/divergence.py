"""Audit of how sources of a language differ in their terms.

Each language keeps the terms of enough documents. A group (lang, source) gives
a kept term the smoothed probability ``p`` in units of 1e-9, the whole language
``q``; all arithmetic is on integers.

Terms that tell a group from its language come from an upper-bound search. A
group's terms are put into buckets by their count. The largest count of a bucket
and the smallest count that the language has for any of its terms bound p - q, so
buckets are opened best first: in each round every open group opens the next
ones, their terms are evaluated, and a group is done once the bounds of all its
unseen buckets are strictly below its k-th value (equal ones may still win by
the order of terms).

Pairs of sources come from postings. A term that neither source has adds the
same to every pair; one that a single source has is summed over that source's
counts of each size; only terms of both meet, in a term's posting. So absent
terms are never made.

Scale: texts are counted in their tasks, in tables that are let go when they are
full; one shuffle by (lang, term) brings partial counts together and settles
which terms are kept. A hot source or term is one row a task and flush. A posting
has a row for each source of the language, and the result a row for each two.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import forget, map_batches, materialize, read

ADDED, UNIT = 5, 1_000_000_000
#: Distinct (lang, source, term) that a task holds before it sends what it has.
HELD = 500_000
#: Sources of a language whose pairs are summed in one matrix (128 MB).
MATRIX = 4_096
#: Runs of letters and of bytes of characters beyond ASCII.
_terms = re.compile(rb"[a-z\x80-\xff]+").findall


def _share(n: Column, total: Column) -> Column:
    """1 + floor(1e9 * (n + 5) / total), by long division in steps of 1,000 that stay in 64 bits."""
    rest, out = n + F.lit(ADDED), F.lit(0).cast("long")
    for _ in range(3):
        rest = rest * 1000
        out = out * 1000 + F.call_function("div", rest, total)
        rest = rest % total
    return out + 1


def counts(docs: DataFrame) -> DataFrame:
    """lang, source, term, n, docs: partial counts of occurrences and documents; a row without a term for each group of a task."""

    def run(batches: Iterator) -> Iterator[dict]:
        found: dict[tuple[str, str], tuple[Counter, Counter]] = {}
        held = 0

        def out() -> Iterator[dict]:
            for (lang, source), (n, docs) in found.items():
                terms, every = list(n), len(n)
                for k in range(0, every, 50_000):
                    some = terms[k : k + 50_000]
                    yield {"lang": [lang] * len(some), "source": [source] * len(some), "term": pa.array(some, pa.binary()).cast(pa.string()), "n": [n[t] for t in some], "docs": [docs[t] for t in some]}
            groups = list(found)
            yield {"lang": [g[0] for g in groups], "source": [g[1] for g in groups], "term": [None] * len(groups), "n": [0] * len(groups), "docs": [0] * len(groups)}
            found.clear()

        for batch in batches:
            for lang, source, text in zip(batch["lang"].to_pylist(), batch["source"].to_pylist(), batch["text"].cast(pa.binary()).to_pylist(), strict=True):
                terms = _terms(text.lower())
                n, docs = found.setdefault((lang, source), (Counter(), Counter()))
                before = len(n)
                n.update(terms)
                docs.update(set(terms))
                held += len(n) - before
                if held >= HELD:
                    yield from out()
                    held = 0
        yield from out()

    clean = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")])
    return map_batches(clean, run, "lang string, source string, term string, n long, docs long")


def tables(docs: DataFrame, min_docs: int = 30) -> tuple[DataFrame, DataFrame]:
    """Two written tables. ``terms``: lang, source, term, n, lang_n, bucket of kept terms with n > 0.
    ``groups``: lang, source, total (N + 5 V), lang_total, v, zero (p of a term without occurrences) of every group.
    """
    parts = counts(docs).repartition("lang", "term")
    summed = parts.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    # a list holds the sources of one language that have the term
    terms = summed.groupBy("lang", "term").agg(F.collect_list(F.struct("source", "n")).alias("of"), F.sum("n").alias("lang_n"), F.sum("docs").alias("docs"))
    held = materialize(terms.where((F.col("docs") >= min_docs) | F.col("term").isNull()).select("lang", "term", "lang_n", F.explode("of").alias("o")).select("lang", "o.source", "term", "o.n", "lang_n").withColumn("bucket", F.when(F.col("n") > 0, F.floor(F.log2("n") * 4)).cast("int")).sortWithinPartitions("bucket"), "terms")
    kept = held.where("term is not null")
    sizes = held.groupBy("lang", "source").agg(F.sum("n").alias("n"))
    langs = kept.select("lang", "term", "lang_n").distinct().groupBy("lang").agg(F.count(F.lit(1)).alias("v"), F.sum("lang_n").alias("lang_n"))
    groups = sizes.join(langs, "lang", "left").na.fill(0, ["v", "lang_n"])
    total = lambda c: F.greatest(F.col(c) + ADDED * F.col("v"), F.lit(1))
    groups = groups.select("lang", "source", total("n").alias("total"), total("lang_n").alias("lang_total"), "v")
    return kept, materialize(groups.withColumn("zero", _share(F.lit(0).cast("long"), F.col("total"))), "groups")


def telling_terms(terms: DataFrame, groups: DataFrame, k: int = 50) -> DataFrame:
    """lang, source, item, value, rank: a group's ``k`` terms with the largest p - q above 0, ties by term.

    Upper-bound search in rounds; each reads the terms of the buckets it opens.
    """
    group = W.partitionBy("lang", "source")
    best = group.orderBy(F.desc("bound"), "bucket")
    buckets = terms.groupBy("lang", "source", "bucket").agg(F.count(F.lit(1)).alias("terms"), F.max("n").alias("n"), F.min("lang_n").alias("lang_n"))
    bound = _share(F.col("n"), F.col("total")) - _share(F.col("lang_n"), F.col("lang_total"))
    bounds = buckets.join(groups, ["lang", "source"]).select("lang", "source", "bucket", "terms", bound.alias("bound")).where("bound > 0")
    unseen = materialize(bounds.withColumn("before", F.sum("terms").over(best.rowsBetween(W.unboundedPreceding, -1))).na.fill(0, ["before"]), "bounds")
    top, upto = None, k
    while (ends := unseen.where(F.col("before") < upto).agg(F.min("bucket"), F.max("bucket")).first())[0] is not None or not unseen.isEmpty():
        if ends[0] is not None:
            opened = unseen.where(F.col("before") < upto).select("lang", "source", "bucket")
            seen = terms.where(F.col("bucket").between(ends[0], ends[1])).join(opened, ["lang", "source", "bucket"]).join(groups, ["lang", "source"])
            value = _share(F.col("n"), F.col("total")) - _share(F.col("lang_n"), F.col("lang_total"))
            found = seen.select("lang", "source", F.col("term").alias("item"), value.alias("value")).where("value > 0")
            found = found if top is None else found.unionByName(top.drop("rank"))
            ranked = found.withColumn("rank", F.row_number().over(group.orderBy(F.desc("value"), "item"))).where(F.col("rank") <= k)
            old, top = top, materialize(ranked, "top")
            forget(*([old] if old is not None else []))
        kth = top.where(F.col("rank") == k).select("lang", "source", F.col("value").alias("kth")) if top is not None else None
        left = unseen.where(F.col("before") >= upto)
        if kth is not None:
            left = left.join(kth, ["lang", "source"], "left").where("kth is null or bound >= kth").drop("kth")
        old, unseen = unseen, materialize(left, "bounds")
        forget(old)
        upto *= 16
    empty = "lang string, source string, item string, value long, rank int"
    return top if top is not None else terms.sparkSession.createDataFrame([], empty)


def _met(postings: DataFrame) -> DataFrame:
    """lang, source, item, value: over the terms of both sources, what their difference is more than if each had the term alone."""

    def run(batches: Iterator) -> Iterator[dict]:
        places: dict[str, dict[str, int]] = {}
        sums: dict[str, np.ndarray] = {}

        def out(lang: str) -> dict:
            names, m = list(places.pop(lang)), sums.pop(lang)
            i, j = np.nonzero(m[: len(names), : len(names)])
            return {"lang": [lang] * len(i), "source": [names[x] for x in i], "item": [names[x] for x in j], "value": m[i, j]}

        for batch in batches:
            for row in batch.to_pylist():
                lang, of = row["lang"], row["of"]
                p, zero = (np.array([x[c] for x in of], dtype=np.int64) for c in ("p", "zero"))
                for a in range(0, len(of), MATRIX // 2):
                    for b in range(0, len(of), MATRIX // 2):
                        i, j = slice(a, a + MATRIX // 2), slice(b, b + MATRIX // 2)
                        names = dict.fromkeys(x["source"] for x in (*of[i], *of[j]))
                        if lang in places and len(places[lang]) + len(names.keys() - places[lang]) > MATRIX:
                            yield out(lang)
                        at = places.setdefault(lang, {})
                        for s in names:
                            at.setdefault(s, len(at))
                        size = max(64, 1 << (len(at) - 1).bit_length())
                        if (m := sums.get(lang)) is None or len(m) < size:
                            grown = np.zeros((size, size), dtype=np.int64)
                            if m is not None:
                                grown[: len(m), : len(m)] = m
                            m = sums[lang] = grown
                        pi, zi, pj, zj = p[i, None], zero[i, None], p[j], zero[j]
                        more = np.abs(pi - pj) - np.abs(pi - zj) - np.abs(zi - pj) + np.abs(zi - zj)
                        m[np.ix_([at[x["source"]] for x in of[i]], [at[x["source"]] for x in of[j]])] += more
        for lang in list(places):
            yield out(lang)

    return map_batches(postings, run, "lang string, source string, item string, value long")


def source_pairs(terms: DataFrame, groups: DataFrame) -> DataFrame:
    """lang, source, item, value: the sum of |p - q| over all kept terms for every two sources of a language (both ways)."""
    one = groups.select("lang", "source", "v", F.col("zero").alias("a"))
    other = groups.select("lang", F.col("source").alias("item"), F.col("zero").alias("b"))
    pairs = one.join(other, "lang").where("source <> item")
    p = _share(F.col("n"), F.col("total"))
    # terms of a source against a source without them, by the source's counts of each size
    sizes = terms.groupBy("lang", "source", "n").agg(F.count(F.lit(1)).alias("terms")).join(groups, ["lang", "source"]).select("lang", "source", "terms", p.alias("p"), F.col("zero").alias("a"))
    alone = sizes.join(other, "lang").where("source <> item").groupBy("lang", "source", "item").agg(F.sum(F.col("terms") * (F.abs(F.col("p") - F.col("b")) - F.abs(F.col("a") - F.col("b")))).alias("value"))
    postings = terms.join(groups, ["lang", "source"]).select("lang", "term", F.struct("source", p.alias("p"), "zero").alias("o")).groupBy("lang", "term").agg(F.collect_list("o").alias("of")).select("lang", "of")
    more = _met(postings).where("source <> item").unionByName(alone).unionByName(alone.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), "value"))
    more = more.groupBy("lang", "source", "item").agg(F.sum("value").alias("more"))
    joined = pairs.join(more, ["lang", "source", "item"], "left")
    return joined.select("lang", "source", "item", (F.col("v") * F.abs(F.col("a") - F.col("b")) + F.coalesce("more", F.lit(0))).cast("long").alias("value"))


def audit(docs: DataFrame, min_docs: int = 30, k: int = 50) -> DataFrame:
    """lang, source, part, item, value, rank of ``docs`` (lang, source, text).

    Null lang, source and text are the empty text. Rows are documents, so repeated
    rows count each. Groups without kept terms have pairs (of value 0 where the
    language keeps none) and no terms; no rows give none. Other columns are
    ignored.
    """
    terms, groups = tables(docs, min_docs)
    pairs = source_pairs(terms, groups).withColumn("rank", F.row_number().over(W.partitionBy("lang", "source").orderBy(F.desc("value"), "item")))
    out = pairs.withColumn("part", F.lit("pair")).unionByName(telling_terms(terms, groups, k).withColumn("part", F.lit("term")))
    return out.select("lang", "source", "part", "item", "value", F.col("rank").cast("int").alias("rank"))


def op11_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources against their language (50 terms each) and against each other."""
    return audit(read(spark, sf_dir, "documents"))


ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
g AS (SELECT DISTINCT lang, source FROM d),
w AS (SELECT id, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
k AS (SELECT lang, term, count(*) AS n FROM w GROUP BY 1, 2 HAVING count(DISTINCT id) >= 30),
l AS (SELECT lang, count(*) AS v, sum(n) AS n FROM k GROUP BY 1),
c AS (SELECT lang, source, term, count(*) AS n FROM w SEMI JOIN k USING (lang, term) GROUP BY 1, 2, 3),
s AS (SELECT g.lang, g.source, coalesce(sum(c.n), 0) AS n FROM g LEFT JOIN c ON g.lang = c.lang AND g.source = c.source GROUP BY 1, 2),
p AS (SELECT s.lang, s.source, k.term, coalesce(c.n, 0) AS n, 1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 5)) // (s.n + 5 * l.v) AS p, 1 + (1000000000::HUGEINT * (k.n + 5)) // (l.n + 5 * l.v) AS q
      FROM s JOIN l ON s.lang = l.lang JOIN k ON k.lang = s.lang LEFT JOIN c ON c.lang = s.lang AND c.source = s.source AND c.term = k.term),
t AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY 1, 2, 3),
u AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(t.value, 0) AS BIGINT) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN t ON t.lang = a.lang AND t.source = a.source AND t.item = b.source
      UNION ALL SELECT lang, source, 'term', term, CAST(p - q AS BIGINT) FROM p WHERE n > 0 AND p > q),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM u)
SELECT lang, source, part, item, value, rank FROM r WHERE part = 'pair' OR rank <= 50
"""
