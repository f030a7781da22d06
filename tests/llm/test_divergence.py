import random
import re
from collections import Counter, defaultdict

import pytest

from edgeloom.llm import divergence as dv

DOCS = "doc_id long, text string, lang string, source string, n long, term string, value long, rank int, item string"


def rows(spark, texts):
    """Rows of (text, lang, source) with extra columns whose names clash with inner ones."""
    return spark.createDataFrame([(k, t, lang, source, 7, "x", 1, 2, "y") for k, (t, lang, source) in enumerate(texts)], DOCS).repartition(3)


def brute(texts, min_docs, k):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    docs = [(re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (t or "").translate(lower)), lang or "", source or "") for t, lang, source in texts]
    out = []
    for lang in {d[1] for d in docs}:
        df, total, per = Counter(), Counter(), defaultdict(Counter)
        for words, own, source in docs:
            if own == lang:
                df.update(set(words))
                total.update(words)
                per[source].update(words)
        kept = [t for t in df if df[t] >= min_docs]
        v = len(kept)
        p = lambda c: (lambda n: {t: 1 + 10**9 * (c[t] + 5) // (n + 5 * v) for t in kept})(sum(c[t] for t in kept))
        q, of = p(total), {s: p(c) for s, c in per.items()}
        for s in of:
            pairs = [(-sum(abs(of[s][t] - of[o][t]) for t in kept), o) for o in of if o != s]
            terms = [(q[t] - of[s][t], t) for t in kept if per[s][t] > 0 and of[s][t] > q[t]]
            for part, found in (("pair", sorted(pairs, key=lambda x: (x[0], x[1].encode()))), ("term", sorted(terms, key=lambda x: (x[0], x[1].encode()))[:k])):
                out += [(lang, s, part, item, -value, rank + 1) for rank, (value, item) in enumerate(found)]
    return sorted(out)


@pytest.mark.parametrize("seed,min_docs,k", [(0, 3, 50), (1, 3, 4), (2, 6, 1), (3, 100, 5)])
def test_against_brute_force(spark, monkeypatch, seed, min_docs, k):
    rng = random.Random(seed)
    words = ["the", "Über", "a", "naïve", "x1y", "don't", "日本", "é"] + ["".join(rng.choices("abcde", k=3)) for _ in range(40)]
    texts = []
    for _ in range(120):
        lang, source = rng.choice(["en", "en", "de", None]), rng.choice(["s1", "s1", "s2", "s3", "é", None])
        own = words[:20] if source == "s1" else words
        texts.append((" ".join(rng.choices(own, k=rng.randint(0, 30))), lang, source))
    texts += [(None, "en", "empty"), ("", "fr", "a"), ("12 !!", "fr", "b"), (texts[0][0], "en", "s1"), (texts[0][0], "en", "s1"), ("word " * 3000, "en", "s2")]
    monkeypatch.setattr(dv, "HELD", 50)
    monkeypatch.setattr(dv, "MATRIX", 4)
    got = dv.audit(rows(spark, texts), min_docs, k)
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert sorted(map(tuple, got.collect())) == brute(texts, min_docs, k)


def test_equal_values_and_no_rows(spark):
    texts = [(f"common {w}", "en", s) for s, ws in (("a", ["zz", "yy", "xx"]), ("b", ["other"])) for w in ws for _ in range(2)]
    got = dv.audit(rows(spark, texts), 2, 2).where("part = 'term' and source = 'a'").orderBy("rank").collect()
    assert [(r.item, r.rank) for r in got] == [("xx", 1), ("yy", 2)]
    assert sorted(map(tuple, dv.audit(rows(spark, texts), 2, 2).collect())) == brute(texts, 2, 2)
    assert dv.audit(rows(spark, [])).count() == 0


def test_shares_are_exact_beyond_64_bits(spark):
    from pyspark.sql import functions as F

    for n, total in ((10**13, 3 * 10**13 + 7), (0, 6), (9 * 10**15, 9 * 10**15 + 5), (123456789012345, 987654321012345)):
        got = spark.range(1).select(dv._share(F.lit(n).cast("long"), F.lit(total).cast("long"))).first()[0]
        assert got == 1 + 10**9 * (n + 5) // total
