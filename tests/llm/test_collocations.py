import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from edgeloom.llm import collocations as co

DOCS = "doc_id long, text string, lang string, word string, ids string, a int, key int, f int, rank string"


def rows(spark, texts):
    """Rows of (text, lang) with extra columns whose names clash with inner ones."""
    return spark.createDataFrame([(k, t, lang, "x", "y", 1, 2, 3, "z") for k, (t, lang) in enumerate(texts)], DOCS).repartition(3)


def brute(texts, at_least, percent, first):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    f, n, out = defaultdict(Counter), Counter(), []
    for t, lang in texts:
        for piece in re.split(r"[.,;:!?\n-\r]", (t or "").translate(lower)):
            w = re.findall(r"[^ \t]+", piece)
            n[lang or "und"] += len(w)
            f[lang or "und"].update(tuple(w[i : i + k]) for k in range(1, 6) for i in range(len(w) - k + 1))
    for lang, c in f.items():
        cand, found = {p: a for p, a in c.items() if len(p) > 1 and a >= at_least}, []
        for p, a in cand.items():
            if any(100 * b >= percent * a for q, b in cand.items() if len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1))):
                continue
            score, k = min((1000 * a * n[lang] // (c[p[:k]] * c[p[k:]]), k) for k in range(1, len(p)))
            found.append((-score, -a, " ".join(p).encode(), c[p[:k]], c[p[k:]]))
        out += [(lang, r + 1, p.decode(), -a, left, right, n[lang], -s) for r, (s, a, p, left, right) in enumerate(sorted(found)[:first])]
    return sorted(out)


def corpus(seed):
    rng = random.Random(seed)
    words = ["the", "The", "of", "New", "york", "a", "naïve", "日本", "x-y", "'s"] + ["".join(rng.choices("abc", k=2)) for _ in range(12)]
    texts = []
    for _ in range(150):
        w = rng.choices(words, weights=[9, 3, 7, 2, 2, 5, 1, 1, 1, 1] + [1] * 12, k=rng.randint(0, 40))
        for _ in range(rng.randint(0, 4)):
            w.insert(rng.randint(0, len(w)), rng.choice(["united states of america now", "new york", "the the the", "a b a b a b", "end. Of", "to,from", "tab\tbed\x0bline\nbreak"]))
        texts.append((" ".join(w), rng.choice(["en", "en", "de", None, "und"])))
    return texts + [(None, "en"), ("", "fr"), ("one two", "fr"), texts[0], texts[0], ("the of " * 400, "en"), ("same " * 300, "de")]


@pytest.mark.parametrize("seed,at_least,percent,first,split,holds,few", [(0, 5, 100, 2000, 1 << 17, 1 << 18, 400_000), (1, 4, 100, 20, 60, 40, 400_000), (2, 3, 60, 2000, 10, 8, 400_000), (3, 5, 100, 2000, 60, 1 << 18, 0), (4, 6, 100, 2000, 1 << 17, 16, 5)])
def test_against_brute_force(spark, monkeypatch, seed, at_least, percent, first, split, holds, few):
    texts = corpus(seed)
    monkeypatch.setattr(co, "HELD", 30)
    monkeypatch.setattr(co, "TOKENS", 200)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "37")
    try:
        got = co.collocations(rows(spark, texts), at_least, percent, first, split, holds, few)
        assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
        assert sorted(map(tuple, got.collect())) == brute(texts, at_least, percent, first)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def test_each_occurrence_of_a_phrase_has_one_owner():
    rng = np.random.default_rng(0)
    for _ in range(50):
        ids = rng.integers(-1, 6, 60).astype(np.int32)
        got, want = Counter(), Counter()
        for row in co.windows(ids).tolist():
            for x in range(5):
                for y in range(5 - x):
                    if x + y and min(part := row[4 - x : 5 + y]) >= 0:
                        got[tuple(part)] += 1
        for k in range(2, 6):
            want.update(tuple(p) for i in range(len(ids) - k + 1) if min(p := ids[i : i + k].tolist()) >= 0)
        assert got == want


def test_equal_hashes_do_not_merge_rows(monkeypatch):
    rows = np.array([[1, 2], [3, 4], [1, 2], [3, 4], [5, 6]], dtype=np.int32)
    monkeypatch.setattr(co, "hashes", lambda r: np.zeros(len(r), dtype=np.uint64))
    words, sums, which = co.grouped(rows, np.arange(5))
    assert sorted(zip(map(tuple, words.tolist()), sums.tolist(), strict=True)) == [((1, 2), 2), ((3, 4), 4), ((5, 6), 4)]
    assert (words[which] == rows).all()


def test_no_rows(spark):
    assert co.collocations(rows(spark, [])).count() == 0
    assert co.collocations(rows(spark, [("one two one two", "en")])).count() == 0
