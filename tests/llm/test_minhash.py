import random
from itertools import combinations

import numpy as np

from edgeloom.llm import minhash

from .test_llm import groups, table, words4


def near(sets, percent=80):
    return [(a, b) for a, b in combinations(sorted(sets), 2) if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]


def test_rarest_shingles_reach_every_pair(spark):
    rng = random.Random(6)
    sets = {}
    for k in range(70):
        base = range(100 * (k % 3), 100 * (k % 3) + rng.randint(20, 60))
        sets[k] = {x if rng.random() < 0.93 else 1000 + rng.randrange(60) for x in base}
    made = spark.createDataFrame([(k, [int(x) for x in s], k) for k, s in sets.items()], "id long, s array<long>, component long")
    got = {tuple(sorted((r.a, r.b))) for r in minhash.rare_pairs(made, 80).collect()}
    want = set(near(sets))
    assert want and want <= got and len(got) < len(list(combinations(sets, 2)))


def test_pages_of_one_template_make_no_pairs(spark):
    template = list(range(820))
    made = [(k, template + list(range(10_000 + 1000 * k, 10_000 + 1000 * k + 180)), k) for k in range(300)]  # a similarity of 0.69
    frame = spark.createDataFrame(made, "id long, s array<long>, component long")
    assert minhash.rare_pairs(frame, 80).count() == 0
    assert minhash.rare_pairs(frame, 65).count() == 300 * 299 // 2


def test_open_buckets_end_in_the_same_components(spark):
    """Far more different members than rounds: stars of many centres in the same buckets."""
    rng = random.Random(12)
    base = [f"w{k}" for k in range(40)]
    texts = []
    for k in range(120):
        w = list(base)
        for _ in range(rng.randint(0, 4)):
            w[rng.randrange(40)] = f"v{rng.randrange(400)}"
        texts.append((k, " ".join(w)))
    sets = {k: words4(t) for k, t in texts}
    label = groups(sets, near(sets))
    assert len(set(label.values())) > 10
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(table(spark, texts), words=4).collect()}
    assert got == label


def test_texts_that_share_a_doc_id_are_judged_each(spark):
    a, b = (" ".join(f"{x}{k}" for k in range(50)) for x in "ab")
    rows = [(1, a), (5, a + " end"), (5, b), (7, b + " end")]
    got = sorted((r.doc_id, r.component_id) for r in minhash.near_duplicates(table(spark, rows), words=4).collect())
    assert got == [(1, 1), (5, 1), (5, 5), (7, 5)]
    kept = sorted((r.doc_id, r.text) for r in minhash.one_of_each(table(spark, rows)).collect())
    assert kept == [(1, a), (5, b)]


def test_sets_without_shared_elements(spark):
    frame = spark.createDataFrame([(1, [1, 2], 1), (2, [3], 2)], "id long, s array<long>, component long")
    assert minhash.rare_pairs(frame, 80).count() == 0
    assert np.array_equal(minhash.shingles("a B", 4), minhash.shingles("A b", 4))
