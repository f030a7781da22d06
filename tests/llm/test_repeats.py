import random

import numpy as np
import pytest

from edgeloom.llm import repeats

from .test_llm import corpus, table


def brute_repeats(texts, n):
    """By (doc_id, text): bytes, removed, spans and what is kept; texts of one id are in the order of their number."""
    seen, out = set(), {}
    for key, raw in texts:
        gone = np.zeros(len(raw), dtype=bool)
        for i in range(len(raw) - n + 1):
            s = raw[i : i + n]
            if s in seen:
                gone[i : i + n] = True
            seen.add(s)
        edges = int((np.diff(np.append(0, gone.astype(int))) == 1).sum())
        out[key] = (len(raw), int(gone.sum()), edges, bytes(np.frombuffer(raw, dtype=np.uint8)[~gone]))
    return out


def by_id(texts):
    return sorted({(k, (t or "").encode()) for k, t in texts if k is not None})


@pytest.mark.parametrize("most", [1 << 21, 300])
def test_repeats_match_brute_force(spark, most):
    texts = corpus() + [(800, "ab" * 400), (801, "c" * 500)]
    want = brute_repeats([(k, raw) for k, raw in by_id(texts)], 100)
    got = repeats.remove_repeats(table(spark, texts), merge_bytes=8192, most_bytes=most, shards=3).collect()
    assert len(got) == len(texts)
    for r in got:
        if r.doc_id is not None:
            assert (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) == want[r.doc_id], r.doc_id
    assert sum(r.n_removed for r in got) > 1000
    assert repeats.remove_repeats(table(spark, [])).count() == 0


def test_a_very_common_passage_is_split_by_its_next_grams(spark):
    rng = random.Random(4)
    prose = lambda n: "".join(rng.choices("abcdefgh ", k=n))
    passage = prose(140)
    texts = [(k, prose(rng.randint(0, 60)) + passage[: rng.randint(60, 140)] + prose(rng.randint(0, 80))) for k in range(90)]
    texts += [(200 + k, texts[k][1][5:]) for k in range(0, 90, 9)]
    want = brute_repeats(by_id(texts), 100)
    got = repeats.remove_repeats(table(spark, texts), merge_bytes=4096, most_bytes=500, shards=2).collect()
    assert all((r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) == want[r.doc_id] for r in got) and sum(r.n_removed for r in got) > 1000


def test_texts_that_share_a_doc_id_are_documents_of_their_own(spark):
    rng = random.Random(2)
    a, b = ("".join(rng.choices("abcdefgh", k=300)) for _ in range(2))
    got = {bytes(r.kept).decode() for r in repeats.remove_repeats(table(spark, [(1, a), (5, a), (5, b)])).collect()}
    assert got == {a, "", b}
    same = [r.n_removed for r in repeats.remove_repeats(table(spark, [(5, a), (5, a)])).collect()]
    assert same == [0, 0]


def common(a, b):
    n = 0
    while n < min(len(a), len(b)) and a[n] == b[n]:
        n += 1
    return n


@pytest.mark.parametrize("slow", [40, 4])
def test_merged_transforms_are_the_suffix_order(slow):
    rng = random.Random(8)
    shards = [[bytes(rng.choices(b"ab\x00", k=rng.randint(1, 30))) for _ in range(5)] for _ in range(4)]
    made = []
    for s in shards:
        order, symbols = repeats.suffix_order(s)
        parts = [(p[i:] + b"", k, i) for k, p in enumerate(s) for i in range(len(p) + 1)]
        key = lambda x: ([c + 1 for c in x[0]] + [0], x[1])
        assert [parts[i] for i in order] == sorted(parts, key=key)
        back = repeats.symbols_of(*repeats.transform_of(symbols))
        assert (back == symbols).all()
        made.append((back, np.array([len(p) for p in s])))
    places, prefix = repeats.merge_transforms(made, 40, slow)
    suffixes = [p[i:] for s in shards for p in s for i in range(len(p) + 1)]
    order = [[b + 1 for b in suffixes[p]] + [0] for p in places]
    assert sorted(places.tolist()) == list(range(len(suffixes))) and order == sorted(order)
    for i in range(1, len(places)):
        n = common(suffixes[places[i - 1]], suffixes[places[i]])
        step = max([x for x in (4, 8, 16, 32, 40) if x <= n], default=0)
        assert prefix[i] == (n if slow == 40 or n < slow else step)


def test_segments_of_long_texts(monkeypatch):
    raw = bytes(random.Random(9).choices(b"abcd ", k=5000))
    monkeypatch.setattr(repeats, "SEGMENT", 700)
    tiles = sorted((s, n) for _, s, n in repeats.stretches(raw, 100, 32))
    assert sum(n for _, n in tiles) == 4901 and all(a + n == b for (a, n), (b, _) in zip(tiles, tiles[1:]))


def test_next_grams_tile_a_piece():
    raw = bytes(random.Random(5).choices(b"ab", k=150))
    for level in (1, 5, 68):
        tiles = list(repeats.next_stretches(raw, 100, 32, level))
        assert sum(n for _, _, n in tiles) == 51 and [s for _, s, _ in tiles] == np.cumsum([0] + [n for _, _, n in tiles])[:-1].tolist()
