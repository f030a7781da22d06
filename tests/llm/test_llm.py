import hashlib
import random
import zlib
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from edgeloom.llm import components, embeddings, lines, media, minhash, mixing, packing, quality, scoring, token_store, tokens

DOCS = "doc_id long, text string, lang string, source string, n_chars long, key string, line int, n int, sampled string, component_id int"


def table(spark, texts):
    """Rows with extra columns whose names clash with inner ones."""
    made = [(k, t, "en", f"s{k % 3 if isinstance(k, int) else 0}", len(t or ""), "x", 1, 2, "y", 3) for k, t in texts]
    return spark.createDataFrame(made, DOCS).repartition(3)


def corpus(seed=1):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choices("abcdefghij", k=rng.randint(2, 8))) for _ in range(300)]
    prose = lambda n: " ".join(rng.choices(vocabulary, k=n)) + "."
    texts = [prose(rng.randint(1, 120)) for _ in range(40)]
    shared = prose(60)
    for k in range(0, 40, 4):
        texts.append(texts[k])  # exact
        words = texts[k].split()
        words[rng.randrange(len(words))] = "changed"
        texts.append(" ".join(words))  # near
        texts.append(prose(10) + " " + shared + "\n" + prose(9) + "\n" + texts[k])
    texts += ["", "é ü\n\nñ 😀", "One. Two! Three?\nFour", "a", "a", "x " * 3000]
    return [(i, t) for i, t in enumerate(texts)] + [(500, None), (None, "no id at all"), (3, texts[3])]


BYTE, WORD = (tokens.public_path(x) for x in ("byte_bpe_50k.json", "word_bpe_49k.json"))


@pytest.mark.parametrize("path", [BYTE, WORD])
def test_tokens_are_those_of_the_library(path):
    tok = tokens.WordTokenizer(path, capacity=50)
    texts = [t for _, t in corpus() if t] + ["  two  spaces \t tab\n\n x", "it's we'll 's 't x", "\x1cx\x85y z", "<|endoftext|> a", "é ́x Å b c", " lead", "trail ", "w" * 200]
    for t in texts * 2:
        assert tok.encode(t).tolist() == tok.lib.encode(t, add_special_tokens=False).ids, t


def test_best_cuts_match_brute_force():
    rng = np.random.default_rng(0)
    for _ in range(30):
        pos = np.concatenate([[0], np.cumsum(rng.integers(1, 5, size=9))])
        penalty = rng.integers(0, 6, size=10)
        cost = lambda cuts: sum(8 - (pos[b] - pos[a]) + penalty[b] for a, b in zip(cuts, cuts[1:]))
        every = [[0, *c, 9] for k in range(9) for c in combinations(range(1, 9), k)]
        best = min(cost(c) for c in every if all(pos[b] - pos[a] <= 8 for a, b in zip(c, c[1:])))
        assert cost(packing.best_cuts(pos, penalty, 8)) == best


def test_packing(spark):
    texts = corpus()
    got = packing.pack(table(spark, texts), BYTE, max_tokens=64, lookahead=512, every=16).collect()
    tok = tokens.WordTokenizer(BYTE)
    want = sorted((np.append(tok.encode(t), [0]).astype("<u4").tobytes() for _, t in texts))
    by_doc, by_sequence = {}, {}
    for r in got:
        assert zlib.crc32(bytes(r.ids)) == r.ids_crc32 and len(r.ids) == 4 * r.length > 0
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
        by_doc.setdefault(r.doc_id, []).append((r.start, bytes(r.ids), r.doc_tokens))
    for pieces in by_sequence.values():
        at = 0
        for offset, n in sorted(pieces):
            assert offset == at
            at += n
        assert at <= 64
    whole = [b"".join(x[1] for x in sorted(v)) for k, v in by_doc.items() if k != 3]
    assert sorted(whole) == sorted(x for x in want if x != np.append(tok.encode(texts[3][1]), [0]).astype("<u4").tobytes())
    used = sum(r.length for r in got)
    assert used == sum(len(x) // 4 for x in want) and used > 0.9 * 64 * (len(by_sequence) - 4)
    assert packing.pack(table(spark, []), BYTE).count() == 0


def test_directly_addressable_codes(spark):
    rng = np.random.default_rng(1)
    for width in (8, 16):
        for ids in (np.zeros(0, dtype=np.uint32), rng.integers(0, 50_000, 5000), np.array([0, 255, 256, 2**32 - 1]), rng.integers(0, 2**32, 1500)):
            block = token_store.Block(token_store.encode_block(ids.astype(np.uint32), width))
            assert block.all().tolist() == ids.tolist() and [block[i] for i in range(len(block))] == ids.tolist()
    texts = corpus()
    tok = tokens.WordTokenizer(WORD)
    store = token_store.write_store(table(spark, texts), WORD, block_tokens=300)
    got = sorted(token_store.read_documents(store).collect(), key=lambda r: r.start)
    ordered = sorted(texts, key=lambda x: (x[0] is not None, x[0] or 0))
    at = 0
    for (k, t), r in zip(ordered, got, strict=True):
        ids = np.append(tok.encode(t), [2]).astype("<u4")
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (k, at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
    assert token_store.read_documents(token_store.write_store(table(spark, []), WORD)).count() == 0


def words4(text):
    import re

    w = re.findall(rb"[^\x20\x09-\x0d]+", (text or "").encode().lower())
    return {tuple(w[i : i + 4]) for i in range(len(w) - 3)} or ({tuple(w)} if w else set())


def groups(ids, links):
    label = {k: k for k in ids}
    changed = True
    while changed:
        changed = False
        for a, b in links:
            low = min(label[a], label[b])
            changed |= label[a] != low or label[b] != low
            label[a] = label[b] = low
    return label


def test_minhash_matches_brute_force(spark):
    texts = corpus()
    sets = {k: words4(t) for k, t in texts if k is not None}
    links = [(a, b) for a, b in combinations(sets, 2) if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    label = groups(sets, links)
    got = minhash.near_duplicates(table(spark, texts), words=4).collect()
    assert len(got) == len(texts)
    for r in got:
        if r.doc_id is not None:
            assert (r.n_shingles, r.component_id, r.kept) == (len(sets[r.doc_id]), label[r.doc_id], r.doc_id == label[r.doc_id])
        else:
            assert r.component_id is None and r.kept
    assert len(set(label.values())) < len(label) - 8
    assert minhash.near_duplicates(table(spark, [])).count() == 0
    assert minhash.near_duplicates(table(spark, [(1, None), (2, "")])).where("kept").count() == 2


def test_sketch_fills_and_estimates():
    rng = np.random.default_rng(2)
    for n in (1, 5, 50, 3000):
        s = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
        assert (minhash.sketch(s, 288) < np.iinfo(np.uint64).max).all()
    base = rng.integers(0, 2**63, 1000).astype(np.uint64)
    same = np.mean([(minhash.sketch(base[:900] + np.uint64(k), 288) == minhash.sketch(base[100:] + np.uint64(k), 288)).mean() for k in range(8)])
    assert abs(same - 0.8) < 0.04


def test_star_rounds_and_the_rest_agree(spark):
    base = [f"w{k}" for k in range(60)]
    rng = random.Random(3)
    texts = []
    for k in range(60):
        w = list(base)
        for _ in range(rng.randint(0, 3)):
            w[rng.randrange(60)] = f"v{rng.randrange(1000)}"
        texts.append((k, " ".join(w)))
    sets = {k: words4(t) for k, t in texts}
    label = groups(sets, [(a, b) for a, b in combinations(sets, 2) if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])])
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(table(spark, texts), words=4).collect()}
    assert got == label


def test_components(spark):
    rng = random.Random(4)
    links = [(rng.randrange(200), rng.randrange(200)) for _ in range(120)] + [(k, k + 1) for k in range(300, 340)] + [(7, 7), (None, 3)]
    real = [(a, b) for a, b in links if a is not None and a != b]
    label = groups({x for e in real for x in e}, real)
    got = components.connected_components(spark.createDataFrame(links, "a long, b long"))
    assert {r.node: r.component for r in got.collect()} == label and got.count() == len(label)
    assert components.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, v in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, w in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (v != w))
    return row[-1]


@pytest.mark.parametrize("edits,shortest", [(1, 8), (1, 2), (2, 4), (2, 1)])
def test_lines_match_brute_force(spark, edits, shortest):
    rng = random.Random(5)
    word = lambda: "".join(rng.choices("abc", k=2))
    pool = [" ".join(word() for _ in range(rng.randint(1, 12))) for _ in range(12)]
    for p in list(pool):
        for _ in range(edits):
            w = p.split()
            k = rng.randrange(len(w))
            made = [" ".join(w[:k] + w[k + 1 :]) or "z", " ".join([*w[:k], "new", *w[k:]]), " ".join([*w[:k], "sub", *w[k + 1 :]]), p.upper() + "  "]
            pool += made
            p = made[rng.randrange(3)]
    texts = [(k, "\n".join(rng.choices([*pool, "", "  "], k=6))) for k in range(60)] + [(90, None), (91, ""), (None, pool[0])]
    all_lines = [(k, i, [w.lower() for w in x.split()]) for k, t in texts if k is not None for i, x in enumerate((t or "").split("\n"))]
    all_lines = sorted(x for x in all_lines if x[2])
    gone = set()
    for i, (k, n, w) in enumerate(all_lines):
        for _, _, v in all_lines[:i]:
            if v == w or (min(len(v), len(w)) >= shortest and distance(v, w) <= edits):
                gone.add((k, n))
                break
    got = {(r.doc_id, r.line) for r in lines.duplicate_lines(table(spark, texts), shortest, edits).collect()}
    assert got == gone
    kept = {r.doc_id: r for r in lines.drop_duplicate_lines(table(spark, texts), shortest, edits).collect()}
    for k, t in texts:
        want = None if t is None else "\n".join(x for i, x in enumerate(t.split("\n")) if (k, i) not in gone)
        assert kept[k].text == want
    assert lines.drop_duplicate_lines(table(spark, [])).count() == 0


def test_within():
    rng = random.Random(4)
    for _ in range(2000):
        a, b = (rng.choices("ab", k=rng.randint(0, 6)) for _ in range(2))
        for most in (0, 1, 2):
            assert lines.within(a, b, most) == (distance(a, b) <= most), (a, b)


def test_within_one():
    for a, b, same in (("", "", True), ("a", "", True), ("a b c", "a c", True), ("a b c", "a x c", True), ("a b c", "a x y", False), ("a b", "b a", False), ("a b c d", "a b", False)):
        assert lines.within_one(a.split(), b.split()) is same


def test_media_round_trip(spark):
    texts = corpus() + [(700, "".join(random.Random(6).choices("abcdefgh ", k=120_000)))]
    texts.append((701, "zz" + texts[-1][1]))
    got = {r.doc_id: r for r in media.store_and_read(table(spark, texts)).collect()}
    assert len(got) == len(texts) - 1
    for k, t in texts:
        raw = (t or "").encode()
        payload = raw + bytes(max(64, -(-len(raw) // 64) * 64) - len(raw))
        r = got[k]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        samples = list(payload)
        mean = sum(samples) / len(samples)
        spread = (sum((x - mean) ** 2 for x in samples) / len(samples)) ** 0.5
        shape, a, b, bins = r.feature.split(";")
        assert shape == f"{len(payload) // 64}x64" and abs(float(a) - mean) < 1e-4 and abs(float(b) - spread) < 1e-3
        assert bins == ",".join(str(sum(x // 16 == k for x in samples)) for k in range(16))
        assert (r.media_bytes, r.media_sha256) == (len(media.to_media(t)[1]), hashlib.sha256(media.to_media(t)[1]).hexdigest())
    shift = [set(d for d, _ in media.chunks_of(media.to_media(t)[1])) for _, t in texts[-2:]]
    assert len(shift[0] & shift[1]) > len(shift[0]) / 2
    assert media.store_and_read(table(spark, [])).count() == 0


def test_missing_chunk_raises(spark):
    docs = table(spark, [(1, "abc")])
    with pytest.raises(Exception, match="missing"):
        media.rebuild(media.recipes(docs), media.write_chunks(docs).where("false")).collect()


def test_embeddings_match_brute_force(spark):
    rng = np.random.default_rng(3)
    base = rng.standard_normal((60, 16))
    vectors = [*base, *(base[:20] + 0.12 * rng.standard_normal((20, 16))), *(base[:5] * 2), *base[:6]]
    made = [(k, v.tolist(), 0) for k, v in enumerate(vectors)] + [(900, None, 1), (901, [0.0] * 16, 1), (902, [float("nan")] * 16, 1), (903, [1.0, None], 1), (904, [], 1), (905, [1.0, 2.0], 0), (906, [2.0, 4.0], 0), (None, [1.0, 2.0], 0), (907, [float("inf"), 1.0], 0)]
    sound = {k: np.array(v) for k, v, _ in made if k is not None and v and None not in v and np.isfinite(v).all() and any(v)}
    cosine = lambda a, b: a @ b / np.sqrt((a @ a) * (b @ b))
    links = [(a, b) for a, b in combinations(sound, 2) if len(sound[a]) == len(sound[b]) and cosine(sound[a], sound[b]) >= 0.9]
    label = groups([k for k, _, _ in made if k is not None], links)
    got = embeddings.near_duplicates(spark.createDataFrame(made, "vec_id long, embedding array<double>, n int")).collect()
    assert len(got) == len(made)
    for r in got:
        if r.vec_id is not None:
            assert (r.n_links, r.component_id, r.kept) == (sum(r.vec_id in e for e in links), label[r.vec_id], r.vec_id == label[r.vec_id])
    assert embeddings.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_quality_holds_out_and_separates(spark):
    rng = random.Random(10)
    good = lambda: " ".join(rng.choices(["the", "river", "runs", "down", "slow", "hills,", "and", "stones."], k=rng.randint(20, 80)))
    bad = lambda: " ".join(rng.choices(["BUY!!", "NOW$$$", "###", "click&&&"], k=rng.randint(20, 80)))
    texts = [(k, good() if k % 4 else bad()) for k in range(200)]
    labels = spark.createDataFrame([(k, int(k % 4 > 0)) for k, _ in texts] + [(5000, 1), (None, 0), (7, None)], "doc_id long, quality int")
    more = [(300, None), (301, ""), (None, "x")]
    got = quality.classify(table(spark, texts + more), labels).collect()
    assert len(got) == len(texts) + 3 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got)
    assert all(r.held_out == (zlib.crc32(str("" if r.doc_id is None else r.doc_id).encode()) % 5 == 0) for r in got)
    held = [r for r in got if r.held_out and r.doc_id is not None and r.doc_id < 200]
    assert held and all(r.predicted == int(r.doc_id % 4 > 0) for r in held)
    wrong = labels.withColumn("quality", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, 1 - F.col("quality")).otherwise(F.col("quality")))
    again = {r.doc_id: r.score for r in quality.classify(table(spark, texts), wrong).collect()}
    assert all(abs(again[r.doc_id] - r.score) < 1e-9 for r in got if r.doc_id is not None and r.doc_id < 200)
    assert quality.classify(table(spark, []), labels).count() == 0
    assert {r.score for r in quality.classify(table(spark, texts[:3]), labels.where("false")).collect()} == {0.5}
    assert quality.accepted(table(spark, texts), labels).columns == table(spark, texts).columns


def test_mixing(spark):
    texts = corpus()
    out = mixing.mix(table(spark, texts)).collect()
    assert len(out) == len(texts) and all(0 <= r.probability <= 1 for r in out)
    total = sum(r.mix_tokens for r in out)
    assert abs(sum(r.mix_tokens * r.probability for r in out) / total - 0.8) < 0.02
    cells = spark.createDataFrame([(s, la, t, 10 + 7 * i) for i, (s, la, t) in enumerate((s, la, t) for s in "ab" for la in "xy" for t in "pq")], "source string, lang string, topic string, tokens long")
    raked = mixing.rake(cells, {"source": {"a": 0.7, "b": 0.3}, "lang": {"x": 0.5, "y": 0.5}, "topic": {"p": 0.2, "q": 0.8, "gone": 0.0}}, rounds=30).collect()
    for m, level, share in (("source", "a", 0.7), ("lang", "x", 0.5), ("topic", "p", 0.2)):
        assert abs(sum(r.weight for r in raked if r[m] == level) - share) < 1e-6
    assert mixing.mix(table(spark, [])).count() == 0
    assert mixing.drawn(table(spark, texts)).columns == table(spark, texts).columns


def test_scoring(spark):
    texts = corpus()
    got = scoring.score_texts(table(spark, texts), vocabulary=100).collect()
    fold = lambda k: zlib.crc32(str("" if k is None else k).encode()) % 7
    counts = {}
    for k, t in texts:
        for w in scoring.tokens_of(t):
            if fold(k) != 2:
                counts[w] = counts.get(w, 0) + 1
    n, v = sum(counts.values()), len(counts)
    want = sorted((-1 if k is None else k, fold(k) == 2, len(scoring.tokens_of(t)), sum(w in counts for w in scoring.tokens_of(t)), n, sum(np.log10((counts.get(w, 0) + 1) / (n + v + 1)) for w in scoring.tokens_of(t))) for k, t in texts)
    have = sorted((-1 if r.doc_id is None else r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score) for r in got)
    assert len(have) == len(want)
    for a, b in zip(have, want):
        assert a[:5] == b[:5] and abs(a[5] - b[5]) < 1e-8
    assert all(r.score < 0 and r.bits_per_byte > 0 for r in got)
    assert sum(r.score for r in got) > sum(r.base_score for r in got)
    assert scoring.score_texts(table(spark, [])).count() == 0


def test_raking_within_bounds_meets_the_margins(spark):
    tokens_ = {("a", "x", "p"): 4000, ("a", "x", "q"): 1500, ("a", "y", "p"): 900, ("a", "y", "q"): 1200, ("b", "x", "p"): 700, ("b", "x", "q"): 300, ("b", "y", "p"): 500, ("b", "y", "q"): 900}
    cells = spark.createDataFrame([(*k, n) for k, n in tokens_.items()], "source string, lang string, topic string, tokens long")
    targets = {"source": {"a": 0.6, "b": 0.4}, "lang": {"x": 0.5, "y": 0.5}, "topic": {"p": 0.5, "q": 0.5}}
    cut = {tuple(r)[:3]: r.probability for r in mixing.probabilities(mixing.rake(cells, targets), 0.55).collect()}
    gaps = []
    for i, m in enumerate(mixing.MARGINS):
        for level, goal in targets[m].items():
            gaps.append(abs(sum(n * cut[k] for k, n in tokens_.items() if k[i] == level) / sum(n * cut[k] for k, n in tokens_.items()) - goal))
    assert max(gaps) > 0.01
    within = mixing.materialize(mixing.bounded(cells, 0.55, targets), "within")
    assert abs(sum(r.tokens * r.probability for r in within.collect()) / 10_000 - 0.55) < 1e-3
    assert all(0 <= r.probability <= 1 for r in within.collect())
    for r in mixing.shares(within).collect():
        assert abs(r.goal - targets[r.margin][r.level]) < 1e-9 and abs(r.reach - r.goal) < 1e-9 and abs(r.achieved - r.goal) < 1e-3
    # a level with too few tokens gives all it has; the margin's others rise alike
    short = {r.level: r for r in mixing.shares(mixing.materialize(mixing.bounded(cells, 0.8, {"source": {"a": 0.5, "b": 0.5}}), "short")).collect() if r.margin == "source"}
    assert abs(short["b"].achieved - 2400 / 8000) < 1e-3 and abs(short["a"].achieved - 0.7) < 1e-3 and short["a"].goal == 0.5
    out = mixing.mix(table(spark, corpus()), within=False, rounds=4).collect()
    assert len(out) == len(corpus()) and mixing.mix(table(spark, []), within=False, rounds=4).count() == 0


def test_chunks_of_an_earlier_store_are_not_stored_again(spark):
    texts = corpus()
    digests = lambda store: [bytes(r.digest) for r in store.select("digest").collect()]
    early = media.write_chunks(table(spark, texts[:30]))
    first, added, every = digests(early), digests(media.write_chunks(table(spark, texts), early)), digests(media.write_chunks(table(spark, texts)))
    assert first and added and sorted(first + added) == sorted(every) and len(set(every)) == len(every)


def test_embeddings_of_extreme_size(spark):
    big, tiny = [1e160] * 8, [1e-200] * 8
    rows = [(1, big), (2, [*[1e160] * 7, -3e159]), (3, tiny), (4, [2e-200] * 8), (5, [1.0] * 8), (6, [5e-324] * 8), (7, [1.7e308] * 8)]
    got = {r.vec_id: (r.n_links, r.component_id) for r in embeddings.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    # the second is at a cosine of 0.89 to all but itself
    assert got == {2: (0, 2)} | {k: (5, 1) for k in (1, 3, 4, 5, 6, 7)}


def test_lines_of_texts_that_share_a_doc_id(spark):
    rows = [(1, "alpha beta\nsecond"), (5, "alpha beta\nown line"), (5, "unique first line\nanother")]
    got = sorted((r.doc_id, r.text, r.n_removed) for r in lines.drop_duplicate_lines(table(spark, rows)).collect())
    assert got == [(1, "alpha beta\nsecond", 0), (5, "own line", 1), (5, "unique first line\nanother", 0)]


def test_deletions_are_told_apart_and_joined_by_their_words():
    words = [b"a", b"b", b"a", b"c", b"b", b"b"]
    made, n = lines.Deletions(words), len(words)
    seen = {}
    for k in range(n):
        assert made.without(k) == lines.Deletions(words[:k] + words[k + 1 :]).all()
        seen.setdefault(made.without(k), set()).add(tuple(words[:k] + words[k + 1 :]))
        for j in range(k + 1, n):
            assert made.without_two(k, j) == lines.Deletions(words[:k] + words[k + 1 : j] + words[j + 1 :]).all()
    assert all(len(x) == 1 for x in seen.values()) and len(seen) == 5
    assert lines.Deletions([]).all() != lines.Deletions([b"a"]).all()


def test_a_line_of_very_many_words(spark):
    words = [f"w{k % 9973}x{k % 1009}" for k in range(300_000)]
    texts = [(1, " ".join(words)), (2, " ".join(words[:200_000] + ["other"] + words[200_001:])), (3, " ".join(words[:7] + words[8:])), (4, " ".join([*words[:5], "p", "q", *words[7:]]))]
    got = lines.duplicate_lines(table(spark, texts)).collect()
    assert {r.doc_id for r in got} == {2, 3}


def test_a_text_of_many_lines(spark):
    text = "\n".join(f"line {k // 2}" for k in range(100_000))
    got = lines.drop_duplicate_lines(table(spark, [(1, text), (2, "line 7\nown")])).orderBy("doc_id").collect()
    assert (got[0].n_lines, got[0].n_removed, got[1].text) == (100_000, 50_000, "own")
    assert got[0].text == "\n".join(f"line {k}" for k in range(50_000))


def test_tokens_by_random_access(spark):
    texts = [t for t in corpus() if t[0] not in (None, 3)]
    store = token_store.write_store(table(spark, texts), WORD, block_tokens=500)
    tok = tokens.WordTokenizer(WORD)
    ids = {k: [*tok.encode(t).tolist(), 2] for k, t in texts}
    rng = random.Random(2)
    asked = [(k, rng.randrange(-1, len(ids[k]) + 2)) for k in ids for _ in range(4)] + [(12345, 0), (None, 0)]
    got = {(r.doc_id, r.place): r.id for r in token_store.token_at(store, spark.createDataFrame(asked, "doc_id long, place long")).collect()}
    assert got == {(k, p): ids[k][p] for k, p in asked if k in ids and 0 <= p < len(ids[k])}


def test_a_chunk_that_very_many_files_share(spark):
    shared = "".join(random.Random(8).choices("abcdefgh ", k=3000))
    texts = spark.range(20_000).select(F.col("id").alias("doc_id"), F.concat(F.lit(shared), F.lit(" "), F.col("id").cast("string")).alias("text"))
    tables = {t.name for t in spark.catalog.listTables()}
    out = media.store_and_read(texts)
    assert out.count() == 20_000 and {t.name for t in spark.catalog.listTables()} == tables
    want = {k: hashlib.sha256((raw := f"{shared} {k}".encode()) + bytes(-len(raw) % 64)).hexdigest() for k in (0, 7, 19_999)}
    assert {r.doc_id: r.payload_sha256 for r in out.where("doc_id in (0, 7, 19999)").collect()} == want
