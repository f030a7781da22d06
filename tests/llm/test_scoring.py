import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa

from edgeloom.llm import scoring as sc

from .test_llm import corpus, table


def fold(k):
    return zlib.crc32(str("" if k is None else k).encode()) % 7


def lexicon_of(counts, most):
    """Words above the least sixteenth of an octave of counts that leaves ``most`` at most."""
    bars, n, least = Counter(math.floor(math.log2(c) * 16) for c in counts.values()), 0, math.inf
    for step in sorted(bars, reverse=True):
        n += bars[step]
        if n > most:
            break
        least = step
    words = sorted((w for w, c in counts.items() if math.floor(math.log2(c) * 16) >= least), key=lambda w: (-counts[w], w))
    return words, np.array([counts[w] for w in words], dtype=float)


def events(text, lex, told, paths, learn):
    """Of each bit of a text: predictions, gate, kind; and the natural log of what is not bits. Token by token."""
    index, rest = lex.index, 0.0
    own = defaultdict(lambda: [0, 0])
    last = defaultdict(list)
    at, times, out = {}, Counter(), []
    node_n, node_mass = Counter(), Counter()
    common = None
    clip = lambda p: min(max(p, 1e-5), 1 - 1e-5)
    stretch = lambda p: math.log(clip(p) / (1 - clip(p)))

    def mine(kind, name, context, bit):
        zeros, ones = own[kind, name, context]
        x = math.log((ones + 0.4) / (zeros + 0.4))
        own[kind, name, context][bit] += 1
        return x if bit else -x

    def put(kind, bit, small, given, gate):
        past = sum(b << (3 - k) for k, b in enumerate(last[kind][-1:-5:-1]))
        x = [mine(kind, "past", past, bit), mine(kind, "small", small, bit) if small is not None else 0.0, given]
        last[kind].append(int(bit))
        out.append((x, gate, kind))

    def counted(context, path, d):
        """Training counts under the first d and d + 1 bits of a path, the token itself left out."""
        under = [sum(n for p, n in paths[context].items() if p[:k] == path[:k]) - learn for k in (d, d + 1)]
        return under

    for i, w in enumerate(text):
        one, two = (text[i - 1] if i else None), (text[i - 2] if i > 1 else None)
        age = min(int(math.log2(i + 1)), 15)
        seen, rare = w in times, w not in index
        matched = False
        if one in at:
            guess, met = text[at[one] + 1], min(times[one] - 1, 3)
            matched = guess == w
            put(0, matched, met, 0.0, int(met > 1))
        if not matched:
            context = one if one in index else ("c", common)
            code = [] if seen or rare else [int(lex.code[index[w]]) >> (lex.most - 1 - k) & 1 for k in range(min(int(lex.size[index[w]]), sc.CODED))]
            path = (1,) if seen else (0, 1) if rare else (0, 0, *code)
            n, m = counted(context, path, 0)
            put(1, seen, None, stretch((m + 0.4) / (n + 0.8)), 2 + (age >= 6))
            if not seen:
                after = Counter(told[two, one])
                after[w] -= learn
                called = lambda x: index.get(x, (sc.xxhash.xxh3_64_intdigest(x) & (1 << sc.NAME) - 1) | 1 << sc.NAME - 1)
                after = sorted(((-n, called(x), x) for x, n in after.items() if n > 0))
                hit = False
                if after:
                    best, others = -after[0][0], -sum(n for n, _, _ in after[1:])
                    hit = after[0][2] == w
                    x = stretch((best + 0.4) / (best + others + 0.8))
                    strong, mixed = min(best, 3) - 1, min(others, 3)
                    put(2, hit, strong * 4 + mixed, x if hit else -x, 4 + strong * 2 + (mixed > 0))
                if not hit:
                    n, m = counted(context, path, 1)
                    put(3, rare, None, stretch((m + 0.4) / (n + 0.8)), 10 + (age >= 6))
                    if rare:
                        rest += math.log(lex.rare[w] / (1 - lex.chance.sum()))
                    else:
                        for j in range(len(code)):
                            mass = [lex.mass[j + k][index[w]] - node_mass[tuple(code[: j + k])] for k in (0, 1)]
                            p = clip(mass[1] / mass[0])
                            x0 = math.log(p / (1 - p))
                            a, b = node_n[tuple(code[:j])], node_n[tuple(code[: j + 1])]
                            x2 = math.log((b + 30 * p) / (a - b + 30 * (1 - p))) - x0 if j < sc.OWN else 0.0
                            a, b = counted(context, path, j + 2)
                            x1 = math.log((b + 3 * p) / (a - b + 3 * (1 - p))) - x0
                            deep = 0 if j < 2 else 1 if j < 4 else 2 if j < 6 else 3
                            out.append(([x0, x1, x2], sc.FIRST_CODE + 3 * deep + (a > 0) + (a > 20), 4))
                        left = lex.mass[len(code)][index[w]] - node_mass[tuple(code)]
                        rest += math.log(lex.chance[index[w]] / max(left, lex.chance[index[w]]))
            else:
                so_far = sum(lex.chance[index[x]] for x in times if x in index)
                prior = 0.0 if rare else sc.PRIOR * lex.chance[index[w]] / so_far
                rest += math.log((times[w] + prior) / (i + sc.PRIOR))
        if not seen and not rare:
            code = [int(lex.code[index[w]]) >> (lex.most - 1 - k) & 1 for k in range(min(int(lex.size[index[w]]), sc.CODED))]
            for j in range(len(code) + 1):
                node_n[tuple(code[:j])] += 1
                node_mass[tuple(code[:j])] += lex.chance[index[w]]
        if i:
            at[one] = i - 1  # an occurrence counts once the word after it is there
        times[w] += 1
        if index.get(w, sc.COMMON) < sc.COMMON:
            common = w
    return out, rest


def mixed_slowly(made):
    weights = np.array([sc.START] * sc.DECISIONS + [sc.START_CODE] * (sc.GATES - sc.DECISIONS))
    held, total = np.zeros((sc.KINDS, sc.BINS, 2)), 0.0
    ends = [32, 64, 128, 256, *range(512, len(made) + 512, 512)]
    for begin, end in zip([0, *ends], ends):
        step, seen = np.zeros_like(weights), np.zeros_like(held)
        for x, gate, kind in made[begin:end]:
            z = float(np.clip(np.dot(x, weights[gate]), -13, 13))
            p = 1 / (1 + math.exp(-z))
            step[gate] += sc.RATE * (1 - p) * np.array(x)
            if kind < sc.KINDS:
                spot = held[kind, min(int(abs(z) * 2), sc.BINS - 1)]
                sure = (spot[1] + sc.HOLD * max(p, 1 - p)) / (spot.sum() + sc.HOLD)
                seen[kind, min(int(abs(z) * 2), sc.BINS - 1), int(z >= 0)] += 1
                p = (p + (sure if z >= 0 else 1 - sure)) / 2
            total += math.log(p)
        weights, held = weights + step, held + seen
    return total


def slow_scores(texts, most):
    """log10 scores by plain counts and loops, one token at a time."""
    made = [(k, sc.tokens_of(t), fold(k) != 2) for k, t in texts]
    counts = Counter(w for _, t, learn in made if learn for w in t)
    floor = sum(counts.values()) + len(counts) + 1.0
    lex = sc.Lexicon(*lexicon_of(counts, most), floor)
    lex.rare = {w: (counts[w] + 1) / floor for _, t, _ in made for w in t if w not in lex.index}
    told, paths = defaultdict(Counter), defaultdict(Counter)
    for _, text, learn in made:
        at, seen, common = {}, set(), None
        for i, w in enumerate(text):
            one, two = (text[i - 1] if i else None), (text[i - 2] if i > 1 else None)
            if learn and not (one in at and text[at[one] + 1] == w):
                code = [int(lex.code[lex.index[w]]) >> (lex.most - 1 - k) & 1 for k in range(min(int(lex.size[lex.index[w]]), sc.CODED))] if w in lex.index else []
                paths[one if one in lex.index else ("c", common)][(1,) if w in seen else (0, 1) if w not in lex.index else (0, 0, *code)] += 1
                if w not in seen:
                    told[two, one][w] += 1
            if i:
                at[one] = i - 1
            seen.add(w)
            if lex.index.get(w, sc.COMMON) < sc.COMMON:
                common = w
    out = []
    for k, text, learn in made:
        bits, rest = events(text, lex, told, paths, int(learn))
        out.append((-1 if k is None else k, (mixed_slowly(bits) + rest) / math.log(10)))
    return sorted(out)


def test_scores_match_a_token_by_token_version(spark):
    rng = random.Random(7)
    words = [f"w{k}" for k in range(60)]
    texts = [(k, " ".join(rng.choices(words, weights=[1 / (j + 5) for j in range(60)], k=rng.randint(1, 90)))) for k in range(50)]
    texts += [(100 + k, texts[k][1]) for k in range(0, 50, 5)] + [(300, "only here x1 x2 x3 x2 x1 x2"), (301, None), (302, ""), (None, "w1 w2 no id"), (2, "w0 w1 w0 w1 w0 w1 w2 " * 6)]  # counts under 128 are exact
    want = slow_scores(texts, 30)
    got = sorted((-1 if r.doc_id is None else r.doc_id, r.score) for r in sc.score_texts(table(spark, texts), vocabulary=30).collect())
    assert len(got) == len(want)
    for a, b in zip(got, want):
        assert a[0] == b[0] and abs(a[1] - b[1]) < 1e-3 * (1 + abs(b[1])), (a, b)


def test_two_hops_give_the_scores_of_one(spark, monkeypatch):
    docs = table(spark, corpus()).repartition(7)
    one = sorted(map(tuple, sc.score_texts(docs, vocabulary=100).drop("bits_per_byte").collect()), key=str)
    monkeypatch.setattr(sc, "ONE_HOP", 3)
    two = sorted(map(tuple, sc.score_texts(docs, vocabulary=100).drop("bits_per_byte").collect()), key=str)
    assert len(one) == len(two) > 0
    assert all(a[:5] == b[:5] and abs(a[6] - b[6]) < 1e-6 * (1 + abs(a[6])) for a, b in zip(one, two))
    assert sc.score_texts(table(spark, [])).count() == 0


def test_what_a_batch_sends_does_not_grow_with_the_buckets():
    rng = np.random.default_rng(3)
    n, vocabulary = 1 << 18, 1 << 14
    counts = 1e6 / (np.arange(vocabulary) + 3)
    lex = sc.Lexicon([b"w%d" % k for k in range(vocabulary)], counts, counts.sum())
    word = rng.choice(vocabulary + 2000, n, p=(p := np.append(counts, np.full(2000, counts[-1]))) / p.sum())
    names = rng.integers(0, 1 << 63, 2000, dtype=np.uint64) * np.uint64(2)
    learn, sent = np.ones(512, dtype=bool), {}
    for power in (8, 14, 17):
        b = sc.Batch(np.full(512, n // 512), word, names, lex, power + sc.INNER)
        out = sc.Asked(b, power, power + sc.INNER, sc.hops(power)).columns(b, learn)
        sent[power] = len(out["bucket"]), sum(len(x) for k, v in out.items() if k != "bucket" for x in v)
    assert max(rows for rows, _ in sent.values()) <= 512
    assert sent[14][1] < 1.2 * sent[8][1] and sent[17][1] < 1.2 * sent[8][1], sent


def test_blocks_begin_short():
    assert [sc.block_end(k) for k in range(8)] == [32, 64, 128, 256, 512, 1024, 1536, 2048]


def test_scoring(spark):
    texts = corpus()
    got = sc.score_texts(table(spark, texts), vocabulary=100).collect()
    counts = Counter(w for k, t in texts if fold(k) != 2 for w in sc.tokens_of(t))
    n, v = sum(counts.values()), len(counts)
    want = sorted((-1 if k is None else k, fold(k) == 2, len(sc.tokens_of(t)), sum(w in counts for w in sc.tokens_of(t)), n, sum(np.log10((counts.get(w, 0) + 1) / (n + v + 1)) for w in sc.tokens_of(t))) for k, t in texts)
    have = sorted((-1 if r.doc_id is None else r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score) for r in got)
    assert len(have) == len(want)
    for a, b in zip(have, want):
        assert a[:5] == b[:5] and abs(a[5] - b[5]) < 1e-8
    assert all(r.score < 0 and r.bits_per_byte > 0 for r in got)
    assert sum(r.score for r in got) > sum(r.base_score for r in got)
    assert sc.score_texts(table(spark, [])).count() == 0
    alone = sc.score_texts(table(spark, [(3, "a b a"), (25, None)]).where(sc.held_out_fold(7, 9))).count()
    assert alone == 0


def test_a_corpus_without_training_texts(spark):
    held = [k for k in range(60) if fold(k) == 2][:3]
    got = sc.score_texts(table(spark, [(k, "a b a b c") for k in held])).collect()
    assert len(got) == 3 and all(r.n_known == 0 and r.train_tokens == 0 and r.base_score == 0 and r.score <= 0 for r in got)


def in_one_place(texts, learn, most):
    """Natural log scores of token lists, with all steps but Spark."""
    counts = Counter(w for t, on in zip(texts, learn) if on for w in t)
    floor = sum(counts.values()) + len(counts) + 1.0
    lex = sc.Lexicon(*lexicon_of(counts, most), floor)
    local = {}
    word = np.array([lex.index[w] if w in lex.index else len(lex.index) + local.setdefault(w, len(local)) for t in texts for w in t])
    names = np.array([sc.xxhash.xxh3_64_intdigest(w) for w in local], dtype=np.uint64)
    b = sc.Batch(np.array([len(t) for t in texts]), word, names, lex, 34)
    asked, learn = sc.Asked(b, 8, 34), np.array(learn)
    out = asked.columns(b, learn)
    given = pa.table({"batch": [0] * len(out["bucket"])} | out)
    back = [r for k in out["bucket"] for r in sc.answered(given.filter(pa.compute.equal(given["bucket"], k))).to_pylist()]
    return sc.score_batch(b, sc.Found.of(b, asked, back), learn, floor)[0]


def test_probabilities_of_a_next_token_sum_to_at_most_one():
    import pyarrow.compute  # noqa: F401

    rng = random.Random(5)
    words = [b"a", b"b", b"c", b"d", b"e", b"f", b"g", sc.END]
    training = [[*rng.choices(words[:-1], weights=[9, 7, 5, 3, 2, 1, 1], k=12), sc.END] for _ in range(30)]
    known = sorted({w for t in training for w in t})
    for past in ([], [b"a"], [b"a", b"b", b"a"], [b"a", b"g", b"a", b"c", b"g"], training[0][:6]):
        tried = [[*past, w] for w in known]
        scores = in_one_place([*training, *([past] if past else []), *tried], [True] * len(training) + [False] * (len(tried) + bool(past)), 5)
        before = scores[len(training)] if past else 0.0
        total = np.exp(scores[-len(tried) :] - before).sum()
        assert 0.2 < total <= 1 + 1e-4, past


def test_codes_are_free_of_prefixes_and_short():
    rng = random.Random(1)
    weights = [rng.random() ** 3 for _ in range(200)]
    lex = sc.Lexicon([f"{k}".encode() for k in range(200)], np.array(weights) * 1e4, 1e6)
    assert abs(sum(2.0 ** -int(n) for n in lex.size) - 1) < 1e-12
    codes = {format(int(c) >> (lex.most - int(n)), f"0{int(n)}b") for c, n in zip(lex.code, lex.size)}
    assert len(codes) == 200 and not any(a != b and b.startswith(a) for a in codes for b in codes)
    p = lex.chance / lex.chance.sum()
    assert -(p * np.log2(p)).sum() <= (p * lex.size).sum() < -(p * np.log2(p)).sum() + 1
