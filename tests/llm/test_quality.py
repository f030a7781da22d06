import math
import random
import zlib

import numpy as np

from edgeloom.llm import quality

from .test_llm import table


def plain_statistics(text):
    """The statistics, character by character."""
    raw = (text or "").encode()
    n = len(raw)
    count = lambda ok: sum(bool(ok(b)) for b in raw)
    letters = count(lambda b: b >= 128 or chr(b).isalpha())
    upper = count(lambda b: chr(b) in "ABCDEFGHIJKLMNOPQRSTUVWXYZ")
    digits = count(lambda b: chr(b) in "0123456789")
    spaces, breaks = count(lambda b: b == 32), count(lambda b: b == 10)
    stops, marks = count(lambda b: chr(b) in ".,"), count(lambda b: chr(b) in ";:'\"!?()-")
    controls = count(lambda b: b < 32 and b not in (9, 10, 13))
    symbols = n - letters - digits - spaces - breaks - stops - marks - controls
    shares = [raw.count(b) / n for b in set(raw)]
    words = raw.lower().split()
    m = len(words)
    sizes = [len(w) for w in words]
    mean = sum(sizes) / m if m else 0.0
    spread = math.sqrt(sum((s - mean) ** 2 for s in sizes) / m) if m else 0.0
    lines = [x for x in raw.split(b"\n") if x]
    pairs = {(a, b) for a, b in zip(words, words[1:])}
    rate = lambda x, of: math.log((x + 0.05) / (of + 1))
    return [
        math.log(1 + n), rate(n - letters, n), rate(upper, letters), rate(digits, n), rate(spaces, n), rate(breaks, m), rate(stops, m), rate(marks, n), rate(symbols, n), rate(controls, n),
        -sum(p * math.log(p) for p in shares), math.log(1 + m), math.log(1 + mean), math.log(1 + spread), rate(sum(not (w[-1] >= 128 or chr(w[-1]).isalnum()) for w in words), m),
        math.log((len(set(words)) + 1) / (m + 1)), rate(max([words.count(w) for w in set(words)], default=0), m), rate(max(m - 1 - len(pairs), 0), m), rate(len(lines) - len(set(lines)), len(lines)), math.log(1 + n / max(len(lines), 1)),
    ]


def labelled(seed):
    rng = random.Random(seed)
    texts, labels = [], []
    for k in range(260):
        good = rng.random() < 0.5
        words = ["".join(rng.choices("abcdefghij" if good else "abcXYZ019%$", k=rng.randint(2, 9))) for _ in range(rng.randint(5, 60))]
        texts.append((k, " ".join(words) + ("." if good else "\n\n!!")))
        if rng.random() < 0.8:
            labels.append((k, int(good) if rng.random() < 0.97 else 1 - int(good), 0))
    return [*texts, (900, None), (901, ""), (902, "é"), (None, "abc def")], [*labels, (5, 1, 0), (5, 0, 0), (7000, 1, 0), (3, None, 0)]


def test_scores_are_those_of_a_discriminant_in_numpy(spark):
    texts, labels = labelled(1)
    x = {k: plain_statistics(t) for k, t in texts}
    fold = lambda k: zlib.crc32(("" if k is None else str(k)).encode()) % 5
    rows = [(x[k], y) for k, y, _ in labels if k in x and y is not None and fold(k)]
    data, y = np.array([r[0] for r in rows]), np.array([r[1] for r in rows])
    means = [data[y == c].mean(axis=0) for c in (0, 1)]
    covariances = [np.cov(data[y == c].T, bias=True) for c in (0, 1)]
    share = [(y == c).mean() for c in (0, 1)]
    pooled = np.diag(np.diag(share[0] * covariances[0] + share[1] * covariances[1]).clip(1e-6))

    def density(v, c):
        s = 0.9 * covariances[c] + 0.1 * pooled + 1e-9 * np.eye(len(v))
        d = np.array(v) - means[c]
        return math.log(share[c]) - 0.5 * (np.linalg.slogdet(s)[1] + d @ np.linalg.solve(s, d))

    frame = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = quality.classify(table(spark, texts), frame).collect()
    assert len(got) == len(texts)
    for r in got:
        want = 1 / (1 + math.exp(min(density(x[r.doc_id], 0) - density(x[r.doc_id], 1), 700)))
        assert abs(r.score - want) < 1e-6 and r.held_out == (fold(r.doc_id) == 0) and r.predicted == int(r.score >= 0.3)
    kept = {r.doc_id for r in quality.accepted(table(spark, texts), frame).collect()}
    assert kept == {r.doc_id for r in got if r.predicted}
