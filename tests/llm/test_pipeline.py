import hashlib
import random
import re
import zlib
from itertools import combinations

import numpy as np

import corpus_pipeline
from edgeloom.llm import quality, tokens

from .test_llm import corpus, groups

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def words(text):
    return re.findall(rb"[^\x20\x09-\x0d]+", (text or "").encode().lower())


def accepted(docs, labels):
    """The discriminant by numpy's own covariances, inverses and determinants."""
    x = {k: np.array(quality.statistics(d[1])) for k, d in enumerate(docs)}
    own = {c: np.array([x[k] for k, d in enumerate(docs) if labels.get(d[0]) == c and zlib.crc32(str(d[0]).encode()) % 5]) for c in (0, 1)}
    n = {c: len(v) for c, v in own.items()}
    total = sum(n.values())
    pooled = np.diag(sum(n[c] * np.diag(np.cov(own[c].T, bias=True)) for c in own) / total).clip(0)
    np.fill_diagonal(pooled, np.diag(pooled).clip(1e-6))
    covariance = {c: 0.9 * np.cov(own[c].T, bias=True) + 0.1 * pooled + 1e-9 * np.eye(len(pooled)) for c in own}

    def log_density(c, v):
        gap = v - own[c].mean(axis=0)
        return np.log(n[c] / total) - 0.5 * np.linalg.slogdet(covariance[c])[1] - 0.5 * gap @ np.linalg.inv(covariance[c]) @ gap

    return [d for k, d in enumerate(docs) if 1 / (1 + np.exp(np.clip(log_density(0, x[k]) - log_density(1, x[k]), -700, 700))) >= 0.3]


def near(a, b):
    """Edit distance of at most one word, by the table of distances."""
    if abs(len(a) - len(b)) > 1:
        return False
    row = list(range(len(b) + 1))
    for i, v in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, w in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (v != w))
    return row[-1] <= 1


def without_lines(docs):
    every = sorted((d[0], i, words(x)) for d in docs if d[0] is not None for i, x in enumerate((d[1] or "").split("\n")) if words(x))
    gone = set()
    for at, (k, i, w) in enumerate(every):
        if any(v == w or (min(len(v), len(w)) >= 8 and near(v, w)) for _, _, v in every[:at]):
            gone.add((k, i))
    out = []
    for k, text, lang, source, _ in docs:
        kept = None if text is None else "\n".join(x for i, x in enumerate(text.split("\n")) if (k, i) not in gone)
        if kept == text or words(kept):
            out.append((k, kept, lang, source, len(kept or "")))
    return out


def one_of_each(docs):
    sets = {}
    for k, text, *_ in docs:
        w = words(text)
        sets[k] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())
    named = [k for k in sets if k is not None and sets[k]]
    label = groups(sets, [(a, b) for a, b in combinations(named, 2) if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])])
    return [d for d in docs if label[d[0]] == d[0]]


def drawn(docs):
    cell_of, cells = [], {}
    for _, text, lang, source, _ in docs:
        n, lines = len(words(text)), (text or "").count("\n") + 1
        topic = "lines" if lines >= 2 and n < 15 * lines else "note" if n < 60 else "article" if n < 500 else "long"
        cell_of.append((source, lang, topic))
        cells[cell_of[-1]] = cells.get(cell_of[-1], 0) + n + 1
    total = sum(cells.values())
    bound = {c: n / (0.8 * total) for c, n in cells.items()}

    def factor(pairs, goal):
        """f of which the least of each bound and f times its value sum to the goal, by halving."""
        if sum(b for b, _ in pairs) <= goal * (1 + 1e-12):
            return max(b / v for b, v in pairs)
        low, high = 0.0, max(b / v for b, v in pairs)
        for _ in range(200):
            f = (low + high) / 2
            low, high = (f, high) if sum(min(b, f * v) for b, v in pairs) < goal else (low, f)
        return high

    reach = []
    for m in range(3):
        by, supply = {}, {}
        for c, t in cells.items():
            by[c[m]] = by.get(c[m], 0) + t
            supply[c[m]] = supply.get(c[m], 0) + bound[c]
        power = {level: t**0.7 for level, t in by.items()}
        goal = {level: p / sum(power.values()) for level, p in power.items()}
        f = factor([(supply[x], goal[x]) for x in goal], 1.0)
        reach.append({x: min(f * goal[x], supply[x]) for x in goal})
    weight = {c: t / total for c, t in cells.items()}
    for _ in range(10):
        for m in (2, 1, 0):
            for level, goal in reach[m].items():
                own = [c for c in cells if c[m] == level]
                f = factor([(bound[c], weight[c]) for c in own], goal)
                weight |= {c: f * weight[c] for c in own}
    chance = {c: min(1.0, weight[c] / bound[c]) for c in cells}
    number = lambda k: int(hashlib.md5(f"7/{'' if k is None else k}".encode()).hexdigest()[:13], 16) / 2**52
    return [d for d, c in zip(docs, cell_of, strict=True) if number(d[0]) < chance[c]]


def key(d):
    return d[0] is not None, d[0] or 0


def test_pipeline_matches_brute_force(spark, tmp_path):
    rng = random.Random(11)
    texts = {k: t for k, t in reversed(corpus())}  # one row for each id
    for k in range(200, 210, 2):  # the same words in other lines: near-duplicates without equal lines
        w = rng.choices(texts[0].split() + texts[2].split() + texts[5].split(), k=90)
        for j, wide in ((0, 9), (1, 15)):
            texts[k + j] = "\n".join(" ".join(w[i : i + wide]) for i in range(0, 90, wide))
    junk = {1000 + k: " ".join(rng.choices(["BUY!!", "NOW$$$", "###", "click&&&", "1234"], k=rng.randint(20, 80))) for k in range(40)}
    docs = [(k, t, "en" if (k or 0) % 3 else None, f"s{(k or 0) % 4}", len(t or "")) for k, t in (texts | junk).items()]
    labels = {k: int(k < 1000) for k in texts | junk if k is not None}
    spark.createDataFrame(docs, COLUMNS).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(k, q, 0) for k, q in labels.items()], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")

    want, now = docs, spark.read.parquet(f"{tmp_path}/documents.parquet")
    brute = [lambda d: accepted(d, labels), without_lines, one_of_each, drawn]
    for (name, stage), step in zip(corpus_pipeline.STAGES[:-1], brute, strict=True):
        before, want = want, step(want)
        now = stage(spark, now, str(tmp_path))
        got = [tuple(r) for r in now.select("doc_id", "text", "lang", "source", "n_chars").collect()]
        assert sorted(got, key=key) == sorted(want, key=key), name
        assert now.columns == [x.split()[0] for x in COLUMNS.split(", ")] and want != before, name
        now = spark.createDataFrame(want, COLUMNS).repartition(3)

    tok = tokens.WordTokenizer(tokens.public_path("byte_bpe_50k.json"))
    ids = {d[0]: np.append(tok.encode(d[1]), [0]).astype("<u4") for d in want}
    at, fill = dict.fromkeys(ids, 0), {}
    pieces = corpus_pipeline.run(spark, str(tmp_path)).collect()
    for r in sorted(pieces, key=lambda r: r.start):
        assert r.start == at[r.doc_id] and r.length > 0 and r.doc_tokens == len(ids[r.doc_id])
        assert r.ids_crc32 == zlib.crc32(ids[r.doc_id][r.start : r.start + r.length].tobytes())
        at[r.doc_id] += r.length
    assert at == {k: len(v) for k, v in ids.items()}
    for r in sorted(pieces, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == fill.get(r.sequence_id, 0)
        fill[r.sequence_id] = r.offset + r.length
    assert max(fill.values()) <= 1024


def test_pipeline_of_empty_tables(spark, tmp_path):
    spark.createDataFrame([], COLUMNS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
