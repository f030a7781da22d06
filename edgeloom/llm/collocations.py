"""Phrases whose words stand together more often than their parts would.

Frequent phrases are mined by pivot partitioning. All words of a language that
are frequent get a number, the most frequent first; other words are blank. The
pivot of a phrase is its rarest word. An occurrence of a word sends, to the
group of that word, the fragment around it in which it is the rarest: up to four
words on either side, cut at a blank or a rarer word (on the left also at the
word itself, so that each occurrence of a phrase is owned by one place, the
leftmost of its pivot). Equal fragments are sent once with their number. A group
is then mined on its own: it counts its pivot's phrases, and no others, in full.

Counting goes from the pivot outwards: a phrase is counted if the shorter ones
inside it that hold its pivot are frequent. A group with more fragments than a
task holds is split by the word left of the pivot (or the word to its right,
for phrases that begin with the pivot), and again by the next word until its
parts fit, or all their fragments are equal. Pivots that are very frequent words
are split so from the start. So no hot word is one task's work, and no
fragment is dropped.

Scale: one shuffle brings word counts together, one the fragments. The words'
numbers go to the tasks as a broadcast while they are few (``few_words``);
beyond that texts are cut into stretches, whose words are joined with the
numbers and put together again. Both give the same fragments.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import map_batches, materialize, read

#: Words of a phrase at most, and words on each side of a pivot.
LONGEST, REACH = 5, 4
#: Distinct words that a task holds before it sends what it has.
HELD = 500_000
#: Tokens whose fragments are made at once.
TOKENS = 400_000
_SEPARATORS = rb".,;:!?\n-\r"
_words = re.compile(rb"[^ \t" + _SEPARATORS + rb"]+").findall
_marked = re.compile(rb"[^ \t" + _SEPARATORS + rb"]+|[" + _SEPARATORS + rb"]+").findall


def _clean(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, bytes]]:
    for batch in batches:
        yield from zip(batch["lang"].to_pylist(), (x.lower() for x in batch["text"].cast(pa.binary()).to_pylist()), strict=True)


def word_counts(docs: DataFrame, at_least: int) -> DataFrame:
    """lang, word, f of the words with ``at_least`` occurrences, and a row without a word for all of a language's. Written."""

    def run(batches: Iterator) -> Iterator[dict]:
        found: dict[str, Counter] = {}
        held = 0

        def out() -> Iterator[dict]:
            for lang, n in found.items():
                words = list(n)
                for k in range(0, len(words), 50_000):
                    some = words[k : k + 50_000]
                    yield {"lang": [lang] * len(some), "word": pa.array(some, pa.binary()).cast(pa.string()), "n": [n[x] for x in some]}
                yield {"lang": [lang], "word": [None], "n": [n.total()]}
            found.clear()

        for lang, text in _texts(batches):
            n = found.setdefault(lang, Counter())
            before = len(n)
            n.update(_words(text))
            held += len(n) - before
            if held >= HELD:
                yield from out()
                held = 0
        yield from out()

    parts = map_batches(_clean(docs), run, "lang string, word string, n long")
    summed = parts.groupBy("lang", "word").agg(F.sum("n").alias("f"))
    return materialize(summed.where((F.col("f") >= at_least) | F.col("word").isNull()), "words")


def numbered(words: DataFrame) -> DataFrame:
    """id, lang, word, f: numbers from 0 by falling f. Written."""
    ordered = words.where("word is not null").repartitionByRange(F.desc("f"), "lang", "word").sortWithinPartitions(F.desc("f"), "lang", "word")
    marked = materialize(ordered.withColumn("at", F.monotonically_increasing_id()), "ordered")
    part = F.shiftright("at", 33)
    sizes = marked.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("k"))
    starts = sizes.select("part", (F.sum("k").over(W.orderBy("part")) - F.col("k")).alias("start"))  # a row for each task of the sort
    return materialize(marked.withColumn("part", part).join(starts, "part").select((F.col("start") + F.col("at").bitwiseAND(F.lit((1 << 33) - 1))).cast("int").alias("id"), "lang", "word", "f"), "numbers")


def windows(ids: np.ndarray, own: np.ndarray | None = None) -> np.ndarray:
    """The fragments of a run of word numbers (-1: blank): a row of 9 for each place that owns a phrase, its pivot in the middle."""
    n = len(ids)
    t = np.concatenate([np.full(REACH, -1, dtype=np.int32), ids, np.full(REACH, -1, dtype=np.int32)])
    before, after = t[REACH - 1 : REACH - 1 + n], t[REACH + 1 : REACH + 1 + n]
    owns = (ids >= 0) & (((before >= 0) & (before < ids)) | ((after >= 0) & (after <= ids)))
    at = np.flatnonzero(owns if own is None else owns & own)
    out = np.full((len(at), 2 * REACH + 1), -1, dtype=np.int32)
    pivot = out[:, REACH] = ids[at]
    left = right = np.ones(len(at), dtype=bool)
    for k in range(1, REACH + 1):
        v = t[at + REACH - k]
        left = left & (v >= 0) & (v < pivot)
        out[left, REACH - k] = v[left]
        v = t[at + REACH + k]
        right = right & (v >= 0) & (v <= pivot)
        out[right, REACH + k] = v[right]
    return out


def hashes(rows: np.ndarray) -> np.ndarray:
    h = np.full(len(rows), 0x9E3779B97F4A7C15, dtype=np.uint64)
    for c in range(rows.shape[1]):
        h = (h ^ (rows[:, c].astype(np.uint64) & np.uint64(0xFFFFFFFF))) * np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(32)
    return h


def grouped(rows: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct rows, the sums of their ``n``, and for each row the number of its distinct one."""
    if not len(rows):
        return rows, n, np.zeros(0, dtype=np.int64)
    h = hashes(rows)
    order = np.argsort(h)
    ordered = rows[order]
    new = np.concatenate([[True], (ordered[1:] != ordered[:-1]).any(axis=1)])
    if (new[1:] & (h[order][1:] == h[order][:-1])).any():  # two rows of one hash
        order = np.lexsort(rows.T)
        ordered = rows[order]
        new = np.concatenate([[True], (ordered[1:] != ordered[:-1]).any(axis=1)])
    which = np.empty(len(rows), dtype=np.int64)
    which[order] = np.cumsum(new) - 1
    return ordered[new], np.add.reduceat(n[order], np.flatnonzero(new)), which


def _needed(rows: np.ndarray, a: int, b: int) -> np.ndarray:
    """Fragments without what the phrases below (a, b) have no use for: they hold a words left of the pivot and b right of it, at least."""
    rows = rows.copy()
    rows[:, REACH + 1 + REACH - a :] = -1
    if b or not a:  # (0, 1) and on: exactly a on the left
        rows[:, : REACH - a] = -1
    return rows


def _parts(rows: np.ndarray, n: np.ndarray, a: int, b: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """The groups into which (a, b) is split: one word more on the left, while none is fixed on the right, or one more on the right."""
    for a2, b2 in [(a + 1, 0), (a, 1)] if b == 0 else [(a, b + 1)]:
        if a2 + b2 < LONGEST:
            has = (rows[:, REACH - a2] >= 0) & (rows[:, REACH + b2] >= 0) if a2 else rows[:, REACH + b2] >= 0
            if has.any():
                yield a2, b2, _needed(rows[has], a2, b2), n[has]


FRAGMENT = "key long, a int, b int, n long, words binary, ids array<int>"


def _sent(rows: np.ndarray, n: np.ndarray, a: int, b: int) -> dict:
    """Rows of Spark for fragments: the group's key, and the numbers from the first that is no blank."""
    rows, n, _ = grouped(rows, n)
    here = rows >= 0
    lead = here.argmax(axis=1).astype(np.int32)
    size = here.sum(axis=1)
    key = hashes(rows[:, REACH - a : REACH + b + 1]) ^ np.uint64(16 * a + b)
    flat = np.empty(size.sum() + len(rows), dtype="<i4")
    starts = np.cumsum(size + 1) - size - 1
    head = np.zeros(len(flat), dtype=bool)
    head[starts] = True
    flat[head], flat[~head] = lead, rows[here]
    offsets = np.concatenate([starts, [len(flat)]]).astype(np.int32) * 4
    words = pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(offsets), pa.py_buffer(flat)])
    return {"key": key.view(np.int64), "a": np.full(len(rows), a, dtype=np.int32), "b": np.full(len(rows), b, dtype=np.int32), "n": n, "words": words, "ids": pa.nulls(len(rows), pa.list_(pa.int32()))}


def _received(words: pa.Array) -> np.ndarray:
    words = pa.concat_arrays([words])
    offsets = np.frombuffer(words.buffers()[1], dtype=np.int32)[words.offset : words.offset + len(words) + 1] // 4
    flat = np.frombuffer(words.buffers()[2], dtype="<i4") if len(words) else np.zeros(0, dtype="<i4")
    size = np.diff(offsets) - 1
    lead = flat[offsets[:-1]]
    row = np.repeat(np.arange(len(words)), size)
    inside = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    out = np.full((len(words), 2 * REACH + 1), -1, dtype=np.int32)
    out[row, lead[row] + inside] = flat[offsets[:-1][row] + 1 + inside]
    return out


def _fragments(rows: np.ndarray, split: int) -> Iterator[dict]:
    """What a task sends: numbers below ``split`` are pivots that are split from the start."""
    n = np.ones(len(rows), dtype=np.int64)
    hot = rows[:, REACH] < split
    if not hot.all():
        yield _sent(rows[~hot], n[~hot], 0, 0)
    for a, b, part, m in _parts(rows[hot], n[hot], 0, 0):
        yield _sent(part, m, a, b)


def fragments(docs: DataFrame, numbers: DataFrame, split: int, few_words: int) -> DataFrame:
    """Fragments of all texts (``FRAGMENT``)."""
    spark = docs.sparkSession
    if numbers.limit(few_words + 1).count() > few_words:
        return _joined(docs, numbers, split)
    known: dict[str, dict[bytes, int]] = {}
    for r in numbers.select("id", "lang", "word").toArrow().to_pylist():
        known.setdefault(r["lang"], {})[r["word"].encode()] = r["id"]
    shared = spark.sparkContext.broadcast(known)

    def run(batches: Iterator) -> Iterator[dict]:
        held, size = [], 0
        blank = np.full(1, -1, dtype=np.int32)
        for lang, text in _texts(batches):
            ids = shared.value.get(lang)
            if not ids:
                continue
            words = _marked(text)  # no run of separators is a word, so it has no number
            held += [np.fromiter(map(ids.get, words, [-1] * len(words)), dtype=np.int32, count=len(words)), blank]
            size += len(words)
            if size >= TOKENS:
                yield from _fragments(windows(np.concatenate(held)), split)
                held, size = [], 0
        if held:
            yield from _fragments(windows(np.concatenate(held)), split)

    return map_batches(_clean(docs), run, FRAGMENT)


def _joined(docs: DataFrame, numbers: DataFrame, split: int, span: int = 512) -> DataFrame:
    """The same with any number of words: stretches of ``span`` words, with what they need of their neighbours, are exploded, joined and put together."""

    def cut(batches: Iterator) -> Iterator[dict]:
        for lang, text in _texts(batches):
            words = _marked(text)
            for k in range(0, len(words), span):
                first = max(0, k - REACH)
                part = words[first : k + span + REACH]
                yield {"lang": [lang], "skip": [k - first], "own": [min(span, len(words) - k)], "words": [[x.decode() for x in part]]}

    def made(batches: Iterator) -> Iterator[dict]:
        for batch in batches:
            held, own = [], []
            for skip, n, size, found in zip(*(batch[c].to_pylist() for c in ("skip", "own", "size", "found")), strict=True):
                ids, mine = np.full(size + 1, -1, dtype=np.int32), np.zeros(size + 1, dtype=bool)
                ids[[x["pos"] for x in found]] = [x["id"] for x in found]
                mine[skip : skip + n] = True
                held.append(ids)
                own.append(mine)
            if held:
                yield from _fragments(windows(np.concatenate(held), np.concatenate(own)), split)

    stretches = materialize(map_batches(_clean(docs), cut, "lang string, skip int, own int, words array<string>").withColumn("stretch", F.monotonically_increasing_id()), "stretches")
    words = stretches.select("stretch", "lang", "skip", "own", F.size("words").alias("size"), F.posexplode("words").alias("pos", "word"))
    found = words.join(numbers.select("lang", "word", "id"), ["lang", "word"])
    # at most span + 8 words
    whole = found.groupBy("stretch", "skip", "own", "size").agg(F.collect_list(F.struct("pos", "id")).alias("found"))
    return map_batches(whole, made, FRAGMENT)


def _mined(rows: np.ndarray, n: np.ndarray, a: int, b: int, at_least: int) -> Iterator[dict]:
    """Frequent phrases of groups that are there in full: those with a words left of the pivot, or more, and b right of it, or more."""
    often: dict[tuple[int, int], np.ndarray] = {}  # which rows have a frequent phrase of so many words on each side
    shapes = [(x, y) for x in range(a, LONGEST) for y in range(LONGEST - x) if x + y and (y >= b if x == a else b == 0)]
    for x, y in sorted(shapes, key=sum):
        may = (rows[:, REACH - x] >= 0) & (rows[:, REACH + y] >= 0)
        for inner in ((x - 1, y), (x, y - 1)):
            if inner in often:
                may &= often[inner]
        which = np.flatnonzero(may)
        words, sums, of = grouped(np.ascontiguousarray(rows[which, REACH - x : REACH + y + 1]), n[which])
        good = sums >= at_least
        often[x, y] = ok = np.zeros(len(rows), dtype=bool)
        ok[which[good[of]]] = True
        if good.any():
            yield _found(words[good], sums[good])


def _found(words: np.ndarray, n: np.ndarray) -> dict:
    k, width = words.shape
    nothing = pa.nulls(k, pa.int32())
    ids = pa.ListArray.from_arrays(pa.array(np.arange(0, k * width + 1, width, dtype=np.int32)), pa.array(words.ravel()))
    return {"key": pa.nulls(k, pa.int64()), "a": nothing, "b": nothing, "n": n, "words": pa.nulls(k, pa.binary()), "ids": ids}


def _mine(at_least: int, holds: int) -> Callable[[Iterator], Iterator[dict]]:
    """Over a partition sorted by key: phrases found (with ids), and fragments of groups that are split (without)."""

    def settle(held: list) -> Iterator[dict]:
        if held:
            key, a, b, n, rows = (np.concatenate([h[c] for h in held]) for c in range(5))
            for x, y in np.unique(np.stack([a, b], axis=1), axis=0).tolist():
                some = (a == x) & (b == y)
                yield from _mined(rows[some], n[some], x, y, at_least)

    def opened(held: list) -> Iterator[dict]:
        key, a, b, n, rows = (np.concatenate([h[c] for h in held]) for c in range(5))
        for x, y in np.unique(np.stack([a, b], axis=1), axis=0).tolist():
            some = (a == x) & (b == y)
            if x + y:
                words, sums, _ = grouped(np.ascontiguousarray(rows[some, REACH - x : REACH + y + 1]), n[some])
                yield _found(words, sums)  # of a part of the group; sums follow
            for a2, b2, part, m in _parts(rows[some], n[some], x, y):
                yield _sent(part, m, a2, b2)

    def run(batches: Iterator) -> Iterator[dict]:
        whole, size = [], 0  # groups that are there in full
        tail, rest, last, over = [], 0, None, False  # the group that may go on; over: it is split
        for batch in batches:
            columns = [batch[c].to_numpy() for c in ("key", "a", "b", "n")] + [_received(batch["words"])]
            key, n = columns[0], batch.num_rows
            if not n:
                continue
            turns = np.flatnonzero(np.diff(key)) + 1
            at = 0
            if key[0] == last:
                at = int(turns[0]) if len(turns) else n
                if over:
                    yield from opened([[c[:at] for c in columns]])
                else:
                    tail.append([c[:at] for c in columns])
                    rest += at
            if at < n:
                whole, size, over = whole + tail, size + rest, False
                start, last = int(turns[-1]) if len(turns) else 0, key[-1]
                whole.append([c[at:start] for c in columns])
                size += start - at
                if size >= holds:
                    yield from settle(whole)
                    whole, size = [], 0
                tail, rest = [[c[start:] for c in columns]], n - start
            if rest >= holds:
                yield from opened(tail)
                tail, rest, over = [], 0, True
        yield from settle(whole + tail)

    return run


def phrases(docs: DataFrame, numbers: DataFrame, at_least: int = 100, split: int = 1 << 17, holds: int = 1 << 18, few_words: int = 400_000) -> DataFrame:
    """ids (the words' numbers), a: phrases of 2 to 5 words with ``at_least`` occurrences. Written."""
    hot = numbers.where(F.col("f") > split).count()
    todo, found = fragments(docs, numbers, hot, few_words), None
    while True:
        dealt = todo.select("key", "a", "b", "n", "words").repartition("key").sortWithinPartitions("key")
        made = materialize(map_batches(dealt, _mine(at_least, holds), FRAGMENT), "mined")
        done = made.where("ids is not null").select("ids", "n")
        found = done if found is None else found.unionByName(done)
        todo = made.where("ids is null")
        if todo.isEmpty():
            break
    return materialize(found.groupBy("ids").agg(F.sum("n").alias("a")).where(F.col("a") >= at_least), "phrases")


def collocations(docs: DataFrame, at_least: int = 100, inside_percent: int = 100, first: int = 2_000, split: int = 1 << 17, holds: int = 1 << 18, few_words: int = 400_000) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score of ``docs`` (lang, text): each language's ``first`` by score, then a, then phrase.

    ``a`` counts the phrase, ``l`` and ``r`` its two parts at the cut with the
    lowest score floor(1000 a n / (l r)) (of equal ones the first), ``n`` the
    words of the language. A phrase is left out if a longer one that holds it has
    ``inside_percent`` of its occurrences or more. Null texts are empty, a null
    lang is ``und``; repeated rows count each; other columns are ignored. No rows
    give none. Arithmetic is on decimals of 38 digits.
    """
    words = word_counts(docs, at_least)
    numbers = numbered(words)
    found = phrases(docs, numbers, at_least, split, holds, few_words)
    size = F.size("ids")
    inner = found.where(size > 2)
    subs = inner.select(F.slice("ids", F.lit(1), size - 1).alias("ids"), "a").union(inner.select(F.slice("ids", F.lit(2), size - 1), "a"))
    longer = subs.groupBy("ids").agg(F.max("a").alias("longer"))  # a phrase inside a longer one is inside one with a word more, of no fewer occurrences
    kept = found.join(longer, "ids", "left").where(f"longer is null or 100 * longer < {inside_percent} * a").select("ids", "a")
    every = found.select("ids", F.col("a").alias("f")).union(numbers.select(F.array("id"), "f"))
    cuts = kept.select("ids", "a", F.explode(F.sequence(F.lit(1), size - 1)).alias("k"))
    cuts = cuts.withColumn("left", F.slice("ids", F.lit(1), F.col("k"))).withColumn("right", F.slice("ids", F.col("k") + 1, size - F.col("k")))
    cuts = cuts.join(every.select(F.col("ids").alias("left"), F.col("f").alias("l")), "left").join(every.select(F.col("ids").alias("right"), F.col("f").alias("r")), "right")
    totals = words.where("word is null").select("lang", F.col("f").alias("n"))
    named = kept.select("ids", F.posexplode("ids").alias("pos", "id")).join(numbers.select("id", "lang", "word"), "id").groupBy("ids").agg(F.array_join(F.array_sort(F.collect_list(F.struct("pos", "word")))["word"], " ").alias("phrase"), F.first("lang").alias("lang"))
    big = lambda c: F.col(c).cast("decimal(19,0)")
    scored = cuts.join(named, "ids").join(totals, "lang").withColumn("score", F.call_function("div", F.lit(1000).cast("decimal(4,0)") * (big("a") * big("n")), big("l") * big("r")))
    best = scored.groupBy("ids", "lang", "phrase", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut")).select("lang", "phrase", "a", "cut.l", "cut.r", "n", "cut.score")
    rank = F.row_number().over(W.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase"))
    return best.withColumn("rank", rank).where(F.col("rank") <= first).select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each language's 2,000 strongest phrases of words with 100 occurrences or more."""
    return collocations(read(spark, sf_dir, "documents"))


ORACLE = r"""
WITH d AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
q AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM d),
n AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM q GROUP BY 1),
i AS (SELECT lang, w, unnest(generate_series(1, len(w))) AS i FROM q),
f AS (SELECT lang, k, array_to_string(w[i : i + k - 1], ' ') AS phrase, count(*) AS f FROM i, (SELECT unnest([1, 2, 3, 4, 5]) AS k) WHERE i + k - 1 <= len(w) GROUP BY 1, 2, 3 HAVING count(*) >= 100),
c AS (SELECT * FROM f WHERE k > 1),
z AS (SELECT * FROM c WHERE NOT EXISTS (SELECT 1 FROM c x WHERE x.lang = c.lang AND x.k > c.k AND 100 * x.f >= 100 * c.f AND contains(' ' || x.phrase || ' ', ' ' || c.phrase || ' '))),
s AS (SELECT z.lang, z.phrase, z.f AS a, unnest(range(1, z.k)) AS k, string_split(z.phrase, ' ') AS w FROM z),
t AS (SELECT s.lang, s.phrase, s.a, s.k, l.f AS l, r.f AS r, n.n, CAST((1000::HUGEINT * s.a * n.n) // (l.f::HUGEINT * r.f) AS BIGINT) AS score
      FROM s JOIN f l ON l.lang = s.lang AND l.phrase = array_to_string(s.w[1 : s.k], ' ') JOIN f r ON r.lang = s.lang AND r.phrase = array_to_string(s.w[s.k + 1 :], ' ') JOIN n ON n.lang = s.lang),
b AS (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) AS first FROM t),
o AS (SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score FROM b WHERE first = 1)
SELECT * FROM o WHERE rank <= 2000
"""
