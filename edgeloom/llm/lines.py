"""Line deduplication by a deletion-neighbourhood join.

A line is its words (A-Z lower-cased, runs without ASCII white space). It is
removed if an earlier line (smaller doc_id, or the same document and a smaller
number; see ``with_sub`` for texts that share a doc_id) has the same words or, for lines of ``near_words`` words and more, words
at an edit distance of 1: one word put in, left out or exchanged. Earliest
lines stay, lines are judged on the input, and lines without words are never
removed.

Equal lines are one row from the start. Every line that may have a neighbour
emits its variants, itself and itself without each word, as hashed keys. Two
lines of one length are a word apart just if they share the variant without
the same place; lines of lengths n and n + 1 are if the longer has a variant
that is the shorter. So for each key the earliest line alone answers for all
others there; the pairs found are verified by their words.

Only lines that share a half with another line may have a neighbour (one edit
leaves one half as it is), so halves are joined first, and variants are made
for those lines alone.

``max_edits`` 2 takes variants without two words as well, from every line: for
each way in which two lines can be two edits apart there is a key under which
all lines are (see ``_variants_of_two``), so again the earliest answers for all.

Scale: keys are partial minima and joins on plain keys; what is shuffled are
digests, and words only of lines that may have a neighbour. A variant's digest is
made from those of the words before and after what is left out (``Deletions``), so
a line's variants take time in proportion to its words, and they leave in stretches.
"""

from __future__ import annotations

from collections.abc import Iterator

import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import forget, map_batches, materialize, read, rows, semi_join, with_sub


PLACE = ("doc_id", "_sub", "line")


def words_of(line: str) -> list[bytes]:
    return line.encode("utf-8", "replace").lower().split()


MODULUS = (1 << 127) - 1
BASE = xxhash.xxh3_128_intdigest(b"lines") % MODULUS
BACK = pow(BASE, -1, MODULUS)
BACK_TWICE = BACK * BACK % MODULUS
STRETCH = 1 << 16  # variants that leave at a time


class Deletions:
    """Digests of words without one or two of them, each in constant time: polynomials of the words' own digests."""

    def __init__(self, words: list[bytes]) -> None:
        self.upto, total, power = [0], 0, 1
        for w in words:
            total = (total + xxhash.xxh3_128_intdigest(w) * power) % MODULUS
            power = power * BASE % MODULUS
            self.upto.append(total)
        self.total = total

    def all(self) -> bytes:
        return self.total.to_bytes(16, "big")

    def without(self, i: int) -> bytes:
        return ((self.upto[i] + (self.total - self.upto[i + 1]) * BACK) % MODULUS).to_bytes(16, "big")

    def without_two(self, i: int, j: int) -> bytes:
        """Without words i and j, i < j."""
        between, after = self.upto[j] - self.upto[i + 1], self.total - self.upto[j + 1]
        return ((self.upto[i] + between * BACK + after * BACK_TWICE) % MODULUS).to_bytes(16, "big")


def halves(words: list[bytes]) -> list[int]:
    """Keys of which two lines at a distance of 1 share one at least."""
    out, n = [], len(words)
    for m in (n - 1, n):  # the shorter line's length, whichever this one is
        half = m // 2
        out.append(xxhash.xxh3_64_intdigest(b" ".join(words[:half]), 2 * m) - (1 << 63))
        out.append(xxhash.xxh3_64_intdigest(b" ".join(words[n - (m - half) :]), 2 * m + 1) - (1 << 63))
    return out


def within_one(a: list[str], b: list[str]) -> bool:
    """Whether two lists of words are at an edit distance of at most 1."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1:
        return False
    k = 0
    while k < len(a) and a[k] == b[k]:
        k += 1
    return a[k + (len(a) == len(b)) :] == b[k + 1 :]


def _lines(docs: DataFrame, near_words: int, texts: bool) -> DataFrame:
    def run(batches: Iterator) -> Iterator[dict]:
        for batch in rows(batches):
            out: dict[str, list] = {k: [] for k in ("doc_id", "_sub", "line", "key", "n_words", "halves", "words")}
            for name, sub, text in zip(*(batch[k].to_pylist() for k in ("doc_id", "_sub", "text")), strict=True):
                for k, line in enumerate((text or "").split("\n")):
                    if words := words_of(line):
                        joined = b" ".join(words)
                        out["doc_id"].append(name)
                        out["_sub"].append(sub)
                        out["line"].append(k)
                        out["key"].append(xxhash.xxh3_128_digest(joined))
                        out["n_words"].append(len(words))
                        if texts:
                            out["words"].append(joined)
                        else:
                            out["halves"].append(halves(words) if len(words) >= near_words else None)
            yield out

    schema = "doc_id long, _sub long, line int, key binary, n_words int, " + ("words binary" if texts else "halves array<long>")
    return map_batches(docs.select("doc_id", "_sub", "text").where("doc_id is not null"), run, schema)


def _variants(lines: DataFrame) -> DataFrame:
    """key, at, and each variant: place -1 is the line itself, n its length."""

    def run(batches: Iterator) -> Iterator[dict]:
        names = ("variant", "place", "n", "key", *PLACE)
        for batch in rows(batches):
            out: dict[str, list] = {k: [] for k in names}
            for key, doc, sub, line, joined in zip(*[batch[c].to_pylist() for c in ("key", *PLACE, "words")], strict=True):
                words = joined.split(b" ")
                made, n = Deletions(words), len(words)
                for begin in range(-1, n, STRETCH):
                    places = range(begin, min(n, begin + STRETCH))
                    out["variant"] += [made.without(k) if k >= 0 else made.all() for k in places]
                    out["place"] += places
                    for k, v in (("n", n), ("key", key), ("doc_id", doc), ("_sub", sub), ("line", line)):
                        out[k] += [v] * len(places)
                    if len(out["n"]) >= STRETCH:
                        yield out
                        out = {k: [] for k in names}
            yield out

    return map_batches(lines.select("key", *PLACE, "words"), run, "variant binary, place int, n int, key binary, doc_id long, _sub long, line int")


def within(a: list, b: list, most: int) -> bool:
    """Whether two lists are at an edit distance of at most ``most``, by a band of the table of distances."""
    if abs(len(a) - len(b)) > most:
        return False
    row = {j: j for j in range(most + 1)}
    for i, x in enumerate(a, 1):
        new = {}
        for j in range(max(0, i - most), min(len(b), i + most) + 1):
            ways = [row[j] + 1] if j in row else []
            if j:
                ways += [new[j - 1] + 1] if j - 1 in new else []
                ways += [row[j - 1] + (x != b[j - 1])] if j - 1 in row else []
            else:
                ways.append(i)
            new[j] = min(ways)
        row = new
    return row.get(len(b), most + 1) <= most


def keys_of_two(words: list[bytes]) -> Iterator[tuple[bytes, int]]:
    """Keys of a line for two edits, each with its side.

    Lines of side 0 are all within two edits of each other under a key: of one
    length and the same words but for two places, or for one word each, wherever
    it stands. Lines of side 1 are within two edits of those of side 2: two words
    more, or one word more and another exchanged.
    """
    n, made = len(words), Deletions(words)

    def key(kind: str, rest: bytes) -> bytes:
        return xxhash.xxh3_128_digest(kind.encode() + b"/" + rest)

    yield key(f"more/{n}", made.all()), 2
    for i in range(n):
        one = made.without(i)
        yield key(f"any/{n}", one), 0
        yield key(f"place/{n}/{i}", one), 2
        for j in range(i + 1, n):
            two = made.without_two(i, j)
            yield key(f"places/{n}/{i}/{j}", two), 0
            yield key(f"more/{n - 2}", two), 1
            # of n - 1 words left once one is gone, the other's place
            yield key(f"place/{n - 1}/{j - 1}", two), 1
            yield key(f"place/{n - 1}/{i}", two), 1


def _variants_of_two(lines: DataFrame) -> DataFrame:
    def run(batches: Iterator) -> Iterator[dict]:
        for batch in rows(batches, 16):
            out: dict[str, list] = {k: [] for k in ("variant", "side", "key", *PLACE)}
            for key, doc, sub, line, joined in zip(*[batch[c].to_pylist() for c in ("key", *PLACE, "words")], strict=True):
                made = set(keys_of_two(joined.split(b" ")))
                out["variant"] += [v for v, _ in made]
                out["side"] += [x for _, x in made]
                for k, v in (("key", key), ("doc_id", doc), ("_sub", sub), ("line", line)):
                    out[k] += [v] * len(made)
            yield out

    return map_batches(lines.select("key", *PLACE, "words"), run, "variant binary, side int, key binary, doc_id long, _sub long, line int")


def _pairs_of_two(lines: DataFrame) -> DataFrame:
    """key and the earliest line (by) of each key that an earlier line of the other side, or of side 0, shares."""
    forms = materialize(_variants_of_two(lines), "variants")
    lead = [F.min(F.when(F.col("side") == k, F.struct(*PLACE, "key"))).alias(f"lead{k}") for k in range(3)]
    leads = forms.groupBy("variant").agg(*lead, F.count(F.lit(1)).alias("size")).where("size > 1")
    other = F.when(F.col("side") == 0, F.col("lead0")).when(F.col("side") == 1, F.col("lead2")).otherwise(F.col("lead1"))
    met = forms.join(leads, "variant").withColumn("lead", other).where(F.struct(*[f"lead.{c}" for c in PLACE]) < F.struct(*PLACE))
    return met.select("key", F.col("lead.key").alias("by")).distinct()


def near_lines(docs: DataFrame, firsts: DataFrame, max_edits: int = 1) -> DataFrame:
    """key of each distinct line that has an earlier neighbour. ``firsts``: key, first (a place), halves."""
    able = firsts.where("halves is not null")
    if max_edits == 1:
        flat = able.select("key", F.explode("halves").alias("half"))
        shared = flat.groupBy("half").agg(F.count(F.lit(1)).alias("size")).where("size > 1").select("half")
        able = flat.join(shared, "half", "left_semi").select("key").distinct().join(firsts, "key")
    maybe = materialize(able.select("key", "first.*"), "maybe")
    texts = _lines(semi_join(docs, maybe, ["doc_id"]), 0, True).select("key", "words").dropDuplicates(["key"])
    lines = materialize(maybe.join(texts, "key"), "lines")
    pairs = _pairs_of_one(lines) if max_edits == 1 else _pairs_of_two(lines)

    def check(batches: Iterator) -> Iterator[dict]:
        for batch in rows(batches):
            both = zip(batch["key"].to_pylist(), batch["words"].to_pylist(), batch["other"].to_pylist(), strict=True)
            yield {"key": [k for k, a, b in both if (within_one(a.split(b" "), b.split(b" ")) if max_edits == 1 else within(a.split(b" "), b.split(b" "), max_edits))]}

    found = pairs.join(lines.select("key", "words"), "key").join(lines.select(F.col("key").alias("by"), F.col("words").alias("other")), "by")
    out = materialize(map_batches(found.select("key", "words", "other"), check, "key binary").distinct(), "near")
    forget(lines)
    return out


def _pairs_of_one(lines: DataFrame) -> DataFrame:
    """key and an earlier line (by) one word apart."""
    forms = materialize(_variants(lines), "variants")
    at, earliest = F.struct(*PLACE), F.min(F.struct(*PLACE, "key"))
    # one word exchanged: the same variant without the same place
    swap = forms.where("place >= 0")
    lead = swap.groupBy("variant", "place", "n").agg(earliest.alias("lead"), F.count(F.lit(1)).alias("size")).where("size > 1")
    swapped = swap.join(lead, ["variant", "place", "n"]).where(F.col("key") != F.col("lead.key")).select("key", F.col("lead.key").alias("by"))
    # one word more or less: a variant is the shorter line itself
    shorter = forms.where("place = -1").select("variant", F.struct(*PLACE, "key").alias("short"))
    longer = swap.join(shorter, "variant")
    cut = longer.where(F.struct(*[f"short.{c}" for c in PLACE]) < at).select("key", F.col("short.key").alias("by"))
    grown = longer.where(at < F.struct(*[f"short.{c}" for c in PLACE])).groupBy(F.col("short.key").alias("key")).agg(earliest.alias("lead")).select("key", F.col("lead.key").alias("by"))
    return swapped.union(cut).union(grown).distinct()


def duplicate_lines(docs: DataFrame, near_words: int = 8, max_edits: int = 1) -> DataFrame:
    """doc_id, _sub (which of the texts that share it), line (from 0) of every line that an earlier one makes superfluous.

    ``max_edits`` is 0 (equal words only), 1 or 2, whose variants grow with the square of a line's words; lines of ``near_words`` words and
    more have neighbours. Documents with a null doc_id have no place in the
    order: their lines are neither removed nor a reason to remove others. Null
    texts have no lines; rows that repeat a doc_id with the same text are one
    document, with different texts they are documents of their own.
    """
    if max_edits not in (0, 1, 2):
        raise ValueError("max_edits must be 0, 1 or 2")
    docs = (docs if "_sub" in docs.columns else with_sub(docs.select("doc_id", "text"))).select("doc_id", "_sub", "text")
    lines = materialize(_lines(docs, near_words, False), "lines")
    firsts = materialize(lines.groupBy("key").agg(F.min(F.struct(*PLACE)).alias("first"), F.any_value("halves").alias("halves")), "firsts")
    state = firsts.select("key", "first", F.lit(False).alias("near"))
    if max_edits:
        near = near_lines(docs, firsts, max_edits).withColumn("hit", F.lit(True))
        state = firsts.select("key", "first").join(near, "key", "left").select("key", "first", F.coalesce("hit", F.lit(False)).alias("near"))
    judged = lines.select(*PLACE, "key").join(state, "key")
    return judged.where(F.col("near") | (F.struct(*PLACE) != F.col("first"))).select(*PLACE).distinct()


def drop_duplicate_lines(docs: DataFrame, near_words: int = 8, max_edits: int = 1) -> DataFrame:
    """``docs`` with the remaining lines as text, and n_lines and n_removed.

    Every row comes back, also those left without a line (text empty). Null
    texts stay null. Other columns are as they were, but for columns named
    n_lines or n_removed, which are replaced.
    """
    columns = [c for c in docs.columns if c not in ("n_lines", "n_removed")]
    docs = with_sub(docs.drop("n_lines", "n_removed"))
    gone = duplicate_lines(docs, near_words, max_edits).groupBy("doc_id", "_sub").agg(F.sort_array(F.collect_list("line")).alias("_lines_gone"))  # at most a document's lines
    joined = docs.join(gone.hint("shuffle_hash"), ["doc_id", "_sub"], "left").withColumns({"_lines_all": F.split("text", "\n"), "_lines_n": F.size(F.split("text", "\n"))})
    # the runs of lines between those that go
    taken, n = F.col("_lines_gone"), F.size("_lines_gone")

    def run(k: Column) -> Column:
        begin = F.when(k == 0, 0).otherwise(F.get(taken, k - 1) + 1)
        end = F.when(k == n, F.col("_lines_n")).otherwise(F.get(taken, k))
        return F.slice("_lines_all", begin + 1, end - begin)

    left = F.flatten(F.transform(F.sequence(F.lit(0), n), run))
    text = F.when(taken.isNull(), F.col("text")).otherwise(F.array_join(left, "\n"))
    out = joined.withColumns({"n_lines": F.greatest(F.coalesce("_lines_n", F.lit(0)), F.lit(0)).cast("long"), "n_removed": F.greatest(F.coalesce(n, F.lit(0)), F.lit(0)).cast("long"), "_lines_text": text})
    return out.withColumn("text", F.col("_lines_text")).select(*columns, "n_lines", "n_removed")


def without_repeats(docs: DataFrame, near_words: int = 8) -> DataFrame:
    """``docs`` with repeated lines taken out of the texts, n_chars following.

    Documents of which no word is left are dropped; those that had none before stay.
    """
    left = drop_duplicate_lines(docs, near_words).where("n_removed = 0 or trim(BOTH ' \t\n\r' FROM text) <> ''")
    return left.withColumn("n_chars", F.coalesce(F.length("text"), F.lit(0)).cast("long")).select(*docs.columns)


def op4_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without repeated lines."""
    out = drop_duplicate_lines(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))


ORACLE = r"""
WITH t AS (SELECT doc_id, string_split(text, chr(10)) AS x FROM documents WHERE text IS NOT NULL),
l AS (SELECT doc_id, unnest(range(len(x))) AS i, unnest(x) AS raw FROM t),
w AS (SELECT doc_id, i, raw, regexp_extract_all(translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM l),
k AS (SELECT array_to_string(w, ' ') AS k, any_value(w) AS w, min(doc_id * 10000000 + i) AS pos FROM w WHERE len(w) > 0 GROUP BY 1),
v AS (SELECT k, pos, len(w) AS n, p, md5(array_to_string(w[:p - 1] || w[p + 1:], ' ')) AS v FROM (SELECT k, w, pos, unnest(range(1, CAST(len(w) AS BIGINT) + 1)) AS p FROM k WHERE len(w) >= 8)),
s AS (SELECT md5(k) AS v, k, pos FROM k WHERE len(w) >= 8),
f AS (SELECT v, p, n, min(pos) AS pos FROM v GROUP BY 1, 2, 3),
near AS (SELECT v.k FROM v JOIN f USING (v, p, n) WHERE f.pos < v.pos
  UNION SELECT v.k FROM v JOIN s USING (v) WHERE s.pos < v.pos
  UNION SELECT s.k FROM v JOIN s USING (v) WHERE v.pos < s.pos),
j AS (SELECT w.doc_id, w.i, w.raw, coalesce(len(w.w) > 0 AND (k.pos <> w.doc_id * 10000000 + w.i OR near.k IS NOT NULL), FALSE) AS gone
  FROM w LEFT JOIN k ON array_to_string(w.w, ' ') = k.k LEFT JOIN near ON near.k = k.k),
g AS (SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_removed, coalesce(string_agg(raw, chr(10) ORDER BY i) FILTER (NOT gone), '') AS kept FROM j GROUP BY 1)
SELECT d.doc_id, CAST(coalesce(n_lines, 0) AS BIGINT) AS n_lines, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM documents d LEFT JOIN g USING (doc_id)
"""
