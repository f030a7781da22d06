"""Quality classifier: regularised quadratic discriminant over text statistics.

Each whole text gives a few transformed statistics. Each class has a mean and
a covariance, shrunk towards the diagonal of the pooled covariance; the
Cholesky factor of each is inverted once and cached in the model. The score is
the logistic of the difference of the two log densities (from the Mahalanobis
distances) plus the log prior odds.

Scale: one pass turns texts into short vectors, which are written once; the
fit needs only sums and products of them (bounded by the number of statistics,
whatever the number of rows), and scoring is one matrix product a batch. Texts
are never shuffled.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import id_text, map_batches, materialize, read, rows, semi_join

NAMES = (
    "log_bytes", "letters", "upper", "digits", "spaces", "breaks", "stops", "marks", "symbols", "controls", "entropy",
    "log_words", "word_length", "word_spread", "marked_words", "distinct_words", "top_word", "distinct_pairs", "repeated_lines", "log_line",
)

_KIND = np.zeros((256, 8), dtype=np.int64)  # letters, upper, digits, spaces, breaks, stops, marks, controls
for _b in range(256):
    _c = chr(_b)
    _KIND[_b] = [
        _b >= 128 or _c.isalpha(), 65 <= _b <= 90, 48 <= _b <= 57, _b == 32, _b == 10, _c in ".,", _c in ";:'\"!?()-", _b < 32 and _b not in (9, 10, 13),
    ]


def statistics(text: str | None) -> list[float]:
    """The transformed statistics of a whole text; null is as empty."""
    raw = (text or "").encode("utf-8", "replace")
    n = len(raw)
    counts = np.bincount(np.frombuffer(raw, dtype=np.uint8), minlength=256)
    letters, upper, digits, spaces, breaks, stops, marks, controls = (counts @ _KIND).tolist()
    symbols = n - letters - digits - spaces - breaks - stops - marks - controls
    share = counts[counts > 0] / max(n, 1)
    words = raw.lower().split()
    m = len(words)
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=m)
    seen = Counter(words)
    pairs = len(set(zip(words, words[1:], strict=False)))
    lines = [x for x in raw.split(b"\n") if x]
    marked = sum(not (w[-1:].isalnum() or w[-1] >= 128) for w in words)

    def rate(x: float, of: float) -> float:
        return math.log((x + 0.05) / (of + 1.0))

    return [
        math.log1p(n), rate(n - letters, n), rate(upper, letters), rate(digits, n), rate(spaces, n), rate(breaks, m), rate(stops, m), rate(marks, n), rate(symbols, n), rate(controls, n),
        float(-(share * np.log(share)).sum()), math.log1p(m), math.log1p(lengths.mean() if m else 0.0), math.log1p(lengths.std() if m else 0.0), rate(marked, m),
        math.log((len(seen) + 1) / (m + 1)), rate(max(seen.values(), default=0), m), rate(max(m - 1 - pairs, 0), m), rate(len(lines) - len(set(lines)), len(lines)), math.log1p(n / max(len(lines), 1)),
    ]


def document_statistics(docs: DataFrame) -> DataFrame:
    """doc_id and its statistics, one row for each row of ``docs``."""

    def run(batches: Iterator) -> Iterator[dict]:
        for batch in rows(batches, 2048):
            yield {"doc_id": batch["doc_id"], "x": [statistics(t) for t in batch["text"].to_pylist()]}

    return map_batches(docs.select("doc_id", "text"), run, "doc_id long, x array<double>")


@dataclass
class Discriminant:
    """What scoring needs: for each class the mean, the inverted Cholesky factor
    and the log density's constant. ``constant`` stands in where no label of one
    class was given."""

    means: list[np.ndarray]
    factors: list[np.ndarray]
    constants: list[float]
    constant: float | None = None

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(x), self.constant)
        logs = [k - 0.5 * np.square((x - m) @ f.T).sum(axis=1) for m, f, k in zip(self.means, self.factors, self.constants, strict=True)]
        return 1.0 / (1.0 + np.exp(np.clip(logs[0] - logs[1], -700, 700)))


def fit(labelled: DataFrame, shrinkage: float = 0.1) -> Discriminant:
    """Fit on ``labelled`` (x array<double>, label int 0 or 1).

    Only sums reach the driver: for each class a count, a mean and products, as
    many as there are statistics squared. Without a label of one class, every
    score is the share of label 1, add-one smoothed.
    """
    d = len(NAMES)

    def sums(batches: Iterator) -> Iterator[dict]:
        total = np.zeros((2, 1 + d + d * d))
        for batch in batches:
            x = np.array(batch["x"].to_pylist(), dtype=np.float64).reshape(-1, d)
            y = batch["label"].to_numpy(zero_copy_only=False)
            for c in (0, 1):
                own = x[y == c]
                total[c] += np.concatenate([[len(own)], own.sum(axis=0), (own.T @ own).ravel()])
        yield {"label": np.repeat([0, 1], total.shape[1]), "k": np.tile(np.arange(total.shape[1]), 2), "v": total.ravel()}

    parts = map_batches(labelled.select("x", "label"), sums, "label int, k int, v double")
    total = np.zeros((2, 1 + d + d * d))
    for label, k, v in parts.groupBy("label", "k").agg(F.sum("v")).collect():  # 2 * (1 + d + d * d) rows
        total[label, k] = v
    n = total[:, 0]
    if not n.all():
        return Discriminant([], [], [], float((n[1] + 1) / (n.sum() + 2)))
    means = [total[c, 1 : 1 + d] / n[c] for c in (0, 1)]
    scatter = [total[c, 1 + d :].reshape(d, d) - n[c] * np.outer(means[c], means[c]) for c in (0, 1)]
    pooled = np.diag((scatter[0] + scatter[1]) / n.sum()).clip(1e-6)
    factors, constants = [], []
    for c in (0, 1):
        s = (1 - shrinkage) * scatter[c] / n[c] + shrinkage * np.diag(pooled)
        lower = np.linalg.cholesky(s + 1e-9 * np.eye(d))
        factors.append(np.linalg.inv(lower))
        constants.append(float(math.log(n[c] / n.sum()) - np.log(np.diag(lower)).sum()))
    return Discriminant(means, factors, constants)


def apply(stats: DataFrame, model: Discriminant, threshold: float = 0.3) -> DataFrame:
    """doc_id, score in 0 to 1, predicted."""

    def run(batches: Iterator) -> Iterator[dict]:
        for batch in batches:
            if batch.num_rows:
                s = model.score(np.array(batch["x"].to_pylist(), dtype=np.float64))
                yield {"doc_id": batch["doc_id"], "score": s, "predicted": (s >= threshold).astype(np.int32)}

    return map_batches(stats.select("doc_id", "x"), run, "doc_id long, score double, predicted int")


def learn(stats: DataFrame, labels: DataFrame, folds: int = 5, shrinkage: float = 0.1) -> Discriminant:
    """Fit on documents' statistics and the labels outside the held-out fold.

    Label rows that repeat a doc_id count each, also where they contradict each other.
    """
    return fit(stats.join(usable(labels, folds), "doc_id"), shrinkage)


def usable(labels: DataFrame, folds: int) -> DataFrame:
    """doc_id and label of the rows that may be learned from."""
    return labels.select("doc_id", F.col("quality").cast("int").alias("label")).where(F.col("label").isin(0, 1) & ~held_out(folds))


def held_out(folds: int):
    return F.crc32(id_text().cast("binary")) % folds == 0


def accepted(docs: DataFrame, labels: DataFrame, folds: int = 5, threshold: float = 0.3, shrinkage: float = 0.1) -> DataFrame:
    """Rows of ``docs``, all columns, whose score reaches ``threshold``.

    The fit reads the labelled texts alone, whose ids are broadcast up to a million.
    """
    ids = materialize(usable(labels, folds).select("doc_id").distinct(), "labelled")
    stats = materialize(document_statistics(semi_join(docs, ids, ["doc_id"])), "statistics")
    model = learn(stats, labels, folds, shrinkage)

    def run(batches: Iterator) -> Iterator:
        for batch in rows(batches, 2048):
            if batch.num_rows:
                x = np.array([statistics(t) for t in batch["text"].to_pylist()])
                yield batch.filter(pa.array(model.score(x) >= threshold))

    return docs.mapInArrow(run, docs.schema)


def classify(docs: DataFrame, labels: DataFrame, folds: int = 5, threshold: float = 0.3, shrinkage: float = 0.1) -> DataFrame:
    """Score every row of ``docs`` (doc_id long, text string).

    ``labels`` has doc_id and quality; rows of the held-out fold (crc32 of the
    id as text is divisible by ``folds``) are never learned from, nor are rows
    with a quality other than 0 and 1 or without a document. Returns doc_id,
    held_out, score, predicted.

    A null text is as an empty one, which is scored like any other; a null
    doc_id counts as the empty text for folds and has no label; repeated rows
    are scored alike. No documents give no rows.
    """
    stats = materialize(document_statistics(docs), "statistics")
    model = learn(stats, labels, folds, shrinkage)
    return apply(stats, model, threshold).select("doc_id", held_out(folds).alias("held_out"), "score", "predicted")


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents, learned from the labels outside the held-out fold."""
    return classify(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
