"""Graph convolution layers over edge tables."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.storage import materialize
from ..functions.vectors import inv_sqrt
from ..functions.vectors import relu as relu_column
from ..functions.vectors import scale
from .compress import Compressed, compress
from .propagate import fill_nodes, propagate


def glorot(n_out: int, n_in: int, seed: int = 0) -> np.ndarray:
    limit = (6.0 / (n_in + n_out)) ** 0.5
    return np.random.default_rng(seed).uniform(-limit, limit, (n_out, n_in))


def linear(x: DataFrame, w: np.ndarray) -> DataFrame:
    """x W' without bias: one product a batch, no shuffle. ``w`` is out x in."""
    w = np.asarray(w, dtype=float)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            flat = b["x"].flatten().to_numpy(zero_copy_only=False).reshape(-1, w.shape[1])
            y = flat @ w.T
            offsets = pa.array(np.arange(0, y.size + 1, w.shape[0], dtype=np.int32))
            yield pa.RecordBatch.from_arrays([b["node"], pa.ListArray.from_arrays(offsets, pa.array(y.ravel()))], ["node", "x"])

    return x.select("node", "x").mapInArrow(run, "node long, x array<double>")


def relu(x: DataFrame) -> DataFrame:
    return x.select("node", relu_column(F.col("x")).alias("x"))


def _scales(edges: DataFrame) -> DataFrame:
    """node, scale = deg^-1/2 of targets. Written."""
    counts = edges.groupBy(F.col("dst").alias("node")).agg(F.count(F.lit(1)).alias("deg"))
    return materialize(counts.select("node", inv_sqrt(F.col("deg")).alias("scale")), "scales")


def _scaled(x: DataFrame, scales: DataFrame) -> DataFrame:
    """Features times their node's scale, 0 where it has none."""
    return x.select("node", "x").join(scales, "node", "left").select("node", scale(F.col("x"), F.coalesce("scale", F.lit(0.0))).alias("x"))


def _normalized_sums(edges: DataFrame, scales: DataFrame, x: DataFrame, n: int, width: int) -> DataFrame:
    """Propagation over ``normalize_edges``: features are scaled before and sums after it, so edges carry no weight and are joined once."""
    sums = propagate(edges.select("src", "dst"), _scaled(x, scales), n, width, message=lambda x_j: x_j)
    return _scaled(sums, scales)


def gcn_layer(edges: DataFrame, x: DataFrame, w: np.ndarray, n: int, normalized: bool = False) -> DataFrame:
    """linear, then propagation with symmetric weights; ``normalized``: edges have them already."""
    h = linear(x, w)
    return propagate(edges, h, n, len(w)) if normalized else _normalized_sums(edges, _scales(edges), h, n, len(w))


def compressed_gcn_layer(c: Compressed, x: DataFrame, w: np.ndarray) -> DataFrame:
    """The same over a normalised compressed form of the transposed edges."""
    return c.matmul(linear(x, w), len(w))


def gcn_model(edges: DataFrame, x: DataFrame, weights: list[np.ndarray], n: int, strategy: str = "direct", form: Compressed | None = None, alpha: int = 2) -> DataFrame:
    """Two layers or more, relu between them; the nodes' scales are computed once.

    ``strategy`` ``compressed`` multiplies by a normalised compressed form, built
    once for all layers, or by ``form``, one of the edges as target -> source
    that was built (and perhaps written) before; a form of other edges raises.
    """
    if len(weights) < 2:
        raise ValueError("a model has two layers at least")
    if strategy == "compressed":
        rows = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
        form = form or compress(rows, n, alpha, normalized=True)
        form.check_source(rows, normalized=True)
        layer = lambda x, w: fill_nodes(compressed_gcn_layer(form, x, w), n, len(w))
    elif strategy == "direct":
        scales = _scales(edges)
        layer = lambda x, w: _normalized_sums(edges, scales, linear(x, w), n, len(w))
    else:
        raise ValueError(f"unknown strategy {strategy}")
    for k, w in enumerate(weights):
        x = layer(x, w)
        x = relu(x) if k + 1 < len(weights) else x
    return x


def weight_gradient(edges: DataFrame, x: DataFrame, g: DataFrame, n: int, n_in: int, n_out: int, normalized: bool = False) -> DataFrame:
    """out, in, v: the gradient g' (A x) of a layer's weight; partial outer products a batch."""
    h = propagate(edges, x, n, n_in) if normalized else _normalized_sums(edges, _scales(edges), x, n, n_in)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((n_out, n_in))
        for b in batches:
            left = b["g"].flatten().to_numpy(zero_copy_only=False).reshape(-1, n_out)
            total += left.T @ b["x"].flatten().to_numpy(zero_copy_only=False).reshape(-1, n_in)
        i, j = np.indices(total.shape)
        yield pa.RecordBatch.from_arrays([pa.array(i.ravel()), pa.array(j.ravel()), pa.array(total.ravel())], ["out", "in", "v"])

    both = h.join(g.select("node", F.col("x").alias("g")), "node").select("x", "g")
    return both.mapInArrow(run, "out long, in long, v double").groupBy("out", "in").agg(F.sum("v").alias("v"))
