"""Propagation of node features along edges: join, message, aggregate.

Features are ``node long, x array<double>``. The join of edges and features and
the aggregation by target are plain shuffles with partial sums; Spark
broadcasts features that its own size estimate finds small.
"""

from __future__ import annotations

import inspect
from collections.abc import Callable
from typing import TYPE_CHECKING

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import reduce_vectors, scale, zeros
from .aggregates import WholeAggregate
from .edges import num_nodes, transpose
from .normalize import normalize_adjacency, normalize_edges

if TYPE_CHECKING:
    from .compress import Compressed

ENDS = {"source_to_target": ("src", "dst"), "target_to_source": ("dst", "src")}


def gather(edges: DataFrame, x: DataFrame, side: str = "src", hubs: int | None = None) -> DataFrame:
    """Edges with the features of one end: x_j for src, x_i for dst. ``hubs`` as in ``join_features``."""
    name = "x_j" if side == "src" else "x_i"
    return join_features(edges, x.select(F.col("node").alias(side), F.col("x").alias(name)), side, hubs)


def join_features(edges: DataFrame, x: DataFrame, on: str, hubs: int | None = None) -> DataFrame:
    """``edges`` joined with ``x`` on a node's id.

    With ``hubs``, the nodes that have more than one in ``hubs`` of all edges (so
    fewer than ``hubs`` nodes) are joined by a broadcast of their rows of ``x``, and
    only the edges of the others are shuffled. That takes a pass over the edges.
    """
    if hubs is None:
        return edges.join(x, on)
    counts = edges.groupBy(on).agg(F.count(F.lit(1)).alias("k"))
    total = edges.count()
    found = [r[0] for r in counts.where((F.col("k") > total / hubs) & F.col(on).isNotNull()).select(on).collect()]  # fewer than ``hubs``
    if not found:
        return edges.join(x, on)
    few = F.broadcast(edges.sparkSession.createDataFrame([(v,) for v in found], f"{on} long"))
    hot = edges.join(few, on, "left_semi").join(F.broadcast(x.join(few, on, "left_semi")), on)
    return hot.unionByName(edges.join(few, on, "left_anti").join(x, on))


def fill_nodes(sums: DataFrame, n: int, width: int) -> DataFrame:
    """Every id under ``n``; 0 where nothing came in."""
    nodes = sums.sparkSession.range(n).withColumnRenamed("id", "node")
    return nodes.join(sums, "node", "left").select("node", F.coalesce("x", zeros(width)).alias("x"))


def scatter_sum(messages: DataFrame, n: int, width: int) -> DataFrame:
    """node, x: sum of the messages (node, x) of each node. Order does not
    matter, so sums over runs of a sorted index are the same operation."""
    return fill_nodes(reduce_vectors(messages, "node", "x", width), n, width)


segment_sum = scatter_sum


def spmm(edges: DataFrame, x: DataFrame, n: int, width: int, transposed: bool = False) -> DataFrame:
    """A x (rows src, columns dst), or A' x. Weights default to 1."""
    row, col = ("dst", "src") if transposed else ("src", "dst")
    weight = F.col("weight") if "weight" in edges.columns else F.lit(1.0)
    joined = edges.select(F.col(row).alias("node"), F.col(col).alias("_col"), weight.alias("_w")).join(x.select(F.col("node").alias("_col"), F.col("x")), "_col")
    return scatter_sum(joined.select("node", scale(F.col("x"), F.col("_w")).alias("x")), n, width)


def spmv(edges: DataFrame, v: DataFrame, n: int) -> DataFrame:
    """node, v: A v for ``v`` (node, v double)."""
    weight = F.col("weight") if "weight" in edges.columns else F.lit(1.0)
    parts = edges.select("src", F.col("dst").alias("node"), weight.alias("_w")).join(v, "node")
    sums = parts.groupBy(F.col("src").alias("node")).agg(F.sum(F.col("_w") * F.col("v")).alias("v"))
    nodes = edges.sparkSession.range(n).withColumnRenamed("id", "node")
    return nodes.join(sums, "node", "left").select("node", F.coalesce("v", F.lit(0.0)).alias("v"))


def _hooked(edges: DataFrame, x: DataFrame, source: str, target: str, message: Callable[..., Column], wants: tuple[str, ...] = (), hubs: int | None = None) -> tuple[DataFrame, list[Column]]:
    """Edges with what a message hook asks for by its arguments' names, its message, and the columns that an aggregate ``wants``."""
    own = list(inspect.signature(message).parameters)
    names = own + list(wants)
    base = edges if "weight" in edges.columns else edges.withColumn("weight", F.lit(1.0))
    base = base.select(*[F.col(c).alias(f"_e_{c}") for c in base.columns])
    for end, mark in ((source, "j"), (target, "i")):
        wanted = sorted({n[:-2] for n in names if n.endswith(f"_{mark}")})
        if wanted or mark == "j":
            side = x.select(F.col("node").alias(f"_e_{end}"), *[F.col(c).alias(f"_{mark}_{c}") for c in wanted])
            base = join_features(base, side, f"_e_{end}", hubs) if mark == "j" else base.join(side, f"_e_{end}", "left")

    def column(name: str) -> Column:
        if name.endswith(("_i", "_j")):
            return F.col(f"_{name[-1]}_{name[:-2]}")
        return F.col("_e_weight" if name == "edge_weight" else f"_e_{name}")

    return base, [message(*[column(n) for n in own]).alias("x"), *[column(n).alias(n) for n in wants]]


def propagate(
    edges: DataFrame,
    x: DataFrame,
    size: int | tuple[int | None, int | None] | None,
    width: int,
    flow: str = "source_to_target",
    message: Callable[..., Column] | None = None,
    aggregate: Callable[[Column], Column] | WholeAggregate = F.sum,
    normalize: bool = False,
    strategy: str = "direct",
    alpha: int = 2,
    form: Compressed | None = None,
    hubs: int | None = None,
) -> DataFrame:
    """Collect, message, aggregate over every edge; ``flow`` is always honoured.

    ``size``: nodes, or (sources, targets); a missing side copies the other,
    None takes the largest id + 1. Nodes without messages get 0.

    ``message`` gives a vector column, by default ``weight * x_j``. Its arguments
    are chosen by name: ``x_j`` and ``x_i`` are the features of the sending and the
    receiving node, and so any column of ``x`` with ``_j`` or ``_i``; other names are
    columns of ``edges`` (``weight``, also as ``edge_weight``, is 1 where there is none).
    ``aggregate`` is applied to each component, or to whole messages if it is one of
    ``aggregates``. ``hubs`` spreads senders of very many edges (``join_features``);
    receivers of very many get partial sums of each task.

    ``normalize`` weights edges by the degrees on the receiving side, or scales the
    weights that they have by their sums there; other columns stay. ``strategy``
    ``compressed`` multiplies by the compressed matrix (``alpha`` as there): the same
    sums for edges without weights, messages and other aggregates. Its edges must be
    distinct. A ``form`` made before (of the edges as receiving node -> sending
    node) is used again; one of other edges raises.
    """
    source, target = ENDS[flow]
    sizes = size if isinstance(size, tuple) else (size, size)
    n = sizes[1] if sizes[1] is not None else sizes[0]
    n = num_nodes(edges) if n is None else n
    if strategy == "compressed":
        if message is not None or aggregate is not F.sum or "weight" in edges.columns:
            raise ValueError("compressed propagation sums features over edges without weights")
        from .compress import compress

        rows = edges.select(F.col(target).alias("src"), F.col(source).alias("dst"))
        form = form or compress(rows, num_nodes(rows), alpha, normalized=normalize)
        form.check_source(rows, normalize)
        return fill_nodes(form.matmul(x, width), n, width)
    if strategy != "direct":
        raise ValueError(f"unknown strategy {strategy}")
    if normalize:
        scaled = normalize_adjacency if "weight" in edges.columns else normalize_edges
        edges = scaled(edges) if source == "src" else transpose(scaled(transpose(edges)))
    message = message or (lambda x_j, edge_weight: scale(x_j, edge_weight))
    wants = aggregate.wants if isinstance(aggregate, WholeAggregate) else ()
    base, columns = _hooked(edges, x, source, target, message, wants, hubs)
    sent = base.select(F.col(f"_e_{target}").alias("node"), *columns)
    sums = aggregate.apply(sent, width) if isinstance(aggregate, WholeAggregate) else reduce_vectors(sent, "node", "x", width, aggregate)
    return fill_nodes(sums, n, width)


def feature_gradient(edges: DataFrame, g: DataFrame, n: int, width: int) -> DataFrame:
    """For y = A x and a gradient g of y: A' g."""
    return spmm(edges, g, n, width, transposed=True)
