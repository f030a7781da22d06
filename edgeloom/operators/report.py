"""Comparisons and summaries of metric tables (dataset, method, alpha, size, value)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .edges import nodes_column


def graph_stats(edges: DataFrame, n: int | None = None, by: str | None = None) -> DataFrame:
    """nodes, edges, and the mean row length once every node has one loop.

    With ``by`` one row for each of that column's values, in one pass; nodes are
    ``n``, or else the largest id + 1.
    """
    keys = [by] if by else []
    inner = F.count(F.when(F.col("src") != F.col("dst"), 1))
    nodes = nodes_column() if n is None else F.lit(n).cast("long")
    sums = edges.select(*keys, "src", "dst").distinct().groupBy(*keys).agg(nodes.alias("nodes"), F.count(F.lit(1)).alias("edges"), inner.alias("inner"))
    return sums.select(*keys, "nodes", "edges", F.try_divide(F.col("inner") + F.col("nodes"), F.col("nodes").cast("double")).alias("mean_row"))


def differences(a: DataFrame, b: DataFrame, atol: float = 1e-4, rtol: float = 1e-4) -> DataFrame:
    """node, of both (node, x), where one is missing or some |a - b| is over atol + rtol |b|."""
    both = a.select("node", F.col("x").alias("p")).join(b.select("node", F.col("x").alias("q")), "node", "full_outer")
    over = F.exists(F.zip_with("p", "q", lambda p, q: F.coalesce(F.abs(p - q) > atol + rtol * F.abs(q), F.lit(True))), lambda v: v)
    return both.where(F.col("p").isNull() | F.col("q").isNull() | over).select("node")


def assert_close(a: DataFrame, b: DataFrame, atol: float = 1e-4, rtol: float = 1e-4) -> None:
    """Raise unless both (node, x) have the same nodes and |a - b| <= atol + rtol |b|."""
    if bad := differences(a, b, atol, rtol).head(1):
        raise AssertionError(f"rows differ, first at node {bad[0].node}")


def timing(metrics: DataFrame) -> DataFrame:
    """mean, median and population deviation of value by dataset and method."""
    return metrics.groupBy("dataset", "method").agg(F.mean("value").alias("mean"), F.percentile("value", F.lit(0.5)).alias("median"), F.stddev_pop("value").alias("std"))


def winners(metrics: DataFrame) -> DataFrame:
    """Flags the method of least value for each dataset and size."""
    best = F.row_number().over(W.partitionBy("dataset", "size").orderBy("value", "method")) == 1
    return metrics.withColumn("winner", best)


def best_alpha(metrics: DataFrame) -> DataFrame:
    return metrics.groupBy("dataset").agg(F.min_by("alpha", F.struct("value", "alpha")).alias("alpha"))


def improvement(metrics: DataFrame, reference: str) -> DataFrame:
    """Per cent saved against the reference method of the same dataset and size."""
    ref = metrics.where(F.col("method") == reference).select("dataset", "size", F.col("value").alias("ref"))
    saved: Column = F.try_divide(F.col("ref") - F.col("value"), F.col("ref")) * 100
    return metrics.join(ref, ["dataset", "size"]).select("dataset", "size", "method", saved.alias("saved"))


def wide(metrics: DataFrame, methods: list[str]) -> DataFrame:
    return metrics.groupBy("dataset", "size").pivot("method", methods).agg(F.first("value"))


def long(table: DataFrame, methods: list[str]) -> DataFrame:
    return table.unpivot(["dataset", "size"], methods, "method", "value")
