"""Degrees and symmetric normalisation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import inv_sqrt


def degree(edges: DataFrame, n: int, side: str = "dst") -> DataFrame:
    """node, deg of every id under ``n``, 0 included."""
    counts = edges.groupBy(F.col(side).alias("node")).agg(F.count(F.lit(1)).alias("deg"))
    nodes = edges.sparkSession.range(n).withColumnRenamed("id", "node")
    return nodes.join(counts, "node", "left").select("node", F.coalesce("deg", F.lit(0)).cast("long").alias("deg"))


def inv_sqrt_degree(edges: DataFrame, n: int, side: str = "dst") -> DataFrame:
    """node, deg, scale = deg^-1/2, 0 for degree 0."""
    return degree(edges, n, side).withColumn("scale", inv_sqrt(F.col("deg")))


def _others(edges: DataFrame) -> list[str]:
    return [c for c in edges.columns if c not in ("src", "dst", "weight")]


def normalize_edges(edges: DataFrame) -> DataFrame:
    """src, dst, weight = deg(src)^-1/2 * deg(dst)^-1/2, degrees of targets, and the edges' other columns."""
    counts = edges.groupBy(F.col("dst").alias("node")).agg(F.count(F.lit(1)).alias("deg"))
    scales = counts.select("node", inv_sqrt(F.col("deg")).alias("scale"))
    ends = edges.join(scales.select(F.col("node").alias("src"), F.col("scale").alias("scale_src")), "src", "left").join(scales.select(F.col("node").alias("dst"), F.col("scale").alias("scale_dst")), "dst")
    return ends.select("src", "dst", (F.coalesce("scale_src", F.lit(0.0)) * F.col("scale_dst")).alias("weight"), *_others(edges))


def normalize_adjacency(edges: DataFrame) -> DataFrame:
    """src, dst, weight scaled on both sides by (column sum)^-1/2, and the edges' other columns."""
    sums = edges.groupBy(F.col("dst").alias("node")).agg(F.sum("weight").alias("s"))
    scales = sums.select("node", inv_sqrt(F.col("s")).alias("scale"))
    ends = edges.join(scales.select(F.col("node").alias("src"), F.col("scale").alias("scale_src")), "src", "left").join(scales.select(F.col("node").alias("dst"), F.col("scale").alias("scale_dst")), "dst")
    return ends.select("src", "dst", (F.col("weight") * F.coalesce("scale_src", F.lit(0.0)) * F.col("scale_dst")).alias("weight"), *_others(edges))
