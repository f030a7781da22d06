"""Cleaning, layout and validation of edge tables (src long, dst long[, weight double]).

Null ids: ``check_edges`` reports them. Operators that return a row for each
node or join on ids leave edges with one out; ``transpose``, ``union_edges``,
``sort_edges`` and ``coalesce_edges`` keep them as they are; compression raises.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.order import numbered


def num_nodes(edges: DataFrame) -> int:
    """Largest id + 1; 0 without edges."""
    return edges.agg(nodes_column()).first()[0]


def nodes_column() -> Column:
    """The same as an aggregate."""
    return (F.coalesce(F.max(F.greatest("src", "dst")), F.lit(-1)) + 1).cast("long").alias("n")


def transpose(edges: DataFrame) -> DataFrame:
    rest = [c for c in edges.columns if c not in ("src", "dst")]
    return edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), *rest)


def remove_self_loops(edges: DataFrame) -> DataFrame:
    return edges.where("src <> dst")


def add_self_loops(edges: DataFrame, n: int, repeats: bool = True) -> DataFrame:
    """Existing loops dropped, one for each of ``n`` ids added, repeats removed.

    Without ``repeats`` the caller knows that there are none, and edges are not shuffled to look for them.
    """
    ids = edges.sparkSession.range(n)
    loops = ids.select(F.col("id").alias("src"), F.col("id").alias("dst"))
    inner = remove_self_loops(edges).select("src", "dst")
    return (inner.distinct() if repeats else inner).unionByName(loops)


def coalesce_edges(edges: DataFrame, ordered: bool = False) -> DataFrame:
    """One row for each (src, dst); weights of repeats are summed."""
    out = edges.groupBy("src", "dst").agg(F.sum("weight").alias("weight")) if "weight" in edges.columns else edges.select("src", "dst").distinct()
    return sort_edges(out) if ordered else out


def sort_edges(edges: DataFrame) -> DataFrame:
    return edges.orderBy("src", "dst")


def with_unit_weight(edges: DataFrame) -> DataFrame:
    return edges.withColumn("weight", F.lit(1.0))


def union_edges(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.unionByName(b)


def edge_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """Edges in one table alone, with the side that has them; empty if the sets are equal."""
    left, right = a.select("src", "dst").distinct(), b.select("src", "dst").distinct()
    return left.exceptAll(right).withColumn("side", F.lit("left")).union(right.exceptAll(left).withColumn("side", F.lit("right")))


def to_rows(edges: DataFrame, n: int) -> DataFrame:
    """row, nnz, entries (sorted col and val) of every row under ``n``, empty ones too."""
    val = F.col("weight") if "weight" in edges.columns else F.lit(1.0)
    packed = edges.groupBy(F.col("src").alias("row")).agg(F.sort_array(F.collect_list(F.struct(F.col("dst").alias("col"), val.alias("val")))).alias("entries"))
    nodes = edges.sparkSession.range(n).withColumnRenamed("id", "row")
    none = F.array().cast("array<struct<col: bigint, val: double>>")
    return nodes.join(packed, "row", "left").select("row", F.coalesce(F.size("entries"), F.lit(0)).cast("long").alias("nnz"), F.coalesce("entries", none).alias("entries"))


def to_row_chunks(edges: DataFrame, size: int = 65_536, n: int | None = None) -> DataFrame:
    """row, chunk (from 0), nnz, entries: each row in chunks of at most ``size`` sorted entries, so that a row of any length is never in one list.

    Edges are sorted by (src, dst) over all tasks and cut at every ``size``-th
    place, and where a row ends. ``to_edges`` takes chunks as it takes rows. With
    ``n``, rows under it without entries have one empty chunk.
    """
    val = F.col("weight") if "weight" in edges.columns else F.lit(1.0)
    placed = numbered(edges.select("src", "dst", val.alias("val")).where("src is not null"), "src", "dst")
    cut = placed.select("src", "dst", "val", F.floor(F.col("at") / size).alias("cut"))
    packed = cut.groupBy("src", "cut").agg(F.sort_array(F.collect_list(F.struct(F.col("dst").alias("col"), "val"))).alias("entries"))
    first = cut.groupBy("src").agg(F.min("cut").alias("first"))
    chunks = packed.join(first, "src").select(F.col("src").alias("row"), (F.col("cut") - F.col("first")).alias("chunk"), F.size("entries").cast("long").alias("nnz"), "entries")
    if n is None:
        return chunks
    empty = edges.sparkSession.range(n).withColumnRenamed("id", "row").join(first.select(F.col("src").alias("row")), "row", "left_anti")
    return chunks.unionByName(empty.select("row", F.lit(0).cast("long").alias("chunk"), F.lit(0).cast("long").alias("nnz"), F.array().cast("array<struct<col: bigint, val: double>>").alias("entries")))


def row_pointer(rows: DataFrame, span: int = 65_536) -> DataFrame:
    """row, ptr: entries before each row."""
    return sums_before(rows.select("row", "nnz"), "row", "nnz", "ptr", span)


def sums_before(df: DataFrame, key: str, value: str, name: str, span: int = 65_536) -> DataFrame:
    """``key`` and ``name``: the sum of ``value`` over smaller keys (long, distinct).

    Running sums are taken within spans of keys and over the spans' totals, so no
    task sees all rows.
    """
    cut = df.select(key, value, F.floor(F.col(key) / span).alias("_span"))
    totals = cut.groupBy("_span").agg(F.sum(value).alias("_n"))
    before = totals.select("_span", (F.sum("_n").over(W.orderBy("_span")) - F.col("_n")).alias("_before"))
    inside = F.sum(value).over(W.partitionBy("_span").orderBy(key)) - F.col(value)
    return cut.withColumn("_inside", inside).join(before, "_span").select(key, (F.col("_before") + F.col("_inside")).cast("long").alias(name))


def to_edges(rows: DataFrame) -> DataFrame:
    return rows.select(F.col("row").alias("src"), F.explode("entries").alias("e")).select("src", F.col("e.col").alias("dst"), F.col("e.val").alias("weight"))


def check_edges(edges: DataFrame, raise_on_error: bool = False) -> DataFrame:
    """One row: contiguous, coalesced, starts_at_zero, no_nulls. ``src`` and ``dst`` must be long."""
    kinds = dict(edges.dtypes)
    if kinds.get("src") != "bigint" or kinds.get("dst") != "bigint":
        raise ValueError("src and dst must be long")
    pairs = edges.groupBy("src", "dst").agg(F.count(F.lit(1)).alias("k"))
    per_pair = pairs.agg(F.sum("k").alias("rows"), F.count(F.lit(1)).alias("pairs"), F.max(F.greatest("src", "dst")).alias("hi"), F.min(F.least("src", "dst")).alias("lo"), F.count(F.when(F.col("src").isNull() | F.col("dst").isNull(), 1)).alias("nulls"))
    ids = pairs.select(F.explode(F.array("src", "dst")).alias("id")).where("id is not null").distinct().agg(F.count(F.lit(1)).alias("ids"))
    report = per_pair.join(ids).select(  # one row each
        F.coalesce(F.col("ids") == F.col("hi") + 1, F.lit(True)).alias("contiguous"),
        F.coalesce(F.col("rows") == F.col("pairs"), F.lit(True)).alias("coalesced"),
        F.coalesce(F.col("lo") == 0, F.lit(True)).alias("starts_at_zero"),
        (F.col("nulls") == 0).alias("no_nulls"),
    )
    if raise_on_error:
        bad = [k for k, v in report.first().asDict().items() if not v]
        if bad:
            raise ValueError("edges are not " + ", ".join(bad))
    return report
