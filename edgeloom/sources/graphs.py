"""Reading and writing edge tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.edges import sums_before


def read_edges(spark: SparkSession, path: str, format: str = "parquet", src: str = "src", dst: str = "dst", **options: str) -> DataFrame:
    """src, dst (long) of a stored table; CSV columns are read as text and cast."""
    return spark.read.format(format).options(**options).load(path).select(F.col(src).cast("long").alias("src"), F.col(dst).cast("long").alias("dst"))


def read_coordinate_text(spark: SparkSession, path: str) -> DataFrame:
    """src, dst, weight of coordinate text files: comments start with %, ids from
    1, the first other line of each file holds the sizes.

    Symmetric, skew-symmetric and hermitian files are mirrored, skew-symmetric
    ones with the opposite sign. Values of complex files are their real part, as
    the weight is one number. Dense files (``array``) raise.
    """
    lines = spark.read.text(path).select(F.trim("value").alias("value"), F.col("_metadata.file_path").alias("file"), F.struct(F.input_file_block_start().alias("block"), F.monotonically_increasing_id().alias("k")).alias("place"))
    head = F.lower("value")
    kinds = lines.where(head.startswith("%%matrixmarket")).groupBy("file").agg(F.first(head).alias("kind"))  # a row for each file
    if kinds.where(F.col("kind").contains(" array")).head(1):
        raise ValueError("dense files hold no coordinates")
    body = lines.where(~F.col("value").startswith("%") & (F.col("value") != ""))
    sizes = body.groupBy("file").agg(F.min("place").alias("first"))
    parts = body.join(sizes, "file").where("place <> first").join(kinds, "file", "left").select(F.split("value", r"\s+").alias("p"), F.coalesce("kind", F.lit("")).alias("kind"))
    value = F.coalesce(F.get("p", F.lit(2)).cast("double"), F.lit(1.0))
    out = parts.select((F.get("p", F.lit(0)).cast("long") - 1).alias("src"), (F.get("p", F.lit(1)).cast("long") - 1).alias("dst"), F.when(F.col("kind").contains("pattern"), 1.0).otherwise(value).alias("weight"), "kind")
    skew, mirrored = F.col("kind").contains("skew-symmetric"), F.col("kind").contains("symmetric") | F.col("kind").contains("hermitian")
    other = out.where(mirrored & (F.col("src") != F.col("dst"))).select("dst", "src", F.when(skew, -F.col("weight")).otherwise(F.col("weight")))
    return out.select("src", "dst", "weight").union(other)


def batch_graphs(edges: DataFrame, sizes: DataFrame) -> DataFrame:
    """graph_id, src, dst of many graphs as one: ids are shifted by the nodes of
    the graphs before. ``sizes`` is (graph_id, n), a row for each graph."""
    shifts = sums_before(sizes.select("graph_id", "n"), "graph_id", "n", "offset")
    return edges.join(shifts, "graph_id").select("graph_id", (F.col("src") + F.col("offset")).alias("src"), (F.col("dst") + F.col("offset")).alias("dst"))


def write_table(df: DataFrame, path: str, format: str = "parquet") -> None:
    df.write.mode("overwrite").format(format).save(path)
