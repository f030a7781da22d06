"""Graphs that are derived from the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.order import numbered
from ..functions.storage import materialize
from ..operators.edges import num_nodes


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Lines of orders for each task that makes or tells apart their pairs, about.
LINES_AT_ONCE = 250_000


def copurchase(spark: SparkSession, sf_dir: str) -> DataFrame:
    """part -> part of one order; symmetric. Written once, as its users read it several times.

    The number of tasks follows that of the lines, so that a task's tables of pairs
    stay as they are when the input grows.
    """
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey")
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-lines.count() // LINES_AT_ONCE))
    lines = lines.repartition(tasks, "l_orderkey")
    a = lines.select("l_orderkey", F.col("l_partkey").cast("long").alias("src"))
    b = lines.select("l_orderkey", F.col("l_partkey").cast("long").alias("dst"))
    pairs = a.join(b, "l_orderkey").where("src < dst").select("src", "dst").repartition(tasks, "src", "dst").distinct()  # one way round, half the pairs to tell apart
    ways = F.explode(F.array(F.struct("src", "dst"), F.struct(F.col("dst").alias("src"), F.col("src").alias("dst"))))
    return materialize(pairs.select(ways.alias("e")).select("e.src", "e.dst"), "copurchase")


def part_supp(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(F.col("l_partkey").cast("long").alias("src"), F.col("l_suppkey").cast("long").alias("dst")).distinct()


def order_part(spark: SparkSession, sf_dir: str, repeats: bool = False) -> DataFrame:
    out = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").cast("long").alias("src"), F.col("l_partkey").cast("long").alias("dst"))
    return out if repeats else out.distinct()


def user_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.datediff(F.to_date("ts"), F.lit("2024-01-01").cast("date"))
    return table(spark, sf_dir, "events").select(F.col("user_id").cast("long").alias("src"), day.cast("long").alias("dst")).distinct()


def doc_word(spark: SparkSession, sf_dir: str) -> DataFrame:
    """document -> word, words by their place in the alphabet: near copies, and words that most documents have."""
    words = F.explode(F.split(F.lower("text"), "[\\t\\n\\f\\r ]+")).alias("word")
    found = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("src"), words).where("word <> ''").distinct()
    found = materialize(found, "words")
    return found.join(numbered(found.select("word").distinct(), "word", name="dst"), "word").select("src", "dst")


def part_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """node, x = (p_size, p_partkey mod 7)."""
    part = table(spark, sf_dir, "part")
    key = F.col("p_partkey").cast("long")
    return part.select(key.alias("node"), F.array(F.col("p_size").cast("double"), (key % 7).cast("double")).alias("x"))


def day_features(spark: SparkSession, n: int) -> DataFrame:
    """node, x = (id mod 11, id)."""
    return spark.range(n).select(F.col("id").alias("node"), F.array((F.col("id") % 11).cast("double"), F.col("id").cast("double")).alias("x"))


def sized(edges: DataFrame) -> int:
    return num_nodes(edges)
