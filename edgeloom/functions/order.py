"""Numbers by an order over all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .storage import materialize


def numbered(df: DataFrame, *order: str | Column, name: str = "at") -> DataFrame:
    """``df`` with ``name``: 0, 1, 2, ... by ``order``, in which ties are arbitrary.

    Rows are sorted over all tasks and written with their places in their task; a
    table of a row for each task then gives what comes before.
    """
    ordered = df.repartitionByRange(*order).sortWithinPartitions(*order)
    marked = materialize(ordered.withColumn("_place", F.monotonically_increasing_id()), "numbered").withColumn("_part", F.shiftright("_place", 33))
    sizes = marked.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    starts = sizes.select("_part", (F.sum("_n").over(W.orderBy("_part")) - F.col("_n")).alias("_start"))
    placed = marked.join(F.broadcast(starts), "_part")  # a row for each task of the sort
    return placed.select(*df.columns, (F.col("_start") + F.col("_place").bitwiseAND(F.lit((1 << 33) - 1))).alias(name))
