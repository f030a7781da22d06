"""Column helpers for dense rows (array<double>)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLOCK = 64


def zeros(width: int) -> Column:
    return F.array_repeat(F.lit(0.0), width)


def add(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x + y)


def scale(x: Column, by: Column) -> Column:
    return F.transform(x, lambda v: v * by)


def relu(x: Column) -> Column:
    return F.transform(x, lambda v: F.greatest(v, F.lit(0.0)))


def inv_sqrt(x: Column) -> Column:
    """x^-1/2, 0 where x is 0 or less."""
    return F.when(x > 0, F.pow(x.cast("double"), F.lit(-0.5))).otherwise(F.lit(0.0))


def reduce_vectors(df: DataFrame, key: str, col: str, width: int, how: Callable[[Column], Column] = F.sum) -> DataFrame:
    """key, ``col``: elementwise aggregate of vectors by key.

    One aggregate a component keeps partial sums in generated code; rows wider
    than ``BLOCK`` are split into blocks that are shuffled and summed apart.
    """
    if width <= BLOCK:
        sums = df.groupBy(key).agg(*[how(F.col(col)[i]).alias(f"_{i}") for i in range(width)])
        return sums.select(key, F.array(*[F.col(f"_{i}") for i in range(width)]).alias(col))
    blocks = F.array(*[F.slice(col, i + 1, BLOCK) for i in range(0, width, BLOCK)])
    parts = df.select(key, F.posexplode(blocks).alias("_b", "_v"))
    summed = parts.groupBy(key, "_b").agg(*[how(F.get(F.col("_v"), F.lit(i))).alias(f"_{i}") for i in range(BLOCK)])
    whole = summed.select(key, F.struct("_b", F.array(*[F.col(f"_{i}") for i in range(BLOCK)]).alias("_v")).alias("_p"))
    return whole.groupBy(key).agg(F.array_sort(F.collect_list("_p")).alias("_p")).select(key, F.slice(F.flatten("_p._v"), 1, width).alias(col))
