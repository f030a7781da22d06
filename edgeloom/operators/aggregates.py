"""Aggregates of whole messages, for ``propagate``.

A function of one column, such as ``F.max``, is applied to each component of a
message. These see the vector as a whole, and may ask for more columns by name, as
message hooks do.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import reduce_vectors, scale


class WholeAggregate:
    """``apply`` turns messages (node, x and the columns named in ``wants``) into one row (node, x) a node."""

    wants: tuple[str, ...] = ()

    def apply(self, sent: DataFrame, width: int) -> DataFrame:
        raise NotImplementedError


class Largest(WholeAggregate):
    """The message with the largest Euclidean norm; of equal ones the last in the order of their components."""

    def apply(self, sent: DataFrame, width: int) -> DataFrame:
        norm = F.aggregate("x", F.lit(0.0), lambda a, v: a + v * v)
        return sent.groupBy("node").agg(F.max_by("x", F.struct(norm, "x")).alias("x"))


@dataclass
class WeightedMean(WholeAggregate):
    """The mean of messages with weights of their own; a null weight is 0, and weights that sum to 0 give 0."""

    weight: str = "edge_weight"

    @property
    def wants(self) -> tuple[str, ...]:
        return (self.weight,)

    def apply(self, sent: DataFrame, width: int) -> DataFrame:
        w = F.coalesce(F.col(self.weight).cast("double"), F.lit(0.0))
        weighed = sent.select("node", F.concat(scale(F.col("x"), w), F.array(w)).alias("x"))
        sums = reduce_vectors(weighed, "node", "x", width + 1)
        total = F.col("x")[width]
        return sums.select("node", F.transform(F.slice("x", 1, width), lambda v: F.when(total != 0, v / total).otherwise(0.0)).alias("x"))


@dataclass
class SoftMaximum(WholeAggregate):
    """Each component's mean with weights exp(sharpness * component), in two passes: maxima first, so that no weight overflows."""

    sharpness: float = 1.0

    def apply(self, sent: DataFrame, width: int) -> DataFrame:
        tops = reduce_vectors(sent, "node", "x", width, F.max).withColumnRenamed("x", "top")
        weights = F.zip_with("x", "top", lambda v, t: F.exp((v - t) * self.sharpness))
        both = sent.join(tops, "node").withColumn("w", weights).select("node", F.concat(F.zip_with("x", "w", lambda v, w: v * w), "w").alias("x"))
        sums = reduce_vectors(both, "node", "x", 2 * width)
        return sums.select("node", F.zip_with(F.slice("x", 1, width), F.slice("x", width + 1, width), lambda a, b: a / b).alias("x"))
