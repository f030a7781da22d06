"""Shared helpers of the training-data operators.

Every operator selects the columns it needs first, so extra columns of any
name never clash, and returns only its own columns (and those documented).
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions.storage import materialize, shared_dir, without_shuffle_files

#: Keys up to this number (16 MB of longs) are broadcast; more are shuffled.
BROADCAST_KEYS = 1_000_000


def new_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def delete(spark: SparkSession, path: str) -> None:
    """Delete what a path of the shared folder holds, if anything."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def forget(*tables: DataFrame) -> None:
    """Delete tables made by ``materialize`` that nothing reads any more."""
    for df in tables:
        if path := getattr(df, "_written_to", None):
            delete(df.sparkSession, path)


@contextmanager
def bucketed(df: DataFrame, n: int, column: str, label: str) -> Iterator[DataFrame]:
    """``df`` as a table of ``n`` buckets in the shared folder, dropped with its files at the end, failures included."""
    spark, path = df.sparkSession, new_path(df.sparkSession, label)
    name = f"{label}_{uuid.uuid4().hex}"
    try:
        df.write.bucketBy(n, column).option("compression", "zstd").option("path", path).saveAsTable(name)
        yield spark.table(name)
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {name}")
        delete(spark, path)


def map_batches(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterable[dict]], schema: str) -> DataFrame:
    """``mapInArrow`` for functions that yield dicts of columns."""
    made = T._parse_datatype_string(schema) if not isinstance(schema, T.StructType) else schema
    arrow = to_arrow_schema(made)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for columns in fn(batches):
            yield pa.RecordBatch.from_arrays([pa.array(columns[f.name], type=f.type) for f in arrow], schema=arrow)

    return df.mapInArrow(run, made)


def rows(batches: Iterator[pa.RecordBatch], at_most: int = 512) -> Iterator[pa.RecordBatch]:
    """Smaller slices, so that Python objects of few rows are alive at a time."""
    for batch in batches:
        for k in range(0, batch.num_rows, at_most):
            yield batch.slice(k, at_most)


def semi_join(df: DataFrame, keys: DataFrame, on: list[str], limit: int = BROADCAST_KEYS, how: str = "left_semi") -> DataFrame:
    """Rows of ``df`` whose key is in ``keys``, or with ``left_anti`` is not.

    ``keys`` must be materialized: they are counted, and broadcast only up to
    ``limit``; beyond it both sides are shuffled and the keys are hashed.
    """
    keys = keys.select(*on).distinct()
    small = keys.limit(limit + 1).count() <= limit
    return df.join(F.broadcast(keys) if small else keys.hint("shuffle_hash"), on, how)


def id_text(col: str = "doc_id") -> Column:
    """The id as text, for folds; a null id is the empty text."""
    return F.coalesce(F.col(col).cast("string"), F.lit(""))


def with_sub(docs: DataFrame) -> DataFrame:
    """``docs`` with ``_sub``: 0, but where rows repeat a doc_id with different texts a digest of the text.

    (doc_id, _sub) names a text; rows that repeat it are one document, and texts
    of one doc_id are documents of their own, in the order of their digests.
    """
    digest = F.xxhash64(F.coalesce("text", F.lit("")))
    spread = docs.where("doc_id is not null").groupBy("doc_id").agg(F.min(digest).alias("lo"), F.max(digest).alias("hi")).where("lo <> hi")
    spread = materialize(spread.select("doc_id", F.lit(True).alias("_spread")), "spread")
    small = spread.limit(BROADCAST_KEYS + 1).count() <= BROADCAST_KEYS
    joined = docs.drop("_sub").join(F.broadcast(spread) if small else spread, "doc_id", "left")
    return joined.withColumn("_sub", F.when(F.col("_spread"), digest).otherwise(F.lit(0)).cast("long")).select(*[c for c in docs.columns if c != "_sub"], "_sub")


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")
