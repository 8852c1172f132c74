"""State tables in buckets of their key, of which an update rewrites only those it touches."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagelake.session import cut_lineage

BUCKET = "bucket"
# Buckets of a state table; a state of B bytes has buckets of about B / BUCKETS.
BUCKETS = 64
# Files of a bucket, about.
FILES = 4


def _bucket(keys: list[str], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*[F.col(k).cast("string") for k in keys]), F.lit(buckets)).cast("int").alias(BUCKET)


def _spread(rows: DataFrame) -> DataFrame:
    """Rows by bucket, each bucket over a few tasks and files, so that a hot key is not one task's work."""
    return rows.repartition(F.col(BUCKET), F.pmod(F.xxhash64(*rows.columns), F.lit(FILES)))


def write_buckets(state: DataFrame, path: str, keys: list[str], buckets: int = BUCKETS) -> None:
    """Write ``state`` in one folder per bucket of its ``keys``."""
    placed = state.select("*", _bucket(keys, buckets))
    _spread(placed).write.mode("overwrite").partitionBy(BUCKET).parquet(path)


def read_buckets(spark: SparkSession, path: str, schema) -> DataFrame:
    """The whole state."""
    return spark.read.schema(schema).parquet(path).select(*[f.name for f in schema.fields])


def update_buckets(spark: SparkSession, path: str, changes: DataFrame, keys: list[str],
                   merge: Callable[[DataFrame, DataFrame], DataFrame], schema, buckets: int = BUCKETS) -> list[int]:
    """Merge ``changes`` into the state under ``path``; returns the buckets that were rewritten.

    Only buckets with a changed key are read and written: the read is pruned to
    their folders, and the write replaces these folders alone.  ``merge`` gets
    the old rows and the changes of these buckets and returns the new rows.
    """
    changes = cut_lineage(changes.select("*", _bucket(keys, buckets)))
    # at most one row per bucket
    touched = sorted(r[0] for r in changes.select(BUCKET).distinct().collect())
    if not touched:
        return []
    old = spark.read.schema(T.StructType([*schema.fields, T.StructField(BUCKET, T.IntegerType())])).parquet(path)
    old = old.where(F.col(BUCKET).isin(touched)).drop(BUCKET)
    # the new rows exist before the old folders go
    new = cut_lineage(merge(old, changes.drop(BUCKET)).select("*", _bucket(keys, buckets)))
    _spread(new).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(BUCKET).parquet(path)
    return touched
