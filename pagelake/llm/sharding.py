"""Sharding by jump consistent hashing.

The shard of a row depends on its id and the number of shards alone: no ring
table, no state.  When shards are appended, a row either stays or goes to a new
shard, so only the necessary fraction of the rows moves.  ``write`` lays a table
out in one folder per shard; ``grow`` writes just the rows that move, and
``read`` skips the copies they left behind.

Slots number the rows of a shard without a gap, in the order of a digest of
(id, size, crc32): a stable random order.  Rows are counted in blocks of equal
leading digits, only the table of block totals is ordered per shard, and rows
that agree in everything are counted first and expanded after, so neither a
large shard nor a much repeated row is numbered in one piece.

Defined results: a null id is keyed as the empty text, so all such rows share a
shard; a null text has no bytes (size 1, crc32 0) as an empty one has; repeated
rows share a shard and take slots of their own; an empty table gives an empty
result; texts are only measured, so very long ones cost their length; other
columns are ignored by ``place`` and kept by ``assign`` and ``write``.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pagelake.llm.common import apart, pick, written

LAW = "key"
SHARDS = 8
# Rows of a shard that are numbered in one sorted block, about; and copies expanded from one row at a time.
BLOCK_ROWS = 50_000
COPIES = 4_096
# The multiplier and the range of the published jump hash.
_MULTIPLIER = np.uint64(2862933555777941757)
_RANGE = float(1 << 31)


def jump(keys: np.ndarray, shards: int) -> np.ndarray:
    """Shard of each unsigned 64-bit key; all keys that still jump do so together."""
    if shards < 1:
        raise ValueError("need one shard at least")
    state, place = keys.astype("uint64"), np.zeros(len(keys), "int64")
    moving = np.arange(len(keys))
    while len(moving):
        state[moving] = state[moving] * _MULTIPLIER + np.uint64(1)
        draw = (state[moving] >> np.uint64(33)).astype("float64") + 1.0
        target = ((place[moving] + 1) * (_RANGE / draw)).astype("int64")
        moving, target = moving[target < shards], target[target < shards]
        place[moving] = target
    return place.astype("int32")


def shard_key(the_id: Column) -> Column:
    """The first 64 bits of the digest of an id's text, as a signed long: stable over types, sessions and releases."""
    return F.conv(F.substring(F.md5(F.coalesce(the_id.cast("string"), F.lit("")).cast("binary")), 1, 16), 16, -10).cast("bigint")


def shard_of(key: Column, shards: int) -> Column:
    """Shard number of a key from ``shard_key``."""

    @F.pandas_udf("int")
    def run(keys: pd.Series) -> pd.Series:
        return pd.Series(jump(keys.to_numpy("int64").view("uint64"), shards))

    return run(key)


def assign(docs: DataFrame, shards: int = SHARDS, id_col: str = "doc_id", name: str = "shard") -> DataFrame:
    """``docs`` with the shard of each row in a column ``name`` at the end."""
    d, new, old = apart(docs)
    d = d.withColumn("shard_key", shard_key(F.col(new[old.index(id_col)])))
    return d.withColumn("shard_no", shard_of(F.col("shard_key"), shards)).select(*new, "shard_no").toDF(*old, name)


def place(docs: DataFrame, shards: int = SHARDS, id_col: str = "doc_id", text_col: str = "text",
          block_rows: int = BLOCK_ROWS, copies: int = COPIES) -> DataFrame:
    """``(doc_id, size, text_crc32, shard, slot, grown_shard)``; ``grown_shard`` is the shard with one shard more."""
    d = pick(docs, doc_id=id_col, text=text_col).select(
        "doc_id", (F.octet_length(F.coalesce("text", F.lit(""))) + 1).cast("bigint").alias("size"),
        F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"))
    # equal rows become one before Python sees the keys, which keeps whole texts out of its queue too
    d = d.groupBy("doc_id", "size", "text_crc32").agg(F.count(F.lit(1)).alias("n"))
    name = F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "size", "text_crc32")
    d = d.withColumn("shard_key", shard_key(F.col("doc_id"))).withColumn("at", F.md5(name.cast("binary")))
    d = d.select("doc_id", "size", "text_crc32", "n", "at", shard_of(F.col("shard_key"), shards).alias("shard"),
                 shard_of(F.col("shard_key"), shards + 1).alias("grown_shard"))
    rows = written(d, "shards")
    total, most = rows.agg(F.count(F.lit(1)), F.max("n")).first()
    digits = 0
    while shards * 16**digits * block_rows < total:
        digits += 1
    rows = rows.withColumn("block", F.substring("at", 1, digits) if digits else F.lit(""))
    of_block = rows.groupBy("shard", "block").agg(F.sum("n").alias("block_n"))
    earlier = Window.partitionBy("shard").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    of_block = of_block.select("shard", "block", F.coalesce(F.sum("block_n").over(earlier), F.lit(0)).alias("before"))
    inside = (Window.partitionBy("shard", "block").orderBy("at", "doc_id", "size", "text_crc32")
              .rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("inside", F.coalesce(F.sum("n").over(inside), F.lit(0))).join(of_block, ["shard", "block"])
    kept = ["doc_id", "size", "text_crc32", "shard", "grown_shard"]
    first = (F.col("before") + F.col("inside")).alias("first")
    runs = rows.select(*kept, first, "n", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("n") - 1) / copies))).alias("run"))
    if most and most > copies:  # the copies of one row go to many tasks
        runs = runs.repartition("doc_id", "run")
    begin = F.col("run") * copies
    slots = runs.select(*kept, "first", F.explode(F.sequence(begin, F.least(F.col("n"), begin + copies) - 1)).alias("copy"))
    return slots.select("doc_id", "size", "text_crc32", "shard", (F.col("first") + F.col("copy")).alias("slot"), "grown_shard")


def write(docs: DataFrame, path: str, shards: int = SHARDS, id_col: str = "doc_id") -> None:
    """Write ``docs`` under ``path``, one folder ``shard=N`` per shard; a column ``shard`` of their own is refused."""
    if "shard" in (c.lower() for c in docs.columns):
        raise ValueError("the files name the shard in a column of their own")
    assign(docs, shards, id_col).write.partitionBy("shard").parquet(path)


def read(spark: SparkSession, path: str, shards: int, id_col: str = "doc_id") -> DataFrame:
    """Rows under ``path`` with their ``shard``, without the copies that later shards have taken over."""
    return assign(spark.read.parquet(path), shards, id_col, "shard_now").where("shard = shard_now").drop("shard_now")


def grow(spark: SparkSession, path: str, shards: int, grown: int, id_col: str = "doc_id") -> None:
    """Go from ``shards`` to ``grown`` shards: only the rows that move are written, into the new folders."""
    if grown <= shards:
        raise ValueError("shards can only be appended")
    now = assign(read(spark, path, shards, id_col).drop("shard"), grown, id_col)
    now.where(F.col("shard") >= shards).write.mode("append").partitionBy("shard").parquet(path)
