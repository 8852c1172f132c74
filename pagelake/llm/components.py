"""Connected components of an edge table by alternating large-star and small-star rounds.

Each round is two aggregations and two joins over the edges; a node with very
many edges is an ordinary skewed join key, never a collected list.  Rounds run
until the edge set stops changing (a logarithmic number of them).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagelake.llm.common import by_key, written


def _digest(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.xxhash64("v", "u").cast("decimal(20,0)")))
    return tuple(row.first())


def _large_star(edges: DataFrame, n: int) -> DataFrame:
    """``n`` is the number of edges; either end of each can be a node of its own."""
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(by_key(least, 2 * n), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame, n: int) -> DataFrame:
    """Edges, at most ``n``, run from the larger node ``u`` to the smaller node ``v``."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(by_key(least, n), "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """``(u, v)`` links between any nodes -> ``(node, root)`` for nodes other than their root.

    ``root`` is the smallest node of the component.  No edges give no rows.
    """
    e = edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    e = written(e, "edges")
    before = _digest(e)
    while before[0]:
        # the large star gives an edge per edge at most
        e = written(_small_star(_large_star(e, before[0]), before[0]), "edges")
        after = _digest(e)
        if after == before:
            break
        before = after
    return by_key(e, before[0]).select(F.col("u").alias("node"), F.col("v").alias("root"))
