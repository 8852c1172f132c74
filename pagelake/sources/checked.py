"""Accepted and rejected rows from one pass over the input.

A reader tags each row with a reason, null if it is fine.  ``split_rows`` writes
the tagged rows once, rejects into a folder of their own, and counts both while
it writes; the two frames then read their folder only.
"""

from __future__ import annotations

import uuid
from typing import NamedTuple

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from pagelake.session import shared_dir

_PART = "__rejected"


class Checked(NamedTuple):
    accepted: DataFrame
    rejects: DataFrame
    n_rows: int
    n_rejects: int


def split_rows(tagged: DataFrame, reason: str = "reject", source: str = "record") -> Checked:
    """Split ``tagged`` by ``reason``: rejects keep ``source`` (the raw input) and the reason, the others all else."""
    spark = tagged.sparkSession
    path = shared_dir(spark, f"cut/checked-{uuid.uuid4().hex}")
    bad = F.col(reason).isNotNull()
    values = [c for c in tagged.columns if c not in (reason, source)]
    rows = tagged.select(
        *[F.when(~bad, F.col(c)).alias(c) for c in values], F.col(reason), F.when(bad, F.col(source)).alias(source), bad.cast("int").alias(_PART))
    seen = Observation(f"checked-{uuid.uuid4().hex}")
    rows = rows.observe(seen, F.count(F.lit(1)).alias("n_rows"), F.count(F.col(reason)).alias("n_rejects"))
    rows.write.partitionBy(_PART).parquet(path)
    counts = seen.get
    both = spark.read.schema(rows.schema).parquet(path)
    return Checked(both.where(F.col(_PART) == 0).select(*values), both.where(F.col(_PART) == 1).select(source, reason),
                   int(counts.get("n_rows", 0)), int(counts.get("n_rejects", 0)))


def together(checked: Checked, reason: str = "reject", source: str = "record") -> DataFrame:
    """Accepted rows and rejects in one frame, each with nulls for the other's columns."""
    return checked.accepted.unionByName(checked.rejects.select(source, reason), allowMissingColumns=True)
