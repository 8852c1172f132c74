"""Bounded training samples: a documented number of rows per label, whatever the table's size."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def per_label(rows: DataFrame, label: str, want: int, seed: int = 11) -> DataFrame:
    """Rows of ``(doc_id, label)`` with about ``want`` of each label, chosen by a hash of the id.

    A label with ``n`` rows keeps those whose hash falls in the first
    ``want / n`` of the range, so no label is sorted or gathered anywhere.  One
    row per id stays; rows without an id or a label are left out.
    """
    rows = rows.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull())
    rows = rows.groupBy("doc_id").agg(F.max(label).alias(label))
    # one row per label: the labels are few
    counts = {r[label]: r["n"] for r in rows.groupBy(label).agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counts:
        return rows.where(F.lit(False))
    place = F.pmod(F.xxhash64(F.lit(seed), F.col("doc_id")), F.lit(1 << 30))
    limit = F.element_at(F.create_map(*[F.lit(x) for k, n in counts.items() for x in (k, math.ceil((1 << 30) * min(1.0, want / n)))]), F.col(label))
    return rows.where(place < limit)


def prior(rows: DataFrame, label: str) -> float:
    """Share of label 1 among all labelled rows; one half without any."""
    got = rows.where(F.col(label).isNotNull()).agg(F.avg(F.col(label).cast("double"))).first()[0]
    return 0.5 if got is None else min(max(got, 1e-4), 1 - 1e-4)
