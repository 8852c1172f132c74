"""Repeatable random sampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def sample_key(seed: str, *cols) -> Column:
    """A repeatable pseudo-random sort key: md5 of ``seed:col1:col2...``."""
    parts = [F.lit(seed)] + [F.col(c).cast("string") if isinstance(c, str) else c.cast("string") for c in cols]
    return F.md5(F.concat_ws(":", *parts))


def sample_n(df: DataFrame, id_col: str, n: int, seed: str | None = None) -> DataFrame:
    """``n`` random rows, then ordered by id.

    With a seed the order is ``md5(seed:id)`` (repeatable, checkable); without
    one it is ``rand()``.  Either way the plan is a TakeOrderedAndProject: each
    partition keeps its own top ``n`` and only those meet in the final merge.
    """
    key = sample_key(seed, id_col) if seed is not None else F.rand()
    return df.orderBy(key).limit(n).orderBy(id_col)
