"""Ordered operators over large tables without a single-partition window.

A plain ``Window.orderBy(...)`` moves every row into one task.  These helpers
split the key range into blocks: the per-row work runs in bounded
``partitionBy(block)`` windows, and only the per-block summary (one row per
block) is ordered globally.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagelake.session import cut_lineage


def _block(col: str, width: int):
    return F.floor(F.col(col) / F.lit(width)).cast("bigint")


def running_total(df: DataFrame, order_cols: list[str], value_col: str, out_col: str,
                  block_width: int, inclusive: bool = False, partition_cols: list[str] | None = None) -> DataFrame:
    """Running sum of ``value_col`` in ``order_cols`` order (exclusive by default).

    ``order_cols[0]`` must be numeric; rows are grouped in blocks of
    ``block_width`` of that key.  Remaining order columns break ties.  With
    ``partition_cols`` the sum restarts per key, and a hot key is still split
    into bounded blocks (only its per-block totals are ordered together).
    """
    keys = list(partition_cols or [])
    key = order_cols[0]
    d = df.withColumn("__blk", _block(key, block_width))
    totals = d.groupBy(*keys, "__blk").agg(F.sum(value_col).alias("__bt"))
    by_key = Window.partitionBy(*keys) if keys else Window
    before = by_key.orderBy("__blk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*keys, "__blk", F.coalesce(F.sum("__bt").over(before), F.lit(0)).alias("__bo"))
    frame_end = 0 if inclusive else -1
    w = Window.partitionBy(*keys, "__blk").orderBy(*order_cols).rowsBetween(Window.unboundedPreceding, frame_end)
    within = d.withColumn("__in", F.coalesce(F.sum(value_col).over(w), F.lit(0)))
    out = within.join(offsets, [*keys, "__blk"]).withColumn(out_col, (F.col("__bo") + F.col("__in")).cast("bigint"))
    return out.drop("__blk", "__bo", "__in")


def next_value(df: DataFrame, key_col: str, out_col: str, default, block_width: int) -> DataFrame:
    """``lead(key)`` over the whole table ordered by ``key`` (keys distinct).

    Within a block the next key comes from a bounded window; the last key of a
    block takes the smallest key of the next non-empty block; the very last
    key takes ``default``.
    """
    d = df.withColumn("__blk", _block(key_col, block_width))
    w = Window.partitionBy("__blk").orderBy(key_col)
    inner = d.withColumn("__nx", F.lead(key_col).over(w))
    mins = d.groupBy("__blk").agg(F.min(key_col).alias("__bmin"))
    nxt_blk = mins.select("__blk", F.lead("__bmin").over(Window.orderBy("__blk")).alias("__nbmin"))
    out = inner.join(nxt_blk, "__blk").withColumn(
        out_col, F.coalesce(F.col("__nx"), F.col("__nbmin"), default if isinstance(default, Column) else F.lit(default)).cast("bigint"))
    return out.drop("__blk", "__nx", "__nbmin")


def one_block(frames: list[DataFrame], col: str, block_width: int) -> bool:
    """Do all values of the numeric ``col`` lie in one block?"""
    rows = reduce(DataFrame.union, [f.select(_block(col, block_width).alias("__blk")) for f in frames])
    first, last = rows.agg(F.min("__blk"), F.max("__blk")).first()
    return first == last


def last_seen(df: DataFrame, key_cols: list[str], order_cols: list[str], values: dict[str, str], block_width: int,
              inclusive: bool = True, keep: Column | None = None, single: bool = False) -> DataFrame:
    """For each new column in ``values``, the last non-null value of its source column per key up to each row.

    The row itself counts if ``inclusive``; only rows with ``keep`` are returned.
    ``order_cols[0]`` must be numeric; a key's rows are split into blocks of
    ``block_width`` of it, and only the last row per key and block is ordered
    beyond.  Rows are computed and shuffled once: the windows are written with a
    mark on those last rows, and a value of an earlier block is joined only to
    blocks that have one.  With ``single`` (see ``one_block``) there is one
    block and nothing to carry, and nothing is written.
    """
    d = df.withColumn("__blk", _block(order_cols[0], block_width))
    place = Window.partitionBy(*key_cols, "__blk").orderBy(*order_cols)
    w = place.rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    within = d.withColumns({f"__in_{out}": F.last(c, ignorenulls=True).over(w) for out, c in values.items()})
    wanted = F.lit(True) if keep is None else keep
    if not single:
        within = within.withColumn("__ends", F.lead(F.lit(1)).over(place).isNull())
        within = cut_lineage(within.where(wanted | F.col("__ends")))
        first, last = within.agg(F.min("__blk"), F.max("__blk")).first()
        single = first == last
    if single:   # all in one block: nothing to carry
        return within.where(wanted).select(*df.columns, *[F.col(f"__in_{out}").alias(out) for out in values])
    blocks = within.where("__ends").select(*key_cols, "__blk", *[
        F.coalesce(c, f"__in_{out}").alias(f"__bv_{out}") for out, c in values.items()])
    before = Window.partitionBy(*key_cols).orderBy("__blk").rowsBetween(Window.unboundedPreceding, -1)
    carried = blocks.select(*key_cols, "__blk", *[
        F.last(f"__bv_{out}", ignorenulls=True).over(before).alias(f"__bc_{out}") for out in values])
    carried = carried.where(reduce(Column.__or__, [F.col(f"__bc_{out}").isNotNull() for out in values]))
    both = within.where(wanted).join(carried, [*key_cols, "__blk"], "left")
    return both.select(*df.columns, *[F.coalesce(f"__in_{out}", f"__bc_{out}").alias(out) for out in values])


def as_of(requests: DataFrame, key: str, at: list[str], events: dict[str | tuple[str, ...], DataFrame], block_width: int,
          inclusive: bool = True, single: bool = False) -> DataFrame:
    """Requests with, for each column name in ``events``, its value in the last event of their key at their time.

    An events frame has the key, the columns ``at`` and its value; no event
    gives null.  A frame under several names has a struct with the value as its
    only field, ``v``, for each, or null if the event does not set it.  ``at``
    orders all sides, its first column must be numeric; events at the very time
    of a request count if ``inclusive``, and a column ``tie`` (of one type in
    all frames) orders those of one time.  Requests and events pass in one
    ordered block-wise stream, so a key with many of both is no product, and
    requests without a key are kept.  ``single`` is that of ``last_seen``.
    """
    place = [key, *[c for c in at if c != key]]
    rest = [c for c in requests.columns if c not in place]
    asked = F.struct(F.lit(True).alias("__is"), *rest).alias("__r")
    at_cols = [F.col(c).alias(f"__at_{c}") for c in place[1:]]
    # requests without a key meet nothing: they are dealt by their own hash
    none = F.when(F.col(key).isNull(), F.xxhash64(*requests.columns)).otherwise(F.lit(0).cast("bigint")).alias("__none")
    both = requests.select(F.col(key).alias("__key"), none, *at_cols, F.lit(1 if inclusive else 0).alias("__turn"), asked)
    names = []
    for told, rows in events.items():
        # a struct, as the value itself may be null
        value = {c: F.col(c) for c in told} if isinstance(told, tuple) else {told: F.struct(F.col(told).alias("v"))}
        names += value
        both = both.unionByName(rows.where(F.col(key).isNotNull()).select(
            F.col(key).alias("__key"), F.lit(0).cast("bigint").alias("__none"), *at_cols, F.lit(0 if inclusive else 1).alias("__turn"),
            *[v.alias(f"__v_{c}") for c, v in value.items()], *[F.col("tie").alias("__tie") for c in rows.columns if c == "tie"]),
            allowMissingColumns=True)
    order = [*[f"__at_{c}" for c in place[1:]], "__turn", *[c for c in both.columns if c == "__tie"]]
    found = last_seen(both, ["__key", "__none"], order, {f"__f_{c}": f"__v_{c}" for c in names}, block_width,
                      keep=F.col("__r").isNotNull(), single=single)
    back = {key: F.col("__key")} | {c: F.col(f"__at_{c}") for c in place[1:]} | {c: F.col(f"__r.{c}") for c in rest}
    return found.select(*[back[c].alias(c) for c in requests.columns], *[F.col(f"__f_{c}.v").alias(c) for c in names])
