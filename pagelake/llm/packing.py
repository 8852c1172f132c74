"""Packing documents into fixed-length token sequences.

A document longer than a sequence is cut from its end into full pieces, so
only the first piece may be shorter.  Full pieces fill a sequence each.  The
others are dealt by hash into groups of bounded size and packed group by group:
best-fit decreasing first, then a local search that empties the least filled
bins.  It moves a document, exchanges one for one, or two for one, whenever the
sum of squared fills grows, which drains emptier bins into fuller ones.

Defined results: a null or empty text is one piece with the end id only;
repeated rows are packed each; null ids pass through; an empty table gives an
empty result; other input columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagelake.llm import tokens
from pagelake.llm.common import map_texts, pick, written

CAPACITY = 1024
END_ID = 2
# Pieces per group: one group is packed in one task's memory (a few MB).
GROUP_PIECES = 40_000


def cut_places(n: int, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """``(start, length)`` of the pieces of ``n`` ids; only the first may be shorter."""
    first = n % capacity or min(n, capacity)
    return [(0, first), *((s, capacity) for s in range(first, n, capacity))] if n else []


def pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None,
           end_id: int = END_ID, capacity: int = CAPACITY) -> DataFrame:
    """``(doc_id, piece, start, length, ids)``; ``ids`` are little-endian unsigned 32-bit integers."""
    path = tokenizer or tokens.default_tokenizer()
    d = pick(docs, doc_id=id_col, text=text_col).withColumn("text", F.coalesce("text", F.lit("")))
    end = np.array([end_id], "uint32")

    def run(texts: list[str]) -> dict:
        enc, out = tokens.encoder(path), []
        for text in texts:
            ids = np.concatenate((enc.encode(text), end)).astype("<u4")
            out.append([{"piece": i, "start": s, "length": n, "ids": ids[s:s + n].tobytes()}
                        for i, (s, n) in enumerate(cut_places(len(ids), capacity))])
        return {"pieces": out}

    cut = map_texts(d, "text", "pieces array<struct<piece:int,start:bigint,length:bigint,ids:binary>>", run, 2_000_000)
    return cut.select("doc_id", F.inline("pieces"))


class _Bins:
    """Bins of one group: sizes and members per bin, found by the room they have left."""

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.members: list[list[int]] = []
        self.fill: list[int] = []
        self.by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.rooms = 0

    def add(self, item: int, size: int) -> None:
        fitting = self.rooms >> size
        if fitting:
            room = size + (fitting & -fitting).bit_length() - 1
            at = self.by_room[room].pop()
            if not self.by_room[room]:
                self.rooms &= ~(1 << room)
            self.members[at].append(item)
            self.fill[at] += size
        else:
            at = len(self.members)
            self.members.append([item])
            self.fill.append(size)
        left = self.capacity - self.fill[at]
        if left:
            self.by_room[left].append(at)
            self.rooms |= 1 << left


def _improve(members: list[list[int]], sizes: np.ndarray, capacity: int) -> list[list[int]]:
    """Drain the least filled bins into the others as long as the sum of squared fills grows."""
    worth = _squares(members, sizes)
    while True:
        better = _drained(members, sizes, capacity)
        grown = _squares(better, sizes)
        if grown <= worth:
            return members
        members, worth = better, grown


def _squares(members: list[list[int]], sizes: np.ndarray) -> int:
    return sum(int(sizes[m].sum()) ** 2 for m in members)


def _offers(own: list[int], sizes: list[int]) -> dict[int, tuple[int, ...]]:
    """One or two documents for every sum that one or two of a bin's documents have: those of equal size are interchangeable."""
    two: dict[int, list[int]] = {}
    for x, n in zip(own, sizes, strict=True):
        if len(held := two.setdefault(n, [])) < 2:
            held.append(x)
    offers: dict[int, tuple[int, ...]] = {n: (held[0],) for n, held in two.items()}
    kinds = list(two)
    for i, a in enumerate(kinds):
        if len(two[a]) == 2:
            offers.setdefault(2 * a, tuple(two[a]))
        for b in kinds[i + 1:]:
            offers.setdefault(a + b, (two[a][0], two[b][0]))
    return offers


def _drained(members: list[list[int]], sizes: np.ndarray, capacity: int) -> list[list[int]]:
    """One pass of the local search, from the least filled bin to the fullest one."""
    fill = np.array([int(sizes[m].sum()) for m in members], "int64")
    done = [m for m, f in zip(members, fill, strict=True) if f == capacity]
    order = [i for i in np.argsort(fill, kind="stable") if fill[i] < capacity]
    bins, fill = [members[i] for i in order], fill[order]
    # flat view of the open bins: the bin of each item, updated as items move
    item = np.array([x for b in bins for x in b], "int64")
    home = np.repeat(np.arange(len(bins)), [len(b) for b in bins])
    size = sizes[item]
    for low in range(len(bins)):
        moved = True
        while moved and fill[low]:
            moved = False
            own = np.flatnonzero(home == low)
            room = capacity - fill
            room[: low + 1] = 0
            # move: the fullest bin that takes a whole document
            for x in own[np.argsort(-size[own], kind="stable")]:
                fits = np.flatnonzero(room >= size[x])
                if len(fits):
                    to = fits[np.argmin(room[fits])]
                    home[x] = to
                    fill[to] += size[x]
                    fill[low] -= size[x]
                    room[to] -= size[x]
                    moved = True
            own = np.flatnonzero(home == low)
            if moved or not len(own):
                continue
            # exchange one or two of this bin's documents for one smaller in a fuller bin
            offers = _offers(own.tolist(), size[own].tolist())
            others = np.flatnonzero((home > low) & (room[home] > 0))
            if not len(others):
                break
            other_size, other_room, other_fill = size[others], room[home[others]], fill[home[others]]
            best_gain, best = 0, None
            for total, what in offers.items():
                d = total - other_size
                gain = np.where((d > 0) & (d <= other_room), 2 * d * (other_fill - fill[low] + d), 0)
                at = int(np.argmax(gain))
                if gain[at] > best_gain:
                    best_gain, best = int(gain[at]), (what, int(others[at]), int(d[at]))
            if best:
                what, other, d = best
                to = home[other]
                home[list(what)] = to
                home[other] = low
                fill[to] += d
                fill[low] -= d
                moved = True
    by_bin: list[list[int]] = [[] for _ in bins]
    for x, b in zip(item.tolist(), home.tolist(), strict=True):
        by_bin[b].append(x)
    return done + [b for b in by_bin if b]


def pack_sizes(sizes: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of every item; deterministic in the order of ``sizes``."""
    sizes = np.asarray(sizes, "int64")
    if len(sizes) and (sizes.min() < 0 or sizes.max() > capacity):
        raise ValueError("sizes must lie between 0 and the capacity")
    bins = _Bins(capacity)
    for i in np.argsort(-sizes, kind="stable").tolist():
        bins.add(i, int(sizes[i]))
    where, offset = np.zeros(len(sizes), "int64"), np.zeros(len(sizes), "int64")
    for b, held in enumerate(_improve(bins.members, sizes, capacity)):
        held = sorted(held)
        where[held] = b
        offset[held] = np.cumsum(sizes[held]) - sizes[held]
    return where, offset


def pack(rows: DataFrame, capacity: int = CAPACITY, group_pieces: int = GROUP_PIECES) -> DataFrame:
    """``(row_id, length)`` with distinct ids -> ``(row_id, sequence_id, offset)``.

    Sequences of full pieces have negative numbers, the others count from 0.
    """
    short = rows.where(F.col("length") < capacity)
    n_groups = max(1, -(-short.count() // group_pieces))
    dealt = short.select("row_id", "length", F.pmod(F.xxhash64("row_id"), F.lit(n_groups)).cast("int").alias("g"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("row_id", kind="stable")
        where, offset = pack_sizes(pdf["length"].to_numpy(), capacity)
        return pd.DataFrame({"row_id": pdf["row_id"], "sequence_id": where * n_groups + int(pdf["g"].iloc[0]), "offset": offset})

    packed = dealt.groupBy("g").applyInPandas(run, "row_id bigint, sequence_id bigint, offset bigint")
    full = rows.where(F.col("length") >= capacity).select(
        "row_id", (-F.col("row_id") - 1).alias("sequence_id"), F.lit(0).cast("bigint").alias("offset"))
    return packed.unionByName(full)


def numbered(cut: DataFrame) -> DataFrame:
    """Pieces as a written table whose rows have distinct numbers."""
    return written(cut.withColumn("row_id", F.monotonically_increasing_id()), "pieces")


def pack_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None,
                   end_id: int = END_ID, capacity: int = CAPACITY) -> DataFrame:
    """``(doc_id, piece, start, length, ids, sequence_id, offset)``: every piece with its place."""
    cut = numbered(pieces(docs, id_col, text_col, tokenizer, end_id, capacity))
    return cut.join(pack(cut.select("row_id", "length"), capacity), "row_id").drop("row_id")
