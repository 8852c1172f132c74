"""SimHash near-duplicate groups.

A fingerprint has one bit per position that is set in more than half of the
shingle hashes.  Two fingerprints within ``max_bits`` of each other must agree
on ``blocks - max_bits`` of ``blocks`` bit blocks, so they meet under one of the
masks that keep that many blocks; every meeting pair is verified by its Hamming
distance.  The members of a bucket above ``HOT_BUCKET`` distinct fingerprints are
not paired up there but split again by the same rule into more blocks, of which
more must agree.  What is crowded even then is linked through shared midpoints
(two fingerprints within 4 bits have a common point within 2 bits of each),
which is exact and linear.  Links join into groups by connected components.

Defined results: a null or empty text has the fingerprint zero and links like
any other; repeated rows share a group; a null id never names a group unless
the whole group lacks ids; an empty table gives an empty result; other columns
are ignored or passed through unchanged.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagelake.llm.common import apart, by_key, map_texts, pick, written
from pagelake.llm.components import components

SHINGLE = 4
MAX_BITS = 4
BLOCKS = 7
SEED = 42
HOT_BUCKET = 512
# The members of buckets above that are split into more blocks, of which more are kept: 8 of 12 are 495 masks of 43 bits.
FINER_BLOCKS = (12,)


def shingle_hashes(text: str, size: int, seed: int = SEED) -> np.ndarray:
    """XXH64 of every run of ``size`` words, A-Z lower-cased, repeats included."""
    words = text.encode("utf-8").lower().split()
    if not words:
        return np.empty(0, "uint64")
    joined = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    if len(words) <= size:
        return np.array([digest(joined, seed)], "uint64")
    ends = np.cumsum(np.fromiter(map(len, words), "int64", len(words)) + 1) - 1
    begins = np.concatenate(([0], ends[:-1] + 1))
    spans = zip(begins[: len(words) - size + 1].tolist(), ends[size - 1:].tolist(), strict=True)
    return np.array([digest(joined[a:b], seed) for a, b in spans], "uint64")


def fingerprint_of(hashes: np.ndarray) -> int:
    """Bits set in over half the hashes, as an unsigned integer; zero without any."""
    if not len(hashes):
        return 0
    counts = np.zeros(64, "int64")
    for part in range(0, len(hashes), 1 << 16):
        bits = np.unpackbits(hashes[part:part + (1 << 16)].astype(">u8").view("uint8")).reshape(-1, 64)
        counts += bits.sum(axis=0, dtype="int64")
    return int.from_bytes(np.packbits(counts * 2 > len(hashes)).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """``(doc_id, text_md5, fp)``; ``fp`` is the fingerprint as a signed long."""
    d = pick(docs, doc_id=id_col, text=text_col).withColumn("text", F.coalesce("text", F.lit("")))
    d = d.withColumn("text_md5", F.md5(F.col("text")))

    def run(texts: list[str]) -> dict:
        return {"fp": np.array([fingerprint_of(shingle_hashes(t, shingle)) for t in texts], "uint64").view("int64")}

    return map_texts(d, "text", "fp bigint", run)


def _signed(value: int) -> int:
    return value - (1 << 64) if value >= 1 << 63 else value


def block_masks(max_bits: int = MAX_BITS, blocks: int = BLOCKS) -> list[int]:
    """Masks that keep ``blocks - max_bits`` of ``blocks`` nearly equal bit blocks."""
    if not max_bits < blocks <= 64:
        raise ValueError("need max_bits < blocks <= 64")
    edges = [round(64 * i / blocks) for i in range(blocks + 1)]
    each = [((1 << (b - a)) - 1) << a for a, b in zip(edges, edges[1:], strict=False)]
    return [sum(kept) for kept in combinations(each, blocks - max_bits)]


def _keyed(fps: DataFrame, masks: list[int]) -> DataFrame:
    """One row per fingerprint and mask: mask number, kept bits, fingerprint."""
    each = fps.select("fp", F.posexplode(F.array(*[F.lit(_signed(m)) for m in masks])).alias("m", "mask"))
    return each.select(F.col("m").cast("smallint").alias("m"), F.col("fp").bitwiseAND(F.col("mask")).alias("k"), "fp")


def _near(a: Column, b: Column, max_bits: int) -> Column:
    return F.bit_count(a.bitwiseXOR(b)) <= max_bits


def _midpoint_links(fps: DataFrame, max_bits: int) -> DataFrame:
    """Links that connect every pair within ``max_bits`` through a common midpoint.

    All fingerprints around one midpoint of radius ``max_bits // 2`` are within
    ``max_bits`` of each other, so linking each to the smallest one is exact.
    An odd ``max_bits`` also takes the pairs one bit apart from such a point.
    """
    inner, outer = max_bits // 2, max_bits - max_bits // 2

    def masks(radius: int) -> list[int]:
        return [_signed(sum(1 << b for b in bits)) for r in range(radius + 1) for bits in combinations(range(64), r)]

    def around(radius: int) -> DataFrame:
        # a constant list, so no list is built per fingerprint
        each = fps.select("fp", F.explode(F.array(*[F.lit(m) for m in masks(radius)])).alias("mask"))
        return each.select("fp", F.col("fp").bitwiseXOR(F.col("mask")).alias("mid"))

    near = around(inner)
    least = near.groupBy("mid").agg(F.min("fp").alias("v"), F.count(F.lit(1)).alias("n"))
    if outer == inner:
        least = least.where("n > 1")
        return near.join(by_key(least), "mid").where("fp <> v").select(F.col("fp").alias("u"), "v").distinct()
    # the smallest one within the inner radius is within max_bits of all in the outer radius
    return around(outer).join(by_key(least), "mid").where("fp <> v").select(F.col("fp").alias("u"), "v").distinct()


def links(fps: DataFrame, max_bits: int = MAX_BITS, blocks: int = BLOCKS, hot: int = HOT_BUCKET,
          finer: tuple[int, ...] = FINER_BLOCKS) -> DataFrame:
    """Edges ``(u, v)`` between distinct fingerprints that connect all pairs within ``max_bits``.

    The members of crowded buckets are split anew into each number of blocks in ``finer``.
    """
    keyed = _keyed(fps, block_masks(max_bits, blocks))
    crowded = keyed.groupBy("m", "k").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > hot).select("m", "k")
    crowded = written(crowded, "crowded")
    n_crowded = crowded.count()
    if not n_crowded:
        sparse, more = keyed, None
    else:
        sparse = keyed.join(by_key(crowded, n_crowded), ["m", "k"], "left_anti")
        dense = keyed.join(by_key(crowded, n_crowded), ["m", "k"], "left_semi").select("fp").distinct()
        dense = written(dense, "dense")
        more = links(dense, max_bits, finer[0], hot, finer[1:]) if finer else _midpoint_links(dense, max_bits)
    # a row per mask and fingerprint on both sides
    a, b = sparse.alias("a"), by_key(sparse.alias("b"))
    met = a.join(b, (F.col("a.m") == F.col("b.m")) & (F.col("a.k") == F.col("b.k")) & (F.col("a.fp") > F.col("b.fp"))
                 & _near(F.col("a.fp"), F.col("b.fp"), max_bits))
    found = met.select(F.col("a.fp").alias("u"), F.col("b.fp").alias("v")).distinct()
    return found if more is None else found.unionByName(more).distinct()


def groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE,
           max_bits: int = MAX_BITS, blocks: int = BLOCKS, hot: int = HOT_BUCKET) -> DataFrame:
    """``(doc_id, text_md5, fp, root, component_id)`` per row; ``component_id`` is the least id of the group."""
    marked = written(fingerprints(docs, id_col, text_col, shingle), "fingerprints")
    classes = written(marked.groupBy("fp").agg(F.min("doc_id").alias("least_id")), "classes")
    roots = components(links(classes.select("fp"), max_bits, blocks, hot))
    rooted = classes.join(roots, classes["fp"] == roots["node"], "left").select(
        "fp", "least_id", F.coalesce("root", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("least_id").alias("component_id"))
    return by_key(marked, marked.count()).join(rooted.select("fp", "root").join(least, "root"), "fp").select(
        "doc_id", "text_md5", "fp", "root", "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE,
             max_bits: int = MAX_BITS, blocks: int = BLOCKS, hot: int = HOT_BUCKET) -> DataFrame:
    """``docs`` with one row of each group: the least id (nulls last), then the least text digest.

    Rows that share id and text are the same document; one of them stays.
    """
    g = groups(docs, id_col, text_col, shingle, max_bits, blocks, hot)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_md5"))
    keep = g.groupBy("root").agg(first.alias("k")).select(F.col("k.doc_id").alias("keep_id"), F.col("k.text_md5").alias("keep_md5"))
    d, new, old = apart(docs)
    the_id, the_text = F.col(new[old.index(id_col)]), F.col(new[old.index(text_col)])
    d = d.withColumn("keep_md5", F.md5(F.coalesce(the_text, F.lit("")))).withColumn("keep_id", the_id)
    keep = keep.withColumnsRenamed({"keep_id": "i", "keep_md5": "h"}).distinct()
    same = d["keep_id"].eqNullSafe(keep["i"]) & (d["keep_md5"] == keep["h"])
    return d.join(keep, same, "left_semi").dropDuplicates(["keep_id", "keep_md5"]).select(*new).toDF(*old)


def hex_digits(fp: Column) -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")
