"""Document fingerprints by one-permutation MinHash.

Every shingle is hashed once; the top bits name its bin and the least hash of
a bin represents it.  An empty bin copies a bin that its own sequence of
pseudo-random probes meets first (optimal densification).  A fingerprint keeps
the low ``BITS`` bits of each bin, packed; two fingerprints agree by chance in
``2 ** -BITS`` of the bins, and the likeness corrects for that.

Defined results: a null or empty text (no words) has the fingerprint of one
fixed hash, so empty texts are alike; fewer words than a shingle are one
shingle; rows with equal ids follow each other by the digest of their texts;
null ids come first; a single document follows itself; an empty table gives an
empty result; other input columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from pagelake.llm.common import pick, process_cache, written
from pagelake.llm.simhash import shingle_hashes

BINS = 512
BITS = 4
SHINGLE = 5
_PROBES = 4096
_NO_WORDS = 0x9E3779B97F4A7C15


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _probes(bins: int) -> np.ndarray:
    """Bin that each empty bin looks at in each attempt."""
    cells = np.arange(1, _PROBES * bins + 1, dtype="uint64")
    return (_mixed(cells * np.uint64(0x9E3779B97F4A7C15)) % np.uint64(bins)).astype("int32").reshape(_PROBES, bins)


def bin_values(hashes: np.ndarray, bins: int = BINS) -> np.ndarray:
    """The least hash of every bin, empty bins filled."""
    if not len(hashes):
        hashes = np.array([_NO_WORDS], "uint64")
    ordered = np.sort(hashes)
    home = (ordered >> np.uint64(64 - bins.bit_length() + 1)).astype("int64")
    first = np.flatnonzero(np.diff(home, prepend=-1))
    value, filled = np.zeros(bins, "uint64"), np.zeros(bins, bool)
    value[home[first]] = ordered[first]
    filled[home[first]] = True
    empty = np.flatnonzero(~filled)
    if not len(empty):
        return value
    probes, source = process_cache(f"probes:{bins}", lambda: _probes(bins)), value.copy()
    begin = 0
    for end in (16, 256, _PROBES):
        met = filled[probes[begin:end][:, empty]]
        found = met.any(axis=0)
        at = probes[begin + met.argmax(axis=0)[found], empty[found]]
        value[empty[found]] = source[at]
        empty, begin = empty[~found], end
        if not len(empty):
            return value
    # no probe met a filled bin (possible with a handful of bins only): the next filled bin
    places = np.flatnonzero(filled)
    value[empty] = source[places[np.searchsorted(places, empty) % len(places)]]
    return value


def packed(hashes: np.ndarray, bins: int = BINS, bits: int = BITS) -> bytes:
    low = (bin_values(hashes, bins) & np.uint64((1 << bits) - 1)).astype("uint8")
    return np.packbits(np.unpackbits(low[:, None], axis=1)[:, 8 - bits:].reshape(-1)).tobytes()


def likeness(a: bytes, b: bytes, bits: int = BITS) -> float:
    """Estimated share of common shingles (Jaccard), corrected for chance agreement, within 0 to 1."""
    x = np.unpackbits(np.frombuffer(a, "uint8") ^ np.frombuffer(b, "uint8")).reshape(-1, bits)
    same = 1.0 - x.any(axis=1).mean()
    chance = 2.0 ** -bits
    return float(min(1.0, max(0.0, (same - chance) / (1 - chance))))


def fingerprint(text: str, shingle: int = SHINGLE, bins: int = BINS, bits: int = BITS) -> bytes:
    return packed(shingle_hashes(text, shingle), bins, bits)


def edited(text: str, following: str) -> str:
    """The last half of ``text`` replaced by as many first characters of ``following``, or all it has."""
    half = len(text) // 2
    return text[:len(text) - half] + following[:half]


def _compared(text: str, own: bytes, following: str, other: bytes) -> dict:
    new = edited(text, following)
    print_new = fingerprint(new)
    return {"n_chars": len(text), "edited_sha256": hashlib.sha256(new.encode("utf-8")).digest(), "fingerprint": own,
            "edited_fingerprint": print_new, "near_edited": likeness(own, print_new), "near_next": likeness(own, other)}


# Digests stay binary until the result: as text they take twice the disk.
_RESULT = "n_chars bigint, edited_sha256 binary, fingerprint binary, edited_fingerprint binary, near_edited double, near_next double"


def with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next)``.

    Documents are dealt by ranges of ids and read in order, so the next
    document is at hand.  Only the last one of a range waits for the head of
    the next range; these few rows are finished in a second step.
    """
    d = pick(docs, doc_id=id_col, text=text_col).withColumn("text", F.coalesce("text", F.lit("")))
    order = [F.col("doc_id").asc_nulls_first(), F.md5("text")]
    d = d.repartitionByRange(order[0]).sortWithinPartitions(*order).select(F.spark_partition_id().alias("part"), "doc_id", "text")
    made = T.StructType.fromDDL(_RESULT)
    schema = T.StructType([*d.schema.fields[:2], *made.fields, T.StructField("head", T.StringType()), T.StructField("tail", T.StringType())])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head, last = None, None
        for batch in batches:
            out = []
            for part, doc_id, text in zip(*(batch.column(c) for c in ("part", "doc_id", "text")), strict=True):
                text = text.as_py()
                own = fingerprint(text)
                if last:
                    out.append(last[0] | _compared(last[1], last[2], text, own))
                else:
                    head = text
                last = ({"part": part.as_py(), "doc_id": doc_id.as_py()}, text, own)
            if out:
                yield pa.RecordBatch.from_pylist(out, schema=arrow)
        if last:
            yield pa.RecordBatch.from_pylist([last[0] | {"head": head, "tail": last[1]}], schema=arrow)

    rows = written(d.mapInArrow(run, schema), "fingerprints")
    columns = ["doc_id", *made.fieldNames()]
    result = ["doc_id", *[F.lower(F.hex(f.name)).alias(f.name) if f.dataType == T.BinaryType() else f.name for f in made.fields]]
    # one row per range: the first and the last text of it
    ends = rows.where("tail is not null").select("part", "doc_id", "head", "tail")
    place = ends.select("part", F.row_number().over(Window.orderBy("part")).alias("n"))
    total = place.count()
    if not total:
        return rows.select(*result)
    follower = place.select(F.when(F.col("n") == 1, total).otherwise(F.col("n") - 1).alias("n"), F.col("part").alias("next_part"))
    waiting = (ends.join(place, "part").join(follower, "n")
               .join(ends.select(F.col("part").alias("next_part"), F.col("head").alias("following")), "next_part")
               .select("doc_id", "tail", "following"))
    last_schema = T.StructType([schema["doc_id"], *made.fields])
    last_arrow = to_arrow_schema(last_schema)

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [{"doc_id": r["doc_id"]} | _compared(r["tail"], fingerprint(r["tail"]), r["following"], fingerprint(r["following"]))
                   for r in batch.to_pylist()]
            yield pa.RecordBatch.from_pylist(out, schema=last_arrow)

    return rows.where("tail is null").select(*columns).unionByName(waiting.mapInArrow(finish, last_schema)).select(*result)
