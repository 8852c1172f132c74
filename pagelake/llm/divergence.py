"""Source divergence audit: how far the words of each source lie from those of the others of its language.

Terms are letters A-Z and characters beyond ASCII, only A-Z lower-cased.  Every
task counts its words and hands on blocks of fixed-width records (digest, place
of the source, occurrences, documents), one block per language and range of
digests; these blocks are all that the counts shuffle.  The texts of a task's
terms lie in a column of their own, which only digests that are kept read again.
The least and the greatest text of a digest tell whether two terms share it;
such digests are counted again by their texts.  Shares and values are integers
throughout.

Pairs of sources are summed from the terms that occur: a term that a source
lacks has the same share there as all others it lacks, so those terms are taken
together by their share in the other source, and only terms that both sources
hold meet in a join.

Defined results: a null text, lang or source is read as the empty string; a
language without kept terms has pairs of value 0 and no terms; repeated rows
are documents of their own; an empty table gives an empty result; a very long
text is one document like any other, counted by distinct words; other input
columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from pagelake.llm.common import pick, written

TERM_PATTERN = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"
MIN_DOCS = 10
RANKS = 10
SCALE = 1_000_000_000
DIGEST_BITS = 64
# Distinct words a task counts, and records it merges, before it hands them on (memory, not results).
HELD_WORDS = 200_000
HELD_RECORDS = 1_000_000
# Documents per range of digests, about: what a task merges at once.
RANGE_DOCS = 4_000
# The filter of wanted digests has 8 bits for each and this many at most (8 MiB); a join follows it.
FILTER_BITS = 1 << 26

# A-Z to a-z, every other ASCII character but a-z to a space; bytes of longer characters stay.
_LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def terms_of(text: str) -> list[bytes]:
    return text.encode("utf-8").translate(_LETTERS).split()


def digests_of(terms: list[bytes], bits: int = DIGEST_BITS) -> np.ndarray:
    made = np.fromiter(map(xxhash.xxh64_intdigest, terms), "uint64", len(terms))
    return (made & np.uint64((1 << bits) - 1)).view("int64")


def _strings(values: list, counts: list[int]) -> pa.Array:
    """Each value as many times as its count says."""
    return pa.array(values, pa.string()).take(pa.array(np.repeat(np.arange(len(values)), counts)))


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[tuple[str, str], tuple[Counter, Counter]]]:
    """Occurrences and documents of each word by (lang, source), handed on before they grow too many."""
    held: dict[tuple[str, str], tuple[Counter, Counter]] = {}
    n = 0
    for batch in batches:
        for lang, source, text in zip(*(batch.column(c).to_pylist() for c in ("lang", "source", "text")), strict=True):
            counts = held.get((lang, source))
            if counts is None:
                counts = held[lang, source] = (Counter(), Counter())
            words = terms_of(text)
            n -= len(counts[0])
            counts[0].update(words)
            counts[1].update(set(words))
            n += len(counts[0])
            if n > HELD_WORDS:
                yield held
                held, n = {}, 0
    yield held


_RECORDS = "lang string, bucket bigint, sources array<string>, places binary, digests binary, n binary, df binary"
_NAMES = "name_digests binary, names array<string>"


def _merged(digest: np.ndarray, place: np.ndarray, n: np.ndarray, df: np.ndarray) -> tuple[np.ndarray, ...]:
    """Records of one digest and place added up, in the order of digest and place."""
    order = np.lexsort((place, digest))
    digest, place, n, df = digest[order], place[order], n[order], df[order]
    begin = np.flatnonzero(np.concatenate(([True], (digest[1:] != digest[:-1]) | (place[1:] != place[:-1])))[:len(digest)])
    if not len(begin):
        return digest, place, n, df
    return digest[begin], place[begin], np.add.reduceat(n, begin), np.add.reduceat(df, begin)


def _binary(parts: list[np.ndarray]) -> pa.Array:
    return pa.array([x.tobytes() for x in parts], pa.binary())


def count_blocks(docs: DataFrame, ranges: int, bits: int) -> DataFrame:
    """Per task: blocks of records by language and range of digests, and the texts of its terms beside them."""
    ddl = f"{_RECORDS}, {_NAMES}"
    schema = to_arrow_schema(StructType.fromDDL(ddl))
    shift = np.uint64(64 - ranges.bit_length() + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places: dict[tuple[str, str], int] = {}
        waiting: list[tuple[np.ndarray, ...]] = []
        records = 0

        def blocks() -> Iterator[pa.RecordBatch]:
            digest, place, n, df = _merged(*map(np.concatenate, zip(*waiting, strict=True)))
            group_lang = [lang for lang, _ in places]
            langs = sorted(set(group_lang))
            lang_no = np.array([langs.index(x) for x in group_lang])[place]
            bucket = digest >> shift if ranges > 1 else np.zeros(len(digest), "uint64")
            order = np.lexsort((digest, place, bucket, lang_no))
            digest, place, n, df, bucket, lang_no = (x[order] for x in (digest, place, n, df, bucket, lang_no))
            change = (np.diff(lang_no) != 0) | (np.diff(bucket.view("int64")) != 0)
            begins = [0, *(np.flatnonzero(change) + 1).tolist(), len(digest)]
            names = [source for _, source in places]
            own, at = [], []
            for a, b in zip(begins, begins[1:], strict=False):
                used, back = np.unique(place[a:b], return_inverse=True)
                own.append([names[i] for i in used])
                at.append(back.astype("<u4"))
            cuts = list(zip(begins, begins[1:], strict=False))
            yield pa.RecordBatch.from_arrays([
                pa.array([langs[lang_no[a]] for a, _ in cuts], pa.string()), pa.array([int(bucket[a]) for a, _ in cuts], pa.int64()),
                pa.array(own, pa.list_(pa.string())), _binary(at), _binary([digest[a:b].astype("<u8") for a, b in cuts]),
                _binary([n[a:b].astype("<i8") for a, b in cuts]), _binary([df[a:b].astype("<i8") for a, b in cuts]),
                pa.nulls(len(cuts), pa.binary()), pa.nulls(len(cuts), pa.list_(pa.string()))], schema=schema)

        for held in _word_counts(batches):
            terms = list(set().union(*(c for c, _ in held.values()))) if held else []
            if not terms:
                continue
            made = digests_of(terms, bits)
            digest = dict(zip(terms, made.tolist(), strict=True))
            for group, (c, per_doc) in held.items():
                k, place = len(c), places.setdefault(group, len(places))
                waiting.append((np.fromiter(map(digest.__getitem__, c), "int64", k).view("uint64"), np.full(k, place),
                                np.fromiter(c.values(), "int64", k), np.fromiter(map(per_doc.__getitem__, c), "int64", k)))
                records += k
            texts = pa.ListArray.from_arrays(pa.array([0, len(terms)], pa.int32()), pa.array(terms, pa.binary()).cast(pa.string()))
            yield pa.RecordBatch.from_arrays([*(pa.nulls(1, f.type) for f in list(schema)[:7]), _binary([made.astype("<i8")]), texts], schema=schema)
            if records >= HELD_RECORDS:
                yield from blocks()
                places, waiting, records = {}, [], 0
        if records:
            yield from blocks()

    return docs.select("lang", "source", "text").mapInArrow(run, ddl)


def kept_counts(blocks: DataFrame, min_docs: int) -> DataFrame:
    """``(lang, source, digest, n)`` of the digests in enough documents of the language, block by block."""
    ddl = "lang string, source string, digest bigint, n bigint"
    records = blocks.where("bucket is not null").select("lang", "bucket", "sources", "places", "digests", "n", "df")
    ordered = records.repartition("lang", "bucket").sortWithinPartitions("lang", "bucket")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, places, waiting, records = None, {}, [], 0

        def merge() -> tuple[np.ndarray, ...]:
            return _merged(*map(np.concatenate, zip(*waiting, strict=True)))

        def kept() -> pa.RecordBatch:
            digest, place, n, df = merge()
            begin = np.flatnonzero(np.concatenate(([True], digest[1:] != digest[:-1])))
            width = np.diff(np.append(begin, len(digest)))
            enough = np.repeat(np.add.reduceat(df, begin) >= min_docs, width)
            names = pa.array(list(places), pa.string()).take(pa.array(place[enough]))
            return pa.RecordBatch.from_arrays([_strings([key[0]], [len(names)]), names, pa.array(digest[enough].view("int64")), pa.array(n[enough])],
                                               names=["lang", "source", "digest", "n"])

        for batch in batches:
            for lang, bucket, sources, at, digest, n, df in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if waiting and (lang, bucket) != key:
                    yield kept()
                    places, waiting, records = {}, [], 0
                key = (lang, bucket)
                own = np.array([places.setdefault(s, len(places)) for s in sources])
                waiting.append((np.frombuffer(digest, "<u8"), own[np.frombuffer(at, "<u4")], np.frombuffer(n, "<i8"), np.frombuffer(df, "<i8")))
                records += len(waiting[-1][0])
                if records >= 4 * HELD_RECORDS:
                    waiting = [merge()]
                    # what is left are different records; the next merge waits for as many again
                    records = 0
        if waiting:
            yield kept()

    return ordered.mapInArrow(run, ddl)


def _filter(digests: DataFrame) -> np.ndarray:
    """One bit for the low digits of each digest, as words of 64; its size is bounded, whatever their number."""
    bits = 1 << 16
    wanted = digests.count()
    while bits < 8 * wanted and bits < FILTER_BITS:
        bits *= 2
    place = F.col("digest").bitwiseAND(F.lit(bits - 1))
    words = digests.select(F.shiftright(place, 6).alias("word"), F.expr("shiftleft(1L, cast(digest & 63 as int))").alias("bit"))
    made = words.groupBy("word").agg(F.bit_or("bit").alias("bit")).toArrow()
    out = np.zeros(bits >> 6, "uint64")
    out[made["word"].to_numpy()] = made["bit"].to_numpy().view("uint64")
    return out


def _wanted(filter_words: np.ndarray, digests: np.ndarray) -> np.ndarray:
    place = digests.view("uint64") & np.uint64(len(filter_words) * 64 - 1)
    return (filter_words[place >> np.uint64(6)] >> (place & np.uint64(63))) & np.uint64(1) == 1


def term_names(blocks: DataFrame, digests: DataFrame) -> DataFrame:
    """``(digest, term, last)``: the least and the greatest text of each of the distinct ``digests``."""
    wanted = _filter(digests)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                made = np.frombuffer(batch.column(0)[i].as_py(), "<i8")
                hit = np.flatnonzero(_wanted(wanted, made))
                yield pa.RecordBatch.from_arrays([pa.array(made[hit]), batch.column(1)[i].values.take(pa.array(hit))], names=["digest", "term"])

    found = blocks.where("names is not null").select("name_digests", "names").mapInArrow(run, "digest bigint, term string")
    found = found.groupBy("digest").agg(F.min("term").alias("term"), F.max("term").alias("last"))
    return found.join(digests, "digest", "left_semi")


def exact_counts(docs: DataFrame, shared: DataFrame, bits: int) -> DataFrame:
    """``(lang, source, digest, term, n, df)`` for the terms whose digest is shared, counted by their texts."""
    wanted = _filter(shared.select("digest"))
    ddl = "lang string, source string, digest bigint, term string, n bigint, df bigint"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in _word_counts(batches):
            for (lang, source), (c, per_doc) in held.items():
                terms = list(c)
                made = digests_of(terms, bits)
                hit = _wanted(wanted, made)
                own = [t for t, h in zip(terms, hit.tolist(), strict=True) if h]
                yield pa.RecordBatch.from_arrays([
                    _strings([lang], [len(own)]), _strings([source], [len(own)]), pa.array(made[hit]),
                    pa.array(own, pa.binary()).cast(pa.string()), pa.array([c[t] for t in own], pa.int64()),
                    pa.array([per_doc[t] for t in own], pa.int64())], names=["lang", "source", "digest", "term", "n", "df"])

    made = docs.select("lang", "source", "text").mapInArrow(run, ddl)
    return made.groupBy("lang", "source", "digest", "term").agg(F.sum("n").alias("n"), F.sum("df").alias("df")).join(
        shared.select("digest"), "digest", "left_semi")


def _share_sql(count: str, total: str, v: str) -> Column:
    """``1 + floor(SCALE * (count + 2) / (total + 2 v))`` in exact decimals; null without kept terms."""
    return F.expr(f"CASE WHEN {v} > 0 THEN 1 + ({SCALE} * cast({count} + 2 AS decimal(20,0))) div cast({total} + 2 * {v} AS decimal(20,0)) END")


def _apart_sql(p: str, q: str) -> Column:
    """``floor((p - q)^2 / (p + q))``; shares are at most SCALE + 1, so the square fits a long."""
    return F.expr(f"(({p}) - ({q})) * (({p}) - ({q})) div (({p}) + ({q}))")


def audit(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source",
          min_docs: int = MIN_DOCS, ranks: int = RANKS, digest_bits: int = DIGEST_BITS) -> DataFrame:
    """``(lang, source, part, item, value, rank)``: distances between sources, and the terms that set a source apart."""
    d = pick(docs, lang=lang_col, source=source_col, text=text_col).select(
        *[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")])
    ranges = 16
    total = docs.count()
    while ranges * RANGE_DOCS < total:
        ranges *= 2
    blocks = written(count_blocks(d, ranges, digest_bits), "blocks")
    found = written(kept_counts(blocks, min_docs), "kept")
    counts = found.select("lang", "source", "digest", F.lit("").alias("split"), "n")
    names = written(term_names(blocks, found.select("digest").distinct()), "names")
    shared = names.where("term < last").select("digest")
    if not shared.isEmpty():
        exact = written(exact_counts(d, shared, digest_bits), "exact")
        enough = exact.groupBy("lang", "digest", "term").agg(F.sum("df").alias("df")).where(F.col("df") >= min_docs)
        exact = exact.join(enough, ["lang", "digest", "term"], "left_semi")
        counts = counts.join(shared, "digest", "left_anti").select("lang", "source", "digest", "split", "n").unionByName(
            exact.select("lang", "source", "digest", F.col("term").alias("split"), "n"))
        counts = written(counts, "counts")
    return _audited(d, counts, names, ranks)


def _audited(d: DataFrame, counts: DataFrame, names: DataFrame, ranks: int) -> DataFrame:
    """The result from ``counts``: one row per group and kept term that occurs in it."""
    term = ["lang", "digest", "split"]
    of_lang = counts.groupBy(*term).agg(F.sum("n").alias("ln"))
    size = of_lang.groupBy("lang").agg(F.count(F.lit(1)).alias("v"), F.sum("ln").alias("lang_n"))
    own = counts.groupBy("lang", "source").agg(F.sum("n").alias("group_n"))
    groups = d.select("lang", "source").distinct().join(own, ["lang", "source"], "left").join(size, "lang", "left")
    zero = F.lit(0).cast("bigint")
    groups = groups.select("lang", "source", *[F.coalesce(c, zero).alias(c) for c in ("group_n", "v", "lang_n")])
    groups = written(groups.withColumn("p0", _share_sql("0", "group_n", "v")), "groups")

    shares = counts.join(groups, ["lang", "source"]).select(*term, "source", "v", "lang_n", "p0", _share_sql("n", "group_n", "v").alias("p"))
    shares = written(shares, "shares")

    # terms of both sources, beyond what the two sums below say of them
    a, b = (shares.select(*term, F.col("source").alias(f"{x}_source"), F.col("p").alias(f"{x}_p"), F.col("p0").alias(f"{x}_p0"))
            for x in "ab")
    both = a.join(b, term).where("a_source < b_source")
    more = _apart_sql("a_p", "b_p") - _apart_sql("a_p", "b_p0") - _apart_sql("a_p0", "b_p") + _apart_sql("a_p0", "b_p0")
    both = both.groupBy("lang", "a_source", "b_source").agg(F.sum(more).alias("value"))
    # terms of the first source, as if the second lacked them
    alike = shares.groupBy("lang", "source", "p", "p0").agg(F.count(F.lit(1)).alias("n"))
    others = groups.select("lang", F.col("source").alias("other"), F.col("p0").alias("other_p0"))
    lone = alike.join(others, "lang").where("source <> other").groupBy("lang", "source", "other").agg(
        F.sum(F.col("n") * (_apart_sql("p", "other_p0") - _apart_sql("p0", "other_p0"))).alias("value"))
    # terms that both lack
    pairs = groups.join(others, "lang").where("source <> other")
    none = pairs.select("lang", "source", "other", F.coalesce(F.col("v") * _apart_sql("p0", "other_p0"), zero).alias("value"))
    turned = [F.col("lang"), F.col("other").alias("source"), F.col("source").alias("other"), F.col("value")]
    ab = both.select("lang", F.col("a_source").alias("source"), F.col("b_source").alias("other"), "value")
    summed = none.unionByName(lone).unionByName(lone.select(*turned)).unionByName(ab).unionByName(ab.select(*turned))
    pair = summed.groupBy("lang", "source", "other").agg(F.sum("value").cast("bigint").alias("value"))
    pair = pair.select("lang", "source", F.lit("pair").alias("part"), F.col("other").alias("item"), "value")

    q = shares.join(of_lang, term).withColumn("q", _share_sql("ln", "lang_n", "v")).where("p > q")
    q = q.select("lang", "source", "digest", "split", _apart_sql("p", "q").alias("value"))
    best = Window.partitionBy("lang", "source").orderBy(F.desc("value"))
    q = q.withColumn("place", F.rank().over(best)).where(F.col("place") <= ranks)
    text = F.when(F.col("split") != "", F.col("split")).otherwise(F.col("term"))
    named = q.join(names.select("digest", "term"), "digest").select("lang", "source", F.lit("term").alias("part"), text.alias("item"), "value")

    order = Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")
    out = pair.unionByName(named).withColumn("rank", F.row_number().over(order))
    return out.where((F.col("part") == "pair") | (F.col("rank") <= ranks))
