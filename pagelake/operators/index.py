"""Dump index, stream ranges, greedy packing of streams, and validation of the index."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagelake.functions import xml as X
from pagelake.operators.windows import next_value
from pagelake.session import cut_lineage
from pagelake.sources.checked import Checked, split_rows

OFFSET_BLOCK_BYTES = 1 << 30      # offset blocks for ordered work (~1 GiB of dump each)


def tagged_dump_index(lines: DataFrame, col: str = "value") -> DataFrame:
    """``offset:page_id:title`` (title may hold ':') beside the line and, in ``reject``, what is wrong with it."""
    p = f"split({col}, ':', 3)"
    parsed = lines.select(
        F.expr(f"try_cast(try_element_at({p}, 1) AS BIGINT)").alias("offset"),
        F.expr(f"try_cast(try_element_at({p}, 2) AS BIGINT)").alias("page_id"),
        F.expr(f"CASE WHEN size({p}) = 3 THEN try_element_at({p}, 3) END").alias("title"), F.col(col).alias("record"))
    reject = (F.when(F.col("offset").isNull(), F.lit("bad offset")).when(F.col("page_id").isNull(), F.lit("bad id"))
               .when(F.col("title").isNull(), F.lit("no title")))
    return parsed.withColumn("reject", reject)


def parse_dump_index(lines: DataFrame, col: str = "value") -> tuple[DataFrame, DataFrame]:
    """``offset:page_id:title`` lines -> (rows, rejects)."""
    tagged, fine = tagged_dump_index(lines, col), F.col("reject").isNull()
    return tagged.where(fine).select("offset", "page_id", "title"), tagged.where(~fine).select(F.col("record").alias("line"))


def check_dump_index(lines: DataFrame, col: str = "value") -> Checked:
    """As ``parse_dump_index`` in one pass, with the number of lines and of rejects."""
    return split_rows(tagged_dump_index(lines, col))


def index_line_counts(lines: DataFrame, col: str = "value") -> DataFrame:
    """Lines in the dump index, and how many of them do not parse."""
    return tagged_dump_index(lines, col).agg(F.count(F.lit(1)).alias("n_lines"), F.count("reject").alias("n_rejects"))


def distinct_offsets(index: DataFrame) -> DataFrame:
    return index.select("offset").distinct()


def stream_ranges(index: DataFrame, file_len) -> DataFrame:
    """``st, ed`` per distinct stream; ``ed`` is the next offset, the last one ends the file."""
    offs = distinct_offsets(index).withColumnRenamed("offset", "st")
    return next_value(offs, "st", "ed", file_len, OFFSET_BLOCK_BYTES)


def pages_by_stream(index: DataFrame) -> DataFrame:
    """offset -> its pages, ``id title`` per line (bounded: a stream holds at most a few hundred pages)."""
    page = F.struct("page_id", F.concat_ws(" ", F.col("page_id").cast("string"), "title").alias("line"))
    return index.groupBy("offset").agg(
        F.count(F.lit(1)).alias("n_pages"),
        F.array_join(F.transform(F.array_sort(F.collect_list(page)), lambda p: p["line"]), "\n").alias("pages"))


def greedy_pack_starts(ranges: DataFrame, limit: int, max_rounds: int = 64) -> DataFrame:
    """Greedy byte packing: a pack closes at the first stream with ``ed - base > limit``.

    ``f(base)`` = end of the stream that contains byte ``base + limit``; found
    with a binned range join.  The pack boundaries are the orbit of the first
    offset under ``f``, collected by pointer doubling: after round k the set
    holds ``f^t(s0)`` for all ``t < 2^k`` (log rounds, each a join).
    Returns ``st, ed, pack_start`` for every stream.
    """
    spark = ranges.sparkSession
    width = max(int(limit), 1)
    streams = cut_lineage(ranges.select("st", "ed"))   # read four times below
    bins = streams.select("st", "ed", F.explode(F.sequence(
        F.floor(F.col("st") / width).cast("bigint"),
        F.greatest(F.floor((F.col("ed") - 1) / width), F.floor(F.col("st") / width)).cast("bigint"))).alias("bin"))
    s0 = streams.agg(F.min("st").alias("x"))
    cands = streams.select(F.col("ed").alias("x")).unionByName(s0).distinct()
    probes = cands.withColumn("p", F.col("x") + F.lit(limit)).withColumn(
        "bin", F.floor(F.col("p") / width).cast("bigint"))
    hit = probes.join(bins, "bin").where((F.col("st") <= F.col("p")) & (F.col("p") < F.col("ed")))
    jump = cut_lineage(probes.join(hit.select("x", F.col("ed").alias("nxt")), "x", "left").select("x", "nxt"))
    # Round k adds f^t(s0) for 2^k <= t < 2^(k+1): always new points, so the
    # orbit is a plain union of the checkpointed rounds (no re-deduplication).
    orbit = cut_lineage(s0)
    for _ in range(max_rounds):
        reach = cut_lineage(orbit.join(jump.where(F.col("nxt").isNotNull()), "x").select(F.col("nxt").alias("x")))
        if reach.count() == 0:
            break
        orbit = orbit.unionByName(reach)
        j2 = jump.alias("a").join(jump.alias("b"), F.col("a.nxt") == F.col("b.x"), "left")
        jump = cut_lineage(j2.select(F.col("a.x").alias("x"), F.col("b.nxt").alias("nxt")))
    else:  # pragma: no cover - 2^64 packs
        raise RuntimeError("greedy packing did not converge")
    starts = orbit.select(F.col("x").alias("st"), F.lit(True).alias("pack_start"))
    out = streams.join(starts, "st", "left")
    return out.select("st", "ed", F.coalesce("pack_start", F.lit(False)).alias("pack_start"))


def validate_index(index: DataFrame, records: DataFrame) -> DataFrame:
    """Index against stored records, per stream; pages that are stored but not indexed report under stream -1.

    ``index``: ``offset, page_id, title``.  ``records``: ``record``, raw page
    XML; id and title are read from the record's own elements, so a wrong one
    on either side shows.  Titles are compared trimmed; a title that holds
    U+0085 is compared as that character.  A record without an id, or one that
    is malformed, has no title and is not well-formed.
    """
    head = F.substring_index("record", "<revision>", 1)
    stored = records.select(
        F.regexp_extract(head, "<id>([0-9]+)</id>", 1).try_cast("bigint").alias("rec_id"),
        F.regexp_extract(head, "(?s)<title>(.*?)</title>", 1).alias("rec_title"),
        X.xml_valid("record").alias("rec_ok"))
    trimmed = F.trim("title")
    expected = X.xml_escape(F.when(F.instr("title", "\u0085") > 0, F.lit("\u0085")).otherwise(trimmed))
    j = index.join(stored, index["page_id"] == stored["rec_id"], "full_outer")
    indexed, found = F.col("page_id").isNotNull(), F.col("rec_ok").isNotNull()
    ok = F.coalesce("rec_ok", F.lit(False))
    flags = j.select(
        F.coalesce("offset", F.lit(-1)).alias("offset"), indexed.alias("indexed"), found.alias("stored"),
        (indexed & ok).alias("id_ok"), (F.coalesce(F.trim("rec_title") == expected, F.lit(False)) & ok).alias("title_ok"),
        ok.alias("xml_ok"))
    return flags.groupBy("offset").agg(
        F.count_if("indexed").alias("n_indexed"), F.count_if("stored").alias("n_stored"),
        F.bool_and("id_ok").alias("ids_ok"), F.bool_and("title_ok").alias("titles_ok"),
        F.bool_and("xml_ok").alias("xml_ok"),
    ).withColumn("valid", F.col("ids_ok") & F.col("titles_ok") & F.col("xml_ok"))


def all_valid(report: DataFrame) -> DataFrame:
    return report.agg(F.coalesce(F.bool_and("valid"), F.lit(True)).alias("all_valid"),
                      F.count(F.lit(1)).alias("n_streams"))
